"""Coverage of profiles by weighted items, and gaps against a list of required items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.text import rounded

TOP_ROLES, TOP_GAPS = 3, 8


def evidence_tenths(evidence: str = "evidence") -> Column:
    """The weight of an item's evidence in tenths."""
    return F.when(F.col(evidence) == "demonstrated", 10).otherwise(6)


def distinctiveness(profiles: DataFrame, profile: str = "role", item: str = "skill_id") -> DataFrame:
    """(item, appearances, distinctiveness): one over the number of profiles that name the item."""
    seen = profiles.groupBy(item).agg(F.count_distinct(profile).alias("appearances"))
    return seen.withColumn("distinctiveness", F.lit(1.0) / F.col("appearances"))


def _by_appearances(rows: DataFrame, keys: list[str], amount: Column, name: str) -> DataFrame:
    """(keys, name): the sum of ``amount`` over ``appearances``.

    Amounts of one count of appearances are whole numbers and add up exactly; the quotients are added in
    the order of that count, so no result depends on how rows are dealt out.
    """
    per = rows.groupBy(*keys, "appearances").agg(F.sum(amount).alias("amount"))
    per = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("appearances", "amount"))).alias("parts"))
    return per.select(*keys, F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["amount"] / p["appearances"]).alias(name))


def coverage(owned: DataFrame, profiles: DataFrame, owner: str = "doc_id", profile: str = "role", item: str = "skill_id") -> DataFrame:
    """``owned(owner, item, tenths)`` against ``profiles(profile, item)``: (owner, profile, matched, available).

    An item counts one over the number of profiles that name it; ``matched`` is in tenths of that.
    Profiles that an owner matches nowhere have no row.
    """
    profiles = profiles.select(profile, item).distinct()
    named = profiles.join(distinctiveness(profiles, profile, item).select(item, "appearances"), item)
    available = _by_appearances(named, [profile], F.lit(1), "available")
    matched = _by_appearances(owned.join(named, item), [owner, profile], F.col("tenths"), "matched")
    return matched.join(available, profile).select(owner, profile, "matched", "available")


def top_profiles(owned: DataFrame, profiles: DataFrame, owner: str = "doc_id", profile: str = "role", item: str = "skill_id", k: int = TOP_ROLES) -> DataFrame:
    """The ``k`` best covered profiles of each owner: (owner, rank, profile, confidence).

    Confidence is the share of the coverage over all profiles, rounded to two digits.
    """
    score = coverage(owned, profiles, owner, profile, item).withColumn("score", F.col("matched") / (F.col("available") * 10.0))
    # Sums in a fixed order, so that equal inputs give equal doubles.
    per = score.groupBy(owner).agg(F.sort_array(F.collect_list("score")).alias("all"))
    per = per.select(owner, F.aggregate("all", F.lit(0.0), lambda a, x: a + x).alias("total"))
    order = Window.partitionBy(owner).orderBy(F.desc("score"), profile)
    ranked = score.join(per, owner).withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("score") > 0))
    return ranked.select(owner, "rank", profile, rounded(F.col("score") / F.col("total"), 2).alias("confidence"))


def gap_analysis(owned: DataFrame, required: DataFrame, names: DataFrame, owner: str = "doc_id", request: str = "jd_id", item: str = "skill_id", k: int = TOP_GAPS) -> DataFrame:
    """``required(owner, request, item, mentions)`` against ``owned(owner, item)``.

    One row per owner and request with something required: similarity (share of required items owned),
    matched names (sorted) and the ``k`` most important missing ones with their importance.
    """
    have = owned.select(owner, item).distinct().withColumn("has", F.lit(True))
    rows = required.join(have, [owner, item], "left").join(names.select(item, "name"), item)
    most = F.max("mentions").over(Window.partitionBy(owner, request))
    rows = rows.withColumn("importance", rounded(F.col("mentions") / most, 2)).withColumn("has", F.coalesce("has", F.lit(False)))
    gap = F.struct((-F.col("importance")).alias("order"), F.col("name").alias("skill"), "importance")
    out = rows.groupBy(owner, request).agg(
        rounded(F.count_if("has") / F.count(F.lit(1)), 2).alias("similarity"),
        F.sort_array(F.collect_list(F.when(F.col("has"), F.col("name")))).alias("matched_skills"),
        F.sort_array(F.collect_list(F.when(~F.col("has"), gap))).alias("gaps"),
    )
    cut = F.transform(F.slice("gaps", 1, k), lambda g: F.struct(g["skill"].alias("skill"), g["importance"].alias("importance")))
    return out.select(owner, request, "similarity", "matched_skills", cut.alias("missing_skills"))
