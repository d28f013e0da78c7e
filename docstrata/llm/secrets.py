"""Secret scanning with corpus-wide ownership frequency.

Three base patterns find candidate credentials.  Every candidate value is hashed and counted over the
whole corpus by distinct repositories and distinct owners.  Values that many repositories of several
owners share are widely copied examples; values that stay with one owner, in however many repositories,
and look random are reported as live.
Besides classing the base spans, the frequencies add spans outside every base span whose value stays with one
owner: credentials by their form (bearer headers, passwords in addresses, keys by prefix, private-key blocks) and,
of kind ``owned``, other long mixed tokens.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import stored, whole_text

#: Fixed patterns; each is matched leftmost and without overlap, then short matches are dropped.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A run of 24 or more token letters; it counts where a digit, a capital and a small letter are among them.
MIXED = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}"
#: Credentials by their form: kind, a string that every match holds (in small letters, searched without case), pattern,
#: the group of the value, its least length.
FORMS = (
    ("bearer", "bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]++=*+)", 1, 16),
    ("address", "://", r"://[^\s/:@]++:([^\s/:@]++)@", 1, 6),
    ("prefixed", None, r"(?<![A-Za-z0-9_-])(?:gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}+", 0, 20),
    ("private_key", "private key-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----", 0, 64),
)
#: Matches whose positions are summed one by one.
RUN = 128
KINDS = ("assign", "access", "hex", "owned", *[f[0] for f in FORMS])


def _spans(text: Column, pattern: str, rank: int, value_group: int, least: int) -> Column:
    """array<struct<start, rank, end, value>> of one pattern's matches, in code points.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches, so running
    sums of lengths are the positions.  They are summed in runs of ``RUN`` matches, and the runs' lengths
    then move each run to its place, so a text with very many matches costs no square of their number.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    kind = "array<struct<start:int,rank:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value"))
        ok = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.alias("at"), F.when(ok, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    # A value that a function needs twice is bound to a name by a one-element array.
    bound = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    runs = bound(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(p, k * RUN + 1, F.lit(RUN)), start, step)))

    def placed(runs: Column) -> Column:
        def move(run: Column, k: Column) -> Column:
            before = F.aggregate(F.slice(runs, F.lit(1), k), F.lit(0), lambda n, r: n + r["at"])
            shifted = lambda b: F.transform(run["out"], lambda s: F.struct((s["start"] + b).alias("start"), s["rank"].alias("rank"), (s["end"] + b).alias("end"), s["value"].alias("value")))
            return bound(before, shifted)

        return F.flatten(F.transform(runs, move))

    return F.when(text.rlike(pattern), bound(runs, placed)).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> Column:
    """The spans of the three base patterns by start, then kind; their value is what is counted."""
    found = F.concat(
        _spans(text, ASSIGN, 0, 1, 12), _spans(text, ACCESS, 1, 0, 18), _spans(text, HEX, 2, 0, 16)
    )
    return F.array_sort(found)


def mixed_spans(text: Column) -> Column:
    return F.filter(_spans(text, MIXED, 3, 0, 24), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))


def form_spans(text: Column) -> Column:
    """Credentials by their form, by start."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    found = []
    for rank, (_, hint, pattern, group, least) in enumerate(FORMS, 4):
        spans = _spans(text, pattern, rank, group, least)
        found.append(spans if hint is None else F.when(F.contains(F.lower(text), F.lit(hint)), spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def looks_real(value: Column) -> Column:
    """None of the words that mark examples."""
    return ~F.lower(value).rlike("example|sample|dummy|changeme|placeholder|your_?|xxxx|0000000")


def looks_random(value: Column) -> Column:
    """At least ten different letters, and not one of the words that mark examples."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 10) & looks_real(value)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "source",
    owner_col: str | None = None,
    max_owners: int = 1,
    wide_repos: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: the id, counts by kind and class, digests, ``found`` (all spans) and ``mark`` (a hash of the text).

    ``repo_col`` names the repository; the owner is ``owner_col`` or, by default, the repository's name
    before a ``/``.  A null repository counts as one of its own name, ''.  A value with at most ``max_owners``
    owners that looks random is live; one of more owners in ``wide_repos`` or more repositories is an example.
    A credential by its form need not look random, as its form says what it is; it is reported where its value
    has at most ``max_owners`` owners.  Of added spans those that meet a base span are dropped, and mixed tokens that
    meet a credential by its form.
    Null and empty texts have no spans; rows that repeat an id count once each and get equal results.
    Other columns are ignored.
    """
    text = whole_text(text_col)
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col else F.substring_index(repo, "/", 1)
    first = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), repo.alias("repo"), owner.alias("owner"), base_spans(text).alias("base"), form_spans(text).alias("forms"), mixed_spans(text).alias("mixed"))
    clear = lambda m, of: ~F.exists(of, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    random = lambda s: F.when(s["rank"] > 3, looks_real(s["value"])).otherwise(looks_random(s["value"]))
    keyed = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("key"), random(s).alias("random"))
    added = F.concat(F.filter("forms", lambda m: clear(m, "base")), F.filter("mixed", lambda m: clear(m, "base") & clear(m, "forms")))
    rows = first.select("id", "mark", "repo", "owner", F.transform("base", keyed).alias("base"), F.transform(added, keyed).alias("mixed"))
    # The texts are read once; what follows works on the few spans.  A row key tells repeated ids apart.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "spans")
    spans = rows.select("row", "repo", "owner", F.explode(F.concat("base", "mixed")).alias("s")).select("row", "repo", "owner", "s.*")
    # Distinct (value, repository, owner) first: a value that a third of the rows hold shrinks before it meets.
    places = spans.groupBy("key", "repo", "owner").agg(F.max("random").alias("random"))
    counts = places.groupBy("key").agg(
        F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.max("random").alias("random")
    )
    kind = F.when((F.col("n_repos") >= wide_repos) & (F.col("n_owners") > max_owners), "example").when((F.col("n_owners") <= max_owners) & F.col("random"), "live").otherwise("unsure")
    # Both sides of this join are plain reads, so adaptive execution can split a value that most rows hold.
    classes = stored(counts.select("key", "n_repos", "n_owners", kind.alias("class")), "values")
    classed = spans.join(classes, "key")
    per_row = (
        classed.filter("rank < 3 OR class = 'live'")
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "rank", "end", "class", "n_repos", "n_owners"))).alias("found"),
        )
    )
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,class:string,n_repos:bigint,n_owners:bigint>>")
    out = rows.select("id", "mark", "row").join(per_row, "row", "left").select("id", "mark", F.coalesce("found", empty).alias("found"))
    # A second parameter of the inner function would be taken for the element's index.
    count = lambda f: F.size(F.filter("found", f)).cast("long")
    of_rank = lambda rank: count(lambda s: s["rank"] == rank)
    return out.select(
        F.col("id").alias(id_col),
        *[of_rank(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)],
        count(lambda s: (s["rank"] < 3) & (s["class"] == "live")).alias("n_live"),
        count(lambda s: (s["rank"] < 3) & (s["class"] == "example")).alias("n_example"),
        F.sha2(_joined(F.filter("found", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        "found",
        "mark",
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """``docs`` with every reported span but widely copied examples replaced by ``mask``; n_chars follows.

    Overlapping spans are replaced once, as their union.  Rows without spans pass unchanged, nulls
    included.
    """
    # Ids may repeat with other texts, so a hash of the text goes with the id.
    spans = F.filter("found", lambda s: s["class"] != "example").alias("cut")
    found = scan_secrets(docs, repo_col=repo_col, owner_col=owner_col).filter("size(found) > 0").select(F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark"), spans)
    found = found.filter("size(cut) > 0").dropDuplicates(["cut_id", "cut_mark"])
    # The row travels as one value, so its columns may have any names.
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(whole_text("text")).alias("own_mark"))
    text, start = F.col("row")["text"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    tail = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    joined = marked.join(found, F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own_mark") == F.col("cut_mark")), "left")
    masked = joined.select("row", F.when(F.col("cut").isNotNull(), F.aggregate("cut", start, step, tail)).alias("masked"))
    changed = F.col("masked").isNotNull()
    new = {"text": F.coalesce("masked", F.col("row")["text"]), "n_chars": F.when(changed, F.length("masked").cast("long")).otherwise(F.col("row")["n_chars"])}
    return masked.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
