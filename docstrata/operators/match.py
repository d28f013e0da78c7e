"""Gazetteer matching: greedy leftmost-longest phrases, strict names, and fuzzy single words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.storage import stored
from docstrata.functions.text import tokens

MIN_FUZZY_LENGTH = 6
FUZZY_CUTOFF = 92.0
EXACT_CONFIDENCE, FUZZY_CONFIDENCE = 0.95, 0.8
DEMONSTRATING = ("experience", "projects", "publications")


#: Hits that a scan takes one by one before it puts them with the others.
RUN = 16


def greedy(hits: Column) -> Column:
    """Of ``hits`` (array of structs, sorted, with pos and n) those that a left-to-right scan takes.

    Hits are scanned in runs, and only whole runs are put together, so an array of very many hits is not
    copied once for each of them.
    """

    def step(s: Column, h: Column) -> Column:
        take = h["pos"] >= s["free"]
        return F.struct(
            F.when(take, h["pos"] + h["n"]).otherwise(s["free"]).alias("free"),
            F.when(take, F.concat(s["out"], F.array(h))).otherwise(s["out"]).alias("out"),
        )

    def run(s: Column, k: Column) -> Column:
        start = F.struct(s["free"].alias("free"), F.slice(hits, 1, 0).alias("out"))
        scanned = F.aggregate(F.slice(hits, k * RUN + 1, F.lit(RUN)), start, step)
        put = lambda r: F.struct(r["free"].alias("free"), F.concat(s["out"], F.array(r["out"])).alias("out"))
        return F.get(F.transform(F.array(scanned), put), 0)

    runs = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int"))
    nothing = F.struct(F.lit(0).alias("free"), F.slice(F.array(hits), 1, 0).alias("out"))
    return F.aggregate(runs, nothing, run, lambda s: F.flatten(s["out"]))


def exact_matches(texts: DataFrame, surfaces: DataFrame, keys: list[str], longest: int, allow_strict: Column | None = None, text_col: str = "text") -> DataFrame:
    """(keys, pos, n, skill_id) of every phrase that a greedy scan of each text takes.

    ``longest`` bounds the words of a surface.  A strict surface counts only where ``allow_strict``
    holds and it is written as the name or in lower case; otherwise shorter phrases at the same place
    are tried.  Hits meet in one shuffle by ``keys``; of those at one place the scan takes the longest.
    """
    allowed = F.lit(False) if allow_strict is None else allow_strict
    rows = texts.select(*keys, allowed.alias("allowed"), tokens(text_col).alias("tk"))
    # The outer form, since Spark would tokenise again to filter empty arrays out before the plain one.
    rows = rows.select(*keys, "allowed", "tk", F.posexplode_outer("tk").alias("pos", "word"))
    # Only places whose first word opens some surface go on, with the words that follow.
    heads = surfaces.select(F.substring_index("surface", " ", 1).alias("head")).distinct()
    rows = rows.select(*keys, "allowed", "pos", F.slice("tk", F.col("pos") + 1, F.lit(longest)).alias("win"), F.lower("word").alias("head")).join(heads, "head", "left_semi")
    rows = rows.select(*keys, "allowed", "pos", "win", F.explode(F.sequence(F.lit(1), F.size("win"))).alias("n"))
    rows = rows.withColumn("written", F.array_join(F.slice("win", F.lit(1), F.col("n")), " ")).withColumn("surface", F.lower("written"))
    hits = rows.join(surfaces.select("surface", "skill_id", "name", "strict"), "surface")
    hits = hits.filter("NOT strict OR (allowed AND (written = name OR written = surface))")
    found = F.struct("pos", (-F.col("n")).alias("shorter"), "n", "skill_id")
    gathered = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(found)).alias("hits"))
    return gathered.select(*keys, F.explode_outer(greedy(F.col("hits"))).alias("h")).select(*keys, "h.pos", "h.n", "h.skill_id")


def mention_counts(texts: DataFrame, surfaces: DataFrame, keys: list[str], longest: int, text_col: str = "text") -> DataFrame:
    """(keys, skill_id, mentions); strict names count anywhere, misspellings nowhere."""
    found = exact_matches(texts, surfaces, keys, longest, F.lit(True), text_col)
    return found.groupBy(*keys, "skill_id").agg(F.count(F.lit(1)).alias("mentions"))


#: Letters of a word whose places fit a long, with room for the carry of an addition.
WORD_BITS = 62


def _by_bits(a: Column, b: Column) -> Column:
    """Common subsequence of ``a`` (at most ``WORD_BITS`` letters) and ``b``, a long for each row of the table.

    Bit j is set while letter j of ``a`` has not raised the row; a row follows from the one before by an
    addition, whose carries move the raises, and the unset bits are the length.
    """
    letters, none = F.split(a, ""), F.lit(0).cast("long")
    places = lambda c: F.aggregate(F.reverse(letters), none, lambda bits, x: bits * 2 + F.when(x == c, 1).otherwise(0))
    masks = F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, places(c))))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(a)) - 1

    def run(s: Column) -> Column:
        def row(bits: Column, c: Column) -> Column:
            met = bits.bitwiseAND(F.coalesce(F.try_element_at(s["masks"], c), none))
            return (bits + met).bitwiseOR(bits - met).bitwiseAND(s["full"])

        return F.aggregate(F.split(b, ""), s["full"], row, lambda bits: (F.length(a) - F.bit_count(bits)).cast("int"))

    # Bound once: inside the fold the masks would be built again for every letter.
    return F.get(F.transform(F.array(F.struct(masks.alias("masks"), full.alias("full"))), run), 0)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings; null if one is null.

    In 64-bit arithmetic where the first has ``WORD_BITS`` letters at most, else by rows of the table.
    """
    return F.when(F.length(a) <= WORD_BITS, F.when(b.isNotNull(), _by_bits(a, b))).otherwise(_by_rows(a, b))


def _by_rows(a: Column, b: Column) -> Column:
    other = F.split(b, "")

    def row(before: Column, letter: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            longer = F.when(F.get(other, j) == letter, F.get(before, j) + 1).otherwise(F.greatest(F.get(before, j + 1), F.get(now, j)))
            return F.concat(now, F.array(longer))

        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), cell)

    return F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.length(b) + 1), row, lambda r: F.element_at(r, -1))


def fuzzy_best(words: DataFrame, surfaces: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """``words(token)``, distinct, to (token, skill_id, surface, score): the nearest single-word surface.

    The score is 200 * LCS / (sum of lengths); ties go to the earlier candidate.  A pair that reaches the
    cutoff differs by ``most`` letters at most, so one of ``most + 1`` equal parts of the surface stands
    unchanged in the word, moved by ``most`` places at most: candidates meet in an equality join on that
    part, and edit distance and exact score judge them.
    """
    slack = 1 - cutoff / 100
    most = lambda a, b: F.floor(F.lit(slack) * (a + b) + 1e-9).cast("int")
    own, other = F.col("len"), F.col("other")

    def met(rows: DataFrame, own: Column) -> DataFrame:
        """Each row with every length of the other side that may match, and the letters that may differ."""
        reach = F.floor(F.lit(2 * slack) * own / (1 - slack)).cast("int")
        rows = rows.withColumn("len", own).withColumn("other", F.explode(F.sequence(own - reach, own + reach)))
        rows = rows.withColumn("most", most(F.col("len"), other)).filter("abs(len - other) <= most")
        return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("most"))))

    def part_of(size: Column) -> tuple[Column, Column]:
        """Begin and length of a surface's part."""
        begin = F.floor(F.col("part") * size / (F.col("most") + 1)).cast("int")
        return begin, F.floor((F.col("part") + 1) * size / (F.col("most") + 1)).cast("int") - begin

    cand = surfaces.filter(f"NOT strict AND n_words = 1 AND length(surface) >= {MIN_FUZZY_LENGTH}").select("surface", "skill_id", "cand_ord")
    begin, size = part_of(own)
    left = met(cand, F.length("surface")).select("surface", "skill_id", "cand_ord", own.alias("s_len"), other.alias("t_len"), "part", F.substring(F.col("surface"), begin + 1, size).alias("letters"))
    begin, size = part_of(other)
    right = met(words.filter(F.length("token") >= MIN_FUZZY_LENGTH), F.length("token")).withColumn("begin", begin).withColumn("size", size)
    right = right.withColumn("begin", F.explode(F.sequence(F.col("begin") - F.col("most"), F.col("begin") + F.col("most")))).filter("begin >= 0 AND begin + size <= len")
    right = right.select("token", other.alias("s_len"), own.alias("t_len"), "most", "part", F.substring(F.col("token"), F.col("begin") + 1, F.col("size")).alias("letters"))
    both = right.join(left, ["s_len", "t_len", "part", "letters"]).select("token", "surface", "skill_id", "cand_ord", "most").distinct()
    both = both.filter("levenshtein(token, surface) <= most")
    score = F.lit(200.0) * common_subsequence(F.col("token"), F.col("surface")) / (F.length("token") + F.length("surface"))
    scored = both.withColumn("score", score).filter(F.col("score") >= cutoff)
    best = scored.groupBy("token").agg(F.min(F.struct((-F.col("score")).alias("s"), "cand_ord", "surface", "skill_id")).alias("b"))
    return best.select("token", "b.skill_id", "b.surface", (-F.col("b.s")).alias("score"))


def extract_skills(section_texts: DataFrame, surfaces: DataFrame, longest: int, doc: str = "doc_id") -> DataFrame:
    """``section_texts(doc, section_ord, kind, text)`` to one row per document and skill.

    Exact phrases in all sections come first; a misspelling adds a skill that is not among them, found
    in the first section that has it.  Columns: doc, skill_id, name, category, evidence, found_in
    (sorted), confidence, skill_ord (demonstrated first, then category and name).
    """
    exact = exact_matches(section_texts, surfaces, [doc, "kind"], longest, F.col("kind") == "skills").select(doc, "skill_id", "kind", F.lit(None).cast("struct<section_ord:int,pos:int,kind:string>").alias("at"))
    placed = section_texts.select(doc, F.col("section_ord").cast("int").alias("section_ord"), "kind", F.posexplode_outer(tokens(F.lower("text"))).alias("pos", "token")).filter(F.length("token") >= MIN_FUZZY_LENGTH)
    # Written, so that its size is known: a short list goes to the tokens, which then stay where they are.
    best = stored(fuzzy_best(placed.select("token").distinct(), surfaces).select("token", "skill_id"), "misspelt")
    near = placed.join(best, "token").select(doc, "skill_id", F.lit(None).cast("string").alias("kind"), F.struct("section_ord", "pos", "kind").alias("at"))
    found = exact.unionByName(near).groupBy(doc, "skill_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.min("at").alias("at"))
    spelt = F.size("kinds") > 0
    skills = found.select(
        doc, "skill_id", F.when(spelt, F.col("kinds")).otherwise(F.array("at.kind")).alias("found_in"), F.when(spelt, EXACT_CONFIDENCE).otherwise(FUZZY_CONFIDENCE).alias("confidence")
    )
    shown = F.arrays_overlap("found_in", F.array(*[F.lit(k) for k in DEMONSTRATING]))
    named = surfaces.groupBy("skill_id").agg(F.first("name").alias("name"), F.first("category").alias("category"))
    skills = skills.join(named, "skill_id").withColumn("evidence", F.when(shown, "demonstrated").otherwise("claimed"))
    order = Window.partitionBy(doc).orderBy(F.col("evidence") == "claimed", "category", F.lower("name"), "skill_id")
    return skills.select(doc, "skill_id", "name", "category", "evidence", "found_in", "confidence", F.row_number().over(order).alias("skill_ord"))
