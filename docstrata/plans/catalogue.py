"""The registered queries of the reference operators, and the SQL that must give the same rows.

Text operators run over the whole ``documents`` table, relational ones over the order tables; layout and
segmentation get lines of ``documents`` with boxes and fonts derived from line numbers by integer
arithmetic, so that SQL can derive them too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import dims, text
from docstrata.functions.storage import scratch_path
from docstrata.operators import admission, advise, ats, fit, gazetteer, layout, match, present, segment
from docstrata.plans import samples
from docstrata.plans.analyze import Dimensions, analyze, with_report
from docstrata.sources import files
from docstrata.streaming.admission import replay
from docstrata.streaming.intake import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("ln", "line")).filter("ln IS NOT NULL")


LINES = "lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents)"
TOKENS = "list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9+#.]+'), lambda t: rtrim(t, '.')), lambda t: t <> '')"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# --- text ---------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format(x='text')} AS tk FROM documents) SELECT doc_id, len(tk) AS n_tokens, len(list_distinct(list_transform(tk, lambda t: lower(t)))) AS n_distinct FROM t")
def text_tokenise_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", text.tokens("text").alias("tk"))
    return rows.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.transform("tk", F.lower))).cast("long").alias("n_distinct"))


@query(f"WITH {LINES} SELECT doc_id, ln, trim(regexp_replace(regexp_replace(lower({STRIP.format(x='line')}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM lines")
def text_heading_normalise(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.col("ln").cast("long").alias("ln"), text.heading_norm("line").alias("norm"))


_KEY = f"lower({STRIP.format(x=chr(123) + 'y' + chr(125))})".replace("{y}", "regexp_replace(line, '\\d+', '', 'g')")


@query(f"WITH {LINES} SELECT {_KEY} AS key, count(*) AS n FROM lines GROUP BY 1")
def text_furniture_key(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(text.furniture_key("line").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {LINES}, seen AS (SELECT DISTINCT doc_id, ln % 3 AS page, {_KEY} AS key FROM lines WHERE line <> ''),
    keys AS (SELECT doc_id, key, count(*) AS pages FROM seen GROUP BY ALL)
    SELECT doc_id, max(pages) >= 2 AS text_in_header_footer FROM keys GROUP BY doc_id"""
)
def text_running_furniture(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(
        "doc_id", (F.col("ln") % 3).alias("page_number"), F.col("line").alias("text"), F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"), F.lit(792.0).alias("page_height")
    )
    return layout.running_furniture(rows)


@query(
    """WITH t AS (SELECT doc_id, replace(replace(text, 'n', ''), 'r', '') AS cleaned FROM documents)
    SELECT doc_id, md5(cleaned) AS cleaned_md5, len(list_filter(regexp_split_to_array(cleaned, '\\s+'), lambda w: w <> ''))::INTEGER AS n_words FROM t"""
)
def text_glyph_drop(spark, sf_dir):
    """Two letters of every text stand for glyphs that a font did not map."""
    rows = _docs(spark, sf_dir).withColumn("cleaned", text.drop_glyphs(F.translate("text", "nr", "\ue001\ufffd")))
    return rows.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), text.word_count("cleaned").alias("n_words"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INTEGER AS n_words FROM documents")
def text_word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.word_count("text").alias("n_words"))


@query(
    f"""WITH t AS (SELECT doc_id, {STRIP.format(x='text')} AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 200 THEN s ELSE regexp_replace(substr(s, 1, 199), '\\s+$', '') || '…' END AS excerpt FROM t"""
)
def text_excerpt(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.excerpt("text").alias("excerpt"))


@query(f"WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '\\p{{L}}') AND NOT regexp_matches(line, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]')) AS n_upper FROM lines GROUP BY doc_id")
def text_upper_case_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(text.is_upper_case("line")).alias("n_upper"))


# --- masks --------------------------------------------------------------------------------------


def _masked(name: str, mask, sql: str):
    def run(spark, sf_dir):
        docs = _docs(spark, sf_dir).withColumn("masked", mask("text"))
        return docs.select("doc_id", F.md5("masked").alias("masked_md5"), (F.col("masked") != F.col("text")).alias("changed"))

    run.__name__ = name
    query(sql)(run)


#: The pattern of telephone numbers without looking around: what a number may start with is told by borders.
_GROUPS = r"(?:\(?\d{2,4}\)?[\s.-]?)"
_PHONE = rf"(?:\B\+\d{{1,3}}[\s.-]?|\b\d{{1,3}}[\s.-]?){_GROUPS}{{2,4}}\d{{2,4}}\b|(?:\B\(|\b)\d{{2,4}}\)?[\s.-]?{_GROUPS}{{1,3}}\d{{2,4}}\b"
_PHONES = rf"""array_to_string(list_transform(range(1, len(regexp_split_to_array({{x}}, '{_PHONE}')) + 1), lambda k: regexp_split_to_array({{x}}, '{_PHONE}')[k] || coalesce(
    CASE WHEN regexp_matches(regexp_extract_all({{x}}, '{_PHONE}')[k], '^\s*(19|20)\d{{{{2}}}}\s*-\s*(19|20)\d{{{{2}}}}\s*$') OR length(regexp_replace(regexp_extract_all({{x}}, '{_PHONE}')[k], '\D', '', 'g')) < 8
         THEN regexp_extract_all({{x}}, '{_PHONE}')[k] WHEN regexp_extract_all({{x}}, '{_PHONE}')[k] IS NOT NULL THEN '[PHONE]' END, '')), '')"""


def _mask_sql(*steps: str) -> str:
    """The steps in order, each on the ``x`` of the one before."""
    chain = ", ".join(f"m{k + 1} AS (SELECT doc_id, text, {step} AS x FROM m{k})" for k, step in enumerate(steps))
    return f"WITH m0 AS (SELECT doc_id, text, text AS x FROM documents), {chain} SELECT doc_id, md5(x) AS masked_md5, x <> text AS changed FROM m{len(steps)}"


def _replaced(pattern: str, token: str) -> str:
    return f"regexp_replace(x, '{pattern}', '{token}', 'g')"


_masked("pii_email_mask", text.mask_emails, _mask_sql(_replaced(text.EMAIL, "[EMAIL]")))
_masked("pii_handle_mask", text.mask_handles, _mask_sql(_replaced(text.HANDLE.replace("(?iU)", "(?i)"), "[URL]")))
_masked("pii_url_mask", text.mask_urls, _mask_sql(_replaced(text.URL.replace("(?iU)", "(?i)"), "[URL]")))
_masked("pii_postal_mask", text.mask_postal_codes, _mask_sql(_replaced(text.POSTAL.replace("(?U)", ""), "[POSTAL]")))
_PHONE_STEP = _PHONES.replace(_PHONE, "@").replace("{x}", "x").replace("{{", "{").replace("}}", "}").replace("@", _PHONE)
_masked("pii_phone_mask", text.mask_phones, _mask_sql(_PHONE_STEP))
_masked(
    "pii_scrub",
    text.scrubbed,
    _mask_sql(_replaced(text.EMAIL, "[EMAIL]"), _replaced(text.HANDLE.replace("(?iU)", "(?i)"), "[URL]"), _replaced(text.URL.replace("(?iU)", "(?i)"), "[URL]"), _PHONE_STEP, _replaced(text.POSTAL.replace("(?U)", ""), "[POSTAL]")),
)


# --- matching -----------------------------------------------------------------------------------

#: Phrases that do occur in the prose, as (id, name, category).
PHRASES = (("w:of-the", "of the", "two"), ("w:the", "the", "one"), ("w:and-the", "and the", "two"), ("w:and", "and", "one"), ("w:de-la", "de la", "two"), ("w:la", "la", "one"), ("w:und", "und", "one"), ("w:in", "in", "one"))


def _phrases(spark: SparkSession) -> DataFrame:
    return dims.taxonomy(dims.skills_frame(spark, [(i, n, c, False, []) for i, n, c in PHRASES]))


_LONG_FIRST = sorted(PHRASES, key=lambda p: -len(p[1].split()))
_ALTERNATIVES = "|".join("".join(f" {w} " for w in n.split()) for _, n, _ in _LONG_FIRST)
_IDS = ", ".join(f"('{''.join(f' {w} ' for w in n.split())}', '{i}', '{n}', '{c}')" for i, n, c in PHRASES)
#: Each token between blanks of its own: leftmost-first alternation, longest first, is the greedy scan.
_SCAN = "regexp_extract_all(list_aggregate(list_transform(" + TOKENS.format(x="lower({x})") + ", lambda t: ' ' || t || ' '), 'string_agg', ''), '" + _ALTERNATIVES + "')"


@query(
    f"""WITH ids(hit, skill_id, name, category) AS (VALUES {_IDS}), hits AS (SELECT doc_id, unnest({_SCAN.format(x='text')}) AS hit FROM documents)
    SELECT doc_id, skill_id, count(*) AS mentions FROM hits JOIN ids USING (hit) GROUP BY ALL"""
)
def match_mention_counts(spark, sf_dir):
    return match.mention_counts(_docs(spark, sf_dir), _phrases(spark), ["doc_id"], 2)


@query(
    f"""WITH hits AS (SELECT doc_id, unnest({_SCAN.format(x='text')}) AS hit FROM documents)
    SELECT doc_id, count(*) AS n_matches, sum(len(string_split(trim(hit), '  '))) ::BIGINT AS n_words FROM hits GROUP BY ALL"""
)
def match_exact_greedy(spark, sf_dir):
    found = match.exact_matches(_docs(spark, sf_dir), _phrases(spark), ["doc_id"], 2)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"), F.sum("n").alias("n_words"))


#: A strict name, a phrase that holds it, and another word; strict names count in every other document.
STRICT = (("s:the", "The", True), ("w:of-the", "of the", False), ("w:of", "of", False), ("s:that-the", "That The", True), ("w:that", "that", False))
_ANY_CASE = "list_aggregate(list_transform(" + TOKENS.format(x="text") + ", lambda t: ' ' || t || ' '), 'string_agg', '')"


@query(
    f"""WITH hits AS (SELECT doc_id, unnest(regexp_extract_all({_ANY_CASE}, CASE WHEN doc_id % 2 = 0 THEN ' (?i:of)  (?i:the) | (?:That  The|that  the) | (?i:of) | (?i:that) | (?:The|the) ' ELSE ' (?i:of)  (?i:the) | (?i:of) | (?i:that) ' END)) AS hit FROM documents),
    ids(h, skill_id) AS (VALUES (' the ', 's:the'), (' of  the ', 'w:of-the'), (' of ', 'w:of'), (' that  the ', 's:that-the'), (' that ', 'w:that'))
    SELECT doc_id, skill_id, count(*)::INTEGER AS n FROM hits JOIN ids ON lower(hit) = h GROUP BY ALL"""
)
def match_exact_strict(spark, sf_dir):
    surfaces = dims.taxonomy(dims.skills_frame(spark, [(i, n, "word", strict, []) for i, n, strict in STRICT]))
    found = match.exact_matches(_docs(spark, sf_dir), surfaces, ["doc_id"], 2, F.col("doc_id") % 2 == 0)
    return found.groupBy("doc_id", "skill_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _benchmark_words(spark, sf_dir) -> DataFrame:
    """The words of seven to ten letters in ``benchmark`` as a taxonomy; the name is the word."""
    found = _table(spark, sf_dir, "benchmark", "text").select(F.explode_outer(text.tokens(F.lower("text"))).alias("name")).filter(F.col("name").rlike("^[a-z]{7,10}$")).distinct()
    rows = found.select(F.concat(F.lit("b:"), "name").alias("skill_id"), "name", F.lit("word").alias("category"), F.lit(False).alias("strict"), F.array().cast("array<string>").alias("aliases"))
    # A surface is its entry's only one and the words differ, so one order number serves all.
    rows = rows.withColumn("entry_ord", F.lit(0))
    return dims.taxonomy(rows).withColumn("cand_ord", F.col("surface"))


#: Below 25 letters in both, 92 of 100 leaves room for one letter that only one of them has.
_NEAR = f"""sur AS (SELECT DISTINCT w AS s FROM (SELECT unnest({TOKENS.format(x='lower(text)')}) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]{{7,10}}$')),
    tok AS (SELECT DISTINCT w AS t FROM (SELECT unnest({TOKENS.format(x='lower(text)')}) AS w FROM documents) WHERE length(w) BETWEEN 6 AND 11),
    less_t AS (SELECT DISTINCT t, substr(t, 1, k - 1) || substr(t, k + 1) AS x FROM (SELECT t, unnest(range(1, length(t) + 1)) AS k FROM tok)),
    less_s AS (SELECT DISTINCT s, substr(s, 1, k - 1) || substr(s, k + 1) AS x FROM (SELECT s, unnest(range(1, length(s) + 1)) AS k FROM sur)),
    near AS (SELECT t, s FROM tok JOIN sur ON t = s UNION SELECT t, s FROM less_t JOIN sur ON x = s UNION SELECT t, s FROM tok JOIN less_s ON t = x),
    scored AS (SELECT t, s, CASE WHEN t = s THEN 100.0 ELSE 200.0 * least(length(t), length(s)) / (length(t) + length(s)) END::DOUBLE AS score FROM near),
    best AS (SELECT t, s, score FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, s) AS k FROM scored WHERE score >= 92) WHERE k = 1)"""


@query(f"WITH {_NEAR} SELECT t AS token, 'b:' || s AS skill_id, printf('%.2f', score) AS score FROM best")
def match_fuzzy_top1(spark, sf_dir):
    """The nearest word of ``benchmark`` for every distinct token of ``documents``."""
    words = _docs(spark, sf_dir).select(F.explode_outer(text.tokens(F.lower("text"))).alias("token")).distinct()
    found = match.fuzzy_best(words, _benchmark_words(spark, sf_dir))
    return found.select("token", "skill_id", F.format_number("score", 2).alias("score"))


@query(
    f"""WITH {_NEAR}, {LINES}, parts AS (SELECT doc_id, ln % 3 AS section_ord, ['experience', 'skills', 'education'][1 + ln % 3] AS kind, string_agg(line, ' ' ORDER BY ln) AS text FROM lines GROUP BY ALL),
    placed AS (SELECT doc_id, section_ord, kind, unnest(range(len(tk))) AS pos, unnest(tk) AS t FROM (SELECT *, {TOKENS.format(x='lower(text)')} AS tk FROM parts)),
    exact AS (SELECT DISTINCT doc_id, kind, s FROM placed JOIN sur ON t = s),
    fuzzy AS (SELECT doc_id, s, arg_min(kind, section_ord * 1000000 + pos) AS kind FROM placed JOIN best USING (t) GROUP BY doc_id, s),
    skills AS (SELECT doc_id, s, kind, 0.95 AS c FROM exact UNION ALL SELECT doc_id, s, kind, 0.8 FROM fuzzy WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.doc_id = fuzzy.doc_id AND e.s = fuzzy.s)),
    merged AS (SELECT doc_id, s, string_agg(kind, ',' ORDER BY kind) AS found_in, max(c)::DOUBLE AS confidence, bool_or(kind = 'experience') AS shown FROM skills GROUP BY doc_id, s)
    SELECT doc_id, 'b:' || s AS skill_id, CASE WHEN shown THEN 'demonstrated' ELSE 'claimed' END AS evidence, found_in, confidence,
           (row_number() OVER (PARTITION BY doc_id ORDER BY NOT shown, s))::INTEGER AS skill_ord FROM merged"""
)
def match_skill_fuzzy(spark, sf_dir):
    """Skills whose names are words of ``benchmark``, written right or nearly so, in the sections of every document."""
    skills = match.extract_skills(_parts(spark, sf_dir), _benchmark_words(spark, sf_dir), 1)
    return skills.select("doc_id", "skill_id", "evidence", F.array_join("found_in", ",").alias("found_in"), "confidence", "skill_ord")


_KINDS = ("experience", "skills", "education")


def _parts(spark, sf_dir) -> DataFrame:
    """Every document's lines in turn as three sections."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    numbered = F.transform(F.split("text", "\n"), lambda line, k: F.struct((k % 3).alias("part"), line.alias("line")))
    rows = _docs(spark, sf_dir).select("doc_id", numbered.alias("l")).select("doc_id", "l", F.explode_outer(F.sequence(F.lit(0), F.least(F.lit(2), F.size("l") - 1))).alias("section_ord"))
    own = F.transform(F.filter("l", lambda x: x["part"] == F.col("section_ord")), lambda x: x["line"])
    return rows.select("doc_id", "section_ord", F.get(kinds, F.col("section_ord")).alias("kind"), F.array_join(own, " ").alias("text"))


@query(
    f"""WITH {LINES}, parts AS (SELECT doc_id, ['experience', 'skills', 'education'][1 + ln % 3] AS kind, string_agg(line, ' ' ORDER BY ln) AS text FROM lines GROUP BY ALL),
    ids(hit, skill_id, name, category) AS (VALUES {_IDS}), hits AS (SELECT DISTINCT doc_id, kind, unnest({_SCAN.format(x='text')}) AS hit FROM parts),
    skills AS (SELECT doc_id, skill_id, any_value(category) AS category, any_value(name) AS name, string_agg(kind, ',' ORDER BY kind) AS found_in,
               CASE WHEN bool_or(kind = 'experience') THEN 'demonstrated' ELSE 'claimed' END AS evidence FROM hits JOIN ids USING (hit) GROUP BY doc_id, skill_id)
    SELECT doc_id, skill_id, evidence, found_in, 0.95::DOUBLE AS confidence,
           (row_number() OVER (PARTITION BY doc_id ORDER BY evidence = 'claimed', category, name, skill_id))::INTEGER AS skill_ord FROM skills"""
)
def match_skill_evidence(spark, sf_dir):
    skills = match.extract_skills(_parts(spark, sf_dir), _phrases(spark), 2)
    return skills.select("doc_id", "skill_id", "evidence", F.array_join("found_in", ",").alias("found_in"), "confidence", "skill_ord")


# --- fit ----------------------------------------------------------------------------------------


def _profiles(spark, sf_dir):
    return _table(spark, sf_dir, "part", "p_brand", "p_name").distinct().toDF("role", "skill_id")


def _owned(spark, sf_dir):
    bought = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity").join(_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = bought.join(_table(spark, sf_dir, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    owned = bought.groupBy(F.col("o_custkey").alias("doc_id"), F.col("p_name").alias("skill_id")).agg(F.max("l_quantity").alias("q"))
    return owned.withColumn("evidence", F.when(F.col("q") >= 45, "demonstrated").otherwise("claimed")).withColumn("tenths", fit.evidence_tenths())


_OWNED = """bought AS (SELECT o_custkey AS doc_id, p_name AS skill_id, CASE WHEN max(l_quantity) >= 45 THEN 10 ELSE 6 END AS tenths
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    profile AS (SELECT DISTINCT p_brand AS role, p_name AS skill_id FROM part),
    seen AS (SELECT skill_id, count(DISTINCT role) AS appearances FROM profile GROUP BY 1),
    unit AS (SELECT role, skill_id, appearances FROM profile JOIN seen USING (skill_id)),
    avail AS (SELECT role, list_reduce([0.0::DOUBLE] || list(n::DOUBLE / appearances ORDER BY appearances), lambda a, b: a + b) AS available FROM (SELECT role, appearances, count(*) AS n FROM unit GROUP BY ALL) GROUP BY 1),
    got AS (SELECT doc_id, role, list_reduce([0.0::DOUBLE] || list(n::DOUBLE / appearances ORDER BY appearances), lambda a, b: a + b) AS matched
        FROM (SELECT doc_id, role, appearances, sum(tenths) AS n FROM bought JOIN unit USING (skill_id) GROUP BY ALL) GROUP BY ALL),
    score AS (SELECT doc_id, role, matched / (available * 10.0::DOUBLE) AS score FROM got JOIN avail USING (role))"""


@query("SELECT p_name AS skill_id, count(DISTINCT p_brand) AS appearances, 1.0::DOUBLE / count(DISTINCT p_brand) AS distinctiveness FROM part GROUP BY 1")
def fit_distinctiveness(spark, sf_dir):
    return fit.distinctiveness(_profiles(spark, sf_dir))


@query(f"WITH {_OWNED} SELECT doc_id, role, printf('%.4f', score)::DOUBLE AS coverage FROM score")
def fit_role_coverage(spark, sf_dir):
    rows = fit.coverage(_owned(spark, sf_dir), _profiles(spark, sf_dir))
    return rows.select("doc_id", "role", text.rounded(F.col("matched") / (F.col("available") * 10.0), 4).alias("coverage"))


@query(
    f"""WITH {_OWNED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, role) AS rank, sum(score) OVER (PARTITION BY doc_id) AS total FROM score)
    SELECT doc_id, rank::INTEGER AS rank, role, printf('%.2f', score / total)::DOUBLE AS confidence FROM ranked WHERE rank <= 3"""
)
def fit_top_roles(spark, sf_dir):
    return fit.top_profiles(_owned(spark, sf_dir), _profiles(spark, sf_dir))


@query(
    """WITH l AS (SELECT o_custkey AS doc_id, p_name, o_orderpriority = '1-URGENT' AS urgent FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    need AS (SELECT doc_id, p_name, count(*) AS mentions FROM l WHERE urgent GROUP BY ALL), have AS (SELECT DISTINCT doc_id, p_name FROM l WHERE NOT urgent),
    j AS (SELECT need.*, have.p_name IS NOT NULL AS has, printf('%.2f', mentions / max(mentions) OVER (PARTITION BY need.doc_id))::DOUBLE AS importance FROM need LEFT JOIN have USING (doc_id, p_name)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, has ORDER BY importance DESC, p_name) AS k FROM j)
    SELECT doc_id, 1 AS jd_id, printf('%.2f', count(*) FILTER (WHERE has) / count(*))::DOUBLE AS similarity, coalesce(string_agg(p_name, ',' ORDER BY p_name) FILTER (WHERE has), '') AS matched,
           coalesce(string_agg(p_name || ':' || printf('%.2f', importance), ',' ORDER BY k) FILTER (WHERE NOT has AND k <= 8), '') AS missing FROM r GROUP BY doc_id"""
)
def fit_gap_analysis(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").join(_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(_table(spark, sf_dir, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("o_custkey").alias("doc_id"), F.col("p_name").alias("skill_id"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    need = rows.filter("urgent").groupBy("doc_id", "skill_id").agg(F.count(F.lit(1)).alias("mentions")).withColumn("jd_id", F.lit(1))
    names = _table(spark, sf_dir, "part", "p_name").distinct().select(F.col("p_name").alias("skill_id"), F.col("p_name").alias("name"))
    gaps = fit.gap_analysis(rows.filter("NOT urgent"), need, names)
    listed = F.transform("missing_skills", lambda g: F.concat(g["skill"], F.lit(":"), F.format_number(g["importance"], 2)))
    return gaps.select("doc_id", "jd_id", "similarity", F.array_join("matched_skills", ",").alias("matched"), F.array_join(listed, ",").alias("missing"))


# --- rubric and advice --------------------------------------------------------------------------

_ORDER_CHECKS = {
    "machine_readable_text": "o_totalprice > 1000",
    "single_column_layout": "o_orderstatus <> 'F'",
    "no_layout_tables": "o_custkey % 3 <> 0",
    "text_outside_header_footer": "o_orderkey % 5 <> 0",
    "recognisable_section_headings": "o_orderpriority <> '5-LOW'",
    "appropriate_length": "o_totalprice < 250000",
}


def _judged(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").withColumn("doc_id", F.col("o_orderkey"))
    return ats.checks(orders, {k: F.expr(v) for k, v in _ORDER_CHECKS.items()}, dims.rubric(spark))


_RUBRIC = "rubric(check_ord, check_id, weight, severity) AS (VALUES " + ", ".join(f"({k}, '{c[0]}', {c[2]}, '{c[3]}')" for k, c in enumerate(dims.seed.CHECKS)) + ")"
_JUDGED = "judged AS (" + " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{k}' AS check_id, {v} AS passed FROM orders" for k, v in _ORDER_CHECKS.items()) + ")"


@query(f"WITH {_RUBRIC}, {_JUDGED} SELECT doc_id, check_ord, check_id, passed, weight::DOUBLE AS weight, severity FROM judged JOIN rubric USING (check_id)")
def ats_checks(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "check_ord", "check_id", "passed", "weight", "severity")


@query(f"WITH {_RUBRIC}, {_JUDGED} SELECT doc_id, round(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) * 100, 1)::DOUBLE AS score FROM judged JOIN rubric USING (check_id) GROUP BY 1")
def ats_score(spark, sf_dir):
    return ats.score(_judged(spark, sf_dir))


@query(
    f"""WITH {_RUBRIC}, {_JUDGED}, sev(severity, s) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)),
    advice(ord, kind, severity) AS (VALUES {', '.join(f"({k}, '{x}', '{dims.seed.MISSING_SEVERITY[x]}')" for k, x in enumerate(dims.seed.EXPECTED_SECTIONS))}),
    tips AS (SELECT doc_id, 0 AS a, check_ord AS b, 'ats.' || check_id AS id, severity FROM judged JOIN rubric USING (check_id) WHERE NOT passed
             UNION ALL SELECT o_orderkey, 1, ord, 'section.' || kind, severity FROM orders, advice WHERE (o_orderkey + ord) % 4 = 0
             UNION ALL SELECT o_orderkey, 2, 0, 'skills.unevidenced', 'medium' FROM orders WHERE o_custkey % 2 = 0)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, a, b))::INTEGER AS rank, id, severity FROM tips JOIN sev USING (severity)"""
)
def advise_ranked(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    kinds = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(x).alias("kind")) for k, x in enumerate(dims.seed.EXPECTED_SECTIONS)])
    missing = orders.select(F.col("o_orderkey").alias("doc_id"), F.inline(kinds)).filter("(doc_id + ord) % 4 = 0")
    skills = orders.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("claimed").alias("evidence"), F.lit(1).alias("skill_ord"), F.lit("x").alias("name"))
    tips = advise.advise(_judged(spark, sf_dir), dims.rubric(spark), missing, dims.section_advice(spark), skills)
    return tips.select("doc_id", "rank", "id", "severity")


# --- segmentation -------------------------------------------------------------------------------

_WORDS = ("Education", "Work History", "SKILLS:", "Projects", "Summary", "Contact")
_SYNTHETIC_LINES = f"""{LINES}, made AS (SELECT doc_id, ln::INTEGER AS line_index, (ln // 40 + 1)::INTEGER AS page_number,
    {STRIP.format(x="CASE WHEN ln % 11 = 5 THEN [" + ', '.join(f"'{w}'" for w in _WORDS) + "][1 + (doc_id + ln) % 6] ELSE line END")} AS text,
    CASE WHEN (doc_id + ln) % 13 = 0 THEN 13.0 ELSE 10.0 END AS size, ln % 5 = 0 AS is_bold, ln > 0 AND ln % 17 = 0 AS col_start FROM lines),
    counted AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words,
    regexp_matches(text, '\\p{{L}}') AND NOT regexp_matches(text, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AS up FROM made),
    med AS (SELECT doc_id, median(size) FILTER (WHERE text <> '') AS m FROM counted GROUP BY 1),
    alias(norm, known) AS (VALUES ('education', 'education'), ('work history', 'experience'), ('skills', 'skills'), ('projects', 'projects'), ('summary', 'summary'), ('contact', 'contact')),
    kinds AS (SELECT c.*, CASE WHEN words BETWEEN 1 AND 6 THEN coalesce(known, CASE WHEN regexp_matches(text, '[.,;:]$') THEN NULL WHEN m > 0 AND size >= m * 2.0 THEN NULL
        WHEN m > 0 AND size >= m * 1.25 THEN 'other' WHEN up AND (is_bold OR (m > 0 AND size >= m * 1.15)) THEN 'other' END) END AS raw_kind
        FROM counted c LEFT JOIN med USING (doc_id) LEFT JOIN alias ON norm = trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')))"""
_STRIPPED_BODY = STRIP.format(x="string_agg(text, ' ' ORDER BY line_index) FILTER (WHERE NOT own)")
_SECTIONS = f"""{_SYNTHETIC_LINES}, firsts AS (SELECT doc_id, min(line_index) FILTER (WHERE raw_kind <> 'other') AS f FROM kinds GROUP BY 1),
    heads AS (SELECT kinds.*, CASE WHEN line_index >= coalesce(f, 0) THEN raw_kind END AS hk FROM kinds JOIN firsts USING (doc_id)),
    sums AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(words) OVER (PARTITION BY doc_id) AS total FROM heads),
    nexts AS (SELECT *, coalesce(min(CASE WHEN hk IS NOT NULL THEN before END) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), total) - before AS until FROM sums),
    starts AS (SELECT *, coalesce(hk, CASE WHEN col_start AND until >= 10 THEN 'other' END) AS sk FROM nexts),
    owned AS (SELECT *, coalesce(last_value(CASE WHEN sk IS NOT NULL THEN line_index END IGNORE NULLS) OVER w, -1) AS place, coalesce(last_value(sk IGNORE NULLS) OVER w, 'contact') AS kind
        FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    built AS (SELECT doc_id, place, kind, max(text) FILTER (WHERE own) AS heading, coalesce(min(page_number) FILTER (WHERE NOT own), 1) AS page, coalesce(min(line_index) FILTER (WHERE NOT own), 0) AS line_start,
        coalesce(max(line_index) FILTER (WHERE NOT own), 0) AS line_end, coalesce(sum(words) FILTER (WHERE NOT own), 0) AS words,
        coalesce({_STRIPPED_BODY}, '') AS body
        FROM (SELECT *, hk IS NOT NULL AND line_index = place AS own FROM owned) GROUP BY doc_id, place, kind),
    merged AS (SELECT doc_id, kind, min(place) AS place, arg_min_null(heading, place) AS heading, arg_min(page, place) AS page, arg_min(line_start, place) AS line_start, arg_min(line_end, place) AS line_end, sum(words) AS words,
        arg_min(CASE WHEN length(body) <= 200 THEN body ELSE regexp_replace(substr(body, 1, 199), '\\s+$', '') || '…' END, place) AS excerpt
        FROM (SELECT *, CASE WHEN kind = 'other' THEN 'other:' || place ELSE kind END AS m FROM built) GROUP BY doc_id, kind, m)"""


def _synthetic_lines(spark, sf_dir):
    names = F.array(*[F.lit(w) for w in _WORDS])
    shown = F.when(F.col("ln") % 11 == 5, F.get(names, ((F.col("doc_id") + F.col("ln")) % 6).cast("int"))).otherwise(F.col("line"))
    return _lines(spark, sf_dir).select(
        "doc_id", F.col("ln").alias("line_index"), (F.floor(F.col("ln") / 40) + 1).cast("int").alias("page_number"), shown.alias("text"),
        F.when((F.col("doc_id") + F.col("ln")) % 13 == 0, 13.0).otherwise(10.0).alias("max_font_size"), (F.col("ln") % 5 == 0).alias("is_bold"),
        ((F.col("ln") > 0) & (F.col("ln") % 17 == 0)).alias("is_column_start"),
    )


def _sections(spark, sf_dir):
    return segment.sections(_synthetic_lines(spark, sf_dir), dims.heading_aliases(spark))


@query(f"WITH {_SYNTHETIC_LINES} SELECT doc_id, line_index, raw_kind AS heading_kind FROM kinds WHERE raw_kind IS NOT NULL")
def segment_headings(spark, sf_dir):
    return segment.find_headings(_synthetic_lines(spark, sf_dir), dims.heading_aliases(spark)).filter("heading_kind IS NOT NULL").select("doc_id", "line_index", "heading_kind")


@query(
    f"""WITH {_SECTIONS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INTEGER AS section_ord, kind, heading, page, line_start, line_end, words::BIGINT AS word_count, excerpt FROM merged"""
)
def segment_sections(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(
    f"""WITH {_SECTIONS}, want(ord, kind) AS (VALUES {', '.join(f"({k}, '{x}')" for k, x in enumerate(dims.seed.EXPECTED_SECTIONS))})
    SELECT doc_id, ord, kind FROM (SELECT DISTINCT doc_id FROM documents), want WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.doc_id = documents.doc_id AND m.kind = want.kind)""".replace(
        "(SELECT DISTINCT doc_id FROM documents), want", "(SELECT DISTINCT doc_id FROM documents) AS documents, want"
    )
)
def segment_missing(spark, sf_dir):
    return segment.missing_sections(_sections(spark, sf_dir), _docs(spark, sf_dir), dims.expected_sections(spark))


@query(
    f"""WITH {_SECTIONS}, l AS (SELECT m.doc_id, m.kind, m.place, string_agg(c.text, ' ' ORDER BY c.line_index) AS body FROM merged m JOIN counted c ON c.doc_id = m.doc_id AND c.line_index BETWEEN m.line_start AND m.line_end WHERE m.words > 0 GROUP BY ALL)
    SELECT doc_id, kind, md5({STRIP.format(x="string_agg(body, ' ' ORDER BY place)")}) AS text_md5 FROM l WHERE body <> '' GROUP BY doc_id, kind"""
)
def segment_texts(spark, sf_dir):
    lines = _synthetic_lines(spark, sf_dir)
    return segment.section_texts(segment.sections_with_bodies(lines, dims.heading_aliases(spark))).select("doc_id", "kind", F.md5("text").alias("text_md5"))


# --- layout -------------------------------------------------------------------------------------

_BOXES = f"""{LINES}, boxes AS (SELECT doc_id, (ln // 60)::INTEGER AS page_number, ln::INTEGER AS line_seq, line AS text, 612.0::DOUBLE AS page_width, 792.0::DOUBLE AS page_height,
    (CASE WHEN ln % 2 = 0 THEN 72 ELSE 330 END)::DOUBLE AS x0, (CASE WHEN ln % 2 = 0 THEN 72 ELSE 330 END + length(line) % (200 + doc_id % 60))::DOUBLE AS x1,
    (60 + ((ln % 60) // 2) * 23 + (doc_id + ln) % 7)::DOUBLE AS top FROM lines WHERE line <> ''), bx AS (SELECT *, top + 12 AS bottom FROM boxes)"""
_HISTOGRAM = """body AS (SELECT * FROM bx WHERE NOT (bottom <= page_height * 0.07::DOUBLE OR top >= page_height * (1.0::DOUBLE - 0.07::DOUBLE))),
    big AS (SELECT doc_id, page_number, count(*) AS n FROM body GROUP BY ALL HAVING count(*) >= 8),
    bins AS (SELECT doc_id, page_number, unnest(range(204))::INTEGER AS bin FROM big),
    crossed AS (SELECT doc_id, page_number, unnest(range(greatest(0, trunc(x0 / 3.0)::BIGINT), least(203, trunc(x1 / 3.0)::BIGINT) + 1))::INTEGER AS bin FROM body),
    hist AS (SELECT b.doc_id, b.page_number, b.bin, count(c.bin) AS crossings FROM bins b LEFT JOIN crossed c USING (doc_id, page_number, bin) GROUP BY ALL)"""
_GUTTERS = f"""{_HISTOGRAM}, h AS (SELECT hist.*, n, coalesce(sum(crossings) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(crossings) OVER (PARTITION BY doc_id, page_number) AS total
        FROM hist JOIN big USING (doc_id, page_number) WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY bin)),
    mid AS (SELECT *, sum((crossings > trunc(n * 0.12::DOUBLE))::INTEGER) OVER (PARTITION BY doc_id, page_number ORDER BY bin) AS island FROM h WHERE bin >= trunc(204 * 0.2::DOUBLE) AND bin < trunc(204 * 0.8::DOUBLE)),
    runs AS (SELECT doc_id, page_number, n, min(bin) AS a, max(bin) + 1 AS b, arg_min(before, bin) AS l, arg_max(total - before - crossings, bin) AS r FROM mid WHERE crossings <= trunc(n * 0.12::DOUBLE) GROUP BY doc_id, page_number, n, island),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY b - a DESC, a) AS k FROM runs WHERE l > 0 AND r > 0 AND b - a >= 10),
    found AS (SELECT doc_id, page_number, n, (a + b) / 2.0 * 3.0 AS gutter FROM best WHERE k = 1),
    sides AS (SELECT f.doc_id, f.page_number, n, gutter, count(*) FILTER (WHERE x1 <= gutter) AS nl, count(*) FILTER (WHERE x0 >= gutter) AS nr, min(top) FILTER (WHERE x1 <= gutter) AS lt, max(bottom) FILTER (WHERE x1 <= gutter) AS lb,
        min(top) FILTER (WHERE x0 >= gutter) AS rt, max(bottom) FILTER (WHERE x0 >= gutter) AS rb FROM found f JOIN body USING (doc_id, page_number) GROUP BY ALL),
    gut AS (SELECT doc_id, page_number, gutter::DOUBLE AS gutter FROM sides WHERE least(nl, nr) >= n * 0.2::DOUBLE AND least(lb, rb) - greatest(lt, rt) > 0 AND (least(lb, rb) - greatest(lt, rt)) / least(lb - lt, rb - rt) >= 0.4)"""


def _boxes(spark, sf_dir):
    left = F.when(F.col("ln") % 2 == 0, 72).otherwise(330)
    top = F.lit(60) + F.floor((F.col("ln") % 60) / 2) * 23 + (F.col("doc_id") + F.col("ln")) % 7
    return _lines(spark, sf_dir).filter("line <> ''").select(
        "doc_id", F.floor(F.col("ln") / 60).cast("int").alias("page_number"), F.col("ln").alias("line_seq"), F.col("line").alias("text"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
        left.cast("double").alias("x0"), (left + F.length("line") % (200 + F.col("doc_id") % 60)).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 12).cast("double").alias("bottom"),
    )


@query(f"WITH {_BOXES}, {_HISTOGRAM.replace('HAVING count(*) >= 8', '')} SELECT doc_id, page_number, bin, crossings FROM hist")
def layout_bin_histogram(spark, sf_dir):
    rows = _boxes(spark, sf_dir)
    body = rows.filter(~layout.at_page_edge(F.col("top"), F.col("bottom"), F.col("page_height")))
    return layout.bin_histogram(body).select("doc_id", "page_number", "bin", "crossings")


@query(f"WITH {_BOXES}, {_GUTTERS} SELECT doc_id, page_number, gutter FROM gut")
def layout_gutter(spark, sf_dir):
    return layout.gutters(_boxes(spark, sf_dir))


_ROWS = """sided AS (SELECT bx.*, CASE WHEN gutter IS NULL OR (x0 + x1) / 2 <= gutter THEN 0 ELSE 1 END AS col FROM bx LEFT JOIN gut USING (doc_id, page_number)),
    tol AS (SELECT doc_id, page_number, col, coalesce(median(CASE WHEN bottom > top THEN bottom - top END), 0) * 0.6::DOUBLE AS t FROM sided GROUP BY ALL),
    num AS (SELECT s.*, t, row_number() OVER (PARTITION BY s.doc_id, s.page_number, s.col ORDER BY top, x0, line_seq) AS k FROM sided s JOIN tol USING (doc_id, page_number, col)),
    walk AS (SELECT doc_id, page_number, col, k, line_seq, x0, top, top AS anchor, 0 AS row FROM num WHERE k = 1
        UNION ALL SELECT n.doc_id, n.page_number, n.col, n.k, n.line_seq, n.x0, n.top, CASE WHEN n.top - w.anchor > n.t THEN n.top ELSE w.anchor END, CASE WHEN n.top - w.anchor > n.t THEN w.row + 1 ELSE w.row END
        FROM walk w JOIN num n ON n.doc_id = w.doc_id AND n.page_number = w.page_number AND n.col = w.col AND n.k = w.k + 1)"""


@query(f"WITH RECURSIVE {_BOXES}, {_GUTTERS}, {_ROWS} SELECT doc_id, page_number, col AS column, line_seq, row FROM walk")
def layout_row_cluster(spark, sf_dir):
    return layout.reading_order(_boxes(spark, sf_dir).withColumn("max_font_size", F.lit(10.0))).select("doc_id", "page_number", "column", "line_seq", "row")


@query(
    f"""WITH RECURSIVE {_BOXES}, {_GUTTERS}, {_ROWS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, col, row, x0, top, line_seq) - 1 AS line_index FROM walk)
    SELECT doc_id, line_seq, line_index::INTEGER AS line_index, min(line_index) OVER (PARTITION BY doc_id, page_number, col) = line_index AND line_index > min(line_index) OVER (PARTITION BY doc_id, page_number) AS is_column_start FROM numbered"""
)
def layout_reading_order(spark, sf_dir):
    return layout.reading_order(_boxes(spark, sf_dir)).select("doc_id", "line_seq", "line_index", "is_column_start")


@query(
    """SELECT p_size AS doc_id, string_agg(f, ',' ORDER BY f) AS families FROM (SELECT DISTINCT p_size, CASE WHEN p_partkey % 4 = 3 THEN p_type ELSE replace(p_brand, '#', '') END AS f FROM part WHERE p_partkey % 5 <> 4) GROUP BY 1"""
)
def layout_font_families(spark, sf_dir):
    """Names with subset prefixes, styles and variants, made from brands and types."""
    brand, kind, k = F.regexp_replace("p_brand", "#", ""), F.col("p_type"), F.col("p_partkey")
    font = F.when(k % 5 == 4, "").when(k % 4 == 0, F.concat(F.lit("QWERTY+"), brand, F.lit("-BoldItalic"))).when(k % 4 == 1, F.concat(brand, F.lit(",Oblique"))).when(k % 4 == 2, brand).otherwise(F.concat(F.lit("A+"), kind, F.lit("-,x")))
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size").select(F.col("p_size").alias("doc_id"), font.alias("font"))
    return layout.font_families(rows).select("doc_id", F.array_join("font_families", ",").alias("families"))


# --- admission ----------------------------------------------------------------------------------

_ADMIT = """numbered AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    walk AS (SELECT user_id, event_id, us, k, [us] AS live, true AS admitted, NULL::BIGINT AS wait_us FROM numbered WHERE k = 1
        UNION ALL SELECT n.user_id, n.event_id, n.us, n.k,
            CASE WHEN len(list_filter(w.live, lambda x: x > n.us - 172800000000)) < 3 THEN list_append(list_filter(w.live, lambda x: x > n.us - 172800000000), n.us) ELSE list_filter(w.live, lambda x: x > n.us - 172800000000) END,
            len(list_filter(w.live, lambda x: x > n.us - 172800000000)) < 3,
            CASE WHEN len(list_filter(w.live, lambda x: x > n.us - 172800000000)) >= 3 THEN list_filter(w.live, lambda x: x > n.us - 172800000000)[1] + 172800000000 - n.us END
        FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.k = w.k + 1)"""


def _admitted(spark, sf_dir):
    events = _table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return admission.admit(events, 3, 172_800_000_000, key="user_id")


@query(f"WITH RECURSIVE {_ADMIT} SELECT user_id, event_id, us, admitted, wait_us FROM walk")
def limiter_admissions(spark, sf_dir):
    return _admitted(spark, sf_dir)


@query(f"WITH RECURSIVE {_ADMIT} SELECT event_id, greatest(1, ceil(wait_us / 1000000.0))::INTEGER AS retry_after FROM walk WHERE NOT admitted")
def limiter_retry_after(spark, sf_dir):
    return _admitted(spark, sf_dir).filter("NOT admitted").select("event_id", text.retry_after(F.col("wait_us") / 1e6).alias("retry_after"))


@query(f"WITH RECURSIVE {_ADMIT} SELECT user_id, event_id, us, admitted, wait_us FROM walk")
def limiter_stream(spark, sf_dir):
    """Events that arrive in stretches of time; the stream stops and starts again from its checkpoint in between."""
    return replay(_table(spark, sf_dir, "events", "event_id", "user_id", "ts"), 3, 172_800_000_000, key="user_id")


@query("SELECT event_id FROM events WHERE event_type <> 'view'")
def limiter_logged_requests(spark, sf_dir):
    """Views stand for health checks."""
    rows = _table(spark, sf_dir, "events", "event_id", "event_type")
    return present.logged_requests(rows.withColumn("path", F.when(F.col("event_type") == "view", present.HEALTH_PATH).otherwise(F.col("event_type")))).select("event_id")


@query(
    """WITH named AS (SELECT p_name AS skill_id FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part),
    wanted AS (SELECT p_brand AS role, p_name AS skill_id FROM part UNION SELECT p_brand, lower(p_type) FROM part)
    SELECT role, skill_id FROM wanted ANTI JOIN named USING (skill_id)"""
)
def dims_unknown_skills(spark, sf_dir):
    """Brands ask for the names and types of all their parts; the taxonomy is the names of all parts, and their words."""
    part = _table(spark, sf_dir, "part", "p_name", "p_brand", "p_type")
    typed = part.select(F.col("p_brand").alias("role"), F.lower("p_type").alias("skill_id"))
    named = part.select(F.explode(F.array_append(F.split("p_name", " "), F.col("p_name"))).alias("skill_id"))
    return dims.unknown_skills(_profiles(spark, sf_dir).unionByName(typed).distinct(), named)


@query(
    """WITH e AS (SELECT event_id, 'a' || user_id AS a, 'b' || event_id AS b, CASE WHEN event_id % 5 <> 0 THEN 'p' || user_id END AS peer, event_id % 3 AS hops FROM events)
    SELECT event_id, coalesce(peer, 'unknown') AS k0, coalesce(CASE hops WHEN 1 THEN b WHEN 2 THEN b END, peer, 'unknown') AS k1, coalesce(CASE hops WHEN 2 THEN a END, peer, 'unknown') AS k2 FROM e"""
)
def client_key(spark, sf_dir):
    """Forwarding lists of no, one and two addresses, with blanks and empty entries, and missing peers."""
    a, b = F.concat(F.lit("a"), "user_id"), F.concat(F.lit("b"), "event_id")
    xff = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" , "), b, F.lit(" ,"))).when(F.col("event_id") % 3 == 2, F.concat(a, F.lit(",  "), b))
    rows = _table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", xff.alias("xff"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("p"), "user_id")).alias("peer"))
    return rows.select("event_id", *[text.client_key("xff", "peer", n).alias(f"k{n}") for n in range(3)])


# --- taxonomy, uploads, presentation --------------------------------------------------------------


@query("SELECT p_partkey, p_name AS example, (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS input_ord FROM part")
def technology_order(spark, sf_dir):
    """Parts written as a technology list of several files and read back in blocks, with the order of their lines."""
    path = scratch_path(spark, "technologies")
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.col("p_name").alias("Example"))
    rows.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").write.csv(path, sep="\t", header=True)
    return files.read_technologies(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("Example").alias("example"), "input_ord")


@query(
    """WITH esco AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'skill' ELSE 'kind ' || p_size END AS category, 'about ' || p_brand AS alias FROM part WHERE p_partkey % 4 <> 0),
    onet AS (SELECT 1000000000 + p_partkey AS k, p_type AS name, p_brand AS category FROM part),
    entries AS (SELECT k, 'esco:' || replace(name, ' ', '-') AS skill_id, name, category, alias FROM esco UNION ALL SELECT k, 'onet:' || lower(name), name, category, NULL FROM onet),
    merged AS (SELECT skill_id, min(k) AS k, arg_min(name, k) AS name, arg_min(category, k) AS category, coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias), '') AS aliases FROM entries GROUP BY 1)
    SELECT (row_number() OVER (ORDER BY category, lower(name), k) - 1)::INTEGER AS entry_ord, skill_id, name, category, length(name) <= 2 AS strict, aliases FROM merged"""
)
def gazetteer_build(spark, sf_dir):
    """Part names as an occupation list (blank names and lone signs among them) and part types as a technology list."""
    part = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    name = F.when(F.col("p_partkey") % 8 == 0, "#").when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name"))
    labels = F.concat(F.lit("about "), "p_brand", F.lit("\n"), "p_name", F.lit("|+| a b c d e f "))
    esco = part.select(F.col("p_partkey").cast("long").alias("input_ord"), name.alias("preferredLabel"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("kind "), "p_size")).alias("skillType"), labels.alias("altLabels"))
    onet = part.select((F.lit(1_000_000_000) + F.col("p_partkey")).cast("long").alias("input_ord"), F.col("p_type").alias("Example"), F.col("p_brand").alias("Commodity Title"))
    entries = gazetteer.ordered(gazetteer.merge(gazetteer.from_occupations(esco).unionByName(gazetteer.from_technologies(onet))))
    return entries.select("entry_ord", "skill_id", "name", "category", "strict", F.array_join("aliases", ",").alias("aliases"))


_UPLOADS = """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS typed, o_totalprice::BIGINT * 15 AS size, o_orderkey % 11 <> 0 AS signed, o_custkey % 13 AS pages, o_custkey * 2 AS characters FROM orders),
    c AS (SELECT id, CASE WHEN typed THEN 'unsupported_media_type' WHEN size = 0 THEN 'empty_document' WHEN size > 5242880 THEN 'file_too_large' WHEN NOT signed THEN 'unsupported_media_type'
        WHEN pages > 10 THEN 'too_many_pages' WHEN pages = 0 THEN 'empty_document' WHEN characters = 0 OR characters < 120 * pages THEN 'not_machine_readable' END AS code FROM o)"""
_ERRORS = ", ".join(f"('{code}', {status}, '{message}', '{remediation}')" for code, status, message, remediation in dims.ERRORS)


def _uploads(orders: DataFrame) -> DataFrame:
    """Uploads whose sizes, pages and texts are made from orders."""
    key, custom = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        key.alias("id"), F.when(key % 7 == 0, "text/plain").otherwise(files.MEDIA_TYPES[0]).alias("content_type"), (F.rint("o_totalprice").cast("long") * 15).alias("length"),
        F.when(key % 11 == 0, F.lit("PK")).otherwise(F.lit("%PDF-1.7")).cast("binary").alias("content"), (custom % 13).cast("int").alias("pages"), (custom * 2).cast("int").alias("characters"),
    )


_UPLOAD_ERROR = {"page_count": "pages", "characters": "characters"}


def _upload_error():
    return files.upload_error(**{k: F.col(c) for k, c in _UPLOAD_ERROR.items()})


@query(
    f"""{_UPLOADS} SELECT id, code, CASE code WHEN 'unsupported_media_type' THEN 415 WHEN 'file_too_large' THEN 413 WHEN 'empty_document' THEN 422 WHEN 'too_many_pages' THEN 422 WHEN 'not_machine_readable' THEN 422 END AS status FROM c"""
)
def upload_gate(spark, sf_dir):
    rows = _uploads(_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")).withColumn("code", _upload_error())
    return files.with_error(rows, "code", dims.errors(spark)).select("id", "code", F.col("error.status").alias("status"))


@query(f"{_UPLOADS} SELECT id, code, status, message, remediation FROM c LEFT JOIN (VALUES {_ERRORS}) e(code, status, message, remediation) USING (code)")
def intake_uploads(spark, sf_dir):
    """The same uploads as a stream: what the intake has written to its results (without a code) and its rejects."""
    path = f"{sf_dir}/orders.parquet"
    # A stream takes a lone file, as a table may be one, only by a pattern.
    arrived = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/orders.parque[t]")
    results, rejects, state = (scratch_path(spark, f"intake-{name}") for name in ("results", "rejects", "state"))
    intake(_uploads(arrived), _upload_error(), dims.errors(spark), results, rejects, state).awaitTermination()
    taken = spark.read.parquet(results).select("id")
    return taken.unionByName(spark.read.parquet(rejects).select("id", "code", "status", "message", "remediation"), allowMissingColumns=True)


@query(f"{_UPLOADS} SELECT count(*) AS uploads, count(*) FILTER (WHERE c.code IS NULL) AS accepted, count(*) FILTER (WHERE c.code = 'file_too_large') AS too_large, sum(pages)::BIGINT AS pages FROM c JOIN o USING (id)")
def log_counts(spark, sf_dir):
    """Counts over the judged uploads, observed while these are written."""
    rows = _uploads(_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")).withColumn("code", _upload_error())
    counts = files.write_results_observed(
        rows.drop("content"), scratch_path(spark, "judged"), uploads=F.count(F.lit(1)), accepted=F.count_if(F.col("code").isNull()), too_large=F.count_if(F.col("code") == "file_too_large"), pages=F.sum("pages")
    )
    return dims.small_frame(spark, [tuple(counts.values())], "uploads long, accepted long, too_large long, pages long")


@query(
    f"""WITH {_RUBRIC}, {_JUDGED}, s AS (SELECT doc_id, round(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) * 100, 1)::DOUBLE AS score, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed
    FROM judged JOIN rubric USING (check_id) GROUP BY 1) SELECT doc_id, passed, failed, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS tone, floor(score + 0.5)::INTEGER AS shown FROM s"""
)
def present_checks(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    rows = present.check_counts(judged).join(ats.score(judged), "doc_id")
    return rows.select("doc_id", "passed", "failed", present.score_tone(F.col("score")).alias("tone"), F.floor(F.col("score") + 0.5).cast("int").alias("shown"))


_SHOWN = ("education", "experience", "other", "skills")


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_custkey % 4 AS sev, (o_custkey % 101) / 100.0 AS importance, o_orderkey % 3 AS jd, o_orderkey % 5 AS answer FROM orders)
    SELECT id, ['Education', 'Experience', 'Other', 'Skills'][1 + k] AS section, ['Critical', 'High', 'Medium', 'Low'][1 + sev] AS severity, CASE WHEN importance >= 0.75 THEN 'frequent' ELSE 'occasional' END AS gap,
           CASE jd WHEN 0 THEN 'order ' || id WHEN 1 THEN 'x' END AS jd, CASE WHEN answer IN (0, 1) THEN 'rate_limited' ELSE 'internal_error' END AS code, CASE WHEN answer = 4 THEN 502 ELSE 429 END AS status FROM o"""
)
def present_labels(spark, sf_dir):
    """Labels, descriptions and passed-on errors made from orders."""
    key, custom = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.get(F.array(*[F.lit(k) for k in _SHOWN]), (key % 4).cast("int"))
    severity = F.get(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), (custom % 4).cast("int"))
    described = F.when(key % 3 == 0, F.concat(F.lit("  order "), key, F.lit(" "))).when(key % 3 == 1, "x ").otherwise("   ")
    # Known codes with a message pass; unknown ones, those without a message, and no answer do not.
    status, code = F.when(key % 5 != 4, 429), F.when(key % 5 == 2, "what").otherwise("rate_limited")
    error = present.normalised_error(status, code, F.when(key % 5 != 3, "slow"), tuple(e[0] for e in dims.ERRORS))
    return _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        key.alias("id"), present.section_label(kind).alias("section"), present.severity_label(severity).alias("severity"), present.gap_label((custom % 101) / 100).alias("gap"),
        present.job_description(described).alias("jd"), error["code"].alias("code"), error["status"].alias("status"),
    )


# --- the whole analysis -------------------------------------------------------------------------


def _analysis(spark: SparkSession) -> DataFrame:
    return analyze(samples.raw_spans(spark), samples.raw_pages(spark), Dimensions.shipped(spark), samples.job_descriptions(spark))


@query(samples.EXPECTED_SQL)
def analyze_samples(spark, sf_dir):
    r = _analysis(spark)
    names = F.array_join(F.transform("skills", lambda s: s["name"]), ",")
    return r.select("doc_id", F.col("document.column_count").alias("columns"), F.array_join(F.transform("sections", lambda s: s["kind"]), ",").alias("sections"), F.col("ats.score").alias("score"), names.alias("skills"), F.col("fit.predictions")[0]["role"].alias("top_role"))


@query()
def analyze_documents(spark, sf_dir):
    """Sections, skills, score, roles and advice of every document of the table, from its lines alone."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "text")).filter(text.stripped("text") != "")
    spans = samples.as_spans(lines.withColumn("page_number", (F.floor(F.col("ln") / 60) + 1).cast("int")))
    pages = spans.groupBy("doc_id", "page_number").agg(F.sum(F.length("text")).cast("int").alias("character_count"))
    pages = pages.select("doc_id", "page_number", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("image_count"), F.lit(0).alias("table_count"), "character_count")
    r = with_report(analyze(spans, pages, Dimensions.shipped(spark)))
    return r.select("doc_id", F.col("document.word_count").alias("words"), F.size("sections").alias("n_sections"), F.size("skills").alias("n_skills"), F.col("ats.score").alias("score"), F.size("suggestions").alias("n_suggestions"), F.length("html").alias("html_length"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap analysis of the documents' phrases against what a request asks for."""
    docs = _docs(spark, sf_dir)
    found = match.mention_counts(docs, _phrases(spark), ["doc_id"], 2)
    need = docs.select("doc_id", F.lit(1).alias("jd_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("skill_id"), F.lit(k + 1).alias("mentions")) for k, (i, _, _) in enumerate(PHRASES)])).alias("r")).select("doc_id", "jd_id", "r.*")
    return fit.gap_analysis(found, need, _phrases(spark).select("skill_id", "name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
