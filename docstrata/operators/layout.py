"""Reading order and column layout from styled spans with boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.text import drop_glyphs, font_family, furniture_key, is_upper_case, stripped, word_count

# Fixed values of the layout rules.
HEADER_RATIO, FOOTER_RATIO = 0.07, 0.07
BIN_WIDTH = 3.0
MIN_GUTTER_RATIO, SEARCH_MARGIN = 0.05, 0.2
MIN_LINES, MIN_OVERLAP = 8, 0.4
CROSSING_RATIO, MIN_SHARE = 0.12, 0.2
ROW_TOLERANCE = 0.6
MIN_REPEATS = 2
BOLD, ITALIC = 16, 2

PAGE = ["doc_id", "page_number"]


def spans(raw: DataFrame) -> DataFrame:
    """Raw spans with cleaned text and ``bold`` and ``italic`` from flags or the font's name."""
    styled = lambda bit, name: (F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(bit) != 0) | F.contains(F.lower(F.coalesce("font", F.lit(""))), F.lit(name))
    return raw.withColumn("text", drop_glyphs("text")).withColumn("bold", styled(BOLD, "bold")).withColumn("italic", styled(ITALIC, "italic"))


def lines(styled: DataFrame) -> DataFrame:
    """One row per line that has text: box, text, max_font_size, is_bold, word_count, is_upper_case.

    Bold means that every span with more than white space is bold.
    """
    ordered = F.sort_array(F.collect_list(F.struct("span_seq", "text", "size", "bold")))
    rows = styled.groupBy(*PAGE, "line_seq").agg(
        ordered.alias("s"),
        *[F.first(f"line_{c}").alias(c) for c in ("x0", "top", "x1", "bottom")],
        F.first("page_width").alias("page_width"),
        F.first("page_height").alias("page_height"),
    )
    joined = stripped(F.array_join(F.transform("s", lambda s: s["text"]), ""))
    solid = F.filter("s", lambda s: stripped(s["text"]) != "")
    rows = rows.withColumn("text", joined).filter("text <> ''")
    return rows.select(
        *PAGE, "line_seq", "text", "x0", "top", "x1", "bottom", "page_width", "page_height",
        F.coalesce(F.array_max(F.transform("s", lambda s: s["size"])), F.lit(0.0)).alias("max_font_size"),
        F.forall(solid, lambda s: s["bold"]).alias("is_bold"),
        word_count("text").alias("word_count"),
        is_upper_case("text").alias("is_upper_case"),
    )


def at_page_edge(top: Column, bottom: Column, height: Column) -> Column:
    """In the header or the footer band."""
    return (bottom <= height * HEADER_RATIO) | (top >= height * F.lit(1.0 - FOOTER_RATIO))


def bin_histogram(rows: DataFrame, key: list[str] = PAGE, bin_width: float = BIN_WIDTH) -> DataFrame:
    """``rows(key, x0, x1, page_width)`` to (key, n_bins, bin, crossings) for every bin of a page."""
    pages = rows.groupBy(*key).agg(F.greatest(F.lit(1), (F.first("page_width") / bin_width).cast("int")).alias("n_bins"))
    ends = rows.join(pages, key)
    low = F.greatest(F.lit(0), (F.col("x0") / bin_width).cast("int"))
    high = F.least(F.col("n_bins") - 1, (F.col("x1") / bin_width).cast("int"))
    # A sequence that would fall is an empty range.
    crossed = ends.select(*key, low.alias("low"), high.alias("high")).filter("low <= high").select(*key, F.explode(F.sequence("low", "high")).alias("bin"))
    counted = crossed.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("crossings"))
    every = pages.select(*key, "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    return every.join(counted, [*key, "bin"], "left").select(*key, "n_bins", "bin", F.coalesce("crossings", F.lit(0)).cast("long").alias("crossings"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _in_body(line: Column) -> Column:
    return ~at_page_edge(line["top"], line["bottom"], line["page_height"]) & (line["text"] != "")


def _sparse_runs(ends: Column, n_bins: Column, tolerance: Column) -> Column:
    """Runs (run_start, run_end, exclusive) of bins with at most ``tolerance`` crossings in the searched middle of a page.

    ``ends`` are the first and last bins (low, high) of lines.  Crossings change there alone, so a page costs
    its lines, however many bins it has.
    """
    begin, end = (n_bins * SEARCH_MARGIN).cast("int"), (n_bins * F.lit(1.0 - SEARCH_MARGIN)).cast("int")
    event = lambda bin, change: F.struct(bin.alias("bin"), F.lit(change).alias("change"))
    # The borders of the searched middle are events too, so that no stretch between events reaches over one.
    events = F.concat(F.transform(ends, lambda e: event(e["low"], 1)), F.transform(ends, lambda e: event(e["high"] + 1, -1)), F.array(event(begin, 0), event(end, 0)))
    run = lambda start, stop: F.array(F.struct(start.alias("run_start"), stop.alias("run_end")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), begin.alias("begin"), end.alias("end"), tolerance.alias("tolerance"), F.slice(run(begin, end), 1, 0).alias("runs"))

    def step(s: Column, e: Column) -> Column:
        sparse = (e["bin"] > s["at"]) & (s["at"] >= s["begin"]) & (e["bin"] <= s["end"]) & (s["depth"] <= s["tolerance"])
        before = F.size(s["runs"]) - 1
        last = F.get(s["runs"], before)
        longer = F.when(last["run_end"] == s["at"], F.concat(F.slice(s["runs"], F.lit(1), before), run(last["run_start"], e["bin"]))).otherwise(F.concat(s["runs"], run(s["at"], e["bin"])))
        return F.struct(
            e["bin"].alias("at"), (s["depth"] + e["change"]).alias("depth"), s["begin"].alias("begin"), s["end"].alias("end"), s["tolerance"].alias("tolerance"), F.when(sparse, longer).otherwise(s["runs"]).alias("runs")
        )

    return F.aggregate(F.sort_array(events), start, step, lambda s: s["runs"])


def _widest_run(body: Column) -> Column:
    """The middle of the widest run that lines stand on both sides of; null if there is none."""

    def runs(page: Column) -> Column:
        low = lambda x: F.greatest(F.lit(0), (x["x0"] / BIN_WIDTH).cast("int"))
        high = lambda x: F.least(page["n_bins"] - 1, (x["x1"] / BIN_WIDTH).cast("int"))
        # A sequence that would fall is an empty range.
        ends = F.filter(F.transform(page["body"], lambda x: F.struct(low(x).alias("low"), high(x).alias("high"))), lambda e: e["low"] <= e["high"])
        return _bound(F.struct(ends.alias("ends"), page["n_bins"].alias("n_bins"), page["tolerance"].alias("tolerance")), widest)

    def widest(page: Column) -> Column:
        first, last = F.array_min(F.transform(page["ends"], lambda e: e["low"])), F.array_max(F.transform(page["ends"], lambda e: e["high"]))
        wide = F.greatest(F.lit(1), (page["n_bins"] * MIN_GUTTER_RATIO).cast("int"))
        found = F.filter(_sparse_runs(page["ends"], page["n_bins"], page["tolerance"]), lambda r: (r["run_end"] - r["run_start"] >= wide) & (first < r["run_start"]) & (last >= r["run_end"]))
        best = F.array_min(F.transform(found, lambda r: F.struct((r["run_start"] - r["run_end"]).alias("order"), r["run_start"].alias("run_start"), r["run_end"].alias("run_end"))))
        return _bound(best, lambda r: (r["run_start"] + r["run_end"]) / 2 * BIN_WIDTH)

    n_bins = F.greatest(F.lit(1), (F.get(body, 0)["page_width"] / BIN_WIDTH).cast("int"))
    return _bound(F.struct(body.alias("body"), n_bins.alias("n_bins"), (F.size(body) * CROSSING_RATIO).cast("int").alias("tolerance")), runs)


def _gutter(body: Column) -> Column:
    """The gutter of a page from the lines of its body (array of structs), null unless it has two columns."""

    def confirmed(page: Column) -> Column:
        gutter, body = page["gutter"], page["body"]
        left, right = F.filter(body, lambda x: x["x1"] <= gutter), F.filter(body, lambda x: x["x0"] >= gutter)
        most = lambda side, c: F.array_max(F.transform(side, lambda x: x[c]))
        least = lambda side, c: F.array_min(F.transform(side, lambda x: x[c]))
        extent = lambda side: F.struct(F.size(side).alias("n"), least(side, "top").alias("top"), most(side, "bottom").alias("bottom"))
        return _bound(F.struct(gutter.alias("gutter"), F.size(body).alias("n_lines"), extent(left).alias("left"), extent(right).alias("right")), two)

    def two(page: Column) -> Column:
        left, right = page["left"], page["right"]
        overlap = F.least(left["bottom"], right["bottom"]) - F.greatest(left["top"], right["top"])
        shorter = F.least(left["bottom"] - left["top"], right["bottom"] - right["top"])
        wide = F.least(left["n"], right["n"]) >= page["n_lines"] * MIN_SHARE
        tall = F.when((overlap > 0) & (shorter > 0), overlap / F.nullif(shorter, F.lit(0.0)) >= MIN_OVERLAP).otherwise(False)
        return F.when(wide & tall, page["gutter"])

    def found(body: Column) -> Column:
        # Lines on both sides of a gutter: some line begins where another has ended, or the page is not searched.
        beside = F.array_max(F.transform(body, lambda x: x["x0"])) >= F.array_min(F.transform(body, lambda x: x["x1"]))
        return F.when((F.size(body) >= MIN_LINES) & beside, _bound(F.struct(_widest_run(body).alias("gutter"), body.alias("body")), confirmed))

    return _bound(body, found)


def gutters(placed: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """(key, gutter) for the pages of ``placed`` lines that have two columns."""
    line = F.struct("text", "x0", "x1", "top", "bottom", "page_width", "page_height")
    pages = placed.groupBy(*key).agg(F.collect_list(line).alias("lines"))
    return pages.select(*key, _gutter(F.filter("lines", _in_body)).alias("gutter")).filter("gutter IS NOT NULL")


def row_numbers(items: Column, tolerance: Column) -> Column:
    """Anchored rows: ``items`` (structs with top first, sorted) each with the number of its row.

    A row is opened by its first item; what lies further below that item than the tolerance opens the
    next.
    """
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = s["anchor"].isNull() | (x["top"] - s["anchor"] > tolerance)
        row = F.when(fresh, s["row"] + 1).otherwise(s["row"])
        return F.struct(F.when(fresh, x["top"]).otherwise(s["anchor"]).alias("anchor"), row.alias("row"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def cluster_rows(placed: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``row``, numbered within a column: rows from the top, items from the left.

    Lines travel whole with their column, so none is looked up again for its row.
    """
    height = F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))
    order = ["top", "x0", "line_seq"]
    line = F.struct(*order, *[c for c in placed.columns if c not in (*key, *order)])
    grouped = placed.groupBy(*key).agg(F.sort_array(F.collect_list(line)).alias("items"), (F.coalesce(F.median(height), F.lit(0.0)) * ROW_TOLERANCE).alias("tolerance"))
    rows = grouped.select(*key, F.explode_outer(F.arrays_zip("items", row_numbers(F.col("items"), F.col("tolerance")).alias("row"))).alias("z"))
    return rows.select(*key, "z.items.*", "z.row")


def reading_order(placed: DataFrame) -> DataFrame:
    """All lines of every document with ``line_index``, ``column`` and ``is_column_start``.

    Pages follow each other; a page with a gutter is read column by column, every line belonging to the
    side of its middle.  Each step needs a document's lines together and no more: lines that are dealt by
    document do not travel again.
    """
    line = F.struct(*[c for c in placed.columns if c not in PAGE])
    pages = placed.groupBy(*PAGE).agg(F.collect_list(line).alias("lines")).withColumn("gutter", _gutter(F.filter("lines", _in_body)))
    sided = pages.select(*PAGE, "gutter", F.explode("lines").alias("line")).select(*PAGE, "line.*", "gutter")
    middle = (F.col("x0") + F.col("x1")) / 2
    sided = sided.withColumn("column", F.when(F.col("gutter").isNull() | (middle <= F.col("gutter")), 0).otherwise(1))
    sided = cluster_rows(sided, [*PAGE, "column"])
    order = Window.partitionBy("doc_id").orderBy("page_number", "column", "row", "x0", "top", "line_seq")
    sided = sided.withColumn("line_index", F.row_number().over(order) - 1)
    page, column = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE, "column")
    first_of_column = F.min("line_index").over(column)
    starts = (F.col("line_index") == first_of_column) & (first_of_column > F.min("line_index").over(page))
    return sided.withColumn("is_column_start", starts)


def running_furniture(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_in_header_footer): an edge line, numbers aside, that two pages share."""
    edge = placed.filter((F.col("text") != "") & at_page_edge(F.col("top"), F.col("bottom"), F.col("page_height")))
    seen = edge.select(key, "page_number", furniture_key("text").alias("furniture")).distinct().groupBy(key, "furniture").agg(F.count(F.lit(1)).alias("pages"))
    return seen.groupBy(key).agg((F.max("pages") >= MIN_REPEATS).alias("text_in_header_footer"))


def font_families(styled: DataFrame, key: str = "doc_id") -> DataFrame:
    return styled.filter("font <> ''").groupBy(key).agg(F.sort_array(F.collect_set(font_family("font"))).alias("font_families"))


#: Statistics that ``with_line_statistics`` adds, and their values for a document without lines.
LINE_STATISTICS = {"words_total": 0, "column_count": 1, "median_font_size": 0.0}


def with_line_statistics(ordered: DataFrame) -> DataFrame:
    """Lines with what they tell of their document together: words, columns and the median font size."""
    doc = Window.partitionBy("doc_id")
    return ordered.withColumns({
        "words_total": F.sum("word_count").over(doc), "column_count": F.max(F.col("gutter").isNotNull().cast("int") + 1).over(doc),
        "median_font_size": F.median(F.when(F.col("text") != "", F.col("max_font_size"))).over(doc),
    })


def edge_lines(styled: DataFrame) -> DataFrame:
    """The lines in headers and footers; spans elsewhere are left out before lines are put together."""
    return lines(styled.filter(at_page_edge(F.col("line_top"), F.col("line_bottom"), F.col("page_height"))))


def page_statistics(pages: DataFrame, styled: DataFrame) -> DataFrame:
    """One row per document of ``pages``: counts, furniture and fonts."""
    per_page = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum("character_count").alias("character_count"), F.sum("image_count").alias("image_count"), F.sum("table_count").alias("table_count")
    )
    out = per_page.join(running_furniture(edge_lines(styled)), "doc_id", "left").join(font_families(styled), "doc_id", "left")
    return out.fillna({"text_in_header_footer": False}).withColumn("font_families", F.coalesce("font_families", F.array().cast("array<string>")))
