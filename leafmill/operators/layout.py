"""Page layout rules: words, drawing numbers, callouts, rules, gutters, routing, OCR repair.

Pixel work (OCR, detectors) stays outside; these rules take what it has read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import DRAWING, clean
from leafmill.operators.spatial import boxes_meet

#: Kinds that are never figures; page kinds by what is read from them.
NO_FIGURE = ("text", "icon", "logo", "decoration", "blank")
WITH_TABLE = ("parts_list", "parts_list_and_drawings", "table_and_drawing")
WITH_TEXT = ("controller_screen", "text", "table_and_drawing")
#: Marks that mean "same as above".
DITTO = ("〃", '"', "''", "同上", "〃〃", ",,", "//")


def split_words(boxes: DataFrame) -> DataFrame:
    """OCR boxes of several words become words; x is spread by character offset.

    boxes(page, x0, y0, x1, y1, text, conf)."""
    n = F.greatest(F.char_length("text"), F.lit(1))
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))
    # offset of each word: the characters before it, separators counted as they stand
    flat = boxes.select("*", F.posexplode(words).alias("i", "word"), n.alias("n"))
    before = F.aggregate(F.slice(F.split("text", r"\s+"), 1, F.col("i")), F.lit(0), lambda a, w: a + F.char_length(w) + 1)
    step = (F.col("x1") - F.col("x0")) / F.col("n")
    return flat.withColumn("at", before).select("page", (F.col("x0") + F.col("at") * step).alias("x0"), "y0", (F.col("x0") + (F.col("at") + F.char_length("word")) * step).alias("x1"), "y1", F.col("word").alias("text"), "conf")


def page_words(text_layer: DataFrame, ocr: DataFrame, least: int = 5) -> DataFrame:
    """The text layer of pages with five words or more, else what OCR read."""
    layered = text_layer.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("page")
    return text_layer.join(layered, "page", "left_semi").unionByName(ocr.join(layered, "page", "left_anti"), allowMissingColumns=True)


def scanned_pages(pages: DataFrame) -> DataFrame:
    """pages(page, n_words, image_area, page_area): fewer than five words and mostly image."""
    return pages.where((F.col("n_words") < 5) & (F.col("image_area") / F.col("page_area") > 0.5))


def drawing_numbers(c: Column) -> Column:
    """Of an array, in capitals: long enough, letters and digits, not a thread, pipe or page mark; distinct in order."""
    plain = F.transform(c, lambda x: F.upper(F.regexp_replace(clean(x), "^-+|-+$", "")))
    fits = lambda x: (F.length(x) >= 4) & x.rlike("[A-Z]") & x.rlike(r"\d") & ~x.rlike(r"^(\d+-)?M\d|^PT\d|^PAGE-?\d")
    return F.array_distinct(F.filter(plain, fits))


def figure_verdict(is_figure: Column, kind: Column, layout: Column) -> Column:
    """The judge's verdict, overridden by kinds that are no figures; no verdict keeps the figure."""
    keep = ~F.coalesce(kind.isin(*NO_FIGURE), F.lit(False)) & F.coalesce(is_figure, F.lit(True))
    known = F.when(layout.isin("single", "multi_view", "exploded_parts"), layout).otherwise("single")
    return F.struct(keep.alias("keep"), known.alias("layout"))


def page_route(kind: Column) -> Column:
    return F.struct(kind.isin(*WITH_TABLE).alias("read_table"), kind.isin(*WITH_TEXT).alias("read_text"), (kind != "parts_list").alias("keep_figure"))


def figure_callouts(words: DataFrame, figures: DataFrame, least: float = 0.5) -> DataFrame:
    """(figure_id, callout): numbers 1 to 999 read well enough whose box meets the figure."""
    numbers = words.where(F.col("text").rlike(r"^\d{1,3}$") & (F.col("conf") >= least)).withColumn("no", F.col("text").cast("int")).where("no BETWEEN 1 AND 999")
    return boxes_meet(numbers, figures).select("b.figure_id", F.col("a.no").alias("callout")).distinct()


def corner_code(words: DataFrame, figures: DataFrame, order: str | None = None) -> DataFrame:
    """The first word in a figure that is a drawing code, with double hyphens made plain.

    Of words at the same place the first by the column ``order`` counts, then by text.  Figures with the same box are
    one question; pairs grow with the words and the different boxes of a page, not with their copies."""
    box = ["page", "x0", "y0", "x1", "y1"]
    met = boxes_meet(words.where(F.col("text").rlike(DRAWING)), figures.select(*box).distinct())
    at = F.struct(*(F.col(f"a.{c}") for c in ("y0", "x0", *([order] if order else []))))
    first = F.min(F.struct(at.alias("at"), F.col("a.text").alias("text"))).alias("first")
    found = met.groupBy(*(F.col(f"b.{c}").alias(c) for c in box)).agg(first)
    code = F.replace("first.text", F.lit("--"), F.lit("-"))
    return figures.select("figure_id", *box).join(found, box).groupBy("figure_id").agg(F.min_by(code, "first").alias("code"))


def merged_rules(rules: DataFrame, least: float = 8.0, share: float = 0.6) -> DataFrame:
    """rules(table_id, at): without those closer to their immediate predecessor than
    max(least, share * median gap)."""
    w = Window.partitionBy("table_id").orderBy("at")
    gaps = rules.withColumn("gap", F.col("at") - F.lag("at").over(w))
    limit = gaps.groupBy("table_id").agg(F.greatest(F.lit(least), F.coalesce(F.percentile("gap", 0.5), F.lit(0.0)) * share).alias("limit"))
    return gaps.join(limit, "table_id").where(F.col("gap").isNull() | (F.col("gap") >= F.col("limit"))).select("table_id", "at")


def ink_bands(profile: DataFrame, least_gap: int = 8, keys: tuple[str, ...] = ("figure_id",), share: float = 0.0) -> DataFrame:
    """Bands of rows with ink: blank runs of ``least_gap`` rows, or of ``share`` of the figure's size, part them.

    profile(<keys>, row, ink), with size for a share -> <keys>, band, first, last (islands over inked rows)."""
    w = Window.partitionBy(*keys).orderBy("row")
    gap = F.greatest(F.lit(least_gap), F.floor(F.col("size") * share)) if share else F.lit(least_gap)
    inked = profile.where("ink > 0").withColumn("new", F.when(F.col("row") - F.lag("row").over(w) - 1 < gap, 0).otherwise(1))
    inked = inked.withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return inked.groupBy(*keys, "band").agg(F.min("row").alias("first"), F.max("row").alias("last"))


def figure_views(profile: DataFrame, gap: float = 0.03, caption: float = 0.12, most: int = 6) -> DataFrame:
    """The views that a composite figure falls into: figure_id, axis, view (from 1), first, last.

    profile(figure_id, axis, row, ink, size): ink by row (axis 0) and by column (axis 1).  Blank gutters part
    bands; a band shorter than ``caption`` of the figure is a caption and belongs to the view before it, the
    first one to the view after it.  The first axis with two views counts; a figure of one view, or of
    more than ``most``, stays whole and has no rows here."""
    keys = ["figure_id", "axis"]
    bands = ink_bands(profile, 8, tuple(keys), gap).join(profile.groupBy(*keys).agg(F.max("size").alias("size")), keys)
    w = Window.partitionBy(*keys).orderBy("first")
    short = F.col("last") - F.col("first") + 1 < F.col("size") * caption
    bands = bands.withColumn("view", F.sum(F.when(short & (F.lag("first").over(w).isNotNull()), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    views = bands.groupBy(*keys, "size", "view").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    above = (F.col("view") == 1) & short
    views = views.withColumn("view", F.when(above, 2).otherwise(F.col("view"))).groupBy(*keys, "view").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    views = views.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n >= 2")
    views = views.withColumn("best", F.min("axis").over(Window.partitionBy("figure_id"))).where((F.col("axis") == F.col("best")) & (F.col("n") <= most))
    return views.select("figure_id", "axis", F.row_number().over(w).alias("view"), "first", "last")


def ink_extent(ink: DataFrame, least: float = 0.004, cut: float = 0.002, margin: int = 20) -> DataFrame:
    """The box of a page's drawing: figure_id, x0, y0, x1, y1; pages with too little ink have none.

    ink(figure_id, x, y, width, height): the inked pixels outside tables.  A share ``cut`` of them on each side
    is speckle; both ends are exact percentiles, rounded down, with a margin inside the page."""
    ends = F.array(F.lit(cut), F.lit(1 - cut))
    per = ink.groupBy("figure_id", "width", "height").agg(F.count("*").alias("n"), F.percentile("x", ends).alias("xs"), F.percentile("y", ends).alias("ys"))
    per = per.where(F.col("n") >= F.col("width") * F.col("height") * least)
    low = lambda c: F.greatest(F.lit(0), F.floor(F.col(c)[0]) - margin).cast("int")
    high = lambda c, size: F.least(F.col(size), F.floor(F.col(c)[1]) + margin).cast("int")
    return per.select("figure_id", low("xs").alias("x0"), low("ys").alias("y0"), high("xs", "width").alias("x1"), high("ys", "height").alias("y1"))


def all_callouts(circled: Column, codes: Column, kind: Column, least: int = 3) -> Column:
    """Circled numbers of a drawing, and its letter-number codes where fewer than ``least`` were found."""
    drawn = kind.isin("drawing", "parts_list_and_drawings", "table_and_drawing")
    return F.when((F.size(circled) < least) & drawn, F.array_union(circled, codes)).otherwise(circled)


def small_tables(tables: DataFrame, most: float = 0.35) -> DataFrame:
    """tables(page, width, height, page_width, page_height) that don't fill the page: larger ones are read as pages."""
    return tables.where(F.col("width") * F.col("height") <= F.col("page_width") * F.col("page_height") * most)


def framed(box: Column, frames: Column, width: Column, height: Column, pad: float = 0.015, margin: int = 4) -> Column:
    """A figure's box, grown to the smallest frame that holds nine tenths of it and is about its size, else by a pad.

    box and frames: structs x0, y0, x1, y1; the result lies within the page."""
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    one = F.greatest(area(box), F.lit(1))
    meets = lambda f: F.greatest(F.lit(0), F.least(box["x1"], f["x1"]) - F.greatest(box["x0"], f["x0"])) * F.greatest(F.lit(0), F.least(box["y1"], f["y1"]) - F.greatest(box["y0"], f["y0"]))
    fits = F.filter(frames, lambda f: (meets(f) / one >= 0.9) & (area(f) / one).between(0.8, 1.6))
    best = F.get(F.array_sort(F.transform(fits, lambda f: F.struct(area(f).alias("area"), f.alias("box")))), F.lit(0))["box"]
    by_x, by_y = (width * pad).cast("int"), (height * pad).cast("int")

    def within(b: Column, x, y) -> Column:
        return F.struct(F.greatest(F.lit(0), b["x0"] - x).alias("x0"), F.greatest(F.lit(0), b["y0"] - y).alias("y0"), F.least(width, b["x1"] + x).alias("x1"), F.least(height, b["y1"] + y).alias("y1"))

    return F.when(best.isNotNull(), within(best, F.lit(margin), F.lit(margin))).otherwise(within(box, by_x, by_y))


def carried_names(rows: DataFrame) -> DataFrame:
    """rows(table_id, no, name, code): ditto marks, and blank names beside a code, repeat the name above."""
    same = F.col("name").isin(*DITTO) | ((F.coalesce("name", F.lit("")) == "") & (F.coalesce("code", F.lit("")) != ""))
    own = F.when(~same & (F.col("name") != ""), F.col("name"))
    w = Window.partitionBy("table_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("name", F.when(same, F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit(""))).otherwise(F.coalesce("name", F.lit(""))))


def repaired_cell(c: Column, column: str) -> Column:
    """OCR repair of a cell by its column: spaces around hyphens in part numbers, 0 for O before
    letters in descriptions, WIO for W/O in remarks, marks around refs and quantities."""
    if column == "part":
        return F.regexp_replace(c, r"\s*-\s*", "-")
    if column == "description":
        return F.regexp_replace(c, r"\b0(?=-?[A-Z]{2})", "O")
    if column == "remarks":
        return F.regexp_replace(c, r"\bWIO\b", "W/O")
    return F.regexp_replace(c, "^[.:;, ]+|[.:;, ]+$", "")


def vision_rows(c: Column) -> Column:
    """Rows of a vision reading in JSON: kept with a part number or a description; odd refs are blank."""
    rows = F.from_json(c, "struct<rows:array<struct<ref:string,part_number:string,description:string,qty:string>>>")["rows"]
    full = F.filter(rows, lambda r: (F.trim(F.coalesce(r["part_number"], F.lit(""))) != "") | (F.trim(F.coalesce(r["description"], F.lit(""))) != ""))
    return F.transform(full, lambda r: F.struct(F.when(r["ref"].rlike(r"^\d{1,3}$"), r["ref"]).otherwise("").alias("ref"), r["part_number"], r["description"], r["qty"]))


def upright(counts: DataFrame, tie: float = 0.85) -> DataFrame:
    """counts(page, rotation, words): the rotation with most upright words; a near second is a tie."""
    w = Window.partitionBy("page").orderBy(F.desc("words"), "rotation")
    ranked = counts.withColumns({"n": F.row_number().over(w), "second": F.lead("words").over(w)})
    return ranked.where("n = 1").select("page", "rotation", (F.coalesce("second", F.lit(0)) >= tie * F.col("words")).alias("tie"))


def skew(angles: DataFrame, least: int = 3, most: float = 8.0) -> DataFrame:
    """angles(page, angle): the median of at least three small line angles, else 0."""
    flat = F.when(F.abs("angle") <= most, F.col("angle"))
    return angles.groupBy("page").agg(F.when(F.count(flat) >= least, F.percentile(flat, 0.5)).otherwise(0.0).alias("skew"))


def natural_order(c: Column) -> list[Column]:
    """Sort keys: numbers first by value, then texts."""
    number = c.rlike(r"^\d+$")
    return [F.when(number, 0).otherwise(1), F.when(number, c.try_cast("bigint")), c]


def valid_upload(kind: Column, length: Column, query: Column, most: int = 10 * 1024 * 1024) -> Column:
    return kind.startswith("image/") & length.between(1, most) & (F.trim(F.coalesce(query, F.lit(""))) != "")
