"""Table grids: validity, rendering, splitting at rows, titles, legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import PLACEHOLDER, whole_cells

MAX_TABLE_CHARS = 2500


def validity(cells: DataFrame, flavor: str = "lattice") -> DataFrame:
    """(table_id, valid, reason) from cells(table_id, row_no, col_no, cell), one row a cell.

    The reasons apply in a fixed order; row 0 is the header.
    """
    full = F.coalesce(F.trim("cell"), F.lit(""))
    rows = cells.select("table_id", "row_no", "col_no", full.alias("cell"))
    per_row = rows.groupBy("table_id", "row_no").agg(
        F.count("*").alias("cols"), F.count_if(F.col("cell") != "").alias("filled"),
        # a row has few cells: small sets, not the expansion of two distinct counts
        F.size(F.collect_set(F.when(F.col("cell") != "", F.col("cell")))).alias("values"),
        F.size(F.collect_set(F.when(F.col("cell") != "", F.lower("cell")))).alias("names"),
    )
    head, body = F.col("row_no") == 0, F.col("row_no") > 0
    t = per_row.groupBy("table_id").agg(
        F.count("*").alias("n_rows"), F.max("cols").alias("n_cols"), F.sum("filled").alias("filled"),
        F.max(F.when(head, F.col("filled"))).alias("head_filled"), F.max(F.when(head, F.col("names"))).alias("head_names"),
        F.count_if(body).alias("n_body"), F.count_if(body & (F.col("values") <= 1)).alias("same"),
    )
    fill = F.col("filled") / (F.col("n_rows") * F.col("n_cols"))
    reason = (
        F.when((F.col("n_rows") < 2) | (F.col("n_cols") < 2), "too small")
        .when(fill < (0.55 if flavor == "stream" else 0.35), "too sparse")
        .when(F.col("head_filled") / F.col("n_cols") < 0.7, "header mostly empty")
        .when(F.col("head_names") < F.greatest(F.lit(2), F.floor(F.col("n_cols") * F.lit(0.6))), "header not distinct")
        .when((F.col("n_rows") == 2) & (fill < 0.8), "single sparse row")
        .when(F.col("same") / F.col("n_body") > 0.6, "repeated values")
    )
    return t.select("table_id", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def usable_markdown(c: Column) -> Column:
    """Three non-blank lines, two real header cells and a body row with two real cells."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")

    def real(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
        return F.size(F.filter(cells, lambda x: (x != "") & ~x.rlike(PLACEHOLDER)))

    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    return (F.size(lines) >= 3) & (real(F.get(lines, F.lit(0))) >= 2) & F.exists(body, lambda r: real(r) >= 2)


def markdown(header: Column, rows: Column) -> Column:
    """A grid as markdown: header(array<string>), rows(array<array<string>>); pipes are
    escaped in the body, short rows padded, long ones cut."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    flat = lambda x: F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit(" "))
    names = F.transform(header, lambda h, i: F.coalesce(F.nullif(flat(h), F.lit("")), F.concat(F.lit("Col "), (i + 1).cast("string"))))
    fitted = lambda r: F.transform(header, lambda h, i: F.replace(flat(F.get(r, i)), F.lit("|"), F.lit("\\|")))
    return F.array_join(F.concat(F.array(line(names), line(F.transform(header, lambda h: F.lit("---")))), F.transform(rows, lambda r: line(fitted(r)))), "\n")


def header_value_text(header: Column, rows: Column, caption: Column) -> Column:
    """``Header: value | ...`` lines without blank and ``Col ...`` headers; a row without any
    labelled value gives its raw values; empty rows are left out."""

    def one(r: Column) -> Column:
        both = F.filter(F.zip_with(header, r, lambda h, v: F.struct(F.trim(F.coalesce(h, F.lit(""))).alias("h"), F.trim(F.coalesce(v, F.lit(""))).alias("v"))), lambda x: x["v"] != "")
        real = F.filter(both, lambda x: (x["h"] != "") & ~F.lower(x["h"]).startswith("col "))
        return F.when(F.size(real) > 0, F.array_join(F.transform(real, lambda x: F.concat(x["h"], F.lit(": "), x["v"])), " | ")).otherwise(F.array_join(F.transform(both, lambda x: x["v"]), " | "))

    lines = F.filter(F.transform(rows, one), lambda x: x != "")
    return F.array_join(F.concat(F.filter(F.array(caption), lambda c: F.coalesce(c, F.lit("")) != ""), lines), "\n")


def row_groups(rows: Column, limit: int = MAX_TABLE_CHARS) -> Column:
    """Part number (from 0) of each row: a part is closed before the row that would pass the limit."""
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("size"), F.lit(False).alias("any"), F.array().cast("array<int>").alias("out"))

    def add(a: Column, row: Column) -> Column:
        new = a["any"] & (a["size"] + F.length(row) > limit)
        g = a["g"] + new.cast("int")
        return F.struct(g.alias("g"), (F.when(new, 0).otherwise(a["size"]) + F.length(row) + 1).alias("size"), F.lit(True).alias("any"), F.concat(a["out"], F.array(g)).alias("out"))

    return F.aggregate(rows, start, add, lambda a: a["out"])


def split_table(df: DataFrame, limit: int = MAX_TABLE_CHARS) -> DataFrame:
    """df(table_id, head, rows ARRAY<STRING>, markdown) -> table_id, part, n_parts, content, render_markdown.

    Parts repeat the head; with several parts a note tells which one it is.  The grid is cut at the same
    rows, below its own two head lines, if it has as many rows; else it stays whole with the first part.
    """
    grid = F.split(F.coalesce("markdown", F.lit("")), "\n")
    body = F.when(F.size(grid) > 2, F.slice(grid, 3, F.greatest(F.size(grid) - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    groups = df.withColumns({"g": row_groups(F.col("rows"), limit), "top": F.slice(grid, 1, 2), "grid": body})
    groups = groups.withColumn("even", (F.size("grid") == F.size("rows")) & (F.size("grid") > 0))
    groups = groups.withColumn("grid", F.when(F.col("even"), F.col("grid")).otherwise(F.transform("rows", lambda r: F.lit(None).cast("string"))))
    keys = ["table_id", "head", "top", "even", "markdown"]
    flat = groups.select(*keys, F.posexplode(F.arrays_zip("rows", "g", "grid")).alias("pos", "r")).select(*keys, "pos", F.col("r.rows").alias("row"), F.col("r.grid").alias("line"), F.col("r.g").alias("part"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "row", "line")))
    parts = flat.groupBy(*keys, "part").agg(rows.alias("r"))
    n = F.count("*").over(Window.partitionBy("table_id"))
    note = F.when(F.col("n_parts") > 1, F.format_string("(part %d of %d)", F.col("part") + 1, F.col("n_parts")))
    lines = lambda f: F.array_join(F.transform("r", lambda x: x[f]), "\n")
    shown = F.when(F.col("even"), F.concat_ws("\n", F.array_join("top", "\n"), lines("line"))).when(F.col("part") == 0, F.col("markdown"))
    return parts.withColumn("n_parts", n).select(
        "table_id", (F.col("part") + 1).alias("part"), F.col("n_parts").cast("int").alias("n_parts"), F.concat_ws("\n", "head", note, lines("row")).alias("content"), shown.alias("render_markdown")
    )


def table_chunks(df: DataFrame, limit: int = MAX_TABLE_CHARS) -> DataFrame:
    """df(table_id, content, markdown, caption_line) -> table_id, part, n_parts, content, render_markdown.

    A table of up to ``limit`` characters stays whole; a longer one is split at its rows, its first line
    repeated in every part if it is a caption line."""
    text = F.coalesce("content", F.lit(""))
    whole = df.where(F.length(text) <= limit).select("table_id", F.lit(1).alias("part"), F.lit(1).alias("n_parts"), text.alias("content"), F.col("markdown").alias("render_markdown"))
    lines = F.split(text, "\n")
    first = F.col("caption_line") & (F.size(lines) > 0)
    long = df.where(F.length(text) > limit).select("table_id", F.when(first, lines[0]).alias("head"), F.when(first, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines).alias("rows"), "markdown")
    return whole.unionByName(split_table(long, limit))


def chosen_tables(found: DataFrame) -> DataFrame:
    """found(page, flavor, table_id, valid): of each page the valid tables of the first flavor, lattice before stream, that has one."""
    rank = F.when(F.col("flavor") == "lattice", 0).otherwise(1)
    best = Window.partitionBy("page")
    good = found.where("valid").withColumn("rank", rank)
    return good.withColumn("best", F.min("rank").over(best)).where("rank = best").drop("rank", "best", "valid")


def legend_scores(figures: DataFrame, grids: DataFrame, band: int | None = 2) -> DataFrame:
    """figure_id, table_id, hits: codes of a figure that are whole cells of a table of its manual.

    figures(figure_id, manual_id, page, codes ARRAY), grids(table_id, manual_id, page, cells ARRAY): an equi
    join on manual and code, and on the pages of the band if there is one, so a common code only meets
    the tables near it; every listed code counts, also when it is listed twice."""
    codes = figures.select("figure_id", "manual_id", "page", F.explode("codes").alias("code"))
    cells = grids.select("table_id", "manual_id", "page", F.explode(F.array_distinct("cells")).alias("code"))
    keys = ["manual_id", "code"]
    if band is not None:
        near = F.filter(F.sequence(F.col("page") - band, F.col("page") + band), lambda p: p > 0)
        codes, keys = codes.withColumn("page", F.explode(near)), [*keys, "page"]
    return codes.join(cells.drop(*{"page"} - set(keys)), keys).groupBy("figure_id", "table_id").agg(F.count("*").alias("hits"))


def legend_pairs(figures: DataFrame, grids: DataFrame, band: int = 2, best: bool = True) -> DataFrame:
    """The best table near each figure (or all, with their scores): one point a code, two for a legend title; least score 2.

    grids with content (its first line is the title).  A titled table needs no code to reach the least
    score, so titled tables of the band come too.  Pages count from 1.
    """
    titled = F.lower(F.split(F.coalesce("content", F.lit("")), "\n")[0]).rlike(r"key to fig|legend|parts? list")
    named = grids.where(titled).select("table_id", "manual_id", "page")
    near = F.filter(F.sequence(F.col("page") - band, F.col("page") + band), lambda p: p > 0)
    near = figures.where(F.size("codes") > 0).select("figure_id", "manual_id", F.explode(near).alias("page")).join(named, ["manual_id", "page"]).select("figure_id", "table_id", F.lit(2).cast("bigint").alias("points"))
    points = legend_scores(figures, grids, band).select("figure_id", "table_id", F.col("hits").alias("points")).unionByName(near)
    scored = points.groupBy("figure_id", "table_id").agg(F.sum("points").alias("score")).where("score >= 2")
    w = Window.partitionBy("figure_id").orderBy(F.desc("score"), "table_id")
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n") if best else scored


def legend_sweep(figures: DataFrame, grids: DataFrame, share: float = 0.6, least: int = 4) -> DataFrame:
    """Over all tables of the manual: figures of four codes or more, most hits, at least max(4, int(share * codes)).

    Of n codes, h of which must be cells, any n - h + 1 have one that the table holds: a figure meets tables
    only through its rarest codes, and whole lists are compared then."""
    wanted = F.greatest(F.lit(least), F.floor(F.size("codes") * F.lit(share)))
    enough = figures.where(F.size("codes") >= least).select("figure_id", "manual_id", "codes", wanted.alias("wanted"))
    cells = grids.select("table_id", "manual_id", F.array_distinct("cells").alias("cells"))
    posted = cells.select("table_id", "manual_id", "cells", F.explode("cells").alias("code"))
    often = posted.groupBy("manual_id", "code").agg(F.count("*").alias("often"))
    each = enough.select("figure_id", "manual_id", "codes", "wanted", F.posexplode("codes").alias("pos", "code")).join(often, ["manual_id", "code"], "left")
    place = F.row_number().over(Window.partitionBy("figure_id", "manual_id", "codes").orderBy(F.coalesce("often", F.lit(0)), "code", "pos"))
    asked = each.withColumn("place", place).where((F.col("place") <= F.size("codes") - F.col("wanted") + 1) & F.col("often").isNotNull())
    asked = asked.select("figure_id", "manual_id", "codes", "wanted", "code").distinct()
    hits = F.size(F.filter("codes", lambda c: F.array_contains("cells", c))).cast("bigint")
    good = asked.join(posted, ["manual_id", "code"]).withColumn("hits", hits).where(F.col("hits") >= F.col("wanted"))
    best = good.groupBy("figure_id").agg(F.min(F.struct((-F.col("hits")).alias("less"), "table_id")).alias("best"))
    return best.select("figure_id", "best.table_id", (-F.col("best.less")).alias("hits"))


def legends(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """The legend of each figure: the best table near it, else the best of the manual: figure_id, table_id, near.

    tables(table_id, manual_id, page, content, render_markdown); those without a grid are no candidates."""
    grids = tables.where("render_markdown IS NOT NULL").withColumn("cells", whole_cells(F.col("render_markdown")))
    near = legend_pairs(figures, grids).select("figure_id", "table_id", F.lit(True).alias("near"))
    rest = figures.join(near.select("figure_id"), "figure_id", "left_anti")
    return near.unionByName(legend_sweep(rest, grids).select("figure_id", "table_id", F.lit(False).alias("near")))
