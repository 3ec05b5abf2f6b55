"""Titles and captions: what a table is called, how a figure and its parts are described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a caption line of a table.
CAPTION = r"(?i)^(key to fig(ure)?\.?\s*\d|legend\b|parts?\s*list\b|table\s*\d)"
LEGEND_CAPTION = r"(?i)^(key to fig|legend|parts?\s*list)"


def guessed_caption(page_text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(page_text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.substring(F.get(F.filter(lines, lambda x: x.rlike(CAPTION)), F.lit(0)), 1, 100)


def looks_like_legend(first_cells: Column) -> Column:
    """First cells of the body rows: at least three rows, and max(3, half) of them numbers 1 to 199."""
    number = lambda x: F.trim(x).rlike(r"^\d{1,3}$") & F.trim(x).try_cast("int").between(1, 199)
    n = F.size(first_cells)
    return (n >= 3) & (F.size(F.filter(first_cells, number)) >= F.greatest(F.lit(3), F.floor(n / 2)))


def header_title(header: Column) -> Column:
    """Distinct header cells that are no numbers; the first four joined, if there are two."""
    cells = F.filter(F.transform(header, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    lower = F.transform(cells, lambda x: F.lower(x))
    distinct = F.filter(cells, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return F.when(F.size(distinct) >= 2, F.substring(F.array_join(F.slice(distinct, 1, 4), " / "), 1, 80))


def table_title(caption: Column, legend: Column, header: Column, section: Column) -> Column:
    """The caption, unless it announces a legend over a grid that is none; else the header; else the section."""
    usable = F.when((caption != "") & ~(caption.rlike(LEGEND_CAPTION) & ~legend), caption)
    return F.coalesce(usable, header_title(header), section)


def caption_head(component: Column, kind: Column, page: Column, drawing: Column, section: Column) -> Column:
    """``### component (Kind) — page N — drawing D (section: S)``; what is unknown is left out."""
    pretty = F.initcap(F.replace(F.coalesce(kind, F.lit("diagram")), F.lit("_"), F.lit(" ")))
    said = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), F.nullif(c.cast("string"), F.lit("")), F.lit(after)), F.lit(""))
    known = F.when(section != "Unknown Section", section)
    return F.concat(F.lit("### "), component, F.lit(" ("), pretty, F.lit(")"), said(" — page ", page), said(" — drawing ", drawing), said(" (section: ", known, ")"))


def _names(g: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(g["names"], lambda n: F.coalesce(n, F.lit("")) != "")), " / ")


def parts_line(groups: Column, verified: Column = None, missing: Column = None) -> Column:
    """groups: array of {ref, names array, numbers array} -> ``Parts shown in this diagram: ref = names (numbers); ....``

    Groups without a ref are left out.  A list that was read from a scan is marked, and callouts that it does
    not hold follow on a line of their own."""
    shown = F.filter(groups, lambda g: F.coalesce(g["ref"], F.lit("")) != "")
    name = lambda g: F.coalesce(F.nullif(_names(g), F.lit("")), F.lit("part"))
    one = lambda g: F.replace(F.concat(g["ref"], F.lit(" = "), name(g), F.lit(" ("), F.array_join(g["numbers"], ", "), F.lit(")")), F.lit(";"), F.lit(","))
    line = F.concat(F.lit("Parts shown in this diagram: "), F.array_join(F.transform(shown, one), "; "), F.lit("."))
    if verified is not None:
        line = F.concat(line, F.when(verified, "").otherwise(" (Parts list read by vision from a scanned page - unverified.)"))
    if missing is not None:
        line = F.concat(line, F.when(F.size(missing) > 0, F.concat(F.lit("\nCallouts with no entry in the parts list: "), F.array_join(missing, ", "), F.lit("."))).otherwise(""))
    return line


def listing(groups: Column, limit: int = 80) -> Column:
    """The first ``limit`` refs with their names, a line each: what a caption is asked to be true to."""
    shown = F.slice(F.filter(groups, lambda g: F.coalesce(g["ref"], F.lit("")) != ""), 1, limit)
    return F.array_join(F.transform(shown, lambda g: F.concat(F.lit("  "), g["ref"], F.lit(": "), _names(g))), "\n")


def fallback_caption(groups: Column, heading: Column) -> Column:
    """A caption that needs no model: every listed part by name."""
    shown = F.filter(groups, lambda g: F.coalesce(g["ref"], F.lit("")) != "")
    names = F.array_join(F.transform(shown, lambda g: F.concat(_names(g), F.lit(" ("), g["ref"], F.lit(")"))), ", ")
    return F.concat(F.lit("Exploded parts view of "), heading, F.lit(". The drawing shows: "), names, F.lit("."))


def figure_caption(head: Column, body: Column, groups: Column, verified: Column, missing: Column, codes: Column, labels: Column) -> Column:
    """A figure's whole caption: head, body, then its parts or, without a list, its callouts, and its labels."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    listed = F.coalesce(F.size(groups) > 0, F.lit(False))
    lines = [
        F.when(listed, F.concat(F.lit("\n"), parts_line(groups, verified, missing))),
        F.when(~listed & some(codes), F.concat(F.lit("\nCallout codes shown: "), F.array_join(codes, ", "))),
        F.when(some(labels), F.concat(F.lit("\nLeader-line labels: "), F.array_join(labels, ", "))),
    ]
    return F.concat(head, F.lit("\n\n"), body, *(F.coalesce(x, F.lit("")) for x in lines))


def view_chunks(figures: DataFrame) -> DataFrame:
    """A composite figure as chunks: the full view, then each of its views as a part of it.

    figures(manual_id, page, path, views ARRAY<STRING>) -> manual_id, page, path, figure_role, parent_path, nth."""
    full = figures.select("manual_id", "page", "path", F.lit("full").alias("figure_role"), F.lit(None).cast("string").alias("parent_path"), F.lit(0).alias("nth"))
    views = figures.select("manual_id", "page", F.col("path").alias("parent_path"), F.posexplode("views").alias("nth", "path"))
    return full.unionByName(views.select("manual_id", "page", "path", F.lit("part").alias("figure_role"), "parent_path", (F.col("nth") + 1).alias("nth")))


def callout_codes(read: Column, modelled: Column, labels: Column) -> Column:
    """Callouts of the text layer override the model's; leader labels follow."""
    base = F.when(F.size(F.coalesce(read, F.array().cast("array<string>"))) > 0, read).otherwise(F.coalesce(modelled, F.array().cast("array<string>")))
    return F.array_distinct(F.concat(base, F.coalesce(labels, F.array().cast("array<string>"))))


def enriched_table(content: Column, title: Column, section: Column, summary: Column, is_parts_list: Column) -> Column:
    """A head, the summary (never for parts lists) and the original rows.  A parts list without a title is
    called just that, another table by its section."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.when(is_parts_list, "Parts list").otherwise(F.coalesce(F.nullif(section, F.lit("")), F.lit("Technical Data"))))
    return F.concat_ws("\n\n", F.concat(F.lit("### Table — "), named), F.when(~is_parts_list, summary), content)


def retrieval_mode(mode: Column, intent: Column, pending: Column) -> Column:
    """How an answer is made, from the asked mode (answer or wizard), the chat's intent (troubleshoot
    or learn; troubleshoot by default) and whether a question is open: a reply to one goes on with the wizard."""
    aim = F.coalesce(intent, F.lit("troubleshoot"))
    wizard = (mode == "wizard") | ((mode == "answer") & (aim == "troubleshoot") & pending)
    return F.when(wizard & (aim == "learn"), "learning_walkthrough").when(wizard, "conversational_wizard").when(aim == "learn", "learning").otherwise("diagnosis")


def context_blocks(hits: DataFrame, limit: int = 500) -> DataFrame:
    """One context text a query: numbered blocks in rank order; hits of other manuals are
    collapsed and cut.  hits(query_id, rank, title, content, other)."""
    body = F.when(F.col("other"), F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, limit)).otherwise(F.col("content"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\n"), body)
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def attachments(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Tags in presentation order: figures with a path as IMAGE_n, then usable tables, each once, as TABLE_n.

    figures(query_id, pos, id, path), tables(query_id, pos, id, usable)."""
    tag = lambda df, name: df.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1).select("query_id", F.concat(F.lit(f"{name}_"), F.col("n").cast("string")).alias("tag"), "id")
    once = tables.where("usable").groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    return tag(figures.where("path IS NOT NULL"), "IMAGE").unionByName(tag(once, "TABLE"))


def attached_legends(pairs: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Greedy: full figures of a query in order, each with its best table that is not shown already and that no
    earlier figure took.

    pairs(query_id, figure_pos, figure_id, table_id, score): candidates of full figures, as of
    ``tables.legend_pairs``; shown(query_id, table_id).  A query's few figures and candidates fold in one row,
    inside the JVM."""
    if shown is not None:
        pairs = pairs.join(shown.select("query_id", "table_id"), ["query_id", "table_id"], "left_anti")
    per_figure = pairs.groupBy("query_id", "figure_pos", "figure_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "table_id"))).alias("t"))
    rows = per_figure.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("figure_pos", "figure_id", "t"))).alias("figures"))
    nothing = F.array().cast("array<struct<figure_id:bigint,table_id:bigint>>")

    def step(taken: Column, f: Column) -> Column:
        free = F.get(F.filter(f["t"], lambda t: ~F.exists(taken, lambda x: x["table_id"] == t["table_id"])), F.lit(0))
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(f["figure_id"].cast("bigint").alias("figure_id"), free["table_id"].cast("bigint").alias("table_id")))))

    return rows.select("query_id", F.explode(F.aggregate("figures", nothing, step)).alias("p")).select("query_id", "p.figure_id", "p.table_id")
