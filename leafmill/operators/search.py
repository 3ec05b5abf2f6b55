"""Vector search and the retrieval rules built on it, for whole tables of queries; see ``vectors`` for the pass over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import part_numbers
from leafmill.operators.vectors import EXACT, Slot, slot_hits
from leafmill.sources.scratch import held

#: Gates of the retrieval rules; parameters everywhere.
MIN_FIGURE, MIN_OTHER_MANUAL, MIN_MEMORY = 0.38, 0.55, 0.47
#: Hits up to which what they look up is broadcast.
MAX_BROADCAST = 500_000


def search(index: DataFrame, queries: DataFrame, k: int, types: tuple[str, ...] = (), scope: str = "same", key: str = "manual_id", payload: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, score, rank (1 is best) and ``payload`` columns of the k nearest rows by cosine; one slot of ``vectors.slot_hits``."""
    return slot_hits(index, queries, [Slot("", k, types, scope)], payload, key).drop("slot")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; Spark prunes each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top(df: DataFrame, keys: list[str], k: int | None, order: list | None = None, rank: str = "rank") -> DataFrame:
    """The k first rows of each key with their rank; without k all of them."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.desc("score"), F.col("id")]))
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def text_hits(index: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    return search(index, queries, k, ("text", "table", "part"))


def figure_hits(index: DataFrame, queries: DataFrame, gate: float = MIN_FIGURE, fetch: int = 12, k: int = 3) -> DataFrame:
    """Over-fetch, gate, one row for each path (the best), the k best."""
    found = search(index, queries, fetch, ("image",), payload=("manual_id", "path", "figure_role", "parent_path")).where(F.col("score") >= gate).drop("rank")
    return top(first_by(found, ["query_id", "path"], [F.desc("score"), F.col("id")]), ["query_id"], k)


def table_hits(index: DataFrame, queries: DataFrame, gate: float = MIN_FIGURE, fetch: int = 4, k: int = 2) -> DataFrame:
    found = search(index, queries, fetch, ("table",), payload=("render_markdown",)).drop("rank").where("render_markdown IS NOT NULL")
    return top(found.where(F.col("score") >= gate), ["query_id"], k)


def other_manual_hits(index: DataFrame, queries: DataFrame, gate: float = MIN_OTHER_MANUAL, fetch: int = 9, k: int = 3) -> DataFrame:
    found = search(index, queries, fetch, scope="other", payload=("manual_id", "page")).where(F.col("score") >= gate).drop("rank")
    return top(first_by(found, ["query_id", "manual_id", "page"], [F.desc("score"), F.col("id")]), ["query_id"], k)


def parents(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Full figures of the parts that were hit, unless they were hit themselves; the
    score is that of the best part.  Several rows may share a path: all come."""
    wanted = hits.where("figure_role = 'part' AND parent_path IS NOT NULL").groupBy("query_id", "manual_id", F.col("parent_path").alias("path")).agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    wanted = wanted.join(hits.select("query_id", "path"), ["query_id", "path"], "left_anti")
    figures = index.where("type = 'image'").select("id", "manual_id", "path", "figure_role", "parent_path")
    return wanted.join(figures, ["manual_id", "path"])


def part_figures(text: DataFrame, figures: DataFrame, index: DataFrame) -> DataFrame:
    """Figures of the part entries among the text hits, minus the figures already there."""
    parts = text.join(index.where("type = 'part' AND parent_path IS NOT NULL").select("id", "manual_id", F.col("parent_path").alias("path")), "id")
    wanted = parts.groupBy("query_id", "manual_id", "path").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    wanted = wanted.join(figures.select("query_id", "path"), ["query_id", "path"], "left_anti")
    return wanted.join(index.where("type = 'image'").select("id", "manual_id", "path", "figure_role", "parent_path"), ["manual_id", "path"])


def full_before_parts(figures: DataFrame) -> DataFrame:
    """Position of each figure: groups by best score, in a group full views first.

    figures(query_id, pos, id, path, parent_path, figure_role, score): pos is the input order.
    """
    present = figures.select("query_id", F.col("path").alias("parent_path")).distinct().withColumn("there", F.lit(True))
    part = F.coalesce("figure_role", F.lit("full")) == "part"
    keyed = figures.join(present, ["query_id", "parent_path"], "left").withColumn("group", F.when(part & F.col("there"), F.col("parent_path")).otherwise(F.col("path")))
    g = Window.partitionBy("query_id", "group")
    keyed = keyed.withColumns({"best": F.max(F.coalesce("score", F.lit(0.0))).over(g), "first": F.min("pos").over(g), "is_part": part})
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), "first", "is_part", F.when(part, -F.coalesce("score", F.lit(0.0))), "pos")
    return keyed.withColumn("position", F.row_number().over(order)).drop("there", "best", "first", "is_part", "group")


def best_of_many(hits: DataFrame, k: int) -> DataFrame:
    """hits(report_id, query_id, id, score): the best score of each id over a report's queries."""
    best = hits.groupBy("report_id", "id").agg(F.max("score").alias("score"))
    return top(best, ["report_id"], k)


def exact_first(exact: DataFrame, near: DataFrame, key: str = "id") -> DataFrame:
    """Exact hits (score 1), then the near ones whose key is not among them; ``pos`` orders both.

    exact(query_id, pos, id, score, <key>), near(query_id, pos, id, score, <key>): pos is the order of either."""
    columns = list(dict.fromkeys(["query_id", "id", key, "score", "pos"]))
    rest = near.join(exact.select("query_id", key).distinct(), ["query_id", key], "left_anti")
    both = exact.select(*columns, F.lit(0).alias("late")).unionByName(rest.select(*columns, F.lit(1).alias("late")))
    order = Window.partitionBy("query_id").orderBy("late", "pos", "id")
    return both.withColumn("pos", F.row_number().over(order)).drop("late")


def code_hits(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows of the query's manual that list a code its text names: query_id, pos, id, type, path, score 1; k a query.

    index(id, manual_id, type, path, part_numbers ARRAY), queries(query_id, manual_id, text).  Codes are
    compared as they are stored, and a question's codes are capitals."""
    asked = queries.select("query_id", "manual_id", F.explode(part_numbers(F.col("text"))).alias("code"))
    listed = index.select("id", "manual_id", "type", "path", F.explode(F.array_distinct("part_numbers")).alias("code"))
    found = asked.join(listed, ["manual_id", "code"]).select("query_id", "id", "type", "path").distinct()
    return top(found, ["query_id"], k, [F.col("id")], "pos").withColumn("score", F.lit(1.0))


def matched_figure(index: DataFrame, queries: DataFrame, confident: float = 0.55, possible: float = MIN_FIGURE, fetch: int = 5) -> DataFrame:
    """The figure of the manual that an uploaded picture's description is most like: query_id, id, path, page,
    band (``confident`` or ``possible``), score; no row below ``possible``.  Figures without a path don't count."""
    near = search(index, queries, fetch, ("image",), payload=("path", "page")).drop("rank").where("path IS NOT NULL")
    band = F.when(F.col("score") >= confident, "confident").otherwise("possible")
    return top(near.where(F.col("score") >= possible), ["query_id"], 1).withColumn("band", band).drop("rank")


def retrieve(index: DataFrame, memory: DataFrame, queries: DataFrame, gate: float = MIN_FIGURE, other_gate: float = MIN_OTHER_MANUAL, memory_gate: float = MIN_MEMORY) -> DataFrame:
    """All that answers a question, in five slots: query_id, slot, pos, id, score.

    ``text``: exact code hits, then the nearest texts; ``image``: exact figures, then near ones with
    the full views of parts that were hit and the figures of part entries among the texts, full views
    first; ``table``; ``memory``: past fixes of the query's machine; ``other``: the other manuals.

    index as in ``search`` with page, path, figure_role, parent_path, render_markdown, part_numbers;
    memory(id, embedding, machine_id); queries(query_id, vector, manual_id, machine_id, text).
    """
    # all that is scored or listed comes from one pass over the index, with the columns that are needed of it
    asked = queries.select("query_id", "vector", "manual_id", part_numbers(F.col("text")).alias("codes"))
    rows = index.withColumn("shown", F.col("render_markdown").isNotNull())
    slots = [Slot("text", 3, ("text", "table", "part")), Slot("image", 12, ("image",)), Slot("table", 4, ("table",)), Slot("other", 9, (), "other")]
    hits = held(slot_hits(rows, asked, slots, ("manual_id", "type", "path", "figure_role", "parent_path", "page", "shown"), exact=10))
    slot = lambda name: hits.where(F.col("slot") == name).drop("slot")
    ranked = lambda df: df.withColumnRenamed("rank", "pos")
    exact = ranked(slot(EXACT))
    text = exact_first(exact.where("type <> 'image'"), ranked(slot("text")))

    near = first_by(slot("image").where(F.col("score") >= gate), ["query_id", "path"], [F.desc("score"), F.col("id")])
    near = top(near.drop("rank"), ["query_id"], 3)
    columns = ["query_id", "id", "path", "parent_path", "figure_role", "score"]
    late = lambda df, n: df.select(*columns, F.lit(n).alias("late"))
    place = lambda df: top(df, ["query_id"], None, [F.col("late"), F.desc("score"), F.col("id")], "pos")
    # a second pass, without vectors, looks up the figures of parts among the figures and among the texts
    points = F.max(F.coalesce("score", F.lit(0.0))).alias("score")
    of = near.where("figure_role = 'part' AND parent_path IS NOT NULL").groupBy("query_id", "manual_id", F.col("parent_path").alias("path")).agg(points)
    of = of.join(near.select("query_id", "path"), ["query_id", "path"], "left_anti").withColumn("why", F.lit("figure"))
    parts = hits.where(F.col("slot").isin(EXACT, "text") & (F.col("type") == "part") & F.col("parent_path").isNotNull()).select("query_id", "id", "manual_id", F.col("parent_path").alias("path")).distinct()
    by = text.select("query_id", "id", "score").join(parts, ["query_id", "id"]).groupBy("query_id", "manual_id", "path").agg(points).withColumn("why", F.lit("text"))
    wanted = of.unionByName(by)
    figures_of = index.where("type = 'image'").select("id", "manual_id", "path", "figure_role", "parent_path")
    found = held((F.broadcast(wanted) if hits.count() <= MAX_BROADCAST else wanted).join(figures_of, ["manual_id", "path"]))
    figures = full_before_parts(place(late(near, 0).unionByName(late(found.where("why = 'figure'"), 1))))
    pulled = found.where("why = 'text'").join(figures.select("query_id", "path"), ["query_id", "path"], "left_anti")
    n = figures.groupBy("query_id").agg(F.max("position").alias("n"))  # what is pulled in comes after all others
    after = pulled.select(*columns).join(n, "query_id", "left").withColumn("late", F.coalesce("n", F.lit(0)) + 1).drop("n")
    again = figures.withColumn("late", F.col("position")).select(*columns, "late").unionByName(after)
    ordered = full_before_parts(place(again)).drop("pos").withColumnRenamed("position", "pos")
    image = exact_first(exact.where("type = 'image'"), ordered, "path")

    table = ranked(top(slot("table").where(F.col("shown") & (F.col("score") >= gate)).drop("rank"), ["query_id"], 2))
    fixes = search(memory.withColumn("type", F.lit("memory")), queries.select("query_id", "vector", "machine_id"), 3, key="machine_id")
    fixes = ranked(fixes.where(F.col("score") >= memory_gate))
    other = first_by(slot("other").where(F.col("score") >= other_gate), ["query_id", "manual_id", "page"], [F.desc("score"), F.col("id")])
    other = ranked(top(other.drop("rank"), ["query_id"], 3))
    slots = {"text": text, "image": image, "table": table, "memory": fixes, "other": other}
    found = [df.select("query_id", F.lit(slot).alias("slot"), "pos", "id", "score") for slot, df in slots.items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
