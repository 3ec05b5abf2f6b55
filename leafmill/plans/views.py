"""The driver's tables in the shape of the engine's entities: DataFrames, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ID4 = "CAST(floor(vec_id / 4.0) AS INT)"
#: Text that both engines read.
SQL = {
    "v_index": f"""SELECT vec_id AS id, embedding, 'M' || CAST(label AS STRING) AS manual_id,
  CASE vec_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'image' ELSE 'part' END AS type,
  CAST(floor(vec_id / 10.0) AS INT) AS page,
  CASE WHEN vec_id % 4 = 2 THEN 'fig/' || CAST({_ID4} % 50 AS STRING) END AS path,
  CASE WHEN vec_id % 4 = 2 AND {_ID4} % 3 = 2 THEN 'part' WHEN vec_id % 4 = 2 AND {_ID4} % 3 = 1 THEN 'full' END AS figure_role,
  CASE WHEN (vec_id % 4 = 2 AND {_ID4} % 3 = 2) OR vec_id % 4 = 3 THEN 'fig/' || CAST(({_ID4} + 49) % 50 AS STRING) END AS parent_path,
  CASE WHEN vec_id % 8 = 1 THEN '| A | B |' END AS render_markdown,
  CASE WHEN vec_id % 4 >= 2 THEN 'P-' || CAST(vec_id % 61 AS STRING) END AS code
FROM embeddings""",
    "v_page": "SELECT source AS manual_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page, doc_id, text AS content FROM documents",
    "v_parts": """SELECT l_orderkey AS list_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) END AS ref,
  'P-' || CAST(p_partkey AS STRING) AS part_number, p_name AS description,
  CAST(CAST(l_quantity AS INT) AS STRING) AS qty, CAST(l_orderkey % 40 AS INT) AS page
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_message": """SELECT conv_id AS session_id, conv_id * 1000 + turn AS id,
  CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text AS content FROM conversations""",
    "v_machine": "SELECT 'S' || CAST(s_suppkey AS STRING) AS machine_id, s_name AS name, 'N' || CAST(s_nationkey AS STRING) AS manual_id FROM supplier",
    "v_manual": "SELECT 'N' || CAST(n_nationkey AS STRING) AS manual_id, n_name AS filename FROM nation",
    "v_chunk": "SELECT doc_id AS id, 'N' || CAST(5 + doc_id % 30 AS STRING) AS manual_id, text AS content FROM documents",
    "v_job": """SELECT 'J' || CAST(user_id AS STRING) AS manual_id, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unknown' ELSE 'processing' END AS status FROM events""",
}
#: Views that differ between the engines: the SQL of the oracle.
ORACLE = SQL | {
    "v_line": """SELECT manual_id, page, i - 1 AS line_no, l[i] AS line FROM (
  SELECT manual_id, page, string_split(content, chr(10)) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM v_page)""",
    "v_query": "SELECT vec_id AS query_id, embedding AS vector, 'M' || CAST(label AS STRING) AS manual_id FROM embeddings WHERE vec_id % 50 = 0",
}
_NEEDS = {"v_line": ("v_page",)}
#: Rows of documents and of lineitem that a block of pages and a partition of lists hold, about.
PAGES, LINES = 20_000, 200_000


def _pages(docs: DataFrame) -> DataFrame:
    """v_page of any number of documents: a source is numbered in blocks of ids, so none of its tasks holds all its texts."""
    n, lo, hi = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    width = (hi - lo) // (n // PAGES + 1) + 1 if lo is not None else 1
    block = F.coalesce(F.floor((F.col("doc_id") - (lo or 0)) / width), F.lit(-1))  # null ids come first
    docs = docs.select("source", "doc_id", "text", F.struct("source", block.alias("block")).alias("k"))
    counts = docs.groupBy("k").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("k.source").orderBy("k.block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("k", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("doc_id"))
    return docs.join(before, "k").select(F.col("source").alias("manual_id"), (F.col("before") + place).cast("int").alias("page"), "doc_id", F.col("text").alias("content"))


def _parts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """v_parts of any number of lines: the partitions are as many as the lines need, however small their shuffled bytes are."""
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "p_partkey", "p_name")
    rows = rows.repartition(lineitem.count() // LINES + 1, "l_orderkey")
    return rows.sparkSession.sql(SQL["v_parts"].replace("lineitem JOIN part ON l_partkey = p_partkey", "{rows}"), rows=rows)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of sf_dir; no temporary view is left behind."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "v_line":
        return view(spark, sf_dir, "v_page").selectExpr("manual_id", "page", "posexplode(split(content, '\\n')) AS (line_no, line)")
    if name == "v_query":
        return read("embeddings").where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS vector", "'M' || CAST(label AS STRING) AS manual_id")
    if name == "v_page" and (docs := read("documents")).count() > PAGES:
        return _pages(docs)
    if name == "v_parts" and (lines := read("lineitem")).count() > 10 * LINES:
        return _parts(lines, read("part"))
    text = SQL[name]
    used = {t: read(t) for t in ("embeddings", "documents", "lineitem", "part", "conversations", "supplier", "nation", "events") if f" {t}" in text.replace("\n", " ")}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **used)


def with_views(names: str, body: str) -> str:
    """SQL of the oracle: the named views, and those they need, before the body."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({ORACLE[n]})" for n in order) + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().removeprefix("+")
