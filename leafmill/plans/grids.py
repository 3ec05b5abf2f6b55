"""Queries of table grids and legends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import scalars as X
from leafmill.operators import tables as G
from leafmill.plans.registry import query
from leafmill.plans.views import view, with_views

# a parts list as cells: the header, then one row a part; some cells are blanked
_CELLS = """+h AS (SELECT DISTINCT list_id, 0 AS row_no, unnest([0, 1, 2, 3]) AS col_no, unnest(['Ref', 'Part No', CASE WHEN list_id % 5 = 0 THEN '' ELSE 'Name' END, CASE WHEN list_id % 3 = 0 THEN 'ref' ELSE 'Qty' END]) AS cell FROM v_parts),
b AS (SELECT list_id, seq AS row_no, unnest([0, 1, 2, 3]) AS col_no, unnest([ref, CASE WHEN list_id % 4 = 0 THEN '' ELSE part_number END, CASE WHEN list_id % 4 <> 3 THEN description ELSE ' ' END, CASE WHEN list_id % 4 <> 1 THEN qty ELSE '' END]) AS cell FROM v_parts),
cells AS (SELECT * FROM h UNION ALL SELECT * FROM b)
"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "v_parts")
    m = F.col("list_id") % 4
    head = F.array(F.lit("Ref"), F.lit("Part No"), F.when(F.col("list_id") % 5 == 0, "").otherwise("Name"), F.when(F.col("list_id") % 3 == 0, "ref").otherwise("Qty"))
    body = F.array("ref", F.when(m == 0, "").otherwise(F.col("part_number")), F.when(m != 3, F.col("description")).otherwise(" "), F.when(m != 1, F.col("qty")).otherwise(""))
    rows = parts.select("list_id", F.lit(0).alias("row_no"), head.alias("c")).distinct().unionByName(parts.select("list_id", F.col("seq").alias("row_no"), body.alias("c")))
    return rows.select(F.col("list_id").alias("table_id"), "row_no", F.posexplode("c").alias("col_no", "cell"))


@query(with_views("v_parts", _CELLS + """, r AS (SELECT list_id, row_no, count(*) AS cols, count(*) FILTER (WHERE trim(cell) <> '') AS filled, count(DISTINCT CASE WHEN trim(cell) <> '' THEN trim(cell) END) AS vals, count(DISTINCT CASE WHEN trim(cell) <> '' THEN lower(trim(cell)) END) AS names FROM cells GROUP BY 1, 2),
t AS (SELECT list_id, count(*) AS n_rows, max(cols) AS n_cols, sum(filled)::DOUBLE AS filled, max(filled) FILTER (WHERE row_no = 0) AS hf, max(names) FILTER (WHERE row_no = 0) AS hn, count(*) FILTER (WHERE row_no > 0) AS nb, count(*) FILTER (WHERE row_no > 0 AND vals <= 1) AS same FROM r GROUP BY 1),
v AS (SELECT list_id AS table_id, CASE WHEN n_rows < 2 OR n_cols < 2 THEN 'too small' WHEN filled / (n_rows * n_cols) < 0.35::DOUBLE THEN 'too sparse' WHEN hf::DOUBLE / n_cols < 0.7::DOUBLE THEN 'header mostly empty'
  WHEN hn < greatest(2, floor(n_cols * 0.6::DOUBLE)) THEN 'header not distinct' WHEN n_rows = 2 AND filled / (n_rows * n_cols) < 0.8::DOUBLE THEN 'single sparse row' WHEN same::DOUBLE / nb > 0.6::DOUBLE THEN 'repeated values' ELSE 'ok' END AS reason FROM t)
SELECT table_id, reason = 'ok' AS valid, reason FROM v"""))
def table_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.validity(_cells(spark, sf_dir))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = view(spark, sf_dir, "v_parts").groupBy("list_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "ref", "part_number", "description", "qty"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["ref"], x["part_number"], x["description"], x["qty"]))
    return per.select("list_id", "page", F.array(*map(F.lit, ("Ref", "Part | No", "Col 3", "Qty"))).alias("header"), rows.alias("rows"))


_RAW = "SELECT list_id, page, list([ref, part_number, description, qty] ORDER BY seq) AS rows FROM v_parts GROUP BY 1, 2"


@query(with_views("v_parts", f"""+g AS ({_RAW})
SELECT list_id, '| Ref | Part | No | Col 3 | Qty |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(list_transform(r, lambda c: trim(replace(c, '|', '\\|'))), ' | ') || ' |'), chr(10)) AS markdown FROM g"""))
def md_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("list_id", G.markdown(F.col("header"), F.col("rows")).alias("markdown"))


@query(with_views("v_parts", f"""+g AS ({_RAW})
SELECT list_id, 'Parts of ' || CAST(list_id AS VARCHAR) || chr(10) || array_to_string(list_transform(rows, lambda r:
  array_to_string(list_filter([CASE WHEN r[1] <> '' THEN 'Ref: ' || r[1] END, 'Part | No: ' || r[2], 'Qty: ' || r[4]], lambda x: x IS NOT NULL), ' | ')), chr(10)) AS content FROM g"""))
def header_value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    caption = F.concat(F.lit("Parts of "), F.col("list_id").cast("string"))
    return _lists(spark, sf_dir).select("list_id", G.header_value_text(F.col("header"), F.col("rows"), caption).alias("content"))


@query(with_views("v_parts", """+r AS (SELECT list_id, CAST(seq AS INT) AS seq, 'Ref: ' || ref || ' | ' || part_number || ' | ' || description || ' | Qty: ' || qty AS row, max(seq) OVER (PARTITION BY list_id) AS n FROM v_parts),
g AS (WITH RECURSIVE f AS (SELECT list_id, seq, row, 0 AS g, length(row) + 1 AS size FROM r WHERE seq = 1
  UNION ALL SELECT r.list_id, r.seq, r.row, CASE WHEN f.size + length(r.row) > 150 THEN f.g + 1 ELSE f.g END, CASE WHEN f.size + length(r.row) > 150 THEN length(r.row) + 1 ELSE f.size + length(r.row) + 1 END FROM f JOIN r ON r.list_id = f.list_id AND r.seq = f.seq + 1) SELECT * FROM f),
p AS (SELECT list_id, g, string_agg(row, chr(10) ORDER BY seq) AS body, string_agg('| ' || seq || ' |', chr(10) ORDER BY seq) AS grid FROM g GROUP BY 1, 2),
w AS (SELECT list_id, string_agg('| ' || seq || ' |', chr(10) ORDER BY seq) AS grid FROM r GROUP BY 1),
q AS (SELECT *, count(*) OVER (PARTITION BY list_id) AS n FROM p)
SELECT q.list_id AS table_id, CAST(g + 1 AS INT) AS part, CAST(n AS INT) AS n_parts, 'List ' || CAST(q.list_id AS VARCHAR) || chr(10) || CASE WHEN n > 1 THEN '(part ' || CAST(g + 1 AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ')' || chr(10) ELSE '' END || body AS content,
  CASE WHEN q.list_id % 3 <> 0 THEN '| No |' || chr(10) || '| --- |' || chr(10) || q.grid WHEN g = 0 THEN '| No |' || chr(10) || '| --- |' || chr(10) || '| x |' || chr(10) || w.grid END AS render_markdown FROM q JOIN w ON q.list_id = w.list_id"""))
def table_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists cut at their rows with their grids; every third grid has a row too many and stays whole."""
    line = F.concat(F.lit("Ref: "), "ref", F.lit(" | "), "part_number", F.lit(" | "), "description", F.lit(" | Qty: "), "qty")
    per = view(spark, sf_dir, "v_parts").groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("row")))).alias("r"))
    grid = F.transform("r", lambda x: F.concat(F.lit("| "), x["seq"].cast("string"), F.lit(" |")))
    grid = F.when(F.col("list_id") % 3 == 0, F.concat(F.array(F.lit("| x |")), grid)).otherwise(grid)
    markdown = F.array_join(F.concat(F.array(F.lit("| No |"), F.lit("| --- |")), grid), "\n")
    tables = per.select(F.col("list_id").alias("table_id"), F.concat(F.lit("List "), F.col("list_id").cast("string")).alias("head"), F.transform("r", lambda x: x["row"]).alias("rows"), markdown.alias("markdown"))
    return G.split_table(tables, limit=150)


@query(with_views("v_parts", """+c AS (SELECT list_id, 'Rows of ' || CAST(list_id AS VARCHAR) || chr(10) || string_agg(part_number || ' ' || description, chr(10) ORDER BY seq) AS content FROM v_parts GROUP BY 1),
w AS (SELECT list_id AS table_id, 1 AS part, content FROM c WHERE length(content) <= 120),
r AS (SELECT v.list_id, CAST(seq AS INT) AS seq, part_number || ' ' || description AS row FROM v_parts v JOIN c ON c.list_id = v.list_id WHERE length(content) > 120),
g AS (WITH RECURSIVE f AS (SELECT list_id, seq, row, 0 AS g, length(row) + 1 AS size FROM r WHERE seq = 1
  UNION ALL SELECT r.list_id, r.seq, r.row, CASE WHEN f.size + length(r.row) > 120 THEN f.g + 1 ELSE f.g END, CASE WHEN f.size + length(r.row) > 120 THEN length(r.row) + 1 ELSE f.size + length(r.row) + 1 END FROM f JOIN r ON r.list_id = f.list_id AND r.seq = f.seq + 1) SELECT * FROM f),
p AS (SELECT list_id, g, string_agg(row, chr(10) ORDER BY seq) AS body, count(*) OVER (PARTITION BY list_id) AS n FROM g GROUP BY 1, 2)
SELECT table_id, part, 1 AS n_parts, content FROM w UNION ALL
SELECT list_id, CAST(g + 1 AS INT), CAST(n AS INT), 'Rows of ' || CAST(list_id AS VARCHAR) || chr(10) || CASE WHEN n > 1 THEN '(part ' || CAST(g + 1 AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ')' || chr(10) ELSE '' END || body FROM p"""))
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tables stay whole, long ones are cut."""
    row = F.concat("part_number", F.lit(" "), "description")
    per = view(spark, sf_dir, "v_parts").groupBy("list_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))), lambda x: x["row"]), "\n").alias("body"))
    content = F.concat(F.lit("Rows of "), F.col("list_id").cast("string"), F.lit("\n"), "body")
    tables = per.select(F.col("list_id").alias("table_id"), content.alias("content"), F.lit(None).cast("string").alias("markdown"), F.lit(True).alias("caption_line"))
    return G.table_chunks(tables, limit=120).drop("render_markdown")


@query("""WITH f AS (SELECT l_orderkey AS page, CASE l_linenumber % 2 WHEN 0 THEN 'lattice' ELSE 'stream' END AS flavor, l_partkey AS table_id, bool_or(l_suppkey % 3 <> 0) AS valid FROM lineitem GROUP BY ALL),
v AS (SELECT *, min(CASE flavor WHEN 'lattice' THEN 0 ELSE 1 END) OVER (PARTITION BY page) AS best FROM f WHERE valid)
SELECT page, flavor, table_id FROM v WHERE best = CASE flavor WHEN 'lattice' THEN 0 ELSE 1 END""")
def flavor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page the valid tables of the first reader that found one."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flavor = F.when(F.col("l_linenumber") % 2 == 0, "lattice").otherwise("stream")
    found = l.groupBy(F.col("l_orderkey").alias("page"), flavor.alias("flavor"), F.col("l_partkey").alias("table_id")).agg(F.bool_or(F.col("l_suppkey") % 3 != 0).alias("valid"))
    return G.chosen_tables(found)


_GRID = """+f AS (SELECT list_id - list_id % 2 AS figure_id, CAST(list_id // 10 AS INT) AS page, CAST(list_id // 2 % 4 AS VARCHAR) AS manual_id, list(DISTINCT part_number) AS codes FROM v_parts WHERE list_id % 2 = 0 GROUP BY 1, 2, 3),
t AS (SELECT list_id + 1 - list_id % 2 AS table_id, CAST((list_id + 1 - list_id % 2) // 10 AS INT) AS page, list_id // 2 % 5 = 1 AS titled, CAST(list_id // 2 % 4 AS VARCHAR) AS manual_id, list(DISTINCT part_number) AS cells FROM v_parts GROUP BY 1, 2, 3, 4),
fc AS (SELECT figure_id, manual_id, page AS fp, unnest(codes) AS code FROM f), tc AS (SELECT table_id, manual_id, page AS tp, unnest(cells) AS code FROM t)
"""


def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lists in pairs: the even one is a figure with its part numbers as codes, both together are
    a table with their part numbers as cells; ten lists are a page, and four manuals share the pages."""
    parts = view(spark, sf_dir, "v_parts")
    odd = F.col("list_id") + 1 - F.col("list_id") % 2
    title = F.when(F.floor(F.col("table_id") / 2) % 5 == 1, "Key to Fig. 1").otherwise("Values")
    page = lambda c: F.floor(c / 10).cast("int").alias("page")
    manual = lambda c: (F.floor(c / 2) % 4).cast("string").alias("manual_id")
    figures = parts.where("list_id % 2 = 0").groupBy(F.col("list_id").alias("figure_id")).agg(F.collect_set("part_number").alias("codes")).select("figure_id", manual(F.col("figure_id")), page(F.col("figure_id")), "codes")
    grids = parts.groupBy(odd.alias("table_id")).agg(F.collect_set("part_number").alias("cells")).select("table_id", manual(F.col("table_id")), page(F.col("table_id")), title.alias("content"), "cells")
    return figures, grids


@query(with_views("v_parts", _GRID + """, hits AS (SELECT figure_id, table_id, count(*) AS points FROM fc JOIN tc USING (manual_id, code) WHERE abs(fp - tp) <= 2 AND tp > 0 GROUP BY 1, 2),
tit AS (SELECT figure_id, table_id, 2 AS points FROM f JOIN t ON titled AND f.manual_id = t.manual_id AND abs(f.page - t.page) <= 2 AND t.page > 0),
s AS (SELECT figure_id, table_id, sum(points) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM tit) GROUP BY 1, 2 HAVING sum(points) >= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY score DESC, table_id) AS n FROM s)
SELECT figure_id, table_id, CAST(score AS BIGINT) AS score FROM n WHERE n = 1"""))
def legend_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.legend_pairs(*_grids(spark, sf_dir))


@query(with_views("v_parts", _GRID + """, hits AS (SELECT figure_id, table_id, count(*) AS hits FROM fc JOIN tc USING (manual_id, code) GROUP BY 1, 2),
n AS (SELECT h.*, row_number() OVER (PARTITION BY h.figure_id ORDER BY hits DESC, table_id) AS n FROM hits h JOIN f USING (figure_id) WHERE len(codes) >= 4 AND hits >= greatest(4, floor(len(codes) * 0.6::DOUBLE)))
SELECT figure_id, table_id, hits FROM n WHERE n = 1"""))
def legend_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.legend_sweep(*_grids(spark, sf_dir))


_GRIDS = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '| Col 1 | Column 2 | n/a |' ELSE '| Ref | Name | - |' END || chr(10) || '| --- | --- | --- |' || chr(10) || '| '
  || CASE WHEN p_partkey % 5 = 0 THEN 'N/A' ELSE CAST(p_partkey AS VARCHAR) END || ' | ' || CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END || ' | - |' AS markdown FROM {part}"""


@query("WITH m AS (" + _GRIDS.replace("{part}", "part") + """), l AS (SELECT p_partkey, list_filter(string_split(markdown, chr(10)), lambda x: trim(x) <> '') AS lines FROM m),
c AS (SELECT p_partkey, list_transform(lines, lambda x: len(list_filter(string_split(regexp_replace(trim(x), '^\\||\\|$', '', 'g'), '|'), lambda y: trim(y) <> '' AND NOT regexp_matches(trim(y), '(?i)^(col(umn)?\\s*\\d+|-|n/?a)$')))) AS n FROM l)
SELECT p_partkey, len(n) >= 3 AND n[1] >= 2 AND len(list_filter(n[3:], lambda x: x >= 2)) > 0 AS usable FROM c""")
def markdown_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with placeholder headers, blank cells and rows that say nothing."""
    part = spark.sql(_GRIDS.replace("VARCHAR", "STRING").replace("chr(10)", "'\\n'"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return part.select("p_partkey", G.usable_markdown(F.col("markdown")).alias("usable"))
