"""Queries of page layout, captions and answer assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.scalars import DRAWING
from leafmill.operators import captions as C
from leafmill.operators import layout as L
from leafmill.operators.spatial import points_outside
from leafmill.operators import search as S
from leafmill.plans.registry import query
from leafmill.plans.retrieval import _FIGS, _HITS, GATE
from leafmill.plans.views import view, with_views


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH g AS (SELECT l_orderkey AS table_id, CAST(l_extendedprice AS DOUBLE) AS "at", CAST(l_extendedprice AS DOUBLE) - lag(CAST(l_extendedprice AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY CAST(l_extendedprice AS DOUBLE)) AS gap FROM (SELECT DISTINCT l_orderkey, l_extendedprice FROM lineitem)),
m AS (SELECT table_id, greatest(8.0::DOUBLE, coalesce(quantile_cont(gap, 0.5), 0.0) * 0.6::DOUBLE) AS lim FROM g GROUP BY 1)
SELECT g.table_id, g."at" FROM g JOIN m ON g.table_id = m.table_id WHERE gap IS NULL OR gap >= lim""")
def rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_extendedprice").alias("at")).distinct()
    return L.merged_rules(rules)


_NAMES = "CASE l_linenumber % 3 WHEN 0 THEN '〃' WHEN 1 THEN 'Part ' || CAST(l_partkey AS {}) ELSE '' END"
_ROWS = "SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS no, " + _NAMES + " AS name, CASE WHEN l_suppkey % 2 = 0 THEN 'C' ELSE '' END AS code FROM {}"


@query("WITH r AS (" + _ROWS.format("VARCHAR", "lineitem") + """), s AS (SELECT *, name = '〃' OR (name = '' AND code <> '') AS same FROM r)
SELECT table_id, no, CASE WHEN same THEN coalesce(last_value(CASE WHEN NOT same AND name <> '' THEN name END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY no ROWS UNBOUNDED PRECEDING), '') ELSE name END AS name FROM s""")
def ditto_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.carried_names(spark.sql(_ROWS.format("STRING", "{l}"), l=_table(spark, sf_dir, "lineitem"))).select("table_id", "no", "name")


@query("""WITH w AS (SELECT event_id % 200 AS page, CAST(event_id % 97 AS DOUBLE) AS x0, CAST(event_id % 89 AS DOUBLE) AS y0, CAST(event_id % 1200 AS VARCHAR) AS text, value / 100.0::DOUBLE AS conf FROM events),
f AS (SELECT s_suppkey AS figure_id, s_suppkey % 200 AS page, CAST(s_suppkey % 50 AS DOUBLE) AS x0, CAST(s_suppkey % 40 AS DOUBLE) AS y0 FROM supplier)
SELECT DISTINCT figure_id, CAST(text AS INT) AS callout FROM w JOIN f ON w.page = f.page AND w.x0 < f.x0 + 30 AND w.x0 + 5 > f.x0 AND w.y0 < f.y0 + 30 AND w.y0 + 5 > f.y0 WHERE length(text) <= 3 AND CAST(text AS INT) BETWEEN 1 AND 999 AND conf >= 0.5::DOUBLE""")
def figure_callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.expr(c).cast("double")
    words = _table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("page"), d("event_id % 97").alias("x0"), d("event_id % 89").alias("y0"), d("event_id % 97 + 5").alias("x1"), d("event_id % 89 + 5").alias("y1"), F.expr("CAST(event_id % 1200 AS STRING)").alias("text"), (F.col("value") / 100.0).alias("conf"))
    figures = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("figure_id"), (F.col("s_suppkey") % 200).alias("page"), d("s_suppkey % 50").alias("x0"), d("s_suppkey % 40").alias("y0"), d("s_suppkey % 50 + 30").alias("x1"), d("s_suppkey % 40 + 30").alias("y1"))
    return L.figure_callouts(words, figures)


_CODED = "CASE WHEN event_id % 3 = 0 THEN 'CA--' || CAST(event_id % 9000 + 1000 AS STRING) WHEN event_id % 3 = 1 THEN 'B-' || CAST(event_id % 9000 + 1000 AS STRING) ELSE 'word' END"


@query("WITH w AS (SELECT event_id, event_id % 200 AS page, CAST(event_id % 97 AS DOUBLE) AS x0, CAST(event_id % 89 AS DOUBLE) AS y0, " + _CODED.replace("STRING", "VARCHAR") + """ AS text FROM events),
f AS (SELECT s_suppkey AS figure_id, s_suppkey % 200 AS page, CAST(s_suppkey % 50 AS DOUBLE) AS x0, CAST(s_suppkey % 40 AS DOUBLE) AS y0 FROM supplier),
m AS (SELECT figure_id, text, w.x0, w.y0 FROM w JOIN f ON w.page = f.page AND w.x0 < f.x0 + 30 AND w.x0 + 5 > f.x0 AND w.y0 < f.y0 + 30 AND w.y0 + 5 > f.y0 WHERE regexp_matches(text, '{DRAWING}'))
SELECT figure_id, replace(arg_min(text, (y0, x0)), '--', '-') AS code FROM m GROUP BY 1""".replace("{DRAWING}", DRAWING))
def corner_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing code that is printed first in each figure; of words at the same place, the one read first."""
    d = lambda c: F.expr(c).cast("double")
    words = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200).alias("page"), d("event_id % 97").alias("x0"), d("event_id % 89").alias("y0"), d("event_id % 97 + 5").alias("x1"), d("event_id % 89 + 5").alias("y1"), F.expr(_CODED).alias("text"))
    figures = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("figure_id"), (F.col("s_suppkey") % 200).alias("page"), d("s_suppkey % 50").alias("x0"), d("s_suppkey % 40").alias("y0"), d("s_suppkey % 50 + 30").alias("x1"), d("s_suppkey % 40 + 30").alias("y1"))
    return L.corner_code(words, figures, "event_id")


@query("""WITH w AS (SELECT event_id, event_id % 200 AS page, CAST(event_id % 977 AS DOUBLE) AS x, CAST(event_id % 891 AS DOUBLE) AS y FROM events),
f AS (SELECT s_suppkey % 200 AS page, CAST(s_suppkey % 500 AS DOUBLE) AS x, CAST(s_suppkey % 400 AS DOUBLE) AS y FROM supplier)
SELECT event_id, page FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE w.page = f.page AND w.x BETWEEN f.x AND f.x + 300 AND w.y BETWEEN f.y AND f.y + 250)""")
def words_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circled numbers that lie in no figure of their page."""
    d = lambda c: F.expr(c).cast("double")
    points = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200).alias("page"), d("event_id % 977").alias("x"), d("event_id % 891").alias("y"))
    boxes = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 200).alias("page"), d("s_suppkey % 500").alias("x0"), d("s_suppkey % 400").alias("y0"), d("s_suppkey % 500 + 300").alias("x1"), d("s_suppkey % 400 + 250").alias("y1"))
    return points_outside(points, boxes).select("event_id", "page")


@query("""WITH p AS (SELECT user_id AS figure_id, event_id AS row, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS ink FROM events),
n AS (SELECT *, CASE WHEN row - lag(row) OVER (PARTITION BY figure_id ORDER BY row) - 1 < 300 THEN 0 ELSE 1 END AS new FROM p WHERE ink > 0),
b AS (SELECT *, sum(new) OVER (PARTITION BY figure_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS band FROM n)
SELECT figure_id, CAST(band AS BIGINT) AS band, min(row) AS first, max(row) AS last FROM b GROUP BY 1, 2""")
def gutter_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _table(spark, sf_dir, "events").select(F.col("user_id").alias("figure_id"), F.col("event_id").alias("row"), F.col("event_type").isin("click", "view").cast("int").alias("ink"))
    return L.ink_bands(profile, 300)


@query(with_views("v_index v_query", _HITS + _FIGS.lstrip().removeprefix("+") + """, t0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits WHERE type = 'table'),
t AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS n FROM t0 WHERE r <= 4 AND render_markdown IS NOT NULL)
SELECT query_id, 'IMAGE_' || CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS VARCHAR) AS tag, id FROM figs WHERE path IS NOT NULL UNION ALL SELECT query_id, 'TABLE_' || CAST(n AS VARCHAR), id FROM t"""))
def attachment_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_query")
    figures = S.figure_hits(index, queries, gate=GATE).select("query_id", F.col("rank").alias("pos"), "id", "path")
    tables = S.search(index, queries, 4, ("table",)).join(index.select("id", F.col("render_markdown").isNotNull().alias("usable")), "id").select("query_id", F.col("rank").alias("pos"), "id", "usable")
    return C.attachments(figures, tables)


@query(with_views("v_index v_query", _HITS + """t AS (SELECT query_id, id, manual_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits WHERE type IN ('text', 'table', 'part'))
SELECT query_id, string_agg('[' || CAST(r AS VARCHAR) || '] Chunk ' || CAST(t.id AS VARCHAR) || chr(10) || CASE WHEN r = 3 THEN left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 500) ELSE text END, chr(10) || chr(10) ORDER BY r) AS context FROM t JOIN documents d ON d.doc_id = t.id WHERE r <= 3 GROUP BY 1"""))
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each query from its text hits; the document of the same id is a chunk's text."""
    hits = S.text_hits(view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_query"))
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = hits.withColumn("doc_id", F.col("id")).join(texts, "doc_id")
    return C.context_blocks(rows.select("query_id", "rank", F.concat(F.lit("Chunk "), F.col("id").cast("string")).alias("title"), F.col("text").alias("content"), (F.col("rank") == 3).alias("other")))


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'learning_walkthrough' ELSE 'conversational_wizard' END
  WHEN event_id % 3 = 0 THEN CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'learning_walkthrough' ELSE 'learning' END
  WHEN event_id % 5 = 0 THEN 'conversational_wizard' ELSE 'diagnosis' END AS mode FROM events""")
def mode_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    wizard = (F.col("event_type") == "click") & (F.col("user_id") % 2 == 0)
    intent = F.when(F.col("event_id") % 3 == 0, "learn").when(F.col("event_id") % 3 == 1, "troubleshoot")
    return e.select("event_id", C.retrieval_mode(F.when(wizard, "wizard").otherwise("answer"), intent, F.col("event_id") % 5 == 0).alias("mode"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Key to Fig. 1' WHEN 1 THEN 'Table 7' WHEN 2 THEN '' ELSE 'Legend' END AS caption, p_partkey % 8 < 4 AS legend,
  CASE WHEN p_partkey % 3 = 0 THEN [p_brand, p_type, '12', lower(p_brand)] ELSE [p_brand, ' '] END AS header FROM part),
h AS (SELECT *, list_filter(list_transform(header, lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')) AS cells FROM p),
d AS (SELECT *, list_filter(cells, lambda x, i: list_position(list_transform(cells, lambda y: lower(y)), lower(x)) = i) AS names FROM h)
SELECT p_partkey, CASE WHEN caption <> '' AND NOT (regexp_matches(caption, '(?i)^(key to fig|legend|parts?\\s*list)') AND NOT legend) THEN caption
  WHEN len(names) >= 2 THEN left(array_to_string(names[1:4], ' / '), 80) ELSE 'Section' END AS title FROM d""")
def table_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    caption = F.when(m == 0, "Key to Fig. 1").when(m == 1, "Table 7").when(m == 2, "").otherwise("Legend")
    header = F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand", "p_type", F.lit("12"), F.lower("p_brand"))).otherwise(F.array("p_brand", F.lit(" ")))
    return _table(spark, sf_dir, "part").select("p_partkey", C.table_title(caption, F.col("p_partkey") % 8 < 4, header, F.lit("Section")).alias("title"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey % 500 AS query_id, CAST(l_linenumber AS BIGINT) AS figure_id, CAST(l_partkey % 9 AS BIGINT) AS table_id, count(*) AS score FROM lineitem GROUP BY ALL),
f AS (SELECT query_id, figure_id, list(table_id ORDER BY score DESC, table_id) AS t, row_number() OVER (PARTITION BY query_id ORDER BY figure_id) AS n FROM p GROUP BY 1, 2),
s AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS figure_id, CAST(NULL AS BIGINT) AS pick FROM f GROUP BY 1
  UNION ALL SELECT s.query_id, f.n, CASE WHEN len(list_filter(f.t, lambda x: NOT list_contains(s.taken, x))) > 0 THEN list_append(s.taken, list_filter(f.t, lambda x: NOT list_contains(s.taken, x))[1]) ELSE s.taken END,
    f.figure_id, list_filter(f.t, lambda x: NOT list_contains(s.taken, x))[1] FROM s JOIN f ON f.query_id = s.query_id AND f.n = s.n + 1)
SELECT query_id, figure_id, pick AS table_id FROM s WHERE pick IS NOT NULL""")
def legend_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a group in order, each with its best table that no earlier figure took."""
    l = _table(spark, sf_dir, "lineitem")
    pairs = l.groupBy((F.col("l_orderkey") % 500).alias("query_id"), F.col("l_linenumber").cast("bigint").alias("figure_id"), (F.col("l_partkey") % 9).alias("table_id")).agg(F.count("*").alias("score"))
    return C.attached_legends(pairs.withColumn("figure_pos", F.col("figure_id")))


_PROFILE = """SELECT * FROM (SELECT DISTINCT event_id % 50 AS figure_id, CAST(floor(event_id / 50.0) % 2 AS INT) AS axis, CAST(floor(event_id / 50.0) * 5 % 1000 AS INT) AS row, 1 AS ink, 1000 AS size FROM {0}) AS p
  WHERE (row + figure_id * 13) % (150 + figure_id * 9) < 60 + figure_id * 6 AND (axis = 1 OR figure_id % 3 > 0)"""


@query("WITH p AS (" + _PROFILE.format("events") + """),
n AS (SELECT *, CASE WHEN row - lag(row) OVER w - 1 < 30 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY figure_id, axis ORDER BY row)),
b AS (SELECT figure_id, axis, band, min(row) AS first, max(row) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY figure_id, axis ORDER BY row ROWS UNBOUNDED PRECEDING) AS band FROM n) GROUP BY 1, 2, 3),
g AS (SELECT *, sum(CASE WHEN last - first + 1 < 120 AND before THEN 0 ELSE 1 END) OVER (PARTITION BY figure_id, axis ORDER BY first ROWS UNBOUNDED PRECEDING) AS view FROM (SELECT *, lag(first) OVER (PARTITION BY figure_id, axis ORDER BY first) IS NOT NULL AS before FROM b)),
v AS (SELECT figure_id, axis, view, min(first) AS first, max(last) AS last FROM g GROUP BY 1, 2, 3),
m AS (SELECT figure_id, axis, CASE WHEN view = 1 AND last - first + 1 < 120 THEN 2 ELSE view END AS view, min(first) AS first, max(last) AS last FROM v GROUP BY 1, 2, 3),
c AS (SELECT *, count(*) OVER (PARTITION BY figure_id, axis) AS n FROM m),
a AS (SELECT *, min(axis) OVER (PARTITION BY figure_id) AS best FROM c WHERE n >= 2)
SELECT figure_id, axis, CAST(row_number() OVER (PARTITION BY figure_id, axis ORDER BY first) AS INT) AS view, first, last FROM a WHERE axis = best AND n <= 6""")
def figure_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink profiles of two axes, parted into views."""
    rows = spark.sql(_PROFILE.format("{e}"), e=_table(spark, sf_dir, "events"))
    return L.figure_views(rows)
