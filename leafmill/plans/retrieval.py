"""Queries of the retrieval engine.  Query vectors: every row whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import scalars as X
from leafmill.operators import search as S
from leafmill.plans.registry import query
from leafmill.plans.views import view, with_views
from leafmill.sources import vector_index
from leafmill.sources.scratch import fresh

#: Gates for the near-random vectors of the test tables.
GATE, OTHER_GATE, MEMORY_GATE = 0.15, 0.2, 0.2

# hits of all queries against their own manual, best first
_COS = "round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 12)"
_HITS = f"""+hits AS (SELECT query_id, q.manual_id AS q_manual, i.*, {_COS} AS score
  FROM v_query q JOIN v_index i ON q.manual_id = i.manual_id),
"""
_FIGS = f"""+f0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r0 FROM hits WHERE type = 'image'),
f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, id) AS r1 FROM f0 WHERE r0 <= 12 AND score >= {GATE}),
figs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f1 WHERE r1 = 1) WHERE rank <= 3)
"""


def _sql(body: str, figures: bool = False) -> str:
    return with_views("v_index v_query", _HITS + (_FIGS.lstrip().removeprefix("+") if figures else "") + body) if figures else with_views("v_index v_query", _HITS + body)


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_query")


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


@query(_sql("""t AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits WHERE type IN ('text', 'table', 'part'))
SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM t WHERE rank <= 3"""))
def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _both(spark, sf_dir)
    return _out(S.text_hits(index, queries), "query_id", "id", "rank")


@query(_sql("""t AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits WHERE type IN ('text', 'table', 'part'))
SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM t WHERE rank <= 5"""))
def vec_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of cells, searched exactly: five nearest texts, from the partitions of the query's manual only."""
    index, queries = _both(spark, sf_dir)
    built = vector_index.build(index, fresh(spark, "vector-index"), cells=16, buckets=4)
    return _out(built.search(queries, 5, ("text", "table", "part")), "query_id", "id", "rank")


@query(with_views("v_index v_query", f"""+o AS (SELECT query_id, i.id, i.manual_id, i.page, {_COS} AS score FROM v_query q JOIN v_index i ON q.manual_id <> i.manual_id),
o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM o),
o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, manual_id, page ORDER BY score DESC, id) AS r2 FROM o1 WHERE r <= 9 AND score >= {OTHER_GATE}),
o3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o2 WHERE r2 = 1)
SELECT query_id, id, manual_id, page, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM o3 WHERE rank <= 3"""))
def vec_topk_exclude_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _both(spark, sf_dir)
    return _out(S.other_manual_hits(index, queries, gate=OTHER_GATE), "query_id", "id", "manual_id", "page", "rank")


def _figures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index, queries = _both(spark, sf_dir)
    return index, S.figure_hits(index, queries, gate=GATE)


@query(_sql("SELECT query_id, id, path, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM figs", True))
def vec_gate_dedupe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_figures(spark, sf_dir)[1], "query_id", "id", "path", "rank")


_PARENTS = """, want AS (SELECT query_id, manual_id, parent_path AS path, max(score) AS score FROM figs WHERE figure_role = 'part' AND parent_path IS NOT NULL GROUP BY ALL),
pulled AS (SELECT w.query_id, i.id, i.manual_id, w.path, i.figure_role, i.parent_path, w.score FROM want w JOIN v_index i ON i.manual_id = w.manual_id AND i.path = w.path AND i.type = 'image'
  WHERE NOT EXISTS (SELECT 1 FROM figs f WHERE f.query_id = w.query_id AND f.path = w.path))
"""


@query(_sql(_PARENTS + "SELECT query_id, id, path, round(score, 6) AS score FROM pulled", True).replace("rank <= 3", "rank <= 12").replace("score >= 0.15)", "score >= -1)"))
def parent_pull_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a gate and with all that was fetched, so that many parts are hit."""
    index, queries = _both(spark, sf_dir)
    hits = S.figure_hits(index, queries, gate=-1.0, k=12)
    return _out(S.parents(hits, index), "query_id", "id", "path")


@query(_sql(_PARENTS + """, allf AS (SELECT query_id, id, path, parent_path, figure_role, score, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, id) AS pos FROM (
  SELECT query_id, id, path, parent_path, figure_role, score, 0 AS late FROM figs UNION ALL SELECT query_id, id, path, parent_path, figure_role, score, 1 FROM pulled)),
g AS (SELECT a.*, coalesce(figure_role, 'full') = 'part' AS is_part,
  CASE WHEN coalesce(figure_role, 'full') = 'part' AND EXISTS (SELECT 1 FROM allf b WHERE b.query_id = a.query_id AND b.path = a.parent_path) THEN parent_path ELSE path END AS grp FROM allf a),
h AS (SELECT *, max(score) OVER (PARTITION BY query_id, grp) AS best, min(pos) OVER (PARTITION BY query_id, grp) AS first FROM g)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, is_part, CASE WHEN is_part THEN -score END NULLS FIRST, pos) AS INT) AS position, round(score, 6) AS score FROM h""", True))
def full_before_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, hits = _figures(spark, sf_dir)
    columns = ["query_id", "id", "path", "parent_path", "figure_role", "score"]
    both = hits.select(*columns, F.lit(0).alias("late")).unionByName(S.parents(hits, index).select(*columns, F.lit(1).alias("late")))
    placed = S.top(both, ["query_id"], None, [F.col("late"), F.desc("score"), F.col("id")], "pos")
    return _out(S.full_before_parts(placed), "query_id", "id", "position")


@query(_sql("""t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits WHERE type IN ('text', 'table', 'part')),
b AS (SELECT CAST(floor(query_id / 500) AS BIGINT) AS report_id, id, max(round(score, 6)) AS score FROM t WHERE r <= 3 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, id) AS rank FROM b)
SELECT report_id, id, CAST(rank AS INT) AS rank, score FROM c WHERE rank <= 8"""))
def multi_query_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questions a report: the best score of each chunk over its report's questions."""
    index, queries = _both(spark, sf_dir)
    hits = S.text_hits(index, queries).drop("rank").withColumns({"report_id": F.floor(F.col("query_id") / 500), "score": F.round("score", 6)})
    return _out(S.best_of_many(hits, 8), "report_id", "id", "rank")


@query(_sql("""t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits WHERE type = 'image'),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r2 FROM t WHERE r <= 5 AND path IS NOT NULL AND score >= 0.15)
SELECT query_id, id, CASE WHEN score >= 0.25 THEN 'confident' ELSE 'possible' END AS band, round(score, 6) AS score FROM b WHERE r2 = 1"""))
def figure_match_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.matched_figure(*_both(spark, sf_dir), confident=0.25, possible=GATE), "query_id", "id", "band")


@query(_sql(f"""t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits)
SELECT query_id, id, round_even(score, 3) AS similarity FROM t WHERE r <= 3 AND score >= {MEMORY_GATE}"""))
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past fixes of the same machine (the label stands for it): three nearest, then the gate."""
    index, queries = _both(spark, sf_dir)
    found = S.search(index, queries, 3).where(F.col("score") >= MEMORY_GATE)
    return found.select("query_id", "id", F.bround("score", 3).alias("similarity"))


@query(with_views("v_parts", """+q AS (SELECT p_partkey AS query_id, 'Where is P-' || CAST(p_partkey AS STRING) || ' used, and ' || p_name || '?' AS text FROM part),
c AS (SELECT query_id, unnest(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?i)\\b(?:\\d{6,8}|[0-9]{1,3}[A-Z]{1,3}-\\d{1,4}[A-Z]?|[A-Z][A-Z0-9]{0,5}(?:-[A-Z0-9]{1,6}){1,8})\\b'), lambda x: regexp_matches(x, '\\d')), lambda x: upper(x))))) AS code FROM q),
e AS (SELECT query_id, code, list_id, seq, row_number() OVER (PARTITION BY query_id ORDER BY list_id, seq) AS n FROM c JOIN v_parts ON part_number = code)
SELECT query_id, code, list_id, seq, 1.0::DOUBLE AS score FROM e WHERE n <= 10"""))
def exact_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers printed in a question, looked up exactly; at most ten rows a question."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Where is P-"), F.col("p_partkey").cast("string"), F.lit(" used, and "), "p_name", F.lit("?")).alias("text"))
    codes = asked.select("query_id", F.explode(X.part_numbers(F.col("text"))).alias("code"))
    found = codes.join(view(spark, sf_dir, "v_parts"), F.col("code") == F.col("part_number"))
    return S.top(found, ["query_id"], 10, [F.col("list_id"), F.col("seq")]).select("query_id", "code", "list_id", "seq", F.lit(1.0).alias("score"))


@query(with_views("v_index v_query", """+want AS (SELECT DISTINCT query_id, manual_id, 'fig/' || CAST(query_id % 7 AS STRING) AS path FROM v_query)
SELECT query_id, i.id, i.path FROM want w JOIN v_index i ON i.manual_id = w.manual_id AND i.path = w.path"""))
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a path in a manual; several may share one."""
    index, queries = _both(spark, sf_dir)
    want = queries.selectExpr("query_id", "manual_id", "'fig/' || CAST(query_id % 7 AS STRING) AS path").distinct()
    return want.join(index.select("id", "manual_id", "path"), ["manual_id", "path"]).select("query_id", "id", "path")


@query(_sql("""t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits WHERE type = 'table'),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t WHERE r <= 4 AND render_markdown IS NOT NULL AND score >= 0.15)
SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM u WHERE rank <= 2"""))
def table_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _both(spark, sf_dir)
    return _out(S.table_hits(index, queries, gate=GATE), "query_id", "id", "rank")


@query(_sql(_PARENTS.replace(", want", ", tx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits WHERE type IN ('text', 'table', 'part')) WHERE r <= 12), want", 1).replace("FROM figs WHERE figure_role = 'part' AND", "FROM tx WHERE type = 'part' AND") + "SELECT query_id, id, path, round(score, 6) AS score FROM pulled", True))
def part_figure_pull_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the part entries among the text hits."""
    index, queries = _both(spark, sf_dir)
    return _out(S.part_figures(S.text_hits(index, queries, 12), S.figure_hits(index, queries, gate=GATE), index), "query_id", "id", "path")


def _ordered(name: str, source: str) -> str:
    """SQL: the rows of ``source`` (with pos) as ``name``, full views before their parts."""
    return f"""{name}_g AS (SELECT a.*, coalesce(figure_role, 'full') = 'part' AS is_part,
  CASE WHEN coalesce(figure_role, 'full') = 'part' AND EXISTS (SELECT 1 FROM {source} b WHERE b.query_id = a.query_id AND b.path = a.parent_path) THEN parent_path ELSE path END AS grp FROM {source} a),
{name}_h AS (SELECT *, max(score) OVER (PARTITION BY query_id, grp) AS best, min(pos) OVER (PARTITION BY query_id, grp) AS first FROM {name}_g),
{name} AS (SELECT query_id, id, path, parent_path, figure_role, score, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, is_part, CASE WHEN is_part THEN -score END NULLS FIRST, pos) AS pos FROM {name}_h)"""


@query(_sql(_PARENTS + """, allf AS (SELECT query_id, id, path, parent_path, figure_role, score, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, id) AS pos FROM (
  SELECT query_id, id, path, parent_path, figure_role, score, 0 AS late FROM figs UNION ALL SELECT query_id, id, path, parent_path, figure_role, score, 1 FROM pulled)),
""" + _ordered("one", "allf") + """,
ex AS (SELECT * FROM (SELECT q.query_id, i.id, i.type, i.path, row_number() OVER (PARTITION BY q.query_id ORDER BY i.id) AS pos FROM v_query q JOIN v_index i ON i.manual_id = q.manual_id AND i.code = 'P-' || CAST((q.query_id // 50) % 61 AS VARCHAR)) WHERE pos <= 10),
tn AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM hits WHERE type IN ('text', 'table', 'part')),
tx AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY late, pos, id) AS pos FROM (
  SELECT query_id, id, 1.0::DOUBLE AS score, pos, 0 AS late FROM ex WHERE type <> 'image' UNION ALL SELECT query_id, id, score, pos, 1 FROM tn WHERE pos <= 3 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = tn.query_id AND ex.id = tn.id AND ex.type <> 'image'))),
pf AS (SELECT t.query_id, i.manual_id, i.parent_path AS path, max(t.score) AS score FROM tx t JOIN v_index i ON i.id = t.id WHERE i.type = 'part' AND i.parent_path IS NOT NULL GROUP BY ALL),
pp AS (SELECT w.query_id, i.id, w.path, i.parent_path, i.figure_role, w.score FROM pf w JOIN v_index i ON i.manual_id = w.manual_id AND i.path = w.path AND i.type = 'image' WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.query_id = w.query_id AND o.path = w.path)),
u2 AS (SELECT query_id, id, path, parent_path, figure_role, score, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, id) AS pos FROM (
  SELECT query_id, id, path, parent_path, figure_role, score, pos AS late FROM one UNION ALL SELECT query_id, id, path, parent_path, figure_role, score, 1000000 FROM pp)),
""" + _ordered("two", "u2") + f""",
im AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY late, pos, id) AS pos FROM (
  SELECT query_id, id, 1.0::DOUBLE AS score, pos, 0 AS late FROM ex WHERE type = 'image' UNION ALL SELECT query_id, id, score, pos, 1 FROM two WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = two.query_id AND ex.path = two.path AND ex.type = 'image'))),
tb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hits WHERE type = 'table'),
tc AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM tb WHERE r <= 4 AND render_markdown IS NOT NULL AND score >= {GATE}),
me AS (SELECT query_id, i.id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, i.id) AS pos FROM v_query q JOIN v_index i ON i.id % 3 = 0 AND i.manual_id = q.manual_id WHERE q.query_id % 100 = 0),
ot AS (SELECT query_id, i.id, i.manual_id, i.page, {_COS} AS score FROM v_query q JOIN v_index i ON q.manual_id <> i.manual_id),
o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM ot),
o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, manual_id, page ORDER BY score DESC, id) AS r2 FROM o1 WHERE r <= 9 AND score >= {OTHER_GATE}),
o3 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM o2 WHERE r2 = 1)
SELECT query_id, slot, CAST(pos AS INT) AS pos, id, round(score, 6) AS score FROM (
  SELECT query_id, 'text' AS slot, pos, id, score FROM tx UNION ALL SELECT query_id, 'image', pos, id, score FROM im UNION ALL SELECT query_id, 'table', pos, id, score FROM tc WHERE pos <= 2
  UNION ALL SELECT query_id, 'memory', pos, id, score FROM me WHERE pos <= 3 AND score >= {MEMORY_GATE} UNION ALL SELECT query_id, 'other', pos, id, score FROM o3 WHERE pos <= 3)""", True))
def composite_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five slots of a question.  Figures and part entries list one code each; every third row plays a past
    fix, and every second query has a machine, named like its manual."""
    index, queries = _both(spark, sf_dir)
    index = index.withColumn("part_numbers", F.when(F.col("code").isNotNull(), F.array("code")))
    asked = queries.withColumns({
        "text": F.concat(F.lit("Where is P-"), (F.floor(F.col("query_id") / 50) % 61).cast("string"), F.lit(" shown?")),
        "machine_id": F.when(F.col("query_id") % 100 == 0, F.col("manual_id")),
    })
    memory = index.where("id % 3 = 0").select("id", "embedding", F.col("manual_id").alias("machine_id"))
    return _out(S.retrieve(index, memory, asked, GATE, OTHER_GATE, MEMORY_GATE), "query_id", "slot", "pos", "id")
