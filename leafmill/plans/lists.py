"""Queries of parts lists and numbered readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.operators import parts as P
from leafmill.operators import readers as D
from leafmill.operators.matching import figure_matches
from leafmill.plans.registry import query
from leafmill.plans.views import view, with_views
from leafmill.sources.scratch import held

_GROUPED = "+g AS (SELECT *, CAST(sum(CASE WHEN ref <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY list_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS INT) AS grp FROM v_parts)\n"


@query(with_views("v_parts", _GROUPED + "SELECT list_id, grp, max(ref) AS ref, string_agg(part_number, ';' ORDER BY seq) AS part_numbers, CAST(count(*) AS INT) AS n_rows FROM g GROUP BY 1, 2"))
def parts_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.group_lines(view(spark, sf_dir, "v_parts"))


@query("""WITH c AS (SELECT o_orderkey % 100 AS list_id, o_orderpriority AS value, count(*) AS votes, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY votes DESC, first) AS n FROM c)
SELECT list_id, value, votes FROM r WHERE n = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return P.majority(o.select((F.col("o_orderkey") % 100).alias("list_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value")), ["list_id"])


_CODES = "SELECT p_size AS list_id, p_partkey AS seq, CAST(p_partkey AS STRING) AS ref, CASE WHEN p_partkey % 7 = 0 THEN replace(p_brand, '1', 'I') WHEN p_partkey % 7 = 1 THEN replace(p_brand, '2', 'Z') ELSE p_brand END AS part_number FROM {part}"


@query("WITH p AS (" + _CODES.replace("{part}", "part").replace("STRING", "VARCHAR") + """),
c AS (SELECT *, translate(regexp_replace(upper(part_number), '[^A-Z0-9]', '', 'g'), 'ZODQILSBG', '200011586') AS key, upper(part_number) AS spelling FROM p),
s AS (SELECT list_id, key, spelling, count(*) AS n, list(ref ORDER BY seq)[1:4] AS at FROM c GROUP BY 1, 2, 3),
w AS (SELECT *, count(*) OVER v AS k, max(n) OVER v AS top FROM s WINDOW v AS (PARTITION BY list_id, key)),
x AS (SELECT *, sum(CASE WHEN n = top THEN 1 ELSE 0 END) OVER (PARTITION BY list_id, key) AS leaders FROM w),
f AS (SELECT * FROM x WHERE k > 1 AND NOT (n = top AND leaders = 1)),
o AS (SELECT f.list_id, f.spelling, list(s.spelling ORDER BY s.n DESC, s.spelling) AS others, flatten(list(s.at ORDER BY s.n DESC, s.spelling))[1:4] AS items FROM f JOIN s ON s.list_id = f.list_id AND s.key = f.key AND s.spelling <> f.spelling GROUP BY 1, 2)
SELECT f.list_id, f.spelling, n, array_to_string(others, ' / ') AS others, array_to_string(items, ', ') AS items FROM f JOIN o ON o.list_id = f.list_id AND o.spelling = f.spelling""")
def lookalike_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.lookalikes(spark.sql(_CODES, part=spark.read.parquet(f"{sf_dir}/part.parquet")))
    return found.select("list_id", "spelling", "n", F.array_join("others", " / ").alias("others"), F.array_join("items", ", ").alias("items"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS table_id, l_linenumber + CASE WHEN l_suppkey % 9 = 0 THEN 20 ELSE 0 END AS no FROM lineitem),
s AS (SELECT a.table_id, a.no AS lo, count(*) AS hits, max(b.no) AS hi FROM d a JOIN d b ON a.table_id = b.table_id AND b.no >= a.no AND b.no < a.no + 4 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY hits DESC, lo) AS n FROM s),
k AS (SELECT table_id, count(*) AS k FROM d GROUP BY 1)
SELECT t.table_id, lo, hi, CAST(hits AS INT) AS hits, CAST(k - hits AS INT) AS n_stray, CAST(hi - lo + 1 - hits AS INT) AS n_gaps, hi - lo + 1 = hits AND abs(hi - lo + 1 - 4) <= 1 AS structure_ok FROM t JOIN k ON t.table_id = k.table_id WHERE n = 1""")
def best_item_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    no = F.col("l_linenumber") + F.when(F.col("l_suppkey") % 9 == 0, 20).otherwise(0)
    found = P.best_window(l.select(F.col("l_orderkey").alias("table_id"), no.alias("no"), F.lit(4).alias("n_rows")))
    return found.withColumn("n_gaps", F.size("gaps")).drop("gaps", "n_rows")


_READ = """SELECT l_orderkey % 997 AS table_id, CAST(l_linenumber AS INT) AS no, l_partkey * 10 + l_linenumber AS pos,
  CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1O-' || CAST(l_orderkey % 997 AS STRING) ELSE '10-' || CAST(l_orderkey % 997 AS STRING) END AS model,
  CASE l_suppkey % 3 WHEN 0 THEN '' ELSE 'Bolt' END AS name, CASE l_suppkey % 5 WHEN 0 THEN 'many' WHEN 1 THEN '3' ELSE '2' END AS qty, '' AS remarks FROM {lineitem}"""


@query("WITH r AS (" + _READ.replace("STRING", "VARCHAR").replace("{lineitem}", "lineitem") + """),
p AS (SELECT table_id, no, bool_or(regexp_matches(model, '[A-Za-z0-9]{2,}')) AS coded FROM r GROUP BY 1, 2),
k AS (SELECT table_id, min(no) AS lo, max(no) AS hi, count(*) AS n, count(*) FILTER (WHERE coded) AS c FROM p GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE coded) >= count(*) * 0.5),
e AS (SELECT table_id, unnest(range(lo, hi + 1)) AS no, hi - lo + 1 = n AND n >= 6 AS ok FROM k),
l AS (SELECT table_id, no, pos, 'm' AS field, translate(regexp_replace(upper(model), '[^A-Z0-9]', '', 'g'), 'OIQ', '010') AS fold, model AS value FROM r
  UNION ALL SELECT table_id, no, pos, 'n', name, name FROM r UNION ALL SELECT table_id, no, pos, 'q', qty, qty FROM r WHERE qty <> 'many'),
g AS (SELECT table_id, no, field, fold, count(*) AS votes, arg_min(value, (pos, value)) AS value, min(pos) AS first FROM l WHERE value <> '' GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, no, field ORDER BY votes DESC, first) AS i FROM g) WHERE i = 1),
c AS (SELECT table_id, no, count(*) AS n_read FROM r GROUP BY 1, 2)
SELECT e.table_id, CAST(e.no AS INT) AS no, coalesce(m.value, '') AS part_number, coalesce(n.value, '') AS description, coalesce(q.value, '') AS qty,
  CASE WHEN coalesce(m.votes, 0) >= 2 AND ok AND coalesce(q.votes, 0) >= 2 THEN 'confirmed' WHEN coalesce(m.votes, 0) >= 2 AND ok THEN 'part confirmed' ELSE 'unconfirmed' END AS status,
  CAST(CASE WHEN coalesce(n_read, 0) < 2 THEN 1 ELSE 0 END + CASE WHEN n_read > 0 AND coalesce(m.votes, 0) < 2 THEN 1 ELSE 0 END + CASE WHEN n_read > 0 AND coalesce(q.votes, 0) < 2 THEN 1 ELSE 0 END + CASE WHEN ok THEN 0 ELSE 1 END AS INT) AS n_notes
FROM e LEFT JOIN c ON c.table_id = e.table_id AND c.no = e.no LEFT JOIN b m ON m.table_id = e.table_id AND m.no = e.no AND m.field = 'm' LEFT JOIN b n ON n.table_id = e.table_id AND n.no = e.no AND n.field = 'n' LEFT JOIN b q ON q.table_id = e.table_id AND q.no = e.no AND q.field = 'q'""")
def row_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read in bands: which are parts lists, and how far each of their rows is confirmed."""
    read = spark.sql(_READ, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    read = read.join(P.parts_table(read), "table_id", "left_semi")
    windows = P.best_window(read.select("table_id", "no", F.lit(7).alias("n_rows")))
    found = P.confirmed_rows(read, windows)
    return found.select("table_id", "no", "part_number", "description", "qty", "status", F.size("notes").alias("n_notes"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderkey % 60 + 1 AS INT) AS n FROM orders),
s AS (SELECT * FROM (SELECT o_orderkey, n, unnest(range(1, n + 1, 5)) AS start FROM d) WHERE start = 1 OR start + 5 < n),
b AS (SELECT o_orderkey, start, least(start + 10, n) AS stop FROM s UNION SELECT o_orderkey, 1, least(6, n) FROM d UNION SELECT o_orderkey, greatest(n - 5, 1), n FROM d)
SELECT o_orderkey, CAST(count(*) AS INT) AS n_bands, CAST(sum(stop - start) AS BIGINT) AS n_reads FROM b GROUP BY 1""")
def band_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", P.bands((F.col("o_orderkey") % 60 + 1).cast("int")).alias("b"))
    return o.select("o_orderkey", F.size("b").alias("n_bands"), F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]).alias("n_reads"))


@query("""WITH d AS (SELECT DISTINCT source, doc_id AS no FROM documents), r AS (SELECT source, no - row_number() OVER (PARTITION BY source ORDER BY no) AS island FROM d),
c AS (SELECT source, island, count(*) AS run FROM r GROUP BY 1, 2)
SELECT source, max(run) AS longest, CAST(sum(run) AS BIGINT) AS n_numbers, sum(run) > 15 OR max(run) >= 5 AS discard FROM c GROUP BY 1""")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").alias("no"))
    return P.longest_run(d, "source")


_FIGS = """+l AS (SELECT list_id, CAST(list_id // 10 AS INT) + 1 AS page, CAST(list_id % 6 // 2 AS VARCHAR) AS manual_id, CASE WHEN list_id % 11 < 2 THEN [CAST(list_id // 60 AS VARCHAR), 'none'] ELSE [] END AS families,
  coalesce(list_sort(list(DISTINCT ref) FILTER (WHERE ref <> '')), []) AS refs, min(description) AS title FROM v_parts GROUP BY 1),
f AS (SELECT list_id AS figure_id, manual_id, page, families, refs AS callouts, 'Drawing of ' || title AS page_text FROM l WHERE list_id % 2 = 0 AND (len(refs) > 0 OR list_id % 4 = 0)),
k AS (SELECT list_id, manual_id, page, families, CASE WHEN list_id % 5 = 1 THEN '' ELSE title END AS title, CASE WHEN list_id % 5 = 1 THEN title ELSE '(Front)' END AS subtitle, refs FROM l WHERE list_id % 2 = 1),
c AS (SELECT f.*, k.list_id, k.title, k.subtitle, refs, abs(k.page - f.page) <= 2 AS near, len(list_intersect(list_distinct(f.families), k.families)) > 0 AS kin,
  CASE k.page - f.page WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN -1 THEN 3 WHEN -2 THEN 4 ELSE 5 END AS turn FROM f JOIN k ON f.manual_id = k.manual_id AND (abs(f.page - k.page) <= 2 OR len(list_intersect(list_distinct(f.families), k.families)) > 0))
"""


def _figures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even lists play figures with their refs as callouts, odd ones the lists; ten lists are a page of three
    manuals, some lists belong to drawing sets."""
    ref, k = F.when(F.col("ref") != "", F.col("ref")), F.col("list_id")
    l = held(view(spark, sf_dir, "v_parts").groupBy("list_id").agg(F.array_sort(F.collect_set(ref)).alias("refs"), F.min("description").alias("title")))
    l = l.withColumns({
        "page": F.floor(k / 10).cast("int") + 1, "manual_id": F.floor(k % 6 / 2).cast("string"),
        "families": F.when(k % 11 < 2, F.array(F.floor(k / 60).cast("string"), F.lit("none"))).otherwise(F.array().cast("array<string>")),
    })
    layout = F.when(k % 4 == 0, "exploded_parts").otherwise("single")
    figures = l.where("list_id % 2 = 0").select(k.alias("figure_id"), "manual_id", "page", F.col("refs").alias("callouts"), F.concat(F.lit("Drawing of "), "title").alias("page_text"), "families", layout.alias("layout"))
    odd = k % 5 == 1
    return figures, l.where("list_id % 2 = 1").select("list_id", "manual_id", "page", F.when(odd, "").otherwise(F.col("title")).alias("title"), F.when(odd, F.col("title")).otherwise("(Front)").alias("subtitle"), "refs", "families")


@query(with_views("v_parts", """+c AS (SELECT list_id, seq, CASE WHEN ref <> '' THEN ref ELSE part_number END AS code FROM v_parts)
SELECT list_id, code, CAST(row_number() OVER (PARTITION BY list_id ORDER BY CASE WHEN regexp_matches(code, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(code AS BIGINT), code, seq) AS INT) AS place FROM c"""))
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs and codes of a list as they are shown: numbers first, by value."""
    code = F.when(F.col("ref") != "", F.col("ref")).otherwise(F.col("part_number"))
    rows = view(spark, sf_dir, "v_parts").select("list_id", "seq", code.alias("code"))
    w = Window.partitionBy("list_id").orderBy(*L.natural_order(F.col("code")), "seq")
    return rows.select("list_id", "code", F.row_number().over(w).alias("place"))


_KEYED = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(with_views("v_parts", _FIGS + f""", e AS (SELECT *, CASE WHEN len(callouts) > 0 THEN len(list_intersect(callouts, refs))::DOUBLE / len(callouts) ELSE 0.0::DOUBLE END AS coverage,
  ({_KEYED.format('title')} <> '' AND contains({_KEYED.format('page_text')}, {_KEYED.format('title')})) OR contains({_KEYED.format('page_text')}, {_KEYED.format('subtitle')}) AS titled FROM c),
s AS (SELECT *, coverage + titled::INT + 0.8::DOUBLE * kin::INT + 0.2::DOUBLE * near::INT AS score FROM e WHERE (titled AND (len(callouts) = 0 OR coverage >= 0.4)) OR (coverage >= 0.7 AND (near OR kin))),
n AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY score DESC, turn, list_id) AS n FROM s)
SELECT figure_id, list_id, round(score, 6) AS score, round(coverage, 2) AS coverage, list_sort(list_filter(callouts, lambda x: NOT list_contains(refs, x))) AS missing FROM n WHERE n = 1"""))
def parts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figure_matches(*_figures(spark, sf_dir))


_ENTRY = """+x AS (SELECT *, CASE WHEN seq % 4 = 0 THEN '' ELSE 'note ' || CAST(seq AS VARCHAR) END AS remarks, CASE WHEN list_id % 3 = 0 THEN '' WHEN seq % 2 = 0 THEN 'confirmed by both' ELSE 'unconfirmed ' || CAST(seq % 3 AS VARCHAR) END AS "check" FROM v_parts),
g AS (SELECT *, CAST(sum(CASE WHEN ref <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY list_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS INT) AS grp FROM x),
l AS (SELECT DISTINCT list_id, CASE WHEN list_id % 2 = 0 THEN '' ELSE 'List ' || CAST(list_id AS VARCHAR) END AS title, CASE WHEN list_id % 4 < 2 THEN '' ELSE '(Front)' END AS subtitle, page, list_id % 3 = 0 AS verified FROM v_parts)
"""


def _entry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, i = F.col("list_id"), F.col("seq")
    rows = view(spark, sf_dir, "v_parts").withColumns({
        "remarks": F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("note "), i.cast("string"))),
        "check": F.when(k % 3 == 0, "").when(i % 2 == 0, "confirmed by both").otherwise(F.concat(F.lit("unconfirmed "), (i % 3).cast("string"))),
    })
    lists = rows.select("list_id", "page").distinct().select("list_id", F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("List "), k.cast("string"))).alias("title"), F.when(k % 4 < 2, "").otherwise("(Front)").alias("subtitle"), "page", (k % 3 == 0).alias("verified"))
    return rows, lists


@query(with_views("v_parts", _ENTRY + """, e AS (SELECT list_id, grp, max(ref) AS ref, list({'d': description, 'p': part_number, 'q': qty, 'm': remarks, 'c': "check"} ORDER BY seq) AS r FROM g GROUP BY 1, 2 HAVING max(ref) <> ''),
i AS (SELECT list_id, seq % 2 AS figure_id, CAST(seq % 2 * 3 AS INT) AS page, list(DISTINCT ref) AS callouts FROM v_parts WHERE ref <> '' AND qty::INT > 20 GROUP BY 1, 2, 3),
s AS (SELECT e.list_id, e.ref, list({'pg': i.page, 'f': i.figure_id} ORDER BY i.page, i.figure_id) AS spots FROM (SELECT DISTINCT list_id, ref FROM e) e JOIN i ON i.list_id = e.list_id AND (len(callouts) < 3 OR list_contains(callouts, e.ref)) GROUP BY 1, 2),
u AS (SELECT e.list_id, grp, list_distinct(list_filter(list_transform(r, lambda x: x.c), lambda c: NOT starts_with(c, 'confirmed'))) AS d0 FROM e),
o AS (SELECT list_id, grp, list_filter(list_transform(range(1, len(r) + 1), lambda n: CASE WHEN list_position(list_transform(r, lambda x: x.c), r[n].c) = n AND NOT starts_with(r[n].c, 'confirmed') THEN r[n].c END), lambda c: c IS NOT NULL) AS doubts FROM e)
SELECT e.list_id, e.grp, e.ref, coalesce(nullif(trim(title || ' ' || subtitle), ''), 'Parts list, page ' || l.page) || ' — part ref ' || e.ref || ': ' || r[1].d || ', part number ' || r[1].p || ', quantity ' || r[1].q || CASE WHEN r[1].m <> '' THEN ', ' || r[1].m ELSE '' END
  || array_to_string(list_transform(r[2:], lambda a: '. Alternative: ' || a.d || ' ' || a.p || ', quantity ' || a.q || CASE WHEN a.m <> '' THEN ', ' || a.m ELSE '' END), '')
  || CASE WHEN spots IS NOT NULL THEN '. Shown as callout ' || e.ref || ' in the figure on ' || array_to_string(list_transform(spots, lambda x: 'page ' || x.pg || CASE WHEN x.f = 1 THEN ' (drawing A-1)' ELSE '' END), '; ') || '; listed on page ' || l.page || '.'
     ELSE '. Listed on page ' || l.page || '; callout ' || e.ref || ' was not read on any drawing (it may be missing from the scan or too small to read).' END
  || CASE WHEN verified THEN '' WHEN len(doubts) = 0 THEN ' (Scanned page: item number, part code and quantity confirmed by two independent readings.)' ELSE ' (Scanned page - not fully confirmed: ' || array_to_string(doubts, ' | ') || ')' END AS content,
  coalesce(spots[1].pg, l.page) AS page, 'fig/' || spots[1].f AS parent_path, CAST(coalesce(len(spots), 0) AS INT) AS n_figures
FROM e JOIN l ON l.list_id = e.list_id LEFT JOIN s ON s.list_id = e.list_id AND s.ref = e.ref JOIN o ON o.list_id = e.list_id AND o.grp = e.grp"""))
def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of more than 20 pieces are shown on two figures a list; with fewer than three refs a figure shows all."""
    rows, lists = _entry(spark, sf_dir)
    fig = F.col("figure_id")
    figures = rows.where("ref <> '' AND CAST(qty AS INT) > 20").groupBy("list_id", (F.col("seq") % 2).alias("figure_id")).agg(F.collect_set("ref").alias("callouts"))
    figures = figures.select("list_id", "figure_id", (fig * 3).alias("page"), F.concat(F.lit("fig/"), fig.cast("string")).alias("path"), F.when(fig == 1, "A-1").alias("code"), "callouts")
    return P.part_entries(rows, lists, figures).drop("part_numbers")


@query(with_views("v_parts", """+l AS (SELECT list_id, list_id % 50 AS doc, CAST(row_number() OVER (PARTITION BY list_id % 50 ORDER BY list_id) AS INT) + list_id % 7 // 6 AS page, count(*) AS n_rows, CAST(list_id // 250 AS VARCHAR) || ' Assy' AS title, CASE WHEN list_id % 600 < 300 THEN '' ELSE '(Rear)' END AS subtitle, list_id % 3 <> 0 AS verified FROM v_parts GROUP BY list_id),
n AS (SELECT *, lead(list_id) OVER w AS i1, lead(page) OVER w AS p1, lead(title) OVER w AS t1, lead(subtitle) OVER w AS s1, lead(n_rows) OVER w AS r1, lead(verified) OVER w AS v1,
  lead(list_id, 2) OVER w AS i2, lead(page, 2) OVER w AS p2, lead(title, 2) OVER w AS t2, lead(subtitle, 2) OVER w AS s2, lead(n_rows, 2) OVER w AS r2, lead(verified, 2) OVER w AS v2 FROM l WINDOW w AS (PARTITION BY doc ORDER BY page, list_id)),
g AS (SELECT *, coalesce(p1 - page BETWEEN 1 AND 2 AND t1 = title AND s1 = subtitle, false) AS a FROM n),
h AS (SELECT *, a AND coalesce(p2 - page BETWEEN 1 AND 2 AND t2 = title AND s2 = subtitle, false) AS b FROM g)
SELECT CAST(doc AS VARCHAR) AS manual_id, list_id, CAST(list_id AS VARCHAR) || CASE WHEN a THEN ',' || i1 ELSE '' END || CASE WHEN b THEN ',' || i2 ELSE '' END AS members,
  CAST(n_rows + CASE WHEN a THEN r1 ELSE 0 END + CASE WHEN b THEN r2 ELSE 0 END AS BIGINT) AS n_rows, verified AND (NOT a OR v1) AND (NOT b OR v2) AS verified FROM h"""))
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes on from each list, on the next two pages of its manual."""
    from pyspark.sql import Window

    k = F.col("list_id")
    l = view(spark, sf_dir, "v_parts").groupBy("list_id").agg(F.count("*").alias("n_rows"))
    contd = F.when(k % 2 == 0, F.lit(" (Cont'd)")).otherwise(F.lit(""))
    page = F.row_number().over(Window.partitionBy(k % 50).orderBy("list_id")) + F.floor(k % 7 / 6).cast("int")
    l = l.select("list_id", (k % 50).cast("string").alias("manual_id"), page.alias("page"), "n_rows", F.concat(F.floor(k / 250).cast("string"), F.lit(" Assy"), contd).alias("title"), F.when(k % 600 < 300, "").otherwise("(Rear)").alias("subtitle"), (k % 3 != 0).alias("verified"))
    return P.continued(l).select("manual_id", "list_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "n_rows", "verified")


_SECOND = """SELECT CAST(p_size AS BIGINT) AS list_id, CAST(p_partkey AS INT) AS seq, CAST(p_partkey AS VARCHAR) AS ref, CASE WHEN p_partkey % 10 = 0 THEN '1OC-' || CAST(p_partkey AS VARCHAR) ELSE '10C-' || CAST(p_partkey AS VARCHAR) END AS part_number,
  CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE p_name END AS description, CASE p_partkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN 'many' ELSE 'A/R' END AS qty FROM part WHERE p_brand <> 'Brand#11'"""
_FIRST = """SELECT CAST(p_size AS BIGINT) AS list_id, CAST(p_partkey AS INT) AS seq, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS ref, '10C' || CAST(p_partkey AS VARCHAR) AS part_number, p_name AS description,
  CASE p_partkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '' END AS qty FROM part WHERE p_brand <> 'Brand#12'"""


_WORDS = "list_transform(regexp_extract_all(lower({}), '[a-z0]{{3,}}'), lambda x: translate(x, '0', 'o'))"
_VALID = "CASE WHEN regexp_matches(coalesce({0}, ''), '^(\\d{{1,3}}|[xX]|A/R|AR)$') THEN {0} ELSE '' END"


@query(f"""WITH o0 AS ({_FIRST}), v0 AS ({_SECOND}), o AS (SELECT *, translate(regexp_replace(upper(part_number), '[^A-Z0-9]', '', 'g'), 'OI', '01') AS key FROM o0),
v AS (SELECT *, translate(regexp_replace(upper(part_number), '[^A-Z0-9]', '', 'g'), 'OI', '01') AS key FROM v0),
b AS (SELECT o.*, v.part_number AS vp, v.ref AS vr, v.description AS vd, {_VALID.format('o.qty')} AS q, {_VALID.format('v.qty')} AS vq FROM o LEFT JOIN v ON o.list_id = v.list_id AND o.key = v.key),
n AS (SELECT *, CASE WHEN q <> '' AND lower(q) = lower(vq) THEN 0 ELSE 1 END AS doubt, vp IS NOT NULL AND len(list_intersect({_WORDS.format('description')}, {_WORDS.format('vd')})) > 0 AS name_ok, coalesce(ref = vr, false) AS ref_ok FROM b)
SELECT list_id, seq, CASE WHEN coalesce(name_ok, false) THEN vp ELSE part_number END AS part_number, CASE WHEN q <> '' THEN q ELSE vq END AS qty, CASE WHEN coalesce(name_ok, false) AND ref_ok AND doubt = 0 THEN 'confirmed' WHEN coalesce(name_ok, false) AND ref_ok THEN 'part confirmed' ELSE 'unconfirmed' END AS status,
  CAST(doubt + CASE WHEN coalesce(name_ok, false) THEN CASE WHEN vp <> part_number THEN 1 ELSE 0 END ELSE 1 END AS INT) AS n_notes FROM n""")
def two_reader_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two readers: matched by folded part number, names by shared words, quantities, status."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    read = lambda text: spark.sql(text.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=part)
    rows = D.matched(read(_FIRST).withColumn("conf", F.lit(0.9)), read(_SECOND))
    rows = rows.withColumns({"ref_ok": F.coalesce(F.col("ref") == F.col("v_ref"), F.lit(False)), "ref_note": F.lit(None).cast("string")})
    return D.judged(rows).select("list_id", "seq", "part_number", "qty", "status", F.size("notes").alias("n_notes"))


@query(f"""WITH o0 AS ({_FIRST}), v0 AS ({_SECOND}), o AS (SELECT *, translate(regexp_replace(upper(part_number), '[^A-Z0-9]', '', 'g'), 'OI', '01') AS key FROM o0),
v AS (SELECT *, translate(regexp_replace(upper(part_number), '[^A-Z0-9]', '', 'g'), 'OI', '01') AS key FROM v0),
x AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.list_id = v.list_id AND o.key = v.key)),
p AS (SELECT x.*, NOT EXISTS (SELECT 1 FROM o WHERE o.list_id = x.list_id AND o.ref = x.ref) AS free FROM x)
SELECT list_id, seq, CASE WHEN free THEN (SELECT min(o.seq) FROM o WHERE o.list_id = p.list_id AND o.ref <> '' AND o.ref::INT > p.ref::INT) END AS anchor, CASE WHEN free THEN ref ELSE '' END AS ref, part_number, {_VALID.format('qty')} AS qty FROM p""")
def second_reader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only the second reader saw, and the row that each stands before."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    read = lambda text: spark.sql(text.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=part)
    return D.second_only(read(_FIRST), read(_SECOND)).drop("description")


_GAPPY = "SELECT l_orderkey AS list_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq, CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_linenumber * 3 AS {0}) ELSE '' END AS ref, CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CAST(l_linenumber * 3 + l_partkey % 7 - 3 AS {0}) END AS second FROM {1}"


@query("WITH RECURSIVE r0 AS (" + _GAPPY.format("VARCHAR", "lineitem") + """),
r AS (SELECT *, list(TRY_CAST(ref AS INT)) FILTER (WHERE ref <> '') OVER (PARTITION BY list_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, list(ref) FILTER (WHERE ref <> '') OVER (PARTITION BY list_id) AS printed FROM r0),
s AS (SELECT list_id, 0 AS seq, 0 AS low, '' AS above, [''] AS extra, '' AS filled, '' AS fill FROM r WHERE seq = 1
  UNION ALL SELECT list_id, seq, CASE WHEN got <> '' THEN greatest(low, TRY_CAST(got AS INT)) ELSE low END, CASE WHEN got <> '' THEN got ELSE above END, CASE WHEN got <> '' THEN list_append(extra, got) ELSE extra END, got, how FROM (
    SELECT *, CASE WHEN ref <> '' THEN ref WHEN how = 'second reader' THEN second ELSE '' END AS got FROM (
      SELECT s.list_id, r.seq, s.low, s.above, s.extra, r.ref, r.second, CASE WHEN r.ref <> '' THEN NULL WHEN r.second = '' OR (r.second = s.above AND s.above <> '') THEN 'alternative'
        WHEN r.second IS NOT NULL AND TRY_CAST(r.second AS INT) > s.low AND (coalesce(len(list_filter(r.later, lambda x: x > s.low)), 0) = 0 OR TRY_CAST(r.second AS INT) < list_filter(r.later, lambda x: x > s.low)[1]) AND NOT coalesce(list_contains(r.printed, r.second), false) AND NOT list_contains(s.extra, r.second) THEN 'second reader' ELSE 'no ref' END AS how
      FROM s JOIN r ON r.list_id = s.list_id AND r.seq = s.seq + 1)))
SELECT list_id, seq, filled, fill FROM s WHERE seq > 0""")
def ref_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing refs filled from the second reader; the SQL does it row by row."""
    rows = spark.sql(_GAPPY.format("STRING", "{l}"), l=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return D.filled_refs(rows).select("list_id", "seq", "filled", "fill")


@query("""WITH RECURSIVE r AS (SELECT list_id, seq, no, lead(no) OVER (PARTITION BY list_id ORDER BY seq) AS nxt FROM (
  SELECT l_orderkey AS list_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq, l_linenumber AS no FROM lineitem)),
c AS (SELECT list_id, seq, no, nxt, 0 AS last FROM r WHERE seq = 1),
f AS (SELECT list_id, seq, no, nxt, last, CASE WHEN no = last + 1 AND (nxt IS NULL OR nxt > no) THEN no WHEN nxt IS NOT NULL AND nxt = last + 2 AND no <> last + 1 THEN last + 1 WHEN no <= last OR (nxt IS NOT NULL AND no >= nxt) THEN NULL ELSE no END AS fixed FROM c
  UNION ALL SELECT list_id, seq, no, nxt, last, CASE WHEN no = last + 1 AND (nxt IS NULL OR nxt > no) THEN no WHEN nxt IS NOT NULL AND nxt = last + 2 AND no <> last + 1 THEN last + 1 WHEN no <= last OR (nxt IS NOT NULL AND no >= nxt) THEN NULL ELSE no END FROM (
    SELECT r.list_id, r.seq, r.no, r.nxt, coalesce(f.fixed, f.last) AS last FROM f JOIN r ON r.list_id = f.list_id AND r.seq = f.seq + 1))
SELECT list_id, seq, no, fixed FROM f""")
def ref_sequence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("""SELECT l_orderkey AS list_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq, l_linenumber AS no FROM {l}""", l=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return D.with_repaired_refs(rows.withColumn("conf", F.lit(1.0))).drop("sure")


@query("""WITH c AS (SELECT unnest(['ref', 'part', 'description', 'qty']) AS name, unnest([0.0, 40.0, 90.0, 180.0])::DOUBLE AS start, unnest([1, 2, 3, 4]) AS o)
SELECT e.event_id, coalesce((SELECT arg_max(name, start) FROM c WHERE start <= e.value * 4 - 20 + 4.0), 'ref') AS "column" FROM events e""")
def asof_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit(1).alias("page"), (F.col("value") * 4 - 20).alias("x0"))
    columns = spark.createDataFrame([(1, "ref", 0.0), (1, "part", 40.0), (1, "description", 90.0), (1, "qty", 180.0)], "page int, name string, start double")
    return P.column_of(words, columns).select("event_id", "column")


@query(with_views("v_parts", _ENTRY + """, b AS (SELECT list_id, grp, CASE WHEN max(ref) <> '' THEN max(ref) ELSE '-' END AS ref, list({'d': description, 'p': part_number, 'q': qty, 'm': remarks} ORDER BY seq) AS r FROM g GROUP BY 1, 2),
s AS (SELECT list_id, grp, 'Ref ' || ref || ': ' || r[1].d || ' — part ' || r[1].p || ' (qty ' || r[1].q || ')' || CASE WHEN r[1].m <> '' THEN ' — ' || r[1].m ELSE '' END || array_to_string(list_transform(r[2:], lambda a: '; alternative ' || a.p || ' ' || a.d || ' (qty ' || a.q || ')' || CASE WHEN a.m <> '' THEN ' — ' || a.m ELSE '' END), '') AS line FROM b),
t AS (SELECT list_id, string_agg(line, chr(10) ORDER BY grp) AS body FROM s GROUP BY 1)
SELECT t.list_id, coalesce(nullif(trim(title || ' ' || subtitle), ''), 'Parts list') || ' — parts list' || chr(10) || body AS content FROM t JOIN l ON l.list_id = t.list_id"""))
def parts_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.list_text(*_entry(spark, sf_dir))


@query(with_views("v_parts", _ENTRY + """, r AS (SELECT x.list_id, seq, verified, '| ' || ref || ' | ' || replace(part_number, '|', '\\|') || ' | ' || description || ' | ' || remarks || ' | ' || qty || CASE WHEN verified THEN '' ELSE ' | ' || "check" END || ' |' AS line FROM x JOIN l ON l.list_id = x.list_id)
SELECT list_id, '| Ref. | Part Number | Description | Remarks | Qty. |' || CASE WHEN verified THEN '' ELSE ' Reading |' END || chr(10) || '| --- | --- | --- | --- | --- |' || CASE WHEN verified THEN '' ELSE ' --- |' END || chr(10) || string_agg(line, chr(10) ORDER BY seq) AS markdown FROM r GROUP BY list_id, verified"""))
def parts_list_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.list_markdown(*_entry(spark, sf_dir))


@query("""WITH m AS (SELECT p_brand, quantile_cont(p_size::DOUBLE, 0.5) AS med FROM part GROUP BY 1)
SELECT p_partkey, p.p_brand, p_size FROM part p JOIN m ON p.p_brand = m.p_brand WHERE abs(p_size - med) <= med * 0.35::DOUBLE""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    return P.near_median(part, "p_brand", "p_size").select("p_partkey", "p_brand", "p_size")


@query("""WITH RECURSIVE w AS (SELECT user_id, event_id, event_id * 7919 % 4000 / 8.0 + 1 AS yc, CAST(event_id % 500 AS DOUBLE) AS x0, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 4000 / 8.0, event_id % 500, event_id) AS n FROM events),
f AS (SELECT user_id, n, x0, yc, yc AS anchor, 0 AS line FROM w WHERE n = 1
  UNION ALL SELECT w.user_id, w.n, w.x0, w.yc, CASE WHEN w.yc - f.anchor > 3 THEN w.yc ELSE f.anchor END, CASE WHEN w.yc - f.anchor > 3 THEN f.line + 1 ELSE f.line END FROM f JOIN w ON w.user_id = f.user_id AND w.n = f.n + 1)
SELECT CAST(user_id AS INT) AS page, line AS line_no, count(*) AS n_words, round(min(yc), 6) AS first FROM f GROUP BY 1, 2""")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positioned words of a user's page: lines anchored on their first word."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    y = F.col("event_id") * 7919 % 4000 / 8.0
    words = e.select(F.lit("m").alias("manual_id"), F.col("user_id").cast("int").alias("page"), (F.col("event_id") % 500).cast("double").alias("x0"), y.alias("y0"), (F.col("event_id") % 500 + 20).cast("double").alias("x1"), (y + 2).alias("y1"), F.col("event_type").alias("text"))
    return P.text_lines(words).groupBy("page", "line_no").agg(F.count("*").alias("n_words"), F.round(F.min((F.col("y0") + F.col("y1")) / 2), 6).alias("first"))
