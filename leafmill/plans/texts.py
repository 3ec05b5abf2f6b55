"""Queries of text ingestion and callouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import models as M
from leafmill.functions import scalars as X
from leafmill.operators import callouts as K
from leafmill.operators import text as T
from leafmill.plans.registry import query
from leafmill.plans.views import view, with_views

_KEY = "trim(regexp_replace(trim(regexp_replace(replace(lower(coalesce({}, '')), '--', '-'), '\\s+', ' ', 'g')), '\\d+', '#', 'g'))"
SHARE = 0.05


@query(with_views("v_line", """+b AS (SELECT manual_id, page, line_no AS seq, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS content FROM v_line),
d AS (SELECT *, row_number() OVER (PARTITION BY manual_id, page, lower(content) ORDER BY seq) AS n FROM b WHERE content <> '')
SELECT manual_id, page, CAST(seq AS INT) AS seq, content FROM d WHERE n = 1"""))
def text_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of every page, each once."""
    return T.distinct_on_page(T.blocks(view(spark, sf_dir, "v_page")))


@query("""WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1), 1) - 1 AS seq FROM pages),
t AS (SELECT page_id, seq, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS content FROM f),
s AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM t WHERE content <> '' AND length(content) < 60 AND len(string_split_regex(content, '\\s+')) <= 6 AND NOT regexp_matches(content, '[.!?:]$'))
SELECT page_id, CAST(seq AS INT) AS seq, content FROM s WHERE n < 3
UNION ALL SELECT page_id, CAST(min(seq) AS INT), 'Page contents: ' || string_agg(content, ' | ' ORDER BY seq) FROM s WHERE n >= 3 GROUP BY page_id""")
def toc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1))).alias("seq", "raw"))
    items = items.select("page_id", "seq", F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("content")).where("content <> ''")
    return T.merged_fragments(items.where(T.is_toc_entry(F.col("content"))))


_HEADER = "length(line) < 40 AND line NOT LIKE '%.'"


@query(with_views("v_line", f"""SELECT manual_id, page, CAST(line_no AS INT) AS line_no,
  coalesce(last_value(CASE WHEN {_HEADER} AND length(line) > 3 THEN line END IGNORE NULLS) OVER (PARTITION BY manual_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General Information') AS section FROM v_line"""))
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_section(view(spark, sf_dir, "v_line"), F.expr(_HEADER)).select("manual_id", "page", "line_no", "section")


_FURNITURE = f"""+p AS (SELECT manual_id, count(DISTINCT page) AS n FROM v_line GROUP BY 1),
k AS (SELECT DISTINCT manual_id, page, {_KEY.format('line')} AS key FROM v_line),
run AS (SELECT k.manual_id, key, count(*) AS pages FROM k JOIN p ON k.manual_id = p.manual_id WHERE key <> '' AND key <> '#' AND n >= 3 GROUP BY k.manual_id, key, n HAVING count(*) >= greatest(3, floor(n * {SHARE})))
"""


@query(with_views("v_line", _FURNITURE + "SELECT manual_id, key, pages FROM run"))
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.furniture(view(spark, sf_dir, "v_line"), SHARE)


@query(with_views("v_line", _FURNITURE + f""", i AS (SELECT manual_id, page, line_no, line, {_KEY.format('piece')} AS key, piece FROM (SELECT *, unnest(string_split_regex(line, '\\n| \\| ')) AS piece FROM v_line)),
r AS (SELECT manual_id, page, line_no, bool_or(regexp_replace(piece, '\\s+', '', 'g') <> '') AS filled, bool_or(regexp_replace(piece, '\\s+', '', 'g') <> '' AND key NOT IN (SELECT key FROM run WHERE run.manual_id = i.manual_id) AND NOT regexp_matches(key, '^#+$')) AS keep FROM i GROUP BY 1, 2, 3)
SELECT manual_id, page, CAST(line_no AS INT) AS line_no FROM r WHERE keep OR NOT filled"""))
def furniture_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "v_line")
    items = lines.select("manual_id", "page", "line_no", F.col("line").alias("content"), F.struct("page", "line_no").alias("item_id"))
    return T.without_furniture(items, T.furniture(lines, SHARE)).select("manual_id", "page", "line_no")


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive splitting of whole texts; checked against properties in the tests."""
    return T.chunked(view(spark, sf_dir, "v_page"))


_WORDS = "[\\p{L}\\p{N}_]"


@query(f"""WITH t AS (SELECT doc_id AS chunk_id, source AS manual_id, text AS content, lower(text) AS low FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT code FROM (SELECT regexp_extract(text, '([\\p{{L}}\\p{{N}}]+)', 1) AS code FROM benchmark UNION SELECT CAST(item_id AS VARCHAR) FROM benchmark) WHERE code <> ''),
h AS (SELECT t.*, code, length(code) AS n, regexp_matches(code, '^[0-9]+$') AS number FROM t JOIN w ON contains(low, lower(code))),
o AS (SELECT chunk_id, code, n, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS k, len(parts) AS parts FROM (SELECT chunk_id, code, n, string_split(low, lower(code)) AS parts FROM h)),
q AS (SELECT chunk_id, code, k, parts, CAST(sum(length(part)) OVER (PARTITION BY chunk_id, code ORDER BY k) AS BIGINT) + (k - 1) * n + 1 AS i FROM o),
p AS (SELECT h.*, q.i FROM h JOIN q ON h.chunk_id = q.chunk_id AND h.code = q.code WHERE q.k < q.parts),
c AS (SELECT *, coalesce(substring(low, i - 1, 1), '') AS before, substring(low, i + n, 1) AS after,
  CASE WHEN number AND i > 1 THEN length(regexp_extract(substring(low, greatest(i - 40, 1), i - greatest(i - 40, 1)), '(?:^|[^\\p{{L}}\\p{{N}}_])(items?\\s*[:.\\-]?\\s*)$', 1)) ELSE 0 END AS item,
  CASE WHEN i > 1 AND substring(low, i - 1, 1) IN ('(', '[') THEN 1 ELSE 0 END AS bracket FROM p),
d AS (SELECT *, CASE WHEN i - 1 - bracket < 1 THEN '' ELSE substring(low, i - 1 - bracket, 1) END AS outer_, CASE WHEN i = 1 THEN '' ELSE before END AS inner_ FROM c),
m AS (SELECT manual_id, code, chunk_id, i, content,
  CASE WHEN NOT number THEN CASE WHEN NOT regexp_matches(inner_, '[\\p{{L}}\\p{{N}}_-]') AND NOT regexp_matches(after, '[\\p{{L}}\\p{{N}}_-]') THEN i END
    WHEN item > 0 AND NOT regexp_matches(after, '{_WORDS}') THEN i - item
    WHEN regexp_matches(after, '[)\\].:–-]') AND bracket = 1 AND NOT regexp_matches(outer_, '[\\p{{L}}\\p{{N}}_.-]') THEN i - 1
    WHEN regexp_matches(after, '[)\\].:–-]') AND NOT regexp_matches(inner_, '[\\p{{L}}\\p{{N}}_.-]') THEN i END AS start,
  CASE WHEN NOT number OR (item > 0 AND NOT regexp_matches(after, '{_WORDS}')) THEN i + n ELSE i + n + 1 END AS stop FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY manual_id, code ORDER BY chunk_id, start) AS k, row_number() OVER (PARTITION BY manual_id, code, chunk_id ORDER BY start) AS nth FROM m WHERE start IS NOT NULL)
SELECT manual_id, code, chunk_id, CAST(nth - 1 AS INT) AS nth, trim(regexp_replace(substring(content, greatest(start - 160, 1), stop + 160 - greatest(start - 160, 1)), '\\s+', ' ', 'g')) AS snippet FROM r WHERE k <= 4""")
def code_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of each source's documents around the first word of each benchmark item and around numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("manual_id"), F.col("text").alias("content"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = items.select(F.regexp_extract("text", r"([\p{L}\p{N}]+)", 1).alias("code")).union(items.select(F.col("item_id").cast("string"))).where("code <> ''").distinct()
    manuals = docs.select("manual_id").distinct()
    return K.evidence(words.withColumn("all", F.lit(1)).join(manuals.withColumn("all", F.lit(1)), "all").drop("all"), docs)


@query(with_views("v_parts", "+f AS (SELECT list_id, arg_min(description, (ref, seq)) AS d, arg_min(ref, (ref, seq)) AS r, list(DISTINCT ref) AS refs FROM v_parts WHERE ref <> '' GROUP BY 1),\n" + """c AS (SELECT list_id, d, r, refs FROM f),
w AS (SELECT list_id, list_distinct(flatten(list(list_transform(regexp_extract_all(lower(description), '[a-z]{3,}'), lambda x: CASE WHEN length(x) >= 4 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END)))) AS words FROM v_parts JOIN f USING (list_id) WHERE v_parts.ref = f.r GROUP BY 1)
SELECT list_id AS id, NOT list_contains(refs, '9') AS bolt_unlisted, NOT list_contains(words, 'ring') AND len(words) > 0 AS ring_misnamed FROM c JOIN w USING (list_id)"""))
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that cite parts by number, checked against the list of their order: a bolt that has another
    number or none, and a ring that the list calls by another name."""
    rows = view(spark, sf_dir, "v_parts").where("ref <> ''")
    per = rows.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("ref", "seq", "description"))).alias("r"))
    refs = F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), x["description"].alias("description")))
    first = F.col("r")[0]
    caption = F.concat(F.lit("The "), first["description"], F.lit(" ("), first["ref"], F.lit(") holds. The loose bolt (9) turns, via the ring ("), first["ref"], F.lit("). It stops here."))
    found = K.checked_captions(per.select(F.col("list_id").alias("id"), caption.alias("caption"), refs.alias("refs")))
    has = lambda kind, ref: F.exists("problems", lambda p: (p["kind"] == kind) & ref(p))
    return found.select("id", has("unlisted", lambda p: p["ref"] == "9").alias("bolt_unlisted"), has("misnamed", lambda p: p["phrase"].endswith("ring")).alias("ring_misnamed"))


@query()
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties cut short at every length, repaired as far as they are whole."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = F.substring(F.concat(F.lit('{"a":['), "props", F.lit(","), "props", F.lit("]}")), F.lit(1), (F.col("event_id") % 24 + 6).cast("int"))
    return events.select("event_id", M.tolerant_json_column(cut).alias("repaired"))


@query("""SELECT p_partkey, regexp_replace(translate(regexp_replace(upper('1O-' || p_name || '-' || p_partkey), '[^A-Z0-9]', '', 'g'), 'OI', '01'), 'x', 'x') AS part_key,
  translate(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), 'ZODQILSBG', '200011586') AS lookalike, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS title_key,
  CASE WHEN p_partkey % 2 = 0 THEN 'CA' || CAST(p_partkey AS VARCHAR) || '-15' ELSE 'A3-2590' END AS family FROM part""")
def scalar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    drawing = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ca"), F.col("p_partkey").cast("string"), F.lit("-15-2"))).otherwise(F.lit("A3-2590"))
    return part.select("p_partkey", X.part_key(F.concat(F.lit("1O-"), "p_name", F.lit("-"), F.col("p_partkey").cast("string"))).alias("part_key"), X.lookalike_key(F.col("p_name")).alias("lookalike"), X.title_key(F.col("p_type")).alias("title_key"), X.drawing_family(drawing).alias("family"))


@query("""WITH RECURSIVE b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {'x0': CAST(event_id % 7 AS DOUBLE), 'y0': CAST(event_id % 5 AS DOUBLE), 'x1': CAST(event_id % 7 + 2 + event_id % 3 AS DOUBLE), 'y1': CAST(event_id % 5 AS DOUBLE) + 2} AS b FROM events),
s AS (SELECT user_id, n, [b] AS kept FROM b WHERE n = 1
  UNION ALL SELECT s.user_id, b.n, CASE WHEN len(list_filter(s.kept, lambda k:
      greatest(least(k.x1, b.b.x1) - greatest(k.x0, b.b.x0), 0) * greatest(least(k.y1, b.b.y1) - greatest(k.y0, b.b.y0), 0) / least((k.x1 - k.x0) * (k.y1 - k.y0), (b.b.x1 - b.b.x0) * (b.b.y1 - b.b.y0)) > 0.8)) > 0 THEN s.kept ELSE list_append(s.kept, b.b) END
    FROM s JOIN b ON b.user_id = s.user_id AND b.n = s.n + 1)
SELECT user_id, CAST(max(n) AS INT) AS n, CAST(max(len(kept)) AS INT) AS kept FROM s GROUP BY 1""")
def figure_box_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure boxes of a page in order, without those that lie in an earlier one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    box = F.struct((F.col("event_id") % 7).cast("double").alias("x0"), (F.col("event_id") % 5).cast("double").alias("y0"), (F.col("event_id") % 7 + 2 + F.col("event_id") % 3).cast("double").alias("x1"), (F.col("event_id") % 5 + 2.0).alias("y1"))
    per = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", box.alias("b")))), lambda x: x["b"]).alias("boxes"))
    kept = K.kept_boxes(F.col("boxes"))
    return per.select("user_id", F.size("boxes").alias("n"), F.size(kept).alias("kept"))
