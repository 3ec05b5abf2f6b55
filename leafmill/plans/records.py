"""Queries of registries, sessions and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import scalars as X
from leafmill.operators import registry as R
from leafmill.operators import sessions as C
from leafmill.plans.registry import query
from leafmill.plans.views import view, with_views
from leafmill.sources import answers as A
from leafmill.sources import uploads
from leafmill.sources.migration import migrate
from leafmill.sources.scratch import fresh
from leafmill.streaming import ingest as I
from leafmill.streaming.watch import outcomes


@query(with_views("v_page", "SELECT manual_id, count(*) AS n_chunks FROM v_page WHERE manual_id <> '' GROUP BY 1"))
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_counts(view(spark, sf_dir, "v_page"))


@query(with_views("v_manual v_chunk", """+c AS (SELECT manual_id, count(*) AS n FROM v_chunk GROUP BY 1)
SELECT coalesce(m.manual_id, c.manual_id) AS manual_id, coalesce(filename, '') AS filename, coalesce(n, 0) AS n_chunks, lower(coalesce(m.manual_id, c.manual_id)) AS sort_key
FROM v_manual m FULL JOIN c ON m.manual_id = c.manual_id"""))
def manual_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.manual_listing(view(spark, sf_dir, "v_manual"), view(spark, sf_dir, "v_chunk"))


@query(with_views("v_machine v_chunk", """+c AS (SELECT manual_id, count(*) AS n FROM v_chunk GROUP BY 1)
SELECT machine_id, name, m.manual_id, coalesce(n, 0) AS n_chunks FROM v_machine m LEFT JOIN c ON m.manual_id = c.manual_id"""))
def machine_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.machine_listing(view(spark, sf_dir, "v_machine"), view(spark, sf_dir, "v_chunk"))


_REQUESTS = "SELECT c_custkey AS request_id, 'S' || CAST(c_custkey % 2000 AS STRING) AS machine_id, CASE WHEN c_custkey % 3 = 0 THEN '  N' || CAST(c_nationkey AS STRING) || ' ' WHEN c_custkey % 3 = 1 THEN '  ' END AS manual_id FROM {customer}"


@query(with_views("v_machine", "+r AS (" + _REQUESTS.replace("{customer}", "customer") + """)
SELECT request_id, coalesce(nullif(trim(r.manual_id), ''), m.manual_id) AS resolved FROM r LEFT JOIN v_machine m ON r.machine_id = m.machine_id"""))
def manual_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(_REQUESTS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return R.resolved_manual(requests, view(spark, sf_dir, "v_machine")).select("request_id", "resolved")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"chunks": view(spark, sf_dir, "v_chunk"), "machines": view(spark, sf_dir, "v_machine"), "manuals": view(spark, sf_dir, "v_manual")}


@query(with_views("v_machine", "SELECT machine_id, name, manual_id FROM v_machine WHERE manual_id = 'N7'"))
def orphaned_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delete_manual(_tables(spark, sf_dir), "N7")[1].select("machine_id", "name", "manual_id")


@query(with_views("v_manual v_chunk", """SELECT 'manual' AS kind, manual_id, count(*) AS n FROM v_manual WHERE manual_id <> 'N7' GROUP BY 2
UNION ALL SELECT 'chunk', manual_id, count(*) FROM v_chunk WHERE manual_id <> 'N7' GROUP BY 2"""))
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = R.delete_manual(_tables(spark, sf_dir), "N7")
    count = lambda n, kind: left[n].groupBy("manual_id").count().select(F.lit(kind).alias("kind"), "manual_id", F.col("count").alias("n"))
    return count("manuals", "manual").unionByName(count("chunks", "chunk"))


@query(with_views("v_manual v_chunk v_machine", """+r AS (SELECT 'manual' AS kind, manual_id FROM v_manual UNION ALL SELECT 'chunk', manual_id FROM v_chunk UNION ALL SELECT 'machine', manual_id FROM v_machine)
SELECT kind, CASE manual_id WHEN 'N9' THEN 'N900' ELSE manual_id END AS manual_id, count(*) AS n FROM r GROUP BY 1, 2"""))
def rename_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = R.rename_manual(_tables(spark, sf_dir), "N9", "N900")
    kinds = {"manuals": "manual", "chunks": "chunk", "machines": "machine"}
    rows = None
    for n, kind in kinds.items():
        part = new[n].groupBy("manual_id").count().select(F.lit(kind).alias("kind"), "manual_id", F.col("count").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


_PAYLOAD = "SELECT CASE c_custkey % 5 WHEN 0 THEN ' None ' ELSE ' S' || CAST(c_custkey % 400 AS STRING) || ' ' END AS machine_id, c_name AS name, CASE c_custkey % 7 WHEN 0 THEN 'nan' ELSE 'N' || CAST(c_nationkey AS STRING) || ' ' END AS manual_id, c_custkey AS seq FROM {customer}"


@query(with_views("v_machine", "+p AS (" + _PAYLOAD.replace("{customer}", "customer") + """),
t AS (SELECT trim(machine_id) AS machine_id, name, trim(manual_id) AS manual_id, seq FROM p WHERE lower(trim(machine_id)) NOT IN ('', 'null', 'undefined', 'none', 'nan') AND lower(trim(manual_id)) NOT IN ('', 'null', 'undefined', 'none', 'nan')),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY seq DESC) AS n FROM t) WHERE n = 1)
SELECT machine_id, name, manual_id FROM v_machine m WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.machine_id = m.machine_id) UNION ALL SELECT machine_id, name, manual_id FROM u"""))
def upsert_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with padded ids, placeholders and machines that come several times: the last one counts."""
    payload = spark.sql(_PAYLOAD, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return R.upsert_machines(view(spark, sf_dir, "v_machine"), payload, "seq")


@query(with_views("v_message", """SELECT session_id, arg_min(content, id) FILTER (WHERE role = 'user') AS topic, arg_max(content, id) FILTER (WHERE role = 'agent') AS latest FROM v_message GROUP BY 1"""))
def session_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_and_last(view(spark, sf_dir, "v_message"))


@query(with_views("v_message", """+w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM v_message)
SELECT session_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY id) AS history FROM w WHERE back BETWEEN 2 AND 11 GROUP BY 1"""))
def session_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history_text(C.prior_turns(view(spark, sf_dir, "v_message")))


@query(with_views("v_message", """+f AS (SELECT session_id, id, unnest([0, 1]) AS pos FROM v_message WHERE role = 'agent'),
i AS (SELECT session_id, id, pos, 'img/' || CAST((id // 2 + pos) % 5 AS VARCHAR) AS image FROM f),
d AS (SELECT session_id, image, min((id, pos)) AS spot FROM i GROUP BY 1, 2),
n AS (SELECT session_id, image, row_number() OVER (PARTITION BY session_id ORDER BY spot) AS n FROM d)
SELECT session_id, CAST(n AS INT) AS n, image, 'Figure ' || CAST(n AS VARCHAR) AS caption FROM n WHERE n <= 6"""))
def session_report_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda d: F.concat(F.lit("img/"), (F.floor(F.col("id") / 2) + d).__mod__(5).cast("string"))
    messages = view(spark, sf_dir, "v_message").where("role = 'agent'").withColumn("images", F.array(name(0), name(1)))
    return C.report_images(messages, limit=6)


_TAGGED = """CASE session_id % 4 WHEN 0 THEN '[ASK: Seen it? | Yes | yes | No. ]' WHEN 1 THEN '[ask: Only one | this]' WHEN 2 THEN '[ASK: A? | b | c][ASK: D? | e | f | g | h | i | j][ASK: K? | l | m]' ELSE '' END"""


@query(with_views("v_message", f"""+a AS (SELECT id, {_TAGGED} || content AS answer FROM v_message WHERE role = 'agent'),
b AS (SELECT id, unnest(regexp_extract_all(answer, '(?i)\\[ASK:\\s*([^\\]]+?)\\s*\\]', 1)) AS body, generate_subscripts(regexp_extract_all(answer, '(?i)\\[ASK:\\s*([^\\]]+?)\\s*\\]', 1), 1) AS pos FROM a),
p AS (SELECT id, pos, list_transform(string_split(body, '|'), lambda x: trim(x)) AS parts FROM b),
o AS (SELECT id, pos, parts[1] AS question, list_filter(list_transform(parts[2:], lambda x: trim(left(trim(x, ' .'), 60))), lambda x: x <> '') AS raw FROM p),
d AS (SELECT id, pos, question, list_filter(raw, lambda x, i: list_position(list_transform(raw, lambda y: lower(y)), lower(x)) = i) AS options FROM o),
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM d WHERE question <> '' AND len(options) >= 2)
SELECT id, CAST(n AS INT) AS n, left(question, 200) AS question, array_to_string(options[1:5], '/') AS options FROM e WHERE n <= 2"""))
def ask_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = view(spark, sf_dir, "v_message").where("role = 'agent'").withColumn("answer", F.concat(F.expr(_TAGGED), "content"))
    found = answers.select("id", F.posexplode(X.questions(F.col("answer"))).alias("n", "q"))
    return found.select("id", (F.col("n") + 1).alias("n"), "q.question", F.array_join("q.options", "/").alias("options"))


@query(with_views("v_message", """+a AS (SELECT id, CASE id % 3 WHEN 0 THEN '<think>plan ' || chr(10) || 'more</think> ' || content WHEN 1 THEN '<think>' || content ELSE content END AS raw FROM v_message WHERE role = 'agent')
SELECT id, nullif(regexp_replace(regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', '', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS answer FROM a"""))
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<think>plan \nmore</think> "), "content")).when(F.col("id") % 3 == 1, F.concat(F.lit("<think>"), "content")).otherwise(F.col("content"))
    return view(spark, sf_dir, "v_message").where("role = 'agent'").select("id", X.without_reasoning(raw).alias("answer"))


@query(with_views("v_message", """+a AS (SELECT id, session_id, content || chr(10) || '[IMAGE_1] DIAGRAM, full view (page 3)' AS raw FROM v_message WHERE role = 'agent')
SELECT id, content AS answer FROM (SELECT id, replace(raw, '[IMAGE_1] DIAGRAM, full view (page 3)', '[IMAGE_1]') AS content FROM a)"""))
def history_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing line echoed into an answer shrinks to its tag; an invented history section goes."""
    m = view(spark, sf_dir, "v_message").where("role = 'agent'")
    raw = F.concat("content", F.lit("\n[IMAGE_1] DIAGRAM, full view (page 3)"), F.when(F.col("session_id") % 2 == 0, F.lit("\n### Happened before here\nnever")).otherwise(F.lit("")))
    return m.select("id", X.without_listing(X.without_past_section(raw, F.lit(0))).alias("answer"))


@query(with_views("v_job", "SELECT manual_id, arg_max(status, seq) AS status, max(seq) AS seq FROM v_job GROUP BY 1"))
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest_status(view(spark, sf_dir, "v_job"))


_POLLS = "SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(floor(event_id % 5000 / 500) AS INT) AS STRING) AS manual_id, ts AS polled, event_id AS seq, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'processing' END WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'unknown' END WHEN 'signup' THEN 'unknown' ELSE 'processing' END AS status FROM {events}"


@query("WITH p AS (" + _POLLS.replace("STRING", "VARCHAR").replace("{events}", "events") + """),
l AS (SELECT *, min(polled) OVER (PARTITION BY manual_id) + INTERVAL 1440 MINUTE AS stop FROM p),
s AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN status = 'unknown' THEN 0 ELSE 1 END) OVER w AS run FROM l WHERE polled < stop WINDOW w AS (PARTITION BY manual_id ORDER BY polled, seq)),
t AS (SELECT *, CASE WHEN status IN ('success', 'failed') THEN status WHEN status = 'unknown' AND row_number() OVER (PARTITION BY manual_id, run, status = 'unknown' ORDER BY place) >= 3 THEN 'lost' END AS says FROM s),
f AS (SELECT manual_id, max(stop) AS stop, count(*) AS n, min(place) FILTER (WHERE says IS NOT NULL) AS place, arg_min(says, place) FILTER (WHERE says IS NOT NULL) AS says, min(polled) FILTER (WHERE says IS NOT NULL) AS polled FROM t GROUP BY 1)
SELECT manual_id, coalesce(says, CASE WHEN (SELECT max(polled) FROM p) >= stop THEN 'overdue' ELSE 'processing' END) AS outcome, coalesce(place, n) AS polls, coalesce(polled, CASE WHEN (SELECT max(polled) FROM p) >= stop THEN stop END) AS ended FROM f""")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of jobs that may take a day: how each job ends, and after how many polls."""
    polls = spark.sql(_POLLS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return outcomes(polls.withColumnRenamed("polled", "at"), minutes=1440)


@query(with_views("v_job", """SELECT manual_id, count(*) FILTER (WHERE status = 'success') AS stored, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'unknown') AS empty,
  coalesce(list(seq ORDER BY seq) FILTER (WHERE status = 'failed'), [])[1:5] AS samples, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial' ELSE 'success' END AS state FROM v_job GROUP BY 1"""))
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(view(spark, sf_dir, "v_job"))


@query("""WITH d AS (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)
SELECT doc_id FROM d WHERE coalesce(toxic, 0) = 0""")
def relevance_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdicts as a semi join that fails open: labels play the judge."""
    from leafmill.functions.models import relevant

    verdicts = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg((F.max("toxic") == 0).alias("keep"))
    return relevant(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), verdicts, ["doc_id"])


@query(with_views("v_message", """+a AS (SELECT id AS answer_id, content FROM v_message WHERE role = 'agent')
SELECT answer_id, 1 AS seq, 'text' AS kind, trim(content) AS value FROM a WHERE trim(content) <> ''
UNION ALL SELECT answer_id, CASE WHEN trim(content) = '' THEN 1 ELSE 2 END, 'asset', 'IMAGE_0' FROM a
UNION ALL SELECT answer_id, CASE WHEN trim(content) = '' THEN 2 ELSE 3 END, 'text', 'and' FROM a
UNION ALL SELECT answer_id, CASE WHEN trim(content) = '' THEN 3 ELSE 4 END, 'asset', 'TABLE_1' FROM a"""))
def answer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer in segments: repeated and unknown tags go, unnamed assets follow at the end."""
    m = view(spark, sf_dir, "v_message").where("role = 'agent'")
    text = F.concat("content", F.lit(" [IMAGE_0] and [IMAGE_0] [TABLE_9]"))
    return C.segments(m.select(F.col("id").alias("answer_id"), text.alias("answer"), F.array(F.lit("IMAGE_0"), F.lit("TABLE_1")).alias("tags")))


_UPDATES = "SELECT 'J' || CAST(user_id AS STRING) AS manual_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_type END AS status, CASE WHEN event_id % 5 = 0 THEN event_id END AS chunks FROM {events}"


@query("WITH u AS (" + _UPDATES.replace("{events}", "events") + """)
SELECT manual_id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, arg_max(chunks, seq) FILTER (WHERE chunks IS NOT NULL) AS chunks, max(seq) AS updated FROM u GROUP BY 1""")
def job_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that set some fields, merged field by field."""
    return I.job_state(spark.sql(_UPDATES, events=spark.read.parquet(f"{sf_dir}/events.parquet")), ("status", "chunks"))


@query("WITH u AS (" + _UPDATES.replace("{events}", "events") + """), j AS (SELECT manual_id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status FROM u GROUP BY 1),
a AS (SELECT DISTINCT 'J' || CAST(c_custkey % 300 AS VARCHAR) AS manual_id FROM customer)
SELECT a.manual_id, coalesce(status, 'unknown') AS status FROM a LEFT JOIN j ON a.manual_id = j.manual_id""")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of jobs that are asked for, known or not."""
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("J"), (F.col("c_custkey") % 300).cast("string")).alias("manual_id"))
    return I.status_of(asked, job_fields(spark, sf_dir)).select("manual_id", "status")


@query(with_views("v_message", """+f AS (SELECT id, session_id, content, CASE session_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' worn ' END AS root_cause, CASE session_id % 2 WHEN 0 THEN '  ' ELSE ' replaced ' END AS actions, CASE session_id % 4 WHEN 0 THEN 'turned' ELSE NULL END AS operator_fix FROM v_message WHERE role = 'user'),
c AS (SELECT id, trim(coalesce(root_cause, '')) AS root_cause, coalesce(nullif(trim(actions), ''), nullif(trim(coalesce(operator_fix, '')), '')) AS actions FROM f)
SELECT id, actions, array_to_string(list_filter([CASE WHEN root_cause = '' THEN 'root_cause' END, CASE WHEN actions IS NULL THEN 'actions' END], lambda x: x IS NOT NULL), ',') AS errors FROM c"""))
def fix_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of fixes with what they lack."""
    m, k = view(spark, sf_dir, "v_message").where("role = 'user'"), F.col("session_id")
    rows = m.select("id", F.col("content").alias("symptom"), F.when(k % 3 == 0, "").when(k % 3 == 1, " worn ").alias("root_cause"), F.when(k % 2 == 0, "  ").otherwise(" replaced ").alias("actions"), F.when(k % 4 == 0, "turned").alias("operator_fix"))
    return C.fix_record(rows).select("id", "actions", F.array_join("errors", ",").alias("errors"))


@query(with_views("v_message", """SELECT session_id, right(string_agg(upper(role) || ': ' || content, chr(10) ORDER BY id), 300) AS conversation FROM v_message GROUP BY 1"""))
def conversation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last characters of each conversation, for a summary."""
    return C.conversation_text(view(spark, sf_dir, "v_message"), 300)


@query("""WITH s AS (SELECT doc_id, text, ['Stops', ' ', 'stops ', 'leak'] AS sy, CASE WHEN doc_id % 2 = 0 THEN ['pump', 'Leak cause troubleshooting'] END AS co, ['E' || CAST(doc_id % 7 AS VARCHAR), 'E1', 'E2', 'E3'] AS fa FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, list_concat([left(text, 50)], list_transform(list_filter(list_transform(sy, lambda x: trim(x)), lambda x: x <> ''), lambda x: x || ' cause troubleshooting'), coalesce(co, []), list_transform(fa[1:3], lambda x: 'fault code ' || x)) AS q FROM s)
SELECT doc_id, array_to_string(list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(y)), lower(x)) = i), '; ') AS queries FROM q""")
def report_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report is looked up with, from symptoms, components and codes that were read from it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    said = lambda *c: F.array(*map(F.lit, c))
    codes = F.array(F.concat(F.lit("E"), (F.col("doc_id") % 7).cast("string")), F.lit("E1"), F.lit("E2"), F.lit("E3"))
    asked = X.diagnosis_queries(F.left("text", F.lit(50)), said("Stops", " ", "stops ", "leak"), F.when(F.col("doc_id") % 2 == 0, said("pump", "Leak cause troubleshooting")), codes)
    return d.select("doc_id", F.array_join(asked, "; ").alias("queries"))


@query(with_views("v_message", """SELECT id, CASE WHEN id % 3 = 0 THEN 'Safety' END AS phase, trim(content || ' end') AS body FROM v_message WHERE role = 'agent' AND content = trim(content) AND content <> ''"""))
def shown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with phase, suggestion and question tags, as they are shown."""
    m = view(spark, sf_dir, "v_message").where("role = 'agent' AND content = trim(content) AND content <> ''")
    raw = F.concat(F.when(F.col("id") % 3 == 0, " [phase:  Safety ] ").otherwise(""), "content", F.lit(" end[SUGGESTION: steps?] [ASK: q | a]"))
    shown = X.shown_answer(raw)
    return m.select("id", shown["phase"].alias("phase"), shown["body"].alias("body"))


@query(with_views("v_message v_machine", """+s AS (SELECT DISTINCT session_id AS id, CASE WHEN session_id % 3 <> 0 THEN 'S1' END AS machine_id, CASE session_id % 4 WHEN 0 THEN 'learn' WHEN 1 THEN 'troubleshoot' END AS intent FROM v_message)
SELECT id AS session_id, machine_id IS NOT NULL AND coalesce(intent, '') <> 'learn' AND EXISTS (SELECT 1 FROM v_message m WHERE m.session_id = s.id AND m.role = 'agent') AS can_record FROM s"""))
def recordable_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "v_message")
    k = F.col("id")
    s = m.select(F.col("session_id").alias("id")).distinct()
    s = s.select("id", F.when(k % 3 != 0, "S1").alias("machine_id"), F.when(k % 4 == 0, "learn").when(k % 4 == 1, "troubleshoot").alias("intent"))
    return C.can_record_fix(s, m)


_UPLOADS = """SELECT 'N' || CAST(doc_id % 30 AS STRING) AS manual_id, CAST(1 + floor(doc_id / 30.0) % 3 AS BIGINT) AS upload_id, doc_id, text AS content,
  (doc_id % 30 + 1 + floor(doc_id / 30.0) % 3) % 4 <> 0 AS ended, floor(doc_id / 30.0) % 3 = 2 AND doc_id % 5 = 0 AS blank FROM {documents}"""


@query("WITH p AS (" + _UPLOADS.replace("STRING", "VARCHAR").replace("{documents}", "documents") + """),
l AS (SELECT manual_id, max(upload_id) FILTER (WHERE ended) AS upload_id FROM p GROUP BY 1)
SELECT p.manual_id, p.upload_id, doc_id, CAST(length(content) AS INT) AS n_chars FROM p JOIN l ON p.manual_id = l.manual_id AND p.upload_id = l.upload_id WHERE NOT blank""")
def live_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of thirty manuals, stored in two batches: of each manual the last upload that has ended; some of
    these hold no text, and some never end."""
    pages, path = spark.sql(_UPLOADS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet")), fresh(spark, "uploads")
    items = pages.where("NOT blank").select("manual_id", "upload_id", "doc_id", "content")
    for k in range(2):
        uploads.store(items.where(F.col("doc_id") % 2 == k), path, f"batch-{k}")
    uploads.finish(pages.where("ended"), path)
    return uploads.live(spark, path, "manual_id string, upload_id bigint, doc_id bigint, content string").select("manual_id", "upload_id", "doc_id", F.char_length("content").alias("n_chars"))


@query(with_views("v_message", """+t AS (SELECT 'sessions' AS kind, session_id AS id, session_id FROM v_message GROUP BY ALL UNION ALL SELECT 'messages', id, session_id FROM v_message
  UNION ALL SELECT 'memory', id, session_id FROM v_message WHERE role = 'agent') SELECT kind, id FROM t WHERE session_id % 3 <> 0"""))
def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation is deleted: what is left of sessions, messages and past fixes."""
    m = view(spark, sf_dir, "v_message")
    tables = {"sessions": m.select(F.col("session_id").alias("id")).distinct(), "messages": m.select("id", "session_id"), "memory": m.where("role = 'agent'").select("id", "session_id")}
    left = R.delete_sessions(tables, tables["sessions"].where("id % 3 = 0").select(F.col("id").alias("session_id")))
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), "id") for kind, df in left.items()))


@query("""WITH p AS (SELECT item_id, text, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM benchmark)
SELECT item_id, nullif(left(string_split(t, chr(10))[-1], 500), '') AS answer FROM p""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as prompts, asked in two runs of which the second finds the answers of the first."""
    items, folder = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), fresh(spark, "answers")
    A.ask(items.where("item_id % 2 = 0"), folder, "echo", "text")
    return A.ask(items.select("item_id", "text"), folder, "echo", "text").select("item_id", "answer")


@query("""SELECT 'N' || CAST(doc_id % 7 AS VARCHAR) AS manual_id, doc_id AS id, CAST(length(text) AS INT) AS n_chars FROM documents WHERE doc_id % 11 <> 0""")
def migrated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents moved in ranges of their ids, in two runs; some have no vector."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("'N' || CAST(doc_id % 7 AS STRING) AS manual_id", "doc_id AS id", "text", "CASE WHEN doc_id % 11 <> 0 THEN 'v' END AS embedding"), fresh(spark, "migration")
    low, high = docs.agg(F.min("id"), F.max("id") + 1).first()
    step = -(-(high - low) // 4)
    for most in (2, None):
        migrate(spark, lambda a, b: docs.where((F.col("id") >= a) & (F.col("id") < b)), path, low, high, step, most=most)
    uploads.finish(uploads.files(spark, path), path)
    return uploads.live(spark, path, "manual_id string, id bigint, text string").select("manual_id", "id", F.char_length("text").alias("n_chars"))
