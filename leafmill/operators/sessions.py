"""Chat sessions: first and latest messages, history windows, reports, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import tail


def first_and_last(messages: DataFrame) -> DataFrame:
    """The first user message (the topic) and the latest agent message of each session, by id."""
    return messages.groupBy("session_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("id"))).alias("topic"),
        F.max_by(F.when(F.col("role") == "agent", F.col("content")), F.when(F.col("role") == "agent", F.col("id"))).alias("latest"),
    )


def prior_turns(messages: DataFrame, n: int = 10) -> DataFrame:
    """The n turns before the newest one of each session; ``back`` is 2 for the latest of them."""
    w = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back").between(2, n + 1))


def history_text(turns: DataFrame) -> DataFrame:
    """``ROLE: content`` lines in order; at most the few turns of a window are gathered."""
    said = F.struct("id", F.concat(F.upper("role"), F.lit(": "), "content").alias("line"))
    return turns.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["line"]), "\n").alias("history"))


def report_images(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct images of a session in order of first appearance, with captions.

    messages(session_id, id, images ARRAY<STRING>).
    """
    flat = messages.select("session_id", "id", F.posexplode("images").alias("pos", "image"))
    first = flat.groupBy("session_id", "image").agg(F.min(F.struct("id", "pos")).alias("at"))
    w = Window.partitionBy("session_id").orderBy("at")
    numbered = first.withColumn("n", F.row_number().over(w)).select("session_id", "n", "image", F.concat(F.lit("Figure "), F.col("n").cast("string")).alias("caption"))
    return numbered if limit is None else numbered.where(F.col("n") <= limit)


def anchored_query(topic: Column, query: Column, wizard: Column) -> Column:
    """Wizard turns search with the topic in front, when it differs from the answer."""
    return F.when(wizard & topic.isNotNull() & (F.trim(topic) != F.trim(query)), F.concat(F.trim(topic), F.lit(". "), query)).otherwise(query)


#: What a record of a fix must have.
REQUIRED = ("engineer", "root_cause", "actions", "method")


def fix_record(df: DataFrame) -> DataFrame:
    """Trimmed fields, actions falling back to the operator's fix, and ``errors``: the required fields that are
    blank.  No row is dropped; a record without actions can't be stored."""
    clean = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("symptom", "engineer", "root_cause", "actions", "operator_fix", "method", "parts_replaced") if c in df.columns}
    out = df.withColumns(clean).withColumn("actions", F.coalesce(F.nullif("actions", F.lit("")), F.nullif("operator_fix", F.lit(""))))
    missing = [F.when(F.coalesce(c, F.lit("")) == "", F.lit(c)) for c in REQUIRED if c in df.columns]
    return out.withColumn("errors", F.array_compact(F.array(*missing)))


def conversation_text(messages: DataFrame, most: int | None = None) -> DataFrame:
    """session_id, conversation: all messages as ``ROLE: content`` lines, or the last ``most`` characters of them."""
    text = history_text(messages).withColumnRenamed("history", "conversation")
    return text if most is None else text.withColumn("conversation", tail(F.col("conversation"), most))


def can_record_fix(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, can_record: a session on a machine that isn't for learning and that has been answered."""
    answered = messages.where("role = 'agent'").select(F.col("session_id").alias("id")).distinct().withColumn("answered", F.lit(True))
    ok = (F.coalesce("machine_id", F.lit("")) != "") & (F.coalesce("intent", F.lit("")) != "learn") & F.coalesce("answered", F.lit(False))
    return sessions.join(answered, "id", "left").select(F.col("id").alias("session_id"), ok.alias("can_record"))


def first_incident(incidents: DataFrame) -> DataFrame:
    """Of the past fixes shown with an answer, the best: incidents(answer_id, pos, ...)."""
    w = Window.partitionBy("answer_id").orderBy("pos")
    return incidents.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def as_attachments(images: Column) -> Column:
    """Images of an older message as attachments: {tag, title, url}."""
    return F.transform(images, lambda u, i: F.struct(F.concat(F.lit("IMAGE_"), i.cast("string")).alias("tag"), F.concat(F.lit("Figure "), (i + 1).cast("string")).alias("title"), u.alias("url")))


def cited_pages(hits: DataFrame) -> DataFrame:
    """query_id, pages: the distinct pages of an answer's hits, ascending; unknown ones don't count."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def segments(answers: DataFrame) -> DataFrame:
    """Pieces of an answer: texts and assets in order, each asset once, unknown tags
    dropped, assets that the text does not name at the end.

    answers(answer_id, answer, tags ARRAY<STRING>) -> answer_id, seq, kind, value.
    """
    marked = F.regexp_replace("answer", r"(\[(?:IMAGE|TABLE)_\d+\])", "\x01$1\x01")
    pieces = answers.select("answer_id", "tags", F.posexplode(F.split(marked, "\x01")).alias("pos", "piece"))
    is_tag = F.col("piece").rlike(r"^\[(IMAGE|TABLE)_\d+\]$")
    name = F.regexp_replace("piece", r"[\[\]]", "")
    rows = pieces.select("answer_id", "pos", is_tag.alias("is_tag"), F.when(is_tag, name).otherwise(F.trim("piece")).alias("value"), F.array_contains("tags", name).alias("known"))
    rows = rows.where("(is_tag AND known) OR (NOT is_tag AND value <> '')")
    once = Window.partitionBy("answer_id", "is_tag", F.when(F.col("is_tag"), F.col("value")).otherwise(F.col("pos").cast("string"))).orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1").select("answer_id", "pos", F.when(F.col("is_tag"), "asset").otherwise("text").alias("kind"), "value")
    unnamed = answers.select("answer_id", F.posexplode("tags").alias("pos", "value")).join(rows.where("kind = 'asset'").select("answer_id", "value"), ["answer_id", "value"], "left_anti")
    both = rows.withColumn("late", F.lit(0)).unionByName(unnamed.select("answer_id", "pos", F.lit("asset").alias("kind"), "value", F.lit(1).alias("late")))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("answer_id").orderBy("late", "pos"))).drop("pos", "late")
