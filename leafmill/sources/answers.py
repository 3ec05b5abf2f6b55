"""Model calls whose results are kept by content: what was answered once is not asked again.

An answer's address is the digest of its kind and its prompt.  Of a table of prompts each distinct address is looked up in the folder
of answers, and only unknown ones go to the provider, in requests of a few prompts; a request that fails, or a prompt that gets no answer,
is tried again by itself, with longer and longer waits.  What still fails is not kept: it has no answer now, and is asked again in the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.models import Offline, Provider, tolerant_json_column

SIZE, TRIES, WAIT = 16, 3, 0.2
_KEPT = "digest string, kind string, answer string"


def address(kind: str, prompt: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}\x00"), F.coalesce(prompt, F.lit(""))).cast("binary"), 256)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """digest, kind, answer of all that was ever answered; of answers that two runs gave at once the least counts."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _KEPT)
    return spark.read.schema(_KEPT).parquet(folder).groupBy("digest").agg(F.min("kind").alias("kind"), F.min("answer").alias("answer"))


def _calls(provider: Callable[[], Provider], size: int, tries: int, wait: float):
    def alone(p: Provider, prompt: str) -> str | None:
        for k in range(tries):
            try:
                if (said := p.chat([prompt])[0]) is not None:
                    return said
            except Exception:  # noqa: BLE001  the next try, or no answer
                pass
            if k + 1 < tries:
                time.sleep(wait * 2**k)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = provider()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                prompts = part.column(2).to_pylist()
                try:
                    said = list(p.chat(prompts))
                    said += [None] * (len(prompts) - len(said))
                except Exception:  # noqa: BLE001  one bad prompt must not take the others with it
                    said = [None] * len(prompts)
                said = [alone(p, q) if s is None else s for q, s in zip(prompts, said)]
                good = [i for i, s in enumerate(said) if s is not None]
                some = part.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([said[i] for i in good], pa.string())], ["digest", "kind", "answer"])

    return run


def ask(rows: DataFrame, folder: str, kind: str, prompt: str = "prompt", provider: Callable[[], Provider] = Offline, size: int = SIZE, tries: int = TRIES, wait: float = WAIT, tasks: int = 8) -> DataFrame:
    """``rows`` with ``answer`` (NULL: the call failed, or the prompt is NULL or blank); new answers are kept in ``folder``.

    kind: what is asked of the prompt, such as the model and its instruction; part of the address.  tasks: calls at once."""
    if "answer" in rows.columns:
        raise ValueError("rename the column answer")
    spark = rows.sparkSession
    asked = rows.select(F.col(prompt).alias("prompt")).where(F.trim("prompt") != "").distinct()
    asked = asked.select(address(kind, F.col("prompt")).alias("digest"), F.lit(kind).alias("kind"), "prompt")
    unknown = asked.join(kept(spark, folder).select("digest"), "digest", "left_anti")
    # by digest, so that a few slow prompts don't meet in one task
    new = unknown.repartition(tasks, "digest").mapInArrow(_calls(provider, size, tries, wait), _KEPT)
    new.write.mode("append").parquet(folder)  # committed as a whole: a task that runs again writes once
    known = kept(spark, folder).select(F.col("digest").alias("_digest"), "answer")
    found = rows.join(known, F.when(F.trim(F.col(prompt)) != "", address(kind, F.col(prompt))) == F.col("_digest"), "left")
    return found.select(*rows.columns, "answer")


def ask_json(rows: DataFrame, folder: str, kind: str, schema: str, prompt: str = "prompt", **more) -> DataFrame:
    """As ``ask``, with the answer as a struct of ``schema``: what can be read of it, NULL if nothing can."""
    return ask(rows, folder, kind, prompt, **more).withColumn("answer", F.from_json(tolerant_json_column(F.col("answer")), schema))
