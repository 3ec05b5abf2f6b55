"""Reading documents and keeping tables: Parquet folders, changed by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill import schema
from leafmill.operators import registry


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files as pages: form feeds separate them; page numbers start at 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    pages = whole.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("manual_id"), F.posexplode(F.split("value", "\f")).alias("page", "content"))
    return pages.withColumn("page", F.col("page") + 1)


def uploads(spark: SparkSession, path: str, suffix: str = ".pdf", most_bytes: int | None = None) -> DataFrame:
    """Files of one suffix with their bytes and their manual_id, the name of the folder they lie in;
    empty and oversized files and folders with a blank name are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(suffix) & (F.col("length") > 0))
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    files = files.withColumn("manual_id", F.trim(F.regexp_replace(folder, "%20", " "))).where("manual_id <> ''")
    return files if most_bytes is None else files.where(F.col("length") <= most_bytes)


class Table:
    """A keyed table in a folder, merged when it is read.

    A change writes only its own rows, as a delta beside what is there: new rows, or the keys of deleted ones.
    Reading takes the last whole version and, of each key, the last row of the deltas after it; after
    ``most`` deltas a change is followed by a new whole version.  A version counts when it is complete."""

    def __init__(self, spark: SparkSession, root: str, ddl: str, key: str, most: int = 16):
        self.spark, self.root, self.schema, self.key, self.most = spark, root.rstrip("/"), schema.struct(ddl), key, most
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("v"))

    def _done(self) -> list[str]:
        return [n for n in self._names() if self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS"))]

    def _live(self) -> list[str]:
        """The last whole version, if there is one, and the deltas after it."""
        done = self._done()
        whole = max((k for k, n in enumerate(done) if "-whole-" in n), default=0)
        return done[whole:]

    def read(self) -> DataFrame:
        """Columns that older rows lack are NULL."""
        live = self._live()
        load = lambda n, s: self.spark.read.schema(s).parquet(f"{self.root}/{n}")
        if not live:
            return self.spark.createDataFrame([], self.schema)
        if len(live) == 1 and "-whole-" in live[0]:
            return load(live[0], self.schema)
        wide = T.StructType([*self.schema.fields, T.StructField("__gone", T.BooleanType())])
        rows = None
        for number, name in enumerate(live):
            part = load(name, wide).withColumn("__v", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "__v").alias("r")).select("r.*")
        return last.where(~F.coalesce("__gone", F.lit(False))).select(self.schema.names)

    def _write(self, df: DataFrame, kind: str) -> None:
        done = self._names()
        number = int(done[-1][1:].split("-")[0]) + 1 if done else 0
        have = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        extra = ["__gone"] if "__gone" in df.columns else []
        df.select(*have, *extra).write.parquet(f"{self.root}/v{number:08d}-{kind}-{uuid.uuid4().hex[:8]}")

    def write(self, df: DataFrame) -> None:
        """The whole table anew."""
        self._write(df, "whole")

    def _change(self, delta: DataFrame) -> None:
        self._write(delta, "delta")
        if len(self._live()) > self.most:
            self.write(self.read())

    def upsert(self, rows: DataFrame) -> None:
        """Rows with a key that is there replace it; of rows with one key the last by all columns stays.

        Without the key column every row is new."""
        rows = registry.last_of(rows, self.key) if self.key in rows.columns else rows.withColumn(self.key, F.expr("uuid()"))
        self._change(rows.withColumn("__gone", F.lit(False)))

    def delete(self, condition) -> int:
        """Rows for which the condition holds go; gives how many there were."""
        gone = self.read().where(condition).select(self.key)
        n = gone.count()
        if n:
            self._change(gone.withColumn("__gone", F.lit(True)))
        return n

    def count(self, condition=None) -> int:
        return (self.read() if condition is None else self.read().where(condition)).count()

    def vacuum(self) -> int:
        """Deletes what lies before the last whole version; gives how many versions these were."""
        live = self._live()
        old = [n for n in self._names() if live and n < live[0]]
        for n in old:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(old)


def conditions(must: dict | None = None, must_not: dict | None = None, arrays: tuple[str, ...] = ()):
    """One Column from payload conditions: a value must be equal, a list must hold it; a field named in
    ``arrays`` holds a list itself and must overlap.  Empty arguments set no condition; a missing field
    passes ``must_not``."""
    out = F.lit(True)
    for wanted, fields in ((True, must or {}), (False, must_not or {})):
        for name, value in fields.items():
            if value in (None, "", [], ()):
                continue
            several = list(value) if isinstance(value, (list, tuple)) else [value]
            c = F.arrays_overlap(name, F.array(*map(F.lit, several))) if name in arrays else F.col(name).isin(*several)
            out &= F.coalesce(c, F.lit(False)) if wanted else ~F.coalesce(c, F.lit(False))
    return out


def payload(chunks: DataFrame) -> DataFrame:
    """The fields of a hit: all that are declared, NULL where an older row lacks one, no part numbers as an empty list."""
    kinds = {f.name: f.dataType for f in schema.struct(schema.CHUNKS) if f.name != "embedding"}
    have = [F.col(n).cast(t).alias(n) if n in chunks.columns else F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
    return chunks.select(*have).withColumn("part_numbers", F.coalesce("part_numbers", F.array().cast("array<string>")))
