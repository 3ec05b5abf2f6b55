"""Registries of manuals and machines, chunk counts, and keyed changes to stored tables.

A change reads tables and gives new ones; ``sources.store`` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifiers that stand for nothing.
PLACEHOLDERS = ("", "null", "undefined", "none", "nan")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks of each manual; rows without a manual are not counted."""
    return chunks.where("manual_id <> ''").groupBy("manual_id").agg(F.count("*").alias("n_chunks"))


def manual_listing(manuals: DataFrame, chunks: DataFrame) -> DataFrame:
    """All manuals with their counts; ids that only chunks know are listed too."""
    return manuals.join(chunk_counts(chunks), "manual_id", "full_outer").select(
        "manual_id", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lower("manual_id").alias("sort_key")
    )


def machine_listing(machines: DataFrame, chunks: DataFrame) -> DataFrame:
    counted = machines.join(chunk_counts(chunks), "manual_id", "left")
    return counted.select("machine_id", "name", "manual_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def resolved_manual(requests: DataFrame, machines: DataFrame) -> DataFrame:
    """The explicit manual if it is not blank, else that of the machine, else NULL."""
    known = machines.select("machine_id", F.col("manual_id").alias("of_machine"))
    return requests.join(known, "machine_id", "left").withColumn("resolved", F.coalesce(F.nullif(F.trim("manual_id"), F.lit("")), "of_machine"))


def orphaned(machines: DataFrame, deleted: DataFrame) -> DataFrame:
    """Machines whose manual was deleted; they are kept and reported."""
    return machines.join(deleted.select("manual_id").distinct(), "manual_id", "left_semi")


def usable_id(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*PLACEHOLDERS)


def last_of(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the one with the greatest ``order``; without an order, and between equal
    orders, the greatest by all columns, so that a repeated run gives the same rows."""
    rank = F.struct(*([order] if order else []), *[c for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), rank).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; columns may be missing on either side.

    A key that comes several times in ``new`` leaves its last row (see ``last_of``)."""
    new = last_of(new, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_machines(machines: DataFrame, payload: DataFrame, order: str | None = None) -> DataFrame:
    """Inserts or overwrites machines; ids are stored trimmed, placeholders are refused."""
    clean = payload.withColumns({c: F.trim(c) for c in ("machine_id", "manual_id")})
    usable = clean.where(usable_id(F.col("machine_id")) & usable_id(F.col("manual_id")))
    rows = last_of(usable, "machine_id", order)
    return upsert(machines, rows.drop(order) if order and order not in machines.columns else rows, "machine_id")


def delete_machine(machines: DataFrame, machine_id: str) -> DataFrame:
    """The machines without this one; an unknown id is an error."""
    if machines.where(F.col("machine_id") == machine_id).isEmpty():
        raise LookupError(f"404: {machine_id}")
    return machines.where(~F.col("machine_id").eqNullSafe(machine_id))


def rename_manual(tables: dict[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    """chunks, machines and manuals with the new id; sessions and memory keep the old one.

    Nothing happens for equal ids; a taken new id and an unknown old one are errors.
    """
    if old == new:
        return tables
    has = lambda name, i: not tables[name].where(F.col("manual_id") == i).isEmpty()
    if has("manuals", new) or has("chunks", new):
        raise ValueError(f"409: {new} exists")
    if not (has("manuals", old) or has("chunks", old)):
        raise LookupError(f"404: {old}")
    changed = F.when(F.col("manual_id") == old, new).otherwise(F.col("manual_id"))
    return tables | {n: tables[n].withColumn("manual_id", changed) for n in ("chunks", "machines", "manuals")}


def delete_manual(tables: dict[str, DataFrame], manual_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the manual and its chunks, and the machines that it leaves behind.

    An id that neither table knows is an error."""
    gone = F.col("manual_id").eqNullSafe(manual_id)
    if tables["manuals"].where(gone).isEmpty() and tables["chunks"].where(gone).isEmpty():
        raise LookupError(f"404: {manual_id}")
    left = {n: tables[n].where(~gone) for n in ("chunks", "manuals")}
    return tables | left, tables["machines"].where(gone)


def sessions_by_update(sessions: DataFrame) -> DataFrame:
    """Sessions of each machine, the one changed last first; ``place`` keeps the order through shuffles."""
    newest = Window.partitionBy("machine_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("id"))
    return sessions.withColumn("place", F.row_number().over(newest))


def delete_sessions(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """memory, messages and sessions without those of ``ids(session_id)``."""
    drop = lambda df, c: df.join(ids.select(F.col("session_id").alias(c)), c, "left_anti")
    return tables | {"memory": drop(tables["memory"], "session_id"), "messages": drop(tables["messages"], "session_id"), "sessions": drop(tables["sessions"], "id")}
