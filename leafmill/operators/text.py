"""Text ingestion: fragments, running headers, sections, dedupe, chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import furniture_key, trimmed
from leafmill.sources.scratch import held

#: Separators of the recursive splitter, from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Characters of chunks after which a task gives them out.
SLICE = 1 << 20
#: Up to so many running lines are sent to all tasks; more meet the items in a join.
MAX_SENT = 1 << 16


def blocks(pages: DataFrame) -> DataFrame:
    """Non-empty trimmed lines of a page as text items, in order."""
    lines = pages.select("manual_id", "page", F.posexplode(F.split("content", "\n")).alias("seq", "content"))
    return lines.withColumn("content", trimmed(F.col("content"))).where("content <> ''")


def is_toc_entry(c: Column) -> Column:
    return (F.length(c) < 60) & (F.size(F.split(F.trim(c), r"\s+")) <= 6) & ~c.rlike(r"[.!?:]$")


def distinct_on_page(items: DataFrame) -> DataFrame:
    """The first item of each lower-cased content on a page."""
    w = Window.partitionBy("manual_id", "page", F.lower("content")).orderBy("seq")
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged_fragments(fragments: DataFrame, least: int = 3) -> DataFrame:
    """Three short fragments of a page or more become one ``Page contents:`` item.

    fragments(page_id, seq, content) -> page_id, seq, content.  A page's short fragments
    fit in one row; longer items never come here.
    """
    w = Window.partitionBy("page_id")
    counted = fragments.withColumn("n", F.count("*").over(w))
    single = counted.where(F.col("n") < least).select("page_id", "seq", "content")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " | ")
    many = counted.where(F.col("n") >= least).groupBy("page_id").agg(F.min("seq").alias("seq"), F.concat(F.lit("Page contents: "), joined).alias("content"))
    return single.unionByName(many)


def with_section(items: DataFrame, is_header: Column, default: str = "General Information") -> DataFrame:
    """The last header text longer than three characters applies to what follows, across pages."""
    w = Window.partitionBy("manual_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(is_header & (F.length("line") > 3), F.col("line")), ignorenulls=True).over(w)
    return items.withColumn("section", F.coalesce(title, F.lit(default)))


def furniture(lines: DataFrame, share: float = 0.30, least: int = 3) -> DataFrame:
    """(manual_id, key) of running headers and footers: digit-masked lines on enough pages."""
    pages = lines.groupBy("manual_id").agg(F.countDistinct("page").alias("n_pages"))
    keys = lines.select("manual_id", "page", furniture_key(F.col("line")).alias("key")).where("key <> '' AND key <> '#'").distinct()
    counted = keys.groupBy("manual_id", "key").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(least), F.floor(F.col("n_pages") * F.lit(share)))
    return counted.join(pages, "manual_id").where((F.col("n_pages") >= least) & (F.col("pages") >= need)).select("manual_id", "key", "pages")


def without_furniture(items: DataFrame, running: DataFrame) -> DataFrame:
    """Items(manual_id, item_id, content) of which something is neither furniture nor a page number.

    A manual has few running lines, each is on a share of its pages; they go to the items, which stay where they are."""
    running = held(running.select("manual_id", "key"))
    text = F.replace("content", F.lit("Page contents:"), F.lit(""))
    if running.count() <= MAX_SENT:
        per = running.groupBy("manual_id").agg(F.collect_set("key").alias("__running"))
        both = items.join(F.broadcast(per), "manual_id", "left")
        keys = F.transform(F.filter(F.split(text, r"\n| \| "), lambda p: trimmed(p) != ""), furniture_key)
        real = F.exists(keys, lambda k: ~F.coalesce(F.array_contains("__running", k), F.lit(False)) & ~k.rlike("^#+$"))
        return both.where((trimmed(F.coalesce(text, F.lit(""))) == "") | real).select(items.columns)
    pieces = items.select("manual_id", "item_id", F.explode(F.split(text, r"\n| \| ")).alias("piece"))
    pieces = pieces.where(trimmed(F.col("piece")) != "").withColumn("key", furniture_key(F.col("piece")))
    real = pieces.join(running, ["manual_id", "key"], "left_anti").where(~F.col("key").rlike("^#+$")).select("manual_id", "item_id").distinct()
    blank = items.where(trimmed(F.coalesce(text, F.lit(""))) == "").select("manual_id", "item_id")
    return items.join(real.unionByName(blank), ["manual_id", "item_id"], "left_semi")


def split_text(text: str, size: int = 800, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character splitting: the coarsest separator that occurs cuts the text and
    stays at the start of the next piece; pieces are merged up to ``size`` with overlap;
    what is still too long is cut by the finer separators."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    if sep:
        first, *more = text.split(sep)
        pieces = [p for p in [first, *(sep + m for m in more)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            held: list[str] = []
            total = 0
            for p in run:
                if total + len(p) > size and held:
                    if joined := "".join(held).strip():
                        out.append(joined)
                    while held and (total > overlap or total + len(p) > size):
                        total -= len(held.pop(0))
                held.append(p)
                total += len(p)
            if joined := "".join(held).strip():
                out.append(joined)
            run.clear()

    for p in pieces:
        if len(p) < size:
            run.append(p)
        else:
            flush()
            if finer:
                out.extend(split_text(p, size, overlap, finer))
            elif p.strip():
                out.append(p.strip())
    flush()
    return out


def chunked(items: DataFrame, size: int = 800, overlap: int = 100, keep: tuple[str, ...] = ("manual_id", "page", "doc_id")) -> DataFrame:
    """items(<keep>, content) -> the columns ``keep``, chunk_no and content, one row a chunk; one Arrow pass, no shuffle.

    Chunks are given out as soon as they have SLICE characters, so a task holds few texts beside its batch, however many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(b: pa.RecordBatch, row: list[int], no: list[int], chunks: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row, pa.int64())) for k in range(len(keep))), pa.array(no, pa.int32()), pa.array(chunks, pa.string())], [*keep, "chunk_no", "content"])

        for b in batches:
            row, no, chunks, weight = [], [], [], 0
            for i in range(b.num_rows):
                parts = split_text(b.column(len(keep))[i].as_py() or "", size, overlap)
                row += [i] * len(parts)
                no += range(len(parts))
                chunks += parts
                weight += sum(map(len, parts))
                if weight >= SLICE:
                    yield given(b, row, no, chunks)
                    row, no, chunks, weight = [], [], [], 0
            if row:
                yield given(b, row, no, chunks)

    schema = items.select(*keep).schema.add("chunk_no", "integer").add("content", "string")
    return items.select(*keep, "content").mapInArrow(run, schema)


def chunk_rows(items: DataFrame) -> DataFrame:
    """Parts and images pass as they are, one chunk each: an image without a caption has an empty one, and
    counts as a full view unless it says otherwise.  items(type, content, figure_role, ...)."""
    image = F.col("type") == "image"
    return items.where(F.col("type").isin("part", "image")).withColumns({
        "content": F.when(image, F.coalesce("content", F.lit(""))).otherwise(F.col("content")),
        "figure_role": F.when(image, F.coalesce("figure_role", F.lit("full"))).otherwise(F.col("figure_role")),
    })


def raw_corpus(chunks: DataFrame) -> DataFrame:
    """What callouts are looked up in: texts and tables with content, as they were before enrichment."""
    return chunks.where(F.col("type").isin("text", "table") & (F.coalesce("content", F.lit("")) != "")).select("chunk_id", "manual_id", "page", "type", "content")


def to_embed(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with content, and how many of each manual have none: (rows, manual_id + empty)."""
    filled = F.coalesce(F.length("content"), F.lit(0)) > 0
    return chunks.where(filled), chunks.groupBy("manual_id").agg(F.count_if(~filled).alias("empty"))
