"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only (operator 4).

A document holds a benchmark item if somewhere, word by word and without shifts, at
least ``SHARE`` of ``WINDOW`` consecutive words of the item (all of its words, if it
has fewer) stand in the document at their places; so single words may be replaced.

Candidates come from four fixed masks over five word positions.  A mask looks at four
of them, so a replaced word at the ignored place does not matter.  Whatever the
replaced words of a window are, as long as SHARE of it holds, one mask hits (the tests
try all patterns).  Document and item positions with equal masked hashes are joined and
give (document, item, shift); the shift is then verified word by word.

Words that occur in no item cannot be part of a hit, so a document's other words are
dropped before anything is hashed or joined; the list of the items' words is used for
that only while it has at most ``MAX_VOCABULARY`` words.  The table of item seeds, of a
fixed width, is broadcast only while it has at most ``MAX_BROADCAST`` rows, that of the
items' words while they have at most ``MAX_BYTES``; beyond that both are joined by a shuffle.

Words are runs of letters and digits in lower case.  Items of fewer than MIN_WORDS
words are no evidence of anything and match nothing.

Defined cases: null or empty texts have no words and match nothing; repeated documents
or items give one row for each distinct pair of ids, a null id being one of them; of shifts
with equally many words the least counts; very long texts are used whole; an empty table on
either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, free_name, written

WINDOW, SHARE, MIN_WORDS = 20, 0.8, 5
#: Positions that a mask looks at; the first word always counts.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
MAX_VOCABULARY, MAX_BROADCAST, MAX_BYTES = 100_000, 500_000, 16 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def needed(n: int) -> int:
    """Words that must hold of a window of n: the least integer not below SHARE * n."""
    return -(-n * int(SHARE * 100) // 100)


def _spots(numbers: Column, least: int = 3) -> Column:
    """(position, w0..w4) where a mask could hit: w0 and three of the next four are there."""

    def spot(x: Column, i: Column) -> Column:
        after = [F.get(numbers, i + k) for k in range(1, 5)]
        there = sum((a.isNotNull().cast("int") for a in after[1:]), after[0].isNotNull().cast("int"))
        return F.when(x.isNotNull() & (there >= least), F.struct(i.alias("pos"), x.alias("w0"), *(a.alias(f"w{k + 1}") for k, a in enumerate(after))))

    return F.filter(F.transform(numbers, spot), lambda s: s.isNotNull())


def _seeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, seed) from rows (keys, numbers)."""
    spots = rows.select(*keys, F.explode(_spots(F.col("numbers"))).alias("s")).select(*keys, "s.*")
    hashes = []
    for number, mask in enumerate(MASKS):
        looked = [F.col(f"w{k}") for k in mask]
        whole = looked[0].isNotNull()
        for w in looked[1:]:
            whole &= w.isNotNull()
        hashes.append(F.when(whole, F.xxhash64(F.lit(number), *looked)))
    return spots.select(*keys, "pos", F.explode(F.array(*hashes)).alias("seed")).where("seed IS NOT NULL")


def _numbers(vocabulary: list[str] | None) -> Column:
    """Hashes of words; NULL for words of no item.  Words hold only letters and digits."""
    if vocabulary is None:
        return F.transform("words", lambda w: F.xxhash64(w))
    listed = ",".join(f"'{w}'" for w in vocabulary)
    return F.expr(f"transform(words, w -> IF(w IN ({listed}), xxhash64(w), NULL))")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, item_words,
    matched_words (at the best shift) and shift (position of the item's first word)."""
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, item_words int, matched_words int, shift int")
    tests = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") >= MIN_WORDS).distinct()
    tests = written(tests.withColumn("numbers", F.transform("words", lambda w: F.xxhash64(w))), "items")
    distinct = tests.select(F.explode("words").alias("w")).distinct()
    found = [r.w for r in distinct.limit(MAX_VOCABULARY + 1).collect()]
    if not found:
        dropped(tests)
        return empty
    vocabulary = sorted(found) if len(found) <= MAX_VOCABULARY else None

    seeds = _seeds(tests.select("item_id", F.size("words").alias("n"), "numbers"), ["item_id", "n"]).distinct()
    marks = stored = written(seeds.withColumnRenamed("pos", "at"), "item-seeds")
    if marks.count() <= MAX_BROADCAST:
        marks = F.broadcast(marks)
    numbered = docs.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", _numbers(vocabulary).alias("numbers"))
    hits = _seeds(numbered, ["doc_id"]).join(marks, "seed")
    pairs = written(hits.select("doc_id", "item_id", "n", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "candidates")

    per_doc = pairs.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("at"))
    texts = docs.select("doc_id", "text").join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")))
    # only the stretch of each shift goes on to the join with the item's words, which are compared as words
    stretch = texts.select("doc_id", words(F.col("text")).alias("have"), F.explode("at").alias("a")).select(
        "doc_id", "a.item_id", "a.n", "a.shift", F.slice("have", F.greatest(F.col("a.shift"), F.lit(0)) + 1, F.col("a.n")).alias("have")
    )
    wanted = tests.select(F.col("item_id").alias("item"), F.size("words").alias("size"), F.col("words").alias("want"))
    if (tests.agg(F.sum(F.octet_length(F.array_join("words", " ")))).first()[0] or 0) <= MAX_BYTES:
        wanted = F.broadcast(wanted)
    both = stretch.join(wanted, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("n") == F.col("size"))).drop("item", "size")
    skip = F.greatest(-F.col("shift"), F.lit(0))  # item words before the document's first
    both = both.withColumn("holds", F.transform("want", lambda x, i: F.coalesce(F.get("have", i - skip) == x, F.lit(False)).cast("int")))
    both = both.withColumn("matched", F.aggregate("holds", F.lit(0), lambda a, x: a + x))
    both = both.withColumn("size", F.least("n", F.lit(WINDOW)))
    both = both.withColumn("need", F.ceil(F.col("size") * int(SHARE * 100) / F.lit(100.0)).cast("int")).where("matched >= need")
    good = F.exists(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda s: F.aggregate(F.slice("holds", s + 1, F.col("size")), F.lit(0), lambda a, x: a + x) >= F.col("need"))
    best = both.where(good).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("shift")).alias("less"), "n")).alias("b"))
    result = written(best.select("doc_id", "item_id", F.col("b.n").alias("item_words"), F.col("b.matched").alias("matched_words"), (-F.col("b.less")).alias("shift")), "contaminated")
    dropped(tests, stored, pairs)
    return result


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    name = free_name("bad", docs.columns)
    bad = contaminated(docs, items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
