"""Which parts list explains which figure, as set joins between groups of lists and figures.

A figure meets the lists of its page band (near), of its drawing sets (kin), and of both.  Each of these is a
group: a key that figures and lists share, with the points that it is worth.  In a group of few lists each figure is compared
with each list, which is linear in the figures.  Within a larger group lists of equal refs
are one set (the least list_id speaks for it), figures of equal callouts are one question, so copies cost nothing.
A question meets a set only through its rarest callouts: of n callouts, k of which must be covered, any n - k + 1
have one that the set holds.  Titles meet pages through their rarest run of letters.  Only the best answer of a
question goes back to its figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import title_key
from leafmill.operators.parts import _natural
from leafmill.sources.scratch import held

#: Letters of the runs by which titles and pages meet; a shorter title is a run of its own.
RUN = 6

#: A group of at most so many lists is small.
FEW = 32

#: Up to so many large groups are sent to all tasks; more meet their rows in a join.
MAX_SENT = 1 << 16

#: Kinds of groups.
NEAR, KIN, BOTH = 0, 1, 2


def _set(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())))


def _group(kind: int, page: Column, family: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col("manual_id").alias("manual_id"), page.cast("bigint").alias("page"), family.alias("family"))


def figure_groups(figures: DataFrame, band: int = 2) -> DataFrame:
    """figure_id, g, turn, callouts, manual_id, print: a row for each group in which a figure looks for its list.

    Lists on the figure's page come first, then the next pages and the ones before (``turn``), then those of a shared drawing set.
    Figures without callouts count only if they are exploded views.  print: digest of the page's text, as titles see it."""
    none, nowhere = F.lit(""), F.lit(0)
    steps = sorted(range(-band, band + 1), key=lambda d: (d < 0, abs(d)))
    shown = figures.where(F.col("manual_id").isNotNull()).withColumns({"callouts": _set("callouts"), "families": _set("families")}).where((F.size("callouts") > 0) | (F.col("layout") == "exploded_parts"))
    at = lambda g, turn: F.struct(g.alias("g"), F.lit(turn).alias("turn"))
    pages = [(turn, F.col("page") + d) for turn, d in enumerate(steps)]
    near = F.when(F.col("page").isNotNull(), F.array(*(at(_group(NEAR, p, none), turn) for turn, p in pages)))
    kin = F.transform("families", lambda f: at(_group(KIN, nowhere, f), len(steps)))
    both = F.when(F.col("page").isNotNull(), F.flatten(F.transform("families", lambda f: F.array(*(at(_group(BOTH, p, f), turn) for turn, p in pages)))))
    empty = F.filter(kin, lambda _: F.lit(False))
    rows = shown.withColumn("at", F.concat(F.coalesce(near, empty), kin, F.coalesce(both, empty)))
    return rows.select("figure_id", "manual_id", "callouts", F.xxhash64(title_key(F.col("page_text"))).alias("print"), F.explode("at").alias("at")).select("figure_id", "at.g", "at.turn", "callouts", "manual_id", "print")


def list_groups(lists: DataFrame) -> DataFrame:
    """list_id, g, refs, titles: a row for each group that a list belongs to."""
    none, nowhere = F.lit(""), F.lit(0)
    known = lists.where(F.col("manual_id").isNotNull()).withColumns({"refs": _set("refs"), "families": _set("families"), "titles": titles_of(F.col("title"), F.col("subtitle"))})
    kin = F.transform("families", lambda f: _group(KIN, nowhere, f))
    near = F.when(F.col("page").isNotNull(), F.concat(F.array(_group(NEAR, F.col("page"), none)), F.transform("families", lambda f: _group(BOTH, F.col("page"), f))))
    return known.select("list_id", "refs", "titles", F.explode(F.concat(kin, F.coalesce(near, F.filter(kin, lambda _: F.lit(False))))).alias("g"))


def titles_of(*columns: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*map(title_key, columns)), lambda t: F.coalesce(t, F.lit("")) != ""))


def _runs(text: Column, size: Column) -> Column:
    """All distinct runs of ``size`` letters."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, size))))


def printed_titles(figures: DataFrame, lists: DataFrame) -> DataFrame:
    """manual_id, print, title: which titles of a manual's lists are printed on which pages of its figures.

    A title is looked for only on pages that have its rarest run of RUN letters; then the whole title must be there."""
    titles = lists.where(F.col("manual_id").isNotNull()).select("manual_id", F.explode(titles_of(F.col("title"), F.col("subtitle"))).alias("title")).distinct()
    titles = titles.withColumn("size", F.least(F.length("title"), F.lit(RUN)))
    runs = titles.select("manual_id", "title", "size", F.explode(_runs(F.col("title"), F.col("size"))).alias("run"))
    often = runs.groupBy("manual_id", "run").agg(F.count("*").alias("n"))
    keyed = runs.join(often, ["manual_id", "run"]).groupBy("manual_id", "title", "size").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    sizes = sorted(r["size"] for r in titles.select("size").distinct().collect())  # at most RUN of them
    pages = figures.where(F.col("manual_id").isNotNull()).select("manual_id", title_key(F.col("page_text")).alias("text")).where(F.col("text") != "").distinct().withColumn("print", F.xxhash64("text"))
    held = F.flatten(F.array_compact(F.array(F.array().cast("array<string>"), *(_runs(F.col("text"), F.lit(k)) for k in sizes))))
    met = pages.select("manual_id", "print", F.explode(held).alias("run")).join(keyed, ["manual_id", "run"]).select("manual_id", "print", "title")
    return met.join(pages, ["manual_id", "print"]).where(F.contains("text", "title")).select("manual_id", "print", "title")


def needed(n: Column, share: float) -> Column:
    """The fewest of n callouts that are a share of them; never too many by rounding."""
    return F.greatest(F.ceil(n * share - 1e-9), F.lit(1))


def rarest(questions: DataFrame, sets: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys, callouts, ref: the callouts by which a question looks for sets that cover ``share`` of it."""
    often = sets.select(*keys, F.explode("refs").alias("ref")).groupBy(*keys, "ref").agg(F.count("*").alias("often"))
    each = questions.select(*keys, "callouts", F.explode("callouts").alias("ref")).join(often, [*keys, "ref"], "left")
    order = Window.partitionBy(*keys, "callouts").orderBy(F.coalesce("often", F.lit(0)), "ref")
    n = F.size("callouts")
    return each.withColumn("place", F.row_number().over(order)).where((F.col("place") <= n - needed(n, share) + 1) & F.col("often").isNotNull()).select(*keys, "callouts", "ref")


def candidates(questions: DataFrame, sets: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys, callouts, refs, list_id, coverage: sets that hold one of a question's rarest callouts and cover ``share`` of it."""
    posted = sets.select(*keys, "refs", "list_id", F.explode("refs").alias("ref"))
    met = rarest(questions, sets, keys, share).join(posted, [*keys, "ref"])
    return met.withColumn("coverage", F.size(F.array_intersect("callouts", "refs")) / F.size("callouts")).where(F.col("coverage") >= share).drop("ref")


def best_covering(questions: DataFrame, sets: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys, callouts and the set that covers most of them: refs, list_id, coverage."""
    found = candidates(questions, sets, keys, share)
    best = found.groupBy(*keys, "callouts").agg(F.min(F.struct((-F.col("coverage")).alias("less"), "list_id", "refs")).alias("best"))
    return best.select(*keys, "callouts", "best.refs", "best.list_id", (-F.col("best.less")).alias("coverage"))


def figure_matches(figures: DataFrame, lists: DataFrame, band: int = 2, coverage: float = 0.4, strong: float = 0.7) -> DataFrame:
    """The list that explains each figure: figure_id, list_id, score, coverage, missing.

    figures(figure_id, manual_id, page, page_text, callouts ARRAY, families ARRAY, layout),
    lists(list_id, manual_id, page, title, subtitle, refs ARRAY, families ARRAY).  A list of a common group
    fits if its title or subtitle is printed on the page and it covers ``coverage`` of the
    callouts (or there are none), or if it covers ``strong`` of them.  Score: coverage + title + 0.8 kin + 0.2 near;
    ties by turn and list_id.  Nulls in arrays are no callouts, refs or families; rows without a manual match nothing.
    """
    figures, lists = held(figures), held(lists)  # both are read several times
    printed = printed_titles(figures, lists).groupBy("manual_id", "print").agg(F.collect_set("title").alias("shown"))
    asked = figure_groups(figures, band).join(printed, ["manual_id", "print"], "left").select("figure_id", "g", "turn", "callouts", F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))
    known = list_groups(lists)
    # large groups are few: they pick their rows before anything is shuffled, and these are held
    large = held(known.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("g"))
    large = F.broadcast(large) if large.count() <= MAX_SENT else large
    few, many = known.join(large, "g", "left_anti"), held(known.join(large, "g", "left_semi"))
    covered = F.size("callouts") > 0
    # small groups: all pairs
    pairs = asked.join(few, "g").withColumns({"coverage": F.when(covered, F.size(F.array_intersect("callouts", "refs")) / F.size("callouts")).otherwise(0.0), "titled": F.arrays_overlap("titles", "shown")})
    pairs = pairs.where((F.col("titled") & (~covered | (F.col("coverage") >= coverage))) | (covered & (F.col("coverage") >= strong)))
    # large groups, without a title: the best set
    asked = held(asked.join(large, "g", "left_semi"))
    sets = many.groupBy("g", "refs").agg(F.min("list_id").alias("list_id"))
    plain = best_covering(asked.where(covered).select("g", "callouts").distinct(), sets, ["g"], strong)
    plain = asked.join(plain, ["g", "callouts"]).withColumn("titled", F.lit(False))
    # large groups, with a title that is printed on the page: the best set of the title
    named = many.select("g", "refs", "list_id", F.explode("titles").alias("title")).groupBy("g", "title", "refs").agg(F.min("list_id").alias("list_id"))
    under = asked.withColumn("title", F.explode("shown"))
    with_title = best_covering(under.where(covered).select("g", "title", "callouts").distinct(), named, ["g", "title"], coverage)
    with_title = under.join(with_title, ["g", "title", "callouts"])
    bare = named.groupBy("g", "title").agg(F.min(F.struct("list_id", "refs")).alias("x")).select("g", "title", "x.list_id", "x.refs")
    bare = under.where(~covered).join(bare, ["g", "title"]).withColumn("coverage", F.lit(0.0))
    columns = ["figure_id", "g", "turn", "callouts", "refs", "list_id", "coverage", "titled"]
    both = pairs.select(columns).unionByName(plain.select(columns)).unionByName(with_title.withColumn("titled", F.lit(True)).select(columns)).unionByName(bare.withColumn("titled", F.lit(True)).select(columns))
    kin, near = (F.col("g.kind") != NEAR).cast("double"), (F.col("g.kind") != KIN).cast("double")
    score = F.col("coverage") + F.col("titled").cast("double") + kin * 0.8 + near * 0.2
    best = both.groupBy("figure_id").agg(F.min(F.struct((-score).alias("less"), "turn", "list_id", "coverage", "callouts", "refs")).alias("b"))
    missing = _natural(F.array_except("b.callouts", "b.refs"))
    return best.select("figure_id", "b.list_id", F.round(-F.col("b.less"), 6).alias("score"), F.round("b.coverage", 2).alias("coverage"), missing.alias("missing"))
