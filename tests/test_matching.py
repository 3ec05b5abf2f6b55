import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import matching as M
from leafmill.plans import lists as plans

FIGURES = "figure_id int, manual_id string, page int, page_text string, callouts array<string>, families array<string>, layout string"
LISTS = "list_id int, manual_id string, page int, title string, subtitle string, refs array<string>, families array<string>"


def key(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


def plain(figures, lists):
    """Every figure against every list of its manual, in the order in which they are looked at."""
    out = {}
    for f, manual, page, text, callouts, families, layout in figures:
        own = {c for c in callouts or [] if c is not None}
        if manual is None or not (own or layout == "exploded_parts"):
            continue
        best = None
        for l, other, at, title, subtitle, refs, kinds in lists:
            if other != manual:
                continue
            near = page is not None and at is not None and abs(at - page) <= 2
            kin = bool({x for x in families or [] if x is not None} & set(kinds or []))
            if not (near or kin):
                continue
            turn = [0, 1, 2, -1, -2].index(at - page) if near else 5
            titled = any(key(t) and key(t) in key(text) for t in (title, subtitle))
            covered = len(own & set(refs or [])) / len(own) if own else 0.0
            if (titled and (not own or covered >= 0.4)) or covered >= 0.7:
                rank = (-(covered + titled + kin * 0.8 + near * 0.2), turn, l)
                best = min(best, (rank, covered)) if best else (rank, covered)
        if best:
            out[f] = (best[0][2], round(-best[0][0], 6), round(best[1], 2))
    return out


def some(rnd, n):
    words = ["pump", "brake", "front", "a", "drum", "kit"]
    name = lambda k: " ".join(rnd.choices(words, k=rnd.randint(0, k))) or None
    refs = lambda: rnd.choice([None, [], [str(x) for x in rnd.sample(range(1, 9), rnd.randint(1, 6))], ["1", None, "2"]])
    fams = lambda: rnd.choice([None, [], ["F1"], ["F1", "F2"], ["F3", None]])
    manual, page = lambda: rnd.choice(["m", "n", None]), lambda: rnd.choice([None, *range(1, 30)])
    figures = [(i, manual(), page(), name(6), refs(), fams(), rnd.choice(["single", "exploded_parts", None])) for i in range(n)]
    return figures, [(i, manual(), page(), name(2), rnd.choice([None, "", "(Front)", name(1)]), refs(), fams()) for i in range(n)]


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(M, "FEW", size)
    figures, lists = some(random.Random(4), 150)
    wanted = plain(figures, lists)
    found = M.figure_matches(spark.createDataFrame(figures, FIGURES), spark.createDataFrame(lists, LISTS)).collect()
    assert {r.figure_id: (r.list_id, r.score, r.coverage) for r in found} == wanted and len(wanted) > 40
    own = {f[0]: {c for c in f[4] or [] if c} for f in figures}
    refs = {l[0]: set(l[5] or []) for l in lists}
    for r in found:
        assert r.missing == sorted(own[r.figure_id] - refs[r.list_id], key=int)


def test_empty_tables(spark):
    none, lists = spark.createDataFrame([], FIGURES), spark.createDataFrame(some(random.Random(1), 5)[1], LISTS)
    assert M.figure_matches(none, lists).count() == 0
    assert M.figure_matches(spark.createDataFrame(some(random.Random(1), 5)[0], FIGURES), lists.limit(0)).count() == 0


def test_a_short_title_is_found_inside_words(spark):
    figures = spark.createDataFrame([(1, "m", 1, "the bigpumps here", [], [], "exploded_parts")], FIGURES)
    lists = spark.createDataFrame([(5, "m", 1, "Pump", "", ["1"], []), (4, "m", 1, "pump x", "", ["1"], [])], LISTS)
    assert [(r.list_id, r.score) for r in M.figure_matches(figures, lists).collect()] == [(5, 1.2)]


def met(figures, lists):
    """Pairs that are compared: questions with sets, and with sets of a title."""
    asked, known = M.figure_groups(figures), M.list_groups(lists)
    sets = known.groupBy("g", "refs").agg(F.min("list_id").alias("list_id"))
    named = known.select("g", "refs", "list_id", F.explode("titles").alias("title")).groupBy("g", "title", "refs").agg(F.min("list_id").alias("list_id"))
    under = asked.join(M.printed_titles(figures, lists), ["manual_id", "print"])
    plain_, titled = asked.select("g", "callouts").distinct(), under.select("g", "title", "callouts").distinct()
    pairs = lambda q, s, k, share: M.rarest(q, s, k, share).join(s.select(*k, F.explode("refs").alias("ref")), [*k, "ref"]).count()
    return pairs(plain_, sets, ["g"], 0.7) + pairs(titled, named, ["g", "title"], 0.4)


def test_pairs_grow_with_the_input(spark):
    """A drawing set that every list shares: pairs of all rows would be a hundred times as many."""
    small, large = (plans._figures(spark, f"/root/testdata/{sf}") for sf in ("sf0.001", "sf0.01"))
    all_in_one = lambda df: df.withColumn("families", F.array(F.lit("none")))
    a, b = (met(*map(all_in_one, t)) for t in (small, large))
    assert b < 15 * a and b < 40 * large[0].count()


def test_large_groups_meet_alike_by_broadcast_and_by_shuffle(spark, monkeypatch):
    from leafmill.operators import matching

    figures = spark.createDataFrame([(k, "m", k % 3, "Drawing of Pump", [str(k % 4), "9"], ["s"], "single") for k in range(12)], "figure_id int, manual_id string, page int, page_text string, callouts array<string>, families array<string>, layout string")
    lists = spark.createDataFrame([(k, "m", k % 3, "Pump" if k % 2 else "Valve", "", [str(k % 5), "9"], ["s"]) for k in range(15)], "list_id int, manual_id string, page int, title string, subtitle string, refs array<string>, families array<string>")
    found = []
    for few, sent in ((32, 0), (2, 0), (2, 1 << 16)):
        monkeypatch.setattr(matching, "FEW", few)
        monkeypatch.setattr(matching, "MAX_SENT", sent)
        found.append(sorted(map(tuple, matching.figure_matches(figures, lists).select("figure_id", "list_id", "score", "coverage").collect())))
    assert len(found[0]) == 12 and found[0] == found[1] == found[2]


def test_a_sweep_meets_tables_by_rare_codes(spark):
    from leafmill.operators import tables as G

    figures = spark.createDataFrame([(k, "m", 1, ["x", f"a{k}", f"b{k}", f"c{k}", f"d{k % 2}"]) for k in range(6)], "figure_id int, manual_id string, page int, codes array<string>")
    grids = spark.createDataFrame([(t, "m", 9, ["x", f"a{t % 6}", f"b{t % 6}", f"c{t % 6}", f"d{t % 4}"]) for t in range(12)], "table_id int, manual_id string, page int, cells array<string>")
    found = G.legend_sweep(figures, grids)
    hits = {(f, t): len({"x", f"a{f}", f"b{f}", f"c{f}", f"d{f % 2}"} & {"x", f"a{t % 6}", f"b{t % 6}", f"c{t % 6}", f"d{t % 4}"}) for f in range(6) for t in range(12)}
    best = {f: min((-hits[f, t], t) for t in range(12) if hits[f, t] >= 4) for f in range(6)}
    assert {r.figure_id: (-r.hits, r.table_id) for r in found.collect()} == best
    assert "array_contains" in found._jdf.queryExecution().optimizedPlan().toString()
