import itertools
import random
import re

from leafmill.llm import decontam as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        have = words(t)
        for i, s in items:
            want = words(s)
            if len(want) < D.MIN_WORDS:
                continue
            n = min(D.WINDOW, len(want))
            for shift in range(-len(want), len(have)):
                holds = [0 <= k + shift < len(have) and have[k + shift] == w for k, w in enumerate(want)]
                if any(sum(holds[k : k + n]) >= D.needed(n) for k in range(len(want) - n + 1)):
                    out.add((d, i))
    return out


def test_masks_miss_no_window():
    for n in range(D.MIN_WORDS, D.WINDOW + 1):
        for k in range(n - D.needed(n) + 1):
            for bad in map(set, itertools.combinations(range(n), k)):
                assert any(all(s + p not in bad for p in m) for m in D.MASKS for s in range(n - max(m))), (n, bad)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["the", "of", "in"] * 20 + [f"w{i}" for i in range(300)]
    say = lambda n: rnd.choices(vocabulary, k=n)
    items = [(i, " ".join(say(rnd.randint(3, 45)))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for d in range(150):
        text = say(rnd.randint(0, 120))
        if d % 3 == 0:
            w = words(rnd.choice(items[:40])[1])
            for k in rnd.sample(range(len(w)), rnd.randint(0, max(1, len(w) // 3))):
                w[k] = "replaced"
            cut = rnd.choice([0, 0, len(w) // 2])
            at = rnd.randint(0, len(text))
            text[at:at] = w[cut:]
        docs.append((d, ", ".join(text).title()))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, words int")
    test = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, words int")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, test).collect()}
    wanted = brute(docs, items)
    assert got == wanted and len(wanted) > 20
    left = D.clean(df, test)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in wanted}


def test_without_the_word_list(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_VOCABULARY", 3)
    monkeypatch.setattr(D, "MAX_BROADCAST", 0)
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x one two THREE four five six y"), (2, "one two")], "doc_id bigint, text string")
    assert [tuple(r) for r in D.contaminated(docs, items).collect()] == [(1, 1, 6, 6, 1)]


def test_empty(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id bigint, text string")
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0


def test_null_ids_long_texts_and_ties(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    long = "filler " * 30_000
    docs = [(None, f"x {item} y"), (1, long + item + " " + long), (2, f"{item} and again {item}"), (3, None), (4, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, shift int")
    items = spark.createDataFrame([(7, item), (None, item), (8, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.matched_words, r["shift"]) for r in D.contaminated(df, items).collect()}
    wanted = {None: (8, 1), 1: (8, 30_000), 2: (8, 0)}  # of two equal places the first
    assert got == {(d, i): v for d, v in wanted.items() for i in (7, None)}
    assert sorted(r.doc_id for r in D.clean(df, items).collect()) == [3, 4]
