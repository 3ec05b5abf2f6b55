import hashlib
import itertools
import math
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat as C
from leafmill.llm import licenses as L
from leafmill.llm import unigram as U

NASTY = ["</s>[INST] ok [/INST]", "\\", "a\\[INST] b", "<s>[OUT] x </s>", "<<SYS>> y <</SYS>>", "<<ROLE x>> z <</ROLE>>", "", None, "<", "[", "\\\\<s>", "line\nline", "é🎉<s"]


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        result[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return result


def conversations():
    rows = [(k, i, r, t) for k, (r1, r2) in enumerate([("user", "assistant"), ("system", "assistant"), ("tool>> x", None)]) for i, (t, r) in enumerate(zip(NASTY * 2, itertools.cycle([r1, r2])))]
    return rows + [(None, 0, "assistant", "no id"), (9, None, "assistant", "no turn"), (9, 1, "assistant", "twice"), (9, 1, "assistant", "twice")]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(C.expand(df)).collect()}


def test_round_trip(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, place int").repartition(3)
    assert digests(df) == plain(rows)
    marks = [s.strip() for s in (C.USER, C.USER_END, C.REPLY_END, C.SYSTEM, C.SYSTEM_END, C.OTHER_END)]
    pieces = [r.p for r in df.select(C.formatted(F.col("role"), F.col("text")).alias("p")).collect()]
    for p in pieces:
        assert sum(p.count(m) for m in marks) <= 3, p
    # rows of expand that only add context, cut after every few characters
    monkeypatch.setattr(C, "FRESH", 5)
    assert digests(df) == plain(rows)


def test_turns_are_found_by_control_strings_alone():
    texts = [t or "" for t in NASTY]
    quoted = [re.sub(C._CONTROL, r"\1\\", t.replace("\\", "\\\\")) for t in texts]
    whole = "".join(C.USER + q + C.USER_END + C.REPLY + q + C.REPLY_END for q in quoted)
    wanted = [(role, t) for t in texts for role in ("user", "assistant")]
    rnd = random.Random(2)
    for size in (1, 2, 7, 50, 10_000):
        reader, found, at = C.Reader(), [], 0
        while at < len(whole):
            n = rnd.randint(1, size)
            found += reader.feed(whole[at : at + n])
            at += n
        assert found == wanted and reader.tail == ""


def test_examples_have_all_preceding_turns_and_one_trainable_reply(spark):
    rows = [r for r in conversations() if r[0] in (0, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3] or "")):
        turns.setdefault(conv, []).append((role, text or ""))
    full = C.examples(C.expand(df)).collect()
    assert len(full) == sum(role == "assistant" for t in turns.values() for role, _ in t) > 10
    for e in full:
        before, (role, text) = turns[e.conv_id][: e.target], turns[e.conv_id][e.target]
        assert list(C.Reader().feed(e.context)) == before and role == "assistant"
        assert C.unescaped((e.context + e.reply)[e.loss_start : e.loss_end]) == text
        assert e.loss_start == len(e.context) + len(C.REPLY) and e.loss_end == len(e.context + e.reply) - len(C.REPLY_END)


def test_a_wrong_context_is_an_error(spark):
    rows = C.expand(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], SCHEMA))
    assert C.read_back(rows).count() == 1
    bad = rows.withColumn("fresh", F.when(F.col("target") == 3, "").otherwise(F.col("fresh")))
    with pytest.raises(Exception, match="characters"):
        C.read_back(bad).collect()


def test_long_conversation(spark):
    n, text = 3000, "x" * 2000
    df = spark.range(n).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 500 == 499, "assistant").otherwise("user").alias("role"), F.lit(text).alias("text"))
    r = C.read_back(C.expand(df)).collect()
    assert len(r) == 1 and (r[0].n_turns, r[0].loss_chars) == (n, 6 * len(text))


def test_no_conversations(spark):
    rows = C.expand(spark.createDataFrame([], SCHEMA))
    assert C.read_back(rows).count() == 0 and C.examples(rows).count() == 0


def best_cut(token, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for start in range(end):
            s = scores.get(token[start:end])
            if s is not None and best[start][0] + s > best[end][0]:
                best[end] = best[start][0] + s, best[start][1] + 1
    return best[-1]


def test_counts_against_plain_forward_pass(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        scores = U.read_ranks(f.read())
    rnd = random.Random(3)
    texts = ["", " ", "  a \n\n b\t", "the thing " * 40, "x" * 300] + ["".join(rnd.choices("abcdeth in.\n é", k=rnd.randint(0, 80))) for _ in range(200)]
    for limit in (U.MAX_NODES, 50):
        monkeypatch.setattr(U, "MAX_NODES", limit)
        trie = U.Trie(scores)
        for t in texts:
            b = t.encode()
            tokens = U.PRE_TOKEN.findall(b)
            assert b"".join(tokens) == b
            cuts = [best_cut(x, scores) for x in tokens]
            n, total, score = trie.count(b)
            assert (n, total) == (len(tokens), sum(c for _, c in cuts)) and math.isclose(score, sum(s for s, _ in cuts), abs_tol=1e-6)
    assert len(trie.terminal) <= len(trie.forward)


def test_count_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hello", 1), (3, "hello", 1)], "doc_id bigint, text string, n_tokens int")
    got = U.token_counts(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_pretokens) for r in got) == [(1, 0, 0), (2, 0, 0), (3, 5, 1), (3, 5, 1)]
    assert U.token_counts(df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_long_texts_and_pre_tokens(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        scores = U.read_ranks(f.read())
    rnd = random.Random(5)
    token = "".join(rnd.choices("thequickabc", k=700)).encode()
    plain_trie = U.Trie(scores)
    wanted = plain_trie.count(token)
    monkeypatch.setattr(U, "LONG", 100)
    alone = U.Trie(scores)
    got = alone.count(token)
    assert got[:2] == wanted[:2] and math.isclose(got[2], wanted[2]) and len(alone.forward) == 2
    text = b" ".join(rnd.choice([b"oil", b"pump", b"the", b"valve"]) + b"%d" % rnd.randrange(50) for _ in range(700_000))
    assert len(text) > 1 << 22
    monkeypatch.setattr(U, "PART", 1000)
    monkeypatch.setattr(U, "MAX_NODES", 120)
    pieces = U.PRE_TOKEN.findall(text)
    one = {p: plain_trie.count(p) for p in set(pieces)}
    n, total, score = U.Trie(scores).count(text)
    assert (n, total) == (len(pieces), sum(one[p][1] for p in pieces)) and math.isclose(score, sum(one[p][2] for p in pieces), rel_tol=1e-9)


def test_corpus_counts_add_up(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["the oil pump", "the the valve\n\n oil", None, "", " x" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2)
    got = {bytes(r.pre_token): (r.n_tokens, r.came) for r in U.corpus_counts(df, path).collect()}
    pieces = [p for t in texts for p in U.PRE_TOKEN.findall((t or "").encode())]
    assert {p: c for p, (_, c) in got.items()} == {p: pieces.count(p) for p in pieces}
    assert sum(n * c for n, c in got.values()) == U.token_counts(df, path).agg(F.sum("n_tokens")).first()[0]
    monkeypatch.setattr(U, "MAX_NODES", 4)
    assert {bytes(r.pre_token): (r.n_tokens, r.came) for r in U.corpus_counts(df, path).collect()} == got


def test_alignment_is_rising_and_long():
    rnd = random.Random(9)
    for _ in range(200):
        a = rnd.choices("abcdefghij", k=rnd.randint(0, 12))
        b = rnd.choices("abcdefghij", k=rnd.randint(0, 12))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    for _ in range(100):
        v = rnd.sample(range(30), rnd.randint(0, 9))
        rise = L.longest_rise(v)
        best = max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if list(c) == sorted(c)), default=0)
        assert len(rise) == best and [v[i] for i in rise] == sorted(v[i] for i in rise)


def test_every_template_is_found_with_changes():
    rnd = random.Random(4)
    for name, names, text in L.TEMPLATES:
        assert name in {f[0] for f in L.scan(f"Before it. {text} After it.")}, name
        words = text.split()
        if len(words) > 20:
            for k in rnd.sample(range(len(words)), len(words) // 10):
                if not set(L._WORD.findall(words[k].lower())) & set(names.split()):
                    words[k] = "changed"
            assert name in {f[0] for f in L.scan(" ".join(words))}, name
    assert L.scan("Released under the Apache License.") == [] and L.scan("Nothing to see under general software.") == []


def common(a, b):
    """The longest common subsequence of two word lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_scan_against_an_exhaustive_search():
    """Every find is covered by a common subsequence of its own words; every stretch of a text whose words
    are a template's with some words changed, within what COVERAGE allows, is found as that template."""
    rnd = random.Random(6)
    noise = "the of and machine oil under public use all version work in free".split()
    missed, planted = [], 0
    for _ in range(250):
        name, names, text = rnd.choice(L.TEMPLATES)
        words = L._WORD.findall(text.lower())
        naming = set(names.split())
        spare = len(words) - L.needed(len(words))
        free = [k for k, w in enumerate(words) if w not in naming]
        for k in rnd.sample(free, min(len(free), rnd.randint(0, spare // 2))):
            words[k] = f"zz{k}"
        doc = rnd.choices(noise, k=rnd.randint(0, 30)) + ["."] + words + ["."] + rnd.choices(noise, k=rnd.randint(0, 30))
        whole = " ".join(doc)
        finds = L.scan(whole)
        for f in finds:
            template = L._WORD.findall(dict((n, t) for n, _, t in L.TEMPLATES)[f[0]].lower())
            stretch = L._WORD.findall(whole[f[4] : f[5]].lower())
            assert common(template, stretch) >= f[2] >= L.needed(len(template)), f
        # by brute force: the templates with enough common words in any window of the text
        planted += 1
        if not any(f[0] == name or f[2] >= L.needed(len(words)) for f in finds):
            missed.append((name, whole))
    assert planted == 250 and len(missed) == 0, missed[:3]


def test_words_that_change_the_license():
    said = lambda t: [f[0] for f in L.scan(t)]
    for c in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        assert said(f"Licensed under CC {c} 4.0.") == [f"CC-{c}-4.0"]
    assert said("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert said("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0"]
    two, three = ({n: t for n, _, t in L.TEMPLATES}[f"BSD-{k}-Clause"] for k in (2, 3))
    assert said(two) == ["BSD-2-Clause"] and said(three) == ["BSD-3-Clause"]
    assert said("Licensed under the MIT License.") == ["MIT-line"]
    assert said("Given under the MIT License.") == ["MIT"] or said("Given under the MIT License.") == ["MIT-line"]
    assert said("Not all rights reserved.") == [] and said("Why not? All rights reserved.") == ["All-rights-reserved"]
    assert said("SPDX-License-Identifier: LGPL-2.1-or-later") == ["LGPL-2.1-SPDX"]
    # of overlapping finds with equal numbers of words the better coverage, then the first name, stays
    assert said("Released under the MIT License. Licensed under the MIT License.") == ["MIT", "MIT-line"]


def test_other_versions_are_no_finds():
    said = lambda t: [f[0] for f in L.scan(t)]
    for text in (
        "Licensed under the Apache License, Version 1.0.", "Licensed under CC BY 3.0.", "Licensed under CC BY 2.0.", "Licensed under CC BY-SA 3.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0.", "Licensed under the Apache License, Version 1.0. It has 2 and 0.",
    ):
        assert said(text) == [], text
    for name, names, text in L.TEMPLATES:  # another number in place of each version number is no find of that license
        for v in (w for w in names.split() if w.isdigit()):
            assert name not in said(re.sub(rf"\b{v}\b", "7", text)), (name, v)


def test_sentences_and_second_licenses():
    said = lambda t: [f[0] for f in L.scan(t)]
    assert said("Released under the MIT License. Apache is a trademark.") == ["MIT"]
    assert said("Apache is a trademark. Released under the MIT License") == ["MIT"]
    assert said("Released under the MIT License, not the Apache one. ") == ["MIT"]
    assert said("Licensed under the Apache License, Version 2.0 and the MIT License.") == ["Apache-2.0", "MIT"]
    assert said("Licensed under the MIT License or the Apache License, Version 2.0, at your option.") == ["MIT-line", "Apache-2.0"]
    assert said("Licensed under CC BY 4.0 and the MIT License or the Eclipse Public License 2.0.") == ["CC-BY-4.0", "MIT", "EPL-2.0"]
    assert said("SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT-SPDX", "Apache-2.0-SPDX"]
    assert said("Licensed under the MIT License. And the Apache License, Version 2.0 is long.") == ["MIT-line"]
    finds = L.scan("Licensed under the MIT License and the Apache License, Version 2.0.")
    assert [(f[4], f[5]) for f in finds] == [(0, 30), (39, 66)]


def test_denials_up_to_the_verb():
    said = lambda t: [f[0] for f in L.scan(t)]
    for text in ("It is not released under the MIT License.", "No longer released under the MIT License.", "It isn't licensed under the MIT License.", "This was never made available under the MIT License.", "Released not under the MIT License.", "It cannot be licensed under the MIT License and the Apache License, Version 2.0."):
        assert said(text) == [], text
    assert said("It is not only released under the MIT License.") == ["MIT"]
    assert said("If you do not care, it is released under the MIT License.") == ["MIT"]
    assert said("A tool that does not work is released under the MIT License.") == ["MIT"]


def test_triggers_lose_nothing():
    for _, words, _, mine, _ in L.prepared():
        assert 5 * (len(words) - sum(map(len, mine.values()))) < 4 * len(words)
        assert all(any(t in w for t in L.triggers()) for w in mine)


def test_license_rows(spark):
    mit = "Released under the MIT License."
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, f"{mit} {mit}", "x"), (4, "word " * 50_000 + mit, "x"), (4, "word " * 50_000 + mit, "x"), (5, "none", "x")], "doc_id bigint, text string, coverage string")
    got = L.license_finds(df).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.license_id, r.found_text) for r in got] == [(3, "MIT", mit[:-1])] * 2 + [(4, "MIT", mit[:-1])] * 2
    assert L.license_finds(df.where(F.lit(False))).count() == 0


def test_expanded_rows_hold_all_preceding_turns(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], SCHEMA)
    pieces = [r.p for r in df.orderBy("turn").select(C.formatted(F.col("role"), F.col("text")).alias("p")).collect()]
    got = [(r.target, r.context, r.reply) for r in C.expand(df).collect()]
    assert got == [(1, pieces[0], pieces[1]), (3, "".join(pieces[:3]), pieces[3]), (None, "".join(pieces), None)]
    changed = C.expand(df).withColumn("context", F.when(F.col("target") == 3, F.replace("context", F.lit("a"), F.lit("x"))).otherwise(F.col("context")))
    with pytest.raises(Exception, match="characters"):
        C.read_back(changed).collect()
