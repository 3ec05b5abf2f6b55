"""Byte-level BPE encoding and decoding (operator 9).

The encoder never replays merges over a text.  An Aho-Corasick automaton over the
vocabulary gives the longest token that starts at each byte of a piece; tokens are
then placed from left to right, and a token may follow another only if the pair is
compatible, that is, if merging their joined bytes gives just these two tokens.  A
sequence whose neighbours are all compatible is what the merges give, so the first
full placement is the exact answer.  A byte position found to be a dead end is
never tried again, which keeps the work linear in the piece.

Decoding gathers token bytes from one buffer through an offset table.

Documents are split at white space first and each distinct piece is encoded once
in a worker; the memory of these pieces is bounded (``CACHE_PIECES``) and is simply
emptied when full, so a result never depends on it.

Defined cases: null text counts as empty; an empty text has no ids, and both
digests are those of empty input; columns in ``keep`` pass through, and one with the name of
an output is an error; repeated rows give repeated results; a text of any length is handled
whole, by itself if it is longer than ``SLICE_CHARS``.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafmill.llm.common import free_name, frugal

#: Fixed value: the word pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Unicode white space, as a character class.
WS = "\t-\r \x85\xa0  -     　"

#: A worker forgets its encoded pieces beyond this many, and after every task.
CACHE_PIECES = 300_000

#: So many characters of text are turned into arrays at once.
SLICE_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Byte strings in one buffer with an offset table."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.len = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.len)])[:-1]

    def gather(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joined strings of ids, and where each one ends."""
        lens = self.len[ids]
        return self.data[spread(self.start[ids], lens)].tobytes(), np.cumsum(lens)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each of many spans, joined."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lens, lens)


class Bpe:
    """Vocabulary, automaton and the pair-compatibility table of one tokenizer file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        model = j["model"]
        vocab = {raw(k): v for k, v in model["vocab"].items() if all(c in to_byte for c in k)}
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        self.single = [vocab[bytes([b])] for b in range(256)]
        #: rank of the merge of a pair; what it makes; which pair made a token.
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = {i: -1 for i in self.single}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = raw(a), raw(b)
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(x << 20 | y, r)
            self.made.setdefault(x << 20 | y, z)
            if z not in self.parts:
                self.parts[z] = x, y
                self.born[z] = r
        self.compatible: dict[int, bool] = {}

        self.of = of = {self.bytes_of[i]: i for i in self.born if self.merged(self.bytes_of[i]) == [i]}
        self.len = [len(b) for b in self.bytes_of]
        #: the longest usable token that is a proper prefix of a token
        self.shorter = [-1] * size
        for t, i in of.items():
            self.shorter[i] = next((of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in of), -1)
        self._automaton()
        self.words = regex.compile(PATTERN)
        self.pieces = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
        self.texts = Table(self.bytes_of)
        self.decimals = Table([b"%d," % i for i in range(size)])
        self.forget()

    def _automaton(self) -> None:
        """Aho-Corasick over all tokens of two bytes or more: ``delta`` maps
        state << 8 | byte to a state (missing steps are filled in from the failure
        links when first used), ``ends`` lists the tokens that end in a state."""
        self.delta: dict[int, int] = {}
        self.ends: list[tuple[int, ...]] = [()]
        layers: list[list[tuple[int, int, int]]] = []
        for t, i in self.of.items():
            state = 0
            for depth, c in enumerate(t):
                key = state << 8 | c
                if key not in self.delta:
                    self.delta[key] = len(self.ends)
                    self.ends.append(())
                    while len(layers) <= depth:
                        layers.append([])
                    layers[depth].append((state, c, self.delta[key]))
                state = self.delta[key]
            if len(t) > 1:
                self.ends[state] = (i,)
        self.fail = [0] * len(self.ends)
        for depth, layer in enumerate(layers):
            for parent, c, state in layer:
                back = self.fail[parent]
                while depth and back and (back << 8 | c) not in self.delta:
                    back = self.fail[back]
                self.fail[state] = self.delta.get(back << 8 | c, 0) if depth else 0
                self.ends[state] += self.ends[self.fail[state]]

    def _step(self, state: int, c: int) -> int:
        back = state
        while back and (back << 8 | c) not in self.delta:
            back = self.fail[back]
        to = self.delta[state << 8 | c] = self.delta.get(back << 8 | c, 0)
        return to

    def merged(self, piece: bytes) -> list[int]:
        """The plain definition: always apply the earliest merge, leftmost first."""
        ids = [self.single[b] for b in piece]
        while len(ids) > 1:
            r, k = min((self.rank.get(ids[k] << 20 | ids[k + 1], 1 << 40), k) for k in range(len(ids) - 1))
            if r == 1 << 40:
                break
            ids[k : k + 2] = [self.made[ids[k] << 20 | ids[k + 1]]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: undoes the later of the two merges again and again;
        no merge across the border may come before the one that was undone."""
        known = self.compatible[a << 20 | b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        rank, born, parts = self.rank, self.born, self.parts
        done_a = done_b = 1 << 40  # ranks of the merges that closed the inner ends
        while True:
            r = rank.get(a << 20 | b)
            # On the left side an equal rank acts first there, on the right side later.
            if r is not None and r < done_a and r <= done_b:
                return False
            ra, rb = born[a], born[b]
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:  # of equal merges the left one came first, so it is undone last only when later
                done_a, done_b = ra, min(done_b, ra)
                a = parts[a][1]
            else:
                done_a, done_b = min(done_a, rb + 1), rb
                b = parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of a word of the pattern."""
        whole = self.of.get(piece)
        if whole is not None:
            return [whole]
        n, lens, shorter, compatible, delta, ends = len(piece), self.len, self.shorter, self.compatible, self.delta, self.ends
        longest = [self.single[b] for b in piece]
        state = end = 0
        for c in piece:
            to = delta.get(state << 8 | c)
            state = self._step(state, c) if to is None else to
            end += 1
            for t in ends[state]:
                longest[end - lens[t]] = t  # later ends are longer
        out: list[int] = []
        dead: set[int] = set()
        pos, last, t = 0, -1, longest[0] if n else -1
        while pos < n:
            while t >= 0:
                if pos + lens[t] not in dead:
                    if last < 0:
                        break
                    ok = compatible.get(last << 20 | t)
                    if ok is None:
                        ok = self.fits(last, t)
                    if ok:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                last = t
                pos += lens[t]
                if pos < n:
                    t = longest[pos]
            else:
                dead.add(pos)
                pos -= lens[last]
                t = shorter[last]
                out.pop()
                last = out[-1] if out else -1
        return out

    def forget(self) -> None:
        bpe, self.ids, self.from_, self.count = self, array("i"), array("q"), array("q")

        class Known(dict):
            """Piece of text -> its place among the encoded pieces."""

            def __missing__(self, piece: str) -> int:
                at = self[piece] = len(bpe.from_)
                bpe.from_.append(len(bpe.ids))
                if piece in bpe.special:
                    bpe.ids.append(bpe.special[piece])
                else:
                    for word in [piece] if piece.lstrip(" ").isalpha() else bpe.words.findall(piece):
                        bpe.ids.extend(bpe.encode_piece(word.encode()))
                bpe.count.append(len(bpe.ids) - bpe.from_[-1])
                return at

        self.known = Known()

    def cut(self, text: str) -> list[str]:
        """Pieces at white space; no token of the word pattern crosses their borders."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.pieces.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text where its ids end."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        cuts = [self.cut(t) for t in texts]
        place = self.known.__getitem__
        at = np.fromiter((place(p) for c in cuts for p in c), np.int64, sum(map(len, cuts)))
        # copies, so that the growing arrays are not held
        starts, counts = np.array(self.from_)[at], np.array(self.count)[at]
        ids = np.array(self.ids)[spread(starts, counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(c) for c in cuts])] if cuts else np.zeros(0, np.int64)
        return ids, ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        data, byte_ends = self.texts.gather(ids)
        cuts = np.concatenate([[0], byte_ends])[np.concatenate([[0], ends])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]

    def id_digests(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        data, byte_ends = self.decimals.gather(ids)
        cuts = np.concatenate([[0], byte_ends])[np.concatenate([[0], ends])]
        return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]


_LOADED: dict[int, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """One per worker and vocabulary; workers live longer than tasks."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


#: What encode_documents can add, by name.
OUTPUTS = {"token_ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(df: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("token_ids", "n_tokens"), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Encodes ``text`` of every row; no shuffle, one pass.

    vocabulary: path of a tokenizer file that the driver can read; its content
    (a few MB, independent of the data) is broadcast.  outputs: names of OUTPUTS,
    appended to the columns ``keep``; ``decoded`` comes from the ids alone.
    """
    if clash := set(keep) & set(outputs):
        raise ValueError(f"rename {sorted(clash)}: outputs have these names")
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs])
    arrow = {"token_ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j]) <= SLICE_CHARS):
                    chars += len(texts[j])
                    j += 1
                ids, ends = bpe.encode(texts[i:j])
                starts = np.concatenate([[0], ends])
                made: dict[str, object] = {}
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    decoded = bpe.decode(ids, ends)
                    made["decoded"] = decoded
                    if "decoded_sha256" in outputs:
                        made["decoded_sha256"] = [hashlib.sha256(s.encode()).hexdigest() for s in decoded]
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = bpe.id_digests(ids, ends)
                made["n_tokens"] = np.diff(starts)
                if "token_ids" in outputs:
                    made["token_ids"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                columns += [made[o] if isinstance(made[o], pa.Array) else pa.array(made[o], arrow.get(o, pa.string())) for o in outputs]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *outputs])
                i = j
        bpe.forget()  # workers live longer than tasks, next to those of other stages

    return df.select(*keep, df[text].alias(free_name("text", keep))).mapInArrow(frugal(run), schema)
