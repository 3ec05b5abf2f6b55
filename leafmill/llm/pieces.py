"""Encoding with libraries, each distinct piece of a block once (operators 11 and 13).

A text may be cut before a space that follows a byte which is no space and stands before a
character which is no white space.  Neither the word pattern of byte-level BPE vocabularies nor
a sentencepiece BPE vocabulary without pieces of the form ``x<space>`` has a token across such a
place, and both sides encode alone as they do together.  So a block of texts is cut in its Arrow
buffer, Arrow finds the distinct pieces, and these go to the library as one joined text, whose
tokens are dealt back by their bytes.  A piece that can't stand in a joined text (it doesn't begin with just
one space, or ends in one) is encoded by itself, and so is every piece of a joined text whose tokens don't
give back its bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafmill.llm.bpe import PATTERN, Table, byte_alphabet, spread

#: So many bytes of text share their distinct pieces; a longer text is a block of its own.
BLOCK_BYTES = 8_000_000

#: So many bytes of distinct pieces are one text for the library.
JOINED_BYTES = 64_000

#: First bytes of characters that are surely no white space.
STARTS = np.ones(256, bool)
STARTS[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
STARTS[128:192] = False

#: Bytes from here on begin characters beyond U+03FF; letters below are the same in every version of Unicode in use.
LATE = 0xD0


def blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, large binary array) of about ``size`` bytes each; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def contents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large binary array without nulls, and the len + 1 borders of its rows."""
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found[borders[0] : borders[-1]], borders - borders[0]


@dataclass
class Pieces:
    codes: np.ndarray  # number of the distinct piece at each place
    row_ends: np.ndarray  # of each row: where its pieces end
    data: np.ndarray  # bytes of the distinct pieces
    borders: np.ndarray
    alone: np.ndarray  # which of them can't stand in a joined text


def pieces(texts: pa.Array, whole: np.ndarray) -> Pieces:
    """Distinct pieces of a large binary array.  whole: rows that stay in one piece."""
    data, borders = contents(texts)
    cut = np.zeros(len(data), bool)
    space = data == 32
    cut[1:-1] = space[1:-1] & ~space[:-2] & STARTS[data[2:]]
    full = borders[1:] > borders[:-1]
    cut[borders[1:][full] - 1] = False
    for row in np.flatnonzero(whole):
        cut[borders[row] : borders[row + 1]] = False
    cut[borders[:-1][full]] = True
    at = np.flatnonzero(cut)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    codes = coded.indices.to_numpy()
    known, ends = contents(coded.dictionary)
    first, last = ends[:-1], ends[1:] - 1
    alone = (known[first] != 32) | (last == first) | (known[last] == 32) | ~STARTS[known[np.minimum(first + 1, last)]]
    row_ends = np.searchsorted(at, borders[1:])
    alone[codes[row_ends[whole & full] - 1]] = True
    return Pieces(codes, row_ends, known, ends, alone)


@dataclass
class Coded:
    """Ids of the distinct pieces, and which of them their tokens give back byte by byte."""

    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    same: np.ndarray

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids at these places, and how many each place has."""
        counts = self.counts[codes]
        return self.ids[spread(self.starts[codes], counts)], counts


class Coder:
    """A library: ``table`` has the bytes of each id, ``size`` ids."""

    table: Table
    size: int

    def joined(self, late: bool, text: str) -> list[int]:
        raise NotImplementedError

    def single(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Rows that can't be cut."""
        raise NotImplementedError

    def encode(self, p: Pieces) -> Coded:
        n = len(p.alone)
        lens = np.diff(p.borders)
        counts, same, starts = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
        late = np.append(0, np.cumsum(p.data >= LATE))
        late = late[p.borders[1:]] > late[p.borders[:-1]]
        found, total, single = [], 0, [np.flatnonzero(p.alone)]
        for kind in (False, True):
            some = np.flatnonzero(~p.alone & (late == kind))
            ends = np.cumsum(lens[some])
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOINED_BYTES, "right")))
                part = some[at:to]
                at = to
                text = p.data[spread(p.borders[part], lens[part])].tobytes()
                ids = np.array(self.joined(kind, text.decode("utf-8", "replace")), np.int32)
                back, id_ends = self.table.gather(ids)
                wanted = np.cumsum(lens[part])
                place = np.searchsorted(id_ends, wanted)
                if back != text or (id_ends[place] != wanted).any():
                    single.append(part)
                    continue
                counts[part] = np.diff(place + 1, prepend=0)
                starts[part] = total + np.append(0, place[:-1] + 1)
                total += len(ids)
                found.append(ids)
        rest = np.concatenate(single)
        texts = [p.data[p.borders[k] : p.borders[k + 1]].tobytes() for k in rest]
        for at in range(0, len(rest), 1024):
            for k, text, ids in zip(rest[at : at + 1024], texts[at : at + 1024], self.single([t.decode("utf-8", "replace") for t in texts[at : at + 1024]])):
                ids = np.array(ids, np.int32)
                starts[k], counts[k] = total, len(ids)
                same[k] = self.table.gather(ids)[0] == text
                total += len(ids)
                found.append(ids)
        return Coded(np.concatenate(found) if found else np.zeros(0, np.int32), starts, counts, same)


def ranks(spec: str) -> dict[bytes, int] | None:
    """Tokens by bytes for an encoder that merges whatever makes the token of least id, if it must give what the merges of the file give.

    When such an encoder makes a token of two parts, nothing was merged across their outer borders, so
    inside the token all is as when it is encoded alone; so if the merges turn each token's bytes into just this token (others are
    never made and are left out here) and ids rise with the merges, both do the same.  Else None."""
    j = json.loads(spec)
    of, model = byte_alphabet(), j["model"]
    raw = lambda s: bytes(of[c] for c in s)
    vocab = {raw(s): i for s, i in model["vocab"].items() if all(c in of for c in s)}
    pairs = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    rank = {p: r for r, p in reversed([*enumerate(pairs)])}
    made = [vocab[a + b] for a, b in pairs]
    if any(bytes([b]) not in vocab for b in range(256)) or any(x >= y for x, y in zip(made, made[1:])) or model.get("ignore_merges"):
        return None

    def kept(token: bytes) -> bool:
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            r, k = min((rank.get((parts[k], parts[k + 1]), len(pairs)), k) for k in range(len(parts) - 1))
            if r == len(pairs):
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    special = {t["content"].encode() for t in j.get("added_tokens", [])}
    return {t: i for t, i in vocab.items() if t not in special and kept(t)}


class ByteLevel(Coder):
    """A byte-level BPE file of the tokenizers library.

    special: strings of special tokens in a text become their ids; else they are plain text.  known: ``ranks`` of the
    file; with them texts of Latin and Greek letters go to a faster library, the others to this one."""

    def __init__(self, spec: str, special: bool, known: dict[bytes, int] | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        library = Tokenizer.from_str(spec)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = not special
        self.library = library
        j = json.loads(spec)
        before = j.get("pre_tokenizer") or {}
        self.cuttable = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not j.get("normalizer")
        self.special = [t["content"].encode() for t in j.get("added_tokens", [])]
        self.apart = special or any(not t.get("special") for t in j.get("added_tokens", []))
        self.size = library.get_vocab_size(with_added_tokens=True)
        of = byte_alphabet()
        bytes_of = [b""] * self.size
        for s, i in j["model"]["vocab"].items():
            bytes_of[i] = bytes(of[c] for c in s) if all(c in of for c in s) else s.encode()
        for t in j.get("added_tokens", []):
            bytes_of[t["id"]] = t["content"].encode()
        self.table = Table(bytes_of)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}) if known and self.cuttable else None

    def joined(self, late: bool, text: str) -> list[int]:
        if self.fast and not late:
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def single(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def whole(self, texts: pa.Array) -> np.ndarray:
        """The library looks for special tokens before it looks for words."""
        found = np.full(len(texts), not self.cuttable)
        for s in self.special if self.apart else ():
            found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found


class SentencePiece(Coder):
    """A BPE model of the sentencepiece library that puts a space before each text; pieces come with that space."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_proto=model)
        self.size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(self.size)]
        self.table = Table([bytes([int(n[3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.cuttable = not any(re.search("[^▁]▁", n) for n in names) and "".join(library.encode("a  b ", out_type=str)) == "▁a▁▁b▁"

    def joined(self, late: bool, text: str) -> list[int]:
        return self.library.encode(text[1:], num_threads=1)

    def single(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)

    def whole(self, texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), not self.cuttable)


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, *parts):
    """One per worker, with its files and settings; workers live longer than tasks."""
    key = (kind, *(len(x) if isinstance(x, dict) else hash(x) for x in parts))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(*parts)
    return _LOADED[key]
