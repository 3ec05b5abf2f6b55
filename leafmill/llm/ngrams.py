"""Hashed n-gram counts of whole texts, made slice by slice with array operations.

The two classifiers (operators 8 and 10) read texts only through these counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are turned into arrays in slices of about so many bytes or documents.
SLICE_BYTES, SLICE_DOCS = 1 << 20, 256


def letters() -> np.ndarray:
    """Bytes as 64 symbols without case: letters, digits, spaces, marks and, for bytes
    above ASCII, their remainder, which tells apart most letters with accents."""
    out = np.full(256, 28, np.int64)
    out[[*b" "]] = 27
    for k, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[c] = 29 + k % 11
    for k in range(26):
        out[[ord("a") + k, ord("A") + k]] = k
    out[ord("0") : ord("9") + 1] = 26
    out[128:] = 40 + np.arange(128) % 24
    return out


def shapes() -> np.ndarray:
    """Bytes as 12 classes of their looks."""
    out = np.full(256, 11, np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    for k, chars in enumerate((b" ", b"\n\r", b".", b",", b"'\"-_/", b"|<>[]{}()=\\", b"!?$%&*#@+~^;:"), 3):
        out[[*chars]] = k
    out[128:] = 10
    return out


LETTERS, SHAPES = letters(), shapes()
N_LETTERS, N_SHAPES, N_SIZES, N_REPEATS = 64 * 64, 12**3, 24, 8
N_ALL = N_LETTERS + N_SHAPES + N_SIZES + N_REPEATS


def slices(texts: list[str]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t.encode())
        size += len(part[-1])
        if size >= SLICE_BYTES or len(part) >= SLICE_DOCS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _spread(codes: np.ndarray, doc: np.ndarray, n: int, width: int, bins: int) -> np.ndarray:
    """Counts of runs of ``width`` codes within each document."""
    base = int(round(bins ** (1 / width)))
    if len(codes) < width:
        return np.zeros((n, bins), np.float32)
    key = codes[: len(codes) - width + 1].copy()
    for k in range(1, width):
        key = key * base + codes[k : len(codes) - width + 1 + k]
    same = doc[: len(key)] == doc[width - 1 :]
    return np.bincount((doc[: len(key)] * bins + key)[same], minlength=n * bins).reshape(n, bins).astype(np.float32)


def letter_pairs(part: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(part), np.uint8)
    doc = np.repeat(np.arange(len(part)), [len(p) for p in part])
    return _spread(LETTERS[data], doc, len(part), 2, N_LETTERS)


def all_counts(part: list[bytes]) -> np.ndarray:
    """Letter pairs, triples of shapes, the length class and how often words repeat."""
    data = np.frombuffer(b"".join(part), np.uint8)
    doc = np.repeat(np.arange(len(part)), [len(p) for p in part])
    out = np.zeros((len(part), N_ALL), np.float32)
    out[:, :N_LETTERS] = _spread(LETTERS[data], doc, len(part), 2, N_LETTERS)
    out[:, N_LETTERS : N_LETTERS + N_SHAPES] = _spread(SHAPES[data], doc, len(part), 3, N_SHAPES)
    for i, p in enumerate(part):
        scale = max(1.0, len(p))
        out[i, N_LETTERS + N_SHAPES + min(N_SIZES - 1, len(p).bit_length())] = 0.02 * scale
        words = p.split()
        share = 1 - len(set(words)) / len(words) if words else 0.0
        out[i, N_LETTERS + N_SHAPES + N_SIZES + min(N_REPEATS - 1, int(share * N_REPEATS))] = 0.1 * scale
    return out
