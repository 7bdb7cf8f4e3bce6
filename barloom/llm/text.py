"""Arrow batches of whole texts as numpy arrays: words, their 64-bit hashes and word shingles without a Python loop over characters.

A block holds about `BLOCK` characters of whole texts; a longer text is a block of its own, so memory follows the longest text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 19
U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = [np.cumprod(np.full(size, base, dtype=U64)) for base in (_STEP, _UNSTEP)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edges[::2], edges[1::2]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the codes of each span, the same wherever the span stands."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[:len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, one for each start."""
    if len(words) < k:
        return np.zeros(0, dtype=U64)
    out = np.zeros(len(words) - k + 1, dtype=U64)
    for j in range(k):
        out = out * U64(_STEP) + words[j:len(words) - k + 1 + j]
    return mix(out)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of the list that hold about `size` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, texts set apart by a line feed, and each text's start (one more at the end)."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.cumsum([0, *[len(t) + 1 for t in texts]])


def utf8(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same over UTF-8 bytes."""
    return np.frombuffer(b"\n".join(texts), dtype=np.uint8), np.cumsum([0, *[len(t) + 1 for t in texts]])


def char_table(test: Callable[[str], bool]) -> np.ndarray:
    """A Boolean for each code point."""
    return np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)


def free_name(columns: list[str], base: str) -> str:
    """A column name that none of these is."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def string_lists(batches, *columns: str) -> Iterator[tuple]:
    """Of each Arrow batch: the batch, and the named columns as lists, null texts empty."""
    for batch in batches:
        if batch.num_rows:
            yield (batch, *([x or "" for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in columns))
