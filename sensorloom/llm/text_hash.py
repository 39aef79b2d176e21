"""Words of whole texts as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

# Bytes of plain ASCII text: letters and digits stay, capitals turn small, the rest parts words.
_ASCII = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() and b < 128 or b == 95 else 32 for b in range(256)
)
_GAP = re.compile(r"[^\w]+")
_RNG = np.random.default_rng(20250101)
_BY_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_BY_WORD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
BLOCK = 1 << 20


def plain(text: str | None) -> bytes:
    """Lower-cased words of a text, one space between; a word is a run of letters, digits and _."""
    if not text:
        return b""
    if text.isascii():
        return text.encode().translate(_ASCII)
    return _GAP.sub(" ", text.lower()).encode("utf-8", "replace")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_words(buf: bytes, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    a = np.frombuffer(buf, dtype=np.uint8)
    inside = a != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, [np.zeros(0, dtype=np.uint64)] * (1 + len(stems))
    first = np.cumsum(lengths) - lengths
    letters = a[inside].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    terms = letters * _BY_PLACE[place & 4095]
    out = [mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64))]
    if stems:
        run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms)))
        for n in stems:
            part = mixed(run[first + np.minimum(n, lengths)] - run[first] + np.uint64(n << 32))
            out.append(np.where(lengths > n, part, np.uint64(0)))
    return starts, out


def words(texts: list[str | None], prepare: Callable[[str | None], bytes] = plain) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the first word's index of each text (one more at the end)."""
    hashes, first = words_and_stems(texts, (), prepare)
    return hashes[0], first


def words_and_stems(
    texts: list[str | None], stems: tuple[int, ...], prepare: Callable[[str | None], bytes] = plain
) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``words``, with the hashes of the first n bytes of each word for each n in ``stems`` (0 for shorter words)."""
    parts = [prepare(t) for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    buf = b" ".join(parts) + b" "
    starts, hashes, low = [], [], 0
    while low < len(buf):
        high = buf.find(b" ", low + BLOCK)
        high = len(buf) if high < 0 else high
        s, h = _block_words(buf[low:high], stems)
        starts.append(s + low)
        hashes.append(h)
        low = high
    found = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    joined = [np.concatenate(h) for h in zip(*hashes)] or [np.zeros(0, dtype=np.uint64)] * (1 + len(stems))
    return joined, np.searchsorted(found, bounds)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within one text, and the text each belongs to."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _BY_WORD[k]
    whole = owner[:n] == owner[width - 1 :]
    return mixed(total[whole]), owner[:n][whole]
