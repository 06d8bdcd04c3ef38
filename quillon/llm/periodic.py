"""Periodic runs: stretches of a text that repeat with a fixed number of words, and the text with them collapsed.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and at least
``max(24, 3 * q)`` words that no neighbouring word extends. For every period a grid of positions is laid out, so wide that
every run holds a grid point whose words equal those one period on, and so narrow that all grids together have about
``n * ln(n) / 2`` points. All pairs of period and point of a batch of texts are handled at once: pairs whose eight words behind
or before differ go, prefix hashes answer how far both sides stay equal by one binary search over all pairs, equal stretches
are one run at their smallest period, and each run's words are compared in the end; should a hash have lied, the batch is done
anew with other hash values.

Defined results: a null or empty text has no run and an empty collapsed text; texts are taken whole, those of one batch of
rows together up to ``TOGETHER`` words and a longer text alone; repeated rows each get their row; an empty table gives none.
Extra columns may have any name but those added (``runs``, ``collapsed``), which replace columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, schema_with, slices, utf8

#: A run has at least this many words, and as many periods.
LEAST, PERIODS = 24, 3
#: Words behind or before a grid point that are compared first; an equal stretch has at least twice as many.
GRAM = 8
#: Texts are handled together up to so many words, pairs of period and grid point up to so many.
TOGETHER, PAIRS = 1 << 18, 1 << 20
PRIME = (1 << 31) - 1
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo ``PRIME`` for i below n, by doubling."""
    found = np.ones(n, np.int64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        found[done : done + more] = found[:more] * step % PRIME
        done, step = done + more, step * step % PRIME
    return found


class Prefixes:
    """Polynomial prefix hashes of a sequence of word numbers."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.powers = _powers(int(rng.integers(1 << 20, PRIME)), len(words) + 1)
        values = rng.integers(1, PRIME, int(words.max(initial=0)) + 1)[words]
        self.sums = np.concatenate([[0], np.cumsum(values * self.powers[:-1] % PRIME) % PRIME])

    def grams(self) -> np.ndarray:
        """A hash of the ``GRAM`` words from each position on, whatever the position; the last positions have none alike."""
        n = len(self.sums) - 1
        found = -1 - np.arange(n)
        if n >= GRAM:
            found[: n - GRAM + 1] = (self.sums[GRAM:] - self.sums[:-GRAM]) % PRIME * self.powers[n - np.arange(n - GRAM + 1)] % PRIME
        return found

    def common(self, i: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``i`` on (or before it) equal those ``shift`` further on, at most ``most``, for all pairs at once."""
        low, high, power = np.zeros_like(most), most.copy(), self.powers[shift]
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            a = i - middle if back else i
            b = a + middle
            same = (self.sums[b] - self.sums[a]) % PRIME * power % PRIME == (self.sums[b + shift] - self.sums[a + shift]) % PRIME
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, period, position)`` of all grid points in blocks; positions count from the text's start."""
    periods = sizes // PERIODS
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    gap = np.maximum(LEAST - period, (PERIODS - 1) * period)
    points = -(-(sizes[text] - period) // gap)
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        many = points[at:to]
        which = np.repeat(np.arange(at, to), many)
        step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        yield text[which], period[which], step * gap[which]
        at = to


def maximal_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of every run, by text, start and period; ``words`` holds the texts one behind another."""
    starts = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= LEAST)
    none = np.zeros(0, np.int64)
    seed = 0
    while len(long):
        hashes = Prefixes(words, seed)
        grams = hashes.grams()
        found = [(none,) * 4]
        for text, period, local in _pairs(starts[long], sizes[long]):
            text = long[text]
            i = starts[text] + local
            behind = grams[i] == grams[i + period]
            before = (i >= GRAM) & (grams[i - GRAM] == grams[i - GRAM + period])
            (hit,) = np.nonzero(behind | before)
            text, period, local, i = text[hit], period[hit], local[hit], i[hit]
            left = hashes.common(i, period, local, back=True)
            length = left + hashes.common(i, period, sizes[text] - local - period, back=False) + period
            (hit,) = np.nonzero(length >= np.maximum(LEAST, PERIODS * period))
            found.append((text[hit], (local - left)[hit], length[hit], period[hit]))
        text, start, length, period = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((period, length, start, text))  # of one stretch the smallest period comes first
        text, start, length, period = text[order], start[order], length[order], period[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        text, start, length, period = text[new], start[new], length[new], period[new]
        first = starts[text] + start
        if all(np.array_equal(words[s : s + n - q], words[s + q : s + n]) for s, n, q in zip(first, length, period)):
            order = np.lexsort((period, start, text))
            return text[order], start[order], length[order], period[order]
        seed += 1  # two different stretches had one hash
    return (none,) * 4


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    if not len(start):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return b" ".join([w for w, d in zip(words, np.cumsum(depth[:-1]).tolist()) if not d])


def _solved(texts: list[list[bytes]]) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Number of runs of each text, the runs and the collapsed texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary())
    numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    text, start, length, period = maximal_runs(numbers, sizes)
    counts = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(counts)
    clean = [_collapsed(t, start[e - c : e], length[e - c : e], period[e - c : e]) for t, c, e in zip(texts, counts, ends)]
    return counts, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN)), clean


def collapse(docs: DataFrame, id_column: str = "doc_id", text: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The documents with ``runs`` (start, length, period in words, by start and period) and ``collapsed``, the text without
    repeats: of every run only the first period stays, words joined by one space. ``change`` may rewrite a text's words first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, found, clean = [], [], []
            group: list[list[bytes]] = []
            held = 0

            def solve() -> None:
                n, r, c = _solved(group)
                counts.append(n)
                found.append(r)
                clean.extend(c)

            for key, data in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist()):
                words = data.split()  # bytes: exactly the white space of the word rule
                words = change(key, words) if change else words
                if group and held + len(words) > TOGETHER:
                    solve()
                    group, held = [], 0
                group.append(words)
                held += len(words)
            if group:
                solve()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
            values = pa.concat_arrays(found) if found else pa.array([], _RUN)
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column("_row"), runs, pa.array(clean, pa.string())], names=["_row", "runs", "collapsed"])

    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    kept = docs.select(F.struct(*[docs[f"`{c}`"] for c in others]).alias("_row"), docs[f"`{id_column}`"].alias("_id"), utf8(text).alias("_text"))
    added = arrow_pass(kept, run, schema_with(kept.select("_row"), f"runs {RUNS}, collapsed string"))
    return added.select(*[F.col("_row")[c].alias(c) for c in others], "runs", "collapsed")


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """About a tenth of all texts get a repeating tail, where and how by their id alone; a null id counts as the empty text."""
    h = zlib.crc32(b"" if key is None else str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
