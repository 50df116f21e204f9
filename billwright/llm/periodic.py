"""Periodic runs of words by an enhanced suffix array, without tree nodes.

A run is a stretch of words that repeats with a smallest period and can't be
made longer at either end. Its last square, the two periods at its end, is a
branching tandem: the words after its two halves differ. Both halves then meet
in the LCP interval whose depth is the period, in different children, so one
of them lies in a child that is not the largest. For the suffixes of such
children alone, the inverse suffix array tells whether the suffix one period
on, or back, is in the same interval. Each square found is rotated to the left
as far as its words repeat, which gives the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common

#: Bytes of text whose words are sorted together; a longer text is sorted alone.
BATCH_BYTES = 2_000_000

Run = tuple[int, int, int]


class SuffixArray:
    """Suffix array, its inverse and the LCP array over several documents of word numbers.

    Every document ends with a number of its own, so no common prefix crosses
    an end, and suffixes are sorted by document first, so that no interval
    holds suffixes of two. ``words`` has these end numbers in place.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray) -> None:
        self.words, n = words, len(words)
        key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        rank = self._starts(key[order], order, n)
        levels, length = [rank], 1
        tied = self._tied(rank)
        while len(tied):
            # suffixes that agree on ``length`` words are sorted by the rank of what follows
            pair = rank[tied].astype(np.int64) * n + rank[tied + length]
            at = np.argsort(pair, kind="stable")
            tied, pair = tied[at], pair[at]
            first = pair // n
            place = np.arange(len(tied))
            new_group = np.r_[True, first[1:] != first[:-1]]
            new_pair = np.r_[True, pair[1:] != pair[:-1]]
            group_at = np.maximum.accumulate(np.where(new_group, place, 0))
            pair_at = np.maximum.accumulate(np.where(new_pair, place, 0))
            rank = rank.copy()
            rank[tied] = first + (pair_at - group_at)
            levels.append(rank)
            length *= 2
            alone = new_pair & np.r_[new_pair[1:], True]
            tied = tied[~alone]
        self.inverse = rank
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        self.lcp = self._lcp(levels)

    @staticmethod
    def _starts(key: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        """Of each suffix the number of suffixes with a smaller key."""
        new = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return rank

    @staticmethod
    def _tied(rank: np.ndarray) -> np.ndarray:
        """The suffixes that share their rank, in order of place."""
        return np.nonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)[0]

    def _lcp(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each suffix with the one sorted before it; 0 for the first."""
        lcp = np.zeros(len(self.words), np.int64)
        near = np.nonzero(levels[0][self.suffixes[1:]] == levels[0][self.suffixes[:-1]])[0] + 1 if len(lcp) else np.zeros(0, np.int64)
        left, right = self.suffixes[near - 1], self.suffixes[near]
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][left] == levels[k][right]
            lcp[near] += same * (1 << k)
            left, right = left + (same << k), right + (same << k)
        return lcp

    def smaller_children(self, least: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(depth, start, end, child start, child end) of intervals of ``least`` suffixes or more, for all children but the largest."""
        lcp, n = self.lcp, len(self.lcp)
        bounds = np.nonzero(lcp == 0)[0]
        ends = np.r_[bounds[1:], n] if n else bounds
        wide = ends - bounds >= least  # blocks of one first word
        for first, last in zip(bounds[wide].tolist(), ends[wide].tolist()):
            depths = lcp[first + 1 : last].tolist()
            depths.append(0)
            # of each open interval: depth, start, and where its children start
            stack: list[tuple[int, int, list[int]]] = []
            for at, depth in enumerate(depths, first + 1):
                start = at - 1
                while stack and stack[-1][0] > depth:
                    inner, start, children = stack.pop()
                    if at - start >= least:
                        children.append(at)
                        sizes = [b - a for a, b in zip(children, children[1:])]
                        largest = sizes.index(max(sizes))
                        for k in range(len(sizes)):
                            if k != largest:
                                yield inner, start, at, children[k], children[k + 1]
                if depth:
                    if stack and stack[-1][0] == depth:
                        stack[-1][2].append(at)
                    else:
                        stack.append((depth, start, [start, at]))

    def tandems(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of every branching tandem whose first half occurs ``least`` times or more, one period apart up to its end."""
        found = np.fromiter((x for c in self.smaller_children(max(2, least)) for x in c), np.int64).reshape(-1, 5)
        if not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = found[:, 4] - found[:, 3]
        row = np.repeat(np.arange(len(found)), size)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + found[row, 3]
        depth, lo, hi, here = found[row, 0], found[row, 1], found[row, 2], self.suffixes[rank]
        starts, periods = [], []
        for start in (here, here - depth):
            good = np.ones(len(start), bool)
            # the other half, and for longer runs the periods before, are in the interval too
            for step in range(2 - least, 2):
                good &= self._within(start + step * depth, lo, hi)
            s, p = start[good], depth[good]
            branching = self.words[s + p] != self.words[s + 2 * p]
            starts.append(s[branching])
            periods.append(p[branching])
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
        return both[0], both[1]

    def _within(self, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        inside = (suffix >= 0) & (suffix < len(self.inverse))
        rank = self.inverse[np.where(inside, suffix, 0)]
        return inside & (rank >= lo) & (rank < hi)


def _rotated(words: np.ndarray, start: int, period: int, floor: int) -> int:
    """Where the run of a square begins: the words are compared to the left until they differ."""
    step = 32
    while start > floor:
        low = max(floor, start - step)
        differ = np.nonzero(words[low:start] != words[low + period : start + period])[0]
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return start


def find_runs(documents: list[np.ndarray], exponent: int = 4, least: int = 6) -> list[list[Run]]:
    """(start, length, period) of the runs of each document of word numbers, by start, then period.

    ``exponent`` is the least number of whole periods (2 or more), ``least``
    the least number of words.
    """
    sizes = np.array([len(d) for d in documents], np.int64)
    runs: list[list[Run]] = [[] for _ in documents]
    if not len(sizes) or sizes.max() < least:
        return runs
    top = max((int(d.max()) for d in documents if len(d)), default=0) + 1
    # each document is followed by a number of its own
    words = np.concatenate([np.r_[d, top + i] for i, d in enumerate(documents)]).astype(np.int64)
    doc = np.repeat(np.arange(len(documents)), sizes + 1)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    starts, periods = SuffixArray(words, doc).tandems(exponent)
    ends = starts + 2 * periods
    at_end: tuple[int, list[tuple[int, int]]] = (-1, [])
    for k in np.lexsort((periods, ends)):
        start, period, end = int(starts[k]), int(periods[k]), int(ends[k])
        if end != at_end[0]:
            at_end = (end, [])
        # a square within a run of a divisor of its period is no run of its own
        if any(period % p == 0 and start >= a for p, a in at_end[1]):
            continue
        floor = int(begin[doc[start]])
        a = _rotated(words, start, period, floor)
        at_end[1].append((period, a))
        if end - a >= max(least, exponent * period):
            runs[int(doc[start])].append((a - floor, end - a, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def _looped(n: int, checksum: int) -> np.ndarray:
    """Places of the original words of a text whose end is replaced by a loop of its own words."""
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _summary(words: list[bytes], runs: list[Run]) -> tuple:
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
        depth = np.zeros(len(words) + 1, np.int64)
        for s, length, q in runs:
            depth[s + q] += 1
            depth[s + length] -= 1
        words = [words[i] for i in np.nonzero(np.cumsum(depth)[:-1] == 0)[0].tolist()]
    else:
        best = (None,) * 4
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), b" ".join(words).decode()


COLUMNS = [
    ("n_runs", pa.int64(), T.LongType()),
    ("start", pa.int64(), T.LongType()),
    ("length", pa.int64(), T.LongType()),
    ("period", pa.int64(), T.LongType()),
    ("exponent_milli", pa.int64(), T.LongType()),
    ("runs_sha256", pa.string(), T.StringType()),
    ("collapsed_sha256", pa.string(), T.StringType()),
    ("collapsed", pa.string(), T.StringType()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
]


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6, loop: str | None = None, texts: bool = True
) -> DataFrame:
    """The runs of every text and the text with each run cut to one period.

    A text's words are what lies between the bytes 20 and 09 to 0D. A run is a
    stretch of at least ``least`` words and ``exponent`` times its smallest
    period that no word before or after it continues. Of its words those after
    the first period are dropped, unless none of its runs has them so; kept
    words are joined by one space. Gives the id column, ``n_runs``, the
    longest run (the first, then the one of the least period if several are as
    long; null without a run) as ``start``, ``length``, ``period`` and
    ``exponent_milli``, digests of all runs and of the text left, and with
    ``texts`` both themselves. ``loop`` names a column of unsigned checksums:
    of the texts where it is a multiple of ten, a stretch at the end is first
    replaced by a loop of its own words, planted repeats to test with.

    Row by row without a shuffle: a null or empty text has no words and no
    runs, repeated rows give a row each, null ids are kept, no other columns
    are read. Memory grows with the longest text, not with the table.
    """
    common.ship(docs.sparkSession)
    chosen = COLUMNS if texts else COLUMNS[:-2]
    schema = T.StructType([common.field(docs, id_col), *[T.StructField(name, kind) for name, _, kind in chosen]])
    checksum = F.col(loop).cast("long") if loop else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                split = [t.encode().split() for t in common.texts(batch, 1)]
                for k, h in enumerate(batch.column(2).to_pylist()):
                    if h is not None and h % 10 == 0 and split[k]:
                        split[k] = [split[k][i] for i in _looped(len(split[k]), h).tolist()]
                numbers = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
                at = np.cumsum([len(words) for words in split])
                found = find_runs(np.split(numbers, at[:-1]), exponent, least)
                rows = [_summary(words, runs) for words, runs in zip(split, found)]
                columns = list(zip(*[(*r, [dict(zip(("start", "length", "period"), x)) for x in runs]) for r, runs in zip(rows, found)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(columns[i], kind) for i, (_, kind, _) in enumerate(chosen)]],
                    names=[id_col, *[name for name, _, _ in chosen]],
                )

    picked = docs.select(id_col, F.col(text_col).cast("string").alias("_text"), checksum.alias("_loop"))
    return picked.mapInArrow(run, schema)
