"""Periodic runs in texts, found online by dyadic square catching.

Words arrive in order. For each power of two a catcher holds the last completed, aligned block of so
many words. With each appended word the text's suffix of a block's length is compared with the
catchers' blocks: where they agree, at a distance of one to two blocks, a square begins to form. It
is extended to the left once and to the right with the words that follow, and squares of one period
that overlap merge into a run. A run is reported when its three periods are complete.

A run of smallest period q in [s, 2s) holds, among its first 3q words, an aligned block of s words and
that block again q words later, so that the catchers miss none. Blocks of fewer than eight words are
not kept: a run of 24 words or more with a shorter period holds a block of eight and its shifted copy.

Null texts have no words. Each row is taken by itself: repeated rows give repeated results. Rows
without doc_id stay. Columns other than doc_id and text play no part, whatever their names. A text of
any length is appended in parts; what is kept of it are its words, once, and their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_and_text, mix64

#: A run has three periods and this many words at least.
LEAST = 24
#: Words of the shortest catchers' blocks.
BLOCK = 8
#: Words appended at once.
PART = 1 << 16


class Catchers:
    """The runs of a growing sequence of whole numbers, up to periods of `longest` words. `append`
    takes the next words, few or many at once; `runs` gives (start, length, period) of what has been
    seen so far, by start and period."""

    def __init__(self, longest: int | None = None):
        self.longest, self.n = longest, 0
        self.words = np.empty(0, np.int64)
        #: For each block size the hashes of windows of this size, from the window at `first` on.
        self.first: list[int] = []
        self.windows: list[np.ndarray] = []
        #: Of each size, the last windows that those of twice the size still need.
        self.rest: list[np.ndarray] = []
        #: Stretches lo <= t < hi in which word t equals word t - period.
        self.open: list[tuple[int, int]] = []  # (lo, period), still growing with the last word
        self.closed: list[tuple[int, int, int]] = []  # (lo, hi, period), of three periods

    def append(self, words: np.ndarray) -> None:
        for at in range(0, len(words), PART):
            self._append(words[at : at + PART])

    def _append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate((self.words, np.empty(max(self.n, PART) if before else self.n, np.int64)))
        self.words[before : self.n] = words
        growing, self.open = self.open, []
        known = [self._keep(lo, self._ahead(before, p), p) for lo, p in growing]
        fresh, first = mix64(words.astype(np.uint64)), before
        size, level, k = 1, 0, 0
        while size // 2 <= self.n and (self.longest is None or size <= max(self.longest, BLOCK)):
            if size > 1:  # windows of twice the size, of two that meet
                half = size // 2
                if len(self.rest) <= level:
                    self.rest.append(np.empty(0, np.uint64))
                joined = np.concatenate((self.rest[level], fresh))
                first -= len(self.rest[level])
                self.rest[level] = joined[max(len(joined) - half, 0) :]
                fresh = mix64(joined[:-half] * np.uint64(0x9E3779B97F4A7C15) + joined[half:]) if len(joined) > half else joined[:0]
                level += 1
            if size >= BLOCK:
                if len(self.windows) <= k:
                    self.windows.append(np.empty(0, np.uint64))
                    self.first.append(first)
                known += self._catch(k, size, fresh, first, known)
                k += 1
            size *= 2

    def _catch(self, k: int, size: int, fresh: np.ndarray, first: int, known: list) -> list[tuple[int, int, int]]:
        """New stretches that the windows ending in the appended words catch."""
        window, start = np.concatenate((self.windows[k], fresh)), self.first[k]
        at = np.arange(first, first + len(fresh))
        block = (at // size - 1) * size
        hits = [(at, block)]
        if size == BLOCK:  # periods within a block
            hits.append((at, at // size * size))
        caught = [(np.empty(0, np.int64),) * 2]
        for j, i in hits:
            held = (i >= start) & (i < j)
            j, i = j[held], i[held]
            same = window[i - start] == window[j - start]
            caught.append((j[same], (j - i)[same]))
        j, period = map(np.concatenate, zip(*caught, strict=True))
        # the windows from the last completed block on are all that later words ask for
        cut = max((first + len(fresh)) // size * size - size - start, 0)
        self.windows[k], self.first[k] = window[cut:], start + cut
        if not len(j):
            return []
        order = np.lexsort((j, period))
        j, period = j[order], period[order]
        fresh_ones = np.ones(len(j), bool)
        by_place = np.argsort(j, kind="stable")
        places = j[by_place]
        for lo, hi, p in known:  # a square inside a known run merges into it
            if hi - lo >= size:
                near = by_place[np.searchsorted(places, lo) : np.searchsorted(places, hi - size, "right")]
                fresh_ones[near[(period[near] % p == 0) & (j[near] - period[near] >= lo - p)]] = False
        j, period = j[fresh_ones], period[fresh_ones]
        found, bounds = [], [*np.flatnonzero(np.diff(period, prepend=-1)), len(j)]
        for head, end in pairwise(bounds):
            p, c = int(period[head]), head
            while c < end:
                t = int(j[c])
                lo, hi = self._behind(t, p), self._ahead(t, p)
                if hi - lo >= size:  # else two windows' hashes agree by chance
                    found.append(self._keep(lo, hi, p))
                c = max(c + 1, head + int(np.searchsorted(j[head:end], hi)))
        return found

    def _keep(self, lo: int, hi: int, p: int) -> tuple[int, int, int]:
        if hi == self.n:
            self.open.append((lo, p))
        elif hi - lo + p >= max(LEAST, 3 * p):
            self.closed.append((lo, hi, p))
        return lo, hi, p

    def _ahead(self, t: int, p: int) -> int:
        """The first word from t on that differs from the one p words before it."""
        width = 64
        while t < self.n:
            end = min(t + width, self.n)
            differ = self.words[t:end] != self.words[t - p : end - p]
            if differ.any():
                return t + int(differ.argmax())
            t, width = end, width * 4
        return self.n

    def _behind(self, t: int, p: int) -> int:
        """The start of the stretch of equal words that ends before t."""
        width = 64
        while t > p:
            end = max(t - width, p)
            differ = (self.words[end:t] != self.words[end - p : t - p])[::-1]
            if differ.any():
                return t - int(differ.argmax())
            t, width = end, width * 4
        return p

    def runs(self) -> list[tuple[int, int, int]]:
        ended = self.closed + [(lo, self.n, p) for lo, p in self.open]
        smallest: dict[tuple[int, int], int] = {}
        for lo, hi, p in ended:  # a stretch with several periods has the smallest one
            where, length = (lo - p, hi), hi - lo + p
            if length >= max(LEAST, 3 * p):
                smallest[where] = min(p, smallest.get(where, p))
        return sorted((start, hi - start, p) for (start, hi), p in smallest.items())


def _classes(lengths: list[int]) -> list[list[int]]:
    """The texts' numbers, those of similar length together; texts too short for a run left out."""
    of: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        if n >= LEAST:
            of.setdefault(n.bit_length(), []).append(k)
    return list(of.values())


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words. Lists of similar length follow each other in one sequence,
    parted by numbers that stand nowhere else."""
    found: list[list] = [[] for _ in texts]
    for alike in _classes([len(t) for t in texts]):
        numbers: dict[bytes, int] = {}
        starts, n, parts = [], 0, []
        for k in alike:
            parts += [np.fromiter(map(numbers.setdefault, texts[k], count(n)), np.int64, len(texts[k])), np.array([-1 - n])]
            starts.append(n)
            n += len(texts[k]) + 1
        catchers, at = Catchers(max(len(texts[k]) for k in alike) // 3), 0
        catchers.append(np.concatenate(parts))
        for start, length, period in catchers.runs():
            while at + 1 < len(starts) and starts[at + 1] <= start:
                at += 1
            found[alike[at]].append((start - starts[at], length, period))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly, then of smallest start and period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, strongest struct<start: long, length: long, period: long>, collapsed string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    named = lambda r: dict(zip(("start", "length", "period"), r, strict=True)) if r else None
    for ids, texts in chunks(batches):
        words = [t.encode().split() for t in texts]
        found, kept = runs_of(words), []
        for own, runs in zip(words, found, strict=True):
            if runs:
                mark = np.zeros(len(own) + 1, np.int64)
                for start, length, period in runs:
                    mark[start + period] += 1
                    mark[start + length] -= 1
                own = compress(own, np.cumsum(mark[:-1]) == 0)
            kept.append(b" ".join(own).decode())
        columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([[named(r) for r in runs] for runs in found], pa.list_(run)), pa.array([named(strongest(r)) for r in found], run), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "strongest", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period), strongest (of
    greatest length / period, null without runs) and collapsed, the text's words joined by spaces
    without those that any run holds behind its first period. No rows are moved."""
    return id_and_text(docs).mapInArrow(_rows, SCHEMA)


def repeating(docs: DataFrame, place: Column) -> DataFrame:
    """doc_id and text; of a document whose `place` (a whole number) is divisible by ten, the words
    from a certain one on repeat the first p of themselves; both follow from `place`. Documents
    without a word, or without place, stay as they are."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(F.col("_h") / 10).cast("long")
    one = id_and_text(docs).select("doc_id", "text", place.cast("long").alias("_h"))
    chosen = one.select("doc_id", "text", g.alias("_g"), F.when(F.col("_h") % 10 == 0, words).alias("_w"))
    n = F.size("_w").cast("long")
    a = F.when(n > 0, F.col("_g") % n)
    set_up = chosen.select("doc_id", "text", "_w", a.alias("_a"), (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("long").alias("_p"))
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))
    places = F.sequence(F.lit(0).cast("long"), F.size("_w").cast("long") - 1)
    again = F.transform(places, lambda i: F.element_at(F.col("_w"), (at(i) + 1).cast("int")))
    return set_up.select("doc_id", F.when(F.col("_a").isNull(), F.col("text")).otherwise(F.concat_ws(" ", again)).alias("text"))
