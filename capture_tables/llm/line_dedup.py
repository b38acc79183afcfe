"""Near-duplicate lines by an exact set-similarity join with prefix filtering.

A line is the set of its words. All words have one order, rarest first, by how often the
corpus holds them. If two sets have a Jaccard similarity of 0.8 or more, the prefixes of
their ordered words share a word, and the places of that word bound their overlap.

Equal sets are brought together first, by 128 bits of hash, and the earliest line of each
stands for all. Such a set goes, by the words of its prefix, into groups of sets that hold
such a word there; in a group a set is matched with the earliest sets that pass the length,
the positional and a bitmap filter. The words of the surviving pairs are fetched and their
Jaccard similarity verified. A line that matches an earlier one is removed.

Sets of up to EXACT words are similar to equal sets only. Words that stand in one prefix
alone start no group. A word that many prefixes hold has its group dealt into blocks, and
each pair of blocks is a group of bounded size. A set whose first candidates all fail their
verification, and that has more, gets all of them in a second pass, so that none is lost.

Words are told apart by 64 bits of hash. Only the words of one pair of lines ever meet, so
that two lines of 50 words are misjudged once in some 10^16 pairs; different sets that agree
in 128 bits are expected once among 10^19 different lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIMILARITY = (4, 5)
#: Words of the largest set that no set but an equal one is similar to (4 of 5 words are 0.8).
EXACT = 3
BLOCK = 4096
#: Candidates that a group hands on for a set before their words are compared.
TRIES = 2
#: Text handled at once, in bytes; a longer document is taken alone.
CHUNK = 1 << 20
#: Pairs that are compared at once.
PAIRS = 1 << 19
#: Places of a sieve for each value it holds, and at most.
SIEVE, SIEVE_MOST = 16, 1 << 29

_SET = "h0 long, h1 long, doc_id long, print long, line int, size int, bits0 long, bits1 long, prefix binary"
_SET_NAMES = [f.split()[0] for f in _SET.split(", ")]
_SET_TYPES = [*[pa.int64()] * 4, *[pa.int32()] * 2, *[pa.int64()] * 2, pa.binary()]
#: Sets with a number, and whether their candidates are still sought.
_NUMBERED = ["id", "doc_id", "size", "bits0", "bits1", "prefix", "open"]
#: Bytes of a word's hash in a prefix: enough to find those that may share it.
PREFIX_BYTES = 5
#: Prefix words that are sent to one shard, on average.
SHARD = 300_000
_ENTRY = np.dtype([("cell", "<u8"), ("id", "<i8"), ("doc", "<i8"), ("size", "<i4"), ("place", "<i4"), ("bits0", "<u8"), ("bits1", "<u8")])
_PAIR = "late long, early long, more boolean"
PLACE = ["doc_id", "print", "line"]


def prefix_size(n):
    """Words of a set of n that a similar set must share one of: n - ceil(0.8 n) + 1."""
    top, bottom = SIMILARITY
    return n - -(-n * top // bottom) + 1


def least_overlap(n, m):
    """Words that sets of n and m must share: ceil(0.8 / 1.8 * (n + m))."""
    top, bottom = SIMILARITY
    return -(-(n + m) * top // (top + bottom))


_READ = f"{common.PARTS}, doc_id long, print long, n_lines long, every array<int>"
_READ_NAMES = [f.split()[0] for f in _READ.split(", ")]


def _read(least: int):
    """Of all texts doc_id, print, n_lines and the numbers of the lines that take part; and the
    task's counts of all words, as rows of common.PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = common.Counts()
        for part in common.slices(batches, CHUNK):
            scan = common.Scan(part.column(1))
            counts.add(scan.hashes)
            if least <= 1:
                row, number, _ = scan.lines()
            else:
                lines = Lines(part.column(1), least=least)
                row, number = lines.row, lines.number
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows)))).astype(np.int32)
            every = pa.ListArray.from_arrays(pa.array(offsets), pa.array(number.astype(np.int32)))
            n_lines = pc.add(pc.count_substring(part.column(1), "\n").cast(pa.int64()), 1)
            none = [pa.nulls(part.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, part.column(0), part.column(2), n_lines, every], _READ_NAMES)
        for batch in counts.parts():
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *none], _READ_NAMES)

    return run


def _prefix_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield _unpacked(batch.column(0))[0]


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of `sizes` values a row, in PREFIX_BYTES bytes each."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PREFIX_BYTES])
    offsets = (np.concatenate(([0], np.cumsum(sizes))) * PREFIX_BYTES).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many in each row) of such a column."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    part = whole[offsets[0] : offsets[-1]].reshape(-1, PREFIX_BYTES)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :PREFIX_BYTES] = part
    return out.view("<u8").ravel(), np.diff(offsets) // PREFIX_BYTES


#: Lines that 24 bits number.
LINES = 1 << 24


class Lines:
    """The lines of a part of the corpus as sets of word hashes, each in the order of `codes`
    (or of the hashes), rarest first: row and number of each line, its size, and the words.
    `wanted` tells by rows and numbers which lines are looked at, if not all."""

    def __init__(self, column: pa.Array, codes: np.ndarray | None = None, least: int = 1, wanted=None):
        scan = common.Scan(column)
        self.row, self.number, words = scan.lines()
        hashes = scan.hashes
        if wanted is not None:
            hit = wanted(self.row, self.number)
            hashes = hashes[np.repeat(hit, words)]
            self.row, self.number, words = self.row[hit], self.number[hit], words[hit]
        line = np.repeat(np.arange(len(words), dtype=np.uint64), words)
        rarity = codes[(hashes & np.uint64(common.COUNTERS - 1)).astype(np.int64)].astype(np.uint64) if codes is not None else np.uint64(0)
        key = line << np.uint64(40) | rarity << np.uint64(32) | hashes >> np.uint64(32)
        order = np.argsort(key)
        ordered = key[order]
        alike = ordered[1:] == ordered[:-1]
        if len(words) > LINES or (hashes[order][1:] != hashes[order][:-1])[alike].any():  # 64 bits are not enough here
            order = np.lexsort((hashes, np.broadcast_to(rarity, len(hashes)), line))
        line, hashes = line[order], hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
        self.words = hashes[new]
        self.size = np.bincount(line[new].astype(np.int64), minlength=len(words))
        if least > 1 and (few := self.size < least).any():
            self.words = self.words[np.repeat(~few, self.size)]
            self.row, self.number, self.size = self.row[~few], self.number[~few], self.size[~few]
        self.heads = np.cumsum(self.size) - self.size

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash for each set."""
        if not len(self.size):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        scrambled = common.mix64(self.words ^ np.uint64(0x5851F42D4C957F2D))
        return tuple(common.mix64(np.add.reduceat(x, self.heads) + self.size.astype(np.uint64)) for x in (scrambled, common.mix64(scrambled)))

    def bits(self) -> list[np.ndarray]:
        """128 bits for each set, each telling whether an odd number of its words fall on it:
        two sets' bits differ in as many places as the sets differ in words at most."""
        where, bit = self.words >> np.uint64(63), np.uint64(1) << (self.words >> np.uint64(57) & np.uint64(63))
        return [np.bitwise_xor.reduceat(np.where(where == k, bit, np.uint64(0)), self.heads) for k in range(2)]


def _sets(counts, least: int):
    """Map side: a row for each different set of a part of the corpus, at its earliest line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, CHUNK):
            lines = Lines(part.column(1), counts.value, least)
            if not len(lines.size):
                continue
            h0, h1 = lines.hashes()
            doc, prints = part.column(0).to_numpy()[lines.row], part.column(2).to_numpy()[lines.row]
            order = np.lexsort((lines.number, prints, doc, h1, h0))
            first = np.ones(len(order), bool)
            first[1:] = (h0[order][1:] != h0[order][:-1]) | (h1[order][1:] != h1[order][:-1])
            at = np.sort(order[first])
            size = np.where(lines.size > EXACT, prefix_size(lines.size), 0)[at]
            words = np.repeat(lines.heads[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            prefix = _packed(lines.words[words], size)
            columns = [h0[at], h1[at], doc[at], prints[at], lines.number[at], lines.size[at], *[b[at] for b in lines.bits()]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, _SET_TYPES, strict=False)] + [prefix], _SET_NAMES)

    return run


class Sieve:
    """A set of 64-bit values in SIEVE bits for each, that lets others through as well, some
    one in ten. Of so many values that it would be larger than SIEVE_MOST bits it lets all
    through: what it lets through is always joined with the values themselves."""

    def __init__(self, values: DataFrame):
        """`values` holds one column of longs."""
        n = values.count()
        self.bits = 1 << max(16, (SIEVE * n).bit_length())
        self.packed = None
        if self.bits > SIEVE_MOST:
            return
        bits = self.bits

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(common.mix64(batch.column(0).to_numpy().astype(np.uint64)) & np.uint64(bits - 1))
                part = at >> np.uint64(16)
                heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                low = [x.astype("<u2").tobytes() for x in np.split(at & np.uint64(0xFFFF), heads[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int64)), pa.array(low, pa.binary())], ["part", "low"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    held.setdefault(k, np.zeros(1 << 16, bool))[np.frombuffer(low.as_buffer(), "<u2")] = True
            for k, part in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(part).tobytes()])], ["part", "low"])

        held = np.zeros(bits // 8, np.uint8)
        parts = values.mapInArrow(mark, "part long, low binary").repartition("part").mapInArrow(join, "part long, low binary")
        for row in parts.collect():  # SIEVE_MOST bits at most
            held[row["part"] << 13 : (row["part"] + 1) << 13] = np.frombuffer(row["low"], np.uint8)
        self.packed = held

    def passes(self, values: np.ndarray) -> np.ndarray:
        if self.packed is None:
            return np.ones(len(values), bool)
        at = common.mix64(values.astype(np.uint64)) & np.uint64(self.bits - 1)
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


#: Flags above the place of a word in its prefix.
_EARLY_BLOCK, _LATE_BLOCK, _OPEN = 1 << 28, 1 << 29, 1 << 30


def _prefixes(counts, shards: int, only_words=None):
    """Rows (shard, entries): the prefix words that others hold there too, each with its set.
    With `only_words` groups of other words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, doc, size, bits0, bits1 = (batch.column(k).to_numpy() for k in range(5))
            words, n = _unpacked(batch.column(5))
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            count = common.at_most(counts.value[(words & np.uint64(common.COUNTERS - 1)).astype(np.int64)])
            keep = count > 1
            if only_words is not None:
                keep &= only_words.value.passes(words)
            row, words, count, place = row[keep], words[keep], count[keep], place[keep]
            if not len(row):
                continue
            blocks = -(-count // BLOCK)
            copy = np.repeat(np.arange(len(row)), blocks)
            own = (common.mix64(ids.astype(np.uint64))[row] % blocks.astype(np.uint64))[copy]
            other = (np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.uint64)
            low, high = np.minimum(own, other), np.maximum(own, other)
            cell = common.mix64(words[copy] + low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F))
            shard = cell % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            r, shard = row[copy][order], shard[order].astype(np.int64)
            place = np.minimum(place, _EARLY_BLOCK - 1)[copy] | np.where(own < other, _EARLY_BLOCK, 0) | np.where(own > other, _LATE_BLOCK, 0)
            place = place[order] | np.where(batch.column(6).to_numpy(zero_copy_only=False)[r], _OPEN, 0)
            columns = [cell[order] >> np.uint64(24), ids[r], doc[r], size[r], place, bits0[r], bits1[r]]
            bounds = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            entries = [_planes([c[lo:hi] for c in columns]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[bounds[:-1]]), pa.array(entries, pa.binary())], ["shard", "entries"])

    return run


def _planes(columns: list[np.ndarray]) -> bytes:
    """Columns of _ENTRY one after the other, numbers as byte planes, which compress well."""
    out = []
    for column, name in zip(columns, _ENTRY.names, strict=True):
        kind = _ENTRY[name]
        out.append(np.ascontiguousarray(column.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes())
    return b"".join(out)


def _from_planes(data: bytes) -> list[np.ndarray]:
    n, at, out = len(data) // _ENTRY.itemsize, 0, []
    for name in _ENTRY.names:
        kind = _ENTRY[name]
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _candidates(x: list[np.ndarray], every: bool, tries: int, pairs: int) -> tuple[np.ndarray, ...]:
    """(late, early, more) of a shard, where `more` says that a set has other candidates: a
    sort by group and size, then each row with those behind it that are not too large."""
    cell, ids, doc, size, place, bits0, bits1 = x
    order = np.lexsort((size, cell))
    cell, ids, doc, size, place, bits0, bits1 = (c[order] for c in (cell, ids, doc, size.astype(np.int64), place.astype(np.int64), bits0, bits1))
    side, open_, place = place >> 28 & 3, place & _OPEN != 0, place & (_EARLY_BLOCK - 1)
    number = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1])))
    width = np.searchsorted(number << 32 | size, number << 32 | size * SIMILARITY[1] // SIMILARITY[0], "right") - np.arange(len(size)) - 1
    total = np.cumsum(width)
    late, early, lo = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + pairs, "right")))
        w = width[lo:hi]
        i = np.repeat(np.arange(lo, hi), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        n, m = size[i], size[j]
        need = least_overlap(n, m)
        ok = (np.minimum(n - place[i], m - place[j]) >= need) & ((side[i] == 0) | (side[i] != side[j]))
        i, j, most = i[ok], j[ok], (n + m - 2 * need)[ok]
        apart = np.bitwise_count(bits0[i] ^ bits0[j]).astype(np.int64) + np.bitwise_count(bits1[i] ^ bits1[j])
        ok = (apart <= most) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        for a, b in ((i[doc[i] >= doc[j]], j[doc[i] >= doc[j]]), (j[doc[j] >= doc[i]], i[doc[j] >= doc[i]])):
            if every:
                a, b = a[open_[a]], b[open_[a]]
            late.append(a)
            early.append(b)
        lo = hi
    late, early = np.concatenate(late), np.concatenate(early)
    if every or not len(late):
        return ids[late], ids[early], np.zeros(len(late), bool)
    order = np.lexsort((ids[early], doc[early], late))
    late, early = late[order], early[order]
    head = np.flatnonzero(np.concatenate(([True], late[1:] != late[:-1])))
    length = np.diff(np.concatenate((head, [len(late)])))
    keep = np.arange(len(late)) - np.repeat(head, length) < tries
    return ids[late[keep]], ids[early[keep]], np.repeat(length > tries, length)[keep]


def _matched(every: bool):
    """Reduce side, over rows sorted by shard: the pairs whose words are to be compared, for
    each set with the earliest others, or with all where `every` (and then of open sets)."""

    def found(blobs: list) -> pa.RecordBatch:
        parts = zip(*[_from_planes(b) for b in blobs], strict=True)
        columns = _candidates([np.concatenate(p) for p in parts], every, TRIES, PAIRS)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["late", "early", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blobs = None, []
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != last and blobs:
                    yield found(blobs)
                    blobs = []
                last = shard
                blobs.append(blob.as_py())
        if blobs:
            yield found(blobs)

    return run


def _pairs(sets: DataFrame, counts, every: bool = False, words=None) -> DataFrame:
    """(late, early, more) of the sets (_NUMBERED)."""
    entries = sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
    rows = sets.mapInArrow(_prefixes(counts, max(8, entries // PREFIX_BYTES // SHARD), words), "shard long, entries binary")
    pairs = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_matched(every), _PAIR)
    return pairs.groupBy("late", "early").agg(F.max("more").alias("more"))


def _place_hash(doc: np.ndarray, prints: np.ndarray, line=None) -> np.ndarray:
    """A number for a document, or for one of its lines."""
    whole = common.mix64(common.mix64(doc.astype(np.uint64)) ^ prints.astype(np.uint64))
    return whole if line is None else common.mix64(whole + line.astype(np.uint64) + np.uint64(1))


def _place_hashes(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place_hash(*[batch.column(k).to_numpy() for k in range(columns)])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    return run


def _words_at(text: DataFrame, places: DataFrame) -> DataFrame:
    """`places` (doc_id, print, line and more) with the words of those lines, as hashes."""
    context, texts = text.sparkSession.sparkContext, places.select("doc_id", "print").distinct()
    of_texts = context.broadcast(Sieve(texts.mapInArrow(_place_hashes(2), "at long")))
    of_lines = context.broadcast(Sieve(places.select(*PLACE).mapInArrow(_place_hashes(3), "at long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(of_texts.value.passes(_place_hash(batch.column(0).to_numpy(), batch.column(2).to_numpy()))))
            for part in common.slices(iter([some]), CHUNK):
                doc, prints = part.column(0).to_numpy(), part.column(2).to_numpy()
                lines = Lines(part.column(1), wanted=lambda row, number: of_lines.value.passes(_place_hash(doc[row], prints[row], number)))
                offsets = pa.array(np.concatenate(([0], np.cumsum(lines.size))).astype(np.int32))
                columns = [doc[lines.row], prints[lines.row], lines.number.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(offsets, pa.array(lines.words.astype(np.int64)))], [*PLACE, "words"])

    found = text.mapInArrow(run, "doc_id long, print long, line int, words array<long>")
    return places.join(found.dropDuplicates(PLACE), PLACE)


def _verified(text: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, ok: for each set of `pairs` (late, early) whether it is similar to an earlier one."""
    wanted = pairs.select(F.col("late").alias("id")).union(pairs.select("early")).distinct()
    places = common.stored(sets.select("id", *PLACE).join(wanted, "id"))
    words = common.stored(_words_at(text, places))
    a, b = (words.select(F.col("id").alias(side), F.struct(*PLACE).alias(f"{side}_at"), F.col("words").alias(f"{side}_words")) for side in ("late", "early"))
    both = pairs.join(a, "late").join(b, "early").where("early_at < late_at")
    top, bottom = SIMILARITY
    shared = F.size(F.array_intersect("late_words", "early_words"))
    ok = shared * bottom >= (F.size("late_words") + F.size("early_words") - shared) * top
    return both.select(F.col("late").alias("id"), ok.alias("ok")).groupBy("id").agg(F.max("ok").alias("ok"))


def _kept_lines(text: DataFrame, read: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, print, line) of the lines that stay out of those that take part."""
    spark = text.sparkSession
    order = spark.sparkContext.broadcast(common.summed(read.where("slice is not null").select("slice", "share", "places", "counts")))  # COUNTERS bytes
    rows = text.mapInArrow(_sets(order, least_words), _SET)
    rest = [name for name in _SET_NAMES if name not in ("h0", "h1")]
    firsts = rows.groupBy("h0", "h1").agg(F.min(F.struct(*rest)).alias("first"))
    sets = common.stored(firsts.select(F.monotonically_increasing_id().alias("id"), *[f"first.{name}" for name in rest]))
    counts = spark.sparkContext.broadcast(common.counted(sets.select("prefix"), _prefix_hashes))  # common.COUNTERS bytes
    numbered = sets.select(*[F.lit(False).alias(c) if c == "open" else c for c in _NUMBERED])
    pairs = common.stored(_pairs(numbered, counts))
    tried = pairs.groupBy(F.col("late").alias("id")).agg(F.max("more").alias("more"))
    checked = common.stored(_verified(text, sets, pairs).join(tried, "id"))
    gone = checked.where("ok").select("id")
    still = checked.where("more and not ok").select("id")
    if not still.isEmpty():
        # the sets left open meet all others of their groups, not only the earliest
        opened = sets.join(still.withColumn("open", F.lit(True)), "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        opened = common.stored(opened.select(*_NUMBERED))
        words = spark.sparkContext.broadcast(Sieve(opened.where("open").select("prefix").mapInArrow(_prefix_words, "word long")))
        more = common.stored(_pairs(opened, counts, True, words).join(pairs.select("late", "early"), ["late", "early"], "left_anti"))
        gone = gone.union(_verified(text, sets, more).where("ok").select("id"))
    return sets.select("id", *PLACE).join(gone, "id", "left_anti").select(*PLACE)


def _prefix_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words in _prefix_hashes(batches):
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64))], ["word"])


def report(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """One row for each different (doc_id, text): doc_id, print (a hash of the text), n_lines,
    n_removed, removed (line numbers in order, from 0).

    Of the lines of `least_words` different words or more those go that repeat or nearly repeat
    an earlier one, a line of a smaller doc_id or one before it in its own document, with a
    Jaccard similarity of word sets of 0.8 or more, whether or not that line is itself removed.

    Null and empty texts have no lines that hold words. Rows of the same doc_id and text are
    one document; rows of one doc_id and different texts are several, of which the one with the
    smaller hash comes first. Rows without doc_id take no part and are left out. An empty table
    gives an empty one.
    """
    text = common.documents(docs)
    read = common.stored(text.mapInArrow(_read(least_words), _READ))
    kept = _kept_lines(text, read, least_words).groupBy("doc_id", "print").agg(F.collect_list("line").alias("kept"))
    sizes = read.where("slice is null").select("doc_id", "print", "n_lines", "every").dropDuplicates(["doc_id", "print"])
    removed = F.array_sort(F.array_except("every", F.coalesce("kept", F.array().cast("array<int>"))))
    found = sizes.join(kept, ["doc_id", "print"], "left").select("doc_id", "print", "n_lines", removed.alias("removed"))
    return found.select("doc_id", "print", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def remove_lines(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """`docs` without the repeated lines in their texts; every column stays. Documents of which
    only white space is left go, unless that was so before. Rows without doc_id stay, and so
    do texts from which nothing goes, as they are."""
    gone = report(docs, least_words).where("n_removed > 0").select(
        F.col("doc_id").alias("__line_doc"), F.col("print").alias("__line_print"), F.col("removed").alias("__line_gone")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    marked = docs.withColumn("__line_key", F.xxhash64(text))
    marked = marked.join(gone, (F.col("doc_id").cast("long") == F.col("__line_doc")) & (F.col("__line_key") == F.col("__line_print")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    short = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    marked = marked.withColumn("__line_text", F.when(F.col("__line_gone").isNotNull(), short))
    blank = F.translate("__line_text", " \t\n\x0b\x0c\r", "") == ""
    columns = [F.coalesce("__line_text", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return marked.where(F.col("__line_text").isNull() | ~blank).select(*columns)
