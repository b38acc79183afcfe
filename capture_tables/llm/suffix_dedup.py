"""Repeated passages by a sparse suffix array over minimiser positions.

A document is a sequence of words. Of each LEAST = 50 consecutive words, the one at which the
window's smallest SEED-word hash starts is its minimiser; equal windows have it at the same
place, so suffixes at those positions alone show every repeat of 50 words or more. Such a
suffix is kept with its extensions: for every window whose minimiser it is, how far the
window reaches to the left of it, and 64 bits of hash of the whole window, left part, seed and
right part. Rows are sorted by seed, extension and place, and neighbours compared: a window
equal to the one before it repeats a passage that stands earlier. Windows that overlap join to
longer passages, so that matches are extended to their full length left and right.

Each task compares its own rows first and sends of each different window only the earliest
place, so that a passage which a third of all documents share reaches the sorted rows once
for each chunk of text and not once for each document. Suffixes at each seed are counted
first. One that more than HOT suffixes start with sends its windows by their own hashes, so
that its rows spread; only equal windows need to meet. Of equal windows a task holds the
earliest alone.

Windows are equal if their seed, the place in it and their own 64 bits agree. Of n different
windows about one seed some n^2 / 2^65 pairs are taken for equal: one in 37 million for a
million windows, one in 37 for a billion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 50
SEED = 16
#: Suffixes of one seed that are compared in one place.
HOT = 10_000
#: Text handled at once, in bytes; and windows that a task holds of one key before it keeps the
#: earliest of equal ones alone.
CHUNK, HELD = 2 << 20, 800_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Kinds of rows that leave the map side.
_SUFFIX, _SPAN, _SIZE = 0, 1, 2
_SCHEMA = "seed long, kind byte, doc_id long, print long, at int, left int, windows binary"
_NAMES = ["seed", "kind", "doc_id", "print", "at", "left", "windows"]
_TYPES = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    if n:
        out[1:] = np.multiply.accumulate(np.full(n, _BASE))
    return out


def _rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` values, by prefix sums of a polynomial."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    inverse = pow(int(_BASE), -1, 1 << 64)
    down = np.empty(len(words), np.uint64)
    down[0] = 1
    if len(words) > 1:
        down[1:] = np.multiply.accumulate(np.full(len(words) - 1, np.uint64(inverse)))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * down, dtype=np.uint64)))
    up = _powers(len(words) - width)
    return common.mix64((sums[width:] - sums[:-width]) * up)


def _windows(words: np.ndarray, sizes: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each window of `least` words within one document: its start, its minimiser's
    position, the seed hash there and the window's hash."""
    if len(words) < least:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    seeds, whole = _rolling(words, seed), _rolling(words, least)
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero(np.arange(len(whole)) + least <= ends[: len(whole)])
    view = np.lib.stride_tricks.sliding_window_view(seeds, least - seed + 1)
    place = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 17):
        part = starts[lo : lo + (1 << 17)]
        place[lo : lo + len(part)] = part + view[part].argmin(axis=1)
    return starts, place, seeds[place], whole[starts]


def _repeats(key, left, window, doc, prints, start) -> tuple[np.ndarray, np.ndarray]:
    """Sort and compare neighbours: (where an equal window stands at an earlier place, where no
    equal window stands before in that order). Rows at the very same place are the same passage."""
    late, head = np.zeros(len(key), bool), np.ones(len(key), bool)
    whole = window.astype(np.uint64) ^ common.mix64(key.astype(np.uint64) + left.astype(np.uint64) * _BASE)
    order = np.argsort(whole)
    alike = whole[order][1:] == whole[order][:-1]
    some = order[np.concatenate((alike, [False])) | np.concatenate(([False], alike))]  # most stand once
    order = some[np.lexsort((start[some], prints[some], doc[some], window[some], left[some], key[some]))]
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (key[a] == key[b]) & (left[a] == left[b]) & (window[a] == window[b])
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    late[order] = same & ((doc[order] != doc[first]) | (prints[order] != prints[first]) | (start[order] != start[first]))
    head[order] = ~same
    return late, head


def _spans(doc, prints, start, least: int) -> tuple[np.ndarray, ...]:
    """(doc, print, first word, word after the last) of overlapping windows joined."""
    order = np.lexsort((start, prints, doc))
    doc, prints, start = doc[order], prints[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1]) | (start[1:] > start[:-1] + least)
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], prints[at], start[at], start[last] + least


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _span_batch(doc, prints, start, least: int) -> pa.RecordBatch:
    doc, prints, lo, hi = _spans(doc, prints, start, least)
    n = len(doc)
    return _batch([_spread(doc, prints), np.full(n, _SPAN), doc, prints, lo, hi, [None] * n])


def _spread(doc: np.ndarray, prints: np.ndarray) -> np.ndarray:
    return common.mix64(doc.astype(np.uint64) ^ common.mix64(prints.astype(np.uint64))).astype(np.int64)


def _seeds(least: int, seed: int):
    """The seeds of the suffixes of all texts, one for each suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in common.slices(batches, CHUNK):
            scan = common.Scan(part.column(1))
            _, place, seeds, _ = _windows(scan.hashes, scan.per_row(), least, seed)
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            yield seeds[new]

    return run


def _suffixes(counts, least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, CHUNK):
            doc_of, print_of = part.column(0).to_numpy(), part.column(2).to_numpy()
            scan = common.Scan(part.column(1))
            words, sizes = scan.hashes, scan.per_row()
            del scan
            begins, n = np.cumsum(sizes) - sizes, len(sizes)
            yield _batch([_spread(doc_of, print_of), np.full(n, _SIZE), doc_of, print_of, sizes, np.zeros(n, np.int64), [None] * n])
            start, place, seeds, whole = _windows(words, sizes, least, seed)
            if not len(start):
                continue
            row = np.searchsorted(begins, start, "right") - 1  # of empty documents with its begin, the one behind
            doc, prints, at, left = doc_of[row], print_of[row], start - begins[row], place - start
            late, head = _repeats(seeds, left, whole, doc, prints, at)
            if late.any():
                yield _span_batch(doc[late], prints[late], at[late], least)
            keep = np.flatnonzero(head)
            place, start, doc, prints, at, left, seeds, whole = (x[keep] for x in (place, start, doc, prints, at, left, seeds, whole))
            hot = common.at_most(counts.value[(seeds & np.uint64(common.COUNTERS - 1)).astype(np.int64)]) > HOT
            # a row for each run of windows, in order, that share a minimiser; at hot ones for each window
            new = np.ones(len(keep), bool)
            new[1:] = hot[1:] | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
            heads = np.flatnonzero(new)
            key = np.where(hot, common.mix64(seeds ^ common.mix64(whole + left.astype(np.uint64))), seeds)[heads]
            offsets = (np.concatenate((heads, [len(keep)])) * 8).astype(np.int32)
            windows = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(whole).tobytes())])
            columns = [key.astype(np.int64), np.full(len(heads), _SUFFIX, np.int8), doc[heads], prints[heads], at[heads].astype(np.int32), left[heads].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), windows], _NAMES)

    return run


def _neighbours(least: int):
    """Rows of one partition, sorted by seed: the passages that stand elsewhere earlier, and
    the sizes handed through."""

    def windows(batch: pa.RecordBatch) -> list[np.ndarray]:
        """key, left, window, doc, print, start of each window of the rows."""
        key, doc, prints, at, left = (batch.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        _, offsets, data = batch.column(6).buffers()
        offsets = np.frombuffer(offsets, np.int32)[batch.column(6).offset :][: batch.num_rows + 1].astype(np.int64)
        counts = np.diff(offsets) // 8
        window = np.frombuffer(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes(), np.uint64)
        row = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        return [key[row], left[row] - step, window, doc[row], prints[row], at[row] + step]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def compared(x: list[np.ndarray]) -> tuple[pa.RecordBatch | None, np.ndarray]:
            late, head = _repeats(*x)
            return (_span_batch(x[3][late], x[4][late], x[5][late], least) if late.any() else None), head

        for batch in batches:
            kind = batch.column(1).to_numpy()
            if (other := kind != _SUFFIX).any():
                yield batch.filter(pa.array(other))
                batch = batch.filter(pa.array(~other))
            if not batch.num_rows:
                continue
            part = windows(batch)
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last seed may go on
            if cut:
                out, _ = compared([x[:cut] for x in held])
                held = [x[cut:] for x in held]
                if out is not None:
                    yield out
            if len(held[0]) > HELD:
                out, head = compared(held)
                held = [x[head] for x in held]
                if out is not None:
                    yield out
        if held is not None and len(held[0]):
            out, _ = compared(held)
            if out is not None:
                yield out

    return run


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """One row for each different (doc_id, text): doc_id, print (a hash of the text), n_words,
    spans (array of [first, after last] word numbers, from 0, in order, apart from each other),
    n_removed (words in them).

    A word is in a span if it lies in a run of `least` words, white space and the case of A-Z
    apart, that also stands earlier: in a document of smaller doc_id, or before it in its own.
    Null and empty texts have no words. Rows of the same doc_id and text are one document, so
    that none is emptied by its own copy; rows of one doc_id and different texts are several,
    of which the one with the smaller hash comes first. Rows without doc_id take no part. An
    empty table gives an empty one.
    """
    common.let_go(docs.sparkSession)
    text = common.documents(docs)
    counts = docs.sparkSession.sparkContext.broadcast(common.counted(text, _seeds(least, seed)))  # COUNTERS bytes
    rows = text.mapInArrow(_suffixes(counts, least, seed), _SCHEMA)
    rows = rows.repartition("seed").sortWithinPartitions("seed").mapInArrow(_neighbours(least), _SCHEMA)
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.when(F.col("kind") == _SPAN, F.struct(F.col("at").alias("first"), F.col("left").alias("last"))))),
        F.expr("cast(array() as array<struct<first:int,last:int>>)"),
        _join_spans,
    )
    spans = rows.groupBy("doc_id", "print").agg(
        F.max(F.when(F.col("kind") == _SIZE, F.col("at"))).cast("long").alias("n_words"), merged.alias("spans")
    )
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return spans.select("doc_id", "print", "n_words", "spans", removed.alias("n_removed"))


def _join_spans(done, span):
    """Fold step over sorted spans: one that starts within the last, or where it ends, goes on."""
    last = F.try_element_at(done, F.lit(-1))
    goes_on = (F.size(done) > 0) & (last["last"] >= span["first"])
    longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
    return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
        F.concat(done, F.array(span))
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k, spans in enumerate(batch.column(2).to_pylist()):
            scan = common.Scan(batch.column(1).slice(k, 1))
            data, kept, at = scan.data.tobytes(), [], 0
            for s in spans:
                kept.append(data[at : scan.starts[s["first"]]])
                at = int(scan.ends[s["last"] - 1])
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.string())], ["__cut_doc", "__cut_print", "__cut_text"])


def remove_repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """`docs` with repeated passages cut out of their texts; every column stays. Documents of
    which nothing but white space is left go, unless that was so before. Rows without doc_id
    stay as they are."""
    spans = repeats(docs, least, seed).where(F.size("spans") > 0).select("doc_id", "print", "spans")
    cut = (
        common.documents(docs)
        .join(spans, ["doc_id", "print"])
        .dropDuplicates(["doc_id", "print"])
        .select("doc_id", "text", "spans", "print")
        .mapInArrow(_cut, "__cut_doc long, __cut_print long, __cut_text string")
    )
    blank = F.translate("__cut_text", " \t\n\x0b\x0c\r", "") == ""
    text = F.coalesce("__cut_text", "text").alias("text")
    columns = [text if c == "text" else F.col(c) for c in docs.columns]
    own = docs.withColumn("__cut_own", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = own.join(cut, (F.col("doc_id").cast("long") == F.col("__cut_doc")) & (F.col("__cut_own") == F.col("__cut_print")), "left")
    return found.where(F.col("__cut_text").isNull() | ~blank).select(*columns)
