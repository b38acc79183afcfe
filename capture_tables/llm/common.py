"""What the corpus operators share: input shaping, the shared folder and text chunks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_tables.functions.shared import shared_path

#: Text handled at once inside a task, in bytes; a longer document is taken alone.
CHUNK_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, a null text as the empty one; other columns are dropped,
    so that none of them can clash with an operator's own."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, print (a hash of the text): rows of one doc_id and different texts are
    documents of their own."""
    text = id_and_text(docs).where("doc_id is not null")
    return text.select("doc_id", "text", F.xxhash64("text").alias("print"))


def id_modulo(divisor: int):
    """crc32 of the doc_id's decimal text, modulo `divisor`."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor))


_folders: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already; the folder then stays
        return


#: Of each table that `stored` wrote its path and a weak reference to the JVM's listing of its files,
#: which every plan that reads the table holds on to.
_tables: list[tuple[str, object]] = []


def let_go(spark: SparkSession) -> None:
    """Delete what no DataFrame can ask for any more: stored tables that no plan reads, and shuffles,
    whose files Spark deletes once the driver's JVM has collected them. Left alone that may take half
    an hour, and an executor's disk holds what earlier steps left behind."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    for table in list(_tables):
        path, listing = table
        if listing.get() is None:
            _tables.remove(table)
            _remove(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: lineage ends
    here, and a lost executor costs nothing that was finished. A table goes when no plan reads it
    any more, and an application's folder when the driver ends: results may be read until then."""
    spark, schema = df.sparkSession, df.schema
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = shared_path(spark, "stored")
        _tables.clear()  # of an application that ended, in one of whose folders they lay
        atexit.register(_remove, spark, _folders[app])
    path = f"{_folders[app]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    let_go(spark)
    found = spark.read.schema(schema).parquet(path)
    listing = found._jdf.queryExecution().analyzed().relation().location()
    _tables.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(listing)))
    return found


def _trimmed() -> None:
    """Give free memory back: a worker that is kept for the next task holds none of this one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple]:
    """Lists (doc ids, texts, *other columns) of up to `limit` bytes of text, never across
    Arrow batches. The first two columns are doc_id and text."""
    for batch in batches:
        start = size = 0
        for k, length in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if size and size + (length or 0) > limit:
                yield tuple(column.to_pylist() for column in batch.slice(start, k - start).columns)
                start, size = k, 0
            size += length or 0
        if start < batch.num_rows:
            yield tuple(column.to_pylist() for column in batch.slice(start).columns)
        del batch
    _trimmed()


def slices(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of up to `limit` bytes of text (the second column), as they are."""
    for batch in batches:
        start = size = 0
        for k, length in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if size and size + (length or 0) > limit:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch  # freed before the next one comes: executors run several such tasks
    _trimmed()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of text hashed at once; a longer word is hashed alone.
_SEGMENT = 1 << 16
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: What is kept of eight bytes, by the number of those that belong to the word.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lane(eight: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """A value for the eight bytes that stand at a place of a word, counted in eights."""
    key = mix64(np.atleast_1d(np.asarray(place, np.uint64)) + np.uint64(0xA0761D6478BD642F))
    return mix64(eight ^ key)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 bits for each word of the bytes: the sum of scrambled lanes of eight bytes, each with a key
    of its place, scrambled again with the length."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    total = _lane(eights[starts] & _KEPT[np.minimum(lengths, 8)], 0)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) // 8
        heads = np.cumsum(more) - more
        place = np.arange(more.sum()) - np.repeat(heads, more) + 1
        left = np.repeat(lengths[long], more) - 8 * place
        lanes = _lane(eights[np.repeat(starts[long], more) + 8 * place] & _KEPT[np.minimum(left, 8)], place)
        total[long] += np.add.reduceat(lanes, heads)
    return mix64(total + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Scan:
    """The words `[^\\x20\\x09-\\x0D]+` of a string column without nulls, A-Z lower-cased, found
    and hashed as whole arrays: `hashes` (64 bits), `starts` and `ends` (bytes in `data`), and
    `bounds`, where each row's text starts in `data`, with the last one's end. With `beginnings`,
    numbers of bytes, `begun` has for each (places, hashes): the longer words, by these first
    bytes. `gap` tells which bytes part words."""

    def __init__(self, column: pa.Array, beginnings: tuple[int, ...] = (), gap: np.ndarray = _SPACE):
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.data, self.bounds = whole[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(self.data)
        word = ~gap[self.data]
        first = np.zeros(n + 1, bool)
        first[self.bounds] = True
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | first[1:n]
        end[:-1] &= ~word[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.hashes = np.empty(len(self.starts), np.uint64)
        begun: list[list] = [[(np.empty(0, np.int64), np.empty(0, np.uint64))] for _ in beginnings]
        lo = 0
        while lo < len(self.starts):
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + _SEGMENT, "right")))
            part = _LOWER[self.data[base : self.ends[hi - 1]]]
            a, lengths = self.starts[lo:hi] - base, self.ends[lo:hi] - self.starts[lo:hi]
            self.hashes[lo:hi] = word_hashes(part, a, lengths)
            for found, k in zip(begun, beginnings, strict=True):
                long = np.flatnonzero(lengths > k)
                found.append((long + lo, ~word_hashes(part, a[long], np.full(len(long), k))))
            lo = hi
        self.begun = [tuple(map(np.concatenate, zip(*found, strict=True))) for found in begun]

    def __len__(self) -> int:
        return len(self.hashes)

    def per_row(self) -> np.ndarray:
        """The number of words of each row."""
        return np.diff(np.searchsorted(self.starts, self.bounds))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number in its row's text from 0, number of words) of each line with a word."""
        breaks = np.flatnonzero(self.data == 10)
        rows = np.searchsorted(self.bounds[:-1], breaks, "right") - 1
        heads = np.searchsorted(breaks, self.bounds[:-1])
        row = np.concatenate((np.arange(len(self.bounds) - 1), rows))
        number = np.concatenate((np.zeros(len(self.bounds) - 1, np.int64), np.arange(len(breaks)) - heads[rows] + 1))
        order = np.lexsort((number, row))
        row, number = row[order], number[order]
        first = np.searchsorted(self.starts, np.concatenate((self.bounds[:-1], breaks))[order])
        words = np.diff(np.concatenate((first, [len(self)])))
        full = words > 0
        return row[full], number[full], words[full]


#: Counters of values by their hash; a value shares one with others that hash alike, so that a
#: count is an upper bound. A task's sums are cut into SLICES, and those added in SHARES first.
COUNTERS = 1 << 22
SLICES, SHARES = 64, 16


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact below 200, then by powers of two."""
    return np.where(counts < 200, counts, np.minimum(192 + np.ceil(np.log2(np.maximum(counts, 1))), 255)).astype(np.uint8)


def at_most(codes: np.ndarray) -> np.ndarray:
    """The largest count that a code stands for."""
    c = codes.astype(np.int64)
    return np.where(c < 200, c, 1 << np.clip(c - 192, 0, 62))


#: Rows of partial counts.
PARTS = "slice int, share int, places binary, counts binary"


def _packed_counts(slices, share: int) -> Iterator[pa.RecordBatch]:
    for k, total in slices:
        at = np.flatnonzero(total)
        if len(at):
            columns = [[k], [share], [at.astype("<u2").tobytes()], [np.minimum(total[at], (1 << 31) - 1).astype("<i4").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["slice", "share", "places", "counts"])


class Counts:
    """A task's own counters."""

    def __init__(self):
        self.total = np.zeros(COUNTERS, np.int32)

    def add(self, values: np.ndarray) -> None:
        np.add.at(self.total, (values & np.uint64(COUNTERS - 1)).astype(np.int64), 1)

    def parts(self) -> Iterator[pa.RecordBatch]:
        """Rows of PARTS, one for each slice."""
        yield from _packed_counts(enumerate(self.total.reshape(SLICES, -1)), TaskContext.get().partitionId() % SHARES)


def summed(parts: DataFrame) -> np.ndarray:
    """The codes of all counters from all tasks' rows of PARTS, added in two steps as they arrive."""
    width = COUNTERS // SLICES

    def totals(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, counts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                total = out.setdefault(k, np.zeros(width, np.int64))
                total[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<i4")
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed_counts(totals(batches).items(), TaskContext.get().partitionId() % SHARES)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, total in totals(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_codes(total).tobytes()])], ["slice", "codes"])

    out = np.zeros((SLICES, width), np.uint8)
    for row in parts.repartition("slice", "share").mapInArrow(add, PARTS).repartition("slice").mapInArrow(codes, "slice int, codes binary").collect():
        out[row["slice"]] = np.frombuffer(row["codes"], np.uint8)  # of COUNTERS bytes in all
    return out.ravel()


def counted(rows: DataFrame, hashes) -> np.ndarray:
    """How often each counter's values occur in all rows, as codes. `hashes` gives arrays of
    64-bit values from batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for values in hashes(batches):
            counts.add(values)
        yield from counts.parts()

    return summed(rows.mapInArrow(count, PARTS))
