"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Equal fingerprints are one class, so only distinct fingerprints are compared. A tile holds
the fingerprints whose four 16-bit quarters have the same population counts. Two
fingerprints that differ in r bits have population counts that differ, summed over the
quarters, by at most r; so tile pairs whose counts differ by more are skipped unread, and
within the rest every pair is compared by numpy exclusive-or and bit counts. A tile of more
than `BLOCK` fingerprints is dealt into blocks, and each pair of blocks is a task group of
bounded size. A group hands on a spanning forest of the links it found, at most one row for
each fingerprint in it, which joins the same fingerprints as all the links would.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components, spanning_forest

SHINGLE = 3
RADIUS = 2
BLOCK = 4096
_SEED = 42


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the shingles of `width` words; 0 where there is no word."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], _SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in common.chunks(batches):
        found = np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row; a null text counts as empty."""
    return common.id_and_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _quarters(fp):
    """Population counts of the four 16-bit quarters, packed five bits each."""
    parts = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return sum((p.cast("int") * F.lit(32**k) for k, p in enumerate(parts)), F.lit(0))


def _near_tiles(radius: int) -> list[tuple[int, ...]]:
    steps = range(-radius, radius + 1)
    return [d for d in product(steps, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def _compare(radius: int):
    def links(cell: np.ndarray, role: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the pairs within the radius, for rows of a single cell."""
        left, right = fp[role == 0], fp[role == 1]
        if not len(left):
            return left, left
        own = not len(right)  # a block against itself
        other = left if own else right
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 512):
            near = np.bitwise_count(left[at : at + 512, None] ^ other[None, :]) <= radius
            i, j = np.nonzero(near)
            i += at
            keep = i < j if own else slice(None)
            ends.append(spanning_forest(left[i[keep]], other[j[keep]]))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        return spanning_forest(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            edges = np.flatnonzero(np.diff(rest[0])) + 1
            bounds = [0, *edges.tolist()]
            if batch is None:
                bounds.append(len(rest[0]))
            found = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    fp = rest[2][lo:hi].astype(np.uint64)
                    a, b = links(rest[0][lo:hi], rest[1][lo:hi], fp)
                    if len(a):
                        found.append((a, b))
            rest = [x[bounds[-1] :] for x in rest]
            if found:
                a, b = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints of `distinct` (fp long, no repeats) that
    join all fingerprints within `radius` bits of each other."""
    tiled = distinct.select("fp", _quarters(F.col("fp")).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    tiled = tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    shifts = F.explode(F.array(*[F.lit(sum(s * 32**k for k, s in enumerate(d))) for d in _near_tiles(radius)]))
    pairs = (
        sizes.select("tile", "blocks", shifts.alias("shift"))
        .select("tile", "blocks", (F.col("tile") + F.col("shift")).alias("other"))
        .join(sizes.select(F.col("tile").alias("other"), F.col("blocks").alias("other_blocks")), "other")
    )
    cells = (
        pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
        .where("tile <> other or i <= j")
        .withColumn("cell", F.xxhash64("tile", "i", "other", "j"))
    )
    ends = cells.select(
        "cell",
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("tile"), F.col("i").alias("block"), F.lit(0).alias("role")),
                    F.struct(
                        F.col("other").alias("tile"),
                        F.col("j").alias("block"),
                        F.when(F.expr("tile = other and i = j"), 0).otherwise(1).alias("role"),
                    ),
                )
            )
        ).alias("end"),
    ).select("cell", "end.*")
    rows = tiled.join(ends, ["tile", "block"]).select("cell", "role", "fp")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(radius), "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id that links reach).

    Null or empty texts have fingerprint 0 and link like any other. Rows that repeat a doc_id
    are kept. Rows without doc_id are classed too, but name no component: theirs is null where
    no row with an id is reached. An empty table gives an empty one.
    """
    prints = common.stored(fingerprints(docs))
    classes = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(classes.select("fp"), radius, block))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay: one document of each component, the smallest doc_id.
    Rows without doc_id stay, and so do rows that repeat the doc_id of one that stays."""
    found = components(docs.where("doc_id is not null"), radius)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
