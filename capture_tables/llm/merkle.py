"""Merkle manifests of tables: a digest of each row, a tree of them for each group, a tree of the
groups' roots, and proofs of single rows.

A tree takes every three neighbouring nodes together, the last ones fewer. It is built in aligned
blocks of 3^7 leaves: rows are numbered within their group by a sort over ranges, blocks are dealt
out by group and number, and the blocks' roots are the leaves of the next trees above, until each
group has one. So no task holds more than a block, whatever a group's size.

The tree is persistent. A changed leaf makes a version that copies its ancestors within the block
and shares all other nodes; the version goes on in the trees above, along the path that all leaves of
its block share, and ends in the root that a verifier would compute.

Null values, empty texts and texts of any length are leaves like others; repeated rows are leaves of
their own, rows of one doc_id follow by their digests, and rows without it come first. Columns that
are not named play no part. An empty table has an empty manifest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Children of a node, and levels of a block.
FAN, LEVELS = 3, 7
#: What the leaf of a document tells, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(row: dict[str, Column]) -> Column:
    """Lower-case hexadecimal SHA-256 of values, each with its length in bytes before it, null as `-`."""
    said = [v.cast("string") for v in row.values()]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in said]), 256)


def joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Block:
    """The levels of one block's tree, from the leaves up, `levels` at most. Its last level is one
    node: a block without others beside it has as many levels as the whole tree needs."""

    def __init__(self, leaves: list[str], levels: int = LEVELS, alone: bool = True):
        self.nodes = [leaves]
        while len(self.nodes) <= levels and not (alone and len(self.nodes[-1]) == 1):
            last = self.nodes[-1]
            self.nodes.append([joined(last[k : k + FAN]) for k in range(0, len(last), FAN)])

    @property
    def root(self) -> str:
        return self.nodes[-1][0]

    def path(self, k: int) -> list[tuple[str, str]]:
        """The siblings before and behind leaf k and its ancestors, level by level."""
        found = []
        for level in self.nodes[:-1]:
            at = k // FAN * FAN
            found.append(("".join(level[at:k]), "".join(level[k + 1 : at + FAN])))
            k //= FAN
        return found

    def version(self, k: int, leaf: str) -> str:
        """The root of a version in which leaf k is another one: only its ancestors are copied."""
        return folded(leaf, self.path(k))


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for before, behind in path:
        node = joined([before, node, behind])
    return node


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their task and number in it within their group, from 0."""
    part, group, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        numbers = []
        for value in batch.column(0).to_pylist():
            group, n = value, n + 1 if value == group else 0
            numbers.append(n)
        columns = [*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "number"])


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows, stored, with `number`: their place within their group, from 0. Each task numbers its
    range of the sort; only of the group that a task begins with may rows lie in tasks before."""
    ordered = rows.select(group, *[c for c in rows.columns if c != group])
    ordered = ordered.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", part int, number long"
    kept = stored(ordered.mapInArrow(_counted, schema))
    ends = kept.groupBy("part").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by("number", F.struct(group, "number")).alias("n"))
    before, offsets, last = 0, [], None
    for row in ends.orderBy("part").collect():  # one for each task of the sort
        if row["first"] != last:
            before = 0
        if before:
            offsets.append((row["part"], row["first"], before))
        before, last = (before if row["last"] == row["first"] else 0) + row["n"] + 1, row["last"]
    if not offsets:
        return kept.drop("part")
    schema = f"part int, {group} {kept.schema[group].dataType.simpleString()}, before long"
    ahead = F.broadcast(kept.sparkSession.createDataFrame(offsets, schema))  # as many at most
    return kept.join(ahead, ["part", group], "left").withColumn("number", F.col("number") + F.coalesce("before", F.lit(0))).drop("part", "before")


_PATH = "array<struct<before: string, behind: string>>"
_PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))
Key = tuple[pa.Scalar, ...]


def _block(key: Key, nodes: pa.Table, levels: int) -> Block:
    """The tree over nodes in order of their numbers; key is (group, number of the block). The first
    block of several is full, so that it needs all levels."""
    return Block(nodes["digest"].to_pylist(), levels, key[1].as_py() == 0)


def _keyed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("number") / FAN**levels).cast("long"))


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """group, block, digest: the root of each block of the nodes (group, number, digest)."""

    def root(key: Key, rows: pa.Table) -> pa.Table:
        digest = _block(key, rows.sort_by("number"), levels).root
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([digest])], ["group", "block", "digest"])

    keyed = _keyed(nodes.select("group", "number", "digest"), levels)
    return stored(keyed.groupBy("group", "block").applyInArrow(root, "group string, block long, digest string"))


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """group, number, path, top: the siblings on the way from each node (group, number, digest) to top,
    the root of its group's tree; `above` has the same for the blocks' roots, by block."""

    def down(key: Key, rows: pa.Table, over: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        block, up, n = _block(key, rows, levels), over.to_pylist()[0], rows.num_rows
        paths = [[{"before": a, "behind": b} for a, b in block.path(k)] + up["path"] for k in range(n)]
        return pa.table([rows["group"], rows["number"], pa.array(paths, _PATH_TYPE), pa.array([up["top"]] * n)], ["group", "number", "path", "top"])

    both = _keyed(nodes.select("group", "number", "digest"), levels).groupBy("group", "block").cogroup(above.groupBy("group", "block"))
    return both.applyInArrow(down, f"group string, number long, path {_PATH}, top string")


def paths_above(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """group, block, path, top: the same from the root of each block of the nodes."""
    found = [_roots(nodes, levels)]
    while found[-1].where("block > 0").limit(1).count():
        found.append(_roots(found[-1].withColumnRenamed("block", "number"), levels))
    above = found.pop().select("group", "block", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    while found:
        above = stored(_paths(found.pop().withColumnRenamed("block", "number"), above, levels).withColumnRenamed("number", "block"))
    return above


def leaves(rows: DataFrame, group: str, fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """group (null: `-`, others `=` and the value), doc_id, digest, tampered: the leaf of each row, and
    for the rows chosen by `when` the one that it has with `changed` values, where that differs."""
    own = {f: F.col(f) for f in fields}
    other = F.when(when, digest({**own, **changed})) if changed else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    both = rows.select(key.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), digest(own).alias("digest"), other.alias("tampered"))
    return both.withColumn("tampered", F.nullif("tampered", "digest"))


#: Groups whose paths are broadcast; with more of them they are joined by a shuffle.
FEW_GROUPS = 10_000
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """PROOFS of `leaves`: each row's leaf, its group's root (leaves by doc_id), the root over the
    groups' roots (groups by their bytes, null first), the digest of the siblings from the leaf to it,
    the root that follows along them from the tampered leaf, else from the leaf, and whether it is
    the same."""

    def prove(key: Key, rows: pa.Table, over: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        block, up, n = _block(key, rows, levels), over.to_pylist()[0], rows.num_rows
        rest = [(p["before"], p["behind"]) for p in [*up["path"], *up["group_path"]]]
        shared = "".join(a + b for a, b in rest)
        own, proofs, roots, versions = rows["digest"].to_pylist(), [], [], {}
        for k, other in enumerate(rows["tampered"].to_pylist()):
            proofs.append(sha256(("".join(a + b for a, b in block.path(k)) + shared).encode()).hexdigest())
            version = block.version(k, other or own[k])
            if version not in versions:  # all untampered leaves go on as one version
                versions[version] = folded(version, rest)
            roots.append(versions[version])
        columns = [rows["doc_id"], rows["digest"], pa.array([up["top"]] * n), pa.array([up["root"]] * n), pa.array(proofs), pa.array(roots), pa.array([r == up["root"] for r in roots])]
        return pa.table(columns, [c.split()[0] for c in PROOFS.split(", ")])

    # repeated rows are dealt over the tasks of the sort
    nodes = numbered(stored(found).withColumn("tie", F.monotonically_increasing_id()), "group", "doc_id", "digest", "tie").drop("tie")
    above = paths_above(nodes, levels)
    groups = above.where("block = 0").select(F.lit("").alias("all"), F.col("group").alias("name"), F.col("top").alias("digest"))
    groups = numbered(groups, "all", "name").withColumnRenamed("all", "group")
    group_paths = stored(_paths(groups, paths_above(groups, levels), levels).select("number", F.col("path").alias("group_path"), F.col("top").alias("root")))
    group_paths = groups.select("number", F.col("name").alias("group")).join(group_paths, "number").drop("number")
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    up = above.join(F.broadcast(group_paths) if few else group_paths, "group")
    return _keyed(nodes, levels).groupBy("group", "block").cogroup(up.groupBy("group", "block")).applyInArrow(prove, PROOFS)
