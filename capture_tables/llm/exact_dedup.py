"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text, white space removed, is cut where its own content says so: behind three code points of
certain kinds, which stand every few hundred code points in prose, once a chunk has its least
length, and at its greatest length anyway. So cuts fall into step again behind an insertion,
and equal texts are cut equally. A text's recipe is the ordered list of its chunks'
identifiers. A chunk's identifier is its 64-bit hash as long as that hash stands for one text
alone, which is verified over all chunks that can matter; where it stands for several, the
identifier is the chunk itself. Two texts are equal if and only if their ordered identifier
lists are.

A list's digest of 128 bits tells which lists can recur. Only the lists of such documents are
compared, within a digest, and only their chunks are compared with each other; of those each
task sends each different chunk once. No document is moved as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points deleted before texts are compared.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A chunk ends behind these once it has LEAST code points, or has MOST.
CUT_AFTER = r"(?:[aeiouäöüéèáíóàе-ик-я\u4E00-\u5FFF][lnrst\u4E00-\u5FFF][.,;:!?|0358\u3001\u3002]|[aeoу-я\u6000-\u6FFF][bgmp\u6000-\u6FFF][fhkpuyа-е\u6000-\u6FFF])"
LEAST, MOST = 192, 1024

#: Values that a text's hash is cut to: what is broadcast has so many rows at most.
BUCKETS = 1 << 20

_CHUNK = rf"(?s).{{{LEAST - 3},{MOST - 3}}}?{CUT_AFTER}|.{{1,{MOST}}}"


def _chunks(norm: str):
    return F.regexp_extract_all(norm, F.lit(_CHUNK), F.lit(0))


def _digest(recipe: str):
    return F.xxhash64(recipe).alias("d0"), F.xxhash64(F.lit(1), recipe, F.size(recipe)).alias("d1")


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (of the original text), text_key (its hash), text_sha256 (of the
    normalised text), recipe (the hashes of its chunks)."""
    norm = common.id_and_text(docs).select(
        "doc_id", F.length("text").alias("n_points"), F.xxhash64("text").alias("text_key"), F.translate("text", WHITE_SPACE, "").alias("norm")
    )
    return norm.select(
        "doc_id",
        "n_points",
        "text_key",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform(_chunks("norm"), lambda c: F.xxhash64(c)).alias("recipe"),
    )


def _collisions(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(hash, chunk) of the chunks whose hash stands for more than one text, among the texts of
    `keys` (text_key). These are cut to BUCKETS values, so that what every task gets has a
    bound, and a task filters its own rows before it cuts them. A text in another's bucket only
    has its chunks compared for nothing."""
    bucket = F.pmod("text_key", F.lit(BUCKETS)).cast("int").alias("bucket")
    text = common.id_and_text(docs).select("text", F.xxhash64("text").alias("text_key")).select("text", bucket)
    near = text.join(F.broadcast(keys.select(bucket).distinct()), "bucket", "left_semi").select(F.translate("text", WHITE_SPACE, "").alias("norm"))
    chunks = near.select(F.explode(F.array_distinct(_chunks("norm"))).alias("chunk"))
    texts = chunks.select(F.xxhash64("chunk").alias("hash"), "chunk").distinct()
    several = texts.groupBy("hash").count().where("count > 1").select("hash")
    return texts.join(several, "hash")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text, and all empty texts are equal. Of equal texts the one with
    the most code points before white space went stays, then the smallest doc_id; rows that
    repeat both are kept alike. A row without doc_id joins its group, and stays only where no
    row of as many code points has an id. An empty table gives an empty one.
    """
    base = common.stored(recipes(docs).select("*", *_digest("recipe")))
    recurring = common.stored(base.groupBy("d0", "d1").agg(F.count("*").alias("n")).where("n > 1").select("d0", "d1", F.lit(True).alias("again")))
    marked = common.stored(base.join(recurring, ["d0", "d1"], "left"))
    own = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    alone = marked.where("again is null").select("doc_id", *[c.alias(n) for n, c in own.items()], "text_sha256")
    several = marked.where("again")
    clash = common.stored(_collisions(docs, several.select("text_key")))
    if not clash.isEmpty():
        several = _with_clashes(docs, several, clash)
    best = F.min_by("doc_id", F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id"))
    chosen = several.groupBy("d0", "d1", "recipe").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    # a large group's rows meet its one row in as many parts as needed
    chosen = common.stored(chosen.withColumnRenamed("recipe", "listed"))
    found = several.join(chosen, ["d0", "d1"]).where("recipe = listed")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256").unionByName(alone)


def _with_clashes(docs: DataFrame, several: DataFrame, clash: DataFrame) -> DataFrame:
    """`several` with recipes in which the chunks of `clash` stand for themselves: texts that
    hold such a hash are read again."""
    hashes = clash.select("hash").distinct()
    touched = several.select("text_key", F.explode("recipe").alias("hash")).join(hashes, "hash", "left_semi").select("text_key").distinct()
    again = common.id_and_text(docs).select("doc_id", "text", F.length("text").alias("n_points"), F.xxhash64("text").alias("text_key"))
    again = again.join(touched, "text_key", "left_semi").withColumn("norm", F.translate("text", WHITE_SPACE, ""))
    again = again.select("doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), _chunks("norm").alias("recipe"))
    rest = several.join(touched, "text_key", "left_anti").select(
        "doc_id", "n_points", "text_sha256", F.transform("recipe", lambda h: h.cast("string")).alias("recipe")
    )
    return common.stored(rest.unionByName(again).select("*", *_digest("recipe")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns; rows without doc_id stay."""
    dropped = groups(docs.where("doc_id is not null")).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


