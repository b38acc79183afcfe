"""A corpus pipeline of five stages: toxicity, line dedup, SimHash near-dedup, suffix-array
dedup, packing. Each stage reads what its predecessor kept.

In all stages a null text counts as the empty one and stays null, columns that a stage does not
know stay as they are, whatever their names, and an empty table gives an empty one. Rows of one
doc_id and text are one document. Rows without doc_id are neither compared nor removed, and are
packed like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_tables.llm import common, line_dedup, packing, simhash, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal severity model, fitted on `labels`, does not reject; without
    toxic and clean labels all stay. Rows of one doc_id go together if one of them is rejected."""
    return toxicity.remove_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly repeat an earlier one, of a smaller doc_id or above
    it; of one doc_id's different texts the one with the smaller hash comes first. Documents
    of which nothing is left go, but those that held nothing before stay. n_chars follows."""
    return _counted(line_dedup.remove_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link, the smallest doc_id, with all
    its rows; texts without words link with each other."""
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that stand earlier, in the order of the
    line stage. Documents of which nothing is left go. n_chars follows."""
    return _counted(suffix_dedup.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, in windows of 2048 tokens; each row is packed, an
    empty text as its end alone."""
    return packing.pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: SQL has no ordinal regression, SimHash or packing: the tests hold the rows against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result but the last is stored and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
