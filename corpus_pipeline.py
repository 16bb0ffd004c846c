"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, extra ones too whatever their names; n_chars follows a
changed text. An empty table gives an empty result at each stage. Very long texts are read whole everywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import jaccard, linededup, mixing, packing, quality, simhash
from matchlens.llm.common import deleted, shared_folder, table

#: Quality rules are learned, and near-duplicates found by hash tables: no SQL expresses them.
ORACLE_SQL = None


def _counted(new: DataFrame, docs: DataFrame) -> DataFrame:
    """new with the columns of docs, n_chars as the text is now."""
    length = F.length("text").cast("long")
    return new.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the learned list keep. Null and empty texts have too few words and go; of repeated rows all stay or go; a null doc_id doesn't matter."""
    return quality.keep_good(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that other documents keep. Null texts stay null; rows with one doc_id, or with none, count as one document."""
    return _counted(linededup.dedup_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that of the least doc_id; of repeated rows one. Rows without a doc_id stay, all texts without words are one component."""
    return simhash.first_of_each(docs, jaccard.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, some twice, in the order of its schedule. Texts without words aren't taken; a null source is a source; ties in the shuffled order go by doc_id."""
    return _counted(mixing.mixed(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: see packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written is deleted once the next one has been written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            deleted(spark, f"{folder}/{before}")
        before = name
    return docs
