"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a regular expression of the JVM and of Python alike.
BLANK = r"[\x20\x09-\x0D]+"
#: A word. Possessive: each character is tried once, however long the word.
WORD = r"[^\x20\x09-\x0D]++"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that a caller has set for checkpoints.

    Only where neither is so on one machine (a local master), as in tests, a temporary folder takes its place; on a
    cluster that is an error, since executors don't share local folders.
    """
    context = spark.sparkContext
    is_set = context._jsc.sc().getCheckpointDir().isDefined()
    if (named := context.getConf().get("spark.checkpoint.dir")) is None:
        if is_set:
            return context._jsc.sc().getCheckpointDir().get()
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint")
    if not is_set:
        context.setCheckpointDir(named)
    return named


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Writes each round's rows to the shared folder and reads them again; of earlier rounds only the last is kept.

    Unlike a checkpoint, a table that is read has its own size: estimates of joins of joins don't grow from round to round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        if len(self.paths) > 2:
            deleted(self.spark, self.paths[-3])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it (case apart)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def unpartitioned(name: str) -> Column:
    """The long column as an expression of which Spark doesn't know the partitioning.

    A join by it gets its own exchange on this side too, so that adaptive execution may split a hot key.
    """
    return F.bitwise_not(F.bitwise_not(F.col(name))).alias(name)


def words(text: Column) -> Column:
    """The words of a text as an array; of null none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those that a hash of the key puts first; the same rows on every run.

    Rows far behind are left out by their hash alone, so that no task is sent more than a few times `most` in all.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 40))
    if total > 4 * most:
        df = df.where(place < int((1 << 40) * 2 * most / total))
    return df.orderBy(place, key).limit(most)


def running_sums(df: DataFrame, order: Sequence[Column], **values: Column) -> DataFrame:
    """df with the sum of each value over all rows before a row, in the order, which must tell all rows apart.

    Rows are dealt to ranges of the order; only a row for each range meets in one task, and no more ranges are made
    than there are partitions. An empty df gives an empty result.
    """
    part, key, first = fresh(df, "range_part", "range_key", "range_first")
    dealt = checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(*[F.sum(v).alias(k) for k, v in values.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(part).alias(key), F.struct(*[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in values]).alias(first))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{key}_{k}") for k, v in values.items()])
    joined = summed.join(F.broadcast(totals), F.col(part) == F.col(key))
    return joined.select(*df.columns, *[(F.col(f"{key}_{k}") + F.col(first)[k]).alias(k) for k in values])
