"""Line dedup on sharded cuckoo filters, backed by exact reference-count tables.

`LineIndex` holds three tables. `refs` has a row for each document and key, so that a deletion can be undone to the
last reference; `counts` has the documents and the largest doc_id of each key; `filters` has a cuckoo filter for each
shard of the keys in min_docs documents or more. The filters only say which references can't be of a repeated line;
what passes is joined with the exact counts. Insertions and deletions count anew only the keys that they touch, and
change only the filters of shards whose repeated keys they change; the tables are written anew as a whole.

References meet the filter of their shard in tasks that read both in order of shard, one filter at a time, however many
there are; a shard is dealt to several tasks, so that a frequent line isn't all in one.

Keys are 128-bit hashes (XXH3) of stripped, lower-cased lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, table, unpartitioned
from .cuckoo import CuckooFilter

STRIP = " \t\n\x0b\x0c\r"
#: Filters have at least so many shards, and so many keys a shard on average, so that no task builds a large one.
LEAST_SHARDS, SHARD_KEYS = 64, 65_536
#: The references of a shard are dealt to at least so many parts, and more if a part would have more than SALT_ROWS on
#: average. Each part gets a copy of the shard's filter.
LEAST_SALTS, SALT_ROWS = 8, 250_000


def line_key(line: str, min_chars: int) -> bytes | None:
    key = line.strip(STRIP)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def _references(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): the different keys of each row; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {line_key(x, min_chars) for x in (text.as_py() or "").split("\n")} - {None}
                ids += [doc_id] * len(found)
                keys += sorted(found)
            halves = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long").distinct()


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = CuckooFilter.sized(len(rows) * 2)
        out.insert(np.sort(rows["h1"].to_numpy()))
        return pd.DataFrame({"shard": [key[0]], "filter": [out.to_bytes()]})

    return keys.select(_shard(shards), "h1").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def _counted(refs: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, largest) of all keys."""
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))


def _shards_for(keys: int) -> int:
    return max(LEAST_SHARDS, -(-keys // SHARD_KEYS))


def _shard(shards: int) -> Column:
    return F.pmod("h2", F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int
    sized_for: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shards: int | None = None) -> LineIndex:
        """Indexes doc_id and text of docs; shards are as many as the keys need if not given. Rows with the same doc_id count as one document, a null doc_id as another."""
        refs = checkpointed(_references(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars))
        counts = checkpointed(_counted(refs))
        repeated = counts.where(F.col("n_docs") >= min_docs)
        n = repeated.count()
        shards = shards or _shards_for(n)
        return cls(refs, counts, checkpointed(_filters(repeated, shards)), min_docs, min_chars, shards, n)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Takes in documents; references that are there already count once."""
        new = _references(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), self.min_chars)
        old = self.refs.select(F.col("doc_id").alias("d"), unpartitioned("h1"), F.col("h2").alias("o2"))
        new = checkpointed(new.join(old.withColumnRenamed("h1", "o1"), (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti"))
        was = self._of(new)
        now = was.select("h1", "h2", "n_docs", "largest").union(_counted(new).select("h1", "h2", "n_docs", "largest"))
        now = now.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("largest").alias("largest"))
        return self._changed(self.refs.union(new), was, now)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes out the documents of the first column of ids; results are as if they had never been inserted."""
        gone = checkpointed(ids.select(ids[ids.columns[0]].cast("long").alias("gone_id")).distinct())
        lost = checkpointed(self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi"))
        rest = checkpointed(self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti"))
        touched = lost.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")).distinct()
        left = rest.join(touched, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")
        return self._changed(rest, self._of(lost), _counted(left))

    def _of(self, refs: DataFrame) -> DataFrame:
        """The counts of the keys of some references."""
        touched = refs.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")).distinct()
        return self.counts.join(touched, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")

    def _changed(self, refs: DataFrame, was: DataFrame, now: DataFrame) -> LineIndex:
        """was and now: the counts of the keys that are touched, before and after.

        Filters take the keys that came and went. Once the keys outgrow the filters' room, these are built anew.
        """
        was, now = checkpointed(was), checkpointed(now)
        keys = was.select("h1", "h2").union(now.select("h1", "h2")).distinct()
        stay = self.counts.join(keys.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_anti")
        counts = checkpointed(stay.unionByName(now))
        often = F.col("n_docs") >= self.min_docs
        n = counts.where(often).count()
        if n > max(1.5 * self.sized_for, LEAST_SHARDS):
            shards = _shards_for(n)
            return replace(self, refs=refs, counts=counts, filters=checkpointed(_filters(counts.where(often), shards)), shards=shards, sized_for=n)
        key = ["h1", "h2"]
        came = now.where(often).join(was.where(often), key, "left_anti").select(_shard(self.shards), "h1", F.lit(True).alias("came"))
        went = was.where(often).join(now.where(often), key, "left_anti").select(_shard(self.shards), "h1", F.lit(False).alias("came"))
        changes = checkpointed(came.union(went))

        def update(shard: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            new, old_keys = np.sort(rows["h1"][rows["came"]].to_numpy()), np.sort(rows["h1"][~rows["came"]].to_numpy())
            out = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(2 * len(new))
            out.delete(old_keys)
            out.insert(new)
            return pd.DataFrame({"shard": [shard[0]], "filter": [out.to_bytes()]})

        touched = changes.select(F.col("shard").alias("s")).distinct()
        changed = self.filters.join(touched, F.col("shard") == F.col("s"), "left_semi")
        same = self.filters.join(touched, F.col("shard") == F.col("s"), "left_anti")
        new = changed.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, "shard int, filter binary")
        return replace(self, refs=refs, counts=counts, filters=checkpointed(same.union(new)))

    def candidates(self, refs: DataFrame) -> DataFrame:
        """The references that the filters don't rule out."""
        rows = refs.select(_shard(self.shards), "doc_id", "h1", "h2")
        parts = F.greatest(F.lit(LEAST_SALTS), F.ceil(F.count("*") / SALT_ROWS)).cast("int").alias("parts")
        parts = checkpointed(rows.groupBy(F.col("shard").alias("s")).agg(parts))  # a row for each SHARD_KEYS keys
        rows = rows.join(parts, F.col("shard") == F.col("s"))
        salt = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.col("parts")).cast("int").alias("salt")
        rows = rows.select("shard", salt, F.lit(None).cast("binary").alias("filter"), "doc_id", "h1", "h2")
        salts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
        filters = self.filters.join(parts, F.col("shard") == F.col("s")).select("shard", salts, "filter", *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "h1", "h2")])
        met = filters.union(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A filter comes before the references of its shard and salt; a shard without one has no repeated key."""
            place, held = None, None
            for batch in batches:
                shard, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edges = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
                    if b == a:
                        continue
                    if place != (place := (shard[a], salt[a])):
                        blob = batch.column(2)[a].as_py()
                        held = CuckooFilter.from_bytes(blob) if blob is not None else None
                        a += blob is not None
                    if held is not None and b > a:
                        part = batch.slice(a, b - a)
                        yield part.select(["doc_id", "h1", "h2"]).filter(pa.array(held.contains(part.column(4).to_numpy())))

        return met.mapInArrow(run, "doc_id long, h1 long, h2 long")

    def dropped(self, refs: DataFrame) -> DataFrame:
        """(doc_id, h1, h2) of the keys whose lines the document loses."""
        found = self.candidates(refs).select("doc_id", unpartitioned("h1"), "h2")
        exact = self.counts.where(F.col("n_docs") >= self.min_docs)
        exact = exact.select(unpartitioned("h1"), F.col("h2").alias("c2"), "largest").withColumnRenamed("h1", "c1")
        joined = found.join(exact, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
        return joined.where("doc_id is null or doc_id <> largest").select("doc_id", "h1", "h2")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, **options) -> DataFrame:
    """docs (all its columns) with the kept text in place of the text, and n_lines, n_dropped at the end.

    A null or empty text is one empty line, and is kept as it is in the text column. Names of the added columns get
    underscores if docs has them already. Without an index, docs themselves are indexed. Very long texts and lines are read
    whole. Of documents that hold a line the largest doc_id keeps it; rows with one doc_id, repeated ones too, are one
    document, as are those without one, and all of them keep it. An empty table gives no rows.
    """
    index = index or LineIndex.build(docs, **options)
    drops = index.dropped(index.refs).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))
    lines, gone, drop_id, keys = fresh(docs, "n_lines", "n_dropped", "drop_id", "drop_keys")
    drops = drops.select(F.col("doc_id").alias(drop_id), F.col("keys").alias(keys)).hint("shuffle_hash")
    joined = docs.join(drops, docs["doc_id"].cast("long").eqNullSafe(F.col(drop_id)), "left").drop(drop_id)
    at, min_chars = docs.columns.index("text"), index.min_chars
    names = [*docs.columns, lines, gone]
    schema = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(gone, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, lost = [], [], []
            for text, hashes in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text, hashes = text.as_py(), hashes.as_py()
                parts = (text or "").split("\n")
                totals.append(len(parts))
                if hashes:
                    bad = {np.array([x["h1"], x["h2"]], dtype="<i8").tobytes() for x in hashes}
                    kept = [x for x in parts if line_key(x, min_chars) not in bad]
                    lost.append(len(parts) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    lost.append(0)
                    texts.append(text)
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1], pa.array(totals, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with lines as (
  select doc_id, i, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from (select doc_id, text, row_number() over () as i from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
hot as (select key, max(doc_id) as largest from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, h.key is not null and k.doc_id <> h.largest as gone from keyed k left join hot h on k.key = h.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id, i
"""
