"""Suffix-array dedup: bytes that lie in a window found anywhere else are removed, over all texts.

Texts are written as runs of windows with one key (see repeats.py): a window can only repeat one with the same key. A
run whose key is met once, at one place of its text, holds no repeat. Of runs with the same text every window repeats.
What remains, the different run texts of a key, goes to tasks sorted by key, and is searched by suffix arrays and their
common prefixes (suffixes.py), some keys at a time. The run texts of a key that has more than `most` are first cut into
runs by a second key, from the first and last parts of windows, and so on: equal windows agree in that key too. After
LEVELS keys a run is one window, so that no key can have many texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, suffixes
from .common import checkpointed, table, unpartitioned

#: Run texts searched together by one suffix array, if a key has no more.
TOGETHER = 256
#: Keys that a crowded key's runs are cut by, before they are cut into single windows.
LEVELS = 3


def _runs(base: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for number, at, n, key, whole, own in repeats.runs(batch.column(2).to_pylist(), window):
                arrays = [ids[number], th[number], at.astype(np.int32), n.astype(np.int32), key.view(np.int64), whole.view(np.int64), own]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["id", "th", "at", "n", "key", "whole", "own"])

    return base.mapInArrow(run, "id long, th long, at int, n int, key long, whole long, own boolean")


def _cut(joined: DataFrame, window: int) -> DataFrame:
    """A row for each run of `runs` with its text, from rows (id, th, body, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, th, body, found in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [(r["key"], r["whole"], r["copies"], doc_id, th, r["at"], r["n"], body[r["at"] : r["at"] + r["n"] + window - 1]) for r in found]
                if len(rows) > 20_000:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "whole", "copies", "id", "th", "at", "n", "body"])

    return joined.select("id", "th", "body", "runs").mapInArrow(run, "key long, whole long, copies long, id long, th long, at int, n int, body binary")


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _searched(texts: DataFrame, window: int) -> DataFrame:
    """(id, th, start, stop) of the bytes in repeats, of the runs that occur once.

    Rows are dealt by an expression that no join has dealt by: else Spark leaves the exchange out, and if it then makes
    that join a broadcast one, a key's rows are in several tasks, each of which misses repeats.
    """
    texts = texts.repartition(F.bitwise_not(F.bitwise_not(F.col("key")))).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    yield search(held)
                    held = []
                held.append(row)
        yield search(held)

    def search(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], []]
        flags = suffixes.repeated([r[-1] for r in rows], window) if rows else []
        for (_, copies, doc_id, th, at, _), found in zip(rows, flags):
            if copies == 1:
                for a, b in _spans(found):
                    for column, value in zip(out, (doc_id, th, at + a, at + b - 1 + window)):
                        column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "th", "start", "stop"])

    return texts.select("key", "copies", "id", "th", "at", "body").mapInArrow(run, "id long, th long, start int, stop int")


def _cut_again(texts: DataFrame, window: int, level: int) -> DataFrame:
    """The runs of run texts by the key of another level, with their texts and the copies of the run they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, ids, ths, starts = (batch.column(i).to_numpy() for i in range(5))
            bodies = batch.column(5).to_pylist()
            for number, at, n, key, whole, own in repeats.runs(bodies, window, level, 1 if level > LEVELS else repeats.MAX_RUN):
                # A single window's key is the hash of all its text.
                both = (keys[number].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (whole if level > LEVELS else key)
                parts = [bodies[i][a : a + c + window - 1] for i, a, c in zip(number.tolist(), at.tolist(), n.tolist())]
                arrays = [both.view(np.int64), whole.view(np.int64), copies[number], ids[number], ths[number], (starts[number] + at).astype(np.int32), n.astype(np.int32), own]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in arrays], pa.array(parts, pa.binary())], ["key", "whole", "copies", "id", "th", "at", "n", "own", "body"])

    return texts.select("key", "copies", "id", "th", "at", "body").mapInArrow(run, "key long, whole long, copies long, id long, th long, at int, n int, own boolean, body binary")


def _texts_of(base: DataFrame, window: int, keys: list[int]) -> DataFrame:
    """The run texts of some keys, a row each: key, whole, copies, id, th, at, n of the first and its text.

    Texts are cut where they are read, so that only the runs wanted are exchanged, not all texts once more.
    """
    wanted = np.array(sorted(keys), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th, bodies = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for number, at, n, key, whole, _ in repeats.runs(bodies, window):
                ours = np.isin(key.view(np.int64), wanted)
                number, at, n, key, whole = (x[ours] for x in (number, at, n, key, whole))
                parts = [bodies[i][a : a + c + window - 1] for i, a, c in zip(number.tolist(), at.tolist(), n.tolist())]
                arrays = [key.view(np.int64), whole.view(np.int64), ids[number], th[number], at.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in arrays], pa.array(parts, pa.binary())], ["key", "whole", "id", "th", "at", "n", "body"])

    rows = base.mapInArrow(run, "key long, whole long, id long, th long, at int, n int, body binary")
    first = F.min(F.struct("id", "th", "at", "n")).alias("first")
    groups = rows.groupBy("key", "whole").agg(F.count("*").alias("copies"), first, F.min_by("body", F.struct("id", "th", "at")).alias("body"))
    return groups.select("key", "whole", "copies", "first.*", "body")


def _repeats_of(texts: DataFrame, window: int, most: int, level: int = 1) -> list[DataFrame]:
    """(id, th, start, stop) of the repeats in different run texts of a key, of keys with more than `most`."""
    again = checkpointed(_cut_again(texts, window, level))
    firsts = [F.sum("copies").alias("copies"), F.max("own").alias("own"), F.min(F.struct("id", "th", "at", "n")).alias("first"), F.min_by("body", F.struct("id", "th", "at")).alias("body")]
    groups = checkpointed(again.groupBy("key", "whole").agg(*firsts).select("key", "whole", "copies", "own", "first.*", "body"))
    many = groups.where("copies > 1").select(unpartitioned("key"), F.col("whole").alias("w")).withColumnRenamed("key", "k")
    equal = again.where("copies = 1").select("id", "th", "at", "n", unpartitioned("key"), "whole").join(many, (F.col("key") == F.col("k")) & (F.col("whole") == F.col("w")))
    equal = equal.select("id", "th", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + window).alias("stop"))
    keys = checkpointed(groups.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 or own"))
    left = groups.drop("own").join(keys.select(unpartitioned("k")), F.col("key") == F.col("k"), "left_semi")
    # Keys have over `most` rows each, so that at most a `most`-th as many are sent to all tasks.
    crowded = keys.where(F.col("c") > most).select("k")
    if crowded.isEmpty():
        return [_searched(left, window), equal]
    few, rest = (left.join(F.broadcast(crowded), F.col("key") == F.col("k"), how) for how in ("left_anti", "left_semi"))
    return [_searched(few, window), equal, *_repeats_of(rest, window, most, level + 1)]


def remove_repeats(docs: DataFrame, window: int = 200, most: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and stop of the removed runs of bytes) and kept (bytes) of every row of docs.

    Null and empty texts have no bytes; texts shorter than the window lose none; very long texts are searched whole.
    Repeated rows are texts of their own, and so lose all windows. An empty table gives no rows. Texts are told apart by
    doc_id and a hash, so doc_id may be null or repeated. Other columns of docs, whatever their names, play no part.
    `most` changes the work, never the result.
    """
    # A text is known by doc_id and a hash, whose lowest bit says that doc_id is null: another hash stands for it then.
    unknown, text = F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))
    th = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(unknown, 1).otherwise(0))
    known = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(1), text))
    base = docs.select(known.alias("id"), th.alias("th"), F.encode(text, "UTF-8").alias("body"))
    runs = _runs(base, window)
    keys = runs.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.max("own").alias("own")).where("c > 1 or own")
    keys = keys.select(unpartitioned("k"), ((F.col("lo") != F.col("hi")) | F.col("own")).alias("several"))
    found = checkpointed(runs.join(keys, F.col("key") == F.col("k")).drop("k", "own"))

    # Of equal run texts one stands for all.
    first = F.min(F.struct("id", "th", "at", "n")).alias("first")
    groups = found.where("several").groupBy("key", "whole").agg(F.count("*").alias("copies"), first)
    groups = checkpointed(groups.select("key", "whole", "copies", "first.*"))
    # Keys have over `most` rows each, so that at most a `most`-th as many are sent to the driver and to all tasks.
    crowded = checkpointed(groups.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c")).where(F.col("c") > most).select("k"))
    few = groups.join(F.broadcast(crowded), F.col("key") == F.col("k"), "left_anti")
    wanted = few.groupBy("id", "th").agg(F.collect_list(F.struct("key", "whole", "copies", "at", "n")).alias("runs"))
    wanted = wanted.withColumnsRenamed({"id": "i", "th": "t"})

    bodies = base.repartition("id", "th")
    texts = _cut(bodies.join(wanted.hint("shuffle_hash"), (F.col("id") == F.col("i")) & (F.col("th") == F.col("t"))), window)
    crowded = [r["k"] for r in crowded.collect()]
    partial = reduce(DataFrame.union, [_searched(texts, window), *(_repeats_of(_texts_of(base, window, crowded), window, most) if crowded else [])])

    many = groups.where("copies > 1").select(unpartitioned("key"), F.col("whole").alias("w")).withColumnRenamed("key", "k")
    whole = found.where("several").select("id", "th", "at", "n", unpartitioned("key"), "whole").join(many, (F.col("key") == F.col("k")) & (F.col("whole") == F.col("w")))
    whole = whole.select("id", "th", "at", "n").union(found.where("not several").select("id", "th", "at", "n"))
    whole = whole.select("id", "th", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + window).alias("stop"))
    marks = partial.union(whole).groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.collect_list(F.struct("start", "stop")).alias("marks"))

    # The same exchange of the texts serves here as above.
    joined = bodies.join(marks.hint("shuffle_hash"), (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")), "left")
    known = F.when(F.col("th").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias("doc_id")
    joined = joined.select(known, "body", "marks")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted((m["start"], m["stop"]) for m in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                sizes.append(len(body))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                edges = [0, *[x for m in merged for x in m], len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else body)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
