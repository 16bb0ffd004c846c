"""Packing documents into sequences by patterns fitted with non-negative least squares.

Spark counts the pieces of each length. On the driver, over at most `capacity` lengths whatever the input, all patterns
of up to three lengths that fill a sequence are enumerated, and repeat counts are fitted to the histogram by
non-negative least squares (accelerated projected gradients). Rounded counts are kept as far as pieces last; the
pieces left over are packed best fit, longest first, again over the histogram. Spark then ranks the pieces of each
length and deals rank to place by the plan.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Pieces of a length are ranked in at least so many parts.
PARTS = 256


def byte_bpe(folder: str | None = None) -> Callable[[str], list[int]]:
    """The ids of byte_bpe_50k. The ranks of the same vocabulary serve plain texts, some four times faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = (lambda x: f"{folder}/{x}") if folder else public_tokenizers.path
    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞₠-₿]*")

    def encode(text: str) -> list[int]:
        if plain.fullmatch(text) and "<|endoftext|>" not in text:
            return quick.encode_ordinary(text)
        return whole.encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizers: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each row of docs; a null text is empty: one end id.

    A document of more than `capacity` ids is cut so that all pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizers)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packed, n = np.array(ids, dtype="<u4"), len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(packed[a:b].tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def full_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the lengths that sum to the capacity, longest first; 0 stands for no document."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    a, b = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij", sparse=True)
    c = capacity - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & (a > 0) & have[a] & have[b] & have[np.maximum(c, 0)]
    i, j = np.nonzero(ok)
    return np.stack([i, j, capacity - i - j], axis=1)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares: how often to repeat each pattern so that their documents come near the counts."""
    if not len(patterns):
        return np.zeros(0)
    size = len(counts)
    weight = 1.0 / np.sqrt(np.maximum(counts, 1.0))  # as the counts' own deviation
    weight[0] = 0.0

    def made(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, k], x, size) for k in range(patterns.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(weight**2 * made(v))
        v /= np.linalg.norm(v) or 1.0
    step = 0.9 / max(np.linalg.norm(back(weight**2 * made(v))), 1e-12)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(weight**2 * (made(y) - counts)))
        if ((y - new) * (new - x)).sum() > 0:
            t = 1.0  # start the momentum anew where it points uphill
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / faster * (new - x), faster
    return x


def best_fit(left: np.ndarray, capacity: int) -> Counter:
    """How often each filling is used when the pieces left are packed longest first, each where least room remains."""
    left = left.copy()
    open_bins: dict[int, Counter] = defaultdict(Counter)  # by room: fillings and how many sequences have them
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                filling = next(iter(open_bins[room]))
                n = int(min(left[length], open_bins[room][filling]))
                open_bins[room][filling] -= n
                if not open_bins[room][filling]:
                    del open_bins[room][filling]
                rooms[room] -= n
            else:
                room, filling, per = capacity, (), capacity // length
                n = int(left[length] // per)
                if n and per > 1:  # as many as fit at once
                    filling, room = (length,) * per, capacity - length * per
                    open_bins[room][filling] += n
                    rooms[room] += n
                    left[length] -= n * per
                    continue
                n = 1 if per > 1 else int(left[length])
            left[length] -= n
            open_bins[room - length][(*filling, length)] += n
            rooms[room - length] += n
    return sum(open_bins.values(), Counter())


def packing_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences) for all pieces that the histogram counts; index is the length."""
    left = counts.astype(np.int64).copy()
    plan: Counter = Counter()
    patterns = full_patterns(np.flatnonzero(left), capacity)
    repeats = fit_repeats(patterns, left.astype(float))
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 0.5:
            break
        filling = tuple(int(x) for x in patterns[k] if x)
        need = Counter(filling)
        n = int(min(round(repeats[k]), *(left[x] // m for x, m in need.items())))
        if n > 0:
            plan[filling] += n
            for x, m in need.items():
                left[x] -= n * m
    plan.update(best_fit(left, capacity))
    return sorted(plan.items(), key=lambda p: (p[0], p[1]), reverse=True)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizers: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of the rows of docs.

    Null and empty texts are pieces of one id; very long ones give as many pieces as they need. Repeated rows are packed
    each; pieces of one length are ranked by doc_id, piece and ids, and equal ones are interchangeable. doc_id may be
    null. Columns of docs other than doc_id and text, whatever their names, play no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = checkpointed(token_pieces(docs, capacity, end_id, tokenizers))
    counts, n = np.zeros(capacity + 1, dtype=np.int64), 0
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
        n += row["n"]

    # Ranks within a length: by parts, of which a frequent length has many.
    parts = PARTS + n // 200_000
    dealt = pieces.select("*", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part"))
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.select("*", F.row_number().over(inside).alias("k")).join(sums, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k") - 1).alias("rank"))

    # A place is (length, first rank, end rank, sequence of the first, offset). Places are bounded by the capacity alone:
    # three for each of some capacity^2 / 12 patterns (87,381 of 1024), and those of the residual, whose fillings are
    # at most two for each length.
    used, places, sequence = Counter(), [], 0
    for filling, repeats in packing_plan(counts, capacity):
        offset = 0
        for length in filling:
            places.append((int(length), used[length], used[length] + repeats, sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    names = "place_length long, lo long, hi long, first long, offset long"
    if places:
        columns = [pa.array(x, pa.int64()) for x in zip(*places)]
        table_ = spark.createDataFrame(pa.Table.from_arrays(columns, names=[x.split()[0] for x in names.split(", ")]))
    else:
        table_ = spark.createDataFrame([], names)
    # Ranks and places meet in a bucket of ranks, so that a row isn't tried against all of a length's places.
    width = max(1, n // 4096)
    buckets = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    table_ = table_.select("*", buckets.alias("bucket"))
    here = (F.col("length") == F.col("place_length")) & (F.floor(F.col("rank") / width) == F.col("bucket")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    joined = ranked.join(F.broadcast(table_), here)
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
