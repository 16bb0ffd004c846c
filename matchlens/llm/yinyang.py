"""Compression of vectors to codes: codebooks by Lloyd rounds with Yinyang bounds.

A vector is cut into equal parts, and each part is coded by the nearest entry of its position's codebook. The entries of
a codebook are clustered into groups. A row keeps, for each part, an upper bound on the distance to its entry and one
lower bound for each group on the distance to that group's other entries. After an update the bounds are shifted by how
far the entry, or the farthest entry of the group, has moved. Where no lower bound of a group falls to the upper one,
nothing is computed; else the upper bound is made exact and only groups whose bound still fails are scanned. Scanned
distances are whole numbers, so that ties are seen and go to the lower index; a group is left out only if its bound is
above by more than rounding.

Rows stay where they are: each round is a map over them, and a sum for each entry is all that is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, table
from .topk import matrix
from .vectors import cleaned, squared, squared_pairs, sums_by

SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry of a codebook, by a few Lloyd rounds from entries at even steps."""
    groups = max(1, min(groups, len(entries)))
    centers = entries[np.arange(groups) * len(entries) // groups].astype(float)
    for _ in range(rounds):
        near = ((entries[:, None, :] - centers) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (near == g).any():
                centers[g] = entries[near == g].mean(axis=0)
    return np.unique(near, return_inverse=True)[1]


def down(x: np.ndarray) -> np.ndarray:
    """Lower bounds as half floats, never above what they were."""
    x = np.clip(x, 0.0, 65504.0)
    half = x.astype("<f2")
    return np.where(half > x, np.nextafter(half, np.float16(0)), half).astype("<f2")


def up(x: np.ndarray) -> np.ndarray:
    """Upper bounds as floats, never below what they were."""
    single = x.astype("<f4")
    return np.where(single < x, np.nextafter(single, np.float32(np.inf)), single).astype("<f4")


def first_scan(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code, upper and lower bounds (one column a group) of parts that meet all entries."""
    far, rows = squared(x, entries).astype(float), np.arange(len(x))
    code = far.argmin(axis=1)  # of equal ones the first
    upper = np.sqrt(far[rows, code])
    far[rows, code] = np.inf
    return code, upper, np.sqrt(np.stack([far[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1))


def next_scan(x: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for parts whose codes and bounds were right before the entries moved by drift; and how many distances were computed."""
    upper = upper + drift[code]
    lower = lower - np.array([drift[group == g].max() for g in range(lower.shape[1])])
    slack = 1e-6 * (1.0 + upper)
    open_ = np.flatnonzero(lower.min(axis=1) <= upper + slack)
    if not len(open_):
        return code, upper, lower, 0
    parts, was, low = x[open_], code[open_], lower[open_]
    exact = squared_pairs(parts, entries[was])  # the upper bound, made tight
    limit = np.sqrt(exact.astype(float))
    best, best_at, computed = exact.copy(), was.copy(), len(open_)
    scanned = np.zeros(low.shape, dtype=bool)
    least, second, least_at = (np.full(low.shape, np.inf) for _ in range(3))
    for g in range(low.shape[1]):
        some = np.flatnonzero(low[:, g] <= limit + 1e-6 * (1.0 + limit))
        if not len(some):
            continue
        members = np.flatnonzero(group == g)
        far = squared(parts[some], entries[members])
        at = far.argmin(axis=1)
        value, where = far[np.arange(len(some)), at].astype(np.int64), members[at]
        scanned[some, g], least[some, g], least_at[some, g] = True, value, where
        if len(members) > 1:
            second[some, g] = np.partition(far, 1, axis=1)[:, 1]
        computed += far.size
        wins = (value < best[some]) | ((value == best[some]) & (where < best_at[some]))
        best[some[wins]], best_at[some[wins]] = value[wins], where[wins]
        limit[some[wins]] = np.sqrt(value[wins].astype(float))
    low = np.where(scanned, np.sqrt(np.where(least_at == best_at[:, None], second, least)), low)
    rows = np.arange(len(open_))
    left = (best_at != was) & ~scanned[rows, group[was]]  # the entry that it had is now one of a group that wasn't scanned
    low[rows[left], group[was[left]]] = np.minimum(low[rows[left], group[was[left]]], np.sqrt(exact[left].astype(float)))
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    code[open_], upper[open_], lower[open_] = best_at, np.sqrt(best.astype(float)), low
    return code, upper, lower, computed


def compress(
    vectors: DataFrame, dims: int = 64, parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 8, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that takes part.

    Rows whose vector is null, has another number of components than `dims`, or holds null or non-finite ones, take no
    part. Components become floor(scale * x), cut at 2^26 in size. The first entries are the parts of the rows with the
    smallest ids; rows with one id go by the bytes of their vector, rows without an id come last. With fewer rows than entries
    the codebooks are so short. Of entries equally near the lower index counts, and an entry without parts stays. Repeated
    rows are rows of their own. Null labels are one label, NaN ones too. A sum of errors beyond a long is the largest
    long. Other columns, whatever their names, play no part. An empty table gives no rows.
    """
    result, _ = compressed(vectors, dims, parts, entries, rounds, groups, scale, id_col, vector_col, label_col)
    return result


def compressed(vectors: DataFrame, dims: int, parts: int, entries: int, rounds: int, groups: int, scale: float, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, list]:
    """What compress returns, and a counter of the distances computed for each scan, filled as it runs."""
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("dims must be a multiple of parts, and entries from 1 to 256")
    spark, width = vectors.sparkSession, dims // parts
    store = Rounds(spark)
    rows = store.written(cleaned(vectors, dims, scale, id_col, vector_col, [label_col]))
    start = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not start:
        return spark.createDataFrame([], SCHEMA), []
    books = matrix(start, dims).reshape(len(start), parts, width).transpose(1, 0, 2)  # part, entry, component
    group = [grouped(b, groups) for b in books]
    label_type = rows.schema["keep_0"].dataType.simpleString()
    drift, counters = None, []

    def scan(books: np.ndarray, drift: np.ndarray | None, counter):
        """A map from rows, with codes and bounds or without, to rows with those of the codebooks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, x = batch.num_rows, matrix(batch.column(2).to_pylist(), dims)
                codes, uppers, lowers = np.zeros((n, parts), dtype=np.uint8), np.zeros((n, parts), dtype="<f4"), []
                if drift is not None:
                    taken = lambda i, kind: np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(n, -1)  # noqa: B023, E731
                    before, upper, bounds = taken(3, np.uint8), taken(4, "<f4").astype(float), taken(5, "<f2").astype(float)
                at = 0
                for p in range(parts):
                    mine = x[:, p * width : (p + 1) * width]
                    if drift is None:
                        code, high, low = first_scan(mine, books[p], group[p])
                        counter.add(n * len(books[p]))
                    else:
                        here = bounds[:, at : (at := at + group[p].max() + 1)]
                        code, high, low, computed = next_scan(mine, books[p], group[p], drift[p], before[:, p].astype(np.int64), upper[:, p], here)
                        counter.add(computed)
                    codes[:, p], uppers[:, p] = code, up(high)
                    lowers.append(down(low))
                bound = np.concatenate(lowers, axis=1) if n else np.zeros((0, 1), dtype="<f2")
                as_bytes = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], as_bytes(codes), as_bytes(uppers), as_bytes(bound)], ["vec_id", "keep_0", "v", "code", "high", "low"])

        return run

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many parts each entry has, and their sums, of a task's rows."""
        n, total = np.zeros(parts * 256, dtype=np.int64), np.zeros((parts * 256, width), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0).to_pylist(), dims).reshape(-1, width)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts) + np.arange(parts) * 256
                slot, count, added = sums_by(x, code.ravel())
                n[slot] += count
                total[slot] += added
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["slot", "n", "s"])

    state = rows
    for _ in range(rounds + 1):
        counters.append(spark.sparkContext.accumulator(0))
        schema = f"vec_id long, keep_0 {label_type}, v binary, code binary, high binary, low binary"
        state = store.written(state.mapInArrow(scan(books, drift, counters[-1]), schema))
        if len(counters) > rounds:
            break
        sums = state.select("v", "code").mapInArrow(totals, "slot int, n long, s array<long>")
        sums = sums.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", i)).alias(f"s{i}") for i in range(width)])
        moved = books.copy()
        for r in sums.collect():  # at most a row for each entry
            moved[r["slot"] // 256, r["slot"] % 256] = [r[f"s{i}"] // r["n"] for i in range(width)]
        drift, books = np.sqrt(((moved - books) ** 2).sum(axis=2)), moved

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2).to_pylist(), dims)
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts)
            made = books[np.arange(parts), code].reshape(-1, dims) if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(squared_pairs(x, made), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = store.written(state.select("vec_id", "keep_0", "v", "code").mapInArrow(errors, f"vec_id long, label {label_type}, code binary, error long"))
    most = F.lit((1 << 63) - 1)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), most).cast("long").alias("label_error"))
    by_label = Rounds(spark).written(by_label)  # so that its size is known: broadcast if small, else joined by key
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")), counters


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """The same by meeting all entries each time; a round is a few named tables."""
    floored = lambda s: f"({s} - (({s} % n) + n) % n) // n"
    steps = [
        f"""kept as materialized (select row_number() over () as uid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = {parts * width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"pieces as materialized (select uid, p, v[p * {width} + 1 : p * {width} + {width}] as x from kept, range({parts}) r(p))",
        f"""first as (select uid, row_number() over (order by vec_id nulls last) - 1 as e from kept),
b0 as materialized (select p, e, x as c from pieces join first using (uid) where e < {entries})""",
    ]
    for i in range(rounds + 1):
        apart = " + ".join(f"(x[{k}] - c[{k}]) ** 2" for k in range(1, width + 1))
        steps.append(f"a{i} as materialized (select uid, p, any_value(x) as x, min(({apart})::bigint * 256 + e) as m from pieces join b{i} using (p) group by uid, p)")
        if i < rounds:
            new = "[" + ", ".join(floored(f"s{k}") for k in range(1, width + 1)) + "]"
            sums = ", ".join(f"sum(x[{k}])::bigint as s{k}" for k in range(1, width + 1))
            steps.append(f"b{i + 1} as materialized (select p, e, coalesce(t.c, b{i}.c) as c from b{i} left join (select p, e, {new} as c from (select p, m % 256 as e, count(*) as n, {sums} from a{i} group by 1, 2)) t using (p, e))")
    last = f"a{rounds}"
    steps.append(f"coded as (select uid, string_agg(printf('%02x', m % 256), '' order by p) as code, sum(m // 256)::bigint as error from {last} group by uid)")
    steps.append(f"digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join kept using (uid), digest"


ORACLE_SQL = _sql()
