"""Exact top-k search by inner product: pivot-table elimination.

Each vector's distances to many pivots, one of them the origin, are precomputed. In a Euclidean space they fix where the
vector lies in the pivots' span and how far off it, (c, r), so the greatest lower bound that they allow on the distance
of a query and a candidate is sqrt(|c_q - c_x|^2 + (r_q - r_x)^2), and the least upper bound on their inner product
c_q . c_x + r_q r_x. The table keeps c and r, which say the same as the distances and are shorter to compare.

Candidates are grouped by their nearest pivot and their distance to it. A group's ranges of distances give each query
one bound for all of the group; groups below the query's floor never get the query. Within a group candidates are met
in the order of their bounds, until these fall below the k-th score found. Pivots come from a bounded sample, each the
vector farthest from the span of those before; the sample's own k-th score is a query's floor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, hashed_sample, table

#: Rows that pivots are chosen from, and that give each query its floor.
SAMPLE = 2048
#: Groups are as many as the pivots, times so many shells around each: what is sent to all tasks is bounded by them.
SHELLS = 16
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def encoded(v: np.ndarray) -> bytes:
    """Whole numbers as 16-bit integers where all fit, else as doubles; the first byte tells which."""
    return b"h" + v.astype("<i2").tobytes() if not len(v) or np.abs(v).max() < 1 << 15 else b"d" + v.astype("<f8").tobytes()


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Encoded vectors as rows, short ones padded with zeros."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        v = np.frombuffer(row, "<i2" if row[:1] == b"h" else "<f8", offset=1)
        out[i, : len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The origin, and up to n vectors: always the one farthest from the span of all that are chosen."""
    chosen, rest = [], sample.copy()
    for _ in range(min(n, *sample.shape)):
        far = (rest * rest).sum(axis=1)
        k = int(far.argmax()) if len(far) else 0
        if not len(far) or not np.isfinite(far[k]) or far[k] < 1e-6 * max((sample[k] ** 2).sum(), 1e-300):
            break
        chosen.append(k)
        unit = rest[k] / np.sqrt(far[k])
        rest = rest - np.outer(rest @ unit, unit)
    return np.concatenate([np.zeros((1, sample.shape[1])), sample[chosen]])


def span_of(pivots: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the pivots' span, a column each."""
    return np.linalg.qr(pivots[1:].T)[0] if len(pivots) > 1 else np.zeros((pivots.shape[1], 0))


def placed(far: np.ndarray, pivots: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(c, r) of vectors, from their distances to the pivots alone. The origin is the first pivot."""
    norm = far[:, 0] ** 2
    products = (norm[:, None] + (pivots[1:] ** 2).sum(axis=1) - far[:, 1:] ** 2) / 2
    c = np.linalg.solve(pivots[1:] @ basis, products.T).T if len(pivots) > 1 else products
    return np.concatenate([c, np.sqrt(np.maximum(norm - (c * c).sum(axis=1), 0.0))[:, None]], axis=1)


def slack(scale: np.ndarray | float) -> np.ndarray | float:
    """What rounding may take from a bound, at products of norms of this scale."""
    return 1.0 + 1e-4 * scale


def group_bound(q_far: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds on the inner products of a query with all vectors of each group, from the groups' distance ranges."""
    gap = np.maximum(np.maximum(low - q_far, q_far - high), 0.0).max(axis=1)
    norm = q_far[0]
    return np.minimum(norm * high[:, 0], (norm**2 + high[:, 0] ** 2 - gap**2) / 2) + slack(norm * high[:, 0] + norm**2)


def exact_scores(block: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole numbers, in Python's own integers where doubles could round."""
    if len(block) and float(np.abs(block).max()) * float(np.abs(query).max(initial=0.0)) * max(block.shape[1], 1) >= EXACT:
        whole = [int(x) for x in query]
        return [sum(a * int(b) for a, b in zip(whole, row)) for row in block]
    return [int(x) for x in block @ query]


def search_block(queries: np.ndarray, query_uids: np.ndarray, floors: np.ndarray, q_place: np.ndarray, block: np.ndarray, ids: np.ndarray, uids: np.ndarray, place: np.ndarray, k: int, step: int = 32) -> tuple[list, dict]:
    """The k best (query uid, id, score) of a block for each query, ties to the smaller id, and how many were evaluated.

    Scores below a query's floor needn't be found. A query doesn't meet the row that it is itself.
    """
    norms, out, evaluated = np.sqrt((place * place).sum(axis=1)), [], 0
    for i, query in enumerate(queries):
        with np.errstate(over="ignore", invalid="ignore"):
            scale = norms * np.sqrt((q_place[i] ** 2).sum())
            bound = place @ q_place[i] + slack(scale)
        bound[~np.isfinite(bound)] = np.inf
        order = np.flatnonzero((bound >= floors[i]) & (uids != query_uids[i]))
        order = order[np.argsort(-bound[order], kind="stable")]
        best: list[tuple[int, int]] = []
        for at in range(0, len(order), step):
            some = order[at : at + step]
            if len(best) == k and bound[some[0]] < -best[-1][0]:
                break
            scores = exact_scores(block[some], query)
            evaluated += len(some)
            best = sorted(best + [(-s, v) for s, v in zip(scores, ids[some].tolist())])[:k]
        out += [(int(query_uids[i]), vec_id, -score) for score, vec_id in best]
    return out, {"evaluated": evaluated, "pairs": len(queries) * len(block)}


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, n_pivots: int = 48, scale: float = 256.0, block: int = 4096, query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by `every`.

    Components become floor(scale * x). Rows with a null id or vector, or with components that are null, non-finite or
    not finite once scaled, take no part. Vectors of different lengths are compared as if padded with zeros; an empty
    vector scores 0 everywhere. Rows are told apart by themselves, not by id: of rows with the same id each is a
    candidate (also for the other rows of that id) and, if the id is divisible, each is a query with results of its
    own. Equal scores go to the smaller id. Scores are exact however large the components; one beyond a long is given
    as the nearest long, and ranked by its logarithm among such. Columns other than id and vector, whatever their names, play
    no part. An empty table, or a single row, gives no rows.
    """
    found, _ = searched(vectors, k, every, n_pivots, scale, block, query_block, id_col, vector_col)
    return found


def searched(vectors: DataFrame, k: int = 5, every: int = 50, n_pivots: int = 48, scale: float = 256.0, block: int = 4096, query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """What top_k returns, and counters of the pairs that reached a task and of those evaluated, filled as it runs."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null").select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v")
    shipped, evaluated = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for row in batch.column(2).to_pylist():
                ok = None not in row
                if ok:
                    with np.errstate(over="ignore", invalid="ignore"):
                        v = np.floor(scale * np.array(row, dtype=float))
                    ok = bool(np.isfinite(v).all())
                keep.append(ok)
                if ok:
                    out.append(encoded(v))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(out, pa.binary())], ["uid", "vec_id", "v"])

    rows = checkpointed(rows.mapInArrow(packed, "uid long, vec_id long, v binary"))
    n, width = rows.agg(F.count("*"), F.max(F.when(F.substring("v", 1, 1) == F.lit(b"h"), (F.length("v") - 1) / 2).otherwise((F.length("v") - 1) / 8))).first()
    width = int(width or 0)
    sample = hashed_sample(rows, "uid", SAMPLE).collect()
    known = matrix([r["v"] for r in sample], width)
    pivots = choose_pivots(known, n_pivots)
    reach = float(distances(known, pivots).max()) if len(known) else 0.0
    shared = spark.sparkContext.broadcast((np.array([r["uid"] for r in sample], dtype=np.int64), known, pivots, span_of(pivots), reach))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_uids, known, pivots, basis, reach = shared.value
        for batch in batches:
            uids, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2).to_pylist(), width)
            with np.errstate(over="ignore", invalid="ignore"):
                far = distances(x, pivots)
                place = placed(far, pivots, basis)
            near = far[:, 1:].argmin(axis=1) + 1 if len(pivots) > 1 else np.zeros(len(x), dtype=np.int64)
            at = far[np.arange(len(x)), near] / max(reach, 1e-300) * SHELLS
            shell = np.where(at < SHELLS - 1, at, SHELLS - 1).astype(np.int32)
            floors = np.full(len(ids), -np.inf)
            for i in np.flatnonzero(ids % every == 0):
                scores = (known @ x[i])[known_uids != uids[i]]
                if len(scores) >= k and np.isfinite(scores).all():
                    floors[i] = np.partition(scores, -k)[-k] - 1e-6 * np.abs(scores).max()
            as_bytes = lambda m: pa.array([row.tobytes() for row in m], pa.binary())
            columns = [*batch.columns, as_bytes(far.astype("<f4")), as_bytes(place.astype("<f4")), pa.array(floors), pa.array((near * SHELLS + shell).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "vec_id", "v", "far", "place", "floor", "g"])

    index = checkpointed(rows.mapInArrow(indexed, "uid long, vec_id long, v binary, far binary, place binary, floor double, g int"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            far, g = floats(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            for one in np.unique(g).tolist():
                here = far[g == one]
                n, low, high = held.get(one, (0, here[0], here[0]))
                held[one] = (n + len(here), np.minimum(low, here.min(axis=0)), np.maximum(high, here.max(axis=0)))
        lists = lambda i: pa.array([x[i].astype(float).tolist() for x in held.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), lists(1), lists(2)], ["g", "n", "low", "high"])

    per_task = index.select("far", "g").mapInArrow(ranges, "g int, n long, low array<double>, high array<double>")
    merged = lambda name, f: F.array(*[f(F.get(name, j)) for j in range(len(pivots))]).alias(name)
    groups = per_task.groupBy("g").agg(F.sum("n").alias("n"), merged("low", F.min), merged("high", F.max)).orderBy("g").collect()  # at most pivots x SHELLS rows
    merged_of, joint = {}, []  # small groups next to each other become one
    for r in groups:
        low, high = np.array(r["low"]), np.array(r["high"])
        if joint and joint[-1][0] + r["n"] <= block:
            n_before, low_before, high_before = joint.pop()
            joint.append((n_before + r["n"], np.minimum(low, low_before), np.maximum(high, high_before)))
        else:
            joint.append((r["n"], low, high))
        merged_of[r["g"]] = len(joint) - 1
    parts = [max(1, -(-x[0] // block)) for x in joint]
    rounded = 1 + 2.0**-22  # distances are kept as 32-bit floats
    summary = spark.sparkContext.broadcast((np.array([x[1] for x in joint]) / rounded, np.array([x[2] for x in joint]) * rounded, parts))
    query_blocks = max(1, -(-n // (every * query_block)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and part of a group that it can't do without."""
        low, high, parts = summary.value
        for batch in batches:
            far = floats(batch.column(4).to_pylist())
            take, where, which = [], [], []
            for i in range(batch.num_rows):
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = group_bound(far[i].astype(float), low, high)
                for g in np.flatnonzero(~(bound < batch.column(3)[i].as_py())).tolist():
                    take += [i] * parts[g]
                    where += [g] * parts[g]
                    which += range(parts[g])
            some = batch.select(["uid", "v", "place", "floor"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(where, pa.int32()), pa.array(which, pa.int32())], ["uid", "v", "place", "floor", "g", "part"])

    queries = index.where(F.col("vec_id") % every == 0).select("uid", "v", "place", "floor", "far")
    queries = queries.mapInArrow(asked, "uid long, v binary, place binary, floor double, g int, part int")
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("uid"), F.lit(query_blocks)).cast("int"))
    known_as = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("g")] if of else F.lit(1)
    others = index.select("uid", "vec_id", "v", "place", known_as(merged_of).alias("g"))
    others = others.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "uid"), known_as(dict(enumerate(parts)))).cast("int"))
    if query_blocks > 1:  # only to the blocks of queries that asked for the part
        asking = queries.select(F.col("g").alias("ag"), F.col("part").alias("ap"), F.col("qb").alias("ab")).distinct().hint("shuffle_hash")
        others = others.join(asking, (F.col("g") == F.col("ag")) & (F.col("part") == F.col("ap"))).select("uid", "vec_id", "v", "place", "g", "part", F.col("ab").alias("qb"))
    else:
        others = others.withColumn("qb", F.lit(0))

    def search(asking: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(candidates):
            return pd.DataFrame({"quid": [], "vec_id": [], "score": [], "beyond": []})
        x, place = matrix(candidates["v"].tolist(), width), floats(candidates["place"].tolist()).astype(float)
        q, q_place = matrix(asking["v"].tolist(), width), floats(asking["place"].tolist()).astype(float)
        found, seen = search_block(q, asking["uid"].to_numpy(), asking["floor"].to_numpy(), q_place, x, candidates["vec_id"].to_numpy(), candidates["uid"].to_numpy(), place, k)
        shipped.add(seen["pairs"])
        evaluated.add(seen["evaluated"])
        held = [(a, b, min(max(s, LEAST), MOST), 0.0 if LEAST <= s <= MOST else math.log2(abs(s)) * (1 if s > 0 else -1)) for a, b, s in found]
        return pd.DataFrame(held, columns=["quid", "vec_id", "score", "beyond"]).astype({"quid": "int64", "vec_id": "int64", "score": "int64"})

    grid = ["g", "part", "qb"]
    found = queries.groupBy(grid).cogroup(others.groupBy(grid)).applyInPandas(search, "quid long, vec_id long, score long, beyond double")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.select("quid", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    names = index.where(F.col("vec_id") % every == 0).select(F.col("uid").alias("named"), F.col("vec_id").alias("query_id"))
    out = ranked.join(names, F.col("quid") == F.col("named")).select("query_id", "rank", "vec_id", "score")
    return out, {"rows": n, "shipped": shipped, "evaluated": evaluated}


def floats(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with whole as (select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.uid, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from whole q join whole c on q.vec_id % 50 = 0 and q.uid <> c.uid),
ranked as (select *, row_number() over (partition by uid order by score desc, vec_id) as rank from pairs)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5
"""
