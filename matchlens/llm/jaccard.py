"""Near-duplicates of the pipeline's SimHash stage: texts whose word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of five-word shingles and their covering tables (simhash.py) give candidates, but at a similarity
of 0.8 some ten of 64 bits differ on average, and tables that cover so many would be too many. So min-hash bands give
more: each set of shingles gets BANDS keys of WIDTH min-hashes, and a pair with similarity 0.8 shares none with
probability (1 - 0.8^WIDTH)^BANDS = 3e-6. All candidates are verified on their shingle sets.

Texts with equal shingle sets are one class. A bucket with more than `dense` classes is first compared with two of its
own only, the one with most neighbours and a random one. If this leaves a bucket in several components, its classes are
compared across them where they share one of their rarest shingles: of two sets with a similarity of s, both of at least
n shingles, any (1 - s) n + 1 of the one, rarest first, meet as many of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unpartitioned
from .components import connected_components
from .simhash import fingerprint_of, near_links

BANDS, WIDTH, STEP = 24, 4, 1 << 12
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * WIDTH, 1), dtype=np.uint64)
FACTORS, SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a text's word shingles, in order, repeats included; a shorter text is one shingle, one without words none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, digest, k = b" ".join(found), xxhash.xxh64_intdigest, shingle - 1
    if len(found) <= k:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([digest(joined[i:j], 42) for i, j in zip(starts[: len(found) - k].tolist(), ends[k:].tolist())], dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a non-empty set, as signed longs."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, (hashes[None, at : at + STEP] * FACTORS + SHIFTS).min(axis=1))
    least = least.reshape(BANDS, WIDTH)
    keys = least[:, 0].copy()
    for i in range(1, WIDTH):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + least[:, i]
    return keys.view(np.int64)


def _sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, s1, s2, fp, size, bands) of every row: hashes of the text and of its set, 128 bits each, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints = [], []
            for x in batch.column(3):
                hashes = shingle_hashes(x.as_py(), shingle)
                prints.append(fingerprint_of(hashes))
                sets.append(np.unique(hashes))
            whole = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8") for s in sets], dtype=np.int64).reshape(-1, 2)
            keys = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            new = [pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], ["doc_id", "h1", "h2", "s1", "s2", "fp", "size", "bands"])

    return _named(docs, id_col, text_col).mapInArrow(run, "doc_id long, h1 long, h2 long, s1 long, s2 long, fp long, size int, bands array<long>")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def _sets(needed: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of the classes in the column need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["id", "hashes"])

    need = classes.join(needed.distinct().select(unpartitioned("need")), F.col("id") == F.col("need")).select("id", F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("least").alias("of"))
    found = texts.join(need, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("id", "text")
    return checkpointed(found.mapInArrow(run, "id long, hashes array<long>").dropDuplicates(["id"]))


def _similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Those of the pairs (a, b) of classes with a similarity of tenths / 10 at least."""
    pairs = checkpointed(pairs.distinct())
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("need")), classes, texts, shingle)
    of = lambda key, name: sets.select(unpartitioned("id").alias(key), F.col("hashes").alias(name))
    both = pairs.join(of("ka", "x"), F.col("a") == F.col("ka")).select("a", unpartitioned("b"), "x").join(of("kb", "y"), F.col("b") == F.col("kb"))
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
    return checkpointed(both.where(F.col("shared") * 10 >= (F.col("sizes") - F.col("shared")) * tenths).select("a", "b"))


def _by_rare_shingles(left: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Pairs (a, b) of the classes left (id, root), of different roots, that share one of their rarest shingles."""
    sets = _sets(left.select(F.col("id").alias("need")), classes, texts, shingle)
    each = sets.select("id", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    often = each.groupBy(F.col("h").alias("oh")).agg(F.count("*").alias("n"))
    each = each.select("id", "size", unpartitioned("h")).join(often.select(unpartitioned("oh"), "n"), F.col("h") == F.col("oh"))
    rarest = each.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"))
    first = (F.col("size") - F.ceil(F.col("size") * tenths / 10) + 1).cast("int")
    rarest = rarest.select("id", "size", F.explode(F.slice("s", F.lit(1), first)).alias("s")).select("id", "size", "s.h", "s.n").where("n > 1")
    roots = left.select(F.col("id").alias("of"), "root").distinct()
    rarest = checkpointed(rarest.join(roots.select(unpartitioned("of"), "root"), F.col("id") == F.col("of")).select("id", "size", "h", "root"))
    x, y = rarest.alias("x"), rarest.select("id", "size", unpartitioned("h"), "root").alias("y")
    fits = (F.col("x.size") * 10 >= F.col("y.size") * tenths) & (F.col("y.size") * 10 >= F.col("x.size") * tenths)
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") < F.col("y.root")) & fits)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _by_fingerprints(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints are equal or differ in at most two bits: one class stands for a fingerprint."""
    reps = checkpointed(classes.where("size > 0").groupBy(F.col("fp").alias("f")).agg(F.min("id").alias("rep")))
    same = classes.where("size > 0").select("id", unpartitioned("fp")).join(reps.select(unpartitioned("f"), "rep"), F.col("fp") == F.col("f")).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    of = lambda key, name: reps.select(unpartitioned("f").alias(key), F.col("rep").alias(name))
    near = near_links(reps.select(F.col("f").alias("fp")))
    near = near.join(of("fa", "ra"), F.col("a") == F.col("fa")).select("ra", unpartitioned("b")).join(of("fb", "rb"), F.col("b") == F.col("fb"))
    return same.union(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 5, tenths: int = 8, dense: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row of docs; rows with a similarity of tenths / 10 at least are linked.

    Words are lower-cased (ASCII). Texts without words, null or empty, are linked to each other; a text shorter than a
    shingle to those with the same words; very long texts are read whole. component_id is the least doc_id of a row's
    component, null only if it has none. Repeated rows give a row each, an empty table none. Other columns of docs,
    whatever their names, play no part.
    """
    marked = checkpointed(_sketches(docs, shingle, id_col, text_col))
    classes = marked.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("one"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "fp", "size", "bands", F.col("one.doc_id").alias("least"), "one.h1", "one.h2"))
    names = classes.select("id", "least", "h1", "h2")
    texts = _named(docs, id_col, text_col)
    rows = classes.select("id", "size", F.posexplode("bands").alias("t", "k"))
    counts = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    rows = checkpointed(rows.join(counts.select("t", unpartitioned("k"), "n"), ["t", "k"]).select("id", "size", "t", "k", "n"))
    may = lambda x, y: (x["size"] * 10 >= y["size"] * tenths) & (y["size"] * 10 >= x["size"] * tenths)
    group = rows.where(F.col("n") <= dense).groupBy("t", "k").agg(F.collect_list(F.struct("id", "size")).alias("g"))
    each = group.select("g", F.explode("g").alias("x")).select("x", F.explode(F.filter("g", lambda y: (y["id"] > F.col("x.id")) & may(y, F.col("x")))).alias("y"))
    pairs = [each.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), _by_fingerprints(classes.select("id", "fp", "size"))]
    many = rows.where(F.col("n") > dense)
    any_dense = not many.isEmpty()
    if any_dense:
        central = many.groupBy("id").agg(F.sum("n").alias("near"))
        many = checkpointed(many.join(central.select(unpartitioned("id").alias("c"), "near"), F.col("id") == F.col("c")).select("id", "size", "t", "k", "near"))
        one = F.struct("id", "size")
        pivots = many.groupBy("t", "k").agg(F.max_by(one, F.struct("near", "id")).alias("p"), F.min_by(one, F.xxhash64("id")).alias("q"))
        pivots = pivots.select(F.col("t").alias("pt"), unpartitioned("k").alias("pk"), F.explode(F.array("p", "q")).alias("p"))
        dealt = many.join(pivots, (F.col("t") == F.col("pt")) & (F.col("k") == F.col("pk"))).select(one.alias("x"), F.col("p").alias("y")).where((F.col("x.id") != F.col("y.id")) & may(F.col("x"), F.col("y")))
        pairs.append(dealt.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    links = _similar(reduce(DataFrame.union, pairs), names, texts, shingle, tenths)
    found = checkpointed(connected_components(links, "a", "b"))
    if any_dense:
        many = many.join(found.select(unpartitioned("node"), "root"), F.col("id") == F.col("node"), "left").select("id", "size", "t", "k", F.coalesce("root", "id").alias("root"))
        mixed = many.groupBy("t", "k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        left = checkpointed(many.join(mixed.select(F.col("t").alias("mt"), unpartitioned("k").alias("mk")), (F.col("t") == F.col("mt")) & (F.col("k") == F.col("mk"))).select("id", "size", "t", "k", "root"))
        if not left.isEmpty():
            more = _similar(_by_rare_shingles(left.select("id", "root"), names, texts, shingle, tenths), names, texts, shingle, tenths)
            found = checkpointed(connected_components(links.union(more), "a", "b"))
    roots = classes.select("id", "s1", "s2", "least").join(found.select(unpartitioned("node"), "root"), F.col("id") == F.col("node"), "left").select("s1", "s2", "least", F.coalesce("root", "id").alias("root"))
    roots = checkpointed(roots)
    tops = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.select("s1", "s2", unpartitioned("root")).join(tops.select(unpartitioned("root"), "component_id"), "root").select(unpartitioned("s1"), "s2", "component_id")
    return marked.select("doc_id", unpartitioned("s1"), "s2").join(named, ["s1", "s2"]).select("doc_id", "component_id")
