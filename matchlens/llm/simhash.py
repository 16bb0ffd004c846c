"""SimHash near-duplicates found by covering locality-sensitive hashing.

The fingerprint's bits are dealt to the non-zero vectors of r + 1 bits. Each such vector v makes a table, whose mask
keeps the bits dealt to vectors that have an odd scalar product with v. Any r bits that differ leave some v orthogonal
to all of their vectors; in that table both fingerprints have the same key. So no pair within radius r is missed.

A bucket's fingerprints agree in its mask's bits and differ in the rest only. So a bucket of more than `most` is dealt
again by covering masks of the bits that are left, and so on: with radius 2 there are 28 bits left after the first
dealing, 12 after the second, and 6 at most after the third, where no bucket can hold more than 64 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, table, unpartitioned
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a text's word shingles; 0 for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    k = shingle - 1
    if len(found) <= k:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts[: len(found) - k].tolist(), ends[k:].tolist())]
    return fingerprint_of(np.array(hashes, dtype=np.uint64))


def fingerprint_of(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The bits that are set in over half of the hashes; 0 if there are none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = 2, places: Sequence[int] = range(BITS)) -> list[list[int]]:
    """For each non-zero vector of radius + 1 bits, those of the places (of bits) that its table's key keeps."""
    vectors = range(1, 1 << (radius + 1))
    return [[p for i, p in enumerate(places) if bin(v & vectors[i % len(vectors)]).count("1") % 2] for v in vectors]


def _signed(places: Sequence[int]) -> int:
    mask = sum(1 << p for p in places)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(distinct: DataFrame, radius: int = 2, most: int = 32) -> DataFrame:
    """All pairs (a, b), a below b, of distinct fingerprints (column fp) that differ in at most radius bits.

    A pair is given once for each bucket that it is found in. Buckets of more than `most` are dealt again, as above,
    as long as more than six bits are left; `most` changes the work, never the pairs.
    """
    if not 0 <= radius <= 2:
        raise ValueError("a radius from 0 to 2 is supported")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    rows, out = distinct.select("fp", F.lit(0).alias("path")), []
    left = [list(range(BITS))]  # the places that are in no key, for each path of tables
    while True:
        kept = [covering_masks(radius, places) for places in left]
        n = len(kept[0])
        left = [[p for p in places if p not in one] for places, tables in zip(left, kept) for one in tables]
        # A key holds the bits of all tables on its path.
        masks = F.array(*[F.lit(_signed([p for p in range(BITS) if p not in places])) for places in left])
        key = lambda i: F.struct((F.col("path") * n + i).alias("t"), F.col("fp").bitwiseAND(F.get(masks, F.col("path") * n + i)).alias("k"))  # noqa: B023, E731
        dealt = rows.select("fp", F.inline(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), key)))
        sizes = dealt.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
        dealt = checkpointed(dealt.join(sizes.select("t", unpartitioned("k"), "n"), ["t", "k"]).select("fp", "t", "k", "n"))
        last = max(map(len, left)) <= 6
        group = (dealt if last else dealt.where(F.col("n") <= most)).groupBy("t", "k").agg(F.collect_list("fp").alias("g"))
        each = group.select("g", F.explode("g").alias("a"))
        out.append(each.select("a", F.explode(F.filter("g", lambda x: (x > F.col("a")) & near(x, F.col("a")))).alias("b")))
        rows = dealt.where(F.col("n") > most).select("fp", F.col("t").alias("path"))
        if last or rows.isEmpty():
            return reduce(DataFrame.union, out)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, most: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    Rows whose fingerprints differ in at most `radius` bits are linked; component_id is the least doc_id of a row's
    component. Null and empty texts have fingerprint 0 and are linked like any other; very long texts are read whole.
    Each repeated row gives its own result row. A null doc_id never is a component_id unless a component has no other.
    An empty table gives no rows. Other columns of docs, whatever their names, play no part.
    """
    marked = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(near_links(classes.select("fp"), radius, most), "a", "b")
    roots = classes.join(found.select(unpartitioned("node"), "root"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = checkpointed(roots)
    tops = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.select("fp", unpartitioned("root")).join(tops.select(unpartitioned("root"), "component_id"), "root").select("fp", "component_id")
    return marked.select("doc_id", unpartitioned("fp")).join(named.select(unpartitioned("fp"), "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with the least doc_id of each component only, once; rows without a doc_id stay."""
    return first_of_each(docs, near_duplicates(docs, **options), options.get("id_col", "doc_id"))


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the rows whose doc_id is a component_id of found only, each doc_id once; rows without a doc_id stay."""
    kept = checkpointed(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    key = docs[id_col].cast("long")
    (name,) = fresh(docs, "kept_id")
    stay = docs.join(kept.select(unpartitioned("doc_id").alias(name)), key == F.col(name), "left_semi")
    if not kept.where("n > 1").isEmpty():
        stay = stay.dropDuplicates([id_col])
    return stay.unionByName(docs.where(docs[id_col].isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", digits.alias("fingerprint"), "component_id")
