"""Mixture-controlled packing: deficit round-robin over the queues of sources.

Each source's documents wait in a queue, in shuffled order. A window is one round: each source's deficit grows by its
quantum, its share of the window's tokens, and its queue's next packets are served while the deficit covers them; what
is left is carried to the next window. So packet after packet a source is served up to w quanta after w windows, and the
window of a packet follows from the sum of tokens before it in its queue, which is taken over ranges of the queues: what
a partition's last window leaves over is carried into the next partition by those sums. Packets are pieces of a document
of at least `packet` tokens (whole documents if shorter), so that small documents stay whole however small the quantum.

Windows are laid end to end, in each the sources in turn, and cut into sequences; what is left at the end fills
sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, running_sums, table
from .mixing import MAX_BROADCAST_SOURCES

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"

# The vocabulary's pattern of words, spelt out for lower-cased text of a few Latin blocks.
_L, _N = "a-zªµºß-öø-ʯ", "0-9²³¹¼½¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Texts in which each character is its own normal form and is lower-cased by itself, to a letter of the pattern.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ȷ‐-‧‰-⁞₠-₿]*")


def merge_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary's byte strings with their ids, which rise with the order of merges; a space stands for the end of a word."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves there
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    return {bytes(byte[c] for c in token.removesuffix("</w>")) + b" " * token.endswith("</w>"): i for token, i in vocabulary.items()}


_READY: dict[str, Callable[[str], bytes]] = {}


def word_bpe(folder: str | None = None) -> Callable[[str], bytes]:
    """The ids of word_bpe_49k as 16-bit integers.

    Words of plain texts go to a quicker encoder of the same vocabulary, which joins any two parts that are a token
    together, the lowest id first; it gives the tokenizer's ids since each token is what its own bytes are merged to. Other
    texts, and those that may hold a special token, go to the tokenizer whole.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = f"{folder}/word_bpe_49k.json" if folder else public_tokenizers.path("word_bpe_49k.json")
    if path not in _READY:
        tokenizer = Tokenizer.from_file(path)
        quick = tiktoken.Encoding("word_bpe_49k", pat_str="[^ ]+ ", mergeable_ranks=merge_ranks(path), special_tokens={})

        def encode(text: str) -> bytes:
            if "<|" not in text and _PLAIN.fullmatch(text):
                return np.array(quick.encode_ordinary(" ".join([*_WORDS.findall(text.lower()), ""])), dtype="<u2").tobytes()
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

        _READY[path] = encode
    return _READY[path]


def tokens(docs: DataFrame, end_id: int, seed: int, tokenizers: str | None) -> DataFrame:
    """rid, doc_id, source, h, n, ids of each row of docs: h is its place in the shuffled order, ids are 16-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_bpe(tokenizers), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            ids = [encode(text.as_py() or "") + end for text in batch.column(4)]
            n = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], n, pa.array(ids, pa.large_binary() if sum(map(len, ids)) >> 31 else pa.binary())], ["rid", "doc_id", "source", "h", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, source string, h long, n long, ids binary")


def _by_source() -> list[Column]:
    """The order of sources: by code point, null last."""
    return [F.col("source").isNull(), F.encode("source", "UTF-8")]


def queued(sized: DataFrame, window: int, weights: Mapping[str | None, float] | None) -> tuple[DataFrame, int]:
    """rid, n, source, turn, at (tokens before it in its source's queue) and quantum of each row of (rid, doc_id, source, h, n); and all tokens."""
    spark = sized.sparkSession
    at = Rounds(spark).written(running_sums(sized, [*_by_source(), F.col("h"), F.col("doc_id"), F.col("rid")], at=F.col("n")))
    sources = at.groupBy("source").agg(F.min("at").alias("begin"), F.sum("n").alias("waiting"))
    sources = Rounds(spark).written(running_sums(sources, _by_source(), turn=F.lit(1)))
    total = sources.agg(F.sum("waiting")).first()[0] or 0
    weight = F.col("waiting").cast("double")
    if weights is not None:
        weight = F.lit(1.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sources = sources.withColumn("weight", weight)
    whole = sources.agg(F.sum("weight")).first()[0] or 1.0
    sources = sources.select(F.col("source").alias("of"), "begin", "turn", (F.col("weight") * (window / whole)).alias("quantum"))
    joined = at.join(F.broadcast(sources) if sources.count() <= MAX_BROADCAST_SOURCES else sources, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("rid", "n", "source", "turn", (F.col("at") - F.col("begin")).alias("at"), "quantum"), total


def served(queue: DataFrame, packet: int) -> DataFrame:
    """rid, source, turn, window, start, stop, at: the parts of each row that one window serves; at counts in the queue."""
    window_of = lambda end: F.greatest(F.ceil((F.col("at") + end) / F.col("quantum")) - 1, F.lit(0).cast("long"))
    packets = F.greatest(F.floor(F.col("n") / packet), F.lit(1).cast("long"))
    end = lambda i: F.when(i < packets, i * packet).otherwise(F.col("n"))
    inner = F.filter(F.sequence(F.lit(1).cast("long"), packets), lambda i: (i < packets) & (window_of(end(i)) != window_of(end(i + 1))))
    one = window_of(end(F.lit(1).cast("long"))) == window_of(F.col("n"))
    cuts = F.concat(F.array(F.lit(0).cast("long")), F.when(one, F.array().cast("array<bigint>")).otherwise(F.transform(inner, end)), F.array("n"))
    rows = queue.select("*", cuts.alias("cuts"))
    parts = F.transform(F.slice("cuts", F.lit(2), F.size("cuts") - 1), lambda stop, i: F.struct(F.get("cuts", i).alias("start"), stop.alias("stop")))
    rows = rows.select("rid", "source", "turn", "at", "quantum", F.inline(parts))
    return rows.select("rid", "source", "turn", window_of(F.col("stop")).alias("window"), "start", "stop", (F.col("at") + F.col("start")).alias("at"))


def tail_cuts(total: int, capacity: int) -> list[int]:
    """Where the sequences after the last full one begin: their lengths are the powers of two that make up the rest."""
    rest, out = total % capacity, []
    at = total - rest
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def pack(docs: DataFrame, capacity: int = 2048, window: int = 64 * 2048, packet: int = 128, end_id: int = 1, weights: Mapping[str | None, float] | None = None, seed: int = 11, tokenizers: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window of each piece of the rows of docs.

    A source's share of a window is its share of all tokens, so that every window has the mix of the whole; with weights
    (of 1 where a source has none) it is by weight as long as its queue lasts, and afterwards windows are smaller. In each
    window a source is within twice `packet` tokens of its share, and so it is over all windows up to any. A piece ends
    where its window, its sequence or its document ends. Null and empty texts are one end id; very long ones give as many
    pieces as they need; a null source is a source; repeated rows are packed each, and equal ones are interchangeable.
    doc_id may be null. Columns other than doc_id, text and source, whatever their names, play no part. Vocabularies have
    at most 2^16 ids. An empty table gives no rows.
    """
    spark = docs.sparkSession
    if capacity & (capacity - 1) or min(capacity, window, packet) < 1:
        raise ValueError("capacity must be a power of two; window and packet at least 1")
    coded = Rounds(spark).written(tokens(docs, end_id, seed, tokenizers))
    queue, total = queued(coded.select("rid", "doc_id", "source", "h", "n"), window, weights)
    parts = Rounds(spark).written(served(queue, packet))
    grid = parts.groupBy("window", "turn").agg(F.sum(F.col("stop") - F.col("start")).alias("held"), F.min("at").alias("first"))
    grid = Rounds(spark).written(running_sums(grid, [F.col("window"), F.col("turn")], base=F.col("held")).select("window", "turn", "first", "base"))
    placed = parts.join(grid, ["window", "turn"]).select("rid", F.struct("start", "stop", (F.col("base") + F.col("at") - F.col("first")).alias("place"), "window").alias("part"))
    placed = placed.groupBy("rid").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # as many as the row has
    full, tail = total // capacity, tail_cuts(total, capacity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, source, n, ids, parts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                for part in parts:
                    begin, shift = part["place"], part["start"] - part["place"]
                    end = begin + part["stop"] - part["start"]
                    edges = [begin, *range((begin // capacity + 1) * capacity, end, capacity)]
                    edges = sorted({*(x for x in edges if x < end), *(x for x in tail if begin < x < end), end})
                    for a, b in zip(edges, edges[1:]):
                        late = bisect_right(tail, a)
                        sequence, offset = (full + late - 1, a - tail[late - 1]) if late else (a // capacity, a % capacity)
                        row = (doc_id, a + shift, b - a, zlib.crc32(ids[a + shift : b + shift].tobytes()), n, sequence, offset, source, part["window"])
                        for column, value in zip(out, row):
                            column.append(value)
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return coded.join(placed, "rid").select("doc_id", "source", "n", "ids", "parts").mapInArrow(cut, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
