"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule takes the point frac(t * golden ratio), mapped through the sources' cumulative shares of the
whole target; the k-th slot of a source takes the source's k-th block of equally many words, from its documents in
shuffled order, starting anew when they are used up. A source's last slot is cut where its target is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, WORD, checkpointed, fresh, running_sums, table

GOLDEN = 0.6180339887498949
#: Slots ranked together, and documents placed together, at most about so many.
CHUNK = 4096
#: Points and sources' shares of the whole meet in so many bins.
BINS = 1024
#: Tables of more sources than that aren't broadcast.
MAX_BROADCAST_SOURCES = 10_000


def sizes(docs: DataFrame, text_col: str = "text") -> Column:
    """The number of words in the text; of null 0."""
    return F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long")


def _by_source() -> list[Column]:
    """The order of sources: by code point, null last."""
    return [F.col("source").isNull(), F.encode("source", "UTF-8")]


def targets(by_source: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times the size; what is over
    goes to the others by weight. That settles where all other targets are the same multiple of their weight: the
    sources are met in order of size over weight, and stop as long as an even share of the rest would exceed the limit.
    """
    rows = running_sums(by_source, _by_source(), turn=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    rows = rows.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    total, all_w = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    rows = running_sums(rows, [F.col("cap") / F.col("w"), *_by_source()], cap_before=F.col("cap"), w_before=F.col("w"))
    rows = rows.withColumn("even", (F.lit(float(total) * float(share)) - F.col("cap_before")) / (F.lit(all_w) - F.col("w_before")))
    # The multiple is that of the first source that an even share of the rest leaves below its limit.
    first = rows.where(F.col("even") * F.col("w") <= F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("w"), "even"))["even"]).first()[0]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.lit(first).cast("double") * F.col("w"), F.col("cap"))).alias("target"))


def _earlier(sums: DataFrame, value: str) -> DataFrame:
    """(s, c, base): of each (source, chunk) the sum of the value over the source's chunks before it."""
    summed = running_sums(sums, [*_by_source(), F.col("chunk")], base=F.col(value))
    starts = summed.groupBy(F.col("source").alias("of")).agg(F.min("base").alias("start"))
    joined = summed.join(starts, F.col("source").eqNullSafe(F.col("of")))
    return joined.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.col("base") - F.col("start")).alias("base"))


def mix(docs: DataFrame, block_words: int = 2048, seed: int = 8, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places, targets and the schedule of docs (doc_id, text, source).

    places: doc_id, source, size, at (first word in the source's shuffled words), for each row of docs.
    plan: source, source_size, target. schedule: slot, source, block, part (0: the source's first run through, 1: the
    second), words (of the block that are taken). Null texts and texts without words have size 0 and no place in the
    schedule; a null source is a source; repeated rows are documents of their own. An empty table gives empty results.
    """
    sized = docs.select("doc_id", "source", sizes(docs).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.md5("text")).alias("h"))
    sized = checkpointed(sized)
    plan = checkpointed(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))

    # Where each document starts in its source's shuffled words: documents are dealt to chunks by hash, summed, and ordered in them.
    n = sized.count()
    chunks = max(256, 2 * n // CHUNK)
    dealt = sized.where("size > 0").select("*", F.pmod("h", F.lit(chunks)).alias("chunk"))
    sums = dealt.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("inside"))
    placed = placed.join(_earlier(sums, "words"), F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    places = placed.select("doc_id", "source", "size", "h", (F.col("base") + F.col("inside")).alias("at"))
    places = places.unionByName(sized.where("size = 0").select("doc_id", "source", "size", "h", F.lit(None).cast("long").alias("at")))

    return places, plan, _schedule(plan, block_words)


def _schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """slot, source, block, part, words."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    shares = running_sums(plan.where("target > 0"), _by_source(), before=F.col("target"), turn=F.lit(1))
    top = shares.agg(F.max("turn")).first()[0]
    part = lambda c: c / F.lit(max(total, 1.0))
    shares = shares.select(
        "source", "source_size", "target", F.floor("target").alias("most"), part(F.col("before")).alias("lo"), part(F.col("before") + F.col("target")).alias("hi"),
        (F.col("turn") == F.lit(top)).alias("last"), "turn",
    )
    shares = checkpointed(shares)
    # Some slots more than the words fill. What is over is cut below; a source that still lacks slots gets them after the last.
    sources = plan.count()
    slots = int(total * 1.02 / block_words) + 16 * sources + 16 if total else 0
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    points = spark.range(slots).select(F.col("id").alias("slot")).select("slot", point.alias("u"))
    every = shares.select(F.col("source").alias("s"), "source_size", "most", "turn")
    shares = shares.select("*", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.floor(F.least("hi", F.lit(1.0)) * BINS))).alias("bin"))
    here = (F.floor(F.col("u") * BINS) == F.col("bin")) & (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last"))
    hit = points.join(F.broadcast(shares) if sources <= MAX_BROADCAST_SOURCES else shares, here)
    hit = hit.select("slot", "source", "source_size", "most", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    sums = _earlier(hit.groupBy("source", "chunk").agg(F.count("*").alias("n")), "n")
    ranked = hit.select("*", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")).alias("k"))
    ranked = ranked.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.select("slot", "source", "source_size", "most", (F.col("base") + F.col("k") - 1).alias("rank"))
    got = hit.groupBy("source").agg(F.count("*").alias("got"))
    late = every.join(got, F.col("source").eqNullSafe(F.col("s")), "left").select("s", "source_size", "most", "turn", F.coalesce("got", F.lit(0)).alias("got"))
    late = late.where(F.col("got") * block_words < F.col("most"))
    late = late.select("*", F.explode(F.sequence(F.col("got"), F.ceil(F.col("most") / block_words) - 1)).alias("rank"))
    late = late.select((F.lit(slots) + (F.col("rank") - F.col("got")) * sources + F.col("turn")).alias("slot"), F.col("s").alias("source"), "source_size", "most", "rank")
    first = F.col("rank") * block_words
    both = ranked.unionByName(late)
    return both.select("slot", "source", "source_size", first.alias("first"), F.least(first + block_words, "most").alias("end")).where("first < end")


def taken(docs: DataFrame, block_words: int = 2048, **options) -> DataFrame:
    """doc_id, source, size, h, at, source_size, target, taken, slots of each row of docs: the words that the mix takes of it.

    Slots and documents are cut at the same block borders (first run through, then second) and joined by block. slots
    are the first slot that takes words of the row, in the first and in the second run through; null for none. Null texts
    and texts without words are there with size and taken 0; a null source is a source; very long texts are taken in
    many slots; repeated rows are documents of their own. An empty table gives no rows.
    """
    places, plan, schedule = mix(docs, block_words, **options)
    places = checkpointed(places)
    # A slot's span of the endless stream, in the source's words: at most two pieces, each within some blocks.
    runs = F.array(*[
        F.struct(F.greatest(F.col("first") - F.col("source_size") * r, F.lit(0)).alias("a"), F.least(F.col("end") - F.col("source_size") * r, F.col("source_size")).alias("b"), F.lit(r).alias("part"))
        for r in (0, 1)
    ])
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block_words), F.floor((b - 1) / block_words)))
    spans = schedule.select("source", "slot", F.inline(runs)).where("a < b").select("source", "slot", "a", "b", "part", blocks(F.col("a"), F.col("b")).alias("block"))
    pieces = places.where("size > 0").select("doc_id", "source", "size", "h", "at", blocks(F.col("at"), F.col("at") + F.col("size")).alias("block"))
    clip = lambda lo, hi: (F.greatest(F.col("block") * block_words, lo), F.least((F.col("block") + 1) * block_words, hi))
    lo, hi = clip(F.col("at"), F.col("at") + F.col("size"))
    pieces = pieces.select("doc_id", "h", "at", F.col("source"), "block", lo.alias("p"), hi.alias("q"))
    lo, hi = clip(F.col("a"), F.col("b"))
    spans = spans.select(F.col("source").alias("s"), F.col("block").alias("k"), "slot", "part", lo.alias("a"), hi.alias("b"))
    joined = pieces.join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    words = F.greatest(F.least("q", "b") - F.greatest("p", "a"), F.lit(0))
    first = [F.min(F.when((words > 0) & (F.col("part") == r), F.col("slot"))) for r in (0, 1)]
    took = joined.groupBy("source", "at").agg(F.sum(words).alias("taken"), F.array(*first).alias("slots")).select(F.col("source").alias("s"), F.col("at").alias("p"), "taken", "slots")
    out = places.join(took, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("p")), "left").drop("s", "p")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = out.join(F.broadcast(plan) if plan.count() <= MAX_BROADCAST_SOURCES else plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "h", "at", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "slots")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, in the order of the schedule: each row of docs as often as it is taken whole, and once more with the taken words if in part.

    Columns are those of docs. Only the document at which a source's target is reached is taken in part. Documents are
    where the first of their words is scheduled, those of one slot one after the other. Rows without words aren't taken.
    """
    key, left, times = fresh(docs, "mix_key", "mix_left", "mix_times")
    took = taken(docs.select("doc_id", "text", "source"), **options)
    took = took.where("taken > 0").groupBy("doc_id", "h").agg(F.max("size").alias("size"), F.max("taken").alias("taken"), F.min("slots").alias("slots"), F.min("at").alias("at"))
    took = took.select(F.col("doc_id").alias(key), F.col("h").alias("mix_h"), F.struct("size", "taken", "slots", "at").alias(left)).withColumnRenamed("mix_h", times)
    h = F.xxhash64(F.lit(options.get("seed", 8)), docs["doc_id"], F.md5(docs["text"]))
    joined = docs.join(took, docs["doc_id"].eqNullSafe(F.col(key)) & (h == F.col(times)))
    whole = F.floor(F.col(left)["taken"] / F.col(left)["size"])
    rest = F.col(left)["taken"] - whole * F.col(left)["size"]
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    placed = F.transform(copies, lambda n, i: F.struct(F.get(F.col(left)["slots"], i).alias("slot"), F.col(left)["at"].alias("at"), n.alias("words")))
    joined = joined.select(*[joined[f"`{c}`"] for c in docs.columns], F.explode(placed).alias(left))
    joined = joined.repartitionByRange(F.col(left)["slot"], F.col(left)["at"]).sortWithinPartitions(F.col(left)["slot"], F.col(left)["at"])
    words = F.col(left)["words"]
    part = F.array_join(F.slice(F.array_remove(F.split("text", BLANK), ""), F.lit(1), F.greatest(words, F.lit(1)).cast("int")), " ")
    return joined.select(*[F.when(words == 0, F.col("text")).otherwise(part).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.get("slots", 0).alias("first_slot"))
