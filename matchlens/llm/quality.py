"""Quality rules: learned decision lists, run as ordered Spark conditional expressions.

Sequential covering: grow a conjunction of thresholds that best separates the low-quality rows still uncovered, prune
it on rows held out, append it to the list, take away what it covers, go on. All statistics and the list itself are
built-in Spark expressions; Python sees only a bounded sample of labelled statistics while the list is learned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, fresh, hashed_sample, table, words

#: Most labelled rows that a decision list is learned from.
MAX_LABELLED = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "bars", "longest", "line_words", "distinct"]


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[c.alias(k) for k, c in columns.items()])


#: The counts that each feature is made of, beyond the base statistics.
NEEDS = {"dup_lines": ["n_lines"], "upper": ["n_upper", "n_lower"], "digits": ["n_digits"], "marks": ["n_marks"], "bars": ["n_bars"], "longest": ["longest"], "line_words": ["n_lines"], "distinct": ["n_distinct"]}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """doc_id, the five base statistics (longs) and the named ones of FEATURES for each row of docs.

    Null and empty texts have no words: counts are 0 and ratios 0. Repeated rows give a row each.
    n_repeat_words counts the positions of words that lie in a window of three found twice or more in the text. Very long
    texts are read whole; a null id is one like others; columns other than id and text, whatever their names, play no part;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", "t", words(F.col("t")).alias("w"))
    # Of three rows of words, shifted against each other, the windows' hashes.
    window = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    df = _stage(df, h=F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), window))
    df = _stage(df, repeated=F.size(F.array_distinct("h")) < F.size("h"))
    pairs = F.when(F.col("repeated"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.select("doc_id", "t", "w", pairs.alias("s"))
    twice = F.filter("s", lambda v, j: (F.get("s", j - 1)["x"] == v["x"]) | (F.get("s", j + 1)["x"] == v["x"]))
    df = df.select("doc_id", "t", "w", twice.alias("d"))
    starts = F.transform("d", lambda v: v["i"])
    covered = F.array_distinct(F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _stage(df, c=covered, lines=lines)
    size, length = lambda c: F.size(c).cast("long"), lambda c: F.length(c).cast("long")
    of = lambda chars: length(F.col("t")) - length(F.translate("t", chars, ""))
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    counts = {
        "n_words": size("w"),
        "word_chars": length(F.regexp_replace("t", BLANK, "")),
        "n_symbols": of("#*$%&|<>"),
        "n_dup_lines": size("lines") - size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("c").isNull(), F.lit(0).cast("long")).otherwise(size("c")),
        "n_lines": size("lines"),
        "n_distinct": size(F.array_distinct("w")),
        "longest": F.coalesce(F.aggregate("w", F.lit(0), lambda a, x: F.greatest(a, F.length(x))), F.lit(0)),
        "n_upper": of(upper),
        "n_lower": of(lower),
        "n_digits": of("0123456789"),
        "n_marks": of("!?"),
        "n_bars": of("|"),
    }
    needed = {*BASE, *[c for f in features for c in NEEDS.get(f, [])]}
    df = df.select("doc_id", *[c.alias(k) for k, c in counts.items() if k in needed])
    # A row is passed on as the one element of an array. Filters on what follows stay above that; pushed below, each
    # would repeat the nested expressions above many times over.
    df = df.select(F.explode_outer(F.array(F.struct("*"))).alias("row")).select("row.*")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    ratios = {
        "mean_word": lambda: share("word_chars", "n_words"),
        "symbols": lambda: share("n_symbols", "word_chars"),
        "dup_lines": lambda: share("n_dup_lines", "n_lines"),
        "repeats": lambda: share("n_repeat_words", "n_words"),
        "upper": lambda: F.coalesce(F.try_divide(F.col("n_upper").cast("double"), F.col("n_upper") + F.col("n_lower")), F.lit(0.0)),
        "digits": lambda: share("n_digits", "word_chars"),
        "marks": lambda: share("n_marks", "n_words"),
        "bars": lambda: share("n_bars", "n_words"),
        "longest": lambda: F.col("longest").cast("double"),
        "line_words": lambda: share("n_words", "n_lines"),
        "distinct": lambda: share("n_distinct", "n_words"),
    }
    return df.select("doc_id", *BASE, *[ratio().alias(k) for k, ratio in ratios.items() if k in features])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold)."""

    terms: tuple[tuple[str, str, float], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, op, at in self.terms:
            out &= x[name] <= at if op == "<=" else x[name] > at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.terms:
            out = out & (F.col(name) <= at if op == "<=" else F.col(name) > at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {a:g}" for n, o, a in self.terms)


@dataclass(frozen=True)
class DecisionList:
    """The first rule that fits says "low"; a row that none fits is good."""

    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """True for a good row, as one ordered conditional expression."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
        return F.lit(True) if out is None else out.otherwise(True)

    def features(self) -> list[str]:
        return sorted({name for rule in self.rules for name, _, _ in rule.terms})

    def good(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for rule in self.rules:
            out &= ~rule.mask(x)
        return out


def _grow(x: dict[str, np.ndarray], low: np.ndarray, max_terms: int, cuts: int) -> Rule:
    """Adds the term of greatest information gain until only low rows are covered."""
    terms: list[tuple[str, str, float]] = []
    inside = np.ones(len(low), dtype=bool)
    while len(terms) < max_terms and (~low[inside]).any():
        p, n = (low & inside).sum(), (~low & inside).sum()
        base, best = np.log2(p / (p + n)), (0.0, None)
        for name, v in x.items():
            edges = np.unique(v[inside])
            mids = (edges[1:] + edges[:-1]) / 2
            if len(mids) > cuts:
                mids = mids[np.linspace(0, len(mids) - 1, cuts).astype(int)]
            lows, highs = np.sort(v[inside & low]), np.sort(v[inside & ~low])
            below_p, below_n = np.searchsorted(lows, mids, "right"), np.searchsorted(highs, mids, "right")
            for op, pp, nn in (("<=", below_p, below_n), (">", p - below_p, n - below_n)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), 0.0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (gain.max(), (name, op, float(mids[gain.argmax()])))
        if best[1] is None:
            break
        terms.append(best[1])
        inside = inside & Rule((best[1],)).mask(x)
    return Rule(tuple(terms))


def learn(x: dict[str, np.ndarray], low: np.ndarray, max_rules: int = 12, max_terms: int = 4, precision: float = 0.9, least: int = 4, cuts: int = 256) -> DecisionList:
    """A decision list for the rows marked low. Every third row is held out for pruning.

    A pruned rule must cover `least` low rows of all that are left, at `precision` or more; without low rows, or
    without others, the list is empty. Equal gains go to the feature named first, so reruns agree.
    """
    rules: list[Rule] = []
    if not low.any() or low.all():
        return DecisionList(())
    left = np.ones(len(low), dtype=bool)
    held = np.arange(len(low)) % 3 == 2
    part = lambda m: {k: v[m] for k, v in x.items()}
    while len(rules) < max_rules and (left & low & ~held).sum() >= 2:
        grow, prune = left & ~held, left & held
        rule = _grow(part(grow), low[grow], max_terms, cuts)
        if not rule.terms:
            break

        def worth(r: Rule) -> float:
            hit = r.mask(part(prune))
            p, n = (hit & low[prune]).sum(), (hit & ~low[prune]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        options = [Rule(rule.terms[:k]) for k in range(1, len(rule.terms) + 1)]
        rule = max(options, key=worth)
        hit = rule.mask(x) & left
        p, n = (hit & low).sum(), (hit & ~low).sum()
        if p < least or p / (p + n) < precision:
            rule = options[-1]
            hit = rule.mask(x) & left
            p, n = (hit & low).sum(), (hit & ~low).sum()
            if p < least or p / (p + n) < precision:
                break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def learned(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> DecisionList:
    """Learns from the statistics of at most max_labelled labelled rows, chosen by a hash of doc_id.

    Rows with a null label or doc_id aren't used; without labelled rows the list is empty and all rows are good.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = hashed_sample(chosen, "doc_id", max_labelled).select(F.col("doc_id").alias("chosen_id"), "quality")
    some = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id"))
    stats = statistics(some.select("doc_id", "text")).join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id"))
    rows = stats.select("doc_id", "quality", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(max_labelled).collect()
    x = {k: np.array([float(r[k]) for r in rows]) for k in FEATURES}
    return learn(x, np.array([r["quality"] == 0 for r in rows], dtype=bool), **options)


def judged(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every row of docs.

    The first rule that fits decides; a value equal to a rule's threshold lies below it. Null and empty texts fail the base
    rules. For long texts, repeated rows, other columns and empty tables see statistics.
    """
    stats = statistics(docs, id_col, text_col, rules.features()).select("*", base_failed().alias("base_failed"))
    return stats.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & rules.column()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """docs without the rows that the base rules or the list reject; columns as before, whatever their names.

    Null and empty texts go; very long ones are read whole; of repeated rows all stay or go; an empty table stays empty.
    """
    (whole,) = fresh(docs, "whole_row")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(whole))
    stats = statistics(packed.select(F.col(whole), F.col(whole)[text_col].alias("judged_text")), whole, "judged_text", rules.features())
    # An array of the row or nothing, exploded: a filter would be pushed below, and repeat the statistics' expressions.
    return stats.select(F.explode(F.when(~base_failed() & rules.column(), F.array("doc_id"))).alias("kept")).select("kept.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learned(docs, table(spark, sf_dir, "labels")))
