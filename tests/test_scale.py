"""Quantiles, ranks, densities and roll-ups that keep their results however rows are spread."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.functions import quantiles, stats
from matchlens.operators import games, ranks, spans, summary, timebins
from matchlens.plans import arena, bindings, reports
from matchlens.sources import logs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bins,most", [(1024, 10_000), (4, 5), (16, 1)])
def test_exact_quantiles(spark, bins, most):
    """Ties, wide ranges, infinities, nulls, NaN, a null group, a group of one value."""
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.choice([0, 5, -5])) for _ in range(300)] + [("b", float(rng.choice([1, 2, 2, 2, 7]))) for _ in range(101)]
    rows += [(None, 2.0**k * rng.choice([1, -1])) for k in range(-1000, 1000, 37)] + [("c", 5.0), ("d", None), ("d", float("nan")), ("e", float("inf")), ("e", 1.0), ("e", -float("inf"))]
    df = quantiles.kept(spark.createDataFrame(rows, "g string, v double").withColumn("_n", F.lit(0)), "v", ["g"])
    got = {r.g: (r.low, r.mid, r.high) for r in quantiles.exact(df, "v", {"low": 0.05, "mid": 0.5, "high": 1.0}, ["g"], bins, most).collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    for g in ("a", "b", "c", None):
        want = np.quantile([v for k, v in rows if k == g], [0.05, 0.5, 1.0])
        assert np.allclose(got[g], want, rtol=1e-12), g
    assert got["e"][1:] == (1.0, math.inf)
    whole = quantiles.exact(df.where("g = 'b'"), "v", {"m": 0.5}, (), bins, most).collect()
    assert [r.m for r in whole] == [2.0]
    assert quantiles.exact(df.where("g = 'd'"), "v", {"m": 0.5}).count() == 0


def test_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0), ("z", None)], "g string, v double")
    got = {r.g: (r.n, r["mean"], r["median"], r["std"]) for r in stats.describe(df, "v", ["g"]).collect()}
    assert got == {"a": (2, 2.5, 2.5, 1.5), None: (1, 2.0, 2.0, 0.0), "z": (0, None, None, None)}
    assert "percentile" not in plan(stats.describe(df, "v", ["g"])) and "median" not in plan(stats.describe(df, "v")).replace("median#", "")


def test_densities_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = [("a", *rng.normal(0, 1, 2)) for _ in range(60)] + [(None, *(rng.normal(0, 0.2, 2) @ [[1, 0.7], [0, 0.5]] + 3)) for _ in range(40)] + [("one", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("a", None, 1.0)]
    df = spark.createDataFrame([(g, None if x is None else float(x), float(y)) for g, x, y in points], "g string, x double, y double")
    out = stats.kde2d(df, "x", "y", 4.0, 21, ["g"])
    assert "Python" not in plan(out) and "Pandas" not in plan(out)
    rows = out.collect()
    assert {r.g for r in rows} == {"a", None} and len(rows) == 2 * 441
    for g in ("a", None):
        p = np.array([(x, y) for k, x, y in points if k == g and x is not None])
        cov = np.cov(p.T) * len(p) ** (-1 / 3)
        inverse, det = np.linalg.inv(cov), np.linalg.det(cov)
        for r in rows:
            if r.g == g:
                d = np.array([r.x, r.y]) - p
                want = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inverse, d)).sum() / (len(p) * 2 * math.pi * math.sqrt(det))
                assert want - 1e-12 / (2 * math.pi * math.sqrt(det)) - 1e-13 <= r.density <= want + 1e-12
    one = stats.kde1d(df, "y", 50, ["g"])
    assert "Python" not in plan(one)
    for r in one.collect():
        v = np.array([y for k, x, y in points if k == r.g])
        h = v.std(ddof=1) * len(v) ** -0.2
        assert abs(r.density - np.exp(-0.5 * ((r.x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))) < 1e-11


@pytest.mark.parametrize("count,different", [(3000, 3000), (3000, 40), (1_000_000, 3)])
def test_ranks_of_ties(spark, count, different):
    df = spark.range(count).select("id", F.when(F.col("id") % 50 != 7, F.pmod(F.hash("id"), F.lit(different)) / 7.0).alias("w"))
    out = summary.average_rank(df, "w")
    windows = re.findall(r"windowspecdefinition\((\w+)", plan(out))
    assert windows and set(windows) == {"_range"}
    rows = out.toPandas()
    known = rows[rows.w.notna()]
    want = np.floor(known.w.rank(ascending=False, method="average"))
    assert (known.Rank.astype(float) == want).all() and rows[rows.w.isna()].Rank.isna().all() and len(rows) == count


def test_ranges_of_any_distribution(spark):
    rng = random.Random(3)
    values = [10.0 ** rng.uniform(-300, 300) for _ in range(2000)] + [0.0, -0.0, float("inf"), -float("inf"), -5.0]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    got = {r._value: r._before for r in ranks.tied(df, F.col("v"), ranges=16).collect()}
    order = sorted(values)
    assert all(got[x] == sum(y < x for y in order) for x in set(values))


def test_order_as_a_column(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", None), ("d", 1)], "Bot_L string, Rank_L int")
    assert sorted((r.place, r.Bot) for r in reports.ordered_domain(df).collect()) == [(1, "d"), (2, "a"), (3, "b"), (4, "c")]


def test_labels_are_clipped(spark):
    """A matrix of over 40 settings keeps the first 40 labels by name on each side."""
    rows = [(0.5, float(t), 0.1, f"BestOf{t}", "Boost", "Stone") for t in range(60)]
    df = spark.createDataFrame(rows, "WinRate_L double, Timer double, ActInterval double, Round string, SkillLeft string, SkillRight string")
    out = reports.config_cross(df, max_labels=40).toPandas()
    labels = sorted({f"{n}={v}" for n, vs in (("Timer", [f"{float(t)}" for t in range(60)]), ("ActInterval", ["0.1"]), ("Round", [f"BestOf{t}" for t in range(60)]), ("SkillLeft", ["Boost"]), ("SkillRight", ["Stone"])) for v in vs})[:40]
    assert set(out.X) == set(labels) == set(out.Y)


def test_parts_of_games_can_be_added(spark):
    games = spark.createDataFrame([(f"B{i % 3}", f"B{(i + 1) % 3}", i % 3, float(i), 0.5 * i, i) for i in range(30)], "Bot_L string, Bot_R string, Winner long, MatchDur double, Duration_L double, TotalActions long")
    keys = ["Bot_L", "Bot_R"]
    whole = summary.matchup_parts(games, keys)
    halves = summary.matchup_parts(games.where("TotalActions < 11"), keys).unionByName(summary.matchup_parts(games.where("TotalActions >= 11"), keys))
    assert sorted(summary.finished(summary.added(halves, keys)).collect()) == sorted(summary.finished(whole).collect())


def test_reports_read_their_tables_once(spark):
    """Each report's plan has one scan of the written roll-up a branch at most, and none of the tables."""
    sf = "/root/testdata/sf0.001"
    rows = bindings.matchups(spark, sf, ranks=False)
    for out in (summary.competitor_stats(rows, ranks=False), reports.correlations(reports.correlation_rows(rows), ["Timer", "Duration"]), reports.winrate_by(rows), reports.grouped_error(rows.withColumns({"Rank_L": F.lit(1), "Rank_R": F.lit(1)}))):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") == 1, text


def test_one_game_with_most_events(spark):
    """A game with nine tenths of all events, at clustered times with ties: equal metrics, and no task with more than its share."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        t = rng.choice([rng.random() * 60, float(rng.randrange(60)), 30 + rng.random() / 100])
        rows.append(("f" if i % 10 else None, 1 if i % 10 else i % 70, i % 3, t - rng.random() if i % 7 else None, t if i % 97 else None, rng.randrange(2), "Action" if i % 4 else "Collision", rng.choice("012"), rng.choice(["Dash", "TurnLeft", None]), i % 2, i % 3 % 2, 0, i))
    names = "source_file string, GameIndex long, GameWinner long, StartedAt double, UpdatedAt double, Actor long, Category string, State string, Name string, ColActor long, ColTieBreaker long, round_pos int, event_pos int"
    events = spark.createDataFrame(rows, names).repartition(4).cache()
    exact = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.withColumn("source_file", F.coalesce("source_file", F.lit(""))).collect())
    whole = exact(games.game_metrics(events, most=None).fillna(-1))
    for most in (50, 1000, 10_000):
        assert exact(games.game_metrics(events, most=most).fillna(-1)) == whole
    ranges = spans.sliced(events, ["source_file", "GameIndex"], most=500).where("source_file = 'f'").groupBy("_slice").agg(F.count("*").alias("n"), F.min("UpdatedAt").alias("a"), F.max("UpdatedAt").alias("b")).orderBy("_slice").collect()
    assert len(ranges) >= 5 and sum(r.n for r in ranges) == 5400
    assert all(x.b < y.a for x, y in zip(ranges, ranges[1:]))
    small = spans.sliced(events, ["source_file", "GameIndex"], most=500).where("source_file is null")
    assert small.where("_slice is not null").count() == 0


def test_large_games_are_not_joined_in_one_task(spark):
    """Where tables are too large to be sent by their size, ranges are still found and handed on without a join that meets a game's events in one task."""
    events = spark.range(3000).selectExpr("if(id % 10 > 0, 0, id) as GameIndex", "0L as GameWinner", "id / 7 as UpdatedAt", "id / 9 as StartedAt", "id % 2 as Actor", "if(id % 5 = 0, 'Collision', 'Action') as Category", "string(id % 3) as State", "string(id % 4) as Name", "0L as ColActor", "0L as ColTieBreaker", "int(id) as event_pos")
    whole = sorted(games.with_actual_duration(events, ["GameIndex"], most=None).collect())
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = games.with_actual_duration(events, ["GameIndex"], most=100)
        assert "SortMergeJoin" not in plan(out) and out.columns == [*events.columns, "ActualDuration"]
        assert sorted(out.collect()) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_bins_shuffle_counts_only(spark):
    events = bindings.telemetry(spark, "/root/testdata/sf0.001")
    text = plan(timebins.action_fragments(events, 5.0, ["GameIndex"]))
    assert "Window" not in text


def test_all_levels_in_one_pass(spark):
    """Levels, time windows named by what is skipped, a side, some configurations only."""
    rng = random.Random(6)
    rows = [("f", i % 4, i * 0.1, a, rng.gauss(0, 1), rng.gauss(0, 1), 15.0 if i % 4 < 2 else None, "LR"[a], "XY"[a], "X_vs_Y", f"Timer_{i % 3}") for i in range(800) for a in (0, 1)]
    df = spark.createDataFrame(rows, "source_file string, GameIndex long, UpdatedAt double, Actor long, BotPosX double, BotPosY double, Timer double, Side string, Bot string, matchup string, config string")
    out = arena.all_modes(df, skip=2.0, side="left", max_configs=2, cells=10, points=20)
    assert set(out) == {"heatmap", "marginal", "over_time", "position", "distance"}
    levels = {(r.Bot, r.level, r.part) for r in out["heatmap"].select("Bot", "level", "part").distinct().collect()}
    assert levels == {("X", "all", ""), ("X", "timer", "15"), ("X", "phase", "0"), ("X", "phase", "1"), ("X", "phase", "2"), ("X", "window", "2.0-15s"), ("X", "window", "15-30s"), ("X", "window", "30-45s"), ("X", "window", "45-60s")}
    assert {r.Bot for r in out["over_time"].select("Bot").distinct().collect()} == {"X", "Y"} == {r.Bot for r in out["distance"].select("Bot").distinct().collect()}
    kept = df.where("config <> 'Timer_2'")
    first = {r.GameIndex: r.m for r in kept.groupBy("GameIndex").agg(F.min("UpdatedAt").alias("m")).collect()}
    assert out["position"].where("axis = 'X'").agg(F.sum("count")).first()[0] == sum(r.Side == "L" and r.UpdatedAt >= first[r.GameIndex] + 2 for r in kept.collect())
    assert set(arena.all_modes(df, "position")) == {"position"} and "over_time" not in arena.all_modes(df, "heatmap", levels=["phase"])
    for bad in ({"mode": "x"}, {"side": "up"}, {"levels": ["x"]}):
        with pytest.raises(ValueError):
            arena.all_modes(df, **bad)


def test_union_in_the_widest_types(spark):
    a, b = spark.sql("select 1 as x, 'a' as y"), spark.sql("select 5 as y, 2.5d as x")
    out = logs.union_widened([a, b, spark.sql("select null as y, cast(7 as bigint) as x")])
    assert dict(out.dtypes) == {"x": "double", "y": "string"} and sorted(map(repr, out.collect())) == sorted(["Row(x=1.0, y='a')", "Row(x=2.5, y='5')", "Row(x=7.0, y=None)"])
    for other in ("select 1 as x", "select true as x, 'a' as y", "select array(1) as x, 'a' as y"):
        with pytest.raises(ValueError):
            logs.union_widened([a, spark.sql(other)])


def test_competitors_are_ranked_by_the_means_they_show(spark):
    """Also where adding up again gives other last digits, as it does when executors' parts come in another order."""
    noise = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    rows = [(f"B{i % 9}", f"B{(i + 1) % 9}", 10, i % 9 / 10, i % 7 / 10, 1.0, 1.0, 1, 1, 1, 1, 1) for i in range(63)]
    names = "Bot_L string, Bot_R string, Games long, WinRate_L double, WinRate_R double, Duration_L double, Duration_R double, ActionCounts_L long, ActionCounts_R long, Collisions_L long, Collisions_R long, Collisions_Tie long"
    matchups = spark.createDataFrame(rows, names).withColumn("WinRate_L", noise("WinRate_L"))
    got = summary.competitor_stats(matchups).orderBy(F.desc("WinRate_mean")).collect()
    assert [r.Rank for r in got] == list(range(1, 10))


def test_a_value_is_compared_with_few_borders(spark):
    """With the borders of one block, not all of them; nor are the ranges before a row's summed for each row."""
    plan = ranks.tied(spark.range(10), F.col("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(_borders" in plan and re.search(r"Join Inner, \(_range#\d+ = _r#\d+\)", plan)
