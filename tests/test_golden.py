"""Hand-made games: flattening, metrics, bins, formats, streaming, ranks and distances."""

import json

import pytest
from pyspark.sql import functions as F

from matchlens.functions import scalars as S
from matchlens.functions import stats
from matchlens.operators import games, spatial, summary, timebins
from matchlens.plans import reports
from matchlens.sources import loads, logs
from matchlens.sources.schema import DIMENSIONS, EVENTS
from matchlens.streaming.games import ingest_available

CONFIG = "Timer_15__ActInterval_0.1__Round_BestOf3__SkillLeft_Boost__SkillRight_Stone"
ROWS = [
    (0.0, 0.0, "Left", "Action", 0, "Accelerate", None, None), (0.0, 1.5, "Left", "Action", 2, "Accelerate", None, None), (2.0, 2.0, "Left", "Action", 0, "Dash", None, None),
    (2.0, 2.6, "Left", "Action", 2, "Dash", None, None), (1.0, 1.0, "Right", "Action", 0, "TurnLeft", None, None), (1.0, 5.0, "Right", "Action", 2, "TurnLeft", None, None),
    (6.0, 6.0, "Right", "Action", 0, "Accelerate", None, None), (5.2, 5.2, "Left", "Collision", 0, None, True, False), (4.0, 4.0, "Right", "Collision", 0, None, True, False),
    (9.0, 9.0, "Left", "Collision", 0, None, False, True), (12.0, 12.0, "Left", "LastPosition", 0, None, None, None),
]


def game(rows, index=0, winner="Left"):
    robot = {"Position": {"X": 3.24, "Y": 5.97}, "Rotation": 1.0, "IsDashActive": True}
    events = [{"StartedAt": s, "UpdatedAt": u, "Actor": a, "Target": "", "Category": c, "State": k, "Data": {"Name": n, "Reason": "None", "Robot": robot, "IsActor": x, "IsTieBreaker": t}} for s, u, a, c, k, n, x, t in rows]
    return {"Index": index, "Timestamp": "t", "Winner": winner, "Rounds": [{"Index": 0, "Winner": "Draw", "PlayerEvents": events}]}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    for matchup, k, rows, winner in (("Bot_A_vs_Bot_B", 0, ROWS, "Left"), ("Bot_B_vs_Bot_A", 0, ROWS[7:], "Draw"), ("Bot_A_vs_Bot_B", 1, ROWS[:2], "Right")):
        folder = top / matchup / CONFIG
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"game_{k}.json").write_text(json.dumps(game(rows, k, winner)))
    return str(top)


@pytest.fixture(scope="module")
def events(spark, root):
    return logs.flatten_games(logs.read_games(spark, root)).cache()


def metrics(events):
    return games.game_metrics(events, dimensions=DIMENSIONS)


def test_flatten(events):
    assert [c for c in events.columns if c in EVENTS.names] == EVENTS.names and events.count() == 15
    first = events.where("GameIndex = 1 and Bot_L = 'Bot_A'").orderBy("event_pos").collect()
    assert len(first) == 10
    r = first[0]
    assert (r.GameWinner, r.RoundWinner, r.Actor, r.Target, r.Reason, r.BotPosX, r.BotIsDashActive, r.BotIsSkillActive, r.ColBotPosX, r.ColActor) == (0, 2, 0, None, None, 3.24, 1, 0, None, None)
    assert (r.Timer, r.ActInterval, r.Round, r.SkillLeft, r.SkillRight, r.Bot_R) == (15.0, 0.1, "BestOf3", "Boost", "Stone", "Bot_B")
    assert (first[7].ColBotPosX, first[7].ColActor, first[7].ColTieBreaker, first[7].EnemyBotPosX) == (3.24, 1, 0, None)


def test_game_metrics(events):
    r = metrics(events).where("GameIndex = 1 and Bot_L = 'Bot_A'").first()
    assert (r.Winner, r.MatchDur, r.ActionCounts_L, r.ActionCounts_R, r.TotalActions) == (0, 9.0, 2, 2, 4)
    assert [round(x, 9) for x in (r.Duration_L, r.Duration_R, r.Accelerate_Dur_L, r.Dash_Dur_L, r.TurnLeft_Dur_R, r.Dash_Dur_R)] == [2.1, 4.0, 1.5, 0.6, 4.0, 0.0]
    assert (r.Collisions_L, r.Collisions_R, r.Collisions_Tie) == (1, 1, 1)
    none = metrics(events).where("Bot_L = 'Bot_B'").first()
    assert none.ActionCounts_L is None and none.Duration_R is None and none.TotalActions is None and none.Collisions_Tie == 1


def test_one_exchange(events):
    plan = games.game_metrics(events, dimensions=DIMENSIONS, most=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bins(events):
    rows = timebins.action_fragments(events.where("GameIndex = 1"), 5.0).collect()
    assert sorted((r.Actor, r.TimeBin, r.Action, r.Count) for r in rows) == [(0, 0.0, "Accelerate", 1), (0, 0.0, "Dash", 1), (0, 5.0, "Accelerate", 0), (0, 5.0, "Dash", 0), (1, 0.0, "Accelerate", 0), (1, 0.0, "TurnLeft", 1), (1, 5.0, "Accelerate", 1), (1, 5.0, "TurnLeft", 0)]
    one = events.where("GameIndex = 1 and Bot_L = 'Bot_A'")
    got = lambda **o: sorted((r.TimeBin, r.Actor_L, r.Actor_R, r.Tie) for r in timebins.collision_fragments(one, 5.0, **o).collect())
    assert got() == [(0.0, 0, 1, 0), (5.0, 1, 0, 1)] and got(legacy_side_labels=True) == [(0.0, 1, 0, 0), (5.0, 0, 1, 1)]


def test_summaries(events):
    m = summary.matchup_summary(metrics(events))
    r = m.where("Bot_L = 'Bot_A'").first()
    assert (r.Games, r.Winner_L, r.Winner_R, r.WinRate_L, r.TotalActions) == (2, 1, 1, 0.5, 5)
    draw = m.where("Bot_L = 'Bot_B'").first()
    assert (draw.Winner_L, draw.Winner_R, draw.TotalActions) == (0, 0, 0)
    out = summary.competitor_summary(m).collect()
    assert [r["Win-rate"] for r in out] == ["0.25 (0.35)", "0.25 (0.35)"] and [r.Rank for r in out] == [1, 1]
    assert summary.competitor_summary(m.where("Bot_L = 'Bot_A'")).first()["Win-rate"] is None


def test_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 0.5, 0.5, 0.5, 0.1, 0.1, None)], "w double")
    assert sorted((r.Rank or 99) for r in summary.average_rank(df, "w").collect()) == [1, 3, 3, 3, 5, 5, 99]


def test_csv_and_parquet_agree(spark, events, tmp_path):
    for fmt in ("csv", "parquet"):
        logs.write_events(events.select(*EVENTS.names, "matchup", "config"), str(tmp_path / fmt), fmt)
    a, b = (logs.read_events(spark, str(tmp_path / f), f).select(*EVENTS.names) for f in ("csv", "parquet"))
    assert a.exceptAll(b).count() == 0 and a.count() == 15
    with pytest.raises(ValueError):
        logs.read_events(spark, "x.orc")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text(",".join(EVENTS.names) + "\n" + "what," * (len(EVENTS.names) - 1) + "x\n")
    assert logs.read_events(spark, str(tmp_path / "bad"), "csv", lenient=True).select("GameIndex", "Name").first() == (None, "what")


def test_stream_takes_each_game_once(spark, root, tmp_path):
    for _ in range(2):
        ingest_available(spark, root, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_files_and_manifest(spark):
    files = spark.createDataFrame([("m", "c", "a.csv"), ("m", "c", "b.parquet"), ("m", "d", "c.csv")], "matchup string, config string, path string")
    assert sorted(r.path for r in loads.preferred_files(files).collect()) == ["b.parquet", "c.csv"]
    assert loads.pending(files, files.where("config = 'c'"), "path").count() == 1


def test_distances(spark):
    rows = [("f", 1, 0.0, 0, -1.0, 0.0), ("f", 1, 0.0, 1, 2.0, 4.0), ("f", 1, 1.0, 0, 3.24, 5.97), ("g", 1, 1.0, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "source_file string, GameIndex long, UpdatedAt double, Actor long, BotPosX double, BotPosY double")
    assert [r.Distance for r in spatial.pair_distance(df).collect()] == [5.0]
    assert spatial.center_distance(df.where("BotPosX > 3")).first().DistanceFromCenter == pytest.approx(5.0)
    assert sorted(r.phase for r in spatial.with_phase(df).collect()) == [0, 0, 0, 2]


def test_positions_by_competitor(events):
    assert {r.Bot for r in logs.competitor_positions(events).select("Bot").distinct().collect()} == {"Bot_A", "Bot_B"}
    left = logs.competitor_positions(events, "Bot_A", "left")
    assert {(r.Bot, r.Opponent, r.Side) for r in left.collect()} == {("Bot_A", "Bot_B", "L")}
    with pytest.raises(ValueError):
        logs.competitor_positions(events, side="up")


def test_scalars(spark):
    df = spark.createDataFrame([("Timer_60__A_1_2__Bare__A_3",)], "c string").select(S.config_map(F.col("c")).alias("m"), S.timer_of(F.col("c")).alias("t"), *[x.alias(n) for x, n in zip(S.matchup_sides(F.lit("a_vs_b_vs_c")), "lr")])
    r = df.first()
    assert r.m == {"Timer": "60", "A": "3", "Bare": "True"} and (r.t, r.l, r.r) == (60.0, "a_vs_b", "c")
    r = spark.range(1).select(S.safe_long(F.lit("2.7")).alias("a"), S.safe_flag(F.lit(None).cast("boolean")).alias("b"), S.mean_std_label(F.lit(0.5), F.lit(None).cast("double")).alias("c"), S.slug(F.lit("  A b--C ")).alias("d"), S.trailing_number(F.lit("x")).alias("e")).first()
    assert (r.b, r.c, r.d, r.e) == (0, None, "a-b-c", None)


def test_histograms(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 10)], "v double")
    assert {r.bin: r["count"] for r in stats.histogram(df, "v", 10).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 9: 1}
    assert [(r["count"], r.start, r.stop) for r in stats.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 2).collect()] == [(2, 2.0, 2.5)]
    assert stats.kde1d(df.limit(1), "v").count() == 0


def test_p_values(spark):
    assert stats.two_sided_p(0.5, 10) == pytest.approx(0.14111, abs=1e-5)
    assert stats.two_sided_p(0.0, 20) == pytest.approx(1.0) and stats.two_sided_p(1.0, 5) == 0.0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "x double, y double").agg(stats.pearson("x", "y").alias("r"), stats.line("x", "y")[0].alias("s")).first()
    assert flat.r is None and flat.s is None


def test_report_arguments(spark):
    bins = spark.createDataFrame([("a", 0.0, "Dash", 1.0)], "Bot string, TimeBin double, Action string, MeanCount double")
    for bad in ({"mode": "x"}, {"mode": "select"}):
        with pytest.raises(ValueError):
            reports.action_intensity(bins, **bad)
    with pytest.raises(ValueError):
        reports.collision_intensity(bins, "select", "x")
