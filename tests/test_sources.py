"""Event tables read back, files of both formats, keys that no schema knows, loads that are broken off."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from matchlens.functions import scalars as S
from matchlens.operators import games, spans
from matchlens.plans import nested
from matchlens.sources import freeform, loads, logs
from matchlens.sources.schema import DIMENSIONS, EVENTS

CONFIGS = [f"Timer_{t}__ActInterval_0.1__Round_BestOf3__SkillLeft_Boost__SkillRight_Stone" for t in (15, 30)]


def game(index, n=3, **more):
    robot = {"Position": {"X": 1 / 3, "Y": 2.0}, "Rotation": 1.5, "IsDashActive": True}
    events = [{"StartedAt": 0.1 * i, "UpdatedAt": 0.1 * i + i, "Actor": "Left" if i % 2 else "Right", "Category": "Action", "State": "0", "Data": {"Name": "Dash", "Robot": robot, "Reason": 'a "b", c', **more}} for i in range(n)]
    return {"Index": index, "Timestamp": "t", "Winner": "Left", "Rounds": [{"Index": 0, "Winner": "Draw", "PlayerEvents": events}]}


@pytest.fixture()
def root(tmp_path):
    """Three matchups, two configurations, games of equal index in different files; a name with a blank and a plus."""
    for m in ("Bot A+_vs_B", "B_vs_Bot A+", "B_vs_C"):
        for c in CONFIGS:
            folder = tmp_path / "logs" / m / c
            folder.mkdir(parents=True)
            for k in (2, 10):
                (folder / f"game_{k}.json").write_text(json.dumps(game(0, k)))
    return str(tmp_path / "logs")


def metrics(events):
    out = games.game_metrics(events, dimensions=DIMENSIONS).drop("_x")
    return sorted(map(repr, out.collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_event_table_reads_back(spark, root, tmp_path, fmt):
    events = logs.flatten_games(logs.read_games(spark, root))
    assert events.select("source_file", "GameIndex").distinct().count() == 12 and {r.Bot_L for r in events.select("Bot_L").distinct().collect()} == {"Bot A+", "B"}
    logs.write_events(events.coalesce(1), str(tmp_path / "out"), fmt)
    back = logs.read_events(spark, str(tmp_path / "out"), fmt)
    assert back.exceptAll(events.select(*back.columns)).count() == 0 and back.count() == events.count()
    assert metrics(back) == metrics(events) and len(metrics(back)) == 12
    one = logs.read_events(spark, str(tmp_path / "out" / "matchup=B_vs_C"), fmt, base=str(tmp_path / "out"))
    assert one.count() == 24 and one.select("Bot_R", "Timer").distinct().count() == 2


def test_one_competitor_reads_its_folders_only(spark, root, tmp_path):
    logs.write_events(logs.flatten_games(logs.read_games(spark, root)), str(tmp_path / "out"))
    events = logs.read_events(spark, str(tmp_path / "out"), "parquet")
    mine = logs.competitor_positions(events, "C")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "matchup" in scan.split("PartitionFilters: [")[1].split("]")[0] and "Bot_R" not in scan
    assert "EnemyBotPosX" not in scan.split("ReadSchema")[1]
    assert {r.Side for r in mine.collect()} == {"R"} and mine.count() == 12
    assert logs.competitor_positions(events, "B", "left", max_configs=1).select("Timer").distinct().collect()[0].Timer == 15.0
    assert logs.matchup_positions(events, "C", "B").count() == 24 and logs.matchup_positions(events, max_configs=1).count() == 36


def test_ten_digits_in_csv(spark, root, tmp_path):
    events = logs.flatten_games(logs.read_games(spark, root))
    logs.write_events(events, str(tmp_path / "out"), "csv", ten_digits=True)
    back = logs.read_events(spark, str(tmp_path / "out"), "csv")
    assert {r.BotPosX for r in back.select("BotPosX").collect()} == {0.3333333333}
    assert back.where("Reason = 'a \"b\", c'").count() == events.count()


def test_ten_digits(spark):
    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1e10, 9999999999.0, 99999999995.0, 1e-4, 1e-5, 1.5e-7, 1 / 3, -2 / 3, 1e300, float("nan"), float("inf"), -float("inf"), 120.0, 123456.7891234]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(S.ten_digits(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{x:.10g}" for x in numbers]
    assert spark.range(1).select(S.ten_digits(F.lit(None).cast("double"))).first()[0] is None


def test_discovery_of_both_formats(spark, tmp_path):
    """A file a configuration, Parquet before CSV; also a mixed table."""
    row = spark.createDataFrame([tuple(1 if t in ("bigint",) else 0.5 if t == "double" else "x" for _, t in [(f.name, f.dataType.simpleString()) for f in EVENTS])], EVENTS).coalesce(1)
    place = lambda m, c, ext: str(tmp_path / "in" / m / c / f"events.{ext}")
    row.withColumn("Name", F.lit("p")).write.parquet(place("A_vs_B", CONFIGS[0], "parquet"))
    row.withColumn("Name", F.lit("c")).write.option("header", True).csv(place("A_vs_B", CONFIGS[0], "csv"))
    flat = tmp_path / "flat"
    for m, c, ext in (("A_vs_B", CONFIGS[0], "parquet"), ("A_vs_B", CONFIGS[0], "csv"), ("A_vs_B", CONFIGS[1], "csv")):
        folder = flat / m / c
        folder.mkdir(parents=True, exist_ok=True)
        source = next((tmp_path / "in" / "A_vs_B" / CONFIGS[0] / f"events.{ext}").glob(f"part*.{ext}"))
        (folder / f"log.{ext}").write_bytes(source.read_bytes())
    names = lambda fmt: sorted(r.Name + str(r.Timer) for r in loads.read_discovered(spark, str(flat), fmt).collect())
    assert names("auto") == ["c30.0", "p15.0"] and names("csv") == ["c15.0", "c30.0"] and names("parquet") == ["p15.0"]
    with pytest.raises(ValueError):
        loads.discovered(spark, str(flat), "orc")


def test_files_in_natural_order(spark, root):
    assert {r.source_file for r in loads.listed(spark, root).collect()} == {r.source_file for r in logs.read_games(spark, root).collect()}
    files = [r.source_file.rpartition("/")[2] for r in loads.listed(spark, root).where("matchup = 'B_vs_C'").orderBy("config", "file_index").collect()]
    assert files == ["game_2.json", "game_10.json"] * 2


def test_unseen_keys_become_columns(spark, tmp_path):
    folder = tmp_path / "A_vs_B" / CONFIGS[0]
    folder.mkdir(parents=True)
    extra = game(0, 2, Zone={"x": [1, 2]}, name="clash")
    extra["Rounds"][0]["PlayerEvents"][1]["Heat"] = 1.5
    extra["Rounds"][0]["PlayerEvents"][1]["Data"]["Zone"] = None
    (folder / "game_0.json").write_text(json.dumps(extra, indent=1))
    (folder / "game_1.json").write_text(json.dumps(game(1, 1)))
    (folder / "game_2.json").write_text("not json")
    (folder / "game_3.json").write_text(json.dumps({"Index": 3, "Rounds": [{"Index": 0, "PlayerEvents": [{"Category": "Action"}, {"Category": "LastPosition", "Late": 1}]}, {"Index": 1}]}))
    texts = freeform.read_texts(spark, str(tmp_path))
    assert freeform.unseen_keys(texts) == [("$", "Heat"), ("$.Data", "Zone"), ("$.Data", "name")]
    out = freeform.flatten_all(texts)
    assert [c for c in out.columns if c in EVENTS.names] == EVENTS.names and set(out.columns) >= {"Heat", "Zone", "name_"}
    got = sorted((r.GameIndex, r.event_pos, r.Heat, r.Zone, r.name_, r.Bot_L) for r in out.collect())
    assert got == [(1, 0, None, '{"x":[1,2]}', "clash", "A"), (1, 1, "1.5", None, "clash", "A"), (2, 0, None, None, None, "A"), (4, 0, None, None, None, "A")]
    known = logs.flatten_games(logs.read_games(spark, str(tmp_path)))
    same = [*EVENTS.names, "source_file", "round_pos", "event_pos", *DIMENSIONS]
    assert out.select(*same).exceptAll(known.select(*same)).count() == 0


def test_a_load_broken_off_counts_once(spark, root, tmp_path):
    into = str(tmp_path / "table")
    assert loads.loaded_events(spark, into).count() == 0
    name, files = loads.staged(spark, root, into, max_files=5)
    loads.commit(into, files)
    assert files.count() == 5 and loads.loaded_events(spark, into).select("source_file").distinct().count() == 5
    lost, _ = loads.staged(spark, root, into, max_files=4)  # killed before its commit
    assert loads.loaded_events(spark, into).select("source_file").distinct().count() == 5
    assert loads.load(spark, root, into, max_files=4) == 2 and loads.load(spark, root, into) == 0
    assert loads.cleaned(spark, into) == 1 and lost not in loads.committed(spark, into) and name in loads.committed(spark, into)
    events, want = loads.loaded_events(spark, into), logs.flatten_games(logs.read_games(spark, root))
    assert events.exceptAll(want.select(*events.columns)).count() == 0 and events.count() == want.count()
    assert loads.manifest(spark, into).count() == 12 and metrics(events) == metrics(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_logs_of_whole_tables_take_little_disk(spark):
    """Files are compressed, and what is exchanged before are lines, not the events made of them."""
    root = nested._written(spark, "/root/testdata/sf0.01")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if not f.startswith("."))
    assert size < 100 * spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    plan = nested.game_logs(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "PlayerEvents" in plan.split("RebalancePartitions")[0] and "PlayerEvents" not in plan.split("RebalancePartitions")[1]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_arranged_events_are_written_as_they_lie(spark, root, tmp_path, fmt):
    events = logs.flatten_games(logs.read_games(spark, root))
    logs.write_events(events, str(tmp_path / "out"), fmt, arranged=True)
    back = logs.read_events(spark, str(tmp_path / "out"), fmt)
    assert back.exceptAll(events.select(*back.columns)).count() == 0 and back.count() == events.count()


def test_compressed_lines_are_read(spark, tmp_path):
    folder = tmp_path / "A_vs_B" / CONFIGS[0]
    spark.createDataFrame([(json.dumps(game(i)),) for i in range(5)], "value string").write.text(str(folder))
    plain = logs.read_games(spark, str(tmp_path), lines=True, pattern="*.txt").count()
    spark.createDataFrame([(json.dumps(game(i)),) for i in range(5)], "value string").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "x"))
    (folder / "games.json.gz").write_bytes(next((tmp_path / "x").glob("*.gz")).read_bytes())
    assert plain == 5 and logs.read_games(spark, str(tmp_path), lines=True).count() == 5 and loads.listed(spark, str(tmp_path), logs.LINES).count() == 1


def test_large_games_are_sent_to_events_not_the_other_way(spark, tmp_path):
    """A table that is small as stored isn't sent to every task."""
    spark.range(5000).selectExpr("id % 3 as GameIndex", "cast(id as double) as UpdatedAt").write.parquet(str(tmp_path / "e"))
    plan = spans.sliced(spark.read.parquet(str(tmp_path / "e")), ["GameIndex"], most=500)._jdf.queryExecution().sparkPlan().toString()
    assert "Inner, BuildRight" in plan


def test_rounding_of_exact_values(spark):
    """Where the shortest decimal form is a tie, but the number isn't."""
    numbers = [12345.678905, 1234567890.5, 1234567891.5, 1.0000000005, 0.12345678905, 3.0000000015, -7.1234567885]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(S.ten_digits(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{x:.10g}" for x in numbers]
    assert spark.range(1).select(S.mean_std_label(F.lit(1.005), F.lit(0.125))).first()[0] == "1.0 (0.13)"


def test_names_of_configurations(spark):
    """Any name gives what taking it apart in plain Python does, once a row."""
    rng = random.Random(8)
    names = ["", "_", "__", "___", "Timer", "Timer_", "a__Timer_5__Timer_15"] + ["".join(rng.choice(["Timer", "Round", "_", "__", "1.5", "x"]) for _ in range(rng.randrange(9))) for _ in range(200)]

    def plain(name):
        return {p.partition("_")[0]: p.partition("_")[2] if "_" in p else "True" for p in name.split("__") if p}

    df = spark.createDataFrame([("A_vs_B", n) for n in [*names, None]], "matchup string, config string")
    got = df.select("config", S.config_map(F.col("config")).alias("m")).collect()
    assert all(r.m == (None if r.config is None else plain(r.config)) for r in got)
    out = logs.with_dimensions(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("map_from_arrays") == 1
    assert {r.config: r.Round for r in out.collect()} == {n: None if n is None else plain(n).get("Round") for n in [*names, None]}


def test_folder_names_are_taken_apart_once_a_game(spark):
    """By the metrics of an event table; not for each event, nor for each dimension."""
    text = nested.event_table_parquet(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("map_from_arrays") == 1 and text.index("map_from_arrays") < text.index("Aggregate")


def test_csv_is_parsed_once(spark):
    """An event table of CSV files is read by one pass, which writes what the metrics read in several."""
    files = nested.event_table_csv(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if ".csv" in f]


def test_documents_are_parsed_once(spark, tmp_path):
    """Where unseen keys are not given, too; and only for the event columns that are asked for."""
    folder = tmp_path / "A_vs_B" / CONFIGS[0]
    folder.mkdir(parents=True)
    (folder / "games.json").write_text("\n".join(json.dumps(game(k, 3, Heat=None if k % 2 else {"z": k}, **{"it's": k})) for k in range(6)))
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    texts = freeform.read_texts(spark, str(tmp_path), lines=True)
    out = freeform.flatten_all(texts.withColumn("json", F.udf(counted, "string")("json")))
    got = out.collect()
    assert read.value == 6 and len(got) == 18 and {r.Heat for r in got} == {None, '{"z":0}', '{"z":2}', '{"z":4}'} and {r["it's"] for r in got} == set("012345")
    want = freeform.flatten_all(texts, [("$.Data", "Heat"), ("$.Data", "it's")])
    assert want.columns == out.columns and sorted(map(repr, want.collect())) == sorted(map(repr, got))
    few = freeform.flatten_all(texts.select("json"), columns=["Category", "BotPosX"])
    assert few.columns == ["Category", "BotPosX", "round_pos", "event_pos", "Heat", "it's"]
    assert sorted(map(repr, few.collect())) == sorted(map(repr, out.select(few.columns).collect()))
