"""Summaries kept up to date from a stream: batches, repeated batches, batches broken off."""

import json
import os

import pytest
from pyspark.sql import functions as F

from matchlens.operators import games, summary
from matchlens.sources import logs
from matchlens.sources.schema import DIMENSIONS
from matchlens.streaming import summaries

CONFIG = "Timer_15__ActInterval_0.1__Round_BestOf3__SkillLeft_Boost__SkillRight_Stone"


def write(root, matchup, k):
    folder = root / matchup / CONFIG
    folder.mkdir(parents=True, exist_ok=True)
    events = [{"StartedAt": float(i), "UpdatedAt": i + 0.5, "Actor": "Left" if i % 2 else "Right", "Category": "Action" if i % 3 else "Collision", "State": str(i % 3), "Data": {"Name": "Dash", "IsActor": True}} for i in range(4 + k)]
    (folder / f"game_{k}.json").write_text(json.dumps({"Index": k, "Winner": "Left" if k % 2 else "Right", "Rounds": [{"Index": 0, "PlayerEvents": events}]}))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture()
def root(tmp_path):
    for m in ("A_vs_B", "B_vs_A"):
        for k in range(3):
            write(tmp_path / "logs", m, k)
    return tmp_path / "logs"


def whole(spark, root):
    events = logs.flatten_games(logs.read_games(spark, str(root)))
    return rows(summary.matchup_summary(games.game_metrics(events, dimensions=DIMENSIONS)))


def run(spark, root, tmp_path, name, max_files):
    summaries.summarise_available(spark, str(root), str(tmp_path / name), str(tmp_path / f"{name}-check"), max_files).awaitTermination()
    return rows(summaries.current(spark, str(tmp_path / name)))


def test_batches_equal_one(spark, root, tmp_path):
    want = whole(spark, root)
    assert run(spark, root, tmp_path, "one", 100) == want and summaries.versions(spark, str(tmp_path / "one")) == [0]
    assert run(spark, root, tmp_path, "three", 2) == want and summaries.versions(spark, str(tmp_path / "three"))[-1] == 2
    write(root, "A_vs_B", 7)
    assert run(spark, root, tmp_path, "three", 2) == whole(spark, root) != want


def test_a_repeated_batch_changes_nothing(spark, root, tmp_path):
    want = run(spark, root, tmp_path, "t", 2)
    last = summaries.versions(spark, str(tmp_path / "t"))[-1]
    os.remove(tmp_path / "t-check" / "commits" / str(last))  # as if the run had ended between merge and commit
    for f in (tmp_path / "t-check" / "commits").glob(f".{last}.crc"):
        os.remove(f)
    assert run(spark, root, tmp_path, "t", 2) == want
    events = logs.flatten_games(logs.read_games(spark, str(root)))
    assert summaries.merge(events, last, str(tmp_path / "t")) is False and rows(summaries.current(spark, str(tmp_path / "t"))) == want


def test_a_version_broken_off_is_merged_again(spark, root, tmp_path):
    table = str(tmp_path / "t")
    events = logs.flatten_games(logs.read_games(spark, str(root))).cache()
    summaries.merge(events.where("matchup = 'A_vs_B'"), 0, table)
    later = events.where("matchup = 'B_vs_A'")
    summaries.merge(later, 1, table)
    os.remove(f"{table}/batch=1/_SUCCESS")  # not committed
    assert summaries.versions(spark, table) == [0]
    assert summaries.merge(later, 1, table) and rows(summaries.current(spark, table)) == whole(spark, root)
    with pytest.raises(FileNotFoundError):
        summaries.current(spark, str(tmp_path / "none"))


def test_a_batch_is_read_once(spark, root, tmp_path):
    """However many passes the metrics take; and what was written for them is gone."""
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    events = logs.flatten_games(logs.read_games(spark, str(root)))
    once = events.withColumn("StartedAt", F.udf(counted, "double")("StartedAt"))
    assert summaries.merge(once, 0, str(tmp_path / "t")) and read.value == events.count()
    assert rows(summaries.current(spark, str(tmp_path / "t"))) == whole(spark, root) and os.listdir(tmp_path / "t") == ["batch=0"]


def test_parts_of_documents(spark, root):
    """Each event column is the same where only what it is made of is taken from the documents."""
    events = logs.flatten_games(logs.read_games(spark, str(root)))
    for columns in (["ColBotPosX", "EnemyBotIsDashActive", "Reason"], ["GameTimestamp", "RoundWinner"], list(games.MEASURED), []):
        documents = spark.read.schema(logs.game_type(columns)).option("multiLine", True).option("recursiveFileLookup", True).json(str(root))
        some = logs.flatten_games(documents, columns)
        assert set(some.columns) == {*columns, "round_pos", "event_pos"} and rows(some) == rows(events.select(some.columns))
