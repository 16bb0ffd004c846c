"""orders and lineitem as nested game logs, written as files and read back: queries of the log and event-table sources.

An order is a game, the parity of a line's number its round, a line an event. Missing parts are there on purpose: events
without data, data without snapshots, snapshots without flags.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import games
from ..sources import freeform, loads, logs
from ..sources.schema import ACTIONS, DIMENSIONS, EVENT, EVENTS, SNAPSHOTS
from ..sources.shared import shared_folder, written
from ..streaming import summaries
from .bindings import table
from .registry import entry, rounded, rounded_sql

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_ROBOT = """named_struct('Position', named_struct('X', {x}, 'Y', {y}), 'LinearVelocity', l_discount, 'AngularVelocity', cast(null as double), 'Rotation', l_quantity,
  'IsDashActive', l_partkey % 2 = 1, 'IsSkillActive', cast(null as boolean), 'IsOutFromArena', l_linenumber > 5)"""
_NAME = f"element_at(array({', '.join(repr(a) for a in ACTIONS)}), cast(l_suppkey % 6 as int) + 1)"
_CATEGORY = "case when l_partkey % 11 = 0 then 'LastPosition' when l_partkey % 5 = 0 then 'Collision' when l_partkey % 17 <> 1 then 'Action' end"
_EVENT = f"""named_struct('StartedAt', l_linenumber * 1.0d, 'UpdatedAt', l_linenumber * 1.0d + l_quantity, 'Actor', if(l_partkey % 2 = 0, 'Left', 'Right'),
  'Target', case l_suppkey % 4 when 0 then '' when 1 then 'Left' when 2 then 'Right' end, 'Category', {_CATEGORY},
  'State', case l_returnflag when 'R' then '0' when 'A' then '1' else '2' end,
  'Data', if(l_suppkey % 7 = 0, null, named_struct('Name', if(l_partkey % 5 = 0, null, {_NAME}), 'Duration', l_quantity,
    'Reason', case when l_linestatus = 'F' then 'None' when l_partkey % 3 > 0 then l_returnflag end, 'Robot', if(l_partkey % 4 = 0, null, {_ROBOT.format(x='l_extendedprice / 10000', y='l_tax * 10')}),
    'EnemyRobot', if(l_partkey % 6 = 1, null, {_ROBOT.format(x='l_tax', y='l_extendedprice')}), 'IsActor', if(l_suppkey % 5 = 0, null, l_suppkey % 2 = 0), 'Impact', l_extendedprice,
    'IsTieBreaker', l_tax < 0.02d, 'LockDuration', l_tax)))"""


def game_logs(spark: SparkSession, sf: str, more: str = "") -> DataFrame:
    """matchup, config, Index, Timestamp, Winner, Rounds: a document an order that has lines; more: further fields of events."""
    event = re.sub(r"\bl_", "p.l_", _EVENT if not more else f"{_EVENT[:-1]}, {more})")
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("lines"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.expr("concat('TEAM_', o_custkey % 5, '_vs_TEAM_', o_orderkey % 5)").alias("matchup"),
        F.expr("concat('Timer_', cast(substr(o_orderpriority, 1, 1) as int) * 15, '__ActInterval_0.1__Round_BestOf', cast(substr(o_orderpriority, 1, 1) as int) % 3 * 2 + 1, '__SkillLeft_Boost__SkillRight_Stone')").alias("config"),
        F.expr("o_orderkey - 1").alias("Index"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Timestamp"), F.expr("case o_orderstatus when 'F' then 'Left' when 'P' then 'Draw' else 'Right' end").alias("Winner"),
    )
    # Events, of which each has many times a line's bytes, are made of the lines after the last exchange.
    dealt = orders.join(nested, "l_orderkey").hint("rebalance", "matchup", "config")
    rounds = f"""transform(array_sort(array_distinct(transform(lines, p -> p.l_linenumber % 2))), i -> named_struct('Index', cast(i as bigint), 'Timestamp', 'r', 'Winner', case when i = 0 then 'Draw' when l_orderkey % 3 = 0 then 'Left' else 'Right' end,
      'PlayerEvents', transform(filter(lines, p -> p.l_linenumber % 2 <=> i), p -> {event})))"""
    return dealt.select("matchup", "config", "Index", "Timestamp", "Winner", F.expr(rounds).alias("Rounds"))


def _flag(value: str) -> str:
    return f"coalesce({value}::bigint, 0)"


def _snapshot_sql(prefix: str, robot: str, only: str) -> str:
    """The eight columns of a snapshot from a struct (null if there is none), where `only` holds."""
    put = lambda name, value: f"case when {only} and {robot} is not null then {value} end as {prefix}{name}"
    plain = {"PosX": "Position.X", "PosY": "Position.Y", "Linv": "LinearVelocity", "Angv": "AngularVelocity", "Rot": "Rotation"}
    return ", ".join([put(k, f"{robot}.{v}") for k, v in plain.items()] + [put(k, _flag(f"{robot}.{k}")) for k in ("IsDashActive", "IsSkillActive", "IsOutFromArena")])


def _struct_sql(x: str, y: str) -> str:
    return f"""{{'Position': {{'X': {x}, 'Y': {y}}}, 'LinearVelocity': l_discount, 'AngularVelocity': null::double, 'Rotation': l_quantity, 'IsDashActive': l_partkey % 2 = 1, 'IsSkillActive': null::boolean, 'IsOutFromArena': l_linenumber > 5}}"""


_NAME_SQL = f"[{', '.join(repr(a) for a in ACTIONS)}][(l_suppkey % 6 + 1)::int]"
_NESTED = f"""ev as (select l_orderkey, l_linenumber % 2 as parity, row_number() over (partition by l_orderkey, l_linenumber % 2 order by {', '.join(_ORDER)}) as n,
  {{'StartedAt': l_linenumber * 1.0::double, 'UpdatedAt': l_linenumber * 1.0::double + l_quantity, 'Actor': case when l_partkey % 2 = 0 then 'Left' else 'Right' end,
   'Target': case l_suppkey % 4 when 0 then '' when 1 then 'Left' when 2 then 'Right' end, 'Category': {_CATEGORY}, 'State': case l_returnflag when 'R' then '0' when 'A' then '1' else '2' end,
   'Data': case when l_suppkey % 7 > 0 then {{'Name': case when l_partkey % 5 > 0 then {_NAME_SQL} end, 'Duration': l_quantity, 'Reason': case when l_linestatus = 'F' then 'None' when l_partkey % 3 > 0 then l_returnflag end,
     'Robot': case when l_partkey % 4 > 0 then {_struct_sql('l_extendedprice / 10000', 'l_tax * 10')} end, 'EnemyRobot': case when l_partkey % 6 <> 1 then {_struct_sql('l_tax', 'l_extendedprice')} end,
     'IsActor': case when l_suppkey % 5 > 0 then l_suppkey % 2 = 0 end, 'Impact': l_extendedprice, 'IsTieBreaker': l_tax < 0.02, 'LockDuration': l_tax}} end, 'Part': l_partkey, 'Zone': l_suppkey}} as e from lineitem),
rd as (select l_orderkey, parity, {{'Index': parity::bigint, 'Winner': case when parity = 0 then 2 when l_orderkey % 3 = 0 then 0 else 1 end, 'PlayerEvents': list(e order by n)}} as r from ev group by l_orderkey, parity),
gm as (select l_orderkey as GameIndex, list(r order by parity) as Rounds from rd group by l_orderkey),
lg as (select gm.*, case o_orderstatus when 'F' then 0 when 'P' then 2 else 1 end as GameWinner, strftime(o_orderdate, '%Y-%m-%d') as GameTimestamp, 'TEAM_' || (o_custkey % 5) as Bot_L, 'TEAM_' || (o_orderkey % 5) as Bot_R,
  substr(o_orderpriority, 1, 1)::int * 15.0::double as Timer, 0.1::double as ActInterval, 'BestOf' || (substr(o_orderpriority, 1, 1)::int % 3 * 2 + 1) as Round, 'Boost' as SkillLeft, 'Stone' as SkillRight from gm join orders on o_orderkey = GameIndex),
r1 as (select *, unnest(Rounds) as r, generate_subscripts(Rounds, 1) - 1 as round_pos from lg),
e1 as (select *, unnest(r.PlayerEvents) as e, generate_subscripts(r.PlayerEvents, 1) - 1 as event_pos from r1),
flat as (select GameIndex, GameWinner::bigint as GameWinner, GameTimestamp, r.Index as RoundIndex, r.Winner::bigint as RoundWinner, 'r' as RoundTimestamp, e.StartedAt as StartedAt, e.UpdatedAt as UpdatedAt, case when e.Actor = 'Left' then 0 else 1 end::bigint as Actor,
  case when e.Target is null or e.Target = '' then null when e.Target = 'Left' then 0 else 1 end::bigint as Target, e.Category as Category, e.State as State, e.Data.Name as Name, e.Data.Duration as Duration,
  case when e.Data.Reason <> 'None' then e.Data.Reason end as Reason, {_snapshot_sql('Bot', 'e.Data.Robot', 'true')}, {_snapshot_sql('EnemyBot', 'e.Data.EnemyRobot', 'true')}, {_snapshot_sql('ColBot', 'e.Data.Robot', "e.Category = 'Collision'")},
  {_snapshot_sql('ColEnemyBot', 'e.Data.EnemyRobot', "e.Category = 'Collision'")}, case when e.Category = 'Collision' then {_flag('e.Data.IsActor')} end as ColActor, case when e.Category = 'Collision' then e.Data.Impact end as ColImpact,
  case when e.Category = 'Collision' then {_flag('e.Data.IsTieBreaker')} end as ColTieBreaker, case when e.Category = 'Collision' then e.Data.LockDuration end as ColLockDuration,
  {', '.join(DIMENSIONS)}, round_pos::int as round_pos, event_pos::int as event_pos, e.Part as Part, e.Zone as Zone from e1 where e.Category is null or e.Category <> 'LastPosition')"""


#: Compressed files can't be split among tasks, so none is large.
_FILES = {"compression": "gzip", "maxRecordsPerFile": 100_000}


def _written(spark: SparkSession, sf: str, more: str = "") -> str:
    """The folder of the whole tables' logs, a game a line, compressed."""
    root = shared_folder(spark)
    game_logs(spark, sf, more).write.partitionBy("matchup", "config").options(**_FILES).json(root)
    return root


def _read(spark: SparkSession, sf: str) -> DataFrame:
    return logs.flatten_games(logs.read_games(spark, _written(spark, sf), lines=True))


_COLUMNS = [*EVENTS.names, *DIMENSIONS, "round_pos", "event_pos"]
#: Whole numbers that may be null, compared as doubles: frames on both sides hold those differently.
_SPARSE = {"Target", "ColActor", "ColTieBreaker", *(f"{p}{c}" for p in SNAPSHOTS for c in ("IsDashActive", "IsSkillActive", "IsOutFromArena"))}
_COUNTS = ["ActionCounts_L", "ActionCounts_R", "TotalActions"]


def _doubles(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


@entry(f"with {_NESTED} select {', '.join(f'{c}::double as {c}' if c in _SPARSE else c for c in _COLUMNS)} from flat")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Nested logs of all orders, written as JSON, read and flattened: events, snapshots, dimensions."""
    return _doubles(_read(spark, sf).select(*_COLUMNS), sorted(_SPARSE))


_M = f"""m as (select GameIndex, max(GameWinner) as Winner, max(UpdatedAt) as MatchDur, count(*) filter (where Category = 'Action') as acts, count(*) filter (where Category = 'Action' and State <> '2' and Actor = 0) as l,
  count(*) filter (where Category = 'Action' and State <> '2' and Actor = 1) as r, count(*) filter (where Category = 'Action' and State <> '2') as t,
  count(*) filter (where Category = 'Collision' and State = '0' and ColTieBreaker = 0 and ColActor = 1 and Actor = 0) as Collisions_L, count(*) filter (where Category = 'Collision' and State = '0' and ColTieBreaker = 0 and ColActor = 1 and Actor = 1) as Collisions_R,
  coalesce(sum(ColTieBreaker) filter (where Category = 'Collision' and State = '0'), 0)::bigint as Collisions_Tie, coalesce(sum(dur) filter (where Category = 'Action' and Actor = 0), 0) as dl, {', '.join(f'max({d}) as {d}' for d in DIMENSIONS)}
  from (select *, case when State = '2' and lag(StartedAt) over w is not null then UpdatedAt - lag(StartedAt) over w else 0 end as dur from flat window w as (partition by GameIndex, Category, Actor, Name order by UpdatedAt, round_pos, event_pos)) group by GameIndex)"""
_METRICS = f"""{_M}
select GameIndex, Winner, {rounded_sql('MatchDur')}, case when acts > 0 then round(dl, 6) end as Duration_L, case when acts > 0 then l end::double as ActionCounts_L, case when acts > 0 then r end::double as ActionCounts_R, case when acts > 0 then t end::double as TotalActions,
  Collisions_L, Collisions_R, Collisions_Tie, {', '.join(DIMENSIONS)} from m"""


def _reread(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    """Metrics of each game, with dimensions, from an event table that was written and read back."""
    path = shared_folder(spark)
    logs.write_events(_read(spark, sf), path, fmt, arranged=True)
    folders = ["matchup", "config"]
    events = games.measured(logs.read_events(spark, path, fmt), folders)
    if fmt == "csv":  # parsed once, not for each pass of the metrics
        events = written(events, shared_folder(spark))
    # The names of folders are taken apart once a game, not for each event.
    metrics = logs.with_dimensions(games.game_metrics(events, dimensions=folders))
    return rounded(_doubles(metrics, _COUNTS).select("GameIndex", "Winner", "MatchDur", "Duration_L", *_COUNTS, "Collisions_L", "Collisions_R", "Collisions_Tie", *DIMENSIONS), "MatchDur", "Duration_L")


@entry(f"with {_NESTED}, {_METRICS}")
def event_table_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _reread(spark, sf, "parquet")


@entry(f"with {_NESTED}, {_METRICS}")
def event_table_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _reread(spark, sf, "csv")


@entry(f"""with {_NESTED} select GameIndex, 'TEAM_2' as Bot, case when Actor = 0 then Bot_R else Bot_L end as Opponent, case when Actor = 0 then 'L' else 'R' end as Side, Timer, UpdatedAt, BotPosX, BotPosY, BotRot from flat
  where BotPosX is not null and BotPosY is not null and BotRot is not null and case when Actor = 0 then Bot_L else Bot_R end = 'TEAM_2'""")
def competitor_events(spark: SparkSession, sf: str) -> DataFrame:
    """One competitor's positions on either side, from the folders of its own matchups."""
    path = shared_folder(spark)
    logs.write_events(_read(spark, sf), path, arranged=True)
    rows = logs.competitor_positions(logs.read_events(spark, path, "parquet"), "TEAM_2")
    return rows.select("GameIndex", "Bot", "Opponent", "Side", "Timer", "UpdatedAt", "BotPosX", "BotPosY", "BotRot")


_UNSEEN = f"""select GameIndex, round_pos, event_pos, Category, UpdatedAt, case when Part % 3 > 0 then Part::varchar end as Part, case when Zone % 2 = 0 then '["z",' || Zone || ']' when Zone % 3 = 0 then Zone::varchar end as Zone from flat"""


@entry(f"with {_NESTED} {_UNSEEN}")
def json_unseen_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Logs with two keys that the schema doesn't know: a number that some events lack, and lists, numbers and nulls."""
    zone = """case when l_suppkey % 2 = 0 then concat('["z",', l_suppkey, ']') when l_suppkey % 3 = 0 then string(l_suppkey) end"""
    root = _written(spark, sf, f"'Part', if(l_partkey % 3 > 0, l_partkey, null), 'Zone', parse_json({zone})")
    out = freeform.flatten_all(freeform.read_texts(spark, root, lines=True).select("json"), columns=["GameIndex", "Category", "UpdatedAt"])
    return out.select("GameIndex", "round_pos", "event_pos", "Category", "UpdatedAt", "Part", "Zone")


@entry(f"""with {_NESTED}, {_M}, s as (select {', '.join(DIMENSIONS)}, count(*) as Games, count(*) filter (where Winner = 0) as Winner_L, count(*) filter (where Winner = 1) as Winner_R, round(avg(MatchDur), 6) as MatchDur,
  round(sum(case when acts > 0 then dl end), 6) as Duration_L, coalesce(sum(case when acts > 0 then t end), 0)::bigint as TotalActions, sum(Collisions_L)::bigint as Collisions_L, sum(Collisions_Tie)::bigint as Collisions_Tie from m group by all)
  select * replace (coalesce(Duration_L, 0) as Duration_L), round(Winner_L / Games, 6) as WinRate_L from s""")
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The matchup summary, kept up to date from a stream of log files in some batches, the last of which is merged twice."""
    root, into = _written(spark, sf), shared_folder(spark)
    summaries.summarise_available(spark, root, f"{into}/table", f"{into}/checkpoint", max_files=50, lines=True).awaitTermination()
    again = logs.flatten_games(logs.read_games(spark, root, lines=True)).limit(1000)
    summaries.merge(again, summaries.versions(spark, f"{into}/table")[-1], f"{into}/table")
    out = summaries.current(spark, f"{into}/table", ranks=False)
    return rounded(out.select(*DIMENSIONS, "Games", "Winner_L", "Winner_R", "MatchDur", "Duration_L", "TotalActions", "Collisions_L", "Collisions_Tie", "WinRate_L"), "MatchDur", "Duration_L", "WinRate_L")


@entry("""with g as (select o_orderkey as GameIndex, count(*) as events, sum(l_quantity) as quantity from orders join lineitem on o_orderkey = l_orderkey where l_partkey % 11 > 0 group by 1)
select GameIndex, events, round(quantity, 6) as UpdatedSum from (select GameIndex, events, (select sum(l_linenumber) from lineitem where l_orderkey = GameIndex and l_partkey % 11 > 0) + quantity as quantity from g)""")
def manifest_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Games of many files, loaded in runs of which one ended between writing and commit: each event is there once."""
    root, into = _written(spark, sf), shared_folder(spark)
    first = loads.staged(spark, root, into, max_files=40, lines=True, arranged=True)
    loads.commit(into, first[1])
    loads.staged(spark, root, into, max_files=40, lines=True, arranged=True)  # broken off before its commit
    loads.load(spark, root, into, lines=True, arranged=True)
    loads.cleaned(spark, into)
    events = loads.loaded_events(spark, into)
    return rounded(events.groupBy("GameIndex").agg(F.count("*").alias("events"), F.sum("UpdatedAt").alias("UpdatedSum")), "UpdatedSum")


@entry("""select l_orderkey, l_linenumber, l_partkey, format('{:.10g}', l_extendedprice * l_discount / 7) as a, format('{:.10g}', l_quantity) as b, format('{:.10g}', l_tax / 1000000 / 3) as c,
  format('{:.10g}', -sqrt(l_extendedprice) * 123456789.7) as d from lineitem""")
def csv_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as the CSV sink writes them, of up to ten significant digits."""
    value = {"a": "l_extendedprice * l_discount / 7", "b": "l_quantity", "c": "l_tax / 1000000 / 3", "d": "-sqrt(l_extendedprice) * 123456789.7d"}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[S.ten_digits(F.expr(v)).alias(k) for k, v in value.items()])
