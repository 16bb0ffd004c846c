"""The driver's tables read as telemetry: the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.games import action_columns, collision_columns
from ..operators.spans import with_group
from ..operators.summary import finished, matchup_parts
from ..sources.schema import ACTIONS
from ..sources.shared import shared_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a game, time counts in half days since its first event."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = with_group(e, ["user_id"], F.min("us").alias("first"))
    t = (F.col("us") - F.col("first")).cast("double") / 43_200_000_000.0
    part = lambda n: F.call_function("div", F.col("event_id"), F.lit(n))
    return e.select(
        F.col("user_id").alias("GameIndex"), (F.col("user_id") % 3).alias("GameWinner"), t.alias("UpdatedAt"), F.greatest(t - (F.col("event_id") % 4) / 100.0, F.lit(0.0)).alias("StartedAt"),
        (F.col("event_id") % 2).alias("Actor"), F.when(F.col("event_id") % 5 == 0, "Collision").otherwise("Action").alias("Category"), F.col("event_type").alias("Name"),
        (part(7) % 3).cast("string").alias("State"), (part(5) % 2).alias("ColActor"), F.when(part(10) % 3 == 0, 1).otherwise(0).cast("long").alias("ColTieBreaker"),
        F.col("event_id").alias("event_pos"), "value", "props",
    )


TELEMETRY = """tele as (select user_id as GameIndex, user_id % 3 as GameWinner, t as UpdatedAt, greatest(t - (event_id % 4) / 100.0::double, 0.0) as StartedAt, event_id % 2 as Actor,
  case when event_id % 5 = 0 then 'Collision' else 'Action' end as Category, event_type as Name, cast((event_id // 7) % 3 as varchar) as State, (event_id // 5) % 2 as ColActor,
  case when (event_id // 10) % 3 = 0 then 1 else 0 end as ColTieBreaker, event_id as event_pos, value, props
  from (select *, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id))::double / 43200000000.0::double as t from events))"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem: an order is a game of its customer's nation against another; its lines are the actions."""
    o, c, n, li = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "lineitem"))
    acts = li.select(
        F.col("l_orderkey").alias("GameIndex"), (F.col("l_partkey") % 2).alias("Actor"), F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("Name"),
        F.col("l_quantity").alias("ActualDuration"), F.when(F.col("l_returnflag") == "N", "2").otherwise("0").alias("State"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("long").alias("ColActor"),
        F.when(F.col("l_tax") < 0.02, 1).otherwise(0).cast("long").alias("ColTieBreaker"),
    )
    per = acts.groupBy("GameIndex").agg(*action_columns(F.lit(True)), *collision_columns(F.lit(True)))
    home, away = (n.select(F.col("n_nationkey").alias(f"k_{s}"), F.col("n_name").alias(f"Bot_{s}")) for s in ("L", "R"))
    o = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k_L"), "c_mktsegment"), "o_custkey").withColumn("k_R", (F.col("o_orderkey") % 25).cast("int"))
    o = o.join(F.broadcast(home), "k_L").join(F.broadcast(away), "k_R")  # 25 nations
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    o = o.select(
        F.col("o_orderkey").alias("GameIndex"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 2).otherwise(1).cast("long").alias("Winner"), (F.col("o_totalprice") / 1000).alias("MatchDur"),
        "Bot_L", "Bot_R", (level * 15.0).alias("Timer"), F.when(F.length("c_mktsegment") > 9, 0.2).otherwise(0.1).cast("double").alias("ActInterval"),
        F.concat(F.lit("BestOf"), (level % 3 * 2 + 1).cast("string")).alias("Round"), F.when(F.col("o_orderkey") % 2 == 0, "Boost").otherwise("Stone").alias("SkillLeft"),
        F.when(F.col("o_custkey") % 2 == 0, "Boost").otherwise("Stone").alias("SkillRight"),
    )
    out = o.join(per, "GameIndex", "left")
    return out.withColumns({f"Collisions_{x}": F.coalesce(f"Collisions_{x}", F.lit(0).cast("long")) for x in ("L", "R", "Tie")})


def _game_sql() -> str:
    counted, side = "State <> '2'", {"L": "Actor = 0", "R": "Actor = 1"}
    out = []
    for s, is_side in side.items():
        out.append(f"coalesce(sum(q) filter (where {is_side}), 0) as Duration_{s}")
        out.append(f"coalesce(count(*) filter (where {is_side} and {counted}), 0) as ActionCounts_{s}")
        for a in ACTIONS:
            out.append(f"coalesce(sum(q) filter (where {is_side} and Name = '{a}'), 0) as {a}_Dur_{s}")
            out.append(f"count(*) filter (where {is_side} and {counted} and Name = '{a}') as {a}_Act_{s}")
    out.append(f"count(*) filter (where {counted}) as TotalActions")
    out += [f"count(*) filter (where State = '0' and tie = 0 and ca = 1 and {c}) as Collisions_{s}" for s, c in side.items()]
    out.append("coalesce(sum(tie) filter (where State = '0'), 0) as Collisions_Tie")
    return ", ".join(out)


_DYNAMIC = [f"{a}_{k}_{s}" for a in ACTIONS for k in ("Act", "Dur") for s in ("L", "R")]
_SUMS = ["Duration_L", "Duration_R", "ActionCounts_L", "ActionCounts_R", "TotalActions", "Collisions_L", "Collisions_R", "Collisions_Tie", *_DYNAMIC]

GAMES = f"""acts as (select l_orderkey as GameIndex, l_partkey % 2 as Actor, [{", ".join(f"'{a}'" for a in ACTIONS)}][(l_suppkey % 6 + 1)::int] as Name, l_quantity as q,
  case when l_returnflag = 'N' then '2' else '0' end as State, case when l_linestatus = 'F' then 1 else 0 end as ca, case when l_tax < 0.02 then 1 else 0 end as tie from lineitem),
per as (select GameIndex, {_game_sql()} from acts group by GameIndex),
games as (select o_orderkey as GameIndex, case o_orderstatus when 'F' then 0 when 'P' then 2 else 1 end as Winner, o_totalprice / 1000 as MatchDur, h.n_name as Bot_L, a.n_name as Bot_R,
  substr(o_orderpriority, 1, 1)::int * 15.0::double as Timer, case when length(c_mktsegment) > 9 then 0.2::double else 0.1::double end as ActInterval,
  'BestOf' || (substr(o_orderpriority, 1, 1)::int % 3 * 2 + 1) as Round, case when o_orderkey % 2 = 0 then 'Boost' else 'Stone' end as SkillLeft, case when o_custkey % 2 = 0 then 'Boost' else 'Stone' end as SkillRight,
  per.* exclude (GameIndex, Collisions_L, Collisions_R, Collisions_Tie), coalesce(Collisions_L, 0) as Collisions_L, coalesce(Collisions_R, 0) as Collisions_R, coalesce(Collisions_Tie, 0) as Collisions_Tie
  from orders join customer on o_custkey = c_custkey join nation h on h.n_nationkey = c_nationkey join nation a on a.n_nationkey = o_orderkey % 25 left join per on per.GameIndex = o_orderkey)"""


def matchups(spark: SparkSession, sf_dir: str, ranks: bool = True) -> DataFrame:
    """The matchup summary. Its parts are written first: orders and lineitem are read once, whatever a report does with the summary."""
    return finished(written(matchup_parts(games(spark, sf_dir)), shared_folder(spark)), ranks)


MATCHUPS = f"""{GAMES},
m0 as (select Bot_L, Bot_R, Timer, ActInterval, Round, SkillLeft, SkillRight, count(distinct GameIndex) as Games, count(*) filter (where Winner = 0) as Winner_L, count(*) filter (where Winner = 1) as Winner_R,
  avg(MatchDur) as MatchDur, {", ".join(f"coalesce(sum({c}), 0) as {c}" for c in _SUMS)} from games group by all),
m1 as (select *, Winner_L / Games as WinRate_L, Winner_R / Games as WinRate_R from m0),
pool as (select Bot, sum(Wins) as Wins, sum(Games) as Games, sum(Wins) / sum(Games) as WinRate from (select Bot_L as Bot, Winner_L as Wins, Games from m1 union all select Bot_R, Winner_R, Games from m1) group by Bot),
ranks as (select *, floor(rank() over (order by WinRate desc) + (count(*) over (partition by WinRate) - 1) / 2)::int as Rank from pool),
matchups as (select m1.*, l.Rank as Rank_L, r.Rank as Rank_R from m1 left join ranks l on l.Bot = Bot_L left join ranks r on r.Bot = Bot_R),
bothsides as (select Bot_L as Bot, Bot_R as Enemy, WinRate_L as WinRate, Rank_L as Rank, Duration_L as Duration, ActionCounts_L as Actions, Collisions_L as Collisions, Collisions_R as EnemyCollisions, SkillLeft as Skill, Dash_Act_L as Dash_Act, Games, Timer, ActInterval, Round, Collisions_Tie from matchups
  union all select Bot_R, Bot_L, WinRate_R, Rank_R, Duration_R, ActionCounts_R, Collisions_R, Collisions_L, SkillRight, Dash_Act_R, Games, Timer, ActInterval, Round, Collisions_Tie from matchups)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: two vectors of following ids are the two sides at one time; their first components are places."""
    e = table(spark, sf_dir, "embeddings").withColumn("pair", F.call_function("div", F.col("vec_id"), F.lit(2)))
    return e.select((F.col("pair") % 10).alias("GameIndex"), (F.col("pair") / 4.0).alias("UpdatedAt"), (F.col("vec_id") % 2).alias("Actor"), (F.get("embedding", 0).cast("double") * 5).alias("BotPosX"), (F.get("embedding", 1).cast("double") * 5).alias("BotPosY"), (F.col("label") * 15.0 + 15).alias("Timer"))


FRAMES = "frames as (select (vec_id // 2) % 10 as GameIndex, (vec_id // 2) / 4.0::double as UpdatedAt, vec_id % 2 as Actor, embedding[1]::double * 5 as BotPosX, embedding[2]::double * 5 as BotPosY, label * 15.0::double + 15 as Timer from embeddings)"
