"""The named queries that bind operators to the driver's tables, with equivalent SQL.

Figures are rounded to six places on both sides, since sums may differ in their last digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats
from ..operators import games, spatial, summary, timebins
from ..sources import loads, logs
from ..sources.shared import shared_folder
from . import arena, nested  # noqa: F401  nested enters queries of its own
from . import bindings as B
from . import reports as R
from .registry import CATALOG, Query, entry
from .registry import rounded as _rounded
from .registry import rounded_sql as _r


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}


# Games, matchups, competitors


@entry("select o_orderkey, case o_orderstatus when 'F' then 0 when 'P' then 2 else 1 end as winner, case when o_orderstatus = 'F' then 0 else 1 end as actor from orders")
def winner_encode(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "F", "Left").when(F.col("o_orderstatus") == "P", "Draw").otherwise("Right")
    return B.table(spark, sf, "orders").select("o_orderkey", S.winner_code(name).cast("int").alias("winner"), S.actor_code(name).cast("int").alias("actor"))


@entry(f"with {B.MATCHUPS} select Bot_L, Bot_R, Timer, ActInterval, Round, SkillLeft, SkillRight, Games, Winner_L, Winner_R, {_r('WinRate_L', 'WinRate_R')}, Rank_L, Rank_R from matchups")
def matchup_winrate(spark: SparkSession, sf: str) -> DataFrame:
    out = B.matchups(spark, sf).select(*R.CONFIG, "Bot_L", "Bot_R", "Games", "Winner_L", "Winner_R", "WinRate_L", "WinRate_R", "Rank_L", "Rank_R")
    return _rounded(out, "WinRate_L", "WinRate_R")


@entry(f"with {B.MATCHUPS} select * replace ({', '.join(f'round({c}::double, 6) as {c}' for c in ['MatchDur', 'WinRate_L', 'WinRate_R', *B._SUMS])}) from matchups")
def matchup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.matchups(spark, sf), "MatchDur", "WinRate_L", "WinRate_R", *B._SUMS)


@entry(f"with {B.MATCHUPS} select Bot, Wins::bigint as Wins, Games::bigint as Games, {_r('WinRate')}, Rank from ranks")
def competitor_rank_avg_ties(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(summary.competitor_ranks(B.matchups(spark, sf, ranks=False)), "WinRate")


_STATS = ", ".join(f"avg({c}) as {c}_mean, stddev_samp({c}) as {c}_std" for c in ("WinRate", "Duration", "Actions", "Collisions"))
_COMPETITOR = f"""{B.MATCHUPS}, per as materialized (select Bot, WinRate, Duration / Games as Duration, Actions / Games as Actions, (Collisions + Collisions_Tie) / Games as Collisions from bothsides),
cs as (select Bot, {_STATS} from per group by Bot)""".replace("per as materialized", "pergame as").replace("from per group", "from pergame group")


@entry(f"with {_COMPETITOR} select Bot, {_r(*[f'{c}_{x}' for c in ('WinRate', 'Duration', 'Actions', 'Collisions') for x in ('mean', 'std')])} from cs")
def competitor_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    out = summary.competitor_stats(B.matchups(spark, sf, ranks=False), ranks=False)
    return _rounded(out, *[c for c in out.columns if c != "Bot"])


def _label(column: str, name: str) -> str:
    return f"round({column}_mean, 2)::varchar || ' (' || round({column}_std, 2)::varchar || ')' as \"{name}\""


@entry(f"""with {_COMPETITOR}, ranked as (select *, floor(rank() over (order by WinRate_mean desc) + (count(*) over (partition by WinRate_mean) - 1) / 2)::int as Rank from cs)
  select Rank, Bot, {_label('WinRate', 'Win-rate')}, {_label('Duration', 'Action Duration')}, {_label('Actions', 'Actions')}, {_label('Collisions', 'Collisions')} from ranked""")
def mean_std_label(spark: SparkSession, sf: str) -> DataFrame:
    return summary.competitor_summary(B.matchups(spark, sf, ranks=False))


_GAME = """select GameIndex, max(GameWinner) as Winner, round(max(UpdatedAt), 6) as MatchDur, round(coalesce(sum(dur) filter (where Category = 'Action' and Actor = 0), 0), 6) as Duration_L,
  round(coalesce(sum(dur) filter (where Category = 'Action' and Actor = 1), 0), 6) as Duration_R, count(*) filter (where Category = 'Action' and State <> '2' and Actor = 0) as ActionCounts_L,
  count(*) filter (where Category = 'Action' and State <> '2' and Actor = 1) as ActionCounts_R, count(*) filter (where Category = 'Action' and State <> '2') as TotalActions,
  round(coalesce(sum(dur) filter (where Category = 'Action' and Actor = 0 and Name = 'click'), 0), 6) as click_Dur_L, count(*) filter (where Category = 'Action' and State <> '2' and Actor = 1 and Name = 'view') as view_Act_R,
  count(*) filter (where Category = 'Collision' and State = '0' and ColTieBreaker = 0 and ColActor = 1 and Actor = 0) as Collisions_L, count(*) filter (where Category = 'Collision' and State = '0' and ColTieBreaker = 0 and ColActor = 1 and Actor = 1) as Collisions_R,
  coalesce(sum(ColTieBreaker) filter (where Category = 'Collision' and State = '0'), 0)::bigint as Collisions_Tie
  from (select *, case when State = '2' and lag(StartedAt) over w is not null then UpdatedAt - lag(StartedAt) over w else 0 end as dur from tele window w as (partition by GameIndex, Category, Actor, Name order by UpdatedAt, event_pos)) group by GameIndex"""
KINDS = ("click", "view", "purchase", "signup", "error")


def _game_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return games.game_metrics(B.telemetry(spark, sf), ["GameIndex"], actions=KINDS)


@entry(f"with {B.TELEMETRY} {_GAME}")
def game_metrics_wide(spark: SparkSession, sf: str) -> DataFrame:
    out = _game_metrics(spark, sf).select("GameIndex", "Winner", "MatchDur", "Duration_L", "Duration_R", "ActionCounts_L", "ActionCounts_R", "TotalActions", "click_Dur_L", "view_Act_R", "Collisions_L", "Collisions_R", "Collisions_Tie")
    return _rounded(out, "MatchDur", "Duration_L", "Duration_R", "click_Dur_L")


@entry(f"""with {B.TELEMETRY} select GameIndex, Actor, Name, round(sum(case when State = '2' and b is not null then UpdatedAt - b else 0 end), 6) as Duration
  from (select *, lag(StartedAt) over (partition by GameIndex, Actor, Name order by UpdatedAt, event_pos) as b from tele where Category = 'Action') group by all""")
def action_lag_duration(spark: SparkSession, sf: str) -> DataFrame:
    acts = B.telemetry(spark, sf).where("Category = 'Action'")
    out = games.with_actual_duration(acts, ["GameIndex"]).groupBy("GameIndex", "Actor", "Name").agg(F.sum("ActualDuration").alias("Duration"))
    return _rounded(out, "Duration")


@entry(f"with {B.TELEMETRY} select GameIndex, " + ", ".join(f"count(*) filter (where Actor = {i} and Name = '{k}') as {k}_Act_{s}" for i, s in enumerate("LR") for k in KINDS) + " from tele where Category = 'Action' and State <> '2' group by GameIndex")
def action_counts_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _game_metrics(spark, sf).where("TotalActions > 0").select("GameIndex", *[f"{k}_Act_{s}" for s in "LR" for k in KINDS])


@entry(f"with {B.GAMES} select GameIndex, Collisions_L, Collisions_R, Collisions_Tie::bigint as Collisions_Tie from games")
def collision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.games(spark, sf).select("GameIndex", "Collisions_L", "Collisions_R", "Collisions_Tie")


_ONE_GAME = f"""{B.TELEMETRY.replace('tele as', 'tele0 as')}, tele as (select * replace (case when GameIndex % 10 > 0 then 0 else GameIndex end as GameIndex) from tele0)"""


def _one_game(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry in which one game has nine tenths of all events."""
    return B.telemetry(spark, sf).withColumn("GameIndex", F.when(F.col("GameIndex") % 10 > 0, 0).otherwise(F.col("GameIndex")))


@entry(f"with {_ONE_GAME} {_GAME}")
def one_large_game(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics where a game is dealt to ranges of time."""
    out = games.game_metrics(_one_game(spark, sf), ["GameIndex"], actions=KINDS, most=500)
    out = out.select("GameIndex", "Winner", "MatchDur", "Duration_L", "Duration_R", "ActionCounts_L", "ActionCounts_R", "TotalActions", "click_Dur_L", "view_Act_R", "Collisions_L", "Collisions_R", "Collisions_Tie")
    return _rounded(out, "MatchDur", "Duration_L", "Duration_R", "click_Dur_L")


# Time bins

_BIN = "case when UpdatedAt = 0 then 0.0::double else (ceil(UpdatedAt / 5.0) - 1) * 5.0::double end"
_ACTION_BINS = f"""{B.TELEMETRY}, longest as (select GameIndex, max(UpdatedAt) as longest from tele group by GameIndex),
acts as (select t.*, {_BIN} as TimeBin, longest from tele t join longest using (GameIndex) where Category = 'Action' and State <> '2'),
dom as (select GameIndex, Actor, Name, unnest(range(ceil(longest / 5.0)::int)) * 5.0::double as TimeBin from (select distinct GameIndex, Actor, Name, longest from acts where longest > 0)),
frag as (select d.GameIndex, d.Actor, d.Name as Action, d.TimeBin, coalesce(c, 0) as Count from dom d left join (select GameIndex, Actor, Name, TimeBin, count(*) as c from acts group by all) x using (GameIndex, Actor, Name, TimeBin))"""


@entry(f"with {_ACTION_BINS} select * from frag")
def action_timebins_dense(spark: SparkSession, sf: str) -> DataFrame:
    return timebins.action_fragments(B.telemetry(spark, sf), 5.0, ["GameIndex"])


@entry(f"with {_ACTION_BINS} select Actor, TimeBin, Action, round(avg(Count), 6) as MeanCount from frag group by all")
def action_bins_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(timebins.action_bins(action_timebins_dense(spark, sf), ["Actor"]), "MeanCount")


_COLLISION_BINS = f"""{B.TELEMETRY}, longest as (select GameIndex, max(UpdatedAt) as longest from tele group by GameIndex),
hits as (select t.*, {_BIN} as TimeBin, longest from tele t join longest using (GameIndex) where Category = 'Collision' and State = '0'),
dom as (select GameIndex, unnest(range(ceil(longest / 5.0)::int)) * 5.0::double as TimeBin from (select distinct GameIndex, longest from hits where longest > 0)),
cfrag as (select GameIndex, TimeBin, coalesce(l, 0) as Actor_L, coalesce(r, 0) as Actor_R, coalesce(t, 0)::bigint as Tie from dom left join (select GameIndex, TimeBin,
  count(*) filter (where ColTieBreaker = 0 and ColActor = 1 and Actor = 0) as l, count(*) filter (where ColTieBreaker = 0 and ColActor = 1 and Actor = 1) as r, sum(ColTieBreaker) as t from hits group by all) x using (GameIndex, TimeBin))"""


@entry(f"with {_COLLISION_BINS} select * from cfrag")
def collision_timebins(spark: SparkSession, sf: str) -> DataFrame:
    return timebins.collision_fragments(B.telemetry(spark, sf), 5.0, ["GameIndex"])


@entry(f"with {_COLLISION_BINS} select TimeBin, sum(Actor_R)::bigint as Actor_L, sum(Actor_L)::bigint as Actor_R, sum(Tie)::bigint as Tie from cfrag group by TimeBin")
def collision_bins_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return timebins.collision_bins(timebins.collision_fragments(B.telemetry(spark, sf), 5.0, ["GameIndex"], legacy_side_labels=True), [])


@entry(f"with {_ACTION_BINS} select Actor, TimeBin, round(avg(m), 6) as MeanCount from (select Actor, TimeBin, Action, avg(Count) as m from frag group by all) group by all")
def intensity_total(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.action_intensity(timebins.action_bins(action_timebins_dense(spark, sf), ["Actor"]), by="Actor"), "MeanCount")


@entry(f"with {_ACTION_BINS} select Actor, TimeBin, Action, round(avg(Count), 6) as MeanCount from frag where Action in ('click', 'view') group by all")
def intensity_select(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.action_intensity(timebins.action_bins(action_timebins_dense(spark, sf), ["Actor"]), "select", ["click", "view"], "Actor"), "MeanCount")


@entry(f"with {_COLLISION_BINS} select GameIndex, TimeBin, round(avg(Actor_L + Actor_R + Tie), 6) as MeanCount from cfrag group by all")
def collision_intensity_total(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.collision_intensity(collision_timebins(spark, sf), by="GameIndex"), "MeanCount")


@entry(f"with {_COLLISION_BINS} select TimeBin, Type, round(avg(Count), 6) as MeanCount, 0 as one from (unpivot (select TimeBin, Actor_L, Actor_R, Tie from cfrag) on Actor_L, Actor_R, Tie into name Type value Count) group by all")
def collision_intensity_per_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = collision_timebins(spark, sf).withColumn("one", F.lit(0))
    return _rounded(R.collision_intensity(rows, "per_type", by="one"), "MeanCount")


# Space


@entry(f"""with {B.TELEMETRY}, g as (select *, min(UpdatedAt) over (partition by GameIndex) as lo, max(UpdatedAt) over (partition by GameIndex) as hi from tele)
  select event_pos, case when hi = lo then 0 else least(floor((UpdatedAt - lo) * 3 / (hi - lo)), 2) end::int as phase from g""")
def phase_split(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.with_phase(B.telemetry(spark, sf), 3, ["GameIndex"]).select("event_pos", "phase")


@entry(f"""with {B.TELEMETRY} select event_pos, case when UpdatedAt < 15 then '0-15s' when UpdatedAt < 30 then '15-30s' when UpdatedAt < 45 then '30-45s' else '45-60s' end as time_window from tele
  where UpdatedAt >= 2.5 and UpdatedAt < 60""")
def time_windows(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.with_time_window(B.telemetry(spark, sf), 2.5).select("event_pos", "time_window")


@entry(f"with {B.TELEMETRY} select event_pos from (select *, min(UpdatedAt) over (partition by GameIndex) as f from tele) where UpdatedAt >= f + 2.5")
def skip_initial(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.skip_initial(B.telemetry(spark, sf), 2.5, ["GameIndex"]).select("event_pos")


_PAIR = f"{B.FRAMES}, pairs as (select GameIndex, UpdatedAt, l.Timer, l.BotPosX as Bot1_X, l.BotPosY as Bot1_Y, r.BotPosX as Bot2_X, r.BotPosY as Bot2_Y, sqrt((l.BotPosX - r.BotPosX) ** 2 + (l.BotPosY - r.BotPosY) ** 2) as Distance from frames l join frames r using (GameIndex, UpdatedAt) where l.Actor = 0 and r.Actor = 1)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.pair_distance(B.frames(spark, sf), ["GameIndex"], keep=["Timer"])


@entry(f"with {_PAIR} select GameIndex, UpdatedAt, {_r('Bot1_X', 'Bot1_Y', 'Bot2_X', 'Bot2_Y', 'Distance')} from pairs")
def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_pairs(spark, sf).drop("Timer"), "Bot1_X", "Bot1_Y", "Bot2_X", "Bot2_Y", "Distance")


@entry(f"with {B.FRAMES} select GameIndex, UpdatedAt, Actor, round(sqrt((BotPosX - 0.24) ** 2 + (BotPosY - 1.97) ** 2), 6) as DistanceFromCenter from frames")
def center_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(spatial.center_distance(B.frames(spark, sf)), "DistanceFromCenter").select("GameIndex", "UpdatedAt", "Actor", "DistanceFromCenter")


@entry(f"with {_PAIR} select Timer, count(Distance) as n, round(avg(Distance), 6) as mean, round(median(Distance), 6) as median, round(stddev_pop(Distance), 6) as std from pairs group by Timer")
def describe_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.describe(_pairs(spark, sf), "Distance", ["Timer"]), "mean", "median", "std")


@entry(f"""with {_PAIR} select Timer, floor(UpdatedAt / (Timer / 50))::int as bin, round(avg(Distance), 6) as mean, round(coalesce(stddev_samp(Distance), 0), 6) as std, count(*) as n,
  round((floor(UpdatedAt / (Timer / 50))::int + 0.5) * Timer / 50, 6) as mid from pairs where UpdatedAt < Timer group by Timer, floor(UpdatedAt / (Timer / 50))::int""")
def distance_over_time(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(spatial.distance_over_time(_pairs(spark, sf), F.col("Timer")), "mean", "std", "mid")


def _hist(source: str, value: str, bins: int, shared: bool = False) -> str:
    over = "" if shared else "partition by g"
    return f"""b as (select g, {value} as v, min({value}) over ({over}) as lo, max({value}) over ({over}) as hi, count(*) over (partition by g) as n from {source}),
h as (select g, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})::int as bin, lo, hi, n, count(*) as count from b group by 1, 2, 3, 4, 5)
select g, bin, round(lo + bin * ((hi - lo) / {bins}), 6) as start, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) as stop, count, round(count / (n * ((hi - lo) / {bins})), 6) as density from h"""


@entry(f"with {B.FRAMES}, src as (select *, Actor as g from frames), {_hist('src', 'BotPosX', 30)}")
def hist1d_30(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.histogram(B.frames(spark, sf).withColumn("g", F.col("Actor")), "BotPosX", 30, ["g"]), "start", "stop", "density")


@entry(f"with src as (select *, l_returnflag as g from lineitem where l_quantity is not null), {_hist('src', 'l_extendedprice', 99, True)}")
def hist1d_density_shared(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "lineitem").withColumn("g", F.col("l_returnflag"))
    return _rounded(stats.histogram(rows, "l_extendedprice", 99, ["g"], shared=True), "start", "stop", "density")


@entry(f"""with {B.FRAMES}, b as (select *, min(BotPosX) over () as x0, max(BotPosX) over () as x1, min(BotPosY) over () as y0, max(BotPosY) over () as y1 from frames)
  select least(floor((BotPosX - x0) / 0.7), greatest(ceil((x1 - x0) / 0.7) - 1, 0))::int as ix, least(floor((BotPosY - y0) / 0.7), greatest(ceil((y1 - y0) / 0.7) - 1, 0))::int as iy, count(*) as count from b group by 1, 2""")
def hist2d_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram2d(B.frames(spark, sf), "BotPosX", "BotPosY", spatial.TILE)


@entry(f"""with {_PAIR}, p as (select min(Distance) as lo, max(Distance) as hi, stddev_samp(Distance) * count(*)::double ** -0.2 as h, count(*) as n from pairs),
  g as (select i::int as i, lo + i / 199.0::double * (hi - lo) as x, h, n from p, range(200) r(i))
  select i, round(x, 6) as x, round(sum(exp(-0.5 * ((x - Distance) / h) ** 2)) / (n * h * sqrt(2 * pi())), 6) as density from g, pairs group by i, x, n, h""")
def kde1d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.kde1d(_pairs(spark, sf), "Distance"), "x", "density")


_KDE2 = f"""{B.FRAMES}, c as (select BotPosX - 0.24 as px, BotPosY - 1.97 as py from frames),
m as (select count(*) as n, var_samp(px) as sxx, var_samp(py) as syy, covar_samp(px, py) as sxy, count(*)::double ** (-1.0 / 3) as f from c),
axis as (select i::int as i, -5.73485 + i * (2 * 5.73485 / 99) as v from range(100) r(i)), inv as (select *, (sxx * syy - sxy * sxy) * f * f as det from m),
grid as (select a.i as ix, b.i as iy, a.v as x, b.v as y, sum(exp(-0.5 * (syy * f / det * (a.v - px) ** 2 - 2 * sxy * f / det * (a.v - px) * (b.v - py) + sxx * f / det * (b.v - py) ** 2))) / (any_value(n) * 2 * pi() * sqrt(any_value(det))) as density
  from axis a, axis b, inv, c group by a.i, b.i, a.v, b.v)"""


@entry(f"with {_KDE2} select ix, iy, {_r('x', 'y', 'density')} from grid")
def kde2d_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.kde2d(spatial.centered(B.frames(spark, sf)), "BotPosX", "BotPosY", spatial.RADIUS + 1), "x", "y", "density")


@entry(f"with {_KDE2}, d as (select ix, iy, round(density, 6) as density from grid), q as (select quantile_cont(density, 0.4) as lim from d) select ix, iy, case when density >= lim then density + 0.0 end as density from d, q")
def kde_mask40(spark: SparkSession, sf: str) -> DataFrame:
    return stats.masked_density(kde2d_grid(spark, sf).select("ix", "iy", "density"))


@entry(f"with {B.FRAMES}, s as (select *, case when hi = lo then 0 else least(floor((UpdatedAt - lo) * 3 / (hi - lo)), 2) end::int as phase from (select *, min(UpdatedAt) over (partition by GameIndex) as lo, max(UpdatedAt) over (partition by GameIndex) as hi from frames)), src as (select *, phase as g from s), {_hist('src', 'BotPosY', 30)}")
def phased_position_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.histogram(spatial.with_phase(B.frames(spark, sf), 3, ["GameIndex"]).withColumnRenamed("phase", "g"), "BotPosY", 30, ["g"]), "start", "stop", "density")


_BOTS = f"{B.FRAMES}, bots as (select *, 'BOT_' || ((GameIndex + Actor * 2) % 3) as Bot, case when hi = lo then 0 else least(floor((UpdatedAt - lo) * 3 / (hi - lo)), 2) end::int as phase from (select *, min(UpdatedAt) over (partition by GameIndex) as lo, max(UpdatedAt) over (partition by GameIndex) as hi from frames))"


def _bots(spark: SparkSession, sf: str) -> DataFrame:
    bot = F.concat(F.lit("BOT_"), ((F.col("GameIndex") + F.col("Actor") * 2) % 3).cast("string"))
    return B.frames(spark, sf).withColumn("Bot", bot)


def _grid(by: str) -> str:
    """Density grids by some columns, of the table bots."""
    keys = by and f"{by}, "
    return f"""c as (select {keys}BotPosX - 0.24 as px, BotPosY - 1.97 as py from bots),
m as (select {keys}count(*) as n, var_samp(px) as sxx, var_samp(py) as syy, covar_samp(px, py) as sxy, count(*)::double ** (-1.0 / 3) as f from c group by {by or '()'}),
axis as (select i::int as i, -5.73485 + i * (2 * 5.73485 / 99) as v from range(100) r(i)), inv as (select *, (sxx * syy - sxy * sxy) * f * f as det from m where n > 1 and sxx * syy - sxy * sxy > 1e-12)
select {keys}a.i as ix, b.i as iy, round(a.v, 6) as x, round(b.v, 6) as y, round(sum(exp(-0.5 * (syy * f / det * (a.v - px) ** 2 - 2 * sxy * f / det * (a.v - px) * (b.v - py) + sxx * f / det * (b.v - py) ** 2))) / (any_value(n) * 2 * pi() * sqrt(any_value(det))), 6) as density
  from c join inv {f'using ({by})' if by else 'on true'}, axis a, axis b group by {keys}a.i, b.i, a.v, b.v"""


@entry(f"with {_BOTS}, {_grid('Bot, phase')}")
def phased_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(arena.frames(_bots(spark, sf), "heatmap", ["GameIndex"])["phased"], "x", "y", "density")


@entry(f"with {_BOTS}, {_grid('Bot')}")
def competitor_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(arena.frames(_bots(spark, sf), "heatmap", ["GameIndex"])["heatmap"], "x", "y", "density")


@entry(f"with {_BOTS}, {_grid('')}")
def combined_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(arena.frames(_bots(spark, sf), "all", ["GameIndex"])["combined"], "x", "y", "density")


@entry(f"with {_BOTS.replace('bots as', 'all_bots as')}, bots as (select * from all_bots where Actor = 0), {_grid('')}")
def combined_heatmap_left(spark: SparkSession, sf: str) -> DataFrame:
    """One map of the left competitors of all files."""
    return _rounded(arena.combined_heatmap(_bots(spark, sf)), "x", "y", "density")


def _hist_by(source: str, by: str, bins: int, edges: str) -> str:
    return f"""b as (select {by}, v, min(v) over (partition by {edges}) as lo, max(v) over (partition by {edges}) as hi, count(*) over (partition by {by}) as n from {source}),
h as (select {by}, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})::int as bin, lo, hi, n, count(*) as count from b group by all)
select {by}, bin, round(lo + bin * ((hi - lo) / {bins}), 6) as start, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) as stop, count, round(count / (n * ((hi - lo) / {bins})), 6) as density from h"""


@entry(f"with {_BOTS}, src as (select Bot, 'X' as axis, BotPosX as v from bots union all select Bot, 'Y', BotPosY from bots), {_hist_by('src', 'Bot, axis', 30, 'Bot, axis')}")
def competitor_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(arena.frames(_bots(spark, sf), "position", ["GameIndex"])["position"], "start", "stop", "density")


_BOT_PAIRS = "prs as (select GameIndex, UpdatedAt, l.Bot as a, r.Bot as b, sqrt((l.BotPosX - r.BotPosX) ** 2 + (l.BotPosY - r.BotPosY) ** 2) as Distance from bots l join bots r using (GameIndex, UpdatedAt) where l.Actor = 0 and r.Actor = 1), cd as (select GameIndex, UpdatedAt, a as Bot, b as Opponent, Distance from prs union all select GameIndex, UpdatedAt, b, a, Distance from prs)"
_BOT_DISTANCES = f"{_BOTS}, {_BOT_PAIRS}, src as (select Bot, 'pair' as kind, Distance as v from cd union all select Bot, 'center', sqrt((BotPosX - 0.24) ** 2 + (BotPosY - 1.97) ** 2) from bots)"


@entry(f"with {_BOTS}, {_BOT_PAIRS} select GameIndex, UpdatedAt, Bot, Opponent, round(Distance, 6) as Distance from cd")
def competitor_distances(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(arena.competitor_distances(_bots(spark, sf), ["GameIndex"]), "Distance")


@entry(f"with {_BOT_DISTANCES}, {_hist_by('src', 'Bot, kind', 30, 'Bot, kind')}")
def competitor_distance_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(arena.frames(_bots(spark, sf), "distance", ["GameIndex"])["distance"], "start", "stop", "density")


@entry(f"with {_BOT_DISTANCES}, {_hist_by('src', 'Bot, kind', 50, 'kind')}")
def shared_distance_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(arena.distance_histograms(_bots(spark, sf), ["GameIndex"], 50, shared=True), "start", "stop", "density")


@entry(f"""with {_BOTS}, {_BOT_PAIRS}, t as (select *, 60.0::double as Timer from cd) select Bot, Timer, floor(UpdatedAt / (Timer / 50))::int as bin, round(avg(Distance), 6) as mean, round(coalesce(stddev_samp(Distance), 0), 6) as std, count(*) as n,
  round((floor(UpdatedAt / (Timer / 50))::int + 0.5) * Timer / 50, 6) as mid from t where UpdatedAt < Timer group by Bot, Timer, floor(UpdatedAt / (Timer / 50))::int""")
def competitor_distance_over_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = arena.competitor_distances(_bots(spark, sf), ["GameIndex"])
    return _rounded(spatial.distance_over_time(rows, F.lit(60.0), by=["Bot"]), "mean", "std", "mid")


# All competitors, levels and modes at once; the first half second of each game is skipped

_CELLS, _SKIP = 40, 0.5
_LATE = f"""{B.FRAMES}, late as (select *, 'BOT_' || ((GameIndex + Actor * 2) % 3) as Bot from (select *, min(UpdatedAt) over (partition by GameIndex) as first from frames) where UpdatedAt >= first + {_SKIP}),
bots as (select *, case when hi = lo then 0 else least(floor((UpdatedAt - lo) * 3 / (hi - lo)), 2) end::int as phase from (select *, min(UpdatedAt) over (partition by GameIndex) as lo, max(UpdatedAt) over (partition by GameIndex) as hi from late)),
lv as (select Bot, 'all' as level, '' as part, BotPosX - 0.24 as px, BotPosY - 1.97 as py from bots union all select Bot, 'timer', Timer::int::varchar, BotPosX - 0.24, BotPosY - 1.97 from bots
  union all select Bot, 'phase', phase::varchar, BotPosX - 0.24, BotPosY - 1.97 from bots union all select Bot, 'window', case when UpdatedAt < 15 then '{_SKIP}-15s' when UpdatedAt < 30 then '15-30s' when UpdatedAt < 45 then '30-45s' else '45-60s' end, BotPosX - 0.24, BotPosY - 1.97
  from bots where UpdatedAt >= {_SKIP} and UpdatedAt < 60)"""


def _all_modes(spark: SparkSession, sf: str, mode: str) -> dict[str, DataFrame]:
    return arena.all_modes(_bots(spark, sf), mode, keys=["GameIndex"], skip=_SKIP, cells=_CELLS)


@entry(f"""with {_LATE}, m as (select Bot, level, part, count(*) as n, var_samp(px) as sxx, var_samp(py) as syy, covar_samp(px, py) as sxy, count(*)::double ** (-1.0 / 3) as f from lv group by 1, 2, 3),
axis as (select i::int as i, -5.73485 + i * (2 * 5.73485 / {_CELLS - 1}) as v from range({_CELLS}) r(i)), inv as (select *, (sxx * syy - sxy * sxy) * f * f as det from m where n > 1 and sxx * syy - sxy * sxy > 1e-12)
select Bot, level, part, a.i as ix, b.i as iy, round(a.v, 6) as x, round(b.v, 6) as y, round(sum(exp(-0.5 * (syy * f / det * (a.v - px) ** 2 - 2 * sxy * f / det * (a.v - px) * (b.v - py) + sxx * f / det * (b.v - py) ** 2))) / (any_value(n) * 2 * pi() * sqrt(any_value(det))), 6) as density
  from lv join inv using (Bot, level, part), axis a, axis b group by Bot, level, part, a.i, b.i, a.v, b.v""")
def all_modes_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_all_modes(spark, sf, "heatmap")["heatmap"], "x", "y", "density")


@entry(f"""with {_LATE}, ax as (select Bot, level, part, 'X' as axis, px as v from lv union all select Bot, level, part, 'Y', py from lv),
  p as (select Bot, level, part, axis, min(v) as lo, max(v) as hi, stddev_samp(v) * count(*)::double ** -0.2 as h, count(*) as n from ax group by 1, 2, 3, 4 having count(*) > 1 and stddev_samp(v) > 0),
  g as (select Bot, level, part, axis, i::int as i, lo + i / 199.0::double * (hi - lo) as x, h, n from p, range(200) r(i))
  select Bot, level, part, axis, i, round(x, 6) as x, round(sum(exp(-0.5 * ((x - v) / h) ** 2)) / (n * h * sqrt(2 * pi())), 6) as density from g join ax using (Bot, level, part, axis) group by Bot, level, part, axis, i, x, n, h""")
def all_modes_marginal(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_all_modes(spark, sf, "heatmap")["marginal"], "x", "density")


@entry(f"""with {_BOTS}, {_BOT_PAIRS.replace('select GameIndex, UpdatedAt, l.Bot as a', 'select GameIndex, UpdatedAt, l.Timer as Timer, l.Bot as a').replace('select GameIndex, UpdatedAt, a as Bot', 'select Timer, UpdatedAt, a as Bot').replace('select GameIndex, UpdatedAt, b, a', 'select Timer, UpdatedAt, b, a')}
  select Bot, Timer, floor(UpdatedAt / (Timer / 50))::int as bin, round(avg(Distance), 6) as mean, round(coalesce(stddev_samp(Distance), 0), 6) as std, count(*) as n,
  round((floor(UpdatedAt / (Timer / 50))::int + 0.5) * Timer / 50, 6) as mid from cd where UpdatedAt < Timer group by Bot, Timer, floor(UpdatedAt / (Timer / 50))::int""")
def all_modes_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """Of all of each game: distances over time don't skip its start."""
    return _rounded(_all_modes(spark, sf, "heatmap")["over_time"], "mean", "std", "mid")


@entry(f"with {_LATE}, src as (select Bot, 'X' as axis, BotPosX as v from bots union all select Bot, 'Y', BotPosY from bots), {_hist_by('src', 'Bot, axis', 30, 'Bot, axis')}")
def all_modes_position(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_all_modes(spark, sf, "position")["position"], "start", "stop", "density")


@entry(f"with {_LATE}, {_BOT_PAIRS}, src as (select Bot, 'pair' as kind, Distance as v from cd union all select Bot, 'center', sqrt((BotPosX - 0.24) ** 2 + (BotPosY - 1.97) ** 2) from bots), {_hist_by('src', 'Bot, kind', 30, 'Bot, kind')}")
def all_modes_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_all_modes(spark, sf, "distance")["distance"], "start", "stop", "density")


# Reports


@entry(f"with {B.MATCHUPS} select Enemy, round(avg(r), 6) as WinRate from (select Bot_R as Enemy, avg(WinRate_L) as r from matchups where Bot_L = 'NATION_0' group by 1 union all select Bot_L, avg(WinRate_R) from matchups where Bot_R = 'NATION_0' group by 1) group by 1")
def head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.head_to_head(B.matchups(spark, sf, ranks=False), "NATION_0"), "WinRate")


@entry(f"with {B.MATCHUPS} select Bot, Enemy, round(avg(WinRate), 6) as WinRate, min(Rank) as Rank from bothsides group by 1, 2")
def winrate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.winrate_pairs(B.matchups(spark, sf)), "WinRate")


_ENEMIES = [f"NATION_{i}" for i in range(25)]


@entry(f"with {B.MATCHUPS} select Bot, " + ", ".join(f"round(avg(WinRate) filter (where Enemy = '{e}'), 6) as \"{e}\"" for e in _ENEMIES) + " from bothsides group by 1")
def winrate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.winrate_matrix(B.matchups(spark, sf, ranks=False), _ENEMIES), *_ENEMIES)


@entry(f"with {B.MATCHUPS} select Timer, ActInterval, round(avg(MatchDur), 6) as MatchDur from matchups group by 1, 2")
def duration_by_config(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.duration_by(B.matchups(spark, sf, ranks=False), "Timer", "ActInterval"), "MatchDur")


@entry(f"""with {B.MATCHUPS}, s as (unpivot (select Bot_L as Bot, {', '.join(f'sum({a}_Act_L)::bigint as {a}' for a in B.ACTIONS)} from matchups group by 1) on {', '.join(B.ACTIONS)} into name Action value Count)
  select * from (select Bot, Action, Count, row_number() over (partition by Bot order by Count desc, Action)::int as place from s) where place <= 3""")
def top_actions(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_actions(B.matchups(spark, sf, ranks=False), 3).withColumn("Count", F.col("Count").cast("long"))


@entry(f"with {B.MATCHUPS} select Bot, Timer, round(avg(WinRate), 6) as WinRate from bothsides group by 1, 2")
def winrate_by_config(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.winrate_by(B.matchups(spark, sf, ranks=False)), "WinRate")


@entry(f"with {B.MATCHUPS} select Bot_L as Bot, Round as Config, round(avg(Duration_L / Games), 6) as mean, round(stddev_samp(Duration_L / Games), 6) as std from matchups group by 1, 2")
def metric_by_config(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.metric_by_config(B.matchups(spark, sf, ranks=False), "Duration_L", "Round"), "mean", "std")


@entry(f"with {B.MATCHUPS} select Bot, Skill as Config, round(avg(WinRate), 6) as mean, round(stddev_samp(WinRate), 6) as std from bothsides group by 1, 2")
def metric_by_skill(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.metric_by_config(B.matchups(spark, sf, ranks=False), "WinRate_L", "Skill"), "mean", "std")


@entry(f"with {B.MATCHUPS} select Bot_L as Bot, round(avg(Collisions_L / Games), 6) as mean, round(stddev_samp(Collisions_L / Games), 6) as std from matchups group by 1")
def metric_overall(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.metric_overall(B.matchups(spark, sf, ranks=False)), "mean", "std")


@entry(f"with {B.MATCHUPS} select Bot, ActInterval, round(avg(WinRate), 6) as mean, count(WinRate) as n, round(coalesce(1.96 * stddev_samp(WinRate) / sqrt(count(WinRate)), 0), 6) as error, coalesce(min(Rank), 9999) as Rank from bothsides group by 1, 2")
def grouped_error(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.grouped_error(B.matchups(spark, sf), error="ci"), "mean", "error")


_CROSS = " union all ".join(f"select WinRate_L as k, '{c}' as t, {x} as s from matchups" for c, x in (("Round", "Round"), ("SkillLeft", "SkillLeft"), ("SkillRight", "SkillRight"), ("Timer", "Timer::varchar"), ("ActInterval", "ActInterval::varchar")))


@entry(f"""with {B.MATCHUPS}, long as ({_CROSS}), c as (select k, t, t || '=' || s as x, count(*) as n from long group by all),
  p as (select a.x as X, b.x as Y, sum(a.k * a.n * b.n) / sum(a.n * b.n) as v from c a join c b on a.k = b.k and a.t <> b.t group by 1, 2)
  select p.X, p.Y, round((p.v + q.v) / 2, 6) as value from p join p q on p.X = q.Y and p.Y = q.X""")
def config_cross_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.config_cross(B.matchups(spark, sf, ranks=False)), "value")


_RADAR = {"Accelerate": "avg(Accelerate_Act_L)", "TurnLeft": "avg(TurnLeft_Act_L)", "TurnRight": "avg(TurnRight_Act_L)", "Dash": "avg(Dash_Act_L)", "Skill": "avg(SkillBoost_Act_L) + avg(SkillStone_Act_L)"}


@entry(f"""with {B.MATCHUPS}, s as (unpivot (select Bot_L as Bot, {', '.join(f'sqrt({v}) as {k}' for k, v in _RADAR.items())} from matchups group by 1) on {', '.join(_RADAR)} into name Axis value value)
  select Bot, Axis, round(value, 6) as value, round((select quantile_cont(value, 0.95) from s) * 1.15, 6) as "limit" from s""")
def radar_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.action_radar(B.matchups(spark, sf, ranks=False), "sqrt"), "value", "limit")


@entry(f"with {B.MATCHUPS} select Bot_L as Bot, round(log10(sum(Collisions_L) + 1), 6) as hit, round(log10(sum(Collisions_Tie) + 1), 6) as tie, round(log10(sum(Collisions_R) + 1), 6) as being_hit from matchups group by 1")
def radar_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.collision_radar(B.matchups(spark, sf, ranks=False), "log"), "hit", "tie", "being_hit")


@entry(f"""with {B.MATCHUPS}, s as (select Bot_L as Bot, sum(Accelerate_Act_L) as Accelerate, sum(TurnLeft_Act_L) as TurnLeft, sum(TurnRight_Act_L) as TurnRight, sum(Dash_Act_L) as Dash, sum(SkillBoost_Act_L + SkillStone_Act_L) as Skill from matchups group by 1)
  select Bot, {', '.join(f'round({c} / nullif(Accelerate + TurnLeft + TurnRight + Dash + Skill, 0) * 100, 6) as {c}' for c in _RADAR)} from s""")
def mix_percent(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.action_mix(B.matchups(spark, sf, ranks=False), True), *_RADAR)


@entry(f"with {B.MATCHUPS} select Bot_L as Bot, sum(Collisions_L)::bigint as hit, sum(Collisions_Tie)::bigint as tie, sum(Collisions_R)::bigint as being_hit from matchups group by 1")
def mix_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return R.collision_mix(B.matchups(spark, sf, ranks=False))


_XS = ["ActInterval", "Timer", "RoundNumeric", "SkillNumeric", "Dash_Act", "Collisions", "EnemyCollisions", "Duration"]
_CORR = f"""{B.MATCHUPS}, cr as (select Bot, WinRate, ActInterval, Timer, regexp_extract(Round, '([0-9]+)$', 1)::double as RoundNumeric, case Skill when 'Stone' then 1.0::double else 2.0::double end as SkillNumeric, Dash_Act / Games as Dash_Act, Collisions::double as Collisions, EnemyCollisions::double as EnemyCollisions, Duration::double as Duration from bothsides),
  cl as (unpivot (select Bot, WinRate, {', '.join(f'{c}::double as {c}' for c in _XS)} from cr) on {', '.join(_XS)} into name x value v)"""
_FIT = "round(corr(v, WinRate), 6) + 0.0 as r, round(regr_slope(WinRate, v), 6) + 0.0 as slope, round(regr_intercept(WinRate, v), 6) + 0.0 as intercept"


@entry(f"with {_CORR} select x, count(*) as n, {_FIT} from cl group by x")
def pearson_all(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.correlations(R.correlation_rows(B.matchups(spark, sf, ranks=False)), _XS), "r", "slope", "intercept")


@entry(f"with {_CORR} select Bot, x, count(*) as n, {_FIT} from cl where x in ('Duration', 'Dash_Act') group by Bot, x having stddev_pop(v) > 0 and stddev_pop(WinRate) > 0")
def ols_per_group(spark: SparkSession, sf: str) -> DataFrame:
    out = R.correlations(R.correlation_rows(B.matchups(spark, sf, ranks=False)), ["Duration", "Dash_Act"], by=["Bot"]).where("r is not null")
    return _rounded(out, "r", "slope", "intercept")


_ONE = f"""{_CORR.replace('Dash_Act / Games as Dash_Act', 'Dash_Act::double as Dash_Act')}, fit as (select x, count(*) as n, {_FIT} from cl where Bot = 'NATION_0' and x in ('Duration', 'Dash_Act', 'Collisions') group by x)"""


@entry(f"with {_ONE} select *, round(greatest(0, least(1, intercept)), 6) + 0.0 as y_lo, round(greatest(0, least(1, slope * 100 + intercept)), 6) + 0.0 as y_hi from fit")
def individual_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """One competitor's correlations, actions in sum, and the ends of its lines between 0 and 100, cut to [0, 1]."""
    fit = _rounded(R.correlations(R.individual_rows(B.matchups(spark, sf, ranks=False), "NATION_0"), ["Duration", "Dash_Act", "Collisions"]), "r", "slope", "intercept")
    return _rounded(R.regression_line(fit, F.lit(0.0), F.lit(100.0), clip=True), "y_lo", "y_hi")


@entry()
def pearson_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    """The p value has no SQL; it is tested against known values."""
    return R.correlations(R.correlation_rows(B.matchups(spark, sf, ranks=False)), _XS, p_values=True)


@entry(f"with {B.MATCHUPS} select Bot_L as Bot, coalesce(min(Rank_L), 9999) as Rank, case when coalesce(min(Rank_L), 9999) <= 5 then 'strong' else 'weak' end as tier, Bot_L || ' (#' || min(Rank_L) || ')' as label from matchups group by Bot_L")
def ranked_domain(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.col("Rank")
    return R.ranked_domain(B.matchups(spark, sf)).select("Bot", "Rank", S.rank_tier(rank).alias("tier"), S.ranked_label(F.col("Bot"), rank).alias("label"))


@entry(f"with {B.MATCHUPS} select Bot, Rank, row_number() over (order by Rank, Bot) as place from (select Bot_L as Bot, coalesce(min(Rank_L), 9999) as Rank from matchups group by Bot_L)")
def ordered_domain(spark: SparkSession, sf: str) -> DataFrame:
    return R.ordered_domain(B.matchups(spark, sf))


@entry("select o_orderkey, floor(rank() over (order by o_totalprice desc) + (count(*) over (partition by o_totalprice) - 1) / 2)::int as Rank from orders where o_totalprice is not null")
def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of all orders by price, ties at their mean rank."""
    return summary.average_rank(B.table(spark, sf, "orders"), "o_totalprice").where("o_totalprice is not null").select("o_orderkey", "Rank")


@entry("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, floor(rank() over (order by l_quantity desc) + (count(*) over (partition by l_quantity) - 1) / 2)::int as Rank from lineitem")
def global_rank_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of all lines by quantity, of which there are fifty: nearly all are ties."""
    return summary.average_rank(B.table(spark, sf, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "Rank")


@entry(f"with {B.MATCHUPS}, g as (select Bot_L as Bot, concat_ws('-', Round, Timer::int) as Config, avg(WinRate_L) as m, stddev_samp(WinRate_L) as s from matchups where (length(Bot_L) + Timer::int // 15) % 3 > 0 group by 1, 2) select b.Bot, c.Config, round(coalesce(m, 0), 6) as mean, round(s, 6) as std from (select distinct Bot from g) b, (select distinct Config from g) c left join g on g.Bot = b.Bot and g.Config = c.Config")
def metric_by_config_filled(spark: SparkSession, sf: str) -> DataFrame:
    """A row for every competitor and setting, 0 where there was no matchup."""
    rows = B.matchups(spark, sf, ranks=False).where((F.length("Bot_L") + F.call_function("div", F.col("Timer").cast("int"), F.lit(15))) % 3 > 0)
    rows = rows.withColumn("Setting", F.concat_ws("-", "Round", F.col("Timer").cast("int").cast("string")))
    return _rounded(R.metric_by_config(rows, "WinRate_L", "Setting", fill=True), "mean", "std")


@entry(f"with {B.MATCHUPS} select Bot, ActInterval, round(avg(WinRate), 6) as mean, count(WinRate) as n, round(coalesce(stddev_samp(WinRate) / sqrt(count(WinRate)), 0), 6) as error, coalesce(min(Rank), 9999) as Rank from bothsides group by 1, 2")
def grouped_error_se(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.grouped_error(B.matchups(spark, sf), error="se"), "mean", "error")


@entry(f"with {B.MATCHUPS} select Bot, Timer, round(avg(WinRate), 6) as mean, count(WinRate) as n, round(coalesce(stddev_samp(WinRate), 0), 6) as error, coalesce(min(Rank), 9999) as Rank from bothsides group by 1, 2")
def grouped_error_std(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.grouped_error(B.matchups(spark, sf), by="Timer", error="std"), "mean", "error")


@entry(f"with {B.MATCHUPS} select distinct Bot_L as Bot from matchups union select distinct Bot_R from matchups")
def unique_competitors(spark: SparkSession, sf: str) -> DataFrame:
    return logs.competitors(B.matchups(spark, sf, ranks=False))


@entry(f"with {B.MATCHUPS} select distinct Timer from matchups")
def distinct_timers(spark: SparkSession, sf: str) -> DataFrame:
    return R.domain(B.matchups(spark, sf, ranks=False), "Timer")


@entry(f"with {_COLLISION_BINS} select GameIndex, TimeBin, 'Tie' as Type, round(avg(Tie), 6) as MeanCount from cfrag group by all")
def collision_intensity_select(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.collision_intensity(collision_timebins(spark, sf), "select", "Tie", by="GameIndex"), "MeanCount")


@entry("""select 'orders' as source, o_orderkey::double as id, o_totalprice as amount, o_orderpriority as note from orders union all select 'lines', l_orderkey::double, l_quantity, l_linenumber::varchar from lineitem
  union all select 'parts', p_retailprice, p_size::double, null from part""")
def union_widened(spark: SparkSession, sf: str) -> DataFrame:
    """Three tables whose columns have different types, in the widest of them."""
    a = B.table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("note"))
    b = B.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("note"), F.lit("lines").alias("source"), F.col("l_orderkey").cast("int").alias("id"), F.col("l_quantity").alias("amount"))
    c = B.table(spark, sf, "part").select(F.lit("parts").alias("source"), F.col("p_retailprice").alias("id"), F.col("p_size").alias("amount"), F.lit(None).alias("note"))
    return logs.union_widened([a, b, c])


# Names, JSON, files


@entry("""select o_orderkey, case when o_orderkey % 10 > 0 then 'A' || (o_custkey % 7) || case when o_orderkey % 3 = 0 then '_vs_X' else '' end end as bot_l, case when o_orderkey % 10 > 0 then 'B' || (o_orderkey % 5) end as bot_r,
  case when o_orderkey % 4 > 0 then o_orderkey % 100 else -1 end as file from orders""")
def matchup_split(spark: SparkSession, sf: str) -> DataFrame:
    """Both names of a folder, split at the last _vs_, or none; and the number of a file's name."""
    key = F.col("o_orderkey")
    left = F.concat(F.lit("A"), (F.col("o_custkey") % 7).cast("string"), F.when(key % 3 == 0, "_vs_X").otherwise(""))
    folder = F.concat(left, F.when(key % 10 > 0, "_vs_").otherwise(" against "), F.lit("B"), (key % 5).cast("string"))
    folder = F.when(key % 10 > 0, folder).otherwise(F.replace(folder, F.lit("_vs_X"), F.lit("")))
    name = F.concat(F.when(key % 4 > 0, "game_").otherwise("log_"), (key % 100).cast("string"), F.lit(".json"))
    a, b = S.matchup_sides(folder)
    return B.table(spark, sf, "orders").select("o_orderkey", a.alias("bot_l"), b.alias("bot_r"), S.file_index(name).cast("long").alias("file"))


@entry("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 4 when 0 then l_tax when 1 then null when 2 then l_partkey::double end as number, case when l_suppkey % 2 = 0 then 'Match Duration' else 'Other' || (l_suppkey % 3) end as name from lineitem""")
def safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as numbers where they are some, and display names of metrics where there are some."""
    text = F.expr("case l_linenumber % 4 when 0 then cast(l_tax as string) when 1 then '' when 2 then cast(l_partkey as string) else 'n/a' end")
    metric = F.when(F.col("l_suppkey") % 2 == 0, "MatchDur").otherwise(F.concat(F.lit("Other"), (F.col("l_suppkey") % 3).cast("string")))
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.safe_double(text).alias("number"), S.metric_name(metric).alias("name"))


@entry("""select p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1)::int as trailing, p_size::double as timer, 'BestOf' || p_size as round, p_brand || ' (#' || p_size || ')' as label, p_brand as name, p_size as rank,
  'Stone' as skill, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part""")
def config_parse(spark: SparkSession, sf: str) -> DataFrame:
    part = B.table(spark, sf, "part")
    part = part.withColumn("cfg", F.concat(F.lit("Timer_"), "p_size", F.lit("__ActInterval_0.1__Round_BestOf"), "p_size", F.lit("__SkillLeft_Stone__Bare")))
    label = S.ranked_label(F.col("p_brand"), F.col("p_size"))
    return part.select(
        "p_partkey", S.trailing_number(F.col("p_brand")).alias("trailing"), S.timer_of(F.col("cfg")).alias("timer"), S.config_map(F.col("cfg"))["Round"].alias("round"),
        label.alias("label"), S.label_name(label).alias("name"), S.label_rank(label).alias("rank"), S.config_map(F.col("cfg"))["SkillLeft"].alias("skill"), S.slug(F.col("p_name")).alias("slug"),
    )


@entry("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, try_cast(event_type as bigint) as bad, case when event_type <> 'view' then event_type end as reason from events")
def props_coerced(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").withColumn("p", F.from_json("props", "k string"))
    reason = F.when(F.col("event_type") == "view", "None").otherwise(F.col("event_type"))
    return e.select("event_id", S.safe_long(F.col("p.k")).alias("k"), S.safe_long(F.col("event_type")).alias("bad"), S.safe_text(reason).alias("reason"))


@entry(f"with {B.MATCHUPS} select Bot_L, Bot_R, Timer, ActInterval, Round, SkillLeft, SkillRight, Games, Winner_L, Winner_R, {_r('WinRate_L', 'WinRate_R', 'MatchDur')}, Rank_L, Rank_R from matchups")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The matchup summary, written as one CSV file to the shared folder, and read again."""
    rows = B.matchups(spark, sf).select("Bot_L", "Bot_R", *R.CONFIG, "Games", "Winner_L", "Winner_R", "WinRate_L", "WinRate_R", "MatchDur", "Rank_L", "Rank_R")
    logs.write_summary(rows, path := shared_folder(spark))
    return _rounded(logs.read_summary(spark, path, rows.schema), "WinRate_L", "WinRate_R", "MatchDur")


@entry("select r_regionkey, r_name from region where r_regionkey >= 2")
def pending_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What a resumed load still has to do, after an earlier one wrote the first two."""
    region = B.table(spark, sf, "region").select("r_regionkey", "r_name")
    return loads.pending(region, region.where("r_regionkey < 2"), "r_regionkey").select("r_regionkey", "r_name")


@entry("select n_regionkey as matchup, n_nationkey as config from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) where k <= 2")
def limit_configs(spark: SparkSession, sf: str) -> DataFrame:
    nation = B.table(spark, sf, "nation").select(F.col("n_regionkey").alias("matchup"), F.col("n_nationkey").alias("config"))
    return logs.limit_configs(nation, 2)
