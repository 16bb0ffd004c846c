"""Game logs whose events have keys that no schema knows: read as variants, with a column for each key found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import LINES, flattened, game_type, with_layout
from .schema import DATA, EVENT, EVENTS
from .shared import shared_folder, written

#: More different keys than that are taken for values used as keys.
MAX_KEYS = 1000


def read_texts(spark: SparkSession, root: str | list[str], lines: bool = False, pattern: str | None = None) -> DataFrame:
    """json, source_file, matchup, config and dimensions of each game document, as logs.read_games finds them."""
    texts = spark.read.text(root, wholetext=not lines, recursiveFileLookup=True, pathGlobFilter=pattern or (LINES if lines else "game_*.json"))
    games = with_layout(texts.select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("_path")), F.col("_path")).drop("_path")
    return games.where(F.col("config").startswith("Timer_"))


def _events(games: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of flatten_games before projection, with each event's variant (ev) beside its struct (e); with `columns` e has what those are made of."""
    rest = [c for c in games.columns if c != "json"]
    kind = game_type(columns)
    own = {k: v for k, v in {"Index": "g", "Timestamp": "gt", "Winner": "gw"}.items() if k in kind.names}
    of_round = [k for k in kind["Rounds"].dataType.elementType.names if k != "PlayerEvents"]
    parsed = games.select(*rest, F.from_json("json", kind).alias("_g"), F.try_parse_json("json").alias("_v"))
    variants = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    rounds = parsed.select(*rest, *[F.col(f"_g.{k}").alias(v) for k, v in own.items()], F.posexplode(F.arrays_zip(F.col("_g.Rounds").alias("r"), variants(F.col("_v"), "$.Rounds").alias("rv"))).alias("round_pos", "_r"))
    rest += [*own.values(), "round_pos"]
    rounds = rounds.select(*rest, F.col("_r.r").alias("r"), F.col("_r.rv").alias("_rv"))
    both = F.arrays_zip(F.col("r.PlayerEvents").alias("e"), variants(F.col("_rv"), "$.PlayerEvents").alias("ev"))
    rest += ["r"] if of_round else []
    events = rounds.select(*[F.col("r").dropFields("PlayerEvents").alias("r") if c == "r" else c for c in rest], F.posexplode(both).alias("event_pos", "_e"))
    return events.select(*rest, "event_pos", F.col("_e.e").alias("e"), F.col("_e.ev").alias("ev"))


def _text(value: Column) -> Column:
    """A variant as text: objects and lists as JSON; null for null."""
    return F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def _unseen(v: Column, path: str, known: Sequence[str]) -> Column:
    """The keys of an object within a variant, without known ones, and the texts of their values; null if there is no object."""
    known_ = F.array(*[F.lit(k) for k in known])
    return F.transform_values(F.map_filter(F.try_variant_get(v, path, "map<string,variant>"), lambda k, _: ~F.array_contains(known_, k)), lambda _, x: _text(x))


#: Where unseen keys are looked for, and which are known there.
PLACES = {"$": EVENT.names, "$.Data": DATA.names}


def _found(events: DataFrame) -> list[tuple[str, str]]:
    """(place, key) of all keys in the columns named by PLACES, in order."""
    named = lambda place: F.transform(F.coalesce(F.map_keys(F.col(f"`{place}`")), F.array().cast("array<string>")), lambda k: F.struct(F.lit(place).alias("place"), k.alias("key")))
    keys = events.select(F.explode(F.concat(*[named(p) for p in PLACES])).alias("k")).select("k.place", "k.key").distinct().limit(MAX_KEYS + 1).collect()
    if len(keys) > MAX_KEYS:
        raise ValueError(f"events have over {MAX_KEYS} different keys")
    return sorted((r.place, r.key) for r in keys)


def _with_unseen(events: DataFrame) -> DataFrame:
    """events with a column for each of PLACES, the unseen keys there, in place of ev."""
    return events.withColumns({p: _unseen(F.col("ev"), p, known) for p, known in PLACES.items()}).drop("ev")


def unseen_keys(games: DataFrame) -> list[tuple[str, str]]:
    """(place, key) of all keys of events ($) and of their data ($.Data) that the schema doesn't know, in order; one pass over all games."""
    return _found(_with_unseen(flattened(_events(games, []), ["ev"], [])))


def flatten_all(games: DataFrame, keys: Sequence[tuple[str, str]] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The event table of games (read_texts) with a text column for each key that the schema doesn't know.

    A column has its key's name, with underscores added where another column has that name, case apart. Values that are
    objects or lists are JSON; of null and where an event lacks the key they are null. Documents that aren't JSON give no
    rows. Without `keys` games are read once, and the events written to the shared folder, where their keys are found. With
    `columns` only those event columns are there.
    """
    rest = [c for c in games.columns if c != "json"]
    table = flattened(_events(games, columns), [*rest, "ev"], columns)
    shown = [c for c in table.columns if c != "ev"]
    if keys is None:
        table = written(_with_unseen(table), shared_folder(games.sparkSession))
        keys = _found(table)
        value = lambda place, key: F.try_element_at(F.col(f"`{place}`"), F.lit(key))
    else:
        value = lambda place, key: _text(F.try_variant_get("ev", f"{place}['{key}']" if "'" not in key else f'{place}["{key}"]', "variant"))
    used = {c.lower() for c in [*EVENTS.names, *shown, "ev"]}
    found = []
    for place, key in keys:
        name = key
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(value(place, key).alias(name))
    return table.select(*shown, *found)
