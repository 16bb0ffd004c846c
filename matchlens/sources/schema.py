"""Types of game logs, of the flat event table and of the CSV summaries."""

from __future__ import annotations

from pyspark.sql import types as T

L, D, S = T.LongType(), T.DoubleType(), T.StringType()

# The actions, sides and snapshots that the tables' column names are made of.
ACTIONS = ["Accelerate", "TurnLeft", "TurnRight", "Dash", "SkillBoost", "SkillStone"]
SIDES = ["L", "R"]
SNAPSHOTS = ["Bot", "EnemyBot", "ColBot", "ColEnemyBot"]
DIMENSIONS = ["Bot_L", "Bot_R", "Timer", "ActInterval", "Round", "SkillLeft", "SkillRight"]
TOTALS = ["Duration_L", "Duration_R", "ActionCounts_L", "ActionCounts_R", "TotalActions", "Collisions_L", "Collisions_R", "Collisions_Tie"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ROBOT = _struct(Position=_struct(X=D, Y=D), LinearVelocity=D, AngularVelocity=D, Rotation=D, IsDashActive=T.BooleanType(), IsSkillActive=T.BooleanType(), IsOutFromArena=T.BooleanType())
DATA = _struct(Name=S, Duration=D, Reason=S, Robot=ROBOT, EnemyRobot=ROBOT, IsActor=T.BooleanType(), Impact=D, IsTieBreaker=T.BooleanType(), LockDuration=D)
EVENT = _struct(StartedAt=D, UpdatedAt=D, Actor=S, Target=S, Category=S, State=S, Data=DATA)
ROUND = _struct(Index=L, Timestamp=S, Winner=S, PlayerEvents=T.ArrayType(EVENT))
GAME = _struct(Index=L, Timestamp=S, Winner=S, Rounds=T.ArrayType(ROUND))

_PARTS = {"PosX": D, "PosY": D, "Linv": D, "Angv": D, "Rot": D, "IsDashActive": L, "IsSkillActive": L, "IsOutFromArena": L}
EVENTS = T.StructType(
    [T.StructField(k, v) for k, v in {"GameIndex": L, "GameWinner": L, "GameTimestamp": S, "RoundIndex": L, "RoundWinner": L, "RoundTimestamp": S}.items()]
    + [T.StructField(k, v) for k, v in {"StartedAt": D, "UpdatedAt": D, "Actor": L, "Target": L, "Category": S, "State": S, "Name": S, "Duration": D, "Reason": S}.items()]
    + [T.StructField(f"{prefix}{k}", v) for prefix in SNAPSHOTS for k, v in _PARTS.items()]
    + [T.StructField(k, v) for k, v in {"ColActor": L, "ColImpact": D, "ColTieBreaker": L, "ColLockDuration": D}.items()]
)
#: What the event table keeps: the events, the game's file, the places of round and event in it, and the folders' names.
STORED = T.StructType(EVENTS.fields + [T.StructField(k, v) for k, v in {"source_file": S, "round_pos": T.IntegerType(), "event_pos": T.IntegerType(), "matchup": S, "config": S}.items()])

_ROBOT_PARTS = {"PosX": "Position.X", "PosY": "Position.Y", "Linv": "LinearVelocity", "Angv": "AngularVelocity", "Rot": "Rotation"}
#: The parts of a game document that each event column is made of.
PATHS = (
    {"GameIndex": ["Index"], "GameWinner": ["Winner"], "GameTimestamp": ["Timestamp"], "RoundIndex": ["Rounds.Index"], "RoundWinner": ["Rounds.Winner"], "RoundTimestamp": ["Rounds.Timestamp"]}
    | {k: [f"Rounds.PlayerEvents.{k}"] for k in ("StartedAt", "UpdatedAt", "Actor", "Target", "Category", "State")}
    | {k: [f"Rounds.PlayerEvents.Data.{k}"] for k in ("Name", "Duration", "Reason")}
    | {f"{prefix}{k}": [f"Rounds.PlayerEvents.Data.{prefix.removeprefix('Col').removesuffix('Bot')}Robot.{_ROBOT_PARTS.get(k, k)}"] for prefix in SNAPSHOTS for k in _PARTS}
    | {f"Col{k}": [f"Rounds.PlayerEvents.Data.{v}"] for k, v in {"Actor": "IsActor", "Impact": "Impact", "TieBreaker": "IsTieBreaker", "LockDuration": "LockDuration"}.items()}
)


def narrowed(kind: T.DataType, paths: set[str]) -> T.DataType:
    """A type with the parts at the given paths only; a part that a path ends at is whole."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(narrowed(kind.elementType, paths))
    if not isinstance(kind, T.StructType) or "" in paths:
        return kind
    below = {f.name: {p.partition(".")[2] for p in paths if p.partition(".")[0] == f.name} for f in kind.fields}
    return T.StructType([T.StructField(f.name, narrowed(f.dataType, below[f.name])) for f in kind.fields if below[f.name]])
