"""State sequences: one row for each character and step, and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.model import CHARS, ROOMS

#: Rooms of the event types; a character is in the first room until its first event.
EVENT_ROOMS = dict(zip(["lobby", "signup", "purchase", "error", "click", "view"], ROOMS, strict=True))


def named(ordinal: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), ordinal.cast("int") + 1)


def ordinal(name: Column, names: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), name) - 1).cast("int")


def _filled(cells: DataFrame, chars: list[str], default: str) -> DataFrame:
    """State from one row for each step and character, whose room is null where it didn't move."""
    order = Window.partitionBy("seq_id", "ch_ord").orderBy("step_id").rowsBetween(Window.unboundedPreceding, 0)
    room = F.coalesce(F.last("room", ignorenulls=True).over(order), F.lit(default))
    return cells.select("seq_id", "step_id", "ch_ord", named(F.col("ch_ord"), chars).alias("ch"), room.alias("room"))


def forward_filled(moves: DataFrame, length: int, chars: list[str] = CHARS, default: str = ROOMS[0]) -> DataFrame:
    """state(seq_id, step_id, ch_ord, ch, room) from moves (seq_id, step_id, ch_ord, room): the last room of each character at each step."""
    grid = moves.select("seq_id").distinct().withColumn("step_id", F.explode(F.sequence(F.lit(1), F.lit(length)))).withColumn("ch_ord", F.explode(F.sequence(F.lit(0), F.lit(len(chars) - 1))))
    return _filled(grid.join(moves, ["seq_id", "step_id", "ch_ord"], "left"), chars, default)


def _by_sequence(rows: DataFrame) -> DataFrame:
    """The one shuffle of everything that follows: all later grouping is by seq_id and more, which this partitioning serves.

    Its number of parts is fixed: a few bytes of moves become many of states and texts, so parts that were put together
    by the size of moves would be few and large.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id")


def _sequence_of(length: int) -> Column:
    return F.floor(F.col("event_id") / length).cast("long").alias("seq_id")


def _moves(events: DataFrame, length: int) -> DataFrame:
    room = F.create_map(*(F.lit(x) for kv in EVENT_ROOMS.items() for x in kv))[F.col("event_type")]
    return _by_sequence(events.select(_sequence_of(length), (F.col("event_id") % length + 1).cast("int").alias("step_id"), (F.col("user_id") % len(CHARS)).cast("int").alias("ch_ord"), room.alias("room")))


def sequences_of_events(events: DataFrame, length: int = 32) -> DataFrame:
    """seq_id of the full sequences of moves_of_events, by counts alone."""
    return _by_sequence(events.select(_sequence_of(length))).groupBy("seq_id").agg(F.count("*").alias("n")).where(F.col("n") == length).select("seq_id")


def moves_of_events(events: DataFrame, length: int = 32) -> DataFrame:
    """seq_id, step_id, ch_ord, room: `length` consecutive event ids are a sequence with a move a step; only full sequences count."""
    return _moves(events, length).withColumn("n", F.count("*").over(Window.partitionBy("seq_id"))).where(F.col("n") == length).drop("n")


def steps_of_events(events: DataFrame, length: int = 32) -> DataFrame:
    """seq_id, step_id, rooms: where each character is, in their order. One sort of the moves tells full sequences and last rooms."""
    order = Window.partitionBy("seq_id").orderBy("step_id")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = [F.coalesce(F.last(F.when(F.col("ch_ord") == k, F.col("room")), ignorenulls=True).over(so_far), F.lit(ROOMS[0])).alias(f"r{k}") for k in range(len(CHARS))]
    steps = _moves(events, length).select("seq_id", "step_id", F.count("*").over(whole).alias("n"), *last).where(F.col("n") == length)
    return steps.select("seq_id", "step_id", F.array(*(F.col(f"r{k}") for k in range(len(CHARS)))).alias("rooms"))


def _cells_of_steps(steps: DataFrame, company: bool = False) -> DataFrame:
    """A row for each character of a step; with n, how many are in its room, if `company`."""
    at = [F.get("rooms", F.lit(k)) for k in range(len(CHARS))]
    n = lambda k: [sum((F.coalesce(at[k] == x, F.lit(False)).cast("long") for x in at), F.lit(0).cast("long")).alias("n")] if company else []
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ch_ord"), F.lit(c).alias("ch"), at[k].alias("room"), *n(k)) for k, c in enumerate(CHARS)))).alias("x")
    return steps.select("seq_id", "step_id", each).select("seq_id", "step_id", "x.*")


def state_of_moves(moves: DataFrame, chars: list[str] = CHARS, default: str = ROOMS[0]) -> DataFrame:
    """State where every step has exactly one move: a step's row for each character needs no join."""
    cells = moves.select("seq_id", "step_id", "ch_ord", "room", F.explode(F.sequence(F.lit(0), F.lit(len(chars) - 1))).alias("k"))
    return _filled(cells.select("seq_id", "step_id", F.col("k").alias("ch_ord"), F.when(F.col("k") == F.col("ch_ord"), F.col("room")).alias("room")), chars, default)


def state_of_events(events: DataFrame, length: int = 32) -> DataFrame:
    return _cells_of_steps(steps_of_events(events, length))


def binding_columns(length: int, ranged: bool = False, n_crowd: int = 3) -> dict[str, Column]:
    """Bindings of a sequence as data, by its id alone: two characters, two rooms, a step, most or least, a range of steps."""
    s, c, r = F.col("seq_id"), len(CHARS), len(ROOMS)
    c0, r0 = s % c, s % r
    c1 = (c0 + 1 + F.floor(s / c) % (c - 1)) % c
    r1 = (r0 + 1 + F.floor(s / r) % (r - 1)) % r
    return {
        "c0": named(c0, CHARS),
        "c1": named(c1, CHARS),
        "r0": named(r0, ROOMS),
        "r1": named(r1, ROOMS),
        "frame": (s * 7 % length + 1).cast("int"),
        "is_more": s % 2 == 0,
        "f0": (s % 8 + 1 if ranged else F.lit(1)).cast("int"),
        "f1": (length - s % 5 if ranged else F.lit(length)).cast("int"),
        "n_crowd": F.lit(n_crowd),
    }


def params_of(sequences: DataFrame, length: int, ranged: bool = False, n_crowd: int = 3) -> DataFrame:
    """Bindings of every sequence. `sequences` needs a column seq_id; moves will do, so that no state is computed for it."""
    return sequences.select("seq_id").distinct().withColumns(binding_columns(length, ranged, n_crowd))


def world_of_events(events: DataFrame, length: int = 32, ranged: bool = False) -> World:
    steps = steps_of_events(events, length)
    bind = lambda df: df.withColumns(binding_columns(length, ranged))
    return World(_cells_of_steps(steps), bind(sequences_of_events(events, length)), length, bind=bind, steps=steps)


@dataclass(frozen=True)
class World:
    """State, bindings and dimensions that every query is asked of. Where bindings follow from the id alone, `bind` adds them to a table without a join; `steps` has the state by step, if it comes from such a table."""

    state: DataFrame
    param: DataFrame
    length: int = 32
    chars: tuple[str, ...] = tuple(CHARS)
    rooms: tuple[str, ...] = tuple(ROOMS)
    bind: Callable[[DataFrame], DataFrame] | None = None
    steps: DataFrame | None = None

    def with_param(self, rows: DataFrame) -> DataFrame:
        """`rows` (seq_id, ...) with the bindings of their sequences."""
        return self.bind(rows) if self.bind else rows.join(self.param, "seq_id")

    @property
    def bound(self) -> DataFrame:
        return self.with_param(self.state)

    @property
    def company(self) -> DataFrame:
        """The state with n, how many are in the same room at the step; by steps no window has to sort it."""
        if self.steps is not None:
            return _cells_of_steps(self.steps, company=True)
        return self.state.withColumn("n", F.count("*").over(Window.partitionBy("seq_id", "step_id", "room")))

    @property
    def occ(self) -> DataFrame:
        """seq_id, step_id, room, n, who: occupied cells; who is the sole occupant if n is 1."""
        return self.state.groupBy("seq_id", "step_id", "room").agg(F.count("*").alias("n"), F.min("ch").alias("who"))

    def each(self, names: tuple[str, ...], key: str) -> DataFrame:
        """A row for each sequence and name, so that zeros take part."""
        return self.param.withColumn(key, F.explode(F.array(*map(F.lit, names))))


def wide(state: DataFrame, chars: list[str] = CHARS) -> DataFrame:
    return state.groupBy("seq_id", "step_id").pivot("ch", chars).agg(F.first("room"))


def _entries(occupants: Column, rooms: list[str]) -> Column:
    """Map from each configured room to its occupants in character order, of an array of (ch_ord, ch, room)."""

    def entry(room: str) -> Column:
        return F.struct(F.lit(room).alias("key"), F.transform(F.filter(occupants, lambda x: x["room"] == room), lambda x: x["ch"]).alias("value"))

    return F.map_from_entries(F.array(*map(entry, rooms)))


def rooms_map(state: DataFrame, rooms: list[str] = ROOMS) -> DataFrame:
    """seq_id, step_id, rooms: map from each configured room to its occupants in character order."""
    at = F.array_sort(F.collect_list(F.struct("ch_ord", "ch", "room")))
    steps = state.groupBy("seq_id", "step_id").agg(at.alias("at"))
    return steps.select("seq_id", "step_id", _entries(F.col("at"), rooms).alias("rooms"))


def sequences(state: DataFrame, rooms: list[str] = ROOMS) -> DataFrame:
    """seq_id, sequence: the steps of a sequence as an ordered array of (step_id, rooms)."""
    steps = rooms_map(state, rooms)
    entries = F.map_entries("rooms")
    ordered = F.array_sort(F.collect_list(F.struct("step_id", entries.alias("e"))))
    return steps.groupBy("seq_id").agg(ordered.alias("s")).select("seq_id", F.transform("s", lambda x: F.struct(x["step_id"].alias("step_id"), F.map_from_entries(x["e"]).alias("rooms"))).alias("sequence"))
