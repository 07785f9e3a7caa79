"""The 24 queries over state sequences.

Each builder takes a World and returns (answers, cells): seq_id, answer, valid of every sequence, and the cells
(seq_id, step_id, room) that support the answer. An answer is null where the query has none; a tie for the most or
least is none, and what never happens counts as zero and takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.model import NOBODY
from stepfold.plans.state import World

Result = tuple[DataFrame, DataFrame]


def _answers(world: World, found: DataFrame, answer: Column, valid: Column) -> DataFrame:
    ok = F.coalesce(valid, F.lit(False))
    return world.param.select("seq_id").join(found, "seq_id", "left").select("seq_id", F.when(ok, answer.cast("string")).alias("answer"), ok.alias("valid"))


def _cells(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("seq_id", "step_id", "room")
    for p in parts[1:]:
        out = out.unionByName(p.select("seq_id", "step_id", "room"))
    return out.where("room is not null").distinct()


def _end(inv: bool) -> Callable[..., Column]:
    return F.max_by if inv else F.min_by


def app(world: World, inv: bool) -> Result:
    found = world.bound.where("ch = c0").groupBy("seq_id").agg(_end(inv)(F.struct("step_id", "room"), "step_id").alias("x")).select("seq_id", "x.*")
    return _answers(world, found, F.col("room"), F.col("room").isNotNull()), _cells(found)


def _event(world: World, who: str, where: str, inv: bool) -> DataFrame:
    """seq_id, step_id at which a character is first or last in a room."""
    return world.bound.where(F.col("ch") == F.col(who)).where(F.col("room") == F.col(where)).groupBy("seq_id").agg((F.max if inv else F.min)("step_id").alias("step_id"))


def char_on_char(world: World, inv: bool) -> Result:
    event = _event(world, "c1", "r0", inv)
    found = world.bound.where("ch = c0").join(event, ["seq_id", "step_id"]).select("seq_id", "step_id", "room", "r0")
    return _answers(world, found, F.col("room"), F.col("room").isNotNull()), _cells(found, found.select("seq_id", "step_id", F.col("r0").alias("room")))


def char_at_frame(world: World) -> Result:
    found = world.bound.where("ch = c0 and step_id = frame")
    return _answers(world, found.select("seq_id", "room"), F.col("room"), F.col("room").isNotNull()), _cells(found)


def at_room(world: World, inv: bool, strict_reference: bool = False) -> Result:
    """strict_reference also rejects a sole occupant at the first (last) step of a sequence without any shared step in the room."""
    seen = world.with_param(world.occ).where("room = r0").groupBy("seq_id").agg(_end(inv)(F.struct("step_id", "room", "n", "who"), "step_id").alias("x"), F.max("n").alias("most")).select("seq_id", "most", "x.*")
    ok = F.coalesce(F.col("n"), F.lit(1)) == 1
    if strict_reference:
        edge = F.col("step_id") == (world.length if inv else 1)
        ok = ok & ~F.coalesce(edge & (F.col("most") == 1), F.lit(False))
    return _answers(world, seen, F.coalesce("who", F.lit(NOBODY)), ok), _cells(seen)


def _occupants(world: World, at: DataFrame, room: str) -> DataFrame:
    """`at` (seq_id, step_id and bindings) with n and who of the room there; n is 0 in an empty one."""
    return at.join(world.occ.withColumnRenamed("room", room), ["seq_id", "step_id", room], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _sole(world: World, at: DataFrame) -> DataFrame:
    return _answers(world, at.select("seq_id", "n", "who"), F.when(F.col("n") == 0, NOBODY).otherwise(F.col("who")), F.col("n") <= 1)


def _on_char(world: World, inv: bool) -> tuple[DataFrame, DataFrame]:
    at = _occupants(world, world.with_param(_event(world, "c0", "r1", inv)), "r0")
    return at, _cells(at.select("seq_id", "step_id", F.col("r0").alias("room")), at.select("seq_id", "step_id", F.col("r1").alias("room")))


def room_on_char(world: World, inv: bool) -> Result:
    at, cells = _on_char(world, inv)
    return _sole(world, at), cells


def n_room_on_char(world: World, inv: bool) -> Result:
    at, cells = _on_char(world, inv)
    return _answers(world, at.select("seq_id", "n"), F.col("n"), F.col("n").isNotNull()), cells


def _framed(world: World) -> DataFrame:
    return world.param.withColumn("step_id", F.col("frame"))


def room_at_frame(world: World) -> Result:
    at = _occupants(world, _framed(world), "r0")
    return _sole(world, at), _cells(at.select("seq_id", "step_id", F.col("r0").alias("room")))


def _company(world: World) -> DataFrame:
    """The room of c0 at the step, how many others are there and one of them."""
    mine = world.bound.where("ch = c0 and step_id = frame").select("seq_id", "step_id", "room", "c0")
    other = world.state.select("seq_id", "step_id", "room", "ch")
    return mine.join(other, ["seq_id", "step_id", "room"]).groupBy("seq_id", "step_id", "room").agg(F.count_if(F.col("ch") != F.col("c0")).alias("n"), F.min(F.when(F.col("ch") != F.col("c0"), F.col("ch"))).alias("who"))


def char_on_char_at_frame(world: World) -> Result:
    at = _company(world)
    return _sole(world, at), _cells(at)


def n_char_at_frame(world: World) -> Result:
    at = _company(world)
    return _answers(world, at.select("seq_id", "n"), F.col("n"), F.lit(True)), _cells(at)


def n_empty(world: World) -> Result:
    grid = _occupants(world, world.each(world.rooms, "room").withColumn("step_id", F.col("frame")), "room")
    found = grid.groupBy("seq_id").agg(F.count_if(F.col("n") == 0).alias("n"))
    cells = grid.join(found.withColumnRenamed("n", "empty"), "seq_id").where("n = 0 or empty = 0")
    return _answers(world, found, F.col("n"), F.lit(True)), _cells(cells)


def unique_extremum(counts: DataFrame, key: str, most: Column) -> DataFrame:
    """seq_id, answer, n_tied: the key with the most or least n of its sequence, and how many share it."""
    by = Window.partitionBy("seq_id")
    best = F.when(most, F.max("n").over(by)).otherwise(F.min("n").over(by))
    return counts.withColumn("best", best).where("n = best").groupBy("seq_id").agg(F.min(key).alias("answer"), F.count("*").alias("n_tied"))


def _in_range(df: DataFrame) -> DataFrame:
    return df.where("step_id between f0 and f1")


def _counted(world: World, names: tuple[str, ...], key: str, hits: DataFrame) -> DataFrame:
    """How many rows of `hits` (seq_id, key) each name has, zeros too."""
    n = hits.groupBy("seq_id", key).agg(F.count("*").alias("n"))
    return world.each(names, key).join(n, ["seq_id", key], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _extreme(world: World, counts: DataFrame, key: str, most: Column | None = None, allowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers, and those that are valid with their bindings. counts has every sequence, so none is missing from the answers."""
    found = world.with_param(unique_extremum(counts, key, F.col("is_more") if most is None else most))
    ok = F.col("n_tied") == 1
    if allowed is not None:
        ok = ok & allowed
    answers = found.select("seq_id", F.when(ok, F.col("answer").cast("string")).alias("answer"), ok.alias("valid"))
    return answers, found.where(ok)


def _steps(of: DataFrame, room: str) -> DataFrame:
    return of.select("seq_id", F.col(room).alias("room"), F.explode(F.sequence("f0", "f1")).alias("step_id"))


def room_empty(world: World) -> Result:
    used = _in_range(world.with_param(world.occ)).select("seq_id", "room")
    counts = _counted(world, world.rooms, "room", used).withColumn("n", F.col("f1") - F.col("f0") + 1 - F.col("n"))
    answers, won = _extreme(world, counts, "room")
    return answers, _cells(_steps(won, "answer"))


def where_spend(world: World) -> Result:
    own = _in_range(world.bound.where("ch = c0"))
    counts = _counted(world, world.rooms, "room", own.select("seq_id", "room"))
    answers, won = _extreme(world, counts, "room", allowed=F.col("is_more") | (len(world.rooms) - (F.col("f1") - F.col("f0") + 1) <= 1))
    return answers, _cells(own.join(won.select("seq_id", F.col("answer").alias("room")), ["seq_id", "room"]))


def crowded_room(world: World) -> Result:
    crowds = _in_range(world.with_param(world.occ)).where("n >= n_crowd").select("seq_id", "step_id", "room")
    answers, won = _extreme(world, _counted(world, world.rooms, "room", crowds.select("seq_id", "room")), "room", F.lit(True))
    return answers, _cells(crowds.join(won.select("seq_id", F.col("answer").alias("room")), ["seq_id", "room"]))


def who_spend(world: World) -> Result:
    hits = _in_range(world.bound.where("room = r0")).select("seq_id", "ch")
    answers, won = _extreme(world, _counted(world, world.chars, "ch", hits), "ch")
    return answers, _cells(_steps(won, "r0"))


def spend_alone(world: World) -> Result:
    alone = _in_range(world.with_param(world.occ.where("n = 1"))).select("seq_id", "step_id", "room", F.col("who").alias("ch"))
    answers, won = _extreme(world, _counted(world, world.chars, "ch", alone.select("seq_id", "ch")), "ch", allowed=F.col("is_more") | (F.col("f1") - F.col("f0") >= 2))
    return answers, _cells(alone.join(won.select("seq_id", F.col("answer").alias("ch")), ["seq_id", "ch"]))


def spend_together(world: World) -> Result:
    # where c0 is, told to each row of its step within the one partitioning by sequence
    mine = F.max(F.when(F.col("ch") == F.col("c0"), F.col("room"))).over(Window.partitionBy("seq_id", "step_id"))
    both = _in_range(world.bound).withColumn("mine", mine).where("room = mine and ch <> c0").select("seq_id", "step_id", "room", "c0", "ch")
    answers, won = _extreme(world, _counted(world, world.chars, "ch", both.select("seq_id", "ch")).where("ch <> c0"), "ch")
    return answers, _cells(both.join(won.select("seq_id", F.col("answer").alias("ch")), ["seq_id", "ch"]))


def steps_in_room(world: World) -> Result:
    own = _in_range(world.bound.where("ch = c0 and room = r0"))
    return _answers(world, own.groupBy("seq_id").agg(F.count("*").alias("n")), F.coalesce("n", F.lit(0)), F.lit(True)), _cells(own)


def rooms_visited(world: World) -> Result:
    first = _in_range(world.bound.where("ch = c0")).groupBy("seq_id", "room").agg(F.min("step_id").alias("step_id"))
    return _answers(world, first.groupBy("seq_id").agg(F.count("*").alias("n")), F.coalesce("n", F.lit(0)), F.lit(True)), _cells(first)


def crowd_count(world: World) -> Result:
    crowds = _in_range(world.with_param(world.occ)).where("n >= n_crowd")
    return _answers(world, crowds.groupBy("seq_id").agg(F.countDistinct("step_id").alias("n")), F.coalesce("n", F.lit(0)), F.lit(True)), _cells(crowds)


QUESTIONS: dict[str, Callable[[World], Result]] = {
    "first_app": lambda w: app(w, False),
    "final_app": lambda w: app(w, True),
    "char_on_char_first_app": lambda w: char_on_char(w, False),
    "char_on_char_final_app": lambda w: char_on_char(w, True),
    "char_at_frame": char_at_frame,
    "first_at_room": lambda w: at_room(w, False),
    "last_at_room": lambda w: at_room(w, True),
    "room_on_char_first_app": lambda w: room_on_char(w, False),
    "room_on_char_final_app": lambda w: room_on_char(w, True),
    "room_at_frame": room_at_frame,
    "char_on_char_at_frame": char_on_char_at_frame,
    "n_room_on_char_first_app": lambda w: n_room_on_char(w, False),
    "n_room_on_char_final_app": lambda w: n_room_on_char(w, True),
    "n_char_at_frame": n_char_at_frame,
    "n_empty": n_empty,
    "room_empty": room_empty,
    "where_spend": where_spend,
    "crowded_room": crowded_room,
    "who_spend": who_spend,
    "spend_alone": spend_alone,
    "spend_together": spend_together,
    "steps_in_room": steps_in_room,
    "rooms_visited": rooms_visited,
    "crowd_count": crowd_count,
}
DENSE = list(QUESTIONS)[15:]
