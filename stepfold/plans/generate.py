"""Generated sequences: random moves by hash of the seed, so that any partitioning gives the same rows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.functions import wording
from stepfold.model import GenerationConfig, atype
from stepfold.operators.questions import QUESTIONS
from stepfold.plans import records
from stepfold.plans.controlled import controlled, controlled_for
from stepfold.plans.state import World, named, sequences

__all__ = ["bindings", "comparison", "controlled", "controlled_for", "count_by_length", "draw", "forced_more", "hashed", "in_context_examples", "questions", "random_params", "sampled_steps", "samples", "states"]

#: Sequences that are made at first for each one that is wanted, as ties are rejected, and how many times more if a cell is short.
OVERSAMPLE, GROWTH = 4, 4
#: Ids of the sequences of one length.
STRIDE = 1 << 32
#: Lengths up to which a type is only asked for the most.
FORCED = {"where_spend": 4, "spend_alone": 2}
#: A cell that is still short of questions after so many sequences is an error, never a short result.
LIMIT = 1 << 20


def draw(n: int, seed: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("int")


def numbered_sequences(spark: SparkSession, n: int, lengths: list[int], first: int = 0) -> DataFrame:
    """seq_id, seq_len of n sequences of each length; ids of a length start at its place in the list times STRIDE."""
    rows = spark.range(n * len(lengths))
    place = F.floor(F.col("id") / n)
    return rows.select((place * STRIDE + F.col("id") % n + first).cast("long").alias("seq_id"), F.element_at(F.array(*map(F.lit, lengths)), place.cast("int") + 1).alias("seq_len"))


def states_of(rows: DataFrame, config: GenerationConfig, one_move: bool = True) -> DataFrame:
    """state of sequences (seq_id, seq_len). Each step one character moves to another room: rooms are running sums of non-zero offsets."""
    c, r, seed = len(config.chars), len(config.rooms), config.seed
    grid = rows.select("seq_id", "seq_len", F.explode(F.sequence(F.lit(1), F.col("seq_len"))).alias("step_id")).withColumn("ch_ord", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    any_room = draw(r, seed, F.lit("at"), "seq_len", "seq_id", "step_id", "ch_ord")
    if one_move:
        moves = (F.col("step_id") > 1) & (draw(c, seed, F.lit("who"), "seq_len", "seq_id", "step_id") == F.col("ch_ord"))
        offset = F.when(F.col("step_id") == 1, any_room).when(moves, 1 + draw(max(1, r - 1), seed, F.lit("to"), "seq_len", "seq_id", "step_id")).otherwise(0)
        any_room = F.pmod(F.sum(offset).over(Window.partitionBy("seq_id", "ch_ord").orderBy("step_id")), F.lit(r))
    return grid.select("seq_id", "step_id", "ch_ord", named(F.col("ch_ord"), config.chars).alias("ch"), named(any_room, config.rooms).alias("room"))


def states(spark: SparkSession, n: int, length: int, config: GenerationConfig, one_move: bool = True) -> DataFrame:
    """state of n sequences of one length."""
    return states_of(numbered_sequences(spark, n, [length]), config, one_move)


def sampled_steps(length: int | Column, fraction: float, *keys: Column | str, seed: int = 0) -> tuple[Column, Column, Column]:
    """First and last step of a stretch of a sequence's steps, from 1, and how a question about it ends."""
    length = F.lit(length) if isinstance(length, int) else length
    n = F.greatest(F.lit(1), F.bround(length * fraction).cast("int"))
    first = (F.pmod(F.xxhash64(F.lit(seed), F.lit("steps"), *keys), F.greatest(length - n + 1, F.lit(1)).cast("long")) + 1).cast("int")
    last = (first + n - 1).cast("int")
    tail = F.lit("?") if fraction == 1 else F.concat(F.lit(" between steps "), first.cast("string"), F.lit(" and "), last.cast("string"), F.lit("?"))
    return first, last, tail


def comparison(*keys: Column | str, superlative: bool = True, is_more: Column | bool | None = None, seed: int = 0) -> tuple[Column, Column]:
    """Whether more is asked for, by a flip unless it is given, and the words for it."""
    flip = draw(2, seed, F.lit("more"), *keys) == 1
    more = flip if is_more is None else F.coalesce(F.lit(is_more) if isinstance(is_more, bool) else is_more, flip)
    words = ("most", "least amount of") if superlative else ("more", "fewer")
    return more, F.when(more, words[0]).otherwise(words[1])


def forced_more(qtype: str, length: int) -> bool:
    """Whether a question is only asked for the most, as its sequences are too short to tell the least."""
    return length <= FORCED.get(qtype, 0)


def bindings(rows: DataFrame, config: GenerationConfig, fraction: float = 1.0, qtype: str | None = None, n_crowd: int = 3) -> DataFrame:
    """Bindings of sequences (seq_id, seq_len) by hash of the seed: two characters and two rooms that differ, a step, most or least (most where the type's sequences are too short for least), and a stretch of steps that is the share `fraction` of all."""
    c, r, n = len(config.chars), len(config.rooms), F.col("seq_len")
    of = lambda n, name: draw(n, config.seed, F.lit(name), "seq_len", "seq_id")
    c0, r0 = of(c, "c0"), of(r, "r0")
    c1, r1 = (c0 + 1 + of(max(1, c - 1), "c1")) % c, (r0 + 1 + of(max(1, r - 1), "r1")) % r
    forced = F.when(n <= FORCED[qtype], True) if qtype in FORCED else None
    more, _ = comparison("seq_len", "seq_id", is_more=forced, seed=config.seed)
    first, last, _ = sampled_steps(n, fraction, "seq_len", "seq_id", seed=config.seed)
    frame = (F.pmod(F.xxhash64(F.lit(config.seed), F.lit("frame"), "seq_len", "seq_id"), n.cast("long")) + 1).cast("int")
    return rows.select(
        "seq_id", named(c0, config.chars).alias("c0"), named(c1, config.chars).alias("c1"), named(r0, config.rooms).alias("r0"), named(r1, config.rooms).alias("r1"),
        frame.alias("frame"), more.alias("is_more"), first.alias("f0"), last.alias("f1"), F.lit(n_crowd).alias("n_crowd"),
    )


def random_params(sequences: DataFrame, length: int, config: GenerationConfig, fraction: float = 1.0, qtype: str | None = None, n_crowd: int = 3) -> DataFrame:
    """bindings() of sequences of one length, given by any table with seq_id."""
    return bindings(sequences.select("seq_id").distinct().withColumn("seq_len", F.lit(length)), config, fraction, qtype, n_crowd)


def count_by_length(samples: DataFrame) -> DataFrame:
    return samples.groupBy("seq_len").agg(F.count("*").alias("n"))


def _ascii_json(text: Column) -> Column:
    """A text as JSON in ASCII, characters beyond it as escapes."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0")))), "")
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[^\x00-\x7F]"), escaped).otherwise(plain), F.lit('"'))


def hashed(state: DataFrame) -> DataFrame:
    """seq_id, seq_hash of each sequence: SHA-256 of a JSON array of steps, each an array of the rooms in character order, in ASCII with ', ' between."""
    steps = state.groupBy("seq_id", "step_id").agg(F.array_sort(F.collect_list(F.struct("ch_ord", "room"))).alias("at"))
    row = F.concat(F.lit("["), F.array_join(F.transform("at", lambda x: _ascii_json(x["room"])), ", "), F.lit("]"))
    whole = steps.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("step_id", row.alias("row")))).alias("s"))
    return whole.select("seq_id", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["row"]), ", "), F.lit("]")), 256).alias("seq_hash"))


def questions(spark: SparkSession, config: GenerationConfig, fraction: float = 1.0) -> DataFrame:
    """qid, seq_len, qtype, atype, answer, seq_hash, seq_id: n_questions of each type and length, no sequence twice in a cell.

    Dense questions ask about the share `fraction` of the steps. With target_keyframes only sequences count whose answer
    rests on as many steps. Sequences are made until each cell is full; one that isn't after LIMIT raises ValueError.
    """
    types, lengths = config.get_question_types(), config.seq_lengths
    low, high = config.keyframes
    length_of = F.element_at(F.array(*map(F.lit, lengths)), (F.floor(F.col("seq_id") / STRIDE) + 1).cast("int"))

    def made(n: int, first: int, short: dict[str, list[int]]) -> DataFrame:
        """Answers of the short cells from one table of states, whatever the lengths."""
        wanted = sorted({x for some in short.values() for x in some}, key=lengths.index)
        rows = numbered_sequences(spark, n, lengths, first).where(F.col("seq_len").isin(wanted))
        state = states_of(rows, config)
        hashes = hashed(state)
        parts = []
        for q, some in short.items():
            w = World(state, bindings(rows, config, fraction, q), max(lengths), tuple(config.chars), tuple(config.rooms))
            answered, support = QUESTIONS[q](w)
            found = answered.where("valid")
            if low is not None:
                steps = support.select("seq_id", "step_id").distinct().groupBy("seq_id").agg(F.count("*").alias("n"))
                found = found.join(steps.where(F.col("n").between(low, high)), "seq_id", "left_semi")
            found = found.withColumn("seq_len", length_of).where(F.col("seq_len").isin(some))
            parts.append(found.join(hashes, "seq_id").select("seq_len", F.lit(q).alias("qtype"), F.lit(types.index(q)).alias("ord"), F.lit(atype(q)).alias("atype"), "seq_id", "answer", "seq_hash"))
        return reduce(DataFrame.unionByName, parts)

    parts, short, first, n = [], {q: list(lengths) for q in types}, 0, config.n_questions * OVERSAMPLE
    while short:
        parts.append(made(n, first, short))
        so_far = reduce(DataFrame.unionByName, parts).where(F.col("qtype").isin(list(short)))
        sizes = {(r.qtype, r.seq_len): r.n for r in so_far.groupBy("qtype", "seq_len").agg(F.count_distinct("seq_hash").alias("n")).collect()}  # a row for each cell
        short = {q: some for q, old in short.items() if (some := [x for x in old if sizes.get((q, x), 0) < config.n_questions])}
        first, n = first + n, (first + n) * (GROWTH - 1)
        if short and first + n > LIMIT:
            raise ValueError(f"fewer than {config.n_questions} questions in {first} sequences: {short}")
    first = Window.partitionBy("seq_len", "qtype", "seq_hash").orderBy("seq_id")
    rows = reduce(DataFrame.unionByName, parts).withColumn("again", F.row_number().over(first)).where("again = 1").drop("again")
    cell = Window.partitionBy("seq_len", "qtype").orderBy("seq_id")
    kept = rows.withColumn("nth", F.row_number().over(cell)).where(F.col("nth") <= config.n_questions)
    # ids are the rank in (length, type, number), which the place of a cell and the number give without one global sort
    sizes = kept.groupBy("seq_len", "ord").agg(F.count("*").alias("n"))
    before = sizes.select("seq_len", "ord", (F.sum("n").over(Window.orderBy("seq_len", "ord")) - F.col("n")).alias("before"))
    return kept.join(F.broadcast(before), ["seq_len", "ord"]).select(F.format_string("%07d", F.col("before") + F.col("nth") - 1).alias("qid"), "seq_len", "qtype", "atype", "answer", "seq_hash", "seq_id")


def samples(spark: SparkSession, config: GenerationConfig, fraction: float = 1.0, language: str = "en") -> DataFrame:
    """Questions with their text, sequence, metadata and counts of relevant rooms, in the shape that a dataset is saved in."""
    made = questions(spark, config, fraction)
    rows = made.select("seq_id", "seq_len").distinct()
    state = states_of(rows, config)
    steps = sequences(state, config.rooms)
    parts = []
    for q in config.get_question_types():
        w = World(state, bindings(rows, config, fraction, q), max(config.seq_lengths), tuple(config.chars), tuple(config.rooms))
        said = w.param.join(rows, "seq_id")
        text = said.select("seq_id", F.when((F.col("f0") == 1) & (F.col("f1") == F.col("seq_len")), wording.question(q, language, whole=True)).otherwise(wording.question(q, language)).alias("question"))
        meta = records.dense_metadata(QUESTIONS[q](w)[1], rows, config.rooms)
        parts.append(made.where(F.col("qtype") == q).join(text, "seq_id").join(steps, "seq_id").join(meta, "seq_id"))
    out = reduce(DataFrame.unionByName, parts)
    per_step, total = records.relevant_counts(F.col("metadata"))
    return out.select("qid", "seq_len", "qtype", "atype", "question", "answer", "sequence", "metadata", per_step.alias("n_relevant_rooms_per_step"), total.alias("n_relevant_rooms"))


def in_context_examples(spark: SparkSession, config: GenerationConfig, n: int = 5, lengths: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """n samples for each type and each of the short lengths, under example_id, with a seed of their own."""
    own = replace(config, seed=config.seed + 12345, n_questions=n, seq_lengths=list(lengths))
    return samples(spark, own).withColumnRenamed("qid", "example_id")
