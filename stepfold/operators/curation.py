"""Choosing, splitting and reshaping rows of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remaining(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't done."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def padded_id(qid: Column, width: int = 7) -> Column:
    qid = qid.cast("string")
    return F.when(F.length(qid) < width, F.lpad(qid, width, "0")).otherwise(qid)


def hash_order(key: str, seed: int = 42) -> Column:
    """An order that any engine can repeat."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def first_per(rows: DataFrame, n: int | Column, by: list[str], *order: str | Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def split_stratified(rows: DataFrame, by: list[str], key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """`rows` with split: exactly round(share * n) rows of each stratum are train, in an order of hashes."""
    w = Window.partitionBy(*by)
    nth = F.row_number().over(w.orderBy(hash_order(key, seed), key))
    size = F.count("*").over(w)
    return rows.withColumn("_nth", nth).withColumn("_size", size).withColumn("split", F.when(F.col("_nth") <= F.bround(F.col("_size") * share), "train").otherwise("test")).drop("_nth", "_size")


def deduplicated(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return first_per(rows, 1, by, order)


def few_shots(wanted: DataFrame, pool: DataFrame, k: int, longest: int = 16) -> DataFrame:
    """wanted (qid, qtype, seq_len) with up to k shots of its type and length min(seq_len, longest), else of the whole pool, by example_id."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("example_id"))
    own = pool.withColumn("nth", rank("qtype", "seq_len")).where(F.col("nth") <= k).groupBy("qtype", F.col("seq_len").alias("at")).agg(F.array_sort(F.collect_list("example_id")).alias("own"))
    any_ = pool.orderBy("example_id").limit(k).agg(F.array_sort(F.collect_list("example_id")).alias("any"))
    out = wanted.withColumn("at", F.least("seq_len", F.lit(longest))).join(own, ["qtype", "at"], "left").join(F.broadcast(any_))
    return out.select("qid", F.array_join(F.coalesce("own", "any"), ",").alias("shots"))


def quota(rows: DataFrame, quotas: dict[int, int], by: str, order: str) -> DataFrame:
    """So many rows of each length for each `by`."""
    n = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("seq_len"))
    return first_per(rows.where(F.col("seq_len").isin(list(quotas))), n, [by, "seq_len"], order)


def masked(state: DataFrame, share: float, seed: int = 42, mask: str = "?") -> DataFrame:
    """State with a share of its cells hidden, chosen by hash."""
    at = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "seq_id", "step_id", "ch_ord"), 256), 1, 8), 16, 10).cast("double") / 2**32
    return state.withColumn("room", F.when(at < share, mask).otherwise(F.col("room")))


def indexed(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """`rows` with idx, their place from 0, within each of `by`. Over all rows, ranges are ordered in parallel and offset by their sizes."""
    if by:
        return rows.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = parted.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_least"))
    offsets = sizes.select("_part", "_least", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row for each partition
    return parted.join(F.broadcast(offsets), "_part").withColumn("idx", F.col("_before") + F.col("_at") - F.col("_least")).drop("_part", "_at", "_least", "_before")


def selected(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order (all if there are fewer), with idx."""
    return indexed(rows.orderBy(*order).limit(n), list(order))


def subsample(rows: DataFrame, n: int, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """n rows of each stratum, or of all rows without strata, in an order of hashes."""
    return first_per(rows, n, by, hash_order(key, seed), key) if by else rows.orderBy(hash_order(key, seed), key).limit(n)


def within_segments(rows: DataFrame, most: int, column: str = "num_segments") -> DataFrame:
    return rows.where(F.col(column) <= most)


def stages(rows: DataFrame, limits: list[int], column: str = "num_segments") -> list[DataFrame]:
    """The rows of each stage of a curriculum, those with at most so many segments; raises ValueError for a stage without any."""
    counts = rows.agg(*(F.count_if(F.col(column) <= n).alias(f"n{k}") for k, n in enumerate(limits))).first()
    if empty := [n for n, found in zip(limits, counts, strict=True) if not found]:
        raise ValueError(f"no rows with at most {empty} segments")
    return [within_segments(rows, n, column) for n in limits]


def full_quota(rows: DataFrame, quotas: dict[int, int], by: str, order: str) -> DataFrame:
    """quota(), raising ValueError where a group has fewer rows than its quotas ask for."""
    out = quota(rows, quotas, by, order)
    short = rows.select(by).distinct().join(out.groupBy(by).agg(F.count("*").alias("n")), by, "left").where(F.coalesce("n", F.lit(0)) < sum(quotas.values()))
    if missing := [r[by] for r in short.orderBy(by).limit(20).collect()]:
        raise ValueError(f"fewer than {sum(quotas.values())} shots: {missing}")
    return out
