"""Scans of JSON arrays and of CSV with line breaks in quotes by many tasks, however few files and lines there are.

Such a file can't be cut at any line: where a part begins may be within a string. So each part first tells what it would
do to either state, within quotes or not: whether it ends in the other one, and by how much the depth of brackets
changes. These functions are composed over the parts of a file, in order, which gives the state that each part begins
in; then each reads its values on its own. Only the pieces at the ends of parts, two for each part, are put together by
a shuffle. Parts are those of Spark's text source, cut at closing braces (JSON) or line feeds (CSV), so a single line of
any length is cut too, and any store that Spark reads will do. The text is scanned three times, and never sorted.

JSON: an array of objects, or one object; anything after it is ignored, and so is a last object that doesn't end.
CSV: quotes are doubled within quotes, none stand in bare values, and the first record of each file is its header. Blank
lines are left out. Empty files have no values.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts up to which the states they begin in are broadcast, some 200 bytes each.
BROADCAST_PARTS = 100_000
#: Values that are sent at once.
SENT = 500
_ESCAPE = re.compile(r"\\.", re.DOTALL)


def json_effect(text: str) -> tuple[int, int, int]:
    """Whether a text that ends in a brace changes between within and without quotes, and its change of depth if it begins without and within."""
    parts = _ESCAPE.sub("", text).split('"')
    by = [0, 0]
    for i, x in enumerate(parts):
        by[i & 1] += x.count("{") + x.count("[") - x.count("}") - x.count("]")
    return (len(parts) - 1) & 1, *by


def csv_effect(text: str) -> tuple[int, int, int]:
    return text.count('"') & 1, 0, 0


FORMATS = {"json": ("}", json_effect), "csv": ("\n", csv_effect)}


def _cut(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    return spark.read.option("lineSep", sep).text(paths).select(*at, "value")


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _effects(cut: DataFrame, kind: str) -> DataFrame:
    """file, start, flips, without, within, opens of each part; opens is the first bracket of a file."""
    sep, effect = FORMATS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, list] = {}
        for batch in batches:
            for file, start, value in _columns(batch):
                e = done.setdefault((file, start), [0, 0, 0, None])
                flips, *by = effect(value + sep)
                # what is without quotes from here on was within at the beginning if the quotes so far are odd
                e[1] += by[e[0]]
                e[2] += by[1 - e[0]]
                e[0] ^= flips
                if e[3] is None and start == 0:
                    e[3] = next((c for c in value + sep if c in "[{"), None)
        rows = [(*k, *e) for k, e in done.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["file", "start", "flips", "without", "within", "opens"])

    found = cut.mapInArrow(run, "file string, start long, flips int, without long, within long, opens string")
    return found


def _states(cut: DataFrame, kind: str) -> DataFrame:
    """file, start, quoted, depth, base: the state that each part begins in, and the depth around the values of its file."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = _effects(cut, kind).withColumn("quoted", (sum_before("flips") % 2).cast("int"))
    rows = rows.withColumn("depth", sum_before(F.when(F.col("quoted") == 1, F.col("within")).otherwise(F.col("without"))))
    base = F.when(F.first("opens", True).over(Window.partitionBy("file")) == "[", 1).otherwise(0) if kind == "json" else F.lit(0)
    return rows.select(F.col("file").alias("f"), F.col("start").alias("s"), "quoted", "depth", base.cast("int").alias("base"))


def _pieces(spark: SparkSession, cut: DataFrame, kind: str, broadcast_parts: int) -> DataFrame:
    """file, start, kind, first, text: whole values of each part, and the head and the tail that go on in other parts; 'through' is neither."""
    sep, effect = FORMATS[kind]
    states = _states(cut, kind)
    same = (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))
    if states.count() <= broadcast_parts:
        rows = cut.join(F.broadcast(states), same)
    else:
        rows = cut.withColumn("nth", F.monotonically_increasing_id()).join(states, same).repartition("file", "start").sortWithinPartitions("file", "start", "nth")
    rows = rows.select("file", "start", "value", "quoted", "depth", "base")
    names = ["file", "start", "kind", "first", "text"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part, held, closed, first = None, [], False, False
        quoted = depth = 0

        def sent() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

        def rest() -> None:
            if held:
                out.append((*part, "tail" if closed or part[1] == 0 else "through", first, "".join(held)))
                held.clear()

        for batch in batches:
            for file, start, value, begins, at, base in _columns(batch):
                if part != (file, start):
                    if part:
                        rest()
                    part, quoted, depth, closed, first = (file, start), begins, at, False, start == 0
                flips, *by = effect(value + sep)
                depth += by[quoted]
                quoted ^= flips
                held.append(value + sep)
                if not quoted and depth == base:
                    out.append((file, start, "whole" if closed or start == 0 else "head", first, "".join(held)))
                    held.clear()
                    closed, first = True, False
                    if len(out) >= SENT:
                        yield sent()
        if part:
            rest()
        yield sent()

    return rows.mapInArrow(run, "file string, start long, kind string, first boolean, text string")


def values(spark: SparkSession, paths: str | list[str], kind: str, broadcast_parts: int = BROADCAST_PARTS) -> DataFrame:
    """file, first (whether it is the first of its file), text of each value: an object of a JSON array, a record of a CSV file."""
    pieces = _pieces(spark, _cut(spark, paths, FORMATS[kind][0]), kind, broadcast_parts)
    whole = pieces.where("kind = 'whole'").select("file", "first", "text")
    # a value that parts share is a tail, maybe some that it goes through, and a head
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "tail")
    ends = F.count_if(F.col("kind") == "head").over(order.rowsBetween(Window.unboundedPreceding, -1))
    shared = pieces.where("kind <> 'whole'").withColumn("nth", F.coalesce(ends, F.lit(0)))
    joined = shared.groupBy("file", "nth").agg(F.max("first").alias("first"), F.max(F.col("kind") == "head").alias("ends"), F.array_sort(F.collect_list(F.struct("start", (F.col("kind") == "tail").alias("last"), "text"))).alias("x"))
    joined = joined.where("ends").select("file", "first", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("text"))
    found = whole.unionByName(joined)
    return found.withColumn("text", F.regexp_replace("text", r"^[^{]*+" if kind == "json" else r"\r?\n\z", "")).where("text <> ''")


def json_objects(spark: SparkSession, paths: str | list[str], schema: str, **limits) -> DataFrame:
    """file, x: the objects of JSON arrays by a schema."""
    return values(spark, paths, "json", **limits).select("file", F.from_json("text", schema).alias("x"))


def csv_headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """The header of each file that has one, from the first part of each; a row for each file comes to the driver."""
    first = _cut(spark, paths, FORMATS["csv"][0]).where("start = 0")
    rows = _pieces(spark, first, "csv", BROADCAST_PARTS).where("first and kind = 'whole'").select("file", "text").collect()
    plain = lambda path: unquote(path.split(":", 1)[-1]).lstrip("/")
    headers = {plain(r.file): tuple(next(csv.reader([r.text.removeprefix("\ufeff").rstrip("\r\n")], strict=False))) for r in rows if r.text.strip()}
    return {path: headers[plain(path)] for path in paths if plain(path) in headers}


def csv_records(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Records (text) under a header as columns of text; what doesn't fit is null but for malformed, which holds the record."""
    schema = ", ".join(f"`{c}` string" for c in (*columns, "malformed"))
    parsed = F.from_csv("text", schema, {"escape": '"', "columnNameOfCorruptRecord": "malformed", "mode": "PERMISSIVE"})
    return records.select("file", parsed.alias("x")).select("file", "x.*")
