"""Segments of token arrays and of step lengths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(tokens: Column, size: int, align: str = "left") -> Column:
    """An array of segments of `size`: the short one last (left), first (right), or none (center: equal parts)."""
    n = F.size(tokens)
    parts = F.ceil(n / size).cast("int")
    if align == "center":
        each = F.ceil(n / F.greatest(parts, F.lit(1))).cast("int")
        out = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(tokens, i * each + 1, each))
    elif align == "right":
        head = n - (parts - 1) * size
        out = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(tokens, F.when(i == 0, 1).otherwise(head + (i - 1) * size + 1), F.when(i == 0, head).otherwise(F.lit(size))))
    else:
        out = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(tokens, i * size + 1, size))
    return F.when(n > 0, out).otherwise(F.array().cast("array<array<int>>"))


def padded(tokens: Column, size: Column | int, pad: int = 0, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(pad), F.greatest((F.lit(size) if isinstance(size, int) else size) - F.size(tokens), F.lit(0)))
    return F.concat(fill, tokens) if left else F.concat(tokens, fill)


def n_segments(length: Column, size: int) -> Column:
    return F.floor(length / size).cast("int") + 1


def packed_steps(lengths: Column, limit: int) -> Column:
    """segments, fill: whole steps into segments that stay under the limit."""

    def step(acc: Column, x: Column) -> Column:
        fits = acc["fill"] + x < limit
        return F.struct((acc["segments"] + F.when(fits, 0).otherwise(1)).alias("segments"), F.when(fits, acc["fill"] + x).otherwise(x).alias("fill"))

    return F.aggregate(lengths, F.struct(F.lit(1).alias("segments"), F.lit(0).alias("fill")), step)


def completion_mask(prompt: Column, completion: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), prompt), F.array_repeat(F.lit(1), completion))


def labels(prompt: Column, ids: Column, ignore: int = -100) -> Column:
    return F.concat(F.array_repeat(F.lit(ignore), prompt), ids)


def position(haystack: Column, needle: Column) -> Column:
    """Where an array first occurs in another, from 0; -1 if nowhere."""
    last = F.size(haystack) - F.size(needle)
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(haystack, i + 1, F.size(needle)) == needle)
    return F.when(last < 0, -1).otherwise(F.coalesce(F.get(at, F.lit(0)), F.lit(-1)))


def proxy_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def filled_segments(tokens: Column, size: int, pad: int = 0, final: Column | None = None) -> tuple[Column, Column]:
    """Tokens in full segments, the last one padded, then the final one as it is if there is one; and how many segments these are."""
    parts = F.ceil(F.size(tokens) / size).cast("int")
    whole = padded(tokens, parts * size, pad)
    return (whole, parts) if final is None else (F.concat(whole, final), parts + 1)


def collated(rows: DataFrame, ids: str, batch: str, pad: int, ignore: int | None = None, left: bool = False) -> DataFrame:
    """`rows` with ids padded to the longest of their batch (ignore pads labels instead), and mask, which is 1 where a token is."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    out = rows.withColumn("_longest", longest)
    mask = padded(F.transform(ids, lambda _: F.lit(1)), F.col("_longest"), 0, left)
    return out.withColumn("mask", mask).withColumn(ids, padded(F.col(ids), F.col("_longest"), pad if ignore is None else ignore, left)).drop("_longest")


def quoted_steps(text: Column, schema: str = "array<struct<step_id:int,rooms:map<string,array<string>>>>") -> Column:
    """Steps from a text that has single quotes where JSON has double ones."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), schema)
