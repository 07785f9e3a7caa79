"""Where regular expressions match, as DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,value:string,part:string>>"
#: Matches that are folded at once: each step of a fold copies what it has gathered.
FOLD = 64


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def located(text: Column, pattern: str, found: Column, parts: Column | None = None, keep=None) -> Column:
    """Spans of all matches of `pattern`, leftmost first, without overlap, in code points, ends exclusive.

    `found` are the matches and `parts` a group of each. Splitting by the pattern gives what lies between them, so
    a running sum of lengths places each. Patterns match no empty string. keep(match, part) says which to return.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(found.alias("hit"), gaps.alias("gap"), (found if parts is None else parts).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), x["part"].alias("part"))
        more = F.concat(acc["out"], F.array(one))
        return F.struct(end.alias("at"), (more if keep is None else F.when(keep(x["hit"], x["part"]), more).otherwise(acc["out"])).alias("out"))

    none = F.array().cast(SPANS)

    def fold(at: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), none.alias("out")), step)

    def block(acc: Column, some: Column) -> Column:
        return once(fold(acc["at"], some), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    def folded(z: Column) -> Column:
        return F.aggregate(in_blocks(z), F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])

    return F.when(F.size(found) > 0, once(zipped, folded)).otherwise(none)


def in_blocks(z: Column) -> Column:
    """An array that isn't empty, cut into arrays of FOLD."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / FOLD).cast("int")), lambda i: F.slice(z, i * FOLD + 1, F.lit(FOLD)))


def once(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def only_if(condition: Column, strings: Column) -> Column:
    return F.when(condition, strings).otherwise(F.array().cast("array<string>"))


def text_of(kind: Column | str, start: Column, end: Column) -> Column:
    return F.concat(kind if isinstance(kind, Column) else F.lit(kind), F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"))
