"""Broken JSON made whole, as a column expression: one expression cuts a text into tokens, and one fold runs a pushdown automaton over them.

The text counts from its first bracket on; what follows the end of that value is left out. Mended are strings and
brackets that are never closed, closing brackets without an opening one, missing, doubled and trailing commas, missing
colons and values, single quotes, bare keys and words, comments (//, #, /* */), escapes that JSON lacks, raw control
characters, and the literals of Python. A key without value has null, a value without key the key ''. A string that the
text ends in loses the brackets and white space at the very end, which were meant to close what is around it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BACKSLASH = "\\"
_DOUBLE = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\\)?'
_SINGLE = r"'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\\)?"
_COMMENT = r"//[^\n]*+|#[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_BARE = r"""(?:[^\s{}\[\]:,"'/#]|/(?![/*]))(?:[^{}\[\]:,"\n/#]|/(?![/*]))*+"""
TOKEN = rf"{_DOUBLE}|{_SINGLE}|{_COMMENT}|[{{}}\[\]:,]|{_BARE}"
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
# What the literals of JSON and Python are in JSON.
LITERALS = {"true": "true", "True": "true", "TRUE": "true", "false": "false", "False": "false", "FALSE": "false", "null": "null", "None": "null", "NULL": "null"}
#: What stands for control characters in JSON.
_CONTROL = {chr(i): f"\\u{i:04x}" for i in range(32)} | {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _quoted(inner: Column) -> Column:
    """A JSON string of what stood between quotes of either kind."""
    # an escape that JSON has stays, of any other the character alone
    units = F.regexp_extract_all(inner, F.lit(r'[^"\\]++|"|\\u[0-9A-Fa-f]{4}|\\(?s:.)'), F.lit(0))
    escaped = F.transform(units, lambda x: F.when(x == '"', '\\"').when(F.startswith(x, F.lit(_BACKSLASH)) & ~x.rlike(r'^\\(?:["\\/bfnrt]$|u.)'), F.substring(x, 2, 1 << 30)).otherwise(x))
    pairs = F.when(inner.rlike(r'["\\]'), F.array_join(escaped, "")).otherwise(inner)
    # tokens of control characters are rare, so their replacement is looked for only where there are any
    plain = pairs
    for char, escape in _CONTROL.items():
        plain = F.replace(plain, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), F.when(pairs.rlike(r"[\x00-\x1f]"), plain).otherwise(pairs), F.lit('"'))


def _token(x: Column) -> Column:
    """kind (a bracket, colon or comma, 's' for a scalar), and a scalar's JSON as a key and as a value."""
    first = F.substring(x, 1, 1)
    is_string = first.isin('"', "'")
    closed = x.rlike(r"""(?s)^(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')\z""")
    inner = F.substr(x, F.lit(2), F.length(x) - 1 - closed.cast("int"))
    # a string that isn't closed ends before closing brackets, and before a backslash that escapes nothing any more
    inner = F.when(closed, inner).otherwise(F.regexp_replace(F.regexp_replace(inner, r"[\s}\]]+\z", ""), r"^((?s:[^\\]|\\.)*+)\\\z", "$1"))
    bare = F.regexp_replace(x, r"\s+\z", "")
    text = _quoted(F.when(is_string, inner).otherwise(bare))
    literal = F.element_at(F.create_map(*(F.lit(y) for kv in LITERALS.items() for y in kv)), bare)
    value = F.when(is_string, text).otherwise(F.coalesce(F.when(bare.rlike(NUMBER), bare), literal, text))
    kind = F.when(x.isin(*"{}[]:,"), x).otherwise("s")
    return F.struct(kind.alias("kind"), F.when(kind == "s", text).alias("key"), F.when(kind == "s", value).otherwise(x).alias("value"))


def _closed(stack: Column) -> Column:
    """What closes the brackets of a stack, the innermost first."""
    return F.translate(F.reverse(stack), "{[", "}]")


def _missing(want: Column) -> Column:
    """What a key that has no value yet lacks."""
    return F.when(want == ":", ":null").when(want == "o", "null").otherwise("")


def _step(acc: Column, x: Column) -> Column:
    """One token. want: k a key, : a colon, o a value of a key, v an item or the root, a comma what follows a value, e nothing more."""
    out, stack, want, comma, kind = acc["out"], acc["stack"], acc["want"], acc["comma"], x["kind"]
    inside = F.when(F.substring(stack, -1, 1) == "{", "k").otherwise("v")
    # a scalar or an opening bracket; a comma that isn't there is taken as read
    now = F.when(want == ",", inside).otherwise(want)
    opens, closes = kind.isin("{", "["), kind.isin("}", "]")
    is_key = (now == "k") & (kind == "s")
    before = F.concat(F.when((want == ",") | comma, ",").otherwise(""), F.when(now == ":", ":").when((now == "k") & opens, '"":').otherwise(""))
    put = F.concat(out, before, F.when(is_key, x["key"]).otherwise(x["value"]))
    after = F.when(is_key, ":").when(kind == "{", "k").when(kind == "[", "v").otherwise(",")
    # a closing bracket also closes what is open within its own pair
    opening = F.when(kind == "}", "{").otherwise("[")
    depth = F.length(stack) - F.instr(F.reverse(stack), opening)
    left = F.substr(stack, F.lit(1), depth)
    end = F.concat(out, _missing(want), _closed(F.substr(stack, depth + 1)))

    def state(out: Column, stack: Column, want: Column, comma: Column) -> Column:
        return F.struct(out.alias("out"), stack.alias("stack"), want.alias("want"), comma.alias("comma"))

    no = F.lit(False)
    return (
        F.when(want == "e", acc)
        .when(kind == ",", F.when(want.isin(":", "o", ","), state(F.concat(out, _missing(want)), stack, inside, F.lit(True))).otherwise(acc))
        .when(kind == ":", F.when(want == ":", state(F.concat(out, F.lit(":")), stack, F.lit("o"), no)).otherwise(acc))
        .when(closes, F.when(F.instr(stack, opening) == 0, acc).otherwise(state(end, left, F.when(depth == 0, "e").otherwise(","), no)))
        .otherwise(state(put, F.when(opens, F.concat(stack, kind)).otherwise(stack), after, no))
    )


def repaired(text: Column) -> Column:
    """Valid JSON, an object or an array, of the first of either in a text; null where there is no opening bracket."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?s)^[^{\[]*+", ""), F.lit(TOKEN), F.lit(0))
    tokens = F.transform(F.filter(found, lambda x: ~x.rlike(r"^(?://|#|/\*)")), _token)
    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("stack"), F.lit("v").alias("want"), F.lit(False).alias("comma"))
    done = F.aggregate(tokens, zero, _step, lambda acc: F.concat(acc["out"], _missing(acc["want"]), _closed(acc["stack"])))
    return F.nullif(done, F.lit(""))
