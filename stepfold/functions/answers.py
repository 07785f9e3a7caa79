"""Extracting, normalising and comparing free-text answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.json_repair import repaired
from stepfold.model import CHARS, NOBODY, ROOMS, RU_CHARS, RU_NOBODY, RU_ROOMS

# Canonical answers, the words that are no answer, and the patterns that answers are found by.
SYNONYMS = {x.lower(): x for x in RU_ROOMS + RU_CHARS + [RU_NOBODY]} | {a.lower(): b for a, b in zip(ROOMS + CHARS + [NOBODY], RU_ROOMS + RU_CHARS + [RU_NOBODY], strict=True)} | {"никого": RU_NOBODY, "no one": RU_NOBODY, "none": RU_NOBODY}
SKIPPED = ["the", "a", "an", "i", "think", "believe", "so", "therefore"]
JSON_ANSWER = r"""\{\s*["']answer["']\s*:\s*["']?([^"'}\s]+)["']?\s*\}"""
JSON_BLOCK = r"""\{[^{}]*"answer"[^{}]*\}"""
SAID_EN = r"""(?i)(?:the\s+)?(?:answer|result)\b\s*(?:is|:)\s*['"]?([A-Za-zА-Яа-я0-9]+)['"]?"""
SAID_RU = r"""(?iu)(?:ответ|результат)\s*(?::|—|–|-)\s*['"]?([A-Za-zА-Яа-я0-9]+)['"]?"""
BOXED = r"\\boxed\{([^}]+)\}"
BOLD = r"\*\*([A-Za-zА-Яа-я0-9]+)\*\*"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalized(answer: Column, atype: Column) -> Column:
    """Canonical Russian name, or all digits of a number ('0' if none). Empty stays empty."""
    answer = F.coalesce(answer, F.lit(""))
    bare = F.regexp_replace(_strip(answer), r"[.,!?;:]+$", "")
    digits = F.regexp_replace(bare, r"[^0-9]", "")
    low = _strip(F.lower(bare))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv)), low)
    word = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))
    return F.when(answer == "", "").when(atype == "number", F.when(digits == "", "0").otherwise(digits)).otherwise(F.coalesce(known, word))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """Like _first, for groups that are never empty: one pass of the expression instead of two."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def final_part(text: Column) -> Column:
    """The text without reasoning: no think blocks, and what follows the last channel close."""
    text = F.regexp_replace(_strip(F.coalesce(text, F.lit(""))), r"(?s)<think>.*?</think>", "")
    after = _last(text, r"(?s)<channel\|>\s*(.+?)(?=<\|channel>|$(?!\n))")
    return _strip(F.coalesce(after, F.regexp_replace(text, r"(?s)<\|channel>thought.*?(?=<\|channel>|$(?!\n))", "")))


def with_answer(df: DataFrame, text: str = "resp", atype: str = "atype", name: str = "pred") -> DataFrame:
    """`df` with the normalised answer of a model's text; its final part is computed once a row."""
    part = f"{name}_part"
    out = df.withColumn(part, final_part(F.col(text)))
    return out.withColumn(name, extracted_from(F.col(part), F.col(atype))).drop(part)


def batch_answers(logs: DataFrame) -> DataFrame:
    """Sample logs (resps, doc) with pred; the kind of answer is in either place of meta, else it is a person."""
    kind = F.coalesce(F.col("doc.meta.categories.atype"), F.col("doc.meta.atype"), F.lit("person"))
    text = F.coalesce(F.get(F.get("resps", F.lit(0)), F.lit(0)), F.lit(""))
    return with_answer(logs.withColumn("resp", text).withColumn("atype", kind))


def extracted(text: Column, atype: Column) -> Column:
    """The normalised answer of a model's text: JSON, then said, boxed or bold answers, then the first number or word."""
    return extracted_from(final_part(text), atype)


def extracted_from(rest: Column, atype: Column) -> Column:
    """The same of the final part of a text."""
    json = F.get_json_object(_found(rest, JSON_BLOCK, 0), "$.answer")
    said = F.coalesce(_last(rest, SAID_EN), _last(rest, SAID_RU), _found(rest, BOXED), _last(rest, BOLD))
    words = F.array_remove(F.split(rest, r"(?U)\s+"), "")

    def counts(word: Column) -> Column:
        clean = F.regexp_replace(F.lower(word), r"(?U)[^\w]", "")
        return (clean != "") & ~clean.isin(SKIPPED)

    word = F.coalesce(F.try_element_at(F.filter(words, counts), F.lit(1)), F.try_element_at(words, F.lit(1)))
    fallback = F.when(atype == "number", _found(rest, r"(\d+)")).otherwise(word)
    return F.when(rest == "", "").otherwise(normalized(F.coalesce(_found(rest, JSON_ANSWER), json, said, fallback, F.lit("")), atype))


# legacy answers


#: A number after junk characters.
NUMBER = r"""[<>'"`,.]*(\d+)"""
PEOPLE = CHARS + [NOBODY]


def legacy_number(text: Column) -> Column:
    """First number after junk characters, null if none."""
    return _found(text, NUMBER).cast("bigint")


def legacy_items(value: Column) -> Column:
    """What a literal holds, as an array of strings: the items of a list, tuple or set, a quoted or bare scalar alone. A scalar that is no literal counts by its first number, if it has one."""
    x = F.trim(value)
    unquote = lambda s: F.regexp_replace(F.trim(s), r"""^(['"])(.*)\1$""", "$2")
    listed = x.rlike(r"(?s)^[\[({].*[\])}]$")
    items = F.filter(F.transform(F.split(F.substring(x, 2, 1 << 30).substr(F.lit(1), F.length(x) - 2), ","), unquote), lambda s: s != "")
    literal = x.rlike(r"""(?s)^(?:-?\d+|'[^']*'|"[^"]*")$""")
    return F.when(listed, items).when(literal, F.array(unquote(x))).otherwise(F.array(F.coalesce(legacy_number(x).cast("string"), x)))


def _is_list(value: Column) -> Column:
    return F.trim(value).rlike(r"(?s)^[\[({].*[\])}]$")


def _whole(text: Column) -> Column:
    return F.when(text.rlike(r"^-?\d+$"), text.cast("bigint"))


def legacy_number_of(items: Column, listed: Column) -> Column:
    """The number of an answer: 0 where Nobody is in it, else its first number; null if there is none, or a list without."""
    one = F.get(items, F.lit(0))
    nobody = F.when(listed, F.array_contains(items, NOBODY)).otherwise(one.contains(NOBODY))
    number = F.coalesce(_whole(one), legacy_number(one))
    return F.when(nobody, F.lit(0).cast("bigint")).when(~listed, number)


def legacy_hit(gold: Column, predicted: Column) -> Column:
    """Whether a prediction equals the gold answer after both are read as the gold's kind: a number, a room, or a set of people. What can't be read so isn't a hit."""
    g, p, g_list, p_list = legacy_items(gold), legacy_items(predicted), _is_list(gold), _is_list(predicted)
    one, said = F.get(g, F.lit(0)), F.get(p, F.lit(0))
    people = F.array(*map(F.lit, PEOPLE))
    sets = lambda x: F.array_sort(F.array_distinct(x))
    all_people = lambda x: F.size(F.array_except(x, people)) == 0
    number = ~g_list & one.rlike(r"^-?\d+$")
    room = ~g_list & one.isin(ROOMS)
    person = F.when(g_list, all_people(g)).otherwise(one.isin(PEOPLE))
    hit = F.when(number, _whole(one) == legacy_number_of(p, p_list)).when(room, ~p_list & (one == said)).when(person, all_people(p) & (sets(g) == sets(p)))
    return F.coalesce(hit, F.lit(False))


def legacy_scored(files: DataFrame) -> DataFrame:
    """Answer rows (answer, Predicted_Answer, ...) that are usable, with Final_Answer and hit (0 or 1)."""
    rows = files.where(~F.coalesce(F.lower("Predicted_Answer").contains("error"), F.lit(True)))
    final = legacy_parsed(after_reasoning(F.col("Predicted_Answer"), keep_offset=True))
    return rows.withColumn("Final_Answer", final).withColumn("hit", legacy_hit(F.col("answer"), F.col("Final_Answer")).cast("int"))


# The schemas that answers of each kind are held to.
SCHEMAS = {
    "room": {"type": "object", "properties": {"answer": {"enum": ROOMS, "type": "string"}}, "required": ["answer"]},
    "number": {"type": "object", "properties": {"answer": {"default": 0, "type": "integer"}}},
    "person": {"type": "object", "properties": {"answer": {"default": NOBODY, "enum": PEOPLE, "type": "string"}}},
}


def strict_schema(atype: str) -> dict:
    """A schema under its name in which every field must be there and no other may."""
    plain = SCHEMAS[atype]
    fields = {k: {x: y for x, y in v.items() if x != "default"} for k, v in plain["properties"].items()}
    return {"name": atype, "schema": {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}}


def fits_schema(value: Column, atype: Column) -> Column:
    """Whether an answer is one that its kind allows."""
    return F.coalesce(F.when(atype == "room", value.isin(ROOMS)).when(atype == "number", value.rlike(r"^-?\d+$")).otherwise(value.isin(PEOPLE)), F.lit(False))


def legacy_parsed(text: Column) -> Column:
    """The answer field of a JSON text; whatever contains 'no' is Nobody. Otherwise the first number, the first known name, or None. A list of one item is that item in braces, as a set; longer ones are Nobody.

    Broken JSON is mended first, see json_repair.
    """
    fixed = repaired(text)
    value = F.get_json_object(fixed, "$.answer")
    has = F.coalesce(F.startswith(fixed, F.lit("{")), F.lit(False))
    one = F.from_json(value, "array<string>")
    parsed = F.when(F.lower(F.coalesce(value, F.lit("None"))).contains("no"), NOBODY).when(value.startswith("["), F.when(F.size(one) == 1, F.concat(F.lit("{"), F.get(one, F.lit(0)), F.lit("}"))).otherwise(NOBODY)).otherwise(value)
    name = _first(text, "(?i)(" + "|".join(ROOMS + CHARS + [NOBODY]) + ")")
    return F.when(has, parsed).otherwise(F.coalesce(legacy_number(text).cast("string"), name, F.lit("None")))


def after_reasoning(text: Column, keep_offset: bool = False) -> Column:
    """From the first brace after </think>, without answer tags. keep_offset starts to look for it at the old place of </think>, as older runs did."""
    at = F.locate("</think>", text)
    tail = F.trim(F.replace(F.replace(F.substr(text, at), F.lit("</answer>"), F.lit("")), F.lit("<answer>"), F.lit("")))
    brace = F.when(F.lit(keep_offset), F.expr("0")).otherwise(F.locate("{", tail))
    if keep_offset:
        inner = F.locate("{", F.substr(tail, at))
        brace = F.when(inner > 0, inner + at - 1).otherwise(0)
    return F.when(at == 0, text).when(brace == 0, tail).otherwise(F.substr(tail, brace))


def legacy_kind(answer: Column) -> Column:
    return F.when(answer.rlike(r"^\d+$"), "number").when(answer.isin(ROOMS), "room").when(answer.isin(CHARS + [NOBODY]), "person")


def reasoning_tokens(text: Column) -> Column:
    """A quarter of the characters of the reasoning: the think block, else the channel, else all lines but the last of a long text."""
    think, channel = _first(text, r"(?s)<think>(.*?)</think>"), _first(text, r"(?s)<\|channel>thought(.*?)<channel\|>")
    lines = F.split(text, "\n")
    lead = F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    inner = F.coalesce(think, channel, F.when((F.length(text) > 200) & (F.size(lines) > 3), lead), F.lit(""))
    return F.floor(F.length(inner) / 4)


def truncated_at(text: Column, stops: list[str]) -> Column:
    for s in stops:
        text = F.substring_index(text, s, 1)
    return text


def tagged(text: Column, tag: str, json: bool = False) -> Column:
    """What a tag holds; of a text without its end, what follows the last start."""
    if json:
        inner = _first(text, r'(?s)\{"answer":\s*(.*?)\}')
        rest = F.when(text.contains('{"answer":'), F.replace(F.trim(F.substring_index(F.substring_index(text, '{"answer":', -1), "}", 1)), F.lit('"'), F.lit("")))
        return F.coalesce(_strip(inner), rest, F.lit(""))
    inner = _first(text, rf"(?s)<{tag}>(.*?)</{tag}>")
    rest = F.when(text.contains(f"<{tag}>"), F.substring_index(F.substring_index(text, f"<{tag}>", -1), f"</{tag}>", 1))
    return F.coalesce(_strip(inner), _strip(rest), F.lit(""))


# scores


def exact(prediction: Column, gold: Column) -> Column:
    return (F.lower(prediction) == F.lower(gold)).cast("double")


def numeric_scores(prediction: Column, gold: Column, raw: Column, seq_len: Column) -> dict[str, Column]:
    """mae, mae_norm, smape and parse rate of a number; a text without digits counts as wholly wrong."""
    parsed = raw.rlike(r"\d") & prediction.rlike(r"^\d+$")
    p, g = prediction.try_cast("double"), gold.try_cast("double")
    error = F.when(parsed, F.abs(p - g)).otherwise(seq_len.cast("double"))
    smape = F.when(~parsed, 1.0).when((p == 0) & (g == 0), 0.0).otherwise(F.abs(p - g) / (F.abs(p) + F.abs(g)))
    return {"mae": error, "mae_norm": F.least(error / F.greatest(seq_len, F.lit(1)), F.lit(1.0)), "smape": smape, "parsed": parsed.cast("double")}


def token_hit(labels: Column, predicted: Column, ignore: int = -100) -> Column:
    """Whether all label tokens that count are predicted, of which there must be one."""
    pairs = F.filter(F.arrays_zip(labels.alias("l"), predicted.alias("p")), lambda x: x["l"] != ignore)
    return (F.size(pairs) > 0) & F.forall(pairs, lambda x: F.coalesce(x["l"] == x["p"], F.lit(False)))
