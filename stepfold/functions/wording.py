"""Question texts in English and Russian, rendered from the bindings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfold.model import CHARS, FEMALE, ROOMS, RU_CHARS, RU_PLACES

# Fixed texts. {x|a|b} is a for a man and b for a woman, or a for most and b for least; {e} ends a question.
TEXTS = {
    "first_app": ("In which room did {c0} first appear?", "В какой комнате {c0} {c0|появился|появилась} впервые?"),
    "final_app": ("In which room was {c0} at the final step?", "В какой комнате {c0|был|была} {c0} на последнем шаге?"),
    "char_on_char_first_app": ("In which room was {c0} when {c1} first appeared in the {r0}?", "В какой комнате {c0|был|была} {c0}, когда {c1} впервые {c1|появился|появилась} {r0}?"),
    "char_on_char_final_app": ("In which room was {c0} when {c1} made their final appearance in the {r0}?", "В какой комнате {c0|был|была} {c0}, когда {c1} в последний раз {c1|появился|появилась} {r0}?"),
    "char_at_frame": ("In which room was {c0} at step {frame}?", "В какой комнате {c0|был|была} {c0} на шаге {frame}?"),
    "first_at_room": ("Who was the first to appear in the {r0}?", "Кто первым появился {r0}?"),
    "last_at_room": ("Who was the last person seen in the {r0}?", "Кого последним видели {r0}?"),
    "room_on_char_first_app": ("Who was in the {r0} when {c0} first appeared in the {r1}?", "Кто был {r0}, когда {c0} впервые {c0|появился|появилась} {r1}?"),
    "room_on_char_final_app": ("Who was in the {r0} when {c0} made their final appearance in the {r1}?", "Кто был {r0}, когда {c0} в последний раз {c0|появился|появилась} {r1}?"),
    "room_at_frame": ("Who was in the {r0} at step {frame}?", "Кто был {r0} на шаге {frame}?"),
    "char_on_char_at_frame": ("Who was in the same room as {c0} at step {frame}?", "Кто был в одной комнате с {c0} на шаге {frame}?"),
    "n_room_on_char_first_app": ("How many characters were in the {r0} when {c0} first appeared in the {r1}?", "Сколько персонажей было {r0}, когда {c0} впервые {c0|появился|появилась} {r1}?"),
    "n_room_on_char_final_app": ("How many characters were in the {r0} when {c0} made their final appearance in the {r1}?", "Сколько персонажей было {r0}, когда {c0} в последний раз {c0|появился|появилась} {r1}?"),
    "n_char_at_frame": ("How many other characters were in the same room as {c0} at step {frame}?", "Сколько других персонажей было в одной комнате с {c0} на шаге {frame}?"),
    "n_empty": ("How many rooms were empty at step {frame}?", "Сколько комнат были пустыми на шаге {frame}?"),
    "room_empty": ("Which room was empty for {is_more|more|fewer} steps than the other rooms{e}", "Какая комната была пустой {is_more|больше|меньше} шагов, чем остальные{e}"),
    "where_spend": ("In which room did {c0} spend the {is_more|most|least amount of} time{e}", "В какой комнате {c0} провёл(а) {is_more|больше всего|меньше всего} времени{e}"),
    "crowded_room": ("Which room was crowded ({n_crowd} or more people in one room) for the most steps{e}", "Какая комната была переполнена ({n_crowd} или более человек) наибольшее количество шагов{e}"),
    "who_spend": ("Who spent the {is_more|most|least amount of} time in the {r0}{e}", "Кто провёл {is_more|больше всего|меньше всего} времени {r0}{e}"),
    "spend_alone": ("Who spent the {is_more|most|least amount of} time alone in the rooms{e}", "Кто провёл {is_more|больше всего|меньше всего} времени в одиночестве{e}"),
    "spend_together": ("With whom did {c0} spend the {is_more|most|least amount of} time together in the same room{e}", "С кем {c0} провёл(а) {is_more|больше всего|меньше всего} времени вместе в одной комнате{e}"),
    "steps_in_room": ("How many steps did {c0} spend in the {r0}{e}", "Сколько шагов {c0} провёл(а) {r0}{e}"),
    "rooms_visited": ("How many different rooms did {c0} visit{e}", "Сколько разных комнат посетил(а) {c0}{e}"),
    "crowd_count": ("For how many steps was there a crowd ({n_crowd} or more people in one room){e}", "Сколько шагов существовала толпа ({n_crowd} или более человек в одной комнате){e}"),
}
BETWEEN = (" between steps {f0} and {f1}?", " между шагами {f0} и {f1}?")
_PART = re.compile(r"\{([^}]*)\}")


def translated(name: Column, source: list[str], target: list[str], default: Column | None = None) -> Column:
    """The name of the same place in another list; an unknown name is the default, or else stays."""
    pairs = [F.lit(x) for kv in zip(source, target, strict=True) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name if default is None else default)


def place(room: Column) -> Column:
    """Where something is in Russian; an unknown room is named as it is."""
    return translated(room, ROOMS, RU_PLACES, F.concat(F.lit("в "), room))


def verb(name: Column, man: str, woman: str) -> Column:
    """The form of a verb for a character; one that isn't known counts as a man."""
    return F.when(F.coalesce(name.isin(FEMALE), F.lit(False)), woman).otherwise(man)


def language_of(code: str) -> str:
    """Any code but 'ru' is English."""
    return "ru" if code == "ru" else "en"


def question(qtype: str, language: str = "en", length: int | None = None, whole: bool = False) -> Column:
    """The text of a query for bindings c0, c1, r0, r1, frame, is_more, f0, f1, n_crowd. With `length`, a range of all steps isn't said; with `whole`, none is."""
    ru = language == "ru"

    def piece(spec: str) -> Column:
        name, *forms = spec.split("|")
        if forms:
            return F.when(F.col(name) if name == "is_more" else ~F.col(name).isin(FEMALE), forms[0]).otherwise(forms[1])
        if name == "e":
            if whole:
                return F.lit("?")
            said = rendered(BETWEEN[ru])
            return said if length is None else F.when((F.col("f0") == 1) & (F.col("f1") == length), "?").otherwise(said)
        if ru and name[0] in "cr" and name[1:].isdigit():
            return translated(F.col(name), CHARS, RU_CHARS) if name[0] == "c" else place(F.col(name))
        return F.col(name).cast("string")

    def rendered(text: str) -> Column:
        parts = _PART.split(text)
        return F.concat(*(piece(p) if k % 2 else F.lit(p) for k, p in enumerate(parts)))

    return rendered(TEXTS[qtype][ru])


def question_sql(qtype: str, language: str, length: int) -> str:
    """The same as DuckDB SQL."""
    ru = language == "ru"
    case = lambda name, a, b: f"CASE {name} " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in zip(a, b, strict=True)) + f" ELSE {name} END"

    def piece(spec: str) -> str:
        name, *forms = spec.split("|")
        if forms:
            test = name if name == "is_more" else f"{name} NOT IN ('" + "', '".join(FEMALE) + "')"
            return f"CASE WHEN {test} THEN '{forms[0]}' ELSE '{forms[1]}' END"
        if name == "e":
            return f"CASE WHEN f0 = 1 AND f1 = {length} THEN '?' ELSE {rendered(BETWEEN[ru])} END"
        if ru and name in ("c0", "c1"):
            return case(name, CHARS, RU_CHARS)
        if ru and name in ("r0", "r1"):
            return case(name, ROOMS, RU_PLACES)
        return f"CAST({name} AS VARCHAR)"

    def rendered(text: str) -> str:
        return "concat(" + ", ".join(piece(p) if k % 2 else f"'{p}'" for k, p in enumerate(_PART.split(text))) + ")"

    return rendered(TEXTS[qtype][ru])


def translate_question(text: Column) -> Column:
    """The Russian of an English question text; unknown text stays as it is (compare with it to find what is unmatched)."""
    out = text
    for qtype, (en, ru) in TEXTS.items():
        names: list[str] = []

        def group(m: re.Match, names=names) -> str:
            spec = m[1]
            names.append(spec.split("|")[0])
            name = names[-1]
            if name == "is_more":
                return "(" + "|".join(spec.split("|")[1:]) + ")"
            return {"c": "(" + "|".join(CHARS) + ")", "r": "(" + "|".join(ROOMS) + ")", "e": r"( between steps \d+ and \d+\?|\?)"}.get(name[0], r"(\d+)")

        parts = _PART.split(en)
        pattern = "^" + "".join(group(re.match(r"(.*)", p)) if k % 2 else re.escape(p) for k, p in enumerate(parts)) + "$"
        more = en[en.find("{is_more|") + 9 :].split("|")[0] if "{is_more|" in en else ""

        def said(spec: str, names=names, pattern=pattern, more=more) -> Column:
            name, *forms = spec.split("|")
            value = F.regexp_extract(text, pattern, names.index(name) + 1)
            if forms:
                return F.when(value == more if name == "is_more" else ~value.isin(FEMALE), forms[0]).otherwise(forms[1])
            if name == "e":
                steps = F.concat(F.lit(" между шагами "), F.regexp_extract(value, r"(\d+) and", 1), F.lit(" и "), F.regexp_extract(value, r"and (\d+)", 1), F.lit("?"))
                return F.when(value == "?", "?").otherwise(steps)
            return translated(value, CHARS, RU_CHARS) if name[0] == "c" and name[1:].isdigit() else place(value) if name[0] == "r" else value

        out = F.when(text.rlike(pattern), F.concat(*(said(p) if k % 2 else F.lit(p) for k, p in enumerate(_PART.split(ru))))).otherwise(out)
    return out
