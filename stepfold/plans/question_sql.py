"""The same queries as DuckDB SQL, for checking."""

from __future__ import annotations

from stepfold.model import CHARS, NOBODY, ROOMS
from stepfold.plans.state import EVENT_ROOMS


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def prelude(length: int = 32, ranged: bool = False) -> str:
    room = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ROOMS.items()) + " END"
    f0, f1 = ("seq_id % 8 + 1", f"{length} - seq_id % 5") if ranged else ("1", str(length))
    return f"""WITH mv AS (SELECT event_id // {length} AS seq_id, event_id % {length} + 1 AS step_id, user_id % 5 AS ch_ord, {room} AS room FROM events),
seqs AS (SELECT seq_id FROM mv GROUP BY seq_id HAVING count(*) = {length}),
grid AS (SELECT seq_id, s.step_id, c.ch_ord FROM seqs, range(1, {length + 1}) s(step_id), range(0, 5) c(ch_ord)),
state AS (SELECT seq_id, step_id, ch_ord, {_list(CHARS)}[ch_ord + 1] AS ch, coalesce(last_value(room IGNORE NULLS) OVER (PARTITION BY seq_id, ch_ord ORDER BY step_id), '{ROOMS[0]}') AS room FROM grid LEFT JOIN mv USING (seq_id, step_id, ch_ord)),
param AS (SELECT seq_id, {_list(CHARS)}[seq_id % 5 + 1] AS c0, {_list(CHARS)}[(seq_id % 5 + 1 + seq_id // 5 % 4) % 5 + 1] AS c1, {_list(ROOMS)}[seq_id % 6 + 1] AS r0, {_list(ROOMS)}[(seq_id % 6 + 1 + seq_id // 6 % 5) % 6 + 1] AS r1, seq_id * 7 % {length} + 1 AS frame, seq_id % 2 = 0 AS is_more, {f0} AS f0, {f1} AS f1, 3 AS n_crowd FROM seqs),
b AS (SELECT * FROM state JOIN param USING (seq_id)),
occ AS (SELECT seq_id, step_id, room, count(*) AS n, min(ch) AS who FROM state GROUP BY ALL),
rooms AS (SELECT unnest({_list(ROOMS)}) AS room), chars AS (SELECT unnest({_list(CHARS)}) AS ch),
"""


def _event(who: str, where: str, inv: bool) -> str:
    return f"(SELECT seq_id, {'max' if inv else 'min'}(step_id) AS step_id FROM b WHERE ch = {who} AND room = {where} GROUP BY seq_id)"


SOLE = f"CASE WHEN n <= 1 THEN CASE WHEN n = 0 THEN '{NOBODY}' ELSE who END END"


def _extreme(counts: str, key: str, most: str = "is_more", allowed: str = "true") -> str:
    return f"(SELECT seq_id, CASE WHEN count(*) = 1 AND bool_and({allowed}) THEN min(k) END AS answer FROM (SELECT seq_id, {key} AS k, n, is_more, f0, f1, CASE WHEN {most} THEN max(n) OVER (PARTITION BY seq_id) ELSE min(n) OVER (PARTITION BY seq_id) END AS best FROM {counts}) WHERE n = best GROUP BY seq_id)"


def _counted(dim: str, key: str, hits: str, where: str = "true") -> str:
    return f"(SELECT p.*, d.{key}, coalesce(h.n, 0) AS n FROM param p CROSS JOIN {dim} d LEFT JOIN (SELECT seq_id, {key}, count(*) AS n FROM {hits} GROUP BY ALL) h ON h.seq_id = p.seq_id AND h.{key} = d.{key} WHERE {where})"


def bodies() -> dict[str, tuple[str, str]]:
    """Of each query: a relation (seq_id, answer) and a relation of its cells (seq_id, step_id, room). `a` is the first in the second."""
    out: dict[str, tuple[str, str]] = {}
    for inv, names in ((False, ("first_app", "char_on_char_first_app", "first_at_room", "room_on_char_first_app", "n_room_on_char_first_app")), (True, ("final_app", "char_on_char_final_app", "last_at_room", "room_on_char_final_app", "n_room_on_char_final_app"))):
        end = "max" if inv else "min"
        one = f"(SELECT seq_id, step_id, room FROM b WHERE ch = c0 QUALIFY step_id = {end}(step_id) OVER (PARTITION BY seq_id))"
        out[names[0]] = (f"(SELECT seq_id, room AS answer FROM {one})", one)
        two = f"(SELECT b.seq_id, b.step_id, b.room, b.r0 FROM b JOIN {_event('c1', 'r0', inv)} e USING (seq_id, step_id) WHERE ch = c0)"
        out[names[1]] = (f"(SELECT seq_id, room AS answer FROM {two})", f"(SELECT seq_id, step_id, unnest([room, r0]) AS room FROM {two})")
        seen = f"(SELECT occ.* FROM occ JOIN param USING (seq_id) WHERE room = r0 QUALIFY step_id = {end}(step_id) OVER (PARTITION BY seq_id))"
        out[names[2]] = (f"(SELECT p.seq_id, CASE WHEN n IS NULL THEN '{NOBODY}' WHEN n = 1 THEN who END AS answer FROM param p LEFT JOIN {seen} s ON s.seq_id = p.seq_id)", seen)
        at = f"(SELECT p.seq_id, e.step_id, p.r0, p.r1, coalesce(o.n, 0) AS n, o.who FROM {_event('c0', 'r1', inv)} e JOIN param p ON p.seq_id = e.seq_id LEFT JOIN occ o ON o.seq_id = e.seq_id AND o.step_id = e.step_id AND o.room = p.r0)"
        cells = f"(SELECT seq_id, step_id, unnest([r0, r1]) AS room FROM {at})"
        out[names[3]] = (f"(SELECT seq_id, {SOLE} AS answer FROM {at})", cells)
        out[names[4]] = (f"(SELECT seq_id, n AS answer FROM {at})", cells)
    frame = "(SELECT * FROM b WHERE ch = c0 AND step_id = frame)"
    out["char_at_frame"] = (f"(SELECT seq_id, room AS answer FROM {frame})", frame)
    at = "(SELECT p.seq_id, p.frame AS step_id, p.r0 AS room, coalesce(o.n, 0) AS n, o.who FROM param p LEFT JOIN occ o ON o.seq_id = p.seq_id AND o.step_id = p.frame AND o.room = p.r0)"
    out["room_at_frame"] = (f"(SELECT seq_id, {SOLE} AS answer FROM {at})", at)
    with_me = f"(SELECT m.seq_id, m.step_id, m.room, count(*) FILTER (s.ch <> m.c0) AS n, min(s.ch) FILTER (s.ch <> m.c0) AS who FROM {frame} m JOIN state s ON s.seq_id = m.seq_id AND s.step_id = m.step_id AND s.room = m.room GROUP BY ALL)"
    out["char_on_char_at_frame"] = (f"(SELECT seq_id, {SOLE} AS answer FROM {with_me})", with_me)
    out["n_char_at_frame"] = (f"(SELECT seq_id, n AS answer FROM {with_me})", with_me)
    empty = "(SELECT p.seq_id, p.frame AS step_id, r.room, o.n IS NULL AS e FROM param p CROSS JOIN rooms r LEFT JOIN occ o ON o.seq_id = p.seq_id AND o.step_id = p.frame AND o.room = r.room)"
    out["n_empty"] = (f"(SELECT seq_id, count(*) FILTER (e) AS answer FROM {empty} GROUP BY seq_id)", f"(SELECT * FROM {empty} QUALIFY e OR NOT bool_or(e) OVER (PARTITION BY seq_id))")
    span = "step_id BETWEEN f0 AND f1"
    used = f"(SELECT occ.seq_id, occ.step_id, occ.room, n, n_crowd FROM occ JOIN param USING (seq_id) WHERE {span})"
    steps = "(SELECT p.seq_id, unnest(range(p.f0, p.f1 + 1)) AS step_id, {} AS room FROM param p JOIN a ON a.seq_id = p.seq_id WHERE a.answer IS NOT NULL)"
    won = "(SELECT h.* FROM {} h JOIN a ON a.seq_id = h.seq_id AND a.answer = h.{})"
    out["room_empty"] = (_extreme(f"(SELECT * REPLACE (f1 - f0 + 1 - n AS n) FROM {_counted('rooms', 'room', used)})", "room"), steps.format("a.answer"))
    own = f"(SELECT * FROM b WHERE ch = c0 AND {span})"
    out["where_spend"] = (_extreme(_counted("rooms", "room", own), "room", allowed="is_more OR 6 - (f1 - f0 + 1) <= 1"), won.format(own, "room"))
    crowds = f"(SELECT * FROM {used} WHERE n >= n_crowd)"
    out["crowded_room"] = (_extreme(_counted("rooms", "room", crowds), "room", "true"), won.format(crowds, "room"))
    inside = f"(SELECT * FROM b WHERE room = r0 AND {span})"
    out["who_spend"] = (_extreme(_counted("chars", "ch", inside), "ch"), steps.format("p.r0"))
    alone = f"(SELECT occ.seq_id, step_id, room, who AS ch FROM occ JOIN param USING (seq_id) WHERE n = 1 AND {span})"
    out["spend_alone"] = (_extreme(_counted("chars", "ch", alone), "ch", allowed="is_more OR f1 - f0 >= 2"), won.format(alone, "ch"))
    both = f"(SELECT m.seq_id, m.step_id, m.room, s.ch FROM {own} m JOIN state s ON s.seq_id = m.seq_id AND s.step_id = m.step_id AND s.room = m.room AND s.ch <> m.c0)"
    out["spend_together"] = (_extreme(_counted("chars", "ch", both, "d.ch <> p.c0"), "ch"), won.format(both, "ch"))
    mine = f"(SELECT * FROM b WHERE ch = c0 AND room = r0 AND {span})"
    count = "(SELECT p.seq_id, coalesce(x.n, 0) AS answer FROM param p LEFT JOIN (SELECT seq_id, {} AS n FROM {} GROUP BY seq_id) x ON x.seq_id = p.seq_id)"
    out["steps_in_room"] = (count.format("count(*)", mine), mine)
    first = f"(SELECT seq_id, room, min(step_id) AS step_id FROM {own} GROUP BY ALL)"
    out["rooms_visited"] = (count.format("count(*)", first), first)
    out["crowd_count"] = (count.format("count(DISTINCT step_id)", crowds), crowds)
    return out


def answer_sql(qtype: str, ranged: bool = False, length: int = 32) -> str:
    return prelude(length, ranged) + f"a AS {bodies()[qtype][0]}\nSELECT p.seq_id, CAST(a.answer AS VARCHAR) AS answer, a.answer IS NOT NULL AS valid FROM param p LEFT JOIN a ON a.seq_id = p.seq_id"


def cells_sql(qtype: str, ranged: bool = False, length: int = 32) -> str:
    answer, cells = bodies()[qtype]
    return prelude(length, ranged) + f"a AS {answer}\nSELECT DISTINCT seq_id, step_id, room FROM {cells} WHERE room IS NOT NULL"
