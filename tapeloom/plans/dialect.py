"""Pieces of DuckDB SQL that say the same as the engine's Column functions."""

from __future__ import annotations

from tapeloom.functions import vocab


def words(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def key(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def toks(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '[\s\p{{Z}}]+'), lambda x: x <> '')"


def hits(t: str, ws: list[str]) -> str:
    return f"len(list_filter({t}, lambda x: list_contains({words(ws)}, x)))"


def runs(t: str) -> str:
    anchors = words([*vocab.PHONETIC, *vocab.OPERATORS])
    cls = f"array_to_string(list_transform({t}, lambda x: CASE WHEN list_contains({anchors}, x) THEN 'A' WHEN list_contains({words(vocab.NUMERALS)}, x) THEN 'N' ELSE 'O' END), '')"
    return f"len(list_filter(string_split_regex({cls}, 'O+'), lambda r: length(r) >= 2 AND contains(r, 'A')))"


def word_errors(a: str, b: str) -> str:
    """For pairs with fewer than 90 different words."""
    code = lambda t: f"array_to_string(list_transform({t}, lambda w: chr(CAST(33 + list_position(list_sort(list_distinct(list_concat({a}, {b}))), w) AS INTEGER))), '')"
    return f"levenshtein({code(a)}, {code(b)})"


def ungreeted(c: str) -> str:
    """Blanks between words are doubled, so that neighbouring phrases each have their own."""
    phrases = "|".join(p.replace(" ", "  ") for p in sorted(vocab.GREETINGS, key=lambda p: (-len(p), p)))
    return rf"trim(regexp_replace(regexp_replace(' ' || replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' ', '  ') || ' ', ' (?:{phrases}) ', ' ', 'g'), '\s+', ' ', 'g'))"


#: Both sides' labels of each row of the queue: o the labelled stretches in order (s, m = -end, k), d those that are disjoint, t the words with their places.
SIDES = rf"""
    WITH z AS (SELECT queue_id, text, 'a' side, opta ents FROM heldout_queue UNION ALL SELECT queue_id, text, 'b', optb FROM heldout_queue),
    o AS (SELECT queue_id, side, text, list_sort(list_transform(list_filter(coalesce(ents, []), lambda x: len(x.span) = 2), lambda x: {{'s': x.span[1], 'm': -(x.span[2]), 'k': upper({key('x.label')})}})) o FROM z),
    v AS (SELECT *, list_filter(o, lambda x: x.s >= 0 AND x.s < -(x.m) AND -(x.m) <= length(text)) v FROM o),
    d AS (SELECT *, CASE WHEN len(v) = 0 THEN [] ELSE list_reduce(list_transform(v, lambda x: [x]), lambda acc, x: CASE WHEN -(acc[len(acc)].m) <= x[1].s THEN list_concat(acc, x) ELSE acc END) END d FROM v),
    p AS (SELECT *, regexp_extract_all(text, '[\s\p{{Z}}]*[^\s\p{{Z}}]+') p FROM d),
    k AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: {{'w': regexp_replace(p[i], '^[\s\p{{Z}}]+', ''), 'e': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS INTEGER)}}) l FROM p),
    t AS (SELECT *, list_transform(l, lambda x: {{'w': x.w, 's': x.e - length(x.w), 'e': x.e}}) t FROM k)
"""


def constraint() -> str:
    """The first rule an entity breaks, for columns t (its text), w (its words), label and u (the utterance)."""
    some = lambda ws: f"len(list_filter(w, lambda x: list_contains({words(ws)}, x))) > 0"
    n, digits = some(vocab.NUMBERS), hits("w", vocab.DIGITS)
    isin = lambda ws: f"list_contains({words(ws)}, w[1])"
    of = lambda k, cond: f"label = '{k}' AND ({cond})"
    rules = [
        (some(["knot", "knots"]), "speed"), (f"{ungreeted('t')} = ''", "greeting"), (of("CALLSIGN", isin(vocab.NOT_CALLSIGN_START)), "callsign-start"), (of("CALLSIGN", f"{digits} = len(w)"), "callsign-only-digits"),
        *((of(k, f"NOT {some([k.lower()])} OR NOT {n}"), f"{k.lower()}-incomplete") for k in ("RUNWAY", "HEADING", "SQUAWK")),
        (of("ALTITUDE", f"NOT {n} OR NOT {some(vocab.ALTITUDE_UNITS)}"), "altitude-incomplete"), (of("ALTITUDE", isin(vocab.NOT_ALTITUDE_START)), "altitude-start"),
        (of("FREQUENCY", f"NOT {isin(vocab.NUMBERS)}"), "frequency-start"), (of("FREQUENCY", f"NOT {some(['decimal'])} AND {digits} < 4"), "frequency-short"),
        (of("FREQUENCY", "contains(' ' || u || ' ', ' speed ' || t || ' ') OR contains(' ' || u || ' ', ' mach ' || t || ' ')"), "frequency-is-speed"), (of("COMMAND", f"{n} OR (len(w) > 4 AND w[1] <> 'cleared')"), "command-shape"),
        (f"label IN ('WAYPOINT', 'FACILITY') AND {n}", "name-with-number"), (of("WAYPOINT", some(vocab.PROCEDURES)), "waypoint-procedure"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{why}'" for c, why in rules) + " END"
