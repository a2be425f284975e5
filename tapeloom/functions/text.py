"""Text functions as Column expressions: null in, null out unless a docstring says otherwise. SURVEY 2.9."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions import vocab


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once although lambdas within use it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(c: Column) -> Column:
    """ST-1: lower case, anything but letters, digits and underscores to blanks, single blanks, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def digits_to_words(c: Column) -> Column:
    """ST-2: each figure of a run of digits as its spoken word; a point or dash between digits is spoken too."""
    # inner points and dashes first, as they are told by the digits around them; then figures, each followed by a mark that ends up as one blank
    out = F.regexp_replace(c, r"(?<=\d)[.](?=\d)", "\x01decimal\x01")
    out = F.regexp_replace(out, r"(?<=\d)-(?=\d)", "\x01dash\x01")
    for d in "0123456789":
        out = F.replace(out, F.lit(d), F.lit(f"\x02{vocab.SPOKEN[d]}\x03"))
    return F.regexp_replace(F.regexp_replace(out, "\x03\x02|\x03\x01|\x01\x02", " "), "[\x01\x02\x03]", "")


def scoring_form(c: Column) -> Column:
    """ST-3: spoken digits, then normalised."""
    return normalize(digits_to_words(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """ST-4: the words between white space."""
    return F.filter(F.split(c, r"[\s\p{Z}]+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def hits(toks: Column, words: list[str]) -> Column:
    """ST-5: how many tokens are among the words."""
    return F.size(F.filter(toks, lambda x: x.isin(words)))


def run_classes(toks: Column) -> Column:
    """A string with a letter for each token: A anchors a callsign, N is a figure, O anything else."""
    anchor = [*vocab.PHONETIC, *vocab.OPERATORS]
    return F.array_join(F.transform(toks, lambda x: F.when(x.isin(anchor), "A").when(x.isin(vocab.NUMERALS), "N").otherwise("O")), "")


def callsign_runs(toks: Column) -> Column:
    """ST-6: runs of two or more anchors and figures that hold an anchor."""
    return F.size(F.filter(F.split(run_classes(toks), "O+"), lambda r: (F.length(r) >= 2) & r.contains("A")))


def strip_greetings(c: Column) -> Column:
    """ST-8: without greeting and filler phrases, which are whole words, the longest first; single blanks."""
    phrases = sorted(vocab.GREETINGS, key=lambda p: (-len(p), p))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?<!\S)(?:" + "|".join(phrases) + r")(?!\S)", " "), r"\s+", " "))


def trainable(c: Column) -> Column:
    """PF13: two words or more, and more than greetings; null is not."""
    return F.coalesce((word_count(c) >= 2) & (strip_greetings(c) != ""), F.lit(False))


def recorded_at(path: Column) -> Column:
    """ST-9: the YYYYMMDD_HHMMSS in a file name as ISO text; null without a valid one."""
    return F.date_format(F.try_to_timestamp(F.nullif(F.regexp_extract(path, r"(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss")), "yyyy-MM-dd'T'HH:mm:ss")


def stem(path: Column) -> Column:
    """File name without its folder and last extension; null gives ''."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")


def session_key(path: Column, pattern: str = r"^(.+)_\d+$") -> Column:
    """ST-10: the stem's session part, else the stem itself."""
    s = stem(path)
    return F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")), s)


def word_errors(ref: Column, hyp: Column) -> Column:
    """ST-11: least number of words to insert, delete or replace. Words become characters, numbered within the pair, for the built-in edit distance.

    Numbers run through Unicode from U+0100 on, the surrogates left out, so a pair may hold 1,111,807 different words; more raise an error.
    """

    def letter(n: Column) -> Column:
        # big-endian UTF-32; the distance counts whole characters
        code = n + 255 + F.when(n > 55040, 2048).otherwise(0)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def distance(p):
        def coded(known):
            number = F.map_from_arrays(known, F.transform(known, lambda _, i: letter(i + 1)))
            return let(number, lambda m: F.levenshtein(*(F.array_join(F.transform(p[c], lambda w: F.element_at(m, w)), "") for c in "ab")))

        return let(F.array_distinct(F.concat(p["a"], p["b"])), lambda known: F.when(F.size(known) > 1_111_807, F.raise_error(F.lit("too many different words in a pair")).cast("int")).otherwise(coded(known)))

    return F.when(ref.isNotNull() & hyp.isNotNull(), let(F.struct(tokens(F.coalesce(ref, F.lit(""))).alias("a"), tokens(F.coalesce(hyp, F.lit(""))).alias("b")), distance))


def wer(ref: Column, hyp: Column) -> Column:
    """ST-13: word errors per reference word; null for an empty reference."""
    return F.try_divide(word_errors(ref, hyp), word_count(ref))


def cer(ref: Column, hyp: Column) -> Column:
    """ST-12: character errors per reference character; null for an empty reference."""
    return F.try_divide(F.levenshtein(ref, hyp), F.length(ref))


def token_recall(ref: Column, hyp: Column, words: list[str]) -> Column:
    """ST-16: share of the reference's tokens among words that the hypothesis holds too; null where there is none (T22)."""
    wanted = F.filter(tokens(ref), lambda x: x.isin(words))
    return let(F.struct(wanted.alias("w"), tokens(hyp).alias("h")), lambda p: F.try_divide(F.size(F.filter(p["w"], lambda x: F.array_contains(p["h"], x))), F.size(p["w"])))


def pattern_recall(ref: Column, hyp: Column, pattern: str) -> Column:
    """ST-17: 1 if the hypothesis has the pattern the reference has, else 0; null where the reference hasn't."""
    return F.when(ref.rlike(pattern), hyp.rlike(pattern).cast("double"))


_NUMBER = "one|two|three|four|five|six|seven|eight|nine|niner|zero"
_N = f"(?:{_NUMBER})"
#: ST-18, fixed values: patterns of spoken numbers in normalised transcripts.
PATTERNS = {
    "frequency": rf"\b{_N}(?: {_N}){{2,}}(?: decimal(?: {_N}){{1,3}})\b",
    "runway": rf"\brunway {_N}(?: {_N})?(?: left| right| center)?\b",
    "heading": rf"\bheading(?: {_N}){{3}}\b",
    "altitude": rf"\b(?:climb|descend|maintain)(?: to)?(?: (?:{_NUMBER}|flight|level|hundred|thousand))+\b",
}


def clock_seconds(c: Column) -> Column:
    """ST-20: h:m:s, m:s or s in seconds; anything else is null."""
    parts = F.transform(F.split(c, ":"), lambda x: x.cast("double"))
    return F.when(c.rlike(r"^\d+(:\d+){0,2}$"), F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x))


def human_size(n: Column) -> Column:
    """ST-21: bytes as text with a unit up to TB."""
    unit = F.when(n < 1 << 10, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).when(n < 1 << 40, 3).otherwise(4)
    return F.format_string("%.1f %s", n / F.pow(F.lit(1024.0), unit), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1))


def squeeze(c: Column) -> Column:
    """ST-23: single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def shown(c: Column, most: int = 60) -> Column:
    """ST-24: for display: line breaks as ' / ', cut with an ellipsis."""
    one = F.regexp_replace(c, r"\n", " / ")
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def first_line(c: Column) -> Column:
    """ST-25."""
    return F.split(c, "\n")[0]


def tool_calls(c: Column) -> Column:
    """ST-26: XML-style calls as array<struct<name, params: map>>."""
    calls = F.regexp_extract_all(c, F.lit(r"(?s)<function=(?:[^>]+)>.*?</function>"), F.lit(0))
    names = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)<parameter=([^>]+)>.*?</parameter>"), F.lit(1))
    values = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<parameter=[^>]+>(.*?)</parameter>"), F.lit(1)), lambda v: F.trim(F.regexp_replace(v, r"^\s+|\s+$", "")))
    return F.transform(calls, lambda x: F.struct(F.regexp_extract(x, r"<function=([^>]+)>", 1).alias("name"), F.map_from_arrays(names(x), values(x)).alias("params")))


def prompt(text: Column, hints: Column) -> Column:
    """ST-27: the message for an annotator, with hints (array<struct<label, text>>) if there are any."""
    said = F.array_join(F.transform(hints, lambda h: F.concat(h["label"], F.lit(" '"), h["text"], F.lit("'"))), "; ")
    return F.when(F.coalesce(F.size(hints), F.lit(0)) > 0, F.concat(F.lit("Utterance: "), text, F.lit("\nHints: "), said)).otherwise(F.concat(F.lit("Utterance: "), text))


def config_parts(c: Column) -> Column:
    """ST-28: model/backend/device-threads as a struct; threads is null without them."""
    p = F.split(c, "/")
    last = F.get(p, F.lit(2))
    return F.struct(F.get(p, F.lit(0)).alias("model"), F.get(p, F.lit(1)).alias("backend"), F.split(last, "-")[0].alias("device"), F.nullif(F.regexp_extract(last, r"-(\d+)t?$", 1), F.lit("")).cast("int").alias("threads"))


def store_uri(c: Column) -> Column:
    """ST-29: scheme://bucket/key as a struct; nulls if it isn't one."""
    part = lambda i: F.when(c.rlike(r"^\w+://[^/]+"), F.regexp_extract(c, r"^\w+://([^/]+)/?(.*?)/*$", i))
    return F.struct(part(1).alias("bucket"), part(2).alias("key"))


def safe_name(c: Column) -> Column:
    """ST-22: the last part of a model id, in characters fit for file names."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]+)/*$", 1), r"[^A-Za-z0-9._-]+", "-")


def features(c: Column) -> list[Column]:
    """ST-7: the transcript columns in one projection."""
    n = normalize(c)
    t = tokens(n)
    return [
        n.alias("transcript_normalized"), F.size(tokens(F.coalesce(c, F.lit("")))).alias("word_count"), F.length(F.coalesce(c, F.lit(""))).alias("character_count"),
        hits(t, vocab.NUMERALS).alias("numeric_token_count"), hits(t, vocab.VERBS).alias("command_verb_count"), callsign_runs(t).alias("callsign_like_count"),
    ]
