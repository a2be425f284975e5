"""Problem 9: text cut off by a field limit or during transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.names import name_key
from tapeloom.operators.skew import lookup_join
from tapeloom.plans.tables import read, written

#: Context lengths of the model, in characters.
ORDERS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
DEPTH = max(ORDERS)
#: Bits of the filter that keeps contexts no text ends with out of the count; its size is fixed, and it only ever spares work.
FILTER_BITS = 26
#: Characters handled at a time, weight of the shorter context, and length of the final window that counts once.
BLOCK, KAPPA, WINDOW = 1 << 18, 4.0, 64
#: Thresholds lie within LIMIT of neutral log-odds, in steps of 1/STEPS, where the fewest texts lie within 1 of them.
LIMIT, STEPS = 1, 4
#: Frequent short words by which a text's language is told.
FUNCTION_WORDS = {
    "de": (" der ", " die ", " und ", " das ", " den ", " nicht ", " von ", " mit ", " wurde ", " auf ", " im "),
    "en": (" the ", " and ", " of ", " to ", " was ", " in ", " on ", " with ", " at ", " by ", " for "),
    "fr": (" le ", " la ", " les ", " des ", " et ", " une ", " du ", " est ", " a ", " au ", " dans "),
}
#: Spoken figures; they and runs of digits count as two characters, so that contexts don't hang on the figures.
FIGURES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "niner")
INSIDE, FIGURE = "\x02", "\x020"
_FIGURE = re.compile(r"\d+|\b(?:" + "|".join(FIGURES) + r")\b")
_STARTS = sorted({f[:i] for f in FIGURES for i in range(1, len(f)) if f[:i] not in FIGURES}, key=len, reverse=True)
_BEGUN = re.compile(r"(?<=\s)(?:" + "|".join(x for x in _STARTS if len(x) > 1) + r")$|(?<=\x020 )[" + "".join(x for x in _STARTS if len(x) == 1) + "]$")
_STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
_BLANKS = np.array([9, 10, 11, 12, 13, 32, 0xA0, 0x2009, 0x3000], np.uint32)
_B = np.uint64(0x9E3779B97F4A7C15)


def language(text: str, stated: str | None) -> str:
    """By the text's function words, else as stated, else und."""
    t = " " + re.sub(r"\s+", " ", text.lower()) + " "
    n = {k: sum(map(t.count, v)) for k, v in FUNCTION_WORDS.items()}
    best = max(n, key=n.get)
    return best if n[best] else stated if stated in FUNCTION_WORDS else "und"


def plain(text: str) -> str:
    """The text as the model reads it: up to its last visible character, without a closing ellipsis, lower case, figures as FIGURE, one that is cut short at the end as INSIDE.

    A broken last character (U+FFFD) is left out.
    """
    t = re.sub(r"\s*(?:\.\.\.|…)$", "", text.rstrip().rstrip("�").rstrip())
    return _BEGUN.sub(INSIDE, _FIGURE.sub(FIGURE, t.lower()))


def _hashes(codes: np.ndarray, at: np.ndarray, known=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (places, hashes of the contexts that end with the code there, read backward from it).

    With known only places go on whose context it knows: a longer context can only be asked for where the shorter one is.
    """
    h, n = np.zeros(len(at), np.uint64), 0
    for order in ORDERS:
        while n < order:
            h = h * _B + codes[at - n] + np.uint64(1)
            n += 1
        x = (h ^ (h >> np.uint64(31)) ^ np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        if known is not None:
            hit = np.flatnonzero(known(x))
            at, h, x = at[hit], h[hit], x[hit]
        yield at, x


def final_contexts(plains: list[str]) -> np.ndarray:
    """texts x orders: hashes of the contexts that the texts end with; short texts are filled up with zeros in front."""
    codes = np.frombuffer("".join(t[-DEPTH:].rjust(DEPTH, "\x00") for t in plains).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(1, len(plains) + 1) * DEPTH - 1
    return np.stack([h for _, h in _hashes(codes.astype(np.uint64), at)], axis=1) if plains else np.zeros((0, len(ORDERS)), np.uint64)


def places(plains: list[str], known=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (hashes of contexts, whether a unit ends there) of all places in the texts but their ends, or of those whose context is known.

    A unit ends before a line break, before stops that a blank or the end follows, and after them; everywhere else but after a blank text goes on.
    """
    pad = "\x00" * DEPTH
    codes = np.frombuffer("".join(pad + t + "\x00" for t in plains).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank, stop, no = np.isin(codes, _BLANKS), np.isin(codes, _STOPS), codes == 0
    nxt = np.append(codes[1:], 0)
    closing = stop & np.append((blank | no)[1:], True)
    after = closing.copy()
    for _ in range(2):
        closing |= stop & np.append(closing[1:], False)
    place = np.flatnonzero(~blank & ~no & (nxt != 0))
    end = (nxt == 10) | np.append(closing[1:], False) | after
    for at, h in _hashes(codes.astype(np.uint64), place, known):
        yield h, end[at]


def _in_filter(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    i = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _blocks(values: list) -> Iterator[list]:
    part, size = [], 0
    for v in values:
        if part and size + len(v[-1]) > BLOCK:
            yield part
            part, size = [], 0
        part.append(v)
        size += len(v[-1])
    if part:
        yield part


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, stated = b.column("text").to_pylist(), b.column("lang").to_pylist()
        plains = [plain(t) for t in texts]
        # of very long texts the model reads all places, but only the last characters decide the final context
        h = final_contexts(plains).view(np.int64)
        ctx = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(ORDERS), pa.int32()), pa.array(h.reshape(-1)))
        window = [t[-WINDOW:] for t in plains]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array([language(t, s) for t, s in zip(texts, stated)], pa.string()), pa.array(window, pa.string()), pa.array([t.rstrip().endswith("�") for t in texts]), ctx], ["id", "source", "lang", "window", "broken", "ctx"])


def _counts(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _blocks([(plain(t),) for t in b.column("text").to_pylist()]):
                for h, end in places([p[0] for p in part], lambda x: _in_filter(x, bits)):
                    code, keys = pd.factorize(h)
                    e = np.bincount(code, end, len(keys)).astype(np.int64)
                    n = np.bincount(code, minlength=len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys, np.uint64).view(np.int64)), pa.array(e), pa.array(n - e)], ["h", "ends", "goes_on"])

    return run


def truncation_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, source, lang, log_odds, broken) of each text with a visible character: how likely, against any place, text ends where this one does.

    A backward character model: for the contexts of 1 to 24 characters that texts end with, it counts over all places of all texts how often a unit ends there and how often text goes on
    (ends of texts count once for each different final window, and not for the text itself); a longer context corrects a shorter one's estimate as far as it was seen.
    Contexts are 64-bit hashes; a filter of fixed size, made of the final contexts, keeps others from being counted. Null and blank texts and null keys are no case; repeated rows give repeated rows.
    """
    rows = docs.select(F.col(key).alias("id"), name_key(F.col(source)).alias("source"), name_key(F.col(lang)).alias("lang"), F.col(text).alias("text")).where(r"id is not null and text rlike '[^\\s]'")
    kind = dict(rows.dtypes)["id"]
    ends = written(rows.mapInArrow(_ends, f"id {kind}, source string, lang string, window string, broken boolean, ctx array<bigint>").withColumn("row", F.monotonically_increasing_id()), "ends")
    once = ends.groupBy("window").agg(F.first("ctx").alias("ctx"))
    own = once.select(F.explode("ctx").alias("h")).groupBy("h").agg(F.count("*").alias("own"))
    needed = written(ends.select(F.explode("ctx").alias("h")).groupBy("h").agg(F.count("*").alias("texts")).join(own, "h", "left"), "needed")
    # one bit for each needed context: at most 2**FILTER_BITS / 64 rows, whatever the data
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    word = needed.groupBy(F.shiftrightunsigned(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[word["w"].to_numpy()] = word["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint8))
    counted = rows.select("text").mapInArrow(lambda it: _counts(shared.value)(it), "h bigint, ends bigint, goes_on bigint").groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    zero = F.lit(0)
    model = needed.join(counted, "h", "left").select("h", "texts", (F.coalesce("ends", zero) + F.greatest(F.coalesce("own", zero) - 1, zero)).cast("double").alias("e"), F.coalesce("goes_on", zero).cast("double").alias("c"))
    model = written(model, "model")
    flat = ends.select("id", "source", "lang", "broken", "row", F.posexplode("ctx").alias("o", "h"))
    seen = lookup_join(flat, model, ["h"], "texts").groupBy("row", "id", "source", "lang", "broken").agg(F.sort_array(F.collect_list(F.struct("o", "e", "c"))).alias("m"))
    top = written(model.agg(F.sum("e").alias("e"), F.sum("c").alias("c")), "all")
    share = top.first()
    p0 = ((share["e"] or 0) + 1) / ((share["e"] or 0) + (share["c"] or 0) + 2)
    p = F.aggregate("m", F.lit(p0), lambda p, x: (x["e"] + KAPPA * p) / (x["e"] + x["c"] + KAPPA))
    clipped = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return seen.select(F.col("id").alias(key), "source", "lang", F.round(F.log(clipped / (1 - clipped)) - float(np.log(p0 / (1 - p0))), 6).alias("log_odds"), "broken")


def thresholds(scores: DataFrame) -> dict[str, float]:
    """For each language the log-odds, within LIMIT of neutral, around which the fewest of its texts lie: the valley between cut and finished texts. Of several the nearest to neutral, then the lower.

    From counts of all texts in steps of 1/STEPS (four languages, so a hundred rows or so).
    """
    reach = (LIMIT + 1) * STEPS
    bins = scores.where(~F.col("broken")).groupBy("lang", F.floor(F.col("log_odds") * STEPS).cast("int").alias("bin")).agg(F.count("*").alias("n")).where(f"bin between {-reach} and {reach - 1}").collect()
    count: dict[str, np.ndarray] = {}
    for r in bins:
        count.setdefault(r["lang"], np.zeros(2 * reach, np.int64))[r["bin"] + reach] += r["n"]
    at = np.arange(-LIMIT * STEPS, LIMIT * STEPS + 1)
    return {lang: float(min(at, key=lambda c: (n[c + reach - STEPS : c + reach + STEPS].sum(), abs(c), c))) / STEPS for lang, n in count.items()}


def truncated(scores: DataFrame) -> DataFrame:
    """Adds `cut`: the log-odds lie under the language's threshold, or the last character is broken (U+FFFD, which no finished text ends with)."""
    scores = written(scores, "scores")
    found = [x for kv in thresholds(scores).items() for x in kv]
    limit = F.coalesce(F.create_map(*map(F.lit, found))[F.col("lang")], F.lit(0.0)) if found else F.lit(0.0)
    return scores.withColumn("cut", (F.col("log_odds") < limit) | F.col("broken"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(truncation_scores(read(spark, d, "documents"))).where("cut").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts; names as letters and digits, null and letterless ones together."""
    name = F.when(F.col("source") != "", F.col("source"))
    return truncated(truncation_scores(read(spark, d, "documents"))).groupBy(name.alias("source")).agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_sources": p9_sources}
