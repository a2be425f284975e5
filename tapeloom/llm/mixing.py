"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.names import name_key
from tapeloom.llm.tokens import RANKS, token_counts
from tapeloom.plans.tables import read, written

MAX_SOURCES = 100_000


def mixed(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = RANKS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mix: key, source, copy, tokens; report: source, target_share, wanted_tokens, source_tokens, rate, mixed_tokens, actual_share, short).

    Tokens are summed per source; a source's rate is wanted / there, at most max_repeats; each document comes out floor(rate) times and once more
    with a chance of the fraction, decided by a hash of seed and key. Nothing but the sums per source is shuffled.
    Sources are compared as names and come out as in targets; a null or unknown source, a null key and a text without tokens are in no source; repeated rows of a key share its luck.
    A source without documents has rate 0 and is short if anything is wanted. Other columns are ignored.
    """
    t = targets.select("source", "target_share", "max_repeats", "mix_tokens")
    if t.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    t = t.select("*", name_key(F.col("source")).alias("_name"))
    named = docs.select(key, F.col(text).alias("_t"), name_key(F.col("source")).alias("_name")).where(F.col(key).isNotNull() & (F.col("_name") != ""))
    sized = written(token_counts(named, [key, "_name"], "_t", tokenizer).where("tokens > 0"), "tokens")
    sums = sized.groupBy("_name").agg(F.sum("tokens").alias("source_tokens"))
    wanted = F.col("target_share") * F.col("mix_tokens")
    have = F.coalesce("source_tokens", F.lit(0))
    rates = t.join(sums, "_name", "left").select("_name", "source", "target_share", wanted.alias("wanted_tokens"), have.alias("source_tokens"), F.when(have > 0, F.least(F.col("max_repeats").cast("double"), wanted / have)).otherwise(F.lit(0.0)).alias("rate"), (have * F.col("max_repeats") < wanted).alias("short"))
    rates = written(rates, "rates")
    luck = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = sized.join(F.broadcast(rates.select("_name", "source", "rate")), "_name")  # at most MAX_SOURCES rows
    copies = (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    mix = out.withColumn("n", copies).where("n > 0").select(key, "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")
    got = mix.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"))
    total = got.agg(F.sum("mixed_tokens").alias("total"))
    report = rates.join(got, "source", "left").join(F.broadcast(total)).select("source", "target_share", F.round("wanted_tokens", 3).alias("wanted_tokens"), "source_tokens", F.round("rate", 9).alias("rate"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.round(F.coalesce("mixed_tokens", F.lit(0)) / F.col("total"), 9).alias("actual_share"), "short")
    return mix, report


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixed(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed collection: each document as often as its source's rate asks."""
    return _run(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each source."""
    return _run(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short even at the highest number of repeats."""
    return _run(spark, d)[1].where("short").select("source")


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report}
