"""Quality checks with an audit log. SURVEY AG3-AG7, PF5-PF9, PF23, PF24, WN1-WN3."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def decode_ok(error: Column) -> Column:
    """PF9: no decode error; an empty one is none."""
    return F.coalesce(error, F.lit("")) == ""


@dataclass
class Check:
    """A row-local check: rows where `bad` holds are dropped, or only flagged."""

    name: str
    description: str
    bad: Column
    action: str = "drop"


def default_checks() -> list[Check]:
    """PF5-PF8 in fixed order; the later corrupt stage finds nothing, as missing audio drops decode errors first (T11)."""
    d = F.col("duration_sec")
    return [
        Check("missing_audio", "no path, or it can't be decoded", blank(F.col("audio_path")) | F.col("audio_decode_error").isNotNull()),
        Check("missing_transcript", "no text", blank(F.col("transcript"))),
        Check("zero_or_negative_duration", "no duration above zero", d.isNull() | F.isnan(d) | (d <= 0)),
        Check("corrupt_audio", "decode error", F.col("audio_decode_error").isNotNull()),
    ]


@dataclass
class Cleaned:
    clean: DataFrame
    dropped: DataFrame
    log: DataFrame


def clean(df: DataFrame, order: list[str], audio: str = "audio_checksum", norm: str = "transcript_normalized", checks: list[Check] | None = None) -> Cleaned:
    """All checks in one pass: the first failing stage of each row, then duplicates among the survivors only (T30), then repeated texts among those left.

    Of rows with the same audio and text the first by `order` stays; nulls equal nulls there (T5). Repeated texts are flagged, not dropped.
    The windows are partitioned by text, so that one shuffle serves duplicates and repeats. log has a row for each stage, in order.
    """
    checks = default_checks() if checks is None else checks
    stage = F.lit(None).cast("string")
    for c in reversed([c for c in checks if c.action == "drop"]):
        stage = F.when(c.bad, c.name).otherwise(stage)
    rows = df.withColumn("_stage", stage)
    for c in checks:
        rows = rows.withColumn(f"_flag_{c.name}", F.coalesce(c.bad, F.lit(False)))
    ok = F.col("_stage").isNull()
    rows = rows.withColumn("_live", ok)
    same = Window.partitionBy("_live", norm, audio).orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(same)).withColumn("_stage", F.when(ok & (F.col("_n") > 1), "duplicate_row").otherwise(F.col("_stage")))
    # what is left holds one row for each audio and text, so a text is repeated where it has more than one row left
    left = Window.partitionBy("_live", norm)
    rows = rows.withColumn("repeated_transcript_count", F.count_if(F.col("_stage").isNull()).over(left)).withColumn("is_repeated_transcript", F.col("repeated_transcript_count") > 1)
    kept = rows.where("_stage is null").drop("_stage", "_live", "_n", *(f"_flag_{c.name}" for c in checks))
    gone = rows.where("_stage is not null").withColumn("drop_reason", F.col("_stage")).drop("_live", "_n", "is_repeated_transcript", "repeated_transcript_count", *(f"_flag_{c.name}" for c in checks)).withColumnRenamed("_stage", "dropped_by")
    names = [*(c.name for c in checks), "duplicate_row", "repeated_transcript"]
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("_stage")), F.lit(0)).cast("int")
    repeated = F.col("is_repeated_transcript") & F.col("_stage").isNull()
    aggs = [F.count("*").alias("n"), F.count_if(repeated).alias("rep")]
    for i, n in enumerate(names[:-1]):
        alive = (rank == 0) | (rank > i)
        aggs += [F.count_if(rank == i + 1).alias(f"r{i}"), F.count_if(alive & (F.col(f"_flag_{n}") if i < len(checks) else rank == i + 1)).alias(f"f{i}")]
    one = rows.agg(*aggs)
    info = {c.name: (c.description, c.action) for c in checks} | {"duplicate_row": ("same audio and text as an earlier row", "drop"), "repeated_transcript": ("same text with other audio", "flag_only")}
    lines, before = [], F.col("n")
    for i, n in enumerate(names):
        removed = F.col(f"r{i}") if n != "repeated_transcript" else F.lit(0).cast("bigint")
        flagged = F.col(f"f{i}") if n != "repeated_transcript" else F.col("rep")
        lines.append(F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("stage"), F.lit(info[n][0]).alias("check_description"), before.alias("rows_in"), flagged.alias("rows_flagged"), removed.alias("rows_removed"), (before - removed).alias("rows_out"), F.lit(info[n][1]).alias("action")))
        before = before - removed
    return Cleaned(kept, gone, one.select(F.explode(F.array(*lines)).alias("x")).select("x.*"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AG7, WN1: one row for each key, the first by order; nulls are a key of their own."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def gate(df: DataFrame, bad: Column, most: float = 0.05) -> float:
    """PF23: the share of bad rows; raises above `most`. An empty table has none."""
    share = df.agg(F.avg(F.coalesce(bad, F.lit(False)).cast("double"))).first()[0] or 0.0
    if share > most:
        raise ValueError(f"{share:.1%} of the rows are bad, more than {most:.0%}")
    return share


def integrity(parts: list[DataFrame], union: DataFrame, key: str) -> None:
    """PF24: the union has as many rows as its parts, and unique keys."""
    n = sum(p.count() for p in parts)
    got = union.agg(F.count("*").alias("n"), F.count_distinct(key).alias("k")).first()
    if (got["n"], got["k"]) != (n, n):
        raise ValueError(f"{n} rows in the parts, {got['n']} in the union, {got['k']} keys")
