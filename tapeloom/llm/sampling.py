"""Problem 1: a sample that matches target proportions of categories."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.names import name_key
from tapeloom.plans.tables import read, written

NAMES = ["dataset_split", "dataset_source", "selection_reason"]
#: Target tables are specifications. One with more rows than this is refused, as the category table is worked out on the driver.
MAX_TARGETS = 100_000


def _quotas(cats: list[dict]) -> None:
    """Adds e (expected size) to each category: proportional to the target share, capped by what is there, summing to sample_size if the rows suffice.

    The factor on the shares is found by filling up: categories whose share exceeds what is there are capped, the rest scaled again.
    """
    size = max((c["sample_size"] for c in cats), default=0)
    free, left = [c for c in cats if c["available"] and c["target_share"] > 0], float(size)
    for c in cats:
        c["e"] = 0.0
    while free:
        scale = left / sum(c["target_share"] for c in free)
        full = [c for c in free if c["target_share"] * scale >= c["available"]]
        for c in full or free:
            c["e"] = float(c["available"]) if full else c["target_share"] * scale
        if not full:
            break
        left -= sum(c["available"] for c in full)
        free = [c for c in free if not any(c is f for f in full)]


def _repair(cats: list[dict], start: float) -> None:
    """Adds base (prefix sum of expected sizes in sorted order), drawn (integer crossings) and final (after the repair of floors)."""
    base = 0.0
    for c in cats:
        c["base"] = base
        base += c["e"]
        # rounded, so that a prefix sum that should be whole is whole
        c["drawn"] = math.floor(round(base - start, 9)) - math.floor(round(c["base"] - start, 9))
        c["final"] = c["drawn"]
    for c in cats:
        c["final"] = max(c["final"], min(c["min_rows"], c["available"]))
    excess = sum(c["final"] for c in cats) - sum(c["drawn"] for c in cats)
    # taken back one by one from the category furthest above its expected size, never below a floor; where none can give, the floors alone exceed the size, and the sample is larger
    place = lambda i: (cats[i]["e"] - cats[i]["final"], -cats[i]["final"], cats[i]["target_id"], i)
    rich = [place(i) for i, c in enumerate(cats) if c["final"] > max(c["min_rows"], 0)]
    heapq.heapify(rich)
    while excess > 0 and rich:
        i = heapq.heappop(rich)[-1]
        cats[i]["final"] -= 1
        excess -= 1
        if cats[i]["final"] > max(cats[i]["min_rows"], 0):
            heapq.heappush(rich, place(i))


def proportional_sample(rows: DataFrame, targets: DataFrame, key: str = "utterance_id", seed: int = 11, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Systematic unequal-probability sample of the distinct `key`s of rows, by the categories NAMES of targets.

    The keys are put in random (hash) order within the sorted categories; each has the inclusion probability expected size / available of
    its category; one random start u selects the keys whose prefix sum of probabilities passes a whole number plus u. The prefix sums are made
    across partitions: each category is cut into hash buckets, a bucket's rows are numbered on their own, and the buckets' counts give the offsets.
    Then floors are repaired: a category below min_rows gets the next keys in its order, and the categories furthest above their expected size give them back.

    Returns (sample: target_id, NAMES as in targets, key; report: one row per target with available, needed, drawn, actual_share, short).
    A row with a null or a letterless name, or a null key, is in no category; a key in several categories counts in each; repeated rows count once.
    An empty table gives an empty sample and every target that needs a row as short. Other columns are ignored.
    """
    spark = rows.sparkSession
    t = targets.select("target_id", *NAMES, "target_share", "min_rows", "sample_size").limit(MAX_TARGETS + 1).collect()
    if len(t) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    schema = T.StructType([f for f in targets.schema if f.name in ("target_id", *NAMES)])
    small = spark.createDataFrame([(r["target_id"], *(r[n] for n in NAMES)) for r in t], T.StructType([targets.schema["target_id"], *(schema[n] for n in NAMES)]))
    small = small.select("target_id", *(name_key(F.col(n)).alias(f"_{n}") for n in NAMES)).where(" and ".join(f"_{n} <> ''" for n in NAMES))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.col(key).alias("_key"), *(name_key(F.col(c)).alias(f"_{c}") for c in NAMES)).where(F.col("_key").isNotNull())
    order = F.xxhash64(F.lit(seed), "_key")
    placed = keyed.join(F.broadcast(small), [f"_{c}" for c in NAMES]).select("target_id", F.pmod(F.shiftrightunsigned(order, 20), F.lit(n)).cast("int").alias("bucket"), order.alias("r"), "_key")
    # one shuffle serves both the removal of repeated keys and the numbering
    w = "(PARTITION BY target_id, bucket ORDER BY r, _key)"
    one = placed.repartition("target_id", "bucket").groupBy("target_id", "bucket", "r", "_key").agg(F.lit(1).alias("one"))
    ranked = written(one.selectExpr("target_id", "bucket", "_key", f"row_number() OVER {w} AS k"), "sample-order")
    counts = ranked.groupBy("target_id", "bucket").agg(F.max("k").alias("n"))
    cum = "OVER (PARTITION BY target_id ORDER BY bucket ROWS UNBOUNDED PRECEDING)"
    offsets = counts.selectExpr("target_id", "bucket", "n", f"sum(n) {cum} - n AS before")  # targets x buckets rows at most
    avail = {r["target_id"]: r["n"] for r in counts.groupBy("target_id").agg(F.sum("n").alias("n")).collect()}  # at most one row per target
    cats = [r.asDict() | {"available": avail.get(r["target_id"], 0)} for r in t]
    for c in cats:
        c["min_rows"], c["target_share"], c["sample_size"] = c["min_rows"] or 0, c["target_share"] or 0.0, c["sample_size"] or 0
        c["needed"] = max(c["min_rows"], math.floor(c["target_share"] * c["sample_size"] + 0.5))
    cats.sort(key=lambda c: tuple(c[x] or "" for x in NAMES) + (c["target_id"],))
    _quotas(cats)
    start = spark.range(1).select((F.pmod(F.xxhash64(F.lit(seed), F.lit("start")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")).first()["u"]
    _repair(cats, start)
    plan = spark.createDataFrame(
        [(c["target_id"], *(c[x] for x in NAMES), c["available"], c["needed"], float(c["e"]), float(c["base"]), c["drawn"], c["final"]) for c in cats],
        T.StructType([targets.schema["target_id"], *(schema[x] for x in NAMES), *(T.StructField(x, kind()) for x, kind in (("available", T.LongType), ("needed", T.LongType), ("e", T.DoubleType), ("base", T.DoubleType), ("drawn", T.LongType), ("final", T.LongType)))]),
    )
    at = ranked.join(offsets.select("target_id", "bucket", "before"), ["target_id", "bucket"]).join(F.broadcast(plan), "target_id").withColumn("rank", F.col("before") + F.col("k"))
    crossed = lambda rank: F.floor(F.round(F.col("base") + rank * F.col("e") / F.col("available") - F.lit(start), 9)) - F.floor(F.round(F.col("base") - F.lit(start), 9))
    at = at.withColumn("nth", crossed(F.col("rank"))).withColumn("hit", F.col("nth") > crossed(F.col("rank") - 1))
    # the nth selected key stays while n <= final; the mth unselected one is added while m <= final - drawn
    keep = F.when(F.col("hit"), F.col("nth") <= F.col("final")).otherwise(F.col("rank") - F.col("nth") <= F.col("final") - F.col("drawn"))
    sample = at.where(keep).select("target_id", *NAMES, F.col("_key").alias(key))
    taken = sample.groupBy("target_id").agg(F.count("*").alias("drawn"))
    total = sample.agg(F.count("*").alias("total"))
    report = (
        plan.drop("drawn", "e", "base", "final").join(taken, "target_id", "left").join(F.broadcast(total))  # a single row
        .select("target_id", *NAMES, "available", "needed", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce(F.round(F.col("drawn") / F.col("total"), 9), F.lit(0.0)).alias("actual_share"), (F.col("available") < F.col("needed")).alias("short"))
    )
    return sample, report


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return proportional_sample(read(spark, d, "heldout"), read(spark, d, "sample_targets"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample itself."""
    return _run(spark, d)[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Available, needed and drawn rows and the actual share of each category."""
    return _run(spark, d)[1]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories that have fewer distinct utterances than they need: the shortages that the sample reports."""
    return _run(spark, d)[1].where("short").select(*NAMES)


_KEY = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
SQL = {
    "p1_found": f"""
        WITH h AS (SELECT DISTINCT utterance_id u, {_KEY.format('dataset_split')} a, {_KEY.format('dataset_source')} b, {_KEY.format('selection_reason')} c FROM heldout WHERE utterance_id IS NOT NULL)
        SELECT t.dataset_split, t.dataset_source, t.selection_reason FROM sample_targets t
        LEFT JOIN h ON {_KEY.format('t.dataset_split')} = a AND {_KEY.format('t.dataset_source')} = b AND {_KEY.format('t.selection_reason')} = c
        GROUP BY t.target_id, t.dataset_split, t.dataset_source, t.selection_reason, t.min_rows, t.target_share, t.sample_size
        HAVING count(u) < greatest(t.min_rows, floor(t.target_share * t.sample_size + 0.5))
    """,
}
QUERIES = {"p1_found": p1_found, "p1_sample": p1_sample, "p1_report": p1_report}
