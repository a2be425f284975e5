"""Splits and samples that any engine repeats: order comes from md5 of seed and id (T6). SURVEY WN7, SL1-SL14, SO10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.spans import rule_entities
from tapeloom.operators.skew import lookup_join
from tapeloom.sources.readers import numbered


def hash_order(key: Column, seed: int | str) -> Column:
    """SL6: a fixed random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def group_split(df: DataFrame, group: str, seed: int, test: float, validation: float) -> DataFrame:
    """WN7: adds dataset_split so that no group is cut: groups in hash order fill test, then validation, each until its share is reached.

    Sums run over the table of groups in hash order. They are made in two steps, sums of 4096 slices of the order and running sums within a slice, so that no task holds all groups.
    A null group is a group. The sizes overshoot by less than a group (T14).
    """
    g = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", hash_order(F.coalesce(F.col(group).cast("string"), F.lit("\x00")), seed)).withColumn("_s", F.substring("_h", 1, 3))
    slices = g.groupBy("_s").agg(F.sum("_n").alias("_m")).withColumn("_before", F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))  # at most 4096 rows
    total = df.agg(F.count("*").alias("_total"))
    run = Window.partitionBy("_s").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    g = g.join(F.broadcast(slices.select("_s", F.coalesce("_before", zero).alias("_before"))), "_s").join(F.broadcast(total)).withColumn("_ex", F.col("_before") + F.coalesce(F.sum("_n").over(run), zero))
    is_test = F.col("_ex") < F.bround(F.col("_total") * test)
    # test takes a prefix of the order, so validation starts where the first group isn't test
    in_test = g.where(is_test).agg(F.coalesce(F.sum("_n"), zero).alias("_in_test"))
    g = g.join(F.broadcast(in_test)).withColumn("dataset_split", F.when(is_test, "test").when(F.col("_ex") - F.col("_in_test") < F.bround(F.col("_total") * validation), "validation").otherwise("train"))
    key = F.coalesce(F.col(group).cast("string"), F.lit("\x00"))
    # a recording with a tenth of the rows is not shuffled
    return lookup_join(df.drop("dataset_split").withColumn("_k", key), g.select(key.alias("_k"), "dataset_split", "_n"), ["_k"], "_n").drop("_k")


def _ranked(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """df with _r, a row's place in the hash order of its stratum (a null one counts), from 1: its place in one of 4096 slices of the order after the rows of the slices before, so a stratum of a third of all rows is spread over tasks."""
    h = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_s", F.substring("_h", 1, 3)).withColumn("_g", F.struct(*strata))
    n = h.groupBy("_g", "_s").agg(F.count("*").alias("_m"))
    before = n.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")  # at most 4096 rows for each stratum
    place = h.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_s").orderBy("_h", key)))
    return place.join(before, ["_g", "_s"]).withColumn("_r", F.col("_r") + F.col("_before")).drop("_h", "_s", "_g", "_before")


def equal_sample(df: DataFrame, stratum: str, key: str, limit: int, seed: int) -> DataFrame:
    """SL7: the same quota for each stratum, one more for the first by name if it doesn't divide; a shortfall isn't made up. All rows if there are no more than limit."""
    n = df.groupBy(stratum).agg(F.count("*").alias("_c"))
    named = n.withColumn("_i", F.row_number().over(Window.orderBy(stratum)) - 1)  # one row for each stratum
    quotas = named.join(F.broadcast(n.agg(F.count("*").alias("_k"), F.sum("_c").alias("_all")))).select(F.col(stratum).alias("_st"), F.when(F.col("_all") <= limit, F.col("_c")).otherwise(F.floor(F.lit(limit) / F.col("_k")) + (F.col("_i") < F.lit(limit) % F.col("_k")).cast("int")).alias("_q"))
    return _ranked(df, [stratum], key, seed).join(quotas, F.col(stratum).eqNullSafe(F.col("_st"))).where("_r <= _q").drop("_r", "_q", "_st")


def proportional_sample(df: DataFrame, stratum: str, key: str, share: float, seed: int) -> DataFrame:
    """SL8: the same share of each stratum, half to even, at least one row."""
    n = df.groupBy(F.col(stratum).alias("_st")).agg(F.count("*").alias("_n"))
    return _ranked(df, [stratum], key, seed).join(n, F.col(stratum).eqNullSafe(F.col("_st"))).where(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))).drop("_r", "_n", "_st")


def targeted_sample(df: DataFrame, key: str, taken: DataFrame, cues: dict[str, Column], per_cue: int, stratum: str, n_random: int, seed: int, blind: float = 0.25) -> DataFrame:
    """SL9, SL10: rows for each cue, drawn on their own, and random rows for each stratum, none of them taken before; a row drawn twice keeps the first reason (T33).

    Adds selection_reason and, for a share of the rows by hash, blind.
    """
    pool = df.join(taken.select(key).distinct(), key, "left_anti")
    parts = []
    for i, (name, cond) in enumerate(cues.items()):
        drawn = pool.where(cond).orderBy(hash_order(F.col(key), f"{seed}-{name}"), key).limit(per_cue)
        parts.append(drawn.withColumn("selection_reason", F.lit(f"targeted:{name}")).withColumn("_p", F.lit(i)))
    rest = _ranked(pool, [stratum], key, seed).where(F.col("_r") <= n_random // 2).drop("_r").withColumn("selection_reason", F.lit("random")).withColumn("_p", F.lit(len(cues)))
    parts.append(rest)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).where("_n = 1").drop("_n", "_p")
    return one.withColumn("blind", F.conv(F.substring(hash_order(F.col(key), f"{seed}-blind"), 1, 4), 16, 10).cast("int") < int(blind * 65536))


def quota_select(estimates: DataFrame, labels: list[tuple[str, int]], quota: int, key: str, seed: int, most: int = 1_000_000):
    """SL11: greedy: labels from the rarest count up; for each the rows with the highest estimate of it until its quota; a row counts for all labels it is estimated to have.

    estimates has key and one int column per label. The choice is sequential by nature, so it runs over the rows that can be chosen at all:
    for a label the best labels * quota rows by (estimate, hash order) suffice, as each pick uses up one row. Those are bounded; more than `most` are refused.
    """
    names = [n for n, _ in sorted(labels, key=lambda x: x[1])]
    per = quota * len(names)
    if per * len(names) > most:
        raise ValueError("quotas too large for a sequential choice")
    e = estimates.withColumn("_h", hash_order(F.col(key), seed))
    parts = [e.where(F.col(n) > 0).orderBy(F.col(n).desc(), "_h", key).limit(per) for n in names]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    rows = {r[key]: r for r in pool.dropDuplicates([key]).collect()}
    got, picked, used = dict.fromkeys(names, 0), [], set()
    for n in names:
        for r in sorted((r for r in rows.values() if r[n] > 0), key=lambda r: (-r[n], r["_h"], r[key])):
            if got[n] >= quota:
                break
            if r[key] in used:
                continue
            used.add(r[key])
            picked.append((r[key], n, len(picked) + 1))
            for m in names:
                got[m] += r[m]
    spark = estimates.sparkSession
    kind = dict(estimates.dtypes)[key]
    return spark.createDataFrame(picked, f"{key} {kind}, for_label string, pick int")


def quantile_picks(df: DataFrame, stratum: str, value: str, key: str, qs: list[float]) -> DataFrame:
    """SL13: for each stratum the rows at place floor(q * (n - 1)) by value."""
    some = df.where(F.col(value).isNotNull())
    n = some.groupBy(F.col(stratum).alias("_st")).agg(F.count("*").alias("_n"))
    r = numbered(some, stratum, [value, key]).join(n, F.col(stratum).eqNullSafe(F.col("_st")))
    return r.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).where(F.col("_number") == F.floor(F.col("q") * (F.col("_n") - 1))).drop("_number", "_n", "_st")


def oversample(df: DataFrame, labels: Column, counts: DataFrame, target: int, cap: int) -> DataFrame:
    """SO10, NU18, T32: each row as often as the largest boost among its labels, min(cap, ceil(target / n)) under the target; once without labels. Adds copy (from 1).

    counts has label and n; the labels form a small closed set.
    """
    boost = counts.where("n < " + str(target)).select("label", F.least(F.lit(cap), F.ceil(F.lit(target) / F.col("n"))).cast("int").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("label", "b"))).alias("_m"))
    times = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(labels, lambda x: F.coalesce(F.element_at("_m", x), F.lit(1)))), F.lit(1)))
    return df.join(F.broadcast(boost)).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_m")


#: Fixed value: what leads to a waypoint.
WAYPOINT_CUE = r"\b(?:direct(?: to)?|proceed|set course|via)\b"


def label_estimates(text: Column, labels: list[str]) -> list[Column]:
    """XO6: for each label how many entities a text may have by the rules; waypoints, which no rule finds, by their cues."""
    rules = rule_entities(text)
    count = lambda k: F.size(F.filter(rules, lambda e: e["label"] == k)) + (F.regexp_count(text, F.lit(WAYPOINT_CUE)) if k == "WAYPOINT" else F.lit(0))
    return [count(k).alias(k) for k in labels]
