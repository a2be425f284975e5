"""Profiles and statistics of tables. SURVEY AG8-AG25, AG37, AG38, AG48-AG50, WN5, WN6, SL1-SL4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.tables import written


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG8: count, mean, sample deviation, least, quartiles, largest."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), *(F.round(q[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))), F.max(value).alias("max"))


def shares(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """AG1, AG2, WN4: rows for each key and their percentage of the rows of `within`, half to even."""
    total = F.sum("row_count").over(Window.partitionBy(*within))
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).withColumn("pct", F.bround(100 * F.col("row_count") / total, 1))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """AG10: with ranks by count, ties by value."""
    n = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return n


def crosstab(df: DataFrame, sources: DataFrame, labels: list[str], label: str, source: str) -> DataFrame:
    """AG20: (label, source, n) for each of the fixed labels and each of the sources, 0 where they never meet; a null source is one of its own."""
    n = df.groupBy(label, source).agg(F.count("*").alias("n")).withColumnsRenamed({label: "_l", source: "_s"})
    grid = sources.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")))
    return grid.join(n, (F.col(label) == F.col("_l")) & F.col(source).eqNullSafe(F.col("_s")), "left").select(label, source, F.coalesce("n", F.lit(0)).alias("n"))


def null_rates(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """AG14, AG15: share and number of nulls of each column, one row for each group and column."""
    one = df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return one.select(*by, "rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols))).alias("x")).select(*by, "rows", "x.column", "x.nulls", F.round(F.col("x.nulls") / F.col("rows"), 9).alias("null_rate"))


def vocabulary(df: DataFrame, by: list[str], toks: Column) -> DataFrame:
    """AG12: tokens, types and their ratio; types are counted in two steps, so a frequent token is one row for each task."""
    t = df.select(*by, F.explode(toks).alias("_t")).groupBy(*by, "_t").agg(F.count("*").alias("_n"))
    return t.groupBy(*by).agg(F.sum("_n").alias("tokens"), F.count("*").alias("types")).withColumn("ttr", F.round(F.col("types") / F.col("tokens"), 9))


def top_words(df: DataFrame, by: list[str], toks: Column, stop: list[str], n: int) -> DataFrame:
    """AG13: the n most frequent tokens but stop words, ties by token."""
    t = df.select(*by, F.explode(F.filter(toks, lambda x: ~x.isin(stop))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "token"))).where(F.col("rank") <= n)


def average_rank(c: str, by: list[str]) -> Column:
    """WN6: the mean place of ties."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2


def corr(a: str, b: str) -> Column:
    """Correlation over rows that have both; null where one of them doesn't vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """AG24: rank correlation with ties, by the columns `by` (a null group is one of its own). No p-value is computed.

    Ranks come from counts of values in range slices and the counts of the slices before, so no task orders all values of a group.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.struct(*by).alias("_g"), a, b)
    n = rows
    for c in (a, b):
        v = written(rows.groupBy("_g", c).agg(F.count("*").alias("_c")).repartitionByRange("_g", c).withColumn("_slice", F.spark_partition_id()), "ranks")
        size = v.groupBy("_g", "_slice").agg(F.sum("_c").alias("_m"))
        before = size.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
        v = v.join(before, ["_g", "_slice"])
        n = n.join(v.select("_g", c, (F.col("_before") + F.sum("_c").over(Window.partitionBy("_g", "_slice").orderBy(c)) - (F.col("_c") - 1) / 2).alias(f"_r{c}")), ["_g", c])
    r = n.groupBy("_g").agg(F.count("*").alias("n"), corr(f"_r{a}", f"_r{b}").alias("rho"))
    return r.select("_g.*", "n", F.round("rho", 6).alias("rho"))


def correlations(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """AG23: correlation of each pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.groupBy(*by).agg(*(F.round(corr(a, b), 6).alias(f"{a}~{b}") for a, b in pairs))
    return one.select(*by, F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs))).alias("x")).select(*by, "x.*")


def bins(value: Column, edges: list[float]) -> Column:
    """AG25, T8: index of the right-closed bin (a, b]; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((value > edges[i]) & (value <= edges[i + 1]), i).otherwise(out)
    return out


def tails(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG50, NU20: mean, deviation, and values beyond two and three deviations; two passes of partial sums."""
    s = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = df.join(s, by).withColumn("_z", F.abs((F.col(value) - F.col("_m")) / F.col("_s"))) if by else df.join(F.broadcast(s)).withColumn("_z", F.abs((F.col(value) - F.col("_m")) / F.col("_s")))
    return z.groupBy(*by).agg(F.round(F.first("_m"), 6).alias("mean"), F.round(F.first("_s"), 6).alias("std"), F.round(F.median(value), 6).alias("median"), F.count_if(F.col("_z") > 2).alias("beyond_2"), F.count_if(F.col("_z") > 3).alias("beyond_3"))


def dictionary(df: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """AG48, SK16: name, type, definition, a non-null value (the least), known values, missing ones in percent and distinct ones of each column. A table without rows has no percentage."""
    kinds = dict(df.dtypes)
    plain = df.agg(F.count("*").alias("_n"), *(F.struct(F.min(F.col(c)).alias(c), F.count(c).alias("n")).alias(c) for c in df.columns))
    # distinct values are counted by groups, each column for itself, so that no task holds them all
    one = None
    for c in df.columns:
        n = df.where(F.col(c).isNotNull()).select(F.xxhash64(c).alias("_h"), F.col(c).alias("_v")).distinct().agg(F.count("*").alias("distinct")).select(F.lit(c).alias("column"), "distinct")
        one = n if one is None else one.unionByName(n)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.lit(definitions.get(c, "")).alias("definition"), F.expr(f"`{c}`.`{c}`").cast("string").alias("example") if not kinds[c].startswith("timestamp") else F.date_format(F.expr(f"`{c}`.`{c}`"), "yyyy-MM-dd HH:mm:ss").alias("example"), F.expr(f"`{c}`.n").alias("non_null"), F.round(100 * (1 - F.try_divide(F.expr(f"`{c}`.n"), F.col("_n"))), 6).alias("missing_pct")) for c in df.columns))
    return plain.select(F.explode(rows).alias("x")).select("x.*").join(one, "column")


def duplicates(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """AG49: for each named key, the rows that share it with another."""
    out = None
    for name, cols in keys.items():
        n = df.groupBy(*cols).agg(F.count("*").alias("_c")).agg(F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias("rows")).select(F.lit(name).alias("key"), "rows")
        out = n if out is None else out.unionByName(n)
    return out
