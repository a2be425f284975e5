"""Problem 7: filling containers of fixed capacity with items of varying size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.tokens import RANKS, token_counts
from tapeloom.plans.tables import read, written

#: Open bins of a stream, and about how many items a stream has.
OPEN, STREAM = 64, 20_000
MAX_SPECS = 1000


def best_fit(sizes: list[int], capacity: int, opened: int = OPEN) -> tuple[list[int], list[int], set[int]]:
    """(bin of each item, used room of each bin, bins still open at the end); online best fit with a fixed number of open bins.

    The free spaces of open bins are bits of one integer: the least set bit at or above an item's size is the best fit,
    the least set bit of all is the fullest bin, which closes first when a bin is needed and all are open.
    """
    bits, by_free, where, used = 0, {}, [], []
    count = 0
    for s in sizes:
        fit = bits >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            bin_ = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                bits ^= 1 << free
        else:
            if count == opened:
                full = (bits & -bits).bit_length() - 1
                by_free[full].pop()
                if not by_free[full]:
                    del by_free[full]
                    bits ^= 1 << full
                count -= 1
            bin_, free = len(used), capacity
            used.append(0)
            count += 1
        where.append(bin_)
        used[bin_] += s
        free -= s
        if free:
            if free not in by_free:
                by_free[free] = []
                bits |= 1 << free
            by_free[free].append(bin_)
        else:
            count -= 1
    return where, used, {b for v in by_free.values() for b in v}


def _pack(items: DataFrame, streams: int, level: int) -> DataFrame:
    """items: spec_name, capacity_tokens, item (string), size. Adds container and whether it is still open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "item"])
        where, _, still = best_fit(pdf["size"].tolist(), int(pdf["capacity_tokens"].iloc[0]))
        n = int(pdf["stream"].iloc[0])
        return pd.DataFrame({"spec_name": pdf["spec_name"], "capacity_tokens": pdf["capacity_tokens"], "item": pdf["item"], "size": pdf["size"], "container": [f"{level}-{n}-{w}" for w in where], "open": [w in still for w in where]})

    order = F.xxhash64(F.lit(level), "item")
    put = items.withColumn("order", order).withColumn("stream", F.pmod(F.shiftrightunsigned("order", 16), F.lit(streams)))
    return put.groupBy("spec_name", "stream").applyInPandas(run, "spec_name string, capacity_tokens bigint, item string, size bigint, container string, open boolean")


def packed(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = RANKS) -> DataFrame:
    """(spec_name, container, key, piece, pieces, tokens, capacity_tokens): where each document goes, for each capacity.

    Only a document with more tokens than the capacity is split: into full pieces, each a container of its own, and a rest that is packed like any item.
    Items go in hash order to streams of about STREAM items; each is packed online by best fit. Bins left open at a stream's end are packed again as items, until one stream is left,
    so that at most OPEN bins of a spec stay partly filled for want of items. Documents without tokens and null keys are left out; repeated rows are packed each. Other columns are ignored.
    """
    plan = specs.where("capacity_tokens > 0").select("spec_name", "capacity_tokens").limit(MAX_SPECS + 1).collect()
    if len(plan) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    # repeated rows differ in their row number, which is fixed by being written
    sized = written(token_counts(docs.where(F.col(key).isNotNull()), [key], text, tokenizer).where("tokens > 0").withColumn("row", F.monotonically_increasing_id()), "tokens")
    n = sized.count()
    each = F.explode(F.array(*(F.struct(F.lit(r["spec_name"]).alias("spec_name"), F.lit(r["capacity_tokens"]).cast("bigint").alias("capacity_tokens")) for r in plan)) if plan else F.expr("cast(array() as array<struct<spec_name:string,capacity_tokens:bigint>>)"))
    pieces = sized.select(key, "row", "tokens", each.alias("s")).select(key, "row", "tokens", "s.*").withColumn("pieces", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    piece = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    size = F.least(F.col("capacity_tokens"), F.col("tokens") - F.col("piece") * F.col("capacity_tokens"))
    piece = piece.withColumn("size", size).withColumn("item", F.format_string("%d.%d", "row", "piece"))
    full = piece.where("size = capacity_tokens").withColumn("container", F.concat(F.lit("f-"), "item"))
    level, streams = 0, max(1, -(-n // STREAM))
    now = written(_pack(piece.where("size < capacity_tokens").select("spec_name", "capacity_tokens", "item", "size"), streams, level), "packed")
    while streams > 1:
        streams, level = min(streams - 1, max(1, -(-streams * OPEN // STREAM))), level + 1
        left = now.where("open").groupBy("spec_name", "capacity_tokens", F.col("container").alias("item")).agg(F.sum("size").alias("size"))
        merged = _pack(left, streams, level).select("spec_name", F.col("item").alias("container"), F.col("container").alias("into"), F.col("open").alias("still"))
        now = written(now.join(merged, ["spec_name", "container"], "left").select("spec_name", "capacity_tokens", "item", "size", F.coalesce("into", "container").alias("container"), F.coalesce("still", F.lit(False)).alias("open")), "packed")
    rest = piece.where("size < capacity_tokens").join(now.select("spec_name", "item", "container"), ["spec_name", "item"])
    return full.unionByName(rest).select("spec_name", "container", key, "piece", "pieces", F.col("size").alias("tokens"), "capacity_tokens")


def _run(spark: SparkSession, d: str) -> DataFrame:
    return packed(read(spark, d, "documents"), read(spark, d, "pack_specs"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every piece of every document."""
    return _run(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room used, for each capacity."""
    return _run(spark, d).groupBy("spec_name", "capacity_tokens").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that exceed the capacity alone: those the packing had to split."""
    return _run(spark, d).where("pieces > 1 and piece = 0").select("spec_name", "doc_id")


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_packed": p7_packed, "p7_report": p7_report}
