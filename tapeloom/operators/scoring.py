"""Scores of spans, entities and transcripts. SURVEY AG21-AG34, AG42-AG46, JN8, JN9, XO9-XO12, XO14."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import text as tx


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """NU19: precision, recall and F1, 0 where undefined."""
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    f = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)
    return [F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1"), (tp + fn).alias("support")]


def span_counts(gold: DataFrame, pred: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """AG26: tp, fp, fn by label, and by the columns `by`; the label ALL sums up.

    Both have key and entities (array of struct with start, end, label; a pred without the key counts as empty, ids not in gold are left out, repeated spans count once: T29).
    Spans meet inside the row, so nothing is exploded but the labels of each row.
    """
    by = by or []
    spans = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<text:string,label:string,start:int,end:int>>")), lambda e: F.struct(e["start"].alias("s"), e["end"].alias("e"), e["label"].alias("l"))))
    both = gold.select(key, *by, spans("entities").alias("g")).join(pred.select(key, spans("entities").alias("p")), key, "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<s:int,e:int,l:string>>")))
    mark = lambda arr, k: F.transform(arr, lambda x: F.struct(x["l"].alias("label"), F.lit(k).alias("k")))
    each = both.select(*by, F.explode(F.concat(mark(F.array_intersect("g", "p"), "tp"), mark(F.array_except("p", "g"), "fp"), mark(F.array_except("g", "p"), "fn"))).alias("x")).select(*by, "x.*")
    cnt = lambda k: F.count_if(F.col("k") == k).alias(k)
    one = each.groupBy(*by, "label").agg(cnt("tp"), cnt("fp"), cnt("fn"))
    total = one.groupBy(*by).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn"))).withColumn("label", F.lit("ALL"))
    return one.unionByName(total)


def span_scores(gold: DataFrame, pred: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    c = span_counts(gold, pred, key, by)
    return c.select(*(by or []), "label", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def averages(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG27, T31: micro, macro and weighted averages over labels with support."""
    by = by or []
    some = scores.where("label <> 'ALL' and support > 0").groupBy(*by)
    cols = ("precision", "recall", "f1")
    macro = some.agg(*(F.round(F.avg(c), 9).alias(c) for c in cols), F.sum("support").alias("support")).withColumn("average", F.lit("macro"))
    weighted = some.agg(*(F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 9).alias(c) for c in cols), F.sum("support").alias("support")).withColumn("average", F.lit("weighted"))
    micro = scores.where("label = 'ALL'").select(*by, *cols, "support").withColumn("average", F.lit("micro"))
    return micro.unionByName(macro).unionByName(weighted)


def exact_rows(gold: DataFrame, pred: DataFrame, key: str, by: list[str]) -> DataFrame:
    """AG28, AG43: rows whose span sets are the same, by the columns `by`."""
    spans = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda e: F.struct(e["start"].alias("s"), e["end"].alias("e"), e["label"].alias("l")))))
    both = gold.select(key, *by, spans("entities").alias("g")).join(pred.select(key, spans("entities").alias("p")), key, "left")
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("g") == F.coalesce("p", F.array().cast("array<struct<s:int,e:int,l:string>>"))).alias("exact"))


def multiset_counts(gold: Column, pred: Column, norm=None) -> list[Column]:
    """AG45, SO6: (matched, in gold, in pred) as multisets of label and normalised text."""
    norm = norm or (lambda t: F.lower(tx.squeeze(t)))
    keys = lambda a: F.transform(F.coalesce(a, F.array().cast("array<struct<text:string,label:string,start:int,end:int>>")), lambda e: F.concat(e["label"], F.lit("\x00"), norm(e["text"])))
    g, p = keys(gold), keys(pred)
    # a matched item is the nth of its kind on both sides
    nth = lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.concat(F.get(a, i - 1), F.lit("\x00"), F.size(F.filter(F.slice(a, F.lit(1), i), lambda x: x == F.get(a, i - 1))).cast("string")))
    many = lambda c: tx.let(c, lambda a: F.when(F.size(a) > 0, nth(a)).otherwise(F.array().cast("array<string>")))
    return [F.size(F.array_intersect(many(g), many(p))), F.size(g), F.size(p)]


def transcript_errors(df: DataFrame, ref: str, hyp: str, by: list[str]) -> DataFrame:
    """AG21, AG30, T7, T23: word error rate as a ratio of sums, by the columns `by` and for ALL together."""
    e = df.select(*by, tx.word_errors(F.col(ref), F.col(hyp)).alias("e"), tx.word_count(F.col(ref)).alias("w"))
    return e.rollup(*by).agg(F.count("*").alias("n"), F.sum("e").alias("errors"), F.sum("w").alias("words"), F.round(F.sum("e") / F.greatest(F.sum("w"), F.lit(1)), 9).alias("wer"))


def _poisson(df: DataFrame, key: str, sums: list[str], by: list[str], b: int, seed: int) -> DataFrame:
    """Sums of each of b Poisson resamples: every row has a Poisson(1) weight in each by hash, so that sums are pre-aggregated where the rows lie, for any number of rows."""

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                h = part["_h"].to_numpy(np.int64).astype(np.uint64)
                v = part[sums].to_numpy(float)
                a = acc.setdefault(g, np.zeros((b, len(sums))))
                for at in range(0, len(h), 512):
                    x = h[at : at + 512, None] ^ (np.arange(b, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
                    a += np.searchsorted(_CDF, u).T @ v[at : at + 512]
        for g, a in acc.items():
            out = pd.DataFrame(a, columns=sums)
            for c, x in zip(by, g if isinstance(g, tuple) else (g,)):
                out[c] = x
            out["_b"] = np.arange(b)
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{s} double" for s in sums), *(f"{c} {kinds[c]}" for c in by), "_b int"])
    return df.select(*by, *sums, F.xxhash64(F.lit(seed), key).alias("_h")).mapInPandas(run, schema).groupBy(*by, "_b").agg(*(F.sum(s).alias(s) for s in sums))


_CDF = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1], np.arange(1, 20)])))


def bootstrap(df: DataFrame, key: str, num: list[str], den: list[str], by: list[str], b: int = 2000, seed: int = 1) -> DataFrame:
    """AG31, AG33: the ratio sum(num) / max(sum(den), 1) with its 95 % interval from b resamples of rows, by the columns `by`."""
    cols = list(dict.fromkeys(num + den))
    ratio = lambda: sum(F.col(c) for c in num) / F.greatest(sum(F.col(c) for c in den), F.lit(1.0))
    point = df.groupBy(*by).agg(*(F.sum(c).cast("double").alias(c) for c in cols), F.count("*").alias("n")).withColumn("value", ratio()).select(*by, "n", F.round("value", 9).alias("value"))
    ends = _poisson(df, key, cols, by, b, seed).withColumn("_v", ratio()).groupBy(*by).agg(F.percentile("_v", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return point.join(ends, by) if by else point.join(F.broadcast(ends))


def paired_verdict(df: DataFrame, key: str, config: str, errors: str, words: str, base: str, b: int = 2000, seed: int = 1) -> DataFrame:
    """AG32, AG34, A11: for each configuration its error rate, the difference to `base` on the same rows with a 95 % interval, and the verdict.

    Rows are weighted alike in all configurations, as the resamples hang on the key alone. Differences share the base's denominator.
    """
    ref = df.where(F.col(config) == base).select(key, F.col(errors).alias("_e0"), F.col(words).alias("_w0"))
    pairs = df.join(ref, key).withColumn("_d", F.col(errors) - F.col("_e0"))
    point = pairs.groupBy(config).agg(F.count("*").alias("n"), F.sum(errors).alias("errors"), F.sum(words).alias("words"), F.sum("_d").alias("_d"), F.sum("_w0").alias("_w0"), F.count_if(F.col(errors) > F.col(words) * 0.5).alias("bad_clips"), F.round(F.avg((F.col(errors) == F.col("_e0")).cast("double")), 9).alias("identical_share"))
    ends = _poisson(pairs, key, ["_d", "_w0"], [config], b, seed).withColumn("_v", F.col("_d") / F.greatest("_w0", F.lit(1.0))).groupBy(config).agg(F.percentile("_v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = point.join(ends, config).select(config, "n", "errors", "words", F.round(F.col("errors") / F.greatest("words", F.lit(1)), 9).alias("wer"), F.round(F.col("_d") / F.greatest("_w0", F.lit(1)), 9).alias("difference"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "bad_clips", "identical_share")
    return out.withColumn("verdict", F.when(F.col(config) == base, "reference").when(F.col("high") < 0, "better").when(F.col("low") > 0, "worse").otherwise("no clear difference"))


def latency(df: DataFrame, by: list[str], seconds: str, duration: Column) -> DataFrame:
    """AG29, NU16, NU17: n, median, p95, mean, max and the ratio of total times."""
    q = F.percentile(seconds, F.array(F.lit(0.5), F.lit(0.95)))
    return df.groupBy(*by).agg(F.count(seconds).alias("n"), F.round(q[0], 6).alias("median_s"), F.round(q[1], 6).alias("p95_s"), F.round(F.avg(seconds), 6).alias("mean_s"), F.round(F.max(seconds), 6).alias("max_s"), F.round(F.sum(seconds) / F.sum(duration), 6).alias("rtf"))


def speech_rate(words: Column, seconds: Column) -> Column:
    """NU8, NU15: words a minute; null without a duration above zero (views show 0.0 instead)."""
    return F.when(seconds > 0, words / (seconds / 60))


def label_recall(gold: DataFrame, pred: DataFrame, key: str, by: list[str]) -> DataFrame:
    """AG46: by the columns `by` and label: entities of gold as multisets of label and normalised text, how many pred has too, and their share. A row that pred lacks has none."""
    both = gold.select(key, *by, F.coalesce("entities", F.array().cast(_ENTITIES)).alias("g")).join(pred.select(key, F.coalesce("entities", F.array().cast(_ENTITIES)).alias("p")), key, "left")
    count = lambda c: F.transform(F.coalesce(c, F.array().cast(_ENTITIES)), lambda e: F.struct(e["label"].alias("label"), F.lower(tx.squeeze(e["text"])).alias("t")))
    each = both.select(*by, F.explode(F.array_distinct(count("g"))).alias("x"), count("g").alias("g"), count("p").alias("p"))
    same = lambda c: F.size(F.filter(c, lambda e: e.eqNullSafe(F.col("x"))))
    n = each.select(*by, "x.label", same("g").alias("n"), F.least(same("g"), same("p")).alias("m")).groupBy(*by, "label").agg(F.sum("m").alias("matched"), F.sum("n").alias("in_gold"))
    return n.withColumn("recall", F.round(F.col("matched") / F.greatest("in_gold", F.lit(1)), 9))


_ENTITIES = "array<struct<text:string,label:string,start:int,end:int>>"


def bootstrap_f1(gold: DataFrame, pred: DataFrame, key: str, by: list[str], b: int = 2000, seed: int = 1) -> DataFrame:
    """AG33: F1 of spans with its 95 % interval from b resamples of rows, by the columns `by`."""
    spans = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast(_ENTITIES)), lambda e: F.struct(e["start"].alias("s"), e["end"].alias("e"), e["label"].alias("l"))))
    both = gold.select(key, *by, spans(F.col("entities")).alias("g")).join(pred.select(key, spans(F.col("entities")).alias("p")), key, "left")
    n = both.select(key, *by, F.coalesce(2 * F.size(F.array_intersect("g", "p")), F.lit(0)).cast("double").alias("twice"), (F.size("g") + F.coalesce(F.size("p"), F.lit(0))).cast("double").alias("all"))
    return bootstrap(n, key, ["twice"], ["all"], by, b, seed)


def run_summary(records: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """AG41: records of a run by the columns `by`: valid, asked again and without entities in percent, mean and median time."""
    pct = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 6)
    empty = F.coalesce(F.size("entities"), F.lit(0)) <= 0
    return records.groupBy(*by).agg(F.count("*").alias("n"), pct(F.col("ok")).alias("valid_pct"), pct(F.col("n_rounds") > 1).alias("retry_pct"), pct(empty).alias("empty_pct"), F.round(F.avg(seconds), 4).alias("mean_latency_s"), F.round(F.median(seconds), 4).alias("median_latency_s"))


def variant_table(gold: DataFrame, pred: DataFrame, records: DataFrame, key: str, variant: str, labels: list[str]) -> DataFrame:
    """XO11: for each variant precision, recall and F1 of all spans, F1 of some labels, rows that are exactly alike, and rows asked again in percent."""
    s = span_scores(gold, pred, key, [variant])
    every = s.where("label = 'ALL'").select(variant, "precision", "recall", "f1")
    each = s.groupBy(variant).agg(*(F.coalesce(F.max(F.when(F.col("label") == k, F.col("f1"))), F.lit(0.0)).alias(f"f1_{k.lower()}") for k in labels))
    rows = records.groupBy(variant).agg(F.count("*").alias("n"), F.count_if(F.col("n_rounds") == 1).alias("exact"), F.round(F.avg(F.when(F.col("n_rounds") > 1, 100.0).otherwise(0.0)), 6).alias("retry_pct"))
    return rows.join(every, variant, "left").join(each, variant, "left")


def flag_validity(rows: DataFrame, flag: str, correct: Column) -> DataFrame:
    """AG39: flagged and other rows, how many are right, and the share that is wrong in percent."""
    n = rows.groupBy(flag).agg(F.count("*").alias("rows"), F.count_if(correct).alias("exactly_correct"))
    return n.withColumn("wrong_pct", F.round(100 * (1 - F.col("exactly_correct") / F.col("rows")), 6))


def window_sweep(clips: DataFrame, seconds: str, windows: list[int], words: str, full: str, short: str) -> DataFrame:
    """AG52, SL15: for each window the clips that fit, their share, the error rates of the full and of the short window, and clips with more than half of their words wrong."""
    fit = clips.select(F.explode(F.filter(F.array(*map(F.lit, windows)), lambda w: F.col(seconds) <= w)).alias("w"), words, full, short)
    rate = lambda c: F.round(F.sum(c) / F.greatest(F.sum(words), F.lit(1)), 9)
    bad = lambda c: F.count_if(2 * F.col(c) > F.col(words))
    n = fit.groupBy("w").agg(F.count("*").alias("clips"), rate(full).alias("wer_30s"), rate(short).alias("wer_window"), bad(full).alias("bad_clips_30s"), bad(short).alias("bad_clips"))
    return n.join(F.broadcast(clips.agg(F.count("*").alias("_t")))).withColumn("share", F.round(F.col("clips") / F.col("_t"), 9)).drop("_t")


def best_epoch(evaluations: DataFrame, by: list[str], epoch: str, metric: str) -> DataFrame:
    """AG53: epochs, the least metric, and the first epoch that has it."""
    return evaluations.groupBy(*by).agg(F.count("*").alias("epochs"), F.round(F.min(metric), 9).alias("best_wer"), F.min_by(epoch, F.struct(metric, epoch)).alias("best_epoch"))


def evaluate(gold: DataFrame, predict: Callable[[DataFrame], DataFrame], key: str, by: list[str] | None = None) -> DataFrame:
    """2.14 predict hook: scores of what predict(rows of key and text) gives as entities by key."""
    return span_scores(gold, predict(gold.select(key, "text")), key, by)


def evaluate_transcripts(clips: DataFrame, transcribe: Callable[[DataFrame], DataFrame], key: str, by: list[str]) -> DataFrame:
    """2.14 transcriber hook: error rates of what transcribe(clips without their transcript) gives as hypothesis by key, over scoring forms."""
    said = clips.join(transcribe(clips.drop("transcript")).select(key, "hypothesis"), key, "left")
    return transcript_errors(said.select(*by, tx.scoring_form(F.col("transcript")).alias("r"), tx.scoring_form(F.col("hypothesis")).alias("h")), "r", "h", by)
