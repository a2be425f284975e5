"""Queries over annotation runs, benchmark runs and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import spans as sp
from tapeloom.functions import text as tx
from tapeloom.functions import vocab
from tapeloom.functions.names import name_key
from tapeloom.operators import quality, scoring
from tapeloom.plans import dialect as q
from tapeloom.plans.registry import query
from tapeloom.plans.score_queries import _SPANS, _SRC, _sides
from tapeloom.plans.tables import read
from tapeloom.streaming import streams

_BOTH = f"list_sort(list_distinct(list_transform(%s, lambda x: (x.span[1], x.span[2], upper({q.key('x.label')})))))"
#: A run of an annotator over the queue: a row is good where it has labels and all are known, and was asked twice where the second answer differs.
_RUN = f"""
    WITH r AS (SELECT queue_id, {_SRC} source, {q.key('srca')} model, utterance_id, opta, coalesce(len(opta) > 0 AND len(list_filter(opta, lambda x: list_contains({q.words(vocab.LABELS)}, upper({q.key('x.label')})))) = len(opta), false) ok,
        CASE WHEN {_BOTH % 'opta'} IS DISTINCT FROM {_BOTH % 'optb'} THEN 2 ELSE 1 END n_rounds, len(opta) n FROM heldout_queue)
"""


def _run(spark, d) -> DataFrame:
    z = read(spark, d, "heldout_queue")
    known = lambda e: F.upper(name_key(e["label"])).isin(vocab.LABELS)
    keys = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda e: F.struct(e["span"][0].alias("s"), e["span"][1].alias("e"), F.upper(name_key(e["label"])).alias("k")))))
    return z.select(
        "queue_id", "utterance_id", name_key(F.col("dataset_source")).alias("source"), name_key(F.col("srca")).alias("model"), F.col("opta").alias("entities"),
        F.coalesce((F.size("opta") > 0) & F.forall("opta", known), F.lit(False)).alias("ok"), F.when(keys("opta").eqNullSafe(keys("optb")), 1).otherwise(2).alias("n_rounds"),
    )


@query("q_run_progress", "AG51 SR3", _RUN + """
    , h AS (SELECT count(DISTINCT utterance_id) pool_size, epoch(max(ingested_at)) - epoch(min(ingested_at)) elapsed FROM heldout), a AS (SELECT count(*) annotated, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) ok_rate, avg(CASE WHEN n_rounds > 1 THEN 1.0 ELSE 0 END) retry_rate FROM r)
    SELECT annotated, pool_size, round(ok_rate, 9) ok_rate, round(retry_rate, 9) retry_rate, round(annotated / elapsed, 12) rate_per_s, round((pool_size - annotated) / (annotated / elapsed), 3) eta_s FROM a, h""")
def run_progress(spark, d):
    h = read(spark, d, "heldout").agg(F.count_distinct("utterance_id").alias("pool_size"), (F.unix_micros(F.max("ingested_at").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ingested_at").cast("timestamp")) / 1e6).alias("elapsed"))
    return streams.run_progress(_run(spark, d), h)


@query("q_run_labels", "AG51", _RUN + f"SELECT source, upper({q.key('x.label')}) label, count(*) n FROM (SELECT source, unnest(opta) x FROM r) GROUP BY 1, 2")
def run_labels(spark, d):
    return streams.run_labels(_run(spark, d), ["source"])


@query("q_quality_summary", "AG41", _RUN + """
    , l AS (SELECT r.*, date_diff('microsecond', a, b) / 1e6 latency FROM r LEFT JOIN (SELECT utterance_id, min(ingested_at) a, max(ingested_at) b FROM heldout GROUP BY 1) USING (utterance_id))
    SELECT model, count(*) n, round(avg(CASE WHEN ok THEN 100.0 ELSE 0 END), 6) valid_pct, round(avg(CASE WHEN n_rounds > 1 THEN 100.0 ELSE 0 END), 6) retry_pct, round(avg(CASE WHEN coalesce(n, 0) = 0 THEN 100.0 ELSE 0 END), 6) empty_pct,
        round(avg(latency), 4) mean_latency_s, round(median(latency), 4) median_latency_s FROM l GROUP BY model""")
def quality_summary(spark, d):
    at = lambda f: F.unix_micros(f("ingested_at").cast("timestamp")) / 1e6
    sent = read(spark, d, "heldout").groupBy("utterance_id").agg((at(F.max) - at(F.min)).alias("latency"))
    return scoring.run_summary(_run(spark, d).join(sent, "utterance_id", "left"), ["model"], "latency")


@query("q_variants", "XO11", _RUN.replace("WITH r AS", "WITH r AS") + f"""
    , g AS (SELECT DISTINCT queue_id, model, x.span[1] s, x.span[2] e, upper({q.key('x.label')}) k FROM (SELECT q.queue_id, {q.key('q.srca')} model, unnest(q.optb) x FROM heldout_queue q)),
    p AS (SELECT DISTINCT queue_id, model, x.span[1] s, x.span[2] e, upper({q.key('x.label')}) k FROM (SELECT q.queue_id, {q.key('q.srca')} model, unnest(q.opta) x FROM heldout_queue q)),
    j AS (SELECT coalesce(g.model, p.model) model, coalesce(g.k, p.k) k, g.s IS NOT NULL AND p.s IS NOT NULL tp, g.s IS NULL fp, p.s IS NULL fn FROM g FULL JOIN p ON g.queue_id = p.queue_id AND g.s = p.s AND g.e = p.e AND g.k = p.k),
    c AS (SELECT model, count_if(tp) tp, count_if(fp) fp, count_if(fn) fn, {", ".join(f"count_if(tp AND k = '{k}') tp_{k}, count_if(fp AND k = '{k}') fp_{k}, count_if(fn AND k = '{k}') fn_{k}" for k in ("COMMAND", "FACILITY", "CALLSIGN"))} FROM j GROUP BY 1),
    t AS (SELECT model, count(*) n, count_if(n_rounds = 1) exact, round(avg(CASE WHEN n_rounds > 1 THEN 100.0 ELSE 0 END), 6) retry_pct FROM r GROUP BY 1)
    SELECT model AS variant, n, exact, retry_pct, round(tp / (tp + fp), 9) "precision", round(tp / (tp + fn), 9) recall, round(2 * tp / (2 * tp + fp + fn), 9) f1,
        {", ".join(f"round(CASE WHEN tp_{k} + fp_{k} + fn_{k} = 0 THEN 0 ELSE 2 * tp_{k} / (2 * tp_{k} + fp_{k} + fn_{k}) END, 9) f1_{k.lower()}" for k in ("COMMAND", "FACILITY", "CALLSIGN"))} FROM t LEFT JOIN c USING (model)""")
def variants(spark, d):
    a, b = _sides(spark, d)
    m = read(spark, d, "heldout_queue").select("queue_id", name_key(F.col("srca")).alias("variant"))
    return scoring.variant_table(b.join(m, "queue_id"), a, _run(spark, d).withColumnRenamed("model", "variant"), "queue_id", "variant", ["COMMAND", "FACILITY", "CALLSIGN"])


@query("q_flag_validity", "AR10 AG39")
def flag_validity(spark, d):
    """Rows that reasons would send to review against those they would not, and how many of each the second annotator has exactly alike. Without SQL: the reasons are long rules."""
    a, b = _sides(spark, d)
    both = a.join(b.select("queue_id", F.col("entities").alias("other")), "queue_id").join(_run(spark, d).select("queue_id", "ok", "n_rounds"), "queue_id")
    # the reasons of one annotator alone, as the other one is the measure here
    routed = both.withColumn("flagged", sp.triggers_review(sp.prototype_reasons("text", "entities", "entities", F.col("ok"), F.lit(True), F.col("n_rounds"))))
    return scoring.flag_validity(routed, "flagged", F.col("n_rounds") == 1)


@query("q_label_errors", "AR16", f"""
    WITH q AS (SELECT queue_id, text, opta, optb FROM heldout_queue),
    g AS (SELECT DISTINCT queue_id, x.span[1] s, x.span[2] e, upper({q.key('x.label')}) k FROM (SELECT queue_id, unnest(opta) x FROM q)), p AS (SELECT DISTINCT queue_id, x.span[1] s, x.span[2] e, upper({q.key('x.label')}) k FROM (SELECT queue_id, unnest(optb) x FROM q)),
    j AS (SELECT coalesce(g.queue_id, p.queue_id) queue_id, coalesce(g.k, p.k) label, g.s IS NOT NULL AND p.s IS NULL human, g.s IS NULL model FROM g FULL JOIN p ON g.queue_id = p.queue_id AND g.s = p.s AND g.e = p.e AND g.k = p.k)
    SELECT label, count(*) FILTER (human OR model) AS spans, count_if(human) human, count_if(model) model, count(DISTINCT CASE WHEN human OR model THEN queue_id END) rows FROM j WHERE list_contains({q.words(vocab.LABELS)}, label) GROUP BY 1 HAVING count_if(human OR model) > 0""")
def label_errors(spark, d):
    a, b = _sides(spark, d)
    both = a.select("queue_id", F.col("entities").alias("g")).join(b.select("queue_id", F.col("entities").alias("p")), "queue_id")
    each = both.select("queue_id", F.explode(F.array(*(F.struct(F.lit(k).alias("label"), sp.label_errors("g", "p", k).alias("x")) for k in vocab.LABELS))).alias("y")).where("y.x is not null")
    n = lambda c: F.sum(F.size(f"y.x.{c}"))
    return each.groupBy(F.col("y.label").alias("label")).agg((n("human") + n("model")).alias("spans"), n("human").alias("human"), n("model").alias("model"), F.count("*").alias("rows"))


@query("q_window_wer", "AG52", f"""
    WITH s AS (SELECT duration_s, {q.norm('ground_truth')} n FROM samples WHERE duration_s > 0 AND ground_truth IS NOT NULL),
    p AS (SELECT duration_s, {q.toks('n')} r, {q.toks("replace(n, 'two', 'to')")} a, {q.toks("replace(replace(n, 'two', 'to'), 'level', '')")} b FROM s),
    e AS (SELECT duration_s, len(r) w, {q.word_errors('r', 'a')} ea, {q.word_errors('r', 'b')} eb FROM p), w AS (SELECT unnest([4, 6, 8, 10, 15, 20, 30]) w)
    SELECT w.w, count(*) clips, round(count(*) / (SELECT count(*) FROM s), 9) AS share, round(sum(ea) / greatest(sum(e.w), 1), 9) wer_30s, round(sum(eb) / greatest(sum(e.w), 1), 9) wer_window, count_if(2 * ea > e.w) bad_clips_30s, count_if(2 * eb > e.w) bad_clips
    FROM e JOIN w ON duration_s <= w.w GROUP BY w.w""")
def window_wer(spark, d):
    n = F.col("n")
    s = read(spark, d, "samples").where("duration_s > 0 and ground_truth is not null").select("duration_s", tx.normalize(F.col("ground_truth")).alias("n"))
    full = F.replace(n, F.lit("two"), F.lit("to"))
    e = s.select("duration_s", tx.word_count(n).alias("words"), tx.word_errors(n, full).alias("full"), tx.word_errors(n, F.replace(full, F.lit("level"), F.lit(""))).alias("short"))
    return scoring.window_sweep(e, "duration_s", [4, 6, 8, 10, 15, 20, 30], "words", "full", "short")


@query("q_best_epoch", "AG53", """
    WITH e AS (SELECT event_type run, CAST(ts AS DATE) epoch, avg(value) wer FROM events GROUP BY 1, 2)
    SELECT run, count(*) epochs, round(min(wer), 9) best_wer, arg_min(epoch, (wer, epoch)) best_epoch FROM e GROUP BY run""")
def best_epoch(spark, d):
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("epoch")).agg(F.avg("value").alias("wer"))
    return scoring.best_epoch(e, ["run"], "epoch", "wer")


@query("q_last_values", "WN10", """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) r FROM events)
    SELECT event_type, count(*) n, round(avg(value), 9) mean, round(max(value), 9) longest FROM r WHERE r <= 60 GROUP BY 1""")
def last_values(spark, d):
    last = streams.last_values(read(spark, d, "events"), ["event_type"], ["ts", "event_id"], 60)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.max("value"), 9).alias("longest"))


@query("q_decode_ok", "PF9", "SELECT source, count(*) n, count_if(coalesce(note, '') = '') decoded FROM samples GROUP BY 1")
def decode_ok(spark, d):
    return read(spark, d, "samples").groupBy("source").agg(F.count("*").alias("n"), F.count_if(quality.decode_ok(F.col("note"))).alias("decoded"))


@query("q_speech_rate", "NU8 NU15", f"""
    SELECT id, round(CASE WHEN duration_s > 0 THEN len({q.toks(q.norm('ground_truth'))}) / (duration_s / 60) END, 6) wpm, round(CASE WHEN duration_s > 0 THEN len({q.toks(q.norm('ground_truth'))}) / (duration_s / 60) ELSE 0 END, 6) shown_wpm FROM samples""")
def speech_rate(spark, d):
    n = tx.word_count(tx.normalize(F.col("ground_truth")))
    return read(spark, d, "samples").select("id", F.round(scoring.speech_rate(n, F.col("duration_s")), 6).alias("wpm"), F.round(F.coalesce(scoring.speech_rate(n, F.col("duration_s")), F.lit(0.0)), 6).alias("shown_wpm"))


@query("q_bootstrap_f1", "AG33")
def bootstrap_f1(spark, d):
    """Span F1 by source with its interval from 2,000 resamples of rows. Without SQL: resamples come from hashes."""
    a, b = _sides(spark, d)
    return scoring.bootstrap_f1(a, b, "queue_id", ["source"])


@query("q_label_recall", "AG46", _SPANS.split("j AS (")[0].rstrip().rstrip(",") + f""",
    x AS (SELECT queue_id, {_SRC} source, y.label l, lower(trim(regexp_replace(y.text, '[\\s\\p{{Z}}]+', ' ', 'g'))) t FROM (SELECT *, unnest(opta) y FROM heldout_queue)), z AS (SELECT queue_id, y.label l, lower(trim(regexp_replace(y.text, '[\\s\\p{{Z}}]+', ' ', 'g'))) t FROM (SELECT *, unnest(optb) y FROM heldout_queue)),
    g AS (SELECT queue_id, source, upper({q.key('l')}) l, t, count(*) n FROM x GROUP BY ALL), p AS (SELECT queue_id, upper({q.key('l')}) l, t, count(*) n FROM z GROUP BY ALL)
    SELECT g.source, g.l label, CAST(sum(least(g.n, coalesce(p.n, 0))) AS BIGINT) matched, CAST(sum(g.n) AS BIGINT) in_gold, round(sum(least(g.n, coalesce(p.n, 0))) / greatest(sum(g.n), 1), 9) recall FROM g LEFT JOIN p ON g.queue_id = p.queue_id AND g.l = p.l AND g.t = p.t GROUP BY 1, 2""")
def label_recall(spark, d):
    a, b = _sides(spark, d)
    return scoring.label_recall(a, b, "queue_id", ["source"])


@query("q_word_diff", "ST-15")
def word_diff(spark, d):
    """Words kept, cut and added between the two copies of an utterance that were sent, by matching blocks."""
    h = read(spark, d, "heldout").where("text is not null").groupBy("utterance_id").agg(F.min_by("text", F.struct("ingested_at", "text")).alias("a"), F.max_by("text", F.struct("ingested_at", "text")).alias("b"))
    x = h.select("utterance_id", sp.diff_words("a", "b").alias("w"))
    n = lambda op: F.size(F.filter("w", lambda y: y["op"] == op))
    return x.select("utterance_id", n("=").alias("kept"), n("-").alias("cut"), n("+").alias("added"))
