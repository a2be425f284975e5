"""Queries over spans, scores, benchmarks, signals and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import audio, vocab
from tapeloom.functions import spans as sp
from tapeloom.functions import text as tx
from tapeloom.functions.names import name_key
from tapeloom.operators import curation, profile, scoring
from tapeloom.plans import dialect as q
from tapeloom.plans.registry import query
from tapeloom.plans.tables import read
from tapeloom.sources import writers
from tapeloom.streaming import streams

_SRC = q.key("dataset_source")
#: A hypothesis with known errors: greetings dropped and two words misheard.
_HYP = f"replace(replace({q.ungreeted('n')}, 'two', 'to'), 'level', '')"


def _pairs(spark, d) -> DataFrame:
    n = tx.normalize(F.col("text"))
    hyp = F.replace(F.replace(tx.strip_greetings(n), F.lit("two"), F.lit("to")), F.lit("level"), F.lit(""))
    return read(spark, d, "gold").select("utterance_id", name_key(F.col("dataset_source")).alias("source"), n.alias("ref"), hyp.alias("hyp"))


_P = f"WITH a AS (SELECT utterance_id, {_SRC} source, {q.norm('text')} n FROM gold), p AS (SELECT utterance_id, source, {q.toks('n')} r, {q.toks(_HYP)} h, n ref, {_HYP} hyp FROM a), e AS (SELECT *, {q.word_errors('r', 'h')} e, len(r) w FROM p)"


@query("q_wer_rows", "ST-11 ST-13 AG34 XO9", _P + " SELECT utterance_id, e errors, w words, round(CASE WHEN w > 0 THEN e / w END, 9) wer FROM e")
def wer_rows(spark, d):
    e, w = tx.word_errors(F.col("ref"), F.col("hyp")), tx.word_count(F.col("ref"))
    return _pairs(spark, d).select("utterance_id", e.alias("errors"), w.alias("words"), F.round(tx.wer(F.col("ref"), F.col("hyp")), 9).alias("wer"))


@query("q_wer_by_source", "AG21 AG30 XO26", _P + " SELECT source, count(*) n, sum(e) errors, sum(w) words, round(sum(e) / greatest(sum(w), 1), 9) wer FROM e GROUP BY ROLLUP (source)")
def wer_by_source(spark, d):
    return scoring.transcript_errors(_pairs(spark, d), "ref", "hyp", ["source"])


@query("q_cer", "ST-12", _P + """, c AS (SELECT utterance_id, CASE WHEN length(ref) = 0 THEN [] ELSE string_split(ref, '') END r, CASE WHEN length(hyp) = 0 THEN [] ELSE string_split(hyp, '') END h FROM p)
    SELECT utterance_id, round(CASE WHEN len(r) > 0 THEN """ + q.word_errors("r", "h") + """ / len(r) END, 9) cer FROM c""")
def cer(spark, d):
    return _pairs(spark, d).select("utterance_id", F.round(tx.cer(F.col("ref"), F.col("hyp")), 9).alias("cer"))


@query("q_recalls", "ST-16 ST-17 ST-18 AG22", _P + rf"""
    , x AS (SELECT source, list_filter(r, lambda t: list_contains({q.words(vocab.NUMERALS)}, t)) want, h, ref, hyp FROM e)
    SELECT source, round(avg(CASE WHEN len(want) > 0 THEN len(list_filter(want, lambda t: list_contains(h, t))) / len(want) END), 6) numerals,
        {", ".join(f"round(avg(CASE WHEN regexp_matches(ref, '{p}') THEN CAST(regexp_matches(hyp, '{p}') AS DOUBLE) END), 6) {k}" for k, p in tx.PATTERNS.items())} FROM x GROUP BY source""")
def recalls(spark, d):
    p = _pairs(spark, d)
    pattern = lambda k: F.round(F.avg(tx.pattern_recall(F.col("ref"), F.col("hyp"), tx.PATTERNS[k])), 6).alias(k)
    return p.groupBy("source").agg(F.round(F.avg(tx.token_recall(F.col("ref"), F.col("hyp"), vocab.NUMERALS)), 6).alias("numerals"), *map(pattern, tx.PATTERNS))


@query("q_error_words", "ST-14")
def error_words(spark, d):
    p = _pairs(spark, d).select(sp.errors_of("ref", "hyp").alias("e")).select(F.explode(F.concat(F.transform(F.col("e")[1], lambda w: F.concat(F.lit("-"), w)), F.col("e")[0])).alias("error"))
    return p.groupBy("error").agg(F.count("*").alias("n"))


@query("q_binned_wer", "AG25", _P + """
    SELECT source, CASE WHEN w <= 20 THEN 0 WHEN w <= 40 THEN 1 ELSE 2 END bin, count(*) n, round(sum(e) / sum(w), 9) wer FROM e WHERE w > 0 GROUP BY 1, 2""")
def binned_wer(spark, d):
    """By source and words: up to 20, up to 40, more. Rows without a word have no rate and no bin."""
    p = _pairs(spark, d).withColumns({"e": tx.word_errors(F.col("ref"), F.col("hyp")), "w": tx.word_count(F.col("ref"))}).where("w > 0")
    return p.withColumn("bin", profile.bins(F.col("w"), [0, 20, 40, float("inf")])).groupBy("source", "bin").agg(F.count("*").alias("n"), F.round(F.sum("e") / F.sum("w"), 9).alias("wer"))


@query("q_bootstrap_wer", "AG31")
def bootstrap_wer(spark, d):
    p = _pairs(spark, d).withColumns({"e": tx.word_errors(F.col("ref"), F.col("hyp")).cast("double"), "w": tx.word_count(F.col("ref")).cast("double")})
    return scoring.bootstrap(p, "utterance_id", ["e"], ["w"], ["source"])


@query("q_paired_verdict", "AG32 AG34 JN11 XO14")
def paired_verdict(spark, d):
    p = _pairs(spark, d).withColumn("configs", F.array(F.struct(F.lit("base").alias("config"), F.col("hyp").alias("h")), F.struct(F.lit("same").alias("config"), F.col("hyp").alias("h")), F.struct(F.lit("oracle").alias("config"), F.col("ref").alias("h"))))
    x = p.select("utterance_id", "ref", F.explode("configs").alias("c")).select("utterance_id", "c.config", tx.word_errors(F.col("ref"), F.col("c.h")).cast("double").alias("errors"), tx.word_count(F.col("ref")).cast("double").alias("words"))
    return scoring.paired_verdict(x, "utterance_id", "config", "errors", "words", "base")


@query("q_latency", "AG29 NU16 NU17 PF15", """
    SELECT event_type, count(value) n, round(quantile_cont(value, 0.5), 6) median_s, round(quantile_cont(value, 0.95), 6) p95_s, round(avg(value), 6) mean_s, round(max(value), 6) max_s, round(sum(value) / sum(user_id % 10 + 1), 6) rtf FROM events GROUP BY 1""")
def latency(spark, d):
    return scoring.latency(read(spark, d, "events"), ["event_type"], "value", F.col("user_id") % 10 + 1)


@query("q_baseline_twin", "JN16 A18", """
    WITH c AS (SELECT event_type || CASE WHEN user_id % 2 = 0 THEN '-dynwin' ELSE '' END config, median(value) m FROM events GROUP BY 1), b AS (SELECT * FROM c WHERE config NOT LIKE 'c%-dynwin')
    SELECT c.config, round(c.m / coalesce(x.m, y.m), 6) ratio FROM c LEFT JOIN b x ON x.config = c.config LEFT JOIN b y ON y.config = replace(c.config, '-dynwin', '')""")
def baseline_twin(spark, d):
    c = read(spark, d, "events").groupBy(F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "-dynwin").otherwise("")).alias("config")).agg(F.median("value").alias("m"))
    b = c.where("config not like 'c%-dynwin'").select(F.col("config").alias("k"), F.col("m").alias("b"))
    x = c.join(b.withColumnRenamed("b", "x"), F.col("config") == F.col("k"), "left").drop("k")
    x = x.join(b.withColumnRenamed("b", "y"), F.replace("config", F.lit("-dynwin"), F.lit("")) == F.col("k"), "left")
    return x.select("config", F.round(F.col("m") / F.coalesce("x", "y"), 6).alias("ratio"))


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    z = read(spark, d, "heldout_queue").select("queue_id", name_key(F.col("dataset_source")).alias("source"), "text", "opta", "optb")
    up = lambda c: F.transform(sp.flat(F.col(c)), lambda e: F.struct(e["text"].alias("text"), F.upper(name_key(e["label"])).alias("label"), e["start"].alias("start"), e["end"].alias("end")))
    return tuple(z.select("queue_id", "source", "text", up(c).alias("entities")) for c in ("opta", "optb"))


_SPANS = f"""
    WITH q AS (SELECT queue_id, {_SRC} source, opta, optb FROM heldout_queue),
    a AS (SELECT DISTINCT queue_id, source, x.span[1] s, x.span[2] e, upper({q.key('x.label')}) label FROM (SELECT queue_id, source, unnest(opta) x FROM q)),
    b AS (SELECT DISTINCT queue_id, source, x.span[1] s, x.span[2] e, upper({q.key('x.label')}) label FROM (SELECT queue_id, source, unnest(optb) x FROM q)),
    j AS (SELECT coalesce(a.source, b.source) source, coalesce(a.label, b.label) label, a.s IS NOT NULL AND b.s IS NOT NULL tp, a.s IS NULL fp, b.s IS NULL fn
        FROM a FULL JOIN b ON a.queue_id = b.queue_id AND a.s = b.s AND a.e = b.e AND a.label = b.label),
    c AS (SELECT source, coalesce(label, 'ALL') label, count_if(tp) tp, count_if(fp) fp, count_if(fn) fn FROM j GROUP BY GROUPING SETS ((source, label), (source))),
    s AS (SELECT source, label, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) recall,
        round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) f1, tp + fn support FROM c)
"""


@query("q_span_scores", "AG26 NU19 JN8 JN9 SO5", _SPANS + "SELECT * FROM s")
def span_scores(spark, d):
    a, b = _sides(spark, d)
    return scoring.span_scores(a, b, "queue_id", ["source"])


@query("q_span_averages", "AG27 AG28 XO27", _SPANS + """
    SELECT source, 'micro' AS average, "precision", recall, f1, support FROM s WHERE label = 'ALL'
    UNION ALL SELECT source, 'macro', round(avg("precision"), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM s WHERE label <> 'ALL' AND support > 0 GROUP BY source
    UNION ALL SELECT source, 'weighted', round(sum("precision" * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM s WHERE label <> 'ALL' AND support > 0 GROUP BY source""")
def span_averages(spark, d):
    a, b = _sides(spark, d)
    return scoring.averages(scoring.span_scores(a, b, "queue_id", ["source"]), ["source"])


@query("q_exact_sets", "AG28 AG43 XO12", f"""
    WITH s AS (SELECT {_SRC} source, list_sort(list_distinct(list_transform(opta, lambda x: (x.span[1], x.span[2], upper({q.key('x.label')}))))) a, list_sort(list_distinct(list_transform(optb, lambda x: (x.span[1], x.span[2], upper({q.key('x.label')}))))) b FROM heldout_queue)
    SELECT source, count(*) n, count_if(a = b) exact FROM s GROUP BY source""")
def exact_sets(spark, d):
    a, b = _sides(spark, d)
    return scoring.exact_rows(a, b, "queue_id", ["source"])


@query("q_entity_multiset", "AG45 AG46 SO6", f"""
    WITH q AS (SELECT queue_id, {_SRC} source, opta, optb FROM heldout_queue),
    a AS (SELECT queue_id, source, upper({q.key('x.label')}) l, lower(trim(regexp_replace(x.text, '[\\s\\p{{Z}}]+', ' ', 'g'))) t, count(*) n FROM (SELECT queue_id, source, unnest(opta) x FROM q) GROUP BY ALL),
    b AS (SELECT queue_id, source, upper({q.key('x.label')}) l, lower(trim(regexp_replace(x.text, '[\\s\\p{{Z}}]+', ' ', 'g'))) t, count(*) n FROM (SELECT queue_id, source, unnest(optb) x FROM q) GROUP BY ALL),
    m AS (SELECT source, sum(least(a.n, b.n)) m FROM a JOIN b USING (queue_id, source, l, t) GROUP BY source)
    , t AS (SELECT source, m, (SELECT sum(n) FROM a WHERE a.source = m.source) g, (SELECT sum(n) FROM b WHERE b.source = m.source) p FROM m)
    SELECT source, CAST(m AS BIGINT) matched, CAST(g AS BIGINT) in_gold, CAST(p AS BIGINT) in_pred, round(CASE WHEN p > 0 THEN m / p ELSE 0 END, 9) "precision", round(CASE WHEN g > 0 THEN m / g ELSE 0 END, 9) recall, round(CASE WHEN m > 0 THEN 2 * m / (g + p) ELSE 0 END, 9) f1 FROM t""")
def entity_multiset(spark, d):
    a, b = _sides(spark, d)
    j = a.select("queue_id", "source", F.col("entities").alias("g")).join(b.select("queue_id", F.col("entities").alias("p")), "queue_id")
    m, g, p = scoring.multiset_counts(F.col("g"), F.col("p"))
    n = j.groupBy("source").agg(F.sum(m).alias("matched"), F.sum(g).alias("in_gold"), F.sum(p).alias("in_pred"))
    scores = scoring.prf(F.col("matched"), F.col("in_pred") - F.col("matched"), F.col("in_gold") - F.col("matched"))
    return n.select("*", *scores[:3])


@query("q_overlap_agreement", "AG42 JN14", _SPANS + """
    SELECT label, count(*) spans, count_if(EXISTS (SELECT 1 FROM b WHERE b.queue_id = a.queue_id AND b.label = a.label AND a.s < b.e AND b.s < a.e)) met FROM a GROUP BY label""")
def overlap_agreement(spark, d):
    a, b = _sides(spark, d)
    j = a.select("queue_id", F.explode(F.array_distinct("entities")).alias("x")).join(b.select("queue_id", F.col("entities").alias("p")), "queue_id").dropDuplicates(["queue_id", "x"])
    met = F.exists("p", lambda e: (e["label"] == F.col("x.label")) & (F.col("x.start") < e["end"]) & (e["start"] < F.col("x.end")))
    return j.groupBy(F.col("x.label").alias("label")).agg(F.count("*").alias("spans"), F.count_if(met).alias("met"))


@query("q_label_stats", "AG35 AG37", """
    WITH e AS (SELECT x.label l, lower(x.text) t FROM (SELECT unnest(entities) x FROM gold))
    SELECT l AS label, count(*) spans, round(count(*) / (SELECT count(*) FROM e), 9) AS share, count(DISTINCT t) texts, round(count(DISTINCT t) / count(*), 9) distinct_ratio FROM e GROUP BY 1""")
def label_stats(spark, d):
    e = read(spark, d, "gold").select(F.explode("entities").alias("x")).select(F.col("x.label").alias("label"), F.lower("x.text").alias("t"))
    s = e.groupBy("label", "t").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("spans"), F.count_if(F.col("t").isNotNull()).alias("texts"))
    return s.join(F.broadcast(s.agg(F.sum("spans").alias("_t")))).select("label", "spans", F.round(F.col("spans") / F.col("_t"), 9).alias("share"), "texts", F.round(F.col("texts") / F.col("spans"), 9).alias("distinct_ratio"))


@query("q_runway_template", "AG38", f"""
    WITH e AS (SELECT {q.norm('x.text')} t FROM (SELECT unnest(entities) x FROM gold) WHERE x.label = 'RUNWAY') SELECT count(*) spans, count_if(starts_with(t, 'runway')) led, count_if(len({q.toks('t')}) = 3) of_three FROM e""")
def runway_template(spark, d):
    e = read(spark, d, "gold").select(F.explode("entities").alias("x")).where("x.label = 'RUNWAY'").select(tx.normalize(F.col("x.text")).alias("t"))
    return e.agg(F.count("*").alias("spans"), F.count_if(F.col("t").startswith("runway")).alias("led"), F.count_if(tx.word_count(F.col("t")) == 3).alias("of_three"))


@query("q_rule_spans", "AR1 XO8")
def rule_spans(spark, d):
    r = read(spark, d, "gold").select("utterance_id", tx.normalize(F.col("text")).alias("text")).withColumn("e", sp.rule_entities("text"))
    return r.select("utterance_id", F.explode("e").alias("e")).select("utterance_id", "e.start", "e.end", "e.label", "e.text")


@query("q_constraints", "AR2", f"""
    WITH g AS (SELECT {q.norm('text')} u, unnest(entities) x FROM gold), e AS (SELECT u, x.label, {q.norm('x.text')} t FROM g), s AS (SELECT *, string_split(t, ' ') w FROM e WHERE t <> '')
    SELECT label, {q.constraint()} reason, count(*) n FROM s GROUP BY 1, 2""")
def constraints(spark, d):
    e = read(spark, d, "gold").select(tx.normalize(F.col("text")).alias("u"), F.explode("entities").alias("x")).select("u", F.col("x.label").alias("label"), tx.normalize(F.col("x.text")).alias("t")).where("t <> ''")
    return e.groupBy("label", sp.constraint(F.col("t"), F.col("label"), F.col("u")).alias("reason")).agg(F.count("*").alias("n"))


@query("q_alignment", "AR3 AR4 AR5 AR6 AR26 WN14")
def alignment(spark, d):
    g = read(spark, d, "gold").select("utterance_id", "text", "entities", sp.stated_entities("text", "entities").alias("stated"))
    low = F.lower("text")
    g = g.withColumn("found", sp.aligned_entities(low, "entities")).withColumn("merged", sp.merged_entities(low, "found"))
    return g.select("utterance_id", F.size("stated").alias("stated"), F.size("found").alias("found"), F.size("merged").alias("merged"))


def _rows(spark, d) -> DataFrame:
    """Both sides' labels of each queue row."""
    a, b = _sides(spark, d)
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query("q_iob2", "AR11 AR12 AR13 JN15 WN8 PF20", q.SIDES + """
    , g AS (SELECT *, list_transform(t, lambda u: coalesce(list_transform(list_filter(d, lambda x: x.s <= u.s AND u.e <= -x.m), lambda x: CASE WHEN len(list_filter(t, lambda y: y.s < u.s AND y.s >= x.s)) > 0 THEN 'I-' ELSE 'B-' END || x.k)[1], 'O')) g,
        list_transform(d, lambda x: list_filter(t, lambda u: x.s <= u.s AND u.e <= -x.m)) inside FROM t)
    SELECT queue_id, side, array_to_string(g, ' ') tags, CAST(len(list_filter(range(1, len(d) + 1), lambda i: len(inside[i]) > 0 AND (inside[i][1].s <> d[i].s OR inside[i][len(inside[i])].e <> -d[i].m))) AS INTEGER) lost,
        CAST(coalesce(list_sum(list_transform(g, lambda x: CASE WHEN x = 'O' THEN 0 ELSE 2 * list_position(""" + q.words(vocab.LABELS) + """, x[3:]) - CASE WHEN x[1:1] = 'B' THEN 1 ELSE 0 END END)), 0) AS BIGINT) id_sum FROM g""")
def iob2(spark, d):
    t = _rows(spark, d).withColumn("entities", sp.disjoint_entities("text", "entities")).withColumn("tags", sp.tags("text", "entities"))
    back = t.withColumn("again", sp.tag_entities("text", "tags"))
    ids = F.aggregate(sp.tag_ids("tags"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select("queue_id", "side", F.array_join("tags", " ").alias("tags"), F.size(F.array_except("again", "entities")).alias("lost"), ids.alias("id_sum"))


@query("q_missed_verbs", "AR7 AR19", q.SIDES + f"""
    , u AS (SELECT side, o, text, unnest(t) u FROM t), l AS (SELECT side, u.w verb, len(list_filter(o, lambda x: x.s <= u.s AND u.e <= -x.m)) held, ends_with(substring(text, 1, u.s), 'radar ') after FROM u WHERE list_contains({q.words([*vocab.VERBS, *vocab.EXTRA_VERBS])}, u.w))
    SELECT side, verb, count_if(held = 0 AND NOT (verb = 'contact' AND after)) n, count_if(held > 0) held FROM l GROUP BY 1, 2""")
def missed_verbs(spark, d):
    """For each side and verb how often it is missed, and how often a word of it has a label."""
    verbs = [*vocab.VERBS, *vocab.EXTRA_VERBS]
    r = _rows(spark, d)
    loose = r.select("side", F.explode(sp.missed("text", "entities")).alias("verb")).select("side", "verb", F.lit(1).alias("n"), F.lit(0).alias("held"))
    words = F.zip_with(sp.located(F.col("text")), sp.labels_of_words("text", "entities"), lambda t, k: F.struct(t["w"].alias("verb"), k.isNotNull().cast("int").alias("held")))
    held = r.select("side", F.explode(F.filter(words, lambda x: x["verb"].isin(verbs))).alias("x")).select("side", "x.verb", F.lit(0).alias("n"), "x.held")
    return loose.unionByName(held).groupBy("side", "verb").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


@query("q_rendered", "AR8 ST-19 PF20 AG55 ST-27 AR20 AR21", q.SIDES + """
    , x AS (SELECT *, list_transform(d, lambda y: {'text': substring(text, y.s + 1, -y.m - y.s), 'label': y.k, 'start': y.s, 'end': -y.m}) e FROM t),
    y AS (SELECT *, array_to_string(list_transform(e, lambda z: z.label || chr(32) || chr(39) || z.text || chr(39)), '; ') said0 FROM x)
    SELECT queue_id, side, array_to_string(list_transform(range(1, len(d) + 1), lambda i: substring(text, CASE WHEN i > 1 THEN -(d[i - 1].m) ELSE 0 END + 1, d[i].s - CASE WHEN i > 1 THEN -(d[i - 1].m) ELSE 0 END) || '[' || e[i].text || ' | ' || e[i].label || ']'), '') || substring(text, CASE WHEN len(d) > 0 THEN -(d[len(d)].m) ELSE 0 END + 1) shown,
        CASE WHEN len(e) > 0 THEN said0 ELSE 'none' END said, sha1(to_json({'text': text, 'e': e})) cache_key, sha1('Utterance: ' || text || CASE WHEN len(e) > 0 THEN E'\\nHints: ' || said0 ELSE '' END) prompt_key,
        array_to_string(list_transform(list_filter(range(1, len(e) + 1), lambda i: e[i].label = 'CALLSIGN' AND len(list_filter(e[1:i - 1], lambda z: z.label = 'CALLSIGN' AND z.text = e[i].text)) = 0), lambda i: e[i].text), ', ') headline FROM y""")
def rendered(spark, d):
    a = _rows(spark, d).withColumn("e", sp.disjoint_entities("text", "entities"))
    headline = F.array_join(F.array_distinct(F.transform(F.filter("e", lambda x: x["label"] == "CALLSIGN"), lambda x: x["text"])), ", ")
    return a.select("queue_id", "side", sp.rendered(F.col("text"), F.col("e")).alias("shown"), sp.shown_entities(F.col("e")).alias("said"), F.sha1(F.to_json(F.struct("text", "e"))).alias("cache_key"), F.sha1(tx.prompt(F.col("text"), F.col("e"))).alias("prompt_key"), headline.alias("headline"))


def _curated(spark, d) -> DataFrame:
    g = read(spark, d, "gold")
    r = g.select(F.col("utterance_id").alias("id"), tx.normalize(F.col("text")).alias("text"), name_key(F.col("dataset_split")).alias("split"), F.lit(True).alias("ok"), (F.crc32(F.encode("utterance_id", "utf-8")) % 5 == 0).cast("int").alias("n_flags"), F.lit(1).alias("n_rounds"))
    r = r.withColumn("entities", sp.rule_entities("text"))
    e = read(spark, d, "samples").select(tx.normalize(F.col("ground_truth")).alias("text")).where("text <> ''")
    return curation.curate(r, e, {"train": "train", "validation": "dev", "test": "test_llm"}, ["dev", "test_llm"])


@query("q_curate", "AR9 JN5")
def curate(spark, d):
    return _curated(spark, d).select("id", "split", "route", F.array_join("signals", ",").alias("signals"))


@query("q_curate_manifest", "AG35 AG36 AG40")
def curate_manifest(spark, d):
    return writers.manifest(_curated(spark, d))


@query("q_adjudicate", "JN13 AR17 AR18 SO7")
def adjudicate(spark, d):
    a, b = _sides(spark, d)
    return curation.adjudicate(a, b, "queue_id", 6).select("queue_id", F.size("diffs").alias("diffs"), "outcome", "shown_first")


@query("q_nearest", "SL16 NU21", f"""
    WITH t AS (SELECT id, {q.toks("lower(coalesce(ground_truth, ''))")} w FROM samples),
    x AS (SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) t FROM t),
    f AS (SELECT id, t, count(*) tf FROM x GROUP BY 1, 2), i AS (SELECT t, ln((1 + (SELECT count(*) FROM samples)) / (1 + count(*))) + 1 idf FROM f GROUP BY t),
    v AS (SELECT id, t, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) v FROM f JOIN i USING (t)),
    s AS (SELECT q.id AS query, p.id id, round(sum(q.v * p.v), 9) score FROM v q JOIN v p ON q.t = p.t AND q.id <> p.id WHERE CAST(substring(q.id, 5) AS INTEGER) % 20 = 0 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id DESC) rank FROM s)
    SELECT query, CAST(rank AS INTEGER) rank, round(score, 6) score FROM k WHERE rank <= 3""")
def nearest(spark, d):
    pool = read(spark, d, "samples").select("id", F.lower(F.coalesce("ground_truth", F.lit(""))).alias("text"))
    queries = pool.where(F.substring("id", 5, 20).cast("bigint") % 20 == 0)
    return curation.nearest(pool, queries, "id", 3).select("query", "rank", F.round("score", 6).alias("score"))


@query("q_rms", "NU1 NU4", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings)
    SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 6) rms, round(len(list_filter(range(1, len(v)), lambda i: (v[i] < 0) <> (v[i + 1] < 0))) / (len(v) - 1), 9) zcr FROM e""")
def rms(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(audio.whole_rms(F.col("embedding")), 6).alias("rms"), F.round(audio.whole_zcr(F.col("embedding")), 9).alias("zcr"))


@query("q_envelope", "AG54", """
    WITH e AS (SELECT vec_id, embedding v, unnest(range(0, 8)) i FROM embeddings)
    SELECT vec_id, CAST(i AS INTEGER) bin, round(CAST(list_min(v[i * 8 + 1:i * 8 + 8]) AS DOUBLE), 6) low, round(CAST(list_max(v[i * 8 + 1:i * 8 + 8]) AS DOUBLE), 6) high FROM e""")
def envelope(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode(audio.envelope(F.col("embedding"), 8)).alias("bin", "x"))
    return e.select("vec_id", "bin", F.round(F.col("x.low").cast("double"), 6).alias("low"), F.round(F.col("x.high").cast("double"), 6).alias("high"))


@query("q_signal_features", "NU1 NU2 NU3 NU5 NU6 NU7 NU8 NU9 SC11 AR23")
def signal_features(spark, d):
    return read(spark, d, "embeddings").select("vec_id", audio.features(F.col("embedding"), 64, 16, 4).alias("f")).select("vec_id", "f.*")


@query("q_pauses", "NU13 SL17 XO17")
def pauses(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.explode(audio.pauses(F.col("embedding"), 64, 0.4, 8, 2)).alias("s")).select("vec_id", "s.*")


@query("q_window_sweep", "SL15", """
    WITH w AS (SELECT unnest([4, 6, 8, 10, 15, 20, 30]) w) SELECT w, count(*) clips, round(count(*) / (SELECT count(*) FROM samples WHERE duration_s > 0), 9) AS share,
        count_if(w = (SELECT min(x.w) FROM w x WHERE x.w >= duration_s)) smallest FROM samples JOIN w ON duration_s > 0 AND duration_s <= w GROUP BY w""")
def window_sweep(spark, d):
    s = read(spark, d, "samples").where("duration_s > 0").select("duration_s")
    fit = F.filter(F.array(*map(F.lit, (4, 6, 8, 10, 15, 20, 30))), lambda w: F.col("duration_s") <= w)
    x = s.select(F.explode(fit).alias("w"), F.array_min(fit).alias("m")).groupBy("w").agg(F.count("*").alias("clips"), F.count_if(F.col("w") == F.col("m")).alias("smallest"))
    return x.join(F.broadcast(s.agg(F.count("*").alias("_t")))).select("w", "clips", F.round(F.col("clips") / F.col("_t"), 9).alias("share"), "smallest")


@query("q_corpus_text", "XO21", f"SELECT {q.key('dataset_source')} source, substring(md5(utterance_id), 1, 2) part, md5(string_agg({q.norm('text')}, ' ' ORDER BY utterance_id)) corpus FROM gold GROUP BY 1, 2")
def corpus_text(spark, d):
    """A source's text in 256 parts by hash, each ordered by id, so that no task joins a whole source."""
    g = read(spark, d, "gold").select(name_key(F.col("dataset_source")).alias("source"), F.substring(F.md5("utterance_id"), 1, 2).alias("part"), "utterance_id", tx.normalize(F.col("text")).alias("t"))
    return g.groupBy("source", "part").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utterance_id", "t"))), lambda x: x["t"]), " ")).alias("corpus"))


@query("q_json_props", "AR25 SC8", """SELECT event_type, count(*) n, count_if(json_valid(props)) good, count(DISTINCT json_extract_string(props, '$.' || json_keys(props)[1])) firsts FROM events GROUP BY 1""")
def json_props(spark, d):
    e = read(spark, d, "events")
    first = F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.from_json("props", "map<string,string>").isNotNull()).alias("good"), F.count_distinct(first).alias("firsts"))


@query("q_event_windows", "extension 2.13", """
    SELECT time_bucket(INTERVAL 1 DAY, ts) window_start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    return streams.event_windows(read(spark, d, "events"), "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("q_sessions", "extension 2.13", """
    WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END s FROM events), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM a)
    SELECT user_id, min(ts) session_start, count(*) n FROM b GROUP BY user_id, g""")
def sessions(spark, d):
    return streams.sessions(read(spark, d, "events"), "6 hours").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
