"""Queries over splits, samples, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.functions.names import name_key
from tapeloom.operators import curation, quality, sampling
from tapeloom.plans import dialect as q
from tapeloom.plans.registry import query
from tapeloom.plans.tables import read
from tapeloom.sources import readers, writers


@query("q_group_split", "WN7", f"""
    WITH g AS (SELECT CASE WHEN source_id IS NULL THEN 'none' ELSE source_id END k, count(*) n FROM heldout GROUP BY 1),
    o AS (SELECT k, n, md5('7:' || k) h, (SELECT count(*) FROM heldout) total FROM g),
    x AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ex FROM o),
    t AS (SELECT *, ex < round_even(total * 0.1, 0) is_test FROM x), nt AS (SELECT sum(n) nt FROM t WHERE is_test),
    s AS (SELECT k, CASE WHEN is_test THEN 'test' WHEN ex - nt < round_even(total * 0.15, 0) THEN 'validation' ELSE 'train' END dataset_split FROM t, nt)
    SELECT utterance_id, s.dataset_split FROM heldout JOIN s ON k = CASE WHEN source_id IS NULL THEN 'none' ELSE source_id END""")
def group_split(spark, d):
    h = read(spark, d, "heldout").select("utterance_id", F.coalesce("source_id", F.lit("none")).alias("rec"))
    return sampling.group_split(h, "rec", 7, 0.1, 0.15).select("utterance_id", "dataset_split")


_SRC = q.key("dataset_source")


@query("q_equal_sample", "SL7 XO13", f"""
    WITH g AS (SELECT utterance_id, {_SRC} s FROM gold), k AS (SELECT s, count(*) c, row_number() OVER (ORDER BY s) - 1 i, (SELECT count(DISTINCT s) FROM g) n FROM g GROUP BY s),
    r AS (SELECT utterance_id, s, row_number() OVER (PARTITION BY s ORDER BY md5('3:' || utterance_id), utterance_id) r FROM g)
    SELECT utterance_id, s source FROM r JOIN k USING (s) WHERE r <= 303 // n + CASE WHEN i < 303 % n THEN 1 ELSE 0 END""")
def equal_sample(spark, d):
    return sampling.equal_sample(read(spark, d, "gold").select("utterance_id", name_key(F.col("dataset_source")).alias("source")), "source", "utterance_id", 303, 3)


@query("q_proportional_sample", "SL8", f"""
    WITH r AS (SELECT utterance_id, {_SRC} source, row_number() OVER (PARTITION BY {_SRC} ORDER BY md5('3:' || utterance_id), utterance_id) r, count(*) OVER (PARTITION BY {_SRC}) n FROM gold)
    SELECT utterance_id, source FROM r WHERE r <= greatest(1, round_even(n * 0.05, 0))""")
def proportional_sample(spark, d):
    return sampling.proportional_sample(read(spark, d, "gold").select("utterance_id", name_key(F.col("dataset_source")).alias("source")), "source", "utterance_id", 0.05, 3)


@query("q_targeted_sample", "SL9 SL10 SL12 SL18 PF10 PF11 PF12 JN6 SO9", f"""
    WITH taken AS (SELECT DISTINCT utterance_id FROM heldout_queue), p AS (SELECT utterance_id, min({q.norm('text')}) t, min({_SRC}) s FROM heldout WHERE utterance_id NOT IN (SELECT utterance_id FROM taken) GROUP BY 1),
    a AS (SELECT utterance_id, 'targeted:SQUAWK' r, 0 p FROM p WHERE regexp_matches(t, 'squawk') ORDER BY md5('9-SQUAWK:' || utterance_id), utterance_id LIMIT 40),
    b AS (SELECT utterance_id, 'targeted:RUNWAY' r, 1 p FROM p WHERE regexp_matches(t, 'runway') ORDER BY md5('9-RUNWAY:' || utterance_id), utterance_id LIMIT 40),
    c AS (SELECT utterance_id, 'random' r, 2 p FROM (SELECT utterance_id, row_number() OVER (PARTITION BY s ORDER BY md5('9:' || utterance_id), utterance_id) n FROM p) WHERE n <= 15),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY p) k FROM u)
    SELECT utterance_id, r selection_reason, CAST('0x' || substring(md5('9-blind:' || utterance_id), 1, 4) AS INTEGER) < 16384 blind FROM o WHERE k = 1""")
def targeted_sample(spark, d):
    h = read(spark, d, "heldout").groupBy("utterance_id").agg(F.min(tx.normalize(F.col("text"))).alias("t"), F.min(name_key(F.col("dataset_source"))).alias("s"))
    cues = {"SQUAWK": F.col("t").rlike("squawk"), "RUNWAY": F.col("t").rlike("runway")}
    return sampling.targeted_sample(h, "utterance_id", read(spark, d, "heldout_queue"), cues, 40, "s", 30, 9).select("utterance_id", "selection_reason", "blind")


@query("q_quota_select", "SL11 XO6")
def quota_select(spark, d):
    """Without SQL: the choice is sequential."""
    g = read(spark, d, "gold").select("utterance_id", tx.normalize(F.col("text")).alias("t"))
    labels = ["SQUAWK", "RUNWAY", "HEADING", "WAYPOINT"]
    return sampling.quota_select(g.select("utterance_id", *sampling.label_estimates(F.col("t"), labels)), [("SQUAWK", 1), ("RUNWAY", 3), ("HEADING", 2), ("WAYPOINT", 4)], 25, "utterance_id", 4)


@query("q_quantile_picks", "SL13", """
    WITH r AS (SELECT source, id, duration_s, row_number() OVER (PARTITION BY source ORDER BY duration_s, id) - 1 i, count(*) OVER (PARTITION BY source) n FROM samples WHERE duration_s IS NOT NULL)
    SELECT source, id, q FROM r, (SELECT unnest([0.25, 0.55, 0.9]) q) WHERE i = floor(q * (n - 1))""")
def quantile_picks(spark, d):
    return sampling.quantile_picks(read(spark, d, "samples").select("source", "id", "duration_s"), "source", "duration_s", "id", [0.25, 0.55, 0.9]).select("source", "id", F.col("q").cast("double").alias("q"))


@query("q_first_per_source", "SL14 PF14 PF22", """
    SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) r FROM samples WHERE duration_s BETWEEN 2 AND 12) WHERE r <= 8""")
def first_per_source(spark, d):
    return read(spark, d, "samples").where("duration_s between 2 and 12").selectExpr("source", "id", "row_number() over (partition by source order by id) r").where("r <= 8").select("source", "id")


@query("q_leak_guard", "JN5 PF10 SO8", f"""
    WITH e AS (SELECT DISTINCT {q.norm('text')} t FROM heldout WHERE text IS NOT NULL) SELECT utterance_id FROM gold WHERE text IS NULL OR {q.norm('text')} NOT IN (SELECT t FROM e)""")
def leak_guard(spark, d):
    t = F.when(F.col("text").isNotNull(), tx.normalize(F.col("text"))).alias("t")
    return curation.leak_guard(read(spark, d, "gold").select("utterance_id", t), read(spark, d, "heldout").select(t), "t").select("utterance_id")


@query("q_todo", "JN6 SL5 SL6", """
    SELECT utterance_id FROM (SELECT DISTINCT utterance_id FROM heldout) h WHERE NOT EXISTS (SELECT 1 FROM heldout_queue q WHERE q.utterance_id = h.utterance_id) ORDER BY md5('5:' || utterance_id) LIMIT 256""")
def todo(spark, d):
    ids = read(spark, d, "heldout").select("utterance_id").distinct().join(read(spark, d, "heldout_queue"), "utterance_id", "left_anti")
    return ids.orderBy(sampling.hash_order(F.col("utterance_id"), 5)).limit(256)


@query("q_known_texts", "JN7 XO10", f"SELECT DISTINCT {q.norm('text')} t FROM gold WHERE {q.norm('text')} IN (SELECT {q.norm('ground_truth')} FROM samples)")
def known_texts(spark, d):
    t = read(spark, d, "gold").select(tx.normalize(F.col("text")).alias("t")).distinct()
    return t.join(read(spark, d, "samples").select(tx.normalize(F.col("ground_truth")).alias("t")), "t", "left_semi")


_LATEST = f"SELECT utterance_id, {_SRC} s, row_number() OVER (PARTITION BY utterance_id ORDER BY ingested_at DESC, text) r, {q.norm('text')} t FROM heldout"


@query("q_feature_join", "JN1 JN2 JN3 JN9 JN10 JN11 JN12 AG3", f"""
    WITH h AS ({_LATEST}) SELECT queue_id, q.utterance_id, h.s source, len({q.toks('h.t')}) words FROM heldout_queue q LEFT JOIN h ON q.utterance_id = h.utterance_id AND r = 1""")
def feature_join(spark, d):
    h = read(spark, d, "heldout").groupBy("utterance_id").agg(F.max_by(F.struct(name_key(F.col("dataset_source")).alias("source"), tx.word_count(tx.normalize(F.col("text"))).alias("words")), F.struct("ingested_at")).alias("f"))
    return read(spark, d, "heldout_queue").select("queue_id", "utterance_id").join(h, "utterance_id", "left").select("queue_id", "utterance_id", "f.source", "f.words")


@query("q_text_lookup", "JN4 PF17", f"""
    WITH g AS (SELECT {q.norm('text')} t, min(utterance_id) gold_id, max(len(entities)) spans FROM gold GROUP BY 1 HAVING {q.norm('text')} <> '')
    SELECT id, gold_id, CAST(coalesce(g.spans, len(entities)) AS INTEGER) spans FROM samples LEFT JOIN g ON {q.norm('ground_truth')} = t""")
def text_lookup(spark, d):
    g = read(spark, d, "gold").where(tx.normalize(F.col("text")) != "").groupBy(tx.normalize(F.col("text")).alias("t")).agg(F.min("utterance_id").alias("gold_id"), F.max(F.when(F.col("entities").isNotNull(), F.size("entities"))).alias("spans"))
    s = read(spark, d, "samples").select("id", tx.normalize(F.col("ground_truth")).alias("t"), F.when(F.col("entities").isNotNull(), F.size("entities")).alias("own"))
    return s.join(g, "t", "left").select("id", "gold_id", F.coalesce("spans", "own").alias("spans"))


@query("q_union_align", "SC1 SO1 SO4 PF1 PF2 PF3 PF19 WN13", """
    WITH a AS (SELECT 'gold' dataset_source, dataset_split s, utterance_id id, text t, CAST(NULL AS DOUBLE) duration_s FROM gold UNION ALL SELECT 'samples', split, id, ground_truth, duration_s FROM samples)
    SELECT dataset_source, printf('%s-%s-%06d', dataset_source, s, row_number() OVER (PARTITION BY dataset_source, s ORDER BY id) - 1) utterance_id, id, duration_s FROM a WHERE s IS NOT NULL""")
def union_align(spark, d):
    g = read(spark, d, "gold").where("dataset_split is not null").select(F.col("utterance_id").alias("id"), F.col("dataset_split").alias("original_split"), F.col("text").alias("transcript"))
    s = read(spark, d, "samples").where("split is not null").select("id", F.col("split").alias("original_split"), F.col("ground_truth").alias("transcript"), "duration_s")
    return readers.union_sources({"gold": g, "samples": s}, {}, ["id"]).select("dataset_source", "utterance_id", "id", "duration_s")


@query("q_sample_catalog", "SC16 XO24", """
    SELECT id, coalesce(split, 'test') split, coalesce(note, '') note, coalesce(source, '?') || ' · ' || CASE WHEN duration_s IS NULL THEN '?' ELSE printf('%.1f', floor(duration_s * 10 + 0.5) / 10) END || CASE WHEN coalesce(note, '') <> '' THEN ' s · ' || note ELSE ' s' END AS label FROM samples""")
def sample_catalog(spark, d):
    return readers.sample_catalog(read(spark, d, "samples")).select("id", "split", "note", "label")


@query("q_artifact_plan", "SK12 SO8", """
    WITH r AS (SELECT 'doc/' || doc_id AS key, md5(coalesce(text, '')) h FROM documents WHERE lang IS NOT NULL OR source IS NULL), l AS (SELECT 'doc/' || doc_id AS key, md5(trim(coalesce(text, ''))) h FROM documents WHERE source IS NOT NULL OR lang IS NULL)
    SELECT key, CASE WHEN l.h IS NULL THEN 'new' WHEN r.h IS NULL THEN 'local-only' WHEN l.h = r.h THEN 'unchanged' ELSE 'conflict' END AS action FROM r FULL JOIN l USING (key)""")
def artifact_plan(spark, d):
    """Documents as two inventories: one lacks those without a language, the other those without a source, and holds texts without blanks at their ends; none stands on neither side."""
    t = read(spark, d, "documents").select("lang", "source", F.concat(F.lit("doc/"), "doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("t"))
    remote = t.where("lang is not null or source is null").select("key", F.md5("t").alias("sha256"))
    local = t.where("source is not null or lang is null").select("key", F.md5(F.trim("t")).alias("sha256"))
    return writers.download_plan(remote, local)


@query("q_model_store", "AG56", """
    WITH k AS (SELECT lang task, source model, created_at FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND created_at IS NOT NULL)
    SELECT task, model, list_sort(list_distinct(list(strftime(created_at, '%Y%m')))) runs, max(strftime(created_at, '%Y%m')) latest FROM k GROUP BY 1, 2""")
def model_store(spark, d):
    k = read(spark, d, "documents").where("lang is not null and source is not null and created_at is not null").select(F.concat_ws("/", "lang", "source", F.date_format("created_at", "yyyyMM"), F.lit("w.bin")).alias("key"))
    return writers.model_store(k)


@query("q_oversample", "SO10 NU18", """
    WITH c AS (SELECT label, count(*) n FROM (SELECT unnest(entities).label label FROM samples) GROUP BY 1), b AS (SELECT label, least(4, ceil(3000 / n)) b FROM c WHERE n < 3000),
    r AS (SELECT id, coalesce((SELECT max(b) FROM b WHERE list_contains(list_transform(entities, lambda e: e.label), label)), 1) k FROM samples)
    SELECT id, CAST(unnest(range(1, CAST(greatest(k, 1) AS BIGINT) + 1)) AS INTEGER) copy FROM r""")
def oversample(spark, d):
    s = read(spark, d, "samples").select("id", F.col("entities.label").alias("labels"))
    n = s.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return sampling.oversample(s, F.col("labels"), n, 3000, 4).select("id", "copy")


@query("q_integrity", "PF24", """
    SELECT 'gold' AS part, count(*) n, count(DISTINCT utterance_id) ids FROM gold UNION ALL SELECT 'samples', count(*), count(DISTINCT id) FROM samples""")
def integrity(spark, d):
    g, s = read(spark, d, "gold").select(F.col("utterance_id").alias("id")), read(spark, d, "samples").select("id")
    quality.integrity([g, s], g.unionByName(s), "id")
    one = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    return one(g, "gold").unionByName(one(s, "samples"))


@query("q_relational", "2.5 extension", """
    SELECT n_name, o_orderpriority, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ROLLUP (n_name, o_orderpriority)""")
def relational(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("revenue"))
