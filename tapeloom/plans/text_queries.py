"""Queries over transcripts: features, cleaning, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.functions import vocab
from tapeloom.functions.names import name_key
from tapeloom.operators import profile, quality
from tapeloom.plans import dialect as q
from tapeloom.plans.registry import query
from tapeloom.plans.tables import read


@query("q_transcript_features", "ST-1 ST-4 ST-5 ST-6 ST-7", f"""
    WITH t AS (SELECT utterance_id, text, {q.norm('text')} n FROM heldout), w AS (SELECT *, {q.toks('n')} w FROM t)
    SELECT utterance_id, n transcript_normalized, len({q.toks("coalesce(text, '')")}) word_count, length(coalesce(text, '')) character_count,
        {q.hits('w', vocab.NUMERALS)} numeric_token_count, {q.hits('w', vocab.VERBS)} command_verb_count, {q.runs('w')} callsign_like_count FROM w""")
def transcript_features(spark, d):
    return read(spark, d, "heldout").select("utterance_id", *tx.features(F.col("text")))


@query("q_digits_to_words", "ST-2 ST-3", rf"""
    WITH a AS (SELECT doc_id, coalesce(text, '') t FROM documents),
    p AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([0-9])\.([0-9])', E'\\1\x01decimal\x01\\2', 'g'), '([0-9])\.([0-9])', E'\\1\x01decimal\x01\\2', 'g') t FROM a),
    r AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([0-9])-([0-9])', E'\\1\x01dash\x01\\2', 'g'), '([0-9])-([0-9])', E'\\1\x01dash\x01\\2', 'g') t FROM p),
    s AS (SELECT doc_id, {"".join("replace(" for _ in range(10))}t{"".join(f", '{d}', E'\\x02{vocab.SPOKEN[d]}\\x03')" for d in "0123456789")} t FROM r),
    x AS (SELECT doc_id, regexp_replace(regexp_replace(t, E'\x03\x02|\x03\x01|\x01\x02', ' ', 'g'), E'[\x01\x02\x03]', '', 'g') t FROM s)
    SELECT doc_id, md5({q.norm('t')}) spoken FROM x""")
def digits_to_words(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.scoring_form(F.col("text"))).alias("spoken"))


@query("q_trainable", "ST-8 PF13 XO7", f"""
    WITH t AS (SELECT utterance_id, {q.norm('text')} n FROM gold), g AS (SELECT *, {q.ungreeted('n')} s FROM t)
    SELECT utterance_id, s stripped, len({q.toks('n')}) >= 2 AND s <> '' trainable FROM g""")
def trainable(spark, d):
    n = tx.normalize(F.col("text"))
    return read(spark, d, "gold").select("utterance_id", tx.strip_greetings(n).alias("stripped"), tx.trainable(n).alias("trainable"))


@query("q_repeated_transcripts", "AG4 AG5 WN2 WN3", f"""
    WITH t AS (SELECT {q.key('dataset_source')} source, source_id, {q.norm('text')} n FROM heldout),
    c AS (SELECT source, count(*) OVER (PARTITION BY n) by_text, count(*) OVER (PARTITION BY n, source_id) by_both FROM t)
    SELECT source, count(*) n, count_if(by_text > 1 AND NOT by_both > 1) repeated, max(by_text) largest FROM c GROUP BY source""")
def repeated_transcripts(spark, d):
    t = read(spark, d, "heldout").select(name_key(F.col("dataset_source")).alias("source"), "source_id", tx.normalize(F.col("text")).alias("n"))
    # counts of texts come from counts of (text, recording), so no task holds all rows of one text
    both = t.groupBy("source", "n", "source_id").agg(F.count("*").alias("c"))
    per = both.groupBy("n", "source_id").agg(F.sum("c").alias("by_both"), F.collect_list(F.struct("source", "c")).alias("s"))
    text = per.groupBy("n").agg(F.sum("by_both").alias("by_text"))
    x = per.join(text, "n").select("by_text", "by_both", F.explode("s").alias("s"))
    return x.groupBy(F.col("s.source").alias("source")).agg(F.sum("s.c").alias("n"), F.coalesce(F.sum(F.when((F.col("by_text") > 1) & ~(F.col("by_both") > 1), F.col("s.c"))), F.lit(0)).alias("repeated"), F.max("by_text").alias("largest"))


_AUDIO = f"""
    WITH u AS (SELECT id, file audio_path, ground_truth transcript, duration_s d, source audio_checksum, {q.norm('ground_truth')} n FROM samples),
    s AS (SELECT *, CASE WHEN audio_path IS NULL OR trim(audio_path) = '' THEN 'missing_audio' WHEN transcript IS NULL OR trim(transcript) = '' THEN 'missing_transcript' WHEN d IS NULL OR isnan(d) OR d <= 0 THEN 'zero_or_negative_duration' END st FROM u),
    r AS (SELECT *, CASE WHEN st IS NULL THEN row_number() OVER (PARTITION BY st IS NULL, n, audio_checksum ORDER BY id) END rn FROM s),
    f AS (SELECT *, CASE WHEN rn > 1 THEN 'duplicate_row' ELSE st END stage FROM r),
    l AS (SELECT *, count_if(stage IS NULL) OVER (PARTITION BY st IS NULL, n) c FROM f)
"""


def _cleaned(spark, d):
    s = read(spark, d, "samples").select("id", F.col("file").alias("audio_path"), F.lit(None).cast("string").alias("audio_decode_error"), F.col("ground_truth").alias("transcript"), F.col("duration_s").alias("duration_sec"), F.col("source").alias("audio_checksum"), tx.normalize(F.col("ground_truth")).alias("transcript_normalized"))
    return quality.clean(s, ["id"])


@query("q_quality_clean", "AG3 AG4 AG5 PF5 PF6 PF7 PF8 WN1", _AUDIO + "SELECT id, c > 1 is_repeated_transcript, c repeated_transcript_count FROM l WHERE stage IS NULL")
def quality_clean(spark, d):
    return _cleaned(spark, d).clean.select("id", "is_repeated_transcript", "repeated_transcript_count")


@query("q_quality_dropped", "AG6 SK1", _AUDIO + "SELECT id, stage dropped_by FROM l WHERE stage IS NOT NULL")
def quality_dropped(spark, d):
    return _cleaned(spark, d).dropped.select("id", "dropped_by")


@query("q_quality_log", "AG6", _AUDIO + """
    , k AS (SELECT unnest(['missing_audio', 'missing_transcript', 'zero_or_negative_duration', 'corrupt_audio', 'duplicate_row', 'repeated_transcript']) stage, unnest(range(1, 7)) step),
    n AS (SELECT k.stage, CAST(step AS INTEGER) step, (SELECT count(*) FROM l WHERE l.stage = k.stage) removed, (SELECT count(*) FROM l) total FROM k),
    o AS (SELECT *, total - sum(removed) OVER (ORDER BY step) AS rows_out FROM n)
    SELECT step, stage, CAST(rows_out + removed AS BIGINT) rows_in, CASE WHEN stage = 'repeated_transcript' THEN (SELECT count(*) FROM l WHERE stage IS NULL AND c > 1) ELSE removed END rows_flagged, removed rows_removed, CAST(rows_out AS BIGINT) rows_out FROM o""")
def quality_log(spark, d):
    return _cleaned(spark, d).log.select("step", "stage", "rows_in", "rows_flagged", "rows_removed", "rows_out")


@query("q_dedup_keep_first", "AG7 SR7", f"""
    SELECT utterance_id FROM (SELECT utterance_id, row_number() OVER (PARTITION BY {q.norm('text')} ORDER BY utterance_id) r FROM gold) WHERE r = 1""")
def dedup_keep_first(spark, d):
    # the first of each text as a minimum, which is pre-aggregated
    return read(spark, d, "gold").groupBy(tx.normalize(F.col("text")).alias("n")).agg(F.min("utterance_id").alias("utterance_id")).select("utterance_id")


@query("q_validation_report", "AG1 AG2 WN4", f"""
    WITH c AS (SELECT {q.key('dataset_split')} dataset_split, {q.key('dataset_source')} dataset_source, count(*) row_count FROM heldout GROUP BY 1, 2)
    SELECT *, round_even(100 * row_count / sum(row_count) OVER (PARTITION BY dataset_split), 1) pct FROM c""")
def validation_report(spark, d):
    h = read(spark, d, "heldout").select(name_key(F.col("dataset_split")).alias("dataset_split"), name_key(F.col("dataset_source")).alias("dataset_source"))
    return profile.shares(h, ["dataset_split", "dataset_source"], ["dataset_split"])


@query("q_describe_duration", "AG8 AG9", """
    SELECT source, count(duration_s) n, round(avg(duration_s), 6) mean, round(stddev_samp(duration_s), 6) std, min(duration_s) "min", round(quantile_cont(duration_s, 0.25), 6) q25,
        round(quantile_cont(duration_s, 0.5), 6) q50, round(quantile_cont(duration_s, 0.75), 6) q75, max(duration_s) "max" FROM samples GROUP BY source""")
def describe_duration(spark, d):
    return profile.describe(read(spark, d, "samples"), ["source"], "duration_s")


@query("q_hours_share", "AG9", """
    SELECT source, count(*) n, round(sum(CASE WHEN duration_s > 0 THEN duration_s END) / 3600, 6) AS "hours", round(100 * count(*) / (SELECT count(*) FROM samples), 6) pct FROM samples GROUP BY source""")
def hours_share(spark, d):
    s = read(spark, d, "samples")
    return s.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("duration_s") > 0, F.col("duration_s"))) / 3600, 6).alias("hours")).join(F.broadcast(s.agg(F.count("*").alias("_t")))).select("source", "n", "hours", F.round(100 * F.col("n") / F.col("_t"), 6).alias("pct"))


@query("q_value_counts", "AG10", "SELECT event_type AS value, count(*) n FROM events GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(read(spark, d, "events"), "event_type")


@query("q_distinct_counts", "AG11", "SELECT count(DISTINCT user_id) users, count(DISTINCT event_type) types, (SELECT count(DISTINCT source_id) FROM heldout) recordings FROM events")
def distinct_counts(spark, d):
    e = read(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))
    return e.join(F.broadcast(read(spark, d, "heldout").agg(F.count_distinct("source_id").alias("recordings"))))


@query("q_vocab_richness", "AG12", f"""
    WITH t AS (SELECT {q.key('dataset_source')} source, unnest({q.toks(q.norm('text'))}) w FROM gold)
    SELECT source, count(*) tokens, count(DISTINCT w) types, round(count(DISTINCT w) / count(*), 9) ttr FROM t GROUP BY source""")
def vocab_richness(spark, d):
    g = read(spark, d, "gold").select(name_key(F.col("dataset_source")).alias("source"), tx.tokens(tx.normalize(F.col("text"))).alias("t"))
    return profile.vocabulary(g, ["source"], F.col("t"))


@query("q_top_words", "AG13", f"""
    WITH t AS (SELECT {q.key('dataset_source')} source, unnest({q.toks(q.norm('text'))}) token FROM gold),
    c AS (SELECT source, token, count(*) n FROM t WHERE NOT list_contains({q.words(vocab.NUMERALS)}, token) GROUP BY 1, 2)
    SELECT source, token, n, CAST(r AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) r FROM c) WHERE r <= 15""")
def top_words(spark, d):
    g = read(spark, d, "gold").select(name_key(F.col("dataset_source")).alias("source"), tx.tokens(tx.normalize(F.col("text"))).alias("t"))
    return profile.top_words(g, ["source"], F.col("t"), vocab.NUMERALS, 15)


_NULLS = ["utterance_id", "text", "dataset_split", "selection_reason", "blind", "source_id", "speaker_id", "recorded_at", "ingested_at"]


@query("q_null_rates", "AG14 AG15", " UNION ALL ".join(f"""
    SELECT {q.key('dataset_source')} source, count(*) rows, '{c}' AS "column", count_if({c} IS NULL) nulls, round(count_if({c} IS NULL) / count(*), 9) null_rate FROM heldout GROUP BY 1""" for c in _NULLS))
def null_rates(spark, d):
    return profile.null_rates(read(spark, d, "heldout").withColumn("source", name_key(F.col("dataset_source"))), ["source"], _NULLS)


@query("q_zero_share", "AG16 AG17", f"""
    WITH t AS (SELECT {q.key('dataset_source')} source, {q.toks(q.norm('text'))} w FROM heldout), c AS (SELECT source, {q.runs('w')} c, {q.hits('w', vocab.NUMERALS)} n FROM t)
    SELECT source, round(avg(CASE WHEN c = 0 THEN 1.0 ELSE 0 END), 9) no_callsign, round(avg(n), 9) numerals_mean, round(stddev_samp(n), 6) numerals_std FROM c GROUP BY source""")
def zero_share(spark, d):
    f = read(spark, d, "heldout").select(name_key(F.col("dataset_source")).alias("source"), *tx.features(F.col("text")))
    return f.groupBy("source").agg(F.round(F.avg((F.col("callsign_like_count") == 0).cast("double")), 9).alias("no_callsign"), F.round(F.avg("numeric_token_count"), 9).alias("numerals_mean"), F.round(F.stddev_samp("numeric_token_count"), 6).alias("numerals_std"))


@query("q_time_range", "AG18 PF21", f"""
    SELECT {q.key('dataset_source')} source, count(recorded_at) n, CAST(min(try_cast(recorded_at AS TIMESTAMP)) AS DATE) AS "first", CAST(max(try_cast(recorded_at AS TIMESTAMP)) AS DATE) AS "last",
        CAST(datediff('day', CAST(min(try_cast(recorded_at AS TIMESTAMP)) AS DATE), CAST(max(try_cast(recorded_at AS TIMESTAMP)) AS DATE)) AS INTEGER) AS "days" FROM heldout GROUP BY 1""")
def time_range(spark, d):
    at = F.to_date(F.try_to_timestamp("recorded_at"))
    g = read(spark, d, "heldout").groupBy(name_key(F.col("dataset_source")).alias("source")).agg(F.count("recorded_at").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return g.withColumn("days", F.datediff("last", "first"))


@query("q_split_pivot", "AG19", f"""
    WITH c AS (SELECT {q.key('dataset_source')} source, count_if({q.key('dataset_split')} = 'train') train, count_if({q.key('dataset_split')} = 'validation') validation, count_if({q.key('dataset_split')} = 'test') test, count(*) total FROM heldout GROUP BY 1)
    SELECT *, round(100 * train / total, 6) train_pct, round(100 * validation / total, 6) validation_pct, round(100 * test / total, 6) test_pct FROM c""")
def split_pivot(spark, d):
    h = read(spark, d, "heldout").select(name_key(F.col("dataset_source")).alias("source"), name_key(F.col("dataset_split")).alias("split"))
    splits = ("train", "validation", "test")
    p = h.groupBy("source").agg(*(F.count_if(F.col("split") == x).alias(x) for x in splits), F.count("*").alias("total"))
    return p.select("*", *(F.round(100 * F.col(x) / F.col("total"), 6).alias(f"{x}_pct") for x in splits))


@query("q_label_by_source", "AG20 AG35", f"""
    WITH l AS (SELECT unnest({q.words(vocab.LABELS)}) label), s AS (SELECT DISTINCT {q.key('source')} source FROM samples),
    e AS (SELECT {q.key('source')} source, upper({q.key('x.label')}) label FROM (SELECT source, unnest(entities) x FROM samples))
    SELECT l.label, s.source, count(e.label) n FROM l CROSS JOIN s LEFT JOIN e ON l.label = e.label AND s.source IS NOT DISTINCT FROM e.source GROUP BY 1, 2""")
def label_by_source(spark, d):
    s = read(spark, d, "samples").select(name_key(F.col("source")).alias("source"), "entities")
    e = s.select("source", F.explode("entities.label").alias("l")).select("source", F.upper(name_key(F.col("l"))).alias("label"))
    return profile.crosstab(e, s.select("source").distinct(), vocab.LABELS, "label", "source")


@query("q_spearman", "AG24 WN6", """
    WITH s AS (SELECT source, duration_s a, length(ground_truth) b FROM samples WHERE duration_s IS NOT NULL AND ground_truth IS NOT NULL),
    r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY a) + (count(*) OVER (PARTITION BY source, a) - 1) / 2 ra, rank() OVER (PARTITION BY source ORDER BY b) + (count(*) OVER (PARTITION BY source, b) - 1) / 2 rb FROM s)
    SELECT source, count(*) n, round(corr(ra, rb), 6) rho FROM r GROUP BY source""")
def spearman(spark, d):
    return profile.spearman(read(spark, d, "samples").withColumn("size", F.length("ground_truth")), ["source"], "duration_s", "size")


@query("q_correlations", "AG23", " UNION ALL ".join(f"SELECT source, '{a}' a, '{b}' b, round(corr({x}, {y}), 6) r FROM samples GROUP BY source" for (a, x), (b, y) in [(("duration_s", "duration_s"), ("size", "length(ground_truth)")), (("duration_s", "duration_s"), ("spans", "len(entities)")), (("size", "length(ground_truth)"), ("spans", "len(entities)"))]))
def correlations(spark, d):
    s = read(spark, d, "samples").withColumns({"size": F.length("ground_truth").cast("double"), "spans": F.size("entities").cast("double")}).withColumn("spans", F.when(F.col("entities").isNotNull(), F.col("spans")))
    return profile.correlations(s, ["source"], ["duration_s", "size", "spans"])


@query("q_tails", "AG50 NU20", """
    WITH m AS (SELECT source, avg(duration_s) m, stddev_samp(duration_s) s FROM samples GROUP BY source)
    SELECT source, round(any_value(m), 6) mean, round(any_value(s), 6) std, round(median(duration_s), 6) median, coalesce(count_if(abs((duration_s - m) / s) > 2), 0) beyond_2, coalesce(count_if(abs((duration_s - m) / s) > 3), 0) beyond_3
    FROM samples JOIN m USING (source) GROUP BY source""")
def tails(spark, d):
    return profile.tails(read(spark, d, "samples"), ["source"], "duration_s")


@query("q_top_rows", "SL1 SL2 SL3 WN5", """
    WITH t AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) r, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) s FROM documents)
    SELECT lang, doc_id, n_chars, r <= 10 longest FROM t WHERE r <= 10 OR s <= 5""")
def top_rows(spark, d):
    t = read(spark, d, "documents").selectExpr("lang", "doc_id", "n_chars")
    # two ranks with limits, each cut down before its shuffle
    a = t.selectExpr("*", "row_number() over (partition by lang order by n_chars desc, doc_id) r").where("r <= 10").drop("r").withColumn("longest", F.lit(True))
    b = t.selectExpr("*", "row_number() over (partition by lang order by n_chars, doc_id) r").where("r <= 5").drop("r").withColumn("longest", F.lit(False))
    return a.unionByName(b).groupBy("lang", "doc_id", "n_chars").agg(F.max("longest").alias("longest"))


@query("q_near_median", "SL4", """
    SELECT doc_id, n_chars FROM documents, (SELECT median(n_chars) m FROM documents) ORDER BY abs(n_chars - m), doc_id LIMIT 20""")
def near_median(spark, d):
    t = read(spark, d, "documents")
    return t.join(F.broadcast(t.agg(F.median("n_chars").alias("m")))).orderBy(F.abs(F.col("n_chars") - F.col("m")), "doc_id").limit(20).select("doc_id", "n_chars")


@query("q_duplicate_keys", "AG49", f"""
    SELECT 'text' AS key, CAST(coalesce(sum(n), 0) AS BIGINT) rows FROM (SELECT count(*) n FROM gold GROUP BY {q.norm('text')}) WHERE n > 1
    UNION ALL SELECT 'text and source', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) n FROM gold GROUP BY {q.norm('text')}, dataset_source) WHERE n > 1
    UNION ALL SELECT 'id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) n FROM gold GROUP BY utterance_id) WHERE n > 1""")
def duplicate_keys(spark, d):
    return profile.duplicates(read(spark, d, "gold").withColumn("n", tx.normalize(F.col("text"))).select("n", "dataset_source", "utterance_id"), {"text": ["n"], "text and source": ["n", "dataset_source"], "id": ["utterance_id"]})


_DICTIONARY = {"doc_id": ("bigint", "id"), "text": ("string", ""), "lang": ("string", "language"), "source": ("string", ""), "n_chars": ("bigint", "size in characters"), "station": ("string", ""), "created_at": ("timestamp", "time of writing")}


@query("q_dictionary", "AG48 SK16 XO22", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", '{k}' AS type, '{why}' AS definition, {f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')" if c == "created_at" else f"CAST(min({c}) AS VARCHAR)"} example, count({c}) non_null, round(100 * (1 - count({c}) / count(*)), 6) missing_pct, count(DISTINCT {c}) "distinct" FROM documents""" for c, (k, why) in _DICTIONARY.items()))
def dictionary(spark, d):
    return profile.dictionary(read(spark, d, "documents"), {c: why for c, (_, why) in _DICTIONARY.items()})


@query("q_flow", "AG47 SO3", f"""
    SELECT 'raw' AS step, count(*) n FROM gold UNION ALL SELECT 'worded', count(*) FROM gold WHERE {q.norm('text')} <> '' UNION ALL SELECT 'distinct', count(DISTINCT {q.norm('text')}) FROM gold WHERE {q.norm('text')} <> ''""")
def flow(spark, d):
    n = read(spark, d, "gold").select(tx.normalize(F.col("text")).alias("n"))
    per = n.groupBy("n").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("raw"), F.coalesce(F.sum(F.when(F.col("n") != "", F.col("c"))), F.lit(0)).alias("worded"), F.count_if(F.col("n") != "").alias("distinct"))
    return per.select(F.explode(F.array(*(F.struct(F.lit(c).alias("step"), F.col(c).alias("n")) for c in ("raw", "worded", "distinct")))).alias("x")).select("x.*")


@query("q_formats", "ST-9 ST-10 ST-20 ST-21 ST-22 ST-23 ST-24 ST-25 ST-28 ST-29 ST-30", r"""
    SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars / 1.0) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0) ELSE printf('%.1f MB', n_chars / 1048576.0) END size,
        md5(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) squeezed, string_split(text, E'\n')[1] first_line,
        CASE WHEN length(replace(text, E'\n', ' / ')) > 60 THEN substring(replace(text, E'\n', ' / '), 1, 59) || '…' ELSE replace(text, E'\n', ' / ') END shown,
        (doc_id % 60) * 60 + doc_id % 50 + 0.0 AS "seconds", 'store' bucket, 'a/' || doc_id || '.bin' AS key, 4 threads, 'rec_' || doc_id session,
        CASE WHEN doc_id % 12 + 1 <= 12 THEN strftime(make_date(2020, CAST(doc_id % 12 + 1 AS INTEGER), 5), '%Y-%m-%d') || 'T09:11:12' END recorded_at FROM documents""")
def formats(spark, d):
    t, i = F.col("text"), F.col("doc_id")
    uri, conf = tx.store_uri(F.concat(F.lit("s3://store/a/"), i, F.lit(".bin"))), tx.config_parts(F.concat(F.lit("m/"), i, F.lit("/cpu-4t")))
    name = F.format_string("clips/rec_%d_2020%02d05_091112.wav", i, (i % 12 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", tx.human_size(F.col("n_chars")).alias("size"), F.md5(tx.squeeze(t)).alias("squeezed"), tx.first_line(t).alias("first_line"), tx.shown(t).alias("shown"), tx.clock_seconds(F.format_string("%d:%02d", i % 60, i % 50)).alias("seconds"), uri["bucket"].alias("bucket"), uri["key"].alias("key"), conf["threads"].alias("threads"), tx.session_key(F.regexp_replace(name, "_2020.*", "_7.wav")).alias("session"), tx.recorded_at(name).alias("recorded_at"))
