"""Curation of labelled text: routing, leakage guard, adjudication, retrieval. SURVEY JN4-JN7, JN13-JN16, AR9, AR10, AR17, AR18, SL16, AG35-AG44, SK4, SR6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import spans as sp
from tapeloom.functions import text as tx
from tapeloom.operators.neighbours import nearest_texts
from tapeloom.operators.sampling import hash_order
from tapeloom.plans.tables import written


def leak_guard(rows: DataFrame, evaluation: DataFrame, text: str = "text") -> DataFrame:
    """JN5, T13, T28: rows whose text is in no evaluation set. A null text is in none. The side is joined by shuffle or broadcast as its size allows."""
    return rows.join(evaluation.where(F.col(text).isNotNull()).select(F.col(text).alias("_e")).distinct(), F.col(text) == F.col("_e"), "left_anti")


def curate(records: DataFrame, evaluation: DataFrame, names: dict[str, str], review_in: list[str]) -> DataFrame:
    """Adds split (exported name), signals and route to records (id, text, split, entities, ok, n_rounds, n_flags).

    Leaked training texts are dropped first, so they give no signals; then a record with signals goes to review if its exported split is in review_in, else it is dropped; the rest is kept.
    """
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("split"))
    lookup = evaluation.where("text is not null").select("text").distinct().withColumn("_leak", F.lit(True))
    r = records.withColumn("split", kind).join(lookup, "text", "left")
    leaked = F.coalesce(F.col("_leak"), F.lit(False)) & (F.col("split") == "train")
    signs = F.when(~leaked, sp.signals("text", "entities", "ok", "n_rounds", "n_flags"))
    r = r.withColumn("signals", F.coalesce(signs, F.array().cast("array<string>")))
    flagged = F.size("signals") > 0
    return r.withColumn("route", F.when(leaked, "leaked").when(flagged & F.col("split").isin(review_in), "review").when(flagged, "flagged").otherwise("kept")).drop("_leak")


def adjudicate(a: DataFrame, b: DataFrame, key: str, seed: int) -> DataFrame:
    """JN13, AR17, AR18, SO7: spans only one annotator has, each with the guideline that explains it or null, and what becomes of its utterance: agreed, resolved or adjudicate with sides in hash order.

    Both have key, text, entities; an id only one of them has raises in the plan.
    """
    key_of = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(sp.ARR)), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    both = a.select(key, "text", key_of("entities").alias("x")).join(b.select(F.col(key).alias("_k"), key_of("entities").alias("y")), F.col(key) == F.col("_k"), "full")
    both = both.withColumn("x", F.when(F.col(key).isNull() | F.col("_k").isNull(), F.raise_error(F.lit("an utterance has one annotator only"))).otherwise(F.col("x")))
    mark = lambda arr, side: F.transform(arr, lambda e: F.struct(F.lit(side).alias("side"), e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    d = both.withColumn("diffs", F.concat(mark(F.array_except("x", "y"), "a"), mark(F.array_except("y", "x"), "b")))

    def why(e):
        said = F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"])
        other = F.when(e["side"] == "a", F.col("y")).otherwise(F.col("x"))
        over = F.exists(other, lambda o: (o["label"] == e["label"]) & (o["start"] < e["end"]) & (e["start"] < o["end"]))
        return F.when(sp.constraint(said, e["label"]).isNotNull(), "breaks-a-rule").when(over, "same-label-overlap").when(tx.hits(tx.tokens(said), sp.vocab.EXTRA_VERBS) > 0, "extra-verb")

    d = d.withColumn("diffs", F.transform("diffs", lambda e: F.struct(e["side"].alias("side"), e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), why(e).alias("rule"))))
    explained = F.forall("diffs", lambda e: e["rule"].isNotNull())
    swap = F.conv(F.substring(hash_order(F.col(key), seed), 1, 1), 16, 10).cast("int") % 2 == 1
    out = F.when(F.size("diffs") == 0, "agreed").when(explained, "resolved").otherwise("adjudicate")
    return d.select(key, "diffs", out.alias("outcome"), F.when(out == "adjudicate", F.when(swap, "b").otherwise("a")).alias("shown_first"))


def retry_loop(pool: DataFrame, key: str, backend: Callable[[DataFrame, int], DataFrame], rounds: int = 3, soft: bool = False) -> DataFrame:
    """SR6, A7, AR15: asks the backend for entities (array<struct<text, label>>) of the pending rows, validates, and asks again only for rows that fail.

    backend(pending, round) gives key and raw (JSON {"entities": [...]}). Unreadable JSON is a hard error. Entities are replaced each round; n_rejected adds up;
    soft errors (missed verbs) ask again but don't make a row bad. Each round's state is written, so a lost executor costs one round at most.
    """
    schema = "struct<entities:array<struct<text:string,label:string>>>"
    state = written(pool.select(key, "text").withColumns({"entities": F.array().cast(sp.ARR), "ok": F.lit(False), "n_rounds": F.lit(0), "n_rejected": F.lit(0), "n_flags": F.lit(0), "again": F.lit(True)}), "annotate")
    for r in range(1, rounds + 1):
        pending = state.where("again")
        said = backend(pending.select(key, "text"), r).select(F.col(key), F.from_json("raw", schema).alias("_j"))
        x = pending.join(said, key, "left")
        given = F.filter(F.coalesce("_j.entities", F.array().cast("array<struct<text:string,label:string>>")), lambda e: e["text"].isNotNull())
        good = F.filter(given, lambda e: e["label"].isin(sp.vocab.LABELS) & sp.constraint(tx.squeeze(F.lower(e["text"])), e["label"], F.col("text")).isNull())
        # the rules are worked out and written before Python aligns what passed them
        x = written(x.select(key, "text", "n_rejected", F.col("_j.entities").isNull().alias("_unread"), F.size(given).alias("_given"), good.alias("_good")), "annotate")
        x = written(x.withColumn("entities", sp.aligned_entities("text", "_good")), "annotate")
        x = x.withColumn("_bad", F.col("_given") - F.size("entities")).withColumn("_hard", F.col("_unread") | (F.col("_bad") > 0))
        x = x.withColumn("_soft", F.size(sp.missed("text", "entities")) if soft else F.lit(0))
        done = x.select(key, "text", "entities", (~F.col("_hard")).alias("ok"), F.lit(r).alias("n_rounds"), (F.col("n_rejected") + F.col("_bad")).alias("n_rejected"), F.col("_soft").alias("n_flags"), ((F.col("_hard") | (F.col("_soft") > 0)) & F.lit(r < rounds)).alias("again"))
        state = written(state.where("not again").unionByName(done), "annotate")
    return state.withColumn("entities", sp.merged_entities("text", "entities")).drop("again")


def nearest(pool: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """SL16, NU21, A16: for each query row the k pool rows with the highest TF-IDF cosine of words and word pairs, never itself; ties by descending key.

    Rows with the same words are one text, whose k + 1 last keys can be an answer. Texts are searched by bounds, see neighbours; a query that shares no term finds nothing.
    """
    words = lambda df: df.groupBy(key).agg(F.array_sort(F.collect_list(F.array_join(tx.tokens(F.col("text")), " "))).alias("t"))
    keys = F.slice(F.sort_array(F.collect_list(key), asc=False), 1, k + 1).alias("keys")
    texts = written(words(pool).groupBy("t").agg(keys, F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "texts")
    rows = words(queries).where(F.col(key).isNotNull())
    asked = written(rows.groupBy("t").agg(F.collect_list(key).alias("queries")).withColumn("id", F.monotonically_increasing_id()), "asked")
    # each text is taken apart once: lambdas work out anew what isn't their own variable
    hashed = lambda t: F.flatten(F.transform(F.transform(t, lambda x: F.filter(F.split(x, " "), lambda w: w != "")), lambda x: F.transform(_terms(x), lambda w: F.xxhash64(w))))
    s = nearest_texts(texts.select("id", "t", "n", F.size("keys").alias("m")), asked.select("id", "t"), hashed, k + 1, pool.count())
    s = s.join(texts.select(F.col("id").alias("p"), F.explode("keys").alias(key)), "p").join(asked.select(F.col("id").alias("q"), F.explode("queries").alias("query")), "q")
    s = s.where(F.col(key) != F.col("query")).select("query", key, F.round("score", 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc(key)))).where(F.col("rank") <= k)


def _terms(t):
    """Words, and pairs of words in a row."""
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)
