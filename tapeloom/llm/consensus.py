"""Problem 6: one label per span from several annotators who disagree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.names import name_key
from tapeloom.operators.skew import lookup_join
from tapeloom.plans.tables import drop_written, read, written

#: The nine labels; the tenth answer is "no entity".
LABELS = ["ALTITUDE", "CALLSIGN", "COMMAND", "FACILITY", "FREQUENCY", "HEADING", "RUNWAY", "SQUAWK", "WAYPOINT"]
NONE = ""
#: Rounds end when no skill moves by more than TOLERANCE, or after ROUNDS (then `converged` is false); so do the steps on difficulty within a round. Standard deviations of the normal priors.
ROUNDS, INNER, TOLERANCE, SD_B, SD_A = 200, 8, 0.005, 1.0, 2.0
#: Up to so many annotators the skills travel with the tasks (8 bytes each); above, they are joined to the answers.
MAX_SENT = 500_000


def answers(queue: DataFrame) -> DataFrame:
    """(utterance_id, span_start, annotator, label) from both sides of the queue, each answer once.

    An annotator who answered for an utterance, also with an empty list, says "no entity" (label '') at every start that others gave there.
    A null list or a letterless or null annotator is no answer; spans without a start or with a label outside LABELS are left out.
    """
    sides = F.array(F.struct(F.col("opta").alias("opt"), F.col("srca").alias("src")), F.struct(F.col("optb").alias("opt"), F.col("srcb").alias("src")))
    s = queue.where("utterance_id is not null").select("utterance_id", F.explode(sides).alias("s")).select("utterance_id", name_key(F.col("s.src")).alias("annotator"), F.col("s.opt").alias("opt")).where("annotator <> '' and opt is not null")
    spans = F.array_distinct(F.filter(F.transform("opt", lambda e: F.struct(F.get(e["span"], F.lit(0)).cast("bigint").alias("span_start"), F.upper(name_key(e["label"])).alias("label"))), lambda e: e["span_start"].isNotNull() & e["label"].isin(LABELS)))
    # an utterance's answers meet in one group: its annotators are few and each answer is a short list
    per = s.select("utterance_id", F.struct("annotator", spans.alias("spans")).alias("a")).distinct().groupBy("utterance_id").agg(F.collect_list("a").alias("all"))
    starts = F.array_distinct(F.flatten(F.transform("all", lambda a: F.transform(a["spans"], lambda e: e["span_start"]))))
    at = per.select("utterance_id", "all", F.explode(starts).alias("span_start")).select("utterance_id", "span_start", F.explode("all").alias("a"))
    here = F.transform(F.filter("a.spans", lambda e: e["span_start"] == F.col("span_start")), lambda e: e["label"])
    said = at.select("utterance_id", "span_start", F.col("a.annotator").alias("annotator"), here.alias("here"))
    # someone who answered twice and gave a span there once doesn't also say "no entity"
    given = said.groupBy("utterance_id", "span_start", "annotator").agg(F.array_distinct(F.flatten(F.collect_list("here"))).alias("g"))
    return given.select("utterance_id", "span_start", "annotator", F.explode(F.when(F.size("g") > 0, F.col("g")).otherwise(F.array(F.lit(NONE)))).alias("label"))


def _infer(item: np.ndarray, label: np.ndarray, alpha: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior n x K, difficulty parameter b of each item, gradient and curvature of each answer's skill) given the answers' skills.

    An answer is right with the chance sigmoid(skill * exp(b)), else any other label alike. Difficulty climbs from its prior by steps of its gradient over its curvature, an E-step before each, until it rests.
    """
    k = len(LABELS) + 1
    b = np.zeros(n)
    flat = item * k + label

    def e_step() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scale = np.exp(b)[item]
        p = np.clip(1 / (1 + np.exp(-np.clip(alpha * scale, -30, 30))), 1e-6, 1 - 1e-6)
        post = np.bincount(flat, np.log(p * (k - 1) / (1 - p)), n * k).reshape(n, k)
        post = np.exp(post - post.max(axis=1)[:, None])
        return post / post.sum(axis=1)[:, None], p, scale

    for _ in range(INNER):
        post, p, scale = e_step()
        slope = alpha * scale
        grad = np.bincount(item, (post.reshape(-1)[flat] - p) * slope, n) - b / SD_B**2
        curve = np.bincount(item, p * (1 - p) * slope**2, n) + 1 / SD_B**2
        step = np.clip(grad / curve, -1, 1)
        b = np.clip(b + step, -3, 3)
        if not n or np.abs(step).max() < TOLERANCE:
            break
    post, p, scale = e_step()
    return post, b, (post.reshape(-1)[flat] - p) * scale, p * (1 - p) * scale**2


def _read(batch: pa.RecordBatch, skills: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, label, skill, annotator) of each answer of a batch."""
    given = batch.column("answers")
    item = np.repeat(np.arange(batch.num_rows), given.value_lengths().to_numpy(zero_copy_only=False))
    flat = given.flatten()
    who = flat.field("who").to_numpy(zero_copy_only=False)
    return item, flat.field("code").to_numpy(zero_copy_only=False).astype(np.int64), skills[who] if skills is not None else flat.field("skill").to_numpy(zero_copy_only=False), who


def _gradients(skills: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, label, alpha, who = _read(b, skills)
            _, _, g, h = _infer(item, label, alpha, b.num_rows)
            some, row = np.unique(who, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.bincount(row, g, len(some))), pa.array(np.bincount(row, h, len(some)))], ["who", "g", "h"])

    return run


def _posteriors(skills: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, label, alpha, _ = _read(b, skills)
            post, diff, _, _ = _infer(item, label, alpha, b.num_rows)
            # rounded, so that ties go to the first label by name whatever the order of the answers; "no entity" is the last
            top = np.round(post, 9).argmax(axis=1)
            names = np.array([*LABELS, NONE], object)
            yield pa.RecordBatch.from_arrays([b.column("utterance_id"), b.column("span_start"), pa.array(names[top], pa.string()), pa.array(np.round(post.max(axis=1), 6) if b.num_rows else np.zeros(0)), pa.array(np.round(np.exp(-diff), 6)), pa.array(np.bincount(item, minlength=b.num_rows))], ["utterance_id", "span_start", "label", "posterior", "difficulty", "answers"])

    return run


def latent_consensus(given: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(consensus: utterance_id, span_start, label, posterior, difficulty, answers; annotators: annotator, skill, reliability, answers, agreement, converged; agreement: one row).

    Gradient expectation-maximisation for annotators' skills and items' difficulties together. Items' answers are grouped once, with annotators as numbers, and written; each round is one pass
    that gives every annotator's summed gradient and curvature, and one step of their quotient on the skills (normal prior around 1). Rounds end when the skills rest; annotators has `converged`.
    Difficulty is found anew from the skills in each pass, so nothing else is kept.
    agreement holds Krippendorff's alpha for names (chance-corrected), the observed and the expected disagreement, and the numbers of items and answers.
    A single answer is its own consensus; ties go to the first label by name, "no entity" (label '') last. An empty table gives empty tables and an alpha of null.
    """
    spark = given.sparkSession
    code = F.create_map(*(x for i, c in enumerate([*LABELS, NONE]) for x in (F.lit(c), F.lit(i))))
    found = given.groupBy("annotator").agg(F.count("*").alias("answers"))
    n = found.agg(F.count("*")).first()[0]
    sent, rest = n <= MAX_SENT, None
    found = written(found.withColumn("who", F.xxhash64("annotator") if not sent else F.row_number().over(Window.orderBy("annotator")) - 1).select("annotator", F.col("who").cast("bigint").alias("who"), "answers"), "annotators")
    coded = lookup_join(given.select("utterance_id", "span_start", "annotator", code[F.col("label")].alias("code")), found.withColumn("n", F.col("answers")).select("annotator", "who", "n"), ["annotator"], "n")
    items = written(coded.groupBy("utterance_id", "span_start").agg(F.sort_array(F.collect_list(F.struct("who", "code"))).alias("answers")), "items")
    out = "utterance_id string, span_start bigint, label string, posterior double, difficulty double, answers bigint"
    sums = lambda df, skills: df.mapInArrow(_gradients(skills), "who bigint, g double, h double").groupBy("who").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    if sent:
        skills = np.ones(n)
        for _ in range(ROUNDS if n else 0):
            g = sums(items, skills).toArrow()
            who, step = g["who"].to_numpy(), np.zeros(n)
            step[who] = np.clip((g["g"].to_numpy() - (skills[who] - 1) / SD_A**2) / (g["h"].to_numpy() + 1 / SD_A**2), -1, 1)
            skills = np.clip(skills + step, -8, 8)
            rest = float(np.abs(step).max())
            if rest < TOLERANCE:
                break
        consensus = items.mapInArrow(_posteriors(skills), out)
        start = spark.createDataFrame(pa.table({"who": pa.array(np.arange(n)), "skill": pa.array(skills)})) if n else spark.createDataFrame([], "who bigint, skill double")
    else:
        flat = items.select("utterance_id", "span_start", F.explode("answers").alias("a")).select("utterance_id", "span_start", "a.*")
        start = written(found.select("who", F.lit(1.0).alias("skill")), "skills")
        regroup = lambda: lookup_join(flat, start.join(found.select("who", "answers"), "who"), ["who"], "answers").groupBy("utterance_id", "span_start").agg(F.sort_array(F.collect_list(F.struct("who", "code", "skill"))).alias("answers"))
        for _ in range(ROUNDS):
            step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("g") - (F.col("skill") - 1) / SD_A**2) / (F.col("h") + 1 / SD_A**2)))
            moved, before = written(start.join(sums(regroup(), None), "who").select("who", F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("skill") + step)).alias("skill"), step.alias("step")), "skills"), start
            start = moved.select("who", "skill")
            rest = moved.agg(F.max(F.abs("step"))).first()[0]
            drop_written(before)
            if rest < TOLERANCE:
                break
        consensus = regroup().mapInArrow(_posteriors(None), out)
    converged = rest is None or rest < TOLERANCE
    start = start.join(found.select("annotator", "who"), "who")
    counted = given.join(consensus.select("utterance_id", "span_start", F.col("label").alias("best")), ["utterance_id", "span_start"]).groupBy("annotator").agg(F.count("*").alias("answers"), F.round(F.avg((F.col("label") == F.col("best")).cast("double")), 6).alias("agreement"))
    annotators = start.join(counted, "annotator").select("annotator", F.round("skill", 6).alias("skill"), F.round(1 / (1 + F.exp(-F.col("skill"))), 6).alias("reliability"), "answers", "agreement", F.lit(converged).alias("converged"))
    return consensus, annotators, _alpha(given)


def _alpha(given: DataFrame) -> DataFrame:
    """Krippendorff's alpha from the counts of labels within items with two or more answers."""
    n = given.groupBy("utterance_id", "span_start", "label").agg(F.count("*").alias("n"))
    item = n.groupBy("utterance_id", "span_start").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m > 1")
    observed = item.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("t"), F.count("*").alias("items"))
    labels = n.join(item.select("utterance_id", "span_start"), ["utterance_id", "span_start"]).groupBy("label").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    o, e = F.col("o") / F.col("t"), (F.col("t") * F.col("t") - F.col("sq")) / (F.col("t") * (F.col("t") - 1))
    return observed.join(F.broadcast(labels)).select("items", F.coalesce("t", F.lit(0)).alias("answers"), F.round(o, 6).alias("observed_disagreement"), F.round(e, 6).alias("expected_disagreement"), F.round(F.when(e > 0, 1 - o / e), 6).alias("alpha"))


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return latent_consensus(written(answers(read(spark, d, "heldout_queue")), "answers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus of each span that is one of the nine labels."""
    return _run(spark, d)[0].where("label <> ''").select("utterance_id", "span_start", "label")


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Skill, reliability and agreement with the consensus of each annotator."""
    return _run(spark, d)[1]


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Chance-corrected agreement over all spans."""
    return _alpha(answers(read(spark, d, "heldout_queue")))


SQL = {
    "p6_agreement": r"""
        WITH s AS (SELECT utterance_id u, srca a, opta o FROM heldout_queue UNION ALL SELECT utterance_id, srcb, optb FROM heldout_queue),
        k AS (SELECT u, regexp_replace(lower(a), '[^\p{L}\p{N}]', '', 'g') a, o FROM s WHERE o IS NOT NULL AND u IS NOT NULL),
        v AS (SELECT DISTINCT u, a FROM k WHERE a <> ''),
        e AS (SELECT DISTINCT u, a, x.span[1] st, upper(regexp_replace(x.label, '[^A-Za-z]', '', 'g')) l FROM (SELECT u, a, unnest(o) x FROM k WHERE a <> '')),
        i AS (SELECT DISTINCT u, st FROM e WHERE st IS NOT NULL),
        w AS (SELECT i.u, i.st, v.a, coalesce(e.l, '') l FROM i JOIN v ON i.u = v.u LEFT JOIN e ON e.u = v.u AND e.a = v.a AND e.st = i.st),
        n AS (SELECT u, st, l, count(*) n FROM w GROUP BY 1, 2, 3),
        m AS (SELECT u, st, sum(n) m, sum(n * n) sq FROM n GROUP BY 1, 2 HAVING sum(n) > 1),
        o AS (SELECT sum((m * m - sq) / (m - 1)) o, sum(m) t, count(*) items FROM m),
        c AS (SELECT sum(c * c) sq FROM (SELECT l, sum(n) c FROM n SEMI JOIN m USING (u, st) GROUP BY 1))
        SELECT items, CAST(t AS BIGINT) answers, round(o / t, 6) observed_disagreement, round((t * t - sq) / (t * (t - 1.0)), 6) expected_disagreement,
            round(1 - (o / t) / ((t * t - sq) / (t * (t - 1.0))), 6) alpha FROM o, c
    """,
}
QUERIES = {"p6_found": p6_found, "p6_annotators": p6_annotators, "p6_agreement": p6_agreement}
