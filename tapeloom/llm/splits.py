"""Problem 5: splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.names import id_key, name_key
from tapeloom.operators.skew import lookup_join
from tapeloom.plans.tables import drop_written, read, written

#: Components above 1/UNITS of all records move alone; the others move in UNITS hashed bunches of whole components.
UNITS, CHAINS, STEPS = 2048, 8, 20_000
#: The LABELS most frequent labels are balanced each by itself; only those beyond share TAIL hashed slots, and the report says which.
LABELS, TAIL = 1024, 64


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the smallest node connected with it.

    Alternates large-star (every node sends its larger neighbours to its smallest) and small-star (its smaller ones) until nothing changes;
    each round is a pre-aggregated minimum and a join that spreads hot nodes, written to the shared folder. Loops and nulls are ignored, repeated edges allowed.
    """
    now = written(edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        new = now
        for large in (True, False):
            sym = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))) if large else F.array(F.struct("u", "v"))
            near = new.select(F.explode(sym).alias("e")).select("e.*")
            least = written(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")
            moved = lookup_join(near, least.select("u", F.least("u", "m").alias("m"), "degree"), ["u"], "degree")
            if large:
                moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                own = least.select("u", F.col("m").alias("v"))
                moved = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
            after = written(moved.where("u <> v").distinct(), "edges")
            drop_written(least)
            if new is not now:
                drop_written(new)
            new = after
        # both hold distinct edges, so equal sums of hashes and counts mean that the round changed nothing
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("t")).first()
        drop_written(now)
        now = new
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def related_groups(rows: DataFrame, key: str, ids: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(members: key, comp; groups: comp, group_id, records) of records that share an id in any of the columns ids (column -> kind), directly or through others.

    Ids are compared by letters and number; an id without a digit, or null, ties nothing. Repeated rows of a key are one record with all their ids.
    group_id is the smallest key of the group. Null keys are ignored; an empty table gives no group.
    """
    nodes = F.array_compact(F.array(*(id_key(F.col(c), kind) for c, kind in ids.items())))
    held = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode_outer(nodes).alias("node")).distinct()
    held = written(held, "held")
    own = written(held.where("node is not null").groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("u"), F.count("*").alias("n")), "own")
    edges = own.where("n > 1").select("u", "v")
    more = own.where("n > 2").select("key", "v", "n")
    edges = edges.unionByName(lookup_join(held.where("node is not null"), more, ["key"], "n").select(F.col("node").alias("u"), "v"))
    roots = written(connected(edges), "roots")
    degree = own.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n"))
    linked = degree.join(roots, "node", "left").select(F.col("node").alias("v"), F.coalesce("root", "node").alias("comp"), "n")
    tied = lookup_join(own.select("key", "v"), written(linked, "linked"), ["v"], "n").select("key", "comp")
    alone = held.where("node is null").select("key").distinct().join(own.select("key"), "key", "left_anti").select("key", F.concat(F.lit("="), "key").alias("comp"))
    members = written(tied.unionByName(alone), "members")
    groups = members.groupBy("comp").agg(F.min("key").alias("group_id"), F.count("*").alias("records"))
    return members.withColumnRenamed("key", key), groups


def torn_groups(rows: DataFrame, key: str, split: str, ids: dict[str, str]) -> DataFrame:
    """(group_id, key) of all records of groups that now have two or more splits; splits are compared as names, null or letterless is none."""
    members, groups = related_groups(rows, key, ids)
    now = rows.select(key, name_key(F.col(split)).alias("split")).where("split <> ''").groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b"))
    seen = members.join(now, key).groupBy("comp").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b")
    torn = written(groups.join(seen.select("comp"), "comp"), "torn")
    return lookup_join(members, torn, ["comp"], "records").select("group_id", key)


def _anneal(size: np.ndarray, labels: np.ndarray, start: np.ndarray, share: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """Moves a unit to another split or exchanges two, at a falling temperature; returns the least cost seen and its assignment.

    Cost: squared deviations of the splits' sizes and, for each label, of its parts in the splits from their shares, each relative to what is to be split.
    """
    rng = np.random.default_rng(seed)
    total, per = max(size.sum(), 1), np.maximum(labels.sum(axis=0), 1)
    k = len(share)
    at = start.copy()
    have = np.array([size[at == s].sum() for s in range(k)], float)
    lab = np.array([labels[at == s].sum(axis=0) for s in range(k)], float)
    weight = per / per.sum()
    # a move changes only the labels its unit holds
    held = [np.flatnonzero(row) for row in labels]
    part = [labels[n, c] / per[c] for n, c in enumerate(held)]
    load = size / total
    h, x = have / total - share, lab / per - share[:, None]
    now = best = float((h**2).sum() * 4 + (x**2 * weight).sum())
    kept = at.copy()

    def move(n: int, s: int) -> float:
        """Moves unit n to split s; returns the change of the cost."""
        change, c = 0.0, held[n]
        for t, sign in ((at[n], -1), (s, 1)):
            v = sign * part[n]
            change += 4 * sign * load[n] * (2 * h[t] + sign * load[n]) + float((weight[c] * v * (2 * x[t, c] + v)).sum())
            h[t] += sign * load[n]
            x[t, c] += v
        at[n] = s
        return change

    u, v, to, luck, kind = rng.integers(0, len(size), steps), rng.integers(0, len(size), steps), rng.integers(0, k, steps), rng.random(steps), rng.random(steps)
    for i in range(steps if len(size) > 1 and k > 1 else 0):
        heat = max(now, 1e-12) * 0.1 * (1 - i / steps) ** 2 + 1e-15
        a, b = u[i], v[i]
        moves = [(a, at[b]), (b, at[a])] if kind[i] < 0.5 else [(a, to[i])]
        if all(at[n] == s for n, s in moves):
            continue
        back = [(n, at[n]) for n, _ in moves]
        c = now + sum(move(n, s) for n, s in moves)
        if c <= now or luck[i] < np.exp((now - c) / heat):
            now = c
            if c < best:
                best, kept = c, at.copy()
        else:
            for n, s in back:
                move(n, s)
    h = np.bincount(kept, size, k) / total - share
    x = np.array([labels[kept == s].sum(axis=0) for s in range(k)]) / per - share[:, None]
    return float((h**2).sum() * 4 + (x**2 * weight).sum()), kept


def _record_labels(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label as a name; null is the empty name) of each record."""
    return rows.groupBy(key).agg(F.min(name_key(F.col(label))).alias("label")).select(key, F.coalesce("label", F.lit("")).alias("label"))


def _slots(counts: DataFrame) -> tuple[DataFrame, Column]:
    """(the LABELS most frequent labels of counts (label, n) with their slot, ties by label; the slot of a label joined with them)."""
    top = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).select("label").collect()
    own = counts.sparkSession.createDataFrame([(r["label"], i) for i, r in enumerate(top)], "label string, own int")
    return own, F.coalesce("own", (F.pmod(F.xxhash64("label"), F.lit(TAIL)) + LABELS).cast("int"))


def grouped_split(rows: DataFrame, targets: DataFrame, key: str, label: str, ids: dict[str, str], seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(assignment: key, group_id, assigned_split; report: dataset_split, target_share, actual_share, records, within_tolerance).

    Component swap search: a hash puts each unit into a split by the shares; CHAINS annealing chains in parallel then move and exchange units,
    and the best result of all chains is kept. A unit is one component with more than 1/UNITS of all records, or a hashed bunch of smaller whole components:
    at most 2 * UNITS units whatever the data's size, and no component is ever cut. The LABELS most frequent labels are numbered exactly;
    those beyond are hashed to TAIL slots (label_shares tells them apart).
    """
    spark = rows.sparkSession
    members, groups = related_groups(rows, key, ids)
    t = targets.orderBy("dataset_split").limit(1001).collect()
    if not t or len(t) > 1000:
        raise ValueError("from 1 to 1000 target splits are needed")
    share = np.array([r["target_share"] for r in t], float)
    share = share / share.sum()
    total = members.count()
    big = F.col("records") > total / UNITS
    unit = F.when(big, F.xxhash64("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(UNITS)))
    placed = written(groups.withColumn("unit", F.concat(F.when(big, "c").otherwise("b"), unit.cast("string"))), "units")
    with_unit = written(lookup_join(members, placed, ["comp"], "records").select(key, "group_id", "unit"), "with-unit")
    counts = written(with_unit.join(_record_labels(rows, key, label), key).groupBy("unit", "label").agg(F.count("*").alias("n")), "labels")
    own, slot = _slots(counts)
    hist = counts.join(F.broadcast(own), "label", "left").groupBy("unit", slot.alias("slot")).agg(F.sum("n").alias("n"))
    # one row for each unit, of at most LABELS + TAIL slots
    hist = hist.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("x")).select("unit", F.col("x.slot").alias("slot"), F.col("x.n").alias("n"))
    hist = hist.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(CHAINS - 1))))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        units, slots = pdf["unit"].to_numpy(), np.concatenate(pdf["slot"].to_numpy())
        _, col = np.unique(slots, return_inverse=True)
        labels = np.zeros((len(units), col.max() + 1))
        labels[np.repeat(np.arange(len(units)), pdf["slot"].str.len()), col] = np.concatenate(pdf["n"].to_numpy())
        c = int(pdf["chain"].iloc[0])
        # the same hashed start for all chains
        u = np.array([int.from_bytes(__import__("hashlib").md5(f"{seed}:{x}".encode()).digest()[:6], "big") / 2**48 for x in units])
        best, at = _anneal(labels.sum(axis=1), labels, np.minimum(np.searchsorted(np.cumsum(share), u, side="right"), len(share) - 1), share, seed * 1000 + c, STEPS)
        return pd.DataFrame({"chain": c, "cost": best, "unit": units, "s": at})

    tried = written(hist.groupBy("chain").applyInPandas(chain, "chain int, cost double, unit string, s int"), "chains")
    best = tried.agg(F.min(F.struct("cost", "chain")).alias("b")).select(F.col("b.chain").alias("chain"))
    names = F.array(*(F.lit(r["dataset_split"]) for r in t))
    chosen = tried.join(F.broadcast(best), "chain").select("unit", names[F.col("s")].alias("assigned_split"))  # at most 2 * UNITS rows
    assigned = with_unit.join(F.broadcast(chosen), "unit").select(key, "group_id", "assigned_split")
    n = assigned.groupBy(F.col("assigned_split").alias("dataset_split")).agg(F.count("*").alias("records"))
    small = spark.createDataFrame([(r["dataset_split"], float(r["target_share"]), float(r["tolerance"]), total) for r in t], "dataset_split string, target_share double, tolerance double, total long")
    actual = F.round(F.coalesce("records", F.lit(0)) / F.greatest("total", F.lit(1)), 9)
    report = small.join(n, "dataset_split", "left").select("dataset_split", "target_share", actual.alias("actual_share"), F.coalesce("records", F.lit(0)).alias("records"), (F.abs(actual - F.col("target_share")) <= F.col("tolerance")).alias("within_tolerance"))
    return assigned, report


def label_shares(rows: DataFrame, targets: DataFrame, assigned: DataFrame, key: str, label: str) -> DataFrame:
    """(label, dataset_split, target_share, actual_share, records, within_tolerance, hashed) of every label, also the hashed ones, and split: the share of the label's records that the split has.

    hashed: the label is beyond the LABELS most frequent, so the splits were balanced for its slot only.
    """
    n = written(assigned.join(_record_labels(rows, key, label), key).groupBy("label", "assigned_split").agg(F.count("*").alias("n")), "label-splits")
    own, _ = _slots(n)
    total = n.groupBy("label").agg(F.sum("n").alias("total"))
    each = total.crossJoin(F.broadcast(targets.select("dataset_split", "target_share", "tolerance"))).join(n.withColumnRenamed("assigned_split", "dataset_split"), ["label", "dataset_split"], "left")
    each = each.join(F.broadcast(own), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    actual = F.round(F.col("n") / F.col("total"), 9)
    return each.select("label", "dataset_split", F.col("target_share").cast("double").alias("target_share"), actual.alias("actual_share"), F.col("n").alias("records"), (F.abs(actual - F.col("target_share")) <= F.col("tolerance")).alias("within_tolerance"), F.col("own").isNull().alias("hashed"))


IDS = {"speaker_id": "s:", "source_id": "r:"}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Utterances of groups that are now torn apart."""
    return torn_groups(read(spark, d, "heldout"), "utterance_id", "dataset_split", IDS)


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """The new split of each utterance."""
    return grouped_split(read(spark, d, "heldout"), read(spark, d, "split_targets"), "utterance_id", "dataset_source", IDS)[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the new splits: of all records where label is null, then of each label's."""
    rows, targets = read(spark, d, "heldout"), read(spark, d, "split_targets")
    assigned, whole = grouped_split(rows, targets, "utterance_id", "dataset_source", IDS)
    labels = label_shares(rows, targets, written(assigned, "assigned"), "utterance_id", "dataset_source")
    return whole.withColumns({"label": F.lit(None).cast("string"), "hashed": F.lit(False)}).select(labels.columns).unionByName(labels)


_ID = r"CASE WHEN {0} SIMILAR TO '.*[0-9].*' THEN '{1}' || regexp_replace(lower({0}), '[^\p{{L}}]', '', 'g') || '#' || coalesce(nullif(ltrim(regexp_replace({0}, '[^0-9]', '', 'g'), '0'), ''), '0') END"
SQL = {
    # labels spread between utterances and ids until nothing changes
    "p5_found": f"""
        WITH RECURSIVE h AS (SELECT DISTINCT utterance_id u, nullif(regexp_replace(lower(dataset_split), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') sp,
            {_ID.format('speaker_id', 's:')} a, {_ID.format('source_id', 'r:')} b FROM heldout WHERE utterance_id IS NOT NULL),
        e AS (SELECT DISTINCT u, a n FROM h WHERE a IS NOT NULL UNION SELECT DISTINCT u, b FROM h WHERE b IS NOT NULL),
        l AS (SELECT DISTINCT u, u AS g, 0 AS i FROM h
            UNION ALL SELECT u, min(g), min(i) + 1 FROM (
                SELECT e.u, m.g, m.i FROM e JOIN (SELECT e.n, min(l.g) g, min(l.i) i FROM l JOIN e ON l.u = e.u GROUP BY e.n) m ON e.n = m.n
                UNION ALL SELECT u, g, i FROM l) GROUP BY u HAVING min(i) < 40),
        c AS (SELECT u, g FROM l WHERE i = (SELECT max(i) FROM l)),
        t AS (SELECT g FROM c JOIN h ON c.u = h.u GROUP BY g HAVING count(DISTINCT sp) > 1)
        SELECT g AS group_id, u AS utterance_id FROM c WHERE g IN (SELECT g FROM t)
    """,
}
QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_report": p5_report}
