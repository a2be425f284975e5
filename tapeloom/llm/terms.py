"""Problem 4: how often every term occurs, and in how many records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.plans.tables import read

_WORD = re.compile(r"[^\W_]+")
#: Tokens of a suffix array; a record with more is an array of its own.
BLOCK = 1 << 20
#: Marks the ends of a value; no word holds it.
EDGE = "\x00"


def suffix_array(tokens: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the whole suffixes in order, common prefix of each with the one before). A suffix goes on to the end of its stretch, `left` tokens away, and comes before those it begins.

    Prefix doubling: ranks by 1, 2, 4 ... tokens until the longest stretch is covered or all ranks differ. Neighbours' common prefix is put together from the ranks of each power, the largest first.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    while n and width < left.max() and rank.max() < n:
        nxt = np.zeros(n, np.int64)
        on = np.flatnonzero(left > width)
        nxt[on] = rank[on + width]
        rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    prefix = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        most, got = np.minimum(left[a], left[b]), np.zeros(n - 1, np.int64)
        for level in reversed(range(len(levels))):
            ok = np.flatnonzero(got + (1 << level) <= most)
            ok = ok[levels[level][a[ok] + got[ok]] == levels[level][b[ok] + got[ok]]]
            got[ok] += 1 << level
        prefix[1:] = got
    return order, prefix


def intervals(order: np.ndarray, prefix: np.ndarray, record: np.ndarray, k: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a position, occurrences, records) of every k-gram: the intervals of suffixes whose neighbours share k tokens.

    whole says which positions begin k tokens of one record. Records are occurrences less the adjacencies of one record within an interval.
    """
    run = np.cumsum(prefix < k)
    keep = whole[order]
    run, pos = run[keep], order[keep]
    if not len(pos):
        return pos, pos, pos
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    n = np.diff(np.append(first, len(run)))
    rec = record[pos]
    by = np.lexsort((rec, run))
    again = np.append(False, (run[by][1:] == run[by][:-1]) & (rec[by][1:] == rec[by][:-1]))
    return pos[first], n, n - np.add.reduceat(again, first)


def _block_counts(rows: list[tuple[str, list[list[str]]]], max_n: int) -> Iterator[tuple[str, str, int, int, int]]:
    """(field, term, n, occurrences, records) of one block; field `text` gives n-grams within a stretch, others whole values."""
    ids: dict[str, int] = {}
    for name in dict.fromkeys(x[0] for x in rows):
        tokens, record, stretch = [], [], []
        whole_value = name != "text"
        s = 0
        for r, (field, values) in enumerate(rows):
            if field == name:
                for v in values:
                    v = [EDGE, *v, EDGE] if whole_value else v
                    tokens.extend(ids.setdefault(w, len(ids)) for w in v)
                    record.extend([r] * len(v))
                    stretch.extend([s] * len(v))
                    s += 1
        if not tokens:
            continue
        t, rec, st = np.array(tokens), np.array(record), np.array(stretch)
        size = np.bincount(st)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        left = (starts + size)[st] - np.arange(len(t))
        words = list(ids)
        # one array of whole suffixes; terms of every length are read from its intervals
        order, prefix = suffix_array(t, left)
        for k in map(int, np.unique(size) if whole_value else range(1, min(max_n, int(size.max())) + 1)):
            ok = left >= k if not whole_value else (left == k) & (size[st] == k)
            at, occ, recs = intervals(order, prefix, rec, k, ok)
            for p, o, c in zip(at.tolist(), occ.tolist(), recs.tolist()):
                g = tokens[p : p + k]
                yield name, " ".join(words[x] for x in (g[1:-1] if whole_value else g)), (k - 2 if whole_value else k), o, c


def _count(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*_block_counts(rows, max_n))) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["field", "term", "n", "occurrences", "records"])

        for b in batches:
            for field, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = [w for x in values if x is not None and (w := _WORD.findall(x.lower()))]
                if v:
                    n = sum(map(len, v))
                    if rows and size + n > BLOCK:
                        yield out()
                        rows, size = [], 0
                    rows.append((field, v))
                    size += n
        if rows:
            yield out()

    return run


def term_frequencies(df: DataFrame, max_n: int = 1) -> DataFrame:
    """(field, term, n, occurrences, records) of every term.

    df has field (string) and values (array of strings), a row for each record and field. In field `text` terms are the n-grams of 1 to max_n words within a value,
    in any other field the whole values, as their words joined by blanks. Each task builds suffix arrays over blocks of its records, of whole suffixes, to the end of their value;
    an interval of common prefixes is a term, its length the occurrences, less the neighbours within one record the records.
    Records are never split between blocks, so the blocks' counts add up; only they are shuffled, summed on the map side first, which also evens out terms that stand in every record.
    max_n only bounds what is put out, as all runs of all lengths are as many as the squares of the values' lengths. Null values, and those without a word, count nothing; an empty table gives no row. Other columns are ignored.
    """
    counts = df.select("field", "values").where("values is not null").mapInArrow(_count(max_n), "field string, term string, n int, occurrences bigint, records bigint")
    return counts.groupBy("field", "term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


#: Terms in at most so many records are rare, in more than this share of all rows common.
RARE, COMMON = 2, {"text": 0.1, "entity": 0.01}


def _records(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("text").alias("field"), F.array("text").alias("values")), F.struct(F.lit("entity").alias("field"), F.col("entities.text").alias("values")))
    return read(spark, d, "gold").select(F.explode(both).alias("x")).select("x.*")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """All words and entity values with occurrences, records and verdict (`rare`, `common` or `useful`)."""
    rows = read(spark, d, "gold").agg(F.count("*").alias("rows"))  # one row
    limit = F.when(F.col("field") == "text", F.lit(COMMON["text"])).otherwise(F.lit(COMMON["entity"]))
    verdict = F.when(F.col("records") <= RARE, "rare").when(F.col("records") > limit * F.col("rows"), "common").otherwise("useful")
    return term_frequencies(_records(spark, d)).join(F.broadcast(rows)).select("field", "term", "occurrences", "records", verdict.alias("verdict"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p4_terms(spark, d).where("verdict <> 'useful'").select("field", "term", "verdict")


def p4_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of all runs of one to three words of gold.text."""
    return term_frequencies(read(spark, d, "gold").select(F.lit("text").alias("field"), F.array("text").alias("values")), 3).select("term", "n", "occurrences", "records")


_TERMS = r"""
    WITH x AS (SELECT utterance_id id, 'text' field, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term FROM gold
        UNION ALL SELECT id, 'entity', array_to_string(regexp_extract_all(lower(e), '[\p{L}\p{N}]+'), ' ') FROM (SELECT utterance_id id, unnest(entities).text e FROM gold)),
    c AS (SELECT field, term, count(*) occurrences, count(DISTINCT id) records FROM x WHERE term <> '' GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > (CASE field WHEN 'text' THEN 0.1 ELSE 0.01 END) * (SELECT count(*) FROM gold) THEN 'common' ELSE 'useful' END verdict FROM c)
"""
SQL = {
    "p4_found": _TERMS + "SELECT field, term, verdict FROM v WHERE verdict <> 'useful'",
    "p4_terms": _TERMS + "SELECT field, term, occurrences, records, verdict FROM v",
    "p4_ngrams": r"""
        WITH w AS (SELECT utterance_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM gold),
        p AS (SELECT id, w, unnest(range(1, len(w) + 1)) i FROM w), g AS (SELECT id, w, i, unnest([1, 2, 3]) n FROM p),
        t AS (SELECT id, n, array_to_string(w[i:i + n - 1], ' ') term FROM g WHERE i + n - 1 <= len(w))
        SELECT term, CAST(n AS INTEGER) n, count(*) occurrences, count(DISTINCT id) records FROM t GROUP BY 1, 2
    """,
}
QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms, "p4_ngrams": p4_ngrams}
