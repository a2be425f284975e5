"""Exact nearest neighbours of sparse vectors, for curation.nearest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.tables import drop_written, shared_table, written

#: Terms of pool texts in an index block, which a task holds in memory (about 30 bytes each), and of the queries of a slice.
BLOCK_TERMS, SLICE_TERMS = 6_000_000, 400_000
#: Postings that are scored before the bound is tightened; then eight times as many, up to the last.
FIRST, MOST = 512, 1 << 15
#: Terms of a text that are looked at before all are.
AHEAD = 8
#: Texts that are scored before the others of a lot.
BEST = 32
#: Steps of the norms by which postings are ordered.
LEVELS = 1024
#: Scores are compared with that much to spare, as they are rounded to nine digits later.
SPARE = 1e-8


class Terms:
    """All terms of the pool, numbered from the rarest on, with their weights."""

    _last: tuple = (None, None)

    def __init__(self, term: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(term)
        self.term = term[order]
        self.rank = np.empty(len(term), np.int64)
        by = np.lexsort((term, df))
        self.rank[by] = np.arange(len(term))
        self.rank = self.rank[order].astype(np.int32)
        self.idf = np.log((1 + n) / (1 + df[by])) + 1

    @classmethod
    def load(cls, path: str, n: int) -> Terms:
        """From the shared folder; a worker keeps those it used last."""
        if cls._last[0] != path:
            cls._last = (None, None)
            rows = shared_table(path, ["t", "df"])
            cls._last = (path, cls(rows.column("t").to_numpy(), rows.column("df").to_numpy(), n))
        return cls._last[1]

    def vectors(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin of each text and end of the last, terms from the rarest on, how often each occurs, lengths of the vectors); a term that the pool hasn't counts in the length only, with weight 1."""
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row, t = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.term, t)
        known = self.term.take(at, mode="clip") == t if len(self.term) else np.zeros(len(t), bool)
        lost = np.lexsort((t[~known], row[~known]))
        extra = np.zeros(len(size))
        if len(lost):
            r, x = row[~known][lost], t[~known][lost]
            first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])))
            extra = np.bincount(r[first], np.diff(np.append(first, len(r))).astype(float) ** 2, len(size))
        wide = max(1, len(self.term))
        pair = np.sort(row[known] * wide + self.rank[at[known]])
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(pair))).astype(np.int32)
        row, rank = pair[first] // wide, (pair[first] % wide).astype(np.int32)
        v = tf * self.idf[rank]
        norm = np.sqrt(np.bincount(row, v * v, len(size)) + extra)
        return np.append(0, np.cumsum(np.bincount(row, minlength=len(size)))), rank, tf, norm

    def weights(self, begin: np.ndarray, rank: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return tf * self.idf[rank] / np.repeat(norm, np.diff(begin))


def _rest(begin: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Length of each text's vector from each term on."""
    total = np.append(0, np.cumsum((v * v)[::-1]))[::-1]
    end = np.repeat(begin[1:], np.diff(begin))
    return np.sqrt(np.maximum(total[:-1] - total[end], 0) + 1e-9)  # rather too long than too short


class Block:
    """A block of pool texts: vectors by text, and postings by term, the longest rest of a vector first."""

    def __init__(self, ids: np.ndarray, members: np.ndarray, begin: np.ndarray, rank: np.ndarray, v: np.ndarray):
        self.ids, self.members, self.begin, self.rank, self.v = ids, members, begin, rank, v
        self.rest = np.append(_rest(begin, v), 0)
        level = np.clip(((1 - self.rest[:-1]) * LEVELS).astype(np.int64), 0, LEVELS - 1)  # no longer than 1 - level / LEVELS
        key = rank.astype(np.int64) * LEVELS + level
        self.entry = np.argsort(key, kind="stable").astype(np.int32)
        self.key = key[self.entry]
        self.row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(begin))
        self.seen, self.first = np.zeros(len(ids), bool), np.zeros(len(ids), np.int32)

    def best(self, t: np.ndarray, w: np.ndarray, rest: np.ndarray, full: np.ndarray, k: int, found: list, bound: float) -> float:
        """Adds (ids, scores, members) of the texts that may be among the k nearest of a query (terms t, weights w, lengths of what rests; full has the weights by term); the bound from now on.

        Of two texts' common terms take the rarest: their score is no more than the product of the lengths of both vectors from there on. So postings under that are left out,
        and a text whose rarest common term is left out so is none of the nearest. Of the others, the next AHEAD terms and the lengths of what then rests tell most off.
        """
        at = np.searchsorted(self.key, t.astype(np.int64) * LEVELS)
        scored, budget, j = [], MOST if bound else FIRST, 0
        after = np.append(rest, 0)
        while j < len(t):
            # level / LEVELS <= 1 - bound / rest, for all terms from j on
            room = (1 - (bound - SPARE) / rest[j:]) * LEVELS
            stop = int(np.searchsorted(-room, 0, "right"))  # room falls with rest
            if not stop:
                break
            to = np.searchsorted(self.key, t[j : j + stop].astype(np.int64) * LEVELS + np.minimum(room[:stop], LEVELS - 1).astype(np.int64), "right")
            n = np.maximum(to - at[j : j + stop], 0)
            total = np.cumsum(n)
            m = max(1, int(np.searchsorted(total, budget, "right")))
            n, m = n[:m], min(m, len(n))
            e = self.entry[np.repeat(at[j : j + m] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            row = self.row[e]
            new = np.flatnonzero(~self.seen[row])
            j, budget = j + m, min(MOST, budget * 8)
            if not len(new):
                continue
            e, row = e[new], row[new]
            nth = np.arange(len(row), dtype=np.int32)
            self.first[row[::-1]] = nth[::-1]
            one = self.first[row] == nth  # each once, with its rarest common term
            e, row = e[one], row[one]
            self.seen[row] = True
            scored.append(row)
            row, most = self.ahead(e, row, t, after, full, bound - SPARE)
            # the most promising first, as they raise the bound for the others
            if len(row) > BEST:
                order = np.argpartition(-most, BEST)
                row, most = row[order], most[order]
            for part in (slice(0, BEST), slice(BEST, None)):
                some = row[part][most[part] >= bound - SPARE]
                if len(some):
                    s = self.scores(some, full)
                    keep = np.flatnonzero(s >= bound - SPARE)
                    if len(keep):
                        found.append((self.ids[some[keep]], s[keep], self.members[some[keep]]))
                        bound = trimmed(found, k)
        for row in scored:
            self.seen[row] = False
        return bound

    def ahead(self, e: np.ndarray, row: np.ndarray, t: np.ndarray, after: np.ndarray, full: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, most that they can score) of those that may reach least, by the AHEAD terms from entry e on, then twice as many, and the lengths of what rests after these."""
        sure = np.zeros(len(row))
        for wide in (AHEAD, 2 * AHEAD):
            end = self.begin[row + 1]
            near = e[:, None] + np.arange(wide, dtype=np.int32)
            value = full.take(self.rank.take(near, mode="clip")) * self.v.take(near, mode="clip")
            value[near >= end[:, None]] = 0
            sure, e = sure + value.sum(1), np.minimum(e + np.int32(wide), end).astype(np.int32)
            most = sure + np.where(e < end, self.rest.take(e) * after.take(np.searchsorted(t, self.rank.take(e, mode="clip"))), 0)
            can = np.flatnonzero(most >= least)
            e, row, sure, most = e[can], row[can], sure[can], most[can]
        return row, most

    def scores(self, row: np.ndarray, full: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for at in range(0, len(row), 1 << 14):
            r = row[at : at + (1 << 14)]
            a, n = self.begin[r], self.begin[r + 1] - self.begin[r]
            first = np.cumsum(n) - n
            e = np.repeat(a - first, n) + np.arange(int(n.sum()))
            out[at : at + len(r)] = np.add.reduceat(full[self.rank[e]] * self.v[e], first)
        return out


def trimmed(found: list, k: int) -> float:
    """The score that k members of the texts found reach, 0 if there are fewer; drops what falls short of it, equals stay."""
    ids, s, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-s, kind="stable")
    total = np.cumsum(n[order])
    at = int(np.searchsorted(total, k))
    bound = float(s[order[at]]) if at < len(order) else 0.0
    keep = s >= bound - SPARE
    found[:] = [(ids[keep], s[keep], n[keep])]
    return bound


def _built(terms: str, n: int):
    def run(key, table):
        begin, rank, tf, norm = Terms.load(terms, n).vectors(_lists(table.column("h")))
        put = {"ids": table.column("id").to_numpy(), "members": table.column("m").to_numpy().astype(np.int64), "begin": begin, "rank": rank, "tf": tf, "norm": norm}
        rows = [(key[0].as_py(), name, i, x.tobytes()[a : a + (4 << 20)]) for name, x in put.items() for i, a in enumerate(range(0, max(x.nbytes, 1), 4 << 20))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return run


_PIECES = pa.schema([("block", pa.int64()), ("what", pa.string()), ("nth", pa.int32()), ("data", pa.binary())])
_KINDS = {"ids": np.int64, "members": np.int64, "begin": np.int64, "rank": np.int32, "tf": np.int32, "norm": np.float64}


def _lists(column: pa.ChunkedArray) -> pa.ListArray:
    one = column.combine_chunks()
    return pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one


def _block(terms: Terms, path: str, b: int) -> Block | None:
    rows = shared_table(path, ["what", "nth", "data"], ("block", b)).sort_by("nth")
    if not rows.num_rows:
        return None
    what, data = rows.column("what").to_pylist(), rows.column("data")
    x = {k: np.concatenate([np.frombuffer(data[i].as_buffer(), np.uint8) for i, w in enumerate(what) if w == k]).view(kind) for k, kind in _KINDS.items()}
    del rows, data
    return Block(x["ids"], x["members"], x["begin"], x["rank"], terms.weights(x["begin"], x["rank"], x["tf"], x["norm"]))


def _searched(terms: str, n: int, index: str, blocks: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table, t = pa.Table.from_batches(got), Terms.load(terms, n)
        begin, rank, tf, norm = t.vectors(_lists(table.column("h")))
        w = t.weights(begin, rank, tf, norm)
        rest, full, ids = _rest(begin, w), np.zeros(len(t.idf)), table.column("id").to_numpy()
        found: list[list] = [[] for _ in ids]
        bound = np.zeros(len(ids))
        for b in range(blocks):
            one = _block(t, index, b)
            for i in range(len(ids) if one else 0):
                of = slice(begin[i], begin[i + 1])
                full[rank[of]] = w[of]
                bound[i] = one.best(rank[of], w[of], rest[of], full, k, found[i], bound[i])
                full[rank[of]] = 0
            del one
        for i, f in enumerate(found):
            found[i] = [(np.full(len(p), ids[i]), p, s) for p, s, _ in f]
        out = [x for f in found for x in f]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "p", "score"])

    return run


def nearest_texts(pool: DataFrame, queries: DataFrame, terms_of: Callable[[Column], Column], k: int, n: int) -> DataFrame:
    """(q, p, score) of each query and the texts of the pool with the highest TF-IDF cosine that together have k members, with all that equal the last.

    pool has id, t (what terms_of makes an array of term hashes of), n (rows with this text) and m (members, those that can be an answer), queries id and t; n is the number of rows for the weights.
    The pool is indexed in blocks in the shared folder; slices of the queries search block after block, so what they found in one bounds the next. Exact: only texts that can't reach the bound are left out.
    A task holds one block, all different terms of the pool (some 30 bytes each) and its slice. Terms are compared as 64-bit hashes.
    """
    hashed = lambda df: df.withColumn("h", terms_of(F.col("t"))).drop("t")
    terms = written(hashed(pool).select("n", F.explode(F.array_distinct("h")).alias("t")).groupBy("t").agg(F.sum("n").alias("df")), "terms")
    total = lambda df: hashed(df).agg(F.sum(F.size("h"))).first()[0] or 0
    blocks = max(1, -(-total(pool) // BLOCK_TERMS))
    build = _built(terms._tapeloom_path, n)
    # texts are shuffled, their terms are made where they arrive
    lots = hashed(pool.withColumn("block", F.expr(f"pmod(xxhash64(id), {blocks})")).repartition("block"))
    index = written(lots.groupBy("block").applyInArrow(lambda key, table: build(key, table), "block bigint, what string, nth int, data binary"), "index")
    slices = max(pool.sparkSession.sparkContext.defaultParallelism, -(-total(queries) // SLICE_TERMS))
    search = _searched(terms._tapeloom_path, n, index._tapeloom_path, blocks, k)
    out = written(hashed(queries.repartition(slices)).select("id", "h").mapInArrow(search, "q bigint, p bigint, score double"), "nearest")
    drop_written(index)
    drop_written(terms)
    return out
