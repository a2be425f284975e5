"""Problem 2: records that differ only in formatting or in the order of their fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.skew import HOT_PARTS
from tapeloom.plans.tables import read, written

#: Characters of text that are hashed at a time; longer texts are a block of their own.
BLOCK = 1 << 22
PRIME, BASES = (1 << 31) - 1, (911_382_323, 972_663_749)
#: A named field: after the start or a field separator, a name, then an assignment sign.
_FIELD = re.compile(r"(?:^|[;|\n])([^;|\n:=]*)[:=]")

_FOLD = np.zeros(0x110000, np.uint32)
_SEEN = np.zeros(0x110000, bool)


def fold(code: int) -> int:
    """What a code point counts as: 0 if it is skipped, else its lower-case letter or digit plus one."""
    low = chr(code).lower()[:1]
    return ord(low) + 1 if low.isalnum() else 0


def _folded(codes: np.ndarray) -> np.ndarray:
    """The skip-and-fold table applied to code points; the table is filled as characters turn up."""
    new = np.unique(codes[~_SEEN[codes]])
    if len(new):
        _FOLD[new] = [fold(int(c)) for c in new]
        _SEEN[new] = True
    return _FOLD[codes]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), PRIME)) % np.uint64(PRIME)])
        _POWERS[base] = p
    return p[:n]


class Rolling:
    """Prefix sums of two polynomial hashes over the kept characters of a block of texts; any stretch's hash follows in constant time."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        f = _folded(codes)
        self.kept = np.concatenate([[0], np.cumsum(f > 0)])
        self.sums = []
        for base in BASES:
            w = _powers(base, len(f) + 1)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(f * w[self.kept[:-1]] % np.uint64(PRIME), dtype=np.uint64)]))
        self.inverse = [_powers(pow(base, -1, PRIME), len(f) + 1) for base in BASES]

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(62-bit hash, number of kept characters) of each stretch."""
        h = [(s[end] - s[start]) % np.uint64(PRIME) * inv[self.kept[start]] % np.uint64(PRIME) for s, inv in zip(self.sums, self.inverse)]
        return (h[0] << np.uint64(31)) | h[1], self.kept[end] - self.kept[start]


def fields(text: str) -> list[tuple[int, int, int, int]]:
    """(name start, name end, value start, value end) of each field if the text is a strip of several named fields, else nothing."""
    if ":" not in text and "=" not in text:
        return []
    found = list(_FIELD.finditer(text))
    # several fields, each with a name, and nothing but skipped characters before the first
    if len(found) < 2 or any(not any(map(fold, map(ord, m[1]))) for m in found) or any(map(fold, map(ord, text[: found[0].start()]))):
        return []
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m.start(1), m.end(1), m.end(), e) for m, e in zip(found, ends)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, size) of each text: size is the number of kept characters, or minus the number of fields of a strip; 0 means nothing is kept.

    A strip's hash is the sum of its fields' hashes, so that their order doesn't matter.
    """
    h, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= BLOCK:
            size += len(texts[j])
            j += 1
        block = texts[i:j]
        off = np.concatenate([[0], np.cumsum([len(t) for t in block])]).astype(np.int64)
        roll = Rolling(block)
        a, b = roll.of(off[:-1], off[1:])
        a = a.view(np.int64).copy()
        strips = [(k, *f) for k, t in enumerate(block) for f in fields(t)]
        if strips:
            s = np.array(strips, np.int64)
            at = off[s[:, 0]]
            name, value = roll.of(at + s[:, 1], at + s[:, 2]), roll.of(at + s[:, 3], at + s[:, 4])
            with np.errstate(over="ignore"):
                one = _mix(_mix(name[0] + name[1].astype(np.uint64)) + value[0] * np.uint64(3) + value[1].astype(np.uint64))
                rows, first = np.unique(s[:, 0], return_index=True)
                a[rows] = np.add.reduceat(one, first).view(np.int64)
            b = b.copy()
            b[rows] = -np.diff(np.append(first, len(s)))
        h[i:j], n[i:j] = a, b
        i = j
    return h, n


def same(a: str, b: str) -> bool:
    """Two pointers run over both texts and skip what doesn't count; strips are compared field by field."""
    if a == b:
        return True
    fa, fb = fields(a), fields(b)
    if bool(fa) != bool(fb):
        return False
    if not fa:
        return _run(a, 0, len(a), b, 0, len(b))
    if len(fa) != len(fb):
        return False
    left = list(fb)
    for x in fa:
        y = next((y for y in left if _run(a, x[0], x[1], b, y[0], y[1]) and _run(a, x[2], x[3], b, y[2], y[3])), None)
        if y is None:
            return False
        left.remove(y)
    return True


def _run(a: str, i: int, m: int, b: str, j: int, n: int) -> bool:
    while True:
        x = y = 0
        while i < m and not (x := _at(a[i])):
            i += 1
        while j < n and not (y := _at(b[j])):
            j += 1
        if i == m or j == n:
            return i == m and j == n
        if x != y:
            return False
        i += 1
        j += 1


class _Cache(dict):
    def __missing__(self, c: str) -> int:
        self[c] = v = fold(ord(c))
        return v


_at = _Cache().__getitem__


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, n = signatures(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("record_table"), b.column("id"), b.column("text"), pa.array(h), pa.array(n)], ["record_table", "id", "text", "h", "n"])


@F.pandas_udf(T.BooleanType())
def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.StringType())
def _canonical(a: pd.Series) -> pd.Series:
    """Only for rows whose hashes collide though they differ."""
    kept = lambda t: "".join(chr(v - 1) for c in t if (v := _at(c)))
    return pd.Series(["\x01".join(sorted(kept(t[x[0] : x[1]]) + "\x02" + kept(t[x[2] : x[3]]) for x in fields(t))) or kept(t) for t in a])


def format_duplicates(df: DataFrame, salts: int = 64) -> DataFrame:
    """Links every record to the first of those that are the same but for formatting: (record_table, first_id, copy_id), no row for the first itself.

    df has record_table, id (unique in its table) and text. Texts are streamed through a skip-and-fold table into two rolling polynomial hashes;
    rows that share hashes and size are compared with the group's first by two skipping pointers. Rows that fail it (true collisions) are grouped again exactly.
    A group that holds more than 1/1024 of the rows is spread over `salts` tasks. Nulls, blank and letterless texts and null ids are no case; exact repeats are.
    Strings are ordered by code point. Other columns are ignored.
    """
    rows = df.select("record_table", F.col("id").cast("string").alias("id"), "text").where("text is not null and id is not null")
    signed = written(rows.mapInArrow(_sign, "record_table string, id string, text string, h bigint, n bigint").where("n <> 0"), "signatures")
    keys = ["record_table", "h", "n"]
    groups = signed.groupBy(*keys).agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    groups = written(groups, "groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hot_at = max(total / HOT_PARTS, 1000)
    hot = groups.where(F.col("copies") > hot_at).select(*keys, F.lit(True).alias("hot"))  # fewer than HOT_PARTS rows of fixed size
    salted = signed.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("hot")
    first = groups.join(signed.withColumnRenamed("id", "first_id"), [*keys, "first_id"]).select(*keys, "first_id", F.col("text").alias("first_text"), F.explode(F.when(F.col("copies") > hot_at, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    pairs = salted.join(first, [*keys, "salt"]).where("id <> first_id").withColumn("same", _verify("text", "first_text"))
    pairs = written(pairs.select(*keys, "first_id", "id", "same", F.when(~F.col("same"), F.col("text")).alias("text")), "verified")
    collided = pairs.where("not same").withColumn("c", _canonical("text"))
    again = collided.groupBy(*keys, "c").agg(F.min("id").alias("first_id"))
    again = collided.drop("first_id").join(again, [*keys, "c"]).where("id <> first_id")
    return pairs.where("same").select("record_table", "first_id", F.col("id").alias("copy_id")).unionByName(again.select("record_table", "first_id", F.col("id").alias("copy_id")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    gold = read(spark, d, "gold").select(F.lit("gold").alias("record_table"), F.col("utterance_id").alias("id"), "text")
    return gold.unionByName(read(spark, d, "samples").select(F.lit("samples").alias("record_table"), "id", F.col("ground_truth").alias("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record but the first of a set of same values."""
    return format_duplicates(_records(spark, d))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per transmission with its number of copies, itself included; texts without a letter or digit, which are no case, are left out."""
    rows = _records(spark, d).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    found = written(format_duplicates(_records(spark, d)), "found")
    n = found.groupBy("record_table", F.col("first_id").alias("id")).agg(F.count("*").alias("more"))
    firsts = rows.select("record_table", "id").join(found.select("record_table", F.col("copy_id").alias("id")), ["record_table", "id"], "left_anti")
    return firsts.join(n, ["record_table", "id"], "left").select("record_table", "id", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))


_ROWS = r"""
    WITH r AS (SELECT 'gold' record_table, utterance_id id, text t FROM gold UNION ALL SELECT 'samples', id, ground_truth FROM samples),
    k AS (SELECT record_table, id, regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g') plain,
        list_filter(regexp_split_to_array(regexp_replace(t, '(^|[;|\n])([^;|\n:=]*)[:=]', E'\x01\\2\x02', 'g'), E'\x01'), lambda x: x <> '') f, t FROM r WHERE t IS NOT NULL),
    c AS (SELECT record_table, id, CASE WHEN len(f) >= 2 AND len(list_filter(f, lambda x: contains(x, E'\x02'))) = len(f)
        THEN '#' || array_to_string(list_sort(list_transform(f, lambda x: regexp_replace(lower(x), E'[^\\p{L}\\p{N}\x02]', '', 'g'))), E'\x01') ELSE plain END c
        FROM k WHERE plain <> ''),
    g AS (SELECT *, min(id) OVER (PARTITION BY record_table, c) first_id, count(*) OVER (PARTITION BY record_table, c) n FROM c)
"""
SQL = {
    "p2_found": _ROWS + "SELECT record_table, first_id, id AS copy_id FROM g WHERE id <> first_id",
    "p2_collapsed": _ROWS + "SELECT record_table, id, n AS copies FROM g WHERE id = first_id",
}
QUERIES = {"p2_found": p2_found, "p2_collapsed": p2_collapsed}
