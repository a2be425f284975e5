"""Scans. SURVEY SC1-SC17, SO1, SO2, SO4, PF1-PF3."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import audio
from tapeloom.plans.tables import written

UTTERANCES = T.StructType([T.StructField(n, k(), True) for n, k in [
    ("utterance_id", T.StringType), ("dataset_source", T.StringType), ("original_split", T.StringType), ("dataset_split", T.StringType), ("source_id", T.StringType),
    ("audio_path", T.StringType), ("audio_checksum", T.StringType), ("audio_decode_error", T.StringType), ("transcript", T.StringType), ("transcript_normalized", T.StringType),
    ("duration_sec", T.DoubleType), ("sample_rate", T.IntegerType), ("word_count", T.IntegerType), ("character_count", T.IntegerType), ("speech_rate_wpm", T.DoubleType),
    ("numeric_token_count", T.IntegerType), ("command_verb_count", T.IntegerType), ("callsign_like_count", T.IntegerType), ("rms_energy", T.DoubleType), ("silence_pct", T.DoubleType),
    ("snr_db_proxy", T.DoubleType), ("zero_crossing_rate", T.DoubleType), ("spectral_centroid_hz", T.DoubleType), ("spectral_bandwidth_hz", T.DoubleType), ("recorded_at", T.StringType),
    ("is_repeated_transcript", T.BooleanType), ("repeated_transcript_count", T.LongType),
]])
SPANS = "array<struct<text:string,label:string,span:array<int>>>"
GOLD = f"utterance_id string, text string, entities {SPANS}"
RECORD = "utterance_id string, text string, dataset_split string, dataset_source string, entities array<struct<text:string,label:string>>, ok boolean, n_rounds int, n_rejected int, n_flags int"
HISTORY = "run_id string, timestamp_utc string, tag string, git_commit string, git_dirty string, config string, n int, median_s double, p95_s double, mean_s double, rtf double, wer double, cer double, load_s double, warmup_s double, peak_rss_mb double, gpu_peak_mb double, error string"


def validate_schema(df: DataFrame, expected: T.StructType = UTTERANCES) -> None:
    """SO4: exactly the expected columns, in any order."""
    have, want = set(df.columns), set(expected.fieldNames())
    if have != want:
        raise ValueError(f"missing {sorted(want - have)}, unexpected {sorted(have - want)}")


def split_table(spark: SparkSession, path: str, split: str) -> DataFrame:
    """SC3: one split of a table written by split; only its folder is read."""
    return spark.read.parquet(path).where(F.col("dataset_split") == split)


def numbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with _number, from 0 within each value of `by` in the given order: a row's place in its range slice, after the rows of the slices before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as the bounds of the slices are sampled and must not be drawn anew
    cut = written(df.repartitionByRange(n, by, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    count = cut.groupBy(F.col(by).alias("_by"), F.col("_slice").alias("_at")).agg(F.count("*").alias("_n"))
    before = count.select(F.col("_by").alias("_b"), F.col("_at").alias("_before"), F.col("_n").alias("_m"))
    offset = count.join(before, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_before") < F.col("_at")), "left").groupBy("_by", "_at").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_offset"))
    place = cut.withColumn("_number", F.row_number().over(Window.partitionBy(by, "_slice").orderBy(*order)) - 1)
    return place.join(offset, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_at"))).withColumn("_number", F.col("_number") + F.col("_offset")).drop("_slice", "_by", "_at", "_offset")


def union_sources(sources: dict[str, DataFrame], renames: dict[str, str], order: list[str], common_splits: bool = False) -> DataFrame:
    """SC1, SO1, SO2, PF1-PF3: one table of several sources: renamed, missing columns null, tagged with dataset_source and an id source-split-000000.

    `order` fixes the row numbers within a split. With common_splits only splits that all sources have are kept. Numbers are made per source and split from counts of range slices and places within them,
    so no task holds a whole split's order; ids keep the published split (T16).
    """
    out = None
    splits = [df.select("original_split").distinct() for df in sources.values()]
    for name, df in sources.items():
        d = df.withColumnsRenamed(renames)
        d = numbered(d, "original_split", order).withColumn("dataset_source", F.lit(name)).withColumn("utterance_id", F.format_string("%s-%s-%06d", F.lit(name), "original_split", "_number")).drop("_number")
        if common_splits:
            for s in splits:
                d = d.join(s, "original_split", "left_semi")
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def last_records(spark: SparkSession, path: str, schema: str = RECORD, key: str = "utterance_id") -> DataFrame:
    """SC4: JSON lines; blank ones skipped, of several records of a key the last one written stays (by file, then place in it).

    A file's place comes from the line's number within its split of the file, so files must be small enough for one task each, as one chunk of a run is.
    """
    raw = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_modification_time").alias("_t"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    r = raw.select(F.from_json("value", schema).alias("r"), F.struct("_t", "_f", "_b", "_i").alias("_at")).where(f"r.{key} is not null")
    return r.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "_at").alias("r")).select("r.*")


def gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """SC5."""
    return spark.read.schema(GOLD).json(path)


def result_files(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """SC6, JN17: CSV files by pattern; model is the file name's part between the first _ and _full."""
    df = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).csv(folder)
    return df.withColumn("model", F.regexp_extract(F.input_file_name(), r"/[^/_]+_([^/]+?)_full[^/]*\.csv$", 1))


def last_run(history: DataFrame, tag: str) -> DataFrame:
    """SC7: the rows of the last run with the tag, by timestamp, then run id."""
    rows = history.where(F.col("tag") == tag)
    last = rows.agg(F.max_by("run_id", F.struct("timestamp_utc", "run_id")).alias("run_id"))
    return rows.join(F.broadcast(last), "run_id", "left_semi")


def newest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """SC9: path of the newest file that matches; only names and times are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def wav_clips(spark: SparkSession, folder: str, features: bool = True, most_bytes: int = 200 << 20) -> DataFrame:
    """SC10-SC12, NU9: WAV files with rate, samples' checksum and features; a file that can't be read or is too large has an error instead. Without features only paths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    if not features:
        return files.select(F.col("path").alias("audio_path"))
    import hashlib

    import numpy as np
    import pandas as pd

    def run(it):
        for pdf in it:
            out = []
            for path, length, data in zip(pdf["path"], pdf["length"], pdf["content"]):
                try:
                    if length > most_bytes:
                        raise ValueError("file too large")
                    y, rate = audio.from_wav(bytes(data))
                    f = audio.clip_features(y, rate)
                    out.append({"audio_path": path, "sample_rate": rate, "audio_checksum": hashlib.sha1(y.astype(np.float32).tobytes()).hexdigest(), **f})
                except Exception as e:  # noqa: BLE001
                    out.append({"audio_path": path, "sample_rate": 0, "audio_checksum": None, **audio.clip_features(None, 1), "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(out)

    return files.select("path", "length", "content").mapInPandas(run, "audio_path string, sample_rate int, audio_checksum string, rms_energy double, silence_pct double, snr_db_proxy double, zero_crossing_rate double, spectral_centroid_hz double, spectral_bandwidth_hz double, duration_sec double, error string")


def log_tail(spark: SparkSession, path: str, most: int = 3_000_000) -> DataFrame:
    """SC13: lines (at, value) of the last `most` bytes of a log, in order; a line the tail cuts into is left out. Progress bars redraw with carriage returns, which end lines too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    lines = spark.read.text(path, wholetext=True).select(F.encode("value", "utf-8").alias("b"))
    tail = F.decode(F.when(F.lit(size) > most, F.substring("b", max(size - most, 0) + 1, most)).otherwise(F.col("b")), "utf-8")
    parts = F.split(tail, r"[\r\n]+")
    kept = F.slice(parts, 2, F.size(parts)) if size > most else parts
    return lines.select(F.posexplode(kept).alias("at", "value")).where(F.trim("value") != "")


def training_status(events: DataFrame) -> DataFrame:
    """SC13: one row of a log's events (at, from log_events): the last step of the training bar, losses and evaluations, test scores.

    The training bar is the one whose total is redrawn most often (the larger total where two are): validation and loading bars have other totals. Without bars the step is null.
    """
    bars = events.where("total is not null")
    main = bars.groupBy("total").agg(F.count("*").alias("n")).agg(F.max_by("total", F.struct("n", "total")).alias("total"))
    last = bars.join(F.broadcast(main), "total").agg(F.max_by(F.struct("done", "total", "elapsed_s", "left_s"), "at").alias("bar"))
    n = events.agg(F.count("loss").alias("losses"), F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("at"))).alias("latest_loss"), F.count("eval_wer").alias("evaluations"), F.min("eval_wer").alias("best_wer"), F.max_by("test_wer", F.when(F.col("test_wer").isNotNull(), F.col("at"))).alias("test_wer"), F.max_by("test_cer", F.when(F.col("test_cer").isNotNull(), F.col("at"))).alias("test_cer"))
    return n.join(F.broadcast(last)).select("bar.done", "bar.total", "bar.elapsed_s", "bar.left_s", "losses", "latest_loss", "evaluations", "best_wer", "test_wer", "test_cer")


def log_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """SC13, SR4: progress bars (done, total, elapsed and left seconds), losses, evaluations and test scores from log lines; batch or stream."""
    from tapeloom.functions.text import clock_seconds

    c = F.col(line)
    bar, num = r"(\d+)/(\d+) \[([\d:?]+)<([\d:?]+)", r"'%s': '?([-\d.e]+)"
    get = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    found = {"done": get(bar, 1).cast("long"), "total": get(bar, 2).cast("long"), "elapsed_s": clock_seconds(get(bar, 3)), "left_s": clock_seconds(get(bar, 4))}
    found |= {k: get(num % k, 1).cast("double") for k in ("loss", "eval_wer", "epoch")} | {f"test_{k}": get(rf"(?i)test.*?{k}\W+([\d.]+)", 1).cast("double") for k in ("wer", "cer")}
    return lines.withColumns(found).where("done is not null or loss is not null or eval_wer is not null or test_wer is not null")


def prefixes(paths: DataFrame, path: str, depth: int) -> DataFrame:
    """SC15: distinct leading folders of paths."""
    return paths.select(F.array_join(F.slice(F.split(path, "/"), 1, depth), "/").alias("prefix")).where(F.size(F.split(path, "/")) > depth).distinct()


def sample_catalog(df: DataFrame) -> DataFrame:
    """SC16, XO24: the catalog with defaults for split and note, and a label for display."""
    d = df.withColumns({"split": F.coalesce("split", F.lit("test")), "note": F.coalesce("note", F.lit("")), "entities": F.coalesce("entities", F.array().cast(dict(df.dtypes)["entities"]))})
    return d.withColumn("label", F.format_string("%s · %s%s", F.coalesce("source", F.lit("?")), F.when(F.col("duration_s").isNotNull(), F.format_string("%.1f", F.floor(F.col("duration_s") * 10 + 0.5) / 10)).otherwise("?"), F.when(F.col("note") != "", F.concat(F.lit(" s · "), "note")).otherwise(" s")))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """SC17, SR2: the table at path if it was completely written, else made and written; put the configuration's signature into the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fill_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """PF2: missing columns as nulls of a type."""
    return df.select("*", *(F.lit(None).cast(k).alias(c) for c, k in columns.items() if c not in df.columns))


def first_known(*cols: Column) -> Column:
    """PF17: the first value that isn't null."""
    return F.coalesce(*cols)
