import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.functions import vocab


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("descend flight level 660", "descend flight level six six zero"), ("contact 118.7", "contact one one eight decimal seven"), ("a 1-2 b.", "a one dash two b."), (".5 and 5.", ".five and five."), ("1.2.3", "one decimal two decimal three"), ("", ""), (None, None)])
def test_digits_to_words(spark, text, want):
    assert one(spark, tx.digits_to_words(F.col("t")), t=text) == want


def test_scoring_form_unites_spellings(spark):
    a, b = (one(spark, tx.scoring_form(F.col("t")), t=t) for t in ("Descend, Flight Level 90!", "descend flight level nine zero"))
    assert a == b


def test_normalize_is_idempotent_and_total(spark):
    rows = [(None,), ("",), ("  Hé, thé!  x_1 ",), (" A　b" * 50_000,)]
    df = spark.createDataFrame(rows, "t string").select(tx.normalize(F.col("t")).alias("n")).withColumn("m", tx.normalize(F.col("n")))
    got = df.collect()
    assert all(r["n"] == r["m"] for r in got)
    assert [r["n"] for r in got[:3]] == ["", "", "hé thé x_1"]


@pytest.mark.parametrize("text, want", [("roger", False), ("thank you", False), ("standby", False), ("ah stand by", True), ("roger turn left", True), (None, False), ("", False)])
def test_trainable(spark, text, want):
    assert one(spark, tx.trainable(F.col("t")), t=text) is want


def test_callsign_runs(spark):
    t = lambda s: one(spark, tx.callsign_runs(tx.tokens(F.col("t"))), t=s)
    assert t("hansa nine bravo report echo kilo") == 2
    assert t("nine eight two two") == 0
    assert t("alpha") == 0
    assert t("") == 0


def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_word_errors_match_the_plain_program(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("abcdefg", k=rng.randint(0, 12))), " ".join(rng.choices("abcdefgé", k=rng.randint(0, 12)))) for _ in range(200)]
    big = " ".join(f"w{i}" for i in range(3000))
    rows += [(big, big + " x"), ("", ""), ("a", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", tx.word_errors(F.col("a"), F.col("b")).alias("e"), tx.wer(F.col("a"), F.col("b")).alias("w")).collect()
    for r in got[:-3]:
        assert r["e"] == plain_distance(r["a"].split(), r["b"].split())
    assert [r["e"] for r in got[-3:]] == [1, 0, 1]
    assert got[-2]["w"] is None
    assert one(spark, tx.wer(F.lit("one two three"), F.lit("one too three"))) == pytest.approx(1 / 3)


def test_undefined_recall_is_null(spark):
    assert one(spark, tx.token_recall(F.lit("climb now"), F.lit("x"), vocab.NUMERALS)) is None
    assert one(spark, tx.token_recall(F.lit("one two"), F.lit("two"), vocab.NUMERALS)) == 0.5
    assert one(spark, tx.pattern_recall(F.lit("climb"), F.lit("x"), "runway")) is None


def test_small_parsers(spark):
    assert one(spark, tx.recorded_at(F.lit("a/b_20201025_091112.wav"))) == "2020-10-25T09:11:12"
    assert one(spark, tx.recorded_at(F.lit("a/b_20201325_091112.wav"))) is None
    assert one(spark, tx.session_key(F.lit("x/gf1_02.wav"))) == "gf1"
    assert one(spark, tx.session_key(F.lit("x/solo.wav"))) == "solo"
    assert one(spark, tx.session_key(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.clock_seconds(F.lit("1:02:03"))) == 3723
    assert one(spark, tx.clock_seconds(F.lit("?"))) is None
    assert one(spark, tx.human_size(F.lit(2_500_000_000))) == "2.3 GB"
    assert one(spark, tx.human_size(F.lit(12))) == "12.0 B"
    c = one(spark, tx.config_parts(F.lit("medium/ct2-int8/cpu-4t")))
    assert (c["model"], c["backend"], c["device"], c["threads"]) == ("medium", "ct2-int8", "cpu", 4)
    u = one(spark, tx.store_uri(F.lit("s3://bucket/a/b/")))
    assert (u["bucket"], u["key"]) == ("bucket", "a/b")
    calls = one(spark, tx.tool_calls(F.lit("x <function=add>\n<parameter=text>\nab c\n</parameter><parameter=label>RUNWAY</parameter></function> <function=done></function>")))
    assert [(c["name"], c["params"]) for c in calls] == [("add", {"text": "ab c", "label": "RUNWAY"}), ("done", {})]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_text_columns_take_anything(spark, texts):
    df = spark.createDataFrame([(t.replace("\x00", ""),) for t in texts], "t string")
    assert df.select(*tx.features(F.col("t")), tx.digits_to_words(F.col("t")), tx.strip_greetings(F.col("t"))).count() == len(texts)
