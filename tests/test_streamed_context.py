"""Contexts over a stream against those of the batch operator."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.folds import sentence_context
from tessera.streaming import flows
from tessera.streaming.context import ROCKSDB, Fold, streamed_context

COLS = "id long, timeline string, start double, text string, sentence string, sentence_char double, split string"


def words(seed: int = 8) -> list[tuple]:
    r, out = random.Random(seed), []
    for line in ("a", None, "b"):
        for k in range(60):
            sentence = r.choice(["one. ", "two words ", "x", "three short words. ", " ", "", None])
            for at in range(r.randint(1, 3)):
                place = None if r.random() < 0.1 else float(at - k % 2)
                out.append((len(out), line, float(len(out) // 2), r.choice(["w", "é", None]), sentence, place, r.choice(["p"] * 6 + ["q", None])))
    return out


@pytest.mark.parametrize("most", [0, 2, 5])
def test_fold_equals_the_batch_operator(spark, most):
    w = [x for x in words() if x[3] is not None]
    want = {r["id"]: r["context"] for r in sentence_context(spark.createDataFrame(w, COLS), most).collect()}
    got = {}
    for line in ("a", None, "b"):
        fold = Fold(most)
        got.update({x[0]: fold.word(*x[3:]) for x in sorted(w, key=lambda x: x[2:1:-1] + (x[0],)) if x[1] == line})
    assert got == want


def test_stream_equals_batch_and_leaves_out_late_words(spark, tmp_path):
    w = [x for x in words(5) if x[3] is not None]
    df = spark.createDataFrame(w, COLS)
    r = random.Random(2)
    # words come up to 20 seconds out of order, in five files; then words far ahead, and one that is far too late
    order = sorted(w, key=lambda x: x[2] + r.random() * 20)
    files = [order[i * len(order) // 5 : (i + 1) * len(order) // 5] for i in range(5)]
    end = [(-1, "end", 1e6, "w", "w", 0.0, "p")]
    folder, schema = str(tmp_path / "in"), df.withColumn("ts", F.timestamp_seconds(F.col("start") + 1000)).schema
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for f in [*files, end, [(9999, "a", 1.0, "w", "late", 0.0, "p")]]:
            spark.createDataFrame(f, COLS).withColumn("ts", F.timestamp_seconds(F.col("start") + 1000)).coalesce(1).write.mode("append").parquet(folder)
            flows.poll(streamed_context(flows.source(spark, folder, schema), 3, "25 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = [(x["id"], x["context"]) for x in spark.read.schema("id long, context string").parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted((x["id"], x["context"]) for x in sentence_context(df, 3).collect())
