"""Ids whose column has a dot in its name, and benchmark items without an id."""

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, dedup, lm
from tests.llm import brute

TEXT = " ".join(f"w{i}" for i in range(30))


def test_dotted_ids(spark):
    df = spark.createDataFrame([(1, TEXT), (2, TEXT), (3, "a b"), (4, None)], "`doc.id` long, text string")
    ids = lambda out: sorted(r[0] for r in out.collect())
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.bpe_encode(df, path, id_col="doc.id")
    assert ids(encoded) == ids(bpe.bpe_decode(encoded, path, id_col="doc.id")) == [1, 2, 3, 4]
    assert ids(dedup.substring_dedup(df, 20, id_col="doc.id").filter("n_removed > 0")) == [2]
    assert ids(dedup.suffix_array_dedup(df, 50, id_col="doc.id").filter("n_removed > 0")) == [1, 2]
    assert ids(lm.score_texts(df, F.col("id") == 3, id_col="doc.id")) == [1, 2, 3, 4]


def test_items_without_ids_hit_words(spark):
    docs = [(1, "a b c"), (2, "x y"), (3, None)]
    items = [(None, "a b"), (None, "B c"), (5, "x"), (6, None)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "`doc.id` long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10, id_col="doc.id")
    assert {r["doc.id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()} == {1: (3, 3, [None]), 2: (2, 1, ["5"]), 3: (0, 0, [])}
    digest = got.select(F.col("`doc.id`").alias("i"), F.sha2(F.concat_ws(",", "items"), 256).alias("s"), F.size("items").alias("n"))
    assert {tuple(r) for r in digest.collect()} == {(1, brute.sha(b""), 1), (2, brute.sha(b"5"), 1), (3, brute.sha(b""), 0)}
