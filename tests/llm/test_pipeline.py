"""The pipeline against the plain versions of its stages, and the registered queries on the smallest tables."""

import pytest

import corpus_pipeline
from tessera import session
from tessera.llm import catalog
from tests.llm import brute
from tests.oracle import both, database

SF = "/root/testdata/sf0.001"


def test_stages_after_the_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    near = brute.near_duplicates([(d, r.text) for d, r in rows.items()])
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(left) == {d for d, x in near.items() if x[2]}
    cut = corpus_pipeline.cut_repeats(spark, kept, SF)
    assert cut.columns == docs.columns
    want = brute.byte_dedup(list(left.items()), 200)
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == set(want) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(len(got[d].text.encode()) <= n - gone and (gone or got[d].text == left[d]) for d, (n, gone, _, _) in want.items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.decontaminate([(d, r.text) for d, r in got.items()], items, 10)
    clean = corpus_pipeline.drop_contaminated(spark, cut, SF)
    assert {r.doc_id for r in clean.collect()} == {d for d, x in hit.items() if not x[1]}
    last = {r.doc_id: r for r in corpus_pipeline.encode(spark, clean, SF).collect()}
    assert all(last[d].decoded_sha256 == brute.sha(got[d].text.encode()) for d in last)


def test_stages_keep_rows_that_share_an_id_or_have_none(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 10)
    rows = [(None, "one clean text", "a"), (None, "another clean text", "b"), (None, f"x {item} y", "c"), (7, "the first of id seven", "d"), (7, "the second of id seven", "e"), (7, "the second of id seven", "e"), (8, "a text", "f")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    of = lambda df: sorted((str(r.doc_id), r.text, r.lang) for r in df.collect())
    cut = corpus_pipeline.cut_repeats(spark, docs, SF)
    assert cut.columns == docs.columns and of(cut) == sorted({(str(i), t, lang) for i, t, lang in rows})
    assert of(corpus_pipeline.drop_contaminated(spark, docs, SF)) == sorted((str(i), t, lang) for i, t, lang in rows if lang != "c")


def test_classifier_stage_keeps_what_the_model_scores(spark):
    """Every document scored by itself, outside Spark, with the stage's own model."""
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    from tessera.llm import quality

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    model = quality.train_quality(docs, labels.filter(F.col("doc_id").isin([r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5])))
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    score = {d: model.score(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for d, b in raw.items()}
    assert {r.doc_id for r in kept.collect()} == {d for d, x in score.items() if x >= 0.3}


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """No rows at all; null and empty texts, repeated rows, clashing columns, and one very long text."""
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, d long, kept_text string, score double"
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, long, "en", "s", len(long)), (None, None, None, None, None)]
    for some in ([], [(*r, 9, "k", 0.5) for r in rows]):
        docs = spark.createDataFrame(some, kinds)
        for name, stage in corpus_pipeline.STAGES:
            docs = session.table(stage(spark, docs, str(tmp_path)))
            if name != "BPE encoding and decoding":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()) == ([(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)] if some else [])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and "n_tokens" in out.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        mine, theirs = both(df, database(SF), catalog.ORACLE_SQL[name])
        assert mine == theirs
    else:
        table = "embeddings" if name.startswith("op6") else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
