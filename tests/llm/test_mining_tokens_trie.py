"""Hard negatives, rank-file BPE and the conversation trie against brute force, a library and edge cases."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import catalog, mining, ranked, trie
from tests.llm import brute

VECTORS = "vec_id long, embedding array<double>, label int"
TURNS = "conv_id long, turn long, role string, text string"


def mined(df):
    return [tuple(r) for r in mining.hard_negatives(df, anchors=F.col("id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def in_order(rows):
    return sorted(rows, key=repr)


# --- op11


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block):
    """Ties, repeated ids and rows, a hot label, nulls, lengths of their own; also with many small cells."""
    monkeypatch.setattr(mining, "CANDIDATES", block)
    monkeypatch.setattr(mining, "ANCHORS", 4 if block == 40 else 1 << 11)
    r = random.Random(3)
    rows = [(i, [r.choice([0.25, 0.5, 0.51, -0.2]) for _ in range(4)], 1 if i % 3 == 0 else r.randint(0, 4)) for i in range(0, 700, 2)]
    rows += [(100, [0.5] * 4, 1), (100, [0.5] * 4, 1), (7, [0.5, 0.25, 0.5, 0.5], 2), (7, [0.5, 0.25, 0.5, 0.5], 2)]
    rows += [(800, [0.5, 0.5], 1), (801, [0.5, 0.4], 1), (802, [0.5, 0.3], 2), (900, [], 0), (901, [], 0), (903, [], 1), (None, [0.5] * 4, 3), (None, [0.5] * 4, 3)]
    rows += [(1000, None, 1), (1100, [0.5] * 4, None), (1200, [0.5, None, 0.5, 0.5], 1), (1300, [0.5, float("nan"), 1.0, 1.0], 1), (1400, [float("inf")] * 4, 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = brute.hard_negatives(rows)
    assert want and in_order(mined(df)) == in_order(want)


def test_hard_negatives_exact_beyond_double(spark):
    """Scores near 2**60 differ by one: floating point would call them equal."""
    big = 2.0**22 - 1  # scaled to just below 2**30
    rows = [(0, [big, 1.0], 1), (1, [big, 0.5], 1), (2, [big, 0.25], 2), (3, [big, 0.5], 2), (4, [big, 0.50390625], 2), (5, [1e9, 0.0], 2), (6, [3.0, 1.0], 3)]
    got = mined(spark.createDataFrame(rows, VECTORS))
    assert in_order(got) == in_order(brute.hard_negatives([r for r in rows if r[0] != 5]))
    assert [r[3] for r in sorted(got, key=lambda r: r[2])] == [3, 2]


def test_hard_negatives_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], VECTORS)
    assert mined(df) == []
    rows = [(0, [1.0], 1, "x"), (1, [1.0], 1, "x"), (2, [0.9], 0, "x")]
    df = spark.createDataFrame(rows, "`vec.id` long, embedding array<float>, label int, node string").withColumns({c: F.lit("k") for c in ("id", "v", "i", "j", "a", "score")})
    got = mining.hard_negatives(df, anchors=F.col("id") % 100 == 0, id_col="vec.id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_hard_negatives_query_changes_labels(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)], r.randint(0, 9)) for i in range(300)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert in_order(tuple(x) for x in got.collect()) == in_order(brute.hard_negatives([(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]))


# --- op12


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def model():
    return ranked.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def ids_of(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_ids_equal_the_library(library, model):
    r = random.Random(1)
    parts = ["a", "b", "the", "in", " ", "  ", "\n", "é", "ß", "漢", "🙂", "́", "0", "12", ".", "'s", "\t", "\xa0", "\x1c", "\x85", "​", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [f"a{chr(c)}{chr(c)} b1{chr(c)}" for c in range(0x3000)]
    got = model.encode_batch(texts)
    assert got == [ids_of(library, t) for t in texts]
    assert [model.decode(x) for x in got] == [t.encode() for t in texts]


def test_short_and_long_trees_agree(library, model):
    r = random.Random(2)
    for n in (2, 3, 5, 17, 63, 64, 65, 128, 129, 1000):
        word = "".join(r.choice("abehinost") for _ in range(n))
        if word.encode() not in model.ids:
            assert model.merge_long(word.encode()) == ids_of(library, word)
            if n <= 64:
                assert model.merge_short([word.encode()] * 3, 64) == [ids_of(library, word)] * 3
    for text in ("a" * 30_000, " " * 20_000 + "x", "".join(r.choice("abcdefghij") for _ in range(50_000))):
        assert model.encode_batch([text]) == [ids_of(library, text)]


def test_ranked_round_trip(spark, library):
    rows = [(1, "Hello, <|endoftext|> wörld"), (1, "Hello, <|endoftext|> wörld"), (2, None), (3, ""), (None, " a b"), (4, "xy" * 20_000)]
    df = spark.createDataFrame(rows, "`doc.id` long, text string").withColumns({c: F.lit("k") for c in ("id", "x", "ids", "n_tokens")})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = ranked.ranked_round_trip(df, path, public_tokenizers.PATTERN, id_col="doc.id").collect()
    want = [(i, len(x) // 4, brute.sha(x), brute.sha((t or "").encode())) for i, t in rows for x in [ids_of(library, t or "")]]
    assert in_order(map(tuple, got)) == in_order(want)
    encoded = ranked.encode_ranked(df, path, public_tokenizers.PATTERN, id_col="doc.id")
    back = ranked.decode_ranked(encoded, path, public_tokenizers.PATTERN, id_col="doc.id").collect()
    assert in_order((r[0], bytes(r[1])) for r in back) == in_order((i, (t or "").encode()) for i, t in rows)
    assert ranked.ranked_round_trip(df.limit(0), path, public_tokenizers.PATTERN, id_col="doc.id").count() == 0


# --- op13


def nodes(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    got = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("block", [1 << 12, 2])
def test_trie_against_brute_force(spark, monkeypatch, block):
    """Shared beginnings, whole copies, hot first turns, absent and short bases, gaps, null and tied turns; also with small blocks."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PIECE", 3)
    r = random.Random(4)
    rows = []
    for c in [*range(-12, 60), *range(100, 400, 7)]:
        if c % 10 == 5:
            continue
        n = r.choice([1, 2, 5, 9, 14])
        kind = r.randint(0, 3)
        for t in range(n):
            text = "hello" if t < kind else r.choice(["x", "yé", f"z{t}"]) if kind < 3 else f"t{t}"
            rows.append((c, r.choice([t, t, t // 2]) if c % 9 == 0 else t, r.choice(["user", None]) if kind == 1 else "user", text))
    rows += [(500, i, "user", f"line {i}") for i in range(40)] + [(505, i, "user", f"line {i}") for i in range(41)]
    rows += [(510, None, "a", "b"), (510, None, "a", "a"), (510, 0, None, None), (510, 0, None, None), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert nodes(trie.conversation_trie(df)) == brute.trie(rows)


def test_trie_of_few_conversations(spark):
    frame = lambda rows: spark.createDataFrame(rows, TURNS)
    assert nodes(trie.conversation_trie(frame([]))) == {}
    one = [(3, i, "u", "t") for i in range(20)]
    assert nodes(trie.conversation_trie(frame(one))) == brute.trie(one)
    two = [(1, 0, "u", "a"), (2, 0, "u", "b")]  # both lose their only turn: the root alone
    got = nodes(trie.conversation_trie(frame(two)))
    assert got == brute.trie(two)
    ended = [(5, 0, "u", "same"), (10, 0, "u", "same"), (10, 1, "u", "more")]  # one ends where the other goes on
    assert nodes(trie.conversation_trie(frame(ended))) == brute.trie(ended)


def test_trie_of_one_hot_conversation(spark):
    """A third of all rows in one conversation, in text of every length, with columns of clashing names."""
    rows = [(0, i, "u", "w" * (i % 7)) for i in range(600)] + [(c, i, "u", f"{c} {i}") for c in range(1, 301) for i in range(4)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("c", "d", "key", "n", "part", "length")}).repartition(4)
    assert nodes(trie.conversation_trie(df)) == brute.trie(rows)
