"""The corpus operators against brute force, libraries and edge cases."""

import pathlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tessera.llm import bpe, decontaminate, dedup, embed, license, lm, neardup, quality, repeats, rlz, skew, suffix, unigram
from tessera.llm.graph import components
from tessera.session import table, tables_dir
from tests.llm import brute

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "ré", "st") for b in ("ta", "ro", "Ne", "xi", "pu")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, periodic, empty, null and long texts."""
    r = random.Random(seed)
    passage, line = prose(r, 70), prose(r, 12)
    texts: list[str | None] = [None, "", "one", "   ", "ab " * 400, prose(r, 3000)]
    base = [prose(r, r.randint(20, 160)) for _ in range(n)]
    for i, t in enumerate(base):
        if i % 5 == 0:
            w = t.split(" ")
            w[len(w) // 2] = "edited"
            texts += [t, " ".join(w)]
        elif i % 5 == 1:
            texts.append(f"{t} {passage} {prose(r, 15)}")
        elif i % 5 == 2:
            texts += [t, t, t]
        elif i % 5 == 3:
            texts.append(f"{line} {t}")
        else:
            texts.append(t)
    r.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def as_dict(df) -> dict:
    return {r[0]: tuple(r[1:]) for r in df.collect()}


# --- engines


@pytest.mark.parametrize("small", [0, 1024])
def test_suffix_array_and_prefixes(small, monkeypatch):
    monkeypatch.setattr(suffix, "SMALL_ALPHABET", small)
    r = np.random.default_rng(3)
    for trial in range(120):
        t = r.integers(1, 4, int(r.integers(1, 50)))
        t = np.r_[np.repeat(t, r.integers(1, 5)) if trial % 3 == 0 else t, 0]
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix.suffix_array(t)
        assert sa.tolist() == want
        phi, plcp = suffix.common_prefixes(t, sa)
        for i, p in enumerate(phi.tolist()):
            k = 0
            while p >= 0 and max(i, p) + k < len(t) and t[i + k] == t[p + k]:
                k += 1
            assert plcp[i] == k


def test_shard_engines():
    r = np.random.default_rng(4)
    for _ in range(150):
        spans = [r.integers(0, 2, int(r.integers(1, 20))).astype(np.uint8) for _ in range(int(r.integers(1, 6)))]
        u, b, n = np.concatenate(spans), np.r_[0, np.cumsum([len(s) for s in spans])], int(r.integers(2, 6))
        where: dict[bytes, list[int]] = {}
        for x, y in zip(b, b[1:], strict=False):
            for i in range(x, y - n + 1):
                where.setdefault(u[i : i + n].tobytes(), []).append(int(i))
        group = np.zeros(len(spans), int)
        assert suffix.shared_windows(u, b, group, n, False).tolist() == sorted(i for v in where.values() if len(v) > 1 for i in v)
        assert rlz.shared_windows(u.astype(np.uint64), b, group, n, True).tolist() == sorted(i for v in where.values() for i in v[1:])


# --- op1, op5


@pytest.mark.parametrize("hot", [500, 1])
def test_dedups_against_brute_force(spark, monkeypatch, hot):
    """With HOT at 1 every shared anchor is crowded."""
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus()
    df = frame(spark, docs)
    assert as_dict(dedup.substring_dedup(df, 20).select("doc_id", "n_units", "n_removed", "kept_sha256")) == brute.substring_dedup(docs, 20)
    assert as_dict(dedup.suffix_array_dedup(df, 200).select("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")) == brute.byte_dedup(docs, 200)


def test_dedup_keys_and_clashing_columns(spark):
    """Repeated rows are documents of their own; null and equal ids work; other columns may have any names."""
    t, u = " ".join(f"w{i}" for i in range(30)), "x y z"
    df = spark.createDataFrame([(1, t, 5, "k"), (1, t, 5, "k"), (None, t, 6, "k"), (1, u, 7, "k")], "doc_id long, text string, d long, kept_text string")
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in dedup.substring_dedup(df, 20, text=True).select("doc_id", "n_units", "n_removed", "kept_text").collect())
    assert got == [(False, 1, 3, 0, u), (False, 1, 30, 30, ""), (False, 1, 30, 30, ""), (True, 0, 30, 0, t)]
    assert dedup.suffix_array_dedup(df.limit(0)).count() == 0
    again = frame(spark, [(1, t), (1, t), (1, u), (2, t)])
    assert sorted((r[0], r[1]) for r in dedup.substring_dedup(again, 20).select("doc_id", "n_removed").collect()) == [(1, 0), (1, 0), (1, 30), (2, 30)]
    size = len(t)
    assert sorted((r[0], r[1]) for r in dedup.suffix_array_dedup(again, 50).select("doc_id", "n_removed").collect()) == [(1, 0), (1, size), (1, size), (2, size)]


def test_words_of_a_regular_build_have_hashes_of_their_own(spark):
    """The word that spells the Thue-Morse sequence and its complement: sums modulo a power of two make them equal."""
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    c = w.translate(str.maketrans("ab", "ba"))
    one, other = (" ".join(f"w{i}" if i != 9 else x for i in range(20)) for x in (w, c))
    df = frame(spark, [(1, one), (2, other), (3, one)])
    assert {r[0]: r[1] for r in dedup.substring_dedup(df, 20).select("doc_id", "n_removed").collect()} == {1: 0, 2: 0, 3: 20}
    near = neardup.near_duplicates(df.withColumn("text", F.split("text", " ")[9]))
    assert {r["doc_id"]: r["component_id"] for r in near.collect()} == {1: 1, 2: 2, 3: 1}
    hits = decontaminate.decontaminate(df, spark.createDataFrame([("x", w)], "item_id string, text string"), 10)
    assert {r["doc_id"]: r["n_hit"] for r in hits.collect()} == {1: 1, 2: 0, 3: 1}
    scores = {r["doc_id"]: r["n_known"] for r in lm.score_texts(df, F.col("id") == 2).collect()}
    assert (scores[1], scores[2]) == (21, 20)


# --- op2


def test_decontamination(spark):
    r = random.Random(5)
    items = [(i, prose(r, 40)) for i in range(12)] + [(90, None), (91, ""), (92, "solo"), (93, "two words")]
    docs = corpus(6, 30)
    docs += [(1000 + i, f"{prose(r, 20)} {' '.join(t.split()[5:18])} {prose(r, 9)}") for i, t in items[:12]] + [(2000, "a SOLO act; two-words"), (2001, items[0][1])]
    want = brute.decontaminate(docs, items, 10)
    for block in (10_000, 60):  # one block of test items, and several
        got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 10, block_words=block)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()} == want


def test_decontamination_proximity_and_empty_tables(spark):
    docs = frame(spark, [(1, "alpha beta extra gamma delta"), (2, "alpha nothing")])
    tests = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    hits = lambda **k: {r[0]: r[1] for r in decontaminate.decontaminate(docs, tests, 4, **k).select("doc_id", "items").collect()}
    assert hits() == {1: [], 2: []} and hits(slop=1) == {1: ["7"], 2: []}
    assert [r["n_hit"] for r in decontaminate.decontaminate(docs, tests.limit(0), 4).collect()] == [0, 0]
    assert decontaminate.decontaminate(docs.limit(0), tests, 4).count() == 0


# --- op3


def test_licenses(spark):
    s = license.SENTENCES
    wrapped = s["mit-grant"].replace(" ", "\n", 7) + "\n\n" + s["mit-notice"] + "\nsome words.\n" + s["mit-warranty"]
    far = s["bsd-grant"] + "\n" + "x.\n" * 9 + s["bsd-source"] + "\n" + s["bsd-binary"]
    docs = [(1, wrapped), (2, s["mit-notice"] + "\n" + s["mit-grant"]), (3, far), (4, "hello. " + s["apache2-short"].upper() + " bye"), (5, None), (6, ""), (7, " ".join(s[k] for k in ("gpl3-free", "gpl-hope", "gpl-see")))]
    got = {r["doc_id"]: r["licenses"] for r in license.scan_licenses(frame(spark, docs)).collect()}
    assert got == {1: ["MIT"], 2: [], 3: [], 4: ["Apache-2.0"], 5: [], 6: [], 7: ["GPL-3.0-or-later"]}
    assert license.scan_licenses(frame(spark, docs).limit(0)).count() == 0


def test_licenses_against_brute_force(spark):
    """Sentences and rules found by trying everything, on texts with wraps, noise, repeated rows and clashing columns."""
    r = random.Random(31)
    keys = sorted(license.SENTENCES)
    docs = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 9)):
            if r.random() < 0.3:
                parts.append(prose(r, r.randint(1, 5)))
            else:
                _, order = r.choice(license.RULES) if r.random() < 0.5 else (0, (r.choice(keys),))
                parts += [license.SENTENCES[k].upper() if r.random() < 0.3 else license.SENTENCES[k].replace(" ", r.choice([" ", "\n", "\n * "]), r.randint(0, 9)) for k in order]
        docs.append((i % 50, r.choice(["\n", " ", "\n\n"]).join(parts)))
    docs.append((99, "All rights reserved. " * 4000 + license.SENTENCES["mit-short"]))
    want = sorted((d, *brute.licenses(t, license)) for d, t in docs)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, licenses string, n_known int").repartition(3)
    got = sorted((x["doc_id"], x["n_sentences"], x["sentence_ids"], x["licenses"]) for x in license.scan_licenses(df).collect())
    assert got == want
    assert {name for _, _, _, names in got for name in names} > {"MIT", "AGPL-3.0-or-later", "ISC"}


# --- op4


def test_quality_learns_and_scores_whole_texts(spark):
    r = random.Random(8)
    rows = [(i, prose(r, 60) if i % 2 else prose(r, 60).upper().replace(" ", "!! ")) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    df = frame(spark, [*rows, (900, None), (901, ""), (902, prose(r, 4000))])
    model = quality.train_quality(df, labels, sample=120, allowed=F.col("_id") < 160)
    score = {r[0]: r[1] for r in quality.score_quality(df, model).collect()}
    assert len(score) == 243 and all(0 <= s <= 1 for s in score.values())
    held = [i for i in range(160, 240)]
    assert np.mean([(score[i] >= 0.3) == bool(i % 2) for i in held]) > 0.95
    assert quality.train_quality(df, labels.limit(0)).score(np.zeros(3, np.uint8), np.array([0, 3])).tolist() == [0.5]
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_quality_scores_whole_texts_as_plain_loops_do():
    """Each place and chunk of a text one by one; all bytes of a text, also the last ones, are in some place."""
    r = np.random.default_rng(8)
    model = quality.ByteCnn(3)
    model.w = {k: (v + r.normal(0, 0.2, v.shape)).astype("f4") for k, v in model.w.items()}
    w = {k: v.astype("f8") for k, v in model.w.items()}
    for n in (0, 1, 7, 8, 9, 11, 159, 160, 161, 312, 313, 700):
        raw = r.integers(0, 256, n).astype(np.uint8)
        hidden, seen = [], set()
        at = 0
        while True:
            chunk = raw[at : at + quality.CHUNK]
            size = max(quality.WIDTH, len(chunk) + (len(chunk) % 2))
            padded = np.r_[chunk, np.zeros(size - len(chunk), np.uint8)]
            acts = []
            for p in range(0, size - quality.WIDTH + 1, quality.STEP):
                seen |= set(range(at + p, at + p + quality.WIDTH))
                acts.append(np.maximum(w["embed"][padded[p : p + quality.WIDTH]].ravel() @ w["conv"] + w["bias"], 0))
            v = np.r_[np.max(acts, 0), np.mean(acts, 0), np.log2(len(acts)) / 3]
            hidden.append(np.maximum(v @ w["hidden"] + w["shift"], 0))
            at += quality.CHUNK - quality.OVERLAP
            if at + quality.OVERLAP >= n:
                break
        z = np.r_[np.max(hidden, 0), np.mean(hidden, 0)] @ w["out"] + w["base"][0]
        assert seen >= set(range(n))
        assert model.score(raw, np.array([0, n]))[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_quality_gradients():
    model = quality.ByteCnn(1)
    data = np.frombuffer(prose(random.Random(1), 90).encode(), np.uint8)
    off, y, w = np.array([0, 200, len(data)]), np.array([1.0, 0.0], "f4"), np.ones(2, "f4")
    model.w = {k: v.astype("f8") for k, v in model.w.items()}
    grad = model.gradients(data, off, y, w)

    def loss():
        p = model.score(data, off)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in model.w:
        flat = model.w[name].reshape(-1)
        at = int(np.abs(grad[name]).reshape(-1).argmax())
        was = flat[at]
        flat[at] = was + 1e-3
        up = loss()
        flat[at] = was - 1e-3
        down = loss()
        flat[at] = was
        assert abs((up - down) / 2e-3 - grad[name].reshape(-1)[at]) < 0.05 * abs(grad[name].reshape(-1)[at]) + 2e-4, name


# --- op6


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    near = [base[i % 6] + r.normal(size=16) * 0.06 for i in range(400)]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate([*base, *near, *near[:20]])]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [None, *[1.0] * 15], 1), (2003, [float("nan"), *[1.0] * 15], 1), (2004, [1.0] * 16, None), (2005, [1.0, 2.0], 1), (2006, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    ids, x, lab = [r[0] for r in rows[:-7]], np.array([r[1] for r in rows[:-7]]), np.array([r[2] for r in rows[:-7]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(len(u), dtype=bool)
    root = brute.components([r[0] for r in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    n = dict(zip(ids, link.sum(1).tolist(), strict=True))
    got = as_dict(embed.near_duplicate_vectors(df, sample=200))
    assert got == {r[0]: (n.get(r[0], 0), root[r[0]], root[r[0]] == r[0]) for r in rows}
    assert embed.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_with_repeated_ids(spark):
    """Different vectors, also of different lengths, under one id are vectors of their own; other columns may have any names."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 1.0, 0.01, 0.0]
    rows = [(1, a, 1, 0), (1, b, 1, 0), (2, a, 1, 0), (3, c, 1, 0), (4, [1.0, 2.0], 1, 0), (4, [1.0, 2.0, 3.0], 1, 0), (4, [1.0, 2.1], 1, 0), (9, a, 2, 0), (1, a, 2, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")
    got = sorted(tuple(r) for r in embed.near_duplicate_vectors(df).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 0, 4, True), (4, 1, 4, True), (9, 1, 1, False), (1, 1, 1, True)])


def plain_links(rows: list[tuple]) -> dict:
    """What the operator returns for (id, vector, label), by all pairs."""
    u, lab = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(len(u), dtype=bool)
    root = brute.components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(link), strict=True)])
    return {r[0]: (int(n), root[r[0]], root[r[0]] == r[0]) for r, n in zip(rows, link.sum(1), strict=True)}


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_short_vectors(spark, dim):
    """A code of fewer bits than tables has fewer substrings, so that a pair may differ more in each."""
    r = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(r.normal(size=(300, dim)))]
    assert as_dict(embed.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == plain_links(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_in_many_groups(spark, monkeypatch, kind):
    """A label of several groups: near copies, chains and copies whose links go through blocks of other groups."""
    monkeypatch.setattr(embed, "SHARE", 10_000)
    r = np.random.default_rng(6)
    step = np.cumsum(r.normal(size=(150, 12)) * 0.05, axis=0) + r.normal(size=12)
    v = np.concatenate([step, r.normal(size=12) + r.normal(size=(200, 12)) * 0.03, r.normal(size=(200, 12))]).astype("f4")
    rows = [(int(i), [float(x) for x in v[i]], int(i == 7)) for i in r.permutation(len(v))]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)]
    assert as_dict(embed.near_duplicate_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(5))) == plain_links(rows)


def test_vectors_of_small_labels_share_blocks(spark, monkeypatch):
    """Small labels beside one of several groups: near vectors of different labels do not link."""
    monkeypatch.setattr(embed, "SHARE", 10_000)
    r = np.random.default_rng(9)
    base = r.normal(size=(30, 12))
    rows = [(i, [float(x) for x in base[r.integers(30)] + r.normal(size=12) * 0.05], "many" if i % 3 else str(r.integers(120))) for i in range(900)]
    assert as_dict(embed.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(5))) == plain_links([(i, np.array(v, "f4").astype("f8"), label) for i, v, label in rows])


def test_vectors_are_not_sent_for_each_code(spark):
    """Vectors without near ones: what goes to disk is a few times the vectors, not hundreds of entries for each."""
    root = pathlib.Path(str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0]))
    folder = pathlib.Path(tables_dir(spark))
    size = lambda: sum(p.stat().st_size for top in (root, folder) for p in top.rglob("*") if p.is_file())
    x = np.random.default_rng(8).normal(size=(4000, 64)).astype("f4")
    df = table(spark.createDataFrame(pd.DataFrame({"vec_id": range(4000), "embedding": x.tolist(), "label": [1] * 4000})).withColumn("embedding", F.col("embedding").cast("array<float>")))
    before = size()
    embed.near_duplicate_vectors(df).write.format("noop").mode("overwrite").save()
    assert size() - before < 8 * x.nbytes


# --- op7


TEXTS = ["", "don't we'll I'VE 123 45a6", "a<|endoftext|>b  <|endoftext|>", "日本語 テスト 🎉🎉 ​\n\n  x", "é" * 500, " \t\n ", "!!!!" * 200, "aaaaaaaa" * 40, prose(random.Random(3), 2000), "²½ x y ́"]


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)
    model = bpe.load(path)
    for t, w, ids in zip(TEXTS, want, model.encode_batch(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids, t
        assert model.decode(ids) == t
    df = frame(spark, [*enumerate(TEXTS), (99, None)])
    back = as_dict(bpe.bpe_decode(bpe.bpe_encode(df, path), path))
    assert back == {**{i: (t,) for i, t in enumerate(TEXTS)}, 99: ("",)}
    assert bpe.bpe_round_trip(df.limit(0), path).count() == 0


# --- op8


def test_language_model(spark):
    docs = [(i, t) for i, t in corpus(11, 40) if True]
    df = frame(spark, docs)
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2
    got = as_dict(lm.score_texts(df, held))
    cut = {d: [*brute.WORDS.findall((t or "").encode().translate(brute.LOW)), None] for d, t in docs}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in cut}
    from collections import Counter

    c = Counter(w for d, ws in cut.items() if not out[d] for w in ws)
    total, v = sum(c.values()), len(c)
    for d, ws in cut.items():
        base = sum(np.log10((c[w] + 1) / (total + v + 1)) for w in ws)
        assert got[d][:4] == (out[d], len(ws), sum(c[w] > 0 for w in ws), total)
        assert got[d][4] == pytest.approx(base) and got[d][5] < 0
    assert lm.score_texts(df.limit(0), held).count() == 0


def test_language_model_scores_against_brute_force(spark):
    """The score from plain counts: only the exchange of the units is the operator's own."""
    docs = [*corpus(19, 30), (500, "never seen wordsqz here"), *((600 + i, " ".join(f"v{(i * 37 + k) % 500}x" for k in range(90))) for i in range(12))]
    held = F.col("id") % 4 == 1
    got = as_dict(lm.score_texts(frame(spark, docs), held))
    want = brute.class_model_scores(docs, lambda d: d % 4 == 1, lm)
    assert {d: got[d][5] for d in got} == {d: pytest.approx(x) for d, x in want.items()}
    assert all(x[6] == pytest.approx(10 ** (-x[5] / x[1])) for x in got.values())


def test_language_model_counts_every_row(spark):
    rows = [(1, "x y", "k", 5), (1, "x y", "k", 5), (2, "z", "k", 5), (None, "z", "k", 5), (None, None, "k", 5)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held string, d int"), F.lit(False)).collect()
    assert len(got) == 5 and {r["train_tokens"] for r in got} == {3 + 3 + 2 + 2 + 1}
    assert sorted(r["n_tokens"] for r in got) == [1, 2, 2, 3, 3]


def test_further_words_are_clustered_by_their_own_contexts(spark, monkeypatch):
    """Rare words of one ending that follow different frequent words score best in the contexts that they had."""
    monkeypatch.setattr(lm, "exchange_classes", lambda counts: np.r_[np.minimum(np.arange(lm.UNITS - 1), 20), lm.CLASSES - 1])
    r = random.Random(17)
    left, right = [f"l{i}ing" for i in range(30)], [f"r{i}ing" for i in range(30)]
    docs = [(i, " ".join(x for _ in range(20) for x in (("pp", "aa", r.choice([*left, *["lo"] * 30]), "bb", "qq") if r.random() < 0.5 else ("ss", "cc", r.choice([*right, *["ro"] * 30]), "dd", "tt")))) for i in range(60)]
    docs += [(100 + i, " ".join(r.sample([f"f{k}x" for k in range(400)], 400))) for i in range(50)]  # the frequent words
    docs += [(1000, f"pp aa {left[0]} bb qq " * 20), (1001, f"pp aa {right[0]} bb qq " * 20)]
    got = as_dict(lm.score_texts(frame(spark, docs), F.col("id") >= 1000))
    known, other = (got[i][5] - got[i][4] for i in (1000, 1001))
    assert known > other + 5
    monkeypatch.setattr(lm, "TOP", 0)  # all classes by the join
    joined = as_dict(lm.score_texts(frame(spark, docs), F.col("id") >= 1000))
    assert {d: x[:4] for d, x in joined.items()} == {d: x[:4] for d, x in got.items()}
    assert all(joined[d][4:] == pytest.approx(got[d][4:]) for d in got)


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(1)
    kind = r.integers(0, 3, 60)
    counts = np.zeros((61, 61), np.int64)
    for a in range(60):
        for b in range(60):
            counts[a, b] = r.poisson(30 if kind[b] == (kind[a] + 1) % 3 else 1)
    owner = lm.exchange_classes(counts, 4)
    assert owner[-1] == 3 and len({(k, o) for k, o in zip(kind, owner[:-1], strict=True)}) == 3


# --- op9


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(12)
    docs = corpus(13, 60)
    base = prose(r, 120).split(" ")
    for i in range(120):  # a dense group of near copies
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(WORDS) + str(i)
        docs.append((5000 + i, " ".join(w)))
    assert as_dict(neardup.near_duplicates(frame(spark, docs))) == brute.near_duplicates(docs)


def test_near_duplicate_recall_at_the_threshold(spark):
    """Pairs just over the threshold: at least 0.98 of the links are found."""
    r = random.Random(14)
    docs = []
    for i in range(150):
        w = [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(160)]
        v = w[:138] + [f"new{i}x{k}" for k in range(22)]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = as_dict(neardup.near_duplicates(frame(spark, docs)))
    assert sum(got[2 * i + 1][1] == 2 * i for i in range(150)) >= 147


def test_near_duplicates_in_crowded_regions(spark):
    """Pairs just over the threshold among many documents that share a long passage and lie below it to each other."""
    r = random.Random(15)
    passage = prose(r, 200).split(" ")
    docs = []
    for i in range(450):  # 0.68 to all others
        own = [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(46)]
        docs.append((i, " ".join(passage + own)))
        if i < 150:  # 0.754 to document i
            docs.append((10**6 - i, " ".join(passage + own[:12] + [f"new{i}x{k}" for k in range(34)])))
    assert as_dict(neardup.near_duplicates(frame(spark, docs))) == brute.near_duplicates(docs)


@pytest.mark.parametrize("pairs", [300, 3000])
def test_near_duplicates_of_large_dense_groups(spark, pairs):
    """Pairs at 0.786 among documents that all share 174 words and lie at 0.739 to each other: every link is found."""
    r = random.Random(41)
    shared = [f"s{r.randrange(10**9)}" for _ in range(174)]
    docs = []
    for i in range(pairs):
        both = [f"p{i}x{k}" for k in range(6)]
        for side in (0, 1):
            own = [f"o{i}x{side}x{k}" for k in range(24)]
            docs.append((2 * i + side, " ".join([*shared, *both, *own])))
    got = as_dict(neardup.near_duplicates(frame(spark, docs)))
    assert sum(got[2 * i + 1][1] == 2 * i == got[2 * i][1] for i in range(pairs)) == pairs


@pytest.mark.parametrize(("blocks", "rare"), [(1, 16), (7, 2), (512, 1), (512, 100)])
def test_links_of_crowded_classes_are_exact(spark, monkeypatch, blocks, rare):
    """Each class has a label of its own, so every link must come out."""
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", blocks)
    monkeypatch.setattr(neardup, "RARE", rare)
    r = random.Random(16)
    sets = {i: set(range(40)) - set(r.sample(range(40), r.randint(0, 12))) | {1000 * i + k for k in range(r.randint(0, 8))} for i in range(1, 60)}
    rows = [(i, i, bytes(r.randrange(256) for _ in range(96)), np.array(sorted(x), np.uint64).tobytes()) for i, x in sets.items()]
    links = neardup.crowded_links(spark.createDataFrame(rows, "id long, label long, sig binary, s binary"), 75)
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(min(x), max(x)) for x in links.collect()} == want and want


@pytest.mark.parametrize("rare", [1, 6])
def test_links_join_the_components_of_crowded_classes(spark, monkeypatch, rare):
    """Labels of several classes: links may stand for others of the same two labels, but the components are the same."""
    monkeypatch.setattr(neardup, "RARE", rare)
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 5)
    r = random.Random(18)
    like = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    for trial in range(4):
        sets = {i: set(range(30)) - set(r.sample(range(30), r.randint(0, 9))) | {1000 * i + k for k in range(r.randint(0, 6))} for i in range(1, 50)}
        links = [(a, b) for a in sets for b in sets if a < b and like(sets[a], sets[b])]
        label = brute.components(sets, r.sample(links, len(links) // 25))
        rows = [(i, label[i], np.array(sorted(x), np.uint64).tobytes()) for i, x in sets.items()]
        got = [tuple(x) for x in neardup.crowded_links(spark.createDataFrame(rows, "id long, label long, s binary"), 75).collect()]
        assert all(like(sets[a], sets[b]) for a, b in got)
        assert brute.components(sets, [*label.items(), *got]) == brute.components(sets, links)


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, " ")], "doc_id long, text string")
    got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in neardup.near_duplicates(df).collect())
    assert got == [(False, 1, 2, 1, True), (False, 1, 2, 1, True), (False, 2, 0, 2, True), (False, 3, 0, 3, True), (True, 0, 2, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 200_000])
def test_components(spark, monkeypatch, small):
    from tessera.llm import graph

    monkeypatch.setattr(graph, "SMALL", small)
    r = random.Random(9)
    links = [(r.randrange(90), r.randrange(90)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(25)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {x: y for x, (y,) in as_dict(components(spark.createDataFrame(links, "a long, b long"))).items()}
    assert got == brute.components(nodes, [(a, b) for a, b in links if a != b])


# --- op10


def test_unigram_counts_equal_the_library(spark):
    pieces = unigram.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    mine = unigram.UnigramCounter(pieces)
    for t in TEXTS[1:]:
        marked = unigram.MARK + t.replace(" ", unigram.MARK)
        assert mine.count(t)[0] == len(library.encode(marked).ids), t
    ties = unigram.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), (unigram.MARK, 0.0)])
    assert ties.count("ab") == (2, -2.0)  # the longest last piece wins the tie
    df = frame(spark, [(1, None), (2, ""), (3, "hello world")])
    got = as_dict(unigram.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")))
    assert got[1] == got[2] == (0, 0.0) and got[3][0] >= 2


def test_dedups_of_many_near_copies(spark, monkeypatch):
    """Crowded anchors: near copies of one text, cut into pieces of several sizes, and frequent keys that are broadcast."""
    monkeypatch.setattr(repeats, "HOT", 2)
    r = random.Random(23)
    base = prose(r, 90).split(" ")
    docs = corpus(2, 25)
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(["edited", f"own{i}", ""])
        docs.append((1000 + i, " ".join(w)))
    df = frame(spark, docs)
    for share in (1000, 5):
        monkeypatch.setattr(skew, "SHARE", share)
        assert as_dict(dedup.substring_dedup(df, 20).select("doc_id", "n_units", "n_removed", "kept_sha256")) == brute.substring_dedup(docs, 20)
        assert as_dict(dedup.suffix_array_dedup(df, 200).select("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")) == brute.byte_dedup(docs, 200)


def test_byte_dedup_returns_the_text_that_is_left(spark):
    same = prose(random.Random(21), 60)
    docs = [(1, f"é one {same} two"), (2, f"three {same} fo ñ"), (3, "untouched"), (4, None)]
    got = as_dict(dedup.suffix_array_dedup(frame(spark, docs), 200, text=True).select("doc_id", "n_removed", "kept_text"))
    assert got[3] == (0, "untouched") and got[4] == (0, "")
    assert got[1][0] == got[2][0] >= len(same.encode()) and got[1][1].startswith("é on") and got[2][1].endswith("o ñ")
