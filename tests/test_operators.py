"""Golden cases and edge cases of single operators, on small frames made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import alignment, cluster
from tessera.operators import folds as L
from tessera.operators import intervals as I
from tessera.operators import order as O
from tessera.operators import quotes as Q
from tessera.operators import relational as R
from tessera.operators import timed
from tessera.operators.graph import connected
from tessera.sources import files
from tessera.streaming import flows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


EVENTS = [("a", -0.5, 2.0, 1), ("b", 0.0, 1.0, 1), ("c", 0.0, 2.0, 1), ("d", -1.0, 2.0, 1), ("e", 10.0, 2.0, 1), ("f", 0.0, 3.0, 2)]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(EVENTS, "text string, start double, duration double, timeline int")
    return df.withColumn("stop", F.col("start") + F.col("duration")).withColumn("event_id", F.ascii("text"))


def test_validated_order(events):
    got = events.withColumn("k", F.row_number().over(I.order_in_timeline())).filter("timeline = 1").orderBy("k").collect()
    assert "".join(r.text for r in got) == "dacbe"


@pytest.mark.parametrize("cell", [0.7, 5.0, 1000.0])
def test_overlap(events, cell):
    w = events.select(F.col("text").alias("w"), "timeline", F.col("start").alias("w_start"), F.col("stop").alias("w_stop"))
    got = I.range_join(w, events.select("text", "timeline", "start", "stop"), I.overlaps(), cell)
    by = {r[0]: "".join(sorted(r[1])) for r in got.groupBy("w").agg(F.collect_list("text")).collect()}
    assert by == {"a": "abcd", "b": "abcd", "c": "abcd", "d": "abcd", "e": "e", "f": "f"}


def test_zero_length_event_counts_in_the_point_form_only(spark):
    w = spark.createDataFrame([(1, 1, 5.0, 9.0)], "w int, timeline int, w_start double, w_stop double")
    e = spark.createDataFrame([(1, 5.0, 5.0)], "timeline int, start double, stop double")
    assert I.range_join(w, e, I.overlaps(), 2.0).count() == 0
    assert I.range_join(w, e, I.starts_ends_or_spans(), 2.0).count() == 1


def test_nearest_takes_the_first_of_equals_and_respects_the_tolerance(spark):
    p = spark.createDataFrame([(1, 1, 10.0), (1, 2, 50.0)], "timeline int, point_id int, t double")
    f = spark.createDataFrame([(1, 7, 8.0), (1, 5, 12.0), (1, 9, 100.0)], "timeline int, frame_id int, ft double")
    assert rows(I.nearest(p, f, 5.0).select("point_id", "frame_id").na.fill(-1)) == [(1, 5), (2, -1)]


def test_chunks(spark):
    e = spark.createDataFrame([(1, 10.1)], "event_id int, duration double")
    assert I.chunk_events(e, 1.0, 0.0).count() == 11
    assert I.chunk_events(e, 1.0, 0.5).count() == 10
    assert I.chunk_events(e, 2.0, 0.0).count() == 6
    assert I.chunk_events(e, 2.0, 0.5).count() == 5


def test_strides(spark):
    e = spark.createDataFrame([(1, 0.0, 100.0)], "event_id int, start double, stop double")
    assert I.strided_windows(e, 10.0, 10.0).count() == 10
    assert I.strided_windows(e, 10.0, 10.0, drop_incomplete=False).count() == 11


def test_hash_split_depends_on_the_kind_of_seed(spark):
    ids = spark.createDataFrame([("0",), ("1",), ("10101001010101",)], "u string")
    split = lambda seed: [r[0] for r in ids.select(L.hash_split(F.col("u"), {"train": 0.5, "test": 0.5}, seed)).collect()]
    assert split(0.0) == ["train", "test", "train"]
    assert split(0) == ["test", "test", "train"]
    with pytest.raises(ValueError):
        L.hash_split(F.col("u"), {"train": 0.5})


@pytest.mark.parametrize(
    ("clusters", "ratios", "want"),
    [
        ([0, 0, 0, 0, 1, 1, 1, 2, 2, 3], {"train": 0.5, "val": 0.3, "test": 0.2}, ["train"] * 4 + ["val"] * 3 + ["test"] * 2 + ["train"]),
        ([0, 0, 1, 1, 2, 2, 3, 3, 4, 5], {"train": 0.85, "val": 0.10, "test": 0.05}, ["train"] * 8 + ["test", "val"]),
        ([0, 0, 1, 1, 1, 2, 3, 4, 4, 5], {"train": 0.3, "val": 0.3, "test": 0.4}, ["train"] * 2 + ["val"] * 3 + ["train"] + ["test"] * 4),
    ],
)
def test_cluster_packing(clusters, ratios, want):
    sizes = {c: clusters.count(c) for c in dict.fromkeys(clusters)}
    got = L.pack_clusters(sizes, ratios)
    assert [got[c] for c in clusters] == want


@pytest.mark.parametrize(
    ("other_timeline", "split", "want"),
    [(False, "split", "b b b. c c c. d d d"), (True, "split", "d d d"), (False, None, "a a a. b b b. c c c. d d d")],
)
def test_sentence_context(spark, other_timeline, split, want):
    # fixed values: words and contexts that must come out
    w = []
    for k, word in enumerate("abcd"):
        for i in range(3):
            side = ("test" if word == "a" else "train") if split else None
            w.append((3 * k + i, "2" if word == "d" and other_timeline else "1", float(3 * k + i), word, f"{word} {word} {word}. ", 2.0 * i, side))
    df = spark.createDataFrame(w, "id long, timeline string, start double, text string, sentence string, sentence_char double, split string")
    got = dict(rows(L.sentence_context(df)))
    assert got[11] == want and got[0] == "a"
    assert dict(rows(L.sentence_context(df, 3)))[11] == " ".join(want.split(" ")[-4:])


def test_sentence_context_of_words_outside_sentences(spark):
    cols = "id long, timeline string, start double, text string, sentence string, sentence_char double, split string"
    w = [(0, "t", 0.0, "a", "a b. ", 0.0, "x"), (1, "t", 1.0, "b", "a b. ", 2.0, "x"), (2, "t", 2.0, "c", "c. ", 0.0, "x"), (3, "t", 3.0, "?", None, None, "x"), (4, "t", 4.0, "?", "", 0.0, "y"),
         (5, "t", 5.0, "d", "d. ", 0.0, "y"), (6, "t", 6.0, "?", "d. ", None, "y"), (7, "t", 7.0, "e", "e. ", 0.0, "y"), (8, "t", 8.0, "?", None, None, "z"), (9, "t", 9.0, "f", "f. ", 0.0, "z")]
    got = dict(rows(L.sentence_context(spark.createDataFrame(w, cols))))
    assert got == {0: "a", 1: "a b", 2: "a b. c", 3: "", 4: "", 5: "a b. d", 6: "", 7: "a b. d. e", 8: "", 9: "f"}
    assert L.sentence_context(spark.createDataFrame([], cols)).count() == 0


def test_press_and_release(spark):
    e = [(1, 1, 0.0, "k", "press"), (1, 2, 1.0, "k", "release"), (1, 3, 2.0, "k", "release"), (1, 4, 3.0, "k", "press"), (1, 5, 4.0, "j", "release"), (1, 6, 5.0, "k", "press"), (1, 7, 6.0, "j", "press")]
    df = spark.createDataFrame(e, "timeline long, id long, t double, key string, kind string")
    assert rows(L.pair_presses(df).na.fill(-1)) == [(1, 0.0, 1.0), (4, 3.0, -1.0), (6, 5.0, -1.0), (7, 6.0, -1.0)]


def test_merge_sentences(spark):
    s = spark.createDataFrame([(1, 1, 1.0, "a b"), (2, 1, 5.0, "c"), (3, 1, 9.0, "d e"), (4, 2, 10.0, "f"), (5, 2, 20.0, "g")], "id long, timeline long, start double, text string")
    size = lambda df: sorted(r[2] for r in df.groupBy("timeline", "grp").count().collect())
    assert size(L.merge_sentences(s, min_duration=6)) == [1, 1, 1, 2]
    assert size(L.merge_sentences(s, min_words=3)) == [2, 3] or size(L.merge_sentences(s, min_words=3)) == [1, 2, 2]


def test_approximate_match():
    # fixed values: places that two lists of times share
    assert L.approximate_match(np.array([1100, 2300, 3600.0]), np.array([0, 1110, 3620, 6500.0]), 10, 1) == ([0, 2], [1, 2])
    assert L.approximate_match(np.array([1000, 5000, 7000, 7011.0]), np.array([1000, 5000, 7010.0]), 10, 1) == ([0, 1, 3], [0, 1, 2])
    assert L.approximate_match(np.array([]), np.array([1.0]), 10, 1) == ([], [])
    # one in a thousand off: the relative tolerance lets it pass, the absolute one alone does not
    a, b = np.array([0.0, 1e5, 2.1e5]), np.array([0.0, 1.001e5, 2.1015e5])
    assert L.approximate_match(a, b, 10, 0) == ([0, 1, 2], [0, 1, 2]) and L.approximate_match(a, b, 10, 0, 0.0) == ([0], [0])


def test_places_in_a_global_order(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = [(int(i), float(x)) for i, x in enumerate(r.integers(0, 60, 300))]
    df = spark.createDataFrame(v, "id long, v double").repartition(4)
    order = sorted(v, key=lambda t: (t[1], t[0]))
    for n in (1, 2, 150, 299, 300):
        assert tuple(O.nth_row(df, "v", "id", n).first()) == order[n - 1]
    assert O.nth_row(df, "v", "id", 301).count() == 0 and O.nth_row(df.limit(0), "v", "id", 1).count() == 0
    values = [x for _, x in v]
    ranks = dict(O.average_ranks(df, "v", "k").select("id", "k").collect())
    assert all(ranks[i] == sum(y < x for y in values) + (values.count(x) + 1) / 2 for i, x in v)
    assert O.totals_before(df.limit(0), "id").count() == 0


def test_complete_linkage(spark):
    x = [("a", "p", 1.0), ("b", "p", 0.8), ("b", "q", 0.6), ("c", "p", 0.6), ("c", "q", 0.8), ("d", "z", 1.0)]
    pairs = L.cosine_pairs(spark.createDataFrame(x, "d string, w string, x double"), 0.5)
    assert [(a, b, round(c, 9)) for a, b, c in rows(pairs)] == [("b", "a", 0.8), ("c", "a", 0.6), ("c", "b", 0.96)]
    assert rows(cluster.complete_linkage(pairs, 0.3)) == [("a", "a"), ("b", "b"), ("c", "b")]  # a is too far from c
    assert rows(cluster.complete_linkage(pairs, 0.5)) == [("a", "a"), ("b", "a"), ("c", "a")]
    r = np.random.default_rng(5)
    for _ in range(20):
        n = int(r.integers(2, 9))
        d = np.triu(r.random((n, n)), 1)
        got = cluster.linkage(list(range(n)), {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}, 0.6)
        clusters = [{i} for i in range(n)]
        reach = lambda p, q: max(d[min(i, j), max(i, j)] for i in p for j in q)
        while len(clusters) > 1:
            apart, p, q = min((reach(p, q), a, b) for a, p in enumerate(clusters) for b, q in enumerate(clusters) if a < b)
            if apart >= 0.6:
                break
            clusters[p] |= clusters.pop(q)
        assert {frozenset(i for i in range(n) if got[i] == k) for k in set(got)} == {frozenset(c) for c in clusters}


def test_verbatim_hits(spark):
    q = [(1, "one two three"), (2, "o"), (3, "wo th"), (4, "missing inner word"), (5, "one “two” three"), (6, None)]
    d = [(1, "says one  two\nthree."), (2, "one \"two\" three"), (3, "nothing"), (4, None), (5, "two threes")]
    got = Q.verbatim_hits(spark.createDataFrame(q, "quote_id long, text string"), spark.createDataFrame(d, "doc_id long, text string"))
    assert rows(got) == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 5), (3, 1), (3, 5), (5, 2)]


def test_overlap_slices(spark):
    # fixed values: what windows cover of ten samples at 1 Hz from second 10 on
    cases = [((15.0, 10.0), (15.0, 5.0)), ((5.0, 10.0), (10.0, 5.0)), ((12.0, 6.0), (12.0, 6.0)), ((19.9, 10.0), (19.0, 1.0)), ((9.1, 1.0), (10.0, 1.0)), ((12.0, 0.1), (12.0, 1.0)), ((2.0, 8.0), None), ((25.0, 1.0), None)]
    df = spark.createDataFrame([(i, *w) for i, (w, _) in enumerate(cases)], "i int, s double, d double").withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("double")))
    got = {r["i"]: r["o"] for r in df.select("i", timed.overlap_slice(F.col("v"), F.lit(10.0), 1.0, F.col("s"), F.col("d")).alias("o")).collect()}
    for i, (_, want) in enumerate(cases):
        assert (got[i] and (got[i]["start"], got[i]["duration"])) == want
        if want:
            assert got[i]["samples"] == [want[0] - 10 + k for k in range(int(want[1]))]


def test_event_modes_refuse(spark):
    e = spark.createDataFrame([(1, 1, 0.0, [1.0], True), (1, 2, 1.0, [2.0], False)], "segment int, event_id int, start double, data array<double>, is_trigger boolean")
    with pytest.raises(Exception, match="2 events"):
        timed.combine_events(e, "single").collect()
    with pytest.raises(ValueError):
        timed.combine_events(e, "sideways")


def test_sentence_splits_need_sentences(spark):
    e = spark.createDataFrame([("t", "Sentence", 0.0, 1.0, "a"), ("t", "Word", 0.5, 0.1, "a")], "timeline string, type string, start double, duration double, text string")
    assert [r["split"] for r in timed.sentence_splits(e, 1).filter("type = 'Word'").collect()] == ["ca978112-ksplit1/1"]
    with pytest.raises(Exception, match="1 sentences for 2 splits"):
        timed.sentence_splits(e, 2).collect()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(rows(connected(e)))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100


def test_tree_closure_ends_on_cycles(spark):
    f = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (9, 8)], "id long, parent long")
    assert rows(R.tree_closure(f, 1)) == [(1,), (2,), (3,)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  12 So.  2d 345 & co ", "1:02:03", "=cmd|x<y", None)], "c string, t string, s string, n string")
    r = df.select(X.cite_slug(F.col("c")), *X.citation_parts(F.col("c")), X.clock_seconds(F.col("t")), X.safe_cell(F.col("s"), 50), X.cite_slug(F.col("n")), X.iso_date(F.lit("20240230")), X.bigram_dice(F.lit("night"), F.lit("nacht"))).first()
    assert tuple(r)[:7] == ("12_So_2d_345_co", "12", "So. 2d", "345", 3723, "'=cmd\\|x&lt;y", None)
    assert r[7] == "" and abs(r[8] - 0.25) < 1e-9


def test_treatment_signal_loses_marks_behind_the_cut(spark):
    df = spark.createDataFrame([(["x" * 210 + " overruled"],), (["was overruled"],), (["fine"],)], "t array<string>")
    assert [r[0] for r in df.select(X.treatment_signal(F.col("t"))[0]).collect()] == ["yellow", "red", "green"]


def plain_distance(a, b):
    """Edit distance by recursion over prefixes."""
    cost = [[max(i, j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (x != y))
    return cost[-1][-1]


def test_word_errors_and_character_classes(spark):
    pairs = [("a b c", "a c"), ("a b c", "x b c d"), ("", "a"), (None, None), ("a b", ""), ("one two three four", "two one four three")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, g string")
    got = dict(rows(df.select("i", alignment.word_error_rate(F.col("t"), F.col("g")))))
    assert got == {i: plain_distance((a or "").split(), (b or "").split()) / max(1, len((a or "").split())) for i, (a, b) in enumerate(pairs)}
    k = [("abcd", "abXd"), ("abcd", "abcdd"), ("abcd", "bcd"), ("", "xy"), (None, "z"), ("ab", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(k)], "i int, t string, g string")
    got = {r[0]: tuple(r[1]) for r in df.select("i", L.alignment_classes(F.col("t"), F.col("g"))).collect()}
    assert got == {0: (3, 1, 0), 1: (4, 0, 1), 2: (3, 0, 0), 3: (0, 0, 2), 4: (0, 0, 1), 5: (0, 0, 0)}
    assert dict(rows(df.select("i", timed.typed_classes(F.col("t"), F.col("g"))))) == {0: "mmsm", 1: "mmmma", 2: "mmm", 3: "aa", 4: "a", 5: ""}


def test_unique_anchor(spark):
    cases = [(("say  the\nword now", "the", "word", "now"), 9), (("a b a b", "", "a", ""), -2), (("a b a c", "", "a", "c"), 4), (("a b", "", "z", ""), -1), ((None, "", "a", ""), -1), (("x", "", "", ""), -1)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, t string, b string, f string, a string")
    got = dict(rows(df.select("i", L.unique_anchor(F.col("t"), F.col("b"), F.col("f"), F.col("a")))))
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_words_in_text():
    # fixed values: places of words in a text that spells some of them otherwise
    assert L.words_in_text("aaaa bbbb cccc cccc".split(), "aaax bbbx cccc cccc") == [0, 5, 10, 15]
    assert L.words_in_text(["b", "a"], "a b") == [2, -1] and L.words_in_text(["zz"], "") == [-1]


def test_beam_search_with_room_for_all_paths_is_exhaustive():
    import itertools

    r = np.random.default_rng(6)
    for _ in range(20):
        logits, bonus = r.normal(size=(4, 3)), r.normal(size=(3, 3))
        value = lambda p: sum(logits[k, s] for k, s in enumerate(p)) + sum(bonus[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=4), key=value)
        assert tuple(L.beam_search(logits, bonus, 81)) == best
        narrow = L.beam_search(logits, np.zeros((3, 3)), 1)
        assert narrow == logits.argmax(1).tolist()


def test_decoding_by_step_equals_one_frame(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(3, 80, 4))
    y = x @ r.normal(size=4) + r.normal(size=(3, 80)) * 0.3
    y[2] = 1.0
    df = spark.createDataFrame([(s, i, [float(v) for v in x[s, i]], float(y[s, i])) for s in range(3) for i in range(80)], "step long, id long, x array<double>, y double").repartition(4)
    got = {s: (n, c) for s, n, c in L.ridge_by_step(df, 1.0).collect()}
    for s in range(2):
        a, m, level = x[s][::2] - x[s][::2].mean(0), x[s][::2].mean(0), y[s][::2].mean()
        w = np.linalg.solve(a.T @ a + np.eye(4), a.T @ (y[s][::2] - level))
        assert got[s][0] == 80 and got[s][1] == pytest.approx(np.corrcoef((x[s][1::2] - m) @ w + level, y[s][1::2])[0, 1])
    assert got[2][0] == 80 and np.isnan(got[2][1])


def test_monte_carlo_depends_on_the_seed_only(spark):
    want = {}
    for i in range(50):
        tier = int((np.random.default_rng([42, i]).random(16) > 0.5).sum()) // 4
        want[tier] = want.get(tier, 0) + 1
    assert dict(rows(L.monte_carlo(spark, 50, 42))) == want


def test_best_offsets(spark):
    songs = spark.createDataFrame([(1, 100, 10.0), (1, 200, 11.0), (1, 300, 12.5), (2, 100, 50.0)], "song int, freq int, t double")
    samples = spark.createDataFrame([(7, 1, 103, 0.0), (7, 2, 204, 1.02), (7, 3, 900, 2.5)], "sample int, token int, freq int, t double")
    # the third token counts at an offset that the others name, whatever its frequency
    assert [(a, b, n) for a, b, n, _ in rows(I.best_offsets(songs, samples, 5, 0.05))] == [(1, 7, 3), (2, 7, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "b.json").write_text('{"k": 3}\n{broken\n{"k": 4}\n')
    assert rows(files.read_json_records(spark, f"{tmp_path}/*.json", "k long")) == [(1,), (2,), (3,), (4,)]
    (tmp_path / "c.csv").write_text('"t","t 2"\n"","x\ny"\n"p","q"\n')
    assert rows(files.read_scraped_csv(spark, f"{tmp_path}/c.csv", {"title": ["missing", "t", "t 2"]})) == [("p",), ("x\ny",)]
    (tmp_path / "Foo v. Bar.txt").write_text("body\n")
    assert rows(files.read_texts_by_slug(spark, f"{tmp_path}/*.txt"))[0][0] in ("Foo_v_Bar", "Foo_20v_20Bar")
    (tmp_path / "v.vtt").write_text("WEBVTT\n\n1\n00:01.000 --> 00:02.000\n<c>hello</c> you\n")
    assert rows(files.read_captions(spark, f"{tmp_path}/*.vtt")) == [("v.vtt", "hello you")]


def test_poll_sees_each_row_once(spark, tmp_path):
    df = spark.range(5)
    src, sink, cp = (f"{tmp_path}/{x}" for x in ("src", "sink", "cp"))
    df.write.parquet(src)
    flows.poll(flows.source(spark, src, df.schema), sink, cp)
    flows.poll(flows.source(spark, src, df.schema), sink, cp)
    spark.range(5, 8).write.mode("append").parquet(src)
    flows.poll(flows.source(spark, src, df.schema), sink, cp)
    assert rows(spark.read.parquet(sink)) == [(i,) for i in range(8)]


def test_sweep_keeps_the_rows_of_a_failed_batch(spark, tmp_path):
    src, cp, seen = f"{tmp_path}/src", f"{tmp_path}/cp", []
    for i in range(3):
        spark.range(10 * i, 10 * i + 2).coalesce(1).write.mode("append").parquet(src)

    def work(fails):
        def take(batch, number):
            ids = [r[0] for r in batch.collect()]
            if any(fails(i) for i in ids):
                raise ValueError("no")
            seen.extend(ids)

        return take

    stream = flows.source(spark, src, spark.range(1).schema)
    assert len(flows.sweep(stream, cp, work(lambda i: i >= 10))) == 2 and sorted(seen) == [0, 1]
    assert len(flows.sweep(stream, cp, work(lambda i: i >= 20))) == 1 and sorted(seen) == [0, 1, 10, 11]
    assert flows.sweep(stream, cp, work(lambda i: False)) == [] and sorted(seen) == [0, 1, 10, 11, 20, 21]
    assert flows.sweep(stream, cp, work(lambda i: True)) == [] and len(seen) == 6


def test_ndjson_records_over_several_chunks(spark):
    c = [("a", 1, '{"k"'), ("a", 2, ": 1"), ("a", 3, '}\n{"k": 2}\n\nbroken\n{"k"'), ("a", 4, None), ("a", 5, ': 3}\n'), ("b", 1, '{"k": 4}'), ("b", 2, "")]
    df = spark.createDataFrame(c, "stream string, seq int, value string").repartition(3)
    assert rows(flows.ndjson_records(df, "k long")) == [("a", 1), ("a", 2), ("a", 3), ("b", 4)]


def test_shared_folder_of_a_cluster_must_be_named(spark):
    from types import SimpleNamespace

    from tessera import session

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        session.shared_dir(away)
    df = session.table(spark.range(3))
    assert df.count() == 3 and session.folders(spark, session.tables_dir(spark))


def test_study_cache_and_pushdown(spark, events, tmp_path):
    some = files.load_study(spark, events, f"{tmp_path}/c", "n_events > 1")
    assert some.count() == 5
    assert files.load_study(spark, events, f"{tmp_path}/d").filter("timeline = 1").count() == 5


def test_sentence_context_keeps_only_what_counts(spark):
    """The shortened context is the end of the whole one, for sentences without blanks, over many partitions, and null timelines."""
    import random

    r = random.Random(8)
    w, n = [], 0
    for line in ("a", None, "b"):
        for k in range(120):
            sentence = r.choice(["one. ", "two words ", "x", "three short words. ", " "])
            for at in range(r.randint(1, 2)):
                w.append((n, line, float(n), "w", sentence, float(at - k % 2), r.choice(["p"] * 9 + ["q"])))
                n += 1
    df = spark.createDataFrame(w, "id long, timeline string, start double, text string, sentence string, sentence_char double, split string").repartition(3)
    whole = dict(rows(L.sentence_context(df)))
    for most in (0, 1, 5):
        assert dict(rows(L.sentence_context(df, most))) == {i: " ".join(c.split(" ")[-most - 1 :]) for i, c in whole.items()}


def test_smoothing_composes_over_partitions(spark):
    r = np.random.default_rng(3)
    x = [(int(k), i, r.normal(size=2).tolist()) for i, k in enumerate(r.choice([1, 1, 1, 1, 2, 3], 400))]
    got = dict(rows(O.smoothed(spark.createDataFrame(x, "k long, i long, v array<double>").repartition(5), "k", ["i"], "v", 0.8).select("k", "levels")))
    for k in (1, 2, 3):
        level = np.zeros(2)
        for key, _, v in x:
            if key == k:
                level = 0.8 * level + 0.2 * np.array(v)
        assert np.allclose(got[k], level)
    assert O.smoothed(spark.createDataFrame([], "k long, i long, v array<double>"), "k", ["i"], "v", 0.8).count() == 0


def test_group_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", 5.0)], "k string, v double")
    assert rows(R.group_values(df, "k", "v")) == [("a", 1.0), ("b", 3.0), ("c", 5.0)]
    assert rows(R.group_values(df, "k", "v", least=2)) == [("a", 1.0), ("b", 3.0)]
    assert rows(R.group_values(df.filter("k <> 'b'"), "k", "v", "first", 2)) == [("a", 1.0)]
    assert rows(R.group_values(df.filter("k = 'c'"), "k", "v", "first", 2)) == [("c", 5.0)]  # no group has two rows
    assert rows(R.group_values(df.filter("k <> 'a'"), "k", "v", "first", 3)) == []  # left out before its values are compared
    with pytest.raises(Exception, match="a group holds different values: b"):
        R.group_values(df, "k", "v", "first").collect()


@pytest.mark.parametrize(("duration", "words"), [(2.5, None), (None, 4), (3.0, 5), (0.0, None), (None, None)])
def test_merged_sentences_equal_a_fold(spark, duration, words):
    import random

    r = random.Random(11)
    s = []
    for line in (1, 2, 3):
        at = 0.0
        for _ in range(40 if line < 3 else 1):
            s.append((len(s), line, at, r.choice(["", None, "a", "a b", " a  b c ", "a\tb c d"])))
            at += r.choice([0.0, 0.5, 1.0, 2.0])
    want = {}
    for line in (1, 2, 3):
        grp, first, n = -1, 0.0, 0
        for i, _, start, text in (x for x in s if x[1] == line):
            if grp < 0 or ((duration is None or start - first >= duration) and (words is None or n >= words)):
                grp, first, n = grp + 1, start, 0
            n += len((text or "").split())
            want[i] = grp
    df = spark.createDataFrame(s, "id long, timeline long, start double, text string").repartition(3)
    assert {x["id"]: x["grp"] for x in L.merge_sentences(df, duration, words).collect()} == want
