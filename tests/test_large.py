"""What came out otherwise than SQL, or grew too fast, on larger tables."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as X
from tessera.operators import alignment as A
from tessera.operators import intervals as I
from tessera.operators import offsets
from tessera.operators import order as O
from tessera.operators import relational as R
from tessera.streaming import flows
from tests.oracle import both, database
from tests.test_alignment import plain_partial


def events(tmp_path, rows: str) -> str:
    """A folder with a table `events` of these (event_id, ts, user_id, event_type, value)."""
    duckdb.sql(f"COPY (SELECT CAST(a AS BIGINT) AS event_id, CAST(b AS TIMESTAMP) AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type, CAST(e AS DOUBLE) AS value, '{{}}' AS props FROM (VALUES {rows}) t(a, b, c, d, e)) TO '{tmp_path}/events.parquet'")
    return str(tmp_path)


def same_as_sql(spark, sf: str, name: str) -> bool:
    mine, theirs = both(catalog.QUERIES[name](spark, sf), database(sf), catalog.ORACLE_SQL[name])
    return mine == theirs


def test_offsets_on_both_sides_of_zero_share_an_hour(spark, tmp_path):
    rows = "(1, '2024-01-02 10:00:00', 0, 'view', 5), (2, '2024-01-02 10:20:00', 3, 'click', 5), (3, '2024-01-02 09:40:00', 3, 'click', 5), (4, '2024-01-02 05:10:00', 4, 'click', 5), (5, '2024-01-02 05:50:00', 4, 'click', 5)"
    assert same_as_sql(spark, events(tmp_path, rows), "j24_constellation_match")


def test_ranks_of_values_that_come_out_otherwise_when_computed_again(spark):
    """As sums of doubles do whose parts arrive in another order."""
    unsteady = F.udf(lambda i: i + __import__("random").random() / 4, "double").asNondeterministic()
    rows = spark.range(400).select("id", unsteady("id").alias("v"))
    assert [r["k"] for r in O.average_ranks(rows, "v", "k").orderBy("id").collect()] == [i + 1.0 for i in range(400)]


def test_event_modes_round_halves_as_sql_does(spark, tmp_path):
    rows = ", ".join(f"({i}, '2024-01-02 10:00:00', {i}, 'purchase', {50.00005 + i / 1e4:.5f})" for i in range(200))
    assert same_as_sql(spark, events(tmp_path, rows), "t03_all_event_modes")


def test_event_modes_of_a_purchase_that_is_not_among_its_own_events(spark, tmp_path):
    """One without duration, inside another event, does not overlap itself: its trigger is null. One that overlaps nothing has no row."""
    rows = "(1, '2024-01-02 10:00:00', 0, 'view', 5), (2, '2024-01-02 10:10:00', 0, 'purchase', 0), (3, '2024-01-02 10:20:00', 0, 'purchase', -1), (4, '2024-01-03 10:00:00', 0, 'purchase', 0), (5, '2024-01-04 10:00:00', 0, 'purchase', 7)"
    assert same_as_sql(spark, events(tmp_path, rows), "t03_all_event_modes")


@pytest.mark.parametrize("seed", range(12))
def test_offsets_equal_all_pairs(seed):
    """Also where pairs are compared a few at once, and where a token has several times or no name."""
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 60, 2)
    song, sample = r.integers(0, 4, n), r.integers(0, 3, m)
    t, u = 1.7e9 + r.integers(0, 60, n) * 0.25, 1.7e9 + r.integers(0, 60, m) * 0.25
    f, g = r.integers(0, 30, n) * 1.0, r.integers(0, 30, m) * 1.0
    token = np.arange(m) if seed % 3 else r.integers(-1, m, m)
    want = {}
    for a in np.unique(song):
        for b in np.unique(sample):
            d, names = t[song == a][:, None] - u[sample == b], token[sample == b]
            near = d[abs(f[song == a][:, None] - g[sample == b]) <= 5]
            scores = [(len(set(names[(abs(d - c) < 1.5).any(0)]) - {-1}), -c) for c in near]
            if scores:
                want[a, b] = (max(scores)[0], -max(scores)[1])
    for at_once in (offsets.AT_ONCE, 50):
        found = offsets.best(offsets.Side(song, t, f), offsets.Side(sample, u, g), token, 5, 1.5, at_once)
        assert {(a, b): (k, c) for a, b, k, c in zip(*found, strict=True)} == want


def test_offsets_do_not_send_pairs_of_tokens(spark):
    tokens = spark.range(3000).selectExpr("id % 30 as song", "id % 20 as sample", "id as token", "id % 7 as freq", "id * 100.0D as t")
    best = I.best_offsets(tokens.select("song", "freq", "t"), tokens.select("sample", "token", "freq", "t"), 5, 600.0)
    plan = best._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert best.count() == 600


def test_bigram_dice_cuts_each_text_once(spark):
    texts = [("night", "nacht"), ("aaaa", "aa a"), ("a", "A"), ("", ""), ("ab", ""), (None, "ab"), ("ab", None), ("abab ab", "BABA")]
    d = spark.createDataFrame(texts, "a string, b string").select("a", "b", X.bigram_dice(F.col("a"), F.col("b")).alias("dice"))
    assert d._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 2
    for a, b, dice in d.collect():
        x, y = ("".join(t.lower().split()) if t is not None else None for t in (a, b))
        p, q = (Counter(t[i : i + 2] for i in range(len(t) - 1)) if t else Counter() for t in (x, y))
        both_have = p and q
        assert dice == (2 * (p & q).total() / (p.total() + q.total()) if both_have else float(x is not None and x == y)), (a, b)


def test_rasterised_levels_are_not_grouped_sample_by_sample(spark, tmp_path):
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-02 00:00:00' + INTERVAL ({i * i * 37 % 90_000}) SECOND, {i % 3}, 'view', {i * 7 % 40 - 2})" for i in range(120))
    sf = events(tmp_path, rows)
    assert same_as_sql(spark, sf, "t07_rasterised_detector")
    plan = catalog.QUERIES["t07_rasterised_detector"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # samples are spread out above the only aggregate
    assert plan.index("Generate explode") < plan.index("Aggregate")


def test_smoothing_takes_what_it_needs_only(spark, tmp_path):
    sf = events(tmp_path, "(1, '2024-01-02 10:00:00', 0, 'view', 5)")
    stream = flows.source(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema)
    lines = flows.smooth(stream)._jdf.queryExecution().analyzed().toString().splitlines()
    assert not any("Project" in line and "props" in line for line in lines) and any("Project" in line and "value" in line for line in lines)


def test_smoothing_of_unordered_events_equals_sql(spark, tmp_path):
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-02 00:00:00' + INTERVAL ({i * 37 % 11}) SECOND, {i % 2}, 'view', {i * 7 % 40})" for i in range(30))
    duckdb_sf = events(tmp_path, rows)
    e = spark.read.parquet(f"{duckdb_sf}/events.parquet")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    found: list = []
    updates = flows.smooth(flows.source(spark, f"{tmp_path}/in", e.schema))
    updates.writeStream.outputMode("update").foreachBatch(lambda b, k: found.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    for r in found:
        s = 0.0
        for x in sorted((x for x in e.collect() if x["user_id"] == r["user_id"]), key=lambda x: (x["ts"], x["event_id"])):
            s = s * 0.8 + x["value"] * (1 - 0.8)
        assert (r["s"], r["n"]) == (s, 15)
    assert len(found) == 2


def test_words_that_come_together_are_one_element_of_the_state():
    """As each element is a trip to the state store; no word carries its whole sentence there."""
    import pandas as pd

    from tessera.streaming import context

    class Held(list):
        appendValue = list.append  # noqa: N815

        def get(self):
            return self[0] if len(self) == 1 and not isinstance(self[0], tuple) else iter(self)

        def appendList(self, rows):  # noqa: N802
            self.extend(rows)

        def update(self, value):
            self[:] = [list(value)]

        def put(self, rows):
            self[:] = rows

    held = {"waiting": Held(), "fold": Held()}
    timers = []

    class Handle:
        registerTimer = staticmethod(timers.append)  # noqa: N815

        def getListState(self, name, schema):  # noqa: N802
            return held[name]

        getValueState = getListState  # noqa: N815

    held["fold"].get = lambda: held["fold"][0] if held["fold"] else None
    times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 3000})()
    p = context.ContextProcessor(1)
    p.init(Handle())
    frame = pd.DataFrame([(1_000_000 * k, np.array([k, 0]), b"s", " b c", " y z", float(k), None) for k in range(1, 6)], columns=context.FIELDS)
    assert list(p.handleInputRows((1,), iter([frame[:3], frame[3:]]), times)) == []
    assert len(held["waiting"]) == 1 and timers == [1000]
    out = list(p.handleExpiredTimer((1,), times, None))
    assert [x.context.tolist() for x in out] == [["b c"] * 3] and out[0].id.tolist() == [[1, 0], [2, 0], [3, 0]]
    assert len(held["waiting"]) == 1 and timers == [1000, 4000]


def test_words_of_a_stream_carry_what_a_context_holds(spark, tmp_path):
    from tessera.streaming.context import streamed_context

    w = spark.createDataFrame([(1, 1, 1.0, "w", "a w", 2.0, None)], "id long, timeline long, start double, text string, sentence string, sentence_char double, split string").withColumn("ts", F.timestamp_seconds("start"))
    w.write.parquet(f"{tmp_path}/in")
    plan = streamed_context(flows.source(spark, f"{tmp_path}/in", w.schema), 3, "2 seconds")._jdf.queryExecution().analyzed().toString()
    assert "sentence#" not in plan.split("TransformWithState")[1].splitlines()[0] and "substring_index" in plan


def test_sentence_context_sorts_words_once_and_aggregates_no_sentences(spark, monkeypatch):
    from tessera.operators import folds

    plans: list[str] = []
    kept = folds.table
    monkeypatch.setattr(folds, "table", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    w = spark.createDataFrame([(k, 1, k, "w", f"a b c d {k // 2}", float(k % 2), None) for k in range(9)], "id long, timeline long, start long, text string, sentence string, sentence_char double, split string")
    context = folds.sentence_context(w, 1)
    assert len(plans) == 1 and plans[0].count("+- Sort [") == 1
    assert "first(" not in context._jdf.queryExecution().optimizedPlan().toString()
    assert dict(context.collect())[4] == "d 1a"


def test_quotes_of_many_pairs_share_a_table(spark, monkeypatch):
    """All windows of a body come from one table, and tables of many pairs are filled side by side; a pair at a time took a search of its own."""
    r = random.Random(8)
    text = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    small = [(text("abé😀 ", r.randint(0, 20)), text("abé😀 ", r.randint(0, 90))) for _ in range(300)]
    monkeypatch.setattr(A, "TOGETHER", 2)
    monkeypatch.setattr(A, "LANES", 7)
    assert A.partial_ratios(small, [0.0] * 300) == pytest.approx([plain_partial(a, b) for a, b in small])
    monkeypatch.undo()
    tables, comb = [], A.comb
    monkeypatch.setattr(A, "comb", lambda *a: tables.append(len(a[0])) or comb(*a))
    A.groundings([text("abcdefgh ", 200) for _ in range(256)], [text("abcdefgh ", 600) for _ in range(256)])
    assert sum(tables) == 256 and len(tables) <= 2


def test_quotes_are_normalised_as_before(spark):
    odd = ["", "  ", "A  <b>Tag</b>&amp;&nbsp; “q” — d’e", "ÀÉ x\n\ty", "a<", "İSTANBUL ß", "-a-", None, "1 2  3"]
    c = F.col("t")
    twice = F.trim(F.regexp_replace(F.regexp_replace(F.lower(X.plain_quotes(X.strip_html(c))), "[^a-z0-9 ]+", " "), " +", " "))
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(X.quote_norm(c).alias("a"), twice.alias("b")).collect()
    assert all(x["a"] == x["b"] for x in rows)


@pytest.mark.parametrize("letters", ["ab", "abé😀", "a\u0000b "])
def test_grams_stand_where_they_are_found(monkeypatch, letters):
    """Strings of any length, the empty one too, in texts that share blocks of bytes; none across the end of a text."""
    monkeypatch.setattr(R, "BLOCK", 5)
    r = random.Random(9)
    make = lambda n, k: ["".join(r.choice(letters) for _ in range(r.randint(0, k))) for _ in range(n)]
    grams, texts = sorted({"", *make(60, 4), *make(40, 14)}), ["", *make(60, 40), ""]
    texts += [g + "b" for g in grams[::9]] + [""]
    row, gram = R._Grams(grams).held(pa.array(["x", *texts])[1:])
    assert {(texts[i], grams[k]) for i, k in zip(row, gram, strict=True)} == {(t, g) for t in texts for g in grams if g in t}
    assert len(set(zip(row, gram, strict=True))) == len(row) and not len(R._Grams(grams).held(pa.array([], pa.string()))[0])


@pytest.mark.parametrize("most", [R.GRAMS, 3])
def test_texts_are_not_taken_apart_for_few_needles(spark, monkeypatch, most):
    """The words of few needles go to the texts; no row of a text's grams is made."""
    monkeypatch.setattr(R, "GRAMS", most)
    hays = spark.range(300).selectExpr("concat('text ', id, ' é says ', id * 7 % 100, ' times so, and no more') as hay")
    needles = spark.createDataFrame([("é says 7 times so",), ("nowhere at all",), ("text 29",), ("",), ("no",)], "needle string")
    found = R.containment_pairs(hays, needles, size=12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("Generate explode" in plan) == (most == 3)
    want = [(h, x) for (h,) in hays.collect() for (x,) in needles.collect() if x in h]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 600
