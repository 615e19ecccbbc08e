"""Alignments, grounding, containment and cuts against brute force."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment as A
from tessera.operators import intervals as I
from tessera.operators import quotes
from tessera.operators.folds import unique_anchor
from tessera.operators.relational import containment_pairs


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_partial(a, b):
    """Every part of the longer string: as long as the shorter one, or shorter at an end."""
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not a:
        return 0.0
    parts = [b[i : i + m] for i in range(n - m + 1)] + [b[:i] for i in range(1, m)] + [b[n - i :] for i in range(1, m)]
    best = max(200 * common(a, p) / (m + len(p)) for p in parts)
    if m == n:
        best = max([best] + [200 * common(b, p) / (m + len(p)) for i in range(1, m) for p in (a[:i], a[m - i :])])
    return best


def plain_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    sides = [" ".join(filter(None, [both, *sorted(d)])) for d in (x - y, y - x)]
    ratio = lambda s, t: 200 * common(s, t) / (len(s) + len(t)) if s and t else 0.0
    if both and (not x - y or not y - x):
        return 100.0
    # common words stand first on both sides, so they cost nothing when the two are compared
    rest = [" ".join(sorted(d)) for d in (x - y, y - x)]
    total = len(sides[0]) + len(sides[1])
    crossed = 100 - 100 * (len(rest[0]) + len(rest[1]) - 2 * common(*rest)) / total
    return max(crossed, *(ratio(both, s) for s in sides)) if both else crossed


def full_matrix(a, b, keep):
    cost = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (x != y))
    p, q, i, j = [], [], len(a), len(b)
    while i and j:
        same = a[i - 1] == b[j - 1]
        if cost[i][j] == cost[i - 1][j - 1] + (not same):
            if same or keep:
                p.append(i - 1)
                q.append(j - 1)
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return cost[-1][-1], (p[::-1], q[::-1])


def test_ratios_against_all_parts():
    r = random.Random(2)
    for k in range(500):
        letters = ("ab", "abc d", "abcdefgh ")[k % 3]
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, n))) for n in (16, 60))
        assert A.partial_ratio(a, b) == pytest.approx(plain_partial(a, b))
        assert A.token_set_ratio(a, b) == pytest.approx(plain_token_set(a, b))
    assert round(A.similarity("this is a test", "this is a test!"), 2) == 96.55 and A.similarity("", "") == 0.0
    assert A.partial_ratio("this is a test", "this is a test!") == 100.0 and A.token_set_ratio("b a", "a b c") == 100.0


def test_ratios_of_long_strings(monkeypatch):
    """Strides of several characters, and lanes that end inside a body."""
    monkeypatch.setattr(A, "LANES", 5)
    monkeypatch.setattr(A, "TOGETHER", 3)
    r = random.Random(3)
    for n in (60, 130, 210):
        quote = "".join(r.choice("abcdefgh ") for _ in range(n))
        near = "".join(c if r.random() > 0.2 else r.choice("xyz") for c in quote)
        noise = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
        for body in (noise(500), noise(300) + near + noise(90), near[20:] + noise(200), noise(200) + near[:-30]):
            assert A.partial_ratio(quote, body) == pytest.approx(plain_partial(quote, body))


def test_edit_scripts_equal_the_full_matrix():
    r = random.Random(4)
    for _ in range(400):
        a, b = ([r.choice("abcd"[:k]) for _ in range(r.randint(0, 30))] for k in (3, 4))
        cost, match = full_matrix(a, b, False)
        assert A.edit_distance(a, b) == cost and A.edit_match(a, b) == match
        assert A.edit_match(a, b, True) == full_matrix(a, b, True)[1]
    assert A.edit_match(list("abcd"), list("abd")) == ([0, 1, 3], [0, 1, 2]) and A.edit_match([], list("ab")) == ([], [])


def test_edit_script_of_long_lists_in_little_memory():
    r = random.Random(5)
    a = [r.randint(0, 5) for _ in range(30_000)]
    b = [v for v in a if r.random() > 0.005]
    tracemalloc.start()
    p, q = A.edit_match(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == len(b) and all(a[i] == b[j] for i, j in zip(p, q, strict=True)) and most < 100e6


def test_entries_are_grounded_in_whole_bodies(spark, monkeypatch):
    """Scores over the whole body, several entries a body and bodies an entry, typos in each word, empties and nulls."""
    monkeypatch.setattr(quotes, "ENTRIES", 2)
    r = random.Random(6)
    words = ["court", "holding", "motion", "notice", "appeal", "order", "party", "denied"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    said = "the judgment of the lower tribunal is reversed and remanded"
    typos = "teh judgmnt off thee lowr tribunall iz reversd annd remandid"
    bodies = [("s1", f"{prose(80)} {typos} {prose(40)}"), ("s2", prose(50)), ("s3", f"{prose(5)} {said.upper()}, {prose(300)}"), ("s4", ""), ("s5", None)]
    entries = [(i, s, q) for i, q in enumerate([said, "motion denied", prose(12), "", None, "zzz"]) for s, _ in [*bodies, ("nowhere", "")]]
    got = quotes.ground_entries(spark.createDataFrame(entries, "entry long, slug string, quote string"), spark.createDataFrame(bodies, "slug string, text string")).collect()
    norm = lambda t: " ".join("".join(c if c.isalnum() or c == " " else " " for c in (t or "").lower()).split())
    want = {}
    for e, s, q in entries:
        if s != "nowhere":
            q, b = norm(q), norm(dict(bodies)[s])
            score = round(max(plain_partial(q, b), plain_token_set(q, b)), 1) if q and b else 0.0
            at = b.find(q.split()[0]) if q else -1
            want[e, s] = (score, b[at : at + max(len(q) + 40, 80)][:300] if at >= 0 else "", "verified" if score >= 80 else "fuzzy" if score >= 55 else "not_found")
    assert len(got) == len(want) and {(x["entry"], x["slug"]): (x["score"], x["passage"], x["status"]) for x in got} == want
    assert want[0, "s1"][0] > 80 and want[0, "s3"][0] == 100.0


def test_containment_against_all_pairs(spark):
    r = random.Random(7)
    make = lambda n, k: {"".join(r.choice("abé😀c") for _ in range(r.randint(0, k))) for _ in range(n)}
    hays, needles = make(80, 12) | {"a.c"}, make(80, 5) | {"", ".", "a.c"}
    got = containment_pairs(spark.createDataFrame([(h,) for h in [*hays, None]], "hay string"), spark.createDataFrame([(x,) for x in [*needles, None]], "needle string"))
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted((h, x) for h in hays for x in needles if x in h)
    none = spark.createDataFrame([], "hay string")
    assert containment_pairs(none, spark.createDataFrame([("a",)], "needle string")).count() == 0


def test_unique_anchor_places(spark):
    cases = [("a  b c\n b d", "a", "b", "c"), ("b b b", "", "b", ""), ("x b y", "x", "b", "z"), ("  lead b", "lead", "b", ""), ("", "", "b", ""), ("ab ab", "ab", "ab", "")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, b string, f string, a string")
    assert dict(map(tuple, df.select("i", unique_anchor(*(F.col(c) for c in "tbfa"))).collect())) == {0: 3, 1: -2, 2: -1, 3: 7, 4: -1, 5: 3}


@pytest.mark.parametrize("cell", [86_400.0, 2.0])
def test_cuts_at_split_changes(spark, cell):
    """A sound of 10.1 s over eleven words whose splits alternate; counts are fixed values."""
    words = [("foo", i, float(i), float(2 * i + 1), "train" if i % 2 else "test") for i in range(11)]
    used = spark.createDataFrame(words, "timeline string, event_id int, start double, stop double, split string")
    sound = spark.createDataFrame([("foo", 99, 0.0, 10.1, "noise")], "timeline string, event_id int, start double, stop double, path string")
    every = used.drop("split").unionByName(sound.drop("path"))
    cut = lambda b, least=None: [(x["piece"], round(x["offset"], 6), round(x["duration"], 6), x["path"]) for x in I.cut_events(sound, b, least, cell=cell).orderBy("piece").collect()]
    breaks = I.split_breaks(used, cell=cell)
    assert [p[:2] for p in cut(breaks)] == [(i, float(i)) for i in range(11)]
    assert len(cut(breaks, 0.5)) == 10 and cut(breaks, 0.5)[-1] == (9, 9.0, 1.1, "noise")
    assert len(cut(I.even_breaks(every, 2.0))) == 6 and len(cut(I.even_breaks(every, 2.0, 0.5), 0.5)) == 5
    # sections: 0-1, 1-3, 2-5, ... cut at each second from where they begin
    assert sorted(x["t"] for x in I.split_breaks(used, 1.0, cell=cell).collect()) == sorted(s + k for _, _, s, e, _ in words for k in range(int(e - s)))
    same = spark.createDataFrame([(w[0], w[1], w[2], w[3], None) for w in words], used.schema)
    assert [x["t"] for x in I.split_breaks(same, cell=cell).collect()] == [0.0]
    assert cut(breaks.limit(0)) == [(0, 0.0, 10.1, "noise")]
