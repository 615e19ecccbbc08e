"""Complete linkage over tasks and the n-gram beam against plain versions."""

import itertools
import math
import random
from collections import Counter

import pytest

from tessera.operators import cluster, ngrams
from tessera.operators.ngrams import BEGIN


def plain_linkage(ids, close, most):
    """Join the nearest two clusters, of equal ones those with the least names, until none is below `most`."""
    parts = {i: [i] for i in ids}
    far = lambda a, b: max((close.get((min(x, y), max(x, y)), math.inf) for x in parts[a] for y in parts[b]))
    while len(parts) > 1:
        d, a, b = min((far(a, b), a, b) for a, b in itertools.combinations(sorted(parts), 2))
        if not d < most:
            break
        parts[a] += parts.pop(b)
    return {x: a for a, members in parts.items() for x in members}


def distances(r, n, share, levels):
    return {(a, b): r.choice(levels) for a, b in itertools.combinations(range(n), 2) if r.random() < share}


def test_chains_equal_greedy_joins():
    r = random.Random(1)
    for k in range(150):
        close = distances(r, 14, (1.0, 0.6, 0.3)[k % 3], [0.1, 0.2, 0.3, 0.4] if k % 2 else [i / 997 for i in range(900)])
        want = plain_linkage(range(14), close, 0.85)
        assert dict(enumerate(cluster.linkage(list(range(14)), close, 0.85))) == want


@pytest.mark.parametrize("edges", [0, 12])
def test_steps_over_tasks_equal_greedy_joins(spark, monkeypatch, edges):
    """With EDGES at 0 every component is joined by joint steps alone."""
    monkeypatch.setattr(cluster, "EDGES", edges)
    r = random.Random(2)
    close = distances(r, 24, 0.3, [0.1, 0.2, 0.3, 0.5, 0.7])
    pairs = spark.createDataFrame([(b, a, 1 - d) for (a, b), d in close.items()], "a long, b long, c double")
    got = {x["id"]: x["cluster"] for x in cluster.complete_linkage(pairs, 0.6).collect()}
    want = plain_linkage(range(24), {k: 1 - (1 - d) for k, d in close.items()}, 0.6)
    reached = {x for k, d in close.items() if d < 0.6 for x in k}
    assert got == {x: want[x] for x in reached}


def plain_model(texts, order):
    """Witten-Bell by its definition, recursively."""
    counts = [Counter((BEGIN + t)[i : i + n] for t in texts for i in range(len(t) + 2 - n)) for n in range(1, order + 1)]
    counts = [Counter({g: k for g, k in c.items() if g[-1] != BEGIN}) for c in counts]

    def p(h, c):
        if len(h) >= order:
            return p(h[-(order - 1) :] if order > 1 else "", c)
        seen = {g[-1]: k for g, k in counts[len(h)].items() if g[:-1] == h}
        lower = 1 / (len(counts[0]) + 1) if not h else p(h[1:], c)
        return (seen.get(c, 0) + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    return p


@pytest.mark.parametrize("order", [1, 3])
def test_back_off_model(spark, order):
    texts = ["the&hat", "a&cat&sat", "that", "ab", ""]
    model, p = ngrams.BackOff(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), order), plain_model(texts, order)
    asked = [(BEGIN + "".join(h), c) for n in range(3) for h in itertools.product("ta&z", repeat=n) for c in "tahz&"]
    got = model.scored(spark.createDataFrame([(h[-max(1, order - 1) :], c, h) for h, c in asked], "context string, c string, h string")).collect()
    assert len(got) == len(asked)
    for r in got:
        assert r["lm"] == pytest.approx(math.log10(p(r["context"], r["c"])))
    assert sum(p("t", c) for c in {c for t in texts for c in t}) <= 1 + 1e-9


def test_wide_beam_is_exhaustive_and_narrow_one_is_greedy(spark):
    r = random.Random(3)
    texts = ["the hat", "that cat sat", "a test", "attach"]
    model = ngrams.BackOff(spark.createDataFrame([(t.replace(" ", "&"),) for t in texts], "text string"))
    p = plain_model([t.replace(" ", "&") for t in texts], 3)
    letters = "tha&7"
    rows, logits = [], {}
    for i in range(6):
        for step in range(3 if i else 2):
            x = [r.gauss(0, 1.5) for _ in letters]
            total = math.log(sum(map(math.exp, x)))
            for c, v in zip(letters, x, strict=True):
                rows.append((i, step, c, v - total))
                logits[i, step, c] = v - total
    emissions = spark.createDataFrame(rows, "id int, step int, c string, p double")

    def value(i, text):
        return sum(logits[i, k, c] + math.log10(p((BEGIN + text[:k])[-2:], c)) for k, c in enumerate(text))

    wide = {x["id"]: (x["text"], x["score"]) for x in ngrams.beam_decode(emissions, model, width=64, labels=5).collect()}
    for i in range(6):
        best = max(itertools.product("tha&", repeat=3 if i else 2), key=lambda t: value(i, "".join(t)))
        assert wide[i][0] == "".join(best) and wide[i][1] == pytest.approx(value(i, wide[i][0]))
    narrow = {x["id"]: x["text"] for x in ngrams.beam_decode(emissions, model, width=1, labels=5, weight=0.0).collect()}
    assert narrow == {i: "".join(max("tha&", key=lambda c: logits[i, k, c]) for k in range(3 if i else 2)) for i in range(6)}
    assert ngrams.beam_decode(emissions.limit(0), model).count() == 0
