"""Ordered folds and alignments that no column expression states: one group (timeline, pair) at a time, in Arrow batches."""

from __future__ import annotations

import difflib
import hashlib
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.alignment import edit_match
from tessera.operators.order import running_tail
from tessera.session import table


def hash_split(uid: Column, ratios: dict[str, float], seed: float = 0.0) -> Column:
    """Split of an id by a generator seeded with its SHA-256 plus `seed`. A float seed and an integer seed of equal value
    give different splits, as their sums with the hash are different numbers."""
    if any(r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-8:
        raise ValueError(f"ratios must be positive and sum to 1: {ratios}")
    names, bounds = list(ratios), np.cumsum(list(ratios.values()))

    @F.pandas_udf("string")
    def split(ids: pd.Series) -> pd.Series:
        def one(u):
            if u is None:
                return None
            score = random.Random(int(hashlib.sha256(u.encode()).hexdigest(), 16) + seed).random()
            return names[min(int(np.searchsorted(bounds, score, side="right")), len(names) - 1)]

        return ids.map(one)

    return split(uid.cast("string"))


def pack_clusters(sizes: dict[int, int], ratios: dict[str, float]) -> dict[int, str]:
    """Whole clusters to splits. The splits choose in turn, the smallest first, each from what is left and in the clusters'
    order: it takes all that still fits into its share of the total, rounded up; the last one has what the others' shares leave.

    Running totals find how far a split gets before a cluster is too large; from there it goes on at the next that fits."""
    names, n = np.array(list(sizes)), np.array(list(sizes.values()), np.int64)
    by_share = sorted(ratios, key=ratios.get)
    shares = [int(np.ceil(ratios[s] * n.sum())) for s in by_share[:-1]]
    shares.append(int(n.sum()) - sum(shares))
    owner = np.full(len(n), -1)
    for k, room in enumerate(shares):
        free = np.flatnonzero((owner < 0) & (n <= room))
        while len(free):
            total = np.cumsum(n[free])
            fits = int(np.searchsorted(total, room, "right"))
            owner[free[:fits]] = k
            room -= int(total[fits - 1]) if fits else 0
            free = free[fits:][n[free[fits:]] <= room]
    if len(set(owner[owner >= 0].tolist())) < len(ratios):
        raise ValueError("a split gets no cluster: too few or too large ones for these ratios")
    return {c: by_share[k] for c, k in zip(names.tolist(), owner.tolist(), strict=True) if k >= 0}


def merge_sentences(rows: DataFrame, min_duration: float | None = None, min_words: int | None = None) -> DataFrame:
    """(id, timeline, grp): groups of consecutive sentences (timeline, start, text, id): one more opens when the group's first start is
    `min_duration` back and it has `min_words` words.

    Starts and words only grow along a timeline, so where the next group would open, if one opened here, is the further one of two places,
    each found by putting what is needed among the sentences' own values. From the first sentence on, these jumps are doubled:
    each round the known openings lead to as many more."""
    order = Window.partitionBy("timeline").orderBy("start", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    size = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    s = rows.select("id", "timeline", "start", size.cast("double").alias("size"))
    s = table(s.select("id", "timeline", F.col("start").cast("double").alias("start"), (F.row_number().over(order) - 1).alias("i"), F.coalesce(F.sum("size").over(before), F.lit(0.0)).alias("words")))

    def reached(value: str, more: float) -> DataFrame:
        """(timeline, i, j): the first sentence whose value is at least that of sentence i and `more`."""
        asked = s.select("timeline", (F.col(value) + more).alias("at"), F.lit(None).cast("int").alias("j"), "i")
        there = s.select("timeline", F.col(value).alias("at"), F.col("i").alias("j"), F.lit(None).cast("int").alias("i"))
        # what is asked for stands before what is there, and sentences of equal values in their order
        along = Window.partitionBy("timeline").orderBy("at", F.col("j").isNotNull(), "j").rowsBetween(0, Window.unboundedFollowing)
        return asked.unionByName(there).withColumn("j", F.first("j", ignorenulls=True).over(along)).filter("i is not null and j is not null")

    jumps = s.select("timeline", "i", (F.col("i") + 1).alias("j"))
    for value, more in (("start", min_duration), ("words", min_words)):
        if more is not None:
            further = reached(value, float(more)).select("timeline", "i", F.col("j").alias("further"))
            jumps = jumps.join(further, ["timeline", "i"]).withColumn("j", F.greatest("j", "further")).drop("further")
    jumps = table(jumps)
    opened = table(s.filter("i = 0").select("timeline", "i"))
    known = opened.count()
    while True:
        to = jumps.join(opened, ["timeline", "i"], "left_semi").select("timeline", F.col("j").alias("i"))
        opened = table(opened.unionByName(to.join(s.select("timeline", "i"), ["timeline", "i"], "left_semi")).distinct())
        known, last = opened.count(), known
        if known == last:
            break
        twice = jumps.select("timeline", F.col("i").alias("j"), F.col("j").alias("further"))
        jumps = table(jumps.join(twice, ["timeline", "j"]).select("timeline", "i", F.col("further").alias("j")))
    marked = s.join(opened.withColumn("open", F.lit(1)), ["timeline", "i"], "left")
    grp = F.sum(F.coalesce("open", F.lit(0))).over(Window.partitionBy("timeline").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return marked.select("id", "timeline", grp.cast("long").alias("grp"))


def sentence_context(rows: DataFrame, max_context: int | None = None) -> DataFrame:
    """Context of each word (id, timeline, start, text, sentence, sentence_char, split): the sentences that ended before it in its
    timeline and split, and its own sentence up to the word's end. `max_context` keeps that many blanks' worth of words and one
    more. Words without a sentence, or without a place in it, have an empty context.

    Window expressions only. A sentence ends where the next placed word, with no word outside all sentences between them, is of
    another sentence and not further on in it. What ended is forgotten where the split changes, either there or at a word
    outside all sentences."""
    order = Window.partitionBy("timeline").orderBy("start", "id")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.col("sentence") != "", F.lit(False))
    placed = inside & F.col("sentence_char").isNotNull() & ~F.isnan(F.col("sentence_char").cast("double"))
    own = F.substring("sentence", F.lit(1), (F.col("sentence_char") + F.length("text")).cast("int"))
    # where contexts are short, words carry no more of their sentence than those need, and name it by a digest
    name, tail = F.col("sentence"), F.col("sentence")
    if max_context is not None:

        def cut(text: Column) -> Column:
            # the blank before the first word that is kept stays, so that what comes before it is not joined to it
            end = F.substring_index(text, " ", -max_context - 1)
            return F.when(F.length(end) < F.length(text), F.concat(F.lit(" "), end)).otherwise(text)

        name, tail, own = F.unhex(F.sha2("sentence", 256)), cut(F.col("sentence")), cut(own)
    w = rows.select("id", "timeline", "start", name.alias("sentence"), tail.alias("tail"), own.alias("own"), "sentence_char", "split", inside.alias("inside"), placed.alias("placed"))
    w = w.withColumn("stretch", F.sum((~F.col("inside")).cast("int")).over(so_far))
    w = w.withColumn("prev", F.last(F.when(F.col("placed"), F.struct("sentence", "tail", "sentence_char", "split", "stretch")), ignorenulls=True).over(before))
    # a word outside all sentences has begun a stretch of its own
    near = F.col("prev.stretch") == F.col("stretch") - F.when(F.col("inside"), 0).otherwise(1)
    ended = near & F.col("placed") & (F.col("sentence") != F.col("prev.sentence")) & (F.col("sentence_char") <= F.col("prev.sentence_char"))
    other = near & ~F.col("prev.split").eqNullSafe(F.col("split"))
    w = w.withColumn("ended", F.coalesce(ended, F.lit(False))).withColumn("reset", F.coalesce(other & (F.col("ended") | ~F.col("inside")), F.lit(False)))
    w = w.withColumn("era", F.sum(F.col("reset").cast("int")).over(so_far))
    w = w.withColumn("adds", F.col("ended") & ~F.col("reset"))
    era = Window.partitionBy("timeline", "era").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, 0)
    if max_context is None:
        context = F.concat(F.array_join(F.collect_list(F.when(F.col("adds"), F.col("prev.tail"))).over(era), ""), "own")
        return w.select("id", F.when(F.col("placed"), context).otherwise("").alias("context"))
    # sentences are folded by themselves, and only as many of their words as a context can hold go on to the words
    # `done` counts through all eras, so that all windows are of one sort
    w = table(w.withColumn("done", F.sum(F.col("adds").cast("int")).over(so_far)).select("id", "timeline", "era", "done", F.when(F.col("adds"), F.col("prev.tail")).alias("ended"), "placed", "own"))
    past = w.filter("ended is not null").select("timeline", "era", "done", F.col("ended").alias("before"))
    past = running_tail(past, ["timeline", "era"], "done", "before", max_context + 1)
    past = past.select(F.col("timeline").alias("_t"), F.col("era").alias("_e"), F.col("done").alias("_d"), "tail")
    joined = w.join(past, w["timeline"].eqNullSafe(past["_t"]) & (w["era"] == past["_e"]) & (w["done"] == past["_d"]), "left")
    context = F.substring_index(F.concat(F.coalesce("tail", F.lit("")), "own"), " ", -max_context - 1)
    return joined.select("id", F.when(F.col("placed"), context).otherwise("").alias("context"))


def pair_presses(rows: DataFrame) -> DataFrame:
    """Key presses with the next release of the same key (timeline, id, t, key, kind): duration to the release; a press
    followed by another press of the key has none, releases without a press are dropped. The next row of the key decides."""
    order = Window.partitionBy("timeline", "key").orderBy("t", "id")
    w = rows.select("id", "t", "kind", F.lead("kind").over(order).alias("then"), F.lead("t").over(order).alias("until"))
    return w.filter("kind = 'press'").select(F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"), F.when(F.col("then") != "press", F.col("until") - F.col("t")).cast("double").alias("duration"))


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sequence alignment join: rows of two ordered lists (key, ord, item) that an edit script matches."""

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("ord"), b.sort_values("ord")
        x, y = edit_match(a.item.tolist(), b.item.tolist())
        k = (a if len(a) else b)[key].iloc[0]
        return pd.DataFrame({key: [k] * len(x), "a": a.ord.to_numpy()[x], "b": b.ord.to_numpy()[y]}).astype({"a": "int64", "b": "int64"})

    kind = left.schema[key].dataType.simpleString()
    return left.select(key, "ord", "item").groupBy(key).cogroup(right.select(key, "ord", "item").groupBy(key)).applyInPandas(one, f"{key} {kind}, a long, b long")


def approximate_match(a: np.ndarray, b: np.ndarray, tolerance: float, missing: int, relative: float = 0.003) -> tuple[list[int], list[int]]:
    """Places of two ascending sequences whose successive differences agree within `tolerance`, or within `relative` of the lesser
    one: the longest such matching in which at most `missing` neighbours of either side are passed over between two matches; of
    equally long ones that with the least sum of disagreements, then the earliest.

    A row of places of `b` at a time: all ways to go on from the rows before are compared at once."""
    a, b = np.asarray(a, "f8"), np.asarray(b, "f8")
    n, m = len(a), len(b)
    if not n or not m:
        return [], []
    length, error, back = np.ones((n, m), np.int64), np.zeros((n, m)), np.full((n, m), -1)
    for i in range(n):
        for di in range(1, min(missing + 1, i) + 1):
            for dj in range(1, min(missing + 1, m - 1) + 1):
                da, db = a[i] - a[i - di], b[dj:] - b[:-dj]
                gap = np.abs(da - db)
                size, total = length[i - di, :-dj] + 1, error[i - di, :-dj] + gap
                ok = gap <= np.maximum(tolerance, relative * np.minimum(abs(da), np.abs(db)))
                ok &= (size > length[i, dj:]) | ((size == length[i, dj:]) & (total < error[i, dj:]))
                at = np.flatnonzero(ok)
                length[i, dj + at], error[i, dj + at], back[i, dj + at] = size[at], total[at], (i - di) * m + at
    best = np.where(length == length.max(), -error, -np.inf)
    at, x, y = int(best.argmax()), [], []
    while at >= 0:
        x.append(at // m)
        y.append(at % m)
        at = int(back[at // m, at % m])
    return x[::-1], y[::-1]


def alignment_classes(truth: Column, got: Column) -> Column:
    """Counts of characters that match, are substituted, or are added."""

    @F.pandas_udf("match long, substitution long, addition long")
    def classes(t: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(t, g, strict=True):
            n = Counter()
            for op, i, j, k, l in difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes():
                n["match" if op == "equal" else "substitution" if op == "replace" else "addition"] += l - k if op != "delete" else 0
            rows.append((n["match"], n["substitution"], n["addition"]))
        return pd.DataFrame(rows, columns=["match", "substitution", "addition"]).astype("int64")

    return classes(truth, got)


def words_in_text(words: list[str], text: str) -> list[int]:
    """Place of each word in the text, in order, -1 where it is not found behind the one before: first as whole words,
    then by the place that most of its letters vote for, of equal ones one where a word begins, then the first."""
    out, at = [], 0
    for w in words:
        place = text.find(w, at)
        if place < 0:
            votes = Counter(p - k for k, c in enumerate(w) for p in range(at, min(len(text), at + 4 * len(w))) if text[p] == c)
            best = min((k for k in votes if k >= at), key=lambda k: (-votes[k], k > 0 and not text[k - 1].isspace(), k), default=-1)
            place = best if best >= 0 and votes[best] * 2 > len(w) else -1
        out.append(place)
        if place >= 0:
            at = place + len(w)
    return out


def common_ends_diff(old: Column, new: Column) -> Column:
    """The smallest replacement: struct(prefix, removed, added) by common prefix and suffix."""

    @F.pandas_udf("prefix long, removed string, added string")
    def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            x, y = x or "", y or ""
            n, most = 0, min(len(x), len(y))
            while n < most and x[n] == y[n]:
                n += 1
            k = 0
            while k < most - n and x[-1 - k] == y[-1 - k]:
                k += 1
            rows.append((n, x[n : len(x) - k], y[n : len(y) - k]))
        return pd.DataFrame(rows, columns=["prefix", "removed", "added"])

    return diff(old, new)


def recover_json(text: Column) -> Column:
    """JSON without code fences; a truncated array ends behind its last whole object."""

    @F.pandas_udf("string")
    def recover(s: pd.Series) -> pd.Series:
        import json

        def one(t):
            if t is None:
                return None
            t = t.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
            try:
                return json.dumps(json.loads(t))
            except ValueError:
                cut = t.rfind("}")
                try:
                    return json.dumps(json.loads(t[: cut + 1] + "]")) if cut >= 0 and t.startswith("[") else None
                except ValueError:
                    return None

        return s.map(one)

    return recover(text)


def unique_anchor(text: Column, before: Column, find: Column, after: Column) -> Column:
    """Where `find` stands between its contexts, blanks folded: its place, -1 for none, -2 for more than one."""

    @F.pandas_udf("long")
    def anchor(t: pd.Series, b: pd.Series, f: pd.Series, a: pd.Series) -> pd.Series:
        out = []
        for text_, *parts in zip(t, b, f, a, strict=True):
            keep = [(i, c) for i, c in enumerate(text_ or "") if not (c.isspace() and i and (text_[i - 1]).isspace())]
            flat = "".join(" " if c.isspace() else c for _, c in keep)
            pre, mid, post = (" ".join((p or "").split()) for p in parts)
            hits, at = [], flat.find(mid) if mid else -1
            while at >= 0:
                # blanks are folded, so at most one stands before and behind
                end = at + len(mid)
                if flat.endswith(pre, 0, at - (flat[at - 1 : at] == " ")) and flat.startswith(post, end + (flat[end : end + 1] == " ")):
                    hits.append(at)
                at = flat.find(mid, at + 1)
            out.append(-1 if not hits else -2 if len(hits) > 1 else keep[hits[0]][0])
        return pd.Series(out, dtype="int64")

    return anchor(text, before, find, after)


def ridge_by_step(rows: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Linear decoding (step, id, x: array, y) for each time step: fit on even ids, correlation on odd ones.

    A step's fit needs sums of products only, which are aggregated like any sums; each task solves the small systems of the steps
    that it has."""
    even = rows.filter("id % 2 = 0").withColumn("z", F.concat(F.array(F.lit(1.0)), "x", F.array("y")))
    cells = even.select("step", F.posexplode("z").alias("i", "u"), "z").select("step", "i", "u", F.posexplode("z").alias("j", "v")).filter("i <= j")
    sums = cells.groupBy("step", "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("s")).groupBy("step").agg(F.collect_list(F.struct("i", "j", "s")).alias("m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m in b.m:
                k = max(c["j"] for c in m) + 1
                a = np.zeros((k, k))
                for c in m:
                    a[c["i"], c["j"]] = a[c["j"], c["i"]] = c["s"]
                n, mean = a[0, 0], a[0] / a[0, 0]
                spread = a - n * np.outer(mean, mean)
                w = np.linalg.solve(spread[1:-1, 1:-1] + penalty * np.eye(k - 2), spread[1:-1, -1])
                out.append([mean[-1] - mean[1:-1] @ w, *w])
            yield pd.DataFrame({"step": b.step, "w": out})

    fits = sums.mapInPandas(solve, "step long, w array<double>")
    guess = F.aggregate(F.zip_with("x", F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: a * b), F.element_at("w", 1), lambda a, b: a + b)
    odd = rows.filter("id % 2 <> 0").join(fits, "step").select("step", "y", guess.alias("p"))
    spread = F.stddev_pop("p") * F.stddev_pop("y")
    scores = odd.groupBy("step").agg(F.when((F.count("*") > 1) & (spread > 0), F.covar_pop("p", "y") / F.when(spread > 0, spread)).otherwise(F.lit(float("nan"))).alias("r"))
    return rows.groupBy("step").agg(F.count("*").alias("n")).join(scores, "step", "left").select("step", "n", F.coalesce("r", F.lit(float("nan"))).alias("r"))


def cosine_pairs(x: DataFrame, least: float) -> DataFrame:
    """(a, b, c) with a > b: pairs of unit vectors (d, w, x) whose cosine c is at least `least`.

    Words are taken from the rarest on. Where the rest of a vector is shorter than `least`, two vectors that only share words of that
    rest cannot reach it, so one of them meets the other by a word before it: frequent words make no pairs."""
    often = x.groupBy("w").agg(F.count("*").alias("n"))
    rest = F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("d").orderBy("n", "w").rowsBetween(0, Window.unboundedFollowing))
    head = x.join(often, "w").select("d", "w", "x", rest.alias("rest")).filter(F.col("rest") >= (least - 1e-9) ** 2)
    met = head.select(F.col("d").alias("p"), "w").join(x.select(F.col("d").alias("q"), "w"), "w").filter("p <> q")
    met = met.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
    one, two = (x.select(F.col("d").alias(n), "w", F.col("x").alias(f"x{n}")) for n in "ab")
    pairs = met.join(one, "a").join(two, ["b", "w"]).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("c"))
    return pairs.filter(F.col("c") >= least - 1e-12)


def monte_carlo(spark, trials: int, seed: int, steps: int = 16) -> DataFrame:
    """Tiers that trials reach, each trial with its own seeded generator: (tier, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tier = [int((np.random.default_rng([seed, int(i)]).random(steps) > 0.5).sum()) // 4 for i in b.id]
            yield pd.DataFrame({"tier": np.array(tier, "int64")})

    return spark.range(trials).mapInPandas(run, "tier long").groupBy("tier").agg(F.count("*").alias("n"))


def beam_search(logits: np.ndarray, bonus: np.ndarray, width: int) -> list[int]:
    """Best path of states: sum of log probabilities and of the pair bonus, `width` paths kept a step."""
    paths = [((), 0.0)]
    for row in logits:
        new = [(p + (s,), v + x + (bonus[p[-1], s] if p else 0.0)) for p, v in paths for s, x in enumerate(row)]
        paths = sorted(new, key=lambda t: (-t[1], t[0]))[:width]
    return list(paths[0][0])
