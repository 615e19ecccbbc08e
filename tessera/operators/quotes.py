"""Quotes in texts: where a quote stands in a document's blocks, and how well a text grounds it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.alignment import groundings

KEY = 30  # characters of a segment that are looked for
ENTRIES = 64  # quotes that share a copy of a body


def locate_quotes(blocks: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc, quote_id, block, since, until): which letters and digits of each block of a document a quote covers.

    `blocks` is (doc, block, text) in the order of `block`, `quotes` is (doc, quote_id, quote). A quote is cut at ellipses; a segment is
    found by its first KEY letters and digits, without case, in the blocks' joined text, and reaches over as many as it has. Where
    segments meet in a block, the later one counts."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))
    before = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.select("doc", "block", bare(F.coalesce("text", F.lit(""))).alias("bare"))
    b = b.withColumn("at", F.coalesce(F.sum(F.length("bare")).over(before), F.lit(0)))
    whole = b.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "bare"))), lambda x: x["bare"]), "").alias("whole"))
    cut = F.filter(F.transform(F.split("quote", r"\.{3}|…"), bare), lambda s: s != "")
    s = quotes.select("doc", "quote_id", F.posexplode(cut).alias("k", "segment")).join(whole, "doc")
    s = s.select("doc", "quote_id", "k", (F.position(F.substring("segment", 1, KEY), "whole") - 1).alias("since"), F.length("segment").alias("n")).filter("since >= 0")
    hit = s.join(b, "doc").filter((F.col("since") < F.col("at") + F.length("bare")) & (F.col("since") + F.col("n") > F.col("at")))
    since, until = F.greatest(F.lit(0), F.col("since") - F.col("at")), F.least(F.length("bare"), F.col("since") + F.col("n") - F.col("at"))
    return hit.groupBy("doc", "quote_id", "block").agg(F.max_by(F.struct(since.cast("long").alias("since"), until.cast("long").alias("until")), "k").alias("r")).select("doc", "quote_id", "block", "r.since", "r.until")


def ground_entries(entries: DataFrame, bodies: DataFrame) -> DataFrame:
    """(entry, slug, score, passage, status): how well the body of the slug that an entry cites grounds the entry's quote.

    `entries` is (entry, slug, quote), `bodies` is (slug, text); an entry whose slug has no body has no row, an entry that cites several slugs
    has one for each. Both sides are normalised; the score is the better of the two fuzzy ratios over the whole body. The
    recorded text begins at the first place in the body of the quote's first word, as the verifier's records do. Entries go to a body in
    groups of ENTRIES, so that a body which very many cite is not copied for each and its entries spread over tasks."""
    q = entries.select("entry", "slug", X.quote_norm(F.coalesce("quote", F.lit(""))).alias("q"))
    sizes = q.groupBy("slug").agg(F.count("*").alias("n"))
    held = bodies.join(sizes, "slug").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ENTRIES).cast("int"))))
    dealt = q.join(sizes, "slug").withColumn("part", F.pmod(F.xxhash64("entry", "q"), F.floor((F.col("n") - 1) / ENTRIES) + 1).cast("int"))
    groups = dealt.groupBy("slug", "part").agg(F.collect_list(F.struct("entry", "q")).alias("quotes"))

    @F.pandas_udf("array<struct<score: double, passage: string>>")
    def score(body: pd.Series, quotes: pd.Series) -> pd.Series:
        pairs = [(text, b) for b, some in zip(body, quotes, strict=True) for text in some]
        found = []
        for (text, b), v in zip(pairs, groundings(*zip(*pairs, strict=True)) if pairs else [], strict=True):
            at = b.find(text.split(" ")[0]) if text else -1
            found.append({"score": v, "passage": b[at : at + max(len(text) + 40, 80)][:300] if at >= 0 else ""})
        each = iter(found)
        return pd.Series([[next(each) for _ in some] for some in quotes])

    met = held.select("slug", "part", X.quote_norm(F.coalesce("text", F.lit(""))).alias("body")).join(groups, ["slug", "part"])
    found = met.select("slug", F.explode(F.arrays_zip("quotes", score("body", "quotes.q").alias("found"))).alias("x"))
    tier = F.when(F.col("score") >= 80, "verified").when(F.col("score") >= 55, "fuzzy").otherwise("not_found")
    return found.select("x.quotes.entry", "slug", "x.found.score", "x.found.passage").withColumn("status", tier)


def verbatim_hits(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, doc_id) where a document's text (doc_id, text) holds a quote (quote_id, text), blanks and quotation marks folded.

    The words between a quote's first and last one stand as whole words in whatever holds it, so the one of them in the fewest
    documents names the candidates, and only those are compared. Quotes of one or two words have no such word; they are
    compared with the documents' distinct words, or pairs of neighbours, instead."""
    q = quotes.select("quote_id", X.verbatim_norm(F.col("text")).alias("q")).filter("q is not null").withColumn("words", F.split("q", " "))
    d = docs.select("doc_id", X.verbatim_norm(F.col("text")).alias("t")).filter("t is not null")
    inner = q.filter(F.size("words") > 2).select("quote_id", F.explode(F.array_distinct(F.expr("slice(words, 2, size(words) - 2)"))).alias("w"))
    index = d.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("w")).join(inner.select("w").distinct(), "w")
    often = index.groupBy("w").agg(F.count("*").alias("n"))
    rarest = inner.join(often, "w", "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("m")).select("quote_id", "m.w")
    met = rarest.join(index, "w").select("quote_id", "doc_id").join(q.select("quote_id", "q"), "quote_id").join(d, "doc_id")
    hits = met.filter(F.contains("t", "q")).select("quote_id", "doc_id")
    short = q.filter(F.size("words") <= 2).select("quote_id", "q", F.size("words").alias("k"))
    if short.isEmpty():
        return hits
    parts = F.split("t", " ")
    pairs = F.expr("transform(sequence(1, greatest(size(split(t, ' ')) - 1, 1)), i -> concat_ws(' ', slice(split(t, ' '), i, 2)))")
    runs = d.select("doc_id", F.explode(F.array_distinct(parts)).alias("run"), F.lit(1).alias("k")).unionByName(d.select("doc_id", F.explode(F.array_distinct(pairs)).alias("run"), F.lit(2).alias("k")))
    known = runs.select("run", "k").distinct().join(short, "k").filter(F.contains("run", "q")).select("run", "k", "quote_id")
    return hits.unionByName(runs.join(known, ["run", "k"]).select("quote_id", "doc_id").distinct())
