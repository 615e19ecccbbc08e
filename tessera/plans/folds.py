"""Folds, alignments, fuzzy scores, splits and components, as registered queries (most are not expressible in SQL)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import alignment, cluster, ngrams
from tessera.operators import folds as L
from tessera.operators.components import fit_components, project
from tessera.operators.graph import connected
from tessera.plans.measures import TFIDF_SQL, tfidf
from tessera.registry import register
from tessera.tables import INTERVALS_SQL, intervals, load


MOST_CLUSTERS = 1_000_000


def split_clusters(rows: DataFrame, id_col: str, ratios: dict[str, float]) -> DataFrame:
    """(id, split): whole clusters, in the order of their least ids, packed to splits. The driver folds the clusters' sizes, at
    most MOST_CLUSTERS of them."""
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min(id_col).alias("o")).orderBy("o").limit(MOST_CLUSTERS + 1).collect()
    if len(sizes) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters: raise the distance that joins them, or use the hash split")
    packed = L.pack_clusters({r["cluster"]: r["n"] for r in sizes}, ratios)
    kind = rows.schema["cluster"].dataType.simpleString()
    splits = rows.sparkSession.createDataFrame(list(packed.items()), f"cluster {kind}, split string")
    return rows.join(splits, "cluster", "left").select(id_col, F.coalesce("split", F.lit("undefined")).alias("split"))


@register("d01_hash_split")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", L.hash_split(F.col("doc_id"), {"train": 0.8, "val": 0.1, "test": 0.1}).alias("split"))


@register("d02_sentence_group_split")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    """Splits by sentence; a conversation whose sentences fall into several is undefined."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", L.hash_split(F.col("text"), {"train": 0.5, "test": 0.5}, seed=0).alias("split"))
    one = c.groupBy("conv_id").agg(F.count_distinct("split").alias("n"), F.min("split").alias("s"))
    return one.select("conv_id", F.when(F.col("n") > 1, "undefined").otherwise(F.col("s")).alias("split"))


@register("d04_cluster_packing")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as clusters, whole clusters packed to splits; the driver folds the cluster counts, one row a cluster."""
    e = load(spark, sf, "embeddings").select("vec_id", "label")
    return split_clusters(e.withColumnRenamed("label", "cluster"), "vec_id", {"train": 0.6, "val": 0.25, "test": 0.15})


@register("d04_similarity_split")
def d04_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Items clustered by complete linkage of their word weights, whole clusters packed to splits."""
    items = load(spark, sf, "benchmark").select("item_id", "text")
    found = cluster.complete_linkage(L.cosine_pairs(tfidf(items, "item_id"), 0.2), 0.8).withColumnRenamed("id", "item_id")
    clustered = items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("cluster", "item_id").alias("cluster"))
    return split_clusters(clustered, "item_id", {"train": 0.7, "val": 0.15, "test": 0.15}).join(clustered, "item_id")


@register("d05_similarity_components", TFIDF_SQL + """, lk AS (SELECT a.d AS a, b.d AS b FROM x a JOIN x b ON a.w = b.w AND a.d <> b.d JOIN l la ON la.d = a.d JOIN l lb ON lb.d = b.d GROUP BY 1, 2 HAVING sum(a.x * b.x / la.l / lb.l) > 0.3),
it(a) AS (SELECT item_id FROM benchmark) SELECT it.a AS item_id, coalesce(least(it.a, (WITH RECURSIVE r(b) AS (SELECT it.a UNION SELECT lk.b FROM r JOIN lk ON lk.a = r.b) SELECT min(b) FROM r)), it.a) AS component FROM it""")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    """Components of items whose word weights have a cosine over 0.3, through the words that they share."""
    items = load(spark, sf, "benchmark").select("item_id", "text")
    x = tfidf(items, "item_id")
    near = L.cosine_pairs(x, 0.3).filter("c > 0.3")
    found = connected(near.select("a", "b")).withColumnRenamed("id", "item_id")
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("component", "item_id").alias("component"))


def sentence_words(c: DataFrame) -> DataFrame:
    """All words of all turns, as `sentence_context` takes them: a turn is a sentence, a conversation a timeline."""
    words = F.split("text", " ")
    place = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.when(k > 0, F.length(F.call_function("substring_index", "text", F.lit(" "), k)) + 1).otherwise(0))
    w = c.select("conv_id", "turn", F.col("text").alias("sentence"), F.posexplode(F.arrays_zip(words.alias("text"), place.alias("at"))).alias("k", "w"))
    w = w.select("conv_id", "turn", "sentence", "k", "w.text", F.col("w.at").cast("double").alias("sentence_char"))
    return w.select(F.struct("conv_id", "turn", F.col("k").cast("long").alias("k")).alias("id"), F.col("conv_id").alias("timeline"), F.col("turn").alias("start"), "text", "sentence", "sentence_char", F.lit("train").alias("split"))


@register("w04_sentence_context", r"""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN text <> lead(text) OVER (PARTITION BY conv_id ORDER BY turn) THEN text ELSE '' END AS done FROM conversations),
p AS (SELECT *, coalesce(string_agg(done, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS past, string_split(text, ' ') AS words FROM c),
w AS (SELECT conv_id, turn, text, past, unnest(range(len(words))) AS k, words FROM p),
x AS (SELECT conv_id, turn, k, past || substr(text, 1, length(array_to_string(words[1:k + 1], ' '))) AS context FROM w)
SELECT conv_id, turn, k, array_to_string(list_reverse(list_reverse(string_split(context, ' '))[1:21]), ' ') AS context FROM x""")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every turn in its sentence, with the context before it."""
    # words are many times their turns, so turns are spread before they are cut
    w = sentence_words(load(spark, sf, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return L.sentence_context(w, 20).select("id.*", "context")


@register("w07_press_release_pairs", f"""
WITH {INTERVALS_SQL}, n AS (SELECT event_id, start, type, lead(type) OVER w AS then_, lead(start) OVER w AS until FROM ev WHERE type IN ('click', 'view') WINDOW w AS (PARTITION BY timeline, event_id % 3 ORDER BY start, event_id))
SELECT event_id AS id, start AS t, CASE WHEN then_ <> 'click' THEN round(until - start, 6) END AS duration FROM n WHERE type = 'click'""")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    e = intervals(spark, sf).filter("type in ('click', 'view')")
    pairs = L.pair_presses(e.select("timeline", F.col("event_id").alias("id"), F.col("start").alias("t"), (F.col("event_id") % 3).cast("string").alias("key"), F.when(F.col("type") == "click", "press").otherwise("release").alias("kind")))
    return pairs.withColumn("duration", F.round("duration", 6))


@register("w09_merge_sentences")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("timeline"), F.col("turn").cast("double").alias("start"), "text")
    return L.merge_sentences(c, min_words=40)


@register("j19_sequence_alignment")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    a = e.select("user_id", order.alias("ord"), F.col("event_type").alias("item"))
    return L.align(a, a.filter("ord % 5 <> 0"), "user_id")


@register("j20_approximate_sequence_match")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    e = intervals(spark, sf).filter("type = 'click'").select("timeline", "start")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.sort(pdf.start.to_numpy())
        x, y = L.approximate_match(a, np.delete(a, np.arange(3, len(a), 7)) + 100.0, 1.0, 1)
        return pd.DataFrame({"timeline": pdf.timeline.iloc[0], "a": np.array(x, "int64"), "b": np.array(y, "int64")})

    return e.groupBy("timeline").applyInPandas(match, "timeline long, a long, b long")


@register("j21_concat_after_alignment", "SELECT conv_id, k, a, b FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn AS a FROM conversations WHERE role = 'user') JOIN (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn AS b FROM conversations WHERE role = 'assistant') USING (conv_id, k)")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    side = lambda role, n: c.filter(F.col("role") == role).select("conv_id", F.col("turn").alias(n), k.alias("k"))
    return side("user", "a").join(side("assistant", "b"), ["conv_id", "k"])


@register("j22_words_in_text", r"""
WITH p AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(lower(text), '\s+$', ''), '\s*\S+') AS parts FROM conversations)
SELECT conv_id, turn, list_transform(range(1, len(parts) + 1), lambda i: CAST(length(array_to_string(parts[1:i], '')) - length(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(13))) AS INTEGER)) AS places FROM p""")
def j22(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("array<int>")
    def places(t: pd.Series) -> pd.Series:
        return t.map(lambda s: L.words_in_text((s or "").lower().split(), (s or "").lower()))

    return load(spark, sf, "conversations").select("conv_id", "turn", places("text").alias("places"))


@register("x08_unique_anchor")
def x08(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    at = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    return load(spark, sf, "conversations").select("conv_id", "turn", L.unique_anchor(F.col("text"), at(1), at(2), at(3)).alias("place"))


@register("x09_minimal_diff", """
WITH t AS (SELECT p_partkey, p_name AS x, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN substr(p_name, 1, 3) || lower(p_type) || substr(p_name, 6) ELSE substr(p_name, 2) END AS y FROM part),
n AS (SELECT *, list_max(list_filter(range(least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i))) AS n FROM t),
k AS (SELECT *, list_max(list_filter(range(least(length(x), length(y)) - n + 1), lambda i: right(x, i) = right(y, i))) AS k FROM n)
SELECT p_partkey, n AS prefix, substr(x, n + 1, length(x) - k - n) AS removed, substr(y, n + 1, length(y) - k - n) AS added FROM k""")
def x09(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    new = F.when(k == 0, F.concat_ws(" ", n, F.lower("p_type"))).when(k == 1, F.concat(F.substring(n, 1, 3), F.lower("p_type"), F.substring(n, 6, 1000))).otherwise(F.substring(n, 2, 1000))
    d = L.common_ends_diff(n, new)
    return load(spark, sf, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.prefix", "d.removed", "d.added")


@register("x18_recover_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("```json\n["), "props", F.when(F.col("event_id") % 2 == 0, "]\n```").otherwise(', {"k": 1, "cut'))
    return load(spark, sf, "events").select("event_id", F.get_json_object(L.recover_json(raw), "$[0].k").cast("long").alias("k"))


@register("x19_citation_objects", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'case' ELSE 'document' END AS kind, least(3, 1 + p_size % 5) AS n_quotes, CASE WHEN p_size > 10 THEN p_size END AS page FROM part")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, "c1").alias("cluster"), F.array_repeat("p_name", (1 + F.col("p_size") % 5).cast("int")).alias("quotes"), F.when(F.col("p_size") > 10, F.concat(F.lit("p. "), F.col("p_size").cast("string"))).otherwise("n/a").alias("page")))
    o = F.from_json(raw, "cluster string, quotes array<string>, page string")
    return load(spark, sf, "part").select("p_partkey", o.alias("o")).select("p_partkey", F.when(F.col("o.cluster").isNotNull(), "case").otherwise("document").alias("kind"), F.size(F.slice("o.quotes", 1, 3)).alias("n_quotes"), F.nullif(F.regexp_extract("o.page", r"(\d+)", 1), F.lit("")).cast("int").alias("page"))


@register("x21_fuzzy_grounding")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn grounded in the next one: the better of two fuzzy ratios, then tiers."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", X.quote_norm(F.col("text")).alias("q"))
    c = c.withColumn("b", F.lead("q").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    s = c.select("conv_id", "turn", alignment.grounding_score(F.col("q"), F.col("b")).alias("score"))
    return s.withColumn("status", F.when(F.col("score") >= 80, "verified").when(F.col("score") >= 55, "fuzzy").otherwise("not_found"))


@register("x22_transcript_similarity")
def x22(spark: SparkSession, sf: str) -> DataFrame:
    """Token-set similarity of each turn with the next one, then tiers; a next turn of under 200 characters is too short to judge."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(alignment.token_set_ratio(x, y), 1) for x, y in zip(a, b, strict=True)], dtype="f8")

    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", " "), r"\s+", " "))
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text", norm.alias("t"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    p = c.withColumn("n", F.lead("t").over(order)).withColumn("next", F.lead("text").over(order)).filter("n is not null")
    early = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no_transcript").when(F.col("next") == "", "no_captions").when(F.length("n") < 200, "captions_too_short")
    p = p.withColumn("early", early).withColumn("score", F.when(F.col("early").isNull(), ratio("t", "n")).otherwise(0.0))
    status = F.coalesce("early", F.when(F.col("score") >= 75, "verified").when(F.col("score") >= 55, "partial").otherwise("mismatch"))
    return p.select("conv_id", "turn", "score", status.alias("status"))


@register("x24_word_error_rate")
def x24w(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn against the next one."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("then"))
    return c.filter("then is not null").select("conv_id", "turn", alignment.word_error_rate(F.col("text"), F.col("then")).alias("wer"))


@register("x25_alignment_classes")
def x25(spark: SparkSession, sf: str) -> DataFrame:
    k = L.alignment_classes(F.col("p_name"), F.lower("p_type"))
    return load(spark, sf, "part").select("p_partkey", k.alias("k")).select("p_partkey", "k.match", "k.substitution", "k.addition")


@register("x37_landmark_offset", "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2 - embedding[5]::DOUBLE, 6) AS dx, round((embedding[2]::DOUBLE + embedding[4]::DOUBLE) / 2 - embedding[6]::DOUBLE, 6) AS dy FROM embeddings")
def x37(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return load(spark, sf, "embeddings").select("vec_id", F.round((at(1) + at(3)) / 2 - at(5), 6).alias("dx"), F.round((at(2) + at(4)) / 2 - at(6), 6).alias("dy"))


@register("a26_monte_carlo")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return L.monte_carlo(spark, 2000, 42)


@register("o07_beam_search")
def o07(spark: SparkSession, sf: str) -> DataFrame:
    """Eight steps of eight states each, from each vector's components, with a fixed pair bonus."""
    bonus = np.fromfunction(lambda i, j: 0.05 * ((i * 3 + j * 5) % 7), (8, 8))

    @F.pandas_udf("array<int>")
    def path(v: pd.Series) -> pd.Series:
        return v.map(lambda x: L.beam_search(np.array(x, "f8").reshape(8, 8), bonus, 5))

    return load(spark, sf, "embeddings").select("vec_id", path("embedding").alias("path"))


@register("o07_ngram_beam")
def o07_ngram(spark: SparkSession, sf: str) -> DataFrame:
    """Eight steps over eight characters, from each vector's components, with a back-off model of all turns' characters."""
    model = ngrams.BackOff(load(spark, sf, "conversations").select(ngrams.spaced(F.col("text")).alias("text")))
    e = load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    e = e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("step"), F.element_at(F.array(*map(F.lit, "etaonr7&")), (F.col("i") % 8 + 1).cast("int")).alias("c"), (F.col("x").cast("double") * 8).alias("x"))
    total = F.log(F.sum(F.exp("x")).over(Window.partitionBy("vec_id", "step")))
    found = ngrams.beam_decode(e.withColumn("p", F.col("x") - total).drop("x"), model, width=5, labels=6, id_col="vec_id")
    return found.select("vec_id", F.replace("text", F.lit("&"), F.lit(" ")).alias("text"), F.round("score", 6).alias("score"))


@register("t01_overlap_slice", f"WITH {INTERVALS_SQL} SELECT event_id, CAST(greatest(0, least(9, floor(duration / 1000))) AS INTEGER) AS first, CAST(least(3, 10 - greatest(0, least(9, floor(duration / 1000)))) AS INTEGER) AS n FROM ev")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    """Slice of ten samples that a window of three covers, at least one sample, pulled back at the right end."""
    first = F.greatest(F.lit(0), F.least(F.lit(9), F.floor(F.col("duration") / 1000))).cast("int")
    samples = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("double"))
    return intervals(spark, sf).select("event_id", first.alias("first"), samples.alias("s")).select("event_id", "first", F.size(F.slice("s", F.col("first") + 1, F.lit(3))).alias("n"))


@register("t10_principal_components")
def t10(spark: SparkSession, sf: str) -> DataFrame:
    """Four principal components; the covariance is one distributed aggregate of fixed size."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = load(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    out = PCA(k=4, inputCol="v", outputCol="p").fit(v).transform(v)
    return out.select("vec_id", F.transform(vector_to_array("p"), lambda x: F.round(F.abs(x), 5)).alias("p"))


@register("t10_incremental_components")
def t10_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Four components of the factors of batches of 200 rows, which merge at full rank: nothing is lost."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding")
    out = project(e, "embedding", fit_components(e, "embedding", keep=64, batch=200), 4)
    return out.select("vec_id", F.transform("p", lambda x: F.round(F.abs(x), 5)).alias("p"))


@register("t10_merged_scatter", "SELECT i AS place, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 4) AS scatter FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1")
def t10_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, mean and squared deviations of each component, read from the merged factors alone."""
    f = fit_components(load(spark, sf, "embeddings"), "embedding", keep=64, batch=200)
    rows = [(i, f.n, float(m), float(s)) for i, (m, s) in enumerate(zip(f.mean, (f.scaled**2).sum(axis=0), strict=True))]
    out = spark.createDataFrame(rows, "place long, n long, mean double, scatter double")
    return out.select("place", "n", F.round("mean", 6).alias("mean"), F.round("scatter", 4).alias("scatter"))


@register("t13_decode_by_step")
def t13(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen steps: four components each decode the next one, linear with a ridge."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = e.select("id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("k"), "embedding")
    rows = rows.select(F.col("k").cast("long").alias("step"), "id", F.transform(F.slice("embedding", F.col("k") * 4 + 1, F.lit(4)), lambda x: x.cast("double")).alias("x"), F.element_at("embedding", F.col("k") * 4 + 5).cast("double").alias("y"))
    return L.ridge_by_step(rows)
