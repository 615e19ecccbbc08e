"""Metrics, retrieval, scaling and array features, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import intervals as I
from tessera.operators import raster
from tessera.operators.order import average_ranks
from tessera.operators.search import product_ranks, top_products
from tessera.registry import register
from tessera.tables import INTERVALS_SQL, intervals, load


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


@register("m01_online_pearson", "SELECT d, round(corr(x, y), 6) AS r FROM (SELECT unnest(range(32)) AS d, unnest(list_slice(embedding, 1, 32))::DOUBLE AS x, unnest(list_slice(embedding, 33, 64))::DOUBLE AS y FROM embeddings) GROUP BY 1")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of two outputs for each dimension; a constant one has none (null)."""
    e = vectors(spark, sf).select(F.posexplode(F.arrays_zip(F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))).alias("d", "p")).select(F.col("d").cast("long").alias("d"), "p.x", "p.y")
    sd = F.stddev_pop("x") * F.stddev_pop("y")
    return e.groupBy("d").agg(F.round(F.when(sd > 0, F.covar_pop("x", "y") / F.when(sd > 0, sd)), 6).alias("r"))


@register("m02_mean_error_rate", "SELECT p_type, round(avg(levenshtein(p_name, p_brand) / greatest(length(p_name), 1)), 6) AS cer FROM part GROUP BY 1")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.levenshtein("p_name", "p_brand") / F.greatest(F.length("p_name"), F.lit(1))
    return load(spark, sf, "part").groupBy("p_type").agg(F.round(F.avg(rate), 6).alias("cer"))


#: Queries of the retrieval metrics: every vector whose id is divisible by 100, perturbed by its neighbour; all vectors are
#: candidates.
RANK_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT a.vec_id AS id, list_transform(list_zip(a.v, b.v), lambda z: z[1] + 0.9::DOUBLE * z[2]) AS x, a.label FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0),
s AS (SELECT q.id, v.vec_id, list_dot_product(q.x, v.v) / sqrt(list_dot_product(v.v, v.v)) AS s FROM q, v), o AS (SELECT id, s FROM s WHERE id = vec_id),
r AS (SELECT s.id, count(*) FILTER (WHERE s.vec_id <> s.id AND s.s > o.s + 1e-12) AS greater, count(*) FILTER (WHERE s.vec_id <> s.id AND s.s >= o.s - 1e-12) AS not_less FROM s JOIN o ON o.id = s.id GROUP BY 1)"""


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    q = v.filter("vec_id % 100 = 0").join(b, "vec_id").select(F.col("vec_id").alias("id"), F.zip_with("v", "w", lambda x, y: x + F.lit(0.9) * y).alias("vec"))
    return product_ranks(q, v.select(F.col("vec_id").alias("id"), F.col("v").alias("vec")))


@register("m03_retrieval_rank", RANK_SQL + " SELECT id, (greater + not_less) / 2 AS rank FROM r")
def m03(spark: SparkSession, sf: str) -> DataFrame:
    return ranks(spark, sf).select("id", ((F.col("greater") + F.col("not_less")) / 2).alias("rank"))


@register("m04_similarity_norms", "SELECT vec_id, round(list_dot_product(a, b), 5) AS plain, round(list_dot_product(a, b) / sqrt(list_dot_product(b, b)), 5) AS by_y, round(list_cosine_similarity(a, b), 5) AS by_xy FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings)")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("vec_id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return v.select("vec_id", *(F.round(A.similarity(F.col("a"), F.col("b"), by), 5).alias(n) for by, n in (("none", "plain"), ("y", "by_y"), ("xy", "by_xy"))))


@register("m05_topk_accuracy", RANK_SQL + ", c AS (SELECT q.label, avg(CASE WHEN (greater + not_less) / 2 < 5 THEN 1.0 ELSE 0.0 END) AS acc FROM r JOIN q ON q.id = r.id GROUP BY 1) SELECT round(avg(acc), 6) AS macro FROM c")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    l = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    hit = F.when((F.col("greater") + F.col("not_less")) / 2 < 5, 1.0).otherwise(0.0)
    return ranks(spark, sf).join(l, "id").groupBy("label").agg(F.avg(hit).alias("acc")).agg(F.round(F.avg("acc"), 6).alias("macro"))


@register("m06_topk_from_scores", "SELECT round(avg(CASE WHEN k <= 3 THEN 1.0 ELSE 0.0 END), 6) AS acc FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS k FROM (SELECT vec_id, unnest(embedding) AS s, unnest(range(64)) AS i FROM embeddings)) WHERE i = 0")
def m06(spark: SparkSession, sf: str) -> DataFrame:
    """Share of rows whose first score is among the three best; ties go to the earlier column."""
    before = F.size(F.filter("v", lambda x: x > F.element_at("v", 1)))
    return vectors(spark, sf).agg(F.round(F.avg(F.when(before < 3, 1.0).otherwise(0.0)), 6).alias("acc"))


@register("m07_macro_rank", RANK_SQL + ", c AS (SELECT q.label, avg((greater + not_less) / 2) AS m FROM r JOIN q ON q.id = r.id GROUP BY 1) SELECT label, round(m, 6) AS m FROM c")
def m07(spark: SparkSession, sf: str) -> DataFrame:
    l = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return ranks(spark, sf).join(l, "id").groupBy("label").agg(F.round(F.avg((F.col("greater") + F.col("not_less")) / 2), 6).alias("m"))


@register("m08_balanced_accuracy", "SELECT round(avg(r), 6) AS balanced FROM (SELECT quality, avg(CASE WHEN (n_chars > 800)::INTEGER = quality THEN 1.0 ELSE 0.0 END) AS r FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1)")
def m08(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 800).cast("int").alias("guess"))
    recall = F.avg(F.when(F.col("guess") == F.col("quality"), 1.0).otherwise(0.0))
    return load(spark, sf, "labels").join(d, "doc_id").groupBy("quality").agg(recall.alias("r")).agg(F.round(F.avg("r"), 6).alias("balanced"))


@register("m09_regression", """
WITH g AS (SELECT user_id, avg(value) AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM g)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM k""")
def m09(spark: SparkSession, sf: str) -> DataFrame:
    """Over per-user aggregates; ranks from ranges of values."""
    g = load(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("y"))
    k = average_ranks(average_ranks(g.select("x", "y"), "x", "rx"), "y", "ry")
    return k.agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@register("m10_signed_rank", """
WITH d AS (SELECT avg(value) - 9.5::DOUBLE AS d FROM events GROUP BY user_id), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0) SELECT round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 3) AS w_plus, round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 3) AS w FROM k""")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "events").groupBy("user_id").agg((F.avg("value") - F.lit(9.5)).alias("d")).filter("d <> 0").withColumn("a", F.abs("d"))
    k = average_ranks(d, "a", "r")
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
    return k.agg(F.round(plus, 3).alias("w_plus"), F.round(F.least(plus, minus), 3).alias("w"))


@register("m11_model_agreement", "SELECT round(avg(CASE WHEN a = b AND b = c THEN 1.0 ELSE 0.0 END), 6) AS unanimous, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS ab, round(avg(CASE WHEN b = c THEN 1.0 ELSE 0.0 END), 6) AS bc FROM (SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END AS b, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS c FROM orders)")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_totalprice") > 250000, "F").otherwise("O").alias("b"), F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O").alias("c"))
    share = lambda cond, n: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6).alias(n)
    return v.agg(share((F.col("a") == F.col("b")) & (F.col("b") == F.col("c")), "unanimous"), share(F.col("a") == F.col("b"), "ab"), share(F.col("b") == F.col("c"), "bc"))


@register("j25_retrieval_similarity", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT q, vec_id AS best FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS k FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE k = 1")
def j25(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set (ids divisible by 100) against all vectors."""
    return products(spark, sf).select("q", F.col("id").alias("best"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))
    return top_products(v.filter("id % 100 = 0"), v, 1)


@register("j25_share_compared")
def j25_share(spark: SparkSession, sf: str) -> DataFrame:
    """How many of all pairs of a query and a vector the bounds leave to be compared."""
    n = load(spark, sf, "embeddings").count()
    return products(spark, sf).agg(F.count("*").alias("n_queries"), F.sum("compared").alias("n_compared")).withColumn("share", F.round(F.col("n_compared") / F.col("n_queries") / n, 6))


@register("j26_nearest_vocabulary", "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT label AS w, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM v) GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, w FROM (SELECT vec_id, w, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), w) AS k FROM v, m) WHERE k = 1")
def j26(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest label mean of each vector. The means are as many as labels (checked: at most 10,000 are held) and go to all
    rows as one array, so no pair leaves the row."""
    v = vectors(spark, sf)
    mean = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("c"))
    if mean.count() > 10_000:
        raise ValueError("too many labels for a vocabulary held in one array")
    words = mean.agg(F.collect_list(F.struct(F.col("label").alias("w"), "c")).alias("words"))

    def apart(w):
        gap = F.zip_with("v", w.c, lambda a, b: a - b)
        return F.struct(A.dot(gap, gap).alias("d"), w.w.alias("w"))

    return v.join(F.broadcast(words)).select("vec_id", F.array_min(F.transform("words", apart))["w"].alias("w"))


@register("j27_nearest_word", "SELECT p_partkey, coalesce(min_by(r_name, (levenshtein(p, r_name), r_name)) FILTER (WHERE levenshtein(p, r_name) <= 3), any_value(p)) AS word FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS p FROM part), (VALUES ('rings'), ('widgets'), ('bolted'), ('gear')) d(r_name) GROUP BY 1")
def j27(spark: SparkSession, sf: str) -> DataFrame:
    """Each word's nearest dictionary word within three edits, else itself; distinct words only meet the dictionary."""
    p = load(spark, sf, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("p"))
    best = F.array_min(F.transform(F.array(*map(F.lit, ("rings", "widgets", "bolted", "gear"))), lambda w: F.struct(F.levenshtein("p", w).alias("d"), w.alias("w"))))
    known = p.select("p").distinct().withColumn("b", best).select("p", F.when(F.col("b.d") <= 3, F.col("b.w")).otherwise(F.col("p")).alias("word"))
    return p.join(known, "p").select("p_partkey", "word")


@register("o04_topk_labels", "SELECT vec_id, list(i ORDER BY s DESC, i)[1:3] AS top FROM (SELECT vec_id, unnest(embedding) AS s, unnest(range(64))::INTEGER AS i FROM embeddings) GROUP BY 1")
def o04(spark: SparkSession, sf: str) -> DataFrame:
    """The three best places of each row's scores, inside the row: no shuffle."""
    scored = F.array_sort(F.transform("v", lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return vectors(spark, sf).select("vec_id", F.transform(F.slice(scored, 1, 3), lambda x: x.i).alias("top"))


@register("x27_softmax_argmax", "SELECT vec_id, CAST(list_position(e, list_aggregate(e, 'max')) - 1 AS BIGINT) AS best, round(ln(list_aggregate(list_transform(e, lambda x: exp(x)), 'sum')), 5) AS lse, round(exp(e[1]) / list_aggregate(list_transform(e, lambda x: exp(x)), 'sum'), 5) AS p0 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def x27(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", A.argmax(F.col("v")).alias("best"), F.round(A.log_sum_exp(F.col("v")), 5).alias("lse"), F.round(F.element_at(A.softmax(F.col("v")), 1), 5).alias("p0"))


TFIDF_SQL = """
WITH t AS (SELECT item_id AS d, w, count(*) AS tf FROM (SELECT item_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS w FROM benchmark) WHERE length(w) > 1 AND w NOT IN ('the','of','and') GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM benchmark), df AS (SELECT w, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM t, n GROUP BY w, n), x AS (SELECT d, t.w, tf * idf AS x FROM t JOIN df ON df.w = t.w), l AS (SELECT d, sqrt(sum(x * x)) AS l FROM x GROUP BY 1)"""


def tfidf(docs: DataFrame, id_col: str, max_features: int | None = None) -> DataFrame:
    """(d, w, x): smoothed inverse document frequency, each document's weights of length 1; of the `max_features` words that are most
    frequent in all documents, the first in the alphabet among equals."""
    words = docs.select(F.col(id_col).alias("d"), F.explode(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")).alias("w"))
    tf = words.filter((F.length("w") > 1) & ~F.col("w").isin("the", "of", "and")).groupBy("d", "w").agg(F.count("*").alias("tf"))
    if max_features is not None:
        top = tf.groupBy("w").agg(F.sum("tf").alias("all")).orderBy(F.desc("all"), "w").limit(max_features)
        tf = tf.join(F.broadcast(top.select("w")), "w", "left_semi")
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("w", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(df, "w").select("d", "w", (F.col("tf") * F.col("idf")).alias("x"))
    return x.join(x.groupBy("d").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l")), "d").select("d", "w", (F.col("x") / F.col("l")).alias("x"))


@register("x30_tfidf_cosine", TFIDF_SQL + " SELECT a.d AS a, b.d AS b, round(sum(a.x * b.x / la.l / lb.l), 5) AS cos FROM x a JOIN x b ON a.w = b.w AND a.d < b.d JOIN l la ON la.d = a.d JOIN l lb ON lb.d = b.d GROUP BY 1, 2")
def x30(spark: SparkSession, sf: str) -> DataFrame:
    x = tfidf(load(spark, sf, "benchmark").select("item_id", "text"), "item_id")
    a, b = x.select(F.col("d").alias("a"), "w", F.col("x").alias("xa")), x.select(F.col("d").alias("b"), "w", F.col("x").alias("xb"))
    return a.join(b, "w").filter("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 5).alias("cos"))


@register("x30_weights_of_frequent_words", r"""
WITH t AS (SELECT doc_id AS d, w, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN ('the','of','and') GROUP BY 1, 2),
k AS (SELECT w FROM t GROUP BY w ORDER BY sum(tf) DESC, w LIMIT 300), u AS (SELECT * FROM t WHERE w IN (SELECT w FROM k)), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT w, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM u, n GROUP BY w, n), x AS (SELECT d, u.w, tf * idf AS x FROM u JOIN df ON df.w = u.w), l AS (SELECT d, sqrt(sum(x * x)) AS l FROM x GROUP BY 1)
SELECT x.d AS doc_id, w, round(x / l, 5) AS weight FROM x JOIN l ON l.d = x.d""")
def x30_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's weights over the 300 most frequent words of all."""
    return tfidf(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", 300).select(F.col("d").alias("doc_id"), "w", F.round("x", 5).alias("weight"))


@register("x31_layer_pooling", "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[33]::DOUBLE) / 2, 6) AS mean0, round(greatest(embedding[2], embedding[34])::DOUBLE, 6) AS max1, round(embedding[1]::DOUBLE, 6) AS first0, round(embedding[33]::DOUBLE, 6) AS last0 FROM embeddings")
def x31(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))
    at = lambda how, i: F.round(F.element_at(A.pool(rows, how), i), 6)
    return vectors(spark, sf).select("vec_id", at("mean", 1).alias("mean0"), at("max", 2).alias("max1"), at("first", 1).alias("first0"), at("last", 1).alias("last0"))


@register("x31_layer_groups", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT vec_id, list_transform(range(8), lambda i: v[1 + 8 * i:8 + 8 * i]) AS l FROM v)
SELECT vec_id, round((l[1][1] + l[2][1] + l[3][1]) / 3, 6) AS early, round((l[4][2] + l[5][2]) / 2, 6) AS middle, round((l[6][3] + l[7][3] + l[8][3]) / 3, 6) AS late, 3 AS n_groups, round(l[1][4] + l[4][4] + l[6][4] + l[8][4], 6) AS total, round(list_aggregate(list_transform(l, lambda x: x[5]), 'avg'), 6) AS mean_of_all, round(l[4][6], 6) AS half FROM l""")
def x31_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Eight layers of eight numbers: the layers at 0, 1/2, 3/4 and all of the depth by groups and summed, all of them, and one alone."""
    rows = F.array(*(F.slice("v", 1 + 8 * i, 8) for i in range(8)))
    at = [0.0, 0.5, 0.75, 1.0]
    p = vectors(spark, sf).select("vec_id", *(A.pool_layers(rows, 8, x, how).alias(n) for n, x, how in (("g", at, "group_mean"), ("s", at, "sum"), ("m", None, "mean"), ("h", [0.5], "mean"))))
    cell = lambda c, n: F.round(c, 6).alias(n)
    return p.select("vec_id", *(cell(F.col("g")[k][k], n) for k, n in enumerate(("early", "middle", "late"))), F.size("g").alias("n_groups"), cell(F.col("s")[3], "total"), cell(F.col("m")[4], "mean_of_all"), cell(F.col("h")[5], "half"))


@register("t02_accumulate_samples", f"WITH {INTERVALS_SQL} SELECT s, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM ev, LATERAL (SELECT unnest(range(floor(start / 600)::BIGINT, floor(start / 600)::BIGINT + greatest(1, floor(duration / 600)::BIGINT))) AS s) GROUP BY 1")
def t02(spark: SparkSession, sf: str) -> DataFrame:
    first = F.floor(F.col("start") / 600)
    e = intervals(spark, sf).select("value", F.explode(F.sequence(first, first + F.greatest(F.lit(1), F.floor(F.col("duration") / 600)) - 1)).alias("s"))
    return e.groupBy("s").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@register("t03_event_aggregation", "SELECT user_id, round(sum(value), 4) AS s, round(avg(value), 6) AS a, first(value ORDER BY ts, event_id) AS f, last(value ORDER BY ts, event_id) AS l, list(value ORDER BY ts, event_id)[count(*) // 2 + 1] AS m FROM events GROUP BY 1")
def t03(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x.value)
    g = load(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("s"), F.round(F.avg("value"), 6).alias("a"), v.alias("v"))
    return g.select("user_id", "s", "a", F.element_at("v", 1).alias("f"), F.element_at("v", -1).alias("l"), F.element_at("v", F.floor(F.size("v") / 2).cast("int") + 1).alias("m"))


@register("t04_missing_default", "SELECT c_custkey, coalesce(v, [0.0::DOUBLE, 0.0::DOUBLE]) AS v FROM customer LEFT JOIN (SELECT user_id, [min(value), max(value)] AS v FROM events GROUP BY 1) ON user_id = c_custkey")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array(F.min("value"), F.max("value")).alias("v"))
    return load(spark, sf, "customer").select("c_custkey").join(v, "c_custkey", "left").select("c_custkey", F.coalesce("v", F.array_repeat(F.lit(0.0), 2)).alias("v"))


@register("t05_time_aggregation", "SELECT vec_id, round(list_aggregate(e, 'sum'), 5) AS s, round(list_aggregate(e, 'avg'), 5) AS a, e[1] AS f, e[64] AS l FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def t05(spark: SparkSession, sf: str) -> DataFrame:
    s = A.total(F.col("v"))
    return vectors(spark, sf).select("vec_id", F.round(s, 5).alias("s"), F.round(s / F.size("v"), 5).alias("a"), F.element_at("v", 1).alias("f"), F.element_at("v", -1).alias("l"))


@register("t06_feature_combination", "SELECT vec_id, len(list_concat(a, b)) AS n, round(list_aggregate(list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2), 'sum'), 5) AS mean_sum FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings)")
def t06(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.slice("v", 1, 32), F.slice("v", 33, 32)
    return vectors(spark, sf).select("vec_id", F.size(F.concat(a, b)).cast("long").alias("n"), F.round(A.total(F.zip_with(a, b, lambda x, y: (x + y) / 2)), 5).alias("mean_sum"))


@register("t07_rasterised_detector", f"WITH {INTERVALS_SQL} SELECT timeline, s, max(k) AS level FROM (SELECT timeline, s, CASE WHEN s = f THEN 2 WHEN s = l THEN 1 ELSE 0 END AS k FROM (SELECT timeline, floor(start / 900)::BIGINT AS f, floor(stop / 900)::BIGINT AS l FROM ev), LATERAL (SELECT unnest(range(f, l + 1)) AS s)) GROUP BY 1, 2")
def t07(spark: SparkSession, sf: str) -> DataFrame:
    """Only first and last samples are grouped. Between two of them that follow each other, all samples are in an event or none."""
    e = intervals(spark, sf).select("timeline", F.floor(F.col("start") / 900).alias("f"), F.floor(F.col("stop") / 900).alias("l")).filter("l >= f")
    end = lambda s, level: F.struct(F.col(s).alias("s"), F.lit(level).alias("level"), F.col("l").alias("reach"))
    ends = e.select("timeline", F.explode(F.array(end("f", 2), end("l", 1))).alias("x")).groupBy("timeline", "x.s").agg(F.max("x.level").alias("level"), F.max("x.reach").alias("reach"))
    order = Window.partitionBy("timeline").orderBy("s")
    marks = ends.select("timeline", "s", "level", F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("reach"), F.lead("s").over(order).alias("next"))
    between = F.when((F.col("reach") > F.col("s")) & (F.col("next") > F.col("s") + 1), F.transform(F.sequence(F.col("s") + 1, F.col("next") - 1), lambda k: F.struct(k.alias("s"), F.lit(0).alias("level"))))
    return marks.select("timeline", F.explode(F.concat(F.array(F.struct("s", "level")), F.coalesce(between, F.array().cast("array<struct<s:bigint,level:int>>")))).alias("x")).select("timeline", "x.s", "x.level")


RASTER_SQL = f"""
WITH {INTERVALS_SQL}, w AS (SELECT event_id AS w_id, timeline, start - 1800 AS w_start FROM ev WHERE type = 'purchase'),
p AS (SELECT w_id, CAST(trunc((start - w_start) * 0.02::DOUBLE) AS BIGINT) AS i, CAST(trunc((start + duration - w_start) * 0.02::DOUBLE) AS BIGINT) AS j, duration FROM w JOIN ev ON ev.timeline = w.timeline AND ev.start < w_start + 7200 AND ev.stop > w_start WHERE start + duration / 2 >= w_start AND start + duration / 2 < w_start + 7200),
q AS (SELECT *, CAST(trunc((i + j) / 2) AS BIGINT) AS c FROM p)"""


@register("t07_raster_modes", RASTER_SQL + """, r AS (
SELECT 'start' AS mode, w_id, i AS k, 1.0::DOUBLE AS level FROM q UNION ALL SELECT 'middle', w_id, c, 1.0 FROM q UNION ALL SELECT 'duration_middle', w_id, c, duration / 7200 FROM q UNION ALL SELECT 'raw_duration', w_id, c, (j - i)::DOUBLE FROM q
UNION ALL SELECT 'flat_confidence', w_id, k, 1.0 FROM q, LATERAL (SELECT unnest(range(greatest(i, 0), least(j, 144))) AS k)
UNION ALL SELECT 'super_smooth', w_id, k, exp(-0.5::DOUBLE * (k - c) ** 2 / 9) FROM q, LATERAL (SELECT unnest(range(greatest(0, c - 9), least(144, c + 9))) AS k))
SELECT mode, w_id, k, round(max(level), 5) AS level FROM r WHERE k >= 0 AND k < 144 GROUP BY 1, 2, 3""")
def t07_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Two hours around each purchase at one sample in 50 s, in six modes."""
    e = intervals(spark, sf).select("timeline", "type", "event_id", "start", "stop", "duration")
    w = e.filter("type = 'purchase'").select(F.col("event_id").alias("w_id"), "timeline", (F.col("start") - 1800).alias("w_start"), (F.col("start") - 1800 + 7200).alias("w_stop"), F.lit(7200.0).alias("w_duration"))
    rows = I.range_join(w, e.select("timeline", "start", "stop", "duration"), I.overlaps(), 21_600.0).select("w_id", "w_start", "w_duration", "start", "duration")
    out = None
    for mode in ("start", "middle", "duration_middle", "raw_duration", "flat_confidence", "super_smooth"):
        one = raster.rasterise(rows, mode, 0.02, sigma=3.0).select(F.lit(mode).alias("mode"), "w_id", "k", F.round("level", 5).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


@register("t07_listed_modes", RASTER_SQL.replace("AS j, duration FROM w", "AS j, duration, start, (start + duration / 2 - w_start) / 7200 AS m FROM w") + """
SELECT w_id, list_transform(list_concat(list(m ORDER BY start, duration, m), [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE])[1:3], lambda x: round(x, 5)) AS centres FROM q GROUP BY 1""")
def t07_listed(spark: SparkSession, sf: str) -> DataFrame:
    e = intervals(spark, sf).select("timeline", "type", "event_id", "start", "stop", "duration")
    w = e.filter("type = 'purchase'").select(F.col("event_id").alias("w_id"), "timeline", (F.col("start") - 1800).alias("w_start"), (F.col("start") - 1800 + 7200).alias("w_stop"), F.lit(7200.0).alias("w_duration"))
    rows = I.range_join(w, e.select("timeline", "start", "stop", "duration"), I.overlaps(), 21_600.0)
    middle = F.col("start") + F.col("duration") / 2
    rows = rows.filter((middle >= F.col("w_start")) & (middle < F.col("w_start") + F.col("w_duration")))
    return raster.listed(rows, "center_DETR", 3).select("w_id", F.transform("values", lambda x: F.round(x, 5)).alias("centres"))


@register("t08_static_codes", "SELECT event_id, CASE event_type WHEN 'click' THEN [1.0::DOUBLE, 0.0::DOUBLE] WHEN 'view' THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [0.0::DOUBLE, 0.0::DOUBLE] END AS code FROM events")
def t08(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return load(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", pair(1.0, 0.0)).when(F.col("event_type") == "view", pair(0.0, 1.0)).otherwise(pair(0.0, 0.0)).alias("code"))


@register("t09_scaler", "WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM events WHERE user_id % 5 <> 0) SELECT event_id, round((value - m) / s, 6) AS z, round((value - lo) / (hi - lo), 6) AS mm, round(value / greatest(abs(lo), abs(hi)), 6) AS ma FROM events, f")
def t09(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    f = e.filter("user_id % 5 <> 0").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = F.col("value")
    return e.join(F.broadcast(f)).select("event_id", F.round((v - F.col("m")) / F.col("s"), 6).alias("z"), F.round((v - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("mm"), F.round(v / F.greatest(F.abs("lo"), F.abs("hi")), 6).alias("ma"))


@register("t12_pad_and_crop", "SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), list_transform(range(6), lambda x: 0.0::DOUBLE)) AS v FROM embeddings")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", A.pad(F.col("v"), 70).alias("v"))


@register("t14_single_batch_scaler", "SELECT d, round(avg(x), 6) AS mean, round(CASE WHEN var_samp(x) < 10 * 2.220446049250313e-16 * count(*) THEN 1 ELSE sqrt(var_samp(x)) END, 6) AS scale FROM (SELECT unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def t14(spark: SparkSession, sf: str) -> DataFrame:
    e = vectors(spark, sf).select(F.posexplode("v").alias("d", "x")).withColumn("d", F.col("d").cast("long"))
    flat = F.var_samp("x") < 10 * 2.220446049250313e-16 * F.count("*")
    return e.groupBy("d").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.when(flat, 1.0).otherwise(F.sqrt(F.var_samp("x"))), 6).alias("scale"))
