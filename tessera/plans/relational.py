"""Scans, predicates, joins, aggregates, ordering and set operators, as registered queries.

Stand-ins: customers are users and owners, orders are projects and reviews, line items are cells, suppliers are peers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.relational import access_filter, anti_join, containment_pairs, first_by, fill_gaps, insert_ignore, latest, nth_tile_labels, overview, reconcile, tree_closure, update_changed, upsert
from tessera.registry import register
from tessera.tables import load


@register("s01_filtered_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F','O') AND o_totalprice >= 1000 AND o_totalprice <= 200000 AND (o_orderpriority = '1-URGENT' OR o_custkey < 50)")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000) & ((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_custkey") < 50))).select("o_orderkey", "o_custkey", "o_totalprice")


@register("s02_count_only", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").filter("o_orderstatus = 'P'").agg(F.count("*").alias("n"))


@register("s03_overview_function", """
SELECT c_custkey AS owner, c_custkey = 7 AS is_owner, count(o_orderkey) AS n_projects, count(DISTINCT o_orderstatus) AS n_states
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7 OR c_nationkey = 3 GROUP BY c_custkey""")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    return overview(load(spark, sf, "customer"), load(spark, sf, "orders"), user=7, nation=3)


@register("s04_full_export", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register("s16_union_of_studies", """
SELECT study, k, name, row_number() OVER (PARTITION BY study ORDER BY k) - 1 AS idx FROM (
SELECT 'customer' AS study, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)""")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "customer").select(F.lit("customer").alias("study"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = load(spark, sf, "supplier").select(F.lit("supplier").alias("study"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    w = Window.partitionBy("study").orderBy("k")
    return a.unionByName(b, allowMissingColumns=True).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


@register("k01_upsert", """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT 1000000 + s_suppkey, s_acctbal FROM supplier""")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    base = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    changed = base.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    fresh = load(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert(base, changed.unionByName(fresh), ["c_custkey"])


@register("k02_insert_ignore", """
SELECT n_nationkey AS k, n_name AS name FROM nation
UNION ALL SELECT k, min(name) FROM (SELECT c_custkey AS k, c_name AS name FROM customer) WHERE k NOT IN (SELECT n_nationkey FROM nation) GROUP BY k""")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    base = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    new = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return insert_ignore(base, new, ["k"])


@register("k03_update_from_join", """
SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'junk' END, d.lang) AS lang, coalesce(l.quality = 0 AND d.lang <> 'junk', false) AS changed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    new = load(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "junk").alias("lang"))
    return update_changed(docs, new, "doc_id", "lang")


@register("k04_cross_product_insert", "SELECT n_nationkey, c.col AS col, 'pending' AS status FROM nation, (VALUES ('parties'),('dates'),('risk')) c(col)")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ("parties", "dates", "risk")))).alias("col"), F.lit("pending").alias("status"))


@register("k05_clear_cells", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS content FROM orders")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("content"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("k07_matrix_export", """
SELECT o_orderstatus, coalesce(max(CASE WHEN p = '1-URGENT' THEN cell END),'-') AS urgent, coalesce(max(CASE WHEN p = '2-HIGH' THEN cell END),'-') AS high, coalesce(max(CASE WHEN p = '5-LOW' THEN cell END),'-') AS low
FROM (SELECT o_orderstatus, o_orderpriority AS p, CASE WHEN count(*) > 1000 THEN 'many: ' ELSE 'few: ' END || count(*) AS cell FROM orders GROUP BY 1, 2) GROUP BY o_orderstatus""")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    cells = load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    cells = cells.select("o_orderstatus", "o_orderpriority", F.concat(F.when(F.col("n") > 1000, "many: ").otherwise("few: "), F.col("n").cast("string")).alias("cell"))
    wide = cells.groupBy("o_orderstatus").pivot("o_orderpriority", PRIORITIES).agg(F.max("cell"))
    return wide.select("o_orderstatus", *(F.coalesce(F.col(f"`{p}`"), F.lit("-")).alias(a) for p, a in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))))


@register("k08_markdown_report", """
SELECT o_orderstatus, '| priority | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || p || ' | ' || n || ' |', chr(10) ORDER BY p) AS report
FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "n"))), lambda x: F.concat(F.lit("| "), x.p, F.lit(" | "), x.n.cast("string"), F.lit(" |"))), "\n")
    return n.groupBy("o_orderstatus").agg(F.concat(F.lit("| priority | n |\n|---|---|\n"), lines).alias("report"))


@register("k09_cascading_delete", """
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey < 20 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    gone = o.filter("o_custkey < 20").select("o_orderkey").union(o.filter("o_orderstatus = 'P'").select("o_orderkey")).distinct()
    l = load(spark, sf, "lineitem").select("l_orderkey")
    return anti_join(l, gone.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("k10_remove_from_json_array", """
SELECT p_partkey, list_filter(string_split(p_name || ', ' || p_brand || ' ,' || upper(p_name), ','), lambda x: lower(trim(x)) <> p_name) AS left_over FROM part""")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", "p_name", F.split(F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ,"), F.upper("p_name")), ",").alias("a"))
    return p.select("p_partkey", F.filter("a", lambda x: F.lower(F.trim(x)) != F.col("p_name")).alias("left_over"))


@register("p01_optional_filter", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    for name, value in {"c_mktsegment": "BUILDING", "c_nationkey": None}.items():
        if value is not None:
            c = c.filter(F.col(name) == value)
    return c.agg(F.count("*").alias("n"))


@register("p02_computed_boolean", "SELECT o_orderkey, o_custkey = 5 AS is_owner FROM orders")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") == 5).alias("is_owner"))


@register("p03_searched_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'small' ELSE 'large' END AS tier FROM customer")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "small").otherwise("large").alias("tier"))


@register("p04_array_membership", "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AS shared FROM part")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    as_json = F.concat(F.lit('["'), F.regexp_replace("p_name", " ", '","'), F.lit('"]'))
    return load(spark, sf, "part").select("p_partkey", F.array_contains(F.from_json(as_json, "array<string>"), "red").alias("shared"))


@register("p05_row_level_access", """
SELECT o_orderkey FROM orders WHERE o_custkey = 12 OR o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 3)""")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    members = load(spark, sf, "lineitem").filter("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return access_filter(load(spark, sf, "orders"), members, "o_orderkey", F.col("o_custkey") == 12, F.col("o_orderstatus") == "P").select("o_orderkey")


@register("p06_deadline_window", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate IS NOT NULL AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-01' + INTERVAL 90 DAY")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    today = F.lit("1997-01-01").cast("timestamp_ntz")
    return load(spark, sf, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderdate").between(today, today + F.expr("INTERVAL 90 DAYS"))).select("o_orderkey", "o_orderdate")


@register("p07_query_string", "SELECT event_id FROM events WHERE user_id < 10 AND value > 3 AND event_type <> 'view'")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").filter("user_id < 10 and value > 3 and event_type != 'view'").select("event_id")


#: Event types and their subtypes.
TYPE_TREE = {"interaction": ["click", "view"], "account": ["signup"], "conversion": ["purchase", "signup"]}


@register("p08_type_with_subtypes", "SELECT event_id, event_type FROM events WHERE event_type IN ('interaction','click','view')")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").filter(F.col("event_type").isin("interaction", *TYPE_TREE["interaction"])).select("event_id", "event_type")


@register("p09_drop_missing_field", "SELECT event_id FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS f FROM events) WHERE event_type <> 'click' OR (f IS NOT NULL AND f <> '')")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    f = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, "").otherwise(F.col("event_type"))
    e = load(spark, sf, "events").select("event_id", "event_type", f.alias("f"))
    return e.filter((F.col("event_type") != "click") | (F.col("f").isNotNull() & (F.col("f") != ""))).select("event_id")


@register("p10_exclude_and_merge_entities", "SELECT CASE user_id WHEN 18 THEN 1 WHEN 19 THEN 2 ELSE user_id END AS subject, count(*) AS n FROM events WHERE user_id NOT IN (3, 4) GROUP BY 1")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").filter(~F.col("user_id").isin(3, 4)).select(F.col("user_id").alias("subject"))
    return e.replace({18: 1, 19: 2}, subset=["subject"]).groupBy("subject").agg(F.count("*").alias("n"))


@register("p11_retrievable_pattern", "SELECT c_custkey FROM (SELECT c_custkey, c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' F. 3d ' ELSE ' -- ' END || c_nationkey AS cite FROM customer) WHERE regexp_matches(cite, '[0-9]+\\s+[A-Za-z.]+(?:\\s*[0-9]?[a-z]+)?\\s+[0-9]+')")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    cite = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, " F. 3d ").otherwise(" -- "), F.col("c_nationkey").cast("string"))
    return load(spark, sf, "customer").withColumn("cite", cite).filter(F.col("cite").rlike(r"[0-9]+\s+[A-Za-z.]+(?:\s*[0-9]?[a-z]+)?\s+[0-9]+")).select("c_custkey")


@register("p12_host_allow_list", "SELECT page_id, list_slice(list_filter([url, 'https://a.example.org/x', 'http://other.test/y'], lambda u: regexp_extract(u, '^https?://([^/?#:]+)', 1) LIKE '%.example.org'), 1, 10) AS urls FROM pages")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    urls = F.array("url", F.lit("https://a.example.org/x"), F.lit("http://other.test/y"))
    return load(spark, sf, "pages").select("page_id", F.slice(F.filter(urls, lambda u: F.parse_url(u, F.lit("HOST")).endswith(".example.org")), 1, 10).alias("urls"))


@register("p16_threshold_tiers", "SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'verified' WHEN c_acctbal >= 5500 THEN 'fuzzy' ELSE 'not_found' END AS status, CASE WHEN c_acctbal >= 8000 THEN 'yes' WHEN c_acctbal >= 5500 THEN 'unsure' ELSE 'no' END AS verdict FROM customer")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    tiers = nth_tile_labels(F.col("c_acctbal") / 100, ((80, ("verified", "yes")), (55, ("fuzzy", "unsure"))), ("not_found", "no"))
    return load(spark, sf, "customer").select("c_custkey", tiers[0].alias("status"), tiers[1].alias("verdict"))


@register("p18_partition_verdicts", """
SELECT s, count(*) AS n, min(o_orderkey) AS least FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cleared' WHEN 'P' THEN 'conditional' ELSE 'blocking' END AS s FROM orders) GROUP BY s""")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "cleared").when(F.col("o_orderstatus") == "P", "conditional").otherwise("blocking")
    return load(spark, sf, "orders").groupBy(s.alias("s")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


@register("p19_overlapping_buckets", "SELECT count(*) FILTER (WHERE o_totalprice > 300000 AND o_orderstatus = 'F') AS high_done, count(*) FILTER (WHERE o_orderstatus = 'P') AS needs_check, count(*) FILTER (WHERE o_totalprice < 1000) AS low, count(*) FILTER (WHERE datediff('day', TIMESTAMP '1998-01-01', o_orderdate) BETWEEN 0 AND 30) AS due FROM orders")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff("o_orderdate", F.lit("1998-01-01"))
    return load(spark, sf, "orders").agg(F.count_if((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "F")).alias("high_done"), F.count_if(F.col("o_orderstatus") == "P").alias("needs_check"), F.count_if(F.col("o_totalprice") < 1000).alias("low"), F.count_if(days.between(0, 30)).alias("due"))


@register("p20_whitelist_truncate", "SELECT doc_id, substr(text, 1, 200) AS text, lang FROM documents")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.substring("text", 1, 200).alias("text"), "lang")


@register("p21_sections", """
SELECT cat, list(c_name ORDER BY c_name) AS names, bool_or(hist) AS historical FROM (SELECT c_name, CASE WHEN c_nationkey < 5 THEN 'federal' WHEN c_nationkey < 15 THEN 'state' ELSE 'other' END AS cat, c_acctbal < 0 AS hist FROM customer WHERE lower(c_name) LIKE '%00007%' OR lower(c_mktsegment) LIKE '%00007%') GROUP BY cat""")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.lower("c_name").contains("00007") | F.lower("c_mktsegment").contains("00007")
    cat = F.when(F.col("c_nationkey") < 5, "federal").when(F.col("c_nationkey") < 15, "state").otherwise("other")
    return load(spark, sf, "customer").filter(hit).groupBy(cat.alias("cat")).agg(F.sort_array(F.collect_list("c_name")).alias("names"), F.bool_or(F.col("c_acctbal") < 0).alias("historical"))


@register("p22_hidden_list", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) AND p_type = 'ECONOMY' AND lower(p_name) LIKE '%red%'")
def p22(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").filter((F.col("p_type") == "ECONOMY") & F.lower("p_name").contains("red"))
    return anti_join(p, load(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey")), ["p_partkey"]).select("p_partkey")


@register("j01_left_join_cast", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey + 10 AS VARCHAR)")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 10).cast("string").alias("k"))
    return o.join(load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name"), "k", "left").select("o_orderkey", "c_name")


@register("j02_case_insensitive_join", "SELECT a.p_partkey AS a, b.n AS n FROM part a LEFT JOIN (SELECT upper(p_name) AS name, p_size, count(*) AS n FROM part GROUP BY 1, 2) b ON lower(a.p_name) = lower(b.name) AND a.p_size = b.p_size")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    b = p.groupBy(F.upper("p_name").alias("name"), "p_size").agg(F.count("*").alias("n"))
    return p.withColumn("k", F.lower("p_name")).join(b.withColumn("k", F.lower("name")), ["k", "p_size"], "left").select(F.col("p_partkey").alias("a"), "n")


@register("j03_exists_under_or", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    some = load(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return access_filter(load(spark, sf, "customer"), some, "c_custkey", F.col("c_acctbal") > 9000).select("c_custkey")


@register("j04_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@register("j05_skip_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    return anti_join(load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels").select("doc_id"), ["doc_id"])


@register("j06_lookup_default", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return load(spark, sf, "customer").withColumn("k", F.col("c_nationkey") + 3).join(n, "k", "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@register("j07_composite_lookup_status", """
SELECT o_custkey, count(*) AS requested, count(p_partkey) AS matched, CASE WHEN count(p_partkey) = count(*) THEN 'ok' WHEN count(p_partkey) = 0 THEN 'not_found' ELSE 'partial' END AS status
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 25 GROUP BY 1""")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    l = load(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey0"))
    p = load(spark, sf, "part").filter("p_size <= 25").select("p_partkey")
    g = o.join(l, "o_orderkey", "left").join(p, F.col("p_partkey0") == F.col("p_partkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("requested"), F.count("p_partkey").alias("matched"))
    return g.withColumn("status", F.when(F.col("matched") == F.col("requested"), "ok").when(F.col("matched") == 0, "not_found").otherwise("partial"))


@register("j08_fallback_fill", "SELECT p_partkey, coalesce(s_name, c_name, 'none') AS name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey")
    p = p.join(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name"), "p_partkey", "left").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("p_partkey"), "c_name"), "p_partkey", "left")
    return p.select("p_partkey", F.coalesce("s_name", "c_name", F.lit("none")).alias("name"))


@register("j09_bidirectional_substring", """
SELECT n_nationkey, min(r_regionkey) AS first_hit FROM (SELECT n_nationkey, lower(n_name) AS a FROM nation) JOIN (SELECT p_partkey AS r_regionkey, 'nation_' || p_size AS h FROM part) ON contains(a, h) OR contains(h, a) GROUP BY 1""")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("a"))
    h = load(spark, sf, "part").groupBy(F.concat(F.lit("nation_"), F.col("p_size").cast("string")).alias("h")).agg(F.min("p_partkey").alias("first"))
    x, y = a.select("a").distinct(), h.select("h")
    down = containment_pairs(x.withColumnRenamed("a", "hay"), y.withColumnRenamed("h", "needle")).toDF("a", "h")
    up = containment_pairs(y.withColumnRenamed("h", "hay"), x.withColumnRenamed("a", "needle")).toDF("h", "a").select("a", "h")
    return a.join(down.unionByName(up), "a").join(h, "h").groupBy("n_nationkey").agg(F.min("first").alias("first_hit"))


@register("j09_passages_in_texts", """
WITH p AS (SELECT item_id, text AS whole, substr(text, 30, 40) AS part FROM benchmark)
SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM p JOIN documents d ON contains(d.text, part) OR contains(whole, d.text) GROUP BY 1""")
def j09_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Items and documents of which either side holds the other: a passage of the item stands in the document, or the whole document in the item."""
    p = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("whole"), F.substring("text", 30, 40).alias("part"))
    d = load(spark, sf, "documents").filter("text is not null").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    text = d.select("text")
    down = containment_pairs(text.withColumnRenamed("text", "hay"), p.select(F.col("part").alias("needle")).distinct(), size=12)
    up = containment_pairs(p.select(F.col("whole").alias("hay")).distinct(), text.withColumnRenamed("text", "needle"))
    down = down.join(p, F.col("needle") == F.col("part")).select("item_id", F.col("hay").alias("text"))
    up = up.join(p, F.col("hay") == F.col("whole")).select("item_id", F.col("needle").alias("text"))
    return down.unionByName(up).distinct().join(d, "text").groupBy("item_id").agg(F.sum("copies").alias("n"), F.min("first").alias("first_doc"))


@register("j10_inverted_index_join", """
WITH ix AS (SELECT l_partkey AS cite, l_orderkey AS idx FROM lineitem) SELECT p_brand, count(*) AS n, count(DISTINCT ix.idx) AS n_entries FROM part JOIN ix ON ix.cite = p_partkey GROUP BY 1""")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    ix = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("idx"))
    return load(spark, sf, "part").select("p_partkey", "p_brand").join(ix, "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("n_entries"))


@register("j16_prefer_source", """
SELECT conv_id, turn, role FROM conversations c WHERE CASE WHEN EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'system') THEN role = 'system' ELSE role = 'user' END""")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    has = c.groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("has"))
    return c.join(has, "conv_id").filter(F.when(F.col("has"), F.col("role") == "system").otherwise(F.col("role") == "user")).drop("has")


@register("j17_join_of_aggregates", """
SELECT a.user_id, a.n, round(b.m, 6) AS m FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id""")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    a = e.filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return a.join(e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m")), "user_id")


@register("j18_aggregate_joined_back", "SELECT conv_id, turn, string_agg(role, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS seq FROM conversations")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    seq = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), "").alias("seq"))
    return c.join(seq, "conv_id", "left").select("conv_id", "turn", "seq")


@register("j23_reconcile", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'orphan' WHEN a.v IS DISTINCT FROM b.v THEN 'update' ELSE 'same' END AS action
FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) a FULL JOIN (SELECT s_suppkey + 50 AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k""")
def j23(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = load(spark, sf, "supplier").select((F.col("s_suppkey") + 50).alias("k"), F.col("s_nationkey").alias("v"))
    return reconcile(a, b, "k", "v")


@register("j28_tree_closure", """
WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent FROM part), t(id) AS (SELECT 2::BIGINT UNION SELECT f.id FROM f JOIN t ON f.parent = t.id)
SELECT t.id, count(l_partkey) AS n_docs FROM t LEFT JOIN lineitem ON l_partkey = t.id GROUP BY 1""")
def j28(spark: SparkSession, sf: str) -> DataFrame:
    folders = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).cast("long").alias("parent"))
    found = tree_closure(folders, 2)
    l = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.lit(1).alias("one"))
    return found.join(l, "id", "left").groupBy("id").agg(F.count("one").alias("n_docs"))


@register("a01_queue_by_unlocks", "SELECT l_partkey AS cite, count(*) AS unlocks, list(l_orderkey ORDER BY l_orderkey) AS entries FROM lineitem GROUP BY 1")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cite")).agg(F.count("*").alias("unlocks"), F.sort_array(F.collect_list("l_orderkey")).alias("entries"))
    return g.orderBy(F.desc("unlocks"), "cite")


@register("a02_longest_per_key", "SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return first_by(load(spark, sf, "conversations"), ["conv_id"], [F.length("text").desc(), F.col("turn").asc()]).select("conv_id", "text")


@register("a03_latest_filtered", "SELECT c.c_custkey, v.latest FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1) v ON v.o_custkey = c.c_custkey")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("latest"))
    return load(spark, sf, "customer").select("c_custkey").join(v, "c_custkey", "left")


@register("a04_verdict_histogram", "SELECT o_orderpriority AS model, count(*) FILTER (WHERE o_orderstatus='F') AS yes, count(*) FILTER (WHERE o_orderstatus='O') AS no, count(*) FILTER (WHERE o_orderstatus='P') AS unsure FROM orders GROUP BY 1")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    wide = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("model", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("F", "yes"), ("O", "no"), ("P", "unsure"))))


@register("a05_coverage_ratio", "SELECT lang, round(100.0 * avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 1) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    l = load(spark, sf, "labels").select("doc_id", F.lit(1.0).alias("hit"))
    return load(spark, sf, "documents").select("doc_id", "lang").join(l, "doc_id", "left").groupBy("lang").agg(F.round(100.0 * F.avg(F.coalesce("hit", F.lit(0.0))), 1).alias("coverage"))


@register("a06_status_counts_pass_rate", "SELECT count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE toxic = 1) AS flagged, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / greatest(count(*), 1), 6) AS rate FROM labels")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.count_if(F.col("quality") == 1)
    return load(spark, sf, "labels").agg(ok.alias("passed"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.round(ok.cast("double") / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


@register("a07_urgency_counts", """
SELECT u, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' WHEN d < 0 THEN 'lapsed' WHEN d <= 30 THEN 'critical' WHEN d <= 90 THEN 'soon' ELSE 'later' END AS u FROM (SELECT o_orderpriority, datediff('day', TIMESTAMP '1998-06-01', o_orderdate) AS d FROM orders)) GROUP BY 1""")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    d = F.datediff("o_orderdate", F.lit("1998-06-01"))
    u = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(d < 0, "lapsed").when(d <= 30, "critical").when(d <= 90, "soon").otherwise("later")
    return load(spark, sf, "orders").groupBy(u.alias("u")).agg(F.count("*").alias("n"))


@register("a08_critical_count", "SELECT o_orderstatus, count(*) FILTER (WHERE datediff('day', TIMESTAMP '1998-06-01', o_orderdate) BETWEEN 0 AND 14) AS critical FROM orders GROUP BY 1")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(F.datediff("o_orderdate", F.lit("1998-06-01")).between(0, 14)).alias("critical"))


@register("a09_ordered_tiers", "SELECT CASE WHEN n >= 15 THEN 1 WHEN n >= 8 THEN 2 ELSE 3 END AS tier, count(*) AS n_keys, list(o_custkey ORDER BY o_custkey) AS members FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    tier = F.when(F.col("n") >= 15, 1).when(F.col("n") >= 8, 2).otherwise(3)
    return g.groupBy(tier.alias("tier")).agg(F.count("*").alias("n_keys"), F.sort_array(F.collect_list("o_custkey")).alias("members")).orderBy("tier")


@register("a28_group_first_label", "SELECT l_suppkey, first(l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS label, count(*) AS n FROM lineitem GROUP BY 1")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("label"), F.count("*").alias("n"))


@register("a29_next_version", "SELECT l_orderkey, CAST(coalesce(max(CASE WHEN l_returnflag IN ('A','R') THEN l_linenumber END), 1) + 1 AS INTEGER) AS next_version FROM lineitem GROUP BY 1")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.coalesce(F.max(F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_linenumber"))), F.lit(1)) + 1).alias("next_version"))


@register("a30_pending_count", "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS pending FROM lineitem GROUP BY 1")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("pending"))


@register("o01_order_limit", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000")
def o01(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1000)


@register("o02_nulls_last", "SELECT r_regionkey, v FROM (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS v FROM region) ORDER BY v ASC NULLS LAST, r_regionkey")
def o02(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "region").select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("v")).orderBy(F.col("v").asc_nulls_last(), "r_regionkey")


@register("o03_latest_ten_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def o03(spark: SparkSession, sf: str) -> DataFrame:
    return latest(load(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 10).select("o_custkey", "o_orderkey")


@register("o05_null_as_empty_desc", "SELECT page_id, coalesce(d, '') AS d FROM (SELECT page_id, nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS d FROM pages) ORDER BY 2 DESC, 1")
def o05(spark: SparkSession, sf: str) -> DataFrame:
    d = F.coalesce(F.nullif(F.regexp_extract("url", "page=([0-9]+)", 1), F.lit("")), F.lit(""))
    return load(spark, sf, "pages").select("page_id", d.alias("d")).orderBy(F.desc("d"), "page_id")


def clamp(value: int, low: int, high: int) -> int:
    """A caller's limit within its bounds."""
    return max(low, min(high, value))


@register("o06_clamped_limit", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def o06(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(clamp(500, 1, 20)).select("c_custkey")


@register("o08_block_shuffle", "SELECT conv_id, turn, md5(conv_id::VARCHAR || ':7') AS block FROM conversations ORDER BY 3, 1, 2")
def o08(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations in an order that a seed decides: the sort key is a hash, so no global numbering is needed."""
    block = F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":7")))
    return load(spark, sf, "conversations").select("conv_id", "turn", block.alias("block")).orderBy("block", "conv_id", "turn")


@register("o09_mapped_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def o09(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return load(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey")).cast("long").alias("place"))


@register("u01_union_missing_columns", "SELECT event_id AS id, event_type, NULL AS role FROM events UNION ALL SELECT conv_id, NULL, role FROM conversations")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return a.unionByName(load(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role"), allowMissingColumns=True)


@register("u02_union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_nationkey = 4")
def u02(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(F.col("o_custkey").alias("id")).union(load(spark, sf, "customer").filter("c_nationkey = 4").select("c_custkey")).distinct()


@register("u03_intersect_except", "SELECT 'both' AS kind, w FROM (SELECT unnest(string_split(p_name,' ')) AS w FROM part WHERE p_size >= 5 INTERSECT SELECT unnest(string_split(p_name,' ')) FROM part WHERE p_size < 5) UNION ALL SELECT 'new', w FROM (SELECT lower(p_type) AS w FROM part EXCEPT SELECT unnest(string_split(p_name,' ')) FROM part)")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    words = lambda d: d.select(F.explode(F.split("p_name", " ")).alias("w"))
    both = words(p.filter("p_size >= 5")).intersect(words(p.filter("p_size < 5")))
    new = p.select(F.lower("p_type").alias("w")).distinct().join(words(p), "w", "left_anti")
    return both.select(F.lit("both").alias("kind"), "w").union(new.select(F.lit("new"), "w"))


@register("u04_keep_first_fallback_key", "SELECT k, min(p_partkey) AS first_id FROM (SELECT coalesce(nullif(CASE WHEN p_size < 20 THEN '' ELSE p_brand END, ''), p_name) AS k, p_partkey FROM part) GROUP BY 1")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    k = F.coalesce(F.nullif(F.when(F.col("p_size") < 20, "").otherwise(F.col("p_brand")), F.lit("")), F.col("p_name"))
    return load(spark, sf, "part").select(k.alias("k"), "p_partkey").groupBy("k").agg(F.min("p_partkey").alias("first_id"))


@register("u05_fill_gaps", "SELECT c_custkey AS k, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), s_name) AS v FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("v"))
    return fill_gaps(old, load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"], ["v"])


@register("u06_last_write_wins", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def u06(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@register("u07_ordered_unique", "SELECT p_partkey, CASE WHEN split_part(p_name,' ',1) = split_part(p_name,' ',2) THEN [split_part(p_name,' ',1), p_type] ELSE [split_part(p_name,' ',1), split_part(p_name,' ',2), p_type] END AS terms FROM part")
def u07(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.element_at(F.split("p_name", " "), 1), F.col("p_type")))).alias("terms"))


@register("u08_missed_indices", "SELECT g.i AS missed FROM generate_series(0, 99) g(i) WHERE g.i NOT IN (SELECT user_id FROM events WHERE value > 20)")
def u08(spark: SparkSession, sf: str) -> DataFrame:
    seen = load(spark, sf, "events").filter("value > 20").select(F.col("user_id").alias("missed")).distinct()
    return spark.range(100).withColumnRenamed("id", "missed").join(seen, "missed", "left_anti")


@register("u09_last_edit_first_seen", "SELECT conv_id, last(role ORDER BY turn) AS role, min(turn) AS seen FROM conversations GROUP BY 1")
def u09(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.min("turn").alias("seen")).orderBy("seen", "conv_id")
