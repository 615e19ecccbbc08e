"""Workspaces, message routing and quotes, as registered queries.

Stand-ins: orders are reviews and chats, customers are projects and profiles, parts are workflows, suppliers are shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import access, quotes
from tessera.registry import register
from tessera.tables import load


def user(c: Column) -> Column:
    return F.concat(F.lit("u"), c.cast("string"))


@register("s03_visible_reviews", """
WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS project_id, 'u' || (o_orderkey % 40) AS user_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 ELSE 0 END AS n, CASE o_orderkey % 50 WHEN 0 THEN 'a@x.org' WHEN 1 THEN 'A@x.org' ELSE 'b@x.org' END AS mail FROM orders),
p AS (SELECT c_custkey AS id, 'u' || c_nationkey AS user_id, c_custkey % 9 = 0 AS shared FROM customer)
SELECT id, user_id = 'u7' AS is_owner, CAST(n AS BIGINT) AS document_count FROM r WHERE user_id = 'u7' OR mail = 'a@x.org' OR EXISTS (SELECT 1 FROM p WHERE p.id = r.project_id AND (p.user_id = 'u7' OR p.shared))""")
def s03_reviews(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    mail = F.when(k % 50 == 0, "a@x.org").when(k % 50 == 1, "A@x.org").otherwise("b@x.org")
    ids = F.when(k % 5 > 0, F.slice(F.array(*map(F.lit, ("d1", "d2", "d3"))), F.lit(1), (k % 4).cast("int")))
    r = load(spark, sf, "orders").select(k.alias("id"), F.when(k % 3 > 0, F.col("o_custkey")).alias("project_id"), user(k % 40).alias("user_id"), ids.alias("document_ids"), F.array(mail).alias("shared_with"), F.col("o_orderdate").alias("updated_at"))
    c = F.col("c_custkey")
    p = load(spark, sf, "customer").select(c.alias("id"), user(F.col("c_nationkey")).alias("user_id"), F.when(c % 9 == 0, F.array(F.lit("a@x.org"))).alias("shared_with"))
    return access.visible_reviews(r, p, "u7", "a@x.org").select("id", "is_owner", "document_count")


@register("s03_own_chats", """
SELECT o.o_orderkey AS id, c.c_name AS creator_display_name FROM (SELECT *, 'u' || (o_custkey % 30) AS user_id FROM orders) o LEFT JOIN customer c ON c.c_custkey % 2 = 1 AND 'u' || c.c_custkey = o.user_id WHERE o.user_id = 'u9' ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 100""")
def s03_chats(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), user(F.col("o_custkey") % 30).alias("user_id"), F.col("o_orderdate").alias("created_at"))
    p = load(spark, sf, "customer").filter("c_custkey % 2 = 1").select(user(F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("display_name"))
    return access.own_chats(o, p, "u9", 100).select("id", "creator_display_name")


@register("s03_visible_workflows", """
WITH w AS (SELECT p_partkey AS id, 'u' || p_size AS user_id, p_brand AS type, p_partkey % 11 = 0 AS is_system FROM part),
s AS (SELECT s_suppkey AS workflow_id, unnest(['a@x.org', CASE WHEN s_suppkey % 3 = 0 THEN 'A@X.org' ELSE 'c@x.org' END]) AS mail, 'u' || s_nationkey AS by, s_suppkey % 2 = 0 AS may FROM supplier WHERE s_suppkey % 4 <> 1),
n AS (SELECT 'u' || c_custkey AS user_id, c_name FROM customer WHERE c_custkey < 15)
SELECT w.id, w.user_id = 'u7' AS is_owner, CASE WHEN w.user_id = 'u7' THEN true WHEN is_system THEN false ELSE coalesce(may, false) END AS allow_edit, CASE WHEN w.user_id <> 'u7' AND NOT is_system THEN c_name END AS shared_by_name
FROM w LEFT JOIN s ON s.workflow_id = w.id AND lower(s.mail) = 'a@x.org' LEFT JOIN n ON n.user_id = s.by WHERE w.user_id = 'u7' OR is_system OR s.workflow_id IS NOT NULL""")
def s03_workflows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    w = load(spark, sf, "part").select(k.alias("id"), user(F.col("p_size")).alias("user_id"), F.col("p_brand").alias("type"), (k % 11 == 0).alias("is_system"), k.alias("created_at"))
    j = F.col("s_suppkey")
    mails = F.array(F.lit("a@x.org"), F.when(j % 3 == 0, "A@X.org").otherwise("c@x.org"))
    s = load(spark, sf, "supplier").filter("s_suppkey % 4 <> 1").select(j.alias("workflow_id"), F.explode(mails).alias("shared_with_email"), user(F.col("s_nationkey")).alias("shared_by_user_id"), (j % 2 == 0).alias("allow_edit"))
    n = load(spark, sf, "customer").filter("c_custkey < 15").select(user(F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("display_name"))
    return access.visible_workflows(w, s, n, "u7", "A@x.org").select("id", "is_owner", "allow_edit", "shared_by_name")


#: Words that are put behind the turns of conversations, so that every rule is met.
SAID = ("hello", "please proofread this letter", "the witness later said otherwise", "map their defense for us", "a trade secret was taken", "the assignment clause", "a takedown notice came", "a va claim and the bva", "my security clearance", "the howey test", "a recording contract", "the eu ai act", "a plain matter", "what is the holding, a summary")


def rule_sql(said: str, rules: list[tuple[str, str]], rest: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({said}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for p, label in rules)
    return f"CASE {arms} ELSE {rest} END"


@register("p14_message_intents", f"""
WITH m AS (SELECT conv_id, turn, role, lower(trim(CASE WHEN turn % 2 = 0 THEN '' ELSE text || ' ' END || [{', '.join(f"'{s}'" for s in SAID)}][1 + (conv_id * 5 + turn) % {len(SAID)}])) AS said FROM conversations),
i AS (SELECT *, CASE WHEN length(said) < {X.SHORT_MESSAGE} THEN 'simple' ELSE {rule_sql('said', X.INTENT_RULES, "CASE WHEN role = 'system' THEN 'full_crew' ELSE 'research_only' END")} END AS intent FROM m)
SELECT conv_id, turn, intent, CASE WHEN intent = 'specialty' THEN {rule_sql('said', X.SPECIALTY_RULES, "'ai_legal_tech'")} END AS specialty FROM i""")
def p14_intents(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    said = F.concat(F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat("text", F.lit(" "))), F.element_at(F.array(*map(F.lit, SAID)), (1 + (F.col("conv_id") * 5 + F.col("turn")) % len(SAID)).cast("int")))
    intent, specialty = X.message_intent(said, F.col("role") == "system")
    return c.select("conv_id", "turn", intent.alias("intent"), specialty.alias("specialty"))


BARE = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))"


@register("x39_quotes_in_blocks", f"""
WITH b AS (SELECT *, coalesce(sum(length(bare)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM (SELECT conv_id, turn, {BARE.format('text')} AS bare FROM conversations)),
w AS (SELECT conv_id, string_agg(bare, '' ORDER BY turn) AS whole FROM b GROUP BY 1),
q AS (SELECT conv_id, unnest([{BARE.format('substr(text, 15, 90)')}, {BARE.format('right(text, 40)')}, 'notthere']) AS seg, unnest([0, 1, 2]) AS k FROM conversations WHERE turn = 1),
s AS (SELECT q.conv_id, k, strpos(whole, substr(seg, 1, 30)) - 1 AS since, length(seg) AS n FROM q JOIN w ON w.conv_id = q.conv_id WHERE seg <> '' AND strpos(whole, substr(seg, 1, 30)) > 0),
h AS (SELECT s.conv_id, b.turn, k, greatest(0, since - ahead) AS since, least(length(bare), since + n - ahead) AS until FROM s JOIN b ON b.conv_id = s.conv_id AND since < ahead + length(bare) AND since + n > ahead)
SELECT conv_id AS doc, turn AS block, CAST(max_by(since, k) AS BIGINT) AS since, CAST(max_by(until, k) AS BIGINT) AS until FROM h GROUP BY 1, 2""")
def x39_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A quote of three segments for each conversation: two of its second turn, and one that is nowhere."""
    c = load(spark, sf, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("block"), "text")
    dots = lambda t: F.replace(t, F.lit("..."), F.lit(" "))
    quote = F.concat(dots(F.substring("text", 15, 90)), F.lit(" ... "), dots(F.right("text", F.lit(40))), F.lit("…not there"))
    q = c.filter("turn = 1").select(F.col("conv_id").alias("doc"), F.lit(0).alias("quote_id"), quote.alias("quote"))
    return quotes.locate_quotes(blocks, q).select("doc", "block", "since", "until")


@register("x21_quotes_grounded_in_documents")
def x21_grounded(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is an opinion that one benchmark item cites; each citing item's text is looked for in the whole opinion."""
    items = load(spark, sf, "benchmark").select(F.col("item_id").alias("entry"), "text")
    n = items.count()
    cite = lambda k: X.cite_slug(F.concat(k.cast("string"), F.lit(" U.S. "), (k % 7).cast("string")))
    docs = load(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("k"))
    bodies = docs.select(F.concat_ws("-", cite(F.col("k")), "doc_id").alias("slug"), "text")
    cited = docs.select("k", "doc_id").join(items.withColumn("k", F.pmod("entry", F.lit(n))), "k")
    return quotes.ground_entries(cited.select("entry", F.concat_ws("-", cite(F.col("k")), "doc_id").alias("slug"), F.col("text").alias("quote")), bodies)


#: A title for each filing rule, and one that fits none.
TITLES = ("Motion to Dismiss count two", "Brief on Summary Judgment", "Third Motion in Limine", "Amended Petition", "Answer of the tenant", "Final Order", "Case Management report", "Stip. on dates", "Notice of Appeal", "Subpoena to a bank", "Deposition of a clerk", "Discovery letter", "Trial brief", "Hearing set", "Consent Decree", "Settlement terms", "A letter")


@register("p15_filing_titles", f"""
WITH t AS (SELECT o_orderkey, lower(o_orderpriority || ' ' || [{', '.join(f"'{x}'" for x in TITLES)}][1 + o_orderkey % {len(TITLES)}]) AS title FROM orders) SELECT o_orderkey, {rule_sql('title', X.FILING_RULES, "'Other'")} AS kind FROM t""")
def p15_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat_ws(" ", "o_orderpriority", F.element_at(F.array(*map(F.lit, TITLES)), (1 + F.col("o_orderkey") % len(TITLES)).cast("int")))
    return load(spark, sf, "orders").select("o_orderkey", X.first_match(title, X.FILING_RULES, "Other").alias("kind"))


_CITE = X.DICTIONARY_CITE
_SEE = ("see 410 U.S. 113 and 12 F.3d 45, then 93 S. Ct. 705", "no cite", "as in 5 F. Supp. 2d 99", "1 U.S. 1, 2 U.S. 2, 3 U.S. 3, 4 U.S. 4, 5 U.S. 5, 6 U.S. 6")


@register("s12_dictionary_cites", f"""
WITH e AS (SELECT item_id, unnest([0, 1, 2, 3]) AS k, replace(text, chr(34), ' ') AS t FROM benchmark), b AS (SELECT item_id, k, 'holds ' || chr(34) || substr(t, 1 + k * 3, CASE k WHEN 3 THEN 12 * (item_id % 3) ELSE 150 END) || chr(34) || ' ' || [{', '.join(f"'{x}'" for x in _SEE)}][1 + (item_id + k) % 4] AS body FROM e)
SELECT item_id, 'term ' || k AS term, regexp_extract(body, '{X.DICTIONARY_QUOTE}', 1) AS quote, regexp_extract_all(body, '{_CITE}', 1)[1:5] AS cites FROM b WHERE regexp_extract(body, '{X.DICTIONARY_QUOTE}', 1) <> '' AND len(regexp_extract_all(body, '{_CITE}', 1)) > 0""")
def s12_cites(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of four sections for each item; some lack a cite or have too short a quote."""
    t = F.replace("text", F.lit('"'), F.lit(" "))
    body = F.lit("# Dictionary")
    for k in range(4):
        see = F.element_at(F.array(*map(F.lit, _SEE)), (1 + (F.col("item_id") + k) % 4).cast("int"))
        quote = F.substring(t, F.lit(1 + 3 * k), F.lit(150) if k < 3 else (12 * (F.col("item_id") % 3)).cast("int"))
        body = F.concat(body, F.lit(f"\n## term {k}\nholds \""), quote, F.lit('" '), see)
    entries = load(spark, sf, "benchmark").select("item_id", F.explode(X.dictionary_entries(body)).alias("e"))
    return entries.select("item_id", "e.term", "e.quote", "e.cites")
