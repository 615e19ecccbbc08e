"""Text scalars, captions, markup and verification rules, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.quotes import verbatim_hits
from tessera.registry import register
from tessera.tables import load

SLUG = "regexp_replace(regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
STRIP = "regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&amp;', '&', 'g'), '&[a-z]+;', ' ', 'g')"
CAPTION = "list_aggregate(list_filter(list_transform(list_filter(list_transform(string_split(replace({}, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, 'WEBVTT') AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^[0-9]+$')), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), lambda x: x <> ''), 'string_agg', ' ')"
WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: length(w) > 1))"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@register("x01_cite_slug", f"SELECT doc_id, {SLUG.format('trim(text)')} AS slug FROM documents")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", X.cite_slug(F.trim("text")).alias("slug"))


@register("x02_case_slug", "SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(url), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS slug FROM pages")
def x02(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", X.case_slug(F.col("url")).alias("slug"))


@register("x03_html_text", f"SELECT page_id, trim(regexp_replace({STRIP.format(chr(39).join(['regexp_replace(html, ', '(?is)<(script|style)[^>]*>.*?</(script|style)>', ', ', ' ', ', ', 'g', ')']))}, '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages")
def x03(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", X.page_text(F.col("html")).alias("body"))


QUOTES = "translate({}, chr(8216)||chr(8217)||chr(8220)||chr(8221)||chr(8212)||chr(8211), '''''\"\"--')"


@register("x04_quote_norm", f"SELECT item_id, trim(regexp_replace(regexp_replace(lower({QUOTES.format(STRIP.format('text'))}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS q FROM benchmark")
def x04(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", X.quote_norm(F.col("text")).alias("q"))


@register("x05_bracket_norm", "SELECT item_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace('[a] ' || text || ' . . . [b c]', '\\[.*?\\]', ' ', 'g'), '\\.\\s*\\.\\s*\\.', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS q FROM benchmark")
def x05(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", X.bracket_norm(F.concat(F.lit("[a] "), "text", F.lit(" . . . [b c]"))).alias("q"))


@register("x06_verbatim_quotes", "SELECT b.item_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY 1")
def x06(spark: SparkSession, sf: str) -> DataFrame:
    quotes = load(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    hits = verbatim_hits(quotes, docs(spark, sf).select("doc_id", "text"))
    return hits.groupBy(F.col("quote_id").alias("item_id")).agg(F.count("*").alias("n_docs"))


@register("x07_find_in_text", "SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INTEGER) AS n FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)")
def x07(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", X.count_of(F.col("text"), F.lit(" THE ")).alias("n"))


@register("x10_citation_parts", "SELECT p_partkey, nullif(regexp_extract(c, '\\b(\\d{1,4})\\s+([A-Za-z][A-Za-z0-9.\\s]*?)\\s+(\\d{1,7})\\b', 1),'') AS volume, nullif(trim(regexp_replace(regexp_extract(c, '\\b(\\d{1,4})\\s+([A-Za-z][A-Za-z0-9.\\s]*?)\\s+(\\d{1,7})\\b', 2), '\\s+', ' ', 'g')),'') AS reporter, nullif(regexp_extract(c, '\\b(\\d{1,4})\\s+([A-Za-z][A-Za-z0-9.\\s]*?)\\s+(\\d{1,7})\\b', 3),'') AS page FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'see ' || p_size || ' So.  2d ' || p_partkey ELSE p_name END AS c FROM part)")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    c = F.when(F.col("p_size") > 25, F.concat(F.lit("see "), F.col("p_size").cast("string"), F.lit(" So.  2d "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    volume, reporter, page = X.citation_parts(c)
    return load(spark, sf, "part").select("p_partkey", volume.alias("volume"), reporter.alias("reporter"), page.alias("page"))


@register("x11_extract_all", "SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS links, coalesce(nullif(regexp_extract(html, '<h1>([^<]+)</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), '')) AS title FROM pages")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    first = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return load(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("links"), F.coalesce(first("<h1>([^<]+)</h1>"), first("<title>([^<]+)</title>")).alias("title"))


@register("x12_ids_from_urls", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, TRY_CAST(nullif(regexp_extract(url || ' 1987', '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1), '') AS INTEGER) AS year FROM pages")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"), X.year_of(F.concat("url", F.lit(" 1987"))).alias("year"))


@register("x13_clock_seconds", "SELECT event_id, s AS clock, h * 3600 + m * 60 + sec AS seconds FROM (SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts) AS sec, strftime(ts, '%-H:%M:%S') AS s FROM events)")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return load(spark, sf, "events").select("event_id", X.clock_text(seconds).alias("clock")).withColumn("seconds", X.clock_seconds(F.col("clock")).cast("long"))


@register("x14_compact_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    compact = F.when(F.col("o_orderkey") % 7 == 0, "199x").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return load(spark, sf, "orders").select("o_orderkey", X.iso_date(compact).alias("d"))


@register("x15_days_until", "SELECT o_orderkey, CAST(datediff('day', TIMESTAMP '1998-08-02', o_orderdate) AS INTEGER) AS days FROM orders")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1998-08-02")).alias("days"))


@register("x16_safe_cells", "SELECT page_id, replace(replace(replace(CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r]') THEN '''' || c ELSE c END, '|', '\\|'), '<', '&lt;'), '>', '&gt;') AS cell FROM (SELECT page_id, substr(CASE WHEN page_id % 3 = 0 THEN '=|' ELSE '' END || html, 1, 120) AS c FROM pages)")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", X.safe_cell(F.concat(F.when(F.col("page_id") % 3 == 0, "=|").otherwise(""), "html"), 120).alias("cell"))


@register("x17_cell_json", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'grey' ELSE event_type END AS flag, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS value FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'green' WHEN 'view' THEN 'red' ELSE 'grey' END AS event_type, props FROM events)")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    flag = F.when(F.col("event_type") == "click", "green").when(F.col("event_type") == "view", "red").otherwise("purple")
    raw = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(flag.alias("flag"), F.get_json_object("props", "$.k").cast("long").alias("value"))))
    cell = F.from_json(raw, "flag string, value long")
    return e.select("event_id", F.when(cell["flag"].isin("green", "red", "yellow"), cell["flag"]).otherwise("grey").alias("flag"), cell["value"].alias("value"))


@register("x20_content_hash", "SELECT doc_id, sha256(text) AS h, substr(sha256(text), 1, 10) AS short FROM documents")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"), F.substring(F.sha2("text", 256), 1, 10).alias("short"))


@register("x23_word_overlap", f"SELECT a.conv_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS overlap, round(len(list_intersect(x, ['the','of','der','la'])) / 4, 6) AS hit_rate FROM (SELECT conv_id, {WORDS.format('text')} AS x FROM conversations WHERE turn = 0) a JOIN (SELECT conv_id, {WORDS.format('text')} AS y FROM conversations WHERE turn = 1) b ON a.conv_id = b.conv_id")
def x23(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    a = c.filter("turn = 0").select("conv_id", X.content_words(F.col("text")).alias("x"))
    b = c.filter("turn = 1").select("conv_id", X.content_words(F.col("text")).alias("y"))
    rate = F.size(F.array_intersect("x", F.array(*map(F.lit, ("the", "of", "der", "la"))))) / 4
    return a.join(b, "conv_id").select("conv_id", F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("overlap"), F.round(rate, 6).alias("hit_rate"))


@register("x24_char_error_rate", "SELECT p_partkey, round(levenshtein(p_name, lower(p_type)) / greatest(length(p_name), 1), 6) AS cer FROM part")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.round(X.error_rate(F.col("p_name"), F.lower("p_type")), 6).alias("cer"))


@register("x26_keyboard_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(ceil(sqrt((a.n_nationkey % 10 - b.n_nationkey % 10) ** 2 + (a.n_regionkey - b.n_regionkey) ** 2)) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    key = load(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 10).alias("x"), F.col("n_regionkey").alias("y"))
    a, b = (key.select(F.col("n_nationkey").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for n in "ab")
    d = F.ceil(F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", d.alias("d"))


@register("x28_label_encoding", "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
def x28(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of the sorted distinct labels. The labels are few and their number is checked; the rows are joined, not sorted."""
    e = load(spark, sf, "events").select("event_id", "event_type")
    labels = e.groupBy("event_type").agg(F.lit(1).alias("one"))
    order = labels.agg(F.sort_array(F.collect_list("event_type")).alias("all")).select(F.posexplode("all").alias("code", "event_type"))
    return e.join(order, "event_type").select("event_id", "code")


@register("x29_text_to_classes", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, list_transform(string_split(p_brand, ''), lambda c: ascii(c) - 32) AS ids FROM part")
def x29(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.length("p_name").alias("n"), F.transform(F.split("p_brand", ""), lambda c: F.ascii(c) - 32).alias("ids"))


@register("x32_treatment_signal", """
SELECT conv_id, CASE WHEN max(lvl) = 2 THEN 'red' WHEN max(lvl) = 1 THEN 'yellow' ELSE 'green' END AS signal, sum(hits)::BIGINT AS n_mentions FROM (
SELECT conv_id, CASE WHEN turn % 5 = 4 THEN 2 WHEN turn % 5 = 3 THEN 1 ELSE 0 END AS lvl, CASE WHEN turn % 5 IN (3, 4) THEN 1 ELSE 0 END AS hits FROM conversations) GROUP BY 1""")
def x32(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("turn") % 5 == 4, "was Overruled by a later case").when(F.col("turn") % 5 == 3, "Distinguished on its facts").otherwise("followed")
    texts = load(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(said).alias("t"))
    signal, mentions = X.treatment_signal(F.col("t"))
    return texts.select("conv_id", signal.alias("signal"), F.size(mentions).cast("long").alias("n_mentions"))


@register("x33_jurisdiction_fit", "SELECT c_custkey, CASE WHEN j IS NULL OR j = '' THEN NULL WHEN j = 'NATION_9' THEN 'mandatory' WHEN contains('courts of NATION_1 and NATION_12', j) THEN 'mandatory' ELSE 'persuasive' END AS fit FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE n_name END AS j FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def x33(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("n_name"))
    fit = F.when(j.isNull() | (j == ""), None).when(j == "NATION_9", "mandatory").when(F.contains(F.lit("courts of NATION_1 and NATION_12"), j), "mandatory").otherwise("persuasive")
    return load(spark, sf, "customer").join(n, "c_nationkey").select("c_custkey", fit.alias("fit"))


@register("x34_coercion", "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n, coalesce(TRY_CAST(p_name AS DOUBLE), p_retailprice) AS price FROM part")
def x34(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int").alias("n"), F.coalesce(F.col("p_name").try_cast("double"), "p_retailprice").alias("price"))


@register("x35_iso_shape", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS d FROM orders")
def x35(spark: SparkSession, sf: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return load(spark, sf, "orders").select("o_orderkey", X.iso_or_empty(d).alias("d"))


@register("x36_rounding", "SELECT event_id, round(value, 1) AS r1, round(value * 1.37, 2) AS r2 FROM events")
def x36(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.round("value", 1).alias("r1"), F.round(F.col("value") * F.lit(1.37), 2).alias("r2"))


@register("x38_bigram_dice", """
WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '\\s+', '', 'g') AS a, regexp_replace(lower(p_type || ' ' || p_name), '\\s+', '', 'g') AS b FROM part),
x AS (SELECT p_partkey, substr(a, i, 2) AS g, count(*) AS n FROM s, generate_series(1, 60) t(i) WHERE i < length(a) GROUP BY 1, 2),
y AS (SELECT p_partkey, substr(b, i, 2) AS g, count(*) AS n FROM s, generate_series(1, 60) t(i) WHERE i < length(b) GROUP BY 1, 2),
c AS (SELECT x.p_partkey, sum(least(x.n, y.n)) AS n FROM x JOIN y ON x.p_partkey = y.p_partkey AND x.g = y.g GROUP BY 1)
SELECT s.p_partkey, round(2.0::DOUBLE * coalesce(c.n, 0) / (length(a) - 1 + length(b) - 1), 6) AS dice FROM s LEFT JOIN c ON c.p_partkey = s.p_partkey""")
def x38(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.round(X.bigram_dice(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("dice"))


@register("x39_locate_quote", "SELECT doc_id, strpos(regexp_replace(text, '[^A-Za-z]', '', 'g'), substr(regexp_replace(substr(text, 40, 60), '[^A-Za-z]', '', 'g'), 1, 30)) AS place FROM documents")
def x39(spark: SparkSession, sf: str) -> DataFrame:
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z]", "")
    return docs(spark, sf).select("doc_id", F.position(F.substring(letters(F.substring("text", 40, 60)), 1, 30), letters(F.col("text"))).cast("long").alias("place"))


@register("x40_plan_lines", "SELECT p_partkey, regexp_extract(l, 'QUERY: \"([^\"]*)\" SOURCE: ([a-z]+)', 1) AS q, CASE WHEN regexp_extract(l, 'QUERY: \"([^\"]*)\" SOURCE: ([a-z]+)', 2) IN ('caselaw','statute') THEN regexp_extract(l, 'QUERY: \"([^\"]*)\" SOURCE: ([a-z]+)', 2) ELSE 'web' END AS src FROM (SELECT p_partkey, 'QUERY: \"' || p_name || '\" SOURCE: ' || CASE WHEN p_size < 20 THEN 'statute' ELSE 'blog' END AS l FROM part)")
def x40(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit('QUERY: "'), "p_name", F.lit('" SOURCE: '), F.when(F.col("p_size") < 20, "statute").otherwise("blog"))
    pattern = 'QUERY: "([^"]*)" SOURCE: ([a-z]+)'
    source = F.regexp_extract(line, pattern, 2)
    return load(spark, sf, "part").select("p_partkey", F.regexp_extract(line, pattern, 1).alias("q"), F.when(source.isin("caselaw", "statute"), source).otherwise("web").alias("src"))


@register("s05_header_aliases", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(source), ''), '?') AS title FROM documents")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs), F.lit("?"))
    return docs(spark, sf).select("doc_id", pick(F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("lang")), F.col("source")).alias("title"))


@register("s08_two_payload_formats", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"result":{"content":{"k":'), k, F.lit("}}}"))).otherwise(F.concat(F.lit('{"content":{"k":'), k, F.lit("}}")))
    old, new = F.from_json(raw, "result struct<content: struct<k: long>>"), F.from_json(raw, "content struct<k: long>")
    return load(spark, sf, "events").select("event_id", F.coalesce(old["result"]["content"]["k"], new["content"]["k"]).alias("k"))


VTT = "'WEBVTT' || chr(10) || chr(10) || '12' || chr(10) || '00:00:01.000 --> 00:00:02.500' || chr(10) || '<c.x>' || text || '</c>' || chr(10)"


@register("s09_webvtt_text", f"SELECT conv_id, turn, {CAPTION.format('(' + VTT + ')')} AS said FROM conversations")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    vtt = F.concat(F.lit("WEBVTT\n\n12\n00:00:01.000 --> 00:00:02.500\n<c.x>"), "text", F.lit("</c>\n"))
    return load(spark, sf, "conversations").select("conv_id", "turn", X.caption_text(vtt).alias("said"))


@register("s10_srt_writer", "SELECT conv_id, string_agg(CAST(turn + 1 AS VARCHAR) || chr(10) || '00:00:' || lpad(CAST(turn * 5 AS VARCHAR), 2, '0') || ',000 --> 00:00:' || lpad(CAST(turn * 5 + 5 AS VARCHAR), 2, '0') || ',000' || chr(10) || role, chr(10) || chr(10) ORDER BY turn) AS srt FROM conversations GROUP BY 1")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda s: F.format_string("00:00:%02d,000", s)
    cue = F.format_string("%d\n%s --> %s\n%s", F.col("turn") + 1, at(F.col("turn") * 5), at(F.col("turn") * 5 + 5), F.col("role"))
    g = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues"))
    return g.select("conv_id", F.array_join(F.transform("cues", lambda x: x.cue), "\n\n").alias("srt"))


@register("s11_html_records", "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, link FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"/([^\"]+)\">', 1) AS l FROM pages))")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/([^"]+)">'), F.lit(1))).alias("pos", "link"))
    return p.withColumn("pos", F.col("pos").cast("long"))


@register("s12_markdown_dictionary", "SELECT item_id, 'term ' || item_id AS term, text AS quote FROM benchmark")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """One markdown body of many '## ' sections, cut into (term, quote)."""
    body = F.concat(F.lit("# Title\n"), F.lit("\n## term "), F.col("item_id").cast("string"), F.lit("\n> "), "text")
    section = F.element_at(F.split(body, "\n## "), 2)
    return load(spark, sf, "benchmark").select("item_id", F.regexp_extract(section, r"^([^\n]+)", 1).alias("term"), F.regexp_extract(section, r"(?s)\n> (.*)$", 1).alias("quote"))


@register("s13_journal_header", "SELECT c_custkey, c_name AS matter, c_mktsegment AS status FROM customer")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("# Journal\n**Matter:** "), "c_name", F.lit("\n**Status:**  "), "c_mktsegment", F.lit("\n"))
    field = lambda name: F.regexp_extract(text, rf"\*\*{name}:\*\*\s*([^\n]+)", 1)
    return load(spark, sf, "customer").select("c_custkey", field("Matter").alias("matter"), field("Status").alias("status"))


@register("p13_council_trigger", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'fire' WHEN turn = 1 THEN 'fire' WHEN turn = 2 THEN 'skip' WHEN turn = 3 THEN 'suggest' ELSE 'skip' END AS verdict FROM conversations")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    m = F.when(F.col("turn") == 1, "please War-Room this").when(F.col("turn") == 2, "what is a trial, should I sue or settle").when(F.col("turn") == 3, "Should I sue or settle before the deadline").otherwise("should I sue or wait")
    return load(spark, sf, "conversations").select("conv_id", "turn", X.council_trigger(m, F.when(F.col("role") == "system", "sidebar").otherwise("chat")).alias("verdict"))


@register("p14_intent_routing", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'alert' WHEN contains(p_name, 'ring') THEN 'jewel' WHEN regexp_matches(p_name, 'bolt|nut') THEN 'hardware' ELSE 'general' END AS intent FROM part")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", X.first_match(F.col("p_name"), [("red", "alert"), ("ring", "jewel"), ("bolt|nut", "hardware")], "general").alias("intent"))


@register("p15_filing_classes", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Complaint/Petition' WHEN 1 THEN 'Order/Opinion' WHEN 2 THEN 'Stipulation' WHEN 3 THEN 'Motion to Dismiss' ELSE 'Other' END AS kind FROM orders")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Response to Complaint", "Scheduling Order", "Joint Stip. of parties", "Rule 12(b) brief", "Letter"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", X.first_match(said, X.FILING_RULES, "Other").alias("kind"))


@register("p17_verdict_composition", """
SELECT p_partkey, CASE WHEN g3 = 'red' THEN 'vetoed' WHEN g2 = false THEN 'vetoed' WHEN g3 = 'yellow' OR g4 IS DISTINCT FROM 'mandatory' THEN 'conditional' ELSE 'verified' END AS status FROM (
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'red' WHEN p_size % 7 = 1 THEN 'yellow' WHEN p_size % 7 > 2 THEN 'green' END AS g3, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 END AS g2, CASE WHEN p_size % 5 > 1 THEN 'mandatory' WHEN p_size % 5 = 1 THEN 'persuasive' END AS g4 FROM part)""")
def p17(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    g3 = F.when(s % 7 == 0, "red").when(s % 7 == 1, "yellow").when(s % 7 > 2, "green")
    g2 = F.when(s % 3 == 0, s % 2 == 0)
    g4 = F.when(s % 5 > 1, "mandatory").when(s % 5 == 1, "persuasive")
    status = F.when(g3.eqNullSafe("red") | g2.eqNullSafe(False), "vetoed").when(g3.eqNullSafe("yellow") | ~g4.eqNullSafe("mandatory"), "conditional").otherwise("verified")
    return load(spark, sf, "part").select("p_partkey", status.alias("status"))
