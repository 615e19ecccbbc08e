"""File sources, sinks and incremental flows, as registered queries: each writes to the shared folder and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.folds import sentence_words
from tessera.registry import register
from tessera.session import tables_dir
from tessera.sources import files
from tessera.sources.study import register_study
from tessera.streaming import flows
from tessera.streaming.context import ROCKSDB, streamed_context
from tessera.tables import INTERVALS_SQL, intervals, load


def place(spark: SparkSession) -> str:
    return f"{tables_dir(spark)}/flow-{uuid.uuid4().hex}"


def staged(spark: SparkSession, sf: str, parts: int = 3) -> tuple[DataFrame, str]:
    """Events in their order, as `parts` files of a folder that a stream reads one by one."""
    folder, e = place(spark), load(spark, sf, "events")
    bounds = e.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0.01)
    last = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        some = e
        some = some.filter(F.col("event_id") > low) if low is not None else some
        some = some.filter(F.col("event_id") <= high) if high is not None else some
        some.coalesce(1).write.mode("append").parquet(folder)
        last = some
    return last, folder


@register("k06_file_sinks", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    """Orders through a CSV, a JSON and a Parquet sink in turn."""
    o, at = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), place(spark)
    o.write.csv(f"{at}/csv", header=True)
    spark.read.schema(o.schema).csv(f"{at}/csv", header=True).write.json(f"{at}/json")
    spark.read.schema(o.schema).json(f"{at}/json").write.parquet(f"{at}/parquet")
    return spark.read.schema(o.schema).parquet(f"{at}/parquet")


@register("s06_json_records", "SELECT event_id, event_type, value FROM events")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    at = place(spark)
    load(spark, sf, "events").select("event_id", "event_type", "value").write.json(at)
    return files.read_json_records(spark, f"{at}/*.json", "event_id long, event_type string, value double")


@register("s07_texts_by_slug", "SELECT 'nation_' || n_nationkey AS slug, n_name AS text FROM nation")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    """One folder and file for each text, read by pattern and keyed by name."""
    at = place(spark)
    n = load(spark, sf, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("value"))
    n.repartition(4, "slug").write.partitionBy("slug").text(at)
    got = spark.read.text(f"{at}/*/*", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "slug=([^/]+)/", 1).alias("slug"), F.rtrim(F.regexp_replace("value", "\n$", "")).alias("text"))
    return got


@register("s15_study_loader", f"WITH {INTERVALS_SQL}, t AS (SELECT timeline FROM ev GROUP BY 1 HAVING count(*) >= 5) SELECT event_id, timeline, row_number() OVER (PARTITION BY timeline ORDER BY start, duration DESC, event_id) AS k FROM ev WHERE timeline IN (SELECT timeline FROM t)")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy("timeline").orderBy("start", F.desc("duration"), "event_id")).cast("long"))
    e = intervals(spark, sf).select("event_id", "timeline", "start", "duration")
    return files.load_study(spark, e, place(spark), "n_events >= 5", (number,)).select("event_id", "timeline", "k")


STUDY = "timeline string, event_id long, start double, duration double"


def written_study(spark: SparkSession, sf: str) -> str:
    """A study folder: the events of each timeline as files of their own."""
    at, tasks = place(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = intervals(spark, sf).select(F.col("timeline").cast("string").alias("timeline"), "event_id", "start", "duration")
    e.repartition(tasks, "timeline").sortWithinPartitions("timeline").write.format("study").mode("append").save(at)
    return at


@register("s15_study_source", f"WITH {INTERVALS_SQL} SELECT CAST(timeline AS VARCHAR) AS timeline, count(*) AS n, round(min(start), 3) AS first, round(sum(duration), 3) AS durations FROM ev WHERE CAST(timeline AS VARCHAR) >= '2' AND start > 0 GROUP BY 1")
def s15_source(spark: SparkSession, sf: str) -> DataFrame:
    """Timelines whose names come after '2' by the study source, which reads only their files."""
    register_study(spark)
    e = spark.read.format("study").schema(STUDY).load(written_study(spark, sf)).filter("timeline >= '2' AND start > 0")
    return e.groupBy("timeline").agg(F.count("*").alias("n"), F.round(F.min("start"), 3).alias("first"), F.round(F.sum("duration"), 3).alias("durations"))


@register("s15_study_stream", f"WITH {INTERVALS_SQL} SELECT CAST(timeline AS VARCHAR) AS timeline, event_id, round(start, 3) AS start FROM ev")
def s15_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same folder as a stream; a second poll finds nothing new."""
    register_study(spark)
    stream, at = spark.readStream.format("study").option("settle", 0).schema(STUDY).load(written_study(spark, sf)), place(spark)
    for _ in range(2):
        flows.poll(stream, f"{at}/sink", f"{at}/cp")
    return spark.read.schema(STUDY).parquet(f"{at}/sink").select("timeline", "event_id", F.round("start", 3).alias("start"))


@register("g01_ndjson_assembly", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of chunks for each user, every record cut into two chunks, with malformed lines in between."""
    e = load(spark, sf, "events")
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}\n{broken\n"))
    cut = (1 + F.col("event_id") % 20).cast("int")
    halves = F.array(F.substring(line, F.lit(1), cut), F.substring(line, cut + 1, F.length(line)))
    chunk = e.select(F.col("user_id").alias("stream"), "event_id", F.posexplode(halves).alias("half", "value"))
    chunk = chunk.select("stream", (F.col("event_id") * 2 + F.col("half")).alias("seq"), "value")
    folder, at = place(spark), place(spark)
    chunk.write.parquet(folder)
    flows.poll(flows.source(spark, folder, chunk.schema, 4), f"{at}/sink", f"{at}/cp")
    return flows.ndjson_records(spark.read.schema(chunk.schema).parquet(f"{at}/sink"), "event_id long, k long").select("event_id", "k")


@register("g02_rechunked_reply", "SELECT conv_id, turn, CAST(ceil(length(replace(text, chr(10), ' ')) / 80.0) AS INTEGER) AS chunks FROM conversations")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("(.{1,80})"), F.lit(1))).alias("chunks"))


@register("g03_incremental_poll", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    """Two polls with one checkpoint: the second sees what came in between only."""
    e, folder, at = load(spark, sf, "events"), place(spark), place(spark)
    e.filter("event_id % 2 = 0").write.parquet(folder)
    flows.poll(flows.source(spark, folder, e.schema, 100), f"{at}/sink", f"{at}/cp")
    e.filter("event_id % 2 = 1").write.mode("append").parquet(folder)
    flows.poll(flows.source(spark, folder, e.schema, 100), f"{at}/sink", f"{at}/cp")
    return spark.read.schema(e.schema).parquet(f"{at}/sink").groupBy("event_type").agg(F.count("*").alias("n"))


@register("g04_isolated_sweep", "SELECT event_id FROM events")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    """One batch fails in the first sweep, the others go through; the second sweep takes its rows up again."""
    _, folder = staged(spark, sf)
    at = place(spark)
    stream = flows.source(spark, folder, load(spark, sf, "events").schema)

    def work(down: tuple[int, ...]):
        def write(batch: DataFrame, number: int) -> None:
            if number in down:
                raise ConnectionError("the sink is away")
            batch.select("event_id").write.parquet(f"{at}/sink/{number}")

        return write

    failed = [len(flows.sweep(stream, f"{at}/cp", work(down))) for down in ((1,), ())]
    if failed != [1, 0]:
        raise RuntimeError(f"failed batches in the two sweeps: {failed}")
    return spark.read.schema("event_id long").parquet(f"{at}/sink/*")


@register("g05_resumable_batch", "SELECT doc_id, length(text) AS n FROM documents")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    """A run that stopped in the middle, and the one that takes up the rest."""
    d, sink = load(spark, sf, "documents"), place(spark)
    work = lambda some: some.select("doc_id", F.length("text").cast("long").alias("n"))
    work(d.filter(F.xxhash64("doc_id") % 2 == 0)).write.parquet(sink)
    done = spark.read.schema("doc_id long, n long").parquet(sink)
    work(flows.resume(d, done, "doc_id")).write.mode("append").parquet(sink)
    return spark.read.schema("doc_id long, n long").parquet(sink)


@register("g07_stateful_fold", """
WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, k, value * 0.2::DOUBLE AS s FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, r.s * 0.8::DOUBLE + o.value * 0.2::DOUBLE FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, round(s, 6) AS s, k AS n FROM (SELECT user_id, s, k, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS z FROM r) WHERE z = 1""")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    _, folder = staged(spark, sf)
    at = place(spark)
    updates = flows.smooth(flows.source(spark, folder, load(spark, sf, "events").schema))
    updates.writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.parquet(f"{at}/sink/{k}")).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("user_id long, s double, n long").parquet(f"{at}/sink/*")
    return got.groupBy("user_id").agg(F.round(F.max_by("s", "n"), 6).alias("s"), F.max("n").alias("n"))


@register("g07_streamed_context", r"""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN text <> lead(text) OVER (PARTITION BY conv_id ORDER BY turn) THEN text ELSE '' END AS done FROM conversations),
p AS (SELECT *, coalesce(string_agg(done, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS past, string_split(text, ' ') AS words FROM c),
w AS (SELECT conv_id, turn, text, past, unnest(range(len(words))) AS k, words FROM p),
x AS (SELECT conv_id, turn, k, past || substr(text, 1, length(array_to_string(words[1:k + 1], ' '))) AS context FROM w)
SELECT conv_id, turn, k, array_to_string(list_reverse(list_reverse(string_split(context, ' '))[1:21]), ' ') AS context FROM x""")
def g07_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every turn with the context before it, from a stream in three polls: odd turns come a second and a half
    late. A last word far ahead lets the watermark pass all others."""
    folder, at, comes = place(spark), place(spark), F.col("turn") + F.col("turn") % 2 * 1.5
    c = load(spark, sf, "conversations").withColumn("comes", comes.cast("double"))

    def words(turns: DataFrame) -> DataFrame:
        # words are many times their turns, so turns are spread before they are cut
        w = sentence_words(turns.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 900)))
        return w.select(F.array("id.conv_id", "id.turn", "id.k").alias("id"), "timeline", F.timestamp_seconds(F.col("start") + 1000).alias("ts"), "text", "sentence", "sentence_char", "split")

    low, high = c.approxQuantile("comes", [1 / 3, 2 / 3], 0.01) or (0.0, 0.0)
    parts = [words(c.filter(F.col("comes") <= low)), words(c.filter((F.col("comes") > low) & (F.col("comes") <= high))), words(c.filter(F.col("comes") > high))]
    schema = parts[0].schema
    end = spark.range(1).select(*(F.lit(v).cast(schema[c].dataType).alias(c) for c, v in {"timeline": -1, "text": "", "sentence": "", "sentence_char": None, "split": None}.items()), F.array(F.lit(-1).cast("long")).alias("id"), F.lit("2200-01-01").cast("timestamp").alias("ts"))
    parts[-1] = parts[-1].unionByName(end)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        for part in parts:
            part.write.mode("append").parquet(folder)
            flows.poll(streamed_context(flows.source(spark, folder, schema, 1000), 20, "2 seconds"), f"{at}/sink", f"{at}/cp")
    finally:
        spark.conf.set(provider, before)
    got = spark.read.schema("id array<long>, context string").parquet(f"{at}/sink")
    return got.select(*(F.element_at("id", k + 1).alias(c) for k, c in enumerate(("conv_id", "turn", "k"))), "context")


@register("g08_read_through_cache", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE 'fetched ' || o_custkey END AS answer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    cache = load(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("answer"))
    answers, _ = flows.read_through(asked, cache, "k", lambda m: m.select("k", F.concat(F.lit("fetched "), F.col("k").cast("string")).alias("answer")))
    return answers.select("o_orderkey", "answer")


@register("g09_event_time_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    """Added to the inventory: daily windows over a stream with a watermark, the state complete at the end."""
    _, folder = staged(spark, sf)
    at = place(spark)
    counts = flows.event_windows(flows.source(spark, folder, load(spark, sf, "events").schema), "2 days", "1 day")
    counts.writeStream.outputMode("complete").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{at}/sink")).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{at}/sink")
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("g09_session_windows", """
WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts > p + INTERVAL 6 HOUR OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def g09_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Added to the inventory: sessions that end after six hours without an event."""
    e = load(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
