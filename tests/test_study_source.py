"""The study folder as a source: batch and stream read the same rows, and filters rule files out before they are read."""

import os

import pytest

from tessera.sources.study import EVENTS, StudyFiles, StudyReader, register_study

FILES = {
    "a": "type,start,duration,text\nWord,0.5,0.25,hello\nWord,1,0.5,\"two\nlines, one field\"\n",
    "b": "text,type,start,other\nx,Sound,2.5,9\n",
    "c": "type,start,duration,text\n",
    "d": "",
}
ROWS = [("a", "Word", 0.5, 0.25, "hello"), ("a", "Word", 1.0, 0.5, "two\nlines, one field"), ("b", "Sound", 2.5, None, "x")]


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "study"
    at.mkdir()
    for name, text in FILES.items():
        (at / f"{name}.csv").write_text(text)
    (at / "notes.txt").write_text("not events")
    return at


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batch(spark, folder):
    register_study(spark)
    df = spark.read.format("study").load(str(folder))
    assert rows(df) == ROWS
    assert rows(df.select("text").filter("timeline >= 'b'")) == [("x",)]
    assert rows(spark.read.format("study").option("bytes", 1).load(str(folder))) == ROWS
    assert rows(spark.read.format("study").schema("start double, more string, timeline string").load(str(folder))) == [(0.5, None, "a"), (1.0, None, "a"), (2.5, None, "b")]


@pytest.mark.parametrize(("condition", "names"), [("timeline = 'a'", "a"), ("timeline in ('b', 'c')", "bc"), ("timeline > 'b' and start > 0", "cd"), ("timeline like 'b%'", "b"), ("start > 0", "abcd"), ("timeline = 'none'", "")])
def test_filters_prune(spark, folder, condition, names):
    register_study(spark)
    df = spark.read.format("study").option("bytes", 1).load(str(folder)).filter(condition)
    parts = df.rdd.getNumPartitions()
    assert parts == max(len(names), 1)
    full = spark.createDataFrame(ROWS, EVENTS).filter(condition)
    assert rows(df) == rows(full)


def test_files_in_folders_of_timelines(spark, tmp_path):
    register_study(spark)
    df = spark.createDataFrame([("a b", 1.0), ("a b", 2.0), ("c/d", 3.0)], "timeline string, start double")
    df.repartition(3).write.partitionBy("timeline").csv(str(tmp_path / "s"), header=True)
    got = spark.read.format("study").schema(df.schema).load(f"file:{tmp_path}/s")
    assert rows(got) == rows(df) and rows(got.filter("timeline = 'c/d'")) == [("c/d", 3.0)]


def test_files_go_together_up_to_a_size(folder):
    parts = lambda size: [[os.path.basename(p) for p in part.paths] for part in StudyReader(StudyFiles({"path": str(folder), "bytes": size}, None)).partitions()]
    assert parts("1") == [["a.csv"], ["b.csv"], ["c.csv", "d.csv"]] or parts("1") == [["a.csv"], ["b.csv"], ["c.csv"], ["d.csv"]]
    assert parts("100000") == [["a.csv", "b.csv", "c.csv", "d.csv"]]


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    register_study(spark)

    def poll():
        stream = spark.readStream.format("study").option("settle", 0).load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.schema(EVENTS).parquet(str(tmp_path / "out")))

    assert poll() == ROWS
    (folder / "late.csv").write_text("type,start\nWord,7\n")
    want = sorted([*ROWS, ("late", "Word", 7.0, None, None)], key=str)
    assert sorted(poll(), key=str) == want
    assert sorted(poll(), key=str) == want


def test_writes_a_file_for_each_timeline(spark, tmp_path):
    register_study(spark)
    df = spark.createDataFrame([("a b", 0.1 + 0.2, "x"), ("c/d", 1e300, None), ("a b", 2.0, 'two\n"lines"'), ("é", -0.0, ",")], "timeline string, start double, text string")
    for _ in range(2):
        df.repartition(2, "timeline").sortWithinPartitions("timeline").write.format("study").mode("append").save(f"file://{tmp_path}/s")
    got = spark.read.format("study").schema(df.schema).load(f"file:{tmp_path}/s")
    assert sorted(rows(got), key=str) == sorted(2 * rows(df), key=str)
    assert sorted(p.parent.name for p in (tmp_path / "s").rglob("*")  if p.is_file()) == sorted(2 * ["timeline=a%20b", "timeline=c%2Fd", "timeline=%C3%A9"])


def test_a_write_that_fails_leaves_no_files(spark, tmp_path):
    register_study(spark)
    df = spark.range(0, 100, 1, 2).selectExpr("cast(id as string) as timeline", "if(id = 99, cast(raise_error('late') as double), id) as start")
    with pytest.raises(Exception, match="late"):
        df.write.format("study").mode("append").save(str(tmp_path / "s"))
    assert not [p for p in (tmp_path / "s").rglob("*") if p.is_file()]


def test_many_small_files_go_to_several_tasks(spark, tmp_path):
    """Of a size that one task would hold; their rows come in few batches."""
    at = tmp_path / "s"
    at.mkdir()
    for k in range(600):
        (at / f"{k}.csv").write_text(f"type,start\nWord,{k}\n")
    files = StudyFiles({"path": str(at)}, spark.createDataFrame([], EVENTS).schema)
    parts = StudyReader(files).partitions()
    assert [len(p.paths) for p in parts] == [256, 256, 88]
    batches = [b for p in parts for b in files.read(p)]
    assert len(batches) == 3 and sorted(x for b in batches for x in b.column("start").to_pylist()) == list(range(600))
