"""A study folder as a data source of Spark, for batch, stream and writes: one CSV file of events for each timeline.

    spark.dataSource.register(StudySource)
    spark.read.format("study").load(folder).filter("timeline = 'b'")
    spark.readStream.format("study").load(folder)
    events.repartition(n, "timeline").sortWithinPartitions("timeline").write.format("study").mode("append").save(folder)

Files may also lie in folders named timeline=x, as a partitioned write leaves them: those name the timeline then, and a timeline
may have any number of files. Files whose names begin with _ or . are left out.

The columns are timeline (the folder's, else the file's name without its ending) and those of the schema that the reader is given, else EVENTS.
A column that a file lacks is null; further columns of the file are left out; an empty field is null. Files are read by
`pyarrow.fs`, so a folder may be a path or any address that it knows.

A write adds files in folders timeline=x, one for each run of rows of one timeline in a task, so rows are best sorted by it. They
get their names when their task is done, and go again where the write fails.

Options: `glob` (of the file names, *.csv), `bytes` and `files` (files are put together up to this size, 64 MB, and number, 256,
for one task, as small ones cost their opening), `settle`
(seconds that a file must be unchanged before a stream takes it, 2). Filters on timeline rule files out before anything is
read; as these comparisons are done whole, Spark does not repeat them. Other filters stay with Spark."""

from __future__ import annotations

import fnmatch
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

EVENTS = "timeline string, type string, start double, duration double, text string"
COMPARISONS = {EqualTo: str.__eq__, EqualNullSafe: str.__eq__, GreaterThan: str.__gt__, GreaterThanOrEqual: str.__ge__, LessThan: str.__lt__, LessThanOrEqual: str.__le__, StringStartsWith: str.startswith}
NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # the folder of a missing timeline, as Spark's own writes name it
SMALL, ROWS = 1 << 20, 10_000  # bytes of a file that is read at once, rows that small files are put together to


@dataclass(frozen=True, order=True)
class StudyFile:
    changed: int  # nanoseconds
    path: str
    size: int = field(compare=False, default=0)

    @property
    def timeline(self) -> str:
        *folders, name = self.path.split("/")
        named = [f.removeprefix("timeline=") for f in folders if f.startswith("timeline=")]
        return unquote(named[-1]) if named else name.rsplit(".", 1)[0]


class StudyPart(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class StudyFiles:
    """The files of a folder, and how they are read."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder, self.glob = options["path"], options.get("glob", "*.csv")
        self.part_bytes, self.settle = int(options.get("bytes", 64 << 20)), float(options.get("settle", 2))
        self.part_files = int(options.get("files", 256))
        self.schema = schema

    def opened(self):
        from pyarrow import fs

        # Hadoop writes local addresses with one slash
        return fs.FileSystem.from_uri(self.folder.removeprefix("file:") if self.folder.startswith("file:/") else self.folder)

    def listed(self) -> list[StudyFile]:
        from pyarrow import fs

        system, at = self.opened()
        found = [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, self.glob)]
        return sorted(StudyFile(int(f.mtime_ns or 0), f.path, f.size) for f in found)

    def parts(self, files: list[StudyFile]) -> list[StudyPart]:
        """Files in the order of their timelines, put together up to `part_bytes` and `part_files`."""
        out, size = [], 0
        for f in sorted(files, key=lambda f: (f.timeline, f.path)):
            if not out or size + f.size > self.part_bytes or len(out[-1]) == self.part_files:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [StudyPart(p) for p in out]

    def read(self, part: StudyPart) -> Iterator:
        """Arrow batches of the schema: a block of a large file at a time, or small files together."""
        import pyarrow as pa

        held, rows = [], 0
        for b in self.blocks(part):
            held.append(b)
            rows += b.num_rows
            if rows >= ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def blocks(self, part: StudyPart) -> Iterator:
        import pyarrow as pa
        from pyarrow import csv
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        names = [f for f in want if f.name != "timeline"]
        convert = csv.ConvertOptions(column_types={f.name: f.type for f in names}, include_columns=[f.name for f in names], include_missing_columns=True, strings_can_be_null=True, null_values=[""])
        how = {"parse_options": csv.ParseOptions(newlines_in_values=True), "convert_options": convert}
        system, _ = self.opened()
        for path in part.paths:
            name = StudyFile(0, path).timeline
            size = system.get_file_info(path).size
            if not size:
                continue
            with system.open_input_stream(path) as raw:
                batches = csv.read_csv(raw, csv.ReadOptions(use_threads=False), **how).to_batches() if size <= SMALL else csv.open_csv(raw, **how)
                for b in batches:
                    if b.num_rows:
                        columns = [pa.array([name] * b.num_rows, f.type) if f.name == "timeline" else b.column(f.name).cast(f.type) for f in want]
                        yield pa.RecordBatch.from_arrays(columns, schema=want)


class StudyReader(DataSourceReader):
    def __init__(self, files: StudyFiles):
        self.files, self.tests = files, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("timeline",) and self._understood(f):
                self.tests.append(f)
            else:
                yield f

    @staticmethod
    def _understood(f: Filter) -> bool:
        if isinstance(f, In):
            return all(isinstance(v, str) for v in f.value if v is not None)
        return isinstance(f, IsNotNull) or (type(f) in COMPARISONS and isinstance(f.value, str))

    def wanted(self, timeline: str) -> bool:
        def met(f: Filter) -> bool:
            if isinstance(f, IsNotNull):
                return True
            return timeline in f.value if isinstance(f, In) else COMPARISONS[type(f)](timeline, f.value)

        return all(met(f) for f in self.tests)

    def partitions(self) -> list[StudyPart]:
        # a table without files has one part without files
        return self.files.parts([f for f in self.files.listed() if self.wanted(f.timeline)]) or [StudyPart([])]

    def read(self, partition: StudyPart) -> Iterator:
        return self.files.read(partition)


class StudyStream(DataSourceStreamReader):
    """Files are taken in the order of (time of change, path), each once: the offset is the last one taken. A file that is
    changed later comes again as a whole. Files younger than `settle` seconds wait, so that one that is written at the same
    time as the last one taken, and has a smaller path, is not passed over."""

    def __init__(self, files: StudyFiles):
        self.files = files

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": "0", "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        until = time.time_ns() - int(self.files.settle * 1e9)
        ready = [f for f in self.files.listed() if f.changed <= until]
        return {"changed": str(ready[-1].changed), "path": ready[-1].path} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[StudyPart]:
        after, last = (StudyFile(int(o["changed"]), o["path"]) for o in (start, end))
        return self.files.parts([f for f in self.files.listed() if after < f <= last]) or [StudyPart([])]

    def read(self, partition: StudyPart) -> Iterator:
        return self.files.read(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are: there is nothing to let go of."""


class StudyWriter(DataSourceArrowWriter):
    """A task's files have names that readers leave out until it is done; those of a write that fails are known by its name."""

    def __init__(self, files: StudyFiles):
        self.files, self.write_id = files, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow.compute as pc
        from pyarrow import csv
        from pyspark import TaskContext

        system, at = self.files.opened()
        task = TaskContext.get()
        made, name, out, sink = [], None, None, None

        def ended() -> None:
            if out:
                out.close()
                sink.close()

        try:
            for batch in iterator:
                runs, rest, first = pc.run_end_encode(batch.column("timeline")), batch.drop_columns(["timeline"]), 0
                for end, timeline in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                    if not made or timeline != name:
                        ended()
                        out, name = None, timeline
                        folder = f"{at}/timeline={NO_NAME if timeline is None else quote(timeline, safe='')}"
                        file = f"part-{task.partitionId()}-{len(made)}-{self.write_id}.csv"
                        system.create_dir(folder, recursive=True)
                        made.append((f"{folder}/.{task.taskAttemptId()}-{file}", f"{folder}/{file}"))
                        sink = system.open_output_stream(made[-1][0])
                        out = csv.CSVWriter(sink, rest.schema)
                    out.write_batch(rest.slice(first, end - first))
                    first = end
            ended()
        except BaseException:
            for hidden, _ in made:
                if system.get_file_info(hidden).is_file:
                    system.delete_file(hidden)
            raise
        for hidden, path in made:
            system.move(hidden, path)
        return WriterCommitMessage()

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, at = self.files.opened()
        for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
            if f.is_file and self.write_id in f.base_name:
                system.delete_file(f.path)


class StudySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "study"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema: StructType) -> StudyReader:
        return StudyReader(StudyFiles(dict(self.options), schema))

    def writer(self, schema: StructType, overwrite: bool) -> StudyWriter:
        if overwrite or "timeline" not in schema.names:
            raise ValueError("a study folder is added to only, by rows with a timeline")
        return StudyWriter(StudyFiles(dict(self.options), schema))

    def streamReader(self, schema: StructType) -> StudyStream:  # noqa: N802
        return StudyStream(StudyFiles(dict(self.options), schema))


def register_study(spark) -> None:
    """Make the format "study" known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StudySource)
