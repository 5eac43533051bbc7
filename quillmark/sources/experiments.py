"""Experiment folders as a data source of Spark: a folder for each experiment, a JSON file for each part.

Reading takes a partition for each group of folders. Writing has two phases: tasks stage files in a folder of the job beside the experiments, and the commit
renames them into place, an experiment's state last, so what is there is whole; a job that fails leaves what was there and no staged files. Paths are of any file system that
Arrow knows. Predictions and questions of over ``PIECE`` bytes are several files, ``predictions.json``, ``predictions-00001.json`` and so on, each of that form, so no task holds an experiment;
files are read one at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillmark.sources.results import SKIPPED

SCHEMA = "experiment string, file string, content string"
#: Parts that are several files if they are large.
PIECED = ("predictions", "questions")
PARTS = ("metadata", "questions", "predictions", "results", "state")
#: Folders that a partition reads, and bytes of their files.
GROUP, GROUP_BYTES = 16, 1 << 25
#: Bytes of a file of predictions, beyond which they are several.
PIECE = 1 << 22
#: Files that are handed to the writer at once.
HANDED = 4
_STAGED = "_staged-"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _skipped(name: str) -> bool:
    return name.startswith(("_", ".")) or name in SKIPPED


def part_of(file: str) -> str:
    """The part that a file, or a piece of one, belongs to."""
    return re.sub(r"-\d{5,}$", "", file)


@dataclass
class Files(InputPartition):
    """(experiment, path) of files."""

    paths: tuple[tuple[str, str], ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, group: int):
        self.path, self.group = path, group

    def partitions(self) -> Sequence[InputPartition]:
        system, root = _system(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not _skipped(f.base_name))
        out, held, folders, size = [], [], set(), 0
        for name in names:
            for info in sorted(system.get_file_info(fs.FileSelector(f"{root}/{name}")), key=lambda f: f.base_name):
                if info.type != fs.FileType.File or not info.base_name.endswith(".json"):
                    continue
                if held and (len(folders | {name}) > self.group or size + info.size > GROUP_BYTES):
                    out.append(Files(tuple(held)))
                    held, folders, size = [], set(), 0
                held.append((name, info.path))
                folders.add(name)
                size += info.size
        return [*out, Files(tuple(held))] if held else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        for name, path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read().decode()
            file = path.rpartition("/")[2][: -len(".json")]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([file]), pa.array([content])], names=["experiment", "file", "content"])


@dataclass
class Staged(WriterCommitMessage):
    files: tuple[tuple[str, str, str], ...]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, checked: bool):
        self.path, self.overwrite, self.checked, self.job = path, overwrite, checked, f"{_STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, root = _system(self.path)
        files = []
        for row in iterator:
            if row["experiment"] is None or _skipped(row["experiment"]) or "/" in row["experiment"]:
                raise ValueError(f"no name of an experiment: {row['experiment']!r}")
            if self.checked:
                json.loads(row["content"])  # what is no JSON is not staged
            staged = f"{root}/{self.job}/{uuid.uuid4().hex}.json"
            system.create_dir(f"{root}/{self.job}", recursive=True)
            with system.open_output_stream(staged) as f:
                f.write(row["content"].encode())
            files.append((row["experiment"], row["file"], staged))
        return Staged(tuple(files))

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = _system(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({f[:2] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("a file of an experiment is given twice")
        if self.overwrite:
            old = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
            gone = [f.path for f in old if f.type == fs.FileType.Directory and not _skipped(f.base_name) and f.base_name not in {x[0] for x in files}]
            for path in gone:
                system.delete_dir(path)
        self._drop_pieces(system, root, files)
        for experiment, file, staged in sorted(files, key=lambda f: (f[0], f[1] == "state", f[1])):
            system.create_dir(f"{root}/{experiment}", recursive=True)
            system.move(staged, f"{root}/{experiment}/{file}.json")
        self._clear()

    def _drop_pieces(self, system: fs.FileSystem, root: str, files: list[tuple[str, str, str]]) -> None:
        """Pieces of the parts that are replaced, if the new ones are fewer."""
        kept, parts = {f[:2] for f in files}, {(f[0], part_of(f[1])) for f in files}
        for experiment in sorted({f[0] for f in files if part_of(f[1]) in PIECED}):
            for info in system.get_file_info(fs.FileSelector(f"{root}/{experiment}", allow_not_found=True)):
                file = info.base_name.removesuffix(".json")
                if (experiment, part_of(file)) in parts and (experiment, file) not in kept and part_of(file) in PIECED and info.base_name.endswith(".json"):
                    system.delete_file(info.path)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class ExperimentFolders(DataSource):
    """``spark.read.format("experiments").load(path)``: (experiment, file, content), content the JSON text of a file; and ``df.write`` of such rows.

    Overwriting removes experiments that are not written; appending replaces files of those that are. Options: ``group``, folders of a partition; ``checked``, false to write texts that are no JSON as well."""

    @classmethod
    def name(cls) -> str:
        return "experiments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("group", GROUP)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite, self.options.get("checked", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExperimentFolders)


def read_files(spark: SparkSession, path: str, group: int = GROUP) -> DataFrame:
    """(experiment, file, content) of the experiments right under path."""
    register(spark)
    return spark.read.format("experiments").option("group", group).load(path)


def read_part(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """(experiment and the schema's columns) of one part's files."""
    rows = read_files(spark, path).filter(F.regexp_replace("file", r"-\d{5,}$", "") == part if part in PIECED else F.col("file") == part)
    return rows.select("experiment", F.from_json("content", schema).alias("p")).select("experiment", "p.*")


def _json(rows: DataFrame, part: str, content) -> DataFrame:
    return rows.select("experiment", F.lit(part).alias("file"), content.alias("content"))


def _pieces(rows: DataFrame) -> DataFrame:
    """(experiment, file suffix, js, n): rows (experiment, idx, j) as texts j of about ``PIECE`` bytes a piece, in the order of idx, dealt by hash if they are several; the first has the smallest idx."""
    sizes = rows.groupBy("experiment").agg(F.sum(F.octet_length("j")).alias("bytes"), F.count("*").alias("rows"), F.min("idx").alias("first"))
    sizes = sizes.select("experiment", "first", F.least("rows", F.ceil(F.col("bytes") / PIECE)).alias("pieces"))
    dealt = rows.join(F.broadcast(sizes), "experiment")  # a row for each experiment, as the commit has one for each file
    at = F.when(F.col("idx").eqNullSafe(F.col("first")) | (F.col("pieces") <= 1), 0).otherwise(F.pmod(F.xxhash64("idx", F.lit(0)), "pieces"))
    listed = dealt.withColumn("at", at).groupBy("experiment", "at").agg(F.sort_array(F.collect_list(F.struct("idx", "j"))).alias("all"))
    suffix = F.when(F.col("at") == 0, "").otherwise(F.format_string("-%05d", "at"))
    return listed.select("experiment", suffix.alias("suffix"), F.array_join("all.j", ", ").alias("js"), F.size("all").alias("n"))


def study_files(metadata: DataFrame | None = None, results: DataFrame | None = None, predictions: DataFrame | None = None, questions: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """(experiment, file, content) of the parts that are given, each with a column ``experiment``: one row an experiment for metadata, results and states, one a
    question for predictions (with idx) and questions. Predictions of an idx twice are kept once, that with the larger text. Metadata without a timestamp get the current one."""
    out = None
    given = {"metadata": metadata, "results": results, "state": states}
    for part, rows in given.items():
        if rows is not None:
            if part == "metadata":
                now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
                rows = rows.withColumn("timestamp", F.coalesce("timestamp", now) if "timestamp" in rows.columns else now)
            own = _json(rows, part, F.to_json(F.struct(*(c for c in rows.columns if c != "experiment"))))
            out = own if out is None else out.unionByName(own)
    if predictions is not None:
        whole = F.struct(*(c for c in predictions.columns if c != "experiment"))
        first = predictions.groupBy("experiment", "idx").agg(F.max_by(whole, F.to_json(whole)).alias("p"))
        own = _pieces(first.select("experiment", "idx", F.to_json("p").alias("j")))
        own = own.select("experiment", F.concat(F.lit("predictions"), "suffix").alias("file"), F.concat(F.lit('{"predictions": ['), "js", F.lit("]}")).alias("content"))
        out = own if out is None else out.unionByName(own)
    if questions is not None:
        whole = F.struct(*(c for c in questions.columns if c != "experiment"))
        own = _pieces(questions.select("experiment", "idx", F.to_json(whole).alias("j")))
        name = F.to_json(F.struct("experiment")).substr(F.lit(2), F.length(F.to_json(F.struct("experiment"))) - 2)
        content = F.concat(F.lit("{"), name, F.lit(', "questions": ['), "js", F.lit('], "count": '), F.col("n").cast("string"), F.lit("}"))
        own = own.select("experiment", F.concat(F.lit("questions"), "suffix").alias("file"), content.alias("content"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no part is given")
    return out


def write_study(path: str, mode: str = "append", **parts: DataFrame) -> None:
    """Writes the parts of experiments (as of ``study_files``) into their folders under path, whole or not at all."""
    write_files(study_files(**parts), path, mode)


def write_files(rows: DataFrame, path: str, mode: str = "append", checked: bool = True) -> None:
    """Writes files (experiment, file, content) under path, ``HANDED`` at a time: Spark hands Python 10,000 rows at once, which are files here."""
    spark, name = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    register(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, HANDED)
    try:
        rows.write.format("experiments").option("checked", checked).mode(mode).save(path)
    finally:
        spark.conf.set(name, before)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, idx) of the predictions that are there."""
    rows = read_part(spark, path, "predictions", "predictions array<struct<idx:bigint>>")
    return rows.select("experiment", F.posexplode("predictions").alias("at", "p")).select("experiment", F.coalesce("p.idx", F.col("at").cast("long")).alias("idx"))
