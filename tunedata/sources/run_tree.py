"""Run trees as a data source: ``spark.read.format("run_tree")``, ``spark.readStream.format("run_tree")`` and ``df.write.format("run_tree")``.

A tree is ``<path>/run_*/<files>`` (or ``run_dir=run_*``, as a partitioned writer names folders). Planning lists the
run folders only; each task lists and opens the files of its own share of runs. The option ``runs`` narrows the
listing, so a query for one run opens only that run's files. It is an option and not a pushed filter on purpose: in
this version of Spark the filters that a Python source takes stay with the DataFrame, and a later query over it
without filters would read too little. Files are opened with pyarrow's file systems (local, hdfs, s3, gs); a store
that only Spark can open takes the scans in ``sources.runs``."""

from __future__ import annotations

import fnmatch
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "run_dir string, path string, line_no bigint, value string"
RUNS_PER_TASK = 64
#: Rows of one Arrow batch of lines.
BATCH_LINES = 10_000


def open_store(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _run_name(folder: str) -> str:
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return name[len("run_dir="):] if name.startswith("run_dir=") else name


def list_runs(root: str, runs: str = "*") -> list[str]:
    """Paths of the run folders whose names match one of the comma-separated patterns, in order; a missing root has none."""
    from pyarrow import fs

    store, path = open_store(root)
    found = store.get_file_info(fs.FileSelector(path.rstrip("/"), allow_not_found=True))
    named = [(f.path, _run_name(f.path)) for f in found if f.type == fs.FileType.Directory]
    return sorted(path for path, run in named if run.startswith("run_") and any(fnmatch.fnmatchcase(run, p.strip()) for p in runs.split(",")))


def list_files(root: str, folder: str, pattern: str) -> list[tuple[str, int]]:
    """``(path, changed at, in ns)`` of a run's files whose names match one of the comma-separated patterns."""
    from pyarrow import fs

    store, _ = open_store(root)
    names = [p.strip() for p in pattern.split(",")]
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.path, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and any(fnmatch.fnmatch(f.base_name, n) for n in names))


@dataclass
class RunShare(InputPartition):
    """Run folders of one task and the times between which their files changed (streams)."""

    folders: list[str]
    after: int = -1
    upto: int = -1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["run_dir", "path", "line_no", "value"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), pa.int64(), pa.string()])], names=names)


def read_share(root: str, files: str, lines: bool, share: RunShare) -> Iterator[pa.RecordBatch]:
    """The files of a share: one row per line, or per file with line 0. Broken bytes come as the replacement character."""
    store, _ = open_store(root)
    rows: list[tuple] = []
    for folder in share.folders:
        for path, changed in list_files(root, folder, files):
            if share.upto >= 0 and not share.after < changed <= share.upto:
                continue
            with store.open_input_stream(path) as stream:
                if lines:
                    import io

                    for k, line in enumerate(io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", errors="replace", newline="\n")):
                        rows.append((_run_name(folder), path, k, line.rstrip("\n").rstrip("\r")))
                        if len(rows) >= BATCH_LINES:
                            yield _batch(rows)
                            rows = []
                else:
                    rows.append((_run_name(folder), path, 0, stream.read().decode("utf-8", "replace")))
        if len(rows) >= BATCH_LINES:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


class RunTreeSource(DataSource):
    """Options: ``path``; ``runs``, comma-separated patterns of run names; ``files``, comma-separated name patterns (default all configs and evaluations);
    ``lines``, true for one row per line; ``runsPerTask``; for streams ``settleMs``, how long a file must be unchanged."""

    @classmethod
    def name(cls) -> str:
        return "run_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RunTreeReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RunTreeStreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RunTreeWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


class _Options:
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"]
        self.runs = options.get("runs", "*")
        self.files = options.get("files", "run_config.json,eval_*.json")
        self.lines = options.get("lines", "false").lower() == "true"
        self.per_task = int(options.get("runspertask", RUNS_PER_TASK))
        self.settle_ms = int(options.get("settlems", 1000))

    def shares(self, folders: list[str], after: int = -1, upto: int = -1) -> list[RunShare]:
        return [RunShare(folders[i:i + self.per_task], after, upto) for i in range(0, len(folders), self.per_task)]


class RunTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = _Options(options)

    def partitions(self) -> list[RunShare]:
        return self.o.shares(list_runs(self.o.root, self.o.runs)) or [RunShare([])]

    def read(self, partition: RunShare) -> Iterator[pa.RecordBatch]:
        yield from read_share(self.o.root, self.o.files, self.o.lines, partition)


class RunTreeStreamReader(DataSourceStreamReader):
    """New and changed files since the last micro-batch. The offset is a time of change: files are taken once they
    have not changed for ``settleMs``, so that none with the same time comes later."""

    def __init__(self, options: dict[str, str]):
        self.o = _Options(options)

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - self.o.settle_ms * 1_000_000
        times = [t for folder in list_runs(self.o.root, self.o.runs) for _, t in list_files(self.o.root, folder, self.o.files) if t <= settled]
        return {"upto": max(times, default=-1)}

    def partitions(self, start: dict, end: dict) -> list[RunShare]:
        if end["upto"] <= start["upto"]:
            return [RunShare([])]
        return self.o.shares(list_runs(self.o.root, self.o.runs), start["upto"], end["upto"]) or [RunShare([])]

    def read(self, partition: RunShare) -> Iterator[pa.RecordBatch]:
        yield from read_share(self.o.root, self.o.files, self.o.lines, partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: the offset is all there is."""


class RunTreeWriter(DataSourceArrowWriter):
    """Rows ``run_dir, value``, sorted by run within a partition, as ``run_dir=<name>/part-<partition>-<write><suffix>``, one line
    per row. A task holds one open file; a task that runs again writes the same names anew, and none appear under other names."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("run trees are appended to")
        self.root, self.suffix, self.write_id = options["path"], options.get("suffix", ".txt"), uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = open_store(self.root)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.write_id}{self.suffix}"
        run, out, seen = None, None, set()
        for batch in iterator:
            for folder, value in zip(batch.column("run_dir").to_pylist(), batch.column("value").to_pylist()):
                folder = "__HIVE_DEFAULT_PARTITION__" if folder is None else folder.replace("/", "%2F")
                if folder != run:
                    if out is not None:
                        out.close()
                    if folder in seen:
                        raise ValueError(f"the rows of {folder} are not together")
                    seen.add(folder)
                    store.create_dir(f"{root.rstrip('/')}/run_dir={folder}", recursive=True)
                    run, out = folder, store.open_output_stream(f"{root.rstrip('/')}/run_dir={folder}/{name}")
                out.write(((value or "") + "\n").encode())
        if out is not None:
            out.close()
        return WriterCommitMessage()


def _options(spark: SparkSession, root: str, files: str, lines: bool, runs: str) -> dict[str, str]:
    spark.dataSource.register(RunTreeSource)
    return {"path": root, "files": files, "lines": str(lines).lower(), "runs": runs}


def read_tree(spark: SparkSession, root: str, files: str = "run_config.json,eval_*.json", lines: bool = False, runs: str = "*") -> DataFrame:
    """``run_dir, path, line_no, value`` of a run tree."""
    return spark.read.format("run_tree").options(**_options(spark, root, files, lines, runs)).load()


def stream_tree(spark: SparkSession, root: str, files: str = "run_config.json,eval_*.json", lines: bool = False, runs: str = "*",
                settle_ms: int = 1000) -> DataFrame:
    """The same as a stream: files of new runs, and files written anew, as they appear."""
    return spark.readStream.format("run_tree").options(**_options(spark, root, files, lines, runs), settleMs=str(settle_ms)).load()


def write_tree(rows: DataFrame, root: str, suffix: str = ".txt", mode: str = "append") -> None:
    """``run_dir, value`` rows, those of a run together in a partition, as files of a run tree."""
    rows.sparkSession.dataSource.register(RunTreeSource)
    rows.write.format("run_tree").mode(mode).option("path", root).option("suffix", suffix).save()
