"""Files in a folder that all machines see, for the Python data sources: listing, streams, and a commit in one step.

A writing task makes files under temporary names in a folder whose name begins with an underscore, and tells the
driver their names; on commit the driver moves those of the tasks that succeeded to their places and replaces the
folder's manifest, which lists what belongs to the table. Readers take the manifest's files (all files with the
right ending, where there is no manifest), so what a lost task or an aborted job has left is never read.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_manifest.json"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it; schemes are those that Arrow opens (file, hdfs, s3, gs, abfs)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    try:
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    except Exception as e:
        raise ValueError(f"no file system for {path}: {e}") from e


def listed(path: str, endings: tuple[str, ...]) -> list[str]:
    """The files of a table: one file, a folder's manifest, or what has one of the endings and no leading underscore.

    The last part of a path may hold * and ?.
    """
    files, root = located(path)
    head, _, last = root.rpartition("/")
    if any(c in last for c in "*?"):
        return sorted(x.path for x in files.get_file_info(fs.FileSelector(head)) if fnmatch(x.base_name, last))
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if (named := manifest(files, root)) is not None:
        return [f"{root}/{n}" for n in named]
    return sorted(x.path for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.lower().endswith(endings) and x.base_name[0] not in "_.")


def sizes(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """The files of a table and their bytes, by one listing of their folder."""
    files, _ = located(path)
    names = listed(path, endings)
    known = {x.path: x.size for x in files.get_file_info(fs.FileSelector(names[0].rpartition("/")[0]))} if len(names) > 1 else {}
    return [(n, known.get(n) or files.get_file_info(n).size or 0) for n in names]


def manifest(files: fs.FileSystem, root: str) -> list[str] | None:
    if files.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return None
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    """A task's files: temporary name and final name."""

    names: list[tuple[str, str]] = field(default_factory=list)


class Job:
    """One write into a folder."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.id = path, overwrite, uuid.uuid4().hex[:12]

    @property
    def temporary(self) -> str:
        return f"{located(self.path)[1]}/_temporary-{self.id}"

    def task_name(self, ending: str) -> str:
        """A name that no other attempt at the same task has."""
        task = TaskContext.get()
        return f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex[:12]}{ending}"

    def stream(self, name: str):
        files, _ = located(self.path)
        files.create_dir(self.temporary)
        return files.open_output_stream(f"{self.temporary}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        files, root = located(self.path)
        files.create_dir(root)
        before = manifest(files, root) or []
        names, taken = [], set(before)
        for m in messages:
            for made, name in m.names if m else []:
                if name in taken:  # appended tables keep both
                    stem, dot, ending = name.rpartition(".")
                    name = f"{stem}-{self.id}{dot}{ending}"
                files.move(f"{self.temporary}/{made}", f"{root}/{name}")
                names.append(name)
                taken.add(name)
        with files.open_output_stream(f"{root}/_{self.id}.json") as f:
            f.write(json.dumps(names if self.overwrite else before + names).encode())
        files.move(f"{root}/_{self.id}.json", f"{root}/{MANIFEST}")
        for name in before if self.overwrite else []:
            if files.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                files.delete_file(f"{root}/{name}")
        self.abort()

    def abort(self) -> None:
        files, _ = located(self.path)
        if files.get_file_info(self.temporary).type == fs.FileType.Directory:
            files.delete_dir(self.temporary)


_own: set[str] = set()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which all machines see; a local session may do without, in its temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "docloom-files", spark.sparkContext.applicationId)
        if top not in _own:
            _own.add(top)
            atexit.register(shutil.rmtree, top, True)
        base = f"file://{top}"
    return f"{base.rstrip('/')}/docloom-files/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to a new folder and read again; the shuffle files of the writing go when it ends."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
