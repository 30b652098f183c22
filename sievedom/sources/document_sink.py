"""A sink of one file a document, for batches and streams, that shows a job's files all at once or not at all.

    register_sources(spark)
    by_id(clean, "page_id").write.format("html_files").mode("overwrite").save("out")

A task writes to a folder of its own below ``_staging``, whose name no other try
of it has.  The driver learns folders and counts, never documents: at the commit
it moves the folder of each task's one successful try into place, then deletes
what failed and repeated tries left.  The folder has to allow moves (local disks
and HDFS do, object stores do not).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .folders import located

DONE = "_SUCCESS"
#: Bytes of an encoded id in a file's name; longer ones are cut and told apart by a digest.
MAX_NAME = 120


@dataclass
class Written(WriterCommitMessage):
    job: str
    folder: str
    files: int
    nulls: int


def file_name(doc_id: object) -> str:
    """A name for an id that no other id has, for every file system: percent-encoded, long ones ended by a digest."""
    name = "null" if doc_id is None else "id-" + quote(str(doc_id), safe="").replace(".", "%2E").replace("~", "%7E")
    return name if len(name) <= MAX_NAME else f"{name[:MAX_NAME]}~{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}"


def by_id(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id and html, each id's rows in one task and in a fixed order, so that repeated ids get numbers and not one file."""
    return df.selectExpr(f"`{id_col}` as id", f"`{html_col}` as html").repartition("id").sortWithinPartitions("id", "html")


class _Staged:
    def __init__(self, options: dict, schema: StructType, overwrite: bool = False):
        if schema.names != ["id", "html"]:
            raise ValueError(f"the columns are id and html, not {schema.names}")
        self.path, self.suffix, self.overwrite, self.job = options["path"], options.get("suffix", ".html"), overwrite, uuid.uuid4().hex

    def _at(self, *names: str) -> tuple[fs.FileSystem, str]:
        system, path = located(self.path)
        return system, "/".join([path, *names])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._at("_staging", self.job, uuid.uuid4().hex)
        system.create_dir(folder, recursive=True)
        files = nulls = repeats = 0
        last = None
        for b in iterator:
            for d, h in zip(b.column(0), b.column(1), strict=True):
                if not h.is_valid:
                    nulls += 1
                    continue
                name = file_name(d.as_py())
                repeats = repeats + 1 if name == last else 0
                last = name
                with system.open_output_stream(f"{folder}/{name}{f'~{repeats}' if repeats else ''}{self.suffix}") as f:
                    f.write(h.as_py().encode("utf-8", "surrogatepass"))
                files += 1
        return Written(self.job, folder.rsplit("/", 1)[1], files, nulls)

    def _drop(self, *names: str) -> None:
        system, folder = self._at(*names)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)

    def _place(self, messages: list, *into: str) -> None:
        """Moves the folders of tasks that wrote something, and deletes the job's staging with all that is left in it.

        A stream's commits have a writer of their own, so the job is that of the messages.
        """
        system, top = self._at(*into)
        system.create_dir(top, recursive=True)
        for m in messages:
            if m is not None and m.files:
                system.move(self._at("_staging", m.job, m.folder)[1], f"{top}/part-{m.folder}")
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        for job in {self.job, *(m.job for m in messages if m is not None)}:
            self._drop("_staging", job)

    def _tell(self, messages: list, *into: str) -> None:
        system, done = self._at(*into, DONE)
        some = [m for m in messages if m is not None]
        with system.open_output_stream(done) as f:
            f.write(json.dumps({"files": sum(m.files for m in some), "nulls": sum(m.nulls for m in some)}).encode())


class BatchWriter(_Staged, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        system, top = self._at()
        system.create_dir(top, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(top)) if i.base_name.startswith(("part-", "batch-"))] if self.overwrite else []
        self._place(messages)
        for path in old:  # names of parts never meet, so the older ones go last
            system.delete_dir(path)
        self._tell(messages)

    def abort(self, messages: list) -> None:
        self._clear(messages)


class StreamWriter(_Staged, DataSourceStreamArrowWriter):
    """Each batch has a folder of its own; one that is there already is not written again, as when a batch is run anew."""

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        system, done = self._at(f"batch-{batchId}", DONE)
        if system.get_file_info(done).type == fs.FileType.File:
            self._clear(messages)
            return
        self._drop(f"batch-{batchId}")  # of a commit that ended half way
        self._place(messages, f"batch-{batchId}")
        self._tell(messages, f"batch-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._clear(messages)


class DocumentSink(DataSource):
    """Options: path, suffix (.html).  Rows have id and html; a null html gives no file and is counted in ``_SUCCESS``."""

    @classmethod
    def name(cls) -> str:
        return "html_files"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options, schema, overwrite)
