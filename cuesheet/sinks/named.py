"""A sink that writes one file per row under exactly the row's name.

Spark's own writers name their files ``part-*``.  ``NamedFiles`` is a Python
data source for ``df.write.format("named_files")``: rows of (name, text) become
files ``<path>/<name>``, and with ``overwrite`` files of the folder that the
write doesn't bring go.  Tasks write into a staging folder under names of their
own attempt; only the commit on the driver, from the messages of the attempts
that Spark chose, renames them, so a retried or lost task leaves nothing behind
and readers see whole files only.  The folder may be any that pyarrow opens by
its URI and that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def open_folder(path: str):
    """(file system, path in it) of a plain path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """Staged file by final name."""

    files: dict[str, str] = field(default_factory=dict)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, folder = open_folder(self.staging)
        store.create_dir(folder, recursive=True)
        out = Written()
        for row in iterator:
            name, text = row[0], row[1]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {name!r}")
            if name in out.files:
                raise ValueError(f"two rows are named {name!r}")
            own = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write((text or "").encode("utf-8"))
            out.files[name] = own
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = open_folder(self.path)
        store.create_dir(folder, recursive=True)
        names: dict[str, str] = {}
        for m in messages:
            for name, own in (m.files if m else {}).items():
                if name in names:
                    self.abort(messages)
                    raise ValueError(f"two rows are named {name!r}")
                names[name] = own
        old = [] if not self.overwrite else [f for f in store.get_file_info(_children(folder)) if f.is_file and not f.base_name.startswith(("_", "."))]
        for name, own in names.items():
            store.move(own, f"{folder}/{name}")
        for f in old:
            if f.base_name not in names:
                store.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Drops what is staged; final files stay as they are."""
        store, folder = open_folder(self.staging)
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


def _children(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


class NamedFiles(DataSource):
    """``df.write.format("named_files")``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(files: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write rows (name, text), one file each.  Two rows of one name are an error."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(NamedFiles)
    files.select("name", "text").write.format("named_files").mode("overwrite" if overwrite else "append").option("path", path).save()
