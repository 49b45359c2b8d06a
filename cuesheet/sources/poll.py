"""A streaming source that polls a table of playback events at a rate.

The original asks its player for the position every half second.  ``PlaybackPoll``
is a Python data source for ``spark.readStream.format("playback_poll")``: it
plays a folder of Parquet files back, ``rows_per_second`` events since
``start_ms`` (all that are there, without a rate).  An offset is a number of
rows in the order of the files' names, so it needs nothing but the clock and
the files' footers: a restart goes on behind the last committed batch, a batch
that failed is read again with the same rows, and none is lost or read twice.
New files are found at the next poll; their names must sort behind those of files
that were read already.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from cuesheet.sinks.named import open_folder

POLL_SCHEMA = "session long, ts timestamp, event_id long, episode string, position double, event_type int"
SLICE_ROWS = 1 << 16


@dataclass
class Slice(InputPartition):
    """Rows ``first`` to ``last`` (exclusive) of one file."""

    file: str
    first: int
    last: int


class PollReader(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], rows_per_second: float, start_ms: int, slice_rows: int = SLICE_ROWS):
        self.path, self.columns, self.slice_rows = path, columns, slice_rows
        self.rows_per_second, self.start_ms = rows_per_second, start_ms
        self.sizes: dict[str, int] = {}

    def files(self) -> list[tuple[str, int]]:
        """Files in the order of their names, with their rows (from the footers, each read once)."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, folder = open_folder(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        names = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        for name in names:
            if name not in self.sizes:
                self.sizes[name] = pq.read_metadata(name, filesystem=store).num_rows
        return [(name, self.sizes[name]) for name in names]

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        there = sum(n for _, n in self.files())
        if self.rows_per_second > 0:
            there = min(there, max(0, int((time.time() * 1000 - self.start_ms) * self.rows_per_second / 1000)))
        return {"rows": there}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out, before = [], 0
        for name, n in self.files():
            first, last = max(start["rows"] - before, 0), min(end["rows"] - before, n)
            out += [Slice(name, a, min(a + self.slice_rows, last)) for a in range(first, last, self.slice_rows)]
            before += n
        return out

    def read(self, partition: Slice) -> Iterator:
        import pyarrow.parquet as pq

        store, _ = open_folder(self.path)
        with pq.ParquetFile(partition.file, filesystem=store) as f:
            row = 0
            for group in range(f.num_row_groups):
                size = f.metadata.row_group(group).num_rows
                if row + size > partition.first and row < partition.last:
                    part = f.read_row_group(group, columns=self.columns).select(self.columns)
                    a, b = max(partition.first - row, 0), min(partition.last - row, size)
                    yield from part.slice(a, b - a).to_batches()
                row += size

    def commit(self, end: dict) -> None:
        pass


class PlaybackPoll(DataSource):
    """``spark.readStream.format("playback_poll")``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "playback_poll"

    def schema(self) -> str:
        return POLL_SCHEMA

    def streamReader(self, schema: StructType) -> PollReader:
        rate, start = float(self.options.get("rows_per_second", "0")), int(self.options.get("start_ms", "0"))
        return PollReader(self.options["path"], schema.names, rate, start)


def poll_events(spark: SparkSession, path: str, rows_per_second: float = 0, start_ms: int = 0) -> DataFrame:
    """A stream of the events under ``path``, by the clock from ``start_ms`` on (a caller keeps that over restarts)."""
    spark.dataSource.register(PlaybackPoll)
    options = {"path": path, "rows_per_second": str(rows_per_second), "start_ms": str(start_ms)}
    return spark.readStream.format("playback_poll").options(**options).load()
