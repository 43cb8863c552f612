"""A streaming source of change logs, `changelog`: whole transactions by commit position.

The log is a folder of Parquet files (schema tideline.streaming.cdc.CHANGES) on any file system that Arrow can open by
its URI (local, hdfs, s3, gs). Files are listed, and each is read for its positions once: a file's lowest and highest
commit are kept beside its name, so a trigger costs a listing and the new files' position columns. The source's offset is a
commit position; a batch ends between transactions, so a micro-batch never holds part of one. Files are handed to
partitions whole, and only those whose positions meet the batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tideline.streaming.cdc import CHANGES, format_lsn, parse_lsn


class _Files(InputPartition):
    def __init__(self, names: list[str], after: int, upto: int):
        super().__init__(json.dumps([names, after, upto]))
        self.names, self.after, self.upto = names, after, upto


class ChangeLogSource(DataSource):
    """Options: path (a folder that all executors see), startingLsn (only later commits are read), partitions, and
    acknowledged (a file that gets the position of each batch that the stream has finished)."""

    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _numbers(column):
    """Positions of an Arrow column of `X/Y` texts, by its different values."""
    import numpy as np

    encoded = column.dictionary_encode()
    return np.array([parse_lsn(x) for x in encoded.dictionary.to_pylist()], np.uint64)[encoded.indices.to_numpy(zero_copy_only=False)]


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.first = parse_lsn(options.get("startingLsn", "") or "")
        self.parts = int(options.get("partitions", "4"))
        self.acknowledged = options.get("acknowledged")
        self.spans: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"lsn": format_lsn(self.first)}

    def _list(self) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, folder = _opened(self.path)
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(".parquet") and info.path not in self.spans and not info.base_name.startswith(("_", ".")):
                with system.open_input_file(info.path) as file:
                    low, high = 1 << 64, 0
                    for batch in pq.ParquetFile(file).iter_batches(columns=["commit_lsn"]):
                        if batch.num_rows:
                            found = _numbers(batch.column(0))
                            low, high = min(low, int(found.min())), max(high, int(found.max()))
                self.spans[info.path] = low, high

    def latestOffset(self) -> dict:
        self._list()
        return {"lsn": format_lsn(max([self.first, *(high for _, high in self.spans.values())]))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not self.spans:
            self._list()
        a, b = parse_lsn(start["lsn"]), parse_lsn(end["lsn"])
        names = sorted(n for n, (low, high) in self.spans.items() if low <= b and high > a)
        return [_Files(names[k :: self.parts], a, b) for k in range(min(self.parts, len(names)))]

    def read(self, partition: _Files) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, _ = _opened(self.path)
        names = [c.split()[0] for c in CHANGES.split(", ")]
        at = names.index("commit_time")  # Spark's own files may hold nanoseconds
        for name in partition.names:
            with system.open_input_file(name) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=names):
                    batch = batch.select(names)
                    lsn = _numbers(batch.column(0))
                    some = batch.filter(pa.array((lsn > partition.after) & (lsn <= partition.upto)))
                    if some.num_rows:
                        yield some.set_column(at, "commit_time", some.column(at).cast(pa.timestamp("us", "UTC")))

    def commit(self, end: dict) -> None:
        """The stream has finished all up to `end`: it is written down, for whoever owns the log's slot."""
        if self.acknowledged:
            system, path = _opened(self.acknowledged)
            with system.open_output_stream(path) as file:
                file.write(end["lsn"].encode())
