"""Sparse matrices by weekday, as a Spark data source: one compressed numpy file each.

    spark.dataSource.register(WeekdayMatrices)
    moves.repartition("weekday").write.format("weekday_matrices").mode("overwrite").save(path)
    spark.read.format("weekday_matrices").load(path)

Tasks write to names of their own; the commit gives the files their names and
lists them in a manifest, which is all that a reader looks at.  So a task that
runs twice, or a job that fails, leaves no matrix.  A weekday is one task: its
rows are the moves that occur, a few million at most.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "weekday string, from_rank int, to_rank int, n long, p double"
MANIFEST = "_manifest.json"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a path."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Weekday and file of each matrix of a task."""

    files: list[tuple[str, str]]


class MatrixWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Written:
        rows: dict[str, list[tuple]] = {}
        for row in iterator:
            rows.setdefault(row["weekday"], []).append((row["from_rank"], row["to_rank"], row["n"], row["p"]))
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        files = []
        for weekday, cells in rows.items():
            cells.sort()
            start, to, n, p = zip(*cells, strict=True)
            data = io.BytesIO()
            np.savez_compressed(data, from_rank=np.array(start, np.int32), to_rank=np.array(to, np.int32), n=np.array(n, np.int64), p=np.array(p, float))
            name = f"_part-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(data.getvalue())
            files.append((weekday, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        found = [f for m in messages if m for f in m.files]
        if len({w for w, _ in found}) < len(found):
            self.abort(messages)
            raise ValueError("a weekday came from two tasks: repartition by weekday first")
        kept = {} if self.overwrite else _manifest(store, folder)
        if again := sorted({w for w, _ in found} & kept.keys()):
            self.abort(messages)
            raise ValueError(f"already there: {', '.join(again)}")
        old = _manifest(store, folder) if self.overwrite else {}
        for weekday, name in found:
            kept[weekday] = f"{weekday}-{name[6:14]}.npz"
            store.move(f"{folder}/{name}", f"{folder}/{kept[weekday]}")
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(kept, sort_keys=True).encode())
        for name in old.values():
            store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        for _, name in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{name}")


def _manifest(store: fs.FileSystem, folder: str) -> dict[str, str]:
    if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return {}
    with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Matrix(InputPartition):
    weekday: str
    name: str


class MatrixReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Matrix]:
        return [Matrix(w, n) for w, n in sorted(_manifest(*store_of(self.path)).items())]

    def read(self, partition: Matrix) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Matrix):  # no matrix at all
            return
        store, folder = store_of(self.path)
        with store.open_input_file(f"{folder}/{partition.name}") as f:
            own = np.load(io.BytesIO(f.read()))
        columns = [own[c] for c in ("from_rank", "to_rank", "n", "p")]
        yield pa.RecordBatch.from_arrays([pa.array([partition.weekday] * len(columns[0])), *map(pa.array, columns)], names=["weekday", "from_rank", "to_rank", "n", "p"])


class WeekdayMatrices(DataSource):
    """Option ``path``: the folder."""

    @classmethod
    def name(cls) -> str:
        return "weekday_matrices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], overwrite)
