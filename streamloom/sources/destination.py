"""A destination that commits or aborts: ``df.write.format("records").mode("append").save(path)``.

Each task writes a file of length-prefixed records below ``path``/_staged; the driver's commit moves the files of the
tasks that succeeded to ``path`` and writes a manifest last, an abort removes what was staged. So a reader of
manifests sees all rows of a write or none, and a task that runs twice counts once. ``reader`` gives the rows back.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], replace: bool):
        self.path, self.names, self.replace, self.job = path, names, replace, uuid.uuid4().hex

    def write(self, rows):
        system, root = filesystem(self.path)
        name = f"{self.job}-{uuid.uuid4().hex}.records"
        system.create_dir(f"{root}/_staged", recursive=True)
        n = 0
        with system.open_output_stream(f"{root}/_staged/{name}") as f:
            for row in rows:
                data = json.dumps(dict(zip(self.names, row)), default=str).encode()
                f.write(len(data).to_bytes(4, "little") + data)
                n += 1
        return Written(name, n)

    def commit(self, messages):
        system, root = filesystem(self.path)
        files = [m for m in messages if m is not None]
        if self.replace:
            for _, manifest in manifests(self.path):
                system.delete_file(manifest)
        for m in files:
            system.move(f"{root}/_staged/{m.file}", f"{root}/{m.file}")
        with system.open_output_stream(f"{root}/{self.job}.manifest") as f:
            f.write(json.dumps({"files": [m.file for m in files], "rows": sum(m.rows for m in files)}).encode())
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*filesystem(self.path))

    def _clear(self, system, root):
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(f"{root}/_staged", allow_not_found=True)):
            if info.base_name.startswith(self.job):
                system.delete_file(info.path)


def manifests(path: str) -> list[tuple[dict, str]]:
    from pyarrow import fs

    system, root = filesystem(path)
    found = []
    for info in sorted(system.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda x: x.path):
        if info.path.endswith(".manifest"):
            with system.open_input_stream(info.path) as f:
                found.append((json.loads(f.read()), info.path))
    return found


class _Part(InputPartition):
    def __init__(self, file: str):
        self.file = file


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        return [_Part(f) for m, _ in manifests(self.path) for f in m["files"]]

    def read(self, partition):
        if partition is None:
            return
        system, root = filesystem(self.path)
        with system.open_input_stream(f"{root}/{partition.file}") as f:
            while head := f.read(4):
                row = json.loads(f.read(int.from_bytes(head, "little")))
                yield tuple(row.get(n) for n in self.names)


class Records(DataSource):
    """Columns of strings, numbers and booleans; a reader names its schema."""

    @classmethod
    def name(cls):
        return "records"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema.fieldNames(), overwrite)

    def reader(self, schema):
        return _Reader(self.options["path"], schema.fieldNames())


def register(spark) -> None:
    spark.dataSource.register(Records)
