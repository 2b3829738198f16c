"""CSV members of ZIP archives as a data source: one partition for each member.

The driver reads the central directories alone. A task opens its archive at the place of its member and streams it, so
neither an archive nor a member is held whole, and the members of one large archive spread over the cluster.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CHUNK_ROWS = 20_000


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (a plain path is local) and the path on it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[str]:
    """Files of a folder, or those that a pattern in the last part of the path matches, in order of their names."""
    system, place = filesystem(path)
    folder, pattern = (place, "*.zip") if system.get_file_info(place).type == fs.FileType.Directory else posixpath.split(place)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))


class Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class ZippedCsvReader(DataSourceReader):
    def __init__(self, path: str, members: str, names: list[str]):
        self.path, self.members, self.names = path, members, names

    def partitions(self) -> list[Member]:
        system, _ = filesystem(self.path)
        found = []
        for archive in listed(self.path):
            with system.open_input_file(archive) as handle, zipfile.ZipFile(handle) as zipped:
                inside = [i for i in zipped.infolist() if fnmatch.fnmatch(i.filename.lower(), self.members) and not i.is_dir()]
                found += [(i.file_size, archive, i.filename) for i in inside]
        # the longest first; no member at all still needs a partition
        return [Member(archive, name) for _, archive, name in sorted(found, reverse=True)] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, _ = filesystem(self.path)
        schema = pa.schema([(n, pa.string()) for n in self.names])
        with system.open_input_file(partition.archive) as handle, zipfile.ZipFile(handle) as zipped, zipped.open(partition.member) as content:
            if not content.peek(1):
                return
            wanted = set(self.names)
            for part in pd.read_csv(content, dtype=str, chunksize=CHUNK_ROWS, keep_default_na=False, na_values=[""], usecols=lambda c: c in wanted):
                yield pa.RecordBatch.from_pandas(part.reindex(columns=self.names).astype(object).where(lambda p: p.notna(), None), schema, preserve_index=False)


class ZippedCsv(DataSource):
    """Options: ``path`` (a folder or a pattern) and ``members`` (a pattern of names, ``*.csv`` unless given). All columns of the
    schema are strings; members may lack some of them and have others."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        raise ValueError("zipped_csv needs a schema")

    def reader(self, schema: StructType) -> ZippedCsvReader:
        return ZippedCsvReader(self.options["path"], self.options.get("members", "*.csv"), schema.names)


def write_zipped_csv(df: DataFrame, path: str, rows_per_member: int = 10_000) -> None:
    """One archive for each partition, with members of at most ``rows_per_member`` rows; a NULL is an empty field.

    An archive appears under its name when it is whole, so tasks may be tried again.
    """
    columns = df.columns

    def write(batches):
        part = TaskContext.get().partitionId()
        system, folder = filesystem(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{part:05d}.zip"
        draft = f"{folder}/.part-{part:05d}-{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zipped:
            number = 0
            for batch in batches:
                for at in range(0, len(batch), rows_per_member):
                    text = io.StringIO()
                    batch.iloc[at : at + rows_per_member].to_csv(text, index=False, columns=columns)
                    zipped.writestr(f"member-{number:05d}.csv", text.getvalue())
                    number += 1
        system.move(draft, name)
        yield pd.DataFrame({"archive": [name]})

    df.mapInPandas(write, "archive string").write.format("noop").mode("overwrite").save()
