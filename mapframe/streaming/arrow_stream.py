"""Arrow IPC streams: one stream for a bounded page, one file per task at any size."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import from_arrow_schema

from ..sources.files import locate, matching

# The extension name of WKB columns and the rows of one batch.
EXTENSION = {b"ARROW:extension:name": b"geoarrow.wkb"}
BATCH_ROWS = 5000


def annotate(schema: pa.Schema) -> pa.Schema:
    """Mark the ``geometry`` field as WKB."""
    return pa.schema([f.with_metadata({**(f.metadata or {}), **EXTENSION}) if f.name == "geometry" else f
                      for f in schema], metadata=schema.metadata)


def to_arrow_ipc(page: DataFrame) -> bytes:
    """One IPC stream of a bounded page; an empty page is a stream without rows."""
    table = page.toArrow()
    table = table.cast(annotate(table.schema))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=BATCH_ROWS)
    return sink.getvalue().to_pybytes()


class ArrowStream(DataSource):
    """``format("arrowstream")``: a directory of ``.arrows`` files."""

    @classmethod
    def name(cls):
        return "arrowstream"

    def files(self):
        return matching(self.options["path"], (".arrow", ".arrows"))

    def schema(self):
        system, inner = locate(self.files()[0])
        with system.open_input_stream(inner) as f:
            return from_arrow_schema(pa.ipc.open_stream(f).schema)

    def reader(self, schema):
        return _Reader(self.files())

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


class _File(InputPartition):
    def __init__(self, path):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        system, inner = locate(partition.path)
        with system.open_input_stream(inner) as f:
            for batch in pa.ipc.open_stream(f):
                yield batch.replace_schema_metadata(None)


class _Written(WriterCommitMessage):
    def __init__(self, name):
        self.name = name


class _Writer(DataSourceArrowWriter):
    """Tasks write under ``_pending``; only a finished job moves files into view."""

    def __init__(self, path, overwrite):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, inner = locate(self.path)
        name = f"part-{uuid.uuid4().hex}.arrows"
        pending = f"{inner}/_pending-{self.job}"
        system.create_dir(pending, recursive=True)
        writer = None
        with system.open_output_stream(f"{pending}/{name}") as out:
            for batch in iterator:
                if writer is None:
                    schema = annotate(batch.schema)
                    writer = pa.ipc.new_stream(out, schema)
                table = pa.Table.from_batches([batch]).cast(schema)
                writer.write_table(table, max_chunksize=BATCH_ROWS)
            if writer is not None:
                writer.close()
        if writer is None:
            system.delete_file(f"{pending}/{name}")
            return _Written(None)
        return _Written(name)

    def commit(self, messages):
        system, inner = locate(self.path)
        old = [] if not self.overwrite else [
            i.path for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            if i.is_file and i.path.endswith((".arrow", ".arrows"))]
        for message in messages:
            if message is not None and message.name:
                system.move(f"{inner}/_pending-{self.job}/{message.name}", f"{inner}/{message.name}")
        for path in old:
            system.delete_file(path)
        self._clean(system, inner)

    def abort(self, messages):
        self._clean(*locate(self.path))

    def _clean(self, system, inner):
        pending = f"{inner}/_pending-{self.job}"
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


def write_arrow(df: DataFrame, path: str, mode: str = "append") -> None:
    """One IPC stream file per task; ``overwrite`` replaces what was there."""
    df.sparkSession.dataSource.register(ArrowStream)
    df.write.format("arrowstream").option("path", path).mode(mode).save()


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowStream)
    return spark.read.format("arrowstream").option("path", path).load()
