"""GeoPackage scan as a Python data source: one task per range of row ids."""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BadRequest
from .files import locate, matching, read_range

ROWS_PER_TASK = 100_000
# Bytes of the envelope by its code in the blob header.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _open(path: str):
    """Read-only connection; a file that is not local is read into memory of the task."""
    system, inner = locate(path)
    if system.type_name == "local":
        return sqlite3.connect(f"file:{inner}?mode=ro", uri=True)
    db = sqlite3.connect(":memory:")
    db.deserialize(read_range(path, 0, None))
    return db


def strip_header(blob):
    """WKB of a GeoPackage geometry blob."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        return bytes(blob)
    return bytes(blob[8 + ENVELOPE_BYTES.get((blob[3] >> 1) & 7, 0):])


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str) -> str:
    kind = (declared or "").upper()
    if kind.startswith("BOOL"):
        return "boolean"
    if "INT" in kind:
        return "bigint"
    if any(k in kind for k in ("REAL", "DOUBLE", "FLOAT", "NUMERIC", "DECIMAL")):
        return "double"
    return "binary" if "BLOB" in kind else "string"


class GeoPackage(DataSource):
    """``format("geopackage")``: options ``path`` and, for several layers, ``layer``."""

    @classmethod
    def name(cls):
        return "geopackage"

    def layout(self):
        path = matching(self.options["path"], (".gpkg",))[0]
        with closing(_open(path)) as db:
            layers = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns "
                                "ORDER BY table_name").fetchall()
            wanted = self.options.get("layer")
            chosen = [row for row in layers if wanted in (None, row[0])]
            if not chosen:
                raise BadRequest("No feature layer in GeoPackage")
            table, geom, srid = chosen[0]
            columns = [(r[1], r[2], r[5]) for r in db.execute(f"PRAGMA table_info({_quote(table)})")]
        return table, geom, srid, columns

    def schema(self):
        _, geom, _, columns = self.layout()
        names = [f"`{n}` {_spark_type(t)}" for n, t, _ in columns if n != geom]
        return ", ".join([*names, f"`{geom}` binary"])

    def reader(self, schema):
        table, geom, _, columns = self.layout()
        names = [n for n, _, _ in columns if n != geom]
        booleans = {i for i, n in enumerate(names) if schema[n].dataType.typeName() == "boolean"}
        texts = {i for i, n in enumerate(names) if schema[n].dataType.typeName() == "string"}
        return _Reader(matching(self.options["path"], (".gpkg",)), table, geom, names, booleans, texts)


class _Range(InputPartition):
    def __init__(self, path, low, high):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, paths, table, geom, names, booleans, texts):
        self.paths, self.table, self.geom, self.names = paths, table, geom, names
        self.booleans, self.texts = booleans, texts

    def partitions(self):
        out = []
        for path in self.paths:
            with closing(_open(path)) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.table)}").fetchone()
            if low is not None:
                out += [_Range(path, at, at + ROWS_PER_TASK) for at in range(low, high + 1, ROWS_PER_TASK)]
        return out or [_Range(self.paths[0], 0, 0)]

    def read(self, partition):
        columns = ", ".join(_quote(n) for n in [*self.names, self.geom])
        with closing(_open(partition.path)) as db:
            rows = db.execute(f"SELECT {columns} FROM {_quote(self.table)} WHERE rowid >= ? AND rowid < ? "
                              "ORDER BY rowid", (partition.low, partition.high))
            for row in rows:
                values = list(row)
                for i in self.booleans:
                    values[i] = None if values[i] is None else bool(values[i])
                for i in self.texts:
                    values[i] = None if values[i] is None else str(values[i])
                values[-1] = strip_header(values[-1])
                yield tuple(values)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("geopackage").option("path", path)
    return (reader.option("layer", layer) if layer else reader).load()


def declared_srid(path: str, layer: str | None = None) -> int | None:
    options = {"path": path, **({"layer": layer} if layer else {})}
    srid = GeoPackage(options).layout()[2]
    return srid if srid and srid > 0 else None
