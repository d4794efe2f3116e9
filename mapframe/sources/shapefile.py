"""Shapefile scan as a Python data source: one task per range of records.

The index file gives record offsets and attribute records have a fixed width, so
a task reads only its own byte ranges.  Missing sidecars are tolerated: without
attributes only the geometry is returned, without an index the main file is read
by one task.
"""

from __future__ import annotations

import codecs
import re
import struct
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BadRequest
from ..functions import codec
from .files import exists, matching, read_range

RECORDS_PER_TASK = 100_000
SHAPES = (0, 1, 3, 5, 8, 11, 13, 15, 18, 21, 23, 25, 28)  # fixed values: none, points, lines, polygons, multipoints


def _sidecar(path: str, suffix: str) -> str | None:
    for name in (path[:-4] + suffix, path[:-4] + suffix.upper()):
        if exists(name):
            return name
    return None


def _encoding(table: str) -> str:
    """Python's name for the encoding that the ``.cpg`` file next to an attribute file declares; UTF-8 without one."""
    sidecar = _sidecar(table, ".cpg")
    if sidecar is None:
        return "utf-8"
    name = read_range(sidecar, 0, None).decode("ascii", "replace").strip()
    name = re.sub(r"^(ANSI|OEM)?\s*(?=\d)", "cp", name, flags=re.IGNORECASE) if not name.startswith("8859") else f"iso{name}"
    try:
        return codecs.lookup({"cp88591": "latin-1"}.get(name, name)).name
    except LookupError:
        raise BadRequest(f"Unknown encoding of attributes: {name}") from None


class _Table:
    """Header of an attribute file."""

    def __init__(self, path):
        self.path = path
        head = read_range(path, 0, 32)
        self.rows, self.header, self.width = struct.unpack("<IHH", head[4:12])
        self.encoding = _encoding(path)
        raw = read_range(path, 32, self.header - 32)
        self.fields, at = [], 1
        for k in range(0, len(raw) - 31, 32):
            if raw[k] == 0x0D:
                break
            name = raw[k: k + 11].split(b"\0")[0].decode("latin-1").strip()
            kind, size, decimals = chr(raw[k + 11]), raw[k + 16], raw[k + 17]
            self.fields.append((name, kind, at, size, decimals))
            at += size

    def ddl(self):
        types = {"L": "boolean", "D": "date", "F": "double", "O": "double"}
        return [f"`{n}` " + (types.get(k) or ("string" if k != "N" else "bigint" if d == 0 and s <= 18 else "double"))
                for n, k, _, s, d in self.fields]

    def records(self, first, count):
        """Values of each record, None for deleted ones."""
        data = read_range(self.path, self.header + first * self.width, count * self.width)
        for at in range(0, count * self.width, self.width):
            row = data[at: at + self.width]
            yield None if row[:1] == b"*" else [self.value(row[p: p + s], k, s, d) for _, k, p, s, d in self.fields]

    def value(self, raw, kind, size, decimals):
        text = raw.decode(self.encoding, "replace").strip(" \0")
        if not text or (kind in "NF" and text.startswith("*")):
            return None
        if kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        if kind == "D":
            return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        if kind == "N" and decimals == 0 and size <= 18:
            return int(float(text)) if "." in text else int(text)
        return float(text) if kind in "NFO" else text


def record_geometry(data: bytes):
    """WKB of one record content; the shape code names the type, Z and M are dropped."""
    declared = struct.unpack_from("<i", data)[0]
    if declared not in SHAPES:
        raise BadRequest(f"Shapes of type {declared} are not supported")
    code = declared % 10
    if code == 1:
        return codec.encode((codec.POINT, struct.unpack_from("<dd", data, 4)))
    if code == 8:
        count = struct.unpack_from("<i", data, 36)[0]
        xy = np.frombuffer(data, "<f8", 2 * count, 40).reshape(-1, 2).tolist()
        return codec.encode((codec.MULTIPOINT, [(codec.POINT, tuple(p)) for p in xy]))
    if code == 0:
        return None
    parts, count = struct.unpack_from("<ii", data, 36)
    starts = np.frombuffer(data, "<i4", parts, 44).tolist() + [count]
    xy = np.frombuffer(data, "<f8", 2 * count, 44 + 4 * parts).reshape(-1, 2)
    chains = [xy[a:b] for a, b in zip(starts, starts[1:])]
    if code == 3:
        lines = [(codec.LINE, c) for c in chains]
        return codec.encode(lines[0] if len(lines) == 1 else (codec.MULTILINE, lines))
    return codec.encode(_polygons(chains))


def _polygons(rings):
    """Clockwise rings are shells; a hole goes to the smallest shell around it."""
    from ..functions.overlay import _signed_area
    from ..functions.predicates import locate

    shells = [[r] for r in rings if _signed_area(r) <= 0]
    holes = [r for r in rings if _signed_area(r) > 0]
    if not shells:
        shells, holes = [[r] for r in holes], []
    for hole in holes:
        around = [s for s in shells
                  if (locate(np.hstack([s[0][:-1], s[0][1:]]), hole[:, 0], hole[:, 1]) > 0).all()]
        owner = min(around, key=lambda s: abs(_signed_area(s[0])), default=None)
        if owner is None:
            shells.append([hole])
        else:
            owner.append(hole)
    polygons = [(codec.POLYGON, s) for s in shells]
    return polygons[0] if len(polygons) == 1 else (codec.MULTIPOLYGON, polygons)


class Shapefile(DataSource):
    """``format("shapefile")`` with option ``path``: a file or a directory of files of one schema."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        table = _sidecar(matching(self.options["path"], (".shp",))[0], ".dbf")
        return ", ".join([*(_Table(table).ddl() if table else []), "geometry binary"])

    def reader(self, schema):
        return _Reader(matching(self.options["path"], (".shp",)))


class _Range(InputPartition):
    def __init__(self, path, first, count):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, paths):
        self.paths = paths

    def partitions(self):
        out = []
        for path in self.paths:
            index = _sidecar(path, ".shx")
            if index is None:
                out.append(_Range(path, 0, None))
                continue
            words = struct.unpack(">i", read_range(index, 24, 4))[0]
            rows = (2 * words - 100) // 8
            out += [_Range(path, at, min(RECORDS_PER_TASK, rows - at)) for at in range(0, rows, RECORDS_PER_TASK)]
        return out or [_Range(self.paths[0], 0, 0)]

    def read(self, partition):
        geometries = list(self.geometries(partition))
        table = _sidecar(partition.path, ".dbf")
        if table is None or not geometries:
            yield from ((g,) for g in geometries)
            return
        for g, row in zip(geometries, _Table(table).records(partition.first, len(geometries))):
            if row is not None:
                yield (*row, g)

    def geometries(self, partition):
        if partition.count == 0:
            return
        if partition.count is None:
            data, at = read_range(partition.path, 100, None), 0
            while at + 8 <= len(data):
                size = 2 * struct.unpack_from(">i", data, at + 4)[0]
                yield record_geometry(data[at + 8: at + 8 + size])
                at += 8 + size
            return
        index = read_range(_sidecar(partition.path, ".shx"), 100 + 8 * partition.first, 8 * partition.count)
        entries = np.frombuffer(index, ">i4").reshape(-1, 2).astype("i8") * 2
        start = int(entries[:, 0].min())
        stop = int((entries[:, 0] + entries[:, 1]).max()) + 8
        data = read_range(partition.path, start, stop - start)
        for offset, size in entries.tolist():
            at = offset - start + 8
            yield record_geometry(data[at: at + size])


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").option("path", path).load()


def declared_srid(path: str) -> int | None:
    """EPSG code from the projection sidecar, by authority or by the name of a known system."""
    sidecar = _sidecar(matching(path, (".shp",))[0], ".prj")
    if sidecar is None:
        return None
    text = read_range(sidecar, 0, None).decode("utf-8", "replace")
    authority = re.findall(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]\]\s*$', text.strip())
    if authority:
        return int(authority[-1])
    zone = re.search(r"UTM[_ ]Zone[_ ](\d{1,2})([NS])", text, re.IGNORECASE)
    mga = re.search(r"MGA[_ ]Zone[_ ](\d{1,2})", text, re.IGNORECASE)
    if mga:
        return (7800 if "2020" in text else 28300) + int(mga.group(1))
    if zone and "WGS" in text.upper():
        return (32600 if zone.group(2).upper() == "N" else 32700) + int(zone.group(1))
    if re.search(r"Mercator_Auxiliary_Sphere|Pseudo[- ]Mercator", text, re.IGNORECASE):
        return 3857
    return 4326 if text.lstrip().upper().startswith("GEOGCS") else None
