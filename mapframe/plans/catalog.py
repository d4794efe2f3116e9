"""Datasets on shared storage.

Each dataset is one Parquet directory.  Metadata are appended as small Parquet
files and the newest row of an id counts, so writers never overwrite what a
reader may be looking at.  Count, bounds and geometry type are observed while
the data are written; nothing is read a second time.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..errors import BadRequest, MapframeError, NotFound

from ..operators import features as fe
from ..operators import profile as pr
from ..operators import sqltext
from ..session import prepare
from ..sources import geojson
from ..streaming import arrow_stream

SCHEMA = ("id string, name string, table_name string, geometry_column string, geometry_type string, srid int, "
          "feature_count bigint, bounds struct<min_x:double,min_y:double,max_x:double,max_y:double>, "
          "columns array<struct<name:string,data_type:string,nullable:boolean>>, "
          "created_at timestamp, updated_at timestamp, deleted boolean")
FIELDS = ["id", "name", "table_name", "geometry_column", "geometry_type", "srid", "feature_count", "bounds",
          "columns", "created_at", "updated_at"]


@dataclass(frozen=True)
class Dataset:
    id: str
    name: str
    table_name: str
    geometry_column: str | None
    geometry_type: str
    srid: int
    feature_count: int
    bounds: pr.Bounds | None
    columns: list[dict]
    created_at: datetime
    updated_at: datetime

    @property
    def points(self) -> bool:
        return False if self.geometry_column is None else self.geometry_type == "point"


@dataclass(frozen=True)
class Page:
    """Rows of one request, the size of the dataset, and whether the cap cut the request."""

    features: DataFrame
    total: int
    truncated: bool


class Catalog:
    def __init__(self, spark: SparkSession, root: str, layout: bool = True):
        self.spark, self.root, self.layout = prepare(spark), root.rstrip("/"), layout
        self.log = f"{self.root}/_datasets"

    # --- storage ----------------------------------------------------------

    def _hadoop(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), hadoop

    def _exists(self, path: str) -> bool:
        system, hadoop = self._hadoop(path)
        return system.exists(hadoop)

    def _remove(self, path: str) -> None:
        system, hadoop = self._hadoop(path)
        system.delete(hadoop, True)

    def data_path(self, table_name: str) -> str:
        return f"{self.root}/{table_name}"

    def _record(self, dataset: Dataset, deleted: bool = False) -> None:
        row = {**asdict(dataset), "deleted": deleted, "updated_at": datetime.now(timezone.utc)}
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.log)

    # --- metadata ---------------------------------------------------------

    def datasets(self) -> DataFrame:
        """Current metadata, one row per dataset."""
        if not self._exists(self.log):
            return self.spark.createDataFrame([], SCHEMA).drop("deleted")
        log = self.spark.read.schema(SCHEMA).parquet(self.log)
        newest = log.groupBy("id").agg(F.max_by(F.struct(*log.columns), "updated_at").alias("d"))
        return newest.where(~F.col("d.deleted")).select(*[F.col(f"d.{c}") for c in FIELDS])

    def list(self) -> list[Dataset]:
        return [self._dataset(r) for r in self.datasets().collect()]

    def get(self, dataset_id: str) -> Dataset:
        row = self.datasets().where(F.col("id") == dataset_id).head()
        if row is None:
            raise NotFound(f"Dataset {dataset_id} not found")
        return self._dataset(row)

    @staticmethod
    def _dataset(row) -> Dataset:
        d = row.asDict(recursive=True)
        return Dataset(**{**d, "bounds": pr.Bounds(**d["bounds"]) if d["bounds"] else None})

    def bounds(self, dataset_id: str) -> pr.Bounds:
        found = self.get(dataset_id).bounds
        if found is None:
            raise MapframeError("Bounds not available")
        return found

    def delete(self, dataset_id: str) -> None:
        dataset = self.get(dataset_id)
        self._record(dataset, deleted=True)
        self.spark.catalog.dropTempView(dataset.table_name)
        self._remove(self.data_path(dataset.table_name))

    def restore(self) -> list[Dataset]:
        """Datasets whose data are present, each under its table name in SQL; others are skipped."""
        found = []
        for dataset in self.list():
            try:
                pr.check_identifier(dataset.table_name)
            except BadRequest:
                continue
            if self._exists(f"{self.data_path(dataset.table_name)}/_SUCCESS"):
                self.table(dataset).createOrReplaceTempView(dataset.table_name)
                found.append(dataset)
        return found

    # --- creation ---------------------------------------------------------

    def load_file(self, path: str, name: str | None = None, confine_to: str | None = None,
                  srid: int | None = None, **options) -> Dataset:
        """Read a spatial file and keep it as a dataset."""
        df, declared = sources.read_with_srid(self.spark, path, confine_to, **options)
        geom = pr.detect_geometry_column(df)
        if geom is None:
            raise BadRequest("No geometry column found")
        return self._store(df, name or sources.dataset_name(path.rstrip("/").split("/")[-1]), geom,
                           srid if srid is not None else declared)

    def create(self, df: DataFrame, name: str, srid: int | None = None) -> Dataset:
        """Keep a DataFrame as a dataset, spatial when it has a geometry column."""
        if not name or not name.strip():
            raise BadRequest("Dataset name is required")
        return self._store(df, name.strip(), pr.detect_geometry_column(df), srid)

    def create_from_sql(self, sql: str, name: str) -> Dataset:
        """Keep the result of a query; boxes and row numbers are made anew."""
        found = sqltext.query(self.spark, sql)
        return self.create(found.drop(*pr.INTERNAL), name)

    def _store(self, df: DataFrame, name: str, geom: str | None, srid: int | None) -> Dataset:
        dataset_id = str(uuid.uuid4())
        table = pr.check_identifier("dataset_" + dataset_id.replace("-", "_"))
        columns = pr.column_info(df)
        if geom is None:
            ready, reached = pr.with_fid(df), 4326
        else:
            ready, reached = pr.prepare_features(df, geom, srid)
            if self.layout:
                ready = pr.cell_layout(ready)
        seen = Observation()
        path = self.data_path(table)
        try:
            # observed in the writing stage, whose tasks are counted once each
            ready.observe(seen, *pr.profile_aggregates(geom)).write.mode("errorifexists").parquet(path)
            facts = seen.get
        except Exception:
            self._remove(path)
            raise
        bounds = pr.bounds_of(facts)
        if geom is not None and reached == 4326 and pr.out_of_lonlat(bounds):
            reached = 0
        if reached != 4326:
            warnings.warn(f"{name}: coordinates are not lon/lat and could not be reprojected")
        now = datetime.now(timezone.utc)
        dataset = Dataset(dataset_id, name, table, geom,
                          pr.GEOMETRY_TYPES.get(facts.get("type_code"), "unknown"), reached,
                          facts["feature_count"], bounds, columns, now, now)
        self._record(dataset)
        self.table(dataset).createOrReplaceTempView(table)
        return dataset

    # --- queries ----------------------------------------------------------

    def table(self, dataset: Dataset | str) -> DataFrame:
        """All rows of a dataset with its hidden columns."""
        dataset = self.get(dataset) if isinstance(dataset, str) else dataset
        return self.spark.read.parquet(self.data_path(dataset.table_name))

    def features(self, dataset_id: str, limit: int | None = None, offset: int = 0, bbox=None,
                 cap: int | None = None) -> Page:
        """Attributes, then ``geometry``; internally still with the row number.

        All rows, in no order, without limit, offset and cap; else one page in row order. A cap cuts larger requests off
        and says so.
        """
        dataset = self.get(dataset_id)
        if dataset.geometry_column is None:
            raise BadRequest("Dataset has no geometry")
        found = fe.bbox_filter(self.table(dataset), bbox, dataset.geometry_column, dataset.points)
        found = fe.project(found, dataset.geometry_column, keep_fid=True)
        if limit is None and not offset and cap is None:
            return Page(found, dataset.feature_count, False)
        rows, truncated = fe.cap_limit(limit, dataset.feature_count, cap)
        return Page(fe.page(found, rows, offset or 0), dataset.feature_count, truncated)

    def features_arrow(self, dataset_id: str, limit=None, offset=0, bbox=None, cap=fe.MAX_FEATURES) -> bytes:
        page = self.features(dataset_id, limit, offset, bbox, cap).features
        return arrow_stream.to_arrow_ipc(page.drop(pr.FID))

    def features_geojson(self, dataset_id: str, limit=None, offset=0, bbox=None, cap=fe.MAX_FEATURES) -> str:
        return geojson.collection(self.features(dataset_id, limit, offset, bbox, cap).features)

    def export_arrow(self, dataset_id: str, path: str, bbox=None) -> None:
        """Every feature, one Arrow stream file per task."""
        dataset = self.get(dataset_id)
        found = fe.bbox_filter(self.table(dataset), bbox, dataset.geometry_column, dataset.points)
        arrow_stream.write_arrow(fe.project(found, dataset.geometry_column), path)

    def export_geojson(self, dataset_id: str, path: str, bbox=None) -> None:
        """Every feature, newline-delimited; ids are positions in row order."""
        dataset = self.get(dataset_id)
        found = fe.bbox_filter(self.table(dataset), bbox, dataset.geometry_column, dataset.points)
        numbered = fe.with_position(fe.project(found, dataset.geometry_column, keep_fid=True))
        geojson.write_geojson(numbered, path, "_pos")

    def query(self, dataset_id: str, condition: str | None = None) -> DataFrame:
        """Rows that satisfy a SQL condition; double quotes may enclose column names."""
        return fe.where_text(self.table(dataset_id), condition)

    def identify(self, dataset_id: str, x: float, y: float, tolerance: float = 0.0) -> DataFrame:
        dataset = self.get(dataset_id)
        return fe.identify(self.table(dataset), x, y, tolerance, dataset.geometry_column, dataset.points)
