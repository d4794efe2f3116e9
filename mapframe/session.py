"""Session helpers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .functions.spatial import register


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package usable in this session.

    Task code travels with the plan, so executors need no installed copy, and
    the ``ST_*`` functions become available in ``spark.sql``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    if not spark.catalog.functionExists("mf_bounds"):
        register(spark)
    return spark


@contextmanager
def quoted_identifiers(spark: SparkSession):
    """SQL text read inside may put column names in double quotes."""
    wanted = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's own setting, else one for local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="mapframe-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/mapframe-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a table in the scratch folder: later plans begin there, and rows keep the ids they were written with."""
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
