"""Spatial feature analytics as ordinary Spark plans."""

from .errors import BadRequest, MapframeError, NotFound
from .plans.catalog import Catalog, Dataset, Page
from .session import prepare
from .sources import read_spatial

__all__ = ["BadRequest", "Catalog", "Dataset", "MapframeError", "NotFound", "Page", "prepare", "read_spatial"]
