"""Vectorised measures over one decoded Arrow batch."""

from __future__ import annotations

import numpy as np

from .codec import COLLECTION, LINE, POINT, POLYGON, Batch

POINT_KIND, BOX_KIND, AREA_KIND = 1, 2, 3


def bounds(b: Batch):
    """xmin, ymin, xmax, ymax per geometry; NaN where there is no vertex."""
    out = np.full((4, b.n), np.nan)
    if len(b.geom):
        first = b.start[:-1]
        for row, values, op in ((0, b.x, np.minimum), (1, b.y, np.minimum),
                                (2, b.x, np.maximum), (3, b.y, np.maximum)):
            per_ring = op.reduceat(values, first)
            head = np.flatnonzero(np.diff(b.geom, prepend=-1))
            out[row, b.geom[head]] = op.reduceat(per_ring, head)
    return out


def plain_kind(b: Batch):
    """Kind of each geometry: a point, a rectangle along the axes, another polygon whose box has an area, or 0."""
    x0, y0, x1, y1 = bounds(b)
    with np.errstate(invalid="ignore"):
        wide = (x1 > x0) & (y1 > y0)
    out = np.where((b.kind == POLYGON) & wide, AREA_KIND, 0)
    out[(b.kind == POINT) & ~np.isnan(x0)] = POINT_KIND
    rings = np.bincount(b.geom, minlength=b.n)
    four = np.flatnonzero((b.size == 5) & (out[b.geom] == AREA_KIND) & (rings[b.geom] == 1))
    at = b.start[:-1][four][:, None] + np.arange(5)
    x, y, owner = b.x[at], b.y[at], b.geom[four]
    west, south = x == x0[owner][:, None], y == y0[owner][:, None]
    corners = ((west | (x == x1[owner][:, None])) & (south | (y == y1[owner][:, None]))).all(axis=1)
    opposite = (west[:, :2] != west[:, 2:4]).all(axis=1) & (south[:, :2] != south[:, 2:4]).all(axis=1)
    side = (west[:, 0] == west[:, 1]) != (south[:, 0] == south[:, 1])
    closed = (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4])
    out[owner[corners & opposite & side & closed]] = BOX_KIND
    return out


def _steps(b: Batch):
    """Ring and vertex index of the start of every segment."""
    ring = np.repeat(np.arange(len(b.geom)), np.maximum(b.size - 1, 0))
    starts = np.ones(len(b.x), bool)
    if len(b.geom):
        starts[b.start[1:] - 1] = False
    return ring, np.flatnonzero(starts)


def _per_geom(b: Batch, ring_values):
    return np.bincount(b.geom, weights=ring_values, minlength=b.n)


def _ring_moments(b: Batch):
    """Signed area and area-weighted first moments of every ring."""
    ring, i = _steps(b)
    # relative to the first vertex of the ring, to keep precision far from 0
    ox, oy = b.x[b.start[:-1]][ring], b.y[b.start[:-1]][ring]
    x0, y0, x1, y1 = b.x[i] - ox, b.y[i] - oy, b.x[i + 1] - ox, b.y[i + 1] - oy
    cross = x0 * y1 - x1 * y0
    rings = len(b.geom)
    area = np.bincount(ring, weights=cross, minlength=rings) / 2
    mx = np.bincount(ring, weights=(x0 + x1) * cross, minlength=rings) / 6
    my = np.bincount(ring, weights=(y0 + y1) * cross, minlength=rings) / 6
    return area, mx + area * b.x[b.start[:-1]], my + area * b.y[b.start[:-1]]


def _polygon_sign(b: Batch, area):
    """+1 for shells and -1 for holes whatever the winding; 0 for non-polygons."""
    side = np.where(b.ring == 0, 1.0, -1.0) * np.where(area < 0, -1.0, 1.0)
    return np.where(b.code == POLYGON, side, 0.0)


def area(b: Batch):
    signed, _, _ = _ring_moments(b)
    return _per_geom(b, signed * _polygon_sign(b, signed))


def length(b: Batch):
    """Length of lines; polygons and points count 0."""
    ring, i = _steps(b)
    step = np.hypot(b.x[i + 1] - b.x[i], b.y[i + 1] - b.y[i]) * (b.code[ring] == LINE)
    return np.bincount(b.geom[ring], weights=step, minlength=b.n)


def centroid(b: Batch):
    """Centroid of the parts of highest dimension; NaN for empty geometries."""
    signed, mx, my = _ring_moments(b)
    sign = _polygon_sign(b, signed)
    weight = [_per_geom(b, v * sign) for v in (signed, mx, my)]

    ring, i = _steps(b)
    step = np.hypot(b.x[i + 1] - b.x[i], b.y[i + 1] - b.y[i])
    owner = b.geom[ring]
    lines = [np.bincount(owner, weights=step * v, minlength=b.n)
             for v in (1.0, (b.x[i] + b.x[i + 1]) / 2, (b.y[i] + b.y[i + 1]) / 2)]

    vertex = np.repeat(b.geom, b.size)
    points = [np.bincount(vertex, weights=w, minlength=b.n)
              for w in (np.ones(len(b.x)), b.x, b.y)]

    total = np.where(weight[0] != 0, weight[0], np.where(lines[0] != 0, lines[0], points[0]))
    x = np.where(weight[0] != 0, weight[1], np.where(lines[0] != 0, lines[1], points[1]))
    y = np.where(weight[0] != 0, weight[2], np.where(lines[0] != 0, lines[2], points[2]))
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / total, y / total


def drawable_rings(b: Batch):
    """Rings of the first member of collections and of everything else."""
    return (b.kind[b.geom] != COLLECTION) | (b.member == 0)
