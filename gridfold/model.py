"""Data model: the grid description and the canonical table schemas.

A raster is stored long-form, one row per cell (and per date / band for
stacks).  ``iy``/``ix`` are integer row/column indices on a regular grid,
``y``/``x`` the cell-centre coordinates.  ``y`` descends with ``iy`` (north
up), as in the source rasters.  Missing data is SQL NULL; an absent row also
means missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_SCHEMA = (
    "date DATE, tile STRING, iy INT, ix INT, y DOUBLE, x DOUBLE, "
    "value DOUBLE, qflag DOUBLE"
)
CELLS_LONG_SCHEMA = (
    "date DATE, tile STRING, band INT, iy INT, ix INT, y DOUBLE, x DOUBLE, "
    "value DOUBLE"
)
GRID_SCHEMA = "iy INT, ix INT, y DOUBLE, x DOUBLE, value DOUBLE"
POINTS_SCHEMA = "point_id BIGINT, station STRING, x DOUBLE, y DOUBLE, crs STRING"
LC_SCHEMA = "iy INT, ix INT, y DOUBLE, x DOUBLE, lc_code INT"

WGS84 = "EPSG:4326"
SINUSOIDAL = "SR-ORG:6974"  # MODIS sinusoidal sphere
WEB_MERCATOR = "EPSG:3857"

VALUE_BAND = 1
QUALITY_BAND = 2


@dataclass(frozen=True)
class GridSpec:
    """A regular, north-up grid.

    ``x0`` is the west edge, ``y0`` the north edge, ``dx``/``dy`` the
    (positive) cell sizes and ``nx``/``ny`` the axis lengths.  The spec is
    plan-time metadata: every coordinate is derived from ``iy``/``ix`` by a
    column expression, so no coordinate table has to travel with the data.
    """

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int
    crs: str = WGS84

    # -- coordinates ---------------------------------------------------
    def x_of(self, ix: Column | str = "ix") -> Column:
        ix = F.col(ix) if isinstance(ix, str) else ix
        return (F.lit(self.x0) + (ix + F.lit(0.5)) * F.lit(self.dx)).cast("double")

    def y_of(self, iy: Column | str = "iy") -> Column:
        iy = F.col(iy) if isinstance(iy, str) else iy
        return (F.lit(self.y0) - (iy + F.lit(0.5)) * F.lit(self.dy)).cast("double")

    def ix_of(self, x: Column | str = "x") -> Column:
        """Index of the cell containing ``x`` (may fall outside 0..nx-1)."""
        x = F.col(x) if isinstance(x, str) else x
        return F.floor((x - F.lit(self.x0)) / F.lit(self.dx)).cast("int")

    def iy_of(self, y: Column | str = "y") -> Column:
        y = F.col(y) if isinstance(y, str) else y
        return F.floor((F.lit(self.y0) - y) / F.lit(self.dy)).cast("int")

    def with_coords(self, df: DataFrame) -> DataFrame:
        """(Re)compute ``y``/``x`` from ``iy``/``ix``."""
        return df.withColumns({"y": self.y_of("iy"), "x": self.x_of("ix")})

    # -- derived grids -------------------------------------------------
    def coarsened(self, k: int) -> "GridSpec":
        """Grid of k x k blocks after trimming incomplete edge blocks."""
        if k < 1:
            raise ValueError(f"coarsen factor must be >= 1, got {k}")
        return replace(self, dx=self.dx * k, dy=self.dy * k,
                       nx=self.nx // k, ny=self.ny // k)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """(west, south, east, north) outer bounds."""
        return (self.x0, self.y0 - self.ny * self.dy,
                self.x0 + self.nx * self.dx, self.y0)

    @property
    def n_cells(self) -> int:
        return self.nx * self.ny

    def index_window(self, lon_min=None, lon_max=None, lat_min=None,
                     lat_max=None) -> tuple[int, int, int, int]:
        """Inclusive index ranges (iy_lo, iy_hi, ix_lo, ix_hi) of the cells
        whose centres lie inside the (inclusive) box; open bounds = extent."""
        def lo_idx(v, origin, step):
            return max(0, math.ceil((v - origin) / step - 0.5 - 1e-9))

        def hi_idx(v, origin, step, n):
            return min(n - 1, math.floor((v - origin) / step - 0.5 + 1e-9))

        ix_lo = 0 if lon_min is None else lo_idx(lon_min, self.x0, self.dx)
        ix_hi = self.nx - 1 if lon_max is None else hi_idx(lon_max, self.x0, self.dx, self.nx)
        # y descends: the north bound gives the smallest iy
        iy_lo = 0 if lat_max is None else lo_idx(-lat_max, -self.y0, self.dy)
        iy_hi = self.ny - 1 if lat_min is None else hi_idx(-lat_min, -self.y0, self.dy, self.ny)
        return iy_lo, iy_hi, ix_lo, ix_hi


def nan_to_null(col: Column) -> Column:
    """NaN -> NULL.  Spark aggregates do not skip NaN; the reference does."""
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)
