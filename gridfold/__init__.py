"""gridfold: gridded time-series analytics on Spark DataFrames.

Dated raster composites are long-form cell tables; every operator takes and
returns a DataFrame and is planned by Catalyst.
"""

from gridfold.model import GridSpec  # noqa: F401

__version__ = "0.1.0"
