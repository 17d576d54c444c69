"""A growing season on gridfold: from a tile tree to field reports.

The tree is built from the given tables (there are no satellite files here).
The script asks three questions about it: how April compares with June, which
land cover carried the spring, and how the fields' series ran.

    python examples/crop_season.py /root/testdata/sf0.01
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridfold import api  # noqa: E402
from gridfold.session import get_session, scratch_path, ship_package  # noqa: E402
from gridfold.sources import fixtures as fx  # noqa: E402
from gridfold.sources.raster import write_tiles  # noqa: E402


def main(sf_dir: str) -> None:
    spark = get_session("local[*]", "gridfold-season", shuffle_partitions=8)
    ship_package(spark)
    tree = write_tiles(fx.cells(spark, sf_dir), scratch_path(spark, "season-tree"), fx.CELLS_SPEC, 8, 16)
    out = scratch_path(spark, "season-out")

    months = {}
    for name, span in {"start": ["2020-01-09", "2020-01-25"], "later": ["2020-01-26", "2020-02-18"]}.items():
        months[name] = api.plot_range(spark, tree, span, f"{out}/{name}", operator="mean", coarsen=3,
                                      extra_actions="record+mean", export_stats=True)["stats"].first()
    print("mean of the two spans:", months["start"]["mean"], months["later"]["mean"])

    spring = api.plot_range(spark, tree, ["2020-01-09", "2020-02-18"], f"{out}/cover", operator="sum",
                            extra_actions="record+sum", lc=fx.lc_fine(spark, sf_dir), lc_spec=fx.LC_SPEC)
    spring["lc_percentages"].orderBy("percentage").select("lc_label", "percentage").show(truncate=False)

    fields = api.extract_timeseries(spark, tree, f"{out}/fields", fx.points(spark, sf_dir).drop("station"),
                                    time_start="2020-01-09", time_end="2020-02-18", scale_factor=0.5)
    print("rows of the field series:", fields.count())
    print("outputs under", out)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
