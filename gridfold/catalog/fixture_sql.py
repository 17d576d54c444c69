"""The fixture tables of ``gridfold.sources.fixtures`` as DuckDB SQL.

Used by the oracle queries: each oracle is ``WITH <fixtures> <body>`` over
the driver's base views (lineitem, part, customer, ...).
"""

from __future__ import annotations

import re

CELLS_BODY = """
SELECT date,
       'h' || lpad(CAST(CAST(floor(ix/16) AS INT) AS VARCHAR), 2, '0') ||
       'v' || lpad(CAST(CAST(floor(iy/8) AS INT) AS VARCHAR), 2, '0') AS tile,
       iy, ix,
       CAST({y0c} - 0.5*iy AS DOUBLE) AS y,
       CAST({x0c} + 0.5*ix AS DOUBLE) AS x,
       CASE WHEN (ix + 2*iy + ln) % 11 = 0 OR (ix = 7 AND iy = 3)
            THEN NULL ELSE value END AS value,
       CAST(qflag AS DOUBLE) AS qflag
FROM (SELECT CAST(DATE '2020-01-01' + CAST(8*(l_linenumber-1) AS INT) AS DATE) AS date,
             l_linenumber AS ln,
             CAST(l_orderkey % {ny} AS INT) AS iy,
             CAST(l_partkey % {nx} AS INT) AS ix,
             CAST(CAST(sum(l_quantity) AS BIGINT) % 97 AS DOUBLE) AS value,
             min(CAST(round(l_tax*100) AS INT)) AS qflag
      FROM lineitem
      GROUP BY l_linenumber, l_orderkey % {ny}, l_partkey % {nx}) g
"""

FIXTURES = {
    "cells": CELLS_BODY.format(ny=22, nx=43, y0c="60.75", x0c="10.25"),
    "cells_big": CELLS_BODY.format(ny=523, nx=1021, y0c="60.75", x0c="10.25"),
    "cells_long": """
SELECT date, tile, 1 AS band, iy, ix, y, x, value FROM cells
UNION ALL
SELECT date, tile, 2 AS band, iy, ix, y, x, qflag AS value FROM cells
""",
    "lc_fine": """
SELECT iy2 AS iy, ix2 AS ix,
       CAST(60.875 - 0.25*iy2 AS DOUBLE) AS y,
       CAST(10.125 + 0.25*ix2 AS DOUBLE) AS x,
       CAST(CASE WHEN (ix2 + iy2) % 37 = 0 THEN NULL
                 WHEN k < 9 THEN (k+1)*10 WHEN k = 9 THEN 95 ELSE 100 END AS INT) AS lc_code
FROM (SELECT iy2, ix2, arg_min(k, p_partkey) AS k
      FROM (SELECT ix2, iy2, p_partkey,
                   CAST((p_size + 3*floor(iy2/2) + (iy2 % 2)*p_partkey) % 11 AS INT) AS k
            FROM (SELECT CAST(p_partkey % 86 AS INT) AS ix2, p_partkey, p_size,
                         CAST(unnest(range(0, 44)) AS INT) AS iy2
                  FROM part) e) s
      GROUP BY iy2, ix2) g
""",
    "points": """
SELECT CAST(c_custkey AS BIGINT) AS point_id, c_name AS station,
       CAST(9.0 AS DOUBLE) + CAST(c_custkey*37 % 500 AS DOUBLE) / CAST(20.0 AS DOUBLE) AS x,
       CAST(62.0 AS DOUBLE) - CAST(c_custkey*53 % 290 AS DOUBLE) / CAST(20.0 AS DOUBLE) AS y,
       'EPSG:4326' AS crs
FROM customer
""",
}

# Fixture -> fixtures it reads.
DEPENDS = {"cells_long": ["cells"]}
ORDER = ["cells", "cells_big", "cells_long", "lc_fine", "points"]


def with_fixtures(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs of the fixtures it names.

    ``extra`` adds further named CTEs (in order) after the fixtures; they may
    use the fixtures too."""
    extra = extra or {}
    text = body + " ".join(extra.values())
    needed = {n for n in FIXTURES if re.search(rf"\b{n}\b", text)}
    for n in list(needed):
        needed.update(DEPENDS.get(n, []))
    ctes = [f"{n} AS ({FIXTURES[n]})" for n in ORDER if n in needed]
    ctes += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
