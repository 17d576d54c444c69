"""Land-cover class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-cover codes and their labels (11 classes).
LC_LABELS = {
    10: "Tree Cover",
    20: "Shrubland",
    30: "Grassland",
    40: "Cropland",
    50: "Built-up",
    60: "Bare / sparse vegetation",
    70: "Snow and Ice",
    80: "Permanent Water Bodies",
    90: "Herbaceous Wetlands",
    95: "Mangroves",
    100: "Moss and Lichens",
}


def lc_label(code: Column | str, strict: bool = False) -> Column:
    """Label of a class code; unknown codes fail the job with ``strict``,
    else give NULL.  A NULL code gives NULL."""
    code = F.col(code) if isinstance(code, str) else code
    m = F.create_map(*[x for k, v in LC_LABELS.items() for x in (F.lit(k), F.lit(v))])
    label = F.try_element_at(m, code.cast("int"))
    if strict:
        return F.when(code.isNotNull() & label.isNull(),
                      F.raise_error(F.concat(F.lit("unknown land-cover class "),
                                             code.cast("string")))).otherwise(label)
    return label
