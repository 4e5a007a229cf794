"""Length units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Micrometres per unit.
UM_PER_UNIT = {"um": 1.0, "µm": 1.0, "micron": 1.0, "microns": 1.0, "micrometer": 1.0,
               "mm": 1000.0, "meter": 1000000.0, "m": 1000000.0}


def unit_to_um(unit: Column, unknown_as_mm: bool = False) -> Column:
    """Micrometres per unit; an unlisted unit is an error, or millimetres for 'unknown' on request."""
    name = F.lower(F.trim(unit))
    result = F.when(F.lit(False), F.lit(0.0))
    for text, factor in UM_PER_UNIT.items():
        result = result.when(name == text, F.lit(factor))
    if unknown_as_mm:
        result = result.when(name == "unknown", F.lit(1000.0))
    return result.otherwise(F.raise_error(F.concat(F.lit("unsupported length unit: "), F.coalesce(unit, F.lit("NULL")))).cast("double"))


def guess_unit(spacing_x: Column, spacing_y: Column) -> Column:
    """Both in-plane spacings below 1 are read as millimetres, otherwise micrometres."""
    return F.when((spacing_x < 1) & (spacing_y < 1), F.lit("mm")).otherwise(F.lit("um"))
