"""Label a number by the first upper bound it does not exceed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive upper bounds of the sensor bands, and the label of the rest.
SENSOR_BANDS = ((20.0, "A"), (50.0, "B"))
SENSOR_DEFAULT_BAND = "C"


def band(
    value: str | Column,
    bounds: Sequence[tuple[float, str]] = SENSOR_BANDS,
    default: str = SENSOR_DEFAULT_BAND,
) -> Column:
    """Searched case over ``bounds``, which must ascend.

    The intervals are open below and closed above, so 20.0 is A and 20.4 is B. A value no
    bound admits gets ``default``: that includes NULL, NaN and infinity.
    """
    uppers = [upper for upper, _ in bounds]
    if not bounds or uppers != sorted(set(uppers)):
        raise ValueError(f"band bounds must be non-empty and strictly ascending: {uppers}")
    value = F.col(value) if isinstance(value, str) else value
    # F itself has the same `when` method as a started case expression.
    case = F
    for upper, label in bounds:
        case = case.when(value <= upper, label)
    return case.otherwise(default)
