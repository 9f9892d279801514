"""Column expressions; all of them are compositions of built-in functions."""

from lakeweave.functions.banding import SENSOR_BANDS, SENSOR_DEFAULT_BAND, band
from lakeweave.functions.dates import is_bad_date, iso_date, typed_dates
from lakeweave.functions.exact import exact_sums, folded, sum_bin, sum_part, sum_parts

__all__ = [
    "SENSOR_BANDS",
    "SENSOR_DEFAULT_BAND",
    "band",
    "exact_sums",
    "folded",
    "is_bad_date",
    "iso_date",
    "sum_bin",
    "sum_part",
    "sum_parts",
    "typed_dates",
]
