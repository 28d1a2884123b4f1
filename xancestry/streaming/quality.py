"""Quality filters on a stream: they judge rows one by one, so the same expressions hold.

What needs all rows (the first of each variant, joins over populations, regressions) is for batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import columns, quality


def filtered(stream: DataFrame, by: dict | None = None, names: dict[str, str] | None = None, filters: dict | None = None) -> DataFrame:
    """Standard columns of the rows that pass; works on readStream and on a batch alike."""
    return quality.run_filters(columns.standardise(stream, by, names), filters or quality.filters()).passed
