"""Per-sample purity, ploidy and read parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as defaults
from ..operators.skew import lookup_join


def sample_params(samples: DataFrame, purity: DataFrame | None, reads: DataFrame | None) -> DataFrame:
    """One row per sample of ``samples`` with the given values, or the defaults where a
    sample or a value is absent.  A purity outside 0..1 is an error."""
    out = samples.select("sample").distinct()
    for table in (purity, reads):
        if table is not None:
            out = lookup_join(out, table, ["sample"])
    filled = {
        c: F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v)
        for c, v in defaults.PARAM_DEFAULTS.items()
    }
    out = out.withColumns(filled)
    valid = F.when(F.col("purity").between(0, 1), F.col("purity")).otherwise(
        F.raise_error(
            F.concat(F.lit("purity is not between 0 and 1 for sample "), F.col("sample"))
        ).cast("double")
    )
    return out.withColumn("purity", valid).select("sample", *defaults.PARAM_DEFAULTS)
