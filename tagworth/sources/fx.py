"""Exchange rates from provider JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHAPE = "struct<base:string,base_code:string,rates:map<string,double>,conversion_rates:map<string,double>>"


def read_fx_rates(df: DataFrame, json: str = "payload", as_of: str | None = "as_of") -> DataFrame:
    """``(base, code, rate, as_of)`` from either of the two provider layouts."""
    p = F.from_json(json, _SHAPE)
    parsed = df.withColumn("_p", p)
    return parsed.select(
        F.coalesce("_p.base", "_p.base_code", F.lit("USD")).alias("base"),
        F.explode(F.coalesce("_p.conversion_rates", "_p.rates")).alias("code", "rate"),
        *([as_of] if as_of and as_of in df.columns else []),
    )
