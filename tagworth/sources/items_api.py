"""Marketplace item-API records to parsed listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, text

_MONEY = ("price", "currentBidPrice", "convertedCurrentBidPrice", "minimumBidPrice", "convertedMinimumBidPrice", "marketingPrice")


def read_item_records(df: DataFrame, json: str = "payload", now: Column | None = None) -> DataFrame:
    """Title, first positive money field, status, condition and country of each record."""
    now = F.current_timestamp() if now is None else now
    field = lambda path: blank_to_null(F.trim(text(F.get_json_object(json, f"$.{path}"))))

    def money(name: str) -> Column:
        value = field(f"{name}.value").try_cast("double")
        currency = F.coalesce(F.upper(field(f"{name}.currency")), F.lit("USD"))
        return F.when(value > 0, F.struct(value.alias("price"), currency.alias("currency")))

    out_of_stock = F.upper(text(field("availability.availabilityStatus"))).contains("OUT_OF_STOCK")
    over = F.try_to_timestamp(field("itemEndDate")) < now
    return df.withColumn("_m", F.coalesce(*[money(m) for m in _MONEY])).select(
        *[c for c in df.columns if c != json],
        field("title").alias("title"),
        F.col("_m.price").alias("price"),
        F.col("_m.currency").alias("currency"),
        F.when(out_of_stock | F.coalesce(over, F.lit(False)), F.lit("Sold")).otherwise(F.lit("Available")).alias("status"),
        field("condition").alias("condition"),
        F.coalesce(field("itemLocation.country"), field("itemLocation.countryName")).alias("country"),
    )
