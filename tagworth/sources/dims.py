"""Domain and brand dimensions.  Both come from fixed lists, so their size is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixed
from ..functions.words import brand_aliases


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table.  As a literal its size is known to the planner."""

    def cell(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)

    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def domain_dim(spark: SparkSession) -> DataFrame:
    """One row per supported domain: site key, tier, eBay country and marketplace, speed."""
    rows = []
    for domain, site in fixed.SITE_BY_DOMAIN.items():
        fast = site == "ebay" or domain in fixed.FAST_DOMAINS
        speed = "fast" if fast else "slow" if domain in fixed.SLOW_DOMAINS else "normal"
        rows.append(
            (
                domain,
                site,
                fixed.TIER_BY_SITE[site],
                fixed.EBAY_COUNTRY.get(domain, fixed.SITE_COUNTRY.get(domain)),
                fixed.EBAY_MARKETPLACE.get(domain),
                speed,
            )
        )
    return literal_table(spark, rows, ["domain", "site", "tier", "country", "marketplace", "speed"])


def brand_dim(spark: SparkSession) -> DataFrame:
    """Alias, brand and alias length."""
    rows = [(alias, brand, len(alias)) for alias, brand in brand_aliases()]
    return literal_table(spark, rows, ["alias", "brand", "alias_len"])
