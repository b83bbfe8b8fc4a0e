"""Price tiers 1..4 from several sources; unknown is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cuts by currency, and tiers by label.
CUTS = {"BRL": (40.0, 70.0, 110.0)}
TIERS = {"PRICE_LEVEL_INEXPENSIVE": 1, "PRICE_LEVEL_MODERATE": 2, "PRICE_LEVEL_EXPENSIVE": 3, "PRICE_LEVEL_VERY_EXPENSIVE": 4}


def range_tier(currency: Column, low: Column, high: Column) -> Column:
    """Tier of the middle of a range, or of its only bound; a value on a cut is of the higher tier."""
    stat = F.when(low.isNull(), high).when(high.isNull(), low).otherwise((low + high) / 2)
    out = F.lit(None).cast("int")
    for name, cuts in CUTS.items():
        tier = F.when(stat.isNull(), None)
        for k, cut in enumerate(cuts, 1):
            tier = tier.when(stat < cut, k)
        out = F.when(currency == name, tier.otherwise(len(cuts) + 1)).otherwise(out)
    return out


def label_tier(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, tier in TIERS.items():
        out = F.when(label == name, tier).otherwise(out)
    return out


def price_signal(label: Column, currency: Column, low: Column, high: Column, crowd_price: Column) -> Column:
    """struct<level, source>: the range decides, then the label, then the crowd service's own 1..4."""
    by_range, by_label = range_tier(currency, low, high), label_tier(label)
    by_crowd = F.when(crowd_price.between(1, 4), crowd_price.cast("int"))
    level = F.coalesce(by_range, by_label, by_crowd)
    source = F.when(by_range.isNotNull(), "google_range").when(by_label.isNotNull(), "google_enum").when(by_crowd.isNotNull(), "besttime")
    return F.struct(level.alias("level"), source.alias("source"))
