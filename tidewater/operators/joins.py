"""Left outer joins with distinct counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def product_locations(tx: DataFrame, users: DataFrame, user: str, product: str, location: str) -> DataFrame:
    """Every transaction's product with its user's location, null where the user is unknown. Distinct pairs come before the
    join, since a product is bought by the same user many times."""
    return tx.select(product, user).distinct().join(users.select(user, location), user, "left").select(product, location)


def location_lists(tx: DataFrame, users: DataFrame, user: str, product: str, location: str) -> DataFrame:
    """The sorted distinct known locations of each product's buyers."""
    pairs = product_locations(tx, users, user, product, location)
    return pairs.groupBy(product).agg(F.array_sort(F.collect_set(location)).alias("locations"))


def location_counts(tx: DataFrame, users: DataFrame, user: str, product: str, location: str, missing: str = "ignore") -> DataFrame:
    """Distinct locations of each product's buyers. An unknown user's location counts as one more ('label'), doesn't count
    ('ignore'), or takes the row with it ('drop')."""
    pairs = product_locations(tx, users, user, product, location)
    where = F.col(location).cast("string")
    if missing == "label":
        where = F.coalesce(where, F.lit(UNKNOWN))
    elif missing == "drop":
        pairs = pairs.where(F.col(location).isNotNull())
    return pairs.groupBy(product).agg(F.count_distinct(where).alias("n"))
