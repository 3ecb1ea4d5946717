"""Trips by origin, and calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import within

OD_SCHEMA = "id string, start_time string, start_region_name string, end_time string, end_region_name string, travel_time string"


def origin_counts(trips: DataFrame, origin: str, time: str | None = None, start: str | None = None, end: str | None = None, closed: str = "neither", limit: int | None = None) -> DataFrame:
    """Trips of each origin, of all times or between two; limit keeps the most frequent ones."""
    rows = trips.where(within(F.col(time), start, end, closed)) if time else trips
    counts = rows.groupBy(origin).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), origin).limit(limit) if limit else counts


def project_view(trips: DataFrame, columns: list[str], view: str = "od") -> DataFrame:
    """Columns of trips through a view."""
    trips.createOrReplaceTempView(view)
    return trips.sparkSession.sql(f"SELECT {', '.join(f'`{c}`' for c in columns)} FROM {view}")


def day_type(date: Column, calendar: Column | None = None) -> Column:
    """0 for workdays, 1 for public holidays, 2 for make-up workdays, 3 for rest days, -1 for no date: by the calendar's entry, else
    by the weekday."""
    weekend = F.dayofweek(date).isin(1, 7)
    rule = F.when(date.isNull(), -1).when(weekend, 3).otherwise(0)
    return F.coalesce(calendar, rule).cast("int") if calendar is not None else rule.cast("int")


def day_types(df: DataFrame, date: str, calendar: DataFrame | None = None) -> DataFrame:
    """df with day_type; calendar(date, type) holds exceptions, a few dozen a year; its size decides how it is joined."""
    if calendar is None:
        return df.withColumn("day_type", day_type(F.col(date)))
    known = calendar.select(F.col("date").alias("_date"), F.col("type").alias("_type"))
    return df.join(known, F.col(date) == F.col("_date"), "left").withColumn("day_type", day_type(F.col(date), F.col("_type"))).drop("_date", "_type")
