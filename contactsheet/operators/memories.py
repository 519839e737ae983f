"""What the home page brings back: birthdays and the same years ago (the day itself is ``facets.on_this_day``)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.operators.facets import taken
from contactsheet.operators.predicates import not_screenshot


def _best_first() -> list:
    return [F.coalesce("rating", F.lit(0)).desc(), F.coalesce("quality_score", F.lit(0.0)).desc(), F.col("id")]


def birthdays(photos: DataFrame, faces: DataFrame, persons: DataFrame, today: datetime.date, *, before: int = 1, after: int = 7, around: int = 2, per_year: int = 8) -> DataFrame:
    """(person_id, days_to, turning, year, rank, id): of people whose birthday was yesterday or comes within a week, their
    photos of ``around`` days about past birthdays, ``per_year`` best of each year. 29 February counts as 1 March in
    other years. ``persons`` (id, birth_date); archived photos stay out."""
    born = F.col("birth_date")
    on = lambda year: F.coalesce(F.try_make_timestamp(year, F.month(born), F.dayofmonth(born), F.lit(0), F.lit(0), F.lit(0)).cast("date"), F.make_date(year, F.lit(3), F.lit(1)))
    day = F.lit(today)
    soon = persons.where(born.isNotNull()).withColumn("days_to", F.datediff(on(F.lit(today.year)), day)).where(F.col("days_to").between(-before, after))
    soon = soon.select(F.col("id").alias("person_id"), "birth_date", "days_to", (F.lit(today.year) - F.year(born)).alias("turning"))
    seen = faces.select("photo_id", F.col("person_id").alias("p")).distinct().join(soon, F.col("p") == F.col("person_id"))
    rows = seen.join(photos.where(F.col("taken_ts").isNotNull() & (F.col("archived") == 0)), F.col("photo_id") == F.col("id"))
    year = F.year(taken())
    rows = rows.withColumn("year", year).where(F.abs(F.datediff(on(year), taken().cast("date"))) <= around)
    rank = F.row_number().over(Window.partitionBy("person_id", "year").orderBy(*_best_first()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_year).select("person_id", "days_to", "turning", "year", "rank", "id")


def years_ago(photos: DataFrame, this_year: int, deltas: tuple[int, ...] = (1, 2, 3, 5), per_year: int = 8) -> DataFrame:
    """(years, rank, id): the best photos of the years that are 1, 2, 3 and 5 years back; no screenshots, none archived."""
    rows = photos.where((F.col("archived") == 0) & not_screenshot()).withColumn("years", F.lit(this_year) - F.year(taken())).where(F.col("years").isin(*deltas))
    rank = F.row_number().over(Window.partitionBy("years").orderBy(*_best_first()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_year).select("years", "rank", "id")
