"""Spatial joins over a grid of cells, and places inferred from names."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.functions.geo import city_radius_km, city_score, haversine_km
from contactsheet.functions.text import folder_tokens
from contactsheet.params import EARTH_KM, EDGE_PEOPLE, EDGE_SHARE, EDGE_TOWN, SEAT_BONUS, VILLAGE_KM, VILLAGE_TOWN


def nearest_within(points: DataFrame, places: DataFrame, km: float, *, most: int = 1) -> DataFrame:
    """(id, place_id, km, rank): the ``most`` nearest places within ``km``, ties to the lower place. ``points`` (id,
    lat, lon), ``places`` (place_id, lat, lon)."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("km", "place_id"))
    return within_reach(points, places, km).withColumn("rank", rank).where(F.col("rank") <= most)


def within_reach(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """(id, place_id, km): every place within ``km`` of each point.

    Cells are at least ``km`` high and, at their edge nearest a pole, as wide; places are put into the three rows of
    cells around them, into the columns that the circle around them spans, so the join is by equal cells and no pair
    is missed, also across the date line.
    """
    step = max(km / (EARTH_KM * math.pi / 180), 0.01)
    rows = lambda lat: F.floor((lat + 90) / step).cast("long")
    # The columns of a row of cells, as many as leave each at least ``km`` wide at the row's edge nearest a pole.
    widest = lambda row: F.least(F.lit(89.999), F.greatest(F.abs(row * step - 90), F.abs((row + 1) * step - 90)))
    columns = lambda row: F.greatest(F.lit(1), F.floor(360 / step * F.cos(F.radians(widest(row)))).cast("long"))
    column = lambda lon, row: F.pmod(F.floor((lon + 180) / 360 * columns(row)).cast("long"), columns(row))
    p = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("row", rows(F.col("lat"))).withColumn("cell", column(F.col("lon"), F.col("row")))
    q = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("place_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"), rows(F.col("lat")).alias("own"))
    q = q.withColumn("row", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)))
    # How far the circle around a place reaches in longitude; around a pole it reaches all.
    angle = km / EARTH_KM
    reach = F.when(F.radians(F.abs(F.col("plat"))) + angle < math.pi / 2, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(angle, math.pi / 2)) / F.cos(F.radians("plat")))))).otherwise(180.0)
    count = columns(F.col("row"))
    at = lambda lon: F.floor((lon + 180) / 360 * count).cast("long")
    first = at(F.col("plon") - reach)
    last = F.least(at(F.col("plon") + reach), first + count - 1)
    q = q.withColumn("cell", F.explode(F.transform(F.sequence(first, last), lambda c: F.pmod(c, count)))).drop("own")
    return p.join(q, ["row", "cell"]).select("id", "place_id", F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 6).alias("km")).where(F.col("km") <= km)


def names_in_path(paths: DataFrame, cities: DataFrame, *, population: int = 50_000, lead: float = 3.0, skip: tuple[str, ...] = ()) -> DataFrame:
    """(id, place_id): the city a folder is named after: from the leaf upward, runs of three to one words, the longest
    first, of four letters or more and not in ``skip``; of several cities of one name, one with more than ``lead``
    times the population of the next. ``paths`` (id, folder), ``cities`` (place_id, name, population), those of the
    library's countries."""
    parts = paths.select("id", F.posexplode(F.reverse(F.split("folder", "/"))).alias("depth", "part")).select("id", "depth", folder_tokens(F.col("part")).alias("w")).where(F.size("w") > 0)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.struct(n.alias("n"), i.alias("i"), F.array_join(F.slice("w", i, n), " ").alias("name")))))
    named = parts.select("id", "depth", F.inline(runs)).where((F.length("name") >= 4) & ~F.col("name").isin(*skip))
    big = cities.where(F.col("population") >= population).select(F.lower("name").alias("name"), "place_id", "population")
    by = Window.partitionBy("name").orderBy(F.col("population").desc(), "place_id")
    clear = big.withColumn("r", F.row_number().over(by)).withColumn("next", F.lead("population").over(by)).where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("population") > lead * F.col("next")))).select("name", "place_id")
    return named.join(clear, "name").groupBy("id").agg(F.min_by("place_id", F.struct("depth", -F.col("n"), F.col("i"))).alias("place_id"))


def city_of(points: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """M3: (id, city_id, locality_id): the nearest place within 15 km, and the best-scoring settlement whose reach covers
    the point; failing that the nearest of 5,000 people within 25 km, the locality, or the nearest place within 60 km.

    Between two villages the nearer name wins, and a named town at the edge of a bigger town's reach is its own place.
    ``points`` (id, lat, lon), ``gazetteer`` (geonameid, lat, lon, population, fcode)."""
    near = within_reach(points, gazetteer.select(F.col("geonameid").alias("place_id"), "lat", "lon"), 60.0)
    facts = gazetteer.select(F.col("geonameid").alias("place_id"), F.coalesce("population", F.lit(0)).alias("population"), F.coalesce("fcode", F.lit("")).alias("fcode"))
    seat = F.col("fcode").isin("PPLC", "PPLA")
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in SEAT_BONUS.items() for x in item]), F.col("fcode")), F.lit(0.0))
    rows = near.join(facts, "place_id").withColumn("reach", city_radius_km(F.col("population"), seat)).withColumn("score", F.round(city_score(F.col("population"), seat, F.col("km"), bonus), 9))
    one = F.struct("place_id", "km", "population", "fcode", "reach")
    best = lambda on, order: F.min_by(F.when(on, one), F.when(on, order))
    picked = rows.groupBy("id").agg(
        best(F.col("km") <= 15, F.struct("km", "place_id")).alias("locality"),
        best((F.col("km") <= 35) & (F.col("km") <= F.col("reach")), F.struct(-F.col("score"), F.col("place_id"))).alias("covering"),
        best((F.col("km") <= 25) & (F.col("population") >= 5000), F.struct("km", "place_id")).alias("fallback"),
        best(F.lit(True), F.struct("km", "place_id")).alias("nearest"),
    )
    picked = picked.withColumn("city", F.coalesce("covering", "fallback", "locality", "nearest"))
    city, local = F.col("city"), F.col("locality")
    village = (local["km"] <= VILLAGE_KM) & (city["population"] < VILLAGE_TOWN) & ~city["fcode"].isin("PPLC", "PPLA", "PPLA2", "PPLA3") & (city["km"] > local["km"])
    edge = (local["population"] >= EDGE_PEOPLE) & (city["km"] / city["reach"] > EDGE_SHARE) & (city["population"] < EDGE_TOWN)
    own = F.coalesce((city["place_id"] != local["place_id"]) & (village | edge), F.lit(False))
    return picked.select("id", F.when(own, local["place_id"]).otherwise(city["place_id"]).alias("city_id"), local["place_id"].alias("locality_id"))
