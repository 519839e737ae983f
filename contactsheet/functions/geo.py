"""Distances and settlement scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactsheet.params import EARTH_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M1: great-circle distance in kilometres; null if a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.when(a.isNotNull(), F.least(F.lit(1.0), F.sqrt(a))))


def city_radius_km(population: Column, seat: Column) -> Column:
    """M2: how far a settlement reaches, from its population; a seat of government (``seat``) reaches 2 km further."""
    pop = F.greatest(population, F.lit(1)).cast("double")
    return F.least(F.lit(35.0), 2.5 + 6.0 * F.greatest(F.lit(0.0), F.log10(pop / 10_000)) + F.when(seat, 2.0).otherwise(0.0))


def city_score(population: Column, seat: Column, distance_km: Column, bonus: Column) -> Column:
    """M2: size against distance in units of the settlement's own reach, plus a bonus for its rank."""
    pop = F.greatest(population, F.lit(1)).cast("double")
    return F.log10(pop + 1) - 1.2 * distance_km / city_radius_km(population, seat) + bonus
