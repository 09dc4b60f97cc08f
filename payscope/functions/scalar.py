"""Column functions shared by rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371  # fixed value


def haversine(lat1: Column, lat2: Column, long1: Column, long2: Column) -> Column:
    """Great-circle distance in km; note the argument order (both latitudes first)."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_long = F.radians(long2 - long1) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2.0)) + (
        F.pow(F.sin(half_long), F.lit(2.0)) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)))
    return F.asin(F.sqrt(chord)) * 2 * EARTH_RADIUS_KM


def leading_digit(amount: Column) -> Column:
    """First significant digit of a decimal amount; null for zero."""
    digits = F.ltrim(amount.cast("string"), F.lit("-0."))
    return F.when(digits != "", F.substring(digits, 1, 1).cast("int"))


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
