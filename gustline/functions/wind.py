"""Wind, air and power."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wind speeds (m/s) where a turbine starts, reaches full power, and stops (fixed values).
CUT_IN, RATED, CUT_OUT = 3.0, 12.0, 25.0
#: Bounds of the wind bands, closed at the left, and their labels (fixed values).
BAND_BOUNDS, BAND_LABELS = (3.0, 6.0, 9.0, 12.0, 25.0), ("<3", "3-6", "6-9", "9-12", "12-25", ">=25")
GAS_CONSTANT, EARTH_KM, NEUTRAL_LENGTH = 287.05, 6371.0088, 1e5


def speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def blows_from(u: Column, v: Column) -> Column:
    """Where the wind comes from, in degrees from north. Calm air, which comes from nowhere, gives 0; a formula with signed zeros would give 180."""
    return F.pmod(F.degrees(F.atan2(0 - u, 0 - v)) + 360, F.lit(360.0))


def heading_sine(u: Column, v: Column) -> Column:
    """Sine of where the wind blows to (the other convention)."""
    return F.sin(F.atan2(u, v))


def heading_cosine(u: Column, v: Column) -> Column:
    return F.cos(F.atan2(u, v))


def air_density(pressure: Column, kelvin: Column) -> Column:
    return pressure / F.nullif(kelvin * GAS_CONSTANT, F.lit(0.0))


def cycle(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic quantity."""
    return F.sin(x * (2 * math.pi / period)), F.cos(x * (2 * math.pi / period))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM)


def longitude_180(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def longitude_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def stability(zeta: Column) -> Column:
    """Businger and Dyer's correction for momentum."""
    x = F.pow(1 - 16 * F.least(zeta, F.lit(0.0)), F.lit(0.25))
    unstable = 2 * F.log((1 + x) / 2) + F.log((1 + x * x) / 2) - 2 * F.atan(x) + math.pi / 2
    return F.when(zeta > 0, -5 * zeta).when(zeta < 0, unstable).otherwise(0.0)


def hub_speed(speed_100: Column, hub: Column, roughness: Column, length: Column) -> tuple[Column, Column]:
    """(speed at hub height by similarity theory, 1 where it could be applied): elsewhere the speed at 100 m."""
    valid = (hub > roughness) & hub.between(10, 300) & (roughness > 0) & (roughness < 10) & (length != 0) & (F.abs(length) < float("inf")) & ~F.isnan(length)
    z0 = F.when(valid, roughness)
    neutral = F.abs(length) >= NEUTRAL_LENGTH
    shift = lambda z: F.when(neutral, 0.0).otherwise(stability(z / F.nullif(length, F.lit(0.0))) - stability(z0 / F.nullif(length, F.lit(0.0))))
    share = (F.log(hub / z0) - shift(hub)) / F.nullif(F.log(F.lit(100.0) / z0) - shift(F.lit(100.0)), F.lit(0.0))
    applied = F.coalesce(valid & (share > 0) & ~F.isnan(share), F.lit(False))
    return F.when(applied, speed_100 * share).otherwise(speed_100), applied.cast("int")


def power(wind: Column, capacity: Column, availability: Column) -> Column:
    """Available power: nothing below the start and from the stop on, a cubic rise, then all that is available."""
    most = F.greatest(capacity * availability, F.lit(0.0))
    rise = (F.pow(wind, 3) - CUT_IN**3) / (RATED**3 - CUT_IN**3)
    return F.when((wind < CUT_IN) | (wind >= CUT_OUT), 0.0).when(wind < RATED, most * rise).when(wind.isNotNull(), most)


def bounded(base: Column, change: Column, wind: Column, capacity: Column, availability: Column) -> Column:
    """base + change within what is available; nothing where the turbine stands."""
    inside = F.least(F.greatest(base + change, F.lit(0.0)), F.greatest(capacity * availability, F.lit(0.0)))
    return F.when((wind < CUT_IN) | (wind >= CUT_OUT), 0.0).otherwise(inside)


def capacity_factors(target: Column, base: Column, capacity: Column) -> tuple[Column, Column]:
    """(residual, target) as shares of capacity; null where that is zero."""
    return (target - base) / F.nullif(capacity, F.lit(0.0)), target / F.nullif(capacity, F.lit(0.0))


def scaled(base: Column, correction: Column, scale: float, wind: Column, capacity: Column, availability: Column) -> Column:
    """base plus a scaled correction in shares of capacity, within bounds."""
    return bounded(base, correction * scale * capacity, wind, capacity, availability)


def physical(wind: Column, capacity: Column, availability: Column) -> Column:
    """Whether inputs are finite and possible; null counts as no."""
    known = ~F.isnan(wind) & ~F.isnan(capacity) & ~F.isnan(availability)
    return F.coalesce(known & wind.between(0, 50) & (capacity > 0) & (capacity < float("inf")) & availability.between(0, 1), F.lit(False))


def band(wind: Column) -> Column:
    label = F.when(wind < BAND_BOUNDS[0], BAND_LABELS[0])
    for bound, name in zip(BAND_BOUNDS[1:], BAND_LABELS[1:]):
        label = label.when(wind < bound, name)
    return label.when(wind.isNotNull(), BAND_LABELS[-1])
