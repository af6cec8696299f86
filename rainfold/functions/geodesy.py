"""UTM zones and the transverse Mercator projection as column expressions (sixth-order Krueger series on WGS84)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 1e7
_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Published series in the third flattening n: (numerator, denominator) by power of n, from n**j on (fixed values).
_FORWARD = [
    [(1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)],
    [(13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)],
    [(61, 240), (-103, 140), (15061, 26880), (167603, 181440)],
    [(49561, 161280), (-179, 168), (6601661, 7257600)],
    [(34729, 80640), (-3418889, 1995840)],
    [(212378941, 319334400)],
]
_INVERSE = [
    [(1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)],
    [(1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)],
    [(17, 480), (-37, 840), (-209, 4480), (5569, 90720)],
    [(4397, 161280), (-11, 504), (-830251, 7257600)],
    [(4583, 161280), (-108847, 3991680)],
    [(20648693, 638668800)],
]
ALPHA = [sum(a / b * _N ** (j + k + 1) for k, (a, b) in enumerate(row)) for j, row in enumerate(_FORWARD)]
BETA = [sum(a / b * _N ** (j + k + 1) for k, (a, b) in enumerate(row)) for j, row in enumerate(_INVERSE)]


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone with the exceptions of Norway and Svalbard. Longitude 180 gives 61, which no zone has; it is left so."""
    plain = (F.floor((lon + 180) / 6) + 1).cast("int")
    svalbard = F.when((lon >= 0) & (lon < 9), 31).when((lon >= 9) & (lon < 21), 33).when((lon >= 21) & (lon < 33), 35).when((lon >= 33) & (lon < 42), 37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat < 84), F.coalesce(svalbard, plain)).otherwise(plain)


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon, lat)


def crs_name(epsg: Column) -> Column:
    return F.format_string("WGS 84 / UTM zone %d%s", F.pmod(epsg, F.lit(100)), F.when(epsg < 32700, "N").otherwise("S"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often it stands in the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(x, y) in metres."""
    away = F.radians(lon - (6 * zone - 183))

    def conformal(t: Column) -> Column:
        return let(F.sqrt(1 + t * t), lambda root: let(F.sinh(ECCENTRICITY * F.atanh(ECCENTRICITY * t / root)), lambda s: t * F.sqrt(1 + s * s) - s * root))

    def series(p: Column) -> Column:
        xi = p["xi"] + sum((a * F.sin(2 * (j + 1) * p["xi"]) * F.cosh(2 * (j + 1) * p["eta"]) for j, a in enumerate(ALPHA)), F.lit(0.0))
        eta = p["eta"] + sum((a * F.cos(2 * (j + 1) * p["xi"]) * F.sinh(2 * (j + 1) * p["eta"]) for j, a in enumerate(ALPHA)), F.lit(0.0))
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def sphere(p: Column) -> Column:
        c, away = p["c"], p["away"]
        return F.struct(F.atan2(c, F.cos(away)).alias("xi"), F.asinh(F.sin(away) / F.sqrt(c * c + F.cos(away) * F.cos(away))).alias("eta"))

    at = let(let(F.struct(let(F.tan(F.radians(lat)), conformal).alias("c"), away.alias("away")), sphere), series)
    return FALSE_EASTING + SCALE * RADIUS * at["eta"], F.when(south, FALSE_NORTHING).otherwise(0.0) + SCALE * RADIUS * at["xi"]


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees; the latitude by Newton steps on its tangent."""
    xi = (y - F.when(south, FALSE_NORTHING).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (x - FALSE_EASTING) / (SCALE * RADIUS)

    def series(p: Column) -> Column:
        xi0 = p["xi"] - sum((b * F.sin(2 * (j + 1) * p["xi"]) * F.cosh(2 * (j + 1) * p["eta"]) for j, b in enumerate(BETA)), F.lit(0.0))
        eta0 = p["eta"] - sum((b * F.cos(2 * (j + 1) * p["xi"]) * F.sinh(2 * (j + 1) * p["eta"]) for j, b in enumerate(BETA)), F.lit(0.0))
        return F.struct(xi0.alias("xi"), eta0.alias("eta"))

    def latitude(aim: Column) -> Column:
        def newton(tau: Column, _: Column) -> Column:
            def step(root: Column) -> Column:
                def onward(now: Column) -> Column:
                    slope = (1 - ECCENTRICITY**2) * root / (1 + (1 - ECCENTRICITY**2) * tau * tau) * F.sqrt(1 + now * now)
                    return tau + (aim - now) / slope

                return let(let(F.sinh(ECCENTRICITY * F.atanh(ECCENTRICITY * tau / root)), lambda s: tau * F.sqrt(1 + s * s) - s * root), onward)

            return let(F.sqrt(1 + tau * tau), step)

        return F.aggregate(F.sequence(F.lit(1), F.lit(5)), aim, newton)

    def degrees(p: Column) -> Column:
        aim = F.sin(p["xi"]) / F.sqrt(F.sinh(p["eta"]) * F.sinh(p["eta"]) + F.cos(p["xi"]) * F.cos(p["xi"]))
        return F.struct(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])).alias("away"), F.atan(let(aim, latitude)).alias("phi"))

    at = let(let(F.struct(xi.alias("xi"), eta.alias("eta")), series), degrees)
    return (6 * zone - 183) + F.degrees(at["away"]), F.degrees(at["phi"])


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the one-degree tile of a point by its south-west corner."""
    south, west = F.floor(lat), F.floor(lon)
    return F.concat(F.when(south >= 0, "N").otherwise("S"), F.lpad(F.abs(south).cast("string"), 2, "0"), F.lit("_"), F.when(west >= 0, "E").otherwise("W"), F.lpad(F.abs(west).cast("string"), 3, "0"))


def outward(value: Column, up: bool, digits: int = 6) -> Column:
    unit = float(10**digits)
    return (F.ceil(value * unit) if up else F.floor(value * unit)) / unit
