"""Coordinate reference systems as Column expressions (WGS 84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * RADIUS


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def meridian_radius() -> float:
    n = FLATTENING / (2 - FLATTENING)
    return RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def alpha() -> tuple[float, ...]:
    """Krueger's series, forward."""
    n = FLATTENING / (2 - FLATTENING)
    return (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)


def beta() -> tuple[float, ...]:
    """Krueger's series, backward."""
    n = FLATTENING / (2 - FLATTENING)
    return (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)


def utm(lon: Column, lat: Column, central: float) -> tuple[Column, Column]:
    """Transverse Mercator by the Krueger series of four terms: easting, northing (northern half)."""
    n = FLATTENING / (2 - FLATTENING)
    e = 2 * math.sqrt(n) / (1 + n)
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    d = F.radians(lon - central)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(alpha(), 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000 + SCALE * meridian_radius() * x, SCALE * meridian_radius() * y


def utm_inverse(x: Column, y: Column, central: float) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM point of the northern half; the latitude by rounds of Newton's method."""
    xi, eta = y / (SCALE * meridian_radius()), (x - 500_000) / (SCALE * meridian_radius())
    u, v = xi, eta
    for k, b in enumerate(beta(), 1):
        u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    lon = central + F.degrees(F.atan2(F.sinh(v), F.cos(u)))
    conformal = F.asin(F.sin(u) / F.cosh(v))
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    want = F.atanh(F.sin(conformal))
    # sin of the latitude: s = tanh(want + e atanh(e s)), a contraction by e^2
    s = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.sin(conformal), lambda a, _: F.tanh(want + e * F.atanh(e * a)))
    return lon, F.degrees(F.asin(s))


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal area on the ellipsoid."""
    e2 = FLATTENING * (2 - FLATTENING)
    e, sin = math.sqrt(e2), F.sin(F.radians(lat))
    q = (1 - e2) * (sin / (1 - e2 * sin * sin) + F.atanh(e * sin) / e)
    return RADIUS * F.radians(lon), RADIUS * q / 2


def mollweide(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Mollweide on the sphere; eight rounds of Newton's method for the auxiliary angle (a pole stays a pole)."""
    f = F.radians(lat)

    def step(t, _):
        slope = 2 + 2 * F.cos(2 * t)
        return t - (2 * t + F.sin(2 * t) - math.pi * F.sin(f)) / F.when(slope > 1e-12, slope).otherwise(1.0)

    t = F.aggregate(F.sequence(F.lit(1), F.lit(8)), f, step)
    return 2 * math.sqrt(2) / math.pi * RADIUS * F.radians(lon) * F.cos(t), math.sqrt(2) * RADIUS * F.sin(t)


def azimuthal_equidistant(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = 6371008.8) -> tuple[Column, Column]:
    """On the sphere, about a centre: distances from it are true."""
    d, f = F.radians(lon - lon0), F.radians(lat)
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    cos = s0 * F.sin(f) + c0 * F.cos(f) * F.cos(d)
    k = F.when(cos >= 1, 1.0).otherwise(F.acos(cos) / F.sin(F.acos(cos)))
    return radius * k * F.cos(f) * F.sin(d), radius * k * (c0 * F.sin(f) - s0 * F.cos(f) * F.cos(d))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 8) -> Column:
    """Length of the geodesic by Vincenty's inverse method; not for points nearly opposite to each other."""
    f, b = FLATTENING, RADIUS * (1 - FLATTENING)
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    start = F.radians(lon2 - lon1)
    own = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), start.alias("l"))

    def once(value, body):
        return F.transform(F.array(value), body)[0]

    def parts(p, lam):
        """sin and cos of the angle between the points, sin of the azimuth at the equator, cos of twice the middle."""

        def angle(t):
            x, y = p["c2"] * t["sin"], p["c1"] * p["s2"] - p["s1"] * p["c2"] * t["cos"]
            cs = p["s1"] * p["s2"] + p["c1"] * p["c2"] * t["cos"]
            return once(F.struct(F.sqrt(x * x + y * y).alias("ss"), cs.alias("cs")), lambda q: azimuth(t, q))

        def azimuth(t, q):
            sa = F.coalesce(p["c1"] * p["c2"] * t["sin"] / F.when(q["ss"] != 0, q["ss"]), F.lit(0.0))
            return once(sa, lambda v: middle(q, v))

        def middle(q, sa):
            ca2 = 1 - sa * sa
            cm = F.coalesce(q["cs"] - 2 * p["s1"] * p["s2"] / F.when(ca2 != 0, ca2), F.lit(0.0))
            return F.struct(q["ss"].alias("ss"), q["cs"].alias("cs"), sa.alias("sa"), ca2.alias("ca2"), cm.alias("cm"))

        return once(F.struct(F.sin(lam).alias("sin"), F.cos(lam).alias("cos")), angle)

    def longitude(p, lam):
        def step(q):
            return once(f / 16 * q["ca2"] * (4 + f * (4 - 3 * q["ca2"])), lambda c: corrected(q, c))

        def corrected(q, c):
            inner = q["cm"] + c * q["cs"] * (2 * q["cm"] * q["cm"] - 1)
            return p["l"] + (1 - c) * f * q["sa"] * (F.atan2(q["ss"], q["cs"]) + c * q["ss"] * inner)

        return once(parts(p, lam), step)

    def length(q):
        u = q["ca2"] * ((RADIUS**2 - b**2) / b**2)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))

        def bent(k):
            far = k["small"] / 6 * q["cm"] * (4 * q["ss"] * q["ss"] - 3) * (4 * q["cm"] * q["cm"] - 3)
            fix = k["small"] * q["ss"] * (q["cm"] + k["small"] / 4 * (q["cs"] * (2 * q["cm"] * q["cm"] - 1) - far))
            return b * k["big"] * (F.atan2(q["ss"], q["cs"]) - fix)

        return once(F.struct(big.alias("big"), small.alias("small")), bent)

    def whole(p):
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p["l"], lambda a, _: longitude(p, a))
        return once(parts(p, lam), length)

    return once(own, whole)
