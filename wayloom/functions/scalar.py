"""Scalar rules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres; factors to km/h.
EARTH_M = 6371008.8
SPEED_UNITS = {"km/h": 1.0, "kmh": 1.0, "kph": 1.0, "m/s": 3.6}


def haversine(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def parse_time_strict(text: Column) -> Column:
    """Instant of ISO text that states its offset; null otherwise."""
    return F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def finite_number(text: Column) -> Column:
    """Number that is neither NaN nor infinite; null otherwise."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def speed_kmh(speed: Column, unit: Column) -> Column:
    """Speed in km/h by its unit text; null for an unknown unit."""
    name, out = F.lower(F.trim(unit)), F.lit(None).cast("double")
    for text, factor in SPEED_UNITS.items():
        out = F.when(name == text, speed * factor).otherwise(out)
    return out


def bin_index(value: Column, edges: list[float]) -> Column:
    """Half-open bins by number, the last edge closed; outside: null. Edges may be evenly spaced or not."""
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value)) - 1
    return F.when((value >= edges[0]) & (value <= edges[-1]), F.least(at, F.lit(len(edges) - 2)))


def tag_number(text: Column, speed: bool = False) -> Column:
    """Leading number of a tag value; mph is turned into km/h for speeds, lanes must be whole; zero is null."""
    value = F.lower(F.trim(text))
    pattern = r"^(\d+(?:\.\d+)?)\s*(km/h|kmh|kph|mph)?$" if speed else r"^(\d+(?:\.\d+)?)()$"
    number = F.regexp_extract(value, pattern, 1).try_cast("double")
    if speed:
        number = F.when(F.regexp_extract(value, pattern, 2) == "mph", number * 1.609344).otherwise(number)
    else:
        number = F.when(number == F.floor(number), number)
    return F.when(number > 0, number)


def clean_label(text: Column) -> Column:
    """Dashes of any kind to '-', white space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[‐-―]", "-"), r"\s+", " "))


def text_without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def error_class(message: Column) -> Column:
    """Kind of a server's message."""
    m = F.lower(message)
    return F.when(m.rlike("rate|too many requests"), "rate_limit").when(m.rlike("memory|timeout|timed out"), "resource").when(m.rlike("parse|static error|query"), "query_error").when(m.rlike("incomplete|truncated"), "incomplete").otherwise("other")


def canonical_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are stated."""
    names = sorted(columns)
    return F.sha2(F.to_json(F.struct(*(columns[n].alias(n) for n in names)), {"ignoreNullFields": "false"}), 256)


def spreadsheet_safe(text: Column) -> Column:
    """A leading quote for text that a spreadsheet would run."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def maneuver(angle: Column) -> Column:
    """Class of a signed turn angle in degrees; positive is left."""
    a, side = F.abs(angle), F.when(angle > 0, "left").otherwise("right")
    return F.when(a <= 15, "straight").when(a <= 45, F.concat(F.lit("slight_"), side)).when(a < 135, side).when(a < 165, F.concat(F.lit("sharp_"), side)).otherwise("uturn")


def compass(bearing: Column) -> Column:
    """One of eight points of the compass."""
    names = F.array(*map(F.lit, ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")))
    return F.element_at(names, (F.floor((bearing + 22.5) / 45) % 8 + 1).cast("int"))


def outward(low: Column, high: Column, grain: float = 1e-6) -> tuple[Column, Column]:
    """Bounds rounded outward with a margin of one grain."""
    return F.floor(low / grain) * grain - grain, F.ceil(high / grain) * grain + grain


def polyline_length(points: Column) -> Column:
    """Length of array<struct<x, y>>."""
    steps = F.zip_with(points, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.hypot(b["x"] - a["x"], b["y"] - a["y"])).otherwise(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def segment_projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Fraction along the segment (clamped) of the nearest place, and its distance."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    f = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(0.0)
    return f, F.hypot(px - (ax + f * dx), py - (ay + f * dy))


def metric_grid(lat: Column, lon: Column, meridian: float = 105.0, scale: float = 0.9996, easting: float = 500_000.0) -> tuple[Column, Column]:
    """Transverse Mercator on the WGS84 ellipsoid (Krueger series to the fourth power of n)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return easting + scale * a * x, scale * a * y


def let(value: Column, body) -> Column:
    """body(value), computed once though body names it several times."""
    return F.transform(F.array(value), body)[0]


def metric_degrees(x: Column, y: Column, meridian: float = 105.0, scale: float = 0.9996, easting: float = 500_000.0) -> tuple[Column, Column]:
    """Latitude and longitude of a place on the metric grid, the inverse of metric_grid (same ellipsoid, no datum shift)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def degrees(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, c in enumerate(beta, 1):
            xi = xi - c * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            eta = eta - c * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return let(F.struct(xi.alias("xi"), eta.alias("eta")), latitude)

    def latitude(p: Column) -> Column:
        t0 = F.sin(p["xi"]) / F.sqrt(F.pow(F.sinh(p["eta"]), 2) + F.pow(F.cos(p["xi"]), 2))

        def closer(t: Column, first: Column) -> Column:  # Newton's step on the tangent of the conformal latitude
            s = F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t)))
            return let(let(s, lambda s: t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)), lambda own: t + (first - own) / F.sqrt(1 + own * own) * (1 + (1 - e2) * t * t) / ((1 - e2) * F.sqrt(1 + t * t)))

        tangent = let(t0, lambda first: let(let(closer(first, first), lambda t: closer(t, first)), lambda t: closer(t, first)))
        return F.struct(F.degrees(F.atan(tangent)).alias("lat"), (meridian + F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])))).alias("lon"))

    found = let(F.struct(((x - easting) / (scale * a)).alias("eta"), (y / (scale * a)).alias("xi")), degrees)
    return found["lat"], found["lon"]


#: Shift of the national datum to WGS84 (metres, arc seconds, parts per million), position-vector convention.
DATUM = (-191.90441429, -39.30318279, -111.45032835, -0.00928836, 0.01975479, -0.00427372, 0.252906278)


def datum_shift(lat: Column, lon: Column, back: bool = False) -> Column:
    """WGS84 degrees to the national datum by seven parameters (back: the other way), as a struct.

    Heights are taken as zero on either ellipsoid, which loses a millimetre on the way back; so the way back is corrected
    by what the way there makes of it.
    """
    tx, ty, tz, rx, ry, rz, ppm = DATUM
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    m = 1 + ppm * 1e-6
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    d = 1 + rx * rx + ry * ry + rz * rz

    def cartesian(p: Column) -> Column:
        phi, lam = F.radians(p["lat"]), F.radians(p["lon"])
        v = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
        return F.struct((v * F.cos(phi) * F.cos(lam)).alias("x"), (v * F.cos(phi) * F.sin(lam)).alias("y"), (v * (1 - e2) * F.sin(phi)).alias("z"))

    def moved(u: Column) -> Column:
        x, y, z = u["x"], u["y"], u["z"]
        return F.struct((tx + m * (x - rz * y + ry * z)).alias("x"), (ty + m * (rz * x + y - rx * z)).alias("y"), (tz + m * (-ry * x + rx * y + z)).alias("z"))

    def moved_back(u: Column) -> Column:  # the exact inverse of the linear map
        p, q, r = (u["x"] - tx) / m, (u["y"] - ty) / m, (u["z"] - tz) / m
        along = (rx * p + ry * q + rz * r) / d
        return F.struct(((p + rz * q - ry * r) / d + rx * along).alias("x"), ((q - rz * p + rx * r) / d + ry * along).alias("y"), ((r + ry * p - rx * q) / d + rz * along).alias("z"))

    def degrees(u: Column) -> Column:
        flat = F.hypot(u["x"], u["y"])
        closer = lambda phi: F.atan2(u["z"] + e2 * a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2)) * F.sin(phi), flat)
        phi = F.atan2(u["z"], flat * (1 - e2))
        for _ in range(4):
            phi = let(phi, closer)
        return F.struct(F.degrees(phi).alias("lat"), F.degrees(F.atan2(u["y"], u["x"])).alias("lon"))

    start = F.struct(lat.alias("lat"), lon.alias("lon"))
    shifted = lambda p, way: let(let(let(p, cartesian), way), degrees)
    if not back:
        return shifted(start, moved_back)
    pair = let(start, lambda p: let(shifted(p, moved), lambda g: F.struct(p.alias("p"), g.alias("g"), shifted(g, moved_back).alias("n"))))
    return let(pair, lambda t: F.struct((t["g"]["lat"] + t["p"]["lat"] - t["n"]["lat"]).alias("lat"), (t["g"]["lon"] + t["p"]["lon"] - t["n"]["lon"]).alias("lon")))


def national_grid(lat: Column, lon: Column) -> Column:
    """WGS84 degrees to metres of the national grid (struct x, y): datum shift, then transverse Mercator."""

    def grid(p: Column) -> Column:
        x, y = metric_grid(p["lat"], p["lon"])
        return F.struct(x.alias("x"), y.alias("y"))

    return let(datum_shift(lat, lon), grid)


def national_degrees(x: Column, y: Column) -> Column:
    """Metres of the national grid to WGS84 degrees (struct lat, lon)."""

    def place(p: Column) -> Column:
        lat, lon = metric_degrees(p["x"], p["y"])
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return let(let(F.struct(x.alias("x"), y.alias("y")), place), lambda p: datum_shift(p["lat"], p["lon"], back=True))
