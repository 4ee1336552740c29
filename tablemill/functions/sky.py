"""Positions on the sky: distances, angles, sexagesimal text, coordinate systems. Degrees unless named."""

import math

from pyspark.sql import Column, functions as F

from .blanks import as_column


def _half_chord_squared(lon1, lat1, lon2, lat2) -> Column:
    """Haversine of the angle between two positions in radians."""
    across = F.sin((lat2 - lat1) / 2)
    along = F.sin((lon2 - lon1) / 2)
    return across * across + F.cos(lat1) * F.cos(lat2) * along * along


def sky_distance_radians(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance; arguments and result in radians."""
    h = _half_chord_squared(*[as_column(x) for x in (lon1, lat1, lon2, lat2)])
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def sky_distance(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in degrees."""
    return F.degrees(sky_distance_radians(*[F.radians(as_column(x)) for x in (lon1, lat1, lon2, lat2)]))


def position_angle_radians(lon1, lat1, lon2, lat2) -> Column:
    """Direction from the first to the second position, from north over east, in radians."""
    lon1, lat1, lon2, lat2 = [as_column(x) for x in (lon1, lat1, lon2, lat2)]
    step = lon2 - lon1
    return F.atan2(
        F.cos(lat2) * F.sin(step),
        F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(step),
    )


def polar_distance(lon1, lat1, r1, lon2, lat2, r2) -> Column:
    """Straight distance between two points given by direction (degrees) and radius."""
    a, b = unit_vector(lon1, lat1), unit_vector(lon2, lat2)
    r1, r2 = as_column(r1), as_column(r2)
    parts = [(x * r1 - y * r2) for x, y in zip(a, b)]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def unit_vector(lon, lat) -> tuple[Column, Column, Column]:
    lon, lat = F.radians(as_column(lon)), F.radians(as_column(lat))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def position_xyz(ra, dec, parallax_mas) -> Column:
    """Cartesian position in parsecs from a direction and a parallax in milliarcseconds."""
    distance = F.try_divide(F.lit(1000.0), as_column(parallax_mas))
    return F.array(*[distance * x for x in unit_vector(ra, dec)])


# --- sexagesimal -----------------------------------------------------------------------------------


def sexagesimal(a, b=None, c=None) -> Column:
    """A value from text (``dd:mm:ss``, ``dd mm ss`` or with unit letters) or from three numbers.

    A minus sign, also one before a zero, makes the whole value negative.
    """
    if b is None:
        text = as_column(a)
        parts = F.transform(
            F.regexp_extract_all(text, F.lit(r"\d+\.?\d*|\.\d+"), F.lit(0)), lambda p: p.try_cast("double")
        )
        negative = text.rlike(r"^\s*-")
        size = (
            F.try_element_at(parts, F.lit(1))
            + F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(0.0)) / 60
            + F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(0.0)) / 3600
        )
        return F.when(negative, -size).otherwise(size)
    a, b, c = as_column(a), as_column(b), as_column(c)
    size = F.abs(a) + b / 60 + c / 3600
    return F.when(a < 0, -size).otherwise(size)


def hms_to_degrees(h, m=None, s=None) -> Column:
    return sexagesimal(h, m, s) * 15.0


def dms_to_degrees(d, m=None, s=None) -> Column:
    return sexagesimal(d, m, s)


def _as_sexagesimal(value: Column, places: int, signed: bool) -> Column:
    # Everything is counted in the last shown decimal of the seconds, so that rounding carries.
    scale = 10**places
    units = F.round(F.abs(value) * 3600 * scale).cast("long")
    whole = F.floor(units / (3600 * scale)).cast("long")
    minutes = F.floor(units / (60 * scale)).cast("long") % 60
    seconds = units % (60 * scale)
    second = F.lpad(F.floor(seconds / scale).cast("long").cast("string"), 2, "0")
    if places:
        fraction = F.lpad((seconds % scale).cast("string"), places, "0")
        second = F.concat(second, F.lit("."), fraction)
    text = F.concat_ws(
        ":", F.lpad(whole.cast("string"), 2, "0"), F.lpad(minutes.cast("string"), 2, "0"), second
    )
    text = F.when(value.isNotNull(), text)
    return F.concat(F.when(value < 0, "-").otherwise("+"), text) if signed else text


def degrees_to_dms(degrees, places: int = 0) -> Column:
    """``+dd:mm:ss`` with ``places`` decimals of the seconds."""
    return _as_sexagesimal(as_column(degrees), places, signed=True)


def degrees_to_hms(degrees, places: int = 0) -> Column:
    """``hh:mm:ss`` of an angle, 24 hours to the circle."""
    hours = F.pmod(as_column(degrees) / 15.0, F.lit(24.0))
    # 23:59:59.99… that rounds up to a full day is midnight.
    shown = _as_sexagesimal(hours, places, signed=False)
    return F.regexp_replace(shown, "^24:", "00:")


# --- coordinate systems -------------------------------------------------------------------------

# Rotation from ICRS to galactic coordinates (Hipparcos catalogue, volume 1, section 1.5.3).
ICRS_TO_GALACTIC = [
    [-0.0548755604162154, -0.8734370902348850, -0.4838350155487132],
    [0.4941094278755837, -0.4448296299600112, 0.7469822444972189],
    [-0.8676661490190047, -0.1980763734312015, 0.4559837761750669],
]
# Mean obliquity of the ecliptic at J2000 in arcseconds (IAU 2006), and the supergalactic pole and
# origin in galactic coordinates (de Vaucouleurs et al. 1991).
OBLIQUITY_ARCSEC = 84381.406
SUPERGALACTIC_POLE = (47.37, 6.32)
SUPERGALACTIC_ORIGIN = (137.37, 0.0)


def _vector(lon: float, lat: float) -> list[float]:
    lon, lat = math.radians(lon), math.radians(lat)
    return [math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)]


def _times(a, b) -> list[list[float]]:
    return [[sum(x * y for x, y in zip(row, column)) for column in zip(*b)] for row in a]


def _turned(a) -> list[list[float]]:
    return [list(row) for row in zip(*a)]


def _to_ecliptic() -> list[list[float]]:
    tilt = math.radians(OBLIQUITY_ARCSEC / 3600)
    c, s = math.cos(tilt), math.sin(tilt)
    return [[1.0, 0.0, 0.0], [0.0, c, s], [0.0, -s, c]]


def _to_supergalactic() -> list[list[float]]:
    x, z = _vector(*SUPERGALACTIC_ORIGIN), _vector(*SUPERGALACTIC_POLE)
    y = [z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0]]
    return _times([x, y, z], ICRS_TO_GALACTIC)


# Rotation from ICRS into each system. FK5 at J2000 agrees with ICRS within 0.03 arcsec and is taken as equal.
FROM_ICRS = {
    "icrs": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],
    "galactic": ICRS_TO_GALACTIC,
    "ecliptic": _to_ecliptic(),
    "supergalactic": _to_supergalactic(),
}
FROM_ICRS["fk5"] = FROM_ICRS["icrs"]


def convert_position(lon, lat, source: str, target: str) -> tuple[Column, Column]:
    """(lon, lat) in ``target`` of a position in ``source``; both in degrees, lon in [0, 360)."""
    rotation = _times(FROM_ICRS[target], _turned(FROM_ICRS[source]))
    x, y, z = unit_vector(lon, lat)
    a, b, c = [row[0] * x + row[1] * y + row[2] * z for row in rotation]
    return (
        F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)),
        # Near the poles an arc sine would lose half the digits.
        F.degrees(F.atan2(c, F.hypot(a, b))),
    )


def icrs_to_galactic(ra, dec) -> Column:
    return F.array(*convert_position(ra, dec, "icrs", "galactic"))


def galactic_to_icrs(l, b) -> Column:
    return F.array(*convert_position(l, b, "galactic", "icrs"))


def ecliptic_to_icrs(lon, lat) -> Column:
    return F.array(*convert_position(lon, lat, "ecliptic", "icrs"))
