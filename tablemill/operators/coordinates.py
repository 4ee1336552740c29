"""Sky coordinate columns in another system."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sky


def _read(column: str, unit: str, longitude: bool) -> Column:
    if unit == "rad":
        return F.degrees(column)
    if unit == "sex":
        return sky.hms_to_degrees(column) if longitude else sky.dms_to_degrees(column)
    return F.col(column)


def _write(value: Column, unit: str, longitude: bool) -> Column:
    if unit == "rad":
        return F.radians(value)
    if unit == "sex":
        return sky.degrees_to_hms(value, 2) if longitude else sky.degrees_to_dms(value, 1)
    return value


def add_sky_coordinates(
    df: DataFrame,
    source: str,
    target: str,
    lon: str,
    lat: str,
    new_lon: str,
    new_lat: str,
    in_unit: str = "deg",
    out_unit: str = "deg",
) -> DataFrame:
    """Add the position in system ``target`` (icrs, fk5, galactic, ecliptic, supergalactic).

    Units are deg, rad or sex (sexagesimal text, hours for longitudes).
    """
    new = sky.convert_position(_read(lon, in_unit, True), _read(lat, in_unit, False), source, target)
    return df.withColumns(
        {new_lon: _write(new[0], out_unit, True), new_lat: _write(new[1], out_unit, False)}
    )
