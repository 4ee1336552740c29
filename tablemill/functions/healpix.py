"""HEALPix pixels in NESTED numbering (Górski et al. 2005), and MOC tile numbers."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .blanks import as_column

SPHERE_STERADIAN = 4 * math.pi
SPHERE_SQDEG = 4 * math.pi * (180 / math.pi) ** 2
MAX_ORDER = 29

def _spread(value: np.ndarray) -> np.ndarray:
    """Each bit moved to twice its place."""
    found = np.zeros_like(value)
    for i in range(MAX_ORDER + 1):
        found |= ((value >> i) & 1) << (2 * i)
    return found


def _pixels(ra: pd.Series, dec: pd.Series, order: pd.Series) -> pd.Series:
    blank = (ra.isna() | dec.isna()).to_numpy()
    k = order.to_numpy(dtype="int64")
    side = np.int64(1) << k
    quarter = np.mod(ra.fillna(0.0).to_numpy() / 90.0, 4.0)
    latitude = np.radians(dec.fillna(0.0).to_numpy())
    z = np.sin(latitude)

    def whole(value: np.ndarray) -> np.ndarray:
        return np.floor(value).astype("int64")

    # Belt around the equator: lines of constant (longitude ± height).
    down, up = whole(side * (quarter + 0.5 - z * 0.75)), whole(side * (quarter + 0.5 + z * 0.75))
    face_down, face_up = down >> k, up >> k
    belt_face = np.where(
        face_down == face_up, face_down % 4 + 4, np.where(face_down < face_up, face_down, face_up + 8)
    )
    # Caps around the poles: distance from the pole from the cosine of the latitude, which keeps its
    # digits where 1 - |z| loses them.
    corner = np.minimum(whole(quarter), 3)
    reach = side * np.cos(latitude) / np.sqrt((1.0 + np.abs(z)) / 3.0)
    cap_down = np.minimum(whole((quarter - corner) * reach), side - 1)
    cap_up = np.minimum(whole((1.0 - (quarter - corner)) * reach), side - 1)
    north, belt = z > 0, np.abs(z) <= 2.0 / 3.0
    face = np.where(belt, belt_face, np.where(north, corner, corner + 8))
    x = np.where(belt, up % side, np.where(north, side - 1 - cap_up, cap_down))
    y = np.where(belt, side - 1 - down % side, np.where(north, side - 1 - cap_down, cap_up))
    found = pd.Series((face << (2 * k)) | _spread(x) | (_spread(y) << 1), dtype="Int64")
    return found.mask(blank)


_pixels_udf = F.pandas_udf(_pixels, T.LongType())


def pixel(ra, dec, order: int) -> Column:
    """The pixel of a position at ``order`` (0 to 29); NULL for blank positions.

    Whole batches go through numpy: the same as Column arithmetic is a tree of some hundred nodes,
    takes long to compile and ran thirteen times as slow.
    """
    return _pixels_udf(as_column(ra).cast("double"), as_column(dec).cast("double"), F.lit(order))


def _gathered(value: np.ndarray) -> np.ndarray:
    """The even bits moved to half their place."""
    found = np.zeros_like(value)
    for i in range(MAX_ORDER + 1):
        found |= ((value >> (2 * i)) & 1) << i
    return found


def _centres(ipix: pd.Series, order: pd.Series) -> pd.DataFrame:
    k = order.to_numpy(dtype="int64")
    side = np.int64(1) << k
    face, inside = np.divmod(ipix.to_numpy(dtype="int64"), side * side)
    x, y, row = _gathered(inside), _gathered(inside >> 1), face // 4
    # Ring number counted in pixels from the north pole. Rings get shorter towards the poles, from
    # ``side`` pixels per quarter down to one.
    ring = (row + 2) * side - x - y - 1
    near = np.minimum(np.minimum(ring, 4 * side - ring), side)
    place = ((face % 4) * 2 + (row != 1)) * near + x - y
    # In the caps from the distance to the pole, because an arc sine of the height loses digits there.
    polar = np.degrees(2.0 * np.arcsin(near / side / np.sqrt(6.0)))
    belt = np.degrees(np.arcsin(np.clip((2 * side - ring) * 2.0 / (3.0 * side), -1.0, 1.0)))
    dec = np.where(near == side, belt, np.where(ring < side, 90.0 - polar, polar - 90.0))
    return pd.DataFrame({"ra": np.mod(place / near * 45.0, 360.0), "dec": dec})


# Declared as not deterministic so that filters on the result are not moved in front of it, which would
# run it twice.
_centres_udf = F.pandas_udf(
    _centres, T.StructType([T.StructField("ra", T.DoubleType()), T.StructField("dec", T.DoubleType())])
).asNondeterministic()


def pixel_centre(ipix, order) -> Column:
    """The centre of a pixel as a struct (ra, dec); ``order`` may differ from row to row."""
    return _centres_udf(as_column(ipix).cast("long"), as_column(order).cast("int"))


def _inside_face(face: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors of places in the base pixels, ``x`` and ``y`` from 0 to 1."""
    row = face // 4
    ring = row + 2 - x - y
    near = np.minimum(np.minimum(ring, 4.0 - ring), 1.0)
    turn = ((face % 4) * 2 + (row != 1)) * near + x - y
    angle = np.radians(np.divide(turn, near, out=np.zeros_like(turn), where=near > 1e-12) * 45.0)
    polar = 2.0 * np.arcsin(near / np.sqrt(6.0))
    z = np.where(near >= 1.0, (2.0 - ring) * 2.0 / 3.0, np.where(ring < 2.0, np.cos(polar), -np.cos(polar)))
    across = np.where(near >= 1.0, np.sqrt(np.maximum(1.0 - z * z, 0.0)), np.sin(polar))
    return np.stack([across * np.cos(angle), across * np.sin(angle), z], axis=-1)


# Places looked at along a side before the search narrows down around the nearest, and steps of that.
_PLACES, _STEPS = 33, 40


def _side_distances(ra: pd.Series, dec: pd.Series, ipix: pd.Series, order: pd.Series) -> pd.Series:
    found = np.empty(len(ra))
    for a in range(0, len(ra), 2000):
        part = slice(a, a + 2000)
        lon, lat = np.radians(ra.to_numpy()[part]), np.radians(dec.to_numpy()[part])
        at = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)[:, None, None, :]
        side = np.int64(1) << order.to_numpy(dtype="int64")[part]
        face, inside = np.divmod(ipix.to_numpy(dtype="int64")[part], side * side)
        face, side, x, y = (v[:, None, None] for v in (face, side, _gathered(inside), _gathered(inside >> 1)))
        # Two sides run along x, at either end of y, and two the other way.
        along, end = np.array([True, True, False, False])[None, :, None], np.array([0.0, 1.0, 0.0, 1.0])[None, :, None]

        def chord(t: np.ndarray) -> np.ndarray:
            place = _inside_face(face + np.zeros_like(t, dtype="int64"), (x + np.where(along, t, end)) / side, (y + np.where(along, end, t)) / side)
            return np.linalg.norm(place - at, axis=-1)

        grid = np.broadcast_to(np.linspace(0.0, 1.0, _PLACES), (len(lon), 4, _PLACES))
        best = chord(grid).argmin(axis=2)[:, :, None] / (_PLACES - 1)
        low, high = np.maximum(best - 1 / (_PLACES - 1), 0.0), np.minimum(best + 1 / (_PLACES - 1), 1.0)
        for _ in range(_STEPS):
            one, two = low + (high - low) / 3, high - (high - low) / 3
            left = chord(one) <= chord(two)
            low, high = np.where(left, low, one), np.where(left, two, high)
        nearest = np.minimum(np.minimum(chord(low), chord(high)), chord(best)).min(axis=(1, 2))
        found[part] = np.degrees(2.0 * np.arcsin(np.minimum(nearest / 2.0, 1.0)))
    return pd.Series(found)


_side_distances_udf = F.pandas_udf(_side_distances, T.DoubleType()).asNondeterministic()


def distance_to_sides(ra, dec, ipix, order) -> Column:
    """Degrees from a position to the nearest place on the border of a pixel."""
    return _side_distances_udf(as_column(ra).cast("double"), as_column(dec).cast("double"), as_column(ipix).cast("long"), as_column(order).cast("int"))


def pixel_radius_degrees(order: int) -> float:
    """An upper bound for the distance of a pixel's corners from its centre."""
    # 48.2 degrees for the base pixels; the limit for small pixels is 61.2 degrees per side.
    return min(48.2, 62.0 / (1 << order))


def moc_uniq(order, index) -> Column:
    """Order and index in one number: index + 4^(1 + order)."""
    return as_column(index).cast("long") + F.call_function(
        "shiftleft", F.lit(4).cast("long"), as_column(order).cast("int") * 2
    )


def uniq_to_order(uniq) -> Column:
    # The highest set bit is bit 2 * order + 2, and one of the two bits above an even place.
    bits = F.length(F.bin(as_column(uniq)))
    return F.floor((bits - 3) / 2).cast("int")


def uniq_to_index(uniq) -> Column:
    return as_column(uniq) - F.call_function(
        "shiftleft", F.lit(4).cast("long"), uniq_to_order(uniq) * 2
    )


def parent(ipix, levels) -> Column:
    """The pixel ``levels`` orders up that contains this one."""
    return F.call_function("shiftright", as_column(ipix).cast("long"), as_column(levels).cast("int") * 2)
