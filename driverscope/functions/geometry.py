"""Angles, rotations, distances and screen coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the study's screen: width and height in pixels, pixel pitch in millimetres.
SCREEN_WIDTH_PX = 3840
SCREEN_HEIGHT_PX = 1600
PIXEL_PITCH_MM = 0.229
MISSING_MM = -1000.0


def c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def gaze_pitch(point_y, point_z, origin_y, origin_z) -> Column:
    """Vertical gaze angle in degrees; the viewer looks along negative z."""
    return F.degrees(F.atan2(c(point_y) - c(origin_y), c(origin_z) - c(point_z)))


def gaze_yaw(point_x, point_z, origin_x, origin_z) -> Column:
    return F.degrees(F.atan2(c(point_x) - c(origin_x), c(origin_z) - c(point_z)))


def quaternion_yaw(x, y, z, w) -> Column:
    """Heading in radians, a quarter turn less than the rotation about z (y points ahead).

    Any non-zero length is accepted: numerator and denominator scale alike.
    """
    x, y, z, w = c(x), c(y), c(z), c(w)
    sine = 2 * (w * z + x * y)
    cosine = w * w + x * x - y * y - z * z
    return F.atan2(sine, cosine) - F.lit(math.pi / 2)


def rotate(x, y, radians) -> tuple[Column, Column]:
    """Row vector times the rotation matrix, i.e. a turn by ``-radians``."""
    x, y, a = c(x), c(y), c(radians)
    return x * F.cos(a) + y * F.sin(a), y * F.cos(a) - x * F.sin(a)


def rotate_degrees(x, y, degrees) -> tuple[Column, Column]:
    return rotate(x, y, F.radians(c(degrees)))


def clamp_degrees(angle) -> Column:
    """Same direction in [-180, 180)."""
    return F.pmod(c(angle) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def distance(*pairs: tuple) -> Column:
    """Euclidean distance over (a, b) coordinate pairs."""
    total = F.lit(0.0)
    for a, b in pairs:
        delta = c(a) - c(b)
        total = total + delta * delta
    return F.sqrt(total)


def gaze_pixel(fraction, size) -> Column:
    """Screen fraction to pixel index, halves to even, NULL outside the screen."""
    pixel = F.rint(c(fraction) * c(size) if isinstance(size, (str, Column)) else c(fraction) * F.lit(size))
    limit = c(size) if isinstance(size, (str, Column)) else F.lit(size)
    return F.when((pixel >= 0) & (pixel < limit), pixel.cast("int"))


def gaze_direction(fraction, field_of_view_deg: float = 90.0) -> tuple[Column, Column]:
    """Horizontal unit vector (right, ahead) of a screen fraction."""
    angle = F.radians((c(fraction) - F.lit(0.5)) * F.lit(field_of_view_deg))
    return F.sin(angle), F.cos(angle)


def gaze_millimetres(fraction, pixels: int, missing: float = MISSING_MM) -> Column:
    """Screen fraction to millimetres; missing samples get the marker value."""
    return F.coalesce(c(fraction) * F.lit(float(pixels)) * F.lit(PIXEL_PITCH_MM), F.lit(missing))


def logistic(logit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(logit)))
