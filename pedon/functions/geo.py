"""Projection, variogram models and map rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedon.functions.rounding import col

X = Column | str | float
# GRS80 ellipsoid and UTM scale.
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257222101, 0.9996


def utm_zone(lon: X) -> Column:
    return (F.floor((col(lon) + 180.0) / 6.0) + 1).cast("int")


def epsg(zone: X, south: X) -> Column:
    """SIRGAS 2000 / UTM."""
    return F.when(col(south), col(zone) + 31960).otherwise(col(zone) + 31954).cast("int")


def is_geographic(x: X, y: X) -> Column:
    """Aggregate: whether all coordinates can be degrees; false where there are none."""
    return F.coalesce(F.bool_and((F.abs(col(x)) <= 180) & (F.abs(col(y)) <= 90)), F.lit(False))


def forward_utm(lon: X, lat: X, zone: X, south: X) -> Column:
    """struct(x, y) in metres, by Snyder's series (1987)."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    phi = F.radians(col(lat))
    lam = F.radians(col(lon) - (col(zone) * 6 - 183))
    n = SEMI_MAJOR / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), ep2 * F.cos(phi) * F.cos(phi)
    a = F.cos(phi) * lam
    m = SEMI_MAJOR * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    p = lambda k: F.pow(a, F.lit(float(k)))
    x = SCALE * n * (a + (1 - t + c) * p(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * p(5) / 120) + 500000.0
    y = SCALE * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * p(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * p(6) / 720))
    return F.struct(x.alias("x"), F.when(col(south), y + 1e7).otherwise(y).alias("y"))


#: In the order in which ties are broken.
MODELS = ["exponential", "spherical", "gaussian"]


def shape(model: str, h: X, a: X) -> Column:
    """A model's part between nugget and sill, from 0 to 1."""
    r = col(h) / col(a)
    if model == "spherical":
        r = F.least(r, F.lit(1.0))
        return 1.5 * r - 0.5 * r * r * r
    return 1.0 - F.exp(-3.0 * (r if model == "exponential" else r * r))


def gamma(model: str, h: X, nugget: X, sill: X, a: X) -> Column:
    """Semivariance; 0 at distance 0."""
    return F.when(col(h) > 0, col(nugget) + col(sill) * shape(model, h, a)).when(col(h).isNotNull(), 0.0)


def dependence(nugget: X, sill: X) -> Column:
    """Spatial dependence by the nugget's share."""
    share = col(nugget) / (col(nugget) + col(sill))
    return F.when(share <= 0.25, "forte").when(share <= 0.75, "moderada").when(share.isNotNull(), "fraca")


def scale_bar(width: X) -> Column:
    """The largest of 1, 2 or 5 times a power of ten that is a quarter of the width at most."""
    most = col(width) / 4.0
    ten = F.pow(F.lit(10.0), F.floor(F.log10(most)))
    return F.when(5 * ten <= most, 5 * ten).when(2 * ten <= most, 2 * ten).otherwise(ten)
