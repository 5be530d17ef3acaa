"""Universal transverse Mercator on WGS 84 as Columns, by the series in the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeledger.functions.hazard import let

#: Fixed values of the ellipsoid and the projection.
A, FLATTENING, SCALE, EAST, NORTH = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)


def zone_of(lon: Column) -> Column:
    """Zone 1 to 60 of a longitude from -180 to 180; 180 itself is in zone 60."""
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def _meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def to_utm(lat: Column, lon: Column, zone: Column | None = None) -> Column:
    """Struct (easting, northing, zone) in metres; zone forces a zone, by default the place's own. South of the equator northings count from 10,000 km.

    Within a few degrees of the zone's meridian the series is good to less than a millimetre. Null places give null.
    """
    z = zone_of(lon) if zone is None else zone
    s = F.sin(F.radians(lat))
    turned = F.radians(lon - _meridian(z))
    up = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))

    def place(t):
        xi, eta = F.atan2(t, F.cos(turned)), F.atanh(F.sin(turned) / F.sqrt(1 + t * t))
        x = sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1)), eta)
        y = sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1)), xi)
        return F.struct((EAST + SCALE * RADIUS * x).alias("easting"), (F.when(lat < 0, NORTH).otherwise(0.0) + SCALE * RADIUS * y).alias("northing"), z.alias("zone"))

    return F.when(lat.isNotNull() & lon.isNotNull(), let(up, place))


def from_utm(easting: Column, northing: Column, zone: Column, northern: Column | bool = True) -> Column:
    """Struct (lat, lon) in degrees of a place of a zone; northern: whether northings count from the equator."""
    north = F.lit(northern) if isinstance(northern, bool) else northern
    xi = (northing - F.when(north, 0.0).otherwise(NORTH)) / (SCALE * RADIUS)
    eta = (easting - EAST) / (SCALE * RADIUS)
    x = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BACK, 1)), F.lit(0.0))
    y = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BACK, 1)), F.lit(0.0))

    def place(c):
        """From the conformal latitude to the geographic one by Newton's steps on its tangent."""
        lat_c = F.asin(F.sin(c["x"]) / F.cosh(c["y"]))
        lon = _meridian(zone) + F.degrees(F.atan2(F.sinh(c["y"]), F.cos(c["x"])))

        def steps(chi, phi=None, left=4):
            phi = chi if phi is None else phi
            if not left:
                return phi
            # isometric latitude is what both have in common
            nxt = F.asin(F.tanh(F.atanh(F.sin(chi)) + ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi))))
            return let(nxt, lambda p: steps(chi, p, left - 1))

        return let(lat_c, lambda chi: F.struct(F.degrees(steps(chi)).alias("lat"), lon.alias("lon")))

    return let(F.struct(x.alias("x"), y.alias("y")), place)
