"""Meteorological formulas as single Spark column expressions.

Constants are the reference's (kept as given, including the mixed units it uses: the heat
index polynomial is fed degrees C, vapour pressure is kPa against pressure in hPa).
Divisions that can hit zero use ``try_divide`` (null instead of an ANSI error).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sat_vapor_press(t) -> Column:
    """kPa, Magnus form: 0.6112 * exp(17.67 t / (t + 243.5))."""
    return F.lit(0.6112) * F.exp(F.try_divide(F.lit(17.67) * _c(t), _c(t) + F.lit(243.5)))


def actual_vapor_press(svp, rhum) -> Column:
    return _c(svp) * _c(rhum) / F.lit(100.0)


def wet_bulb(t, rh) -> Column:
    t, rh = _c(t), _c(rh)
    return (t * F.atan(F.lit(0.151977) * F.pow(rh + F.lit(8.313659), F.lit(0.5)))
            + F.atan(t + rh) - F.atan(rh - F.lit(1.676331))
            + F.lit(0.00391838) * F.pow(rh, F.lit(1.5)) * F.atan(F.lit(0.023101) * rh)
            - F.lit(4.686035))


def wind_chill(t, w) -> Column:
    t, w = _c(t), _c(w)
    p = F.pow(w, F.lit(0.16))
    return F.when(t <= 10, F.lit(13.12) + F.lit(0.6215) * t - F.lit(11.37) * p + F.lit(0.3965) * t * p).otherwise(t)


def heat_index_advanced(t, h) -> Column:
    t, h = _c(t), _c(h)
    poly = (F.lit(-42.379) + F.lit(2.04901523) * t + F.lit(10.14333127) * h - F.lit(0.22475541) * t * h
            - F.lit(0.00683783) * t * t - F.lit(0.05481717) * h * h + F.lit(0.00122874) * t * t * h
            + F.lit(0.00085282) * t * h * h - F.lit(0.00000199) * t * t * h * h)
    return F.when(t >= 26, poly).otherwise(t)


def mixing_ratio(avp, pres) -> Column:
    return F.try_divide(F.lit(0.622) * _c(avp), _c(pres) - _c(avp))


def potential_temp(t, pres) -> Column:
    return _c(t) * F.pow(F.try_divide(F.lit(1000.0), _c(pres)), F.lit(0.286))


def solar_elevation(lat, lon, ts) -> Column:
    """Degrees above the horizon from latitude, longitude and the (UTC) timestamp."""
    doy = F.dayofyear(_c(ts))
    ha = F.lit(15) * (F.hour(_c(ts)) - 12) + _c(lon)
    decl = F.lit(23.45) * F.sin(F.radians(F.lit(360) * (F.lit(284) + doy) / F.lit(365)))
    la, de, hr = F.radians(_c(lat)), F.radians(decl), F.radians(ha)
    return F.degrees(F.asin(F.sin(la) * F.sin(de) + F.cos(la) * F.cos(de) * F.cos(hr)))


def solar_intensity(elev) -> Column:
    return F.greatest(F.lit(0.0), F.sin(F.radians(_c(elev))))


def simple_heat_index(t, rhum) -> Column:
    """M1 heat index: t + 0.5 * (rhum / 100) * (t - 14.5)."""
    return _c(t) + F.lit(0.5) * (_c(rhum) / F.lit(100)) * (_c(t) - F.lit(14.5))


TWO_PI = 2 * math.pi
