"""Scalar column expressions (F1-F23). All are built-in Spark expressions: they stay inside
whole-stage codegen and need no Python at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's) -------------------------------------------
# Seasons by month: 12, 1, 2 Winter; 3-5 Spring; 6-8 Summer; 9-11 Fall.
SEASONS = ["Winter", "Spring", "Summer", "Fall"]
# Display order of seasons in the seasonal reports.
SEASON_ORDER = ["Spring", "Summer", "Fall", "Winter"]
# Compass labels of the normals' direction codes 1..8.
COMPASS_8 = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
# Time-of-day bins, left-closed bounds 0, 6, 12, 18, 24, with these labels.
TIME_BINS = [(0, 6, "Night"), (6, 12, "Morning"), (12, 18, "Afternoon"), (18, 24, "Early Morning")]
# Sector colours of a direction: North, East, South, West, and white for none.
SECTOR_COLOURS = {"N": "#007bff", "E": "#dc3545", "S": "#ffc107", "W": "#28a745", None: "#ffffff"}
# Blended direction colour: RGB of the four cardinal directions (0, 90, 180, 270 degrees).
# ---- fixed values: the palette of the wind tables' speed column
SPEED_PALETTE = ("#f8f9fa", "#adb5bd", "#6c757d")
CARDINAL_RGB = [(0, (0.2, 0.4, 0.9)), (90, (0.9, 0.3, 0.3)), (180, (0.9, 0.9, 0.2)), (270, (0.3, 0.8, 0.3))]
# Condition-code groups (4 classes).
CONDITION_4 = {
    "Clear": [1, 2],
    "Cloudy": [3, 4, 5, 6],
    "Rain": [7, 8, 9, 10, 11, 12, 13, 17, 18, 19, 20],
    "Snow": [14, 15, 16, 21, 22],
}
# Condition-code groups (6 classes + Unknown for null + Other).
CONDITION_7 = {
    "Clear": [1, 2],
    "Cloudy/Foggy": [3, 4, 5, 6],
    "Rain": [7, 8, 9, 17],
    "Cold Precip": [10, 11, 12, 13, 14, 15, 16, 19, 21],
    "Extreme": [18, 20, 22, 23, 24, 25, 26, 27],
}
# Beaufort upper bounds (km/h): below bound i -> force i; at or above the last -> 12.
BEAUFORT_KMH = [1, 5.5, 11.9, 19.3, 28.7, 38.9, 49.9, 61.8, 74.6, 88.1, 102.4, 117.4]
# Unit factors.
KMH_TO_MPH = 0.621371
MS_TO_MPH = 2.236936
# --------------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# rounding as NumPy/pandas do it: half-even on the binary value, rint(x * 10^d) / 10^d
def round_half_even(x, digits: int) -> Column:
    f = float(10 ** digits)
    return F.rint(_c(x) * F.lit(f)) / F.lit(f)


# F1 -- timestamps from text ("MM-DDTHH:MM:SS" prefixed with the leap year 2000)
def parse_normals_date(text, year_prefix: str = "2000-", strict: bool = False) -> Column:
    s = F.concat(F.lit(year_prefix), _c(text))
    return F.to_timestamp(s) if strict else F.try_to_timestamp(s)


# F3 -- date from year, month, day; invalid -> null
def make_date_safe(y, m, d) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", _c(y).cast("int"), _c(m).cast("int"),
                                         _c(d).cast("int")), "yyyy-MM-dd")


# F4 -- difference in hours
def hours_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(3600000000e0)


# F5 -- season
def season(month) -> Column:
    m = _c(month)
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.between(3, 5), "Spring")
            .when(m.between(6, 8), "Summer").when(m.between(9, 11), "Fall"))


def season_position(label) -> Column:
    lab = _c(label)
    out = None
    for i, s in enumerate(SEASON_ORDER):
        out = (F.when(lab == s, i) if out is None else out.when(lab == s, i))
    return out


# F6 -- time-of-day bin (left-closed)
def time_bin(hour) -> Column:
    h = _c(hour)
    out = None
    for lo, hi, lab in TIME_BINS:
        cond = (h >= lo) & (h < hi)
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


# F7 -- compass label of a code 1..8; anything else -> null
def compass_label(code) -> Column:
    m = F.create_map(*[x for i, lab in enumerate(COMPASS_8, start=1) for x in (F.lit(i), F.lit(lab))])
    return F.try_element_at(m, _c(code).cast("int"))


def compass_position(label) -> Column:
    lab = _c(label)
    out = None
    for i, s in enumerate(COMPASS_8):
        out = F.when(lab == s, i) if out is None else out.when(lab == s, i)
    return out


# F8 -- unit conversions
def c_to_f(t) -> Column:
    return _c(t) * 9 / 5 + 32


def kmh_to_mph(v, factor: float = KMH_TO_MPH) -> Column:
    return _c(v) * F.lit(factor)


def tenths(v) -> Column:
    return _c(v) / F.lit(10e0)


# F9 -- wind vector (the direction the wind blows towards)
def wind_u(wspd, wdir) -> Column:
    return _c(wspd) * F.sin(F.radians(_c(wdir) + 180))


def wind_v(wspd, wdir) -> Column:
    return _c(wspd) * F.cos(F.radians(_c(wdir) + 180))


# F11 -- cyclic encoding of a periodic value
def cyclic_sin(x, period: float) -> Column:
    return F.sin(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


def cyclic_cos(x, period: float) -> Column:
    return F.cos(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


# F12 -- compass sector of a direction (N >= 315 or < 45, E < 135, S < 225, else W)
def direction_sector(deg) -> Column:
    d = F.pmod(_c(deg), F.lit(360.0))
    return (F.when(d.isNull(), None).when((d >= 315) | (d < 45), "N").when(d < 135, "E")
            .when(d < 225, "S").otherwise("W"))


def sector_colour(deg) -> Column:
    s = direction_sector(deg)
    out = F.when(s.isNull(), SECTOR_COLOURS[None])
    for k in ("N", "E", "S", "W"):
        out = out.when(s == k, SECTOR_COLOURS[k])
    return out


# F13 -- colour blended towards the nearest cardinal direction
def _ang_dist(d: Column, a: float) -> Column:
    x = F.abs(F.lit(float(a)) - d)
    return F.least(x, F.lit(360.0) - x)


def direction_blend_colour(deg) -> Column:
    d = F.pmod(_c(deg), F.lit(360.0))
    dists = [_ang_dist(d, a) for a, _ in CARDINAL_RGB]
    m = F.least(*dists)
    w = F.lit(0.1) + (F.lit(1.0) - m / F.lit(45.0)) * F.lit(0.9)
    channels = []
    for ch in range(3):
        val = None
        # nearest cardinal; on equal distance the first in 0, 90, 180, 270 order wins
        for i in reversed(range(len(CARDINAL_RGB))):
            c = F.lit(CARDINAL_RGB[i][1][ch])
            val = c if val is None else F.when(dists[i] == m, c).otherwise(val)
        channels.append(F.floor((w * val + (F.lit(1.0) - w)) * F.lit(255.0)).cast("int"))
    hexed = F.format_string("#%02x%02x%02x", *channels)
    return F.when(d.isNull() | (m == 45), F.lit("#ffffff")).otherwise(hexed)


# F14 -- position of a value in [lo, hi] (0..1), for colour scales
def scale_position(x, lo, hi) -> Column:
    return F.try_divide(_c(x) - lo, F.lit(hi) - F.lit(lo) if not isinstance(hi, Column) else hi - lo)


# F14 -- colour of a position in [0, 1] on a palette of any number of stops
def palette_mix(position, stops) -> Column:
    """Colour as ``#rrggbb``, mixed linearly between the two ``stops`` (hex colours) around ``position``; positions outside [0, 1] take the
    end colours. Null where the position is null or NaN."""
    rgb = [[int(s[i:i + 2], 16) for i in (1, 3, 5)] for s in stops]
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(position))) * F.lit(float(max(1, len(rgb) - 1)))
    at = F.least(F.floor(x), F.lit(max(0, len(rgb) - 2))).cast("int")
    part = x - at
    mixed = []
    for ch in range(3):
        low = F.element_at(F.array(*[F.lit(float(c[ch])) for c in rgb]), at + 1)
        high = F.element_at(F.array(*[F.lit(float(c[ch])) for c in rgb]), F.least(at + 2, F.lit(len(rgb))))
        mixed.append(F.rint(low + part * (high - low)).cast("int"))
    known = _c(position).isNotNull() & ~F.isnan(_c(position))
    return F.when(known, F.format_string("#%02x%02x%02x", *mixed))


# F15 -- percent label
def percent_label(p) -> Column:
    return F.format_string("%.1f%%", _c(p))


# F16 / F17 -- condition groups
def condition_group_4(code) -> Column:
    c = _c(code)
    out = None
    for lab, codes in CONDITION_4.items():
        out = F.when(c.isin(codes), lab) if out is None else out.when(c.isin(codes), lab)
    return out


def condition_group_7(code) -> Column:
    c = _c(code)
    out = F.when(c.isNull(), "Unknown")
    for lab, codes in CONDITION_7.items():
        out = out.when(c.isin(codes), lab)
    return out.otherwise("Other")


# F18 -- Beaufort force
def beaufort(wspd) -> Column:
    w = _c(wspd)
    out = None
    for i, b in enumerate(BEAUFORT_KMH):
        out = F.when(w < b, i) if out is None else out.when(w < b, i)
    return out.otherwise(12)


# F21 -- chart vector of a (speed, direction) pair with arrow heads
def chart_vector(speed, direction, arrow: float = 0.8) -> dict[str, Column]:
    r = F.radians(F.pmod(_c(direction) - 90, F.lit(360.0)))
    dx = -_c(speed) * F.cos(r)
    dy = _c(speed) * F.sin(r)
    a1 = r + F.lit(math.pi * 5 / 6)
    a2 = r - F.lit(math.pi * 5 / 6)
    return {
        "dx": dx, "dy": dy,
        "arrow1_end_x": dx - F.lit(arrow) * F.cos(a1), "arrow1_end_y": dy + F.lit(arrow) * F.sin(a1),
        "arrow2_end_x": dx - F.lit(arrow) * F.cos(a2), "arrow2_end_y": dy + F.lit(arrow) * F.sin(a2),
    }


# F22 -- arrow ends on a map
def arrow_end(base, delta, scale: float = 0.5) -> Column:
    return _c(base) + _c(delta) * F.lit(scale)
