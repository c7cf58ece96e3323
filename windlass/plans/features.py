"""Station time-series features: differences, rolling windows, global-threshold
flags, the lag block and the meteorological set -- the classifier's 171 features.

Every W-operator uses the same window, over (station, day) pieces that carry the rows before them, so Spark plans one
exchange and one sort for all of them, and no station is one task. Global means/quantiles are computed once as a
one-row aggregate and enter the row expressions as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions import met
from windlass.functions.scalar import beaufort, condition_group_4, cyclic_cos, cyclic_sin
from windlass.operators.aggregates import global_scalars
from windlass.operators.joins import maybe_broadcast
from windlass.operators.quantiles import global_quantiles_many
from windlass.operators.pieces import own_rows, piece_window, with_halo
from windlass.operators.reshape import drop_any_null
from windlass.operators.sequence import mean_of, ref, std_of, with_lags
from windlass.operators.temporal import rolling_mean, rolling_std
from windlass.session import wide_plan_mode

RAW = ["temp", "dwpt", "rhum", "wdir", "wspd", "pres"]
DIFF_COLS = ["pres", "rhum", "wspd", "temp", "dwpt"]
TREND_COLS = {"pressure_trend": "pres", "dwpt_trend": "dwpt", "temp_trend": "temp"}
VOLATILITY_COLS = {"humidity_volatility": "rhum", "wind_consistency": "wspd", "temp_volatility": "temp"}
LAGS = [1, 2, 3]


def global_thresholds(obs: DataFrame) -> dict[str, float]:
    """Means and 0.1/0.9 quantiles over all rows."""
    g = global_scalars(obs, {"pres_mean": F.avg("pres"), "temp_mean": F.avg("temp")})
    q = global_quantiles_many(obs, {"pres": [0.1], "wspd": [0.9], "temp": [0.1, 0.9]})
    (g["pres_q10"],), (g["wspd_q90"],), (g["temp_q10"], g["temp_q90"]) = q["pres"], q["wspd"], q["temp"]
    return g


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


class LagColumns:
    """Row offsets read from ``{col}_lag{j}`` columns (after ``with_lags``), shifted by ``shift``
    rows -- evaluating the formulas with shift k gives the derived columns k rows back."""

    def __init__(self, shift: int = 0):
        self.shift = shift

    def lag(self, c: str, j: int) -> Column:
        return ref(c, j + self.shift)

    def mean3(self, c: str) -> Column:
        return mean_of([self.lag(c, 0), self.lag(c, 1), self.lag(c, 2)])

    def std3(self, c: str) -> Column:
        return std_of([self.lag(c, 0), self.lag(c, 1), self.lag(c, 2)])


class WindowColumns:
    """The same accessors as native window functions over a window ``w``."""

    def __init__(self, w):
        self.w = w

    def lag(self, c: str, j: int) -> Column:
        return F.col(c) if j == 0 else F.lag(c, j).over(self.w)

    def mean3(self, c: str) -> Column:
        return rolling_mean(c, self.w)

    def std3(self, c: str) -> Column:
        return rolling_std(c, self.w)


def derived_columns(g: dict[str, float], acc=None) -> dict[str, Column]:
    """M1: the 30 derived columns, in the reference's order, through an accessor for row
    offsets and 3-row rolling statistics (``LagColumns`` or ``WindowColumns``)."""
    acc = acc or LagColumns()
    r = acc.lag
    lit = F.lit

    def k(v):
        return lit(v).cast("double")

    temp, dwpt, rhum, wspd, pres = r("temp", 0), r("dwpt", 0), r("rhum", 0), r("wspd", 0), r("pres", 0)
    out: dict[str, Column] = {}
    out["pres_change"] = pres - r("pres", 1)
    out["rhum_change"] = rhum - r("rhum", 1)
    out["wspd_change"] = wspd - r("wspd", 1)
    out["pres_rhum_ratio"] = F.try_divide(pres, rhum + lit(0.01))
    out["wspd_rhum_product"] = wspd * rhum
    out["pres_wspd_ratio"] = F.try_divide(pres, wspd + lit(0.01))
    out["rhum_squared"] = F.pow(rhum, 2)
    out["wspd_squared"] = F.pow(wspd, 2)
    out["pres_deviation"] = F.abs(pres - k(g["pres_mean"]))
    out["rhum_extreme"] = _flag(F.coalesce(rhum, lit(0.0)) > 90)
    out["low_pressure"] = _flag(F.coalesce(pres, k(g["pres_mean"])) < k(g["pres_q10"]))
    out["high_wind"] = _flag(F.coalesce(wspd, lit(0.0)) > k(g["wspd_q90"]))
    out["pressure_trend"] = acc.mean3("pres")
    out["humidity_volatility"] = acc.std3("rhum")
    out["wind_consistency"] = acc.std3("wspd")
    out["temp_change"] = temp - r("temp", 1)
    out["dwpt_change"] = dwpt - r("dwpt", 1)
    out["temp_dwpt_spread"] = temp - dwpt
    out["heat_index"] = temp + lit(0.5) * (rhum / lit(100)) * (temp - lit(14.5))
    out["temp_extreme_hot"] = _flag(F.coalesce(temp, k(g["temp_mean"])) > k(g["temp_q90"]))
    out["temp_extreme_cold"] = _flag(F.coalesce(temp, k(g["temp_mean"])) < k(g["temp_q10"]))
    out["temp_pres_ratio"] = F.try_divide(temp, pres / lit(1000) + lit(0.01))
    out["temp_wspd_product"] = temp * wspd
    out["dwpt_rhum_ratio"] = F.try_divide(dwpt, rhum + lit(0.01))
    out["temp_volatility"] = acc.std3("temp")
    out["dwpt_trend"] = acc.mean3("dwpt")
    out["temp_trend"] = acc.mean3("temp")
    out["comfort_index"] = _flag(temp.between(18, 24) & rhum.between(30, 70))
    out["frost_risk"] = _flag((temp <= 2) & (dwpt <= 0))
    out["condensation_risk"] = _flag(F.abs(temp - dwpt) <= 2)
    return out


DERIVED = ["pres_change", "rhum_change", "wspd_change", "pres_rhum_ratio", "wspd_rhum_product",
           "pres_wspd_ratio", "rhum_squared", "wspd_squared", "pres_deviation", "rhum_extreme", "low_pressure",
           "high_wind", "pressure_trend", "humidity_volatility", "wind_consistency", "temp_change", "dwpt_change",
           "temp_dwpt_spread", "heat_index", "temp_extreme_hot", "temp_extreme_cold", "temp_pres_ratio",
           "temp_wspd_product", "dwpt_rhum_ratio", "temp_volatility", "dwpt_trend", "temp_trend", "comfort_index",
           "frost_risk", "condensation_risk"]


def derived_features(obs: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """M1 on every row, by native window functions inside pieces."""
    g = thresholds or global_thresholds(obs)
    return _in_pieces(obs, RAW, derived_columns(g, WindowColumns(piece_window(obs.columns))))


def diff_roll(obs: DataFrame) -> DataFrame:
    """W1 + W4 + W5: differences and 3-row rolling statistics."""
    acc = WindowColumns(piece_window(obs.columns))
    cols = {f"{c}_change": acc.lag(c, 0) - acc.lag(c, 1) for c in DIFF_COLS}
    cols.update({k: acc.mean3(v) for k, v in TREND_COLS.items()})
    cols.update({k: acc.std3(v) for k, v in VOLATILITY_COLS.items()})
    return _in_pieces(obs, DIFF_COLS, cols)


def _in_pieces(obs: DataFrame, raw: Sequence[str], cols: dict[str, Column]) -> DataFrame:
    pieces = with_halo(obs, 2, raw)
    return own_rows(pieces.select(*pieces.columns, *[v.alias(n) for n, v in cols.items()]))


def enhanced_columns(lat: str = "latitude", lon: str = "longitude") -> dict[str, Column]:
    """M2: the 24 time, moisture, comfort and sun features."""
    c = F.col
    out: dict[str, Column] = {}
    out["hour"] = F.hour("time")
    out["hour_sin"] = cyclic_sin(F.hour("time"), 24)
    out["hour_cos"] = cyclic_cos(F.hour("time"), 24)
    out["day_of_year"] = F.dayofyear("time")
    out["season_sin"] = cyclic_sin(F.dayofyear("time"), 365.25)
    out["season_cos"] = cyclic_cos(F.dayofyear("time"), 365.25)
    m = F.month("time")
    out["month"] = m
    out["is_winter"] = _flag((m == 12) | (m <= 2))
    out["is_spring"] = _flag((m >= 3) & (m <= 5))
    out["is_summer"] = _flag((m >= 6) & (m <= 8))
    out["is_fall"] = _flag((m >= 9) & (m <= 11))
    svp = met.sat_vapor_press("temp")
    avp = met.actual_vapor_press(svp, "rhum")
    out["sat_vapor_press"] = svp
    out["actual_vapor_press"] = avp
    out["vapor_pressure_deficit"] = svp - avp
    out["wet_bulb_temp"] = met.wet_bulb("temp", "rhum")
    out["wind_chill"] = met.wind_chill("temp", "wspd")
    out["heat_index_advanced"] = met.heat_index_advanced("temp", "rhum")
    out["mixing_ratio"] = met.mixing_ratio(avp, "pres")
    out["potential_temp"] = met.potential_temp("temp", "pres")
    elev = met.solar_elevation(lat, lon, "time")
    out["solar_elevation"] = elev
    out["is_daylight"] = _flag(elev > 0)
    out["solar_intensity"] = met.solar_intensity(elev)
    out["beaufort_scale"] = beaufort("wspd")
    out["wind_power"] = F.pow(c("wspd"), 3)
    return out


def may_be_null() -> list[str]:
    """Columns of which one is null wherever any of the 36 base columns or their lags is: raw values, the differences that reach furthest
    back, quotients (null where the divisor is 0) and the deviation from a mean. The filter on them costs a part of one on all 144, whose
    expressions Spark would evaluate once for the filter and once for the result."""
    quotients = [c for c in DERIVED if c.endswith("_ratio")]
    lagged = [c if k == 0 else f"{c}_lag{k}" for k in range(max(LAGS) + 1) for c in [*RAW, *quotients]]
    return [*lagged, *[f"{c}_change_lag{max(LAGS)}" for c in DIFF_COLS], "pres_deviation"]


def feature_table(obs: DataFrame, stations: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The classifier's table: 36 base columns (6 raw + 30 derived), their lags 1-3,
    coordinates, 24 enhanced columns and the 4-class label (codes 23-27 removed).

    Only the 6 raw columns are shifted (lags 1-5, one window pass over pieces): a
    derived column k rows back is its formula on the raw values shifted by k.
    """
    wide_plan_mode(obs.sparkSession)
    g = thresholds or global_thresholds(obs)
    base = obs.select("station", "time", *RAW, "coco")
    lagged = with_lags(base, RAW, [1, 2, 3, 4, 5])
    cols: dict[str, Column] = {}
    for k in range(0, max(LAGS) + 1):
        acc = LagColumns(shift=k)
        block = {c: acc.lag(c, 0) for c in RAW}
        block.update(derived_columns(g, acc))
        for name, expr in block.items():
            cols[name if k == 0 else f"{name}_lag{k}"] = expr
    # the place joins the raw values, and as a broadcast where it may: the wide rows are never shuffled
    place = ["latitude", "longitude", "elevation"]
    j = lagged.join(maybe_broadcast(stations.select("station", *place)), "station", "left")
    own = ["station", "time", "coco"]
    wide = drop_any_null(j.select(*own, *[v.alias(n) for n, v in cols.items()], *place), [*own, *may_be_null()])
    e = wide.withColumns(enhanced_columns())
    e = e.filter(~F.col("coco").isin(23, 24, 25, 26, 27))
    return e.withColumn("condition", condition_group_4("coco"))


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("station", "time", "coco", "condition")]
