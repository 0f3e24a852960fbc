"""Climate cells to daily, weekly and lagged features by area, and to long-period site climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careshed.operators.moments import exact_quantiles

from careshed.functions.scalars import LAG_DAYS, celsius, evaporation_mm, heat_index, wind_speed


def zonal_mean(values: DataFrame, members: DataFrame, area: str, time: str, columns: list[str]) -> DataFrame:
    """Means over the cells of each area (members: area, cell_id) at each time."""
    return values.join(members.select(area, "cell_id"), "cell_id").groupBy(area, time).agg(*[F.avg(c).alias(c) for c in columns])


def hourly_to_daily(hourly: DataFrame, area: str = "hsa_id", time: str = "ts") -> DataFrame:
    """Temperature in Celsius (mean, least, greatest, range), hours over 30 and 35, dew point, heat index, wind, evaporation."""
    h = hourly.select(F.col(area), F.to_date(time).alias("obs_day"), celsius(F.col("t_k")).alias("t"), celsius(F.col("td_k")).alias("td"), F.col("u10"), F.col("v10"), F.col("lhf"))
    return h.groupBy(area, "obs_day").agg(
        F.avg("t").alias("t_mean"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
        (F.max("t") - F.min("t")).alias("dtr"),
        F.sum(F.when(F.col("t") > 30, 1).otherwise(0)).alias("hours_above_30"),
        F.sum(F.when(F.col("t") > 35, 1).otherwise(0)).alias("hours_above_35"),
        F.avg("td").alias("td_mean"),
        heat_index(F.avg("t"), F.avg("td")).alias("heat_index"),
        wind_speed(F.avg("u10"), F.avg("v10")).alias("wind"),
        evaporation_mm(F.avg("lhf")).alias("evap_mm"),
    )


def _week(day: str):
    return F.to_date(F.date_trunc("week", day))


def daily_to_weekly(daily: DataFrame, area: str = "hsa_id", day: str = "obs_day", rain: str = "precip_mm", fill: bool = True) -> DataFrame:
    """Weekly rain: mean, sum, greatest day, share of wet days (> 1 mm), days over 10 mm, 95th percentile."""
    d = daily.withColumn("__p", F.coalesce(rain, F.lit(0.0)) if fill else F.col(rain))
    return d.groupBy(area, _week(day).alias("week_start")).agg(
        F.avg("__p").alias("p_mean"),
        F.sum("__p").alias("p_total"),
        F.max("__p").alias("p_max_day"),
        F.avg((F.col("__p") > 1).cast("double")).alias("wetday_frac"),
        F.sum((F.col("__p") > 10).cast("long")).alias("heavy_days"),
        F.percentile("__p", F.lit(0.95)).alias("p95"),
    )


def day_lags(daily: DataFrame, value: str, area: str = "hsa_id", day: str = "obs_day", lags: tuple[int, ...] = LAG_DAYS, prefix: str = "d") -> DataFrame:
    """For each area and week the value k days before its Monday.

    Each day is sent to the weeks it serves (at most one for each lag) and one aggregation by week gathers them.
    """
    k = F.explode(F.array(*[F.lit(x) for x in lags])).alias("k")
    sent = daily.select(area, F.col(day).alias("__d"), F.col(value).alias("__v"), k).withColumn("week_start", F.date_add("__d", F.col("k")))
    sent = sent.where(F.dayofweek("week_start") == 2)  # only Mondays begin weeks
    weeks = daily.select(area, _week(day).alias("week_start")).distinct()
    got = sent.groupBy(area, "week_start").agg(*[F.avg(F.when(F.col("k") == x, F.col("__v"))).alias(f"{prefix}_{x}") for x in lags])
    return weeks.join(got, [area, "week_start"], "left")


def week_lags(weekly_source: DataFrame, area: str = "hsa_id", day: str = "obs_day", rain: str = "precip_mm", weeks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Sum, mean and days over 10 mm of the weeks 1, 2 and 3 before each week that has data."""
    base = weekly_source.groupBy(area, _week(day).alias("week_start")).agg(F.sum(rain).alias("s"), F.avg(rain).alias("m"), F.sum((F.col(rain) > 10).cast("long")).alias("h"))
    sent = base.select(area, "s", "m", "h", F.explode(F.array(*[F.lit(w) for w in weeks])).alias("w"), "week_start").withColumn("week_start", F.date_add("week_start", F.col("w") * 7))
    wide = sent.groupBy(area, "week_start").agg(*[F.max(F.when(F.col("w") == w, F.col(c))).alias(f"p_{n}_w{w}") for w in weeks for c, n in (("s", "sum"), ("m", "mean"), ("h", "heavy"))])
    return base.select(area, "week_start").join(wide, [area, "week_start"], "left")


def water_deficit(weekly_rain: DataFrame, weekly_evap: DataFrame, area: str = "hsa_id") -> DataFrame:
    return weekly_evap.join(weekly_rain, [area, "week_start"]).select(area, "week_start", (F.col("evap_total") - F.col("p_total")).alias("water_deficit"))


def own_quantile(daily: DataFrame, area: str, rain: str, share: float = 0.95, name: str = "p95") -> DataFrame:
    """(area, p95) of each area's own days; an area's days may lie in any number of tasks. Null for an area without rain data."""
    found = exact_quantiles(daily, [rain], [share], area).select(area, F.col("value").alias(name))
    return daily.select(area).distinct().join(found, area, "left")


def threshold_days(daily: DataFrame, area: str = "hsa_id", rain: str = "precip_mm", hot: str = "t_max_c", years: float = 1.0) -> DataFrame:
    """Share of wet days, days a year over 10 and 20 mm, at or over the area's own 95th percentile, and over 35 degrees."""
    d = daily.join(own_quantile(daily, area, rain), area)
    p, t = F.col(rain), F.col(hot)
    return d.groupBy(area).agg(
        F.avg((p > 1).cast("double")).alias("wetday_frac"),
        (F.sum((p > 10).cast("long")) / years).alias("heavy10_per_year"),
        (F.sum((p > 20).cast("long")) / years).alias("heavy20_per_year"),
        (F.sum((p >= F.col("p95")).cast("long")) / years).alias("p95_days_per_year"),
        (F.sum((t > 35).cast("long")) / years).alias("hot_days_per_year"),
        F.first("p95").alias("p95_mm"),
    )


def climatology(daily: DataFrame, hourly_daily: DataFrame, area: str = "hsa_id") -> DataFrame:
    """Long-period means and totals of an area from its daily tables."""
    rain = daily.groupBy(area).agg(F.avg("precip_mm").alias("p_mean_mm"), F.sum("precip_mm").alias("p_total_mm"), F.avg("t_max_c").alias("t_max_mean"), F.avg("t_min_c").alias("t_min_mean"), (F.avg("t_max_c") - F.avg("t_min_c")).alias("dtr_mean"))
    air = hourly_daily.groupBy(area).agg(F.avg("t_mean").alias("t_mean"), F.avg("td_mean").alias("dewpoint"), F.avg("wind").alias("wind"), F.sum("evap_mm").alias("evap_mm"))
    return rain.join(air, area, "left").withColumn("balance_mm", F.col("p_total_mm") - F.col("evap_mm"))


def time_range(table: DataFrame, time: str, first: str, last: str, columns: list[str]) -> DataFrame:
    return table.where((F.col(time) >= F.lit(first).cast("timestamp_ntz")) & (F.col(time) < F.lit(last).cast("timestamp_ntz"))).select(*columns)
