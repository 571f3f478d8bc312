"""From model outputs to levels with bounds, alerts and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalar import Z_95, alert_message, clip_zero
from .features import last_n


def ensemble_summary(samples: DataFrame, keys: list[str] = ["run_id", "horizon"], value: str = "value") -> DataFrame:  # noqa: B006
    """Mean and population standard deviation over the samples."""
    return samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def z_interval(df: DataFrame, mean: str = "mean", std: str = "std", z: float = Z_95) -> DataFrame:
    return df.withColumn("lower", F.col(mean) - z * F.col(std)).withColumn("upper", F.col(mean) + z * F.col(std))


def forecast_accumulate(
    deltas: DataFrame, keys: list[str] = ["run_id"], order: str = "horizon",
    cols: tuple[str, ...] = ("delta", "lower", "upper"), prior: str = "prior",
) -> DataFrame:  # noqa: B006
    """Level = prior + running sum of deltas, step by step for each bound; values below 0 become 0 afterwards."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumns({c: clip_zero(F.col(prior) + F.sum(c).over(w)) for c in cols})


def rescale_forecast(
    deltas: DataFrame, stats: DataFrame, prior: DataFrame, keys: list[str] = ["run_id"], order: str = "horizon",
    time: str = "date",
) -> DataFrame:  # noqa: B006
    """Scaled deltas with std to levels with 95 % bounds: interval, unscaling by month-day, accumulation from the prior
    level, floor at 0. Bounds centre on the plain prediction."""
    bounded = z_interval(deltas, "delta", "std")
    seasonal = stats.select(*[c for c in stats.columns if c in (*keys, "month_day")], F.col("mean").alias("__m"), F.col("std").alias("__s"))
    on = [c for c in seasonal.columns if c not in ("__m", "__s")]
    rows = bounded.withColumn("month_day", cal.month_day(time)).join(seasonal, on).join(prior.select(*keys, "prior"), keys)
    scaled = rows.withColumns({c: F.col(c) * F.col("__s") + F.col("__m") for c in ("delta", "lower", "upper")})
    out = forecast_accumulate(scaled, keys, order)
    return out.select(*keys, order, time, F.col("delta").alias("level"), F.col("lower").alias("lower_bound_95"), F.col("upper").alias("upper_bound_95"))


def peak_forecast(forecast: DataFrame, keys: list[str] = ["run_id"], time: str = "date", value: str = "level") -> DataFrame:  # noqa: B006
    """The largest value of each run and its date, the first on ties."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.unix_date(F.col(time).cast("date"))).alias("d")))
    return forecast.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias("peak"), F.date_from_unix_date((-F.col("b.d")).cast("int")).alias("peak_date"))


def flood_alert(
    history: DataFrame, forecast: DataFrame, keys: list[str] = ["run_id"], as_of: Column | None = None, n: int = 18,
    threshold: float = 0.05, value: str = "value", level: str = "level",
) -> DataFrame:  # noqa: B006
    """Per key: the least of the last n values by date, the forecast's peak, the rise between, whether it exceeds the
    threshold, and the sentence of the alert (null without one)."""
    low = last_n(history, keys, n=n).groupBy(*keys).agg(F.min(value).alias("season_min"), F.max("date").alias("last_date"))
    rows = peak_forecast(forecast, keys, value=level).join(low, keys).withColumn("rise", F.col("peak") - F.col("season_min"))
    fired = F.col("rise") > threshold
    said = alert_message(F.col("last_date") if as_of is None else as_of, F.col("peak"), F.col("peak_date"), F.col("rise"), F.col("season_min"))
    return rows.withColumn("alert", fired).withColumn("message", F.when(fired, said))


def forecast_loss(
    pairs: DataFrame, keys: list[str] = ["run_id"], truth: str = "truth", predicted: str = "predicted",
    sign_weight: float = 20.0, sum_weight: float = 0.1,
) -> DataFrame:  # noqa: B006
    """Mean squared error times the mean sign penalty, plus the weighted mean squared difference of sequence sums. Two
    levels: sums per sequence, then one row."""
    e = F.col(truth) - F.col(predicted)
    penalty = F.when(F.signum(truth) != F.signum(predicted), F.lit(sign_weight)).otherwise(F.lit(1.0))
    per = pairs.groupBy(*keys).agg(F.sum(e * e).alias("se"), F.sum(penalty).alias("p"), F.count("*").alias("n"), F.sum(e).alias("d"))
    total = per.agg((F.sum("se") / F.sum("n")).alias("mse"), (F.sum("p") / F.sum("n")).alias("sign_penalty"), F.avg(F.col("d") * F.col("d")).alias("sum_penalty"))
    return total.withColumn("loss", F.col("mse") * F.col("sign_penalty") + sum_weight * F.col("sum_penalty"))


def forecast_metrics(pairs: DataFrame, keys: list[str] = [], truth: str = "truth", predicted: str = "predicted") -> DataFrame:  # noqa: B006
    e = F.col(truth) - F.col(predicted)
    return pairs.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def focal_loss(
    pixels: DataFrame, size: int, gamma: float = 3.0, alpha: float = 0.95, border: int = 4, truth: str = "truth",
    p: str = "p", epsilon: float = 1e-7,
) -> DataFrame:
    """Mean focal loss over the pixels of patches without their rim."""
    inner = pixels.where(f"y between {border} and {size - border - 1} and x between {border} and {size - border - 1}")
    q = F.least(F.greatest(F.col(p), F.lit(epsilon)), F.lit(1 - epsilon))
    t = F.col(truth)
    hit = t * q + (1 - t) * (1 - q)
    weight = t * alpha + (1 - t) * (1 - alpha)
    return inner.agg(F.avg(-weight * F.pow(1 - hit, F.lit(gamma)) * F.ln(hit)).alias("focal_loss"))


def latest_run(runs: DataFrame, by: str = "run_end", run: str = "run_id") -> DataFrame:
    """The newest run by the end of its forecast, one row."""
    return runs.groupBy().agg(F.max_by(run, F.struct(by, run)).alias(run), F.max(by).alias(by))
