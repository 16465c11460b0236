"""Forecasting end to end: checks of the time column, time split, lagged rows, candidates, ranking, errors by step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import filters, metrics as M, models as K, screens as S, splits as L
from tablegauge.session import staged


@dataclass
class ForecastResult:
    """``status`` is completed, failed (no candidate could be fitted) or blocked; ``reason`` says why."""

    status: str
    reason: str | None
    chronology: DataFrame
    runs: DataFrame | None = None
    ranking: DataFrame | None = None
    errors: DataFrame | None = None
    best: str | None = None
    models: dict | None = None


def forecast_table(df: DataFrame, target: str, time: str, series: list[str] = (), lags: tuple[int, ...] = (1, 2, 3),
                   windows: tuple[int, ...] = (7,), horizon: int = 6, parts: tuple[str, ...] = (),
                   shares: tuple[float, float, float] = L.SHARES, candidates: list[K.Candidate] | None = None,
                   parallelism: int = 4) -> ForecastResult:
    """Forecast ``target`` of each series from its own past.

    Cut times come from the times of all rows. A training row predicts a value inside the training stretch, so nothing later is
    seen; candidates are compared on one-step rows that begin behind the validation stretch, and the best one is rolled
    forward from each of those origins that ``horizon`` known values follow. ``errors``: (step, n, rmse). Rows without target or
    time take no part; a series may have gaps, as steps are rows.
    """
    series = list(series)
    rows = filters.with_target(df, target).where(C.quote(time).isNotNull()).select(*map(C.quote, [*series, time, target]))
    order = C.settle(L.chronology(rows, time, series))
    facts = order.first()
    blocked = lambda reason: ForecastResult("blocked", reason, order)
    if not facts["usable"]:
        return blocked("the time column cannot order the rows")
    if facts["repeated_times"] and not series:
        return blocked("times repeat and no series column tells the rows apart")
    split = L.time_holdout(rows, time, shares).groupBy("split").agg(F.max(C.quote(time)).alias("last"))
    ends = {r["split"]: r["last"] for r in split.collect()}  # three stretches
    if "train" not in ends or "test" not in ends:
        return blocked("too few times for a training and a test stretch")
    reach = max([*lags, *windows])
    frame = staged(K.forecast_frame(rows, target, time, series, reach, horizon), "origins")
    known, next_time = F.size("future") >= 1, F.get("future", F.lit(0))["t"]
    behind = F.col("origin") > F.lit(ends.get("validation", ends["train"]))
    row_id = F.xxhash64(*[C.quote(c) for c in series], "origin")

    def one_step(part: DataFrame) -> DataFrame:
        return K.one_step_rows(part.withColumn("row_id", row_id), lags, windows, reach, parts, keep=("row_id",))

    train = staged(one_step(frame.where(known & (next_time <= F.lit(ends["train"])))), "train")
    test = one_step(frame.where(known & behind))
    n = train.count()
    if n < 2 or test.isEmpty():
        return blocked(f"{n} training rows have {reach} earlier values, and the test stretch needs one at least")
    if candidates is None:
        families = K.families(S.FORECASTING, n, len(lags) + 2 * len(windows) + len(parts), True)
        candidates = [c for c in K.baselines(S.FORECASTING, len(lags)) if c.family in families]
    runs, models = K.train_candidates(train, test, S.FORECASTING, candidates, parallelism=parallelism)
    ranking = M.rank_runs(runs, S.FORECASTING)
    # neighbours have no stages to roll forward with
    usable = [r["candidate"] for r in ranking.where("rank is not null").orderBy("rank").collect()
              if not isinstance(models[r["candidate"]], K.NeighbourModel)]
    if not usable:
        return ForecastResult("failed", "no candidate was fitted", order, runs, ranking)
    rolled = K.recursive_forecast(models[usable[0]], frame.where(behind), horizon, lags, windows, reach, parts)
    return ForecastResult("completed", None, order, runs, ranking, K.horizon_errors(rolled, horizon), usable[0], models)
