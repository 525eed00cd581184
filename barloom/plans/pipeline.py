"""Stages in order, each from tables to a table: selection, plan and run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import bars as B
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import targets as T

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Tables], DataFrame]
    enabled: bool = True


@dataclass
class Pipeline:
    """Runs stages in order; each adds a table under its name."""

    stages: list[Stage]
    done: list[str] = field(default_factory=list)

    def plan(self, only: str | None = None, first: str | None = None, last: str | None = None) -> list[tuple[str, bool]]:
        """``(stage, whether it runs)``. One stage, or those from ``first`` to
        ``last``; a disabled stage never runs. Unknown names raise."""
        names = [s.name for s in self.stages]
        for n in (only, first, last):
            if n is not None and n not in names:
                raise KeyError(f"no stage {n}; there are {names}")
        lo = names.index(only or first) if only or first else 0
        hi = names.index(only or last) if only or last else len(names) - 1
        if lo > hi:
            raise ValueError("the first stage lies behind the last")
        return [(s.name, lo <= k <= hi and s.enabled) for k, s in enumerate(self.stages)]

    def run(self, tables: Tables, dry_run: bool = False, **selection) -> Tables:
        """Tables with those of the stages that ran. Nothing is computed until
        a table is written or counted; a dry run adds nothing."""
        out = dict(tables)
        for stage, (name, runs) in zip(self.stages, self.plan(**selection), strict=True):
            if runs and not dry_run:
                out[name] = stage.run(out)
                self.done.append(name)
        return out


def bar_pipeline(step: int = 1, horizon: int = 15, length: int = 30, timeframe: int = 60, features: tuple[str, ...] = ("f_1m_log_return_1", "f_1m_body_bps")) -> Pipeline:
    """Observed bars to model-ready rows. Wants the tables ``bars`` (symbol,
    datetime, prices, volume, bar_count, wap, session, trading_date) and
    ``windows`` (session windows with symbol, trading_date, session, start, end)."""
    group = ["symbol", "trading_date", "session"]

    def regularize(t: Tables) -> DataFrame:
        grid = B.expected_grid(t["windows"], step, carry=[*group, "start", "end"]).withColumnsRenamed({"start": "session_start", "end": "session_end"})
        reg = B.regularize(t["bars"], grid, group, step)
        return reg.join(t["windows"].select(*group, F.col("start").alias("session_start"), F.col("end").alias("session_end")), group)

    def features_1m(t: Tables) -> DataFrame:
        d = FE.one_minute_features(t["regularize"], step).withColumn("prediction_time", F.timestamp_add("MINUTE", F.lit(step), F.col("datetime")))
        name = f"{timeframe}m"
        context = FE.higher_timeframe_features(t["resample"], name, group)
        return FE.merge_higher_timeframe(d, context, name, [f"f_{name}_log_return_1", f"f_{name}_range_bps"])

    def sequences(t: Tables) -> DataFrame:
        d = T.scope_history(t["targets"], ("premarket", "regular", "aftermarket", "overnight"))
        d = d.where(T.window_eligible(length) & F.col(f"target_valid_{horizon}m"))
        return T.purge(T.assign_split(d, T.split_plan(d)), f"target_realized_at_{horizon}m")

    def matrix(t: Tables) -> DataFrame:
        ready = T.window_finite(t["features"], list(features), length).where("window_finite").select("symbol", "datetime")
        rows = t["sequences"].join(ready, ["symbol", "datetime"], "left_semi")
        return M.scaled(rows, M.scaler(rows.where("split = 'train'"), list(features)), list(features))

    return Pipeline([
        Stage("validate", lambda t: Q.integrity(t["bars"])),
        Stage("regularize", regularize),
        Stage("resample", lambda t: B.resample(t["regularize"], timeframe, step, group)),
        Stage("features", features_1m),
        Stage("targets", lambda t: T.add_target(t["features"], horizon, step)),
        Stage("sequences", sequences),
        Stage("matrix", matrix),
        Stage("labels", lambda t: T.labelled(t["matrix"].join(T.wilder_atr(t["features"], 14, step).select("symbol", "datetime", "atr_14"), ["symbol", "datetime"]), f"target_simple_return_{horizon}m", "atr_14")),
    ])
