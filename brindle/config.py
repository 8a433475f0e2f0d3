"""How fits are run: settings of the process, an override for a block of code, and the routing by size."""

from __future__ import annotations

import contextvars
from collections.abc import Iterator
from contextlib import contextmanager
from copy import deepcopy
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

MODES = ("cluster", "compact", "auto")
#: Rows up to which ``auto`` packs a fit's input into one partition.
DEFAULTS = {"mode": "cluster", "verbose": False, "threshold": 20_000, "thresholds": {}}

_settings, _lock = deepcopy(DEFAULTS), Lock()
_override: contextvars.ContextVar[str | None] = contextvars.ContextVar("mode", default=None)


def get_config() -> dict:
    with _lock:
        return deepcopy(_settings) | ({"mode": m} if (m := _override.get()) else {})


def set_mode(mode: str) -> None:
    """``cluster``: the input's own partitions; ``compact``: one; ``auto``: by the optimizer's estimate of its rows."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    with _lock:
        _settings["mode"] = mode


def set_verbose(verbose: bool) -> None:
    with _lock:
        _settings["verbose"] = bool(verbose)


def set_threshold(rows: int) -> None:
    if rows < 0:
        raise ValueError("a threshold is a number of rows")
    with _lock:
        _settings["threshold"] = int(rows)


def set_thresholds(thresholds: dict[str, int]) -> None:
    """Rows by estimator name, in place of all earlier ones."""
    with _lock:
        _settings["thresholds"] = {str(k): int(v) for k, v in thresholds.items()}


def update_threshold(name: str, rows: int) -> None:
    with _lock:
        _settings["thresholds"][name] = int(rows)


def reset_thresholds() -> None:
    with _lock:
        _settings["threshold"], _settings["thresholds"] = DEFAULTS["threshold"], {}


def reset() -> None:
    with _lock:
        _settings.clear()
        _settings.update(deepcopy(DEFAULTS))


@contextmanager
def running(mode: str) -> Iterator[None]:
    """The mode within a block, per thread and task; blocks nest, and the outer mode returns whatever happens."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    token = _override.set(mode)
    try:
        yield
    finally:
        _override.reset(token)


def cluster_info(spark: SparkSession) -> dict:
    sc = spark.sparkContext
    return {"master": sc.master, "parallelism": sc.defaultParallelism, "version": spark.version, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}


def estimated_rows(df: DataFrame) -> int:
    """The rows of ``df`` as the optimizer takes them: its own count where it has one, else its bytes by the schema's width. Nothing is run."""
    plan = df._jdf.queryExecution().optimizedPlan().stats()
    if plan.rowCount().isDefined():
        return int(str(plan.rowCount().get()))
    return int(str(plan.sizeInBytes())) // max(1, df._jdf.schema().defaultSize())


def routed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a fit of ``name`` is to read it.

    A compact input is packed behind a shuffle of its rows, so the plan that makes
    them keeps all its tasks. ``auto`` decides by the optimizer's estimate, without
    a job; filters don't lower it, so the rare survivors of a large table stay where
    they are.
    """
    c = get_config()
    mode = c["mode"]
    if mode == "auto":
        mode = "compact" if estimated_rows(df) <= c["thresholds"].get(name, c["threshold"]) else "cluster"
    if c["verbose"]:
        print(f"{name}: {mode}")
    return df.repartition(1) if mode == "compact" else df
