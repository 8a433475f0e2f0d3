"""Estimators by name, pipelines of them, and wrapping of look-alikes."""

from __future__ import annotations

import functools
import typing
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .operators.base import Estimator
from .operators.bayes import GaussianNB
from .operators.cluster import DBSCAN, KMeans
from .operators.decomposition import PCA, TruncatedSVD
from .operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from .operators.neighbors import METRICS, KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors
from .operators.scale import MinMaxScaler, RobustScaler, StandardScaler
from .operators.svm import SVC, SVR
from .operators.trees import HistGradientBoostingClassifier, HistGradientBoostingRegressor

REGISTRY: dict[str, type[Estimator]] = {
    c.__name__: c
    for c in (
        LinearRegression, Ridge, Lasso, ElasticNet, LogisticRegression, KMeans, DBSCAN, TruncatedSVD, PCA, GaussianNB, StandardScaler, MinMaxScaler,
        RobustScaler, NearestNeighbors, KNeighborsClassifier, KNeighborsRegressor, SVC, SVR, HistGradientBoostingRegressor, HistGradientBoostingClassifier,
    )
}


class Pipeline(Estimator):
    """Named steps: each but the last transforms, the last may also predict."""

    def __init__(self, steps: list[tuple[str, Estimator]]):
        if not steps or len({n for n, _ in steps}) < len(steps):
            raise ValueError("a pipeline needs steps with different names")
        self.steps = steps

    @property
    def named_steps(self) -> dict[str, Estimator]:
        return dict(self.steps)

    def get_params(self) -> dict:
        return {"steps": self.steps} | {f"{n}__{k}": v for n, s in self.steps for k, v in s.get_params().items()}

    def set_params(self, **params) -> Pipeline:
        for k, v in params.items():
            name, _, own = k.partition("__")
            self.named_steps[name].set_params(**{own: v})
        return self

    def fit(self, df: DataFrame) -> Pipeline:
        for _, step in self.steps[:-1]:
            df = step.fit(df).transform(df)
        self.steps[-1][1].fit(df)
        return self

    def _before(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps[:-1]:
            df = step.transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.steps[-1][1].transform(self._before(df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.steps[-1][1].predict(self._before(df))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.steps[-1][1].predict_proba(self._before(df))

    def score(self, df: DataFrame) -> float:
        return self.steps[-1][1].score(self._before(df))


def is_supported(obj) -> bool:
    """Whether an object, or a class, is told by its name, and its parameters can be taken."""
    name = obj.__name__ if isinstance(obj, type) else type(obj).__name__
    if name == "Pipeline":
        return isinstance(obj, type) or all(is_supported(s) for _, s in obj.steps)
    if name not in REGISTRY or isinstance(obj, (type, Estimator)):
        return name in REGISTRY
    try:
        _parameters(name, obj)
    except (TypeError, ValueError):
        return False
    return True


#: What look-alikes call otherwise, or have and this library has one way of only: parameter, the values that mean the same here, ours.
_SAME = {"kernel": ("rbf",), "penalty": ("l2", "deprecated"), "algorithm": None, "solver": None, "copy": None, "copy_X": None, "n_jobs": None, "verbose": None}
_METRICS = {"l2": "euclidean", "l1": "manhattan", "cityblock": "manhattan"}


def _taken(cls: type[Estimator], name: str, value):
    """``value`` as the parameter's annotation wants it; TypeError if it can't be that."""
    hint = typing.get_type_hints(cls.__init__).get(name, object)
    kinds = typing.get_args(hint) if typing.get_origin(hint) in (typing.Union, type(int | str)) else (hint,)
    kinds = tuple(typing.get_origin(k) or k for k in kinds)
    if isinstance(value, np.generic):
        value = value.item()
    if object in kinds or (isinstance(value, kinds) and not (isinstance(value, bool) and bool not in kinds)):
        return value
    if float in kinds and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if list in kinds and isinstance(value, (tuple, np.ndarray)):
        return list(value)
    if tuple in kinds and isinstance(value, list):
        return tuple(value)
    if np.ndarray in kinds and isinstance(value, (list, tuple)):
        return np.array(value, float)
    raise TypeError(f"{cls.__name__} can't take {name}={value!r}")


def _parameters(name: str, obj) -> dict:
    """The parameters of a look-alike that are known here. None, and no limit on iterations, are the default.

    TypeError or ValueError for a value that can't be taken; a warning for a
    parameter that is set to something else than its own default and isn't known.
    """
    cls, given, out = REGISTRY[name], dict(obj.get_params()), {}
    known = cls().get_params()
    if given.get("metric") == "minkowski":
        given["metric"] = {1: "manhattan", 2: "euclidean"}.get(given.get("p", 2), f"minkowski of p={given.get('p')}")
    given.pop("p", None)
    try:
        usual = type(obj)().get_params()
    except Exception:  # a class that needs arguments has no defaults to compare with
        usual = {}
    for k, v in given.items():
        if k == "metric" and k in known:
            v = _METRICS.get(v, v)
            if v not in METRICS:
                raise ValueError(f"{name} can't take metric={v!r}")
        if k in known:
            if v is None or (k == "max_iter" and v == -1):
                continue
            out[k] = _taken(cls, k, v)
        elif _SAME.get(k, ()) is not None and v not in _SAME.get(k, (None,)) and (k not in usual or np.any(v != usual[k])):
            if k in _SAME:
                raise ValueError(f"{name} can't take {k}={v!r}")
            warnings.warn(f"{name} has no parameter {k}: {v!r} has no effect", stacklevel=4)
    return out


def wrap(obj):
    """An estimator or pipeline of this library with the parameters of ``obj``, which is told by its class's name.

    An object of this library comes back as it is; another kind with a warning.
    Every parameter known here is taken over, or an error is raised.
    """
    if isinstance(obj, Estimator):
        return obj
    name = type(obj).__name__
    if name == "Pipeline":
        return Pipeline([(n, wrap(s)) for n, s in obj.steps])
    if name not in REGISTRY:
        warnings.warn(f"{name} is not supported and stays as it is", stacklevel=2)
        return obj
    return REGISTRY[name]().set_params(**_parameters(name, obj))


def distribute(obj=None):
    """Wraps an estimator or pipeline, a function that returns one, or an estimator class; without argument, the decorator itself."""
    if obj is None:
        return distribute
    if isinstance(obj, type):
        return REGISTRY.get(obj.__name__, obj)
    if isinstance(obj, Callable) and not hasattr(obj, "fit"):

        @functools.wraps(obj)
        def made(*args, **kwargs):
            return wrap(obj(*args, **kwargs))

        return made
    return wrap(obj)
