"""Classical estimators and training-data operators as Spark jobs."""

from .config import cluster_info, get_config, reset, reset_thresholds, running, set_mode, set_threshold, set_thresholds, set_verbose, update_threshold
from .registry import REGISTRY, Pipeline, distribute, is_supported, wrap

__all__ = [
    "REGISTRY", "Pipeline", "cluster_info", "distribute", "get_config", "reset", "reset_thresholds", "running", "set_mode", "set_threshold", "set_thresholds", "set_verbose",
    "update_threshold", "wrap", *REGISTRY,
]

globals().update(REGISTRY)
