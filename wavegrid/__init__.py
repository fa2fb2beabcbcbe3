"""Simulated event-related potentials and trials-by-time images as Spark DataFrames.

The public names are loaded when they are first used, so that Python workers load only what their task needs.
"""

from importlib import import_module

_HOMES = {
    "operators.alignment": ["aligned", "looked_up", "missing_keys"],
    "operators.events": ["delta_latency", "epochs", "onsets", "overlap_add", "running_sum"],
    "operators.intervals": ["interval_join", "interval_totals"],
    "operators.matrix": ["PATTERNS", "VARIANTS", "cropped", "dropout", "color_range", "images", "pattern_keys", "ranked", "resized", "variants", "zscored"],
    "operators.moments": ["moments"],
    "operators.selection": ["order_statistic", "quantile"],
    "plans.config": ["Config", "N", "Noise"],
    "plans.diagnostics": ["Diagnostics", "merged", "totals"],
    "plans.images": ["erp_image"],
    "plans.simulate": ["generate_erp_images"],
    "sources.dataset": ["datasets", "load_dataset", "save_dataset"],
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__} has no attribute {name}")
    return getattr(import_module(f".{_HOME[name]}", __name__), name)
