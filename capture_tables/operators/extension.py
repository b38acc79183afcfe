"""Where users add their own work: evaluators, depth providers, steps and augmentations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from capture_tables.operators.columns import augment_pixels

Metric = Callable[[dict[str, DataFrame]], DataFrame]


class Evaluator:
    """A registry of metrics, each a function of the named tables that gives (seq, frame, value);
    `run` joins them by frame, so that a new metric is one more column."""

    def __init__(self, on=("seq", "frame")):
        self.on, self.metrics = list(on), {}

    def metric(self, name: str):
        def register(build: Metric) -> Metric:
            self.metrics[name] = build
            return build

        return register

    def run(self, tables: dict[str, DataFrame]) -> DataFrame:
        out = None
        for name, build in self.metrics.items():
            one = build(tables).select(*self.on, "value").withColumnRenamed("value", name)
            out = one if out is None else out.join(one, self.on, "full")
        if out is None:
            raise ValueError("no metric is registered")
        return out


def align_depth(predicted: DataFrame, provider: Callable[[DataFrame], DataFrame], by: list[str], pixel=("v", "u")) -> DataFrame:
    """Depth scaled and shifted to the target that the provider makes of it."""
    from capture_tables.operators.masks import apply_scale_shift, fit_scale_shift

    return apply_scale_shift(predicted, fit_scale_shift(predicted, provider(predicted), by, pixel), by)


def preprocessed(depth: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Depth through the steps in turn."""
    for step in steps:
        depth = depth.transform(step)
    return depth


def augmented(pixels: DataFrame, specs: list[dict], seed: int, *keys: str) -> DataFrame:
    """Pixels through a list of augmentations, each with its own seed."""
    for k, spec in enumerate(specs):
        pixels = augment_pixels(pixels, spec, seed + 1000 * k, *keys)
    return pixels
