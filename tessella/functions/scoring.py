"""Caller-given models over tiles and patches, and named processing steps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType


def classify(df: DataFrame, make_predict: Callable, inputs, name: str = "probabilities", batch_size: int = 256) -> DataFrame:
    """Class probabilities per row from a model loaded once per Python worker.

    ``make_predict()`` returns a function from arrays (one per input column) to an
    array ``rows x classes``.
    """
    from pyspark.ml.functions import predict_batch_udf

    fn = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return df.withColumn(name, fn(*(F.col(c) for c in inputs)))


def detect(tiles: DataFrame, make_detector: Callable, schema: str) -> DataFrame:
    """Boxes per tile: ``make_detector()`` returns ``DataFrame of tiles -> DataFrame of boxes``."""

    def run(batches):
        detector = make_detector()
        for pdf in batches:
            out = detector(pdf)
            if len(out):
                yield pd.DataFrame(out)

    return tiles.mapInPandas(run, schema)


def spread_probabilities(df: DataFrame, names, column: str = "probabilities") -> DataFrame:
    return df.select(*(c for c in df.columns if c != column), *(F.col(column)[i].alias(n) for i, n in enumerate(names)))


def apply_chain(df: DataFrame, steps, registry: dict[str, Callable]) -> DataFrame:
    """Run named steps ``(name, parameters)`` in order."""
    for name, params in steps:
        if name not in registry:
            raise ValueError(f"unknown step {name!r}; choose from {sorted(registry)}")
        df = df.transform(lambda d, n=name, p=params: registry[n](d, **p))
    return df


def default_steps() -> dict[str, Callable]:
    """Steps on box tables."""
    from ..functions.boxes import Box, window
    from ..operators import boxes as ob

    flips: dict[str, Callable[[Box], Box]] = {
        "flip_left_right": Box.flip_left_right, "flip_up_down": Box.flip_up_down, "rot90": Box.rot90,
    }
    steps = {name: (lambda d, f=f: ob.put(d, f(Box.of()))) for name, f in flips.items()}
    steps.update(
        normalize=ob.normalize, absolute=ob.absolute, scale=ob.scale, sanitize=ob.sanitize, offset=ob.offset,
        clip=lambda d, xmin, ymin, xmax, ymax: ob.clip(d, window(xmin, ymin, xmax, ymax)),
        score=lambda d, threshold: ob.score_filter(d, threshold),
        size=lambda d, **p: ob.size_filter(d, **p),
    )
    return steps


def softmax(columns) -> list[Column]:
    top = F.greatest(*columns)
    parts = [F.exp(c - top) for c in columns]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]
