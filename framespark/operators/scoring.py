"""Frames through an injected model, in Arrow batches; the model is made once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: make_model() -> function of an array (batch, c * h * w) that gives one row for each frame.
MakeModel = Callable[[], Callable[[np.ndarray], np.ndarray]]


def score_frames(frames: DataFrame, make_model: MakeModel, size: int, batch_size: int = 32) -> DataFrame:
    """M1. Adds classes, a class number for each of the model's outputs, from frames of `size` pixels."""
    scored = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[size]])
    return frames.withColumn("classes", F.transform(scored(F.col("pixels").cast("array<float>")), lambda v: v.cast("int")))


def extract_features(frames: DataFrame, make_model: Callable[[], Callable[[np.ndarray], dict[str, np.ndarray]]], names: list[str], size: int, batch_size: int = 32) -> DataFrame:
    """M2. Adds features, a struct of named feature arrays, one for each resolution."""
    kind = T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in names])
    extracted = predict_batch_udf(make_model, return_type=kind, batch_size=batch_size, input_tensor_shapes=[[size]])
    return frames.withColumn("features", extracted(F.col("pixels").cast("array<float>")))
