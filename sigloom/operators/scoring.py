"""Scoring with opaque models in Arrow batches: a model is loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_models: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def onnx_model(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A one-input ONNX model; every worker must be able to read the path (ship it with addFile)."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    session = onnxruntime.InferenceSession(path, options)
    name = session.get_inputs()[0].name
    return lambda x: np.asarray(session.run(None, {name: x.astype(np.float32)})[0])


def scored(rows: DataFrame, key: str, signal: str, model: str, load: Callable[[str], Callable[[np.ndarray], np.ndarray]] = onnx_model) -> DataFrame:
    """key, logits. All signals of a batch must have one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if model not in _models:
                _models[model] = load(model)
            out = _models[model](np.stack(frame[signal].to_numpy()).astype(float)) if len(frame) else np.zeros((0, 1))
            yield pd.DataFrame({key: frame[key], "logits": list(np.asarray(out, float).reshape(len(frame), -1))})

    return rows.select(key, signal).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, logits array<double>")
