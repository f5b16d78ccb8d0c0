"""Logistic regression of many fits at once: Newton steps whose sums come from one aggregate for all fits."""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.errors import ModelTrainingError
from churnloom.ml import prep
from churnloom.ml.fits import Fit
from churnloom.ml.models import LinearModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-9


def _sums(rows: DataFrame, fits: list[Fit], params: np.ndarray) -> np.ndarray:
    """Per fit the loss, gradient and second derivatives of the weighted log loss at its parameters: one job."""
    size = params.shape[1]
    width = 1 + size + size * size
    sent = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps((fits, params)))

    def run(batches):
        fits, params = pickle.loads(sent.value)
        total = np.zeros((len(fits), width))
        for batch in batches:
            label, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size - 1)
            x = np.hstack([x, np.ones((len(x), 1))])
            for i, fit in enumerate(fits):
                w = fit.weight(label) * fit.mask(fold)
                z = x @ params[i]
                p = 1 / (1 + np.exp(-z))
                total[i, 0] += (w * (np.logaddexp(0, z) - label * z)).sum()
                total[i, 1:size + 1] += x.T @ (w * (p - label))
                total[i, size + 1:] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["cells"])

    cells = rows.mapInArrow(run, "cells array<double>").select(F.posexplode("cells").alias("i", "value"))
    found = cells.groupBy("i").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(len(fits) * width)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    sent.unpersist()
    return out.reshape(len(fits), width)


def fit_linear(encoded: DataFrame, fits: list[Fit], inputs: int, most: int) -> dict[int, LinearModel]:
    """Minimum of weighted log loss plus half the squared coefficients (not the intercept), for every fit.

    The matrices have as many rows as there are inputs; nothing grows with the customers. A step that does not lower the loss is halved.
    """
    rows = encoded.where("fold >= 0").select("label", "fold", vector_to_array(prep.SCALED).alias("x"))
    size = inputs + 1
    penalty = np.r_[np.ones(inputs), 0.0]
    at, steps = np.zeros((len(fits), size)), np.zeros((len(fits), size))
    lowest, done = np.full(len(fits), np.inf), np.zeros(len(fits), bool)
    for _ in range(most):
        trial = at - steps
        sums = _sums(rows, fits, trial)
        for i in np.flatnonzero(~done):
            loss = sums[i, 0] + (penalty * trial[i] ** 2).sum() / 2
            if not loss <= lowest[i] * (1 + 1e-12):
                steps[i] /= 2
                done[i] = np.abs(steps[i]).max() < TOLERANCE
                continue
            at[i], lowest[i] = trial[i], loss
            gradient = sums[i, 1:size + 1] + penalty * at[i]
            second = sums[i, size + 1:].reshape(size, size) + np.diag(penalty)
            steps[i] = np.linalg.lstsq(second, gradient, rcond=None)[0]
            done[i] = np.abs(steps[i]).max() < TOLERANCE * max(1.0, np.abs(at[i]).max())
        if done.all():
            return {f.number: LinearModel(at[i][:-1], float(at[i][-1])) for i, f in enumerate(fits)}
    raise ModelTrainingError(f"logistic regression did not settle in {most} steps")
