"""Running a NumPy algorithm that needs all points of a symbol at once, with a checked bound on their number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.operators.cluster.base import points


def per_symbol(bars: DataFrame, layout: str, max_points: int, run: Callable[[np.ndarray], dict], schema: str, single: bool = False) -> DataFrame:
    """run gets the points of a symbol in order of row_idx and returns columns: of one value a point, or of one value a symbol; with
    `single` one row a symbol comes out.
    A symbol with more than max_points points raises before anything runs."""
    rows = points(bars, layout)
    most = rows.groupBy("symbol").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most is None:
        raise errors.EmptyDataset
    if most > max_points:
        raise errors.TooManyPoints(f"a symbol has {most} points; this algorithm keeps a matrix of all pairs and takes {max_points}")

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_idx")
        x = np.array(table.column("x").to_pylist(), dtype=float)
        if single:
            return pa.table({"symbol": table.column("symbol").slice(0, 1)} | {n: pa.array([v]) for n, v in run(x).items()}).cast(target)
        out = {"symbol": table.column("symbol"), "row_idx": table.column("row_idx")}
        for name, value in run(x).items():
            whole = not isinstance(value, np.ndarray)
            out[name] = pa.array([value] * len(x) if whole else value.tolist())
        return pa.table(out).cast(target)

    target = _arrow(schema)
    return rows.groupBy("symbol").applyInArrow(group, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    pairs = [x.strip().split(" ", 1) for x in schema.split(", ")]
    return pa.schema([(n, kinds[k]) for n, k in pairs])


def matrix(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of x to all rows of y."""
    if metric == "manhattan":
        return np.abs(x[:, None, :] - y[None, :, :]).sum(-1)
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        return np.where(norm == 0, 1.0, 1.0 - (x @ y.T) / np.where(norm == 0, 1.0, norm))
    return np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1), 0.0))
