"""Out-of-fold least squares on all columns from one pass over the data.

The pass gathers one matrix of products per fold; the training set of a held-out fold is the sum of the others.  A sweep
over that matrix solves each fold and shows which columns depend on earlier ones: their pivot vanishes and they get 0, so a
full set of level columns beside the constant needs no dropped level.  Numbers are centred and scaled first, which
keeps the products well conditioned; coefficients are returned in the columns' own units.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlift.sources.shipping import ship_package

#: A pivot below this share of its column's own square is dependence.
DEPENDENT = 1e-9
CONSTANT = "intercept"


def sweep(products: np.ndarray) -> np.ndarray:
    """Coefficients of the last column on the others, from the symmetric matrix of products; dependent columns get 0."""
    a = products.astype(np.float64).copy()
    p = len(a) - 1
    own, solved = a.diagonal().copy(), np.zeros(p, dtype=bool)
    for k in range(p):
        pivot = a[k, k]
        if pivot <= DEPENDENT * own[k]:
            continue
        row, column = a[k] / pivot, a[:, k].copy()
        a -= np.outer(column, row)
        a[k] = row
        solved[k] = True
    return np.where(solved, a[:p, p], 0.0)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        fold = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(np.float64)
        for f in np.unique(fold):
            own = x[fold == f]
            total[int(f)] = total.get(int(f), 0) + own.T @ own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["fold", "products"]
    )


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, dtype=np.float64) for v in table.column("products").to_pylist())
    return pa.table({"fold": table.column("fold").slice(0, 1), "products": pa.array([total.tobytes()], pa.binary())})


def _design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[list[str], list[Column], list[float], list[float]]:
    """Names, columns, centres and scales of the terms, the constant first.  A missing number is taken as the mean."""
    figures = df.agg(*[f(F.col(c).cast("double")) for c in (*numeric, "label") for f in (F.avg, F.stddev_pop)]).first()
    centre, scale = [v or 0.0 for v in figures[0::2]], [v or 1.0 for v in figures[1::2]]
    names, columns = [CONSTANT], [F.lit(1.0)]
    for c, m, s in zip(numeric, centre, scale, strict=False):
        names.append(c)
        columns.append(F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)))
    for c in categorical:
        for level in sorted(r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().collect()):
            names.append(f"{c}_{level}")
            columns.append(F.coalesce((F.col(c).cast("string") == level).cast("double"), F.lit(0.0)))
    columns.append((F.col("label") - centre[-1]) / scale[-1])
    return names, columns, centre, scale


def fold_coefficients(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> tuple[list[str], dict[int, list[float]]]:
    """Terms, and per held-out fold the coefficients fitted on the other folds.  ``df``: ``label``, ``fold`` and columns."""
    ship_package(df.sparkSession)
    known = df.where(F.col("label").isNotNull())
    names, columns, centre, scale = _design(known, numeric, categorical)
    table = known.select(F.col("fold").cast("int").alias("fold"), *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    parts = table.mapInArrow(_products, "fold int, products binary").groupBy("fold").applyInArrow(_added, "fold int, products binary")
    n = len(columns)
    own = {r.fold: np.frombuffer(bytes(r.products), dtype=np.float64).reshape(n, n) for r in parts.collect()}
    total = sum(own.values())
    out = {}
    for held, products in own.items():
        b = sweep(total - products) * scale[-1]
        for i in range(len(numeric)):
            b[i + 1] /= scale[i]
        b[0] += centre[-1] - sum(b[i + 1] * centre[i] for i in range(len(numeric)))
        out[held] = b.tolist()
    return names, out


def out_of_fold(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), keep: Sequence[str] = ("alert_id", "airport")) -> DataFrame:
    """Prediction of every row by the plane through all other folds, in generated code."""
    names, by_fold = fold_coefficients(df, numeric, categorical)
    means = df.where(F.col("label").isNotNull()).agg(*[F.avg(F.col(c).cast("double")) for c in numeric]).first()
    terms = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(numeric, means, strict=True)]]
    for c in categorical:
        terms += [
            F.coalesce((F.col(c).cast("string") == n.removeprefix(f"{c}_")).cast("double"), F.lit(0.0))
            for n in names[len(terms) :] if n.startswith(f"{c}_")
        ]
    table = df.sparkSession.createDataFrame(sorted(by_fold.items()), "fold int, b array<double>")
    predicted = sum((t * F.get("b", F.lit(i)) for i, t in enumerate(terms)), F.lit(0.0))
    return df.join(F.broadcast(table), "fold").select(
        *keep, F.lit("linear_all").alias("model"), "fold", F.col("label").alias("duration_true"), predicted.alias("duration_pred")
    )
