"""Leading singular vectors of a large sparse matrix whose rows are spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessmine.functions.arrays import lists, matrix
from accessmine.functions.common import vector_sum

#: Numbers of the basis (columns x directions) that go to every task at most.
BASIS_CELLS = 50_000_000
#: Directions beyond those asked for, passes at most, and the change of the values at which they end.
MORE, PASSES, STILL = 10, 30, 1e-7


def sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's rows (cols, weights): the columns and weights of all entries, and where each row begins, with the end."""
    cols = batch.column("cols")
    start = np.concatenate([[0], np.cumsum(cols.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return cols.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("weights").flatten().to_numpy(zero_copy_only=False).astype(float), start


def times(cols: np.ndarray, weights: np.ndarray, start: np.ndarray, basis: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """The rows' products with a basis (columns x directions), a part of the entries at a time."""
    out = np.zeros((len(start) - 1, basis.shape[1]))
    rows = np.repeat(np.arange(len(out)), np.diff(start))
    most = max(1, step // max(1, basis.shape[1]))
    for k in range(0, len(cols), most):
        at = slice(k, k + most)
        head = np.flatnonzero(np.concatenate([[True], rows[at][1:] != rows[at][:-1]]))
        out[rows[at][head]] += np.add.reduceat(basis[cols[at]] * weights[at][:, None], head, axis=0)
    return out


def _back(cols: np.ndarray, weights: np.ndarray, start: np.ndarray, y: np.ndarray, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(columns in use, their sums of the rows' y times the weights)."""
    order = np.argsort(cols, kind="stable")
    rows = np.repeat(np.arange(len(y)), np.diff(start))[order]
    used, head = np.unique(cols[order], return_index=True)
    out = np.zeros((len(used), y.shape[1]))
    which = np.repeat(np.arange(len(used)), np.diff(np.append(head, len(cols))))
    most = max(1, step // max(1, y.shape[1]))
    for k in range(0, len(cols), most):
        at = slice(k, k + most)
        first = np.flatnonzero(np.concatenate([[True], which[at][1:] != which[at][:-1]]))
        out[which[at][first]] += np.add.reduceat(y[rows[at]] * weights[order[at]][:, None], first, axis=0)
    return used, out


def leading(rows: DataFrame, width: int, dim: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of rows (cols array<int>, weights array<double>).

    A randomised range finder: a random basis of a few more directions than asked for goes to
    all tasks, each gives back X'(X basis) of its rows for the columns that they have, added up
    on executors, and the sum, made orthogonal, is the next basis. Passes end when the values
    stand still. No row is ever made dense. width x directions numbers at most BASIS_CELLS.
    """
    wide = min(width, dim + MORE)
    if width * wide > BASIS_CELLS:
        raise ValueError(f"{width} columns in {wide} directions are over {BASIS_CELLS} numbers")
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, wide)))[0]
    values, vectors = np.zeros(wide), basis
    rows = rows.select("cols", "weights")
    for _ in range(PASSES):
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def gram(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((width, wide)), np.zeros(width, bool)
            for batch in batches:
                cols, weights, start = sparse(batch)
                used, sums = _back(cols, weights, start, times(cols, weights, start, shared.value))
                total[used] += sums
                seen[used] = True
            at = np.flatnonzero(seen)
            for k in range(0, len(at), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 4096].astype(np.int32)), lists(total[at[k : k + 4096]])], names=["j", "sums"])

        summed = rows.mapInArrow(gram, "j int, sums array<double>").groupBy("j").agg(vector_to_array(vector_sum("sums")).alias("sums")).toArrow()
        shared.unpersist()
        image = np.zeros((width, wide))
        if summed.num_rows:
            image[summed["j"].to_numpy()] = matrix(summed["sums"])
        inner = basis.T @ image
        new, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-new)
        new, vectors = new[order].clip(0), basis @ turn[:, order]
        done = np.abs(new[:dim] - values[:dim]).max(initial=0) <= STILL * max(new.max(initial=0), 1e-300)
        values = new
        if done:
            break
        basis = np.linalg.qr(image)[0]
    vectors = vectors[:, :dim]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[:dim], vectors * np.where(sign == 0, 1, sign)
