"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are packed into integer blocks where they are read, and a table of those blocks is what
every pass reads. The covariance is never formed. Each step sends one vector of the width of
the embeddings to the blocks of centred rows, which give back ``X v`` folded into ``X'X v`` and
its squared length, added up over the cluster. Left vectors, one entry for each row, are not
stored: a left vector is ``X w``, so keeping ``w`` and ``X'X w`` is enough to reorthogonalise it
against all earlier ones (twice), as right vectors are. Singular values of the small bidiagonal
matrix are the deviations, and its right vectors turn the basis into the components.

A step that finds nothing new goes on with a fresh direction, so repeated and zero variances
are found too. Steps go on to the full width unless all wanted components have settled before;
at least ``2 * components + 10`` are taken.

Cases: rows with a null id keep it; rows with a null vector, or with null or non-finite
entries, are dropped; repeated rows count and return each; a vector shorter than the longest
is filled up with zero components; components without variance are not returned, so one
vector, equal vectors or an empty table give no row; a squared deviation beyond a long is
null; only the named columns are read, so others may clash. Which of two components with
equal variance comes first is left open.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinprep.llm.common import arrow_schema, stored
from clinprep.llm.vectors import packed, unpacked, usable

SETTLED = 1e-15
NOTHING = 1e-13
ROWS_OUT = 1 << 14
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """Statistics of the fit list; all of the width of a vector, or of the number of components."""
    n: int
    sums: list[int]
    shift: int
    total: float  # trace of the covariance
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # columns


def whole(row: dict, width: int, shift: int) -> np.ndarray:
    """Integer matrix of a block, filled up to the width."""
    cells = unpacked(row)[2].astype(np.int64)
    return np.pad(cells, ((0, 0), (0, width - cells.shape[1])), constant_values=shift)


def centred(row: dict, fit: Fit) -> np.ndarray:
    """Rows minus their mean, from exact integers where these fit."""
    cells = whole(row, len(fit.sums), fit.shift)
    mean = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([(s % fit.n) / fit.n for s in fit.sums])
    return (cells - mean) - rest


def folded(blocks: DataFrame, columns: list[str], work, size: int) -> np.ndarray:
    """Sum over all blocks of the vector of ``size`` numbers that ``work`` makes of each.

    A task sends one vector; one more task adds them up as they come in.
    """
    kind = pa.list_(pa.float64())

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for row in batch.to_pylist():
                total += work(row)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], kind)], names=["part"])

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += part.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], kind)], names=["part"])

    parts = blocks.select(*columns).mapInArrow(run, "part array<double>")
    return np.array(parts.repartition(1).mapInArrow(add, "part array<double>").collect()[0][0])


CELLS = ["n", "width", "ids", "labels", "kind", "cells"]


def bidiagonalise(product, width: int, components: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors (columns) and the bidiagonal matrix; ``product(w)`` is ``X'X w`` and ``|X w|**2``."""
    draw = np.random.default_rng(seed)
    right, left, images = [], [], []  # v, and w and X'X w of u = X w
    alphas, betas, scale = [], [], 0.0

    def fresh() -> np.ndarray | None:
        for _ in range(4):
            v = draw.standard_normal(width)
            for _ in range(2):
                v -= sum((x * (x @ v) for x in right), np.zeros(width))
            if np.linalg.norm(v) > 1e-6:
                return v / np.linalg.norm(v)
        return None

    v, beta = fresh(), 0.0
    while v is not None and len(right) < width:
        right.append(v)
        betas.append(beta)
        w = v.copy()
        for _ in range(2):
            w -= sum((x * (z @ w) for x, z in zip(left, images)), np.zeros(width))
        image, square = product(w)
        alpha = np.sqrt(max(square, 0.0))
        scale = max(scale, alpha)
        if alpha <= NOTHING * scale or alpha == 0:  # the direction adds no variance
            alpha, w, image = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, image = w / alpha, image / alpha
        alphas.append(alpha)
        left.append(w)
        images.append(image)
        rest = image - alpha * v
        for _ in range(2):
            rest -= sum((x * (x @ rest) for x in right), np.zeros(width))
        beta = np.linalg.norm(rest)
        if beta <= NOTHING * scale or beta == 0:
            v, beta = fresh(), 0.0
        else:
            v = rest / beta
        k = len(right)
        if k >= 2 * components + 10:
            ends, values, _ = np.linalg.svd(bidiagonal(alphas, betas))
            if (np.abs(ends[-1, :components]) * beta <= SETTLED * values[0]).all():
                break
    return np.array(right).T.reshape(width, -1), bidiagonal(alphas, betas)


def bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[1:], 1)


def fit_components(blocks: DataFrame, components: int, shift: int) -> Fit | None:
    """Statistics of all blocks; None without rows."""
    n, width = blocks.agg(F.sum("n").cast("long"), F.max("width")).first()
    if not n or not width:
        return None
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("sums", i), F.col("n") * F.lit(shift)))
    sums = blocks.select(F.posexplode(filled).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    fit = Fit(n, [x for _, x in sorted((r.at, r.x) for r in sums)], shift, 0.0, np.zeros(0), np.zeros((width, 0)))
    fit.total = float(folded(blocks, CELLS, lambda row: np.square(centred(row, fit)).sum(keepdims=True).reshape(1), 1)[0]) / n

    def product(w):
        def part(row):
            x = centred(row, fit)
            u = x @ w
            return np.append(u @ x, u @ u)
        found = folded(blocks, CELLS, part, width + 1)
        return found[:-1], found[-1]

    right, small = bidiagonalise(product, width, components)
    _, deviations, turned = np.linalg.svd(small)
    keep = (deviations[:components] > NOTHING * max(deviations[0], 1e-300)) & (fit.total > 0)
    fit.values = np.square(deviations[:components][keep]) / n
    vectors = np.linalg.qr(right)[0] * np.sign(np.diag(np.linalg.qr(right)[1])) @ turned[:components][keep].T
    if vectors.size:  # one sign for all rows: the largest entry is positive
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    fit.components = vectors
    return fit


def whitened(row: dict, fit: Fit) -> np.ndarray:
    return centred(row, fit) @ fit.components / np.sqrt(fit.values)


def distance_from_identity(blocks: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(fit.values)

    def part(row):
        y = whitened(row, fit)
        return np.append((y.T @ y).ravel(), y.sum(0))

    found = folded(blocks, CELLS, part, k * k + k) / fit.n
    covariance = found[:k * k].reshape(k, k) - np.outer(found[k * k:], found[k * k:])
    return float(np.abs(covariance - np.eye(k)).max())


def squared_deviation(row: dict, fit: Fit) -> list[int | None]:
    """``sum((n * x - S) ** 2)`` of each row, exactly; null where it is no long."""
    cells = whole(row, len(fit.sums), fit.shift)
    mean = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([s % fit.n for s in fit.sums], np.int64)
    away = cells - mean
    largest = (int(np.abs(away).max()) + 1) * fit.n if away.size else 0
    if largest ** 2 * max(cells.shape[1], 1) < 1 << 63:
        return np.square(away * fit.n - rest).sum(1).tolist()
    exact = ((away.astype(object) * fit.n - rest.astype(object)) ** 2).sum(1).tolist()
    return [int(x) if x < 1 << 63 else None for x in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32,
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector and component; the vectors are floored to ``floor(scale * c) + shift``."""
    rows = vectors.where(usable(vector))
    # a null id is marked by its label
    blocks = stored(packed(rows, F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.col(id_col).isNull().cast("long"), vector, scale, shift),
                    "whitening-blocks")
    fit = fit_components(blocks, components, shift)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], OUTPUT)
    error = distance_from_identity(blocks, fit)
    k = len(fit.values)
    share = fit.values / fit.total

    def run(batches):
        schema = arrow_schema(OUTPUT)
        for batch in batches:
            for row in batch.to_pylist():
                ids, missing, _ = unpacked(row)
                deviation, y = squared_deviation(row, fit), whitened(row, fit)
                for at in range(0, len(ids), max(1, ROWS_OUT // k)):
                    part = slice(at, at + max(1, ROWS_OUT // k))
                    rows_here = len(ids[part])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(ids[part], k), mask=np.repeat(missing[part] == 1, k)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                        pa.array(np.full(rows_here * k, fit.n, np.int64)),
                        pa.array(deviation[part], pa.int64()).take(pa.array(np.repeat(np.arange(rows_here), k))),
                        pa.array(y[part].ravel()), pa.array(np.tile(share, rows_here)),
                        pa.array(np.full(rows_here * k, error))], schema=schema)

    return blocks.select(*CELLS).mapInArrow(run, OUTPUT)
