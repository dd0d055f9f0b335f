"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Every partition of the distinct vectors is summed up by its count, exact sums,
and the full-rank singular values and right vectors of its centred rows.  Two
summaries merge without loss: the scaled vectors of both and one row for the
distance of their means are decomposed anew.  Partitions are merged FAN_IN at
a time, level by level, each level a table in the shared folder; no dimension
is given up on the way, and no covariance matrix is summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

COMPONENTS = 4
#: Steps of a unit that entries are rounded down to.
STEPS = 256
#: Summaries that one task merges.
FAN_IN = 8
#: Rows decomposed at once inside a partition.
BLOCK = 4096
_SAFE = 1 << 62
_MOST = (1 << 63) - 1


class Spread(NamedTuple):
    """Count, exact sums, and the singular values and vectors of centred rows."""

    n: int
    sums: np.ndarray  # Python integers
    values: np.ndarray
    vectors: np.ndarray  # a row for each value


def steps(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) for each length among the rows that are not null and hold only finite entries.

    Entries beyond 64 bits are held at the bounds, as a cast to long does.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    ends = np.cumsum(np.maximum(size, 0))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    sound = (size >= 0) & (bad[ends] == bad[ends - np.maximum(size, 0)])
    for length in np.unique(size[sound]):
        rows = np.flatnonzero(sound & (size == length))
        at = (ends[rows] - length)[:, None] + np.arange(length)
        with np.errstate(over="ignore"):
            x = np.floor(entries[at] * STEPS)
        out = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        out[x >= 2.0**63] = _MOST
        yield rows, out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to (dim, x): equal integer vectors give equal bytes, two, four or eight for an entry."""
    for batch in batches:
        for _, x in steps(batch.column(0)):
            m, dim = x.shape
            most = np.maximum(x, ~x).max(axis=1, initial=0)
            width = np.select([most < 1 << 15, most < 1 << 31], [2, 4], 8)
            for w in np.unique(width):
                part = np.ascontiguousarray(x[width == w].astype(f"<i{w}"))
                coded = pa.Array.from_buffers(pa.binary(dim * int(w)), len(part), [None, pa.py_buffer(part.tobytes())]).cast(pa.binary()) if dim else pa.array([b""] * len(part), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim, np.int32)), coded], names=["dim", "x"])


def _decode(column: pa.Array, dim: int) -> np.ndarray:
    """The integer matrix of encoded vectors of one length, in any order of rows."""
    out, width = [], pc.binary_length(column).to_numpy(zero_copy_only=False) // dim
    for w in np.unique(width):
        part = column.filter(pa.array(width == w))
        out.append(np.frombuffer(b"".join(part.to_pylist()), f"<i{w}").reshape(-1, dim).astype(np.int64))
    return np.concatenate(out) if out else np.zeros((0, dim), np.int64)


def _bound(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they suffice, else Python's."""
    if n * _bound(x) + max((abs(int(s)) for s in sums), default=0) < _SAFE:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def summary(x: np.ndarray) -> Spread:
    n = len(x)
    sums = x.sum(axis=0).astype(object) if n * _bound(x) < _SAFE else x.astype(object).sum(axis=0)
    centred = (deviations(x, n, sums) / n).astype(np.float64)
    _, values, vectors = np.linalg.svd(centred, full_matrices=False)
    return Spread(n, sums, values, vectors)


def merge(a: Spread, b: Spread) -> Spread:
    """Both as one: scaled vectors of either, and the row that moves both means to their common one."""
    n = a.n + b.n
    apart = ((a.sums * b.n - b.sums * a.n) / (a.n * b.n)).astype(np.float64)
    rows = (a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, np.sqrt(a.n * b.n / n) * apart[None, :])
    _, values, vectors = np.linalg.svd(np.concatenate(rows), full_matrices=False)
    return Spread(n, a.sums + b.sums, values, vectors)


_SPREAD = "part long, n long, sums array<string>, vals binary, vecs binary"


def _row(part: int, s: Spread) -> pa.RecordBatch:
    sums = pa.array([[str(int(v)) for v in s.sums]], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), sums, pa.array([s.values.tobytes()]), pa.array([s.vectors.tobytes()])], names=["part", "n", "sums", "vals", "vecs"])


def _spread(row: dict) -> Spread:
    values = np.frombuffer(row["vals"])
    return Spread(row["n"], np.array([int(v) for v in row["sums"]], object), values, np.frombuffer(row["vecs"]).reshape(len(values), -1))


def _fitter(dim: int):
    """The distinct vectors of a partition to one summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, so_far = [], 0, None

        def add() -> Spread:
            block = summary(np.concatenate(held))
            held.clear()
            return block if so_far is None else merge(so_far, block)

        for batch in batches:
            if batch.num_rows:
                held.append(_decode(batch.column(0), dim))
                rows += batch.num_rows
            if rows >= BLOCK:
                so_far, rows = add(), 0
        if held:
            so_far = add()
        if so_far is not None:
            yield _row(TaskContext.get().partitionId(), so_far)

    return run


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    so_far = _spread(rows[0])
    for row in rows[1:]:
        so_far = merge(so_far, _spread(row))
    return pa.Table.from_batches([_row(rows[0]["part"] // FAN_IN, so_far)])


def fit(ws: Workspace, distinct: DataFrame, dim: int) -> Spread:
    """The summary of all distinct vectors x, by levels of merges."""
    level = ws.cut(distinct.select("x").mapInArrow(_fitter(dim), _SPREAD))
    while level.count() > 1:
        last, level = level, ws.cut(level.groupBy(F.expr(f"part div {FAN_IN}").alias("node")).applyInArrow(_merged, _SPREAD))
        ws.drop(last)
    return _spread(level.first().asDict())


class Basis(NamedTuple):
    n: int
    sums: np.ndarray
    directions: np.ndarray  # a row for each component that has variance
    scale: np.ndarray
    explained: list[float | None]  # of all components that are returned


def basis(s: Spread, components: int) -> Basis:
    """The first components: eigenvectors of the covariance, their largest entry positive."""
    dim = s.vectors.shape[1]
    variance = np.zeros(min(components, dim))
    have = min(len(variance), len(s.values))
    variance[:have] = s.values[:have] ** 2 / s.n
    floor = s.values.max(initial=0.0) * max(s.n, dim) * np.finfo(float).eps
    rank = int(np.count_nonzero(s.values[:have] > floor))
    directions = s.vectors[:rank]
    turn = np.sign(directions[np.arange(rank), np.abs(directions).argmax(axis=1)]) if rank else np.ones(0)
    trace = float((s.values**2).sum() / s.n)
    return Basis(s.n, s.sums, directions * turn[:, None], np.sqrt(variance[:rank]), [float(v / trace) if trace else None for v in variance])


def _whiten(c: np.ndarray, b: Basis) -> np.ndarray:
    """Deviations (n * x - sums) to their whitened components."""
    return (c / b.n).astype(np.float64) @ b.directions.T / b.scale


def _second_moments(b: Basis, dim: int):
    """(cell, value): sums of the products of whitened components over a partition's distinct vectors, and of them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = len(b.scale)
        total = np.zeros((rank + 1, rank + 1))
        for batch in batches:
            w = _whiten(deviations(_decode(batch.column(0), dim), b.n, b.sums), b)
            w = np.concatenate((w, np.ones((len(w), 1))), axis=1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    return run


def _identity_error(distinct: DataFrame, b: Basis, dim: int) -> float | None:
    rank = len(b.scale)
    if not rank:
        return None
    cells = distinct.select("x").mapInArrow(_second_moments(b, dim), "cell long, value double")
    total = np.zeros((rank + 1) ** 2)
    for cell, value in cells.groupBy("cell").agg(F.sum("value")).collect():
        total[cell] = value
    total = total.reshape(rank + 1, rank + 1)
    mean = total[-1, :-1] / b.n
    return float(np.abs(total[:-1, :-1] / b.n - np.outer(mean, mean) - np.eye(rank)).max())


def _applier(b: Basis, dim: int, error: float | None):
    k, rank = len(b.explained), len(b.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in steps(batch.column(1)):
                if x.shape[1] != dim:
                    continue
                c = deviations(x, b.n, b.sums)
                exact = c if c.dtype != object and dim * _bound(c) ** 2 <= _MOST else c.astype(object)
                far = (exact * exact).sum(axis=1)
                far = pa.array([int(v) if v <= _MOST else None for v in far], pa.int64()) if exact.dtype == object else pa.array(far)
                m, out = len(rows), np.full((len(rows), k), np.nan)
                out[:, :rank] = _whiten(c, b)
                again = pa.array(np.repeat(np.arange(m), k))
                none = np.tile(np.arange(k) >= rank, m)
                cols = [
                    batch.column(0).take(pa.array(rows)).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, b.n, np.int64)),
                    far.take(again),
                    pa.array(out.ravel(), mask=none),
                    pa.array(b.explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(spark: SparkSession, embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each sound row and component.

    A row whose vector is null or holds a null or non-finite entry is
    dropped; so is one whose length is not the commonest among distinct
    sound vectors (the longer of two as common).  Entries become
    ``floor(256 * c)``, held at the bounds of 64 bits.  The fit takes each distinct
    integer vector once, however many rows repeat it; n is their number.
    Components go by falling variance, up to ``components`` of them or the number of dimensions;
    one without variance (beyond the rank; all, where only one vector is distinct) has null
    whitened values, explained is null where nothing varies, and identity_error
    is measured over the distinct vectors and the components that vary, null without any.  A deviation
    that does not fit 64 bits is null.  Ids are only carried: null and repeated ones stay.  Columns
    other than vec_id and embedding are not read.  An empty table gives an empty result.
    """
    ws = Workspace(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    distinct = ws.cut(rows.select("embedding").mapInArrow(_encode, "dim int, x binary").distinct())
    lengths = distinct.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None or not lengths["dim"]:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    own = distinct.where(F.col("dim") == dim)
    b = basis(fit(ws, own, dim), components)
    error = _identity_error(own, b, dim)
    ws.drop(distinct)
    return rows.mapInArrow(_applier(b, dim, error), schema)
