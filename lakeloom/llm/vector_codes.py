"""Vector code compression: product codes trained with adaptive distance bounds.

A vector is cut into equal parts; every part position has a codebook of k
entries and a vector's code is the nearest entry of each part. The codebooks
come from k-means, with the assignments of each round found by the bounds of
Drake and Hamerly ("Accelerated k-means with adaptive distance bounds", 2012).

**State.** Written for every part of every vector: its b closest entries in
order, a lower bound on the distance to each but the first, ordered, and one
outer bound for all entries not listed. After a round each bound shrinks by the
way its entry moved, the outer bound by the longest way of any entry, and a pass
from the outer bound inwards keeps the bounds ordered.

**Assignment.** The distance u to the listed first entry is exact. If u is
below the first bound, no other entry can be as near and nothing is done. If it
is below a later one, the entries before that are compared by exact integer
distances (ties to the lower index) and put in order with new bounds. If it is
below none, all k entries are compared and the list is made anew. Bounds are
rounded down and u up, so rounding can only cause a needless comparison; equal
distances always reach the integers.

**Adapting b.** b starts at k / 4. After each round with bounds it falls to the shortest
list beyond which at most 1 % of the parts had to look, not under k / 8 or 2.

Rounds read the previous state and write the next one to the shared folder; the
one before is then removed, so two states exist at most. Sums, counts and list
depths are added up inside each task; parts * k * (part length + 1) numbers reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TMP, prepare
from .vectors import ID, VEC, drop, integers, kept, matrix, slot_sums

NEAR, LOW, DEEP = f"{TMP}near", f"{TMP}low", f"{TMP}deep"
SPARE = 0.01  # share of parts that may look beyond a shortened list
EPS = 1e-12


def _down(square: np.ndarray) -> np.ndarray:
    """Float32 square roots, not above the true ones."""
    return np.nextafter((np.sqrt(square.astype(np.float64)) * (1 - EPS)).astype(np.float32), np.float32(-np.inf))


def _ordered(low: np.ndarray) -> np.ndarray:
    return np.minimum.accumulate(low[..., ::-1], axis=-1)[..., ::-1]


class Books:
    """Codebooks (parts, k, m) and how far each entry moved to get there."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries.astype(np.int64)
        gap = self.entries - (self.entries if before is None else before)
        self.moves = np.sqrt((gap * gap).sum(axis=2).astype(np.float64)) * (1 + EPS)

    def squares(self, x: np.ndarray, part: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of ``x`` (n, m) of these parts
        to the entries ``which`` (n, c)."""
        gap = x[:, None, :] - self.entries[part[:, None], which]
        return (gap * gap).sum(axis=2)

    def full(self, x: np.ndarray, part: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``b`` nearest entries in order, and the bounds."""
        k = self.entries.shape[1]
        every = np.broadcast_to(np.arange(k), (len(x), k))
        d = self.squares(x, part, every)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        low = np.full((len(x), b), np.float32(np.inf))
        low[:, :min(b, k - 1)] = _down(d[:, 1:b + 1])
        return order[:, :b].astype(np.uint8), low

    def step(self, x: np.ndarray, near: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, low, deep) after the entries moved. ``x`` is (n, parts, m),
        ``near`` and ``low`` (n, parts, b); ``deep`` is how many listed entries
        besides the first were looked at, b for a full comparison."""
        n, parts, b = near.shape
        p = np.arange(parts)[None, :]
        shift = np.empty((n, parts, b))
        shift[..., :-1] = self.moves[p[..., None], near][..., 1:]
        shift[..., -1] = self.moves.max(axis=1)
        bound = _ordered(low.astype(np.float64) * (1 - EPS) - shift)
        gap = x - self.entries[p, near[..., 0]]
        u = np.sqrt((gap * gap).sum(axis=2).astype(np.float64)) * (1 + EPS)
        safe = u[..., None] < bound
        deep = np.where(safe.any(axis=2), safe.argmax(axis=2), b)
        near, low = near.copy(), np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
        for z in range(1, b + 1):
            at = np.nonzero(deep == z)
            if not len(at[0]):
                continue
            if z == b:
                near[at], low[at] = self.full(x[at], at[1], b)
                continue
            some = near[at][:, :z + 1].astype(np.int64)
            d = self.squares(x[at], at[1], some)
            order = np.lexsort((some, d), axis=1)
            row, d = near[at], np.take_along_axis(d, order, axis=1)
            row[:, :z + 1] = np.take_along_axis(some, order, axis=1)
            near[at] = row
            to = low[at]
            to[:, :z] = _down(d[:, 1:])
            low[at] = _ordered(to)
        return near, low, deep.astype(np.uint8)


def _state(b: pa.RecordBatch, near: np.ndarray, low: np.ndarray, deep: np.ndarray, n_keep: int) -> pa.RecordBatch:
    n = b.num_rows
    cols = [pa.array([r.tobytes() for r in near.reshape(n, -1)], pa.binary()),
            pa.array([r.astype("<f4").tobytes() for r in low.reshape(n, -1)], pa.binary()),
            pa.array([r.tobytes() for r in deep], pa.binary())]
    return pa.RecordBatch.from_arrays([*b.columns[:n_keep], *cols], names=[*b.schema.names[:n_keep], NEAR, LOW, DEEP])


def _numbers(column: pa.Array, kind, parts: int) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, kind).reshape(len(column), parts, -1)


def _step(state: DataFrame, books: Books, b: int) -> DataFrame:
    """The state after one more assignment, with lists of ``b`` entries. The
    first assignment is given the plain vectors, which have no lists yet."""
    parts, _, m = books.entries.shape
    n_keep, first = state.columns.index(VEC) + 1, NEAR not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            x = matrix(rows.column(n_keep - 1), parts * m).reshape(-1, parts, m)
            if first:
                part = np.tile(np.arange(parts), len(x))
                near, low = (a.reshape(len(x), parts, b) for a in books.full(x.reshape(-1, m), part, b))
                deep = np.zeros((len(x), parts), np.uint8)
            else:
                near, low = _numbers(rows.column(n_keep), np.uint8, parts), _numbers(rows.column(n_keep + 1), "<f4", parts)
                # Shorter lists: the first bound cut off holds for all that follow.
                near, low, deep = books.step(x, near[..., :b], low[..., :b])
            yield _state(rows, near, low, deep, n_keep)

    kept_cols = state.select(*[f"`{c}`" for c in state.columns[:n_keep]])
    return state.mapInArrow(run, kept_cols.schema.add(NEAR, "binary").add(LOW, "binary").add(DEEP, "binary"))


def _gather(state: DataFrame, books: Books, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after this assignment, and how many parts looked how deep."""
    parts, k, m = books.entries.shape
    offset = np.arange(parts)[None, :] * k

    def count(rows: pa.RecordBatch) -> np.ndarray:
        x = matrix(rows.column(0), parts * m).reshape(-1, m)
        at = (_numbers(rows.column(1), np.uint8, parts)[..., 0] + offset).ravel()
        total = np.zeros((parts * k, m + 1), np.int64)
        np.add.at(total[:, :m], at, x)
        total[:, m] = np.bincount(at, minlength=parts * k)
        deep = np.bincount(_numbers(rows.column(2), np.uint8, parts).ravel(), minlength=b + 1)
        return np.concatenate([total.ravel(), deep.astype(np.int64)])

    got = slot_sums(state.select(VEC, NEAR, DEEP), count)
    new = books.entries.copy()
    for i in range(parts * k):
        n = got.get(i * (m + 1) + m, 0)
        if n:
            new[i // k, i % k] = [got.get(i * (m + 1) + d, 0) // n for d in range(m)]
    deep = np.array([got.get(parts * k * (m + 1) + z, 0) for z in range(b + 1)])
    return new, deep


def _coded(state: DataFrame, books: Books, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the code and its error, from a final state."""
    parts, _, m = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = matrix(rows.column(len(keep)), parts * m).reshape(-1, parts, m)
            best = _numbers(rows.column(len(keep) + 1), np.uint8, parts)[..., 0] if rows.num_rows else np.zeros((0, parts), np.uint8)
            gap = x - books.entries[np.arange(parts)[None, :], best]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:len(keep)], pa.array([r.tobytes().hex() for r in best], pa.string()),
                 pa.array((gap * gap).sum(axis=(1, 2)))], names=[*keep, f"{TMP}code", f"{TMP}error"])

    rows = state.select(*[f"`{c}`" for c in keep], VEC, NEAR)
    return rows.mapInArrow(run, rows.drop(VEC, NEAR).schema.add(f"{TMP}code", "string").add(f"{TMP}error", "long"))


def compress(df: DataFrame, keep: list[Column], id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64,
             parts: int = 8, scale: int = 4096, k: int = 16, rounds: int = 6) -> tuple[DataFrame, list[list[list[int]]]]:
    """The ``keep`` columns of every vector that is kept with ``__ll_code`` (two
    hex digits per part) and ``__ll_error`` (squared distance to what the code
    stands for), and the codebooks (parts, entries, components).

    Dropped are rows whose vector is null, has another length than ``dims`` or
    holds a null or non-finite component. The first codebook of each part are
    the parts of the ``k`` vectors of least id (ties: least components; rows
    without id last); fewer vectors give fewer entries. Repeated rows count as
    often as they occur. Besides ``keep`` only the two named columns are read.
    A table without a usable vector gives an empty result and no codebooks. A
    component beyond the limit of ``vectors`` raises.
    """
    if dims % parts or k > 256:
        raise ValueError("dims must be a multiple of parts and k at most 256")
    prepare(df.sparkSession)
    vectors, folder = kept(integers(df, [*keep, F.col(id_col).alias(ID)], vec_col, dims, scale), "op13-vectors")
    names, m = vectors.columns[:-2], dims // parts
    first = vectors.orderBy(F.col(ID).asc_nulls_last(), F.col(VEC)).limit(k).select(VEC).collect()
    if not first:
        return vectors.select(*[f"`{c}`" for c in names], F.lit("").alias(f"{TMP}code"), F.lit(0).cast("long").alias(f"{TMP}error")), []
    books = Books(np.array([r[0] for r in first]).reshape(-1, parts, m).transpose(1, 0, 2))
    state, b, least = vectors.drop(ID), max(2, k // 4), max(2, k // 8)
    b, least = min(b, len(first)), min(least, len(first))
    for r in range(rounds):
        old, (state, folder) = folder, kept(_step(state, books, b), "op13-state")
        drop(state, old)
        entries, deep = _gather(state, books, b)
        books = Books(entries, books.entries)
        beyond = deep[::-1].cumsum()[::-1]  # parts that looked at z or more entries
        while r and b > least and beyond[b - 1] <= SPARE * deep.sum():
            b -= 1
    out, _ = kept(_coded(_step(state, books, b), books, names), "op13-codes")
    drop(out, folder)
    return out, books.entries.tolist()


def decode(code: Column, books: list[list[list[int]]]) -> Column:
    """The integer vector that a code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(x) for x in e]) for e in part]) for part in books])
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(
        F.get(table, p), F.conv(F.substring(code, p * 2 + 1, F.lit(2)), 16, 10).cast("int"))))
