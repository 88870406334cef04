"""Fixed-effects regressions, many specifications in one job.

A panel's columns are packed once per entity; each task then adds up, per specification and period, the cross products of
the entity-demeaned columns of its entities. Those sums give the period scores of the cross-section-robust covariance.
Coefficients, fit and rank come from a QR decomposition, since cross products square the condition number: each task
reduces its rows to one k x k triangle, and two triangles merge by the QR of one above the other. So the data is read once,
the specifications are not multiplied into rows, and a specification's rows are never gathered: what is shuffled is k x k
per (specification, period) and task, and it does not grow with the entities.

The covariance works on blocks of periods. A specification's triangle gives its coefficients; with them each period's
block of products becomes one vector, the period's score in units of the coefficients. A block of periods gets the scores
of the ``bandwidth`` periods before it as a halo, adds up its own autocovariances, and one k x k sum per block goes on.
So a calendar of any length spreads over tasks, and a task holds the scores of one block and its halo.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.text import idents
from panelloom.session import ensure_checkpoint_dir

# Bytes of sums a task may hold, and of dense columns it may unpack, before it passes them on.
SUMS_BUDGET = 256 << 20
BLOCK_BUDGET = 64 << 20

# Periods of one block of the covariance.
PERIOD_BLOCK = 1024

# A column is spanned by earlier ones if so small a part of its length is left beside them.
ALIAS_TOLERANCE = 1e-7

# The period under which a specification's triangle travels among its period sums.
TRIANGLE = -(1 << 31)

FIT_FIELDS = (
    pa.field("spec_id", pa.string()),
    pa.field("y", pa.string()),
    pa.field("terms", pa.list_(pa.string())),
    pa.field("beta", pa.list_(pa.float64())),
    pa.field("cov", pa.list_(pa.float64())),
    pa.field("aliased", pa.list_(pa.bool_())),
    pa.field("r2", pa.float64()),
    pa.field("n_obs", pa.int64()),
    pa.field("n_periods", pa.int32()),
    pa.field("n_entities", pa.int64()),
)


@dataclass(frozen=True)
class Spec:
    """One regression: a name, the outcome's column and the regressors' columns, in order."""

    name: str
    y: str
    x: tuple[str, ...]


class _PeriodSums:
    """Cross products by (group, specification) and period, with a bound on what is held."""

    def __init__(self) -> None:
        self._held: dict[tuple, list] = {}
        self._bytes = 0

    def add(self, key: tuple, first: int, counts: np.ndarray, entities: int, sums: np.ndarray, triangle: np.ndarray) -> None:
        held = self._held.get(key)
        if held is None:
            self._held[key] = [first, counts.copy(), sums.copy(), triangle, entities]
            self._bytes += sums.nbytes
            return
        held[3] = _merged_triangle(held[3], triangle)
        held[4] += entities
        start, stop = min(held[0], first), max(held[0] + len(held[1]), first + len(counts))
        if (start, stop) != (held[0], held[0] + len(held[1])):
            pad = (held[0] - start, stop - held[0] - len(held[1]))
            before = held[2].nbytes
            held[1] = np.pad(held[1], pad)
            held[2] = np.pad(held[2], (pad, (0, 0), (0, 0)))
            held[0] = start
            self._bytes += held[2].nbytes - before
        at = slice(first - held[0], first - held[0] + len(counts))
        held[1][at] += counts
        held[2][at] += sums

    @property
    def full(self) -> bool:
        return self._bytes > SUMS_BUDGET

    def drain(self, schema: pa.Schema, n_keys: int) -> Iterator[pa.RecordBatch]:
        """Pass on everything held, one batch per (group, specification), periods without rows left out."""
        for (group, spec), (first, counts, sums, triangle, entities) in self._held.items():
            used = np.flatnonzero(counts)
            if not len(used):
                continue
            n = len(used) + 1
            # The products are symmetric: half of them is enough.
            half = np.triu_indices(sums.shape[1])
            width = len(half[0])
            flat = pa.array(np.append(triangle[half], sums[used][:, half[0], half[1]].reshape(-1)))
            columns = [pa.array([group[i]] * n, schema.field(i).type) for i in range(n_keys)]
            columns += [
                pa.array([spec] * n, pa.string()),
                pa.array(np.append(TRIANGLE, used + first).astype("int32")),
                pa.array(np.append(entities, counts[used]).astype("int64")),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * width), flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        self._held.clear()
        self._bytes = 0


class _Block:
    """Dense columns of some entities, laid out (period, column, entity), absent cells 0 and marked."""

    def __init__(self, entities: pa.ListArray, width: int) -> None:
        lengths = entities.value_lengths().to_numpy(zero_copy_only=False)
        rows = entities.flatten()
        periods = rows.field("p").to_numpy(zero_copy_only=False)
        values = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
        self.first = int(periods.min())
        dense = np.full((int(periods.max()) - self.first + 1, len(lengths), width), np.nan)
        at = (periods - self.first, np.repeat(np.arange(len(lengths)), lengths))
        seen = np.zeros(dense.shape[:2], dtype=bool)
        seen[at] = True
        if seen.sum() != len(periods):
            raise ValueError("the panel has more than one row for an entity and period")
        dense[at] = values.reshape(-1, width)
        self.values = np.ascontiguousarray(dense.transpose(0, 2, 1))
        self.known = np.isfinite(self.values)
        self.values[~self.known] = 0.0

    def demeaned_products(self, columns: Sequence[int]) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """Row counts by period, entities, cross products by period of complete rows minus their entity's mean, triangle."""
        complete = self.known[:, columns].all(axis=1)
        weight = complete.astype(float)[:, None, :]
        z = self.values[:, columns]
        z *= weight
        z -= z.sum(axis=0) / np.maximum(weight.sum(axis=0), 1.0)
        z *= weight
        # The outcome goes last, so that its column of the triangle is the projection on the regressors.
        rows = np.roll(z.transpose(0, 2, 1)[complete], -1, axis=1)
        return complete.sum(axis=1), int(complete.any(axis=0).sum()), z @ z.transpose(0, 2, 1), _triangle(rows)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square factor R of the QR decomposition, with rows of zeros if there are too few."""
    k = rows.shape[1]
    found = np.zeros((k, k))
    reduced = np.linalg.qr(rows, mode="r")
    found[: len(reduced)] = reduced
    return found


def _merged_triangle(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The triangle of the rows behind both."""
    return _triangle(np.concatenate([one, two]))


def _unpacked_triangle(half: np.ndarray) -> np.ndarray:
    k = int((np.sqrt(8 * len(half) + 1) - 1) / 2)
    found = np.zeros((k, k))
    found[np.triu_indices(k)] = half
    return found


def _block_rows(series: pa.ListArray, rows: Sequence[int], width: int) -> Iterator[list[int]]:
    """The entities in blocks whose dense columns, over all periods that a block spans, stay within the budget.

    They come in the order of their first period, so a staggered panel gives narrow blocks. One entity is never cut.
    """
    lengths = series.value_lengths().to_numpy(zero_copy_only=False)
    periods = series.flatten().field("p").to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    first, last = np.minimum.reduceat(periods, starts), np.maximum.reduceat(periods, starts)
    part: list[int] = []
    low = high = 0
    for i in sorted(rows, key=lambda i: first[i]):
        wide = max(high, int(last[i])) if part else int(last[i])
        if part and (wide - low + 1) * (len(part) + 1) * width * 8 > BLOCK_BUDGET:
            yield part
            part, wide = [], int(last[i])
        if not part:
            low = int(first[i])
        part.append(i)
        high = wide
    if part:
        yield part


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields)


def period_products(
    panel: DataFrame, specs: Sequence[Spec], entity: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Cross products of the demeaned (y, x) by group, specification and period.

    ``panel`` has one row per (keys, entity, period_idx). Complete cases and entity means are those of each
    specification. Result: keys, ``spec_id``, ``period_idx``, ``n``, ``products`` (upper triangle by rows, y first).
    """
    return _sums(panel, specs, entity, keys).where(f"period_idx <> {TRIANGLE}")


def _sums(panel: DataFrame, specs: Sequence[Spec], entity: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``period_products``, and per group and specification a row of the period ``TRIANGLE`` with the triangle of (x, y) and
    the number of entities."""
    columns = sorted({c for s in specs for c in (s.y, *s.x)})
    at = {c: i for i, c in enumerate(columns)}
    layout = [(s.name, [at[c] for c in (s.y, *s.x)]) for s in specs]
    width, n_keys = len(columns), len(keys)

    vector = ", ".join(f"cast({c} AS double)" for c in idents(columns))
    row = F.expr(f"named_struct('p', period_idx, 'v', array({vector}))")
    # One list per entity, at most one item per period of the calendar.
    packed = panel.groupBy(*keys, *entity).agg(F.collect_list(row).alias("series")).select(*keys, "series")
    schema = f"{_key_fields(panel, keys)}spec_id string, period_idx int, n bigint, products array<double>"

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _PeriodSums()
        arrow = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            arrow = arrow or _sums_schema(batch.schema, n_keys)
            groups = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)])) or [()] * batch.num_rows
            members: dict[tuple, list[int]] = {}
            for i, group in enumerate(groups):
                members.setdefault(group, []).append(i)
            series = batch.column(n_keys)
            for group, rows in members.items():
                for part in _block_rows(series, rows, width):
                    block = _Block(series.take(pa.array(part)), width)
                    for name, wanted in layout:
                        held.add((group, name), block.first, *block.demeaned_products(wanted))
                        if held.full:
                            yield from held.drain(arrow, n_keys)
        if arrow is not None:
            yield from held.drain(arrow, n_keys)

    partial = packed.mapInArrow(accumulate, schema)
    return _merge_products(partial, keys, schema)


def _sums_schema(batch: pa.Schema, n_keys: int) -> pa.Schema:
    return pa.schema(
        [batch.field(i) for i in range(n_keys)]
        + [
            pa.field("spec_id", pa.string()),
            pa.field("period_idx", pa.int32()),
            pa.field("n", pa.int64()),
            pa.field("products", pa.list_(pa.float64())),
        ]
    )


def _merge_products(partial: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """Add up the tasks' partial sums; each (group, specification, period) meets in one task, sorted, as a stream."""
    n_keys = len(keys)
    by = [*keys, "spec_id", "period_idx"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, count, total = None, 0, None
        for batch in batches:
            names, types = batch.schema.names, batch.schema.types
            ids = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys + 2)]))
            counts = batch.column(n_keys + 2).to_pylist()
            lists = batch.column(n_keys + 3)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, key in enumerate(ids):
                products = flat[offsets[i] : offsets[i + 1]]
                if key == now and key[-1] == TRIANGLE:
                    count += counts[i]
                    both = _merged_triangle(_unpacked_triangle(total), _unpacked_triangle(products))
                    total = both[np.triu_indices(len(both))]
                    continue
                if key == now:
                    count, total = count + counts[i], total + products
                    continue
                if now is not None:
                    done.append((*now, count, total))
                now, count, total = key, counts[i], products.copy()
                if len(done) >= 4096:
                    yield _rows(done, names, types)
                    done = []
        if now is not None:
            yield _rows([*done, (*now, count, total)], names, types)

    return partial.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, schema)


def _rows(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=list(names))


def _square(halves: np.ndarray, side: int) -> np.ndarray:
    """Upper triangles to symmetric matrices."""
    rows, columns = np.triu_indices(side)
    full = np.empty((len(halves) // len(rows), side, side))
    full[:, rows, columns] = full[:, columns, rows] = halves.reshape(-1, len(rows))
    return full


def _independent(triangle: np.ndarray) -> list[int]:
    """Columns of the triangle not spanned by earlier ones."""
    lengths = np.sqrt((triangle**2).sum(axis=0))
    usable = lengths > 0
    left = np.abs(np.diag(triangle))
    if (left[usable] > ALIAS_TOLERANCE * lengths[usable]).all() and usable.all():
        return list(range(len(lengths)))
    kept: list[int] = []
    for j in np.flatnonzero(usable).tolist():
        # What is left of the column beside the kept ones; a dropped column would bring in noise as a direction.
        rest = triangle[:, j]
        if kept:
            basis = np.linalg.qr(triangle[:, kept] / lengths[kept])[0]
            rest = rest - basis @ (basis.T @ rest)
            rest = rest - basis @ (basis.T @ rest)
        if np.sqrt(rest @ rest) > ALIAS_TOLERANCE * lengths[j]:
            kept.append(j)
    return kept


def _solve(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray, float | None, int]:
    """Coefficients (NaN: aliased), inverse of the cross products (0 for aliased ones), fit and rank from the triangle."""
    k = len(triangle) - 1
    regressors, outcome = triangle[:, :k], triangle[:, k]
    used = np.array(_independent(regressors), dtype=int)
    beta, inverse = np.full(k, np.nan), np.zeros((k, k))
    fitted, around = 0.0, float(outcome @ outcome)
    if len(used):
        # Columns of one length: the condition that is left is that of their directions.
        scale = np.sqrt((regressors[:, used] ** 2).sum(axis=0))
        q, r = np.linalg.qr(regressors[:, used] / scale)
        projected = q.T @ outcome
        back = np.linalg.inv(r)
        beta[used] = back @ projected / scale
        inverse[np.ix_(used, used)] = back @ back.T / np.outer(scale, scale)
        fitted = float(projected @ projected)
    return beta, inverse, fitted / around if around > 0 else None, len(used)


def block_autocovariance(scores: np.ndarray, halo: int, bandwidth: int) -> np.ndarray:
    """Bartlett-weighted sum of products of the rows from ``halo`` on with themselves and up to ``bandwidth`` rows back."""
    own = scores[halo:]
    found = own.T @ own
    for j in range(1, min(bandwidth, len(scores) - 1) + 1):
        start = max(halo, j)
        lagged = scores[start:].T @ scores[start - j : len(scores) - j]
        found += (1 - j / (bandwidth + 1)) * (lagged + lagged.T)
    return found


def _numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a column of lists, and where each list begins and the last ends."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _spans(ids: Sequence[tuple]) -> Iterator[tuple[int, int]]:
    """Runs of equal keys."""
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[start]:
            yield start, i
            start = i


def _solved_heads(sums: DataFrame, keys: Sequence[str], max_lag: int | None, small_sample: bool) -> DataFrame:
    """Per specification: ``beta`` (NULL: aliased), ``inverse`` (scaled as the covariance wants it), ``r2``, ``n_obs``,
    ``n_periods``, ``lag`` (the bandwidth) and ``blocks`` of periods."""
    names = [f.name for f in sums.select(*keys).schema.fields]
    schema = (
        f"{_key_fields(sums, keys)}spec_id string, beta array<double>, inverse array<double>, r2 double, n_obs bigint, "
        "n_periods int, n_entities bigint, lag int, blocks array<int>"
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for half, n, periods in zip(*(batch.column(c).to_pylist() for c in ("triangle", "n_obs", "n_periods"))):
                beta, inverse, r2, rank = _solve(_unpacked_triangle(np.array(half)))
                if small_sample and periods > 1 and n > rank:
                    inverse *= np.sqrt(periods / (periods - 1) * (n - 1) / (n - rank))
                lag = int(np.floor(periods**0.25)) if max_lag is None else max_lag
                found.append(([None if np.isnan(b) else float(b) for b in beta], inverse.reshape(-1), r2, lag))
            beta, inverse, r2, lag = zip(*found) if found else ([],) * 4
            lists = pa.list_(pa.float64())
            columns = [batch.column(c) for c in (*names, "spec_id")]
            columns += [pa.array(beta, lists), pa.array(inverse, lists), pa.array(r2, pa.float64()), batch.column("n_obs")]
            columns += [batch.column("n_periods"), batch.column("n_entities"), pa.array(lag, pa.int32()), batch.column("blocks")]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "spec_id", "beta", "inverse", "r2", "n_obs", "n_periods", "n_entities", "lag", "blocks"])

    is_period = F.col("period_idx") != TRIANGLE
    grouped = sums.groupBy(*keys, "spec_id").agg(
        F.any_value(F.when(~is_period, F.col("products")), True).alias("triangle"),
        F.coalesce(F.sum(F.when(is_period, F.col("n"))), F.lit(0)).alias("n_obs"),
        F.any_value(F.when(~is_period, F.col("n")), True).alias("n_entities"),
        F.count_if(is_period).cast("int").alias("n_periods"),
        F.collect_set(F.when(is_period, F.expr(_BLOCK))).alias("blocks"),
    )
    return grouped.mapInArrow(solve, schema)


_BLOCK = f"CAST(floor(period_idx / {PERIOD_BLOCK}) AS INT)"


def _period_scores(sums: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``period_idx, lag, score`` by specification and block: own periods, and as a halo those up to ``lag`` before."""
    schema = f"{_key_fields(sums, keys)}spec_id string, block int, period_idx int, lag int, score array<double>"
    n_keys = len(keys)
    known = F.transform("beta", lambda b: F.coalesce(b, F.lit(0.0)))
    # Each block of periods gets its specification's coefficients, which sort before all periods.
    solved = heads.select(
        *keys, "spec_id", F.explode("blocks").alias("block"), F.lit(TRIANGLE).alias("period_idx"), "lag",
        F.array_max("blocks").alias("last"), F.concat(known, "inverse").alias("numbers"),
    )
    nothing = F.lit(0)
    periods = sums.where(f"period_idx <> {TRIANGLE}").select(
        *keys, "spec_id", F.expr(_BLOCK).alias("block"), "period_idx", nothing.alias("lag"), nothing.alias("last"),
        F.col("products").alias("numbers"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = beta = inverse = None
        lag = last = 0
        for batch in batches:
            ids = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys + 2)]))
            at = batch.column("period_idx").to_numpy()
            flat, offsets = _numbers(batch.column("numbers"))
            taken, blocks, lags, found = [], [], [], []
            for start, stop in _spans(ids):
                if ids[start] != now:
                    now, head = ids[start], flat[offsets[start] : offsets[start + 1]]
                    k = int((np.sqrt(4 * len(head) + 1) - 1) / 2)
                    beta, inverse = head[:k], head[k:].reshape(k, k)
                    lag, last = batch.column("lag")[start].as_py(), batch.column("last")[start].as_py()
                    start += 1
                if start == stop:
                    continue
                products = _square(flat[offsets[start] : offsets[stop]], len(beta) + 1)
                scores = (products[:, 1:, 0] - products[:, 1:, 1:] @ beta) @ inverse
                first = now[-1]
                until = np.minimum((at[start:stop].astype(np.int64) + lag) // PERIOD_BLOCK, max(last, first))
                for block in range(first, int(until.max()) + 1):
                    rows = np.flatnonzero(until >= block)
                    taken.append(rows + start)
                    blocks.append(np.full(len(rows), block, np.int32))
                    lags.append(np.full(len(rows), lag, np.int32))
                    found.append(scores[rows])
            if not taken:
                continue
            taken = pa.array(np.concatenate(taken))
            columns = [batch.column(i).take(taken) for i in range(n_keys + 1)]
            sizes = np.concatenate([np.full(len(f), f.shape[1]) for f in found])
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns += [pa.array(np.concatenate(blocks)), batch.column("period_idx").take(taken), pa.array(np.concatenate(lags))]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f.reshape(-1) for f in found]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: n_keys + 1], "block", "period_idx", "lag", "score"])

    by = [*keys, "spec_id", "block"]
    return solved.union(periods).repartition(*by).sortWithinPartitions(*by, "period_idx").mapInArrow(score, schema)


def _block_covariances(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cov``, one part of the covariance for each specification and block of periods."""
    schema = f"{_key_fields(scores, keys)}spec_id string, cov array<double>"
    n_keys = len(keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lag, periods, held = None, 0, [], []

        def part() -> tuple:
            at, rows = np.concatenate(periods), np.concatenate(held)
            # Periods without rows score zero.
            dense = np.zeros((at[-1] - at[0] + 1, rows.shape[1]))
            dense[at - at[0]] = rows
            halo = max(0, now[-1] * PERIOD_BLOCK - int(at[0]))
            return *now[:-1], block_autocovariance(dense, halo, lag).reshape(-1)

        for batch in batches:
            if not batch.num_rows:
                continue
            names, types = [*batch.schema.names[: n_keys + 1], "cov"], [*batch.schema.types[: n_keys + 1], pa.list_(pa.float64())]
            ids = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys + 2)]))
            at = batch.column("period_idx").to_numpy().astype(np.int64)
            flat, offsets = _numbers(batch.column("score"))
            done = []
            for start, stop in _spans(ids):
                if ids[start] != now:
                    if held:
                        done.append(part())
                    now, lag, periods, held = ids[start], batch.column("lag")[start].as_py(), [], []
                periods.append(at[start:stop])
                held.append(flat[offsets[start] : offsets[stop]].reshape(stop - start, -1).copy())
            if done:
                yield _rows(done, names, types)
        if held:
            yield _rows([part()], names, types)

    by = [*keys, "spec_id", "block"]
    return scores.repartition(*by).sortWithinPartitions(*by, "period_idx").mapInArrow(add, schema)


def fit(
    panel: DataFrame,
    specs: Sequence[Spec],
    entity: Sequence[str],
    keys: Sequence[str] = (),
    max_lag: int | None = None,
    small_sample: bool = False,
) -> DataFrame:
    """Within (entity fixed-effects) least squares with Driscoll-Kraay covariance, for all specifications.

    ``max_lag`` defaults to floor(T^(1/4)) of each fit, T being the periods in which any entity has a complete row,
    also where the panel is unbalanced. ``small_sample`` scales the covariance by
    T/(T-1) (n-1)/(n-k). A regressor spanned by earlier ones is aliased: coefficient NULL, covariance 0.
    A fit with no more rows than entities and regressors that are not aliased leaves no residual: its ``beta``, ``cov``,
    ``aliased`` and ``r2`` are NULL.
    One row per (keys, spec): ``terms``, ``beta``, ``cov`` (row-major), ``aliased``, ``r2``, ``n_obs``,
    ``n_periods``, ``n_entities``.
    """
    terms = {s.name: list(s.x) for s in specs}
    outcome = {s.name: s.y for s in specs}
    schema = (
        f"{_key_fields(panel, keys)}spec_id string, y string, terms array<string>, beta array<double>, "
        "cov array<double>, aliased array<boolean>, r2 double, n_obs bigint, n_periods int, n_entities bigint"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = now = head = total = None
        done: list[dict] = []

        def found() -> dict:
            *group, spec = now
            aliased = [b is None for b in head["beta"]]
            named = {"spec_id": spec, "y": outcome[spec], "terms": terms[spec], "aliased": aliased, "cov": total.tolist()}
            if head["n_obs"] <= head["n_entities"] + len(aliased) - sum(aliased):
                named |= dict.fromkeys(("beta", "cov", "aliased", "r2"))
            return {**dict(zip(keys, group)), **head, **named}

        for batch in batches:
            if not batch.num_rows:
                continue
            arrow = pa.schema([batch.schema.field(k) for k in keys] + list(FIT_FIELDS))
            ids = list(zip(*[batch.column(c).to_pylist() for c in (*keys, "spec_id")]))
            fits = batch.select(["beta", "r2", "n_obs", "n_periods", "n_entities"]).to_pylist()
            flat, offsets = _numbers(batch.column("cov"))
            for i, key in enumerate(ids):
                if key != now:
                    if now is not None:
                        done.append(found())
                    # The coefficients come first, the parts of the covariance after them.
                    now, head = key, fits[i]
                    total = np.zeros(len(head["beta"]) ** 2)
                else:
                    total = total + flat[offsets[i] : offsets[i + 1]]
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done = []
        if now is not None:
            done.append(found())
            yield pa.RecordBatch.from_pylist(done, arrow)

    # Written once, as large as specifications x periods: the coefficients and the scores both read it.
    ensure_checkpoint_dir(panel.sparkSession)
    sums = _sums(panel, specs, entity, keys).checkpoint()
    heads = _solved_heads(sums, keys, max_lag, small_sample)
    parts = _block_covariances(_period_scores(sums, heads, keys), keys)
    ids = [*keys, "spec_id"]
    solved = heads.select(*ids, F.lit(0).alias("part"), "beta", "r2", "n_obs", "n_periods", "n_entities", F.array().cast("array<double>").alias("cov"))
    met = solved.unionByName(parts.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return met.repartition(*ids).sortWithinPartitions(*ids, "part").mapInArrow(finish, schema)


def coefficients(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per coefficient: term, estimate, standard error, t value."""
    k = F.size("terms")
    at = F.transform("terms", lambda t, i: F.struct(
        t.alias("term"),
        F.get("beta", i).alias("estimate"),
        F.sqrt(F.get("cov", i * (k + 1))).alias("se"),
        F.get("aliased", i).alias("aliased"),
    ))
    rows = fits.select(*keys, "spec_id", "y", "r2", "n_obs", "n_periods", F.posexplode(at).alias("pos", "_c"))
    rows = rows.select(*keys, "spec_id", "y", "pos", "_c.*", "r2", "n_obs", "n_periods")
    rows = rows.withColumn("se", F.when(~F.col("aliased"), F.col("se")))
    return rows.withColumn("t", F.try_divide("estimate", "se"))


def fit_designs(
    designs: DataFrame,
    n_regressors: int,
    spec: str = "spec_id",
    entity: Sequence[str] = ("entity",),
    max_lag: int | None = None,
    small_sample: bool = False,
) -> DataFrame:
    """``fit`` for designs given as rows ``(spec, entity, period_idx, y, x ARRAY)``, one fit per value of ``spec``.

    For designs that share columns, ``fit`` on the wide panel avoids repeating them.
    """
    names = [f"x{j}" for j in range(n_regressors)]
    wide = designs.select(
        F.col(spec).alias("design"), *entity, "period_idx", "y",
        *[F.get("x", F.lit(j)).alias(n) for j, n in enumerate(names)],
    )
    fits = fit(wide, [Spec("all", "y", tuple(names))], entity, ["design"], max_lag, small_sample)
    return fits.drop("spec_id").withColumnRenamed("design", spec)
