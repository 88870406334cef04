"""Exact top-k inner products over a bit-sliced index.

Components are quantised to whole numbers. A block of candidates keeps, for each component and bit, one bitmap over its
rows. A query's score is a sum of such slices: each component of the query is written in signed digits, and every digit
adds the component's slices at its weight, complemented for a negative digit, where a constant corrects the order-
preserving shift. Slices of one weight are added by carry-save adders, three bitmaps to two, so the sum of all rows
takes bitmap operations only. Rows are then selected from the most significant slice of the sum downward; those that
still tie at the k-th place are resolved by id, and the selected rows' scores are computed as whole numbers.

The query set meets all candidates block by block: query blocks and candidate blocks are both bounded, a task holds one
pair of blocks, and only k rows per query and block go on to the final ranking.

Vectors that are NULL or hold NULL or non-finite components, and rows without an id, take no part. A shorter vector
counts as filled up with zeros. Rows that repeat an id and its quantised vector are one; an id with several vectors is
several candidates and, if it is a query, several queries with k results each; rows with the query's own id are never its
results. The slices are as many as the block's numbers and sums need, so nothing is cut off: a component that does not
fit a long after quantising, or a result's score that does not, is an error. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import small_batches, written

CANDIDATES, QUERIES = 16384, 1024
# Components of a larger size are refused: the numbers themselves are longs.
WIDEST = 2.0**62
USABLE = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))"


def signed_digits(value: int) -> list[tuple[int, int]]:
    """``value`` as sum of sign * 2 ** place, no two neighbouring places used."""
    out, place = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((place, digit))
            value -= digit
        value >>= 1
        place += 1
    return out


class SlicedBlock:
    """Bit-sliced index of the rows of ``values`` (whole numbers, one row per candidate, in the order of ``ids``)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, width = values.shape
        self.n, self.words = n, (n + 63) // 64
        self.low = values.min(axis=0) if n else np.zeros(width, np.int64)
        # Differences of two longs fit 64 bits without a sign.
        shifted = values.view(np.uint64) - self.low.view(np.uint64)
        self.bits = [int(x).bit_length() for x in (shifted.max(axis=0) if n else self.low)]
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.int64)
        planes = np.zeros((int(self.first[-1]), self.words * 64), np.uint8)
        for d, bits in enumerate(self.bits):
            for b in range(bits):
                planes[self.first[d] + b, :n] = (shifted[:, d] >> np.uint64(b)) & np.uint64(1)
        self.planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
        self.valid = self.bitmap(np.ones(n, bool))

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: self.n] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def summed(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the rows' scores but for one constant."""
        planes, weights, flips = [], [], []
        for d, value in enumerate(query.tolist()):
            for place, sign in signed_digits(value) if self.bits[d] else ():
                planes.append(np.arange(self.first[d], self.first[d + 1]))
                weights.append(np.arange(place, place + self.bits[d]))
                flips.append(np.full(self.bits[d], sign < 0))
        if not planes:
            return []
        planes, weights, flips = np.concatenate(planes), np.concatenate(weights), np.concatenate(flips)
        order = np.argsort(weights, kind="stable")
        planes, weights, flips = planes[order], weights[order], flips[order]
        ones = np.where(flips, ~np.uint64(0), np.uint64(0))
        cuts = np.searchsorted(weights, np.arange(weights[-1] + 2))
        slices, carried, w = [], [], 0
        while w < len(cuts) - 1 or carried:
            stack = carried
            if w < len(cuts) - 1 and cuts[w + 1] > cuts[w]:
                s = slice(cuts[w], cuts[w + 1])
                stack = [self.planes[planes[s]] ^ ones[s, None], *stack]
            stack = np.concatenate(stack) if stack else np.zeros((1, self.words), np.uint64)
            carried = []
            while len(stack) > 2:
                k = len(stack) // 3
                a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                odd = a ^ b
                carried.append((a & b) | (c & odd))
                odd ^= c
                stack = np.concatenate([odd, stack[3 * k :]]) if len(stack) > 3 * k else odd
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            slices.append(stack[0])
            w += 1
        return slices

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best rows, ties to the smaller id; not those of the query's id."""
        sure = np.zeros(self.words, np.uint64)
        level = self.valid & ~self.bitmap(self.ids == query_id)
        for part in reversed(self.summed(query)):
            above = sure | (level & part)
            count = int(np.bitwise_count(above).sum())
            if count > k:
                level = level & part
            elif count < k:
                sure, level = above, level & ~part
            else:
                sure, level = above, np.zeros_like(level)
                break
        chosen = self.rows(sure)
        # Rows that tie at the last place: the block is in the order of the ids.
        chosen = np.concatenate([chosen, self.rows(level)[: max(0, k - len(chosen))]])
        return self.ids[chosen], _scores(self.values[chosen], query)


def _scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs; beyond 2^62 they are added up as whole numbers of any size."""
    if not len(values) or (np.abs(values.astype(float)) @ np.abs(query.astype(float))).max() < 2.0**62:
        return values @ query
    exact = values.astype(object) @ query.astype(object)
    if max(map(abs, exact)) >= 1 << 63:
        raise OverflowError("the score of a result does not fit a long")
    return exact.astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and sizes.min() == width:
        return lists.flatten().to_numpy().astype(np.int64).reshape(-1, width)
    for row, values in zip(out, lists.to_pylist()):
        row[: len(values)] = values
    return out


def block_top(table: pa.Table, k: int) -> pa.Table:
    asks = table.filter(table["asks"])
    held = table.filter(pa.compute.invert(table["asks"])).sort_by("id")
    width = pa.compute.max(pa.compute.list_value_length(table["v"])).as_py() or 0
    block = SlicedBlock(held["id"].to_numpy(), _matrix(held["v"], width))
    asked = zip(asks["row"].to_pylist(), asks["id"].to_pylist(), _matrix(asks["v"], width))
    out = [(row, q, *block.top(q, v, k)) for row, q, v in asked] if len(held) else []
    none = np.zeros(0, np.int64)
    return pa.table(
        {
            "row": np.concatenate([none, *[np.full(len(i), row) for row, _, i, _ in out]]),
            "query_id": np.concatenate([none, *[np.full(len(i), q) for _, q, i, _ in out]]),
            "vec_id": np.concatenate([none, *[i for _, _, i, _ in out]]),
            "score": np.concatenate([none, *[s for _, _, _, s in out]]),
        }
    )


def top_k(df: DataFrame, queries: str = "vec_id % 100 = 0", scale: int = 1024, k: int = 10, candidates: int = CANDIDATES, asks: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``df`` with the largest inner product for each row of ``queries``."""
    small_batches(df.sparkSession)
    usable = df.where(f"vec_id IS NOT NULL AND {USABLE}").select("vec_id", "embedding").distinct()
    refused = "raise_error(concat('a component does not fit a long after quantising: ', x))"
    whole = f"transform(embedding, x -> CASE WHEN abs({scale}D * x) < {WIDEST}D THEN floor({scale}D * x) ELSE {refused} END)"
    rows = usable.selectExpr("CAST(vec_id AS BIGINT) AS id", f"{whole} AS v").distinct()
    # The number of a row is fixed by writing it down once.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    wanted = rows.where(queries.replace("vec_id", "id"))
    n, m = rows.count(), wanted.count()
    over, under = max(1, math.ceil(n / candidates)), max(1, math.ceil(m / asks))
    held = rows.selectExpr("row", "id", "v", "false AS asks", f"CAST(pmod(xxhash64(id, v), {over}) AS INT) AS c", f"explode(sequence(0, {under - 1})) AS q")
    asked = wanted.selectExpr("row", "id", "v", "true AS asks", f"explode(sequence(0, {over - 1})) AS c", f"CAST(pmod(xxhash64(row), {under}) AS INT) AS q")
    # One task for each pair of blocks.
    met = held.unionByName(asked).repartition(max(1, over * under), "c", "q")
    found = met.groupBy("c", "q").applyInArrow(lambda table: block_top(table, k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
