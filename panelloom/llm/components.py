"""Connected components by forests of a task's links and alternating star steps, on links of any size and shape."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import map_arrow, written

# Links of one task.
LINKS = 250_000


def _to_least(links: DataFrame, of: str) -> DataFrame:
    """``links`` with the least ``b`` of each ``a`` beside it; the minimum is taken before the shuffle, and the join
    can split a hot ``a``."""
    return links.join(links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), F.expr("a = k")).selectExpr(*of.split("; "))


def forest(links: DataFrame) -> DataFrame:
    """``a, b``: each node of the ``links`` of a task with the least node that it reaches there; roots are left out.

    A task holds ``LINKS`` links at most; from more it passes on one forest after the other.
    """

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        one, two = at[: len(a)], at[len(a) :]
        up = np.arange(len(nodes))
        while True:
            least = np.minimum(up[one], up[two])
            before = up.copy()
            # Not only the nodes but their roots take the least.
            for side in (one, two):
                np.minimum.at(up, before[side], least)
                np.minimum.at(up, side, least)
            up = up[up]
            if np.array_equal(up, before):
                break
        some = np.flatnonzero(up != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[up[some]])], names=["a", "b"])

    def solved(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(h.num_rows for h in held) + batch.num_rows > LINKS:
                yield found(held)
                held = []
            held.append(batch)
        if held:
            yield found(held)

    return map_arrow(links.select("a", "b"), solved, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the least node that each node of ``links`` (``a, b``) reaches, itself included. The links are
    read twice, so they should be written.

    At most ``LINKS`` links are one task's forest. Of more each task leaves a forest, and rounds follow: a round hangs
    every node's larger neighbours on its least one, then every node's smaller neighbours on the least of them; the paths
    halve at least. The links of a round are written to the shared folder. It ends when a round changes nothing; each
    node then hangs on its component's least node.
    """

    def few(links: int) -> int:
        """Few links need few tasks and files."""
        return links // LINKS + 1

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def named(stars: DataFrame) -> DataFrame:
        roots = stars.selectExpr("b AS node", "b AS component").distinct()
        return stars.selectExpr("a AS node", "b AS component").unionByName(roots)

    given = links.where("a <> b")
    n = given.count()
    now = written(forest(given.coalesce(few(n))))
    if n <= LINKS:
        return named(now)
    seen = None
    while True:
        found = stamp(now)
        if found == seen:
            return named(now)
        seen = found
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        large = _to_least(both, "b AS a; least(a, m) AS b; a AS x").where("a > x").select("a", "b").distinct()
        large = written(large.coalesce(few(2 * seen[0])))
        small = _to_least(large, "a AS x; b AS y; m")
        small = small.selectExpr("x AS a", "m AS b").unionByName(small.selectExpr("y AS a", "m AS b")).where("a <> b").distinct()
        now = written(small.coalesce(few(2 * seen[0])))
