"""Near-duplicate vectors by int8 tile products with error bounds.

Each vector is scaled to length 1 and quantised to int8 with a step of its own; the length of what is lost is kept. A
tile multiplies two blocks of int8 codes, exactly. By Cauchy-Schwarz the true cosine lies within
|code_a| loss_b + loss_a of the product, so a pair is linked or dismissed at once when its whole range lies on one side
of the threshold; only the rest is recomputed in double precision.

Vectors are compared within a label and a length. Equal vectors are one class, counted before the shuffle. A label's
classes are dealt by hash into blocks of about ``BLOCK``, and each pair of blocks is one task's work, so neither a hot
label nor a large group of copies meets in one task. A tile passes on one row per linked class: the number of rows it
links with and the least class of its part, never pairs.

Vectors that are NULL, zero, or hold NULL or non-finite components, and those without a label, link with nothing and
are their own component. A repeated vec_id is a row of its own. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import Parts, small_batches, written
from panelloom.llm.components import components

BLOCK = 4096
STRIP = 512
SLACK = 1e-9

USABLE = (
    "label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))"
    " AND exists(embedding, x -> x <> 0)"
)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, steps, lengths of the coded vectors and lengths of what the codes lose."""
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None])
    loss = np.linalg.norm(unit - codes * step[:, None], axis=1) * (1 + 1e-9) + 1e-15
    return codes.astype(np.int8), step, step * np.linalg.norm(codes, axis=1), loss


def linked_tile(a: np.ndarray, b: np.ndarray, threshold: float):
    """Strips (first row, boolean matrix) of the pairs of rows of ``a`` and ``b`` with cosine >= threshold."""
    units, coded = [], []
    for x in (a, b):
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        units.append(scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
        coded.append(quantised(units[-1]))
    (qa, sa, la, ea), (qb, sb, _, eb) = coded
    # Products of int8 codes are whole numbers that this type holds exactly.
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = qb.astype(kind).T
    for first in range(0, len(a), STRIP):
        s = slice(first, first + STRIP)
        near = (qa[s].astype(kind) @ right) * sa[s, None] * sb
        bound = la[s, None] * eb + ea[s, None] + SLACK
        linked = near - bound >= threshold
        rows, cols = np.nonzero(~linked & (near + bound >= threshold))
        for k in range(0, len(rows), 65536):
            r, c = rows[k : k + 65536], cols[k : k + 65536]
            linked[r, c] = np.einsum("ij,ij->i", units[0][first + r], units[1][c]) >= threshold
        yield first, linked


def tile_links(table: pa.Table, threshold: float) -> pa.Table:
    table = table.combine_chunks().sort_by("node")
    node, rows = table["node"].to_numpy(), table["n"].to_numpy()
    vectors = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), -1)
    block, one, two = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    links, parts = np.zeros(len(node), np.int64), Parts(len(node))
    for first, linked in linked_tile(vectors[left], vectors[right], threshold) if len(left) and len(right) else ():
        here = left[first : first + len(linked)]
        if one == two:
            linked &= np.arange(len(right)) > (first + np.arange(len(linked)))[:, None]
        links[here] += linked @ rows[right]
        links[right] += linked.T @ rows[here]
        for r in np.flatnonzero(linked.any(axis=1)):
            parts.join(np.append(right[linked[r]], here[r]))
    some = np.flatnonzero(links)
    return pa.table({"node": node[some], "links": links[some], "root": node[parts.roots(some)]})


def near_duplicates(df: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``df`` (``vec_id, embedding, label``)."""
    small_batches(df.sparkSession)
    vectors = df.select("vec_id", "embedding", "label")
    usable = vectors.where(USABLE)
    # The number of a class is fixed by writing it down once.
    classes = written(
        usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    cells = classes.groupBy("label", F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("_classes"))
    cells = cells.selectExpr("label AS l", "width AS w", f"CAST(ceil(_classes / {block}D) AS INT) AS blocks")
    dealt = classes.join(cells, F.expr("label = l AND size(embedding) = w"))
    dealt = dealt.selectExpr("label", "w AS width", "node", "n", "embedding", "blocks", "CAST(pmod(xxhash64(node), blocks) AS INT) AS block")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.selectExpr("label", "width", "node", "n", "embedding", "block", "least(block, other) AS i", "greatest(block, other) AS j")
    tiles = dealt.groupBy("label", "width", "i", "j").applyInArrow(
        lambda table: tile_links(table, threshold), "node bigint, links bigint, root bigint"
    )
    tiles = written(tiles)
    totals = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(tiles.where("node <> root").selectExpr("node AS a", "root AS b")).withColumnRenamed("node", "_node")
    parts = classes.join(found, F.expr("node = _node"), "left").selectExpr("label", "embedding", "node", "n", "least", "coalesce(component, node) AS component")
    least = parts.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "_component")
    whole = parts.join(least, F.expr("component = _component")).join(totals.withColumnRenamed("node", "_n"), F.expr("node = _n"), "left")
    whole = whole.selectExpr("label AS l", "embedding AS e", "n - 1 + coalesce(links, 0) AS n_links", "component_id")
    rows = usable.join(whole, F.expr("label = l AND embedding = e")).select("vec_id", "n_links", "component_id")
    alone = vectors.where(f"NOT coalesce({USABLE}, false)").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return rows.unionByName(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
