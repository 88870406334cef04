"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets.

A document's set of word shingles is hashed by ``PERMUTATIONS`` permutations, and both the least and the largest value
under each are kept: twice as many signature values as hash evaluations, and estimates of lower variance. ``BANDS``
bands of ``ROWS`` values bring similar documents together.

Documents with equal sets are one node, found by a 128-bit digest before anything is compared, so groups of exact
copies cost one node. Two rounds find all links between nodes that the bands bring together:

1. each node of a bucket with the bucket's least node;
2. in the buckets that still hold several components, the nodes whose signatures allow the wanted similarity to a node
   of another component form clusters; in a cluster all pairs of different components are compared. Buckets and
   clusters are dealt into tiles of bounded size, and a tile passes on one link per node, never its pairs.

Pairs are compared on their full sets, which are made anew for the nodes that need them; sets never travel with the
bands. A tile counts the shared shingles of all its pairs at once, by the product of two 0/1 matrices.

Texts without words (or NULL) have an empty set and link with nothing. A repeated doc_id is a row of its own. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import WORD, Parts, map_arrow, runs, texts_of, thinned, written
from panelloom.llm.components import components
from panelloom.llm.shingles import mixed, shingle_sets

PERMUTATIONS, BANDS, ROWS = 60, 24, 5
TILE = 1024
# Nodes and bytes of sets in one block of a cluster.
BLOCK_NODES, BLOCK_BYTES = 2048, 8 << 20
COLUMNS = 8 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240502))
FACTORS = _RANDOM.integers(1, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64) | np.uint64(1)
FLIPS = _RANDOM.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64)
STRIPE = 2048
TEXT_HASH = "xxhash64(coalesce(text, ''))"


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least, then largest value under each permutation."""
    low, high = None, None
    for at in range(0, len(hashes), STRIPE):
        values = (hashes[at : at + STRIPE] ^ FLIPS) * FACTORS
        least, most = values.min(axis=1), values.max(axis=1)
        low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band from signatures of one row each."""
    rows = values.reshape(len(values), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS))
    for i in range(ROWS):
        keys = mixed(keys + rows[:, :, i])
    return keys


def cut(similarity: float) -> float:
    """Least share of equal signature values that a pair of this similarity has, but for 1 in 10 billion pairs."""
    return similarity - 6.5 * math.sqrt(similarity * (1 - similarity) / (2 * PERMUTATIONS))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_hash, digest, n_shingles, marks, bands``: a digest of the set, one byte of each signature value, the keys."""

    def sketched(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(2).to_pylist(), width))
            full = [i for i, s in enumerate(sets) if len(s)]
            values = np.array([signature(sets[i]) for i in full], np.uint64).reshape(len(full), 2 * PERMUTATIONS)
            marks, keys = (values & np.uint64(255)).astype(np.uint8), band_keys(values).view(np.int64)
            at = {i: r for r, i in enumerate(full)}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([marks[at[i]].tobytes() if i in at else None for i in range(len(sets))], pa.binary()),
                    pa.array([keys[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "digest", "n_shingles", "marks", "bands"],
            )

    rows = docs.selectExpr("doc_id", f"{TEXT_HASH} AS text_hash", "coalesce(text, '') AS _text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, sketched, f"doc_id {kind}, text_hash bigint, digest binary, n_shingles bigint, marks binary, bands array<bigint>")


def set_bytes(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, hashes``: the packed sets of the ``wanted`` nodes (``node, least, digest``), from one document of each."""

    def made(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(2).to_pylist(), width))
            same = [i for i, d in enumerate(batch.column(1).to_pylist()) if digest(sets[i]) == d]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(same, pa.int64())), pa.array([sets[i].tobytes() for i in same], pa.binary())],
                names=["node", "hashes"],
            )

    rows = thinned(texts_of(docs, ["doc_id"]).withColumnRenamed("doc_id", "_doc"), "_doc", wanted, "least").join(wanted, F.expr("_doc <=> least")).select("node", "digest", "_text")
    return map_arrow(rows, made, "node bigint, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a, b``) with 100 * intersection >= percent * union on the full sets."""

    def kept(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.selectExpr("node AS m", "hashes AS one")
    two = sets.selectExpr("node AS n", "hashes AS two")
    met = pairs.join(two, F.expr("b = n")).join(one, F.expr("a = m")).select("a", "b", "one", "two")
    return map_arrow(met, kept, "a bigint, b bigint")


def alike(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` whose signatures agree in at least this share of the values, but for chance agreements of a byte."""

    def kept(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((one == two).mean(axis=1) >= least))

    met = pairs.join(marks.selectExpr("node AS n", "marks AS two"), F.expr("b = n")).join(marks.selectExpr("node AS m", "marks AS one"), F.expr("a = m"))
    return map_arrow(met.select("a", "b", "one", "two"), kept, "a bigint, b bigint")


def _tree(node: np.ndarray, parts: Parts) -> pa.RecordBatch:
    """One link for each row that is not the root of its part."""
    root = parts.roots(np.arange(len(node)))
    some = np.flatnonzero(root != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"])


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``node`` and ``tiles``), each copied to the pairs of blocks (``i``, ``j``) of its block ``side``."""
    sided = rows.withColumn("side", F.expr("CAST(pmod(xxhash64(node), tiles) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    sided = sided.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("tiles", "other")
    return sided.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def candidate_links(rows: DataFrame, least: float) -> DataFrame:
    """Links that join all nodes of a tile of ``rows`` (``key, node, label, marks, tiles``) whose signatures agree and
    whose labels differ."""

    def linked(batches):
        for table in runs(batches, ("key", "i", "j")):
            node, label, side = (table[c].to_numpy() for c in ("node", "label", "side"))
            marks = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(len(table), -1)
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            parts = Parts(len(node))
            for r in left:
                others = right[right > r] if i == j else right
                others = others[label[others] != label[r]]
                if len(others):
                    others = others[(marks[others] == marks[r]).mean(axis=1) >= least]
                    if len(others):
                        parts.join(np.append(others, r))
            yield _tree(node, parts)

    return map_arrow(_dealt(rows, "key").select("key", "i", "j", "side", "node", "label", "marks"), linked, "a bigint, b bigint").distinct()


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set alone is shared by none.
    place = np.cumsum(times > 1) - 1
    common = times[column] > 1
    owner, column = owner[common], place[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(1, COLUMNS // max(1, len(sets)))
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, width):
        a, b = np.searchsorted(column, (at, at + width))
        flags = np.zeros((len(sets), min(width, last - at)), np.float32)
        flags[owner[a:b], column[a:b] - at] = 1
        out += flags[left] @ flags[right].T
    return out


def cluster_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links that join all nodes of a tile of ``rows`` (``cluster, node, label, hashes, tiles``) that are similar enough
    on their full sets and whose labels differ."""

    def linked(batches):
        for table in runs(batches, ("cluster", "i", "j")):
            node, label, side = (table[c].to_numpy() for c in ("node", "label", "side"))
            sets = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
            size = np.array([len(s) for s in sets], np.float32)
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            parts = Parts(len(node))
            if len(left) and len(right):
                shared = shared_counts(sets, left, right)
                close = 100 * shared >= percent * (size[left, None] + size[right] - shared)
                close &= label[left, None] != label[right]
                for r in np.flatnonzero(close.any(axis=1)):
                    parts.join(np.append(right[close[r]], left[r]))
            yield _tree(node, parts)

    return map_arrow(_dealt(rows, "cluster").select("cluster", "i", "j", "side", "node", "label", "hashes"), linked, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, part, component_id, kept`` for each row of ``docs`` (``doc_id, text``).

    Documents are linked from ``percent`` of 100 in Jaccard similarity on their sets of ``width``-word shingles;
    ``component_id`` is the least doc_id reachable by links, ``part`` a number of the component, NULL for an empty set.
    """
    least = cut(percent / 100)
    rows = written(sketches(docs, width))
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("marks").alias("marks"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    # The number of a node is fixed by writing it down once.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high")
    buckets = written(buckets.withColumnRenamed("key", "k"))
    members = keys.join(buckets, F.expr("key = k")).select("key", "node", "low", "held")
    marks = nodes.select("node", "marks")

    stars = written(alike(members.where("node <> low").selectExpr("low AS a", "node AS b").distinct(), marks, least))
    wanted = nodes.select("node", "least", "digest")

    def sets_of(pairs: DataFrame) -> DataFrame:
        some = pairs.selectExpr("a AS p").union(pairs.selectExpr("b AS p")).distinct()
        return set_bytes(docs, wanted.join(some, F.expr("node = p"), "left_semi"), width)

    links = written(confirmed(stars, sets_of(stars), percent))
    found = components(links).withColumnRenamed("node", "n")

    # Buckets of two are settled; so are those in one component.
    labelled = members.where("held > 2").join(found, F.expr("node = n"), "left").selectExpr("key", "node", "held", "coalesce(component, node) AS label")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").selectExpr("key AS k")
    parted = labelled.join(open_keys, F.expr("key = k"), "left_semi").join(marks.withColumnRenamed("node", "n"), F.expr("node = n"))
    parted = parted.selectExpr("key", "node", "label", "marks", f"CAST(ceil(held / {TILE}D) AS INT) AS tiles")
    maybe = written(candidate_links(parted, least))
    if not maybe.isEmpty():
        clusters = written(components(maybe).withColumnRenamed("component", "cluster"))
        clusters = clusters.join(nodes.select("node", "least", "digest", "size"), "node").join(found, F.expr("node = n"), "left").drop("n")
        clusters = written(clusters.withColumn("label", F.expr("coalesce(component, node)")).drop("component"))
        blocks = clusters.groupBy(F.col("cluster").alias("c")).agg(
            F.expr(f"CAST(greatest(ceil(count(1) / {BLOCK_NODES}D), ceil(sum(size) * 8 / {BLOCK_BYTES}D)) AS INT)").alias("tiles")
        )
        placed = clusters.join(blocks, F.expr("cluster = c")).select("node", "cluster", "label", "tiles")
        sets = set_bytes(docs, clusters.select("node", "least", "digest"), width)
        more = cluster_links(placed.join(sets, "node"), percent)
        found = components(links.unionByName(written(more))).withColumnRenamed("node", "n")

    joined = nodes.select("node", "digest", "least").join(found, F.expr("node = n"), "left").selectExpr("digest AS d", "least", "coalesce(component, node) AS part")
    lowest = joined.groupBy("part").agg(F.min("least").alias("component_id")).withColumnRenamed("part", "p")
    parts = joined.join(lowest, F.expr("part = p")).select("d", "part", "component_id")
    result = rows.join(parts, F.expr("digest = d"), "left")
    result = result.selectExpr("doc_id", "text_hash", "n_shingles", "part", "CASE WHEN digest IS NULL THEN doc_id ELSE component_id END AS component_id")
    return result.withColumn("kept", F.expr("doc_id <=> component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, that of the least doc_id. All columns stay.

    Texts without words are no duplicates, except of a row that is equal in all columns.
    """
    names = docs.columns
    found = near_duplicates(docs.select("doc_id", "text"), width, percent).where("kept")
    copies = found.groupBy("doc_id", "part", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    chosen = copies.groupBy("doc_id", "part", F.expr("CASE WHEN part IS NULL THEN text_hash END").alias("_own")).agg(F.min(F.struct("text_hash", "copies")).alias("_one"))
    chosen = written(chosen.selectExpr("doc_id AS d", "_one.text_hash AS t", "_one.copies AS copies").distinct())
    # Columns get names of our own, so none of theirs can clash.
    own = [f"_c{i}" for i in range(len(names))]
    doc, text = own[names.index("doc_id")], own[names.index("text")]
    rows = docs.toDF(*own).withColumn("_hash", F.expr(TEXT_HASH.replace("text", text)))
    one = rows.join(chosen.where("copies = 1"), F.expr(f"{doc} <=> d AND _hash = t"), "left_semi").select(*own)
    # Only rows that share their id and text meet as whole rows. Of those that differ in other columns the least stays;
    # those without words are told apart by all columns, NULL from ''.
    several = chosen.where("copies > 1")
    row = F.struct(*own)
    bare = F.when(~F.coalesce(F.col(text), F.lit("")).rlike(WORD), row)
    met = thinned(rows, "_hash", several, "t").join(several, F.expr(f"{doc} <=> d AND _hash = t"), "left_semi")
    least = met.groupBy(doc, "_hash", bare.alias("_bare")).agg(F.min(row).alias("_row")).select("_row.*")
    return one.unionByName(least).toDF(*names)
