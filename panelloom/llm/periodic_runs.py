"""Periodic runs of words: stretches that repeat a block of ``q`` words at least four times.

A run is a stretch with smallest period ``q`` (words ``q`` apart are equal) and a length of at least
``max(LEAST_WORDS, LEAST_REPEATS * q)`` that no neighbouring word extends. All of them are found, whatever their period.

Periods are taken by octave ``[s, 2s)``, ``s`` a power of two. A run of such a period holds three blocks of ``s`` words
that return ``q`` words later, so a boundary at some multiple of ``s`` starts one of them. Hashes of all blocks of ``s``
words, made by doubling, show which boundaries can do so. Consecutive ones make a tile: their words, ``s`` before and
``4s`` after. A tile is solved on its own. At each boundary one Z-function forward and one backward give, for every
period at once, how far words ``q`` apart agree to both sides, on the words themselves, so a collision of hashes does
no harm. Periods that are multiples of a shorter one there are left out (two periods of a stretch as long as both have
their greatest common divisor as a period).

What a tile finds are fragments ``[x, y)`` of positions whose word returns ``q`` words later. Fragments meet by document
and period and are stitched: those that touch are one stretch. The tiles of a text of more than ``LONG`` characters are
shuffled, so that one very long text is solved by many tasks; those of other texts are solved where they are made.

NULL and empty texts have no words and no runs. Rows of one ``doc_id`` with different texts are documents of their own;
equal rows give equal results, each its own row; a NULL ``doc_id`` is an id like others. Columns other than ``doc_id``
and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import map_arrow, texts_of, thinned, written

LEAST_WORDS, LEAST_REPEATS = 6, 4
# Characters of a text from which its tiles are shuffled, and words of one tile beside its margins.
LONG, TILE_WORDS = 1 << 19, 1 << 14
SLICE = 1 << 20
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_RANDOM = np.random.Generator(np.random.PCG64(20261202))
FACTORS = _RANDOM.integers(1, 1 << 63, (64, 2), dtype=np.uint64) | np.uint64(1)
KEY = "xxhash64(doc_id, _text)"


def word_ids(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers of its distinct words; the text is taken in slices that end between words."""
    known: dict[bytes, int] = {}
    parts = []
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in SPACE:
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def boundaries(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(s, positions)`` per octave: the multiples of ``s`` whose block of ``s`` words may return ``q`` words later, ``s <= q < 2s``."""
    n, step, octave = len(ids), 1, 0
    with np.errstate(over="ignore"):
        hashes = (ids.astype(np.uint64) + np.uint64(1)) * FACTORS[63, 0]
        hashes ^= hashes >> np.uint64(29)
        while n >= max(LEAST_WORDS, LEAST_REPEATS * step):
            # hashes[i] covers the words i .. i + step - 1.
            if len(hashes) <= step:
                return
            blocks = len(hashes) // step
            table = hashes[: blocks * step].reshape(blocks, step)
            # Each block's first hash against those that start in the next block, which may be a part of one.
            hit = (table[1:] == table[:-1, :1]).any(axis=1)
            last = (hashes[blocks * step :] == table[-1, 0]).any()
            places = np.flatnonzero(np.append(hit, last)) * step
            if len(places):
                yield step, places
            hashes = hashes[:-step] * FACTORS[octave, 0] + hashes[step:] * FACTORS[octave, 1]
            hashes ^= hashes >> np.uint64(31)
            step, octave = 2 * step, octave + 1


def z_function(words: list[int], stop: int) -> list[int]:
    """Length of the common prefix of ``words`` and each of its suffixes that start before ``stop``."""
    n = len(words)
    z = [0] * n
    left = right = 0
    for i in range(1, min(n, stop)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(words: np.ndarray, base: int, step: int, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(q, x, y)`` of one tile: the words from ``base`` on, the boundaries ``places``, periods of the octave ``step``.

    Each fragment is a stretch of positions whose word returns ``q`` words later, at least ``step`` of them.
    """
    ends: dict[int, list[int]] = {}
    for place in places.tolist():
        b = place - base
        ahead = words[b : b + 4 * step].tolist()
        z = z_function(ahead, 2 * step)
        # A shorter period d that holds up to d + z[d] makes the periods up to there, less a block, its multiples.
        reach = max((d + z[d] for d in range(1, min(step, len(ahead)))), default=0)
        found = [q for q in range(step, min(2 * step, len(ahead))) if z[q] >= step and q + step > reach]
        if not found:
            continue
        low = max(0, b - step)
        behind = words[low:b][::-1].tolist()
        # The end of the text before b + q, read backwards, against the end of the text before b.
        joined = behind + [-1] + words[low : b + 2 * step][::-1].tolist()
        top = len(joined)
        back = z_function(joined, top - (b - low) - found[0] + 1)
        for q in found:
            # The prefix that ends before b + q starts at this place of the reversed text.
            at = top - (b - low) - q
            x, y = place - min(back[at], len(behind)) if behind else place, place + min(z[q], 2 * step)
            spans = ends.setdefault(q, [])
            if spans and x <= spans[-1]:
                spans[-1] = max(spans[-1], y)
            else:
                spans += [x, y]
    for q, spans in ends.items():
        for x, y in zip(spans[::2], spans[1::2]):
            yield q, x, y


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(s, base, places, words)``: runs of consecutive boundaries with their words, ``s`` before and ``4s`` after."""
    for step, places in boundaries(ids):
        most = max(TILE_WORDS, 8 * step)
        start = 0
        while start < len(places):
            stop = int(np.searchsorted(places, places[start] + most))
            # A gap without boundaries ends a tile.
            gaps = np.flatnonzero(np.diff(places[start:stop]) > 8 * step)
            if len(gaps):
                stop = start + int(gaps[0]) + 1
            base = max(0, int(places[start]) - step)
            yield step, base, places[start:stop], ids[base : int(places[stop - 1]) + 4 * step]
            start = stop


NAMES = ("doc_id", "key", "n_words", "plain_sha256", "q", "x", "y")
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
FRAGMENT = "`doc_id` {}, key bigint, n_words bigint, plain_sha256 string, q bigint, x bigint, y bigint"
# Words of tiles in one batch.
BATCH_WORDS = 1 << 20


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    return texts_of(docs, ["doc_id"], text).selectExpr("doc_id", f"{KEY} AS key", "_text")


def _rows(batch: pa.RecordBatch, rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    """``rows`` are a row of ``batch``, whose first two columns are kept, and the values of the others."""
    of, *values = zip(*rows) if rows else [[] for _ in names[1:]]
    take = pa.array(of, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(2)] + [pa.array(v, k) for v, k in zip(values, kinds)], names=list(names))


def fragments(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: one per document (``doc_id, key, n_words, plain_sha256``, the digest of its words joined by one
    space), and one per fragment (``doc_id, key, q, x, y``)."""
    rows = _keyed(docs)
    schema = FRAGMENT.format(rows.schema["doc_id"].dataType.simpleString())
    tile_names = (*NAMES[:4], "step", "base", "places", "words")
    tile_kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def solve_here(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                ids, words = word_ids(bytes(batch.column(2)[r].as_buffer()))
                out.append((r, len(ids), joined_digest(ids, words), None, None, None))
                for step, base, places, some in tiles(ids):
                    out += [(r, None, None, *f) for f in solve(some, base, step, places)]
            yield _rows(batch, out, NAMES, KINDS)

    def cut(batches):
        for batch in batches:
            out, held = [], 0
            for r in range(batch.num_rows):
                ids, words = word_ids(bytes(batch.column(2)[r].as_buffer()))
                out.append((r, len(ids), joined_digest(ids, words), None, None, None, None))
                for step, base, places, some in tiles(ids):
                    out.append((r, None, None, step, base, places.astype("<i8").tobytes(), some.astype("<i4").tobytes()))
                    held += len(some)
                    if held > BATCH_WORDS:
                        yield _rows(batch, out, tile_names, tile_kinds)
                        out, held = [], 0
            yield _rows(batch, out, tile_names, tile_kinds)

    def solve_tiles(batches):
        for batch in batches:
            n, digest, step, base, places, words = (batch.column(i).to_pylist() for i in range(2, 8))
            out = []
            for r in range(batch.num_rows):
                if step[r] is None:
                    out.append((r, n[r], digest[r], None, None, None))
                else:
                    some = np.frombuffer(words[r], "<i4")
                    out += [(r, None, None, *f) for f in solve(some, base[r], step[r], np.frombuffer(places[r], "<i8"))]
            yield _rows(batch, out, NAMES, KINDS)

    short = map_arrow(rows.where(f"length(_text) <= {LONG}"), solve_here, schema)
    tile_schema = schema.split(", q bigint")[0] + ", step int, base bigint, places binary, words binary"
    cuts = map_arrow(rows.where(f"length(_text) > {LONG}"), cut, tile_schema)
    return short.unionByName(map_arrow(cuts.repartition("doc_id", "key", "step", "base"), solve_tiles, schema))


def joined_digest(ids: np.ndarray, words: list[bytes]) -> str:
    """Digest of the words joined by one space, in slices."""
    out = hashlib.sha256()
    for at in range(0, len(ids), 1 << 16):
        out.update((b" " if at else b"") + b" ".join([words[i] for i in ids[at : at + (1 << 16)].tolist()]))
    return out.hexdigest()


def stitched(found: DataFrame) -> DataFrame:
    """``doc_id, key, q, x, y``: the stretches that the fragments of a document and period make up."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def joined(batches):
        last = None
        done: list[list] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            for doc, key, q, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if last and [doc, key, q] == last[:3] and x <= last[4]:
                    last[4] = max(last[4], y)
                    continue
                if last:
                    done.append(last)
                last = [doc, key, q, x, y]
                if len(done) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                    done = []
        if last:
            done.append(last)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    by = ["doc_id", "key", "q"]
    rows = found.where("q IS NOT NULL").select(*by, "x", "y").repartition(*by).sortWithinPartitions(*by, "x")
    return map_arrow(rows, joined, f"`doc_id` {kind}, key bigint, q bigint, x bigint, y bigint")


def periodic_runs(found: DataFrame) -> DataFrame:
    """``doc_id, key, start, length, period``: every run of the documents whose ``fragments`` are given."""
    long_enough = f"y - x + q >= greatest({LEAST_WORDS}, {LEAST_REPEATS} * q)"
    stretches = stitched(found).where(long_enough).selectExpr("doc_id", "key", "x AS start", "y - x + q AS length", "q")
    # A stretch of a multiple of its smallest period is the same stretch.
    return stretches.groupBy("doc_id", "key", "start", "length").agg(F.min("q").alias("period"))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words stays: those after the first period of a run go."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def collapsed(docs: DataFrame, by_document: DataFrame) -> DataFrame:
    """``doc_id, key, collapsed``: the words of the documents with runs (``doc_id, key, runs``), joined by one space,
    without those that a run repeats."""
    # Only the texts that have runs are shuffled.
    texts = thinned(_keyed(docs), "key", by_document, "key").withColumnsRenamed({"doc_id": "_doc", "key": "_key"}).distinct()
    met = texts.join(by_document, F.expr("_key = key AND _doc <=> doc_id")).select("doc_id", "key", "runs", "_text")
    kind = met.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                ids, words = word_ids(bytes(batch.column(3)[r].as_buffer()))
                some = [(v["start"], v["length"], v["period"]) for v in batch.column(2)[r].as_py()]
                out.append(b" ".join([words[i] for i in ids[kept_words(len(ids), some)].tolist()]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["doc_id", "key", "collapsed"])

    return map_arrow(met, cut, f"`doc_id` {kind}, key bigint, collapsed string")


def found_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_words, plain_sha256, runs, collapsed``.

    ``runs`` are ``(start, period, length)`` by start, then period, never NULL. ``collapsed`` is NULL for documents
    without runs; their words joined by one space have the digest ``plain_sha256``.
    """
    found = written(fragments(docs))
    lists = periodic_runs(found).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    lists = written(lists)
    short = collapsed(docs, lists).withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    results = lists.join(short, F.expr("key = _key AND doc_id <=> _doc")).select("doc_id", "key", "runs", "collapsed")
    results = results.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    rows = found.where("n_words IS NOT NULL").select("doc_id", "key", "n_words", "plain_sha256")
    met = rows.join(results, F.expr("key = _key AND doc_id <=> _doc"), "left")
    none = F.expr("CAST(array() AS array<struct<start:bigint,period:bigint,length:bigint>>)")
    return met.select("doc_id", "n_words", "plain_sha256", F.coalesce("runs", none).alias("runs"), "collapsed")
