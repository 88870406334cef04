"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from panelloom.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(words):
    """``(start, length, period)`` of all runs."""
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    best = {}
    for q in range(1, len(ids) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids[:-q] == ids[q:], [0]])))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x + q >= max(6, 4 * q):
                best.setdefault((x, y - x + q), q)
    return sorted(((x, n, q) for (x, n), q in best.items()), key=lambda r: (r[0], r[2]))


def without(words, runs):
    gone = {i for x, n, q in runs for i in range(x + q, x + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def periodic_words(seed, n):
    rnd = random.Random(seed)
    words = []
    while len(words) < n:
        block = [str(rnd.randint(0, rnd.choice([1, 3, 50]))) for _ in range(rnd.choice([1, 2, 3, 5, 8, 17, 60]))]
        words += block * rnd.randint(1, 7)
    return words[:n]


def answers(df):
    return sorted(((r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in df.collect()), key=str)


def truth(pairs):
    out = []
    for doc, text in pairs:
        words = WORD.findall(text or "")
        runs = brute(words)
        out.append((doc, len(words), runs, " ".join(without(words, runs)) if runs else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("long", "tile"), [(1 << 19, 1 << 14), (10, 1), (400, 64)])
def test_runs_and_collapsed_texts(spark, monkeypatch, long, tile):
    monkeypatch.setattr(periodic_runs, "LONG", long)
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", tile)
    monkeypatch.setattr(periodic_runs, "SLICE", 64)
    pairs = [(i, " ".join(periodic_words(i, n))) for i, n in enumerate([5, 6, 7, 40, 200, 900, 2000])]
    pairs += [(20, "a " * 3000), (20, "a b " * 700 + "end"), (20, "a " * 3000), (21, "\tx\x0bx x\x1cx  x x x x x x\n")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in pairs], "doc_id bigint, text string, key int, step int")
    assert answers(periodic_runs.found_runs(df)) == truth(pairs)


def test_odd_rows(spark, odd_docs, odd_pairs, no_docs):
    assert answers(periodic_runs.found_runs(odd_docs)) == truth(odd_pairs)
    assert periodic_runs.found_runs(no_docs).count() == 0


def planted(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    expected = {}
    for doc, text in docs:
        words = planted(doc, text)
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{x},{n},{q}\n" for x, n, q in runs)
        expected[doc] = (
            len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(without(words, runs)).encode()).hexdigest(),
        )
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got == expected
    assert sum(v[0] > 0 for v in expected.values()) > 5
