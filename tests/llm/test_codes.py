"""Directly addressable codes: the library's identifiers, round trips and random access."""

import os
import zlib

import numpy as np
import pytest

from panelloom.llm import direct_codes, queries
from panelloom.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected(pairs, library):
    out, start = [], 0
    for doc, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = library(text)
        out.append((doc, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segments_round_trip_and_random_access(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.integers(0, 1 << 32, n), 1 << rnd.integers(0, 33, n)).astype("<u4")
    segment = direct_codes.Segment(direct_codes.packed(ids))
    assert len(segment) == n and np.array_equal(segment.all(), ids)
    places = rnd.integers(0, n, 3 * n) if n else np.zeros(0, int)
    assert np.array_equal(segment.at(places), ids[places])
    with pytest.raises(IndexError):
        segment.at(np.array([n]))


def test_small_ids_take_nine_bits():
    assert len(direct_codes.packed(np.full(1 << 16, 200, "<u4"))) < (1 << 16) + 100
    mixed = np.tile(np.array([7, 300], "<u4"), 1 << 15)
    assert len(direct_codes.packed(mixed)) < 1.75 * len(mixed)


def test_query_equals_the_library(spark, library):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op12_direct_codes(spark, SF).collect())
    assert got == [(d, s, n, zlib.crc32(ids)) for d, s, n, ids in expected(pairs, library)]


def test_odd_rows_segments_and_tokens_at(spark, monkeypatch, library, odd_docs, odd_pairs, no_docs):
    monkeypatch.setattr(direct_codes, "SEGMENT", 700)
    pairs = [*odd_pairs, (30, "a<|endoftext|>b <|endoftext|>"), (31, "x\xa0y　 z\x85\x1d w"), (32, " ​ ﻿ q ᠎ r")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(pairs[-3:], "doc_id bigint, text string"))
    path = scratch_path(spark, "codes")
    direct_codes.write(docs, path)
    got = [tuple(r) for r in direct_codes.read(spark, path).orderBy("start").collect()]
    want = expected(pairs, library)
    # Rows of one id come in an order of their own, end to end.
    assert sorted(((g[0], g[3]) for g in got), key=str) == sorted(((w[0], w[3]) for w in want), key=str)
    assert [g[1] for g in got] == list(np.cumsum([0] + [g[2] for g in got[:-1]]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert spark.read.parquet(path).count() > 5
    one = dict((g[0], np.frombuffer(g[3], "<u4")) for g in got)
    wanted = [(5, i) for i in range(0, len(one[5]), 97)] + [(4, 0), (30, 1), (30, 99), (77, 0), (5, -1)]
    found = {(r[0], r[1]): r[2] for r in direct_codes.tokens_at(spark, path, spark.createDataFrame(wanted, "doc_id bigint, i bigint")).collect()}
    assert found == {(d, i): one[d][i] for d, i in wanted if d in one and 0 <= i < len(one[d])}
    empty = scratch_path(spark, "codes")
    direct_codes.write(no_docs, empty)
    assert direct_codes.read(spark, empty).count() == 0


@pytest.mark.parametrize("bound", [0, 2000, 1 << 26])
def test_words_of_earlier_texts_are_not_encoded_again(monkeypatch, library, odd_pairs, bound):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(direct_codes, "KNOWN_BYTES", bound)
    encoder = direct_codes.Encoder(public_tokenizers.path(direct_codes.TOKENIZER))
    encoded = []
    words = encoder.words
    encoder.words = lambda some: encoded.extend(some) or words(some)
    texts = [*(t or "" for _, t in odd_pairs), "a  b", " a b", "x\xa0y　 z\x85\x1d w", "a b\n c", "\ta b "]
    for some in (texts, texts[::-1], texts[:3], [*texts, "unseen before"], [""], texts):
        assert [i.tolist() for i in encoder.ids(pa.array(some))] == [library(t)[:-1] for t in some]
    assert bound == 0 or bound == 2000 or len(encoded) == len(set(encoded))
