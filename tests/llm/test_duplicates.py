"""Suffix dedup, min-max dedup and embedding dedup against brute force."""

import hashlib
import math
import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest

from panelloom.llm import embed_dedup, minmax, shingles, suffix_dedup
from panelloom.llm.components import components

from .conftest import prose


def repeated_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        flags = np.cumsum(covered)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~flags])
        out.append((len(d), int(flags.sum()), int((np.diff(flags.astype(int), prepend=0) == 1).sum()), kept))
    return out


KEY = lambda r: tuple((v is not None, v) for v in r)


def plain(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=KEY)


@pytest.mark.parametrize("crowd", [2000, 2])
def test_suffix_dedup_equals_brute_force(spark, odd_docs, odd_pairs, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    short = [(i, None if t is None else t[:4000]) for i, t in odd_pairs]
    rnd = random.Random(5)
    passage = prose(77, 120)
    short += [(100 + k, prose(200 + k, rnd.randint(5, 60)) + " " + passage[rnd.randint(0, 90) :] + " " + prose(300 + k, 9)) for k in range(25)]
    docs = spark.createDataFrame(short, "doc_id bigint, text string")
    spans = suffix_dedup.repeats(docs, 400, 160, crowd)
    monkeypatch.setattr(suffix_dedup, "repeats", lambda d, length, **_: spans)
    wanted = sorted(((i, *r) for (i, _), r in zip(short, repeated_bytes([t for _, t in short], 400))), key=KEY)
    assert plain(suffix_dedup.without_repeats(docs).drop("n_passages", "passage_words")) == wanted


def shared_passages(texts, length):
    """Separate passages of ``length`` words that come up more than once, and the words they cover."""
    lists = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for words in lists:
        flags = np.zeros(len(words), bool)
        for i in range(len(words) - length + 1):
            if seen[tuple(words[i : i + length])] > 1:
                flags[i : i + length] = True
        out.append((int((np.diff(flags.astype(int), prepend=0) == 1).sum()), int(flags.sum())))
    return out


def test_repeated_passages_equal_brute_force(spark, odd_pairs):
    short = [(i, None if t is None else t[:3000]) for i, t in odd_pairs]
    # Short words: 51 of them are no string of 400 bytes.
    passage = " ".join("ab cde f".split() * 3 + [f"w{i}" for i in range(42)])
    short += [(100 + k, f"{prose(200 + k, 5 + k)} {passage}\n{prose(300 + k, 9)}") for k in range(6)]
    rows = [(i, t, 1, "x") for i, t in short]
    found = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, n_passages int, spans string"), words=51)
    wanted = sorted(((i, *r) for (i, _), r in zip(short, shared_passages([t for _, t in short], 51))), key=KEY)
    assert plain(found.select("doc_id", "n_passages", "passage_words")) == wanted
    assert plain(found.where("doc_id >= 100").select("n_removed").distinct()) == [(0,)]


def test_very_long_texts_and_empty_tables(odd_docs, no_docs):
    rows = {(r[0], r[1]): r for r in suffix_dedup.without_repeats(odd_docs).collect()}
    assert rows[4, 200_000].n_removed == 200_000
    assert suffix_dedup.without_repeats(no_docs).count() == 0
    cut = suffix_dedup.shortened(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert cut.where("doc_id = 4").first().text == "" and cut.where("doc_id = 1").first().text is None


def repeated_words(texts, words, length):
    """What stays of the texts: bytes outside repeated passages of words and of repeated strings with fewer words."""
    data = [t.encode() for t in texts]
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", d)] for d in data]
    passages = [[tuple(d[a:b] for a, b in s[i : i + words]) for i in range(len(s) - words + 1)] for d, s in zip(data, split)]
    few = lambda x: len(re.findall(rb"(?<=[ \t-\r])[^ \t-\r]+(?=[ \t-\r])", x)) < words
    strings = [[d[i : i + length] for i in range(len(d) - length + 1)] for d in data]
    times, seen = Counter(p for ps in passages for p in ps), Counter(x for xs in strings for x in xs)
    out = []
    for d, s, ps, xs in zip(data, split, passages, strings):
        gone = np.zeros(len(d), bool)
        for i, p in enumerate(ps):
            if times[p] > 1:
                runs = s[i : i + words]
                gone[runs[0][0] : runs[-1][1]] = True
        for i, x in enumerate(xs):
            if seen[x] > 1 and few(x):
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~gone]).decode())
    return out


@pytest.mark.parametrize("crowd", [2000, 2])
def test_passages_of_words_equal_brute_force(spark, crowd, monkeypatch):
    whole = suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda *a, **k: whole(*a, crowd=crowd, **k))
    rnd = random.Random(6)
    ascii_prose = lambda seed, n: prose(seed, n).encode("ascii", "ignore").decode()
    passage, long = ascii_prose(78, 130).split(), "".join(rnd.choice("abcdefgh") for _ in range(500))
    texts = [f"{ascii_prose(400 + k, rnd.randint(0, 60))} {rnd.choice(' \n').join(passage[(a := rnd.randint(0, 60)) : a + rnd.randint(45, 70)])} {ascii_prose(500 + k, 9)}" for k in range(25)]
    texts += [ascii_prose(2, 9) + " " + long + " end", long + ascii_prose(3, 80), "so it is " * 40, "", "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in suffix_dedup.shortened(docs, words=51).collect()}
    assert [found[i] for i in range(len(texts))] == repeated_words(texts, 51, 400)


def test_pipeline_cuts_passages_of_51_short_words(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(3)) for _ in range(n))
    planted, short = words(51), words(50)
    assert len(planted) < 400
    rows = [(k, f"{words(200)} A{k} {planted} B{k} {words(200)} C{k} {short} D{k}") for k in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert found == {k: t.replace(planted, "") for k, t in rows}


def test_suffix_sort_orders_suffixes():
    data = np.frombuffer(prose(9, 200).encode() * 2, np.uint8)
    sorter = suffix_dedup.SuffixSort(suffix_dedup.Polynomial(1), data, 50)
    at = np.arange(0, len(data) - 50, 3)
    found = sorter.sort(np.zeros(len(at), int), at)
    strings = [data[a : a + 50].tobytes() for a in found]
    assert strings == sorted(strings) and sorted(found) == sorted(at)


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def joined(ids, linked):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[root(a)] = root(b)
    return [root(i) for i in range(len(ids))]


def brute_components(pairs, width, percent):
    sets = [shingle_set(t, width) for _, t in pairs]
    links = [
        (a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    part = joined(pairs, links)
    ids = {}
    for (i, _), p in zip(pairs, part):
        if i is not None:
            ids[p] = min(ids.get(p, i), i)
    return [(i, len(s), ids.get(p) if s else i) for (i, _), s, p in zip(pairs, sets, part)]


def test_minmax_equals_brute_force(spark, odd_pairs, no_docs, monkeypatch):
    # Small tiles and blocks, so that hot groups are split.
    monkeypatch.setattr(minmax, "TILE", 7)
    monkeypatch.setattr(minmax, "BLOCK_NODES", 9)
    rnd = random.Random(3)
    pairs = list(odd_pairs)
    origin = prose(500, 200).split()
    for k in range(60):
        words = list(origin)
        for _ in range(rnd.randint(1, 9)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        pairs.append((1000 - k, " ".join(words)))
    docs = spark.createDataFrame(pairs, "doc_id bigint, text string")
    found = minmax.near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
    wanted = [(i, n, c, i == c) for i, n, c in brute_components(pairs, 3, 85)]
    assert plain(found) == sorted(wanted, key=KEY)
    assert minmax.near_duplicates(no_docs, 3, 85).count() == 0


def test_one_of_each_keeps_one_row(odd_docs, no_docs):
    kept = minmax.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 9, 10, 12, 13, 14, 15, 15, 16]
    assert minmax.one_of_each(no_docs).count() == 0


def test_one_of_each_keeps_rows_without_words_that_differ(spark):
    text = prose(7, 30)
    rows = [(1, None, "a"), (1, "", "a"), (1, "", "b"), (1, "", "b"), (2, " \n", None), (2, " \n", "c"), (3, text, "z"), (3, text, "y"), (3, text, None)]
    for order in (rows, rows[::-1]):
        kept = minmax.one_of_each(spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(3)).collect()
        assert sorted(map(tuple, kept), key=KEY) == sorted([*set(rows[:6]), (3, text, None)], key=KEY)


def test_shingle_sets_have_the_size_of_exact_ones(odd_pairs):
    texts = [t for _, t in odd_pairs]
    for width in (3, 5):
        assert [len(s) for s in shingles.shingle_sets(texts, width)] == [len(shingle_set(t, width)) for t in texts]


def test_signatures_estimate_similarity():
    rnd = np.random.Generator(np.random.PCG64(1))
    both, one, two = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = (minmax.signature(np.concatenate([both, x])) for x in (one, two))
    assert abs((a == b).mean() - 0.8) < 0.15


def test_shared_counts():
    rnd = random.Random(2)
    sets = [np.array(sorted({rnd.randrange(50) for _ in range(rnd.randint(1, 30))}), np.uint64) for _ in range(12)]
    found = minmax.shared_counts(sets, np.arange(5), np.arange(5, 12))
    assert found.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    found = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def jobs_of(spark, run):
    """What ``run`` returns, and how many Spark jobs it took."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "counted")
    try:
        return run(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_few_links_need_no_rounds(spark):
    # Each round leaves shuffle files and events behind, as many as there are partitions.
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    found, jobs = jobs_of(spark, lambda: dict(components(links).collect()))
    assert found == {i: 0 for i in range(301)}
    assert jobs <= 8


@pytest.mark.parametrize("most", [7, 40])
def test_components_of_many_tasks(spark, monkeypatch, most):
    monkeypatch.setattr("panelloom.llm.components.LINKS", most)
    rnd = random.Random(most)
    links = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(500 + i, 501 + i) for i in range(50)]
    rnd.shuffle(links)
    up = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in up:
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert sorted(components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()) == sorted(up.items())


def brute_vectors(rows, threshold):
    ok = [v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cos(np.float64(rows[a][1]), np.float64(rows[b][1])) >= threshold
    ]
    count = Counter(x for link in links for x in link)
    part = joined(rows, links)
    least = {}
    for (i, _, _), p in zip(rows, part):
        least[p] = min(least.get(p, i), i)
    return [(r[0], count[k], least[p], r[0] == least[p]) for k, (r, p) in enumerate(zip(rows, part))]


@pytest.mark.parametrize("block", [4096, 8])
def test_vectors_equal_brute_force(spark, block):
    rnd = np.random.Generator(np.random.PCG64(4))
    centre = rnd.normal(size=(4, 16))
    rows = [(i, (centre[i % 4] + 0.3 * rnd.normal(size=16)).astype(np.float32).tolist(), i % 3) for i in range(90)]
    rows += [(200 + i, rows[5][1], rows[5][2]) for i in range(4)] + [(5, rows[5][1], rows[5][2])]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 1), (306, [], 1)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, node string, n int")
    found = embed_dedup.near_duplicates(df, 0.93, block).select("vec_id", "n_links", "component_id", "kept")
    assert plain(found) == sorted(brute_vectors(rows, 0.93), key=KEY)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bounds_hold():
    rnd = np.random.Generator(np.random.PCG64(6))
    x = rnd.normal(size=(200, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes, step, length, loss = embed_dedup.quantised(unit)
    near = (codes.astype(float) @ codes.T.astype(float)) * step[:, None] * step
    assert (np.abs(near - unit @ unit.T) <= length[:, None] * loss + loss[:, None] + 1e-12).all()


def test_digest_of_kept_bytes(spark):
    row = suffix_dedup.without_repeats(spark.createDataFrame([(1, "plain text")], "doc_id bigint, text string")).first()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == hashlib.sha256(b"plain text").hexdigest()
