"""URL rules, top-k search, mixing, toxicity, language model and pipeline on small fixtures."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelloom.llm import bitsliced, maxent_lm, mixing, toxicity, url_rules

from .conftest import as_rows, prose

KEY = lambda r: tuple((v is not None, v) for v in r)


def plain(df):
    return sorted(map(tuple, df.collect()), key=KEY)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "https://example.net/en/", "https://example.net/en", "https://notexample.net/en/1",
    "http://x.net", "http://x.net/", "http://x.net?q=/", "http://example.com/de/?a#b", "http://sub.example.com/de", "ftp://org/fr/#x", "a://b://c/d",
    "http://x.org/fr/" + "y/" * 5000, "http://x.org/fr/", "http://x.org/fr/", "http://user@x.net:80/", "http://x.com/#/?", "http://é.net/ü?x",
]


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_list_rules(spark):
    rows = [(i % 19, u, "x", "y") for i, u in enumerate(URLS)]
    found = url_rules.judged(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"))
    got = plain(found.select("page_id", "host", "path", "rule", "verdict"))
    wanted = [(i, *rule_of(u)) for i, u, _, _ in rows]
    assert [g[:4] for g in got] == sorted([w[:4] for w in wanted], key=KEY)
    assert all(w[4] is None or w in got for w in wanted) and {g[4] for g in got} <= {"allow", "block"}
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judged(none).count() == 0
    assert plain(url_rules.judged(spark.createDataFrame([(1, None)], "page_id long, url string")).select("page_id", "host", "verdict")) == [(1, "", "allow")]


def test_association_rules_equal_apriori(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        tokens = sorted({rnd.choice("abcdef") for _ in range(4)})
        rows.append((tokens, "block" if "a" in tokens and ("b" in tokens or rnd.random() < 0.5) else "allow"))
    found = url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8)
    got = {(tuple(r.antecedent), r.verdict): round(r.confidence, 9) for r in found.collect()}
    from itertools import combinations

    every = {}
    for n in range(1, 7):
        for items in combinations("abcdef", n):
            hits = [v for t, v in rows if set(items) <= set(t)]
            for verdict in ("allow", "block"):
                k = hits.count(verdict)
                if k >= 0.02 * len(rows) and k >= 0.8 * len(hits):
                    every[items, verdict] = round(k / len(hits), 9)
    pruned = {k: c for k, c in every.items() if not any(v == k[1] and set(i) < set(k[0]) and d >= c for (i, v), d in every.items())}
    assert got == pruned


@pytest.mark.parametrize(("candidates", "asks"), [(16384, 1024), (16, 3)])
def test_top_k_equals_brute_force(spark, candidates, asks):
    rnd = np.random.Generator(np.random.PCG64(2))
    rows = [(i, rnd.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(400, rows[7][1]), (401, rows[7][1]), (402, rows[7][1]), (500, None), (501, [None] * 8), (502, [math.inf] * 8), (None, rows[3][1])]
    rows += [(600, [0.0] * 8), (700, [1e10, -1e10] + [0.0] * 6), (800, [0.5, 0.5]), (900, []), (300, rows[3][1]), (300, rows[3][1])]
    # An id with several vectors asks with each of them.
    rows += [(100, rows[5][1]), (100, rows[6][1]), (401, rows[8][1])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    whole = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.add((i, (*[math.floor(1024 * x) for x in v], *[0] * (8 - len(v)))))
    wanted = []
    for q, asked in whole:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in whole if i != q)[:10]
            wanted += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert plain(bitsliced.top_k(df, candidates=candidates, asks=asks)) == sorted(wanted)
    assert bitsliced.top_k(df.limit(0)).count() == 0


def test_wide_components():
    big = 1 << 61
    ids = np.arange(4)
    values = np.array([[big, -big, 1], [-big, big, 5], [big, big, -3], [0, 0, 9]], np.int64)
    block = bitsliced.SlicedBlock(ids, values)
    found, scores = block.top(9, np.array([1, 1, 3]), 4)
    assert dict(zip(found.tolist(), scores.tolist())) == {0: 3, 1: 15, 2: 2 * big - 9, 3: 27}
    assert block.top(9, np.array([1, 1, 3]), 1)[0].tolist() == [2]
    with pytest.raises(OverflowError):
        block.top(9, np.array([2, 2, 0]), 1)


def test_a_component_beyond_a_long_is_refused(spark):
    df = spark.createDataFrame([(100, [1e30]), (1, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        bitsliced.top_k(df).collect()


def test_signed_digits():
    for value in range(-300, 300):
        digits = bitsliced.signed_digits(value)
        assert sum(s << p for p, s in digits) == value and all(b[0] - a[0] > 1 for a, b in zip(digits, digits[1:]))


def water_level(sizes, weights, most):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i] * (1 + 1e-12)}
        if not over:
            return [float(most * sizes[i]) if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_targets_reshare_what_is_above(spark):
    rnd = random.Random(8)
    for _ in range(4):
        sizes = [rnd.choice([0, 1, 5, 40, 1000]) for _ in range(6)] + [0]
        names = ["a", "b", "c", "d", "e", "é", None]
        found = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
        got = {r.source: r.target for r in found}
        want = water_level(sizes, [1.0 + i % 3 for i in range(7)], 3)
        assert [got[n] for n in names] == pytest.approx(want)


def test_copies_follow_the_targets(spark, odd_docs, no_docs):
    rows = [(i, prose(i, 5 + i % 40), ["a", "b", "c", None][min(i % 7, 3)]) for i in range(600)]
    docs = mixing.with_size(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = mixing.copies(docs).collect()
    assert sorted(map(tuple, found), key=KEY) == plain(mixing.copies(docs))
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.copies <= 3
    for group in by.values():
        assert abs(sum(r.copies * r.size for r in group) - group[0].target) <= 2 * max(r.size for r in group)
    sized = mixing.with_size(odd_docs, "words").drop("size").withColumnRenamed("words", "size")
    assert mixing.copies(sized).count() == odd_docs.count()
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    taken = {(r.doc_id, r.size) for r in mixing.copies(sized).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()).keys() == {d for d, _ in taken}
    assert mixing.mix(no_docs).count() == mixing.copies(mixing.with_size(no_docs)).count() == 0


@pytest.fixture(scope="module")
def rude(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 40).split()
        if i % 4 == 0:
            for _ in range(3):
                words[rnd.randrange(40)] = rnd.choice(["scumbag", "ідіоt", "1d1ot", "Gritzfoo", "gritzbar", "SCUMBAG!"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - (i % 4 == 0), int(i % 4 == 0)))
    return spark.createDataFrame(as_rows(rows), "doc_id long, text string, a string, source string, b long, c long, score string, d int, e string, f int, g int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding():
    assert toxicity.folded("ІDІ0T, 1diot!\u200b sсum") == " idiot idiot scum "
    assert toxicity.folded("") == toxicity.folded(" .,; ") == "  "


def test_toxicity_on_held_out_rows(spark, rude, odd_docs, no_docs):
    docs, labels = rude
    lexicon = toxicity.fit(docs, labels, "doc_id % 3 <> 0")
    scores = toxicity.scored(docs, lexicon).where("doc_id % 3 = 0").collect()
    assert all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in scores)
    odd = toxicity.scored(odd_docs, lexicon).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.without_toxic(docs, lexicon).columns == docs.columns
    assert toxicity.without_toxic(docs, lexicon).where("doc_id % 4 = 0").isEmpty()
    assert toxicity.without_toxic(no_docs, lexicon).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(odd_docs, empty).collect()} == {0.0}


def test_exception_phrases_excuse():
    lexicon = toxicity.Lexicon({" scum": 5.0}, (" pond scum ",), 3.0, 1.0)
    automaton = lexicon.automaton()
    at = lambda text: lexicon.density(automaton, toxicity.folded(text))
    assert at("green pond scum") == at("a clean text") < at("such scum here")


def test_language_model(spark, odd_docs, no_docs, monkeypatch):
    # A small vocabulary, so that frequent, common and rare words all come up.
    monkeypatch.setattr(maxent_lm, "COMMON", maxent_lm.TOKENS + 50)
    rnd = random.Random(6)
    follow = {w: [rnd.choice("abcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}
    rows = []
    for i in range(500):
        words = ["a"]
        for _ in range(60):
            words.append(rnd.choice(follow[words[-1][0].lower()]) if rnd.random() < 0.95 else f"z{rnd.randrange(9000)}" if rnd.random() < 0.1 else "b")
            words[-1] = words[-1] if words[-1][0] != "z" else "a"
        rows.append((i, " ".join(words) + f" rare{i} word{i % 40}X"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in maxent_lm.scored(docs, "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 <> 2").collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == 2]
    words = {i: [*t.lower().split(), "\n"] for i, t in rows}
    counts = Counter(w for i in words if i not in held for w in words[i])
    total = sum(counts.values())
    for i in words:
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words[i])
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[i]), sum(counts[w] > 0 for w in words[i]), total)
        assert r.base_score == pytest.approx(base)
    assert sum(found[i].score for i in held) > sum(found[i].base_score for i in held)
    odd = maxent_lm.scored(odd_docs, "coalesce(doc_id % 2 = 0, true)").collect()
    assert len(odd) == odd_docs.count() and all(math.isfinite(r.score) and r.score < 0 for r in odd)
    assert maxent_lm.scored(no_docs, "true").count() == 0


def test_model_probabilities_add_up():
    vocabulary = maxent_lm.Vocabulary([b"a", b"b", b"\n"], np.array([5, 3, 2]), 10, 3, np.zeros(maxent_lm.RARE, np.int64), np.zeros(maxent_lm.RARE, np.int64))
    weights = maxent_lm.Weights.start(vocabulary)
    weights.classes += np.random.Generator(np.random.PCG64(1)).normal(size=weights.classes.shape).astype(np.float32)
    ids = np.arange(maxent_lm.TOKENS + maxent_lm.RARE)
    same = lambda n: np.full(len(ids), n)
    scores = maxent_lm.token_scores(weights, ids, same(1), same(2), same(0))
    assert np.exp(scores).sum() == pytest.approx(1, abs=1e-4)


def test_pipeline(spark, rude, tmp_path):
    import corpus_pipeline

    docs, labels = rude
    rows = docs.select("doc_id", "text", "source")
    more = spark.createDataFrame([(900, rows.first().text, "s1"), (901, None, None), (None, prose(1, 40), "s2"), (902, "", "s1")], rows.schema)
    whole = rows.unionByName(more).selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert kept.columns == before.columns
        if k == 0:
            assert sorted(r.doc_id for r in kept.where("doc_id < 400").collect()) == [i for i in range(400) if i % 4]
        if k == 1:
            assert 900 not in {r.doc_id for r in kept.collect()} or 0 not in {r.doc_id for r in kept.collect()}
    assert kept.where("NOT round_trip").isEmpty() and kept.count() == before.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()


def test_pipeline_encodes_with_one_python_worker_a_task(spark, odd_docs, monkeypatch):
    import corpus_pipeline

    plans = []
    write = corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda s, df: plans.append(df) or write(s, df))
    plans.append(corpus_pipeline.encode(spark, odd_docs, ""))
    assert [df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for df in plans] == [1, 1, 1]
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in plans[-1].collect())


def test_states_of_other_operators_are_freed():
    from panelloom.llm import common

    common.states_for("one")
    state = common.worker_state(("s",), object)
    common.states_for("one")
    assert common.worker_state(("s",), object) is state
    common.states_for("two")
    assert common.worker_state(("s",), object) is not state
    common.give_back()


def test_words_are_read_in_columns(odd_pairs, monkeypatch):
    import pyarrow as pa

    from panelloom.llm.common import words_of

    texts = [t or "" for _, t in odd_pairs] + ["", " \n", "\x0bA\x0cb \x1cc\x85 É　X  y\r\n", "<|z|>"]
    expected = [[*words_of(t), maxent_lm.END] for t in texts]
    tokens = [w for w, _ in Counter(w for row in expected for w in row).most_common(maxent_lm.TOKENS + 90)]
    counts = np.arange(len(tokens), 0, -1)
    zeros = np.ones(maxent_lm.RARE, np.int64)
    for known in (tokens, [w for w in tokens if w != maxent_lm.END][:50], []):
        reader = maxent_lm.Reader(maxent_lm.Vocabulary(known, counts[: len(known)], 10, 3, zeros, zeros))
        # A slice, as Arrow hands them over.
        place, ids, begin, rare = reader.read(pa.array(["x y", *texts])[1:])
        flat = [w for row in expected for w in row]
        assert place.tolist() == [known.index(w) if w in known else -1 for w in flat]
        assert ids.tolist() == [p if 0 <= p < maxent_lm.TOKENS else maxent_lm.TOKENS + maxent_lm.rare_class(w) for p, w in zip(place.tolist(), flat)]
        assert np.diff(begin).tolist() == [len(row) for row in expected]
        assert rare.to_pylist() == [w for p, w in zip(place.tolist(), flat) if p < 0]


def test_token_counts_in_small_blocks(spark, odd_docs, odd_pairs, no_docs, monkeypatch):
    from panelloom.llm.common import words_of

    monkeypatch.setattr(maxent_lm, "COUNT_BYTES", 500)
    found = {bytes(r.token): r["count"] for r in maxent_lm.token_counts(odd_docs).collect()}
    assert found == Counter(w for _, t in odd_pairs for w in [*words_of(t or ""), maxent_lm.END])
    assert maxent_lm.token_counts(no_docs).isEmpty()


def test_sums_of_stretches_of_rows():
    random = np.random.default_rng(5)
    values = random.standard_normal((300, 6)).astype(np.float32)
    for kind in (random.integers(0, 2000, 300), random.integers(0, 90, 300), np.zeros(300, np.int64), np.arange(300)):
        order = np.argsort(kind, kind="stable")
        row = kind[order]
        edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        expected = np.add.reduceat(values[order].view(np.complex64), edge, axis=0).view(np.float32)
        assert np.array_equal(maxent_lm.summed(values, order, edge, np.diff(np.append(edge, 300))), expected)
