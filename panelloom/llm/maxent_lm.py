"""Hashed maximum-entropy language model with class-factored softmax.

Counts of all training tokens give the base score (add-one unigram) and the model's vocabulary: the ``CLASSES * WIDTH``
most frequent tokens, in frequency classes of ``WIDTH``. Every other word belongs to one of ``RARE`` classes by its last
two bytes. The probability of a token is that of its class given the context, times that of the token in its class:
a second softmax for a frequent token, add-one counts for a word of a rare class.

Both softmaxes sum rows of hashed weights, one row for each feature of the context: a constant, the previous token (an
n-gram), the tokens two and three back (the skips), and for the classes also the previous two tokens together. They start from the counts and are trained in
``ROUNDS`` rounds over disjoint parts of the training documents. In a round every task takes gradient steps (Adagrad on
rows) over its own part from the same weights and passes on its changed rows; each row's changes are averaged, weighted
by how often a task used it. The tables have a fixed size whatever the input, and only they and the ``COMMON`` most
frequent tokens with their counts are sent to the tasks. Counts of all other words stay in a table: their tokens go
there as rows, by word, and come back as one sum for each document.

NULL and empty texts are the end token alone. A row without an id counts as training text. Repeated rows are scored
each on its own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import map_arrow, texts_of, worker_state, written

CLASSES, WIDTH, RARE = 32, 64, 16
COMMON = 200_000
# Ranges of counts that one look at the table tells apart.
LEVELS = 4096
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 15
ROUNDS = 2
STEP, MINIBATCH = 0.15, 4096
BOUNDS = -30, 15
# Bytes of words that are counted together.
COUNT_BYTES = 1 << 25
# The end of a text as a token; no word holds a line break.
END = b"\n"
TOKENS = CLASSES * WIDTH
START = TOKENS + RARE
LOG10 = math.log(10)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, without their end tokens, and how many come before each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, edges = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # White space at either end leaves an empty word.
    full = pc.binary_length(words).to_numpy() > 0
    return words.filter(pa.array(full)), np.append(0, np.cumsum(full))[edges]


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


RARE_SQL = f"CAST(crc32(substring(token, -2, 2)) % {RARE} AS INT)"


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, count`` over the whole texts; each task adds up before the shuffle."""

    def count(batches):
        held: list[pa.Array] = []
        ends = 0
        for batch in batches:
            held.append(words_in(batch.column(0))[0])
            ends += batch.num_rows
            if sum(words.nbytes for words in held) >= COUNT_BYTES:
                yield out(held, ends)
                held, ends = [], 0
        yield out(held, ends)

    def out(held, ends):
        tokens, times = pa.chunked_array(held, pa.binary()).value_counts().flatten()
        columns = [pa.concat_arrays([c, pa.array([x], c.type)]) for c, x in ((tokens, END), (times, ends))]
        found = pa.RecordBatch.from_arrays(columns, names=["token", "count"])
        return found if ends else found.slice(0, 0)

    return map_arrow(texts_of(docs, []), count, "token binary, count bigint").groupBy("token").agg(F.sum("count").alias("count"))


@dataclass
class Vocabulary:
    """The frequent tokens in order, their counts, and what is left: tokens and distinct ones of each rare class."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    rare_total: np.ndarray
    rare_distinct: np.ndarray

    def plain(self) -> tuple:
        """The fields alone: what is broadcast must load where this package is missing."""
        return self.tokens, self.counts, self.total, self.distinct, self.rare_total, self.rare_distinct


def _least_count(counts: DataFrame, common: int) -> int:
    """The largest count that more than ``common`` tokens reach (0: none); each look at the table brings ``LEVELS`` rows
    at most to the driver, however many counts there are."""
    low, high = 0, (counts.agg(F.max("count")).first()[0] or 0) + 1
    above = 0
    # More than ``common`` tokens reach ``low`` (or it is 0), at most ``common`` reach ``high``: ``above`` of them.
    while high - low > 1:
        step = -(-(high - low) // LEVELS)
        level = F.expr(f"CAST(floor((count - {low}) / {step}) AS BIGINT)")
        found = counts.where(f"count >= {low} AND count < {high}").groupBy(level.alias("_level")).agg(F.count(F.lit(1))).collect()
        for at, kinds in sorted(found, reverse=True):
            if above + kinds > common:
                low, high = low + at * step, min(high, low + (at + 1) * step)
                break
            above += kinds
        else:
            return low
    return low


def vocabulary(counts: DataFrame, common: int = COMMON) -> Vocabulary:
    """From ``token, count``; at most ``common`` rows reach the driver: the tokens above the least count that lets so
    few through."""
    least = _least_count(counts, common)
    top = sorted(counts.where(F.col("count") > least).collect(), key=lambda r: (-r[1], r[0]))
    tokens = [bytes(r[0]) for r in top]
    total, distinct = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for cls, n, k in counts.groupBy(F.expr(RARE_SQL).alias("c")).agg(F.sum("count"), F.count(F.lit(1))).collect():
        total[cls], distinct[cls] = n, k
    everything, kinds = int(total.sum()), int(distinct.sum())
    for token, n in zip(tokens[:TOKENS], (r[1] for r in top)):
        total[rare_class(token)] -= n
        distinct[rare_class(token)] -= 1
    return Vocabulary(tokens, np.array([r[1] for r in top], np.int64), everything, kinds, total, distinct)


class Weights:
    """The two tables of rows: of the classes, and of the tokens within a class."""

    def __init__(self, classes: np.ndarray, words: np.ndarray):
        self.classes, self.words = classes, words

    @staticmethod
    def start(vocabulary: Vocabulary) -> "Weights":
        """Constants from the counts; all other rows are zero."""
        frequent = np.zeros(TOKENS)
        n = min(TOKENS, len(vocabulary.counts))
        frequent[:n] = vocabulary.counts[:n]
        weights = Weights(np.zeros((CLASS_ROWS, CLASSES + RARE), np.float32), np.zeros((WORD_ROWS, WIDTH), np.float32))
        masses = np.concatenate([frequent.reshape(CLASSES, WIDTH).sum(axis=1), vocabulary.rare_total]) + 1
        weights.classes[0] = np.log(masses / masses.sum())
        shares = frequent.reshape(CLASSES, WIDTH) + 0.01
        weights.words[:CLASSES] = np.log(shares / shares.sum(axis=1, keepdims=True))
        return weights


def _hashed(kind: int, rows: int, first: int, *ids: np.ndarray) -> np.ndarray:
    """Row numbers from ``first`` on for features of the given ids."""
    x = np.full(len(ids[0]), 0x9E3779B97F4A7C15 * (kind + 1) % (1 << 64), np.uint64)
    for i in ids:
        x = (x ^ i.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (first + x % np.uint64(rows - first)).astype(np.int32)


def features(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Rows of the class table for tokens with these one, two and three places before them."""
    return np.stack([
        np.zeros(len(one), np.int32), _hashed(0, CLASS_ROWS, 1, one), _hashed(1, CLASS_ROWS, 1, two, one),
        _hashed(2, CLASS_ROWS, 1, two), _hashed(3, CLASS_ROWS, 1, three),
    ])


def word_features(cls: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    return np.stack([
        cls.astype(np.int32), _hashed(4, WORD_ROWS, CLASSES, cls, one), _hashed(5, WORD_ROWS, CLASSES, cls, two),
        _hashed(6, WORD_ROWS, CLASSES, cls, three),
    ])


def log_softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities from the sums of the ``rows`` of the table. Weights lie within ``BOUNDS``, so nothing overflows."""
    logits = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        logits += np.take(table, r, axis=0)
    total = np.exp(logits) @ np.ones(table.shape[1], np.float32)
    logits -= np.log(total + np.float32(1e-30))[:, None]
    return logits


class Reader:
    """Turns texts into numbers: for each token its place among the common ones (-1: none) and its model id."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = pa.array(vocabulary.tokens, pa.binary())
        self.one = np.array([rare_class(bytes([a])) for a in range(256)])
        self.two = np.array([rare_class(bytes([a, b])) for a in range(256) for b in range(256)])
        n = len(vocabulary.tokens)
        self.model_id = np.arange(n)
        for i in range(TOKENS, n):
            self.model_id[i] = TOKENS + rare_class(vocabulary.tokens[i])
        self.base = np.log10((vocabulary.counts + 1) / (vocabulary.total + vocabulary.distinct + 1))
        # Share of a token within its rare class; 0 in logs for the model's own tokens.
        self.in_rare = np.zeros(n)
        self.denominator = vocabulary.rare_total + vocabulary.rare_distinct + 1
        if n > TOKENS:
            self.in_rare[TOKENS:] = np.log10((vocabulary.counts[TOKENS:] + 1) / self.denominator[self.model_id[TOKENS:] - TOKENS])

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Place and model id of all tokens, where each text begins, and the tokens of place -1 in order."""
        words, before = words_in(texts)
        begin = before + np.arange(len(before))
        # Of each token its word; the end has the number after the last.
        which = np.full(begin[-1], len(words))
        inside = np.ones(len(which), bool)
        inside[begin[1:] - 1] = False
        which[inside] = np.arange(len(words))
        words = pa.concat_arrays([words, pa.array([END], pa.binary())])
        place = pc.fill_null(pc.index_in(words, value_set=self.tokens), -1).to_numpy().astype(np.int64)[which]
        ids = self.model_id[place] if len(self.model_id) else np.zeros(len(place), np.int64)
        unknown = np.flatnonzero(place < 0)
        rare = words.take(pa.array(which[unknown]))
        ids[unknown] = TOKENS + self.rare_classes(rare)
        return place, ids, begin, rare

    def rare_classes(self, words: pa.Array) -> np.ndarray:
        """``rare_class`` of words that are not empty, from their last bytes."""
        if not len(words):
            return np.zeros(0, np.int64)
        _, edges, letters = words.buffers()
        end = np.frombuffer(edges, np.int32)[words.offset + 1 : words.offset + len(words) + 1]
        data = np.frombuffer(letters, np.uint8)
        last, before = data[end - 1].astype(np.int64), data[np.maximum(end - 2, 0)].astype(np.int64)
        return np.where(pc.binary_length(words).to_numpy() > 1, self.two[before * 256 + last], self.one[last])


def contexts(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids one, two and three places back; ``START`` before a text's first token."""
    out = []
    position = np.arange(len(ids)) - np.repeat(begin[:-1], np.diff(begin))
    for back in (1, 2, 3):
        shifted = np.full(len(ids), START)
        shifted[back:] = ids[:-back]
        shifted[position < back] = START
        out.append(shifted)
    return tuple(out)


def token_scores(weights: Weights, ids: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Natural log of the class's probability, and of the token's in it if it is frequent."""
    out = np.empty(len(ids))
    for at in range(0, len(ids), 4096):
        s = slice(at, at + 4096)
        y, a, b, c = ids[s], one[s], two[s], three[s]
        cls = np.where(y < TOKENS, y // WIDTH, CLASSES + y - TOKENS)
        found = log_softmax(weights.classes, features(a, b, c))[np.arange(len(y)), cls].astype(np.float64)
        f = np.flatnonzero(y < TOKENS)
        if len(f):
            rows = word_features(cls[f], a[f], b[f], c[f])
            found[f] += log_softmax(weights.words, rows)[np.arange(len(f)), y[f] % WIDTH]
        out[s] = found
    return out


def summed(values: np.ndarray, order: np.ndarray, edge: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` over stretches of ``order``, which start at ``edge`` and have ``count`` rows."""
    out = np.take(values, order[edge], axis=0)
    two = np.flatnonzero(count == 2)
    out[two] += np.take(values, order[edge[two] + 1], axis=0)
    more = np.flatnonzero(count > 2)
    if len(more):
        rows, size = order[np.repeat(count > 2, count)], count[more]
        # Sums of pairs of numbers take half the steps.
        pairs = np.take(values, rows, axis=0).view(np.complex64)
        out[more] = np.add.reduceat(pairs, np.cumsum(size) - size, axis=0).view(np.float32)
    return out


class Trainer:
    """Gradient steps of one task from given weights."""

    def __init__(self, weights: Weights):
        self.tables = [weights.classes.copy(), weights.words.copy()]
        self.squares = [np.full(len(t), 1e-3, np.float32) for t in self.tables]
        self.used = [np.zeros(len(t), np.int64) for t in self.tables]

    def step(self, t: int, rows: np.ndarray, target: np.ndarray) -> None:
        table, squares, used = self.tables[t], self.squares[t], self.used[t]
        push = log_softmax(table, rows)
        np.exp(push, out=push)
        np.negative(push, out=push)
        push[np.arange(len(target)), target] += 1
        for kind in rows:
            # Tokens of one row of the table side by side; numbers of 16 bits sort in linear time.
            order = np.argsort(kind.astype(np.uint16), kind="stable")
            row = kind[order]
            edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            touched, count = row[edge], np.diff(np.append(edge, len(order)))
            gradient = summed(push, order, edge, count)
            gradient *= (count**-0.5).astype(np.float32)[:, None]
            new = squares[touched] + np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
            squares[touched] = new
            gradient *= (STEP / np.sqrt(new))[:, None]
            gradient += np.take(table, touched, axis=0)
            table[touched] = np.clip(gradient, *BOUNDS, out=gradient)
            used[touched] += count

    def learn(self, ids, one, two, three) -> None:
        for at in range(0, len(ids), MINIBATCH):
            s = slice(at, at + MINIBATCH)
            y, a, b, c = ids[s], one[s], two[s], three[s]
            cls = np.where(y < TOKENS, y // WIDTH, CLASSES + y - TOKENS)
            self.step(0, features(a, b, c), cls)
            f = np.flatnonzero(y < TOKENS)
            if len(f):
                self.step(1, word_features(cls[f], a[f], b[f], c[f]), y[f] % WIDTH)


def trained(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Gradient rounds over disjoint parts of ``docs``, dealt by the hash of the text."""
    context = docs.sparkSession.sparkContext
    weights = Weights.start(vocabulary)
    mark = uuid.uuid4().hex
    shared = context.broadcast(vocabulary.plain())
    texts = texts_of(docs, [])
    shapes = [table.shape for table in (weights.classes, weights.words)]
    for part in range(rounds):
        now = context.broadcast((weights.classes, weights.words))

        def learn(batches, now=now):
            reader = worker_state(("reader",), lambda: Reader(Vocabulary(*shared.value)), mark)
            before = Weights(*now.value)
            trainer = Trainer(before)
            for batch in batches:
                _, ids, begin, _ = reader.read(batch.column(0))
                for at in range(0, len(begin) - 1, 128):
                    edges = begin[at : at + 129]
                    some = ids[edges[0] : edges[-1]]
                    trainer.learn(some, *contexts(some, edges - edges[0]))
            for t, old in enumerate((before.classes, before.words)):
                rows = np.flatnonzero(trainer.used[t])
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    changes = (trainer.tables[t][some] - old[some]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), t)), pa.array(some), pa.array(trainer.used[t][some]), pa.array([c.tobytes() for c in changes], pa.binary())],
                        names=["t", "row", "used", "change"],
                    )

        def averaged(batches):
            held = [(np.zeros(n, np.int64), np.zeros((n, width))) for n, width in shapes]
            for batch in batches:
                kind, row, used = (c.to_numpy() for c in batch.columns[:3])
                for t, (uses, sums) in enumerate(held):
                    mine = np.flatnonzero(kind == t)
                    changes = np.frombuffer(b"".join(batch.column(3).take(pa.array(mine)).to_pylist()), np.float16).reshape(-1, sums.shape[1])
                    changes = used[mine, None] * changes.astype(np.float64)
                    np.add.at(uses, row[mine], used[mine])
                    while len(mine):
                        # One change of each row at a time.
                        _, first = np.unique(row[mine], return_index=True)
                        sums[row[mine[first]]] += changes[first]
                        mine, changes = np.delete(mine, first), np.delete(changes, first, axis=0)
            for t, (uses, sums) in enumerate(held):
                rows = np.flatnonzero(uses)
                values = [v.tobytes() for v in (sums[rows] / uses[rows, None]).astype(np.float32)]
                columns = [pa.array(np.full(len(rows), t)), pa.array(rows), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "row", "change"])

        mine = texts.where(f"pmod(xxhash64(_text), {rounds}) = {part}")
        changes = map_arrow(mine, learn, "t bigint, row bigint, used bigint, change binary")
        # A partition holds some rows of the tables, whose number is fixed.
        mean = map_arrow(changes.repartition("t", "row"), averaged, "t bigint, row bigint, change binary")
        tables = [weights.classes.copy(), weights.words.copy()]
        for t, row, change in mean.collect():
            tables[t][row] += np.frombuffer(change, np.float32)
        weights = Weights(*tables)
        now.unpersist()
    return weights


def scored(docs: DataFrame, training: str) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (``doc_id, text``), in
    log10; the model learns from the rows where the SQL condition ``training`` holds."""
    context = docs.sparkSession.sparkContext
    learned = docs.where(training)
    counts = written(token_counts(learned))
    vocab = vocabulary(counts)
    weights = trained(learned, vocab)
    shared = context.broadcast(vocab.plain())
    tables = context.broadcast((weights.classes, weights.words))
    mark = uuid.uuid4().hex

    def score(batches):
        reader = worker_state(("reader",), lambda: Reader(Vocabulary(*shared.value)), mark)
        model = Weights(*tables.value)
        for batch in batches:
            place, ids, begin, rare = reader.read(batch.column(1))
            known = place >= 0
            base, share = np.zeros(len(place)), np.zeros(len(place))
            base[known], share[known] = reader.base[place[known]], reader.in_rare[place[known]]
            for at in range(0, len(begin) - 1, 128):
                edges = begin[at : at + 129]
                s = slice(edges[0], edges[-1])
                share[s] += token_scores(model, ids[s], *contexts(ids[s], edges - edges[0])) / LOG10
            texts = [slice(a, b) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            sums = [pa.array([column[s].sum() for s in texts], pa.float64()) for column in (base, share)]
            missing = np.append(0, np.cumsum(~known))[begin]
            columns = [pa.array(np.diff(begin)), pa.array(np.diff(begin) - np.diff(missing)), *sums, pa.ListArray.from_arrays(pa.array(missing, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "known", "base", "model", "rare"])

    rows = texts_of(docs, ["doc_id"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = map_arrow(rows, score, f"doc_id {kind}, n_tokens bigint, known bigint, base double, model double, rare array<binary>")
    # The number of a row is fixed by writing it down once.
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()))
    tokens = parts.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = f"element_at(array({', '.join(f'{int(n)}L' for n in vocab.rare_total + vocab.rare_distinct + 1)}), {RARE_SQL} + 1)"
    met = tokens.join(counts.withColumnsRenamed({"token": "_t", "count": "c"}), F.expr("token = _t"), "left")
    met = met.selectExpr(
        "row", "n * CAST(c IS NOT NULL AS INT) AS more_known", f"n * log10((coalesce(c, 0) + 1) / {vocab.total + vocab.distinct + 1}D) AS more_base",
        f"n * log10((coalesce(c, 0) + 1) / CAST({sizes} AS DOUBLE)) AS more_model",
    )
    sums = met.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more_known", "more_base", "more_model")]).withColumnRenamed("row", "_r")
    return parts.join(sums, F.expr("row = _r"), "left").selectExpr(
        "doc_id", "n_tokens", "known + coalesce(more_known, 0) AS n_known", f"{vocab.total}L AS train_tokens",
        "base + coalesce(more_base, 0) AS base_score", "model + coalesce(more_model, 0) AS score",
    )
