"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits that stand for letters to Latin ones, drops
invisible characters and turns whatever is no letter into a space. Lexicon terms are whole words and beginnings of
words, each with a weight: its log odds of toxic against other documents, less one standard error. A document's weights
are summed, each word once with its heaviest term, and divided by its length in words; a logistic curve over the
logarithm of that density, with a floor that a text without a hit has, gives the score. A word inside an exception
phrase does not count.

Lexicon, exception phrases and curve are learned from a sample of at most ``SAMPLE`` labelled documents, those with the
least hash of their id, so the sample is the same on every run; equal texts in it count once. Terms are counted by Spark jobs; only the chosen terms
(at most ``TERMS``) and two numbers for each sampled document reach the driver.

NULL and empty texts have no words and get the score of a text without a hit. With no labels, or none of one kind,
every score is 0. A doc_id with several labels is toxic if one of them says so. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import map_arrow, worker_state

SAMPLE = 20_000
TERMS = 2_000
LEAST_WEIGHT, LEAST_DOCUMENTS = 2.5, 3
FLOOR = 0.005
SHORTEST, LONGEST = 3, 8
# Look-alikes of Latin letters, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
}

# A mark that no letter follows is punctuation.
LAST_MARK = re.compile(r"!(?!\w)")


class Folding(dict):
    """Table for ``str.translate``, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        out = ""
        for c in unicodedata.normalize("NFKC", char).lower():
            if c in LOOKALIKES:
                out += LOOKALIKES[c]
            elif unicodedata.category(c) not in ("Cf", "Mn"):
                out += c if c.isalpha() else " "
        self[code] = out
        return out


def folded(text: str) -> str:
    """The folded words between single spaces, with one at either end."""
    table = worker_state(("folding",), Folding)
    if "!" in text:
        text = LAST_MARK.sub(" ", text)
    return " " + " ".join(text.translate(table).split()) + " "


@dataclass(frozen=True)
class Lexicon:
    """``weights`` of terms (they begin with a space; whole words end with one), ``exceptions`` (phrases between
    spaces), and the curve: score = 1 / (1 + exp(-(at + slope * log density)))."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    at: float = -math.inf
    slope: float = 0.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), -1.0))
        if len(found):
            found.make_automaton()
        return found

    def density(self, automaton, text: str) -> float:
        words = text.count(" ") - 1
        hits: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(text) if len(automaton) else ():
            start = end - length + 1
            if weight < 0:
                excused.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        total = sum(w for start, w in hits.items() if not any(a <= start < b for a, b in excused))
        return math.log(total / (max(words, 0) + 10) + FLOOR)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(min(700.0, -(self.at + self.slope * density)))) if self.slope else 0.0


def sampled(docs: DataFrame, labels: DataFrame, rows: str, sample: int) -> DataFrame:
    """``toxic, _text`` of at most ``sample`` labelled documents, where ``rows`` (on doc_id) holds."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    # At most ``sample`` ids.
    return docs.join(F.broadcast(few), F.expr("doc_id = _id")).select("toxic", F.coalesce("text", F.lit("")).alias("_text")).distinct()


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """``term, toxic, other``: documents of either kind that hold each term."""

    def count(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in terms_of(folded(text)):
                    held.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            if len(held) > 500_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], names=["term", "toxic", "other"]
        )

    return map_arrow(rows, count, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def candidate_terms(text: str) -> set[str]:
    """Whole words and their beginnings."""
    out = set()
    for word in set(text.split()):
        if SHORTEST <= len(word) <= 40:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: str = "true", sample: int = SAMPLE) -> Lexicon:
    """Learn from the labelled documents whose doc_id meets the SQL condition ``rows``."""
    texts = sampled(docs, labels, rows, sample)
    sizes = dict(texts.groupBy(F.expr("toxic > 0")).count().collect())
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not other:
        return Lexicon({})
    counts = _counted(texts, candidate_terms)
    often = max(LEAST_DOCUMENTS, math.ceil(0.002 * toxic))
    strong = counts.where(f"toxic >= {often}").withColumn("weight", F.expr(_weight("toxic", "other", toxic, other)))
    chosen = strong.where(f"weight >= {LEAST_WEIGHT}").orderBy(F.desc("toxic"), F.length("term"), "term").limit(TERMS * 5).collect()
    weights = without_kin({r["term"]: (r["toxic"], r["other"], r["weight"]) for r in chosen}, toxic, other, often)
    weights = dict(sorted(weights.items(), key=lambda kv: (-kv[1], kv[0]))[:TERMS])

    lexicon = Lexicon(weights)
    excuses = _counted(texts, lambda text: _phrases(text, lexicon)).where(f"other >= 3 AND other * {toxic} >= 10 * toxic * {other}")
    phrases = [r["term"] for r in excuses.orderBy(F.desc("other"), "term").limit(TERMS).collect()]
    lexicon = Lexicon(weights, tuple(sorted(phrases)))

    # Two numbers for each sampled document.
    pairs = _densities(texts, lexicon).select("toxic", "density").collect()
    y = np.array([float(r[0] > 0) for r in pairs])
    x = np.array([r[1] for r in pairs])
    return Lexicon(lexicon.weights, lexicon.exceptions, *logistic(x, y))


def _weight(a: str, b: str, toxic: int, other: int) -> str:
    odds = f"ln(({a} + 0.5) / {toxic + 1}) - ln(({b} + 0.5) / {other + 1})"
    return f"{odds} - sqrt(1 / ({a} + 0.5) + 1 / ({b} + 0.5))"


def without_kin(terms: dict[str, tuple[int, int, float]], toxic: int, other: int, often: int) -> dict[str, float]:
    """One term for each family of beginnings: a longer term that is in nearly all of a shorter one's toxic documents
    stands for it; else the shorter one replaces longer ones that weigh no more, and stays beside heavier ones only if
    it is strong enough without their documents."""
    kept: dict[str, tuple[int, int, float]] = {}
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        a, b, weight = terms[term]
        kin = [t for t in kept if t.startswith(term)]
        if any(20 * kept[t][0] >= 19 * a for t in kin):
            continue
        if all(kept[t][2] <= weight + 0.25 for t in kin):
            for t in kin:
                del kept[t]
            kept[term] = terms[term]
            continue
        a, b = a - sum(kept[t][0] for t in kin), b - sum(kept[t][1] for t in kin)
        if a >= often:
            b = max(b, 0)
            rest = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if rest >= LEAST_WEIGHT:
                kept[term] = (a, b, rest)
    return {t: v[2] for t, v in kept.items()}


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, float]:
    """Newton steps for one variable, with a penalty on the slope that keeps separable data finite."""
    middle, spread = x.mean(), max(x.std(), 1e-9)
    z = np.stack([np.ones(len(x)), (x - middle) / spread], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - penalty * beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(2), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] - beta[1] * middle / spread), float(beta[1] / spread)


def _phrases(text: str, lexicon: Lexicon) -> set[str]:
    """The pairs of neighbouring words of which one is a hit."""
    automaton = worker_state(("phrases",), lexicon.automaton, repr(lexicon))
    out = set()
    for end, (length, _) in automaton.iter(text) if len(automaton) else ():
        start = end - length + 1
        stop = text.index(" ", start + 1)
        before = text.rfind(" ", 0, start)
        after = text.find(" ", stop + 1)
        if before >= 0:
            out.add(text[before : stop + 1])
        if after >= 0:
            out.add(text[start : after + 1])
    return out


def _densities(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with ``density`` in place of their last column, the text."""

    def weigh(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            found = [lexicon.density(automaton, folded(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*names, "density"])

    names = rows.columns[:-1]
    schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names), "density double"])
    return map_arrow(rows, weigh, schema)


def scored(docs: DataFrame, lexicon: Lexicon, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys`` of each row of ``docs`` with ``score``."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.coalesce("text", F.lit("")).alias("_text"))
    curve = f"1 / (1 + exp(-({lexicon.at!r}D + {lexicon.slope!r}D * density)))" if lexicon.slope else "0D"
    return _densities(rows, lexicon).withColumn("score", F.expr(curve)).drop("density")


def without_toxic(docs: DataFrame, lexicon: Lexicon, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``; a row is judged with all its columns in hand."""
    names = docs.columns
    i = names.index("text")

    def keep(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            good = [lexicon.score(lexicon.density(automaton, folded(t or ""))) < limit for t in batch.column(i).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
