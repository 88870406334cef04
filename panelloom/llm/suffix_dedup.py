"""Removal of long repeated byte strings by a hash-compared suffix sort.

Every start of a ``length``-byte string is one suffix. Suffixes are compared through prefix polynomial hashes: a binary
search over the hashes finds the common extension of two of them, so a comparison takes log2(length) steps, and a merge
sort over such comparisons brings equal strings together. Neighbours that extend each other to the full length are
compared byte by byte before they count.

To spread the sort over tasks, each string elects one of its ``GRAM``-byte substrings, that of the least hash: equal
strings elect alike, at the same place. Consecutive starts with one elected place are a fragment. Then

1. fragments that are the only one of their elected substring are done: none of their starts repeats;
2. fragments of equal content (two independent 64-bit hashes of different polynomials) are repeated whole;
3. of what shares the elected substring but not all its content, one fragment per content is sent to the task of the
   substring, where the starts at the same distance from it are sorted.

Contents are counted before they are shuffled, so a passage or a document that thousands share is one fragment. An
elected substring with more than ``CROWD`` contents is not sorted in one task: its starts are grouped by two hashes
of the whole string instead, as rows that spread over all tasks.

The letters of a string are bytes, or words (as in ``common.WORD``, upper and lower case apart):
then ``length`` and ``gram`` count words, what lies between two words does not matter, a word's letter is its 64-bit
hash, and the sort numbers the words of its block, so that its last comparison is one of bytes there too.

Texts are UTF-8 bytes, a NULL text is empty. A repeated row is another document, so both lose what they share. Matches
never cross documents and are judged on the texts as given. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import map_arrow, thinned, written
from panelloom.llm.shingles import SEPARATES, mixed, word_hashes

LENGTH, GRAM = 400, 160
# Elected words of a string of words.
WORD_GRAM = 12
CHUNK = 1 << 19
CROWD = 2000
BLOCK = 1 << 20
# A fragment's place: first start * 2**24 + distance of the elected substring * 2**12 + number of starts.
TEXT_HASH = "xxhash64(coalesce(text, ''))"


class Polynomial:
    """Prefix hashes of byte strings modulo 2**64, with letters of random value."""

    def __init__(self, seed: int):
        random = np.random.Generator(np.random.PCG64(seed))
        self.letters = random.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(random.integers(1, 1 << 61, dtype=np.uint64)) * 8 + 5
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n + 1, base % (1 << 64), np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        letters = self.letters[data] if data.dtype == np.uint8 else mixed(data.astype(np.uint64) ^ self.letters[0])
        np.cumsum(letters * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[: len(prefix)][start]


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes start and end."""
    edge = np.flatnonzero(np.diff(~SEPARATES[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


def letters_of(texts: list, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of the texts, and of each text where they begin and how many there are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not words:
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes
    starts, hashes = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    edges = np.searchsorted(starts, np.append(0, np.cumsum(sizes + 1)))
    return hashes, edges[:-1], np.diff(edges)


class Cutter:
    """Fragments of texts, for one length and one length of the elected substrings; ``fewer`` leaves only strings of bytes
    with fewer whole words between separators."""

    def __init__(self, length: int, gram: int, fewer: int | None = None):
        if not 0 < length - gram < 1 << 12:
            raise ValueError("the elected substring is shorter than the string, by less than 4096 bytes")
        self.length, self.gram, self.fewer = length, gram, fewer
        self.one, self.two = Polynomial(11), Polynomial(12)

    def few_words(self, data: np.ndarray) -> np.ndarray:
        """Whether the string at each place has fewer than ``fewer`` words that separators bound within the string."""
        inside = ~SEPARATES[data]
        ended = np.cumsum(~inside & np.append(False, inside[:-1]), dtype=np.int32)
        begun = np.cumsum(inside & ~np.append(False, inside[:-1]), dtype=np.int32)
        return ended[self.length - 1 :] - begun[: len(data) - self.length + 1] < self.fewer

    def fragments(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Document, hash of the elected substring, hash of the content, first start, distance of the elected substring
        from it, and number of starts."""
        n = len(data)
        if n < self.length or not (size >= self.length).any():
            return (np.zeros(0, np.int64),) * 6
        # Before the wide arrays, which take more memory.
        few = None if self.fewer is None else self.few_words(data)
        prefix = self.one.prefixes(data)
        grams = mixed(self.one.hashes(prefix, slice(0, n - self.gram + 1), slice(self.gram, n + 1)))
        low = np.uint64((1 << n.bit_length()) - 1)
        least = _window_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), self.length - self.gram + 1)
        place = (least & low).astype(np.int64)
        # Starts whose string lies in one document.
        count = np.maximum(size - self.length + 1, 0)
        doc = np.repeat(np.arange(len(size)), count)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + begin[doc]
        if few is not None:
            few = few[start]
            doc, start = doc[few], start[few]
            if not len(start):
                return (np.zeros(0, np.int64),) * 6
        place = place[start]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
        starts = np.diff(np.append(first, len(doc)))
        at, doc = start[first], doc[first]
        elected = grams[place[first]]
        content = self.two.hashes(self.two.prefixes(data), at, at + starts + self.length - 1)
        ahead = place[first] - at
        content = mixed(mixed(content + ahead.astype(np.uint64)) + starts.astype(np.uint64))
        return doc, elected.view(np.int64), content.view(np.int64), at - begin[doc], ahead, starts


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the stretches."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return begin[fresh], reach[np.append(fresh[1:] - 1, len(reach) - 1)]


def _elected(docs: DataFrame, cutter: Cutter, words: bool) -> DataFrame:
    """Per document its distinct fragments: ``elected``, ``content``, ``at`` (a packed place), ``own`` (whether
    the content comes twice in it), and ``spans``, what its own repeats cover (begin, end, begin, end, ...)."""

    def cut(batches):
        for batch in batches:
            texts = [t.as_buffer() for t in batch.column(2).cast(pa.binary())]
            i = 0
            out = [[] for _ in range(5)]
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + texts[j].size <= CHUNK):
                    size += texts[j].size
                    j += 1
                doc, elected, content, at, ahead, starts = cutter.fragments(*letters_of(texts[i:j], words))
                edges = np.searchsorted(doc, np.arange(j - i + 1))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    keys = np.stack([elected[a:b], content[a:b]], axis=1)
                    _, first, which, times = np.unique(keys, axis=0, return_index=True, return_inverse=True, return_counts=True) if b - a > 1 else (0, np.arange(b - a), np.arange(b - a), np.ones(b - a, np.int64))
                    again = np.flatnonzero(times[which.ravel()] > 1) + a
                    lo, hi = merged(at[again], at[again] + starts[again] + cutter.length - 1)
                    first = first + a
                    packed = (at[first] << 24) | (ahead[first] << 12) | starts[first]
                    for column, values in zip(out, (elected[first], content[first], packed, times > 1, np.stack([lo, hi], axis=1).ravel())):
                        column.append(values)
                i = j
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            arrays = [pa.array(column, pa.list_(kind)) for column, kind in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "text_hash", "elected", "content", "at", "own", "spans"])

    rows = docs.selectExpr("doc_id", f"{TEXT_HASH} AS text_hash", "coalesce(text, '') AS _text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, cut, f"doc_id {kind}, text_hash bigint, elected array<bigint>, content array<bigint>, at array<bigint>, own array<boolean>, spans array<bigint>")


def _sent(docs: DataFrame, wanted: DataFrame, length: int, words: bool) -> DataFrame:
    """The bytes of the ``wanted`` fragments (``doc_id, text_hash`` and ``parts`` of elected, crowded, at)."""

    def send(batches):
        for batch in batches:
            out = []
            for doc, mark, text, parts in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                if words:
                    begin, end = (edge.tolist() for edge in word_edges(np.frombuffer(text, np.uint8)))
                for part in parts:
                    start, ahead, starts = part["at"] >> 24, part["at"] >> 12 & 0xFFF, part["at"] & 0xFFF
                    last = start + starts + length - 1
                    data = text[begin[start] : end[last - 1]] if words else text[start:last]
                    out.append((part["elected"], part["crowded"], doc, mark, start, ahead, data))
                if len(out) >= 4096:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    def packed(rows):
        kinds = (pa.int64(), pa.bool_(), doc_kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["elected", "crowded", "doc_id", "text_hash", "start", "ahead", "data"])

    from pyspark.sql.pandas.types import to_arrow_type

    doc_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.selectExpr("doc_id", f"{TEXT_HASH} AS text_hash", "coalesce(text, '') AS _text")
    met = thinned(rows, "text_hash", wanted, "text_hash").join(wanted.selectExpr("doc_id AS d", "text_hash AS t", "parts"), F.expr("doc_id <=> d AND text_hash = t")).select("doc_id", "text_hash", "_text", "parts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(met, send, f"elected bigint, crowded boolean, doc_id {kind}, text_hash bigint, start bigint, ahead bigint, data binary")


class SuffixSort:
    """Merge sort of suffixes of one block of letters, within cells, by their first ``length`` letters."""

    def __init__(self, polynomial: Polynomial, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.polynomial, self.prefix = polynomial, polynomial.prefixes(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, at most ``length``."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.polynomial.hashes(self.prefix, a, a + middle) == self.polynomial.hashes(self.prefix, b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether the suffix at ``a`` sorts before the one at ``b``; ``ties`` for equal ones."""
        common = self.extension(a, b)
        equal = common >= self.length
        last = np.minimum(common, self.length - 1)
        return np.where(equal, ties, self.data[a + last] < self.data[b + last])

    def sort(self, cell: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The suffixes ``at``, given in the order of their ``cell``, sorted within each cell."""
        at = at.copy()
        n = len(at)
        edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), n)
        size = np.diff(edges)
        base = np.repeat(edges[:-1], size)
        within, size = np.arange(n) - base, np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            pair = within // (2 * width) * (2 * width)
            right = within - pair >= width
            # The other run of the pair: where it starts and how many it has.
            other = base + pair + np.where(right, 0, width)
            held = np.clip(size - pair - np.where(right, 0, width), 0, width)
            low, high = np.zeros(n, np.int64), held.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                there = at[other[open_] + middle]
                # Equal suffixes keep their order: the left run's come first.
                smaller = np.where(right[open_], ~self.before(at[open_], there, False), self.before(there, at[open_], False))
                low[open_] = np.where(smaller, middle + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], middle)
            out = np.empty_like(at)
            out[base + pair + (within - pair - np.where(right, width, 0)) + low] = at
            at = out
            width *= 2
        return at

    def repeated(self, cell: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The suffixes that share their first ``length`` letters with another one of their cell."""
        order = np.argsort(cell, kind="stable")
        cell, at = cell[order], at[order]
        at = self.sort(cell, at)
        near = np.flatnonzero(cell[1:] == cell[:-1])
        near = near[self.extension(at[near], at[near + 1]) >= self.length]
        strings = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        same = np.concatenate([[], *[(strings[at[k]] == strings[at[k + 1]]).all(axis=1) for k in np.array_split(near, len(near) // 4096 + 1)]]).astype(bool)
        found = [at[near[same]], at[near[same] + 1]]
        for c in np.unique(cell[near[~same]]):
            # Unequal strings of equal hashes stood between equal ones: settle the cell by its bytes.
            seen: dict[bytes, list[int]] = {}
            for a in at[cell == c].tolist():
                seen.setdefault(strings[a].tobytes(), []).append(a)
            found += [np.array(group, np.int64) for group in seen.values() if len(group) > 1]
        return np.unique(np.concatenate(found))


def _sorted_spans(fragments: DataFrame, length: int, words: bool) -> DataFrame:
    """``doc_id, text_hash, begin, end``: what the sort finds repeated in the fragments, by elected substring."""

    def spans(batches):
        polynomial = Polynomial(13)
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            elected = table["elected"].to_numpy()
            last = np.flatnonzero(elected != elected[-1])
            whole = last[-1] + 1 if len(last) else 0
            rest = table.slice(whole)
            if whole:
                yield from blocks(table.slice(0, whole), polynomial)
        if rest is not None and len(rest):
            yield from blocks(rest, polynomial)

    def blocks(table, polynomial):
        """Cut between elected substrings into blocks of about ``BLOCK`` bytes."""
        elected = table["elected"].to_numpy()
        sizes = pa.compute.binary_length(table["data"]).to_numpy().astype(np.int64)
        edge = np.append(np.flatnonzero(np.append(True, elected[1:] != elected[:-1])), len(elected))
        total = np.append(0, np.cumsum(sizes))[edge]
        a = 0
        while a < len(edge) - 1:
            b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK)) - 1)
            yield one(table.slice(edge[a], edge[b] - edge[a]), sizes[edge[a] : edge[b]], elected[edge[a] : edge[b]], polynomial)
            a = b

    def one(table, sizes, elected, polynomial):
        data = table["data"].to_pylist()
        if words:
            split = [d.split() for d in data]
            sizes = np.array([len(w) for w in split], np.int64)
            numbers: dict[bytes, int] = {}
            data = np.array([numbers.setdefault(w, len(numbers)) for row in split for w in row], np.int64)
        else:
            data = np.frombuffer(b"".join(data), np.uint8)
        begin, starts = np.cumsum(sizes) - sizes, sizes - length + 1
        row = np.repeat(np.arange(len(sizes)), starts)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = begin[row] + shift
        group = np.cumsum(np.append(False, elected[1:] != elected[:-1]))
        # Equal strings lie at the same distance from the elected substring.
        away = table["ahead"].to_numpy()[row] - shift
        sorter = SuffixSort(polynomial, data, length)
        # A string whose hash is the only one of its kind in the block repeats nowhere in it.
        whole = mixed(polynomial.hashes(sorter.prefix, at, at + length) + mixed(group[row].astype(np.uint64) * np.uint64(4096) + away.astype(np.uint64)))
        order = np.argsort(whole)
        equal = whole[order][1:] == whole[order][:-1]
        many = np.zeros(len(whole), bool)
        many[order[1:][equal]] = many[order[:-1][equal]] = True
        hit = sorter.repeated((group[row] * 4096 + away)[many], at[many]) if many.any() else np.zeros(0, np.int64)
        owner = np.searchsorted(begin, hit, side="right") - 1
        fresh = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1]))) if len(hit) else np.zeros(0, np.int64)
        last = np.append(fresh[1:], len(hit)) - 1 if len(hit) else fresh
        rows = owner[fresh]
        origin = table["start"].to_numpy()[rows] - begin[rows]
        picked = table.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [picked["doc_id"].combine_chunks(), picked["text_hash"].combine_chunks(), pa.array(hit[fresh] + origin), pa.array(hit[last] + origin + length)],
            names=["doc_id", "text_hash", "begin", "end"],
        )

    dealt = fragments.repartition("elected").sortWithinPartitions("elected").select("elected", "ahead", "doc_id", "text_hash", "start", "data")
    kind = fragments.schema["doc_id"].dataType.simpleString()
    return map_arrow(dealt, spans, f"doc_id {kind}, text_hash bigint, begin bigint, end bigint")


def _crowded_spans(fragments: DataFrame, length: int, words: bool) -> DataFrame:
    """The same for elected substrings of very many contents, by two hashes of each string."""

    def hashed(batches):
        one, two = Polynomial(14), Polynomial(15)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data = letters_of([row.column(4)[0].as_buffer()], words)[0]
                n = len(data) - length + 1
                pair = [mixed(p.hashes(p.prefixes(data), slice(0, n), slice(length, len(data) + 1))).view(np.int64) for p in (one, two)]
                repeated = [c.take(pa.array(np.zeros(n, np.int64))) for c in row.columns[1:3]]
                begin = np.arange(n) + row.column(3)[0].as_py()
                yield pa.RecordBatch.from_arrays([*repeated, pa.array(begin), pa.array(pair[0]), pa.array(pair[1])], names=["doc_id", "text_hash", "begin", "one", "two"])

    kind = fragments.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(fragments.select("elected", "doc_id", "text_hash", "start", "data"), hashed, f"doc_id {kind}, text_hash bigint, begin bigint, one bigint, two bigint")
    many = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).where("times > 1").selectExpr("one AS x", "two AS y")
    return rows.join(many, F.expr("one = x AND two = y"), "left_semi").selectExpr("doc_id", "text_hash", "begin", f"begin + {length} AS end")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, words: bool = False, fewer: int | None = None) -> DataFrame:
    """``doc_id, text_hash, spans`` of the texts in which something repeats: stretches of bytes or ``words`` (begin, end),
    perhaps overlapping. Equal rows have one row here. ``fewer`` leaves out strings of bytes with so many words."""
    texts = docs.select("doc_id", "text")
    found = written(_elected(texts, Cutter(length, gram, fewer), words))
    each = found.selectExpr("doc_id", "text_hash", "inline(arrays_zip(elected, content, at, own))")
    shared = each.groupBy("elected").agg(F.count(F.lit(1)).alias("held"), F.min("content").alias("x"), F.max("content").alias("y")).where("held > 1")
    shared = shared.selectExpr("elected AS e", "x <> y AS differs")
    rows = written(each.join(shared, F.expr("elected = e")).select("doc_id", "text_hash", "elected", "content", "at", "own", "differs"))

    contents = rows.where("differs").groupBy("elected", "content").agg(
        F.sum(F.expr("CASE WHEN own THEN 2L ELSE 1L END")).alias("times"), F.min(F.struct("doc_id", "text_hash", "at")).alias("one")
    )
    contents = written(contents)
    # Contents that came once are judged against all others of their elected substring.
    unsettled = contents.groupBy("elected").agg(F.count(F.lit(1)).alias("held"), F.min("times").alias("least")).where("least = 1")
    parts = contents.join(unsettled.selectExpr("elected AS e", f"held > {crowd} AS crowded"), F.expr("elected = e"))
    parts = parts.selectExpr("one.doc_id AS doc_id", "one.text_hash AS text_hash", "struct(elected, crowded, one.at AS at) AS part")
    fragments = _sent(texts, parts.groupBy("doc_id", "text_hash").agg(F.collect_set("part").alias("parts")), length, words)
    if unsettled.where(f"held > {crowd}").isEmpty():
        sorted_out = _sorted_spans(fragments, length, words)
    else:
        fragments = written(fragments)
        sorted_out = _sorted_spans(fragments.where("NOT crowded"), length, words).unionByName(_crowded_spans(fragments.where("crowded"), length, words))

    many = contents.where("times > 1").selectExpr("elected AS e", "content AS c")
    whole = rows.where("NOT differs").select("doc_id", "text_hash", "at").unionByName(
        rows.where("differs").join(many, F.expr("elected = e AND content = c"), "left_semi").select("doc_id", "text_hash", "at")
    )
    whole = whole.selectExpr("doc_id", "text_hash", "shiftright(at, 24) AS begin", f"shiftright(at, 24) + (at & 4095) + {length - 1} AS end")
    inner = found.where("size(spans) > 0").selectExpr("doc_id", "text_hash", "explode(sequence(0, size(spans) - 2, 2)) AS i", "spans")
    inner = inner.selectExpr("doc_id", "text_hash", "spans[i] AS begin", "spans[i + 1] AS end")
    spans = whole.unionByName(sorted_out).unionByName(inner)
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _with_spans(rows: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """``rows`` with the column ``spans``; NULL where nothing repeats."""
    hashed = rows.withColumn("_hash", F.expr(TEXT_HASH.replace("text", text)))
    found = spans.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    return hashed.join(found, F.expr(f"{doc_id} <=> _d AND _hash = _t"), "left").drop("_hash", "_d", "_t")


def _span_arrays(spans) -> tuple[np.ndarray, np.ndarray]:
    both = np.array([(s["begin"], s["end"]) for s in spans or ()], np.int64).reshape(-1, 2)
    return merged(both[:, 0], both[:, 1])


def _found(docs: DataFrame, length: int, words: int | None, fewer: int | None = None) -> DataFrame:
    """``doc_id, text_hash, spans, passages``: repeated strings of ``length`` bytes, and passages of ``words`` words if wanted."""
    none = F.expr("CAST(NULL AS array<struct<begin: bigint, end: bigint>>)")
    found = repeats(docs, length, fewer=fewer).withColumn("passages", none)
    if words is None:
        return found
    passages = repeats(docs, words, WORD_GRAM, words=True).withColumnRenamed("spans", "passages").withColumn("spans", none)
    both = found.unionByName(passages)
    return both.groupBy("doc_id", "text_hash").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "passages")])


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, n_passages, passage_words``: what is left of each text, as bytes.

    With ``words`` the last two tell of the passages of so many words that come up more than once: how many separate
    ones the text has, and the words that they cover. They are reported only; nothing goes for them.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "passage_words"]

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans, passages in zip(batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3))):
                begin, end = _span_arrays(spans)
                edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                first, last = _span_arrays(passages)
                out.append((len(text), int((end - begin).sum()), len(begin), kept, len(first), int((last - first).sum())))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = _with_spans(docs.select("doc_id", "text"), "doc_id", "text", _found(docs, length, words)).selectExpr("doc_id", "coalesce(text, '') AS _text", "spans", "passages")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, n_passages bigint, passage_words bigint")


def shortened(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with their repeated stretches cut out of ``text`` and ``n_chars`` set anew.

    With ``words`` every passage of so many words that comes up more than once is cut out, however short, and strings of
    ``length`` bytes where they hold fewer words (long words, scripts without spaces). A string of ``length`` bytes with
    so many words or more goes as a passage of words, without the parts of words at its ends. A character of which only some bytes repeat stays, so the text is valid. NULL texts stay NULL.
    """
    names = docs.columns
    i = names.index("text")

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans, passages in zip(batch.column(i).to_pylist(), *(c.to_pylist() for c in batch.columns[-2:])):
                if text is not None and (spans or passages):
                    data = text.encode("utf-8", "surrogatepass")
                    begin, end = _span_arrays(spans)
                    if passages:
                        starts, ends = word_edges(np.frombuffer(data, np.uint8))
                        first, last = _span_arrays(passages)
                        begin, end = merged(np.append(begin, starts[first]), np.append(end, ends[last - 1]))
                    at, pieces = 0, []
                    for a, b in zip(begin.tolist(), end.tolist()):
                        while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        pieces.append(data[at:a])
                        at = b
                    text = b"".join([*pieces, data[at:]]).decode("utf-8", "surrogatepass")
                out.append(text)
            columns = list(batch.columns[:-2])
            columns[i] = pa.array(out, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # Columns get names of our own, so none of theirs can clash.
    numbered = docs.toDF(*[f"_c{k}" for k in range(len(names))])
    found = _found(docs, length, words, fewer=words)
    rows = _with_spans(numbered, f"_c{names.index('doc_id')}", f"_c{i}", found)
    cleaned = map_arrow(rows, cut, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in names else cleaned
