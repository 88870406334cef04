"""Token identifiers in directly addressable codes: any token of the files is read without decoding its block.

**Segment.** The identifiers of some whole documents, one after the other. Each is split into chunks of 8 bits, least
first. Level 0 holds the first chunk of every identifier, level k + 1 the next chunk of those that level k marks. A
level is its chunks, one byte each; a continuation bitmap, one bit per chunk, least bit first, set where the identifier
goes on; and a rank directory, for every ``BLOCK`` bits the number of set bits before them. The i-th identifier has its
chunk at place i of level 0; where the bit there is set, the next chunk is at place ``rank(i)`` of level 1, and so on.

Bytes of a segment, all numbers little-endian: ``DAC1``, u32 number of levels, per level u64 number of chunks; then per
level the chunks, and but for the last level the bitmap (padded to whole blocks) and the directory (u32 per block).

**Files.** Parquet, one row per segment: ``part``, ``first`` (identifiers before it in its part), ``n`` identifiers,
``code``, ``docs`` (``doc_id, at, n``: documents in order, ``at`` the place in the segment). Spark writes and commits them, so they live on
any storage Spark can reach and survive lost executors; a reader of the index alone reads no code. Parts are ranges of
documents in ascending order of ``doc_id`` (NULL first, equal ids by their text).

A document of any length lies in one segment. NULL and empty texts have the end identifier alone. Repeated rows are
documents of their own. Columns other than ``doc_id`` and the text are not read. Special strings inside a text are what
the library makes of them. An empty table gives files without rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.common import map_arrow, texts_of, worker_state

TOKENIZER, END = "byte_bpe_50k.json", 0
# Identifiers from which a segment is closed, and bits of one entry of the rank directory.
SEGMENT, BLOCK = 1 << 18, 512
# Bytes of the words that a worker knows.
KNOWN_BYTES = 1 << 26
# Bytes of the texts that are encoded together, and characters of one text handed to the library.
ROUND_BYTES, BATCH_CHARS = 1 << 24, 1 << 16
MAGIC = b"DAC1"


def packed(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit identifiers."""
    rest = np.ascontiguousarray(ids, "<u4")
    levels = []
    while True:
        chunks = (rest & 255).astype(np.uint8)
        more = rest > 255
        levels.append((chunks, more))
        rest = rest[more] >> 8
        if not len(rest):
            break
    out = [MAGIC, struct.pack(f"<I{len(levels)}Q", len(levels), *(len(c) for c, _ in levels))]
    for k, (chunks, more) in enumerate(levels):
        out.append(chunks.tobytes())
        if k < len(levels) - 1:
            bits = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
            bits[: len(more)] = more
            counts = bits.reshape(-1, BLOCK).sum(axis=1)
            out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """Reader of one segment; it holds views of its bytes only."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (count,) = struct.unpack_from("<I", code, 4)
        sizes = struct.unpack_from(f"<{count}Q", code, 8)
        at = 8 + 8 * count
        self.levels = []
        for k, n in enumerate(sizes):
            chunks = np.frombuffer(code, np.uint8, n, at)
            at += n
            bits = directory = None
            if k < count - 1:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(code, np.uint8, blocks * BLOCK // 8, at)
                at += len(bits)
                directory = np.frombuffer(code, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The identifiers at these places, each by its own chunks; cost per place, whatever the segment's length."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= len(self)):
            raise IndexError("place outside the segment")
        out = np.zeros(len(places), np.uint32)
        open_at = np.arange(len(places))
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out[open_at] |= chunks[places].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or not len(places):
                break
            goes_on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            places, open_at = places[goes_on], open_at[goes_on]
            places = self.rank(bits, directory, places)
        return out

    @staticmethod
    def rank(bits: np.ndarray, directory: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's entry and the bits of its block up to there."""
        block = places // BLOCK
        some = bits.reshape(-1, BLOCK // 8)[block]
        byte = np.arange(BLOCK // 8)
        inside = (places % BLOCK)[:, None]
        kept = np.where(byte < inside // 8, 255, np.where(byte == inside // 8, (1 << (inside % 8)) - 1, 0)).astype(np.uint8)
        return directory[block].astype(np.int64) + np.bitwise_count(some & kept).sum(axis=1, dtype=np.int64)

    def all(self) -> np.ndarray:
        """All identifiers, level by level from the last."""
        values = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            mine = chunks.astype(np.uint32)
            if bits is not None:
                mine[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= values << np.uint32(8)
            values = mine
        return values


# Cuts before white space that follows a visible character never fall inside a match of the tokenizer's pattern.
CHUNK = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+$")
# Texts with white space before a space.
RAGGED = ("  ", "\n ", "\t ", "\r ")
# Other white space; texts that hold any are encoded as a whole.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class Places(dict):
    """Words by the order in which they came up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """The library's identifiers. Texts are encoded together, each of their different words once; words of earlier texts
    are known, until they and their identifiers take ``KNOWN_BYTES``.

    Words are joined to longer texts for the library, which knows no faster way than a long text; where one ends is read
    from the bytes that its identifiers stand for.
    """

    def __init__(self, path: str):
        import os

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A token of the vocabulary is spelled with one character per byte.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known, self.odd = pa.array([], pa.string()), np.zeros(0, bool)
        self.coded, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: pa.Array) -> np.ndarray:
        """The places of the different ``words`` among the known ones, where new ones come last."""
        if sum(x.nbytes for x in (self.known, self.odd, self.coded, self.first, self.count)) >= KNOWN_BYTES:
            self.forget()
        places = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = places < 0
        if new.any():
            places[new] = len(self.known) + np.arange(new.sum())
            fresh = words.filter(pa.array(new))
            spelled = fresh.to_pylist()
            ids, first, count = self.words(spelled)
            odd = np.zeros(len(spelled), bool)
            if OTHER_SPACE.search("".join(spelled)):
                odd[[i for i, w in enumerate(spelled) if OTHER_SPACE.search(w)]] = True
            first += len(self.coded)
            self.known = pa.concat_arrays([self.known, fresh])
            for name, more in (("odd", odd), ("coded", ids), ("first", first), ("count", count)):
                setattr(self, name, np.concatenate([getattr(self, name), more]))
        return places

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, first, count)``: the identifiers of all words, and where each word's lie."""
        # Words that start with white space and end without can stand behind each other.
        inner = [i for i, w in enumerate(words) if w[0] in " \n\t\r" and w[-1] not in " \n\t\r"]
        alone = sorted(set(range(len(words))).difference(inner))
        texts, start, size = [], 0, 0
        for end, i in enumerate(inner, 1):
            size += len(words[i])
            if size >= BATCH_CHARS or end == len(inner):
                texts.append("".join([words[k] for k in inner[start:end]]))
                start, size = end, 0
        parts = []
        for at in range(0, len(texts), 4):
            parts += self.library(texts[at : at + 4])
        whole = self.library([words[i] for i in alone])
        joined = np.concatenate([*parts, np.zeros(0, np.uint32)])
        edges = np.concatenate([[0], np.cumsum(self.bytes[joined])])
        ends = np.searchsorted(edges, np.concatenate([[0], np.cumsum([len(words[i].encode()) for i in inner])]))
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[inner], count[inner] = ends[:-1], np.diff(ends)
        sizes = np.array([len(w) for w in whole], np.int64)
        first[alone], count[alone] = len(joined) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([joined, *whole]), first, count

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Per text its identifiers."""
        # Where every space follows a visible character, cuts at spaces are as safe, and Arrow makes them.
        ragged = np.zeros(len(texts), bool)
        for test, patterns in ((pc.match_substring, RAGGED), (pc.starts_with, " \n\t\r"), (pc.ends_with, " \n\t\r")):
            for pattern in patterns:
                ragged |= test(texts, pattern).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(ragged), "", texts), " ")
        words, starts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        spaced = words.dictionary_encode()
        codes = spaced.indices.to_numpy()
        # Words without a space before them, or with other white space.
        bare = Places()
        heads = []
        for r in range(len(texts)):
            some = CHUNK.findall(texts[r].as_py()) if ragged[r] else [w for w in (words[int(starts[r])].as_py(),) if w]
            heads.append(np.fromiter(map(bare.__getitem__, some), np.int64, len(some)))
        every = pa.concat_arrays([pa.array(list(bare), pa.string()), pc.binary_join_element_wise("", spaced.dictionary, " ")]).dictionary_encode()
        places = self.learn(every.dictionary)[every.indices.to_numpy()]
        own, codes = places[: len(bare)], places[len(bare) :][codes]
        strange = self.odd.any()
        out = []
        for r, head in enumerate(heads):
            places = np.concatenate([own[head], codes[starts[r] + 1 : starts[r + 1]]])
            if strange and self.odd[places].any():
                out += self.library([texts[r].as_py()])
                continue
            n = self.count[places]
            before = np.cumsum(n) - n
            out.append(self.coded[np.repeat(self.first[places] - before, n) + np.arange(n.sum())])
        return out


def _loaded(path: str | None) -> Encoder:
    def load():
        import public_tokenizers

        return Encoder(path or public_tokenizers.path(TOKENIZER))

    return worker_state(("tokenizer", path), load)


def encode(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` (``doc_id, _text``) in segments, as they are stored: ``first, n, code, docs``; rows keep their order."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= ROUND_BYTES:
                yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
                held = []
        if held:
            yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(path)
        end = np.array([END], np.uint32)
        held: list[np.ndarray] = []
        docs: list[pa.Array] = []
        sizes: list[int] = []
        first = total = 0

        def closed() -> pa.RecordBatch:
            n = np.array(sizes)
            fields = [pa.concat_arrays(docs), pa.array(np.cumsum(n) - n), pa.array(n)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.StructArray.from_arrays(fields, names=["doc_id", "at", "n"]))
            code = pa.array([packed(np.concatenate(held))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total], pa.int64()), code, listed], names=["first", "n", "code", "docs"])

        for keys, texts in rounds(batches):
            for r, ids in enumerate(encoder.ids(texts)):
                held += [ids, end]
                docs.append(keys.slice(r, 1))
                sizes.append(len(ids) + 1)
                total += sizes[-1]
                if total >= SEGMENT:
                    yield closed()
                    held, docs, sizes, first, total = [], [], [], first + total, 0
        if total:
            yield closed()

    return map_arrow(df, segments, f"first bigint, n bigint, code binary, docs array<struct<doc_id:{kind},at:bigint,n:bigint>>")


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode all ``docs`` (``doc_id, text``) and write them to ``path`` in ascending order of ``doc_id``."""
    rows = texts_of(docs, ["doc_id"])
    # Equal ids are ordered by their text, and spread over tasks by its hash.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("_text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text")
    stored = encode(ranged, tokenizer).withColumn("part", F.expr("shiftright(monotonically_increasing_id(), 33)"))
    stored.select("part", "first", "n", "code", "docs").write.parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the identifiers of all documents before each. What is broadcast has one row per part,
    and there are no more parts than partitions of the write."""
    stored = spark.read.parquet(path)
    sizes = stored.groupBy(F.col("part").alias("_part")).agg(F.sum("n").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return stored.join(F.broadcast(offsets), F.expr("part = _part")).withColumn("start", F.expr("_offset + first"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, segment, at, start, n_tokens`` of each document of the files; no code is read.

    ``start`` counts the identifiers of all documents before it, ``segment`` those before its segment, ``at`` is its place
    in the segment.
    """
    listed = _stored(spark, path).select(F.col("start").alias("segment"), F.inline("docs"))
    return listed.selectExpr("doc_id", "segment", "at", "segment + at AS start", "n AS n_tokens")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents of the files; ``ids`` are little-endian unsigned 32-bit integers."""
    rows = _stored(spark, path).select("start", "code", "docs")
    kind = rows.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs = batch.column(2)[r].values
                at, n = (docs.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                ids = Segment(batch.column(1)[r].as_buffer().to_pybytes()).all().astype("<u4", copy=False)
                first = batch.column(0)[r].as_py()
                bits = pa.array([ids[a : a + k].tobytes() for a, k in zip(at.tolist(), n.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([docs.field(0), pa.array(at + first), pa.array(n), bits], names=["doc_id", "start", "n_tokens", "ids"])

    return map_arrow(rows, decoded, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, i, id`` for ``wanted`` (``doc_id, i``): the i-th identifier of a document, from 0, read by the rank
    directories alone. Places outside the document, and unknown documents, give no row."""
    found = index(spark, path).alias("d")
    met = wanted.selectExpr("doc_id", "CAST(i AS BIGINT) AS i").alias("w").join(found, F.expr("w.doc_id <=> d.doc_id AND w.i >= 0 AND w.i < d.n_tokens"))
    place = F.expr("named_struct('doc_id', w.doc_id, 'i', w.i, 'at', at + w.i)")
    places = met.groupBy("segment", F.expr("i DIV 65536").alias("_slice")).agg(F.collect_list(place).alias("places"))
    codes = _stored(spark, path).select("start", "code")
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                some = batch.column(1)[r].values
                ids = Segment(batch.column(0)[r].as_buffer().to_pybytes()).at(some.field(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([some.field(0), some.field(1), pa.array(ids.astype(np.int64))], names=["doc_id", "i", "id"])

    rows = places.join(codes, F.expr("segment = start")).select("code", "places")
    return map_arrow(rows, looked_up, f"doc_id {kind}, i bigint, id bigint")
