"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

A rank file gives each token's bytes and rank. Bytes become Latin-1 characters, so one Aho-Corasick automaton over all
tokens finds, in one sweep of a piece, the longest token at each position. Encoding goes left to right with the longest
match; where it does not fit its left neighbour it takes the next shorter prefix, and steps back where none is left.
Two adjacent tokens fit when undoing their merges never meets a pair that byte-pair merging would have joined earlier;
the answer is kept per pair. Positions that failed are marked, so each is left at most once and the time is linear.

The text is cut by the pattern first. A cut before white space that follows a visible character never falls inside a
match, so whole words with their leading space are looked up, and only new ones are matched and encoded.

NULL and empty texts give no identifiers. A single match of any length is encoded in one piece. Repeated rows are
encoded each on its own; columns other than the keys and the text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelloom.llm.common import Memo, map_arrow, texts_of, worker_state

CHUNK = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+$")
# White space of the pattern that CHUNK does not cut at; texts that hold any are matched as a whole.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
MEMO, PAIRS = 250_000, 250_000


class RankFile:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.rank = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, r in ranks.items():
            self.bytes[r] = token
        self.length = [len(b) for b in self.bytes]
        self.packed = [r.to_bytes(4, "little") for r in range(self.size)]
        self.automaton = ahocorasick.Automaton()
        for token, r in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), r)
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of each token; -1 if there is none.
        self.shorter = [-1] * self.size
        for token, r in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in ranks:
                    self.shorter[r] = ranks[token[:n]]
                    break
        # The two tokens whose merge makes each token, and the token that two make.
        self.parts: list[tuple[int, int]] = [(r, r) for r in range(self.size)]
        self.joined: dict[tuple[int, int], int] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        for r in sorted(ranks.values()):
            token, head = self.bytes[r], self.shorter[r]
            while head >= 0:
                tail = ranks.get(token[self.length[head] :], self.size)
                if head < r and tail < r and self.undone(head, tail):
                    self.joined[head, tail] = r
                    self.parts[r] = (head, tail)
                    break
                head = self.shorter[head]
        self.memo = Memo(self.word, MEMO)

    def undone(self, left: int, right: int) -> bool:
        """Whether byte-pair merging keeps the boundary between two tokens that it makes on their own."""
        limit = self.size
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            # Undo the later of the two merges; a token without parts is kept and the other one is undone.
            (_, inner), (outer, _) = self.parts[left], self.parts[right]
            if left > right and inner != left or outer == right:
                if inner == left:
                    return True
                limit, left = left, inner
            else:
                limit, right = right + 1, outer

    def fits(self, left: int, right: int) -> bool:
        known = self.fitting.get((left, right))
        if known is None:
            if len(self.fitting) >= PAIRS:
                self.fitting.clear()
            known = self.fitting[left, right] = self.undone(left, right)
        return known

    def piece(self, data: bytes) -> list[int]:
        """The identifiers of one match of the pattern."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        text, n, length, shorter = data.decode("latin-1"), len(data), self.length, self.shorter
        fitting, failed = self.fitting, set()
        out: list[int] = []
        at, last = 0, -1
        while at < n:
            # The longest matches from here on, one after the other, as far as they fit.
            token = -1
            for stop, token in self.automaton.iter_long(text, at):
                end = at + length[token]
                if end != stop + 1:
                    token = -1
                    break
                if end in failed or last >= 0 and not (fitting.get((last, token)) or self.fits(last, token)):
                    break
                out.append(token)
                at, last = end, token
            if at == n:
                break
            if token < 0 or token == last and at == end:
                raise ValueError("bytes that no token covers")
            while True:
                token = shorter[token]
                if token < 0:
                    failed.add(at)
                    if last < 0:
                        raise ValueError("bytes that no token covers")
                    token = out.pop()
                    at, last = at - length[token], out[-1] if out else -1
                elif at + length[token] not in failed and (last < 0 or fitting.get((last, token)) or self.fits(last, token)):
                    out.append(token)
                    at, last = at + length[token], token
                    break
        return out

    def word(self, chunk: str) -> bytes:
        ids: list[int] = []
        for match in self.pattern.findall(chunk):
            ids += self.piece(match.encode("utf-8"))
        return b"".join(map(self.packed.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """The identifiers as little-endian unsigned 32-bit integers."""
        if OTHER_SPACE.search(text):
            return self.word(text)
        return b"".join(map(self.memo.__getitem__, CHUNK.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _loaded(path: str | None, pattern: str | None) -> RankFile:
    def load():
        import public_tokenizers

        return RankFile(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)

    return worker_state(("rank file", path, pattern), load)


def _schema(df: DataFrame, keys: Sequence[str], *more: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *more])


def encode(df: DataFrame, keys: Sequence[str], path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """The keys with ``n_tokens`` and ``ids``, the identifiers packed as little-endian unsigned 32-bit integers."""
    rows = texts_of(df, keys, text)

    def encoded(batches):
        ranks = _loaded(path, pattern)
        for batch in batches:
            packed = [ranks.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts, pa.array(packed, pa.binary())], names=[*keys, "n_tokens", "ids"])

    return map_arrow(rows, encoded, _schema(rows, keys, "n_tokens bigint", "ids binary"))


def decode(df: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """The keys with ``decoded``, the bytes that the packed ``ids`` stand for."""
    rows = df.select(*[f"`{k}`" for k in keys], "ids")

    def decoded(batches):
        ranks = _loaded(path, None)
        for batch in batches:
            texts = [None if p is None else ranks.decode(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*keys, "decoded"])

    return map_arrow(rows, decoded, _schema(rows, keys, "decoded binary"))


def unpacked(df: DataFrame) -> DataFrame:
    """``df`` with its packed ``ids`` as an array of integers."""
    names = df.columns
    i = names.index("ids")

    def unpack(batches):
        for batch in batches:
            packed = batch.column(i).to_pylist()
            values = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            offsets = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            columns = list(batch.columns)
            columns[i] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(df, unpack, _schema(df, [c for c in names[:i]], "ids array<int>", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names[i + 1 :])))
