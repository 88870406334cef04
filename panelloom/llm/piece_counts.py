"""Token counts of a piece vocabulary with byte fallback: heap-and-linked-list byte-pair merging.

Each chunk of a text is a doubly linked list of characters. A heap holds the adjacent pairs that form a piece, lowest
rank first, leftmost first among equals; popping one joins the two. The count is the initial symbols (a character
outside the vocabulary counts as its UTF-8 bytes) minus the merges, so no identifier is ever made.

No piece holds a space mark behind another character, so no merge crosses from a word into the next space: a text is
cut before each run of spaces, and equal chunks are counted once per worker. A vocabulary for which this does not hold
is refused.

NULL and empty texts have 0 tokens. A chunk of any length is merged in O(n log n). Repeated rows are counted each on
its own; columns other than the keys and the text are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelloom.llm.common import Memo, map_arrow, texts_of, worker_state

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
MEMO = 1_000_000


class PieceRanks:
    """Ranks of the pieces of a model file: place in the order of falling score, equal scores sharing one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [
            (model.id_to_piece(i), model.get_score(i))
            for i in range(model.get_piece_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
        ]
        place = {score: n for n, score in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.rank = {piece: place[score] for piece, score in pieces}
        whole = all(c in self.rank for piece in self.rank for c in piece)
        if not whole or any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.rank):
            raise ValueError("the vocabulary joins words, or holds pieces whose characters are not pieces")
        self.memo = Memo(self.merged, MEMO)

    def merged(self, chunk: str) -> int:
        rank = self.rank
        symbols = list(chunk)
        n = len(symbols)
        initial = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in symbols)
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        if not heap:
            return initial
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            # An entry is stale when either symbol has grown or gone meanwhile.
            if left is None or j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            merges += 1
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                if wider in rank:
                    heapq.heappush(heap, (rank[wider], i, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                if wider in rank:
                    heapq.heappush(heap, (rank[wider], h, wider))
        return initial - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, CHUNK.findall(SPACE + text.replace(" ", SPACE))))


def count_tokens(df: DataFrame, keys: Sequence[str], path: str | None = None, text: str = "text") -> DataFrame:
    """The keys with ``n_bytes`` and ``n_tokens`` of each text. ``path``: a model file that every executor has."""
    rows = texts_of(df, keys, text)
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds)), "n_bytes bigint", "n_tokens bigint"])

    def counted(batches):
        def load():
            import public_tokenizers

            return PieceRanks(path or public_tokenizers.path("piece_bpe_32k.model"))

        ranks = worker_state(("piece ranks", path), load)
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            sizes = found.cast(pa.large_binary())
            tokens = np.fromiter((ranks.count(t) for t in found.to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.compute.binary_length(sizes).cast(pa.int64()), pa.array(tokens)],
                names=[*keys, "n_bytes", "n_tokens"],
            )

    return map_arrow(rows, counted, schema)
