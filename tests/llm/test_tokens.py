"""Token counts and byte-level BPE against the libraries that define them."""

import base64

import pytest

tiktoken = pytest.importorskip("tiktoken")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from panelloom.llm import byte_bpe, piece_counts  # noqa: E402
from panelloom.llm.common import Memo  # noqa: E402

BPE_FILE, PIECE_FILE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own_bpe():
    return byte_bpe.RankFile(BPE_FILE, P.PATTERN)


@pytest.fixture(scope="module")
def library_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own_pieces():
    return piece_counts.PieceRanks(PIECE_FILE)


@pytest.fixture(scope="module")
def library_pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)


def ids(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


texts = st.text(max_size=60) | st.text(alphabet="ab \n\t\r.'s1é▁ \x0b\x1c 語🎉", max_size=80)


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_bpe_equals_the_library(own_bpe, library_bpe, text):
    packed = own_bpe.encode(text)
    assert ids(packed) == library_bpe.encode_ordinary(text)
    assert own_bpe.decode(packed) == text.encode()


class Counting:
    """An automaton that counts the matches it gives."""

    def __init__(self, automaton):
        self.automaton, self.given = automaton, 0

    def matches(self, found):
        for match in found:
            self.given += 1
            yield match

    def iter(self, *where):
        return self.matches(self.automaton.iter(*where))

    def iter_long(self, *where):
        return self.matches(self.automaton.iter_long(*where))


def test_only_matches_on_the_way_are_looked_at(own_bpe, library_bpe, monkeypatch):
    # Most matches of a word start inside its tokens and are never asked for.
    counting = Counting(own_bpe.automaton)
    monkeypatch.setattr(own_bpe, "automaton", counting)
    word = " internationalisationsverfahrensweise"
    assert own_bpe.piece(word.encode()) == library_bpe.encode_ordinary(word)
    assert counting.given < len(word)


@pytest.mark.parametrize("data", [b"ac", b"ca", b"abcab", b"c"])
def test_bytes_without_a_token_are_an_error(tmp_path, data):
    ranks = tmp_path / "ranks"
    ranks.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([b"a", b"b", b"ab"])))
    small = byte_bpe.RankFile(str(ranks), ".+")
    assert small.piece(b"abaab") == [2, 0, 2]
    with pytest.raises(ValueError, match="no token covers"):
        small.piece(data)


def test_what_is_asked_for_again_stays_known():
    made = []
    memo = Memo(lambda key: made.append(key) or key.upper(), 8)
    for i in range(200):
        assert memo["often"] == "OFTEN" and memo[f"once {i}"] == f"ONCE {i}"
        assert len(memo) + len(memo.older) <= 8
    assert made.count("often") == 1


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_counts_equal_the_library(own_pieces, library_pieces, text):
    assert own_pieces.count(text) == len(library_pieces.encode(text))


@pytest.mark.parametrize("text", ["ab" * 20_000, "é" * 5_000, " " * 3_000, "<|endoftext|></s><unk>", "a" * 9_999])
def test_long_runs_and_special_strings(own_bpe, library_bpe, own_pieces, library_pieces, text):
    assert ids(own_bpe.encode(text)) == library_bpe.encode_ordinary(text)
    assert own_pieces.count(text) == len(library_pieces.encode(text))


def test_operators_on_odd_rows(odd_docs, odd_pairs, no_docs, library_bpe, library_pieces):
    counted = piece_counts.count_tokens(odd_docs, ["doc_id"]).collect()
    packed = byte_bpe.encode(odd_docs, ["doc_id"])
    decoded = byte_bpe.decode(packed, ["doc_id", "n_tokens"]).collect()
    key = lambda r: (r[0] is not None, r[0], r[1], r[2])
    plain = [(i, t or "") for i, t in odd_pairs]
    assert sorted(map(tuple, counted), key=key) == sorted(((i, len(t.encode()), len(library_pieces.encode(t))) for i, t in plain), key=key)
    wanted = [(i, len(library_bpe.encode_ordinary(t)), t.encode()) for i, t in plain]
    assert sorted(((r[0], r[1], bytes(r[2])) for r in decoded), key=key) == sorted(wanted, key=key)
    assert piece_counts.count_tokens(no_docs, ["doc_id"]).count() == byte_bpe.encode(no_docs, ["doc_id"]).count() == 0


def test_unpacked_ids(odd_docs):
    rows = byte_bpe.unpacked(byte_bpe.encode(odd_docs, ["doc_id"])).collect()
    assert all(len(r.ids) == r.n_tokens for r in rows)
