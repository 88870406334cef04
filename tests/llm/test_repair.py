"""Conversation repair against an exhaustive search over all rows at once."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from panelloom.llm import queries, turn_repair

SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": "u", "s": "u", "a": "u", "u": "a"}
ROLE = {"u": "user", "a": "assistant"}
SF = "/root/testdata/sf0.01"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """``cost, audit, repaired`` by states as strings and whole audits: no vectors, no chunks."""

    def with_inserts(best):
        for _ in range(4):
            for s, follows in AFTER.items():
                if follows in best:
                    cost, audit, text = best[follows]
                    new = (cost + 5, "I" + audit, (ROLE[follows] + ":", *text))
                    best[s] = min(best.get(s, new), new)
        return best

    best = with_inserts({"": (0, "", ()), "a": (0, "", ())})
    for (role, text), fault in list(zip(rows, faults(rows)))[::-1]:
        new = {}
        for s, follows in AFTER.items():
            ways = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if fault not in ("b", "d"):
                more, initial = 5 * (fault == "t"), role[:1]
                if initial == "s" and s == "" or initial == follows:
                    after = best["s" if initial == "s" else follows]
                    ways.append((after[0] + more, "K" + after[1], (f"{role}:{text}", *after[2])))
                after = best[follows]
                ways.append((after[0] + more + 1, "R" + after[1], (f"{ROLE[follows]}:{text}", *after[2])))
            new[s] = min(ways)
        best = with_inserts(new)
    return best[""]


def expected(conv, turns):
    """The contract's row for ``turns`` (turn, role, text) of a conversation."""
    rows = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    said = [(r, t) for _, r, t in rows]
    cost, audit, text = cheapest(said)
    numbers = [t for t, _, _ in rows if t is not None]
    kinds = faults(said)
    return {
        "conv_id": conv,
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": kinds.count("t"),
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(text).encode()).hexdigest(),
    }


def answers(df):
    return {r["conv_id"]: r.asDict() for r in df.collect()}


def damaged(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return by


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = answers(queries.op13_turn_repair(spark, SF))
    assert got == {c: expected(c, t) for c, t in damaged(rows).items()}


def random_turns(seed, n, roles=("system", "user", "assistant", "tool", " ", "")):
    rnd = random.Random(seed)
    texts = ["", " \n", "ok.", "cut", "why?", "so", "Yes!"]
    return [(rnd.choice([None, i, i, i]), rnd.choice(roles), rnd.choice(texts) + rnd.choice(["", str(i) + rnd.choice([".", ""])])) for i in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_chunks_of_any_size_give_the_same(spark, monkeypatch, chunk):
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    monkeypatch.setattr(turn_repair, "GROWTH", 2)
    convs = {7: random_turns(1, 90), 8: random_turns(2, 40, ("user", "assistant")), 9: [], None: random_turns(3, 9)}
    # No row of these changes a difference of costs: vectors pass through all chunks.
    convs[10] = [(i, "user", f"cut {i}") for i in range(40)]
    convs[11] = [(i, "system", "the same.") for i in range(30)]
    rows = [(c, *t, 1, "extra", 3) for c, turns in convs.items() for t in turns] + [(9, 4, "user", "gone", 0, "extra", 3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, times int, said string, ord int").repartition(5)
    pieces = turn_repair.repaired(df)
    got = answers(turn_repair.conversations(pieces))
    assert got == {c: expected(c, t) for c, t in convs.items()}


def test_repaired_turns_follow_the_form(spark):
    df = spark.createDataFrame([(1, i, r, t, 1) for i, r, t in random_turns(5, 60)], "conv_id bigint, turn bigint, role string, text string, times int")
    turns = turn_repair.repaired_turns(turn_repair.repaired(df)).orderBy("conv_id", "ord", "place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns))


def test_nulls_copies_and_empty_tables(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, times int"
    rows = [(1, None, None, None, 1), (2, 1, "user", "hi.", 3), (2, 1, "assistant", "yes.", 1), (3, 2, None, "x.", 1), (4, None, "user", None, 0)]
    got = answers(turn_repair.conversations(turn_repair.repaired(spark.createDataFrame(rows, schema))))
    copies = {1: [(None, " ", " ")], 2: [(1, "assistant", "yes.")] + [(1, "user", "hi.")] * 3, 3: [(2, " ", "x.")], 4: []}
    assert got == {c: expected(c, t) for c, t in copies.items()}
    assert got[4]["audit"] == "" and got[4]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert turn_repair.conversations(turn_repair.repaired(spark.createDataFrame([], schema))).count() == 0


def test_a_wrong_start_runs_again_only_until_vectors_are_parallel():
    search = turn_repair.Search()
    rnd = random.Random(3)
    codes = bytes(rnd.choice([0, 1, 2, 1, 2, 5, 6]) for _ in range(500))
    true, guess = (3, 1, 0, 2), turn_repair.FINAL
    result = search.back(codes, guess)
    steps = []
    step = search.step
    search.step = lambda after, code: steps.append(1) or step(after, code)
    assert search.again(codes, true, guess, result) == turn_repair.Search().back(codes, true)
    assert len(steps) < 100
