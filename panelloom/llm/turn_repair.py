"""Cheapest repair of conversations to the form ``(s?(ua)+)?`` of role initials, by a parallel Viterbi search.

Edits of the rows of a conversation, in order of turn: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an
empty text of user or assistant, anywhere) 5; a truncated row that is not deleted costs 5 more. Rows that are blank (no
visible character), or whose role and text an earlier row has, must be deleted. Of the cheapest repairs the one whose edits
spell the least string wins.

**States** are what may come next: nothing yet, after system, after user, after assistant. The cost vector of a place
holds, per state, the cheapest way to the end. It is computed from the end backwards, and only its differences matter.

**Rank convergence.** A conversation is cut into chunks of at most ``CHUNK`` rows and ``CHUNK_BYTES`` of text, which are
searched independently: every chunk starts from a speculative vector, that of the end of a conversation. In a fix-up pass a
chunk whose right neighbour gives another vector than it started from runs again, beside its former run, until both
vectors differ only by a constant; from there on nothing changes. Passes go on until no chunk starts from a wrong vector.
A pass carries vectors through blocks of neighbouring chunks, eight times as many as in the pass before, so that even
chunks that never converge need a logarithmic number of passes. Rows that must be deleted change no difference and take no
part. Then each chunk, with the costs behind it, says to which state each entry state leads; these are stitched from the
start, and every chunk traces its least edits.

**Scale.** Equal rows are counted before the shuffle. Rows are dealt by ranges of (conversation, turn, role, text), so a
conversation of any length spreads over tasks, and a chunk is what a task holds. Of a conversation in several chunks one
task sees a byte per live row in the passes. Only ``conversations``, for its digest of the whole repaired text, streams a
conversation through one task, chunk by chunk. Two rows are the same if SHA-256 says so.

NULL roles and texts are one space. NULL turns come first. Rows of one turn are taken by role, then text. A NULL
``conv_id`` is a conversation of its own. ``times`` is the number of copies of a row, which follow each other; a row with 0
only names its conversation. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import map_arrow, written
from panelloom.session import scratch_path

CHUNK, CHUNK_BYTES = 4096, 4 << 20
# Growth of the blocks of chunks that one fix-up pass carries vectors through.
GROWTH = 8
SPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after system, after user, after assistant; the role that comes next and the state it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
COMPLETE = (START, ASSISTANT)
# Per class of role (system, user, assistant, other): the state a kept row leads to from each state, -1 if it cannot stay.
KEPT = ((SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1), (-1, -1, -1, -1))
TRUNCATED = 4
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
# Cost from each state at the end of a conversation.
FINAL = (0, 10, 5, 0)


def role_class(role: str) -> int:
    return "sua".find(role[0]) if role and role[0] in "sua" else 3


class Search:
    """Steps of the search, remembered by vector: there are few vectors, since inserts bound their differences."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}
        self.traces: dict[tuple, tuple] = {}

    def step(self, after: tuple, code: int) -> tuple:
        """``(before, base)``: the vector before a row, less its least value ``base``, from the vector after it."""
        known = self.steps.get((after, code))
        if known is None:
            keep, more = KEPT[code % TRUNCATED], CUT if code >= TRUNCATED else 0
            costs = []
            for s in range(4):
                best = min(DELETE + after[s], REROLE + more + after[NEXT[s]])
                costs.append(min(best, more + after[keep[s]]) if keep[s] >= 0 else best)
            for _ in range(3):
                costs = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
            base = min(costs)
            known = self.steps[after, code] = (tuple(c - base for c in costs), base)
        return known

    def back(self, codes: bytes, after: tuple) -> tuple:
        """The vector before the rows ``codes``."""
        for code in reversed(codes):
            after = self.step(after, code)[0]
        return after

    def again(self, codes: bytes, after: tuple, former: tuple, result: tuple) -> tuple:
        """``back`` from ``after``, where ``former`` gave ``result``: ends where the two vectors agree but for a constant."""
        for code in reversed(codes):
            if after == former:
                return result
            after, former = self.step(after, code)[0], self.step(former, code)[0]
        return after

    def edits(self, state: int, code: int, after: tuple) -> tuple[str, int]:
        """The least edits of a row, inserts before it included, and the state they lead to."""
        known = self.traces.get((state, code, after))
        if known is None:
            before, base = self.step(after, code)
            more = CUT if code >= TRUNCATED else 0
            s, letters = state, ""
            while True:
                cost, kept = base + before[s], KEPT[code % TRUNCATED][s]
                if DELETE + after[s] == cost:
                    known = (letters + "D", s)
                elif INSERT + base + before[NEXT[s]] == cost:
                    letters, s = letters + "I", NEXT[s]
                    continue
                elif kept >= 0 and more + after[kept] == cost:
                    known = (letters + "K", kept)
                else:
                    known = (letters + "R", NEXT[s])
                break
            self.traces[state, code, after] = known
        return known

    def vectors(self, codes: bytes, after: tuple) -> list[tuple]:
        """The vector after each row."""
        out = []
        for code in reversed(codes):
            out.append(after)
            after = self.step(after, code)[0]
        return out[::-1]

    def exits(self, codes: bytes, after: tuple) -> list[int]:
        """The state after the rows from each state before them."""
        states = list(range(4))
        for code, vector in zip(codes, self.vectors(codes, after)):
            states = [self.edits(s, code, vector)[1] for s in states]
        return states


def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times, first``: different rows in order within range partitions; ``first`` where no
    earlier row has the same role and text."""
    there = rows.selectExpr(
        "conv_id",
        "CASE WHEN times > 0 THEN turn END AS turn",
        "CASE WHEN times > 0 THEN coalesce(CAST(role AS STRING), ' ') END AS role",
        "CASE WHEN times > 0 THEN coalesce(text, ' ') END AS text",
        "CAST(times AS BIGINT) AS times",
    ).withColumn("said", F.expr("sha2(concat(length(role), ':', role, text), 256)"))
    row = "sha2(concat_ws(',', coalesce(concat('v', conv_id), ''), coalesce(concat('v', turn), ''), said), 256)"
    there = there.withColumn("row", F.expr(row))
    once = there.groupBy("row").agg(*[F.first(c).alias(c) for c in ("conv_id", "turn", "role", "text")], F.sum("times").alias("times"))
    firsts = there.where("times > 0").groupBy("conv_id", "said").agg(F.min(F.struct("turn", "row")).alias("least")).selectExpr("least.row AS first_row")
    marked = once.join(firsts, F.expr("row = first_row"), "left").selectExpr("conv_id", "turn", "role", "text", "times", "first_row IS NOT NULL AS first")
    id_turn = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    ranged = marked.repartitionByRange(*id_turn, F.expr("left(role, 64)").asc_nulls_first(), F.expr("left(text, 64)").asc_nulls_first())
    return ranged.sortWithinPartitions(*id_turn, F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())


CHUNK_COLUMNS = (
    "ord bigint, whole boolean, rows array<struct<role:string,text:string,live:boolean,deleted:bigint>>, codes binary, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
    "first_turn bigint, last_turn bigint, n_turns bigint"
)


def chunks(rows: DataFrame) -> DataFrame:
    """The ``ordered`` rows by chunk: one row per chunk with its rows and counts, ``ord`` rising along the table.

    ``whole``: the chunk is all of its conversation for certain; it is not known of the first and last of a partition.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    marked = rows.withColumn("_part", F.expr("CAST(spark_partition_id() AS BIGINT)"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        number = 0
        now: dict | None = None
        done: list[dict] = []
        held = 0

        def opened(conv, part, whole) -> dict:
            nonlocal number
            number += 1
            return {
                "conv_id": conv, "ord": (part << 32) + number, "whole": whole, "rows": [], "codes": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0,
                "illegal": 0, "first_initial": None, "last_initial": None, "first_turn": None, "last_turn": None, "n_turns": 0, "bytes": 0,
            }

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), *chunk_fields()])
            for conv, turn, role, text, times, first, part in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now["conv_id"]:
                    if now is not None:
                        done.append(now)
                    now = opened(conv, part, now is not None)
                elif len(now["rows"]) >= CHUNK or now["bytes"] >= CHUNK_BYTES:
                    now["whole"] = False
                    done.append(now)
                    now = opened(conv, part, False)
                if times:
                    add(now, turn, role, text, times, first)
                if len(done) >= 256 or held >= CHUNK_BYTES:
                    held = 0
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
                held += len(text or "")
        if now is not None:
            now["whole"] = False
            yield pa.RecordBatch.from_pylist([*done, now], schema)

    def add(chunk: dict, turn, role: str, text: str, times: int, first: bool) -> None:
        initial = role[:1]
        body = text.rstrip(SPACE)
        live = bool(body) and first
        if not body:
            chunk["blank"] += times
        else:
            chunk["duplicate"] += times - live
        if live:
            cut_short = body[-1] not in ".!?"
            chunk["truncated"] += cut_short
            chunk["codes"].append(role_class(role) + (TRUNCATED if cut_short else 0))
        if chunk["first_initial"] is None:
            chunk["first_initial"] = initial
        else:
            chunk["illegal"] += chunk["last_initial"] + initial not in ("su", "ua", "au")
        # Copies of a row have one role.
        chunk["illegal"] += times - 1
        chunk["last_initial"] = initial
        if turn is not None:
            if chunk["first_turn"] is None:
                chunk["first_turn"] = turn
            chunk["n_turns"] += turn != chunk["last_turn"]
            chunk["last_turn"] = turn
        # A deleted row's text is not needed any more.
        chunk["rows"].append({"role": role if live else None, "text": text if live else None, "live": live, "deleted": times - live})
        chunk["bytes"] += len(text) if live else 0

    return map_arrow(marked, cut, f"`conv_id` {kind}, {CHUNK_COLUMNS}")


def chunk_fields() -> list[pa.Field]:
    row = pa.struct([("role", pa.string()), ("text", pa.string()), ("live", pa.bool_()), ("deleted", pa.int64())])
    kinds = {"ord": pa.int64(), "whole": pa.bool_(), "rows": pa.list_(row), "codes": pa.binary(), "first_initial": pa.string(), "last_initial": pa.string()}
    names = [part.split()[0] for part in CHUNK_COLUMNS.replace("array<struct<role:string,text:string,live:boolean,deleted:bigint>>", "rows").split(", ")]
    return [pa.field(n, kinds.get(n, pa.int64())) for n in names]


def _packed(vector: tuple) -> int:
    return sum(v << (8 * i) for i, v in enumerate(vector))


def _vector(number: int) -> tuple:
    return tuple((number >> (8 * i)) & 255 for i in range(4))


def converged(parts: DataFrame) -> DataFrame:
    """``ord, after, entry, last`` for the chunks ``parts`` (``conv_id, ord, codes``): the vector behind each, the state
    before it, and whether it ends its conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    in_order = Window.partitionBy("conv_id").orderBy("ord")
    final = _packed(FINAL)
    schema = f"`conv_id` {kind}, place bigint, ord bigint, codes binary, used bigint, before bigint"
    names = ["conv_id", "place", "ord", "codes", "used", "before"]

    def speculate(batches):
        search = Search()
        for batch in batches:
            found = [_packed(search.back(c, FINAL)) for c in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([final] * len(found), pa.int64()), pa.array(found, pa.int64())], names=names)

    def fixed(batches):
        """Blocks of chunks from the last to the first: a chunk behind one of its block gets that one's new vector."""
        search = Search()
        block, vector = None, None
        for batch in batches:
            codes, used, before, behind = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            blocks = list(zip(batch.column(0).to_pylist(), batch.column(7).to_pylist()))
            for r in range(batch.num_rows):
                after = vector if blocks[r] == block else behind[r]
                if after != used[r]:
                    before[r] = _packed(search.again(codes[r], _vector(after), _vector(used[r]), _vector(before[r])))
                    used[r] = after
                block, vector = blocks[r], before[r]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(used, pa.int64()), pa.array(before, pa.int64())], names=names)

    numbered = parts.withColumn("place", F.row_number().over(in_order).cast("bigint")).select("conv_id", "place", "ord", "codes")
    now = written(map_arrow(numbered, speculate, schema))
    span = 1
    while True:
        behind = now.withColumn("behind", F.coalesce(F.lead("before").over(in_order), F.lit(final)))
        if behind.where("behind <> used").isEmpty():
            break
        span *= GROWTH
        dealt = behind.withColumn("block", F.expr(f"place DIV {span}")).repartition("conv_id", "block")
        now = written(map_arrow(dealt.sortWithinPartitions("conv_id", F.col("place").desc()), fixed, schema))

    def leading(batches):
        search = Search()
        for batch in batches:
            exits = [search.exits(c, _vector(v)) for c, v in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(exits, pa.list_(pa.int32()))], names=["conv_id", "place", "ord", "after", "exits"])

    def entered(batches):
        conv, state = object(), START
        for batch in batches:
            convs, exits = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            entries = []
            for r in range(batch.num_rows):
                if convs[r] != conv:
                    conv, state = convs[r], START
                entries.append(state)
                state = exits[r][state]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (2, 3)), pa.array(entries, pa.int32()), batch.column(5)], names=["ord", "after", "entry", "last"])

    led = map_arrow(now, leading, f"`conv_id` {kind}, place bigint, ord bigint, after bigint, exits array<int>")
    led = led.withColumn("last", F.lead("ord").over(in_order).isNull())
    # A few bytes per chunk, conversation by conversation.
    return map_arrow(led.repartition("conv_id").sortWithinPartitions("conv_id", "place"), entered, "ord bigint, after bigint, entry int, last boolean")


PIECE_COLUMNS = "repaired array<struct<role:string,text:string>>, audit string, cost bigint"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "n_turns")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations by chunk: ``conv_id, ord, whole``, the chunk's counts, ``repaired`` rows in order, the
    initials of their edits (``audit``) and ``cost``. ``rows`` are ``conv_id, turn, role, text, times``."""
    spark = rows.sparkSession
    path = scratch_path(spark, "chunks")
    chunks(ordered(rows)).write.parquet(path)
    stored = spark.read.parquet(path)
    kind = stored.schema["conv_id"].dataType.simpleString()
    settled = converged(stored.where("NOT whole").select("conv_id", "ord", "codes")).withColumnRenamed("ord", "_ord")
    joined = stored.join(settled, F.expr("ord = _ord"), "left").select(
        "conv_id", "ord", "whole", *COUNTS, "rows", "codes",
        F.coalesce("after", F.lit(_packed(FINAL))).alias("after"), F.coalesce("entry", F.lit(START)).alias("entry"), F.coalesce("last", F.lit(True)).alias("last"),
    )
    counts = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.select(*COUNTS).schema.fields)
    pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def traced(batches):
        search = Search()
        for batch in batches:
            kept = list(range(3 + len(COUNTS)))
            rows, codes, after, entry, last = (batch.column(i).to_pylist() for i in range(len(kept), len(kept) + 5))
            out, audits, costs = [], [], []
            for r in range(batch.num_rows):
                new, audit, cost = trace(search, rows[r], codes[r], _vector(after[r]), entry[r], last[r])
                out.append(new)
                audits.append(audit)
                costs.append(cost)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(out, pair), pa.array(audits, pa.string()), pa.array(costs, pa.int64())],
                names=[*(batch.schema.names[i] for i in kept), "repaired", "audit", "cost"],
            )

    return map_arrow(joined, traced, f"`conv_id` {kind}, ord bigint, whole boolean, {counts}, {PIECE_COLUMNS}")


def trace(search: Search, rows: list[dict], codes: bytes, after: tuple, state: int, last: bool) -> tuple[list[dict], str, int]:
    """The repaired rows of a chunk, the initials of its edits and their cost."""
    vectors = search.vectors(codes, after)
    new, audit, cost, at = [], [], 0, 0
    for row in rows:
        if row["live"]:
            code = codes[at]
            letters, _ = search.edits(state, code, vectors[at])
            at += 1
            for letter in letters:
                if letter == "D":
                    cost += DELETE
                elif letter == "I":
                    cost += INSERT
                    new.append({"role": NEXT_ROLE[state], "text": ""})
                    state = NEXT[state]
                else:
                    cost += (REROLE if letter == "R" else 0) + (CUT if code >= TRUNCATED else 0)
                    new.append({"role": NEXT_ROLE[state] if letter == "R" else row["role"], "text": row["text"]})
                    state = NEXT[state] if letter == "R" else KEPT[code % TRUNCATED][state]
            audit.append(letters)
        audit.append("D" * row["deleted"])
        cost += DELETE * row["deleted"]
    while last and state not in COMPLETE:
        audit.append("I")
        cost += INSERT
        new.append({"role": NEXT_ROLE[state], "text": ""})
        state = NEXT[state]
    return new, "".join(audit), cost


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """``conv_id, ord, place, role, text``: the ``repaired`` rows one by one, in order of ``ord`` and ``place``."""
    return pieces.select("conv_id", "ord", F.posexplode("repaired").alias("place", "row")).select("conv_id", "ord", "place", "row.role", "row.text")


def conversations(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    body = "array_join(transform(repaired, r -> concat(r.role, ':', r.text)), '\\n')"
    rows = pieces.selectExpr("conv_id", "ord", *COUNTS, "audit", "cost", f"CASE WHEN whole THEN sha2({body}, 256) END AS digest", f"CASE WHEN NOT whole THEN {body} END AS body")
    schema = f"`conv_id` {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    sums = ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns")

    def folded(batches):
        done: list[dict] = []
        now: dict | None = None
        arrow = None

        def result(c: dict) -> dict:
            gaps = c["last_turn"] - c["first_turn"] + 1 - c["n_turns"] if c["first_turn"] is not None else 0
            return {**c, "gaps": gaps, "audit": "".join(c["audits"]), "repaired_sha256": c["digest"] or c["hash"].hexdigest()}

        def join(one: dict, two: dict) -> None:
            for name in sums:
                one[name] += two[name]
            if one["last_initial"] is not None and two["first_initial"] is not None:
                one["illegal"] += one["last_initial"] + two["first_initial"] not in ("su", "ua", "au")
            if two["last_initial"] is not None:
                one["last_initial"] = two["last_initial"]
            if two["first_turn"] is not None:
                one["n_turns"] -= one["last_turn"] == two["first_turn"]
                one["first_turn"] = two["first_turn"] if one["first_turn"] is None else one["first_turn"]
                one["last_turn"] = two["last_turn"]
            one["audits"].append(two["audit"])
            write(one, two["body"])

        def write(one: dict, text: str | None) -> None:
            if text:
                one["hash"].update((b"\n" if one["any"] else b"") + text.encode("utf-8", "surrogatepass"))
                one["any"] = True

        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field(0), *(pa.field(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
            for piece in batch.to_pylist():
                if now is not None and piece["conv_id"] == now["conv_id"]:
                    join(now, piece)
                    continue
                if now is not None:
                    done.append(result(now))
                now = {**piece, "audits": [piece["audit"]], "hash": hashlib.sha256(), "any": False}
                write(now, piece["body"])
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, result(now)], arrow)

    return map_arrow(rows.repartition("conv_id").sortWithinPartitions("conv_id", "ord"), folded, schema)
