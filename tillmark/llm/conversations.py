"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2), Insert an empty text of user or assistant (5). Blank rows and
duplicates have to be deleted; a truncated row that stays costs 5 more. The repair is a dynamic program over rows and four
states (nothing yet, after s, after u, after a). Going backward it keeps the vector of the states' remaining costs only at
checkpoints, a square root of the rows apart; walking forward it works the vectors of one block out again and takes, of the
tight edits, the one whose initial is least in ASCII. An initial decides the next state, so that is the least audit.

Distribution: texts are reduced to digests and flags first. Copies of a row are counted, the first of equal role and text is
found by a minimum, and rows are sorted by ranges of (conversation, turn), so a long conversation is spread over many tasks,
each packing bounded segments of one byte per row. Only these bytes meet in one task: as many as the conversation's audit,
itself one cell of the result, has letters. Texts are shuffled once, sorted, and replayed against the audit as a stream that
holds one row at a time; a digest of a whole conversation is a chain over its rows and cannot be split.

Order: by turn, nulls first, then role, then the text's digest (rows of one turn); repeats are adjacent. Nulls in role and
text, and in the key of the damage, count as one space; rows whose conv_id is null are one conversation. Empty texts are
blank. Repeated rows are duplicates of the first. Very long texts are digested by Spark and never held beside others in
Python beyond one Arrow batch. An empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillmark.llm.common import NOT_SPACE, arrow_map
from tillmark.session import durable

#: Costs of the edits, and what a truncated row that stays costs besides.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. Role that a state asks for, and the state this role leads to.
ASKS, LEADS = "uuau", (2, 2, 3, 2)
ROLES = {"u": "user", "a": "assistant"}
#: What a row is, in one letter: initial of its role (s, u, a, any other) times its first fault.
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
LETTERS = "ABCDEFGHIJKLMNOP"
#: Rows of a segment at most.
SEGMENT = 65_536
#: Arrow rows per Python batch while texts are replayed.
ROWS = 256

Vector = tuple[int, int, int, int]
END: Vector = (0, 10, 5, 0)


def letter(initial: str, fault: str) -> str:
    kind = INITIALS.index(initial) if initial and initial in INITIALS else 3
    return LETTERS[4 * kind + FAULTS.index(fault)]


@cache
def _choices(symbol: str, after: Vector) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a row: initial, next state, cost to the end; ``after`` holds the costs behind the row."""
    kind, fault = divmod(LETTERS.index(symbol), 4)
    initial, stays = "sua."[kind], TRUNCATED if FAULTS[fault] == "truncated" else 0
    out = []
    for state in range(4):
        edits = [("D", state, DELETE + after[state])]
        if FAULTS[fault] not in ("blank", "duplicate"):
            if initial == ASKS[state]:
                edits.append(("K", LEADS[state], stays + after[LEADS[state]]))
            elif initial == "s" and state == 0:
                edits.append(("K", 1, stays + after[1]))
            edits.append(("R", LEADS[state], RENAME + stays + after[LEADS[state]]))
        out.append(tuple(edits))
    return tuple(out)


@cache
def _before(symbol: str, after: Vector) -> Vector:
    """Costs in front of a row: its edits, with up to two inserts before them."""
    own = [min(cost for _, _, cost in edits) for edits in _choices(symbol, after)]
    third = (3, 3, 2, 3)  # where a second insert leads; from u on the first insert leads to a, the second back
    return tuple(min(own[s], INSERT + own[LEADS[s]], 2 * INSERT + own[third[s]]) for s in range(4))  # type: ignore[return-value]


@cache
def _back(symbol: str, after: Vector) -> tuple[Vector, int]:
    """:func:`_before` less its least cost, and that cost: differences between states are few, so all steps are soon known."""
    vector = _before(symbol, after)
    least = min(vector)
    return tuple(c - least for c in vector), least  # type: ignore[return-value]


@cache
def _forth(symbol: str, after: Vector, state: int) -> tuple[str, int]:
    """The initials least in ASCII that bring the state past a row at the least cost, and the state behind it."""
    vector, done = _before(symbol, after), ""
    while True:
        tight = {edit: to for edit, to, cost in _choices(symbol, after)[state] if cost == vector[state]}
        if "D" not in tight and INSERT + vector[LEADS[state]] == vector[state]:
            done, state = done + "I", LEADS[state]
            continue
        edit = min(tight)
        return done + edit, tight[edit]


def repair(symbols: str) -> tuple[int, str]:
    """Cost and audit of a conversation given as one letter per row."""
    step = isqrt(len(symbols)) + 1
    checkpoints: dict[int, Vector] = {len(symbols): END}
    vector, cost = END, 0
    for i in range(len(symbols) - 1, -1, -1):
        vector, least = _back(symbols[i], vector)
        cost += least
        if i % step == 0:
            checkpoints[i] = vector
    cost += vector[0]

    audit, state = [], 0
    for first in range(0, len(symbols), step):
        block = symbols[first : first + step]
        after = [checkpoints[first + len(block)]]
        for symbol in reversed(block[1:]):
            after.append(_back(symbol, after[-1])[0])
        for symbol in block:
            letters, state = _forth(symbol, after.pop(), state)
            audit.append(letters)
    audit.append({0: "", 1: "II", 2: "I", 3: ""}[state])
    return cost, "".join(audit)


def _illegal(symbols: str) -> int:
    kinds = ["sua."[LETTERS.index(s) // 4] for s in symbols]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


def damage(rows: DataFrame) -> DataFrame:
    """``who, conv_id, turn, role0, text0`` as they stand, and after the damage ``role, text`` and the number of ``copies``."""
    who = F.coalesce(rows["conv_id"].cast("string"), F.lit(" "))
    turn = F.coalesce(rows["turn"].cast("string"), F.lit(" "))
    role, text = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    hit = F.crc32(F.concat(who, F.lit(":"), turn).cast("binary")) % 20
    return rows.select(
        who.alias("who"), rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), role.alias("role0"), text.alias("text0"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def intact(rows: DataFrame) -> DataFrame:
    """The columns of :func:`damage` for a table that is repaired as it stands."""
    role, text = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    who = F.coalesce(rows["conv_id"].cast("string"), F.lit(" "))
    return rows.select(
        who.alias("who"), rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), role.alias("role0"), text.alias("text0"),
        role.alias("role"), text.alias("text"), F.lit(1).alias("copies"),
    )


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _letters() -> Column:
    """The letter of a row but for duplicates: columns ``role, blank, ended``."""
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(~F.col("ended"), 3).otherwise(0)
    return F.substring(F.lit(LETTERS), 4 * kind + fault + 1, F.lit(1))


def _narrow(rows: DataFrame) -> DataFrame:
    """One row without texts per row of :func:`damage` and number of copies; equal rows are summed."""
    short = rows.select(
        "who", "conv_id", "turn", "role0", _digest("text0").alias("digest0"), "role", _digest("text").alias("digest"),
        (~F.col("text").rlike(NOT_SPACE)).alias("blank"),
        F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z").alias("ended"),
        "copies",
    )
    same = [c for c in short.columns if c != "copies"]
    return short.groupBy(*same).agg(F.sum("copies").alias("copies"))


def _segments(rows: DataFrame) -> DataFrame:
    """``who, part, seq, symbols``: the letters of sorted rows, in segments of at most SEGMENT."""
    target = pa.schema([("who", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("symbols", pa.string())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, whose, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        out: list[tuple[str, int, int, str]] = []

        def flush() -> None:
            nonlocal seq, size
            if held:
                out.append((whose, part, seq, "".join(held)))
                held.clear()
                seq, size = seq + 1, 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            for who, first, later, copies in zip(*(batch.column(c).to_pylist() for c in ("who", "symbol", "later", "copies"))):
                if who != whose:
                    flush()
                    whose = who
                left = first
                while copies:
                    room = min(copies, SEGMENT - size)
                    held.append(left + later * (room - 1))
                    copies, size, left = copies - room, size + room, later
                    if size >= SEGMENT:
                        flush()
            if len(out) >= 1024:
                yield batch_of()
        flush()
        if out:
            yield batch_of()

    order = ["who", "turn", "role0", "digest0"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("who", "symbol", "later", "copies").mapInArrow(pack, "who string, part int, seq int, symbols string")


def edits(rows: DataFrame) -> DataFrame:
    """``who, blank, duplicate, truncated, illegal, cost, audit`` of each conversation with rows; ``rows`` from :func:`damage`."""
    short = durable(_narrow(rows).where("copies > 0").drop("conv_id"))
    place = F.struct("turn", "role0", "digest0")
    firsts = short.groupBy("who", "role", "digest").agg(F.min(place).alias("first"))
    marked = short.join(firsts, ["who", "role", "digest"]).withColumn("again", ~place.eqNullSafe(F.col("first")))
    marked = marked.withColumn("symbol", _letters()).withColumn("again", F.lit(True)).withColumn("later", _letters())
    marked = durable(marked.select("who", "turn", "role0", "digest0", "symbol", "later", "copies"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "symbols"))), lambda s: s["symbols"])
    whole = _segments(marked).groupBy("who").agg(F.array_join(parts, "").alias("symbols"))

    def start():
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            texts = batch.column("symbols").to_pylist()
            done = [repair(t) for t in texts]
            counts = {name: [sum(t.count(s) for s in LETTERS[i::4]) for t in texts] for i, name in enumerate(FAULTS) if name}
            yield {
                "who": batch.column("who"), **counts, "illegal": [_illegal(t) for t in texts],
                "cost": [c for c, _ in done], "audit": [a for _, a in done],
            }

        return work

    schema = "who string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    return arrow_map(whole, schema, start)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str]]:
    """Sorted rows, the audit of each conversation first, as ``who, role, text``; a role of None opens a conversation."""
    who, audit, at, state = None, "", 0, 0

    def inserts() -> Iterator[tuple[str, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield who, ROLES[ASKS[state]], ""
            at, state = at + 1, LEADS[state]

    for batch in batches:
        for whose, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("who", "role", "text", "copies"))):
            if role is None:
                yield from inserts()
                who, audit, at, state = whose, text, 0, 0
                yield who, None, ""
                continue
            for _ in range(copies):
                yield from inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    yield who, role, text
                    state = 1 if role[:1] == "s" else LEADS[state]
                elif edit == "R":
                    yield who, ROLES[ASKS[state]], text
                    state = LEADS[state]
    yield from inserts()


def _sorted(rows: DataFrame, audits: DataFrame) -> DataFrame:
    nothing = {"turn": rows.schema["turn"].dataType, "role0": "string", "digest0": "binary", "role": "string", "copies": "int"}
    heads = audits.select(
        "who", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), F.col("audit").alias("text")
    )
    texts = rows.where("copies > 0").select(
        "who", F.lit(1).alias("kind"), "turn", "role0", _digest("text0").alias("digest0"), "role", "copies", "text"
    )
    both = heads.unionByName(texts).repartition("who").sortWithinPartitions("who", "kind", "turn", "role0", "digest0")
    return both.select("who", "role", "text", "copies")


def _stream(rows: DataFrame, audits: DataFrame, schema: str, each) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))
        out: list[tuple] = []
        for row in each(_replayed(small)):
            out.append(row)
            if len(out) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return _sorted(rows, audits).mapInArrow(run, schema)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``who, place, role, text``: the conversations after their edits, rows numbered from 0."""

    def each(events: Iterator[tuple[str, str | None, str]]) -> Iterator[tuple[str, int, str, str]]:
        place = 0
        for who, role, text in events:
            if role is None:
                place = 0
            else:
                yield who, place, role, text
                place += 1

    return _stream(rows, audits, "who string, place bigint, role string, text string", each)


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``who, repaired_sha256``: of ``role:text`` of the rows after their edits, joined by newlines."""

    def each(events: Iterator[tuple[str, str | None, str]]) -> Iterator[tuple[str, str]]:
        whose, chain, begun = None, hashlib.sha256(), False
        for who, role, text in events:
            if role is None:
                if whose is not None:
                    yield whose, chain.hexdigest()
                whose, chain, begun = who, hashlib.sha256(), False
                continue
            chain.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
            begun = True
        if whose is not None:
            yield whose, chain.hexdigest()

    return _stream(rows, audits, "who string, repaired_sha256 string", each)


def report(rows: DataFrame) -> DataFrame:
    """Per conv_id of ``rows`` (from :func:`damage` or :func:`intact`) its faults, gaps, edits and a digest of the repaired text."""
    audits = durable(edits(rows))
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    all_ids = rows.groupBy("who").agg(
        F.max("conv_id").alias("conv_id"),
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).cast("long").alias("gaps"),
    )
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        all_ids.join(audits, "who", "left")
        .join(_digests(rows, audits), "who", "left")
        .select(
            "conv_id", "gaps", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
