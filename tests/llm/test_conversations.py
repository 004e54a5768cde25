import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillmark.llm import conversations as own

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def plain(rows, harm=True):
    """The contract row by row; (cost, audit) by a full table of the best audits, without checkpoints."""
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        after[conv] += []
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20 if harm else 9
        first = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())
        new = (first, "user" if hit == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text))
        after[conv] += [new] * {0: 0, 3: 2}.get(hit, 1)
    return {conv: judge(sorted(got, key=lambda r: r[0])) for conv, got in after.items()}


def judge(rows):
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    turns = [r[0][1] for r in rows if r[0][0]]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def cheapest(rows):
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ()), "a": (0, "", ())}

    def inserts(best):
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                for role in ("user", "assistant"):
                    to = follow.get((state, role[0]))
                    if to in best:
                        cost, audit, out = best[to]
                        best[state] = min(best.get(state, (10**9, "", ())), (cost + 5, "I" + audit, ((role, ""), *out)))
        return best

    best = inserts(best)
    for role, text, fault in reversed(rows):
        new = {}
        for state in ("", "s", "u", "a"):
            found = [(best[state][0] + 2, "D" + best[state][1], best[state][2])] if state in best else []
            if fault in ("", "truncated"):
                for edit, price, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if edit == "R" and name == role:
                        continue
                    to = follow.get((state, name[:1]))
                    if to in best:
                        cost, audit, out = best[to]
                        found.append((cost + price + (5 if fault else 0), edit + audit, ((name, text), *out)))
            if found:
                new[state] = min(found)
        best = inserts(new)
    return best[""]


def test_checkpoints_change_nothing():
    rnd = random.Random(3)
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "": ""}
    for size in [*range(8), 30, 200]:
        for _ in range(60):
            rows = [(names[rnd.choice("suuaat")], "x", rnd.choice(["", "", "", *own.FAULTS])) for _ in range(size)]
            cost, audit, _ = cheapest(rows)
            assert own.repair("".join(own.letter(r[0][:1], r[2]) for r in rows)) == (cost, audit)


def test_cheapest_is_least_of_all_edits():
    """Every string of edits, tried out, for short conversations."""
    for kinds in itertools.product("suat", repeat=2):
        for faults in itertools.product(own.FAULTS, repeat=2):
            found = []
            for audit in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(7)):
                if sum(a != "I" for a in audit) != 2:
                    continue
                for roles in itertools.product("ua", repeat=sum(a in "IR" for a in audit)):
                    made, left, at, cost = "", list(roles), 0, 0
                    for a in audit:
                        cost += {"D": 2, "I": 5, "K": 0, "R": 1}[a]
                        if a == "I":
                            made += left.pop(0)
                            continue
                        if a != "D":
                            made += kinds[at] if a == "K" else left.pop(0)
                            cost += {"": 0, "truncated": 5}.get(faults[at], 10**6)
                        at += 1
                    if GOOD.fullmatch(made) and cost < 10**6:
                        found.append((cost, "".join(audit)))
            assert own.repair("".join(map(own.letter, kinds, faults))) == min(found)


def table():
    rnd = random.Random(8)
    texts = ["Yes.", "No!", "and then", "", " \t\n", None, "Why?", "end. ", "ö ß é", "a.b"]
    roles = ["user", "assistant", "system", "tool", None, "", "ux", "User"]
    rows = []
    for conv in range(120):
        for turn in range(rnd.randrange(1, 9)):
            role = rnd.choice(roles) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn + 3 * (rnd.random() < 0.1), role, rnd.choice(texts) if rnd.random() < 0.5 else f"Text {conv} {turn}."))
    rows += [(None, 1, "user", "Hm."), (None, None, "assistant", "Ah."), (500, None, None, None), (500, None, "user", "Hi."), (501, None, "user", "?")]
    rows += [(600, 4, "user", "Same.")] * 5 + [(601, 1, "system", "S."), (601, 1, "assistant", "A."), (601, 1, "user", "U.")]
    rows += [(700, t, rnd.choice(["user", "assistant"]), f"{t % 150}.") for t in range(400)] + [(701, 1, "user", "w " * 200_000 + ".")]
    rows += [(800 + i, 7, "user", "One.") for i in range(60)]
    return rows


@pytest.mark.parametrize("segment", [own.SEGMENT, 3])
def test_report_equals_the_rows_one_by_one(spark, monkeypatch, segment):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("who", "copies", "symbols", "part", "audit", "role0", "digest", "kind"):
        df = df.withColumn(name, F.lit(name))
    monkeypatch.setattr(own, "SEGMENT", segment)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = own.report(own.damage(df)).collect()
    wanted = plain(rows)
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in got} == wanted
    assert len(got) == len(wanted) and any(v[0] for v in wanted.values()) and any(v[6] == "" for v in wanted.values())


def test_repaired_rows_have_legal_roles(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    rows = own.intact(df)
    made = own.repaired(rows, own.edits(rows))
    roles = made.groupBy("who").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda x: F.left(x["role"], F.lit(1))), "").alias("roles")
    )
    assert all(GOOD.fullmatch(r["roles"]) for r in roles.collect())
    assert {r["conv_id"]: r["cost"] for r in own.report(rows).collect()} == {k: v[5] for k, v in plain(table(), harm=False).items()}


def test_empty_table(spark):
    assert own.report(own.damage(spark.createDataFrame([], SCHEMA))).collect() == []
