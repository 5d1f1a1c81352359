"""Repair of conversations against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from taleweave.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
INSERTS = ["", "u", "a", "ua", "au"]


def by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows (turn, role, text) in order."""
    kinds, seen = [], set()
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("fine" if re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    best = None
    for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
        if any(k in ("blank", "duplicate") and e != "D" for k, e in zip(kinds, edits)):
            continue
        cost = sum({"K": 0, "D": 4}.get(e, 3) + (3 if k == "truncated" and e != "D" else 0) for k, e in zip(kinds, edits))
        if best and cost > best[0]:
            continue
        for more in itertools.product(INSERTS, repeat=len(rows) + 1):
            total = cost + 3 * sum(map(len, more))
            if best and total > best[0]:
                continue
            out, audit = [], ""
            for k, extra in enumerate(more):
                out += [({"u": "user", "a": "assistant"}[x], "") for x in extra]
                audit += "I" * len(extra)
                if k < len(rows):
                    _, role, text = rows[k]
                    audit += edits[k][0]
                    if edits[k] == "K":
                        out.append((role, text))
                    elif edits[k] != "D":
                        out.append(({"u": "user", "a": "assistant"}[edits[k][1]], text))
            # a role without a first character can't be kept
            if all(r for r, _ in out) and LEGAL.fullmatch("".join(r[0] for r, _ in out)):
                found = (total, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
                best = min(best, found) if best else found
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, *best)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", " ", ""]
    texts = ["Yes.", "No", " ", "", "So?\n", "Ünd!", "user", "a\x00b."]
    return [(rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    out = {c: some_rows(rng, rng.randrange(1, 4)) for c in range(150)}
    out |= {None: some_rows(rng, 3), 900: [(0, "system", "Be.")], 901: [(k, "user", "Yes.") for k in range(3)]}
    return out


def run(spark, cases, copies=1):
    rows = [(c, t, r, x, copies) for c, own in cases.items() for t, r, x in own]
    df = spark.createDataFrame(rows, SCHEMA + ", copies long").repartition(3)
    out = conversations.summary(*conversations.repair(df)).collect()
    assert len(out) == len(cases)
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_cheapest_edits_match_all_edits(spark, cases):
    got = run(spark, cases)
    for c, rows in cases.items():
        assert got[c] == by_hand(in_order(rows)), (c, rows)


def test_long_conversations_in_segments(spark, cases, monkeypatch):
    monkeypatch.setattr(conversations, "LONG_ROWS", 1)
    got = run(spark, cases)
    for c, rows in cases.items():
        assert got[c] == by_hand(in_order(rows)), (c, rows)


def test_segments_and_batches_agree(spark, monkeypatch):
    rng = random.Random(9)
    cases = {c: some_rows(rng, rng.randrange(20, 60)) + [(7, "user", "Yes.")] * rng.randrange(30) for c in range(12)}
    want = run(spark, cases)
    monkeypatch.setattr(conversations, "LONG_ROWS", 6)
    assert run(spark, cases) == want
    doubled = run(spark, cases, copies=2)
    assert {c: r[2] + r[1] for c, r in doubled.items()} == {c: r[2] + 2 * r[1] + (len(cases[c]) - r[1]) for c, r in want.items()}


def test_repaired_turns_are_legal(spark, cases):
    df = spark.createDataFrame([(c, t, r, x, 1) for c, own in cases.items() for t, r, x in own], SCHEMA + ", copies long")
    pieces, _ = conversations.repair(df)
    for r in pieces.collect():
        assert LEGAL.fullmatch("".join(t.role[0] for t in r.turns))
        assert [t.edit for t in r.turns] == [e for e in r.audit if e != "D"]


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in range(4)] + [(None, None, None, None), (3, None, "user", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit("clash")).withColumn("copies", F.lit(9))
    got = {(r.conv_id, r.turn): tuple(r)[2:] for r in conversations.damaged(df).collect()}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        assert got[c, t] == ("user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text, {0: 0, 3: 2}.get(k, 1))


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.summary(*conversations.repair(conversations.damaged(none))).isEmpty()
    dropped = spark.createDataFrame([(1, 0, "user", "Yes.", 0), (1, 4, "user", "Yes.", 0)], SCHEMA + ", copies long")
    assert [tuple(r) for r in conversations.summary(*conversations.repair(dropped)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
