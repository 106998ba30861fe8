"""Conversation repair against a search over all edits, conversations cut over many parts included."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from quern.llm.turns import RepairAutomaton, damaged, repair_conversations, repair_digests

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, roles and texts) by trying everything; turns: (role, text, must go, truncated)."""
    follow = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, q, inserted):
        """Least (cost, audit) from turn i in state q."""
        ways = []
        if i == len(turns):
            if q in "0a":
                ways.append((0, "", ()))
        else:
            role, text, gone, short = turns[i]
            c, a, r = best(i + 1, q, 0)
            ways.append((c + 3, "D" + a, r))
            if not gone:
                if (q, role[:1]) in follow:
                    c, a, r = best(i + 1, follow[q, role[:1]], 0)
                    ways.append((c + short, "K" + a, ((role, text), *r)))
                for made in ("user", "assistant"):
                    if (q, made[0]) in follow:
                        c, a, r = best(i + 1, follow[q, made[0]], 0)
                        ways.append((c + 2 + short, "R" + a, ((made, text), *r)))
        if inserted < 4:
            for made in ("user", "assistant"):
                if (q, made[0]) in follow:
                    c, a, r = best(i, follow[q, made[0]], inserted + 1)
                    ways.append((c + 2, "I" + a, ((made, ""), *r)))
        return min(ways, default=(10**6, "", ()))

    return best(0, "0", 0)


def plainly(rows):
    """What the query returns, from damaged rows in order."""
    convs, out = {}, {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for conv, own in convs.items():
        known = [t for _, t, *_ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            chars = WORD.findall(text)
            fault = 0 if not chars else 1 if (role, text) in seen else 2 if chars[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum((a[2][:1], b[2][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(own, own[1:], strict=False))
        cost, audit, made = cheapest(tuple(turns))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        turn = rng.choice([0, 0, 1, 5])
        for _ in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            text = rng.choice(["Yes.", "No", " \t", "", None, "Fine! ", "What?\n", "né…", "same.", f"number {rng.random()}."])
            rows.append((conv, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 4])
    return rows


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_against_all_edits(spark):
    rows = conversations(1, 150)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("pos", "code", "Digest", "a.b")}).repartition(3)
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in repair_digests(table, damaged(table)).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {conv: none for conv, *_ in rows} | plainly(damage(rows))


@pytest.mark.parametrize("parts", [2, 9])
def test_cut_conversations(spark, parts):
    """One conversation holds most rows, another a third: each lies in many parts, and gives what it gives whole."""
    rng = random.Random(parts)
    rows = []
    for conv, n in ((1, 300), (2, 160), (3, 3), (None, 20)):
        for turn in range(n):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(["user", "assistant", "system", "x"])
            rows.append((conv, turn, role, rng.choice([f"text {turn}.", f"text {turn}", "again.", ""])))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        made = repair_conversations(table)
        got = {r.conv_id: r for r in made.summary.collect()}
        sha = {r.conv_id: r.repaired_sha256 for r in made.digests.collect()}
        turns = made.turns.orderBy("conv_id", "pos", "nth").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = plainly(rows)
    assert {c: (*[r[f] for f in FIELDS[:-1]], sha.get(c, hashlib.sha256(b"").hexdigest())) for c, r in got.items()} == wanted
    for conv in wanted:
        text = "\n".join(f"{r.role}:{r.text}" for r in turns if r.conv_id == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == wanted[conv][-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns if r.conv_id == conv))
        assert "".join(r.edit for r in turns if r.conv_id == conv) == got[conv].audit.replace("D", "")


def test_odd_tables(spark):
    """No rows; turns that are null or tie; conversations of which nothing is left; ids of another type."""
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_digests(empty, damaged(empty)).count() == 0
    rows = [("a", None, "user", "Hi."), ("a", None, "user", "Hi."), ("a", 3, "assistant", "Yes."), ("b", None, None, None), (None, 2, "system", "S.")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in repair_conversations(table).summary.collect()}
    assert (got["a"].duplicate, got["a"].gaps, got["a"].audit, got["a"].cost) == (1, 0, "KDK", 3)
    assert (got["b"].blank, got["b"].audit) == (1, "D")
    assert (got[None].audit, got[None].cost) == ("D", 3)
    every = {r.conv_id: r for r in repair_digests(table, table.limit(0)).collect()}
    assert {r.audit for r in every.values()} == {""} and set(every) == {"a", "b", None}


def test_states_are_few():
    auto = RepairAutomaton()
    auto.explored()
    assert len(auto.vectors) < 100
