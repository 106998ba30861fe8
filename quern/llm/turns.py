"""Repair of conversation structure: cheapest edits that make the roles `(s?(ua)+)?`, by lazy weighted determinisation.

Read from its last turn to its first, a conversation is a vector: for each state of the wanted
pattern the least cost of mending what comes after. Vectors that differ by a constant are one state of a
deterministic automaton, and there are few of them; a table keeps what each makes of each kind of
turn, filled as needed. A scan of the table gives the cost. Then a trace against the
direction of the scan follows tight arcs, in each state those of the least letter, and gives the edits.

A conversation may be longer than a task should hold. Turns are dealt by range of (conversation, turn); of
a conversation cut by this, each part tells what it makes of every state at its end, and the driver
composes these (a few rows a partition).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, shuffle_partitions

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: State that a turn of initial s, u or a (0, 1, 2; 3 is any other) leads to, where it fits.
STEP = {(START, 0): AFTER_SYSTEM, (START, 1): AFTER_USER, (AFTER_SYSTEM, 1): AFTER_USER, (AFTER_USER, 2): AFTER_ASSISTANT, (AFTER_ASSISTANT, 1): AFTER_USER}
#: State after the one role that an inserted or changed turn can have, and that role.
MADE = {START: (AFTER_USER, "u"), AFTER_SYSTEM: (AFTER_USER, "u"), AFTER_USER: (AFTER_ASSISTANT, "a"), AFTER_ASSISTANT: (AFTER_USER, "u")}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_FAR = 1 << 20
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
#: A turn's code: initial, and 4 if truncated, 8 if blank, 16 if a duplicate.
TRUNCATED_BIT, BLANK_BIT, DUPLICATE_BIT = 4, 8, 16


class RepairAutomaton:
    """States and transitions, made when first asked for. A state is a vector of costs whose least is 0."""

    def __init__(self):
        self.states: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        ends = [_FAR] * 4
        ends[START] = ends[AFTER_ASSISTANT] = 0
        self.end = self.state(self._inserted(ends))

    def state(self, vector) -> int:
        """Number of a normalised vector."""
        key = tuple(vector)
        if key not in self.states:
            self.states[key] = len(self.vectors)
            self.vectors.append(key)
        return self.states[key]

    @staticmethod
    def _inserted(cost: list[int]) -> list[int]:
        """Costs if turns may be inserted first; two in a row lead back, so three rounds reach all."""
        for _ in range(3):
            cost = [min(cost[q], INSERT + cost[MADE[q][0]]) for q in range(4)]
        return cost

    @staticmethod
    def _consumed(after: tuple, code: int, q: int) -> list[tuple[str, int, int]]:
        """Letters, costs and next states of the ways to deal with a turn in state q, the letters in order."""
        ways = [("D", DELETE + after[q], q)]
        if code < BLANK_BIT:
            kind, extra = code & 3, TRUNCATED if code & TRUNCATED_BIT else 0
            if (q, kind) in STEP:
                ways.append(("K", KEEP + extra + after[STEP[q, kind]], STEP[q, kind]))
            ways.append(("R", REROLE + extra + after[MADE[q][0]], MADE[q][0]))
        return ways

    def _before(self, state: int, code: int) -> list[int]:
        after = self.vectors[state]
        return self._inserted([min(cost for _, cost, _ in self._consumed(after, code, q)) for q in range(4)])

    def move(self, state: int, code: int) -> tuple[int, int]:
        """State before a turn, given the one after it, and the cost that normalising took off."""
        found = self.moves.get((state, code))
        if found is None:
            cost = self._before(state, code)
            least = min(cost)
            found = self.moves[state, code] = self.state(c - least for c in cost), least
        return found

    def trace(self, state: int, code: int, q: int) -> tuple[str, int]:
        """Edits up to and with a turn, each a letter and the made role's initial (- if kept or deleted), and the state of the pattern after it."""
        found = self.traces.get((state, code, q))
        if found is None:
            cost, after, edits, at = self._before(state, code), self.vectors[state], "", q
            while True:
                tight = {letter: to for letter, c, to in self._consumed(after, code, at) if c == cost[at]}
                if "D" not in tight and INSERT + cost[MADE[at][0]] == cost[at]:  # I comes before K and R
                    at, role = MADE[at]
                    edits += "I" + role
                    continue
                letter = min(tight)
                edits += letter + (MADE[at][1] if letter == "R" else "-")
                found = self.traces[state, code, q] = edits, tight[letter]
                break
        return found

    def tail(self, q: int) -> str:
        """Inserts after the last turn."""
        edits, cost = "", self.vectors[self.end]
        while cost[q]:
            q, role = MADE[q]
            edits += "I" + role
        return edits

    def explored(self) -> None:
        """Make all states that any turns lead to."""
        k = 0
        while k < len(self.vectors):
            for code in range(BLANK_BIT + 1):
                self.move(k, code)
            k += 1


def _scanned(auto: RepairAutomaton, codes: list[int], state: int) -> tuple[list[int], int]:
    """States after each turn, then the one before the first last, in the order of the scan; and the cost taken off."""
    states, total, moves = [state], 0, auto.moves
    for code in reversed(codes):
        found = moves.get((state, code)) or auto.move(state, code)
        state = found[0]
        total += found[1]
        states.append(state)
    return states, total


def _traced(auto: RepairAutomaton, codes: list[int], states: list[int], q: int) -> tuple[list[str], int]:
    """Edits of each turn from state q on, and the state of the pattern at the end."""
    edits, traces = [], auto.traces
    for code, state in zip(codes, reversed(states[:-1]), strict=True):
        found = traces.get((state, code, q)) or auto.trace(state, code, q)
        edits.append(found[0])
        q = found[1]
    return edits, q


def _plain(codes: np.ndarray) -> np.ndarray:
    """Codes as the automaton takes them: turns that must go are one kind."""
    return np.where(codes >= BLANK_BIT, BLANK_BIT, codes)


def _runs(batches):
    """(part, conversation, first place, codes) of each run of one conversation's turns in a part; batches are in order of place."""
    held: list[pa.RecordBatch] = []

    def given():
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        conv = table["conv_id"].combine_chunks()
        conv = conv if isinstance(conv, pa.Array) else conv.chunk(0)
        same = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes, pos = table["code"].to_numpy(), table["pos"].to_numpy()
        part = pos >> _ROW_BITS
        edges = np.flatnonzero((np.diff(same) != 0) | (np.diff(part) != 0)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(pos)], strict=True):
            yield int(part[low]), conv[low].as_py(), int(pos[low]), codes[low:high]

    part = None
    for batch in batches:
        parts = batch.column(batch.schema.get_field_index("pos")).to_numpy() >> _ROW_BITS
        for low, high in _stretches(parts):
            if parts[low] != part:
                yield from given()
                held, part = [], parts[low]
            held.append(batch.slice(low, high - low))
    yield from given()


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    edges = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return list(zip([0, *edges], [*edges, len(values)], strict=True)) if len(values) else []


@dataclass
class Repaired:
    """summary: a row for each conversation; turns: the repaired rows; digests: conv_id, repaired_sha256."""

    summary: DataFrame
    turns: DataFrame
    digests: DataFrame


def damaged(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Rows with faults put in by hash of (conversation, turn): of each twenty one dropped, emptied, robbed of its marks, doubled, said by the user."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col))).alias("h"))
    fault = F.col("h") % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, 2).otherwise(1)
    kept = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return kept.drop("copy")


def _composed(cut: dict, scans: dict, traces: dict | None = None) -> dict:
    """For each part of a cut conversation: the vector and cost at its end and, once traces are known, the state of the pattern at its start.

    cut: conversation -> its parts in order. scans: (part, conversation) -> {vector after: (vector before, cost)}; traces:
    (part, conversation) -> state after each of the four.
    """
    end, found = RepairAutomaton(), {}
    for conv, parts in cut.items():
        vector, cost, after = end.vectors[end.end], 0, {}
        for part in reversed(parts):
            after[part] = vector, cost
            vector, more = scans[part, conv][vector]
            cost += more
        q = START
        for part in parts:
            found[part, conv] = *after[part], q
            q = traces[part, conv][q] if traces else START
    return found


def repair_conversations(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> Repaired:
    """Cheapest repair of each conversation, taken by turn (nulls first; then role and hash of the text).

    A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated
    (its last other character isn't `.`, `!` or `?`). Keep costs 0, Rerole 2, Delete 3 and must be done to blank
    and duplicate turns, Insert (an empty text) 2; truncated turns that stay add 1. summary has conv_id, gaps,
    blank, duplicate, truncated, illegal, cost and audit: the letters of the cheapest edits in order, of ties the
    ASCII-least. turns has conv_id, pos, nth, edit, role and text of the repaired conversation in order of (pos, nth).

    Null roles and texts are one space, a null conv_id is a conversation, an empty table gives none. A task holds codes of
    its range of turns, never texts; conversations of any length are cut. digests hashes a conversation's lines one after
    another, as SHA-256 asks, in bounded memory.
    """
    spark = rows.sparkSession
    scratch, n = Scratch(spark, "turns"), shuffle_partitions(spark)
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    slim = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    order = ["conv_id", "turn", "role", "tie"]
    dealt = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = kind + F.when(trimmed == "", BLANK_BIT).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED_BIT)
    digest = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = scratch.save(dealt.select("conv_id", "turn", "role", "text", code.alias("code"), F.unhex(digest).alias("digest"), F.monotonically_increasing_id().alias("pos")), "placed")

    told = placed.select("conv_id", "turn", "code", "digest", "pos")
    first = told.groupBy("digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = told.select("digest", "pos").join(first, "digest").where("pos > first").select("pos", F.lit(DUPLICATE_BIT).alias("again"))
    part = F.shiftright("pos", _ROW_BITS)
    coded = told.join(again, "pos", "left").select("conv_id", "pos", (F.col("code") + F.coalesce("again", F.lit(0))).alias("code"))
    coded = scratch.save(coded, "coded")
    kind_of = placed.schema["conv_id"].dataType.simpleString()

    # conversations that lie in more than one part: the first or last of a part alone can be one
    ends = coded.groupBy(part.alias("part")).agg(F.min_by("conv_id", "pos").alias("first"), F.max_by("conv_id", "pos").alias("last"), F.max_by("code", "pos").alias("code")).orderBy("part").collect()
    cut: dict = {}
    for r in ends:
        for conv in {r["first"], r["last"]}:
            cut.setdefault(conv, []).append(r["part"])
    cut = {conv: parts for conv, parts in cut.items() if len(parts) > 1}
    last_kind = {r["part"]: r["code"] & 3 for r in ends}
    within = {(p, conv) for conv, parts in cut.items() for p in parts}
    parts_cut = sorted({p for p, _ in within})
    in_order = lambda df: df.repartition(n, part).sortWithinPartitions("pos")

    def scan_cut(batches):
        auto = RepairAutomaton()
        auto.explored()
        for p, conv, _, codes in _runs(batches):
            if (p, conv) in within:
                at, cost = np.arange(len(auto.vectors)), np.zeros(len(auto.vectors), np.int64)
                table = np.array([[auto.move(s, c) for c in range(BLANK_BIT + 1)] for s in range(len(auto.vectors))])
                for c in _plain(codes)[::-1].tolist():
                    cost += table[at, c, 1]
                    at = table[at, c, 0]
                yield pa.RecordBatch.from_pydict({"part": [p] * len(at), "conv_id": pa.array([conv] * len(at), _arrow[0]), "after": [list(v) for v in auto.vectors], "before": [list(auto.vectors[k]) for k in at.tolist()], "cost": cost})

    def trace_cut(batches):
        auto = RepairAutomaton()
        for p, conv, _, codes in _runs(batches):
            if (p, conv) in within:
                own = _plain(codes).tolist()
                states, _ = _scanned(auto, own, auto.state(known[p, conv][0]))
                yield pa.RecordBatch.from_pydict({"part": [p], "conv_id": pa.array([conv], _arrow[0]), "ends": [[_traced(auto, own, states, q)[1] for q in range(4)]]})

    from pyspark.sql.pandas.types import to_arrow_type

    _arrow = [to_arrow_type(placed.schema["conv_id"].dataType)]
    known: dict = {}
    if within:
        straddling = in_order(coded.where(part.isin(*parts_cut) if len(parts_cut) <= 1000 else F.lit(True)))
        scans: dict = {}
        for r in straddling.mapInArrow(scan_cut, f"part long, conv_id {kind_of}, after array<long>, before array<long>, cost long").collect():  # a few dozen rows a part
            scans.setdefault((r["part"], r["conv_id"]), {})[tuple(r["after"])] = tuple(r["before"]), r["cost"]
        known = _composed(cut, scans)
        traces = {(r["part"], r["conv_id"]): r["ends"] for r in straddling.mapInArrow(trace_cut, f"part long, conv_id {kind_of}, ends array<long>").collect()}
        known = _composed(cut, scans, traces)
    final = {conv: parts[-1] for conv, parts in cut.items()}
    before = {(p, conv): last_kind[q] for conv, parts in cut.items() for q, p in zip(parts, parts[1:], strict=False)}

    def repaired(batches):
        auto = RepairAutomaton()
        out: list[tuple] = []

        def batch():
            columns = list(zip(*out, strict=True))
            types = [_arrow[0], *[pa.int64()] * 6, pa.string(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "pos", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits"])

        size = 0
        for p, conv, pos, codes in _runs(batches):
            vector, cost, q = known.get((p, conv)) or (auto.vectors[auto.end], 0, START)
            own = _plain(codes).tolist()
            states, more = _scanned(auto, own, auto.state(vector))
            total = cost + more + auto.vectors[states[-1]][START] if (p, conv) not in before else 0
            edits, q = _traced(auto, own, states, q)
            if final.get(conv, p) == p:
                edits[-1] += auto.tail(q)
            kinds = np.concatenate([[before[p, conv]], codes & 3]) if (p, conv) in before else codes & 3
            a, b = kinds[:-1], kinds[1:]
            legal = (a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1)
            blank = codes & BLANK_BIT > 0
            again = ~blank & (codes & DUPLICATE_BIT > 0)
            short = ~blank & ~again & (codes & TRUNCATED_BIT > 0)
            out.append((conv, pos, int(blank.sum()), int(again.sum()), int(short.sum()), int((~legal).sum()), total, "".join(edits)[::2], edits))
            size += len(edits)
            if size > 100_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    runs = in_order(coded).mapInArrow(repaired, f"conv_id {kind_of}, pos long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<string>")
    runs = scratch.save(runs, "runs")
    faults = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "audit"))), lambda x: x["audit"]), "")
    sums = runs.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in faults], audit.alias("audit"))
    turns = told.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    turns = turns.withColumnRenamed("conv_id", "of")
    summary = sums.join(turns, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *faults, "audit")

    # a run's edits come just before its first turn
    nothing = F.lit(None)
    given = runs.select("conv_id", "pos", nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), "edits").unionByName(placed.select("conv_id", "pos", "role", "text", nothing.cast("array<string>").alias("edits")))
    given = given.withColumn("later", F.col("edits").isNull())

    def lines(batches):
        """(conversation, place, number there, edit, role, text) of repaired turns."""
        edits = iter(())
        for batch in batches:
            for conv, pos, role, text, own in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if own is not None:
                    edits = iter(own)
                    continue
                told = next(edits)
                for k in range(0, len(told), 2):
                    letter, made = told[k], {"u": "user", "a": "assistant"}.get(told[k + 1])
                    if letter != "D":
                        yield conv, pos, k // 2, letter, role if letter == "K" else made, "" if letter == "I" else text

    def repaired_turns(batches):
        for batch in batches_of(lines(batches), 5_000):
            types = [_arrow[0], pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch, strict=True), types, strict=True)], names=["conv_id", "pos", "nth", "edit", "role", "text"])

    def digests(batches):
        current, running = None, None
        for conv, _, _, _, role, text in lines(batches):
            line = f"{role}:{text}".encode()
            if running is None or conv != current:
                if running is not None:
                    yield current, running.hexdigest()
                current, running = conv, hashlib.sha256(line)
            else:
                running.update(b"\n" + line)
        if running is not None:
            yield current, running.hexdigest()

    def hashed(batches):
        for some in batches_of(digests(batches), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], _arrow[0]), pa.array([h for _, h in some])], names=["conv_id", "repaired_sha256"])

    by_place = given.repartition(n, part).sortWithinPartitions("pos", "later").drop("later")
    by_conversation = given.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos", "later").drop("later")
    return Repaired(summary, by_place.mapInArrow(repaired_turns, f"conv_id {kind_of}, pos long, nth int, edit string, role string, text string"), by_conversation.mapInArrow(hashed, f"conv_id {kind_of}, repaired_sha256 string"))


def batches_of(items, size: int):
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def repair_digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of a table whose rows (some may be gone) are repaired: the summary and the hash of its repaired lines."""
    made = repair_conversations(rows)
    every = conversations.select("conv_id").distinct()
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    met = every.join(named(made.summary, "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left").join(named(made.digests, "b"), F.col("conv_id").eqNullSafe(F.col("b")), "left")
    return met.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
