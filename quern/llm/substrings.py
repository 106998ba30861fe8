"""Substring dedup by seed and extend: winnowed anchors seed, matches extend to maximal repeats.

A window is `threshold` consecutive words of one document. Winnowing gives each window an anchor, the
word k-gram of smallest hash in it, which depends on the window's words alone: a window can repeat
only where its anchor does. Windows in a row with one anchor form a stretch, all text around the anchor
over which a match through it can extend both ways.

1. Seeds: anchors are counted over all documents. Most occur once, and nothing near them repeats.
2. Extension: where an anchor repeats and every occurrence extends to the same whole stretch, the
   stretch of any but the first document repeats, whatever number of documents share it. Where the
   stretches differ, matches end inside them, and its windows are compared one by one.
3. Repeating windows that overlap or touch join into maximal repeats, which are cut from the text.

All joins are equi-joins of pre-aggregated keys with written tables; there are no pairs of occurrences.
Keys are compared together with the anchor, so two windows are taken as equal by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import Scratch, named

_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=_U))
        held = _powers[base] = made[0], made[1]
    return held[0][:n], held[1][:n]


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[start:end] for each span, wherever it lies."""
    power, inverse = _powers_of(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of some texts in a row: hashes, the text of each, first word of each text (and the end)."""

    hashes: np.ndarray
    of: np.ndarray
    first: np.ndarray

    @classmethod
    def read(cls, texts: list[bytes]) -> Words:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        of = np.searchsorted(text_ends, starts, side="right")
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        return cls(_span_hashes(data.astype(_U) + _U(1), starts, ends, _BYTE_BASE), of, first)


@dataclass
class Stretches:
    """Runs of windows that share an anchor: the text, first window and number of windows, anchor and stretch hash."""

    of: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    stretch: np.ndarray

    @classmethod
    def read(cls, words: Words, threshold: int, gram: int) -> Stretches:
        h, n = words.hashes, len(words.hashes)
        if n < threshold:
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none.astype(_U), none.astype(_U))
        grams = np.zeros(n - gram + 1, _U)
        for j in range(gram):
            grams += _mix(h[j : n - gram + 1 + j] + _U(j + 1))
        grams = _mix(grams)
        reach = threshold - gram + 1  # grams in a window
        least, at, width = grams, np.arange(len(grams)), 1
        while width < reach:  # smallest gram, and the first such, of `width` in a row
            step = min(width, reach - width)
            left = least[:-step] <= least[step:]
            least, at, width = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:]), width + step
        valid = words.of[: n - threshold + 1] == words.of[threshold - 1 :]
        window = np.flatnonzero(valid)
        at = at[window]
        new = np.ones(len(window), bool)
        new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(window)))
        start, at = window[heads], at[heads]
        stretch = _mix(_span_hashes(h, start, start + counts - 1 + threshold, _WORD_BASE) ^ (at - start).astype(_U))
        return cls(words.of[start], start, counts, grams[at], stretch)


def _batches_of_texts(batches, characters=1_000_000):
    """Id, text key and UTF-8 text of some rows at a time: about so many characters, or one long text."""
    ids, keys, texts, size = [], [], [], 0
    for batch in batches:
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids.append(doc_id)
            keys.append(key)
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= characters:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
    if ids:
        yield ids, keys, texts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class _Sieve:
    """A bitmap of hashes: says yes to all that were put in, and to few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, _U(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & self.mask
        return (self.bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1


def _sieve(keys: DataFrame, column: str, rows: int, most_bits: int, parts: int = 16) -> _Sieve:
    """Built in slices on the executors; the driver joins them. At most most_bits bits, whatever the rows."""
    bits = 1 << max(12, min(most_bits.bit_length() - 1, (32 * max(rows, 1)).bit_length()))
    slice_bytes = bits // 8 // parts

    def build(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy().view(_U) & _U(bits - 1)
            byte = (slot >> _U(3)).astype(np.int64)
            for part in np.unique(byte // slice_bytes).tolist():
                mine = byte // slice_bytes == part
                into = held.setdefault(part, np.zeros(slice_bytes, np.uint8))
                np.bitwise_or.at(into, byte[mine] - part * slice_bytes, (1 << (slot[mine] & _U(7))).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()])], names=["part", "bits"])

    part = F.shiftrightunsigned(F.col(column).bitwiseAND(F.lit(bits - 1).cast("long")), 3 + slice_bytes.bit_length() - 1)
    built = np.zeros(bits // 8, np.uint8)
    for r in keys.select(column).repartition(parts, part).mapInArrow(build, "part long, bits binary").collect():
        built[r["part"] * slice_bytes : (r["part"] + 1) * slice_bytes] |= np.frombuffer(r["bits"], np.uint8)
    return _Sieve(built)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a key that parts rows of equal id and different text, text. A null id comes after all others."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(text_col).alias("text"),
    )


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col="doc_id", text_col="text", threshold=20, gram=6, sieve_bits=1 << 29) -> DataFrame:
    """id, key, start, windows: runs of windows whose words also start earlier. Runs may overlap."""
    keyed = _keyed(docs, id_col, text_col)

    def seeds(batches):
        for ids, _, texts in _batches_of_texts(batches):
            s = Stretches.read(Words.read(texts), threshold, gram)
            yield pa.RecordBatch.from_arrays([_signed(s.anchor), pa.array(np.asarray(ids, np.int64)[s.of]), _signed(s.stretch)], names=["anchor", "id", "stretch"])

    counted = (
        keyed.mapInArrow(seeds, "anchor long, id long, stretch long")
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
        .where("n > 1")
        .select("anchor", "first_id", (F.col("low") != F.col("high")).alias("differ"))
    )
    counted = scratch.save(counted, "anchors")
    rows = {r["differ"]: r["count"] for r in counted.groupBy("differ").count().collect()}
    context = docs.sparkSession.sparkContext
    # two bitmaps of at most sieve_bits bits each; past that size they let more through, and results stay exact
    alike = context.broadcast(_sieve(counted.where("not differ"), "anchor", rows.get(False, 0), sieve_bits))
    differing = context.broadcast(_sieve(counted.where("differ"), "anchor", rows.get(True, 0), sieve_bits))

    def extend(batches):
        """kind 0: whole stretches; 1: single windows, the first of their kind in the document; 2: windows that repeat within it."""
        for ids, keys, texts in _batches_of_texts(batches):
            words = Words.read(texts)
            s = Stretches.read(words, threshold, gram)
            whole, single = alike.value.has(s.anchor), differing.value.has(s.anchor)
            either = np.flatnonzero(whole | single)
            run = np.repeat(either, s.windows[either])
            begins = np.cumsum(s.windows[either]) - s.windows[either]
            start = s.start[run] + np.arange(len(run)) - np.repeat(begins, s.windows[either])
            window = _span_hashes(words.hashes, start, start + threshold, _WORD_BASE)
            of = s.of[run]
            order = np.lexsort((start, window, s.anchor[run], of))
            again = np.zeros(len(run), bool)
            a, b = order[1:], order[:-1]
            again[a] = (of[a] == of[b]) & (window[a] == window[b]) & (s.anchor[run[a]] == s.anchor[run[b]])
            parts = [
                (0, np.flatnonzero(whole), None),
                (1, run[single[run] & ~again], single[run] & ~again),
                (2, run[again], again),
            ]
            for kind, r, mine in parts:
                if not len(r):
                    continue
                first = s.start[r] if mine is None else start[mine]
                hashes = s.stretch[r] if mine is None else window[mine]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(r), kind, np.int32)),
                        _signed(s.anchor[r]),
                        _signed(hashes),
                        pa.array(np.asarray(ids, np.int64)[s.of[r]]),
                        pa.array(np.asarray(keys, np.int64)[s.of[r]]),
                        pa.array((first - words.first[s.of[r]]).astype(np.int64)),
                        pa.array((s.windows[r] if mine is None else np.ones(len(r))).astype(np.int64)),
                    ],
                    names=["kind", "anchor", "hash", "id", "key", "start", "windows"],
                )

    found = scratch.save(keyed.mapInArrow(extend, "kind int, anchor long, hash long, id long, key long, start long, windows long"), "extended")
    span = ["id", "key", "start", "windows"]
    stretches = found.where("kind = 0").join(counted.where("not differ").select("anchor", "first_id"), "anchor").where("id > first_id").select(*span)
    single = found.where("kind = 1")
    earliest = single.groupBy("anchor", "hash").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    earliest = scratch.save(earliest.drop("last_id"), "earliest")
    windows = single.join(earliest, ["anchor", "hash"]).where("id > first_id").select(*span)
    within = found.where("kind = 2").select(*span)
    return scratch.save(stretches.unionByName(windows).unionByName(within), "spans")


def _kept(text: str | None, spans: np.ndarray, threshold: int) -> tuple[list[bytes], int]:
    """Words that no repeating window covers, and the number of all words."""
    words = (text or "").encode().split()
    if not len(spans):
        return words, len(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, spans[:, 0] + spans[:, 1] - 1 + threshold, -1)
    keep = np.cumsum(edges[:-1]) == 0
    return [words[k] for k in np.flatnonzero(keep).tolist()], len(words)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", threshold=20, gram=6, digest_only=False) -> DataFrame:
    """Each row of docs with the words of repeated windows removed.

    Returns doc_id, n_words, n_removed, kept_sha256 and, unless digest_only, the kept words joined by
    one space as kept_text and the other columns of docs. A window repeats if its words also start
    earlier: in a document of smaller doc_id or earlier in the same. Windows are judged on the input.

    Words are runs other than ASCII white space, unchanged. A null text has none (kept_text is
    empty). A null id comes after all others; rows that share an id, repeated rows included, do not
    come before one another. Texts are read whole, of any length.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = repeated_spans(docs, scratch, id_col, text_col, threshold, gram)
    scratch.drop("anchors", "extended", "earliest")
    by_doc = spans.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "windows"))).alias("spans"))
    with_text = not digest_only
    rest = [F.struct(*[named(c) for c in docs.columns]).alias("rest")] if with_text else []
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        *rest,
    )
    joined = keyed.join(by_doc, ["id", "key"], "left").select(
        "doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.windows").alias("windows"), *(["rest"] if with_text else [])
    )

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text, starts, windows in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                spans = np.array([starts.as_py(), windows.as_py()], np.int64).T if starts.is_valid else np.zeros((0, 2), np.int64)
                words, n = _kept(text.as_py(), spans, threshold)
                whole = b" ".join(words)
                for column, value in zip(rows, (n, n - len(words), hashlib.sha256(whole).hexdigest(), whole.decode()), strict=True):
                    column.append(value)
            made = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                made += [pa.array(rows[3], pa.string()), batch.column(4)]
                names += ["kept_text", "rest"]
            yield pa.RecordBatch.from_arrays(made, names=names)

    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string").add("rest", keyed.schema["rest"].dataType)
    return joined.mapInArrow(cut, schema)
