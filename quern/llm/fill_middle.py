"""Fill-in-middle: texts cut at two token boundaries and written with the middle last.

Tokens are runs of ASCII letters and single other code points. Where tokens and code points begin is kept in
packed bitvectors with a directory of ones: the ones of a text are its number of tokens, the cuts are
the positions of two of them, and the code points before a cut are a rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text whose bitvectors are made at a time; a longer text is one run.
RUN_BYTES = 4_000_000
_WORDS = 8  # of 64 bits in a block of the directory


class Bits:
    """A packed bitvector with the number of ones before each block of 512 bits: rank and select of many places at a time."""

    def __init__(self, flags: np.ndarray):
        block = 64 * _WORDS
        padded = np.zeros((len(flags) // block + 1) * block, bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.ones.reshape(-1, _WORDS).sum(axis=1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        block = word // _WORDS
        count = self.before[block]
        for k in range(_WORDS - 1):
            inside = block * _WORDS + k
            count = count + np.where(inside < word, self.ones[inside], 0)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return count + np.bitwise_count(self.words[word] & low)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Place of the one with that number (from 0), which must be there."""
        block = np.searchsorted(self.before, nth, side="right") - 1
        word, left = block * _WORDS, nth - self.before[block]
        for _ in range(_WORDS - 1):
            beyond = left >= self.ones[word]
            left, word = np.where(beyond, left - self.ones[word], left), word + beyond
        rest, place = self.words[word], np.zeros(len(nth), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(rest & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= low
            left, place = np.where(beyond, left - low, left), place + width * beyond
            rest = np.where(beyond, rest >> np.uint64(width), rest)
        return (word << 6) + place


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Where tokens and where code points begin in UTF-8 bytes of texts that begin at starts (empty ones left out)."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    point = (data & 0xC0) != 0x80
    point[starts] = True
    token = point.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    token[starts] = True
    return Bits(token), Bits(point)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _cut(ids: pa.Array, texts: pa.Array, forms: list, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    at, data = _strings(texts)
    data, at = data[at[0] : at[-1]], at - at[0]
    token, point = boundaries(data, np.unique(at[:-1][at[1:] > at[:-1]]))
    first = token.rank(at)
    n = np.diff(first)
    left, right = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(left, right), np.maximum(left, right)
    # the end of a text is no start: a cut there isn't selected
    last = max(0, first[-1] - 1)
    place = lambda k: np.where(k == n, at[1:], token.select(np.minimum(first[:-1] + k, last)) if len(data) else 0)
    a, b = place(low), place(high)
    points = point.rank(np.concatenate([at[:-1], a, b])).reshape(3, -1)
    plain = np.array([f == "plain" for f in forms], bool)
    whole, parts = data.tobytes(), []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for form, begin, x, y, end in zip(forms, at[:-1].tolist(), a.tolist(), b.tolist(), at[1:].tolist(), strict=True):
        if form == "plain":
            parts.append(whole[begin:end])
        elif form == "psm":
            parts.append(b"".join((p, whole[begin:x], s, whole[y:end], m, whole[x:y])))
        else:
            parts.append(b"".join((s, whole[y:end], p, whole[begin:x], m, whole[x:y])))
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    output = pa.StringArray.from_buffers(len(parts), pa.py_buffer(ends), pa.py_buffer(b"".join(parts)))
    chars = [pa.array(points[k + 1] - points[k], pa.int64(), mask=plain) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), *chars, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _transformed(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(_strings(batch.column(1))[0])
        run = np.cumsum(sizes) // RUN_BYTES
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            part = batch.slice(low, high - low)
            yield _cut(part.column(0), part.column(1), part.column(2).to_pylist(), part.column(3).to_numpy(), part.column(4).to_numpy())


def fill_in_middle(docs: DataFrame, id_col="doc_id", text_col="text", seed: int = 1, percent: int = 90, percent_spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs.

    n is the number of tokens; prefix and middle end at two of the n + 1 boundaries, drawn by hashing
    (seed, id). The form is `psm` (prefix, suffix, middle), `spm` (suffix, prefix, middle; percent_spm
    of a hundred) or `plain`, which keeps the text: one that is empty or null, that holds a mark, or
    that isn't among the percent drawn. prefix_chars and middle_chars are code points, null if plain.

    No shuffle. A null id hashes as empty; repeated rows are rows, and equal ids are cut alike. A
    task holds the bitvectors of RUN_BYTES of text, or of its longest text.
    """
    doc_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < percent_spm, "spm").otherwise("psm")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_transformed, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that an output was made from. No text that is not plain holds a mark, so the first of each kind is ours."""
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    parts = lambda mark: F.split(body, mark, 2)
    psm, spm = parts(SUFFIX), parts(PREFIX)
    tail, front = F.split(F.get(psm, 1), MIDDLE, 2), F.split(F.get(spm, 1), MIDDLE, 2)
    return F.when(form == "plain", output).when(form == "psm", F.concat(F.get(psm, 0), F.get(tail, 1), F.get(tail, 0))).otherwise(F.concat(F.get(front, 0), F.get(front, 1), F.get(spm, 0)))
