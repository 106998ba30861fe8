"""Best-fit packing of tokenised documents into sequences of bounded length.

The plan is made over the histogram of piece lengths, not over pieces: best-fit decreasing on counts
yields runs "the pieces of this length with ranks from a to b fill these sequences at this offset".
Pieces then take their slots by a lookup of their rank within their length. Histogram and plan are
bounded by the sequence length (at most max_tokens lengths), whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rank import rank_within
from ._scratch import Scratch
from .tokens import WordCachedTokenizer


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths (1 to capacity).

    Returns runs (length, first rank, first sequence, pieces per sequence, offset): the pieces of
    that length from that rank on lie, so many to a sequence, at that offset. A run ends where the
    next run of its length starts. Each group of sequences with equal fill is handled as one, and
    meets each length once, so the work follows the number of lengths, not of pieces.
    """
    runs = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, how many)
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_by_room:
                insort(rooms, room)
                open_by_room[room] = []
            open_by_room[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            else:
                room = rooms[at]
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            first, many = first + full, many - full
            if many and left:  # fewer than `each` are left: they go to one sequence
                runs.append((length, rank, first, left, capacity - room))
                put(room - left * length, first, 1)
                first, many, left = first + 1, many - 1, 0
            put(room, first, many)
    return runs


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", max_tokens=4096, end_id=1, keep_ids=False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if kept).

    A document's ids are those of its text and then end_id. A null or empty text has only end_id.
    Only documents of more than max_tokens ids are cut. Extra columns of docs are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def cut(batches):
        tokenizer = WordCachedTokenizer(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    some = ids[at : at + 4 * max_tokens]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(some) // 4, zlib.crc32(some), some if keep_ids else None), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", max_tokens=4096, end_id=1, keep_ids=False) -> DataFrame:
    """Pieces with the sequence and the offset that best-fit decreasing gives them.

    Returns the columns of ``tokenized_pieces`` and sequence_id, offset. Offsets within a sequence
    are gapless from 0 and no sequence exceeds max_tokens. Null texts count as empty; null ids and
    repeated rows are packed like any other; an empty table gives no rows. Texts are tokenised
    whole and once; a length that a third of all pieces share is ranked over many tasks.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(tokenized_pieces(docs, tokenizer_path, id_col, text_col, max_tokens, end_id, keep_ids), "pieces")
    ranked, counts = rank_within(pieces, "length", ["doc_id", "piece"], scratch)
    scratch.drop("pieces")
    runs = np.asarray(sorted(plan_best_fit(counts, max_tokens)), np.int64).reshape(-1, 5)
    # at most max_tokens lengths times the groups that one can fill: rows here don't follow the corpus
    sent = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches):
        length, first_rank, first_sequence, each, offset = sent.value.T
        keys = (length << 44) | first_rank
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, (size << 44) | rank, side="right") - 1
            nth = rank - first_rank[run]
            keep = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(first_sequence[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * size)],
                names=[*keep.schema.names, "sequence_id", "offset"],
            )

    columns = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def assembled_sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence (binary, little-endian unsigned 32-bit) from pieces packed with keep_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", whole.alias("ids"))
