"""Best-fit-decreasing packing of documents into sequences of bounded length.

Pieces of equal length are alike to the packer, so it works on the histogram of piece
lengths - at most ``size`` rows, whatever the input - and hands out ranges of sequences
to ranges of pieces.  A segment tree over remaining capacities finds the tightest open
sequence in logarithmic time; a sequence takes as many equal pieces as one-by-one
best fit would give it.  Spark cuts and ranks the pieces and looks their places up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sidematch.session import materialize
from .common import map_batches, ranked

SIZE = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: its ids, then ``end_id``; longer documents
    are cut into pieces of ``size``, the first one may be shorter.

    ``with_ids`` adds the ids themselves.  A null or empty text is the end id alone;
    repeated rows give repeated pieces; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from .tokens import encoder

        enc = encoder(tokenizer)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    stop = at + ((n - at) % size or size)
                    part = ids[4 * at:4 * stop]
                    for column, value in zip(out, (doc_id, piece, at, stop - at, zlib.crc32(part), part)):
                        column.append(value)
                    at, piece = stop, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out[:keep], kinds)], names=names[:keep])

    return map_batches(docs, run, PIECES + (", ids binary" if with_ids else ""))


class Capacities:
    """Segment tree over remaining capacities: which of them have an open sequence."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = [0] * (2 * self.leaves)

    def set(self, capacity: int, open_: bool) -> None:
        node = capacity + self.leaves
        self.used[node] = int(open_)
        node //= 2
        while node:
            self.used[node] = self.used[2 * node] | self.used[2 * node + 1]
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest capacity with an open sequence that is at least ``length``."""
        node = length + self.leaves
        if self.used[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.used[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: pieces}``.

    Rows ``(length, first rank, ranks, first sequence, offset)``: pieces of this length
    with these ranks go to as many consecutive sequences, each at ``offset``.
    """
    tree, open_, placed, sequences = Capacities(size), defaultdict(list), [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            open_[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = size, sequences
                count = -(-left // (size // length))
                sequences += count
            else:
                first, count = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            whole = min(count, left // each)
            rest = left - whole * each if whole < count else 0
            for k in range(each if whole else 0):
                placed.append((length, rank, whole, first, size - capacity + k * length))
                rank += whole
            left -= whole * each
            put(capacity - each * length, first, whole)
            if rest:
                for k in range(rest):
                    placed.append((length, rank, 1, first + whole, size - capacity + k * length))
                    rank += 1
                left = 0
                put(capacity - rest * length, first + whole, 1)
                put(capacity, first + whole + 1, count - whole - 1)
            else:
                put(capacity, first + whole, count - whole)
    return placed


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and more; every length from 1 to ``size``)
    with ``sequence_id`` and ``offset``; offsets of a sequence have no gaps.

    Pieces of equal length take their ranks in the order of ``doc_id, piece``, so a
    repeated row only changes places with its own copy.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    rows = sorted(plan(histogram, size))
    places = np.array(rows, np.int64).reshape(-1, 5)
    shift = 1 << 48
    table = spark.sparkContext.broadcast((places[:, 0] * shift + places[:, 1], places[:, 1], places[:, 3], places[:, 4]))
    numbered = ranked(pieces, "length", ["doc_id", "piece"], total)
    length_at, rank_at = numbered.columns.index("length"), numbered.columns.index("_rank")

    def run(batches):
        starts, ranks, firsts, offsets = table.value
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(rank_at).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(starts, length * shift + rank, "right") - 1
            keep = [i for i in range(batch.num_columns) if i != rank_at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    fields = [f for f in numbered.schema.fields if f.name != "_rank"]
    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return map_batches(numbered, run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Places of all pieces of ``docs`` (``doc_id, text``); see ``cut_pieces``, ``pack``."""
    return pack(cut_pieces(docs, tokenizer, size, end_id), size)
