"""Alignment of two tokenizers: groups of tokens between common ends, and linked tokens.

A stretch of a document's bytes is a ``Fragment``: the tokens before its first common end
(open prefix), the groups that are closed inside, and the tokens after its last common end
(open suffix).  Fragments compose associatively: a suffix and the prefix that follows make
one more group.  Short documents are one fragment; long ones are cut into byte ranges that
Spark deals out, each range owning the tokens that end inside, and their fragments are
composed in rounds of a tree.

Both tokenizers start anew at white space that stands alone between two other characters,
so a range is encoded with the pieces at its ends whole.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidematch.session import materialize
from .common import map_batches, mix
from .tokens import BYTE_PATTERN, byte_ranks

# Bytes of one range of a long document.
RANGE_BYTES = 1 << 15
# Fragments composed by one task at a time.
FAN = 16
# Parts of the table of pair counts; one task holds one part.
PARTS = 16
# Documents per slice: parts times slices tasks look counts up.
SLICE_DOCS = 1 << 17
# Documents whose pairs travel in one record.
PACK_DOCS = 64
# Ids of B are below this, so that a pair is one number.
B_IDS = 1 << 16

_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PIECE_SPACE = "▁"

NOTHING = (0, 0, 0, b"", "")
NO_TOKENS = ((), (), (), ())
NODE = "doc_id long, _row long, _k long, node binary"
RESULT = "doc_id long, _row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs binary"


@dataclass
class Fragment:
    """What a stretch of bytes has of the alignment.

    ``head`` and ``tail`` hold ids and lengths of A's tokens, then of B's; without a common
    end (``closed`` false) everything is in ``head``.  ``links`` packs the linked pairs of
    the closed groups, one per occurrence, and ``groups`` spells their ids.
    """

    head: tuple = NO_TOKENS
    tail: tuple = NO_TOKENS
    closed: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    links: list[bytes] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    equal: bool = True

    def __add__(self, other: Fragment) -> Fragment:
        head, tail, middle, links = self.head, other.tail, [], []
        if not self.closed:
            head = _join(self.head, other.head)
        elif not other.closed:
            tail = _join(self.tail, other.head)
        else:
            text, found = group_of(*_join(self.tail, other.head))
            middle, links = ([text], [found]) if text else ([], [])
        return Fragment(
            head, tail, self.closed or other.closed, self.n_a + other.n_a, self.n_b + other.n_b,
            self.n_groups + len(middle) + other.n_groups, [*self.links, *links, *other.links],
            [*self.groups, *middle, *other.groups], self.equal and other.equal)

    def whole(self) -> Fragment:
        """All groups of a document: its start and its end are common ends."""
        edge = Fragment(closed=True)
        return (edge + self + edge).compact()

    def compact(self) -> Fragment:
        self.links = [b"".join(self.links)] if self.links else []
        self.groups = [";".join(self.groups)] if self.groups else []
        return self


def _join(x: tuple, y: tuple) -> tuple:
    return tuple((*a, *b) for a, b in zip(x, y))


# An id as it is followed in the text of groups: by more of its side, by the other side,
# by the next group.
FOLLOWED = np.array([[f"{i}{mark}" for i in range(B_IDS)] for mark in ",|;"], object)


def closed_groups(a_ids, a_ends, b_ids, b_ends) -> tuple[int, bytes, str]:
    """Number of groups, packed linked pairs and text of tokens that end in a common end.

    Arrays of ids and of ends, counted from where both sides begin.  Between two ends next
    to each other, of whichever side, one token of A and one of B overlap.
    """
    if not len(a_ids):
        return 0, b"", ""
    # marks per byte: texts are short, and sums over marks number tokens and groups
    a_marks, b_marks = np.zeros((2, int(a_ends[-1]) + 1), np.int32)
    a_marks[a_ends] = b_marks[b_ends] = 1
    groups = np.cumsum(a_marks & b_marks)
    ends = np.flatnonzero(a_marks | b_marks)
    links = (a_ids[np.cumsum(a_marks)[ends] - a_marks[ends]] * B_IDS + b_ids[np.cumsum(b_marks)[ends] - b_marks[ends]])
    a_last, b_last = b_marks[a_ends], a_marks[b_ends]
    a_group, b_group = groups[a_ends] - a_last, groups[b_ends] - b_last
    a_upto, b_upto = (np.searchsorted(x, np.arange(int(groups[-1]) + 1)) for x in (a_group, b_group))
    text = np.empty(len(a_ids) + len(b_ids), object)
    text[np.arange(len(a_ids)) + b_upto[a_group]] = FOLLOWED[a_last, a_ids]
    text[np.arange(len(b_ids)) + a_upto[b_group + 1]] = FOLLOWED[2 * b_last, b_ids]
    return int(groups[-1]), links.astype("<u4").tobytes(), "".join(text.tolist())[:-1]


def group_of(a_ids, a_lengths, b_ids, b_lengths) -> tuple[str, bytes]:
    """One group's ids as text, and its linked pairs; nothing for no tokens."""
    a_ids, a_lengths, b_ids, b_lengths = (np.array(x, np.int64) for x in (a_ids, a_lengths, b_ids, b_lengths))
    _, links, text = closed_groups(a_ids, np.cumsum(a_lengths), b_ids, np.cumsum(b_lengths))
    return text, links


def fragment(a_ids, a_ends, b_ids, b_ends, a_start: int = 0, b_start: int = 0) -> Fragment:
    """Fragment of the tokens that end at ``a_ends`` and ``b_ends``; the first ones begin
    at ``a_start`` and ``b_start``."""
    a_ids, a_ends, b_ids, b_ends = (np.array(x, np.int64) for x in (a_ids, a_ends, b_ids, b_ends))
    a_lengths, b_lengths = np.diff(a_ends, prepend=a_start), np.diff(b_ends, prepend=b_start)

    def between(i, j, k, m):
        return tuple(tuple(x.tolist()) for x in (a_ids[i:k], a_lengths[i:k], b_ids[j:m], b_lengths[j:m]))

    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    n_a, n_b = len(a_ids), len(b_ids)
    if not len(common):
        return Fragment(head=between(0, 0, n_a, n_b), n_a=n_a, n_b=n_b)
    (i, k), (j, m) = (np.searchsorted(e, common[[0, -1]]) + 1 for e in (a_ends, b_ends))
    n, links, text = closed_groups(a_ids[i:k], a_ends[i:k], b_ids[j:m], b_ends[j:m])
    return Fragment(between(0, 0, i, j), between(k, m, n_a, n_b), True, n_a, n_b, n, [links] if n else [], [text] if n else [])


class Pair:
    """Two tokenizers over the same bytes: a text with a space before it.

    A's vocabulary comes from its file; tiktoken merges by it, several times faster than
    the library the file is for, with the same ids.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        ranks = byte_ranks(a_path)
        if ranks is None:
            raise ValueError(f"{a_path}: not a byte-level model with ids in the order of its merges")
        # without special tokens their strings inside texts are plain text
        self.a = Encoding("a", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        if self.b.get_piece_size() > B_IDS:
            raise ValueError(f"{b_path}: ids beyond {B_IDS}")
        self.a_bytes, self.b_bytes = np.empty(B_IDS, object), np.empty(B_IDS, object)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        for i in range(self.b.get_piece_size()):
            self.b_bytes[i] = self._b_bytes(i)
        self.a_sizes, self.b_sizes = (np.array([len(x or b"") for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.space_id = self.b.piece_to_id(_PIECE_SPACE)

    def _b_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace(_PIECE_SPACE, " ").encode()

    def tokens(self, text: str) -> tuple | None:
        """Ids and ends of A and of B as arrays; none when a side changes the bytes.

        ``text`` begins with a space, or with a line end inside a document, before which
        the space that B adds stays a token of its own.
        """
        a_ids = np.array(self.a.encode_ordinary(text), np.int64)
        b_ids = self.b.encode(text[1:] if text[0] == " " else text)
        if text[0] != " ":
            b_ids = b_ids[1:] if b_ids[0] == self.space_id else []
        raw, b_ids = text.encode(), np.array(b_ids, np.int64)
        if any(b"".join(spelled[ids].tolist()) != raw for ids, spelled in ((a_ids, self.a_bytes), (b_ids, self.b_bytes))):
            return None
        return a_ids, np.cumsum(self.a_sizes[a_ids]), b_ids, np.cumsum(self.b_sizes[b_ids])

    def short(self, text: str | None) -> tuple:
        """Everything of one document at once: ``n_a, n_b, n_groups, links, groups``."""
        found = self.tokens(" " + text) if text else None
        return NOTHING if found is None else (len(found[0]), len(found[2]), *closed_groups(*found))

    def part(self, text: str, low: int, high: int) -> Fragment:
        """Fragment of the tokens of ``text``, whole pieces, that end in ``(low, high]``."""
        found = self.tokens(text)
        if found is None:
            return Fragment(equal=False)
        args, starts = [], []
        for ids, ends in (found[:2], found[2:]):
            i, k = np.searchsorted(ends, [low, high], "right")
            args += [ids[i:k], ends[i:k]]
            starts.append(int(ends[i - 1]) if i else 0)
        return fragment(*args, *starts)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def ranges(text: str, size: int) -> Iterator[tuple[int, str, int, int]]:
    """``number, text, low, high`` of the byte ranges of a document: whole pieces, and the
    bytes of them that the range owns.  A range ends at a multiple of ``size``, or at the
    first one in a piece that is longer, so no piece lies in more than two ranges."""
    number, window, begin, low, at = 0, [], 0, 0, 0
    for p in _SAFE.split(" " + text):
        window.append(p)
        end = at + len(p.encode())
        edge = (max(low, at) // size + 1) * size
        if edge <= end:
            yield number, "".join(window), low - begin, edge - begin
            number, low = number + 1, edge
            window, begin = ([p], at) if edge < end else ([], end)
        at = end
    if low < at:
        yield number, "".join(window), low - begin, at - begin


def pack_pairs(links: bytes) -> bytes:
    """Different pairs in ascending order as differences, then how often each occurs."""
    pairs, times = np.unique(np.frombuffer(links, "<u4"), return_counts=True)
    steps = np.diff(pairs.astype(np.int64), prepend=0)
    # one plane per byte: most of them are zeros then, and are stored in little space
    return b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (steps, times))


def unpack_pairs(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(packed, np.uint8).reshape(2, 4, -1)
    steps, times = (np.ascontiguousarray(p.T).view("<u4").reshape(-1).astype(np.int64) for p in planes)
    return np.cumsum(steps), times


def _result_row(doc_id, row, n_a, n_b, n_groups, links, groups: str, with_groups: bool) -> tuple:
    sha = hashlib.sha256(groups.encode()).hexdigest() if n_groups else ""
    out = (doc_id, row, n_a, n_b, n_groups, len(links) // 4, sha, pack_pairs(links) if links else None)
    return (*out, groups) if with_groups else out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("_row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("_pairs", pa.binary())])


def _result_schema(with_groups: bool) -> tuple[str, pa.Schema]:
    if not with_groups:
        return RESULT, _RESULT
    return RESULT + ", groups string", _RESULT.append(pa.field("groups", pa.string()))


def _short_documents(docs: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    spark_schema, arrow_schema = _result_schema(with_groups)

    def run(batches):
        pair = pair_of(a_path, b_path)
        for batch in batches:
            yield _batch([
                _result_row(doc_id, row, *pair.short(text), with_groups)
                for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns))], arrow_schema)

    return map_batches(docs, run, spark_schema)


def _long_documents(docs: DataFrame, a_path: str, b_path: str, range_bytes: int, with_groups: bool) -> DataFrame:
    """Ranges are dealt out, encoded where they are, and composed by a tree."""
    cut_schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("_k", pa.int64()), ("text", pa.string()),
                            ("low", pa.int64()), ("high", pa.int64())])
    node_schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("_k", pa.int64()), ("node", pa.binary())])
    spark_schema, arrow_schema = _result_schema(with_groups)

    def cut(batches):
        for batch in batches:
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                for some in batched(ranges(text, range_bytes), FAN):
                    yield _batch([(doc_id, row, *x) for x in some], cut_schema)

    def encode_ranges(batches):
        pair = pair_of(a_path, b_path)
        for batch in batches:
            yield _batch([
                (doc_id, row, k, pickle.dumps(pair.part(text, low, high)))
                for doc_id, row, k, text, low, high in zip(*(c.to_pylist() for c in batch.columns))], node_schema)

    def compose(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["_k"])
        total = sum((pickle.loads(r["node"]) for r in rows), Fragment()).compact()
        first = rows[0]
        return pa.Table.from_batches([_batch(
            [(first["doc_id"], first["_row"], first["_k"] // FAN, pickle.dumps(total))], node_schema)])

    def finish(batches):
        for batch in batches:
            out = []
            for doc_id, row, _, node in zip(*(c.to_pylist() for c in batch.columns)):
                x = pickle.loads(node).whole()
                found = (x.n_a, x.n_b, x.n_groups, x.links[0], x.groups[0]) if x.equal and x.groups else NOTHING
                out.append(_result_row(doc_id, row, *found, with_groups))
            yield _batch(out, arrow_schema)

    cuts = map_batches(docs, cut, "doc_id long, _row long, _k long, text string, low long, high long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = materialize(map_batches(cuts.repartition(n, "_row", "_k"), encode_ranges, NODE))
    most = nodes.agg(F.max("_k")).first()[0] or 0
    while most > 0:
        above = nodes.groupBy("_row", F.floor(F.col("_k") / FAN).alias("_up"))
        nodes = materialize(above.applyInArrow(compose, NODE))
        most //= FAN
    return map_batches(nodes, finish, spark_schema)


def encode(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE_BYTES,
           with_groups: bool = False) -> DataFrame:
    """A stored table with a row per document: numbers, groups and packed pairs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
                       F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > range_bytes
    short = docs.where(~long).withColumn("_row", F.col("_row") * 2)
    longer = docs.where(long).withColumn("_row", F.col("_row") * 2 + 1)
    return materialize(_short_documents(short, a_path, b_path, with_groups).unionByName(
        _long_documents(longer, a_path, b_path, range_bytes, with_groups)))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents hold each linked pair, and whether no other
    pair of its A id is in more."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(batches):
        waiting, size = [], 0

        def flush():
            pairs, at = np.unique(np.concatenate([p for p, _ in waiting]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([n for _, n in waiting])).astype(np.int64)

        def rows(pairs, n):
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i:i + (1 << 16)]), pa.array(n[i:i + (1 << 16)])], schema=schema)

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                pairs = unpack_pairs(packed)[0]
                waiting.append((pairs, np.ones(len(pairs), np.int64)))
                size += len(pairs)
                if size > 1 << 21:
                    waiting = [flush()]
                    size = len(waiting[0][0])
                    if size > 1 << 20:
                        yield from rows(*waiting[0])
                        waiting, size = [], 0
        if waiting:
            yield from rows(*flush())

    counted = map_batches(encoded.where("_pairs IS NOT NULL").select("_pairs"), count, "pair long, n long")
    counts = materialize(counted.groupBy("pair").agg(F.sum("n").alias("n")))
    a_id = F.floor(F.col("pair") / B_IDS).alias("_a")
    most = counts.groupBy(a_id).agg(F.max("n").alias("_most"))
    return counts.select("pair", "n", a_id).join(most, "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


_TRAVEL = "part int, slice int, kind int, rows binary, ends binary, pairs binary, times binary"


def link_sums(encoded: DataFrame, counts: DataFrame, parts: int = PARTS, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """``_row, n_best, count_sum`` of every document with links.

    Pairs are dealt into ``parts`` by their hash and documents into slices; a task gets one
    part of the counts, sorted first, and then streams what a slice of the documents has
    in that part.  A pair that every document holds is one entry per document, dealt out
    by slice.
    """
    travel = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("kind", pa.int32()), ("rows", pa.binary()),
                        ("ends", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary())])
    with_links = encoded.where("_pairs IS NOT NULL")
    slices = max(1, -(-with_links.count() // slice_docs))

    def part_of(pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def split(pairs: np.ndarray):
        part = part_of(pairs)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def pack_counts(batches):
        for batch in batches:
            pairs, n, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order, edges = split(pairs)
            out = []
            for p in range(parts):
                at = order[edges[p]:edges[p + 1]]
                if len(at):
                    out.append((p, 0, 0, b"", b"", pairs[at].astype("<i8").tobytes(),
                                (n[at] * 2 + best[at]).astype("<i8").tobytes()))
            yield _batch(out, travel)

    def pack_documents(batches):
        for batch in batches:
            rows, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(rows), PACK_DOCS):
                some = [unpack_pairs(x) for x in packed[i:i + PACK_DOCS]]
                sizes = np.array([len(x) for x, _ in some])
                pairs, times = (np.concatenate([x[k] for x in some]) for k in (0, 1))
                owner = np.repeat(np.arange(len(some)), sizes)
                order, edges = split(pairs)
                ids = np.array(rows[i:i + PACK_DOCS], "<i8")
                place = int(mix(ids[:1].astype(np.uint64))[0] % np.uint64(slices))
                out = []
                for p in range(parts):
                    at = order[edges[p]:edges[p + 1]]
                    if len(at):
                        ends = np.searchsorted(owner[at], np.arange(len(some)), "right")
                        out.append((p, place, 1, ids.tobytes(), ends.astype("<u4").tobytes(),
                                    pairs[at].astype("<u4").tobytes(), times[at].astype("<u4").tobytes()))
                yield _batch(out, travel)

    sums = pa.schema([("_row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def look_up(batches):
        here, waiting, known = None, [], None
        for batch in batches:
            out = [], [], []
            for part, place, kind, rows, ends, pairs, times in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, place) != here:
                    here, waiting, known = (part, place), [], None
                if kind == 0:
                    waiting.append((np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")))
                    continue
                if known is None:
                    keys, values = (np.concatenate([x[k] for x in waiting]) for k in (0, 1))
                    order = np.argsort(keys)
                    known, waiting = (keys[order], values[order]), []
                pairs, times = np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
                value = known[1][np.searchsorted(known[0], pairs)]
                stops = np.frombuffer(ends, "<u4").astype(np.int64)
                for column, each in zip(out[1:], (times * (value & 1), times * (value >> 1))):
                    upto = np.concatenate([[0], np.cumsum(each)])[stops]
                    column.append(np.diff(upto, prepend=0))
                out[0].append(np.frombuffer(rows, "<i8"))
            if out[0]:
                ids, best, total = map(np.concatenate, out)
                some = total > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, best, total)], schema=sums)

    table = map_batches(counts.select("pair", "n", "best"), pack_counts, _TRAVEL)
    table = table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(*travel.names)
    documents = map_batches(with_links.select("_row", "_pairs"), pack_documents, _TRAVEL)
    dealt = table.unionByName(documents).repartition(parts * slices, "part", "slice").sortWithinPartitions("part", "slice", "kind")
    found = map_batches(dealt, look_up, "_row long, n_best long, count_sum long")
    return found.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE_BYTES, parts: int = PARTS,
          slice_docs: int = SLICE_DOCS, with_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every
    row of ``docs`` (``doc_id, text``); ``with_groups`` adds the groups as text.

    A is a byte-level model of the tokenizers library, B a sentencepiece model that adds a
    space in front; both see the bytes of a space and the text.  Byte offsets where tokens
    of both end cut them into groups; tokens whose bytes overlap are linked.  A pair's
    count is the number of rows of ``docs`` that link it; ``n_best`` counts a document's
    links whose count is the highest of their A id, ties included.

    Null and empty texts, and those whose bytes either model changes, have no tokens:
    zeros, and '' for groups.  Texts above ``range_bytes`` are worked in ranges.  Repeated
    rows are documents of their own, a null ``doc_id`` too; an empty table gives no rows;
    other columns are ignored.
    """
    encoded = encode(docs, a_path, b_path, range_bytes, with_groups)
    sums = link_sums(encoded, pair_counts(encoded), parts, slice_docs)
    zero = F.lit(0).cast("long")
    groups = ["groups"] if with_groups else []
    return encoded.drop("_pairs").join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *groups)
