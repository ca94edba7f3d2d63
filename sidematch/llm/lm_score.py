"""Cross-entropy difference of documents between two word models.

A target model is counted on the target documents, a background model on all of them.
Both have the same vocabulary, order and smoothing, and the background's counts are
scaled to the size of the target, so that the losses of a token differ only by what the
two corpora say about it.  A document's score is the mean difference of its tokens'
losses: the lower, the more it is like the target.

The models hold every word and every pair of neighbouring words.  Documents are taken in
stretches, which are stored as numbers.  A stretch sends each of its different pairs and
words once, packed by parts of all names; a part adds up what it gets and answers every
stretch with the counts of the whole corpus, in the order in which the names came.  So a
pair that is everywhere costs one entry per stretch, and no pair moves with a document.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidematch.session import materialize
from .common import map_batches

# A stretch is closed when it has more pairs than this, or more different words or documents.
NEAR_PAIRS = 1 << 21
NEAR_WORDS = 1 << 20
# Words of all stretches for each part of the names.
PART_WORDS = 1 << 22
# Target ids are sent to every task up to this number (8 bytes each), beyond it they are joined.
BROADCAST_IDS = 1 << 20
# So are the places of target documents in stretches, up to this number of documents (4 bytes each).
BROADCAST_PLACES = 1 << 24
SMOOTHING = 4.0
PRIOR = 0.5
# Characters of texts that are split into words at once.
SPLIT_CHARS = 1 << 22

# What is sent and answered: pairs, with n and target, and words, with those and the same as the word before.
PAIRS, WORDS = 0, 1
COUNTS = {PAIRS: 2, WORDS: 4}
STRETCHES = "stretch long, doc_ids array<long>, sizes binary, n_names long, names binary, n_words long, places binary"
SENT = "key long, kind int, part long, stretch long, n long, names binary, counts binary"
ANSWERS = "kind int, part long, stretch long, n long, counts binary, size long, total long, aimed long"
LOSSES = "doc_id long, n_tokens long, target double, background double"
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Places(dict):
    """Numbers of different words, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


# no word has white space
START = b" "


def name_of(word: bytes) -> int:
    """The 64-bit name of a word."""
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def pack(x: np.ndarray, squeeze: bool = True) -> bytes:
    """Numbers byte by byte: all lowest ones first; bytes that none has are left out."""
    width = -(-int(x.max()).bit_length() // 8) or 1 if x.size else 0
    planes = np.ascontiguousarray(x, _U).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return zlib.compress(planes, 1) if squeeze else planes


def unpack(data: bytes, n: int, squeezed: bool = True) -> np.ndarray:
    data = zlib.decompress(data) if squeezed else data
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view(_U).ravel()


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _rows(batches):
    """Rows of batches, one at a time: some are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def stretches(docs: DataFrame) -> DataFrame:
    """Texts (``doc_id, text``) as numbers of words, many documents in a row.  The
    first name is that of the mark behind which the first word of a text stands."""
    def run(batches):
        stretch = TaskContext.get().partitionId() << 24
        places, ids, sizes, held, size = Places({START: 0}), [], [], [], 0

        def row():
            names = np.fromiter(map(name_of, places), _U, len(places))
            return _record([(
                stretch, ids, pack(np.array(sizes, _U)), len(names), names.tobytes(), size, pack(np.concatenate(held)))], STRETCHES)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            chars = np.cumsum([len(t or "") for t in texts]) // SPLIT_CHARS
            edges = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1], True])
            for i, j in zip(edges[:-1], edges[1:]):
                words = [words_of(t) for t in texts[i:j]]
                sizes += map(len, words)
                n = sum(sizes[len(sizes) - len(words):])
                held.append(np.fromiter(map(places.__getitem__, chain.from_iterable(words)), np.uint32, n))
                size += n
                ids += batch.column(0)[i:j].cast(pa.int64()).to_pylist()
                if size > NEAR_PAIRS or max(len(places), len(ids)) > NEAR_WORDS:
                    yield row()
                    stretch += 1
                    places, ids, sizes, held, size = Places({START: 0}), [], [], [], 0
        if ids:
            yield row()

    return materialize(map_batches(docs.select("doc_id", "text"), run, STRETCHES))


class Stretch:
    """Pairs of a stored stretch.  ``order`` sorts its words by the names of their pairs,
    ``first`` are the places there where another pair begins; ``names`` are those of its
    words, sorted, ``word`` and ``before`` the numbers of each word and of the one before.
    A pair's name is the name before, crossed with the word's, which is turned by one bit."""

    def __init__(self, row: dict):
        self.sizes = unpack(row["sizes"], len(row["doc_ids"])).astype(np.int64)
        self.names, of = np.unique(np.frombuffer(row["names"], _U), return_inverse=True)
        of = of.astype(np.int32)
        self.word = of[unpack(row["places"], row["n_words"])]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = of[0]
        turned = (self.names << _U(1)) | (self.names >> _U(63))
        pair = self.names[self.before] ^ turned[self.word]
        self.order = np.argsort(pair)
        pair = pair[self.order]
        self.first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
        self.pairs = pair[self.first]
        self.times = np.diff(np.r_[self.first, len(pair)])


def targets(stored: DataFrame, good: DataFrame) -> DataFrame:
    """``stretch, target``: the places of documents of ``good`` (``doc_id``) in each stretch
    that has any.  Only ids move for it, no texts."""
    places = stored.select("stretch", F.posexplode("doc_ids").alias("place", "doc_id"))
    return places.join(good, "doc_id", "left_semi").groupBy("stretch").agg(F.collect_list("place").alias("target"))


def counted(stored: DataFrame, parts: int) -> DataFrame:
    """For every stretch and part the counts of the stretch's pairs and words in all
    stretches, in the order of their names; and once for every part how many words there
    are, how often, and how often in target documents."""
    def send(batches):
        for row in _rows(batches):
            own = Stretch(row)
            aim = np.zeros(len(own.sizes), bool)
            aim[row["target"] or []] = True
            aim = np.repeat(aim, own.sizes)
            n_aimed = np.add.reduceat(aim[own.order].astype(np.int64), own.first) if len(own.first) else own.first
            words = [np.bincount(x, minlength=len(own.names)) for x in (own.word, own.word[aim], own.before, own.before[aim])]
            out = []
            for kind, names, counts in ((PAIRS, own.pairs, [own.times, n_aimed]), (WORDS, own.names, words)):
                part = ((names >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
                edges = np.searchsorted(part, np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    i, j = edges[k], edges[k + 1]
                    out.append((
                        k * 2 + kind, kind, k, row["stretch"], int(j - i), pack(np.diff(names[i:j], prepend=_U(0)), False),
                        pack(np.concatenate([c[i:j] for c in counts]))))
            yield _record(out, SENT)

    def add_up(batches):
        key, held = None, []

        def answers():
            kind, part = held[0]["kind"], held[0]["part"]
            names = np.concatenate([np.cumsum(unpack(r["names"], r["n"], False), dtype=_U) for r in held])
            counts = np.concatenate([unpack(r["counts"], r["n"] * COUNTS[kind]).reshape(-1, r["n"]) for r in held], axis=1)
            different, at = np.unique(names, return_inverse=True)
            sums = np.array([np.bincount(at, c, len(different)) for c in counts], np.int64)
            ends = np.cumsum([r["n"] for r in held])
            out = [(kind, part, r["stretch"], r["n"], pack(sums[:, at[j - r["n"]:j]].ravel()), 0, 0, 0) for r, j in zip(held, ends)]
            if kind == WORDS:
                out.append((None, part, None, 0, None, int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())))
            return _record(out, ANSWERS)

        for row in _rows(batches):
            if held and row["key"] != key:
                yield answers()
                held = []
            key = row["key"]
            held.append(row)
        if held:
            yield answers()

    tasks = max(parts, stored.sparkSession.sparkContext.defaultParallelism)
    dealt = map_batches(stored, send, SENT).repartition(tasks, "key").sortWithinPartitions("key")
    return materialize(map_batches(dealt, add_up, ANSWERS))


def losses(stored: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """``doc_id, n_tokens, target, background`` of every document: summed losses."""
    size, total, aimed = (x or 0 for x in answers.agg(F.sum("size"), F.sum("total"), F.sum("aimed")).first())
    scale = aimed / (total or 1)

    def loss(seen, word, after, scale):
        share = (word * scale + PRIOR) / (aimed + PRIOR * size)
        return -np.log2((seen * scale + SMOOTHING * share) / (after * scale + SMOOTHING))

    def run(batches):
        now, got = None, None

        def rows():
            own = Stretch(now)
            owner = np.repeat(np.arange(len(own.sizes)), own.sizes)[own.order]
            sums = [np.zeros(len(own.sizes))] * 2
            if len(own.first):
                n, aim = np.concatenate(got[PAIRS], axis=1)
                word_n, word_aim, after_n, after_aim = np.concatenate(got[WORDS], axis=1)
                word, before = own.word[own.order[own.first]], own.before[own.order[own.first]]
                both = loss(aim, word_aim[word], after_aim[before], 1.0), loss(n, word_n[word], after_n[before], scale)
                sums = [np.bincount(owner, np.repeat(x, own.times), len(own.sizes)) for x in both]
            return pa.RecordBatch.from_arrays(
                [pa.array(now["doc_ids"], pa.int64()), pa.array(own.sizes), pa.array(sums[0]), pa.array(sums[1])],
                names=["doc_id", "n_tokens", "target", "background"])

        for row in _rows(batches):
            if row["kind"] is None:
                if now:
                    yield rows()
                now, got = row, {PAIRS: [], WORDS: []}
            else:
                kind, n = row["kind"], row["n"]
                got[kind].append(unpack(row["counts"], n * COUNTS[kind]).reshape(-1, n).astype(np.float64))
        if now:
            yield rows()

    # a stretch, then its answers
    dealt = stored.unionByName(answers.where("stretch IS NOT NULL").drop("size", "total", "aimed"), allowMissingColumns=True).repartition(
        tasks, "stretch").sortWithinPartitions("stretch", F.asc_nulls_first("kind"), "part")
    return map_batches(dealt, run, LOSSES)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` for every row of ``docs``
    (``doc_id, text``); losses are bits per token.

    Target documents are those with a row ``quality = 1`` in ``labels``.  A text that is
    null or has no word has no losses (null); repeated rows count again; without target
    documents both models fall back to equal odds; an empty table gives none.  Words and
    pairs are named by 64 bits.
    """
    good = materialize(labels.where("quality = 1").select("doc_id").distinct())
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    stored = stretches(docs)
    words, rows, documents = (x or 0 for x in stored.agg(F.sum("n_words"), F.count("*"), F.sum(F.size("doc_ids"))).first())
    aims = targets(stored, good)
    aims = F.broadcast(aims) if documents <= BROADCAST_PLACES else aims
    cores = docs.sparkSession.sparkContext.defaultParallelism
    answers = counted(stored.join(aims, "stretch", "left"), max(8 * cores, words // PART_WORDS))
    out = losses(stored, answers, max(cores, rows))
    mean = {side: F.when(F.col("n_tokens") > 0, F.col(side) / F.col("n_tokens")) for side in ("target", "background")}
    return out.select(
        "doc_id", "n_tokens", mean["target"].alias("loss_target"), mean["background"].alias("loss_background"),
        (mean["target"] - mean["background"]).alias("score"))
