"""Token ids in files coded with a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by every file.  A file is a
row of blocks; a block holds whole documents and is coded by itself in interleaved
lanes, so that any block can be decoded alone: its header has the lanes' states (the
checkpoint to start from), the lengths of its documents and a checksum.

File: ``MAGIC``, then blocks.  Block: eight little-endian unsigned 64-bit values
(documents, ids, lanes, words, bytes of the directory, bytes of the table, CRC-32 of the
ids as unsigned 32-bit values, CRC-32 of what follows), the directory (ids and lengths
of documents, zlib), the table (zlib), lane states (unsigned 64-bit), words (unsigned 32-bit).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sidematch.session import materialize
from .common import create_file, map_batches, open_file, shared_folder

MAGIC = b"SMRANS01"
BITS = 20
LOW = 1 << 31
LANES = 1024
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 23
NO_DOC = -(1 << 63)
_MASK = np.uint64((1 << BITS) - 1)
_U = np.uint64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of ``1 << BITS``; every id that occurs keeps one or more."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    scaled = np.maximum((counts.astype(np.float64) * ((1 << BITS) / total)).astype(np.int64), counts > 0)
    order = np.argsort(-scaled, kind="stable")
    over = int(scaled.sum()) - (1 << BITS)
    i = 0
    while over:
        place = order[i % len(order)]
        change = min(over, int(scaled[place]) - 1) if over > 0 else over
        change = min(change, max(1, over // 2)) if over > 0 else change
        scaled[place] -= change
        over -= change
        i += 1
    return scaled.astype(np.uint32)


def starts_of(freq: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)[:-1]]).astype(np.uint64)


def encode(ids: np.ndarray, freq: np.ndarray, first: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """States and words; id ``t * lanes + k`` is step ``t`` of lane ``k``."""
    state = np.full(lanes, LOW, np.uint64)
    words = []
    steps = -(-len(ids) // lanes)
    for t in range(steps - 1, -1, -1):
        part = ids[t * lanes:(t + 1) * lanes]
        n = len(part)
        f, x = freq[part].astype(np.uint64), state[:n]
        full = x >= (f << _U(63 - BITS))
        words.append(x[full].astype(np.uint32))
        x[full] >>= _U(32)
        q = x // f
        state[:n] = (q << _U(BITS)) + (x - q * f) + first[part]
    return state, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)


def decode(state: np.ndarray, words: np.ndarray, n: int, freq: np.ndarray, first: np.ndarray,
           slots: np.ndarray) -> np.ndarray:
    lanes, state, at = len(state), state.copy(), 0
    out = np.empty(n, slots.dtype)
    for t in range(-(-n // lanes) if n else 0):
        part = out[t * lanes:(t + 1) * lanes]
        x = state[:len(part)]
        slot = x & _MASK
        part[:] = slots[slot]
        x[:] = freq[part].astype(np.uint64) * (x >> _U(BITS)) + slot - first[part]
        low = np.flatnonzero(x < _U(LOW))
        x[low] = (x[low] << _U(32)) | words[at:at + len(low)]
        at += len(low)
    if at != len(words) or (state != LOW).any():
        raise ValueError("block does not end where its coding began")
    return out


def pack_block(doc_ids: list, arrays: list[np.ndarray], freq: np.ndarray, first: np.ndarray, table: bytes) -> bytes:
    ids = np.concatenate(arrays)
    lanes = max(1, min(LANES, len(ids) // 16))
    state, words = encode(ids, freq, first, lanes)
    directory = zlib.compress(
        np.array([NO_DOC if d is None else d for d in doc_ids], "<i8").tobytes()
        + np.array([len(a) for a in arrays], "<i8").tobytes(), 6)
    rest = directory + table + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    head = np.array([len(arrays), len(ids), lanes, len(words), len(directory), len(table),
                     zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)], "<u8")
    return head.tobytes() + rest


def unpack_block(block: bytes, tables: dict) -> tuple[list, list[np.ndarray]]:
    """Document ids and their token ids; wrong checksums raise an error."""
    docs, n, lanes, n_words, directory_size, table_size, ids_crc, crc = np.frombuffer(block, "<u8", 8).tolist()
    rest = block[64:]
    if zlib.crc32(rest) != crc:
        raise ValueError("block checksum")
    listed = np.frombuffer(zlib.decompress(rest[:directory_size]), "<i8")
    packed = rest[directory_size:directory_size + table_size]
    if packed not in tables:
        freq = np.frombuffer(zlib.decompress(packed), "<u4")
        tables.clear()
        tables[packed] = freq, starts_of(freq), np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    at = directory_size + table_size
    state = np.frombuffer(rest, "<u8", lanes, at)
    words = np.frombuffer(rest, "<u4", n_words, at + 8 * lanes)
    ids = decode(state, words, n, *tables[packed])
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("checksum of ids")
    ids_of = np.split(ids, np.cumsum(listed[docs:])[:-1])
    return [None if d == NO_DOC else d for d in listed[:docs].tolist()], ids_of


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, n, ids``: unsigned 16- or 32-bit ids with the end id, zstd-compressed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from .tokens import encoder

        enc, small = encoder(tokenizer), zstandard.ZstdCompressor(3)
        wide = enc.tokenizer.get_vocab_size() > 1 << 16
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column(1).to_pylist():
                ids = enc.encode(text) + end
                sizes.append(len(ids) // 4)
                packed.append(small.compress(ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "n", "ids"])

    return map_batches(docs, run, "doc_id long, n long, ids binary")


def _unzip(packed: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=4 * n)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` (``doc_id, text``) in ascending order of ``doc_id`` and
    return the committed blocks: ``part, path, block, at, size, first, n``, where
    ``first`` counts the ids before the block in its file.

    Files are dealt out by ranges of ``doc_id``.  A null text is the end id alone; null
    ids come first; repeated rows stand next to each other; no rows, no file.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "rans")
    stored = materialize(tokenized(docs, tokenizer, end_id))

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.bincount(_unzip(packed, n), minlength=len(total))
                more[:len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    # at most one row per id of the vocabulary comes to the driver
    found = map_batches(stored.select("n", "ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    freq = frequencies(counts)
    shared = spark.sparkContext.broadcast((freq, zlib.compress(freq.astype("<u4").tobytes(), 9)))
    files = max(1, int(counts.sum()) // FILE_IDS)
    dealt = stored.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "n", "ids")

    def run(batches):
        import uuid
        from pyspark import TaskContext

        part, path = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.rans"
        freq, table = shared.value
        first = starts_of(freq)
        out, rows, at, seen = None, [], len(MAGIC), 0
        ids, arrays, size = [], [], 0

        def close():
            nonlocal out, at, seen, ids, arrays, size
            if out is None:
                out = create_file(path)
                out.write(MAGIC)
            block = pack_block(ids, arrays, freq, first, table)
            out.write(block)
            rows.append((part, path, len(rows), at, len(block), seen, size))
            at, seen = at + len(block), seen + size
            ids, arrays, size = [], [], 0

        for batch in batches:
            for doc_id, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids.append(doc_id)
                arrays.append(_unzip(packed, n))
                size += n
                if size >= BLOCK_IDS:
                    close()
        if ids:
            close()
        if out:
            out.close()
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                names=["part", "path", "block", "at", "size", "first", "n"])

    return materialize(map_batches(
        dealt, run, "part long, path string, block long, at long, size long, first long, n long"))


def read(spark: SparkSession, blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, blocks decoded on their
    own; ``with_ids`` adds the ids."""
    files = blocks.groupBy("part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    bases = files.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    work = blocks.join(bases, "part").select("path", "at", "size", (F.col("_base") + F.col("first")).alias("start"))
    work = work.repartition(2 * spark.sparkContext.defaultParallelism, "path", "at")

    def run(batches):
        tables = {}
        for batch in batches:
            for path, at, size, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with open_file(path) as file:
                    if file.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} is not a file of this format")
                    file.seek(at)
                    doc_ids, arrays = unpack_block(file.read(size), tables)
                raw = [a.astype("<u4").tobytes() for a in arrays]
                sizes = np.array([len(a) for a in arrays], np.int64)
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes),
                           pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(work, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
