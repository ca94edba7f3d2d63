"""Token files and packing against the tokenizers library, row by row."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sidematch.llm import packing, rans, tokens

WORD, BYTE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", " ", "\n", "a", "a  b", " a b ", "a\n\nb", "a \nb", "a\tb", "don't stop, It's", "Étude n°7 ÀÉ ß.", "x y  z",
    "<|endoftext|> a<|endoftext|>b", "12 345, 6.7!", "é café", "日本語 テスト", "a\x00b \x1c c", "İstanbul µ ª.",
    "hello,world. end .", "a\r\nb", "..., ;", "word" * 3000, "🙂 ok", "tab\t tab", "﻿x",
]


def texts(sf="/root/testdata/sf0.001"):
    import pyarrow.parquet as pq

    return ODD + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    plain, enc = Tokenizer.from_file(path), tokens.encoder(path)
    for text in texts():
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]
    assert enc.encode(None) == b""


def _docs(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts())] + [(5, None, None), (5, None, None), (None, "lost id", "y")]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_token_files_round_trip(spark):
    rows, docs = _docs(spark)
    got = rans.read(spark, rans.write(docs, WORD), with_ids=True).collect()
    plain = Tokenizer.from_file(WORD)
    want = [(d, plain.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows]
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(
        (-1 if d is None else d, ids) for d, ids in want)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.n_tokens for r in got)
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, last if r.doc_id is None else r.doc_id


def test_token_files_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rans, "FILE_IDS", 20_000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    blocks = rans.write(docs, WORD)
    assert blocks.select("path").distinct().count() > 3
    got = rans.read(spark, blocks).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_files_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rans.read(spark, rans.write(docs, WORD)).collect() == []


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (7, 3), (5000, 1), (70_000, 40_000), (300_000, 300)])
def test_blocks(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    freq = rans.frequencies(np.bincount(ids, minlength=kinds + 3))
    assert n == 0 or freq.sum() == 1 << rans.BITS
    first = rans.starts_of(freq)
    lanes = max(1, min(rans.LANES, n // 16))
    state, words = rans.encode(ids, freq, first, lanes)
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    assert (rans.decode(state, words, n, freq, first, slots) == ids).all()


def test_damaged_block():
    freq = rans.frequencies(np.array([5, 3]))
    block = rans.pack_block([1, None], [np.array([0, 1, 1]), np.array([0])], freq, rans.starts_of(freq), zlib.compress(freq.astype("<u4").tobytes()))
    docs, arrays = rans.unpack_block(block, {})
    assert docs == [1, None] and [a.tolist() for a in arrays] == [[0, 1, 1], [0]]
    with pytest.raises(ValueError):
        rans.unpack_block(block[:-1] + bytes([block[-1] ^ 1]), {})


def _best_fit(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(size - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 400))]
    if seed % 3 == 0:
        lengths = [rng.choice([3, 7, size]) for _ in lengths]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    left, spans, ranks = {}, defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in packing.plan(histogram, size):
        ranks[length].append((rank, count))
        for s in range(first, first + count):
            left[s] = left.get(s, size) - length
            spans[s].append((offset, length))
    assert sorted(left.values()) == _best_fit(lengths, size)
    for length, parts in ranks.items():
        at = 0
        for rank, count in sorted(parts):
            assert rank == at
            at += count
        assert at == histogram[length]
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


def test_packing(spark):
    rows, docs = _docs(spark)
    got = packing.pack_documents(docs, BYTE, size=256).collect()
    plain = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text, _ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        while at < len(ids):
            stop = at + ((len(ids) - at) % 256 or 256)
            want.append((str(doc_id), at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())))
            at = stop
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) == len(_best_fit([w[2] for w in want], 256))


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTE).collect() == []
