"""Token alignment against whole-text encoding and counting, and the fragment monoid."""

import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from sidematch.llm import token_align
from sidematch.llm.token_align import Fragment, fragment
from sidematch.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "\n", "a", "Hello world, it's 12,345 houses!", "  two  spaces \n\n and lines\n next\nline\r\n tab\tend  ",
    "größer façade 漢字かな 😀 é é  x y\x1cz", "under▁score", "<|endoftext|> and </s> <s> <0x0A>", "x\x00y \x07",
    "unbreakable" * 3000, "the cat sat on the mat. " * 900, "the cat sat on the mat. " * 900, "漢字" * 9000, "''s 's\n's don't\nI'll",
]


def plain(texts):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]: c for c in range(128)}
    letters |= {letter: byte for byte, letter in byte_letters().items()}
    spelled = {i: t for t, i in a.get_vocab().items()}
    links, heads = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_parts = [bytes(letters[c] for c in spelled[i]) for i in a_ids]
        b_parts = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            links.append([])
            heads.append((0, 0, 0, ""))
            continue
        a_ends, b_ends = list(accumulate(map(len, a_parts))), list(accumulate(map(len, b_parts)))
        links.append([(x, y) for x, s, e in zip(a_ids, [0, *a_ends], a_ends) for y, u, v in zip(b_ids, [0, *b_ends], b_ends)
                      if max(s, u) < min(e, v)] if len(a_ids) < 3000 else walk(a_ids, a_ends, b_ids, b_ends))
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            k, m = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(f"{','.join(map(str, a_ids[i:k]))}|{','.join(map(str, b_ids[j:m]))}")
            i, j = k, m
        heads.append((len(a_ids), len(b_ids), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for x in links for p in set(x))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return Counter((*head[:3], len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), head[3])
                   for head, x in zip(heads, links))


def walk(a_ids, a_ends, b_ids, b_ends):
    out, i, j = [], 0, 0
    while i < len(a_ids) and j < len(b_ids):
        out.append((a_ids[i], b_ids[j]))
        x, y = a_ends[i], b_ends[j]
        i, j = i + (x <= y), j + (y <= x)
    return out


@pytest.mark.parametrize("options", [{}, {"range_bytes": 40, "parts": 3, "slice_docs": 4}])
def test_equals_plain(spark, options):
    texts = [t[:4000] if t and options else t for t in TEXTS]
    rows = [(i if i % 5 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long, _row string")
    got = token_align.align(docs, A, B, **options).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == plain(texts)


def test_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "ab cd")], "doc_id long, text string")
    row = token_align.align(docs, A, B, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count("|") == row.n_groups
    assert token_align.align(docs.where("false"), A, B).count() == 0


@st.composite
def token_ends(draw):
    size = draw(st.integers(1, 30))
    cut = lambda: sorted({*draw(st.sets(st.integers(1, size))), size})
    return size, cut(), cut()


def cut_fragment(a_ends, b_ends, low, high):
    def inside(ends):
        return [(i, e) for i, e in enumerate(ends) if low < e <= high], max([0, *(e for e in ends if e <= low)])
    (a, a_start), (b, b_start) = inside(a_ends), inside(b_ends)
    return fragment([i for i, _ in a], [e for _, e in a], [i for i, _ in b], [e for _, e in b], a_start, b_start)


@settings(max_examples=300, deadline=None)
@given(token_ends(), st.data())
def test_fragments_are_a_monoid(ends, data):
    size, a_ends, b_ends = ends
    cuts = [0, *sorted(data.draw(st.sets(st.integers(1, size), max_size=6))), size]
    parts = [cut_fragment(a_ends, b_ends, low, high) for low, high in zip(cuts, cuts[1:])]
    left = sum(parts, Fragment()).compact()
    right = Fragment()
    for x in reversed(parts):
        right = x + right
    whole = cut_fragment(a_ends, b_ends, 0, size)
    assert left == right.compact() == whole
    assert left.whole().groups == whole.whole().groups


def test_ranges_cover_every_byte():
    for text in [t for t in TEXTS if t]:
        for size in (1, 7, 100, 1 << 20):
            parts = list(token_align.ranges(text, size))
            assert [p[0] for p in parts] == list(range(len(parts)))
            owned = b"".join(w.encode()[low:high] for _, w, low, high in parts)
            assert owned == (" " + text).encode()
            assert sum(len(w) for _, w, _, _ in parts) <= 2 * len(text) + 2
