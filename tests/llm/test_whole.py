"""Nothing is left out, however much there is of it."""

import math
import os
import random
import threading
from collections import Counter

import numpy as np
import pytest

from sidematch.llm import decontam, license, lm_score


def plain_scores(texts, good):
    """Losses by counting in one place: ``{doc_id: (n, target, background)}``."""
    words = {i: t.lower().split() for i, t in texts}
    sides = [{i: w for i, w in words.items() if i in good}, words]
    single = [Counter(w for x in side.values() for w in x) for side in sides]
    pairs = [Counter(p for x in side.values() for p in zip([""] + x, x)) for side in sides]
    before = [Counter(b for x in side.values() for b in ([""] + x)[:-1]) for side in sides]
    total = [sum(c.values()) for c in single]
    scale, size = [1.0, total[0] / total[1]], len(single[1])
    out = {}
    for i, x in words.items():
        sums = [0.0, 0.0]
        for b, w in zip([""] + x, x):
            for s in (0, 1):
                share = (single[s][w] * scale[s] + lm_score.PRIOR) / (total[0] + lm_score.PRIOR * size)
                sums[s] -= math.log2((pairs[s][b, w] * scale[s] + lm_score.SMOOTHING * share) / (before[s][b] * scale[s] + lm_score.SMOOTHING))
        out[i] = (len(x), sums[0] / len(x), sums[1] / len(x))
    return out


def test_every_pair_is_scored_from_its_own_count(spark, monkeypatch):
    # common text, and 40,000 words more than once in documents of their own
    texts = [(i, "the cat sat on the mat " * 20 + f"house{i} stands") for i in range(40)]
    texts += [(100 + i, " ".join(f"w{i}x{k} v{k % 50}" for k in range(2000)) + f" w{i}x7 v7") for i in range(20)]
    good = {0, 1, 100, 101, 102}
    want = plain_scores(texts, good)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in good] + [(3, 0)], "doc_id long, quality int")
    for near_pairs, near_words in ((1 << 19, 1 << 14), (200, 100), (0, 0)):
        monkeypatch.setattr(lm_score, "NEAR_PAIRS", near_pairs)
        monkeypatch.setattr(lm_score, "NEAR_WORDS", near_words)
        got = {r.doc_id: r for r in lm_score.score(docs, labels).collect()}
        assert set(got) == set(want)
        for i, (n, target, background) in want.items():
            assert got[i].n_tokens == n
            assert abs(got[i].loss_target - target) < 1e-9 and abs(got[i].loss_background - background) < 1e-9
            assert abs(got[i].score - (target - background)) < 1e-9


ITEM = "which of these old rivers flows north past seven quiet towns before it meets the cold sea near the tall lighthouse"


def test_edited_and_short_items_are_found(spark):
    words = ITEM.split()
    texts = [("insert", " ".join([*words[:k], "really", *words[k:]])) for k in range(len(words) + 1)]
    texts += [("replace", " ".join([*words[:k], "really", *words[k + 1:]])) for k in range(len(words))]
    texts += [("short", "we ask now what is a prime and go on"), ("not short", "what is the prime"), ("none", "the old rivers flow on")]
    docs = spark.createDataFrame([(i, "some other words go first then " + t + " and some more follow") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "What is a prime?"), (3, "42")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()}
    want = {(i, {"insert": 1, "replace": 1, "short": 2}[kind]) for i, (kind, _) in enumerate(texts) if kind in ("insert", "replace", "short")}
    assert got == want


def test_values_are_compared_at_every_place(spark):
    # a garbled copy first, where one value stands for two, then a whole one
    item = "ann has 12 red apples and 15 green pears so tell how many fruits she has in all today"
    texts = [item.replace("15", "12") + " then some filler words that go on and on for a while " + item.replace("12", "7")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.slots_changed) for r in got] == [(0, 1, True)] and got[0].position > 0


def test_usual_licence_wordings_are_found(spark):
    code = "\nint main() { return total; }\nvoid other(int value);\nlong third(char *name);\n" * 4
    texts = {
        "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "MIT": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal",
        "GPL-3.0": "either version 3 of the GNU General Public License as published by the Free Software Foundation",
        "Apache-2.0": "// SPDX-License-Identifier: Apache-2.0",
    }
    rows = [(i, f"d/{i}.txt", text + code) for i, text in enumerate(texts.values())] + [(9, "e/9.txt", code)]
    got = {r.file_id: r.license for r in license.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {**dict(enumerate(texts)), 9: None}


def disk_bytes(spark, stop, peak):
    """The most bytes of intermediate tables and shuffles that lay on disk at once until ``stop``."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [spark.conf.get("spark.checkpoint.dir"), *(f.getPath() for f in local)]

    def size(path):
        try:
            return os.path.getsize(path)
        except OSError:  # a file may go meanwhile
            return 0

    while not stop.is_set():
        peak.append(sum(size(os.path.join(d, f)) for top in folders for d, _, names in os.walk(top) for f in names))
        stop.wait(0.05)


def test_pairs_take_a_few_bytes_of_disk(spark, monkeypatch):
    # 400 texts of 500 words each, nearly all pairs different and beyond what is near
    monkeypatch.setattr(lm_score, "NEAR_PAIRS", 1000)
    draw = random.Random(1)
    texts = [(i, " ".join(f"w{draw.randrange(3000)}" for _ in range(500))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 7)], "doc_id long, quality int")
    stop, peak = threading.Event(), []
    watch = threading.Thread(target=disk_bytes, args=(spark, stop, peak))
    watch.start()
    try:
        lm_score.score(docs, labels).write.format("noop").mode("overwrite").save()
    finally:
        stop.set()
        watch.join()
    assert max(peak) - peak[0] < 25 * 400 * 500


@pytest.mark.parametrize("documents", [1 << 24, 0])
def test_texts_do_not_move_for_target_ids(spark, monkeypatch, documents):
    # 60 texts of 10,000 words each, made of 30 long words, and more target ids than are sent to tasks
    monkeypatch.setattr(lm_score, "BROADCAST_IDS", 3)
    monkeypatch.setattr(lm_score, "BROADCAST_PLACES", documents, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    draw = random.Random(2)
    some = ["".join(draw.choices("abcdefghijklmnop", k=20)) for _ in range(30)]
    texts = [(i, " ".join(draw.choices(some, k=10_000))) for i in range(60)]
    good = set(range(0, 60, 7))
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    want = plain_scores(texts, good)
    stop, peak = threading.Event(), []
    watch = threading.Thread(target=disk_bytes, args=(spark, stop, peak))
    watch.start()
    try:
        got = {r.doc_id: r for r in lm_score.score(docs, labels).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        stop.set()
        watch.join()
    assert set(got) == set(want)
    for i, (n, target, background) in want.items():
        assert got[i].n_tokens == n
        assert abs(got[i].loss_target - target) < 1e-9 and abs(got[i].loss_background - background) < 1e-9
    assert max(peak) - peak[0] < 3 * 60 * 10_000


def test_numbers_are_unpacked_as_packed():
    for x in ([], [0], [0, 1, 255], [1 << 63, 3, (1 << 64) - 1], [7] * 1000):
        x = np.array(x, np.uint64)
        for squeeze in (True, False):
            assert (lm_score.unpack(lm_score.pack(x, squeeze), len(x), squeeze) == x).all()
