"""Language models against plain Kneser-Ney, in one part and in many."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sidematch.llm import langid


def folded(text: str) -> str:
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    words = letters.split()
    if not words:
        return ""
    # a text begins with one space; a space at its end stays
    return " " + " ".join(words) + (" " if letters.endswith(" ") else "")


class Plain:
    """Interpolated Kneser-Ney of one language, from its definition."""

    def __init__(self, texts, alphabet):
        self.counts = {4: Counter()}
        for t in texts:
            padded = "   " + folded(t)
            self.counts[4].update(padded[i:i + 4] for i in range(len(padded) - 3))
        for k in (3, 2, 1):
            self.counts[k] = Counter(w[1:] for w in self.counts[k + 1])
        self.discount, self.total, self.kinds = {}, defaultdict(int), Counter()
        for k, of in self.counts.items():
            once, twice = (sum(n == x for n in of.values()) for x in (1, 2))
            self.discount[k] = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
            for w, n in of.items():
                self.total[w[:-1]] += n
                self.kinds[w[:-1]] += 1
        self.floor = 1 / (alphabet + 1)

    def p(self, window):
        if not window:
            return self.floor
        lower, context, d = self.p(window[1:]), window[:-1], self.discount[len(window)]
        if not self.total[context]:
            return lower
        return (max(self.counts[len(window)][window] - d, 0) + d * self.kinds[context] * lower) / self.total[context]

    def bits(self, text):
        padded = "   " + folded(text)
        n = len(padded) - 3
        return -sum(math.log2(self.p(padded[i:i + 4])) for i in range(n)) / n


def texts_of(seed: int, n: int, letters: str) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(30)]
    return [" ".join(rng.choices(words, k=rng.randint(1, 25))) + rng.choice(["", ".", "\n", " 7"]) for _ in range(n)]


TRAIN = {
    "aa": texts_of(1, 20, "abcdeé"), "bb": texts_of(2, 35, "abxyzß"), "cc": texts_of(3, 5, "ĳКлж漢字"),
}
ASKED = [t for s in (1, 2, 3, 4) for t in texts_of(s + 10, 4, "abcdexyzéКл漢Q")] + ["ab cde", "𝒳x", "zzz", "a" * 3000]


@pytest.mark.parametrize("part_windows", [1 << 21, 60])
def test_equals_plain_kneser_ney(spark, part_windows):
    rows = [(lang, t) for lang, texts in TRAIN.items() for t in texts] + [("dd", "123 !"), (None, "qqq"), ("aa", None)]
    models = langid.train(spark.createDataFrame(rows, "lang string, text string"), part_windows)
    assert models.langs == sorted(TRAIN)
    assert (len(models.parts) > 3) == (part_windows == 60)
    alphabet = len({c for texts in TRAIN.values() for t in texts for c in folded(t)})
    plain = [Plain(TRAIN[lang], alphabet) for lang in models.langs]
    bits, n = models.entropies(ASKED)
    assert n.tolist() == [len(folded(t)) for t in ASKED]
    assert np.allclose(bits, [[m.bits(t) for m in plain] for t in ASKED], rtol=1e-4)


def test_probabilities_add_up_to_one(spark):
    rows = [(lang, t) for lang, texts in TRAIN.items() for t in texts]
    models = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    model = langid._part(models.short, models.parts[0])
    alphabet = sorted({ord(c) for texts in TRAIN.values() for t in texts for c in folded(t)}) + [ord("Ω")]
    for context in (" ab", "xya", "ΩΩΩ", "   "):
        columns = [np.full(len(alphabet), ord(c), np.uint32) for c in context] + [np.array(alphabet, np.uint32)]
        total = np.exp2(model.log_probs(columns, len(alphabet)).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=1e-4)


def test_chunks_over_parts_score_every_row_alike(spark, monkeypatch):
    rows = [(i, "aa", t) for i, t in enumerate(ASKED * 3 + ["", None, "123"])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    train = spark.createDataFrame([(lang, t) for lang, texts in TRAIN.items() for t in texts], "lang string, text string")
    one = langid.predict(docs, langid.train(train)).drop("text").orderBy("doc_id").collect()
    monkeypatch.setattr(langid, "CHUNK_CHARS", 50)
    many = langid.predict(docs, langid.train(train, 60)).drop("text").orderBy("doc_id").collect()
    assert len(one) == len(many) == len(rows)
    for a, b in zip(one, many):
        assert (a.doc_id, a.lang, a.lang_pred, a._chars) == (b.doc_id, b.lang, b.lang_pred, b._chars)
        assert a.score == pytest.approx(b.score, abs=1e-6) and a._bits == pytest.approx(b._bits, abs=1e-5)


def test_seventy_languages_are_all_learned(spark):
    base = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 6)]
    rows = [(100 * i + j, f"l{i:02}", t) for i in range(70) for j, t in enumerate(texts_of(i, 12, "".join(base[6 * i:6 * i + 6])))]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()
    assert len(found) == len(rows)
    lang = {i: x for i, x, _ in rows}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in found)
    assert any(r["held_out"] for r in found) and not any(r["rejected"] for r in found if not r["held_out"])


def test_ties_go_to_the_first_language_and_clashing_columns_stay(spark):
    texts = TRAIN["aa"]
    rows = [(i, lang, t, 5) for i, (lang, t) in enumerate([(x, t) for t in texts for x in ("p", "o")])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, _bits int")
    # both languages get each text, but folds differ by doc_id: train on the same texts directly
    models = langid.train(docs.select("lang", "text"))
    assert {r["lang_pred"] for r in langid.predict(docs.drop("_bits"), models).collect()} == {"o"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["_bits"] for r in kept.collect()} <= {5}
