"""Language identification with character models, one per language.

Interpolated Kneser-Ney over ``ORDER`` characters: the longest windows are counted over
all training texts, everything shorter is the number of different windows that continue
it.  Every window of every language is kept.  A text is folded to lower-case letters and
single spaces, and the language with the lowest cross-entropy per character wins.  Texts
that fit no language as well as training texts fit their own are rejected.

The models are arrays sorted by hash in files of the shared folder, all languages in one.
Windows of three and four characters are dealt into parts by the two characters before
the last, so that a part holds all that their probabilities need; windows of one and two
characters are in a file of their own, which every task reads.  A task holds one part at
a time and scores a chunk of texts against one part after the other.
"""

from __future__ import annotations

import functools
import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sidematch.session import materialize
from .common import create_file, map_batches, mix, open_file, python_ready, shared_folder

ORDER = 4
# Windows (per language) that a part of the model is made for: what a task reads at a time.
PART_WINDOWS = 1 << 21
# Characters scored against one part after the other, if there are several parts.
CHUNK_CHARS = 1 << 23
COUNT_CHARS = 1 << 22
SCORE_CHARS = 1 << 19
# A text is rejected if its cross-entropy is above its language's mean by half the way to
# the next language's level, and by this many deviations; the deviation of a mean over n
# characters falls with sqrt(n), down to the spread between long texts.
REJECT_DEVIATIONS = 8.0
UNKNOWN = "und"
_U = np.uint64


@functools.lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All folded characters, and for each the number of its text.  A text begins
    with a space, and has no two of them in a row; without a letter it has none."""
    texts = [t or "" for t in texts]
    raw = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    chars = _folding()[np.minimum(raw, 0x10FFFF)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    new = np.empty(len(chars), bool)
    new[:1] = True
    new[1:] = owner[1:] != owner[:-1]
    keep = (chars != 32) | new
    keep[1:] |= chars[:-1] != 32
    chars, owner = chars[keep], owner[keep]
    letters = np.bincount(owner[chars != 32], minlength=len(texts)) > 0
    if not letters.all():
        kept = letters[owner]
        chars, owner = chars[kept], owner[kept]
    return chars, owner


def shifted(chars: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """The character ``k`` places before, a space outside the text."""
    out = np.full(len(chars), 32, np.uint32)
    if k < len(chars):
        out[k:] = np.where(owner[k:] == owner[:-k], chars[:-k], 32) if k else chars
    return out


def keys(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of windows given as columns of characters, first to last."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = h * _U(0x9E3779B97F4A7C15) + c.astype(np.uint64)
    return mix(h)


def count_windows(docs: DataFrame) -> DataFrame:
    """``lang, hi, lo, n``: windows of four characters in all texts, two per long."""
    docs = docs.select("lang", "text")

    def run(batches):
        counts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts) if x == lang]
                at = 0
                while at < len(own):
                    stop, chars = at, 0
                    while stop < len(own) and chars < COUNT_CHARS // 4:
                        chars += len(own[stop] or "")
                        stop += 1
                    c, owner = fold(own[at:stop])
                    at = stop
                    if not len(c):
                        continue
                    c0, c1, c2, c3 = (shifted(c, owner, k) for k in range(4))
                    hashed = keys([c3, c2, c1, c0])
                    order = np.argsort(hashed)
                    sorted_ = hashed[order]
                    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                    at_ = order[first]
                    rows = (sorted_[first], c3[at_].astype(np.int64) << 21 | c2[at_], c1[at_].astype(np.int64) << 21 | c0[at_],
                            np.diff(np.r_[first, len(sorted_)]).astype(np.int64))
                    counts[lang] = _merge(counts.get(lang), rows)
                    if len(counts[lang][0]) > COUNT_CHARS:
                        yield _rows(lang, counts.pop(lang))
        for lang, rows in counts.items():
            yield _rows(lang, rows)

    return map_batches(docs, run, "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def _merge(old, new):
    if old is None:
        return new
    h = np.concatenate([old[0], new[0]])
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    n = np.add.reduceat(np.concatenate([old[3], new[3]])[order], first)
    pick = order[first]
    return h[first], np.concatenate([old[1], new[1]])[pick], np.concatenate([old[2], new[2]])[pick], n


def _rows(lang, rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(rows[0]), pa.string()), *(pa.array(x) for x in rows[1:])], names=["lang", "hi", "lo", "n"])


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted array, -1 where it is not."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _hashes(columns: list[np.ndarray], rows: int) -> np.ndarray:
    return keys(columns) if columns else np.zeros(rows, np.uint64)


class Table:
    """Values of (hash, language): hashes sorted, the languages of each in a row."""

    def __init__(self, hashes: np.ndarray, start: np.ndarray, lang: np.ndarray, value: np.ndarray):
        self.hashes, self.start, self.lang, self.value = hashes, start, lang, value

    @classmethod
    def of(cls, h: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Table:
        order = np.lexsort((lang, h))
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        return cls(h[first], np.r_[first, len(h)].astype(np.int64), lang[order].astype(np.int32), value[order].astype(np.float32))

    def entries(self, h: np.ndarray):
        """Row of ``h``, language and value of everything found."""
        at = _find(self.hashes, h)
        rows = np.flatnonzero(at >= 0)
        at = at[rows]
        n = self.start[at + 1] - self.start[at]
        before = np.cumsum(n) - n
        place = np.repeat(self.start[at] - before, n) + np.arange(n.sum())
        return np.repeat(rows, n), self.lang[place], self.value[place]

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}_{x}": getattr(self, x) for x in ("hashes", "start", "lang", "value")}

    @classmethod
    def load(cls, arrays, name: str) -> Table:
        return cls(*(arrays[f"{name}_{x}"] for x in ("hashes", "start", "lang", "value")))


class Model:
    """Log2 probabilities of windows of 1 to ``ORDER`` characters, per language.

    An order has the probabilities of the windows seen, and by how much everything
    else after a context falls below the next shorter window's.
    """

    def __init__(self, languages: int, floor: float):
        self.languages, self.floor = languages, floor
        self.seen: dict[int, Table] = {}
        self.fall: dict[int, Table] = {}

    def add(self, columns: list[np.ndarray], lang: np.ndarray, count: np.ndarray, discounts: np.ndarray) -> None:
        """The next order, from the different windows of each language and their counts.
        All windows of a context have to be among them."""
        k, rows = len(columns), len(lang)
        h = _hashes(columns[:-1], rows)
        order = np.lexsort((lang, h))
        new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (lang[order][1:] != lang[order][:-1])]) if rows else np.empty(0, np.int64)
        of = np.empty(rows, np.int64)
        of[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, rows]))
        total, kinds = np.bincount(of, count, len(new)), np.bincount(of, minlength=len(new))
        own = discounts[lang]
        fall = discounts[lang[order][new]] * kinds / total
        lower = np.empty(rows)
        step = max(1, (1 << 22) // max(1, self.languages))
        for at in range(0, rows, step):
            cut = slice(at, at + step)
            below = self.log_probs([c[cut] for c in columns[1:]], len(lang[cut]))
            lower[cut] = np.exp2(below[np.arange(len(below)), lang[cut]].astype(np.float64))
        p = (count - own) / total[of] + fall[of] * lower
        self.fall[k] = Table.of(h[order][new], lang[order][new], np.log2(fall))
        self.seen[k] = Table.of(_hashes(columns, rows), lang, np.log2(p))

    def log_probs(self, columns: list[np.ndarray], rows: int) -> np.ndarray:
        """``rows`` x languages: the last character of each window after those before."""
        out = np.full((rows, self.languages), self.floor, np.float32)
        for k in range(1, len(columns) + 1):
            tail = columns[len(columns) - k:]
            at, lang, value = self.fall[k].entries(_hashes(tail[:-1], rows))
            out[at, lang] += value
            at, lang, value = self.seen[k].entries(_hashes(tail, rows))
            out[at, lang] = value
        return out

    def save(self, path: str, orders: tuple[int, ...]) -> None:
        arrays = {"shape": np.array([self.languages, self.floor])}
        for k in orders:
            arrays |= self.seen[k].arrays(f"seen{k}") | self.fall[k].arrays(f"fall{k}")
        data = io.BytesIO()
        np.savez(data, **arrays)
        with create_file(path) as out:
            out.write(data.getbuffer())

    def read(self, path: str, orders: tuple[int, ...]) -> Model:
        with open_file(path) as source, np.load(io.BytesIO(source.read())) as arrays:
            self.languages, self.floor = int(arrays["shape"][0]), float(arrays["shape"][1])
            for k in orders:
                self.seen[k], self.fall[k] = Table.load(arrays, f"seen{k}"), Table.load(arrays, f"fall{k}")
        return self


SHORT, LONG = (1, 2), (3, 4)


@functools.lru_cache(maxsize=1)
def _short(path: str) -> Model:
    return Model(0, 0.0).read(path, SHORT)


@functools.lru_cache(maxsize=1)
def _part(short: str, path: str) -> Model:
    base = _short(short)
    model = Model(base.languages, base.floor)
    model.seen, model.fall = dict(base.seen), dict(base.fall)
    return model.read(path, LONG)


def part_of(c2, c1, parts: int):
    """Part of the windows with these two characters before the last."""
    return (c2 * 1000003 + c1) % parts


class Models:
    """Where the files of the models are; the languages by number."""

    def __init__(self, langs: list[str], short: str, parts: list[str]):
        self.langs, self.short, self.parts = langs, short, parts

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character (texts x languages) and characters of each text."""
        chars, owner = fold(texts)
        total, n = np.zeros((len(texts), len(self.langs))), np.bincount(owner, minlength=len(texts))
        step = max(1 << 12, SCORE_CHARS * 8 // max(8, len(self.langs)))
        cuts = []
        for at in range(0, len(chars), step):
            low = max(0, at - ORDER + 1)
            c, o = chars[low:at + step], owner[low:at + step]
            columns = [shifted(c, o, k)[at - low:] for k in range(ORDER - 1, -1, -1)]
            # a window is looked up once, however often it is there
            _, first, inverse = np.unique(keys(columns), return_index=True, return_inverse=True)
            columns = [c[first] for c in columns]
            part = part_of(columns[1].astype(np.int64), columns[2].astype(np.int64), len(self.parts))
            cuts.append((columns, part, inverse.astype(np.int32), o[at - low:]))
        for p, path in enumerate(self.parts):
            model = _part(self.short, path)
            for columns, part, inverse, o in cuts:
                of = np.flatnonzero(part == p)
                if not len(of):
                    continue
                found = np.zeros((len(part), len(self.langs)), np.float32)
                found[of] = model.log_probs([c[of] for c in columns], len(of))
                start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                total[o[start]] -= np.add.reduceat(found[inverse], start, axis=0, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame, part_windows: int = PART_WINDOWS) -> Models:
    """Models of all non-null ``lang`` values of ``docs`` (``lang, text``) that have a
    text with a letter.

    Counts, shorter windows and discounts are aggregates over all windows; only the
    languages with their discounts and the names of the files come to the driver.
    """
    spark = docs.sparkSession
    mask = (1 << 21) - 1
    four = materialize(count_windows(docs.where("lang IS NOT NULL AND text IS NOT NULL")))
    c2 = F.col("hi").bitwiseAND(mask)
    three = materialize(four.groupBy("lang", c2.alias("c2"), "lo").agg(F.count("*").alias("n")))
    two = materialize(three.groupBy("lang", "lo").agg(F.count("*").alias("n")))
    one = two.groupBy("lang", F.col("lo").bitwiseAND(mask).alias("lo")).agg(F.count("*").alias("n"))
    rare = None
    for k, table in enumerate((one, two, three, four), 1):
        of = table.groupBy("lang").agg(
            F.lit(k).alias("k"), F.count("*").alias("rows"),
            F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice"))
        rare = of if rare is None else rare.unionByName(of)
    rare = rare.collect()
    langs = sorted({r["lang"] for r in rare})
    if not langs:
        return Models([], "", [])
    at = {lang: i for i, lang in enumerate(langs)}
    discounts = np.zeros((ORDER + 1, len(langs)))
    for r in rare:
        discounts[r["k"], at[r["lang"]]] = min(0.95, max(0.1, r["once"] / max(r["once"] + 2 * r["twice"], 1)))
    floor = -float(np.log2(one.select("lo").distinct().count() + 1))
    folder = shared_folder(spark, "langid")
    python_ready(spark)

    def columns_of(table: pa.Table, *names: str):
        lang = pc.index_in(table["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int64)
        return [lang, *(table[name].to_numpy() for name in names)]

    def written(model: Model, orders: tuple[int, ...], part: int) -> pa.Table:
        # a repeated task writes a file of its own; only the one of the finished task is named
        path = f"{folder}/{part}-{uuid.uuid4().hex}.npz"
        model.save(path, orders)
        return pa.table({"part": pa.array([part], pa.int32()), "path": [path]})

    def write_short(table: pa.Table) -> pa.Table:
        lang, lo, n = columns_of(table, "lo", "n")
        c1, c0 = (lo >> 21).astype(np.uint32), (lo & mask).astype(np.uint32)
        model = Model(len(langs), floor)
        # a window of one character counts the different ones before it
        last = c0.astype(np.int64) * len(langs) + lang
        singles, kinds = np.unique(last, return_counts=True)
        model.add([(singles // len(langs)).astype(np.uint32)], singles % len(langs), kinds.astype(np.float64), discounts[1])
        model.add([c1, c0], lang, n.astype(np.float64), discounts[2])
        return written(model, SHORT, 0)

    short = two.groupBy().applyInArrow(write_short, "part int, path string").first()["path"]
    windows = sum(r["rows"] for r in rare if r["k"] == ORDER)
    parts = -(-windows // part_windows)

    def write_part(table: pa.Table) -> pa.Table:
        lang, hi, lo, n = columns_of(table, "hi", "lo", "n")
        columns = [(x & mask).astype(np.uint32) for x in (hi >> 21, hi, lo >> 21, lo)]
        base = _short(short)
        model = Model(base.languages, base.floor)
        model.seen, model.fall = dict(base.seen), dict(base.fall)
        # different windows that end in the same three characters
        order = np.lexsort((lang, columns[3], columns[2], columns[1]))
        same = [x[order] for x in (*columns[1:], lang)]
        new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in same], axis=0)])
        model.add([x[new] for x in same[:-1]], same[-1][new], np.diff(np.r_[new, len(order)]).astype(np.float64), discounts[3])
        model.add(columns, lang, n.astype(np.float64), discounts[4])
        return written(model, LONG, table["_part"][0].as_py())

    dealt = four.withColumn("_part", part_of(c2, F.shiftright("lo", 21), parts))
    files = {r["part"]: r["path"] for r in dealt.groupBy("_part").applyInArrow(write_part, "part int, path string").collect()}
    empty = f"{folder}/none.npz"
    if len(files) < parts:
        none = Model(len(langs), floor)
        for k in LONG:
            none.seen[k] = none.fall[k] = Table.of(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
        none.save(empty, LONG)
    return Models(langs, short, [files.get(p, empty) for p in range(parts)])


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` with ``lang_pred, score, _bits, _next, _chars``: bits per character of the
    best and the second-best language, and the number of characters.

    ``score`` weighs the languages by two to the power of minus four times their bits
    per character; a text that is null or has no letter is ``und`` with score 0.  With
    several parts of the models, texts of ``CHUNK_CHARS`` characters wait for all parts.
    """
    at_text = docs.columns.index("text")
    chunk = 4 * SCORE_CHARS if len(models.parts) < 2 else CHUNK_CHARS

    def added(texts):
        if models.langs:
            e, n = models.entropies(texts)
        else:
            e, n = np.zeros((len(texts), 1)), np.zeros(len(texts), int)
        pick = e.argmin(1)
        low = e[np.arange(len(e)), pick]
        share = 1 / np.exp2(-4 * (e - low[:, None])).sum(1)
        beside = np.sort(e, 1)[:, min(1, e.shape[1] - 1)]
        return [pa.array([models.langs[p] if k else UNKNOWN for p, k in zip(pick, n)], pa.string()),
                pa.array(np.where(n > 0, share, 0.0)), pa.array(low), pa.array(beside), pa.array(n.astype(float))]

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(at_text)), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                # as many rows as the chunk has room for, one at least
                room = np.searchsorted(np.cumsum(lengths[start:]), chunk - size, side="right")
                stop = min(batch.num_rows, start + max(int(room), 0 if waiting else 1))
                if stop > start:
                    waiting.append(batch.slice(start, stop - start))
                    size += int(lengths[start:stop].sum())
                if stop < batch.num_rows:
                    yield from scored(waiting)
                    waiting, size = [], 0
                start = stop
            if len(models.parts) < 2:
                yield from scored(waiting)
                waiting, size = [], 0
        yield from scored(waiting)

    def scored(waiting):
        if waiting:
            whole = pa.Table.from_batches(waiting)
            texts = whole.column(at_text).to_pylist()
            if texts:
                columns = added(texts)
                at = 0
                for batch in waiting:
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, *(c.slice(at, batch.num_rows) for c in columns)],
                        names=[*batch.schema.names, *(f.name for f in fields)])
                    at += batch.num_rows

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()),
              StructField("_bits", DoubleType()), StructField("_next", DoubleType()), StructField("_chars", DoubleType())]
    return map_batches(docs, run, StructType([*docs.schema.fields, *fields]))


def held_out(column: str = "doc_id"):
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def calibrate(scored: DataFrame):
    """Rows ``lang_pred, mean, beside, spread, noise`` from training texts that got their own
    language: mean bits, and those of the second-best language; deviation between long
    texts; deviation times sqrt(characters).  One aggregate from sums of powers, so that
    no language gathers its rows."""
    own = scored.where("lang = lang_pred AND _chars > 0")
    bits, chars = F.col("_bits"), F.col("_chars")
    sums = own.groupBy("lang_pred").agg(
        F.count("*").alias("n"), F.sum(chars).alias("c"), F.sum(bits * chars).alias("bc"),
        F.sum(bits * bits * chars).alias("bbc"), F.sum(F.col("_next") * chars).alias("nc"))
    mean = F.col("bc") / F.col("c")
    # the sum of (bits - mean)^2 times characters
    off = F.greatest(F.col("bbc") - mean * F.col("bc"), F.lit(0.0))
    return sums.select(
        "lang_pred", mean.alias("mean"), (F.col("nc") / F.col("c")).alias("beside"),
        F.sqrt(off / F.col("c")).alias("spread"), F.sqrt(off / F.col("n")).alias("noise"))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs``.

    The fold ``held_out`` teaches nothing, neither model nor thresholds; ``lang``,
    ``source`` and ``doc_id`` are no inputs of a prediction.  Rejected are texts far
    above the cross-entropy of their language's training texts, and ``und``.  A null id
    belongs to the training folds; repeated rows count again; without any training text
    every row is ``und``; an empty table gives none.
    """
    docs = docs.select("doc_id", "lang", "text")
    model = train(docs.where(~held_out()))
    scored = materialize(predict(docs, model).drop("text").withColumn("held_out", held_out()))
    limits = materialize(calibrate(scored.where("NOT held_out")))
    return _with_verdict(scored, limits).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def _with_verdict(scored: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.select(F.col("lang_pred").alias("_lang"), "mean", "beside", "spread", "noise")
    # one row per learned language; their names are in the driver already
    limits = F.broadcast(limits)
    limit = F.col("mean") + F.greatest(REJECT_DEVIATIONS * F.col("spread"), (F.col("beside") - F.col("mean")) / 2) + (
        REJECT_DEVIATIONS * F.col("noise") / F.sqrt(F.greatest("_chars", F.lit(1.0))))
    return scored.join(limits, scored["lang_pred"] == limits["_lang"], "left").withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | F.coalesce(F.col("_bits") > limit, F.lit(False)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, with all their columns.
    ``lang`` stays as it came; thresholds are learned from a first pass over the texts."""
    plain = docs.select("doc_id", "lang", "text")
    model = train(plain.where(~held_out()))
    scored = predict(plain.where(~held_out()), model).drop("text")
    limits = materialize(calibrate(scored.select("lang", "lang_pred", "_bits", "_next", "_chars")))
    columns = docs.columns
    added = ["lang_pred", "score", "_bits", "_next", "_chars"]
    renamed = docs.toDF(*(f"_c{i}" if c != "text" else c for i, c in enumerate(columns)))
    kept = _with_verdict(predict(renamed, model), limits).where(~F.col("rejected")).drop(*added)
    return kept.select(*(F.col("text" if c == "text" else f"_c{i}").alias(c) for i, c in enumerate(columns)))
