"""Near-duplicate documents: Jaccard join of word shingles, and its components.

A document is the set of its shingles; equal sets are one class.  A class is searched
only if enough of its shingles occur elsewhere.  Shingles are ordered from rare to
common, and two classes can only be linked if they share one of the first
quarter of either set.  In each such bucket

1. every class is compared with one leader, which connects groups of near copies with
   as many comparisons as members;
2. what is still unconnected is found by T-occurrence search: classes that hang together
   by buckets form blocks with an inverted index, and each class that shares enough
   rare shingles with a block merges the short lists on a heap and probes the long ones
   (DivideSkip) for members of larger components that reach the required overlap.

No step lists all pairs of a bucket, and every link between classes that step 1 left
unconnected is found by step 2.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidematch.session import materialize
from .common import map_batches, mix
from .components import components

WIDTH = 5
PERCENT = 75
# Shingles whose number of documents is known to the order, the most frequent first.
# Where the list ends changes how long the search takes, never its result.
COMMON = 1 << 22
# From this number of documents on a bucket is dealt out in parts.
HOT, HOT_PARTS = 4096, 64
# Ids are sent to every task up to this number (8 bytes each), beyond it they are joined.
BROADCAST_IDS = 1 << 20
COUNT_SHINGLES = 1 << 22
BLOCK = 256
_U = np.uint64


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; of all its words
    together if it has fewer, none without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(codes) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h ^ codes[i:i + n]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    h = mix(h)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def class_of(h: np.ndarray) -> int:
    """64-bit name of a set; ``n`` classes have about ``n^2 / 2^65`` equal names by chance."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.searchsorted(a, b)
    same = int((a[np.minimum(both, len(a) - 1)] == b).sum()) if len(a) else 0
    return 100 * same >= percent * (len(a) + len(b) - same)


def survey(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, class, n``: the class and the set size of every document."""
    def run(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([class_of(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "class", "n"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, class long, n long")


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(values.tobytes())


def _unzip(packed: bytes, kind, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=8 * n)
    return np.frombuffer(raw, kind)


PACKED = "kind int, part long, stretch long, n long, a binary, b binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "part", "stretch", "n", "a", "b"])


def occurrences(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """What is known of shingles by the upper 32 bits of their hash, packed in rows.

    Documents are taken in stretches.  Kind 1: classes and sizes of a stretch; kind 0:
    places in it and how many of their shingles (of one part of all names) stand in two
    documents or more; kind 2: names in two documents or more, and in how many.
    """
    parts = 4 * max(1, docs.rdd.getNumPartitions())

    def send(batches):
        from pyspark import TaskContext

        stretch, names, owners, classes = TaskContext.get().partitionId() << 24, [], [], []

        def rows():
            sizes = np.array([len(x) for x in names], np.int32)
            h = np.concatenate(names)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], np.repeat(np.arange(len(names), dtype=np.int32), sizes)[order]
            part = (h.astype(np.uint64) * _U(parts) >> _U(32)).astype(np.int64)
            edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(h)] if len(h) else [0]
            out = [(1, stretch % parts, stretch, len(names), _zip(np.array(classes, np.int64)), _zip(sizes))]
            for i, j in zip(edges[:-1], edges[1:]):
                out.append((0, int(part[i]), stretch, int(j - i), _zip(np.diff(h[i:j], prepend=np.uint32(0))), _zip(owner[i:j])))
            return _packed(out)

        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingles(text, width)
                names.append((own >> _U(32)).astype(np.uint32))
                classes.append(class_of(own))
                size += len(own)
            if size > COUNT_SHINGLES:
                yield rows()
                stretch, names, classes, size = stretch + 1, [], [], 0
        if names:
            yield rows()

    def count(batches):
        now, held = None, []

        def rows():
            u, n = np.unique(np.concatenate([h for _, h, _ in held]), return_counts=True) if held else (np.empty(0, np.uint32),) * 2
            out = []
            for stretch, h, owner in held:
                k = np.bincount(owner[n[np.searchsorted(u, h)] > 1]) if len(h) else np.empty(0, np.int64)
                at = np.flatnonzero(k)
                if len(at):
                    out.append((0, None, stretch, len(at), _zip(at.astype(np.int32)), _zip(k[at].astype(np.int32))))
            twice = n > 1
            if twice.any():
                out.append((2, None, None, int(twice.sum()), _zip(np.diff(u[twice], prepend=np.uint32(0))),
                            _zip(np.minimum(n[twice], np.iinfo(np.int32).max).astype(np.int32))))
            return _packed(out)

        for batch in batches:
            for kind, part, stretch, n, a, b in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if part != now:
                    yield rows()
                    now, held = part, []
                if kind:
                    yield _packed([(kind, part, stretch, n, a, b)])
                else:
                    held.append((stretch, np.cumsum(_unzip(a, np.uint32, n), dtype=np.uint32), _unzip(b, np.int32, n)))
        yield rows()

    sent = map_batches(docs.select("text"), send, PACKED)
    dealt = sent.repartition(max(parts // 4, docs.sparkSession.sparkContext.defaultParallelism), "part").sortWithinPartitions("part")
    return materialize(map_batches(dealt, count, PACKED))


def frequent(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``COMMON`` most frequent names and their numbers of documents, names rising;
    equal numbers are in or out together."""
    packed = known.where("kind = 2").select("n", "a", "b")

    def totals(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for n, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for value, times in zip(*np.unique(_unzip(b, np.int32, n), return_counts=True)):
                    seen[int(value)] = seen.get(int(value), 0) + int(times)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["docs", "k"])

    upto = map_batches(packed, totals, "docs long, k long").groupBy("docs").agg(F.sum("k").alias("k")).selectExpr(
        "docs", "sum(k) OVER (ORDER BY docs DESC) AS upto")
    least = upto.where(F.col("upto") <= COMMON).agg(F.min("docs")).first()[0]
    if least is None:
        return np.empty(0, np.uint32), np.empty(0, np.int32)

    def pick(batches):
        for batch in batches:
            for n, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names, docs = np.cumsum(_unzip(a, np.uint32, n), dtype=np.uint32), _unzip(b, np.int32, n)
                names, docs = names[docs >= least], docs[docs >= least]
                if len(names):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(names)]), pa.array([_zip(np.diff(names, prepend=np.uint32(0)))]), pa.array([_zip(docs)])],
                        names=["n", "a", "b"])

    # at most COMMON names come to the driver, a few bytes each
    rows = map_batches(packed, pick, "n long, a binary, b binary").collect()
    names = np.concatenate([np.cumsum(_unzip(r["a"], np.uint32, r["n"]), dtype=np.uint32) for r in rows])
    order = np.argsort(names)
    return names[order], np.concatenate([_unzip(r["b"], np.int32, r["n"]) for r in rows])[order]


def candidates(known: DataFrame, percent: int) -> DataFrame:
    """``class``: those of whose shingles the share that a link needs stands elsewhere too."""
    def run(batches):
        now, classes, sizes, shared_ = None, None, None, None

        def rows():
            enough = shared_ >= -(-percent * sizes // 100) if now is not None else np.empty(0, bool)
            found = classes[enough & (sizes > 0)] if now is not None else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["class"])

        for batch in batches:
            for stretch, n, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if stretch != now:
                    yield rows()
                    now, classes, sizes = stretch, _unzip(a, np.int64, n), _unzip(b, np.int32, n).astype(np.int64)
                    shared_ = np.zeros(len(sizes), np.int64)
                else:
                    shared_[_unzip(a, np.int32, n)] += _unzip(b, np.int32, n)
        yield rows()

    spark = known.sparkSession
    dealt = known.where("kind < 2").repartition(spark.sparkContext.defaultParallelism, "stretch").sortWithinPartitions("stretch", F.desc("kind"))
    return materialize(map_batches(dealt.select("stretch", "n", "a", "b"), run, "class long").distinct())


def texts_of(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """``text``: that of one document of each of ``classes``.  Ids that stand on several
    rows may bring further texts, or the same again."""
    ids = materialize(members.join(classes, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("_id")).select("_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")


def postings(docs: DataFrame, common, width: int, percent: int) -> DataFrame:
    """``shingle, class, n, hot``: the rarest shingles of every class, and its size.
    ``common`` is a broadcast of what ``frequent`` returns."""
    def run(batches):
        known, counts = common.value
        seen = set()
        for batch in batches:
            out = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                h = shingles(text, width)
                name = class_of(h)
                n = len(h)
                if not n or name in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(name)
                short = (h >> _U(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(known, short), max(len(known) - 1, 0))
                weight = np.where(known[at] == short, counts[at], 0) if len(known) else np.zeros(n, np.int64)
                # an order by weight, then hash; hashes are sorted already
                order = np.argsort(weight, kind="stable")[:n - -(-percent * n // 100) + 1]
                out[0].append(h[order].view(np.int64))
                out[1].append(np.full(len(order), name, np.int64))
                out[2].append(np.full(len(order), n, np.int32))
                out[3].append(weight[order] >= HOT)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], names=["shingle", "class", "n", "hot"])

    return map_batches(docs.select("text"), run, "shingle long, class long, n int, hot boolean")


def shared(found: DataFrame) -> DataFrame:
    """The postings of buckets with two classes or more, and the bucket's leader, its
    smallest class.  Common shingles are dealt out in parts and put together after."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("class"), F.lit(HOT_PARTS))).otherwise(0)
    bucket = Window.partitionBy("shingle", "_salt")
    found = materialize(
        found.withColumn("_salt", salt)
        .withColumn("leader", F.min("class").over(bucket)).withColumn("_high", F.max("class").over(bucket))
        .where("hot OR leader <> _high").select("shingle", "class", "n", "hot", "leader").distinct())
    hot = found.where("hot")
    leaders = hot.groupBy("shingle").agg(F.min("class").alias("_l"), F.max("class").alias("_high")).where(
        "_l <> _high").select("shingle", "_l")
    hot = hot.join(leaders, "shingle").select("shingle", "class", "n", F.col("_l").alias("leader"))
    return materialize(found.where("NOT hot").select("shingle", "class", "n", "leader").union(hot))


def least_common(n, m, percent: int):
    """Rare shingles that two linked sets of these sizes share at least: what they must
    share in all, less what lies beyond the rare ones of the larger set."""
    most = F.greatest(n, m)
    return F.ceil(percent * (n + m) / (100.0 + percent) - 1e-9) - F.ceil(percent * most / 100.0 - 1e-9) + 1


def sets_of(docs: DataFrame, members: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``class, items``: the sets of ``classes``; see ``texts_of``."""
    def run(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "items"])

    return materialize(map_batches(texts_of(docs, members, classes), run, "class long, items array<long>"))


def divide_skip(query: np.ndarray, index: tuple[np.ndarray, np.ndarray], sets: list[np.ndarray],
                groups: list, asked: set, percent: int = PERCENT) -> list[int]:
    """Members of ``sets`` that are linked with ``query``: one of each of the ``groups`` in
    ``asked`` that has any.

    ``index``: hashes in rising order and the member that has each.  A linked member
    shares at least ``T`` of the query's hashes; the ``T - 1`` longest lists cannot hold
    all of them, so it is in one of the others, which are merged.
    """
    known, owners = index
    need = -(-percent * len(query) // 100)
    low, high = np.searchsorted(known, query, "left"), np.searchsorted(known, query, "right")
    size = high - low
    if int((size > 0).sum()) < need:
        return []
    order = np.argsort(size, kind="stable")
    short, long_ = order[:len(order) - need + 1], np.sort(query[order[len(order) - need + 1:]])
    lists = [owners[low[i]:high[i]].tolist() for i in short if size[i]]
    last, count, done, found = None, 0, set(), []
    for member in [*heapq.merge(*lists), None]:
        if member == last:
            count += 1
            continue
        if last is not None and groups[last] in asked and groups[last] not in done:
            own = sets[last]
            # it has to reach the overlap that both sizes ask for
            overlap = -(-percent * (len(own) + len(query)) // (100 + percent))
            if count + len(long_) >= overlap:
                at = np.searchsorted(own, long_)
                count += int((own[np.minimum(at, len(own) - 1)] == long_).sum())
                if count >= overlap:
                    found.append(last)
                    done.add(groups[last])
        last, count = member, 1
    return found


def search(cells: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links of the queries of a cell with its members, one for each component
    that comes after the query's in the order of size and label.

    ``cells``: ``cell, query, class, size, label, items``; the rows of a cell stand
    together in one task, members first, and are read one after the other.
    """
    def run(batches):
        cell, names, sets, groups, index = None, [], [], [], None
        for batch in batches:
            u, v = [], []
            # the offsets of a list array count in all of its values
            items, offsets = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for (key, query, name, size, label), start, stop in zip(rows, offsets[:-1], offsets[1:]):
                own = items[start:stop].view(np.uint64)
                if key != cell:
                    cell, names, sets, groups, index = key, [], [], [], None
                if not query:
                    names.append(name)
                    sets.append(own.copy())
                    groups.append((size, label))
                    continue
                if index is None:
                    known = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    by = np.lexsort((owner, known))
                    index = known[by], owner[by]
                for hit in divide_skip(own, index, sets, groups, {g for g in set(groups) if g > (size, label)}, percent):
                    u.append(name)
                    v.append(names[hit])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = cells.repartition(max(2 * cells.sparkSession.sparkContext.defaultParallelism, 16), "cell").sortWithinPartitions("cell", "query")
    return map_batches(dealt.select("cell", "query", "class", "size", "label", "items"), run, "u long, v long")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest ``doc_id`` reachable by links, itself included.  A
    null text, or one without words, has 0 shingles and no link; a null id is never the
    smallest, so a row with it that has no link has a null component; repeated rows are
    linked with each other; an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = materialize(survey(docs, width))
    known = occurrences(docs, width)
    common = spark.sparkContext.broadcast(frequent(known))
    buckets = shared(postings(texts_of(docs, members, candidates(known, percent)), common, width, percent))
    led = buckets.join(buckets.select(F.col("class").alias("leader"), F.col("n").alias("_n")).distinct(), "leader")
    pairs = materialize(
        led.where("leader <> class").groupBy("leader", "class", "n", "_n").agg(F.count("*").alias("_k"))
        .where(F.col("_k") >= least_common(F.col("n"), F.col("_n"), percent)).select("leader", "class"))
    wanted = pairs.select("class").union(pairs.select("leader")).distinct()
    sets = sets_of(docs, members, wanted, width)
    near = (
        pairs.join(sets.toDF("leader", "_a"), "leader").join(sets.toDF("class", "_b"), "class")
        .withColumn("_same", F.size(F.array_intersect("_a", "_b")))
        .where(100 * F.col("_same") >= percent * (F.size("_a") + F.size("_b") - F.col("_same")))
    )
    links = materialize(near.select(F.col("leader").alias("u"), F.col("class").alias("v")))
    # what the leaders left apart: classes that share a bucket, in different components
    labels = components(links).select(F.col("node").alias("class"), "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    family = components(buckets.where("leader <> class").select(F.col("leader").alias("u"), F.col("class").alias("v")).distinct())
    family = family.select(F.col("node").alias("class"), F.col("label").alias("family"))
    counts = family.groupBy("family").agg(F.count("*").alias("_classes"))
    # blocks are parts of what hangs together by buckets, so that one block holds most of a bucket
    known_of = materialize(
        family.join(counts, "family").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        .join(sizes, "label", "left").select(
            "class", "family", F.pmod(F.xxhash64("class"), F.ceil(F.col("_classes") / BLOCK)).cast("int").alias("block"),
            F.coalesce("size", F.lit(1).cast("long")).alias("size"), "label"))
    placed = buckets.select("shingle", "class", "n").join(known_of, "class")
    mixed = placed.groupBy("shingle").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l <> _h").select("shingle")
    placed = materialize(placed.join(mixed, "shingle"))
    blocks = placed.groupBy("shingle", "block").agg(
        F.max(F.struct("size", "label")).alias("_last"), F.min("n").alias("_least"), F.max("n").alias("_most"))
    met = (
        placed.join(blocks.withColumnRenamed("block", "_block"), "shingle").where(F.col("_last") > F.struct("size", "label"))
        .groupBy("class", "n", "family", "size", "label", "_block")
        .agg(F.count("*").alias("_k"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    )
    # between the ends rounding may ask for one less
    fewest = F.least(*(least_common(F.col("n"), F.col(c), percent) for c in ("_least", "_most"))) - 1
    asked = materialize(met.where(F.col("_k") >= fewest).select("class", "family", "size", "label", F.col("_block").alias("block")))
    chunks = asked.groupBy("family", "block").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_chunks"))
    queries = asked.join(chunks, ["family", "block"]).select(
        F.xxhash64("family", "block", F.pmod(F.xxhash64("class"), F.col("_chunks"))).alias("cell"), F.lit(True).alias("query"),
        "class", "size", "label")
    inside = (
        known_of.join(chunks, ["family", "block"])
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"))
        .select(F.xxhash64("family", "block", "_chunk").alias("cell"), F.lit(False).alias("query"), "class", "size", "label")
    )
    rows = materialize(queries.union(inside))
    cells = rows.join(sets_of(docs, members, rows.select("class").distinct(), width), "class")
    more = materialize(search(cells, percent))
    final = components(links.union(more))
    named = members.join(final.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("_c"))
    return named.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component, with all columns.  Of
    rows that share an id and their text one stays."""
    found = materialize(join(docs)).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = materialize(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")))
    few = found.count() <= BROADCAST_IDS

    def rows_of(ids):
        ids = ids.select("_id")
        return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")

    # only ids that stand on several rows need their texts compared
    text = "_text" + "_" * max(map(len, docs.columns))
    several = rows_of(found.where("_n > 1")).withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return rows_of(found.where("_n = 1")).unionByName(several)
