"""Prefix trie of conversations that begin with another conversation's first turns.

A turn is known by a digest.  The fingerprint of a run of turns is a polynomial in several
fields, an element of a monoid: the product of a head and a suffix follows from running
sums over the stored turns, shifted by powers of the base.  So every prefix of every rebuilt
conversation gets its fingerprint from sums of the base conversation and of its own, and no
rebuilt text is ever made.  Prefixes with one fingerprint are a node; their members' last
turns and parents are compared through the stored turns, and on any difference the
polynomials are taken at other points.

Sums over subtrees need no walk: a node's subtree is what its members hold from its depth
on, each node below counted at its smallest member.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidematch.operators.order import global_rank
from sidematch.operators.scan import CHUNK, Chunk, Sum, scan
from sidematch.session import materialize
from .common import map_batches

PRIME = (1 << 31) - 1
LANES = range(4)
# Points of the polynomials; the next row is for a second attempt, and so on.
POINTS = [[1_103_515_245 + 7919 * (4 * k + lane) for lane in LANES] for k in range(8)]
DIGITS = 256
# Conversations c to c + FAMILY - 1 begin with turns of the one that FAMILY divides.
FAMILY = 20
HEADS = 4
# Width of the ranges of conv_id whose ends are joined to one text at a time.
END_RANGE = 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "fa", "fb"]


def _powers(point: int, exponent: Column) -> Column:
    """``point ** exponent`` modulo the prime, for exponents below 2 ** 32."""
    out = None
    for level in range(4):
        base = pow(point, DIGITS ** level, PRIME)
        table = F.lit([pow(base, d, PRIME) for d in range(DIGITS)])
        digit = F.get(table, F.shiftright(exponent, 8 * level).bitwiseAND(F.lit(DIGITS - 1)).cast("int")).cast("long")
        out = digit if out is None else out * digit % PRIME
    return out


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    return lanes[0] * (1 << 31) + lanes[1], lanes[2] * (1 << 31) + lanes[3]


def stored_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, i, q0..q3, words``: every turn by its place in its conversation, the
    digest of role and text as four numbers of 60 bits, and its words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("_sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = turns.select(
        "conv_id", "turn", "words",
        *(F.conv(F.substring("_sha", 1 + 15 * k, 15), 16, 10).cast("long").alias(f"q{k}") for k in LANES))
    ranked = global_rank(materialize(turns), ["conv_id", F.col("turn").asc_nulls_first(), *(f"q{k}" for k in LANES)])
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("_first"))
    return materialize(ranked.join(first, "conv_id").withColumn("i", F.col("rank") - F.col("_first")).select(
        "conv_id", "i", "words", *(f"q{k}" for k in LANES)))


def members(turns: DataFrame, points: list[int], family: int, heads: int, chunk: Chunk) -> tuple[DataFrame, DataFrame]:
    """Every turn of every rebuilt conversation with the fingerprints up to it and before
    it; and one row per conversation with its rebuilt length."""
    terms = turns.withColumns({
        f"t{k}": F.col(f"q{k}") % PRIME * _powers(points[k], F.col("i")) % PRIME for k in LANES})
    summed = scan(terms, ["conv_id"], "i", {f"s{k}": Sum(F.col(f"t{k}")) for k in LANES}, chunk)
    summed = materialize(summed)
    turn = F.struct("i", "words", *(f"{x}{k}" for k in LANES for x in "qst"))
    own = summed.groupBy("conv_id").agg(
        F.count("*").alias("n_own"), F.array_sort(F.collect_list(F.when(F.col("i") < heads - 1, turn))).alias("own"))
    own = materialize(own)
    convs = own.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % family,
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads,
    }).join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base")), "base", "left")

    def before(turns_of: str, n: str) -> list[Column]:
        """Running sums of the first ``n`` turns."""
        at = F.get(turns_of, (F.col(n) - 1).cast("int"))
        return [F.when(F.col(n) > 0, at[f"s{k}"] % PRIME).otherwise(0) for k in LANES]

    convs = convs.withColumn("g", F.least("h", F.coalesce(F.size("of_base"), F.lit(0)))).withColumn(
        "o", F.least("h", "n_own"))
    convs = materialize(convs.select(
        "conv_id", "h", "g", F.slice("of_base", F.lit(1), F.greatest("g", F.lit(1)).cast("int")).alias("head"),
        (F.col("g") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"),
        *(c.alias(f"b{k}") for k, c in enumerate(before("of_base", "g"))),
        *(c.alias(f"o{k}") for k, c in enumerate(before("own", "o")))))
    # the own suffix stands g - h places from where it was stored
    back = [F.get(F.lit([pow(p, -d, PRIME) for d in range(heads)]), (F.col("h") - F.col("g")).cast("int")) for p in points]
    tail = summed.join(convs.drop("head"), "conv_id").where(F.col("i") >= F.col("h"))

    def placed(less: str | None) -> list[Column]:
        inner = [F.col(f"s{k}") - (F.col(f"{less}{k}") if less else F.lit(0)) - F.col(f"o{k}") for k in LANES]
        return [(F.col(f"b{k}") + F.pmod(inner[k], F.lit(PRIME)) * back[k] % PRIME) % PRIME for k in LANES]

    def rows(df: DataFrame, depth: Column, upto: list[Column], prior: list[Column]) -> DataFrame:
        (fa, fb), (pa_, pb) = _packed(upto), _packed(prior)
        return df.select(
            "conv_id", depth.cast("long").alias("depth"), fa.alias("fa"), fb.alias("fb"), pa_.alias("up_a"), pb.alias("up_b"),
            "words", *(f"q{k}" for k in LANES), (depth == F.col("length")).alias("last"))

    tail = rows(tail, F.col("g") + F.col("i") - F.col("h") + 1, placed(None), placed("t"))
    head = convs.where("g > 0").select("conv_id", "length", F.explode("head").alias("x")).select("conv_id", "length", "x.*")
    head = rows(head, F.col("i") + 1, [F.col(f"s{k}") % PRIME for k in LANES],
                [F.pmod(F.col(f"s{k}") - F.col(f"t{k}"), F.lit(PRIME)) for k in LANES])
    return materialize(tail.unionByName(head)), convs


def _digest_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the conversations that end in each node, ascending.  Ranges of ids are
    joined to texts by many tasks; one task then only reads them in order."""
    texts = ends.groupBy(*NODE, F.floor(F.col("conv_id") / END_RANGE).alias("_range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = pa.schema([("depth", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        here, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if node == here:
                    digest.update(b",")
                else:
                    if here:
                        done.append((*here, digest.hexdigest()))
                    here, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)
        if here:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*here, digest.hexdigest())))], schema)

    dealt = texts.repartition(*NODE).sortWithinPartitions(*NODE, "_range").select(*NODE, "ids")
    return map_batches(dealt, run, "depth long, fa long, fb long, ends_sha256 string")


def build(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, chunk: Chunk = CHUNK,
          points: list[list[int]] = POINTS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` for every node of the trie of rebuilt ``conversations`` (``conv_id, turn,
    role, text``).

    Conversation c is rebuilt from the first h turns of c - c % ``family`` (all of them if
    there are fewer, none if it is absent) and its own turns after its first h, where h is
    crc32 of its decimal id modulo ``heads``.  Turns go by ``turn``, null first, equal ones
    by their digest; a null role or text is empty.  Rows without ``conv_id`` belong to no
    conversation; without any there is no node.  Repeated rows are turns of their own.
    Turns are equal when SHA-256 of role and text is.  A conversation of any length is
    worked in slices of ``chunk`` turns; other columns are ignored.
    """
    turns = stored_turns(conversations)
    for at in points:
        rows, convs = members(turns, at, family, heads, chunk)
        same = {c: (F.min(c), F.max(c)) for c in ("up_a", "up_b", *(f"q{k}" for k in LANES))}
        differs = F.lit(False)
        for low, high in same.values():
            differs = differs | (low != high)
        nodes = materialize(rows.groupBy(*NODE).agg(
            F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
            F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), differs.alias("mixed")))
        if nodes.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError("different turns under one fingerprint at all points")

    up = ["up_depth", "up_a", "up_b"]
    below = nodes.where("depth > 1").withColumn("up_depth", F.col("depth") - 1)
    children = below.groupBy(*up).agg(F.count("*").alias("n_children")).toDF(*NODE, "n_children")
    nodes = materialize(nodes.join(children, NODE, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")).drop("mixed"))

    # what a conversation adds to all nodes on its way: words that others hold too, and
    # the end of a branch, each at the smallest member only
    here = rows.select("conv_id", *NODE).join(nodes.select(*NODE, "rep", "words", "n_children", "n_convs"), NODE)
    smallest = F.col("conv_id") == F.col("rep")
    values = here.withColumns({
        "spare": F.when(smallest, 0).otherwise(F.col("words")),
        "leaf": (smallest & (F.col("n_children") == 0)).cast("long")})
    summed = scan(materialize(values), ["conv_id"], "depth", {
        "saved": Sum(F.col("spare"), down=True), "leaves": Sum(F.col("leaf"), down=True)}, chunk)
    below_of = summed.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    ended = rows.where("last").select("conv_id", *NODE).unionByName(
        convs.where("length = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in NODE)))
    ends = materialize(_digest_ends(ended))

    first = nodes.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"),
                      F.count(F.when(F.col("n_children") == 0, 1)).alias("n_leaves"),
                      F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), F.lit(0)).alias("saved_tokens"))
    whole = convs.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = whole.crossJoin(F.broadcast(first)).select(
        *(F.lit(0).cast("long").alias(c) for c in NODE), "rep", F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("up_a"), F.col("fb").alias("up_b"),
                           F.col("rep").alias("parent_conv_id"))
    columns = [*NODE, "rep", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    deeper = nodes.where("depth > 1").join(parents, ["depth", "up_a", "up_b"])
    top = nodes.where("depth = 1").crossJoin(F.broadcast(whole.select(F.col("rep").alias("parent_conv_id"))))
    inner = deeper.unionByName(top, allowMissingColumns=True).join(below_of, NODE).select(*columns)
    return root.select(*columns).unionByName(inner).join(ends, NODE, "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
