"""Running values: sliced and plain form against a direct statement."""

import random

import pytest
from pyspark.sql import functions as F

from sidematch.operators.scan import Last, Max, Runs, Since, Sum, number_rows, scan, spread_join, stack


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        pos = 0
        for _ in range(rng.randint(1, 25)):
            pos += rng.randint(1, 3)
            rows.append((g, pos, rng.choice([None, "a", "b", "c"]), rng.randint(0, 4)))
    return rows


def _expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        total, changes, start, prev, top = 0, 0, None, None, None
        for i, (_, pos, v, n) in enumerate(group):
            before = prev
            if v is not None:
                if prev is None or v != prev:
                    changes += prev is not None
                    start = pos
                prev = v
            following = next((r[2] for r in group[i + 1:] if r[2] is not None), None)
            tail = sum(r[3] for r in group[i:])
            total += n
            up = next((k for k, r in enumerate(group[i::-1], 1) if r[2] == "a"), None)
            down = next((k for k, r in enumerate(group[i + 1:], 2) if r[2] == "a"), None)
            out[g, pos] = (total, tail, before, prev, following, changes, start, top, i + 1, up, down)
            top = n if top is None else max(top, n)
    return out


@pytest.mark.parametrize("chunk", [None, 1, 3, 8, 1000])
def test_scan(spark, chunk):
    rows = _rows(7)
    df = spark.createDataFrame(rows, "g int, pos int, v string, n int").repartition(3)
    got = scan(
        df,
        ["g"],
        "pos",
        {
            "total": Sum(F.col("n")),
            "tail": Sum(F.col("n"), down=True),
            "before": Last(F.col("v"), inclusive=False),
            "latest": Last(F.col("v")),
            "following": Last(F.col("v"), down=True, inclusive=False),
            "changes": Runs(F.col("v"), "pos"),
            "top": Max(F.col("n"), inclusive=False),
            "up": Since(F.col("v").eqNullSafe("a")),
            "down": Since(F.col("v").eqNullSafe("a"), down=True, inclusive=False),
        },
        chunk,
    )
    got = number_rows(got, ["g"], "pos", "k", chunk)
    result = {
        (r.g, r.pos): (
            r.total, r.tail, r.before, r.latest, r.following, r.changes,
            r.changes_start, r.top, r.k, r.up, r.down,
        )
        for r in got.collect()
    }
    assert result == _expected(rows)


@pytest.mark.parametrize("chunk", [None, 4])
def test_spread_join(spark, chunk):
    df = spark.createDataFrame([(g, p) for g in range(3) for p in range(11)], "g int, pos int")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "g int, name string")
    got = spread_join(df, small, ["g"], "pos", chunk).groupBy("g", "name").count().collect()
    assert sorted((r.g, r.name, r["count"]) for r in got) == [(0, "x", 11), (1, "y", 11), (2, None, 11)]


def test_stack_moves_rows_once(spark):
    """Values of a level that use those of the level before; one exchange of the rows."""
    rows = _rows(3)
    df = spark.createDataFrame(rows, "g int, pos int, v string, n int").repartition(3)
    levels = [
        {"total": Sum(F.col("n"))}, lambda x: x.withColumn("even", F.col("total") % 2 == 0),
        {"evens": Sum(F.col("even").cast("int"))}, {"double": Sum(F.col("evens"))},
    ]
    one_by_one = scan(df, ["g"], "pos", levels[0], 4).withColumn("even", F.col("total") % 2 == 0)
    for level in levels[2:]:
        one_by_one = scan(one_by_one, ["g"], "pos", level, 4)
    stacked = stack(df, ["g"], "pos", levels, 4)
    assert sorted(stacked.collect(), key=str) == sorted(one_by_one.select(stacked.columns).collect(), key=str)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = stack(df, ["g"], "pos", levels, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    sources = [after for line, after in zip(lines, lines[1:]) if "Sort [g#" in line and ", pos#" in line]
    assert len([x for x in sources if "ReusedExchange" not in x]) == 1 and len(sources) >= 3
