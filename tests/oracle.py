"""Compare a registered query with its SQL on the same parquet files."""

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, sf_dir, query, sql):
    """None when equal, else a short description."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] != theirs[1]:
        only_mine, only_theirs = mine[1] - theirs[1], theirs[1] - mine[1]
        return (
            f"rows {sum(mine[1].values())} vs {sum(theirs[1].values())}; "
            f"only here {sum(only_mine.values())}: {list(only_mine)[:3]}; "
            f"only SQL {sum(only_theirs.values())}: {list(only_theirs)[:3]}"
        )
    if not mine[1]:
        return "no rows"
    return None
