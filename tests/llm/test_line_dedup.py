"""Line dedup against a plain version, with nulls, repeats, long texts and clashing names."""

from collections import Counter, defaultdict

from sidematch.llm import line_dedup

LONG = "A line that is long enough to count"
SCHEMA = "doc_id long, text string, kept string, n_lines long, _h string, _at int, _lost string"


def plain(rows, min_chars=20, min_docs=3):
    def key(line):
        line = line.strip(" \t\n\x0b\f\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc_id is not None:
                holders[key(line)].add(doc_id)
    out = Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (
            len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != doc_id)]
        out[doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 7, "y", 3, "z") for i, t in rows], SCHEMA)
    got = line_dedup.drop_shared_lines(docs, **options)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    return Counter(map(tuple, got.collect()))


def test_equals_plain(spark):
    rows = [
        (1, f"{LONG}\nown line of the first document\n{LONG}"), (2, f"  {LONG.upper()}\t\r\nshort\n\n"),
        (3, f"{LONG}\n{LONG}\nx"), (4, None), (5, ""), (None, f"{LONG}\nkept here"), (None, LONG),
        (6, f"É{LONG}"), (7, f"é{LONG}"), (8, f"É{LONG}\n"), (9, f"\n{'É' * 20}\n"), (10, "É" * 20), (11, "É" * 20),
        (12, "e" * 19), (13, "e" * 19), (14, "e" * 19), (15, "\n".join(["only mine and nobody else's"] * 9)),
        (16, "two rows of one document"), (16, "two rows of one document"), (16, "two rows of one document\n"),
        (17, "two rows of one document"), (18, "\n".join(f"line {i % 50} of a very long text" for i in range(20_000))),
        (19, "\n".join(f"line {i} of a very long text" for i in range(40))), (20, "line 7 of a very long text\nend"),
    ]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, min_chars=1, min_docs=2) == plain(rows, 1, 2)


def test_empty_and_null(spark):
    assert run(spark, []) == Counter()
    assert run(spark, [(None, None)] * 3) == Counter({(None, 1, 0, ""): 3})
