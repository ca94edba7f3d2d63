"""Pages, repeating headers and footers, page sections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidematch.functions.text import is_blank, match_start, matched_value, search, strip, unix_newlines
from sidematch.operators.scan import CHUNK, Chunk, Last, Runs, Sum, scan, spread_join, stack

DOC = ("side", "doc_id")
POS = "line_no"

# Page-break patterns in priority order.
PAGE_BREAKS = [
    r"^\s*PAGE\s+\d+\s*$",
    r"^.*\bPAGE\s+\d+\s*$",
    r"\f",
    r"^-{3,}\s*[Pp]age\s*\d+\s*-{3,}$",
    r"^={3,}\s*[Pp]age\s*\d+\s*={3,}$",
    r"^\s*[Pp]age\s+\d+\s+of\s+\d+\s*$",
    r"^[-_]{10,}\s*$",
    r"^\*{10,}\s*$",
]
# A line that opens a page section, and its page number.
PAGE_MARKER = r"^\s*[Pp][Aa][Gg][Ee]\s+(\d+)\b"
# How many lines at a page edge are looked at, and the share of pages
# a line must be on to count as repeating.
EDGE_LINES = 3
REPEAT_SHARE = 0.6

Pattern = str | Callable[[Column], Column]


def _value(pattern: Pattern, line: Column) -> Column:
    return matched_value(line, pattern) if isinstance(pattern, str) else pattern(line)


def _separator(pattern: Pattern | None, line: Column) -> Column:
    """A separator matches at the start of the line; no pattern, no separator."""
    if pattern is None:
        return F.lit(False)
    found = match_start(line, pattern) if isinstance(pattern, str) else pattern(line)
    return F.coalesce(found, F.lit(False))


def drop_matching(lines: DataFrame, patterns: Sequence[str], col: str = "line") -> DataFrame:
    """Lines that match none of the patterns."""
    for p in patterns:
        lines = lines.where(~search(F.col(col), p))
    return lines


def non_blank(lines: DataFrame, col: str = "line") -> DataFrame:
    return lines.where(~is_blank(F.col(col)))


def trim_blocks(
    lines: DataFrame,
    block: str,
    number: str,
    by: Sequence[str] = DOC,
    pos: str = POS,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Drop the blank lines at both ends of every block and number the blocks that
    are left from 1 (``number``).  ``block`` must not decrease along ``pos``.

    A line stays when the nearest non-blank lines on both sides (itself included)
    are of its own block.
    """
    return stack(lines, by, pos, _trimmed(block, number, pos), chunk)


def _trimmed(block: str, number: str, pos: str) -> list:
    """Levels of a stack that trim blocks."""
    filled = F.when(~is_blank(F.col("line")), F.col(block))
    specs = {"_above": Last(filled), "_below": Last(filled, down=True), number: Runs(filled, pos)}
    blank_text = F.col("_above").isNull() & F.col("_below").isNull()
    keep = (F.col("_above") == F.col(block)) & (F.col("_below") == F.col(block))

    def kept(rows: DataFrame) -> DataFrame:
        return rows.where(keep | blank_text).withColumn(number, F.col(number) + 1).drop(
            "_above", "_below", f"{number}_start")

    return [specs, kept]


def pages_by_value_change(
    lines: DataFrame,
    pattern: Pattern,
    by: Sequence[str] = DOC,
    pos: str = POS,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Add ``page_no``: a new page begins on the line whose captured value differs
    from the last captured one.  Lines without a match stay on the current page."""
    changes = {"_page": Runs(_value(pattern, F.col("line")), pos)}
    levels = [changes, *_trimmed("_page", "page_no", pos)]
    return stack(lines, by, pos, levels, chunk).drop("_page", "_page_start")


def pages_by_delimiter(
    docs: DataFrame, by: Sequence[str] = DOC, text: str = "text"
) -> DataFrame:
    """``by, pos, line_no, line, page_no`` from whole texts: the first page-break
    pattern that splits the text into something with content splits all of it; the
    matched text is consumed.  ``line_no`` is the line's true position in the text
    and ``pos`` its order (a form feed cuts one line into two).

    Cutting happens inside the row; the only window runs over the pages of one
    text, which came out of a single cell and is bounded by its size.
    """
    body = unix_newlines(F.col(text))
    uncut = F.struct(F.array(body).alias("chunks"), F.array().cast("array<string>").alias("gaps"))
    choice = None
    for p in PAGE_BREAKS:
        java = f"(?md){p}"
        chunks = F.split(body, java, -1)
        usable = body.rlike(java) & F.exists(chunks, lambda c: ~is_blank(c))
        cut = F.struct(
            chunks.alias("chunks"),
            F.regexp_extract_all(body, F.lit(java), F.lit(0)).alias("gaps"),
        )
        choice = F.when(usable, cut) if choice is None else choice.when(usable, cut)
    cut = docs.select(*by, choice.otherwise(uncut).alias("_cut"))
    pieces = cut.select(
        *by,
        (F.size("_cut.chunks") > 1).alias("_is_cut"),
        F.posexplode(F.arrays_zip("_cut.chunks", "_cut.gaps")).alias("_i", "_piece"),
    )
    arr = F.split(F.col("_piece.chunks"), "\n", -1)
    gap_lines = F.coalesce(F.regexp_count(F.col("_piece.gaps"), F.lit("\n")), F.lit(0))
    newlines = F.size(arr) - 1 + gap_lines
    earlier = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    has_text = ~is_blank(F.col("_piece.chunks"))
    pages = (
        pieces.withColumn("_newlines", newlines)
        .withColumn("_has_text", has_text)
        .withColumn("_offset", F.coalesce(F.sum("_newlines").over(earlier), F.lit(0)))
        .withColumn("_base", F.coalesce(F.sum(F.size(arr)).over(earlier), F.lit(0)))
        .withColumn("page_no", F.sum(F.col("_has_text").cast("long")).over(upto))
    )
    numbered = (
        pages.where(F.col("_has_text") | ~F.col("_is_cut"))
        .withColumn("page_no", F.greatest("page_no", F.lit(1)))
        .select(*by, "page_no", "_is_cut", "_offset", "_base", arr.alias("_arr"))
    )
    blank = F.transform("_arr", is_blank)
    first = F.array_position(blank, False)
    last = F.size("_arr") - F.array_position(F.reverse(blank), False) + 1
    lines = numbered.select(
        *by,
        "page_no",
        "_offset",
        "_base",
        F.when(F.col("_is_cut"), first).otherwise(F.lit(1)).cast("int").alias("_first"),
        F.when(F.col("_is_cut"), last).otherwise(F.size("_arr")).cast("int").alias("_last"),
        F.posexplode("_arr").alias("_p", "line"),
    )
    return lines.where((F.col("_p") + 1).between(F.col("_first"), F.col("_last"))).select(
        *by,
        (F.col("_base") + F.col("_p") + 1).alias("pos"),
        (F.col("_offset") + F.col("_p") + 1).alias("line_no"),
        "line",
        "page_no",
    )


def repeating_lines(
    pages: DataFrame,
    separator: Pattern | None = None,
    by: Sequence[str] = DOC,
    pos: str = POS,
    check: int = EDGE_LINES,
    share: float = REPEAT_SHARE,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """``by, kind, line, n``: stripped lines that are among the first (``header``) or
    last (``footer``) ``check`` lines of enough pages.  Separators are no footers."""
    edges = scan(
        pages,
        [*by, "page_no"],
        pos,
        {"_top": Sum(F.lit(1)), "_bottom": Sum(F.lit(1), down=True)},
        chunk,
    )
    at_top = F.col("_top") <= check
    at_bottom = (F.col("_bottom") <= check) & ~_separator(separator, F.col("line"))
    counts = (
        edges.where(at_top | (F.col("_bottom") <= check))
        .where(~is_blank(F.col("line")))
        .select(*by, strip(F.col("line")).alias("line"), at_top.alias("_t"), at_bottom.alias("_b"))
        .groupBy(*by, "line")
        .agg(F.count_if("_t").alias("header"), F.count_if("_b").alias("footer"))
    )
    n_pages = pages.groupBy(*by).agg(F.max("page_no").alias("n_pages"))
    needed = F.greatest(F.lit(2), F.floor(F.col("n_pages") * F.lit(float(share))))
    kinds = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("header", "footer")]
        )
    )
    return (
        counts.where((F.col("header") >= 2) | (F.col("footer") >= 2))
        .join(n_pages, list(by))
        .where(F.col("n_pages") >= 2)
        .select(*by, "line", "n_pages", kinds.alias("_k"))
        .where(F.col("_k.n") >= needed)
        .select(*by, F.col("_k.kind").alias("kind"), "line", F.col("_k.n").alias("n"))
    )


def strip_repeating(
    pages: DataFrame,
    repeating: DataFrame,
    separator: Pattern | None = None,
    by: Sequence[str] = DOC,
    pos: str = POS,
    check: int = EDGE_LINES,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Add ``role``: header, body or footer.

    From the top, a repeating line is a header while fewer than ``check`` other
    lines precede it on the page.  From the bottom, on the lines that are left, it
    is a footer while fewer than ``check`` other lines and fewer than ``check``
    footers follow it.  At most five lines per document can repeat often enough,
    so they travel as two short arrays.
    """
    def of(kind: str) -> Column:
        return F.collect_set(F.when(F.col("kind") == kind, F.col("line")))

    marks = repeating.groupBy(*by).agg(of("header").alias("_headers"), of("footer").alias("_footers"))
    text = strip(F.col("line"))
    no = F.lit(False)
    page = [*by, "page_no"]
    rows = spread_join(pages, marks, by, pos, chunk, within=page).withColumns(
        {
            "_h": F.coalesce(F.array_contains("_headers", text), no),
            "_f": F.coalesce(F.array_contains("_footers", text), no)
            & ~_separator(separator, F.col("line")),
        }
    ).drop("_headers", "_footers")
    left = ~F.col("_header")

    def headers(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_header", F.col("_h") & (F.col("_before") < check))

    rows = stack(rows, page, pos, [
        {"_before": Sum(F.when(~F.col("_h"), 1).otherwise(0), inclusive=False)},
        headers,
        {
            "_kept": Sum(F.when(left & ~F.col("_f"), 1).otherwise(0), down=True, inclusive=False),
            "_cut": Sum(F.when(left & F.col("_f"), 1).otherwise(0), down=True, inclusive=False),
        },
    ], chunk)
    footer = F.col("_f") & (F.col("_kept") < check) & (F.col("_cut") < check)
    role = F.when(F.col("_header"), "header").when(footer, "footer").otherwise("body")
    return rows.withColumn("role", role).select(*pages.columns, "role")


def page_sections(
    body: DataFrame, by: Sequence[str] = DOC, pos: str = POS, chunk: Chunk = CHUNK,
    among: Column | None = None,
) -> DataFrame:
    """Add ``section_id``, ``section_title`` and ``is_marker``: a line that starts with
    ``PAGE n`` opens the section ``Page n``; lines before the first are ``Page 0``.
    ``among`` tells body lines from others, which open no section."""
    number = F.regexp_extract(F.col("line"), PAGE_MARKER, 1)
    marker = F.col("line").rlike(PAGE_MARKER)
    marker = marker if among is None else among & marker
    rows = scan(
        body,
        by,
        pos,
        {
            "section_id": Sum(F.when(marker, 1).otherwise(0)),
            "_page": Last(F.when(marker, number)),
        },
        chunk,
    )
    title = F.concat(F.lit("Page "), F.coalesce("_page", F.lit("0")))
    return rows.withColumns({"section_title": title, "is_marker": marker}).drop("_page")


def section_list(
    sections: DataFrame, docs: DataFrame | None = None, by: Sequence[str] = DOC,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """One row per section: ``by, ordinal, section_id, section_title, n_lines,
    n_filled``.  Documents of ``docs`` without a body get one empty ``Page 0``."""
    content = ~F.col("is_marker")
    out = sections.groupBy(*by, "section_id").agg(
        F.any_value("section_title").alias("section_title"),
        F.count_if(content).alias("n_lines"),
        F.count_if(content & ~is_blank(F.col("line"))).alias("n_filled"),
    )
    if docs is not None:
        empty = docs.select(*by).join(out.select(*by).distinct(), list(by), "left_anti")
        out = out.unionByName(
            empty.select(
                *by,
                F.lit(0).cast("long").alias("section_id"),
                F.lit("Page 0").alias("section_title"),
                F.lit(0).cast("long").alias("n_lines"),
                F.lit(0).cast("long").alias("n_filled"),
            )
        )
    return scan(out, by, "section_id", {"ordinal": Sum(F.lit(1))}, chunk)
