"""Compare two folders (or any two sets of texts) in one go.

All pairs run together: the pair is a grouping column of every operator.  The parse
is written once and read by every comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidematch.functions.dates import mask_dates
from sidematch.functions.keys import key_parts
from sidematch.functions.text import search
from sidematch.operators import align, blocks, pages, pairing, rollup, stats
from sidematch.operators.fuzzy import NAME_THRESHOLD, fuzzy_pairs
from sidematch.operators.pages import non_blank
from sidematch.operators.scan import CHUNK, Chunk, number_rows, spread_join
from sidematch.session import materialize
from sidematch.sources import rules as rule_columns
from sidematch.sources.keyed import parse_keyed_rows
from sidematch.sources.reports import explode_lines, read_file, read_lines, read_reports, slice_width
from sidematch.sources.rules import Rule, resolve_rules
from sidematch.sources.sinks import pair_name, unique_names, write_manifest, write_result

PAIR = ["pair_id"]
SIDES = ["side", "pair_id", "rule_no"]


@dataclass(frozen=True)
class Options:
    ignore_dates: bool = False
    ignore_lines: Sequence[str] = ()
    fuzzy: bool = False
    fuzzy_threshold: float = NAME_THRESHOLD
    transactions: bool = False
    extract: bool = False
    semantic: bool = False
    keep_blank: bool = False
    page_diffs: bool = False
    part_diffs: bool = False
    stream_long: bool = False
    context: int = align.CONTEXT


@dataclass(frozen=True)
class Comparison:
    """Result tables.  All but ``extracts``, ``folder`` and ``dashboard`` have a
    ``pair_id``; those not asked for, or that no rule asks for, are None.

    ``status_counts`` has a row per pair and kind of part (page, section, transaction,
    summary, row); ``part_diff_rows`` the diff rows of every part but rows that is on both
    sides and differs, named by ``part`` and A's ``part_no``.
    """

    pairs: DataFrame
    summary: DataFrame
    pages: DataFrame
    sections: DataFrame
    transactions: DataFrame | None
    summary_sections: DataFrame | None
    rows: DataFrame | None
    extracts: DataFrame | None
    align: Callable[[], tuple[DataFrame, DataFrame]]
    page_diff_rows: DataFrame | None
    status_counts: DataFrame
    part_diff_rows: DataFrame | None
    folder: DataFrame
    dashboard: DataFrame

    @cached_property
    def _aligned(self) -> tuple[DataFrame, DataFrame]:
        return self.align()

    @property
    def diff_rows(self) -> DataFrame:
        """Diff rows of the pairs that differ, which are aligned when this is first asked for."""
        return self._aligned[0]

    @property
    def unified_diff(self) -> DataFrame:
        return self._aligned[1]


def pair_up(docs: DataFrame, options: Options) -> DataFrame:
    """``pair_id, doc_a, doc_b, file_a, file_b, match_type, name_ratio, pair_name,
    error`` for pairs and unmatched documents of ``docs`` (both sides)."""
    said = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    as_lines = F.col("long") if "long" in docs.columns else F.lit(False)
    bad = F.when(F.col("text").isNull() & ~as_lines, F.coalesce(said, F.lit("text could not be read")))
    named = docs.select("side", "doc_id", "match_name", "file_name", bad.alias("bad"))
    a, b = (named.where(F.col("side") == s).drop("side") for s in "AB")
    found = pairing.pair_docs(a, b).withColumn(
        "name_ratio", F.when(F.col("match_type") == "exact", F.lit(1.0))
    ).drop("match_name")
    if options.fuzzy:
        found = materialize(found)
        only_a = found.where("match_type = 'only_in_a'").select("doc_a").join(
            a.select(F.col("doc_id").alias("doc_a"), F.col("match_name").alias("name_a")), "doc_a")
        only_b = found.where("match_type = 'only_in_b'").select("doc_b").join(
            b.select(F.col("doc_id").alias("doc_b"), F.col("match_name").alias("name_b")), "doc_b")
        similar = fuzzy_pairs(
            only_a.select(F.col("name_a").alias("name")), only_b.select(F.col("name_b").alias("name")),
            options.fuzzy_threshold,
        )
        similar = materialize(similar.join(only_a, "name_a").join(only_b, "name_b").select(
            "doc_a", "doc_b", F.lit("fuzzy").alias("match_type"), F.col("ratio").alias("name_ratio")
        ))
        alone = found.where("match_type <> 'exact'")
        alone = alone.join(similar.select("doc_a"), "doc_a", "left_anti").join(
            similar.select("doc_b"), "doc_b", "left_anti")
        found = found.where("match_type = 'exact'").unionByName(alone).unionByName(similar)

    def attributes(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            F.col("doc_id").alias(f"doc_{tag}"), F.col("file_name").alias(f"file_{tag}"),
            F.col("bad").alias(f"_bad_{tag}"),
        )

    out = found.join(attributes(a, "a"), "doc_a", "left").join(attributes(b, "b"), "doc_b", "left")
    out = out.withColumns(
        {
            "pair_id": F.when(F.col("doc_a").isNull(), F.concat(F.lit("B:"), "doc_b")).otherwise(
                F.concat(F.lit("A:"), "doc_a")
            ),
            "pair_name": pair_name(F.col("file_a"), F.col("file_b"), F.col("match_type")),
            "error": F.coalesce("_bad_a", "_bad_b"),
        }
    ).drop("_bad_a", "_bad_b")
    return unique_names(out)


def parse(
    docs: DataFrame, rules: Sequence[Rule], ignore: Sequence[str] = (), chunk: Chunk = CHUNK,
    lines: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(pages, repeating)`` of documents ``side, pair_id, rule_no, text``: page lines
    with ``pos, line_no, line, page_no, role`` and the columns of ``page_sections``, which body
    lines alone have a use for, and the repeating headers and footers.
    Lines to ignore leave the body (role ``ignored``) after headers and footers are
    found.  ``lines`` (``side, pair_id, rule_no, line_no, line``) are of documents too long
    for a cell: they have pages by their rule's split pattern, or are one page."""
    split = rule_columns.split_value(rules)
    cut = rule_columns.has(rules, "split_pattern")
    delimited, valued = True, split is not None
    if chunk is None and lines is None and valued:
        # pages of one kind leave the lines of a document where both uses below look for them
        valued = not docs.where(cut).isEmpty()
        delimited = not valued or not docs.where(~cut).isEmpty()
    parts = pages.pages_by_delimiter(docs.where(~cut), SIDES) if delimited else None
    if valued:
        cut_lines = explode_lines(docs.where(cut), SIDES)
        if lines is not None:
            cut_lines = cut_lines.unionByName(lines.where(cut))
        by_value = pages.pages_by_value_change(
            cut_lines.withColumn("pos", F.col("line_no")), split, SIDES, "pos", chunk)
        parts = by_value if parts is None else parts.unionByName(by_value, allowMissingColumns=True)
    if lines is not None:
        whole = (lines if split is None else lines.where(~cut)).withColumns({"pos": F.col("line_no"), "page_no": F.lit(1)})
        parts = parts.unionByName(whole)
    if chunk is not None or (delimited and valued):
        parts = materialize(parts)
    separator = rule_columns.separator(rules)
    repeating = materialize(pages.repeating_lines(parts, separator, SIDES, "pos", chunk=chunk))
    roles = pages.strip_repeating(parts, repeating, separator, SIDES, "pos", chunk=chunk)
    ignored = F.lit(False)
    for p in ignore:
        ignored = ignored | search(F.col("line"), p)
    if ignore:
        role = F.when((F.col("role") == "body") & ignored, "ignored").otherwise(F.col("role"))
        roles = roles.withColumn("role", role)
    sections = pages.page_sections(roles, SIDES, "pos", chunk, among=F.col("role") == "body")
    return materialize(sections), repeating


def compare(
    docs: DataFrame, rules: Sequence[Rule] = (), options: Options = Options(),
    lines: DataFrame | None = None,
) -> Comparison:
    """Compare side A of ``docs`` (``side, doc_id, file_name, match_name, text``) with
    side B.  The rules of a pair are those of its A file.  Documents marked ``long`` have
    no text but ``lines`` (``side, doc_id, line_no, line``)."""
    normalize = mask_dates if options.ignore_dates else None
    if lines is None:
        docs = docs.drop("long")
    pairs = materialize(pair_up(docs, options))
    ready = resolve_rules(pairs.where("match_type IN ('exact', 'fuzzy') AND error IS NULL"), rules, "file_a")
    ready = ready.withColumn("rule_no", F.coalesce("rule_no", F.lit(0)))
    members = ready.select("pair_id", "rule_no", F.explode(F.array(
        F.struct(F.lit("A").alias("side"), F.col("doc_a").alias("doc_id")),
        F.struct(F.lit("B").alias("side"), F.col("doc_b").alias("doc_id")),
    )).alias("_m")).select("pair_id", "rule_no", "_m.*")
    texts = docs.select("side", "doc_id", "text").join(members, ["side", "doc_id"])
    # written once: the texts are measured, cut by two kinds of rules, and listed
    texts = materialize(texts.select(*SIDES, "text"))

    if lines is not None:
        lines = spread_join(lines, members, ["side", "doc_id"], "line_no", CHUNK, "inner").select(*SIDES, "line_no", "line")
    chunk = CHUNK if lines is not None else slice_width(texts)
    paged, repeating = parse(texts, rules, options.ignore_lines, chunk, lines)
    section_lines = paged.where("role = 'body'").drop("role")
    body = section_lines.drop("section_id", "section_title", "is_marker")
    filled = non_blank(body)
    groups = ready.select("pair_id")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.where(F.col("side") == tag).drop("side")

    content = materialize(stats.line_stats(side(filled, "A"), side(filled, "B"), PAIR, normalize, groups))
    if options.semantic:
        similar = stats.text_cosine(side(filled, "A"), side(filled, "B"), PAIR, "pos", chunk=chunk)
        content = materialize(content.join(similar, PAIR, "left").fillna(0.0, ["text_similarity"]))

    section_list = materialize(pages.section_list(section_lines, texts, SIDES, chunk))
    sections = materialize(rollup.compare_sections(
        side(section_list, "A"), side(section_list, "B"), side(section_lines, "A"),
        side(section_lines, "B"), PAIR, "pos", normalize, options.semantic, chunk,
    ))
    page_results = rollup.compare_pages(side(paged, "A"), side(paged, "B"), PAIR, normalize)
    page_diff_rows = None
    if options.page_diffs:
        page_results = materialize(page_results)
        page_diff_rows = align.part_diffs(
            side(filled, "A"), side(filled, "B"), page_results, ["pair_id", "page_no"], "line_no",
            normalize, options.context, chunk,
        )
    summary = materialize(rollup.pair_summary(
        paged, body, section_list, repeating, content, sections, PAIR
    ))

    transactions = summary_sections = rows = None
    sort_key = rule_columns.sort_key(rules)
    owned = filled
    if sort_key is not None and options.transactions:
        owned = materialize(blocks.transactions(
            filled, sort_key, rule_columns.max_lines(rules), SIDES, "pos", chunk,
            keep_unowned=True, has_blanks=False,
        ))
        txns = owned.where(F.col("txn_id").isNotNull())
        transactions = pairing.compare_transactions(
            side(txns, "A"), side(txns, "B"), PAIR, "pos", normalize, chunk
        )
    separator = rule_columns.separator(rules)
    if separator is not None:
        base = owned.where(rule_columns.has(rules, "separator_pattern"))
        found = materialize(blocks.summary_sections(base, separator, SIDES, "pos", chunk))
        summary_sections = rollup.compare_summary_sections(side(found, "A"), side(found, "B"), PAIR, normalize)
    keys = rule_columns.by_rule(
        rules, lambda r: key_parts(F.col("line"), r.key_slices) if r.key_slices else None
    )
    view, header = filled, None
    if keys is not None:
        keyed = filled.where(rule_columns.has(rules, "key_slices"))
        parsed, header = parse_keyed_rows(keyed, keys, rule_columns.has(rules, "has_header"), SIDES, "pos")
        parsed = materialize(parsed.select("side", "pair_id", "key", "pos", "sort_vals", "line"))
        rows = materialize(pairing.compare_rows(
            side(parsed, "A"), side(parsed, "B"), ["pair_id", "key"], "pos", normalize,
            chunk=chunk,
        ))
        view = filled.where(~rule_columns.has(rules, "key_slices"))
    if options.keep_blank:
        view = body.where(~rule_columns.has(rules, "key_slices"))

    # Only pairs that differ are aligned.
    parts = _Parts(side, chunk)
    parts.add("page", page_results, F.col("page_no"), filled.withColumn("part_no", F.col("page_no")))
    parts.add("section", sections, F.col("ordinal_a"), _numbered_by_a(
        non_blank(section_lines.where(~F.col("is_marker"))), sections, "section_id", "ordinal", "pos", chunk))
    if transactions is not None:
        order = _transaction_pairs(txns, chunk)
        parts.add("transaction", transactions.join(order, ["pair_id", "sort_key", "occ"], "left"), F.col("ordinal_a"),
                  _numbered_by_a(txns, order, "txn_id", "ordinal", "pos", chunk))
    if summary_sections is not None:
        parts.add("summary", summary_sections, F.col("block_no"), found.withColumn("part_no", F.col("block_no")))
    if rows is not None:
        parts.add("row", rows, None, None)

    differing = stats.changed(content).select("pair_id")
    view = view.join(differing, PAIR, "left_semi").select("side", "pair_id", "pos", "line_no", "line")

    def aligned() -> tuple[DataFrame, DataFrame]:
        indexed = materialize(align.index_lines(view, ["side", "pair_id"], "pos", chunk).drop("pos"))
        a, b = side(indexed, "A"), side(indexed, "B")
        ops = materialize(align.align_lines(a, b, PAIR, normalize, chunk))
        pieces = materialize(align.hunk_pieces(ops, PAIR, options.context, chunk))
        unified = align.unified_diff(pieces, a, b, PAIR, chunk)
        diffs = align.diff_rows(ops, a, b, PAIR, "line_no", options.context, chunk)
        if rows is not None:
            ordered = align.in_key_order(rows.join(differing, PAIR, "left_semi"), PAIR)
            heads = align.header_rows(header, PAIR)
            diffs = diffs.unionByName(align.sorted_diff(ordered, PAIR, "place", normalize, chunk, heads))
        return diffs, unified

    everything = pairs.join(summary.select("pair_id", "similarity_ratio"), PAIR, "left")
    return Comparison(
        pairs=pairs, summary=summary, pages=page_results, sections=sections,
        transactions=transactions, summary_sections=summary_sections, rows=rows,
        extracts=extract(docs, rules, options.ignore_lines) if options.extract else None,
        align=aligned, page_diff_rows=page_diff_rows,
        status_counts=parts.counts(), part_diff_rows=parts.diffs(normalize, options.context) if options.part_diffs else None,
        folder=rollup.folder_summary(everything),
        dashboard=rollup.dashboard(everything),
    )


class _Parts:
    """Results and lines of all kinds of parts, so that one plan counts and aligns them."""

    def __init__(self, side, chunk: Chunk):
        self.side, self.chunk = side, chunk
        self.results, self.lines = [], []

    def add(self, part: str, results: DataFrame, part_no, lines: DataFrame | None) -> None:
        number = F.lit(None).cast("long") if part_no is None else part_no.cast("long")
        self.results.append(results.select(
            "pair_id", F.lit(part).alias("part"), number.alias("part_no"), "status", "similarity_ratio"))
        if lines is not None:
            self.lines.append(lines.select(
                "side", "pair_id", F.lit(part).alias("part"), F.col("part_no").cast("long").alias("part_no"),
                "pos", "line_no", "line"))

    def counts(self) -> DataFrame:
        return rollup.status_counts(_union(self.results), ["pair_id", "part"])

    def diffs(self, normalize, context: int) -> DataFrame:
        lines, by = _union(self.lines), ["pair_id", "part", "part_no"]
        return align.part_diffs(
            self.side(lines, "A"), self.side(lines, "B"), _union(self.results), by, "line_no", normalize, context, self.chunk)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _numbered_by_a(lines: DataFrame, pairs: DataFrame, own: str, ordinal: str, pos: str, chunk: Chunk) -> DataFrame:
    """Lines of paired parts of both sides with ``part_no``, the number of A's part."""
    def numbers(tag: str) -> DataFrame:
        both = pairs.where(F.col(f"{ordinal}_a").isNotNull() & F.col(f"{ordinal}_b").isNotNull())
        return both.select(F.lit(tag).alias("side"), "pair_id", F.col(f"{ordinal}_{tag.lower()}").alias(own),
                           F.col(f"{ordinal}_a").alias("part_no"))

    return spread_join(lines, numbers("A").unionByName(numbers("B")), ["side", "pair_id", own], pos, chunk, "inner")


def _transaction_pairs(txns: DataFrame, chunk: Chunk) -> DataFrame:
    """``pair_id, sort_key, occ, ordinal_a, ordinal_b``: transactions of both sides, the
    k-th of a sort key with the k-th."""
    each = txns.groupBy("side", "pair_id", "sort_key", "txn_id").agg(F.lit(1).alias("_one"))
    each = number_rows(each, ["side", "pair_id", "sort_key"], "txn_id", "occ", chunk)
    return each.groupBy("pair_id", "sort_key", "occ").agg(
        F.max(F.when(F.col("side") == "A", F.col("txn_id"))).alias("ordinal_a"),
        F.max(F.when(F.col("side") == "B", F.col("txn_id"))).alias("ordinal_b"))


def extract(
    docs: DataFrame, rules: Sequence[Rule], ignore: Sequence[str] = ()
) -> DataFrame | None:
    """The transactions of every document of both sides, paired or not, by its own rule:
    ``extract_name, sort_key, line`` and what orders them (``sort_val, txn_id, pos``).
    None when no rule has a sort pattern."""
    sort_key = rule_columns.sort_key(rules)
    if sort_key is None:
        return None
    own = resolve_rules(docs, rules).withColumn("rule_no", F.coalesce("rule_no", F.lit(0)))
    own = own.where(rule_columns.has(rules, "sort_pattern")).withColumn("pair_id", F.col("doc_id"))
    parsed, _ = parse(own.select(*SIDES, "text"), rules, ignore)
    filled = non_blank(parsed.where("role = 'body'"))
    found = blocks.transactions(
        filled, sort_key, rule_columns.max_lines(rules), SIDES, "pos",
        CHUNK, has_blanks=False,
    )
    alone = pair_name(F.col("file_name"), F.lit(""), F.lit("exact"))
    names = own.select("side", "pair_id", F.concat_ws("_", "side", alone).alias("extract_name"))
    return blocks.extract_transactions(found).join(names, ["side", "pair_id"]).select(
        "extract_name", "sort_val", "txn_id", "pos", "sort_key", "line"
    )


def compare_folders(
    spark: SparkSession,
    folder_a: str,
    folder_b: str,
    rules: Sequence[Rule] = (),
    options: Options = Options(),
    exts: Sequence[str] = (".txt",),
    max_bytes: int | None = None,
) -> Comparison:
    """Compare the report files of two folders.

    A file that cannot be read, or is longer than ``max_bytes``, leaves an ``error`` at its
    pair in ``pairs`` and is counted in ``folder``; all other pairs are compared.  With
    ``stream_long`` over-long files are read line by line over many tasks and compared too
    (in pages if their rule has a split pattern; they give no extract).
    """
    docs = read_reports(spark, folder_a, "A", exts, max_bytes).unionByName(
        read_reports(spark, folder_b, "B", exts, max_bytes))
    return _compare_read(docs, {"A": folder_a, "B": folder_b}, rules, options)


def _compare_read(docs: DataFrame, folders: dict[str, str], rules: Sequence[Rule], options: Options) -> Comparison:
    # the files are read once; whatever fails, fails here
    docs, lines = materialize(docs), None
    if options.stream_long:
        # as many rows as there are over-long files
        for side, folder in folders.items():
            names = [r["file_name"] for r in docs.where((F.col("side") == side) & F.col("long")).select("file_name").collect()]
            if names:
                paths = [f"{folder.rstrip('/')}/{re.sub(r'([][{}*?\\])', r'\\\1', n)}" for n in names]
                more = read_lines(docs.sparkSession, paths, side)
                lines = more if lines is None else lines.unionByName(more)
    return compare(docs, rules, options, lines)


def compare_files(
    spark: SparkSession,
    file_a: str,
    file_b: str,
    rules: Sequence[Rule] = (),
    options: Options = Options(),
    max_bytes: int | None = None,
) -> Comparison:
    """Compare two report files, whatever their names and extensions."""
    a, b = read_file(spark, file_a, "A", max_bytes), read_file(spark, file_b, "B", max_bytes)
    docs = a.unionByName(b).withColumn("match_name", F.lit("pair"))
    folders = {"A": file_a.rsplit("/", 1)[0], "B": file_b.rsplit("/", 1)[0]}
    return _compare_read(docs, folders, rules, options)


def write_results(result: Comparison, path: str) -> None:
    """The CSV results below ``path``: one folder per kind and in it one per pair.

    ``manifest`` is written last, with a row per kind and pair: results it does not list
    are of a run that did not end.
    """
    kinds = []
    named = result.pairs.where(F.col("pair_name").isNotNull()).select("pair_id", "pair_name")

    def out(df: DataFrame, kind: str, order: list, columns: list[str]) -> None:
        joined = df.join(named, PAIR)
        hidden = [c.alias(f"_o{i}") for i, c in enumerate(order)]
        rows = joined.select("pair_name", *columns, *hidden)
        kinds.append((kind, "pair_name"))
        write_result(rows, f"{path}/{kind}", "pair_name", [F.col(f"_o{i}") for i in range(len(order))])

    if result.transactions is not None:
        txns = pairing.txn_result(result.transactions, ["pair_id", "sort_val"])
        out(txns, "transactions", [F.col("sort_val"), F.col("sort_key"), F.col("occ")],
            ["sort_key", "status", "similarity_pct", "lines_added", "lines_deleted"])
    if result.summary_sections is not None:
        sections = pairing.section_result(result.summary_sections, PAIR)
        out(sections, "sections", [F.col("block_no")],
            ["section_name", "status", "similarity_pct", "lines_added", "lines_deleted"])
    if result.rows is not None:
        order = F.coalesce("sort_vals_a", "sort_vals_b")
        rows = pairing.keyed_result(result.rows.withColumn("sort_vals", order), ["pair_id", "sort_vals"])
        out(rows, "rows", [F.col("sort_vals"), F.col("key"), F.col("occ")],
            ["key", "status", "similarity_pct", "lines_added", "lines_deleted"])
    if result.extracts is not None:
        hidden = [F.col(c).alias(f"_{c}") for c in ("sort_val", "txn_id", "pos")]
        rows = result.extracts.select("extract_name", "sort_key", "line", *hidden)
        order = ["_sort_val", "_txn_id", "_pos"]
        write_result(rows, f"{path}/extracts", "extract_name", order, header=False)
        kinds.append(("extracts", "extract_name"))
    write_manifest(named.sparkSession, path, kinds)
