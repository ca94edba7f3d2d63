"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
import public_tokenizers

import corpus_pipeline
from sidematch.llm import decontam, jaccard_join, langid, license, lm_score, packing, quality, urls, warc

WORDS = "the cat sat on a mat and the dog ran to 12 houses with Anna Smith near Berlin in 5 km of road"
TEXTS = [None, "", " \n\t", "12 34", "Word", WORDS, WORDS, WORDS.replace("12", "90").replace("Anna Smith", "Bob Jones"),
         "x" * 200_000, "a b " * 3000, "Licensed under the Apache License, Version 2.0.", "le chat noir est sur la table de la maison " * 3]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, host string, score double, label long, hot string, _id long, _h string"


def docs_of(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b"][i % 3], 1, "h", 0.5, 1, "x", 7, "y") for i, t in enumerate(texts)]
    rows += [(None, "lost id", *[None] * 9)] * 2 + rows[-1:] if texts else []
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(params=["rows", "empty", "null"])
def docs(request, spark):
    return docs_of(spark, {"rows": TEXTS, "empty": [], "null": [None, None]}[request.param])


def test_row_per_document(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    n = docs.count()
    assert lm_score.score(docs, labels).count() == n
    assert quality.judge(docs).count() == n
    assert langid.identify(docs).count() == n
    assert jaccard_join.join(docs).count() == n
    files = docs.withColumnRenamed("doc_id", "file_id").withColumn("path", docs["source"])
    assert license.scan(files).count() == n


def test_stages_keep_columns(spark, docs):
    items = spark.createDataFrame([(1, WORDS), (2, None), (3, "short")], "item_id long, text string")
    assert quality.keep_good(docs).schema == docs.schema
    assert quality.keep_good(docs).count() <= docs.count()
    assert langid.keep_identified(docs).columns == docs.columns
    langid.keep_identified(docs).collect()
    assert jaccard_join.keep_one(docs).columns == docs.columns
    jaccard_join.keep_one(docs).collect()
    assert decontam.drop_contaminated(docs, items).columns == docs.columns
    decontam.drop_contaminated(docs, items).collect()


def test_templates(spark):
    items = spark.createDataFrame([(1, WORDS), (2, None), (3, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.slots_changed) for r in decontam.find(docs_of(spark, TEXTS), items).collect()}
    assert got == {(5, 1, False), (6, 1, False), (7, 1, True)}
    # one value replaced by two different ones is another text
    other = [WORDS + " and 12 more", WORDS + " and 13 more"]
    items = spark.createDataFrame([(1, other[0])], "item_id long, text string")
    assert {r.doc_id for r in decontam.find(docs_of(spark, other), items).collect() if r.doc_id is not None} == {0}


def test_quality_numbers():
    assert quality.measure(None) == quality.measure("") == (0, 0, 0, 0, 0)
    assert quality.measure("a b\na b\n\n \nc# d") == (6, 7, 1, 1, 0)
    assert quality.measure("a b c d e f a b c d e")[4] == 10


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "http://A.org/x?y", "<p>é</p>"), (3, "no scheme", ""), (3, "no scheme", ""),
                                       (4, "https://x.example.org/es/1\r\n#t", "<p>é</p>"), (9, "http://b.com", "z" * 100_000)]])
def test_pages(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge(pages.withColumn("host", pages["url"]))
    assert got.count() == len(rows)
    by_id = {r.page_id: r for r in got.collect()}
    if rows:
        assert (by_id[None].host, by_id[None].path, by_id[None].rule, by_id[None].verdict) == ("a.org", "/x", "org/", "allow")
        assert (by_id[4].rule, by_id[4].verdict) == ("example.org/es/", "block")
        assert (by_id[9].host, by_id[9].path, by_id[9].rule) == ("b.com", "", None)
        assert (by_id[1].host, by_id[1].path) == ("", "")
    records = warc.read(spark, warc.write(pages), range_bytes=100).collect()
    assert len(records) == len(rows)
    found = sorted((str(r.page_id), r.record_type, r.payload_bytes, str(r.refers_to), str(r.uri)) for r in records)
    if rows:
        assert found == sorted([
            ("1", "revisit", 0, "3", "None"), ("3", "response", 0, "None", "no scheme"), ("3", "response", 0, "None", "no scheme"),
            ("None", "revisit", 9, "4", "http://A.org/x?y"), ("4", "response", 9, "None", "https://x.example.org/es/1\r\n#t"),
            ("9", "response", 100_000, "None", "http://b.com")])


def test_pipeline_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "language_id", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
