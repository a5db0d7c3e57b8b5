"""Columns whose names an operator uses itself pass through it; what odd archives hold is read."""

import gzip

import pytest
from pyspark.sql import functions as F

from postlens.llm import (
    decontaminate,
    language_id,
    lm_score,
    minhash,
    quality,
    substring_dedup,
    suffix_dedup,
    warc,
)

ODD = ["stats", "text_hash", "__id", "__t", "__w", "rest", "key", "c0", "label", "gone", "hits", "chunk"]


@pytest.fixture(scope="module")
def odd(spark, prose):
    rows = [(i, prose(40, i % 5), "en" if i % 2 else "de") for i in range(12)]
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, lang string")
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(ODD)))


def kept_columns(df, docs):
    assert [c for c in df.columns if c in ODD] == ODD
    values = df.select(*(f"`{c}`" for c in ODD)).distinct().collect()
    assert [tuple(r) for r in values] in ([tuple(range(len(ODD)))], [])
    return df


def test_row_operators(spark, odd, prose):
    model = language_id.train(odd)
    assert kept_columns(language_id.predicted(odd, model), odd).count() == 13
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rules = quality.train(odd, labels)
    assert kept_columns(quality.scored(odd, rules), odd).count() == 13
    items = spark.createDataFrame([(1, prose(40, 3))], "item_id long, text string")
    left = kept_columns(decontaminate.clean(odd, items), odd)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [
        i for i in range(12) if i % 5 != 3]
    left = kept_columns(minhash.without_near_copies(odd), odd)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == list(range(5))


def test_chunk_operators(odd):
    for out in (suffix_dedup.dedup(odd), substring_dedup.dedup(odd), lm_score.scored(odd)):
        assert kept_columns(out, odd).count() == 13


def test_numerals_are_no_letters():
    assert not any(map(language_id.has_letter, ["½ ²", "Ⅷ", "12_", "", "漢"[:0]]))
    assert all(map(language_id.has_letter, ["½a", "漢", "ß", "12 й"]))


def record(kind, block, more=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\n{more}" \
           f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    body = b"<html>" + b"x" * 3_000_000
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    records = [record("warcinfo", b"software: s"), record("conversion", b"plain"),
               record("response", http + body, "Content-Type: application/http; msgtype=response\r\n"),
               record("response", b"dns", "Content-Type: text/dns\r\n"),
               record("revisit", http), record("metadata", b"")]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "notes.txt").write_text("no archive")
    want = sorted([("warcinfo", 11, b"software: s"), ("conversion", 5, b"plain"), ("response", len(body), body),
                   ("response", 3, b"dns"), ("revisit", None, None), ("metadata", 0, b"")] * 2, key=repr)

    def rows(path, payload=True):
        return [(r.record_type, r.payload_length, r.payload and bytes(r.payload) if payload else None)
                for r in warc.read(spark, str(path), payload).collect()]

    got = rows(tmp_path)
    assert sorted([(k, n, b"" if n == 0 else p) for k, n, p in got], key=repr) == want
    assert sorted(rows(tmp_path, payload=False), key=repr) == sorted([(k, n, None) for k, n, _ in want], key=repr)
    assert len(rows(tmp_path / "b.warc")) == 6
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no .warc"):
        rows(tmp_path / "none")
