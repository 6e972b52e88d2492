"""WARC files read back, and language profiles against a plain computation."""

from __future__ import annotations

import gzip
import zlib

import numpy as np

from fieldtally.llm import language, warc
from fieldtally.session import scratch_path


def test_written_records_are_read_back(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>One\r\n\r\ntwo</p>é"), (2, None, None), (3, "u", "<title>t</title>")], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages)).drop("page_id").repartition(1).persist()
    folder = scratch_path(spark, "warc_read")
    warc.write_warc(records, folder)
    names = [c for c in records.columns if c != "target_uri"]
    found = warc.read_warc(spark, folder)
    assert found.where("not complete").count() == 0
    show = lambda df: sorted(tuple(r) for r in df.select(*names).collect())
    want = [tuple(r) for r in records.select(*names).collect()]
    assert show(found) == sorted(want) and len(want) == 6


def record(kind, name, block, length=None, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:{name}>\r\nWARC-Date: 2021-05-0{name}T00:00:00Z\r\n{extra}Content-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_derivatives_keep_dates_and_headers_of_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>one</p>\xff"
    parts = [
        record("warcinfo", 1, b"software: y\r\n"), record("response", 2, body, extra="WARC-Target-URI: http://a/\r\n"), record("response", 3, b"no headers"),
        record("response", 4, b"HTTP/1.1 200 OK\r\n\r\ncut", length=50), record("response", 5, b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    found = warc.read_warc(spark, str(tmp_path))
    assert sorted((r.record_type, r.record_id[5:6], r.complete) for r in found.collect()) == [
        ("response", "2", True), ("response", "3", True), ("response", "4", False), ("response", "5", True), ("warcinfo", "1", True),
    ]
    got = {r.page_id: r for r in warc.responses_in(found).collect()}
    two = got["<urn:2>"]
    assert (two.target_uri, two.date, two.headers) == ("http://a/", "2021-05-02T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: x\r\n")
    assert (got["<urn:3>"].headers, got["<urn:3>"].payload, got["<urn:5>"].payload) == ("", "no headers", "")
    made = {(r.page_id, r.record_type): r for r in warc.derivatives(warc.responses_in(found)).collect()}
    assert len(made) == 8 and made["<urn:2>", "metadata"].date == "2021-05-02T00:00:00Z"
    assert "http-header: Server: x" in made["<urn:2>", "metadata"].block and made["<urn:2>", "conversion"].refers_to == "<urn:2>"


def bundle_of(text, letters):
    signs = []
    for c in text:
        sign = ord(c.lower()[0]) if c.isalpha() else 0
        if sign or not signs or signs[-1]:
            signs.append(sign)
    out = np.zeros(letters.dimensions)
    for a, b, c in zip(signs, signs[1:], signs[2:]):
        out += np.roll(letters.vector(a), 2) * np.roll(letters.vector(b), 1) * letters.vector(c)
    return out


def test_language_against_plain_profiles(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet").where("length(text) < 2000")
    rows = docs.collect()
    letters, sums = language.Letters(language.DIMENSIONS), {}
    bundles = {r.doc_id: bundle_of(r.text, letters) for r in rows if r.text is not None}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            v = bundles[r.doc_id]
            sums[r.lang] = sums.get(r.lang, 0) + v / max(np.linalg.norm(v), 1e-9)
    names = sorted(sums)
    protos = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    found = {r.doc_id: r for r in language.identify(docs, language.prototypes(docs)).collect()}
    assert len(found) == len(rows) > 100
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        v = bundles[r.doc_id]
        cosine = protos @ v / max(np.linalg.norm(v), 1e-9)
        assert abs(found[r.doc_id].score - min(max(cosine.max(), 0), 1)) < 1e-3
        best = np.sort(cosine)[::-1]
        assert found[r.doc_id].lang_pred == names[cosine.argmax()] or best[0] - best[1] < 1e-3


def test_language_with_repeated_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (5, "the dog", None), (None, "der hund", "de"), (7, "der hund " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", language.F.lit("mine"))
    out = language.identify(docs, language.prototypes(docs))
    assert out.count() == 6 and {r.lang_pred for r in out.where("doc_id = 1").collect()} <= {"en", "de"}
    assert language.identify(docs.limit(0), language.prototypes(docs)).count() == 0
