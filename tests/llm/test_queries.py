"""The registered queries on the given tables, against SQL, the library, or a plain version."""

import hashlib
import os
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.compare import duck, rows_of
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of([d[0] for d in found.description], found.fetchall())


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for row in QUERIES["op2_bpe"](spark, SF).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(row) == (row.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(decoded))


def measures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), failed,
    )


def test_quality_measures_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in QUERIES["op4_quality"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == measures(d.text or "")
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in rows.items() if i in labels and not r.base_failed]
    assert sum(q == k for q, k in judged) >= 0.95 * len(judged)


def test_language_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = QUERIES["op6_language"](spark, SF).join(docs, "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_mix_comes_near_its_targets(spark):
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    again = QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    per = {}
    for r in rows:
        per.setdefault(docs[r.doc_id], []).append(r)
        assert r.taken <= 3 * r["size"]
    total = sum(r["size"] for r in rows)
    assert sum(v[0].target for v in per.values()) == pytest.approx(total)
    for found in per.values():
        miss = abs(sum(r.taken for r in found) - found[0].target)
        assert miss <= max(r["size"] for r in found) and found[0].target <= 3 * found[0].source_size


def test_archive_records_are_whole(spark):
    from tidemark.llm import warc

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1_000_000))
    folder = warc.archive_of(twice)
    html = {r.page_id: r.html or "" for r in pages.collect()}
    found = {r.page_id: bytes(r.record) for r in warc.records(spark, folder).collect()}
    assert len(found) == 2 * len(html)
    for page, text in html.items():
        head, _, body = found[page].partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert body[:length].endswith(text.encode()) and body[length:] == b"\r\n\r\n"
        assert b"WARC-Type: response" in head
        if len(text.encode()) >= 100:
            assert f"WARC-Refers-To: <urn:page:{page}>".encode() in found[page + 1_000_000]
    assert spark.read.parquet(f"{folder}/payloads").count() == len(set(html.values()))


def test_warc_refuses_a_record_that_contradicts_its_bytes(spark):
    import pytest

    from tidemark.llm import warc

    pages = spark.createDataFrame([(1, "u", "p" * 120), (2, "a: b", "p" * 120)], "page_id long, url string, html string")
    found = {r.page_id: bytes(r.record) for r in warc.records(spark, warc.archive_of(pages)).collect()}
    assert warc.parse_record(found[1])[0::5] == (1, 120)
    assert warc.parse_record(found[2])[1:3] == ("a: b", "revisit") and warc.parse_record(found[2])[4:] == (1, None)
    for broken in (found[1].replace(b"ppp", b"ppq", 1), found[1][:-1], found[1].replace(b"sha256:", b"sha256:0")):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def test_warc_notices_a_payload_that_is_missing_or_changed(spark):
    import pytest

    from tidemark.llm import warc

    pages = spark.createDataFrame([(i, "u", c * 120) for i, c in enumerate("ab")], "page_id long, url string, html string")
    folder = warc.archive_of(pages)
    stored = spark.read.parquet(f"{folder}/payloads").toPandas()
    for payloads, what in ((stored.iloc[:1], "is missing"), (stored.assign(payload=stored["payload"].iloc[0]), "does not match")):
        other = folder + what.replace(" ", "")
        spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
        spark.createDataFrame(payloads, "digest string, payload binary").write.parquet(f"{other}/payloads")
        with pytest.raises(Exception, match=what):
            warc.read_archive(spark, other).count()
