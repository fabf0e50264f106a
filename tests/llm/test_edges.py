"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_queries import measures
from tidemark.llm import bpe, chat, jaccard, language, mixing, quality, recompression, suffixes, topk, warc

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size string, n string, cls string, doc string, tie string, _doc string, _tie string, root string, key string"
)
EXTRA = ("x",) * 9


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") + rng.choice("qrstuvwx") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base, passage = sentence(rng, 300), sentence(rng, 70)
    texts = [
        base, base, base.replace(base.split()[10], "new", 1), sentence(rng, 100) + "\n" + passage + "\n" + sentence(rng, 90),
        passage + " " + sentence(rng, 50), "", None, " \n\t ", "one two three", "one two three", "ÀB cd ÀB", "to to " * 400,
        sentence(rng, 30_000), ("ab cd ef gh " * 3 + "\n") * 9, sentence(rng, 49), "x" * 70_000, base.upper(),
        "a<|endoftext|>b 'S 　c\x1cd", "日本語 テキスト 123", "\ud83d".encode("utf-8", "replace").decode(),
    ]
    out = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None, *EXTRA) for i, t in enumerate(texts)]
    out += [(None, base, None, None, None, *EXTRA), (None, None, None, None, None, *[None] * 9), out[0], out[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def kept_words(rows, size):
    """Per distinct (id, text) its words, and which of them stay; a null id comes last."""
    order = sorted({(i is None, i or 0, t or "") for i, t, *_ in rows})
    seen, out = set(), {}
    for null, i, t in order:
        words = t.encode().split()
        keep = [True] * len(words)
        for a in range(len(words) - size + 1):
            w = tuple(words[a : a + size])
            if w in seen:
                keep[a : a + size] = [False] * size
            seen.add(w)
        out[(None if null else i, t)] = (len(words), len(words) - sum(keep))
    return out


@pytest.mark.parametrize("dedup, size", [(recompression.remove_repeats, 20), (suffixes.remove_repeats, 50)])
def test_repeats(spark, docs, rows, none, dedup, size):
    want = kept_words(rows, size)
    expected = sorted((str(i), *want[(i, t or "")]) for i, t, *_ in rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in dedup(docs, size).collect())
    assert got == expected
    assert dedup(none, size).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_repeats_of_rows_told_apart_by_text_only(spark, doc_id):
    """Two texts under one id whose hashes agree in their low 31 bits; only one of them holds a repeat."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, None, None, None), (doc_id, passage + " a6155", None, None, None), (doc_id, "b84401", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert df.select(F.pmod(F.xxhash64("text"), F.lit(2**31))).distinct().count() == 2
    for dedup, size in ((recompression.remove_repeats, 20), (suffixes.remove_repeats, 50)):
        got = sorted((r.n_words, r.n_removed) for r in dedup(df, size).collect())
        assert got == [(1, 0), (60, 0), (61, 60)]
    assert sorted(r.text for r in suffixes.clean_documents(df, 50).collect()) == sorted([passage, "a6155", "b84401"])


def test_repeats_of_random_texts(spark):
    """Few different words, so runs, overlaps and chance repeats abound."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("aab") for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += [t[: len(t) // 2] + " c " + t[len(t) // 3 :] for t in texts[:10]]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for dedup, size in ((recompression.remove_repeats, 20), (suffixes.remove_repeats, 50), (suffixes.remove_repeats, 20)):
        want = {i: kept_words(rows, size)[(i, t)] for i, t, *_ in rows}
        assert {r.doc_id: (r.n_words, r.n_removed) for r in dedup(df, size).collect()} == want


def test_neighbours_in_suffix_order_share_words_to_both_sides(monkeypatch, spark):
    """A passage inside different surroundings is found by its neighbour, without the last comparison."""
    rng = random.Random(3)
    passage = sentence(rng, 80)
    texts = [" ".join([sentence(rng, 40 + i), passage, sentence(rng, 60 - i)]) for i in range(8)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = []
    keep = suffixes.settle
    monkeypatch.setattr(suffixes, "settle", lambda df, name: found.append((name, keep(df, name))) or found[-1][1])
    suffixes.repeats(df.repartition(3), 50).count()
    compared = dict(found)["compared"]
    runs = compared.where("a is null").groupBy("doc").agg(F.sum("n").alias("n")).collect()
    assert len(runs) >= 5 and compared.where("a is not null").count() < 8 * 31 + 8 * 2 * 49
    assert all(r.doc > 0 for r in runs)


def test_common_words_of_neighbours():
    words, bounds = np.array([1, 2, 3, 1, 2, 5, 7, 5, 5], np.uint64), np.array([0, 3, 6, 7, 7, 8, 9])
    assert suffixes._common(words, bounds).tolist() == [2, 0, 0, 0, 1]
    column = suffixes._binary(words, np.diff(bounds))
    again, ends = suffixes._hashes(column.slice(1, 4))
    assert again.tolist() == [1, 2, 5, 7, 5] and ends.tolist() == [0, 3, 4, 4, 5]


def test_cut_texts_keep_the_rest(spark, docs, rows, none):
    out = suffixes.clean_documents(docs, 50)
    assert out.columns == docs.columns and suffixes.clean_documents(none, 50).count() == 0
    by_id = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    first = {i: t for i, t, *_ in rows if i is not None}
    assert by_id[3].text == first[3] and by_id[5].text == "" and by_id[6].text is None
    assert by_id[4].text == " ".join(first[4].split()[70:]) and by_id[4].n_chars == len(by_id[4].text)
    assert 1 not in by_id  # a copy loses every word


def similar(rows, share=75):
    sets = []
    for _, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(low[a : a + 5]) for a in range(max(1, len(low) - 4))} if low else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(doc), len(sets[i]), str(min(ids) if ids else doc)))
    return sorted(out)


def test_jaccard_components(spark, docs, rows, none):
    got = jaccard.linked_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == similar(rows)
    assert jaccard.linked_components(none).count() == 0


def test_jaccard_of_near_copies_around_the_threshold(spark):
    rng = random.Random(2)
    base = [sentence(rng, 120).split() for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append((i, " ".join(words[: rng.randint(95, 120)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.linked_components(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == similar(rows)


def test_one_document_of_each_group_stays(spark, docs, rows, none):
    out = jaccard.representatives(docs)
    assert out.columns == docs.columns and jaccard.representatives(none).count() == 0
    ids = sorted(str(r.doc_id) for r in out.collect())
    roots = [c for _, n, c in similar(rows) if n]
    empty = [str(i) for i, t, *_ in rows if not (t or "").encode().split()]
    assert ids == sorted([*set(roots), *empty])


def test_mixing(spark, docs, rows, none):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and mixing.mix(none).count() == 0
    assert all(r.taken == 0 for r in out if r["size"] == 0) and all(r.taken <= 3 * r["size"] for r in out)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_targets_stop_at_three_times_a_source(spark):
    docs = spark.createDataFrame(
        [(i, "w " * 100, s) for i, s in enumerate("a" * 50 + "b" * 5 + "c")], "doc_id long, text string, source string"
    )
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    # c stops at 300, b at 1500, a takes the rest.
    assert target == {"c": 300.0, "b": 1500.0, "a": 3800.0}


def test_quality(spark, docs, rows, none):
    out = quality.judged(docs).collect()
    got = sorted(
        (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out
    )
    assert got == sorted((str(i), *measures(t or "")) for i, t, *_ in rows)
    assert quality.judged(none).count() == 0


def test_quality_rules_outvote(spark):
    rng = random.Random(3)
    good = [(i, sentence(rng, 200).capitalize() + ".") for i in range(150)]
    noisy = [(1000 + i, " ".join(w + "%%%" for w in sentence(rng, 200).split())) for i in range(20)]
    loud = [(2000 + i, " ".join(w.upper() + "!!" for w in sentence(rng, 200).split())) for i in range(20)]
    df = spark.createDataFrame(good + noisy + loud, "doc_id long, text string")
    kept = {r.doc_id for r in quality.judged(df).where("kept").collect()}
    assert kept == {i for i, _ in good}


def test_language(spark, docs, none):
    model = language.train(docs, F.lit(False))
    out = {r.doc_id: r for r in language.predict(docs, model).where("doc_id is not null").collect()}
    assert out[6].lang_pred == "und" and out[7].lang_pred == "und" and out[0].lang_pred == "en"
    nothing = language.train(none, F.lit(False))
    assert nothing.langs == [] and language.predict(none, nothing).count() == 0
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    left = language.accepted(docs, model)
    assert left.columns == docs.columns and left.where("text is null").count() == 0


def test_bpe_edges(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = sorted(
        (str(i), (ids := library.encode(t or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False))
        for i, t, *_ in rows
    )
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in bpe.encode(docs, path).collect()) == want
    assert bpe.encode(none, path).count() == 0


def test_warc_edges(spark):
    page = "p" * 120
    rows = [(3, "u", page), (1, "a\r\nWARC-Type: bad", page), (1, "u", page), (None, None, page), (5, "u", None), (6, "u", ""),
            (7, "u", "short"), (8, "u", "short"), (None, "u", "q" * 200), (9, "u", "é" * 50), (10, "u", "é" * 50)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, header string")
    got = sorted(map(str, [tuple(r) for r in warc.read_archive(spark, warc.archive_of(pages)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]))
    want = [(3, 120, "revisit", 1), (1, 120, "response", None), (1, 120, "response", None), (None, 120, "revisit", 1),
            (5, 0, "response", None), (6, 0, "response", None), (7, 5, "response", None), (8, 5, "response", None),
            (None, 200, "response", None), (9, 100, "response", None), (10, 100, "revisit", 9)]
    assert got == sorted(map(str, want))
    assert warc.read_archive(spark, warc.archive_of(pages.limit(0))).count() == 0


def test_topk_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 700)]
    same = [(i, [1.0] * 8) for i in range(1000, 1400)]
    odd = [(2000, None), (2001, [None, 1.0]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2100, [2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + same + odd], "vec_id long, embedding array<double>, score string").repartition(4)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, rows=32).collect()]
    whole = {i: np.floor(1024 * np.pad(np.array(v), (0, 8 - len(v)))).astype(int) for i, v in rows + same + odd[-1:]}
    want = []
    for q in whole:
        if q % 100 == 0:
            best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("pivots, parts", [(40, 4), (4, 200)])
def test_topk_of_small_cells(spark, pivots, parts):
    """Cells, or blocks cut at range borders, with fewer than k vectors: the rest is searched whole."""
    rng = np.random.default_rng(11)
    near, far = rng.normal(size=(150, 6)), rng.normal(size=(4, 6)) + 90
    vectors = np.vstack([near, far])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [tuple(r) for r in topk.top_k(df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 153), pivots=pivots).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = np.floor(1024 * vectors).astype(int)
    want = []
    for q in [*range(0, 154, 10), 153]:
        best = sorted((-int(whole[q] @ v), i) for i, v in enumerate(whole) if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "search", {"query": '"x"', "limit": "3"}, []),
            (1, 2, "b", "search", {"query": "3", "bogus": "1"}, ["a"]),
            (1, 3, "c", "summarise", {"text": '"é\\n"'}, ["a", "b", "gone"]),
            (1, 4, "d", "nothing", None, None), (1, 5, "e", "search", {"query": '"y"', "limit": "1"}, ["f"]),
            (1, 6, "f", "search", {"query": '"z"', "limit": "2"}, ["e"]), (1, 1, "a", "search", {"query": '"x"', "limit": "3"}, []),
            (None, 1, "a", "search", None, None), (2, None, None, "search", None, None),
        ],
        "conv_id long, turn long, call_id string, tool string, arguments map<string,string>, depends_on array<string>",
    )
    results = spark.createDataFrame(
        [(1, "a", "r1"), (1, "c", "b"), (1, "c", "a"), (9, "a", "other"), (1, None, "lost")], "conv_id long, call_id string, content string"
    )
    got = {r.call_id: r for r in chat.linked(calls, results, chat.TOOLS).collect()}
    assert {k: (r.depth, r.status, r.errors) for k, r in got.items()} == {
        "a": (0, "linked", ""), "b": (1, "invalid", "missing:limit,type:query,unknown:bogus"), "c": (2, "repeated", ""),
        "d": (0, "invalid", "unknown_tool"), "e": (None, "cycle", ""), "f": (None, "cycle", ""),
    }
    assert got["a"].json == '{"after":[],"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"r1"}'
    assert got["c"].json.startswith('{"after":["a","b","gone"],"arguments":{"text":"é')
    assert chat.linked(calls.limit(0), results, chat.TOOLS).count() == 0


def test_pipeline_stages_on_edge_rows(spark, docs, none):
    for table in (docs, none):
        held = table
        for name, stage in corpus_pipeline.STAGES:
            held = stage(spark, held, "")
            if name != "bpe":
                assert held.columns == docs.columns
                held = spark.createDataFrame(held.collect(), docs.schema)
        assert set(held.columns) >= {"doc_id", "ids"} and (held.count() == 0) == (table is none)
