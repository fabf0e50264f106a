"""Sharding, vector codes and token alignment against plain versions, and on odd rows."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, chat, language, sharding, vector_codes

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, shard string, _row string, block string, slot string, pair string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(30)]
    texts += [None, "", " ", "  two  spaces ", "\n\n a\tb \r\n c", "x" * 30_000, texts[0], texts[0], "日本語 テキスト 123 🙂🙂 x",
              "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b ▁ c", "it's we'll  I'm", "\x00 a\x00 b", "nbsp  x  y 　 z",
              "é Å ﬁ ½", "   ", "a" + " " * 50 + "b", "1234567890 1,000.5 --- ...", " ".join(word() for _ in range(20_000))]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None), (None, "null id"), (3, texts[3]), (3, "other")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_shards(spark, docs, rows, none):
    tree = sharding.balanced()
    out = sharding.assign(docs, tree).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.shard) for r in out if r.doc_id == 3} == {(3, next(r.shard for r in out if r.doc_id == 3))}
    assert sharding.assign(none, tree).count() == 0


def placed(spark, tree, n=6000):
    df = spark.range(n).select("id", sharding.descend(tree, F.col("id").cast("string")).alias("shard"))
    return {r.id: r.shard for r in df.collect()}


def test_weights_move_rows_only_where_they_change(spark):
    tree = sharding.Tree((*sharding.balanced(3, 2, 2).leaves[:-1], sharding.Leaf(2, 1, 11, 2.0)))
    before = placed(spark, tree)
    share = Counter(before.values())
    assert all(abs(share[leaf.shard] - 6000 * leaf.weight / 13) < 120 for leaf in tree.leaves)
    heavier = placed(spark, tree.reweighted(4, 3.0))
    path = {leaf.shard: leaf.path for leaf in tree.leaves}
    moved = [(before[i], heavier[i]) for i in before if before[i] != heavier[i]]
    assert moved
    for a, b in moved:
        # The level where the two paths part has the heavier child on the new side.
        level = next(k for k in range(3) if path[a][k] != path[b][k])
        assert path[b][level] == path[4][level]
    twice = tree.grown().grown(0.5)
    once = placed(spark, tree.grown())
    assert {(before[i] == once[i]) or once[i] == 12 for i in before} == {True}
    again = placed(spark, twice)
    assert {(once[i] == again[i]) or again[i] == 13 for i in before} == {True} and 13 in again.values()
    with pytest.raises(ValueError):
        sharding.Tree(())


def test_whole_rows_are_written_to_their_shards(spark, docs, rows, tmp_path):
    tree = sharding.balanced(2, 1, 2)
    sharding.write_shards(docs, tree, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.select("document.*").columns == docs.columns and back.count() == len(rows)
    want = {(r.doc_id, r.shard) for r in sharding.assign(docs, tree).collect()}
    assert {(r.doc_id, r.shard) for r in back.select("document.doc_id", "shard").collect()} == want


def plain_codes(rows, parts, entries, rounds):
    """K-means with every distance measured."""
    kept = [(i, label, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    longest = max(len(v) for *_, v in kept)
    width = -(-longest // parts)
    padded = np.array([np.pad(v, (0, parts * width - len(v))) for *_, v in kept]).reshape(-1, parts, width)
    least = {}
    for (i, _, v), p in zip(kept, padded):
        if i not in least or v.tolist() < least[i][0]:
            least[i] = (v.tolist(), p)
    first = [least[i][1] for i in sorted(least, key=lambda i: (i is None, i))[:entries]]
    books = np.array(first).transpose(1, 0, 2).copy()

    def assigned():
        far = ((padded[:, :, None, :] - books[None]) ** 2).sum(3)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        at, _ = assigned()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    own = padded[at[:, p] == e, p]
                    books[p, e] = own.sum(0) // len(own)
    at, far = assigned()
    total = Counter()
    for (_, label, _), f in zip(kept, far.sum(1)):
        total[label] += int(f)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return sorted(
        (str(i), "".join(f"{x:02x}" for x in a), int(f), total[label], digest) for (i, label, _), a, f in zip(kept, at, far.sum(1))
    )


@pytest.mark.parametrize("entries, broadcast", [(256, True), (70, False), (1, True)])
def test_codes(spark, entries, broadcast):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).round(2).tolist(), int(i) % 3 or None) for i in range(600)]
    rows += [(2000 + i, [0.25] * 16, 7) for i in range(300)]
    rows += [(i, np.round(rng.integers(-2, 3, 16) / 4, 2).tolist(), 1) for i in range(3000, 3300)]
    rows += [(5, rng.normal(size=16).tolist(), 1), (None, [1.0] * 16, None), (None, [0.5] * 16, 2), (7000, [3.0, -4.0], 1), (7001, [], 1),
             (7002, None, 1), (7003, [None] + [1.0] * 15, 1), (7004, [float("nan")] * 16, 1), (7005, [float("-inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, v string").repartition(7)
    if not broadcast:
        spark.conf.set("spark.tidemark.maxBroadcastRows", "2")
    try:
        got = vector_codes.compressed(df, entries=entries).collect()
    finally:
        spark.conf.unset("spark.tidemark.maxBroadcastRows")
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows, 4, entries, 4)
    assert vector_codes.compressed(df.limit(0)).count() == 0


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(6)
    for n, width in ((1, 1), (64, 2), (65, 3), (256, 8)):
        entries = rng.integers(-50, 50, (n, width))
        points = np.vstack([rng.integers(-60, 60, (300, width)), rng.integers(-10**6, 10**6, (5, width)), entries[:1]])
        far = ((points[:, None] - entries[None]) ** 2).sum(2)
        entry, best = vector_codes.Slices(entries).nearest(points)
        assert (entry == far.argmin(1)).all() and (best == far.min(1)).all()


def plain_alignment(rows):
    """Whole texts encoded by the libraries and linked pair by pair."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in letters} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in letters)}
    bytes_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, holds = [], Counter()
    for doc_id, text in rows:
        spaced, groups = f" {text}".encode(), []
        ids = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [list(map(f, x)) for f, x in zip((bytes_a, bytes_b), ids)]
        if text and all(b"".join(p) == spaced for p in parts):
            ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
            at = [0, 0]
            for end in sorted(set(ends[0]) & set(ends[1])):
                group = []
                for k in (0, 1):
                    upto = ends[k].index(end, at[k]) + 1
                    group.append(ids[k][at[k] : upto])
                    at[k] = upto
                groups.append(group)
        else:
            ids = ([], [])
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holds.update(links.keys())
        named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(named.encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    return sorted(
        (str(d), na, nb, g, sum(links.values()), sum(n for p, n in links.items() if holds[p] == top[p[0]]),
         sum(n * holds[p] for p, n in links.items()), sha)
        for d, na, nb, g, links, sha in found
    )


@pytest.mark.parametrize("slice_bytes, link_rows", [(alignment.SLICE_BYTES, alignment.LINK_ROWS), (500, 3)])
def test_alignment(docs, rows, none, slice_bytes, link_rows):
    """Also with slices of one text or few and joins of a few rows at a time, run in this process."""
    if slice_bytes == alignment.SLICE_BYTES:
        got = alignment.aligned(docs, *PATHS).collect()
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == plain_alignment(rows)
        assert alignment.aligned(none, *PATHS).count() == 0
        return
    pair, chunks = alignment.pair_of(*PATHS), {t for _, t in rows if t}
    import pyarrow as pa

    held = pa.array(sorted(f" {t}".encode() for t in chunks if len(t) < 3000), pa.binary())
    whole = alignment.Aligned(held, pair)
    before = alignment.LINK_ROWS
    alignment.LINK_ROWS = link_rows
    try:
        stepped = alignment.Aligned(held, pair)
    finally:
        alignment.LINK_ROWS = before
    assert (whole.pair == stepped.pair).all() and (whole.times == stepped.times).all()
    assert (whole.pairs_from == stepped.pairs_from).all()


def test_rows_of_a_slice_are_bounded(rows, monkeypatch):
    """However much text a slice holds, no row that leaves its task exceeds the size of a part, and nothing is lost."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(alignment, "PART_BYTES", 2000, raising=False)
    monkeypatch.setattr(alignment, "PART_PAIRS", 100, raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    [parts] = alignment._slices(*PATHS)(iter([batch]))
    most = alignment.PART_BYTES + 16 * alignment.PART_PAIRS + 64
    assert len(parts) > 9 and all(parts.slice(i, 1).nbytes <= most for i in range(len(parts)))
    pairs = [x for part in parts.column("pair").to_pylist() for x in part]
    assert pairs == sorted(set(pairs)) and len(pairs) > alignment.PART_PAIRS
    counts = [x for part in parts.column("docs").to_pylist() for x in part]
    told = pa.table({"pair": pairs, "count": counts, "best": [True] * len(pairs)})
    mixed = pa.table(parts).take(list(reversed(range(len(parts)))))
    got = alignment._with_counts(mixed, told.take(list(reversed(range(len(pairs))))))
    want = {r[:5] + r[6:] for r in plain_alignment(rows)}
    assert {(str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in got.to_pylist()} == want
    assert got["n_best"] == got["n_links"]


def test_chunks_encode_as_whole_texts():
    """Cutting texts before single spaces changes no token of either tokenizer."""
    import pyarrow as pa

    pair, rng = alignment.pair_of(*PATHS), random.Random(4)
    signs = ["a", "'s", " ", "  ", "\n", "\t", ".", "é", " ", " ", "1", "the", "日", "▁", "🙂", "_", "-", "\x85", "ß'll", "́", "<s>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    chunks, bounds = alignment._chunked(pa.array(texts), pair.cuts)
    parts = chunks.cast(pa.string()).to_pylist()
    assert pair.cuts and len(parts) > len(texts)
    for encode in (pair.encode_a, pair.encode_b):
        own, whole = encode(parts), encode([" " + t for t in texts])
        for i, ids in enumerate(whole):
            assert [x for p in own[bounds[i] : bounds[i + 1]] for x in p] == ids, texts[i]


def test_language_sample_is_bounded_in_rows_and_sees_null_ids(spark):
    """One id on many rows fills no more than the bound; a table of null ids is learned from."""
    text = {"en": "the house and the tree stand there", "de": "das Haus und der Baum stehen dort"}
    many = [(5, f"{text[l]} {i}", l) for i in range(150) for l in text] + [(5, text["en"], "en")] * 50
    df = spark.createDataFrame(many, "doc_id long, text string, lang string").repartition(3)
    assert language._sample(df, F.lit(False), language.Training(rows=5)).count() == 5
    assert language._sample(df, F.lit(False), language.Training()).count() == 301
    model = language.train(df.withColumn("doc_id", F.lit(None).cast("long")), F.lit(False))
    assert model.langs == ["de", "en"] and model.least >= 0.5
    asked = spark.createDataFrame([(1, "the tree and the house"), (2, "der Baum und das Haus")], "doc_id long, text string")
    assert [r.lang_pred for r in language.predict(asked, model).orderBy("doc_id").collect()] == ["en", "de"]


def test_language_scores_equal_a_plain_average(spark):
    """Every score against subwords cut and averaged one by one."""
    rng = np.random.default_rng(3)
    training = language.Training(buckets=1 << 8)
    model = language.Model(["a", "b", "c"], rng.normal(size=(1 << 8, 3)).astype(np.float32) * 8, 0.5)
    texts = ["One small text", "x", "", None, "ab", "abc", "zwei Wörter, drei", "tail  end. ", "日本語の文", "a" * 50, "1234 !!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    for i, text in enumerate(texts):
        data, rows = (text or "").encode(), []
        folded = [language.FOLDED[b] for b in data]
        for n in (3, 4):
            for at in range(len(data) - n + 1):
                part = [int(x) for x in folded[at : at + n]]
                if language.SPACE in part[1 : n - 1]:
                    continue
                code = 0
                for x in part:
                    code = (code * 0x01000193 + x) % 2**32
                code = ((code ^ (code >> 15)) * 2654435769) % 2**32
                rows.append(model.table[code >> (32 - 8)])
        mean = np.mean(rows, axis=0) if rows else np.zeros(3)
        share = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        if any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "abc"[share.argmax()] and got[i].score == pytest.approx(share.max(), abs=1e-5)
        else:
            assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected


def test_call_depths_of_random_graphs(spark):
    """Long chains, calls with several dependencies, cycles and calls that wait for them."""
    rng, rows, want = random.Random(6), [], {}
    for conv in range(12):
        n, deps = 40, {}
        for i in range(n):
            some = [i - 1] if conv % 3 == 0 else rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))
            deps[i] = [j for j in some if j >= 0] + ([n + 5] if i % 9 == 0 else [])
        if conv % 2:
            deps[rng.randrange(5, 20)].append(rng.randrange(20, n))
        rows += [(conv, f"c{i}", [f"c{j}" for j in deps[i]]) for i in deps]
        depth, left = {}, set(deps)
        while ready := [i for i in left if all(j in depth for j in deps[i] if j in deps)]:
            for i in ready:
                depth[i] = max([depth[j] + 1 for j in deps[i] if j in deps], default=0)
            left -= set(ready)
        want |= {(conv, f"c{i}"): d for i, d in depth.items()}
    rows.append((99, "self", ["self"]))
    df = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>").repartition(3)
    assert {(r.conv_id, r.call_id): r.depth for r in chat.depths(df).collect()} == want


def test_arguments_are_parsed_and_written_anew(spark):
    given = {"query": '"x" "y"', "limit": " 3 "}, {"query": '"a\nb"', "limit": "1"}, {"query": '"\\u00e9"', "limit": "1.5"}, {
        "text": '"' + "long " * 50_000 + '"', "strict": "{\"b\": 1, \"a\": [ ]}"}, {"query": '"q"', "limit": "0", "__x": "null"}, {"query": '"q"', "limit": "1,0],["}, {"query": '"q"', "limit": "1], [2"}
    rows = [(1, i, f"c{i}", "summarise" if "text" in g else "search", g, None, "z") for i, g in enumerate(given)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, tool string, arguments map<string,string>, depends_on array<string>, json string")
    none = spark.createDataFrame([], "conv_id long, call_id string, content string")
    got = {r.call_id: r for r in chat.linked(calls, none, chat.TOOLS).collect()}
    assert [got[f"c{i}"].errors for i in range(7)] == ["type:query", "type:query", "type:limit", "type:strict", "unknown:__x", "type:limit", "type:limit"]
    for i in range(7):
        whole = json.loads(got[f"c{i}"].json)
        assert json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == got[f"c{i}"].json
    assert json.loads(got["c0"].json)["arguments"] == {"limit": 3, "query": '"x" "y"'}
    assert json.loads(got["c3"].json)["arguments"]["strict"] == {"a": [], "b": 1}
