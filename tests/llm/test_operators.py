"""Every operator against brute force: a small table, and rows of every awkward kind."""

import base64
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from retensa.llm import (byte_bpe, components, decontaminate, line_dedup, partenum, pii,
                         quality_classifier, quality_rules, sharding, token_files, warc, word_ids)
from retensa.llm.perfect_hash import PerfectHash
from retensa.llm.word_ids import WordIds

from ..conftest import SF_SMALL
from . import brute
from .conftest import frame

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def key(row):
    return tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else str(x)
                 for x in row)


def agree(got, expected):
    got, expected = sorted(map(tuple, got), key=key), sorted(map(tuple, expected), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == b


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def small_rows(small):
    return [tuple(r) for r in small.select("doc_id", "text").collect()]


def labels_frame(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# 1 ------------------------------------------------------------------------------------------

PAGES = [(1, "http://a.b.example.com:80/x?y#z", "<p>é</p>"), (2, None, None), (3, "", ""),
         (4, "not a url\n at all", "<p>é</p>"), (5, "https://u@EXAMPLE.com", "x" * 100_000),
         (6, "http://a.b.example.com/x?y", "<p>é</p>"), (6, "http://a.b.example.com/x?y", "<p>é</p>"),
         (1, "http://a.b.example.com:80/x?y#z", "<p>é</p>"), (None, "http://q/", "lonely"),
         (None, "http://q/", "<p>é</p>"), (-7, "http://ü.example/ä", "late"), (9, "//h", "late")]


def warc_rows(df):
    return [tuple(r) for r in warc.round_trip(df).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string"
    agree(warc_rows(frame(spark, PAGES, schema)), brute.warc(PAGES))
    assert warc_rows(frame(spark, [], schema)) == []
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    agree(warc_rows(pages), brute.warc([tuple(r) for r in pages.select("page_id", "url", "html").collect()]))


def test_warc_ids_are_whole_numbers(spark, tmp_path):
    with pytest.raises(TypeError):
        warc.write_archives(frame(spark, [("a", "u", "x")], "page_id string, url string, html string"),
                            str(tmp_path))


def test_read_tasks():
    from retensa.llm.files import read_tasks
    assert read_tasks(0, 0) == 1 and read_tasks(1 << 30, 5) == 64 and read_tasks(5, 95_000) == 10
    assert read_tasks(1 << 60, 1) == 100_000


def test_warc_index_finds_keys_over_many_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 50}", f"body {i}") for i in range(900)]
    df = frame(spark, rows, "page_id long, url string, html string")
    captures = warc.write_archives(df, str(tmp_path))
    index = warc.build_index(captures, str(tmp_path), block_lines=5)
    wanted = captures.select("key").union(spark.createDataFrame([("nowhere",), ("~",)], "key string"))
    found = warc.look_up(index, wanted.distinct())
    assert found.count() == 900
    back = warc.read_captures(str(tmp_path), found, payloads=True)
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in back.collect()} == {
        (i, b) for i, _, b in rows}


def test_url_key(spark):
    df = spark.createDataFrame([(u,) for _, u, _ in PAGES], "url string")
    keys = [r[0] for r in df.select(warc.url_key(F.col("url"))).collect()]
    assert keys[0] == "com,example,b,a)/x?y" and keys[1] == "" and keys[4] == "com,example)/"
    assert "\n" not in keys[3] and keys[-1] == "h)/"


# 2 ------------------------------------------------------------------------------------------

def contamination_rows(docs, items):
    return [tuple(r) for r in decontaminate.find_contamination(docs, items, filter_bits=1 << 12).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256),
        "contaminated").collect()]


def test_decontamination(spark, edge, edge_rows, none, small, small_rows):
    schema = "item_id long, text string"
    texts = dict(edge_rows)
    items = [(1, texts[105]), (2, "x"), (3, ""), (4, None), (None, "A, b! C"), (5, "three four"),
             (6, " ".join(texts[400].split()[60:95])), (7, "one TWO three"), (7, "four five"),
             (8, texts[105])]
    agree(contamination_rows(edge, frame(spark, items, schema)), brute.contamination(edge_rows, items))
    assert contamination_rows(none, frame(spark, items, schema)) == []
    agree(contamination_rows(edge, frame(spark, [], schema)), brute.contamination(edge_rows, []))
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    agree(contamination_rows(small, bench),
          brute.contamination(small_rows, [tuple(r) for r in bench.select("item_id", "text").collect()]))
    bad = {(r[0], r[1]) for r, b in zip(edge_rows, brute.contamination(edge_rows, items)) if b[-1]}
    kept = decontaminate.clean_documents(edge, frame(spark, items, schema))
    assert kept.columns == edge.columns
    agree([r[:2] for r in kept.collect()], [r for r in edge_rows if r not in bad])


# 3 ------------------------------------------------------------------------------------------

def test_quality_rules(spark, edge, edge_rows, none, small, small_rows):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "base_failed"]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    judged = quality_rules.judge(small, labels)
    agree(judged.select(*columns).collect(), brute.base_rules(small_rows))
    assert judged.where("base_failed and kept").count() == 0
    empty = labels_frame(spark)
    plain = quality_rules.judge(edge, empty)
    agree(plain.select(*columns).collect(), brute.base_rules(edge_rows))
    assert plain.where("kept = base_failed").count() == 0
    assert quality_rules.judge(none, empty).count() == 0
    kept = quality_rules.kept_documents(edge, empty)
    assert kept.columns == edge.columns and kept.count() == plain.where("kept").count()


def test_isolation_forest_sets_outliers_apart():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    forest = quality_rules.grow_forest(x, 100, 64, 1)
    assert forest.score(np.full((1, 4), 9.0))[0] > np.quantile(forest.score(x), 0.99)
    assert quality_rules.grow_forest(x[:1], 5, 64, 1) is None


# 4 ------------------------------------------------------------------------------------------

def near_rows(docs, **params):
    return [tuple(r) for r in partenum.near_duplicates(docs, **params).select(
        "doc_id", "n_shingles", "component_id").collect()]


def test_near_duplicates(edge, edge_rows, none, small, small_rows):
    agree(near_rows(edge), brute.components(edge_rows))
    agree(near_rows(edge, hot=1), brute.components(edge_rows))
    agree(near_rows(small), brute.components(small_rows))
    assert near_rows(none) == []
    kept = partenum.one_of_each(edge)
    assert kept.columns == edge.columns
    assert kept.select(F.countDistinct("doc_id")).first()[0] == len(
        {c for d, n, c in brute.components(edge_rows) if c is not None})


def test_large_families_in_blocks(spark, monkeypatch):
    import random
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(150)] = f"v{rng.randrange(10 ** 9)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(partenum, "BLOCK_SETS", 7)
    agree(near_rows(frame(spark, rows)), brute.components(rows))


def test_signatures_are_shared_by_similar_sets():
    rng = np.random.default_rng(0)
    for n in (3, 7, 12, 31, 32, 47, 48, 63, 64, 100, 127, 128, 400, 3000):
        for grow in (True, False):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                lost = 0 if grow else n // 7
                more = rng.integers(0, 1 << 63, n // 3 if grow else n // 7, dtype=np.uint64)
                b = np.unique(np.concatenate((rng.permutation(a)[lost:], more)))
                both = len(np.intersect1d(a, b))
                if 100 * both < 75 * (len(a) + len(b) - both):
                    continue
                one, two = (set(np.concatenate(partenum.signatures(x)).tolist()) for x in (a, b))
                assert one & two or np.array_equal(a, b)


@pytest.mark.parametrize("q", [6, 7, 9, 12, 14])
def test_similar_sets_share_as_many_signatures_as_are_asked_for(q):
    rng = np.random.default_rng(q)
    edge = 1 << q                       # sizes 3/4 of it against it, and it against itself
    for common, left, right in ((3 * edge // 4, 0, edge // 4), (6 * edge // 7 + 1, edge // 7 - 1, edge // 7 - 1)):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 64, common + left + right, dtype=np.uint64))
            assert len(x) == common + left + right and 4 * common >= 3 * len(x)
            x = rng.permutation(x)
            one = np.sort(x[:common + left])
            two = np.sort(np.concatenate((x[:common], x[common + left:])))
            band = one.size.bit_length() - 1, two.size.bit_length() - 1
            both = [np.intersect1d(partenum.signatures(one)[r - band[0]], partenum.signatures(two)[r - band[1]])
                    for r in range(max(band), min(band) + 2)]
            assert max(map(len, both)) >= partenum.LEAST_SHARED


def test_components(spark):
    import random
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 7), (60, 50), (50, 60)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = dict(map(tuple, components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 ------------------------------------------------------------------------------------------

def file_rows(docs):
    files = token_files.write_token_files(docs, WORD, 2)
    index = token_files.build_index(files, keys_per_shard=40)
    found = token_files.find(index, files.documents.select("doc_id", "repeat"))
    return files, index, [tuple(r) for r in token_files.read_documents(
        files.folder, found, files.item_bytes).collect()]


def test_token_files(spark, edge, edge_rows, none, small, small_rows):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORD)
    files, index, got = file_rows(small)
    agree(got, brute.token_rows(small_rows, tokenizer, 2))
    wrong = spark.createDataFrame([(10 ** 9 + i, 0) for i in range(500)] + [(0, 1)],
                                  "doc_id long, repeat long")
    assert token_files.find(index, wrong).count() == 0
    assert file_rows(none)[2] == []
    # repeated ids: the same starts and sums, whatever the order within an id
    got = file_rows(edge)[2]
    ids = {}
    for doc_id, text in edge_rows:
        ids.setdefault(doc_id, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids)
    assert sorted((str(d), n) for d, _, n, _ in got) == sorted(
        (str(d), len(i) + 1) for d, every in ids.items() for i in every)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_word_encoder_is_the_tokenizer():
    encoder = WordIds(WORD, cached=50)
    assert encoder.by_runs
    texts = ["İstanbul ΣΑΣ don't it's 'S été ½ ②a!b ..x", "<|endoftext|>x <|startoftext|>", "é" * 200,
             "áb é! x-y z-- ", "A b\x1cc　d", "ÀÉ,, ÿß.", "", "\n"] * 20
    texts += [f"word{i} Été{i}, plain{chr(97 + i % 26) * 9}." for i in range(300)]
    texts += ["x" * 3000 + " y " * 900, "<|", "a<|b |> 1<2", "12,345.6 a1b2 \x00 e\u0301", None or ""]
    word_ids.BLOCK_BYTES, whole = 700, word_ids.BLOCK_BYTES
    try:
        for _ in range(2):                         # the cache shrinks on the way
            ids, ends = encoder.encode([t.encode() for t in texts])
            for text, a, b in zip(texts, ends[:-1], ends[1:]):
                assert ids[a:b].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        word_ids.BLOCK_BYTES = whole


def test_encoder_with_a_tokenizer_of_another_kind():
    from tokenizers import Tokenizer
    file = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = WordIds(file), Tokenizer.from_file(file)
    assert not encoder.by_runs
    texts = ["Two  words\n", "", "don't"]
    ids, ends = encoder.encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_perfect_hash():
    rng = np.random.default_rng(4)
    h1, h2 = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    table = PerfectHash.build(h1, h2)
    assert sorted(table.slots(h1, h2)) == list(range(5000))
    assert (table.slots(h2, h1) >= 0).sum() <= 1
    again, columns = PerfectHash.load(table.dump(x=np.arange(3)))
    assert np.array_equal(again.slots(h1, h2), table.slots(h1, h2)) and len(columns["x"]) == 3
    assert len(PerfectHash.build(h1[:0], h2[:0]).slots(h1, h2)) == 5000
    with pytest.raises(ValueError):
        PerfectHash.build(h1[[0, 0]], h2[[0, 0]])


# 6 ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoding():
    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_byte_bpe(edge, edge_rows, none, small, small_rows, encoding):
    agree(byte_bpe.encode_digests(small, BPE).collect(), brute.bpe_rows(small_rows, encoding))
    agree(byte_bpe.encode_digests(edge, BPE).collect(), brute.bpe_rows(edge_rows, encoding))
    assert byte_bpe.encode_digests(none, BPE).count() == 0
    whole = byte_bpe.encode_documents(edge, BPE)
    assert whole.columns == [c for c in edge.columns if c != "text"] + ["ids", "decoded"]
    agree([(r["doc_id"], bytes(r["decoded"]).decode(), list(r["ids"])) for r in whole.collect()],
          [(d, t or "", encoding.encode_ordinary(t or "")) for d, t in edge_rows])


def test_byte_bpe_splits_like_the_library(encoding):
    codec = byte_bpe.codec(BPE)
    for point in [*range(0x3100), 0x1F600, 0x10FFFF]:
        if not 0xD800 <= point < 0xE000:
            text = f"a{chr(point)}1 {chr(point)}{chr(point)}. {chr(point)} b  {chr(point)}"
            assert codec.encode(text) == encoding.encode_ordinary(text)


# 7 ------------------------------------------------------------------------------------------

def test_quality_classifier(spark, edge, none, small):
    import zlib
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = quality_classifier.score_documents(docs, labels).join(labels, "doc_id").collect()
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 50
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(
        quality_classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    agree(quality_classifier.score_documents(docs, flipped).collect(),
          quality_classifier.score_documents(docs, labels).collect())
    plain = quality_classifier.score_documents(edge, labels_frame(spark))
    assert plain.where("score = 0.5 and predicted = 0").count() == edge.count()
    one = quality_classifier.score_documents(edge, labels_frame(spark, [(3, 1, 0), (5, None, 0)]))
    assert one.where("score = 1.0").count() == edge.count()
    assert quality_classifier.score_documents(none, labels).count() == 0


# 8 ------------------------------------------------------------------------------------------

def check_spans(docs, rows):
    got = pii.span_digests(docs).collect()
    expected = brute.spans(rows)
    agree([tuple(r)[:6] for r in got], [e[:6] for e in expected])
    base = {(e[0], e[5]): set(e[6]) for e in expected}
    for r in got:
        assert base[(r["doc_id"], r["base_sha256"])] <= set(filter(None, r["spans"].split(",")))
    return got


def test_pii(spark, edge, edge_rows, none, small, small_rows):
    check_spans(edge, edge_rows)
    check_spans(small, small_rows)
    assert pii.span_digests(none).count() == 0
    import random
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("a1@.+-_ ()%9é") for _ in range(rng.randrange(120))))
            for i in range(1500)]
    check_spans(frame(spark, rows), rows)


def test_pii_adds_secrets_and_redacts(spark):
    secret = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"
    rows = [(i, f"words before token = \"{secret[i % 9:]}\" é password=b7db7aa4a5fcc7830{i} and x{i}@y.example "
                f"after, token of thanks") for i in range(30)]
    docs = frame(spark, [(*r, "n") for r in rows], "doc_id long, text string, lang string", extra=False)
    kinds = [k for r in pii.find_spans(docs).collect() for k in [s["kind"] for s in r["spans"]]]
    assert kinds.count("secret") == 60 and kinds.count("email") == 30
    texts = [r["text"] for r in pii.redact(docs).collect()]
    assert all(t.startswith('words before token = "<SECRET>" é password=<SECRET> and <EMAIL> after') for t in texts)


@pytest.mark.parametrize("length", [300, 5000])
def test_pii_long_keys_are_found_whole(spark, length):
    import random
    import string
    rng = random.Random(length)
    rows, places = [], {}
    for i in range(40):
        value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(length))
        front, kind = ("é words token=", "secret") if i % 2 else ("é words bearer ", "api_id")
        text = front + value
        places[i] = f"{kind}:{len(front)}:{len(text)}"
        rows.append((i, text + " and then plain words", "n"))
    docs = frame(spark, rows, "doc_id long, text string, lang string", extra=False)
    assert {r["doc_id"]: r["spans"] for r in pii.span_digests(docs).collect()} == places
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i in places:
        assert texts[i] == ("é words token=<SECRET>" if i % 2 else "é words bearer <API_ID>") \
            + " and then plain words"


def test_pii_one_long_key_among_short_ones_and_junk(spark):
    import random
    import string
    rng = random.Random(3)

    def key(n):
        return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))

    texts = [f"set token={key(40)} now" for _ in range(40)]
    texts += [f"line {'-' * 30}{i} and {'ab' * 20}{i}" for i in range(60)]
    long = key(5000)
    texts += [f"set token={long} now", f"bearer {long} now"]
    docs = frame(spark, [(i, t, "n") for i, t in enumerate(texts)],
                 "doc_id long, text string, lang string", extra=False)
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert all(out[i] == "set token=<SECRET> now" for i in range(40))
    assert all(out[i] == texts[i] for i in range(40, 100))
    assert out[100] == "set token=<SECRET> now" and out[101] == "bearer <API_ID> now"
    votes = spark.createDataFrame([("secret", v, "token=") for v in (long[:40], long)],
                                  "kind string, value string, before string").select(
        pii._votes()["shape"].alias("shape")).collect()
    assert [v["shape"] for v in votes] == [1, 1]      # length alone is no vote against a key


def test_pii_rejected_candidates_remove_nothing(spark, monkeypatch):
    import random
    rng = random.Random(2)
    parts = ["auth: ", "token=", "tel_", "078-05-1120", "555-123-4567", "GB82WEST12345698765432", "_", "-",
             " ", "a1b2c3d4e5f6g7h8", "(555) 010-9999", "x@y.ex", "1.2.3.4"]
    texts = ["tel_555-123-4567", "auth: 078-05-1120"]
    texts += ["".join(rng.choice(parts) for _ in range(12)) for _ in range(200)]
    docs = frame(spark, [(i, t, "n") for i, t in enumerate(texts)],
                 "doc_id long, text string, lang string", extra=False)
    judged = []

    def some(candidates):
        rows = candidates.select("row", "kind", "start", "end", "value").collect()
        judged.extend((*r[:4], r["kind"] not in ("secret", "api_id") or r["end"] % 3 == 0) for r in rows)
        return candidates.where("kind not in ('secret', 'api_id') or end % 3 = 0")

    monkeypatch.setattr(pii, "_accepted", some)
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    assert [s["kind"] for s in got[0]] == ["local_phone"]
    assert [s["kind"] for s in got[1]] == ["national_id"]
    kept = []
    for row, kind, start, end, fine in sorted(judged, key=lambda c: (c[0], pii.ORDER.index(c[1]), c[2])):
        if fine and all(r != row or e <= start or s >= end for r, _, s, e in kept):
            kept.append((row, kind, start, end))
    assert len(kept) < sum(c[4] for c in judged) < len(judged)
    added = [(s["kind"], s["start"], s["end"]) for spans in got.values() for s in spans if not s["base"]]
    assert sorted(added) == sorted(k[1:] for k in kept)
    for spans in got.values():
        base = [s for s in spans if s["base"]]
        assert not any(a["start"] < b["end"] and b["start"] < a["end"]
                       for a in spans if not a["base"] for b in base)


def test_vote_estimation_trusts_the_consistent_labelers():
    patterns = [((1, 0, 1, 1), 100), ((-1, 0, -1, -1), 100), ((1, 0, 1, -1), 10), ((-1, 0, -1, 1), 10)]
    _, belief = pii.estimate(patterns)
    assert belief[0] > 0.9 and belief[1] < 0.1 and belief[2] > 0.5 > belief[3]


# 9 ------------------------------------------------------------------------------------------

def check_shards(rows, docs, shards):
    import zlib
    got = sharding.assign_shards(docs, shards, chunks=8).collect()
    agree([(r["doc_id"], r["size"], r["text_crc32"]) for r in got],
          [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows])
    homes, slots, sizes = {}, {}, [0] * shards
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_sharding(edge, edge_rows, none, small, small_rows, tmp_path, spark):
    sizes = check_shards(small_rows, small, 16)
    groups = {}
    for _, t in small_rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 1
    assert max(sizes) <= max(max(groups.values()), sum(sizes) / 16 * 1.1)
    check_shards(edge_rows, edge, 16)
    check_shards(edge_rows, edge, 1)
    assert sharding.assign_shards(none).count() == 0
    sharding.write_shards(small, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(small_rows) and back.select("shard").distinct().count() == 4


def plain_best_fit(sizes, capacity):
    """Bin of every size, one after the other, by a plain search."""
    free, out = [], []
    for s in sizes:
        fits = [(f, b) for b, f in enumerate(free) if f >= s]
        if not fits:
            free.append(capacity)
        at = min(fits)[1] if fits else len(free) - 1
        free[at] -= s
        out.append(at)
    return out


def one_by_one(placed):
    return [b for _, _, b in sorted((-size, rank + i, b) for size, rank, n, b in placed for i in range(n))]


def test_best_fit_enters_the_tightest_bin():
    import random
    from collections import Counter
    rng = random.Random(8)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, rng.choice([4, 60])) for _ in range(rng.randrange(1, 80))), reverse=True)
        runs = [(s, 0, n) for s, n in sorted(Counter(sizes).items(), reverse=True)]
        assert one_by_one(sharding.best_fit(runs, 70, 10 ** 6)) == plain_best_fit(sizes, 70)
    alone = sharding.pack({100: 1, 3: 2, 2: 3}, 3)
    assert alone[0] == (100, 0, 1, 0) and {p[-1] for p in alone[1:]} == {1, 2}
    assert sharding.pack({9: 3}, 3) == [(9, 0, 1, 0), (9, 1, 1, 1), (9, 2, 1, 2)]
    assert sharding.pack({}, 4) == [] and sharding.best_fit([(9, 0, 1)], 8, 5) is None


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_shards_are_best_fit_of_all_groups(spark, folder):
    docs = spark.read.parquet(f"{SF_SMALL}/../{folder}/documents.parquet")
    groups = {}
    for r in docs.select("text").collect():
        t = r["text"] or ""
        groups[t] = groups.get(t, 0) + len(t.encode()) + 1
    sizes = sorted(groups.values(), reverse=True)
    got = sharding.assign_shards(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    bytes_in = {r["shard"]: r["n"] for r in got}
    if sizes[0] * 16 <= sum(sizes):                 # no group above the even share
        capacity = next(c for c in range(-(-sum(sizes) // 16), sum(sizes))
                        if max(plain_best_fit(sizes, c)) < 16)
        plain = [0] * 16
        for s, b in zip(sizes, plain_best_fit(sizes, capacity)):
            plain[b] += s
        assert [bytes_in[b] for b in range(16)] == plain
    assert sorted(bytes_in) == list(range(16)) and sum(bytes_in.values()) == sum(sizes)


# 10 -----------------------------------------------------------------------------------------

def test_line_dedup(edge, edge_rows, none, small, small_rows):
    agree(line_dedup.repeat_digests(small).collect(), brute.lines(small_rows))
    agree(line_dedup.repeat_digests(edge).collect(), brute.lines(edge_rows))
    for least in (1, 8):
        agree(line_dedup.repeat_digests(edge, min_words=least).collect(), brute.lines(edge_rows, least))
    assert line_dedup.repeat_digests(none).count() == 0


def test_line_dedup_takes_runs_of_short_lines(spark, monkeypatch):
    verse = "\n".join(f"line {i} of a verse" for i in range(8))
    one = "a single line that is shared by two documents only here"
    rows = [(1, f"head one\n{verse}\ntail"), (2, f"other\n\n{verse.upper()}\n \nline 3 of a verse\nend"),
            (3, f"{one}\nx"), (4, f"y\n{one}"), (5, verse.replace("\n", "\n\n"))]
    for share in (4096, 4):                        # the second makes many lines hot ones
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        got = {r["doc_id"]: r["text"] for r in line_dedup.repeat_digests(frame(spark, rows)).collect()}
        assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[4] == rows[3][1]
        assert got[2] == "other\n\n \nend" and got[5] == "\n" * 6
        agree(line_dedup.repeat_digests(frame(spark, rows)).collect(), brute.lines(rows))


def test_line_dedup_of_text_ids(spark):
    long = "w " * 30
    rows = [("b", long), ("a", long), (None, long), ("c", "x")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.repeat_digests(
        frame(spark, rows, "doc_id string, text string")).collect()}
    assert got == {"a": long, "b": "", None: "", "c": "x"}


def test_paragraphs(spark):
    a, b = "a b c d e\nf g h i j", "k l m n o p q r s"
    rows = [(1, f"{a}\n\n{b}"), (2, f"x\n\n{a.upper()}\n \n{b}\n"), (3, b)]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(frame(spark, rows), "paragraph", 8).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == ""
    assert got[2]["text"] == "x\n\n \n" and got[2]["n_removed"] == 2
    assert [rows[1][1][s["start"]:s["end"]] for s in got[2]["removed"]] == [a.upper(), b]
    for text in ("", "\n", "a\n", "\n\na\n\nb\n\n", " \na"):
        assert b"\n".join(line_dedup.units_of(text.encode(), "paragraph")) == text.encode()


def plain_sentences(docs, least):
    """By lines of texts whose separators are line feeds; what is kept comes from the offsets."""
    marked = [(d, re.sub(r"(?<=[.!?])[ \t]", "\n", t or "")) for d, t in docs]
    out = []
    for (_, text), (doc_id, n, gone, removed, _) in zip(docs, brute.lines(marked, least)):
        spans = [tuple(map(int, s.split(":"))) for s in removed.split(",") if s]
        kept = "".join(c for i, c in enumerate(text or "") if not any(s - 1 <= i < e for s, e in spans))
        out.append((doc_id, n, gone, removed, kept[1:] if spans and spans[0][0] == 0 else kept))
    return out


def test_sentences_show_passages_inside_lines(spark, monkeypatch):
    passage = " ".join(f"This is sentence {i} of a planted passage!" for i in range(8))
    rows = [(1, f"Some words before {passage} and some after."), (2, f"Other words.\n{passage} More"),
            (3, f"nothing alike. {passage.upper()}\tAnd so on"), (4, "This is sentence 3 of a planted passage!"),
            (5, passage), (6, None), (7, "über alles. é! " + passage), (None, passage + "\nÉnd.\t!")]
    for share in (4096, 4):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        got = {r["doc_id"]: r["text"] for r in line_dedup.repeat_digests(
            frame(spark, rows), unit="sentence").collect()}
        assert got[1] == rows[0][1] and got[4] == rows[3][1] and got[6] == ""
        assert got[2] == f"Other words.\n{passage.split('! ')[0]}! More"   # joined to other words in 1
        assert got[3] == "nothing alike.\tAnd so on" and got[5] == "" and got[7] == "über alles. é!"
        assert got[None] == "Énd.\t!"


def test_sentences(spark, edge, edge_rows, small, small_rows):
    agree(line_dedup.repeat_digests(small, unit="sentence").collect(), plain_sentences(small_rows, 25))
    for least in (1, 8):
        agree(line_dedup.repeat_digests(edge, unit="sentence", min_words=least).collect(),
              plain_sentences(edge_rows, least))
    with pytest.raises(ValueError):
        line_dedup.remove_repeats(small, "word")


def test_large_sets_of_similar_documents_share_signatures(spark):
    """Recall of the join's candidates on the larger table: every pair at 0.75 or more whose sets
    have 64 shingles or more lies in one component."""
    from collections import defaultdict
    docs = spark.read.parquet(f"{SF_SMALL}/../sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, holders = {}, defaultdict(list)
    for doc_id, text in rows:
        w = [x for x in brute.re.findall("[^\x20\x09-\x0D]+", brute.fold(text))]
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        if len(s) >= 64:
            sets[doc_id] = s
            for shingle in s:
                holders[shingle].append(doc_id)
    common = defaultdict(int)
    for own in holders.values():
        for i, a in enumerate(own[:200]):
            for b in own[i + 1:200]:
                common[a, b] += 1
    pairs = [(a, b) for (a, b), n in common.items()
             if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and sets[a] != sets[b]]
    home = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs).collect()}
    assert len(pairs) > 5
    assert [p for p in pairs if home[p[0]] != home[p[1]]] == []
