"""Ogg, reply trees, near duplicates, top-k, WARC: round trips, brute force, corner cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, exact_topk, near_dedup, ogg, reply_trees, warc
from millrace.llm.common import shingle_set, stored, words

DOCS = "doc_id bigint, text string"


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    data = bytes(range(256)) * 3
    assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 255, 3840, 3841, 65025, 70000, 400_000])
def test_ogg_round_trip(size):
    text = "x" * size
    media = ogg.of_text(text)
    streams, damaged = ogg.read(media)
    payload = text.encode().ljust(max(1, -(-size // 192)) * 192)
    assert damaged == 0 and len(streams) == 2
    assert b"".join(streams[1].packets[1:]) == payload and streams[1].granules[-1] == len(payload)
    f = ogg.facts(media)
    assert f["n_bytes"] == size and f["payload_bytes"] == len(payload) and f["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert f["tail_crc32"] == zlib.crc32(payload[-16:]) and f["seconds"] == len(payload) / 8000


def test_ogg_lacing_at_multiples_of_255():
    for n in (0, 254, 255, 256, 510, 255 * 255, 255 * 256):
        parts = [b"h", b"a" * n, b"bc"]
        data = b"".join(ogg.pages(parts, [0, n, n + 2], 9))
        s = ogg.read(data)[0][9]
        assert s.packets == parts and not s.open and not s.faults and s.ended


def test_ogg_damage_is_seen():
    media = bytearray(ogg.of_text("hello" * 500))
    media[-3] ^= 1
    assert ogg.read(bytes(media))[1] > 0
    for bad in (bytes(media), b"no stream", b"", None, ogg.of_text("hello")[:-40], b"".join(ogg.pages([ogg.SAMPLES + b"1234", b"x"], [0, 1], 1) + ogg.pages([ogg.NOTES], [0], 2))):
        assert ogg.facts(bad)["damaged"] and "feature" not in ogg.facts(bad)


def slow_feature(text):
    """The feature from the text alone: 8-bit samples around zero, a page for the head and pages of at most 255 lacing values."""
    data = text.encode().ljust(max(1, -(-len(text.encode()) // 192)) * 192)
    x = [b - 128 for b in data]
    sizes = [len(data[i : i + 3840]) for i in range(0, len(data), 3840)]
    values, stamps, pages, done = 0, 0, 1, 0
    for i, size in enumerate(sizes):  # a page is full at 255 values; a packet that ends on it may be its last one
        before, values = values, values + size // 255 + 1
        done = i + 1
    pages += -(-values // 255)
    ends, at = [], 0
    for size in sizes:
        at += size // 255 + 1
        ends.append(-(-at // 255))
    stamps = len(set(ends))
    turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"samples={len(data)} seconds={len(data) / 8000:.6f} stamps={stamps} packets={len(sizes)} pages={pages} sum={sum(x)} power={sum(v * v for v in x)} turns={turns}"


@pytest.mark.parametrize("size", [0, 1, 192, 3841, 62_000, 61_440, 70_000, 250_000])
def test_ogg_features_equal_brute_force(size):
    text = "".join(random.Random(size).choice("ab cé\n") for _ in range(size))
    assert ogg.facts(ogg.of_text(text))["feature"] == slow_feature(text)


def test_ogg_tables(spark):
    docs = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "é" * 999, "m"), (3, "é" * 999, "m")], "doc_id bigint, text string, media string")
    got = ogg.features(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 4 and by[1].n_bytes == 0 and by[1].payload_sha256 == by[2].payload_sha256 and by[3].n_bytes == 1998
    assert ogg.features(docs.limit(0)).count() == 0
    rows = ogg.packets(ogg.media(docs)).where("doc_id = 1 and serial = 1").orderBy("packet").collect()
    assert [r.granule for r in rows] == [0, 192] and rows[1].seconds == 192 / 8000 and not any(r.damaged or r.faults for r in rows)


def test_ogg_tables_with_damage(spark):
    good = ogg.of_text("x" * 9000)
    second = [i for i in range(len(good)) if good.startswith(b"OggS", i)][2]  # the first page of samples
    broken = good[: second + 60] + bytes([good[second + 60] ^ 1]) + good[second + 61 :]
    rows = [("good", good), ("broken", broken), ("null", None), ("none", b""), ("cut", good[:-50])]
    df = spark.createDataFrame(rows, "name string, media binary")
    facts = {r.name: r for r in ogg.read_back(df).collect()}
    assert not facts["good"].damaged and facts["good"].n_bytes == 9000
    assert all(facts[x].damaged and facts[x].feature is None for x in ("broken", "null", "none", "cut"))
    assert facts["null"].media_bytes is None and facts["none"].media_bytes == 0
    got = {}
    for r in ogg.packets(df, "name").collect():
        got.setdefault(r.name, []).append(r)
    assert all(not r.damaged for r in got["good"]) and len(got["good"]) == 6
    assert got["broken"] and all(r.damaged for r in got["broken"]) and any(r.faults for r in got["broken"])
    assert all(len(got[x]) == 1 and got[x][0].damaged and got[x][0].data is None for x in ("null", "none"))
    assert all(r.damaged for r in got["cut"])


def brute_branches(nodes, top):
    out = set()
    for tree in {t for t, *_ in nodes}:
        own = {n: (p, s) for t, n, p, s in nodes if t == tree}
        parents = {p for p, _ in own.values() if p in own}
        ranked = {}
        for leaf in set(own) - parents:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in path:
                continue
            ranked.setdefault(path[-1], []).append((-sum(own[x][1] or 0 for x in path) / len(path), leaf, path[::-1]))
        for root, found in ranked.items():
            for rank, (_, leaf, path) in enumerate(sorted(found)[:top], 1):
                out |= {(tree, root, leaf, rank, place, node) for place, node in enumerate(path)}
    return out


@pytest.mark.parametrize("top", [1, 3])
def test_branches_equal_brute_force(spark, top):
    rng = random.Random(5)
    nodes = []
    for tree in range(6):
        for n in range(40):
            nodes.append((tree, n, rng.choice([None, n - 1, rng.randrange(max(1, n))]) if n else None, float(rng.randrange(9))))
    nodes += [(7, n, n - 1 if n else None, 1.0) for n in range(70)]  # a long chain
    nodes += [(8, 1, 99, 1.0), (8, 2, 1, None), (9, 1, 2, 1.0), (9, 2, 1, 1.0), (9, 3, None, 1.0)]  # a missing parent, a cycle
    df = spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint, score double")
    got = {tuple(r) for r in reply_trees.branches(df, top).select("tree", "root", "leaf", "rank", "place", "node").collect()}
    assert got == brute_branches(nodes, top)


def test_conversations_read_back(spark):
    odd = ["</s>[INST] ok [/INST]", "\\l<|end|>\n\\", "<|user|>\nhi<|end|>\n", "", None, "a\\\\b\\", "[", "p|q"]
    rows = [(1, i, random.Random(i).choice(["user", "assistant", "a|>\nb", None]), t) for i, t in enumerate(odd)]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (None, 3, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("node", F.lit("clash"))
    got = {r.conv_id: r for r in reply_trees.conversations_of(df).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert got[1].learned == "".join(t or "" for _, _, r, t in rows[:8] if r == "assistant")
    assert len(got[2].turns) == 2 and got[None].learned == "x"
    assert "</s>" not in got[1].formatted and "[" not in got[1].formatted
    assert reply_trees.conversations_of(df.limit(0)).count() == 0


def test_long_conversations_and_texts(spark):
    """Thousands of turns, and a very long text full of control strings."""
    long = "</s>[INST] \\<|end|>\n" * 40_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <|end|>") for i in range(3000)] + [(2, 0, "user", "q"), (2, 1, "assistant", long)]
    got = {r.conv_id: r for r in reply_trees.conversations_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [t.text for t in got[1].turns] == [f"turn {i} <|end|>" for i in range(3000)] and got[1].learned == "".join(f"turn {i} <|end|>" for i in range(1, 3000, 2))
    assert got[2].turns[1].text == long and got[2].learned == long and "[INST]" not in got[2].formatted


def brute_components(texts, width, percent):
    sets = {i: set(shingle_set(t, width).tolist()) for i, t in texts.items()}
    of = {i: i for i in texts}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    of[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "hot"), [(2, None), (5, None), (2, 3), (5, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, hot):
    if hot:  # nearly all buckets are split
        monkeypatch.setattr(near_dedup, "HOT", hot)
        monkeypatch.setattr(near_dedup, "SHARED", 1)
        monkeypatch.setattr(near_dedup, "PARTS", 4)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = {}
    for base in range(6):
        own = [word() for _ in range(120)]
        family = [own]
        for _ in range(14):  # copies of copies
            copy = list(rng.choice(family))
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            family.append(copy)
        for x in family:
            texts[len(texts) * 7 + base] = " ".join(x)
    texts |= {9001: "", 9002: None, 9003: "one", 9004: "ONE", 9005: "a b c", 9006: "A  b\nc", 9007: "a b c d", 9008: " \t", 9009: "x " * 50000}
    rows = [*texts.items(), (9005, "a b c"), (None, "a b c")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")), width=width).collect()
    want, sizes = brute_components(texts, width, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("hot", [1 << 20, 2])
def test_open_buckets_are_finished(spark, monkeypatch, hot):
    """A chain in which no member is near the bucket's first: later rounds must link it."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "SHARED", hot)
    base = [f"w{i}" for i in range(200)]
    texts, own = {0: " ".join(base)}, list(base)
    for i in range(1, 30):
        own = list(own)
        own[i * 3 : i * 3 + 3] = [f"x{i}a", f"x{i}b", f"x{i}c"]
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2).collect()}
    assert got == brute_components(texts, 2, 80)[0]


def test_deduplicated_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "other words are here now"), (None, "a b c d e f"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id or 0 for r in near_dedup.deduplicated(docs).collect()) == [0, 1, 3, 4]
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_one_key_with_different_texts(spark):
    """Texts of one key are told apart: a clean one stays although the other is a copy, and no group is lost with its first text."""
    copy = " ".join(f"w{i}" for i in range(40))
    rows = [(5, copy, "a"), (5, "a clean text that nobody else has written", "b"), (5, copy, "c"), (3, copy, "d"), (9, "", "e"), (9, "", "f"), (9, None, "g"), (None, copy, "h"), (7, copy + " more", "i")]
    docs = spark.createDataFrame(rows, DOCS + ", _i string")
    got = sorted((r.doc_id or 0, r.text or "", r.text is None) for r in near_dedup.deduplicated(docs, width=5).collect())
    assert [(k, t) for k, t, _ in got] == [(0, copy), (3, copy), (5, rows[1][1]), (9, "")]
    assert near_dedup.deduplicated(docs).columns == docs.columns


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.id: r.label for r in near_dedup.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_words_of_the_contract():
    assert words("A\x0bÉ\xa0b c\x1cd") == ["a".encode(), "É\xa0b".encode(), b"c\x1cd"] and words(None) == []


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "MOST", 40 * 8)  # several shards, in several rounds
    monkeypatch.setattr(exact_topk, "LEAST", 10 * 8)
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.3, (150, 8)).astype(np.float32)
    x[10:40] = x[9]  # ties
    x[0] = 0
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(160, None), (180, [None] * 8), (200, [float("nan")] * 8), (None, [1.0] * 8), (220, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in exact_topk.top_k(df, F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 150, 20):
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(150) if i != q))[:5]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert set(got) == set(range(0, 150, 20))
    assert exact_topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def brute(rows, scale=64, k=20):
    """Winners of every query by Python's integers, over vectors of one length."""
    v = {}
    for key, x in rows:
        v.setdefault(len(x), []).append((key, [math.floor(scale * c) for c in x]))
    out = {}
    for same in v.values():
        for key, w in same:
            if key % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(w, x, strict=True)), other) for other, x in same if other != key)
                out[key] = [(other, -s) for s, other in best[:k]]
    return out


def found(df, **options):
    out = {}
    for r in exact_topk.top_k(df, F.col("id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("size", [1 << 4, 1 << 11, 1 << 22, 1 << 29])
def test_top_k_is_exact_at_every_size(spark, monkeypatch, size):
    monkeypatch.setattr(exact_topk, "MOST", 4 * 5)  # thirty shards, in two rounds
    rng = np.random.default_rng(size)
    rows = [(i, [float(c) for c in rng.integers(-size, size, 5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(df, k=7, scale=1) == brute(rows, 1, 7)


def test_top_k_beyond_a_long(spark):
    small = [(0, [4e9, 4e9]), (1, [-4e9, -4e9]), (2, [4e9, -4e9])]
    df = spark.createDataFrame(small, "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        found(df, scale=1)
    held = [(0, [4e9, 4e9, 1.0]), (2, [4e9, -4e9, 3.0]), (4, [-4e9, 4e9, 5.0])]  # large products, scores within a long
    assert found(spark.createDataFrame(held, "vec_id bigint, embedding array<double>"), scale=1) == brute(held, 1)


def test_top_k_of_every_length_and_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "MOST", 12)
    monkeypatch.setattr(exact_topk, "LEAST", 6)
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 1 + i % 3)]) for i in range(70)]
    rows += [(7, [1.0, 1.0])] * 30 + [(100, [0.5, 0.5, 0.5, 0.5])]  # one key with many rows; a vector of its own length
    got = found(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert got == {q: x for q, x in brute(rows).items() if x}
    assert 100 not in got



def test_threshold_stops_before_the_end():
    x = np.zeros((4000, 2), np.int64)
    x[:, 0] = np.arange(4000)
    lists = exact_topk.SortedLists(np.arange(4000), x)
    keys, scores = lists.search(-1, np.array([1, 0]), 5)
    assert keys.tolist() == [3999, 3998, 3997, 3996, 3995] and scores[0] == 3999 and lists.scored < 200
    assert lists.search(-1, np.array([1, 0]), 5, 3998)[0].tolist() == [3999, 3998]  # nothing below the score so far
    assert lists.search(-1, np.array([1, 0]), 5, 4001)[0].tolist() == []


PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize(("chunk", "times", "sent"), [(warc.CHUNK, 30_000, 500_000), (100, 900, 0), (7, 900, 500_000)])
def test_warc_round_trip(spark, monkeypatch, chunk, times, sent):
    monkeypatch.setattr(common, "SENT_KEYS", sent)
    long = "é<p>\r\n\r\n" * times
    rows = [(1, "http://a\r\nX: y", long), (2, None, long), (5, "u", long), (5, "u", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 99)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    chunks = warc.written(pages, chunk=chunk)
    got = warc.read_archives(chunks).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 5) if r.page_id in (1, 2, None) else ("response", None))
    assert warc.read_archives(warc.written(pages.limit(0))).count() == 0


def test_warc_writes_oversized_records_in_small_batches():
    size = 40 << 20
    pages = pa.RecordBatch.from_pydict({"key": [1, 2], "url": ["u", "v"], "payload": ["x" * size, "y"], "digest": pa.array([None, None], pa.string()), "size": pa.array([None, None], pa.int64()), "refers_to": pa.array([None, None], pa.int64())})
    reader, rows, last = warc.Reader(), [], 0
    for batch in warc.chunk_batches(iter([pages]), 0, warc.CHUNK):
        assert batch.nbytes <= 2 * warc.BATCH
        for data, k, n in zip(batch.column("data"), batch.column("chunk").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            reader = warc.Reader() if k == 0 else reader
            reader.add(data.as_py())
            assert len(reader.pending) <= 4 and k == (last + 1 if k else 0)
            last = k
            if k == n - 1:
                rows.append(reader.row())
    assert [r[:4] for r in rows] == [(1, size, hashlib.sha1(b"x" * size).hexdigest(), "response"), (2, 1, hashlib.sha1(b"y").hexdigest(), "response")]


def test_warc_damage_is_seen():
    reader = warc.Reader()
    reader.add(warc.header(1, "u", "response", hashlib.sha1(b"abc").hexdigest(), 3, None) + b"abX\r\n\r\n")
    with pytest.raises(ValueError):
        reader.row()


def test_stored_keeps_rows(spark):
    assert stored(spark.range(5)).count() == 5


def test_top_k_of_repeated_query_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(0, [0.5, 1.0]), (0, [0.5, 1.0]), (0, [-1.0, 0.25])] + [(i, [float(x) for x in rng.normal(size=2)]) for i in range(1, 30) if i % 20]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = exact_topk.top_k(df, F.col("id") % 20 == 0).collect()
    want = []
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    for i, v in (r for r in whole if r[0] % 20 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i)[:20]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(ranked, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want) and len(got) == 60


def test_top_k_fails_where_a_component_is_no_long(spark):
    df = spark.createDataFrame([(0, [1 / 64]), (1, [1e30]), (2, [0.5])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        exact_topk.top_k(df, F.col("id") % 20 == 0).collect()
