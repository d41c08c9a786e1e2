"""Resampling, hard negatives and subword pieces: odd rows, empty tables, brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.llm import hard_negatives, pieces, resampling

MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_file())


# resampling


def plain_features(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("text", ["", " ", "one", "One, TWO", "a-b\u0085c d\x00e\x7ff", "ÄB äb 日本 x1y", "x " * 70_000, "q" * 200_000])
def test_scanner_finds_all_runs(text, width):
    n, got = resampling.NgramScanner(width).hashes(text)
    words, want = plain_features(text, width)
    assert n == words and collections.Counter(got.tolist()) == collections.Counter(zlib.crc32(f.encode()) for f in want)


def plain_resample(docs, target, share=25, least=20, buckets=10_000):
    raw = [(d, *plain_features(t, 2)) for d, t in docs]
    hashed = [[zlib.crc32(f.encode()) % buckets for f in fs] for _, _, fs in raw]
    s, t = collections.Counter(b for h in hashed for b in h), collections.Counter(zlib.crc32(f.encode()) % buckets for x in target for f in plain_features(x, 2)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + buckets)) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (doc, words, _), own in zip(raw, hashed):
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, words >= least, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1]), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[2]))
    drawn = share * len(enough) // 100
    out = [(d, n, w, x, k + 1 if k < drawn else None) for k, (d, _, n, w, x) in enumerate(enough)]
    return collections.Counter(out + [(d, n, w, x, None) for d, e, n, w, x in rows if not e])


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_resampling_equals_plain(spark, request, name):
    docs = request.getfixturevalue(name)
    target = spark.createDataFrame([("alpha0 delta1 theta the of and",), (None,), ("",)], "text string")
    got = collections.Counter(tuple(r) for r in resampling.resample(docs, target).collect())
    assert got == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_resampling_of_empty_tables_and_many_buckets(spark, odd, empty):
    assert resampling.resample(empty, odd).count() == 0
    rows = resampling.resample(odd, empty, buckets=70_000).collect()
    assert len(rows) == odd.count() and sum(r.rank is not None for r in rows) > 0
    with pytest.raises(ValueError):
        resampling.resample(odd, empty, buckets=0)


def test_resampling_draws_repeats_one_by_one(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.range(400).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    ranks = sorted(r.rank for r in resampling.resample(docs, docs).collect() if r.rank is not None)
    assert ranks == list(range(1, 101))


# hard negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("dim", T.IntegerType())])


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90, every=100):
    known = set()
    for r in rows:
        v = r[1]
        if r[0] is None or r[2] is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.add((r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = collections.Counter()
    for a, label, v in known:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in known if i != a and len(w) == len(v)]
        near = sorted((s, i) for s, i, k in scored if k == label)[:positives]
        far = sorted((s, i) for s, i, k in scored if k != label)
        for ps, p in near:
            window = [(s, i) for s, i in far if low * -ps <= 100 * -s <= high * -ps]
            out.update((a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(window[:negatives]))
    return out


def found(frame):
    return collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in frame.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(3)
    rows = [(k, [r.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], r.randrange(4), "x", 1) for k in range(900)]
    rows += [(1000 + k, rows[k][1], rows[k][2], None, None) for k in range(100)]
    rows += [(1100, None, 1, "", 0), (1200, [None] * 6, 1, "", 0), (1300, [float("nan")] * 6, 1, "", 0), (1400, [float("inf")] * 6, 2, "", 0), (1500, [1.0] * 6, None, "", 0)]
    rows += [(None, [1.0] * 6, 1, "", 0), (1600, [0.0] * 6, 1, "", 0), (1700, [], 1, "", 0), (1701, [], 1, "", 0), (1800, [1.0, 2.0], 1, "", 0), (1801, [1.0, 2.0], 1, "", 0), (1802, [0.5, 1.0], 2, "", 0)]
    rows += [rows[100], rows[100], (200, [0.25] * 6, 1, "", 0), (-100, [0.5] * 6, 1, "", 0)]
    return spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("options", [{}, {"anchor_block": 3, "cell_work": 1000}, {"positives": 2, "negatives": 3, "low": 0, "high": 100}])
def test_hard_negatives_equal_plain(vectors, options):
    sizes = {k: v for k, v in options.items() if k not in ("anchor_block", "cell_work")}
    want = plain_negatives([tuple(r) for r in vectors.collect()], **sizes)
    assert len(want) > 50 and found(hard_negatives.hard_negatives(vectors, **options)) == want


def test_hard_negatives_of_odd_tables(spark, vectors):
    assert hard_negatives.hard_negatives(vectors.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(vectors.where("vec_id % 100 <> 0")).count() == 0
    assert hard_negatives.hard_negatives(vectors.where("label = 1 AND vec_id % 7 <> 0")).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(vectors, low=95)


def test_large_components_stay_exact(spark):
    big = float(2**23)  # times 256 and squared 2^62, far beyond exact doubles
    rows = [(100, [big, 1.0], 1), (1, [big, 0.0], 1), (2, [big / 2, 1.0], 2), (3, [big / 2, 3.0], 2), (4, [big / 2, 2.0], 2)]
    frame = spark.createDataFrame([(i, v, k, None, None) for i, v, k in rows], VECTORS)
    got = hard_negatives.hard_negatives(frame).orderBy("rank").collect()
    assert [(r.negative_id, r.negative_score - 2**61) for r in got] == [(3, 3 * 65536), (4, 2 * 65536), (2, 65536)]


def test_blocks_do_not_depend_on_their_size():
    r = np.random.RandomState(5)
    scores, ids = r.randint(-20, 20, (4, 500)), r.permutation(500)
    upper = np.sort(r.randint(-20, 20, (4, 3)), axis=1)[:, ::-1].copy()
    low = np.full(4, -15)
    results = []
    for step in (1, 7, 500):
        slots = hard_negatives.Slots(upper, low, 5)
        for k in range(0, 500, step):
            slots.offer(0, scores[:, k : k + step], ids[k : k + step], np.ones((4, min(step, 500 - k)), bool))
        results.append(sorted(zip(*(c.tolist() for c in slots.columns(np.arange(4))))))
    want = []
    for a in range(4):
        for j in range(3):
            bottom = max(-15, upper[a, j + 1] + 1 if j < 2 else -15)
            best = sorted((-s, i) for s, i in zip(scores[a].tolist(), ids.tolist()) if bottom <= s <= upper[a, j])[:5]
            want += [(a, j, i, -s) for s, i in best]
    assert results[0] == results[1] == results[2] == sorted(want)


# pieces


@pytest.fixture(scope="module")
def piece_table():
    return pieces.PieceTable(pieces.piece_file())


def odd_texts():
    r = random.Random(11)
    names = [MODEL.id_to_piece(i) for i in range(MODEL.get_piece_size())]
    yield from ["", " ", "  ", "\n", " a  b ", "▁x", "▁▁ x", "<s></s><unk>", "<0x41>", "\x00\t\x1f\x7f", "ﬁ é é", "日本語テキスト", "\U0001F600\U0010FFFF�", " " * 100, "a" * 5000, "=" * 999, "ab" * 3000 + "  " * 77]
    for _ in range(4000):
        yield "".join(r.choice("ab  \n\t▁eé日x😀ing.,0") for _ in range(r.randint(0, 40)))
        yield "".join(r.choice(names).replace("▁", " ") for _ in range(r.randint(0, 8)))
        yield "".join(chr(r.choice([r.randint(0, 127), r.randint(128, 0x2FFF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 20)))


def test_pieces_equal_the_library(piece_table):
    for text in odd_texts():
        ids = piece_table.encode(text)
        assert ids.tolist() == MODEL.encode(text), repr(text)
        assert piece_table.decode(ids) == MODEL.decode(ids.tolist()), repr(text)


def test_every_piece_encodes_as_in_the_library(piece_table):
    for i in range(MODEL.get_piece_size()):
        text = MODEL.id_to_piece(i).replace("▁", " ")
        assert piece_table.encode(text).tolist() == MODEL.encode(text)


def test_any_ids_decode_as_in_the_library(piece_table):
    r = random.Random(2)
    for _ in range(20_000):
        ids = [r.randrange(*r.choice([(0, 3), (3, 259), (195, 259), (259, 300), (0, 32_000)])) for _ in range(r.randint(0, 7))]
        assert piece_table.decode(np.array(ids, int)) == MODEL.decode(ids), ids


def test_full_caches_change_nothing():
    table = pieces.PieceTable(pieces.piece_file())
    table.limit = 5
    for text in ["the quick brown fox jumps over the lazy dog", "over the lazy dog  the quick"]:
        assert table.encode(text).tolist() == MODEL.encode(text)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_digests_of_documents(request, name):
    docs = request.getfixturevalue(name)
    want = collections.Counter()
    for r in docs.collect():
        ids = MODEL.encode(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in pieces.digests(docs).collect()) == want


def test_ids_decode_on_their_own(spark, odd, empty):
    rows = pieces.round_trip(odd.where("doc_id < 15")).select("doc_id", "ids", F.lit("kept").alias("text"))
    texts = {r.doc_id: r.text for r in odd.collect()}
    got = pieces.decode_ids(rows.unionByName(spark.createDataFrame([(99, None, None)], "doc_id long, ids array<int>, text string"))).collect()
    assert {r.doc_id: r.decoded for r in got if r.doc_id != 99} == {d: MODEL.decode(MODEL.encode(t or "")) for d, t in texts.items() if d is not None and d < 15}
    assert [(r.decoded, r.text) for r in got if r.doc_id == 99] == [(None, None)] and all(r.text == "kept" for r in got if r.doc_id != 99)
    assert pieces.round_trip(empty).count() == 0


# earlier operators on rows that once went wrong


def test_packing_keeps_large_ids_beside_missing_ones(spark):
    from driverscope.llm import packing

    ids = [9007199254740993, 9007199254740995, None, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text {k} of some words") for k, i in enumerate(ids)], "doc_id long, text string")
    assert collections.Counter(r.doc_id for r in packing.pack_documents(docs).collect()) == collections.Counter(ids)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 300, 2000])
def test_documents_come_by_score_and_order(size):
    from driverscope.llm import packing

    r = np.random.RandomState(size)
    for scores in (r.rand(size), r.randint(0, 4, size).astype(float), np.zeros(size)):
        assert list(packing.by_score(scores, 16)) == np.argsort(-scores, kind="stable").tolist()


def test_bm25_weights_equal_their_formula():
    from driverscope.llm import packing

    r = np.random.RandomState(1)
    docs = [r.randint(0, 30, n) for n in (5, 40, 1, 80, 12)]
    idf, mean = r.rand(30), 27.6
    index = packing.InvertedIndex(docs, idf, mean)
    for seed in range(5):
        want = [sum(idf[t] * list(d).count(t) * 2.2 / (list(d).count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[seed].tolist()) if t in d) for d in docs]
        np.testing.assert_allclose(index.scores(seed), want)


def test_unlinked_text_of_a_repeated_id_stays(spark):
    from driverscope.llm import jaccard

    a = " ".join(f"a{k}" for k in range(40))
    b = " ".join(f"b{k}" for k in range(40))
    unique = " ".join(f"u{k}" for k in range(40))
    rows = [(1, a), (5, a), (5, unique), (5, b), (8, b + " more"), (5, b)]
    kept = jaccard.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"), width=5, threshold=0.8)
    assert sorted(map(tuple, kept.collect())) == sorted([(1, a), (5, unique), (5, b)])


@pytest.mark.parametrize("lead", ["", " ", " \n ", "x ", "xyz  "])
def test_words_hash_alike_wherever_they_stand(lead):
    from driverscope.llm.common import WordHasher

    text = f"{lead}one ONE  oNe eno on\tone".encode()
    hashes, ends = WordHasher().words(np.frombuffer(text, np.uint8), np.array([len(text)]))
    tail = hashes[-6:].tolist()
    assert tail[0] == tail[1] == tail[2] == tail[5] and len(set(tail)) == 3 and ends.tolist() == [len(hashes)]


def test_words_that_cancel_in_a_polynomial_have_their_own_hashes(spark):
    from driverscope.llm import jaccard

    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    docs = spark.createDataFrame([(1, f"{one} x y z"), (2, f"{two} x y z")], "doc_id long, text string")
    assert {r.n_links for r in jaccard.similar_sets(docs, width=4, threshold=0.85).collect()} == {0}


def test_token_cache_holds_bounded_memory():
    from driverscope.llm.common import ChunkTokens, tokenizer_file

    cache = ChunkTokens(tokenizer_file(), "<u2")
    cache.limit = 20_000
    for k in range(2000):
        cache.ids(f"word{k} x{k}y")
    assert sum(cache.entry + len(k) + len(v) for part in (cache, cache.before) for k, v in part.items()) <= cache.limit + 500
