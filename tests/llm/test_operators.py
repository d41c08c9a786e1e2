"""Each operator on odd rows, on an empty table, and against a brute-force version."""

import collections
import hashlib
import itertools
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driverscope.llm import blocks, exact, jaccard, licences, lines, mixing, neighbours, packing, quality, toxicity
from driverscope.llm.common import ChunkTokens, tokenizer_file
from driverscope.llm.components import components
from driverscope.session import scratch_path

TOKENIZER = Tokenizer.from_file(tokenizer_file())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# tokens


@pytest.mark.parametrize("text", ["", "don't WON'T. it's", "ß ªº µ Straße", "x<|endoftext|>y <|startoftext|>", "a b\u0085c", "\x1c a \x1f", "L'été, c'est 's.", "ÀÉÎ!! shti*** a,'t", "日本語 テスト", "é É", "İ ΣΑΣ.", "a" * 500])
def test_chunks_encode_as_whole_texts(text):
    assert np.frombuffer(ChunkTokens(tokenizer_file()).ids(text), "<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 1000])
def test_blocks_round_trip(size):
    ids = np.random.RandomState(size).randint(0, 50_000, size)
    ids[::50] = 2**32 - 1
    image = blocks.encode(ids)
    assert (blocks.decode(image) == ids).all()
    assert (blocks.decode(image, 1, 3) == ids[128:384]).all()
    assert len(blocks.encode(np.full(1280, 70_000))) < 200


def token_rows(spark, docs):
    folder = scratch_path(spark, "tokens")
    blocks.write_tokens(docs, folder, segment_tokens=5000)
    return blocks.read_tokens(spark, folder, with_ids=True)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_token_files_hold_every_text(spark, request, name):
    docs = request.getfixturevalue(name)
    got = sorted(token_rows(spark, docs).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert all(len(r.ids) == r.n_tokens and crc(r.ids) == r.ids_crc32 for r in got)
    want = collections.Counter((r.doc_id, crc(ids_of(r.text))) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_no_tokens_of_an_empty_table(spark, empty):
    assert token_rows(spark, empty).count() == 0 and packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_packing_places_every_id_once(request, name):
    docs = request.getfixturevalue(name)
    pieces = packing.pack_documents(docs, shard_tokens=40_000).collect()
    filled = collections.defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 2048
    shards = len({s >> 32 for s in filled})
    assert sum(sum(n for _, n in own) < 2048 for own in filled.values()) <= shards
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += len(ids_of(r.text))
    got = collections.Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    ids = {r.doc_id: ids_of(r.text) for r in docs.collect()}
    once = [p for p in pieces if p.doc_id is not None and p.doc_id != 20]
    assert all(p.doc_tokens == len(ids[p.doc_id]) and crc(ids[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32 for p in once)


def test_neighbours_fill_a_window_by_score():
    rare = [np.array([1, 2, 3] * 10), np.array([7, 8, 9] * 10), np.array([1, 2, 3] * 9)]
    index = packing.InvertedIndex(rare, np.ones(20), 30.0)
    pieces = packing.fill([30, 30, 27], index.scores, 57)
    assert pieces[:2] == [(0, 0, 30, 0, 0), (2, 0, 27, 0, 30)]


# copies


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_exact_copies(request, name):
    docs = request.getfixturevalue(name)
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    keep = {t: max((d for d in own if d is not None), default=None) for t, own in groups.items()}
    want = sorted((str(r.doc_id), str(keep[r.text or ""]), len(groups[r.text or ""]), r.doc_id == keep[r.text or ""], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in exact.exact_copies(docs, bucket_rows=7).collect()) == want


def test_cuckoo_index_grows_deletes_and_verifies():
    index = exact.CuckooIndex(8)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    assert not any(index.insert(k) for k in keys)
    assert all(k in index for k in keys) and index.insert(keys[0])
    twin = keys[1][:16] + b"\0" * 16  # same places, same fingerprint, another digest
    assert twin not in index
    assert index.delete(keys[0]) and keys[0] in index and index.delete(keys[0]) and keys[0] not in index
    assert not index.delete(keys[0])
    assert all(k in index for k in keys[1:])


def test_index_changes(spark):
    docs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    index = exact.build_index(docs, 3)
    changes = spark.createDataFrame([("a", True), ("b", True), ("c", None), ("d", True)], "text string, deleted boolean")
    got = {(r.digest, r.n) for r in exact.change_index(index, changes, 3).collect()}
    assert got == {(hashlib.sha256(t).hexdigest(), 1) for t in (b"a", b"c", b"")}


def brute_links(rows, width, num, den):
    sets = []
    for r in rows:
        own = [w.decode() for w in (r.text or "").encode().lower().split()]
        k = min(width, len(own))
        sets.append({tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if k else set())
    near = collections.defaultdict(set)
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            near[a].add(b)
            near[b].add(a)
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        least = min((rows[x].doc_id for x in seen if rows[x].doc_id is not None), default=None)
        out.append((str(r.doc_id), len(sets[k]), str(least), len(near[k])))
    return sorted(out)


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 8, 10)])
def test_similar_sets(request, name, width, num, den):
    docs = request.getfixturevalue(name)
    got = jaccard.similar_sets(docs, width, Fraction(num, den), unit_sets=3)
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect()) == brute_links(docs.collect(), width, num, den)


def test_many_near_copies_in_blocks(spark):
    text = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(text[:j] + [f"new{k}"] + text[j + 1 :])) for k, j in enumerate(list(range(0, 120, 2)) + [5] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_sets(docs, 4, Fraction(85, 100), unit_sets=7)
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect()) == brute_links(docs.collect(), 4, 85, 100)


def test_one_document_of_each_group_stays(odd):
    kept = jaccard.one_per_group(odd, width=5, threshold=0.8)
    assert kept.columns == odd.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == {**{k: 1 for k in (0, 1, 2, 3, 5, 6, 10, 12, 13, 14)}, None: 2}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)], "u long, v long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}


# lines


@pytest.mark.parametrize("name,sites", [("odd", 2), ("documents", 3), ("empty", 2)])
def test_lines_on_many_sites_go(request, name, sites):
    docs = request.getfixturevalue(name)
    rows, spread = docs.collect(), collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if r.source is not None and line.strip(" "):
                spread[line.strip(" ")].add(r.source)
    common = {line for line, own in spread.items() if len(own) >= sites}
    want = []
    for r in rows:
        own = (r.text or "").split("\n")
        kept = [line for line in own if line.strip(" ") not in common]
        text = r.text if len(kept) == len(own) else "\n".join(kept)
        want.append((str(r.doc_id), str(text), len(own), len(own) - len(kept)))
    cleaned = lines.remove_boilerplate(docs, sites)
    assert set(docs.columns) < set(cleaned.columns)
    assert sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_removed) for r in cleaned.collect()) == sorted(want)


# mixing


def brute_targets(sizes, cycle=3, most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, full = {s: k % cycle + 1 for k, s in enumerate(order)}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_mix_meets_its_targets(request, name):
    docs = request.getfixturevalue(name)
    rows, got = docs.collect(), mixing.mix(docs).collect()
    assert collections.Counter((r.doc_id, len(words(r.text))) for r in rows) == collections.Counter((r.doc_id, r.size) for r in got)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.chosen * r.size and r.source_size == sizes[r.source]
    targets = brute_targets(dict(sizes)) if rows else {}
    for r in got:
        assert r.target == pytest.approx(targets[r.source])
    if name == "documents":
        assert all(abs(taken[s] - targets[s]) <= 0.1 * targets[s] for s in targets)
        assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_take_repeats_whole_documents(documents):
    mixed = mixing.mix(documents)
    taken = collections.Counter(r.doc_id for r in mixing.take(documents, mixed).collect())
    assert taken == +collections.Counter({r.doc_id: r.chosen for r in mixed.collect()})


def test_full_sources_stop_at_the_cap(spark):
    rows = [(k, " ".join(["w"] * (k % 5 + 1)), "big" if k else "a") for k in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r.taken for r in got if r.source == "a"] == [3 * r.size for r in got if r.source == "a"]


def test_a_gap_is_filled_until_nothing_fits(spark):
    """Long rows overflow early; shorter ones that fit stand far behind them in the order."""
    rows = [(k, " ".join(["w"] * (3 + k % 5 if k % 23 == 7 else 300 + 371 * (k % 19))), f"s{k % 12}") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slice_rows=40).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    drawn = [r for r in got if r.copies % 1 > 1e-12]
    assert len({r.source for r in drawn}) == 12
    for r in drawn:
        left = r.target - taken[r.source]
        assert r.chosen > int(r.copies) or r.size > left
        # no other closing row comes nearer
        assert r.chosen > int(r.copies) or abs(left - r.size) >= abs(left)


# models


def test_ordinal_weights_are_shared_and_cuts_ordered():
    random = np.random.RandomState(3)
    x = random.rand(2000)
    grades = np.digitize(4 * x + random.logistic(0, 0.1, 2000), [1.0, 2.0, 3.0])
    weights, cuts = toxicity.fit_ordinal(np.arange(2000), np.zeros(2000, int), x, grades, 1)
    assert weights[0] > 0 and (np.diff(cuts) > 0).all()
    model = toxicity.OrdinalModel(["f"], weights, cuts)
    expected = model.at_least(weights[0] * x).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_toxicity_finds_what_labels_show(spark, odd, empty):
    rows = [(k, f"plain words number {k} here " + ("grumbleword, again" if k % 6 == 0 else "and there"), k % 6 == 0) for k in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t)) for k, _, t in rows if k < 180] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.severity(docs, labels).collect()}
    assert got == {k: t for k, _, t in rows}
    kept = toxicity.without_toxic(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {k for k, _, t in rows if not t}
    assert toxicity.severity(odd, labels).count() == odd.count() and toxicity.without_toxic(odd, labels).columns == odd.columns
    assert toxicity.severity(empty, labels).count() == 0
    assert not any(r.toxic for r in toxicity.severity(odd, labels.limit(0)).collect())


def test_quality_from_positives_alone(spark, odd, empty):
    rows = [(k, f"Some plain words of document {k}, quite readable." if k % 4 else "WORD!! " * 20 + str(k)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 2000) if k % 4 and k % 3 == 0], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    apart = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in apart) >= 0.95 * len(apart)
    assert quality.quality(odd, labels).count() == odd.count() and quality.quality(empty, labels).count() == 0
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


def test_measures_equal_plain_counts():
    import pyarrow as pa

    texts = ["", "Aa a a!", "x", "É ñ\nUP", " lead  trail "]
    got = quality.TextMeasures().of(pa.array(texts))
    for text, row in zip(texts, got):
        own = text.encode().lower().split()
        named = dict(zip(quality.MEASURES, row))
        assert named["upper"] == pytest.approx(sum(c.isascii() and c.isupper() for c in text) / max(1, len(text.encode())))
        assert named["distinct"] == (len(set(own)) / len(own) if own else 1)
        assert named["repeats"] == pytest.approx(sum(a == b for a, b in zip(own, own[1:])) / max(1, len(own) - 1))


# vectors


def test_nearest_vectors(spark):
    random = np.random.RandomState(5)
    rows = [(k, random.standard_normal(16).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[200][1]) for k in range(40)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (None, [1.0] * 16), (5300, [1.0, None]), (6000, [1.0, 2.0]), (6001, [1.0, 3.0]), (5400, [float("inf")] + [1.0] * 15), (6100, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    assert got.keys() == {i for i, _ in fine if i % 100 == 0}
    hits = total = 0
    for q, v in fine:
        if q % 100 == 0:
            want = sorted((float(np.sqrt(((v - u) ** 2).sum())), i) for i, u in fine if i != q and len(u) == len(v))[:10]
            assert len(got[q]) == len(want) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
            hits += len({i for i, _ in got[q]} & {i for _, i in want})
            total += len(want)
    assert hits >= 0.95 * total
    assert [i for i, _ in got[200]] == list(range(2000, 2010))
    assert neighbours.nearest(vectors.limit(0)).count() == 0


def test_repeated_rows_take_no_places(spark):
    random = np.random.RandomState(6)
    rows = [(k, random.standard_normal(8).tolist()) for k in range(300)] + [(1000 + k, [0.0] + [1.0] * 7) for k in range(12)]
    rows = [r for r in rows for _ in range(12)] + [(1000, [-0.0] + [1.0] * 7)] * 12
    once = {i: np.array(v) for i, v in rows}
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sure=0.999999).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got.keys() == {0, 100, 200, 1000}
    for q, found in got.items():
        assert found == [i for _, i in sorted((float(np.sqrt(((once[q] - v) ** 2).sum())), i) for i, v in once.items() if i != q)[:10]]


def test_stopping_ratio_is_a_chi_square_quantile():
    assert neighbours.stopping_ratio(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
    assert neighbours.stopping_ratio(0.99, 2) == pytest.approx(9.2103, abs=1e-3)


# licences


def test_licences_come_down_from_the_nearest_directory(spark, empty):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("a/LICENSE", mit), ("a/x.py", "code here"), ("a/b/y.py", "more code"), ("a/b/c/LICENSE.txt", apache), ("a/b/c/d/z.py", "deep"), ("a/own.py", f"# intro\n{apache}\ncode of many other words that are not licences"),
        ("e/f.py", "nothing"), ("ab/x.py", "not below a"), ("top.py", None), (None, mit), ("a/x.py", "code here"), ("g/LICENSE", mit), ("g/COPYING", apache), ("g/h", ""),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "path string, text string, licence string")
    got = {r.path: (r.licence, r.origin, r.licence_path) for r in licences.scan(files).collect()}
    assert licences.scan(files).count() == len(rows)
    assert got["a/x.py"] == got["a/b/y.py"] == ("MIT", "inherited", "a/LICENSE")
    assert got["a/b/c/d/z.py"] == ("Apache-2.0", "inherited", "a/b/c/LICENSE.txt")
    assert got["a/own.py"][:2] == ("Apache-2.0", "own") and got["a/LICENSE"][:2] == ("MIT", "own")
    assert got["e/f.py"] == got["ab/x.py"] == got["top.py"] == (None, None, None)
    assert got[None][0] == "MIT" and got["g/h"][1:] == ("inherited", "g/COPYING")
    assert licences.scan(empty.select(F.col("lang").alias("path"), "text")).count() == 0


def test_rare_terms_are_needed():
    templates = licences.Templates(licences.TEMPLATES, 1000, {t: 900 for t in ("the", "of", "is", "this", "and", "in", "to")})
    rare = templates.rare(0.6)
    for _, own in templates.rows:
        assert templates.best(" ".join(own - rare))[0] < 0.6


HEADERS = {
    "GPL-2.0": """ * hello.c - says hello
 *
 * Copyright (C) 2004 Jane Roe
 *
 * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 */""",
    "LGPL-2.1": """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Affero General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


def test_usual_headers_have_their_own_name(spark):
    rows = [(f"{name}/x.c", f"{header}\n\nint main() {{ return 0; }}") for name, header in HEADERS.items()]
    rows += [(f"plain/{k}", "some of the other files under this and that, version 2 or 3") for k in range(40)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.licence for r in licences.scan(files).collect()}
    assert {name: got[f"{name}/x.c"] for name in HEADERS} == {name: name for name in HEADERS}
    assert all(got[f"plain/{k}"] is None for k in range(40))
