"""Corpus operators against brute force, with nulls, empties, ties, repeated rows, clashing names and empty tables."""

import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from obsidra.llm import hashforest, induced, licenses, mixing, orderhash, quality, rangejoin, recompression, sentencepieces, sharding, suffixdedup
from obsidra.llm.common import word_hashes
from obsidra.llm.components import components
from obsidra.llm.queries import PIECE_MODEL, op5_sql

SCHEMA = "doc_id long, text string, source string, n_words string, `range` string"


def documents(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text, source) with two columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], schema)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["é", "ß", "the", "of"]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 19, 20, 21, 80, 150]))]
        if i % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = passage[rng.randrange(20) :]
        if i % 7 == 0:
            text += ["spam"] * 45
        out.append((i, rng.choice([" ", "\n", "  "]).join(text), f"s{i % 4}"))
    out += [(n, None, None), (n + 1, "", "s0"), (n + 2, out[5][1], "s1"), (n + 3, out[3][1] + " tail", "s0"), (None, "no id", "s2"), (n + 4, "a" * 5000, "s0"), (n + 4, "a" * 5000, "s0")]
    return out


def words_of(text):
    return (text or "").encode().split()


def brute_words(rows, width):
    first, out = {}, []
    unique = sorted({(i if i is not None else -1, t or "") for i, t, _ in rows})
    for i, t in unique:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if key in first:
                gone[p : p + width] = [True] * width
            else:
                first[key] = (i, p)
        out.append((i, t, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return {(i, t): r for i, t, *r in out}


@pytest.mark.parametrize("width", [5, 20])
def test_recompression_equals_brute_force(spark, width):
    rows = corpus()
    got = recompression.substring_dedup(documents(spark, rows).withColumn("t", F.col("text")), width).collect()
    want = brute_words(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert [r["n_words"], r["n_removed"], r["kept_text"]] == want[(-1 if r["doc_id"] is None else r["doc_id"], r["t"] or "")]
        assert sum(s["length"] for s in r["removed"]) == r["n_removed"]
    assert "range" in recompression.substring_dedup(documents(spark, rows)).columns
    assert recompression.substring_dedup(documents(spark, [])).count() == 0


def common_prefix(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("memory, blocks, size", [(64 << 20, 1024, 60), (4096, 1024, 150), (1024, 8, 1200)])
def test_suffix_array_orders_suffixes(memory, blocks, size, monkeypatch):
    """Memory of 1 KiB sorts through several levels of names, queues on disk and blocks of letters."""
    monkeypatch.setattr(induced, "BLOCKS", blocks)
    rng = random.Random(2)
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 200])
        data = bytes(rng.randrange(letters) + rng.choice([0, 255 - letters]) for _ in range(rng.randrange(size)))
        data = (data * rng.choice([1, 1, 4]))[:size]
        pieces = list(induced.byte_suffixes(np.frombuffer(data, np.uint8), 10**6, memory))
        order = [int(x) for p in pieces for x in p[0]][::-1]
        shared = [int(x) for p in pieces for x in p[1]][::-1]
        assert order == sorted(range(len(data)), key=lambda i: data[i:])
        assert shared[:-1] == [common_prefix(data[a:], data[b:]) for a, b in zip(order, order[1:])]


def test_suffix_sort_of_a_shard_far_larger_than_memory():
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    data = " ".join(rng.choice(words) for _ in range(8000)).encode()
    data = np.frombuffer(data + data[1000:3000], np.uint8)
    got = induced.repeated(data, 200, len(data) // 10)
    assert (got == induced.repeated(data, 200)).all() and got.sum() == 2 * 1801


@pytest.mark.parametrize("width, hot, memory", [(12, 8192, 64 << 20), (12, 1, 4096), (200, 2, 64 << 20)])
def test_suffix_dedup_equals_brute_force(spark, width, hot, memory):
    rows = corpus(3)
    line = "this line stands in many texts, " * 5
    rows += [(1000 + i, f"{i * 7919} {line} {i * 104729} before" + ("and after " * 30 if i % 5 == 0 else ""), "s") for i in range(20)]
    unique = sorted({(i if i is not None else -1, t or "") for i, t, _ in rows})
    count = Counter(t.encode()[p : p + width] for _, t in unique for p in range(len(t.encode()) - width + 1))
    got = suffixdedup.suffix_dedup(documents(spark, rows).withColumn("t", F.col("text")), width, hot_runs=hot, memory=memory).collect()
    assert len(got) == len(rows)
    for r in got:
        b = (r["t"] or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        spans = [m.span() for m in re.finditer("1+", "".join("1" if g else "0" for g in gone))]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), sum(gone), len(spans))
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone) if not g)
        assert [(s["start"], s["start"] + s["length"]) for s in r["removed"]] == spans
    assert suffixdedup.suffix_dedup(documents(spark, [])).count() == 0


def test_sentencepiece_equals_the_library(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECE_MODEL)
    model = sentencepieces.load(PIECE_MODEL)
    rng = random.Random(4)
    texts = [None, "", " ", "  lead  trail  ", "ﬁ Å é\x00 x　y", "a▁b", "\n\t", "naïve 日本語 한국", "😀👩‍👩‍👧 zwj", "A" * 300, "." * 200, "x-1, (y)!"]
    texts += ["".join(rng.choice("abst ,.éüETA\n(){}0123") for _ in range(150)) for _ in range(150)]
    rows = documents(spark, [(i, t, "s") for i, t in enumerate([*texts, texts[3]])]).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in sentencepieces.encode(rows, model).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "")
        assert got[i]["round_trip"] and got[i]["n_ids"] == len(got[i]["ids"])
    back = sentencepieces.decode(sentencepieces.encode(rows, model), model)
    assert all(r["decoded_text"] == (r["text"] or "").replace("▁", " ") for r in back.collect())
    assert sentencepieces.encode(documents(spark, []), model).count() == 0


def test_unigram_model_takes_the_best_sum():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab"]
    model = sentencepieces.PieceModel(pieces, [0.0, -3.0, -2.0, -2.0, -1.0, -4.0, -6.0], [2, 1, 1, 1, 1, 1, 1], False)
    ids, bounds = sentencepieces.Encoder(model).encode(["ab", "aba"])
    assert [pieces[i] for i in ids[bounds[0] : bounds[1]]] == ["▁", "ab"]
    assert [pieces[i] for i in ids[bounds[1] : bounds[2]]] == ["▁", "ab", "a"]


def test_sharding_is_a_repeatable_permutation(spark):
    rows = corpus(5)
    d = documents(spark, rows)
    got = sharding.shard(d, 16).collect()
    again = sharding.shard(d.repartition(7), 16, bits=3).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    assert sharding.shard(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_bijection(n):
    out = sharding.feistel(np.arange(n), np.full(n, n), 9)
    assert sorted(out.tolist()) == list(range(n))


def vectors(seed=6, n=300, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    rows = []
    for i in range(n):
        v = base[i] if i % 3 else base[i // 9] + 0.1 * rng.normal(size=dim).astype(np.float32) * (i % 5)
        rows.append((i, [float(x) for x in v], i % 4 if i % 10 else None))
    rows += [(n, rows[5][1], rows[5][2]), (n + 1, rows[5][1], rows[5][2]), (n + 2, None, 1), (n + 3, [0.0] * dim, 1), (n + 4, [float("nan")] + [1.0] * (dim - 1), 1), (n + 5, [None] + [1.0] * (dim - 1), 2), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("cell", [4096, 8])
def test_range_join_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(rangejoin, "CELL_ROWS", cell)
    monkeypatch.setattr(rangejoin, "BLOCK_ROWS", 4096 if cell == 4096 else 16)
    rows = vectors()
    got = {r["vec_id"]: r for r in rangejoin.near_vectors(spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit(1)), 0.93).collect()}
    fine = {i: (np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = defaultdict(set)
    for a, (x, l) in fine.items():
        for b, (y, m) in fine.items():
            if a != b and l == m and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links[a].add(b)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), min(seen), min(seen) == i)
    assert rangejoin.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_hash_forest_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(hashforest, "SHARD_ROWS", 128)
    monkeypatch.setattr(hashforest, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(hashforest, "STEP_QUERIES", 3)
    rows = vectors(7, 500)
    got = defaultdict(list)
    for r in hashforest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    hits = total = 0
    for q in (i for i in fine if i % 20 == 0):
        true = sorted(((float((fine[q] * y).sum()), -i) for i, y in fine.items() if i != q), reverse=True)[:10]
        found = got[q]
        assert len(found) == 10 and all(abs(s - (fine[q] * fine[i]).sum()) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({-i for _, i in true} & {i for i, _ in found})
        total += 10
    assert hits / total >= 0.9
    few = [(0, [1.0, 2.0], 0), (20, [2.0, 1.0], 0), (3, [1.0, 1.0], 0)]
    small = hashforest.search(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 20 == 0).collect()
    assert len(small) == 4
    assert hashforest.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += hit
        if hit:
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = [
        None, "", "nothing here", "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y", "CC BY NC CC BY-NC cc by nc", "under the mit licenses", "All rights reserved.",
        "This work is licensed under the GNU General Public License, version 3.", "Ünder the MIT License under the mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software " * 2, "the " * 2000 + "Licensed under CC BY-NC 4.0.",
    ]
    rows = documents(spark, [(i, t, "s") for i, t in enumerate([*texts, texts[3]])])
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(t), t
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[8]["labels"] == "gpl-3" and got[7]["labels"] == "all-rights-reserved" and got[10]["labels"] == "mit" and got[2]["labels"] == ""
    assert got[11]["labels"] == "cc-by-nc" and got[11]["matches"][0]["word"] == 2002
    assert licenses.scan(documents(spark, [])).count() == 0


def test_license_scan_hears_every_template(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted. "
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
    prose = "the redistribution of binary forms with modification without source " + "word " * 300
    texts = [bsd + "All rights reserved.", notice + bsd + "Licensed under CC BY-SA 4.0. Released under the MIT License.", prose + "All rights reserved. Licensed under CC BY-SA 4.0."]
    texts += ["all rights reserved licensed under cc by sa 4 0 the mit license"] * 20  # makes these words frequent
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got[0] == "all-rights-reserved,bsd" and got[1] == "bsd,cc-by-sa,mit" and got[2] == "all-rights-reserved,cc-by-sa"


def test_license_scan_of_all_notices_in_one_file(spark):
    rng = random.Random(16)
    filler = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    every = [t.text for t in licenses.TEMPLATES]
    far = rng.sample(range(len(every)), 5)
    texts = [" . ".join(every), filler(3000) + "".join(f" {every[k]} {filler(2000)}" for k in far), " ".join(every[13:])]
    # a GPL notice whose version is missing is no GPL notice
    texts.append(every[17].replace("either version 3", "either edition 3"))
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got[0]["labels"] == ",".join(sorted({t.label for t in licenses.TEMPLATES}))
    assert set(got[1]["labels"].split(",")) == {licenses.TEMPLATES[k].label for k in far}
    assert len(got[0]["matches"]) >= len(every) and got[3]["labels"] == ""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert {r[0]: r[6] for r in con.sql(op5_sql()).fetchall()} == {i: got[i]["labels"] for i in got}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_decides_as_the_full_table_does():
    rng = random.Random(8)
    for _ in range(800):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [x if rng.random() < 0.8 else rng.randrange(4) for x in a if rng.random() < 0.9]
        for most in range(7):
            assert orderhash.within(a, b, most) == (distance(a, b) <= most)


def test_order_minhash_finds_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(40)]
    rows, true = [], {}
    for i, w in enumerate(base):
        true[i] = i
        rows.append((i, " ".join(w), "s"))
    for k in range(60):
        i = k % 20
        w = [x if rng.random() > 0.03 else rng.choice(words) for x in base[i]]
        true[100 + k] = i
        rows.append((100 + k, "  ".join(w), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "short text", "s"), (503, "short  text", "s"), (504, "short test", "s"), (0, rows[0][1], "s")]
    got = defaultdict(list)
    for r in orderhash.near_duplicates(documents(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    assert all(got[i][0]["class_id"] == c for i, c in true.items())
    assert got[500][0]["class_id"] == got[501][0]["class_id"] == 500 and not got[501][0]["kept"]
    assert got[503][0]["class_id"] == 502 and got[504][0]["class_id"] == 504 and len(got[0]) == 2
    kept = orderhash.deduplicated(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted([*range(40), 500, 502, 504])
    assert orderhash.near_duplicates(documents(spark, [])).count() == 0


def test_a_sketch_does_not_depend_on_the_texts_beside_it():
    rng = random.Random(20)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (300, 4, 0, 80)] + [" ".join(f"w{i}" for i in range(90)), "one"]

    def sketches(own):
        raw = [t.encode() for t in own]
        data = np.frombuffer(b"".join(raw), np.uint8)
        return orderhash.order_sketches(*word_hashes(data, np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)))

    assert (sketches(texts) == np.concatenate([sketches([t]) for t in texts])).all()


@pytest.mark.parametrize("block", [1024, 3])
def test_order_minhash_decides_every_pair_of_a_bucket(spark, block, monkeypatch):
    monkeypatch.setattr(orderhash, "BLOCK_MEMBERS", block)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.sample(words, 90)
    # id 0 holds the passage and is unlike all; copies share it and every second word of a tail, so no shingle but its own
    rows = [(0, " ".join(passage + rng.sample(words, 30)), "s"), (1, " ".join(passage[:60]), "s"), (None, " ".join(passage + rng.sample(words, 60)), "s")]
    for i in range(8):
        tail = rng.sample(words, 30)
        rows.append((900 - i, " ".join(passage + tail), "s"))
        rows += [(10 + 3 * i + k, " ".join(passage + [x if n % 2 else rng.choice(words) for n, x in enumerate(tail)]), "s") for k in range(3)]
    split = [t.split() for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if distance(split[a], split[b]) <= 0.2 * max(len(split[a]), len(split[b])) + 1e-9:
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 10**9)
    for a, (i, _, _) in enumerate(rows):
        least[root(a)] = min(least[root(a)], -1 if i is None else i)
    assert len(set(map(root, range(len(rows))))) == 11
    got = {r["doc_id"]: r["class_id"] for r in orderhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: None if least[root(a)] < 0 else least[root(a)] for a, (i, _, _) in enumerate(rows)}


def test_bags_never_exceed_the_distance():
    rng = random.Random(14)
    for _ in range(300):
        a, b = ([rng.randrange(300) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        h = np.array(a + b, np.uint64)
        held = orderhash.bags(h, np.array([0, len(a), len(a) + len(b)]))
        assert orderhash.least_distances(held[0], held[1:])[0] <= distance(a, b)


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_quality_holds_out(spark):
    rng = random.Random(11)
    good, bad, toxic = ["alpha", "beta", "gamma", "delta"], ["###", "$$$", "zz%%"], ["vile", "nasty"]
    rows, labels = [], []
    for i in range(600):
        grade = i % 3
        w = [rng.choice(good) for _ in range(60)]
        if grade == 1:
            w = [x if rng.random() < 0.4 else rng.choice(bad) for x in w]
        if grade == 0:
            w[30:30] = toxic
        rows.append((i, " ".join(w), "s"))
        if i < 400:
            labels.append((i, grade))
    rows += [(900, None, "s"), (901, "", "s"), (0, rows[0][1], "s")]
    d = documents(spark, rows)
    model = quality.train(d, spark.createDataFrame([*labels, (None, 2), (5, None), (7, 1)], "doc_id long, grade int"), bits=14)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in quality.score(d, model).collect()}
    assert sum(got[i]["grade"] == i % 3 for i in range(400, 600)) / 200 > 0.95
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got.values())
    none = quality.train(d, spark.createDataFrame([], "doc_id long, grade int"))
    assert none is None and all(r["kept"] and r["expected_grade"] is None for r in quality.score(d, none).collect())
    assert quality.score(documents(spark, []), model).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randrange(1, 60), "big" if i % 2 else f"s{i % 8}") for i in range(1200)] + [(2000, None, None), (2001, "", "big"), (2001, "", "big")]
    d = documents(spark, rows)
    got = mixing.mix(d, max_repeat=2.0).collect()
    tokens, passed, repeats = Counter(), Counter(), {}
    for i, t, s in rows:
        tokens[s] += max(1, len((t or "").split()))
    for r in got:
        passed[r["source"]] += r["mix_tokens"]
        repeats[r["source"]] = r["mix_repeats"]
    assert Counter(r["doc_id"] for r in got if r["mix_epoch"] == 0) == Counter(i for i, _, _ in rows)  # all at least once
    assert max(repeats.values()) / min(repeats.values()) <= 2.0 + 1e-6
    for s in tokens:
        most = max(max(1, len((t or "").split())) for _, t, x in rows if x == s)
        assert repeats[s] * tokens[s] - most <= passed[s] <= repeats[s] * tokens[s] + 1e-6
    again = mixing.mix(d.repartition(5), max_repeat=2.0).collect()
    key = lambda r: (str(r["doc_id"]), r["mix_epoch"], r["mix_block_rank"], r["mix_order"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    uniform = mixing.mix(d, target_entropy=np.log(len(tokens)), max_repeat=None).collect()
    assert {round(r["mix_weight"], 4) for r in uniform} == {round(1 / len(tokens), 4)}
    half = mixing.mix(d, max_repeat=None, budget_tokens=sum(tokens.values()) // 2).collect()
    assert sum(r["mix_tokens"] for r in half) <= sum(tokens.values()) // 2
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixing_equals_a_plain_realisation(spark):
    """Weights by plain bisection, then blocks and documents taken one by one in the operator's keyed order."""
    rng = random.Random(17)
    rows = [(i, "w " * rng.randrange(1, 40), "big" if rng.random() < 0.6 else f"s{i % 5}") for i in range(700)]
    d = documents(spark, rows).withColumn("mix_tokens", F.lit("clash")).withColumn("mix_order", F.lit("clash"))
    bits, seed = 3, 7
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    keyed = d.select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("n"), h.alias("h"), F.shiftright(F.xxhash64(h), 64 - bits).cast("int").alias("block")).collect()
    sources = sorted({r["source"] for r in keyed})
    tokens = {s: sum(r["n"] for r in keyed if r["source"] == s) for s in sources}
    total = sum(tokens.values())
    share = {s: tokens[s] / total for s in sources}
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        ratio = [share[s] ** (t - 1) for s in sources]
        low, high = (low, t) if max(ratio) / min(ratio) <= 2 else (t, high)
    weight = {s: share[s] ** high for s in sources}
    norm = sum(weight.values())
    budget = total * norm * max(share[s] ** (1 - high) for s in sources)
    repeats = {s: budget * weight[s] / norm / tokens[s] for s in sources}
    turns = {
        (r["s"], r["e"], r["b"]): r["x"]
        for r in spark.createDataFrame([("s" + s, e, b) for s in sources for e in range(3) for b in range(-(1 << bits - 1), 1 << bits - 1)], "s string, e int, b int").withColumn("x", F.xxhash64(F.lit(seed), "s", "e", "b")).collect()
    }
    got = mixing.mix(d, block_bits=bits, seed=seed).collect()
    assert set(got[0].asDict()) == {*d.columns, *mixing.ADDED} and all(r["mix_tokens"] > 0 for r in got)
    for s in sources:
        assert abs(got and next(r["mix_repeats"] for r in got if r["source"] == s) - repeats[s]) < 1e-4
        exact = next(r["mix_repeats"] for r in got if r["source"] == s)
        mine = [r for r in keyed if r["source"] == s]
        want = Counter()
        for epoch in range(int(exact) + 1):
            room = tokens[s] if epoch < int(exact) else int((exact - int(exact)) * tokens[s])
            for rank, block in enumerate(sorted({r["block"] for r in mine}, key=lambda b: (turns["s" + s, epoch, b], b))):
                inside = sorted((r for r in mine if r["block"] == block), key=lambda r: r["h"])
                for r in inside:
                    if room < r["n"]:
                        room = 0
                        break
                    room -= r["n"]
                    want[r["doc_id"], epoch, rank] += 1
        assert Counter((r["doc_id"], r["mix_epoch"], r["mix_block_rank"]) for r in got if r["source"] == s) == want


def thue_morse(n):
    """Two words of 2**n letters that polynomials modulo 2**64 can't tell apart."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [10, 12])
def test_words_that_defeat_polynomials_stay_different(spark, n):
    a, b = thue_morse(n)
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([a, *rest]), "s"), (2, " ".join([b, *rest]), "s"), (3, " ".join([*rest, "x", a]), "s")]
    # whole texts of two words in that order, and windows of them
    rows += [(10, " ".join(a), "s"), (11, " ".join(b), "s")]
    got = {r["doc_id"]: r for r in recompression.substring_dedup(documents(spark, rows)).collect()}
    want = brute_words(rows, 20)
    for i, t, _ in rows:
        assert [got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]] == want[(i, t)]
    assert got[2]["n_removed"] == 0
    classes = {r["doc_id"]: r["class_id"] for r in orderhash.near_duplicates(documents(spark, [(1, f"{a} {b}", "s"), (2, f"{b} {a}", "s")])).collect()}
    assert classes == {1: 1, 2: 2}


def test_band_of_a_million_words_stays_small():
    rng = np.random.default_rng(18)
    a = [b"%d" % i for i in rng.integers(0, 10**6, 200_000)]
    b = list(a)
    for k in range(40):
        b[20_000 + k * 4_000 : 20_000 + k * 4_000 + k % 3] = [b"new"]
    tracemalloc.start()
    assert orderhash.within(a, b, 40_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # 200 bytes a word
    assert not orderhash.within(a[:9000], b[:8900][::-1], 900)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline as p

    rng = random.Random(19)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}!" for i in range(40)]
    rows, labels = [], []
    for i in range(260):
        poor = i % 4 == 1
        text = [rng.choice(bad if poor and rng.random() < 0.6 else good) for _ in range(rng.choice([60, 100, 140]))]
        if i % 10 == 0:
            text = [x if rng.random() > 0.02 else rng.choice(good) for x in rows[rng.randrange(i)][1].split()] if i else text
        if i % 6 == 2:
            text[30:30] = [f"p{k}" for k in range(50)]
        rows.append((i, " ".join(text), "en", f"s{i % 3 if i % 2 else 0}", len(" ".join(text))))
        if i < 180:
            labels.append((i, int(not poor), 0))
    rows += [(300, None, "en", None, 0), (301, "", "en", "s1", 0), (302, rows[7][1], "en", "s2", rows[7][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{tmp_path}/labels.parquet")))

    def tail(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        place = quality.features(data, np.array([0, len(data)]), model.bits)[1]
        return 1 / (1 + np.exp(-(model.weights[place].astype(float).sum() - model.thresholds[-1])))

    kept = [r for r in rows if tail(r[1]) >= 0.4]
    assert 0 < sum(r[0] % 4 == 1 for r in kept if r[0] < 260) < 20 < len(kept) < len(rows)
    first = {r["doc_id"] for r in p.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert first == {r[0] for r in kept}
    # one document of each class: the smallest id, by all pairs
    split = {r[0]: (r[1] or "").split() for r in kept}
    parent = {i: i for i in split}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in split:
        for j in split:
            if j < i and abs(len(split[i]) - len(split[j])) <= 0.2 * max(len(split[i]), len(split[j]), 1) and orderhash.similar(split[i], split[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    heads = [r for r in kept if root(r[0]) == r[0]]
    assert len(heads) < len(kept)
    # words of 20-word windows that start earlier
    brute = brute_words([(r[0], r[1], r[3]) for r in heads], 20)
    texts = {r[0]: brute[(r[0], r[1] or "")] for r in heads}
    texts = {r[0]: texts[r[0]][2] if texts[r[0]][1] else r[1] for r in heads}
    assert sum(texts[r[0]] != r[1] for r in heads) > 5
    got = p.run(spark, str(tmp_path)).collect()
    times = Counter(r["doc_id"] for r in got)
    assert set(times) == set(texts) and set(times.values()) <= {1, 2}
    # a source is passed as often as its temperature weight asks, up to one block's last document
    tokens = Counter()
    for r in heads:
        tokens[r[3]] += max(1, len((texts[r[0]] or "").split()))
    passed = Counter()
    for r in got:
        passed[r["source"]] += max(1, len((texts[r["doc_id"]] or "").split()))
    share = {s: tokens[s] / sum(tokens.values()) for s in tokens}
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        powers = [share[s] ** (t - 1) for s in share]
        low, high = (low, t) if max(powers) / min(powers) <= 2 else (t, high)
    least = min(share[s] ** (high - 1) for s in share)
    for s in tokens:
        repeats = share[s] ** (high - 1) / least
        assert repeats * tokens[s] - 200 <= passed[s] <= repeats * tokens[s] * (1 + 1e-4) + 1 and passed[s] >= tokens[s]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]] or "") and r["round_trip"] for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).checkpoint()
        assert tuple(docs.columns) == p.COLUMNS
        assert docs.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").isEmpty(), name
    last = p.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("not round_trip").isEmpty()


def test_license_scan_of_a_text_with_very_many_places(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "cc by nc filler " * n), (2, "cc by " * n + "nc")], "doc_id long, text string")
    docs.count()
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert time.perf_counter() - began < 40  # a quadratic scan takes minutes
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (4 * n, n, 0, 4 * (n - 1))
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (1, 2 * (n - 1), 2 * (n - 1), "cc-by-nc")


def test_shared_words_bound_the_distance():
    rng = random.Random(5)
    texts = [[rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    raw = [" ".join(t).encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    shared = orderhash.SharedWords(*word_hashes(data, offsets))
    for i, t in enumerate(texts):
        assert shared.of(i).tolist() == [sum((Counter(t) & Counter(o)).values()) for o in texts]
        near = set(shared.near(i, np.arange(len(texts)), 0.8).tolist())
        assert near >= {j for j, o in enumerate(texts) if orderhash.similar(t, o)}


def test_a_wide_bucket_of_unlike_texts(spark):
    """Texts that share a long line and nothing else meet in its buckets; none is like another but for the copies planted."""
    rng = random.Random(6)
    line = [f"line{i}" for i in range(60)]
    rows = [(i, " ".join(line + [f"w{rng.randrange(10**6)}" for _ in range(30)])) for i in range(1500)]
    rows += [(5000 + i, rows[i * 100][1].replace("line7", "other", 1)) for i in range(10)]
    began = time.perf_counter()
    got = orderhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 120
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i if i < 5000 else (i - 5000) * 100 for i, _ in rows}
