"""Near duplicates, repeated passages, embeddings and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from relslice.llm import embedding_dedup, multiset_hash, queries, simhash, simhash_texts, substring_dedup
from relslice.llm.components import components
from relslice.llm.fm_index import FMIndex, WaveletMatrix, earlier_windows

FOLDER = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reach(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def texts(n, seed, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, words))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        one = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            one[r.randrange(len(one))] = r.choice(vocabulary)
        if r.random() < 0.4:
            one += r.choice(base)
        out.append((" " if r.random() < 0.8 else "\n\t").join(one))
    return out


def test_components_on_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2), (3, 2), (None, 5)]
    df = spark.createDataFrame(pairs, "x long, y long")
    got = dict(tuple(r) for r in components(df, "x", "y").collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(df.limit(0), "x", "y").count() == 0


def test_fingerprint_by_hand():
    for text in ("Ab c D e f", "one", "two words", "", None, "É x\x85y z w", "a " * 500):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
        assert simhash.fingerprint(text) % 2**64 == want


@pytest.mark.parametrize("crowd", [2, 256])
def test_simhash_components(spark, crowd):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(25)] + [0]
    values = set(base)
    for v in base:
        for _ in range(12):
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                v ^= 1 << b
            values.add(v)
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {v: v for v in signed} | {r.node: r.component for r in components(simhash.links(df, crowd=crowd), "a", "b").collect()}
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 2]
    assert got == smallest_reach(signed, near)


@pytest.mark.parametrize("thresholds", [(0, 0, 0), (1, 0)])
def test_every_allocation_finds_all_pairs(spark, monkeypatch, thresholds):
    m = len(thresholds)
    monkeypatch.setattr(simhash, "plan", lambda *_: [(p.tolist(), e) for p, e in zip(np.array_split(np.arange(64), m), thresholds)])
    r = random.Random(5)
    values = [r.getrandbits(63) for _ in range(30)]
    values += [v ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for v in values]
    df = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(df).collect()}
    assert got == {(a, b) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= 2}


def test_threshold_allocation_is_the_cheapest():
    costs = [{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 1, 1: 30}, {-1: 0, 0: 2, 1: 3}]
    assert simhash.allocate(costs, 0) == (4, [-1, 0, 1])


def test_simhash_query_shape_and_odd_rows(spark):
    rows = [(5, "a b c d e"), (2, "A b  c d E"), (9, None), (7, ""), (7, " "), (None, "other words here now"), (11, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    ids = {(r.doc_id, r.component_id) for r in got}
    assert len(got) == 7 and {(5, 2), (2, 2), (9, 7), (7, 7), (None, None), (11, 11)} == ids
    assert {r.fingerprint for r in got if r.doc_id in (7, 9)} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the given tables are not here")
def test_simhash_query_over_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    fps = {}
    for i, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        hashes = np.array([xxh64_intdigest(x.encode(), 42) for x in shingles], np.uint64)
        fps[i] = sum(int(2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes)) << b for b in range(64))
    ids = sorted(fps)
    want = smallest_reach(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, str(FOLDER)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def shingle_set(text, shingle=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} if len(words) > shingle else {tuple(words)} if words else set()


def similar(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def edited_copies(n, seed, words=120):
    """Texts of which many are copies with a few words changed: similarities on both sides of 0.8."""
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(5_000)]
    out = []
    for _ in range(n // 6):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, words))]
        out.append(" ".join(base))
        for _ in range(5):
            one = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                one[r.randrange(len(one))] = r.choice(vocabulary)
            out.append(" ".join(one))
    return out


@pytest.mark.parametrize("block", [7, 4_096])
def test_near_duplicate_texts_against_all_pairs(spark, block):
    said = edited_copies(240, 4) + ["", None, " ", "a b", "A  b", "x y z w v"]
    df = spark.createDataFrame(list(enumerate(said)), "row long, text string").withColumn("fp", F.lit("clash"))
    got = {r.row: r.group for r in simhash_texts.near_duplicate_texts(df, block=block).collect()}
    sets = [shingle_set(t) for t in said]
    linked = [(i, j) for i in range(len(said)) for j in range(i + 1, len(said)) if similar(sets[i], sets[j]) >= 0.8]
    want = smallest_reach(range(len(said)), linked)
    assert len(linked) > 100 and sum(got[i] == got[j] for i, j in linked) >= 0.98 * len(linked)
    assert all(want[i] == want[got[i]] for i in got)  # nothing is tied that links do not tie
    assert got[240] == got[241] == got[242] == 240 and got[243] == got[244] == 243
    assert simhash_texts.near_duplicate_texts(df.limit(0)).count() == 0


def test_one_group_of_many_edited_copies_leaves_few_links(spark):
    r = random.Random(2)
    base = [f"word{r.randrange(5_000)}" for _ in range(150)]
    said = []
    for _ in range(400):
        one = list(base)
        one[r.randrange(150)] = f"other{r.randrange(5_000)}"
        said.append(" ".join(one))
    told = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "row long, text string").mapInArrow(simhash_texts._sketched, simhash_texts.SKETCHED)
    links = simhash_texts.candidates(told, block=100).count()
    assert 399 <= links < 400 * 40  # a tree a key and pair of blocks, not 79,800 pairs
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "row long, text string")
    assert {r.group for r in simhash_texts.near_duplicate_texts(df, block=100).collect()} == {0}


def brute_repeats(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def short_grams(monkeypatch):
    monkeypatch.setattr(substring_dedup, "anchors", lambda w, size, f=substring_dedup.anchors: f(w, size, 3))


def kept_digests(docs, **options):
    got = substring_dedup.remove_repeats(docs, **options).select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("window, shard_words", [(6, 500), (10, 20)])  # 20 words a shard: anchors are split over blocks
def test_repeats(spark, short_grams, window, shard_words):
    rows = list(enumerate(texts(150, 2))) + [(500, None), (501, ""), (502, "a " * 300), (503, "a " * 200), (None, texts(3, 2)[0]), (7, texts(150, 2)[90])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stretches", F.lit(1)).withColumn("part", F.lit(2)).withColumn("kept_text", F.lit("own"))
    assert kept_digests(df, window=window, shard_words=shard_words) == brute_repeats(rows, window)
    out = substring_dedup.remove_repeats(df, window=window)
    assert out.columns == [*df.columns, "repeats"] and {r.kept_text for r in out.collect()} == {"own"}


@pytest.mark.parametrize("parts", [1, 40])
def test_repeats_of_one_common_passage(spark, short_grams, parts):
    """Many documents with a passage in common and words of their own around it; some hold a part of it only."""
    r = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(120):
        a, b = (r.randrange(0, 8), r.randrange(22, 31)) if i % 5 == 0 else (0, 30)
        rows.append((i, " ".join([*(f"x{i}.{k}" for k in range(9)), *common[a:b], *(f"y{i}.{k}" for k in range(9))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert kept_digests(df, window=10) == brute_repeats(rows, 10)


def test_a_common_passage_leaves_few_pieces(spark):
    """What reaches the shards does not follow the number of documents that hold a passage."""
    r, sizes = random.Random(1), {}
    common = " ".join(f"c{i}" for i in range(80))
    for n in (300, 1_500):
        rows = [(i, " ".join(str(r.random()) for _ in range(60)) + f" {common} " + " ".join(str(r.random()) for _ in range(60))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = substring_dedup.stretches(docs, F.lit(0).cast("long")).collect()
        assert len(got) == n - 1 and all(min(s.a for s in row.stretches) == 60 and max(s.b for s in row.stretches) == 140 for row in got)
        sizes[n] = max(len(row.stretches) for row in got)
    assert sizes[300] == sizes[1_500] <= 10


def test_repeats_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(df).count() == 0


@pytest.mark.parametrize("a, b, n", [("", "", 0), ("a ", "a ", 1), ("ab c ", "ab d ", 1), ("ab c ", "abc ", 0), ("x y ", "x y z ", 2)])
def test_common_words(a, b, n):
    assert substring_dedup.common_words(a, b) == n == substring_dedup.common_words(b, a)


def test_backward_search_against_a_scan():
    r = np.random.default_rng(1)
    for _ in range(15):
        window, letters = int(r.integers(3, 20)), int(r.integers(2, 5))
        base = [r.integers(2, 2 + letters, int(r.integers(window, 60))) for _ in range(10)]
        sequences = []
        for _ in range(30):
            one = base[r.integers(10)].copy()
            one[r.integers(len(one))] = 2 + r.integers(letters + 1)
            sequences.append(one.astype(np.int64))
        ranks = np.sort(r.integers(0, 20, 30))
        asking = [i for i in range(30) if ranks[i] > ranks[0]]
        mine = ranks[asking]
        asked = [np.where(r.random(len(sequences[i])) < 0.02, 0, sequences[i]) for i in asking]  # 0: a word that the index lacks
        found, lengths = earlier_windows(FMIndex(sequences, 80), ranks, asked, mine, window)

        def occurs(part, before):
            return any(ranks[j] < before and s[t : t + len(part)].tolist() == part for j, s in enumerate(sequences) for t in range(len(s) - len(part) + 1))

        for q, rank, flags, known in zip(asked, mine, found, lengths):
            assert flags.tolist() == [occurs(q[s : s + window].tolist(), rank) for s in range(len(flags))]
            for end in np.flatnonzero(known >= 0)[:3]:
                n = int(known[end])
                assert n == 0 or n >= window or not occurs(q[end - n - 1 : end].tolist(), rank) or n + 1 < window


def test_a_long_piece_is_searched_at_many_places_at_once(monkeypatch):
    """The steps over the index follow the window, not the longest piece."""
    r, steps, extend = np.random.default_rng(2), [], FMIndex.extend
    monkeypatch.setattr(FMIndex, "extend", lambda *a: (steps.append(1), extend(*a))[1])
    for n in (200, 1_000):
        base = r.integers(2, 5_000, n)
        asked = base.copy()
        asked[60::40] = 1_000_000  # no window of 50 after the first ones occurs, and most break off late
        flags = earlier_windows(FMIndex([base, asked], 100), np.array([0, 1]), [asked], np.array([1]), 50)[0][0]
        assert flags.tolist() == [s <= 10 for s in range(n - 49)]
    assert len(steps) <= 500


def test_smallest_number_of_an_interval():
    r = np.random.default_rng(3)
    values = r.integers(0, 70, 3_000)
    low = r.integers(0, 2_999, 500)
    high = low + r.integers(1, 3_001 - low)
    assert WaveletMatrix(values).smallest(low, high).tolist() == [values[a:b].min() for a, b in zip(low, high)]


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 24))
    vectors = [v + r.normal(size=24) * s for v in base for s in (0.0, 0.02, 0.25, 0.45, 0.6)] + [base[0].copy(), base[0] * 3]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0])]
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("code", F.lit(1))).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i, _ in rows])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9 * near.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert got[300].component_id == 0 and not got[300].kept
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def at_cosine(r, n, dims, low, high):
    """n pairs of unit vectors at cosines between low and high."""
    a, b = r.normal(size=(2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = r.uniform(low, high, (n, 1))
    return a, cos * a + np.sqrt(1 - cos**2) * b


@pytest.mark.parametrize("dims", [3, 16, 64, 200])
def test_embedding_tables_of_large_inputs_keep_their_recall(dims):
    a, b = at_cosine(np.random.default_rng(2), 3_000, dims, 0.9, 0.95)
    turn = embedding_dedup.learn_rotations(np.concatenate([a, b]))
    x, y = embedding_dedup.codes(a, turn), embedding_dedup.codes(b, turn)
    for n in (5_000, 100_000, 10**6, 10**7, 10**8):
        parts = embedding_dedup.tables(turn.shape[1], n)
        assert n / 2 ** len(parts[0]) < 2_000
        assert (embedding_dedup.bucket_keys(x, parts) == embedding_dedup.bucket_keys(y, parts)).any(axis=1).mean() >= 0.98


def test_bits_that_a_pair_at_the_threshold_differs_in():
    a, b = at_cosine(np.random.default_rng(9), 4_000, 64, 0.9, 0.901)
    turn = embedding_dedup.learn_rotations(np.concatenate([a, b]))
    apart = np.bitwise_count(embedding_dedup.codes(a, turn) ^ embedding_dedup.codes(b, turn)).sum(axis=1)
    most = embedding_dedup.most_bits(turn.shape[1])
    assert (apart <= most).mean() >= 0.99 and most < 0.25 * turn.shape[1]


@pytest.mark.parametrize("as_if", [10**6, 10**7])
def test_embedding_links_near_the_threshold_with_tables_of_large_inputs(spark, monkeypatch, as_if):
    monkeypatch.setattr(embedding_dedup, "tables", lambda bits, n, *rest, f=embedding_dedup.tables: f(bits, as_if, *rest))
    a, b = at_cosine(np.random.default_rng(6), 300, 64, 0.9, 0.95)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.concatenate([a, b])
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    links = np.array([got[i] for i in range(600)])
    assert (links <= near).all() and links.sum() >= 0.98 * near.sum() >= 0.98 * 590


def test_embedding_blocks_cover_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(8)
    v = r.normal(size=16)
    rows = [(i, (v + r.normal(size=16) * 0.01).tolist()) for i in range(90)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x.n_links for x in got} == {89} and {x.component_id for x in got} == {0}


def fingerprint_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("at", F.lit(1))
    return {r.doc_id: r for r in multiset_hash.fingerprints(df).collect()}


def test_multiset_hash(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "DOCS_PER_RANGE", 2)
    long = texts(3, 9, 300)[0]
    rows = [(1, "one two\nthree four"), (2, "three four\none two"), (3, None), (4, ""), (6, long), (9, long), (12, "é" * 7), (20, "one two\nthree four\n"), (31, "x")]
    got = fingerprint_rows(spark, rows)
    order = sorted(rows, reverse=True)
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint != got[20].fingerprint and got[3].fingerprint == got[4].fingerprint
    assert got[9].near_next == 1.0 and got[4].near_next == 1.0 and got[9].fingerprint == got[6].fingerprint
    assert fingerprint_rows(spark, []) == {}


def whole_by_hand(text):
    """The first 16 lanes, with XXH64 of the paragraph after that of the lane's seed."""
    total = np.zeros(16, np.uint64)
    for p in (text or "").split("\n"):
        for seed in range(8):
            h = xxh64_intdigest(p.encode(), xxh64_intdigest(int(seed).to_bytes(4, "little"), 42))
            total[2 * seed] += h & 0xFFFFFFFF
            total[2 * seed + 1] += h >> 32
    return "".join(f"{int(x) % 2**32:08x}" for x in total)


def pairs_by_hand(text):
    """(number of words, counts of the 128 hash bits) of the word pairs."""
    n, counts = 0, np.zeros(128, np.int64)
    for p in (text or "").split("\n"):
        words = p.split(" ")
        for i, w in enumerate(words):
            h = xxh64_intdigest(w.encode(), 42)
            if i + 1 < len(words):
                h = xxh64_intdigest(words[i + 1].encode(), h)
            g = xxh64_intdigest(h.to_bytes(8, "little"), 42)
            bits = [[v >> (s + half) & 1 for v in (h, g) for s in range(32)] for half in (0, 32)]
            counts += np.array(bits[0] + bits[1])
            n += 1
    return n, counts


def likeness_by_hand(a, b):
    (n, x), (m, y) = pairs_by_hand(a), pairs_by_hand(b)
    u, v = 2 * x - n, 2 * y - m
    apart = float(((u - v) ** 2).mean())
    return 1.0 if apart == 0 else min(1.0, max(0.0, 1 - apart / (float((u**2).mean()) + float((v**2).mean()))))


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the given tables are not here")
def test_multiset_query_over_a_whole_table(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op6_multiset_hash(spark, str(FOLDER)).collect()}
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        n, counts = pairs_by_hand(text)
        assert got[i].fingerprint == whole_by_hand(text) + f"{n:08x}" + "".join(f"{c % 65536:04x}" for c in counts)
        assert got[i].edited_fingerprint[:128] == whole_by_hand(edited)
        assert got[i].near_next == pytest.approx(likeness_by_hand(text, after), abs=1e-9) and got[i].near_edited == pytest.approx(likeness_by_hand(text, edited), abs=1e-9)


@pytest.mark.parametrize("segments", [3, 1_000])
def test_multiset_order_of_extreme_far_null_and_repeated_ids(spark, monkeypatch, segments):
    monkeypatch.setattr(multiset_hash, "DOCS_PER_RANGE", 20)
    monkeypatch.setattr(multiset_hash, "SEGMENTS", segments)
    ids = [-(2**63) + 5, 2**63 - 5, 2**60, *range(300), *range(10**6, 10**6 + 50), *[41] * 200, *[None] * 200]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranged = multiset_hash.with_ranges(df.withColumn("row", F.monotonically_increasing_id()), 20, segments).select("doc_id", "range").collect()
    at = sorted((r.doc_id is not None, r.doc_id or 0, r.range) for r in ranged)
    assert [r for _, _, r in at] == sorted(r for _, _, r in at)  # ranges rise with ids
    sizes = {r: sum(x.range == r for x in ranged) for r in {x.range for x in ranged}}
    assert max(sizes.values()) <= (300 if segments == 3 else 120)
    out = multiset_hash.fingerprints(df).collect()
    by_edit = {}
    for r in out:
        by_edit.setdefault(r.doc_id, set()).add(r.edited_sha256)
    said = dict(rows)
    falling = sorted({i for i in ids if i not in (None, 41)}, reverse=True)
    for i, j in zip(falling, falling[1:]):
        if 41 not in range(j, i):
            text, after = said[i], said[j]
            half = len(text) // 2
            assert by_edit[i] == {hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()}
    assert len(out) == len(ids)


def test_likeness_of_long_repetitive_texts(spark):
    pair, empty = "a b\n", "\n"
    rows = [(4, empty * 65_535), (3, empty * 131_071), (2, pair * 65_535 + "a b"), (1, pair * 32_767 + "a b")]
    got = fingerprint_rows(spark, rows)
    assert got[4].near_next == pytest.approx(0.8) and got[2].near_next == pytest.approx(0.8) and got[2].near_edited > 0.99


def test_multiset_of_one_row(spark):
    assert fingerprint_rows(spark, [(None, "a")])[None].near_next == 1.0


def test_lanes_add_and_take_away(spark):
    df = spark.createDataFrame([("a b\nc", "a b", "c")], "x string, y string, z string")
    lanes = df.select(*[multiset_hash.whole_lanes(F.col(c)).alias(c) for c in "xyz"])
    row = lanes.select(multiset_hash.combine(F.col("y"), F.col("z")) == F.col("x"), multiset_hash.combine(F.col("x"), F.col("z"), -1) == F.col("y")).first()
    assert row[0] and row[1]


def test_near_duplicates_behind_a_tie_that_does_not_hold_are_found(spark):
    """Triples of which two pairs are similar and the third just looks so: no link is lost to the third one."""
    from relslice.llm import simhash_texts

    r, rows, want = np.random.default_rng(8), [], []

    def changed(words, at):
        out = words.copy()
        out[at] = r.integers(10**9, 2 * 10**9, len(at))
        return out

    for t in range(40):
        base = r.integers(0, 10**9, 1_000)
        spots = np.arange(20, 1_000, 30)[: 2 * 13]
        three = [base, changed(base, spots[:13]), changed(base, spots[13:])]
        order = r.permutation(3)
        sets = [simhash_texts.shingle_hashes(simhash_texts.word_hashes(" ".join(map(str, w)))) for w in three]
        assert simhash_texts.alike(sets[0], sets[1]) and simhash_texts.alike(sets[0], sets[2]) and not simhash_texts.alike(sets[1], sets[2])
        rows += [(3 * t + int(k), " ".join(map(str, w))) for k, w in zip(order, three)]
        want += [(3 * t + k, 3 * t) for k in range(3)]
    df = spark.createDataFrame(rows, "row long, text string").repartition(4)
    got = simhash_texts.near_duplicate_texts(df).collect()
    fps = {i: simhash_texts.word_fingerprint(simhash_texts.word_hashes(t)) for i, t in rows}
    near = lambda a, b: bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= simhash_texts.DISTANCE
    # every link that the fingerprints bring together is there
    texts = {i: simhash_texts.shingle_hashes(simhash_texts.word_hashes(t)) for i, t in rows}
    group = {r.row: r.group for r in got}
    met = [(a, b) for t in range(40) for a in range(3 * t, 3 * t + 3) for b in range(a + 1, 3 * t + 3) if near(a, b) and simhash_texts.alike(texts[a], texts[b])]
    assert len(met) > 60 and all(group[a] == group[b] for a, b in met)
