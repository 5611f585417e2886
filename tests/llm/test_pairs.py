"""Cross-split overlaps and near duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.words import words
from millrace.llm import blocks, cross_split, near_duplicates

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, n=3):
    w = words(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similarity(a, b, n=3):
    a, b = shingles(a, n), shingles(b, n)
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(rng, text):
    w = text.split()
    for _ in range(rng.randint(0, max(1, len(w) // 15))):
        i = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[i] = rng.choice(WORDS)
        elif kind == 1:
            w.insert(i, rng.choice(WORDS))
        elif kind == 2 and len(w) > 4:
            del w[i]
        else:
            w = w[i:] + w[:i]
    return " ".join(w)


def corpus(seed, n=120):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            texts.append(edited(rng, rng.choice(texts)))
        else:
            texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 4, 5, 6, 7, 9, 14, 16, 17, 20, 40, 150]))))
    odd = [None, "", " \n ", "two words", "Ｗ1 w2 w3", "w1 W2, w3!"]
    return [t for t in texts] + odd


def brute(texts, threshold, accept=lambda i, j: True):
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if accept(i, j) and similarity(texts[i], texts[j]) >= threshold}


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_split_equals_brute_force(spark, seed):
    texts = corpus(seed)
    splits = [random.Random(i).choice(["train", " TRAIN", None, "test", "Validation "]) for i in range(len(texts))]
    train = [(s or "train").strip().lower() == "train" for s in splits]
    rows = spark.createDataFrame(
        [(i, s, "src", t, "clash") for i, (s, t) in enumerate(zip(splits, texts, strict=True))],
        "record long, split string, source string, text string, content string",
    )
    got = {tuple(sorted((r.train_record, r.other_record))) for r in cross_split.cross_split_pairs(rows).collect()}
    assert got == brute(texts, 0.75, lambda i, j: train[i] != train[j])
    report = {r.split: (r.rows, r.overlapping) for r in cross_split.overlap_report(rows).collect()}
    hit = {i for pair in got for i in pair if not train[i]}
    for name in ("test", "validation"):
        own = [i for i, s in enumerate(splits) if (s or "train").strip().lower() == name]
        assert report[name] == (len(own), len(hit & set(own)))


def test_bound_holds_for_random_edits():
    rng = random.Random(5)
    for _ in range(400):
        a = " ".join(rng.sample(WORDS, rng.randint(5, 120)))
        b = edited(rng, a)
        s = similarity(a, b)
        if s < 0.55:
            continue
        hashes = {w: np.uint64(hash(w) & (2**64 - 1)) for w in (a + " " + b).split()}
        both = [np.array([hashes[w] for w in t.split()], dtype=np.uint64) for t in (a, b)]
        flat, ends = np.concatenate(both), np.cumsum([0, *map(len, both)])
        for t in (0.55, 0.62, 0.75, 0.9):
            if s < t:
                continue
            prints, text, _ = cross_split.winnow(flat, ends, cross_split.short_text(t))
            common = len(np.intersect1d(prints[text == 0], prints[text == 1]))
            n, repeats = cross_split.measure(flat, ends)
            least = 1 if repeats.any() else max(1.0, ((t - 5 * (1 - t) / 3) * n.max() - 5) / 4)
            assert common >= least - 1e-9, (a, b, t)


def test_batches_equal_texts_one_by_one():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, n).astype(np.uint64) for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 16, 17, 18, 60, 3, 200)]
    flat, ends = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    prints, owner, place = cross_split.winnow(flat, ends, 17)
    n, repeats = cross_split.measure(flat, ends)
    for k, words_ in enumerate(texts):
        grams = [tuple(words_[i : i + 3]) for i in range(len(words_) - 2)]
        pairs = [tuple(words_[i : i + 2]) for i in range(len(words_) - 1)]
        assert n[k] == len(set(grams)) and repeats[k] == (len(set(pairs)) < len(pairs))
        five = cross_split.gram_hashes(words_, 5)
        kept = set()
        for i in range(max(0, len(five) - 3) if len(five) > 4 else min(1, len(five))):
            window = five[i : i + 4]
            kept.add(i + max(j for j in range(len(window)) if window[j] == window.min()))
        expected = {int(five[i]) for i in kept}
        if len(words_) <= 17:
            expected |= {int(h) for h in cross_split.mix(cross_split.gram_hashes(words_, 3) ^ cross_split.SHORT_SALT)}
        assert {int(p) for p in prints[owner == k]} == expected
        assert len(prints[owner == k]) == len(expected) and (place[owner == k] >= 0).all()


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.9])
def test_other_thresholds_equal_brute_force(spark, threshold):
    texts = corpus(7, 80)
    train = [i % 2 == 0 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, "train" if train[i] else "test", t) for i, t in enumerate(texts)], "record long, split string, text string")
    got = {tuple(sorted((r.train_record, r.other_record))) for r in cross_split.cross_split_pairs(rows, threshold).collect()}
    assert got == brute(texts, threshold, lambda i, j: train[i] != train[j])


def test_a_sentence_that_many_texts_share(spark):
    """A fingerprint of a third of all rows: its texts meet, and only those alike are pairs."""
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(12))
    texts = [shared + " " + " ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(150)]
    texts += [texts[3] + " end", texts[8] + " more words", texts[5]]
    train = [i < 140 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, "train" if train[i] else "test", t) for i, t in enumerate(texts)], "record long, split string, text string")
    expected = brute(texts, 0.75, lambda i, j: train[i] != train[j])
    assert {tuple(sorted((r.train_record, r.other_record))) for r in cross_split.cross_split_pairs(rows).collect()} == expected
    classes = {r.record: r.links for r in cross_split.cross_split_classes(rows).collect()}
    assert {r for r, n in classes.items() if n} == {r for pair in expected for r in pair} and len(classes) == len(texts)


def test_alignment():
    assert cross_split.chain([(5, 1), (0, 0), (1, 4), (2, 2), (3, 3)]) == [(0, 0), (2, 2), (3, 3)]
    a, b = np.arange(10), np.array([0, 1, 2, 99, 4, 5, 6, 7])
    assert cross_split.extend(a, b, [(1, 1), (5, 5)]) == 7


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = corpus(seed)
    rows = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "record long, text string, band int, content string")
    got = {(r.record_a, r.record_b) for r in near_duplicates.near_duplicate_pairs(rows, 0.6, 3).collect()}
    expected = brute(texts, 0.6)
    assert got <= expected and len(expected - got) <= max(0, len(expected) // 200)
    groups = {r.record: r for r in near_duplicates.near_duplicate_groups(rows, 0.6, 3).collect()}
    assert len(groups) == len(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in sorted(got):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: root(i) for i in range(len(texts))} == {i: g.group_id for i, g in groups.items()}


def test_copies_are_one_class(spark):
    rows = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(60)] + [(100, "alpha beta gamma delta epsilon")], "record long, text string")
    assert near_duplicates.near_duplicate_pairs(rows, 0.6, 3).count() == 60 * 59 // 2 + 60
    groups = near_duplicates.near_duplicate_groups(rows, 0.6, 3).collect()
    assert {(g.class_id, g.group_id, g.links) for g in groups} == {(0, 0, 1), (100, 0, 1)}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = np.arange(0, 200), np.arange(100, 300)
    owner = np.repeat([0, 1], 200)
    signature = near_duplicates.probminhash(owner, np.concatenate([element[a], element[b]]), np.ones(400), 2, 4096)
    assert abs((signature[0] == signature[1]).mean() - 1 / 3) < 0.03
    wa, wb = rng.integers(1, 6, 200).astype(float), rng.integers(1, 6, 200).astype(float)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = wa, wb
    both = np.nonzero((x > 0) & (y > 0))[0]
    expected = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    signature = near_duplicates.probminhash(owner, np.concatenate([element[a], element[b]]), np.concatenate([wa, wb]), 2, 4096)
    assert abs((signature[0] == signature[1]).mean() - expected) < 0.03


def exact_probability_jaccard(a, b):
    """From the definition, over dictionaries of weights."""
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_probability_jaccard_equals_its_definition():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ({rng.randrange(30): rng.randint(1, 5) for _ in range(rng.randint(0, 20))} for _ in range(2))
        args = [x for d in (a, b) for x in (np.array(sorted(d), dtype=np.int64), np.array([d[k] for k in sorted(d)], dtype=float))]
        assert near_duplicates.probability_jaccard(*args) == pytest.approx(exact_probability_jaccard(a, b) if a and b else 0.0)


def test_weighted_groups_equal_brute_force(spark):
    rng = random.Random(9)
    said = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(12)]
    texts = [" ".join(rng.choices(said[k : k + 4], k=rng.randint(3, 9))) for k in range(0, 8) for _ in range(12)]

    def weighted(text):
        w = words(text)
        out: dict = {}
        for i in range(len(w) - 2):
            out[tuple(w[i : i + 3])] = out.get(tuple(w[i : i + 3]), 0) + 1
        return out

    held = [weighted(t) for t in texts]
    expected = {
        (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if held[i] != held[j] and exact_probability_jaccard(held[i], held[j]) >= 0.6
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "record long, text string")
    links = {(r.class_a, r.class_b) for r in near_duplicates.near_duplicate_links(rows, 0.6, 3, weights="count").collect()}
    first = {i: min(j for j in range(len(texts)) if held[j] == held[i]) for i in range(len(texts))}
    wanted = {tuple(sorted((first[i], first[j]))) for i, j in expected}
    assert links <= wanted and len(wanted - links) <= len(wanted) // 200
    assert links != {(r.class_a, r.class_b) for r in near_duplicates.near_duplicate_links(rows, 0.6, 3).collect()}


def test_a_band_that_many_texts_share(spark):
    """Two hundred texts of one template, all alike: every pair is a link and none is lost."""
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [shared + f" own{i}" for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "record long, text string")
    assert near_duplicates.near_duplicate_links(rows, 0.6, 3).count() == 200 * 199 // 2
    groups = near_duplicates.near_duplicate_groups(rows, 0.6, 3).collect()
    assert {(g.group_id, g.links) for g in groups} == {(0, 199)}


def test_the_driver_holds_few_ids_and_no_shingles(spark):
    """More than a million ids join by shuffle, and the shingles of candidates are never broadcast, however small Spark takes them for."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    classes = spark.range(3_000_000).select(F.col("id").alias("record"), F.array("id").alias("shingles"))
    many, few = (spark.range(n).select((F.col("id") * 2).alias("record")) for n in (1_200_000, 1_000))
    assert "BroadcastHashJoin" not in plan(blocks.only_needed(classes, many, 1_200_000))
    assert blocks.only_needed(classes, many, 1_200_000).count() == 1_200_000
    assert "BroadcastHashJoin" in plan(blocks.only_needed(classes, few, 1_000)) and blocks.only_needed(classes, few, 1_000).count() == 1_000
    texts = corpus(3)
    rows = spark.createDataFrame(list(enumerate(texts)), "record long, text string")
    links = near_duplicates.near_duplicate_links(rows, 0.6, 3)
    assert plan(links).count("BroadcastHashJoin") == plan(links).count("LeftSemi") == 2  # the ids, for either side
    assert links.count() > 0
    assert "Broadcast" not in plan(near_duplicates.classes_by_shingles(rows, 3)[0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "record long, split string, source string, text string")
    assert cross_split.cross_split_pairs(none).count() == 0 and cross_split.overlap_report(none).count() == 0
    assert near_duplicates.near_duplicate_pairs(none).count() == 0 and near_duplicates.near_duplicate_groups(none).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None), (2, "test", None, "")], "record long, split string, source string, text string")
    assert cross_split.cross_split_pairs(nulls).count() == 0
    assert near_duplicates.near_duplicate_groups(nulls).count() == 2


def test_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = spark.createDataFrame(
        [(1, "train", "s", long), (2, "test", "s", long + " more"), (3, "test", "s", "t0 t1 t2")],
        "record long, split string, source string, text string",
    )
    got = cross_split.cross_split_pairs(rows).collect()
    assert [(r.train_record, r.other_record) for r in got] == [(1, 2)] and got[0].coverage_train == 1.0
    assert [tuple(r) for r in near_duplicates.near_duplicate_pairs(rows.select("record", "text")).collect()] == [(1, 2)]
