"""Same or near-same records across splits: winnowing fingerprints, collinear seed chains, alignment.

Fingerprints. Word 5-grams are hashed by a rolling hash, and of every 4 consecutive ones the smallest (rightmost if equal) is
kept, so any 8 common consecutive words give a common fingerprint. Let u be the number of different word 3-grams in either of
two texts without repeated word pairs, and t their least similarity. At most (1-t)u 3-grams are not shared and a break between
two shared runs costs at least 3 of them, so there are at most (1-t)u/3 + 1 runs over at least tu shared 3-grams. With
g = t - 5(1-t)/3 that leaves a run of 8 words where u > 5/g, and in sum at least (gu - 5)/4 common fingerprints. Texts of at most
5/g + 2 words (17 at t = 0.75; every text where g <= 0) also give all their 3-grams, in a namespace of their own, which covers
the pairs below that. So no pair of texts without a repeated word pair is missed at any threshold. Candidates with fewer common
fingerprints than the bound, or with sizes too far apart, cannot reach the threshold and are left out before alignment; where a
text repeats a word pair the bound does not hold and one common fingerprint is enough.

Batches. Sequences, fingerprints and 3-gram counts of all texts of a batch are made together in a few numpy passes.

Copies. Rows of one split side with the same word sequence form one class and are fingerprinted once; a class that holds a third
of the rows is one text. A repeated fingerprint of a text keeps its first position. Seeds of a pair are bounded by its shorter
text. Null, blank and too short texts (under 3 words) have no 3-gram and never overlap.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import WordHashes, flat_word_hashes, gram_hashes, mix
from millrace.llm.blocks import only_needed
from millrace.runtime import cut_lineage, spread

GRAM, WINDOW, SHINGLE = 5, 4, 3
SHORT_SALT = np.uint64(0x5851F42D4C957F2D)
PRINTS = "print bigint, record bigint, place int, n int, repeats boolean"
OVERLAP = "a bigint, b bigint, similarity double, coverage_a double, coverage_b double, seeds int, chained int"


def split_name(column: str = "split") -> Column:
    """Split without case and blanks; null is train, as the loader has it."""
    return F.coalesce(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), F.lit("train"))


def short_text(threshold: float) -> int:
    """Words up to which a text gives all its 3-grams; every text where no run of 8 common words is certain."""
    gain = threshold - 5 * (1 - threshold) / 3
    return math.floor(5 / gain + 1e-9) + 2 if gain > 1e-9 else np.iinfo(np.int64).max


def _owned_grams(flat: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, text, place) of every gram of `size` words that lies within one text."""
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    grams = gram_hashes(flat, size)
    first, last = owner[: len(grams)], owner[size - 1 :] if len(grams) else owner[:0]
    at = np.nonzero(first == last)[0]
    return grams[at], owner[at], at - ends[owner[at]]


def _different(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Number of different values of each text."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=texts)


def winnow(flat: np.ndarray, ends: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, place) of texts given as word hashes one after another; a fingerprint counts once a text, where it is first."""
    grams, owner, place = _owned_grams(flat, ends, GRAM)
    held = np.bincount(owner, minlength=len(ends) - 1)
    start = np.cumsum(held) - held
    rank = np.arange(len(grams)) - start[owner]
    windows = np.nonzero(rank <= np.maximum(held[owner] - WINDOW, 0))[0]
    last = start[owner[windows]] + held[owner[windows]] - 1
    best = windows.copy()
    for k in range(1, WINDOW):
        there = np.minimum(windows + k, last)
        best = np.where(grams[there] <= grams[best], there, best)
    best = np.unique(best)
    prints, texts, places = grams[best], owner[best], place[best]
    small, whose, at = _owned_grams(flat, ends, SHINGLE)
    mine = np.diff(ends)[whose] <= short
    prints = np.concatenate([prints, mix(small[mine] ^ SHORT_SALT)])
    texts, places = np.concatenate([texts, whose[mine]]), np.concatenate([places, at[mine]])
    order = np.lexsort((places, prints, texts))
    prints, texts, places = prints[order], texts[order], places[order]
    new = np.ones(len(prints), dtype=bool)
    new[1:] = (prints[1:] != prints[:-1]) | (texts[1:] != texts[:-1])
    return prints[new], texts[new], places[new]


def measure(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the number of different 3-grams and whether a word pair occurs twice."""
    texts = len(ends) - 1
    pairs, owner, _ = _owned_grams(flat, ends, 2)
    grams, whose, _ = _owned_grams(flat, ends, SHINGLE)
    return _different(grams, whose, texts), _different(pairs, owner, texts) < np.bincount(owner, minlength=texts)


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(record, train, text) to (record, train, content, sequence) for texts with a 3-gram."""
    known = WordHashes()
    for batch in batches:
        flat, ends = flat_word_hashes(batch["text"], known)
        rows = []
        for k, (record, train) in enumerate(zip(batch["record"], batch["train"], strict=True)):
            sequence = flat[ends[k] : ends[k + 1]]
            if len(sequence) >= SHINGLE:
                rows.append((record, train, hashlib.blake2b(sequence.tobytes(), digest_size=16).hexdigest(), sequence.view(np.int64)))
        if rows:
            yield pd.DataFrame(rows, columns=["record", "train", "content", "sequence"])


def _fingerprints(short: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(record, sequence) to PRINTS rows: fingerprint, record, place, the text's number of 3-grams and whether it repeats a word pair."""
        for batch in batches:
            if batch.empty:
                continue
            sequences = [np.asarray(s, dtype=np.int64).view(np.uint64) for s in batch["sequence"]]
            flat, ends = np.concatenate(sequences), np.cumsum([0, *map(len, sequences)])
            prints, text, place = winnow(flat, ends, short)
            n, repeats = measure(flat, ends)
            yield pd.DataFrame(
                {
                    "print": prints.view(np.int64),
                    "record": batch["record"].to_numpy()[text],
                    "place": place.astype(np.int32),
                    "n": n[text].astype(np.int32),
                    "repeats": repeats[text],
                }
            )

    return run


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of seeds that ascend in both texts."""
    seeds = sorted(seeds, key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(seeds)
    for i, (_, y) in enumerate(seeds):
        k = bisect.bisect_left(tails, y)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            ends.append(i)
        else:
            tails[k], ends[k] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(seeds[i])
        i = before[i]
    return out[::-1]


def extend(a: np.ndarray, b: np.ndarray, chained: list[tuple[int, int]]) -> int:
    """Aligned words: every chained seed is extended over equal words to both sides, never across an aligned neighbour."""
    aligned, end_a, end_b = 0, 0, 0
    for x, y in chained:
        if x < end_a or y < end_b:
            continue
        lo = 0
        while x - lo - 1 >= end_a and y - lo - 1 >= end_b and a[x - lo - 1] == b[y - lo - 1]:
            lo += 1
        room = min(len(a) - x, len(b) - y)
        differs = np.nonzero(a[x : x + room] != b[y : y + room])[0]
        hi = int(differs[0]) if len(differs) else room
        aligned += lo + hi
        end_a, end_b = x + hi, y + hi
    return aligned


def _align(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            known: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}

            def text(train: bool, record: int, sequence, known=known) -> tuple[np.ndarray, np.ndarray]:
                """A text's words and different 3-grams, made once a batch."""
                if (train, record) not in known:
                    words = np.asarray(sequence, dtype=np.int64)
                    known[train, record] = words, np.unique(gram_hashes(words.view(np.uint64), SHINGLE))
                return known[train, record]

            for ra, rb, xs, ys, sa, sb in zip(batch["a"], batch["b"], batch["xs"], batch["ys"], batch["sa"], batch["sb"], strict=True):
                (a, ga), (b, gb) = text(True, ra, sa), text(False, rb, sb)
                common = int((ga[np.minimum(np.searchsorted(ga, gb), len(ga) - 1)] == gb).sum())
                similarity = common / (len(ga) + len(gb) - common)
                if similarity < threshold:
                    continue
                chained = chain(list(zip(xs, ys, strict=True)))
                aligned = extend(a, b, chained)
                rows.append((ra, rb, similarity, aligned / len(a), aligned / len(b), len(xs), len(chained)))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in OVERLAP.split(", ")])

    return run


def split_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record, split, text) to members (record, train, class) and classes (record, train, sequence).

    Sequences and classes are cut in the checkpoint folder: texts are split into words once, and four later passes read the classes.
    """
    texts = spread(records.select("record", (split_name() == "train").alias("train"), "text").where("text is not null"))
    made = cut_lineage(texts.mapInPandas(_sequences, "record bigint, train boolean, content string, sequence array<bigint>"))
    classes = cut_lineage(made.groupBy("content", "train").agg(F.min("record").alias("record"), F.first("sequence").alias("sequence")))
    members = made.select("record", "train", "content").join(
        classes.select("content", "train", F.col("record").alias("class")), ["content", "train"]
    )
    return members.select("record", "train", "class"), classes.select("record", "train", "sequence")


def class_overlaps(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ...) with a a train class and b a class of another split, at or over the similarity threshold."""
    prints, texts = {}, {}
    for side, name, at in ((True, "a", "x"), (False, "b", "y")):
        own = classes.where(F.col("train") == side).select("record", "sequence")
        made = own.mapInPandas(_fingerprints(short_text(threshold)), PRINTS)
        prints[name] = made.select(
            "print",
            F.col("record").alias(name),
            F.col("place").alias(at),
            F.col("n").alias(f"n{name}"),
            F.col("repeats").alias(f"r{name}"),
        )
        texts[name] = own
    gain = threshold - 5 * (1 - threshold) / 3
    least = F.when(F.max("ra") | F.max("rb"), F.lit(1.0)).otherwise((gain * F.greatest(F.max("na"), F.max("nb")) - 5) / 4)
    seeds = (
        prints["a"]
        .join(prints["b"], "print")
        .where(F.least("na", "nb") + 1e-9 >= threshold * F.greatest("na", "nb"))
        .groupBy("a", "b")
        .agg(F.collect_list(F.struct("x", "y")).alias("seeds"), least.alias("least"))
        .where(F.size("seeds") >= F.col("least") - 1e-9)
        .select("a", "b", F.col("seeds.x").alias("xs"), F.col("seeds.y").alias("ys"))
    )
    seeds = cut_lineage(seeds)
    most = seeds.count()
    for name, own in texts.items():
        needed = only_needed(own, seeds.select(F.col(name).alias("record")), most)
        seeds = seeds.join(needed.select(F.col("record").alias(name), F.col("sequence").alias(f"s{name}")), name)
    return seeds.select("a", "b", "xs", "ys", "sa", "sb").mapInPandas(_align(threshold), OVERLAP)


def cross_split_classes(records: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per record of (record, split, text) with a 3-gram: (record, train, class_id, links).

    class_id is the smallest record of the same side with the same words, links the number of classes of the other side at or over
    the threshold; copies are not expanded into pairs.
    """
    members, classes = split_classes(records)
    found = class_overlaps(classes, threshold).select("a", "b")
    degree = found.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(degree, "class", "left").select("record", "train", F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def cross_split_pairs(records: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(train_record, other_record, similarity, coverage_train, coverage_other): rows of (record, split, text), copies expanded."""
    members, classes = split_classes(records)
    found = class_overlaps(classes, threshold)
    left = members.where("train").select(F.col("class").alias("a"), F.col("record").alias("train_record"))
    right = members.where("not train").select(F.col("class").alias("b"), F.col("record").alias("other_record"))
    return (
        found.join(left, "a")
        .join(right, "b")
        .select("train_record", "other_record", "similarity", F.col("coverage_a").alias("coverage_train"), F.col("coverage_b").alias("coverage_other"))
    )


def overlap_report(records: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per split and source of (record, split, source, text): rows, rows that overlap the train split, best and mean coverage.

    A row counts once however many train rows it overlaps; coverage is that of its most similar train class.
    """
    members, classes = split_classes(records)
    best = (
        class_overlaps(classes, threshold)
        .groupBy("b")
        .agg(F.max("similarity").alias("similarity"), F.max("coverage_b").alias("coverage"), F.count("*").alias("train_classes"))
    )
    hit = members.where("not train").join(best.withColumnRenamed("b", "class"), "class").select("record", "similarity", "coverage", "train_classes")
    return (
        records.select("record", split_name().alias("split"), "source")
        .where("split <> 'train'")
        .join(hit, "record", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("rows"),
            F.count("similarity").alias("overlapping"),
            F.count_if(F.col("similarity") == 1.0).alias("exact"),
            F.max("coverage").alias("max_coverage"),
            F.avg("coverage").alias("mean_coverage"),
        )
    )
