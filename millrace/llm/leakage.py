"""Held-out passages inside a corpus: one word automaton over all test questions and answers, each text scanned once.

Patterns. Every window of `window` consecutive words of a question, and the answer as a whole, are keys of one Aho-Corasick
automaton whose letters are word numbers (words as in millrace.functions.words). A document is normalised, split into words
and scanned once; hits of an item that overlap or touch form one run, and every run is a passage with its offsets in the original
text, so two far-apart hits never make one passage over unrelated text.

Size. The items are the stated query set. Their bytes are counted first. Up to `block_bytes` all go to every worker as one
automaton. A larger set is cut into blocks of about that size by a hash of the item, and still every text of the corpus is scanned
once: the scan keeps the hashes of windows that pass a Bloom filter of all item windows (its size is bounded, whatever the items),
an exact join of those few hashes with the items' tells which blocks a text has to see, and only such texts move, with the block,
to its automaton. A block with many texts is spread over tasks by a salt. Every item is found at any size, by the same automata.

Inputs. Null, empty and blank texts on either side give no rows, an item shorter than the window has no window and is never
found, duplicate items are each reported, very long texts are scanned whole. Only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import WORD, WordHashes, flat_word_hashes, gram_hashes, mix, normalise, split_grams, words
from millrace.runtime import cut_lineage, spread

SCHEMA = (
    "doc_id bigint, item_id string, run int, windows int, words int, item_words int, coverage double, "
    "start_char int, end_char int, answer_leaked boolean"
)


class Matcher:
    """The automaton over a block of items (id, question, answer)."""

    def __init__(self, items: list[tuple[str, str, str | None]], window: int):
        import ahocorasick

        self.window, self.number, self.items = window, {}, []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        keys: dict[tuple[int, ...], tuple[list, list]] = {}
        for at, (item, question, answer) in enumerate(items):
            asked, told = self._numbers(question, grow=True), self._numbers(answer, grow=True)
            self.items.append((item, len(asked), len(told)))
            for k in range(len(asked) - window + 1):
                keys.setdefault(asked[k : k + window], ([], []))[0].append((at, k))
            if told:
                keys.setdefault(told, ([], []))[1].append(at)
        for key, value in keys.items():
            self.automaton.add_word(key, (len(key), *value))
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    def _numbers(self, text: str | None, grow: bool = False) -> tuple[int, ...]:
        if grow:
            return tuple(self.number.setdefault(w, len(self.number) + 1) for w in words(text))
        get = self.number.get
        return tuple(get(w, 0) for w in words(text))

    def scan(self, text: str, near: int) -> list[tuple]:
        """(item, run, windows, words of the run, item words, coverage, first word, last word, answer follows), one a run of hits.

        Coverage is the share of the item's words inside any hit of the text, the same for all its runs.
        """
        sequence = self._numbers(text)
        if self.empty or len(sequence) < self.window:
            return []
        asked: dict[int, list[tuple[int, int]]] = {}
        told: dict[int, list[int]] = {}
        for end, (length, windows, answers) in self.automaton.iter(sequence):
            for at, k in windows:
                asked.setdefault(at, []).append((end - length + 1, k))
            for at in answers:
                told.setdefault(at, []).append(end - length + 1)
        found = []
        for at, hits in asked.items():
            item, size, _ = self.items[at]
            covered = {k + j for _, k in hits for j in range(self.window)}
            runs: list[list[int]] = []
            for start in sorted({h for h, _ in hits}):
                if runs and start <= runs[-1][1] + 1:
                    runs[-1][1], runs[-1][2] = start + self.window - 1, runs[-1][2] + 1
                else:
                    runs.append([start, start + self.window - 1, 1])
            for run, (first, last, n) in enumerate(runs, 1):
                follows = any(last < s <= last + near for s in told.get(at, ()))
                found.append((item, run, n, last - first + 1, size, len(covered) / size, first, last, follows))
        return found


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end in the original text of every word of the normalised text.

    Normalisation is done piece by piece, a piece being a character with its combining marks; where the pieces do not add up to
    the whole normalised text (final sigma, Jamo), pieces between blanks are taken. Empty where those do not add up either:
    offsets are never guessed.
    """
    whole = normalise(text)
    for pieces in (re.finditer(r".[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]*", text, re.S), re.finditer(r"\s+|\S+", text)):
        origin: list[tuple[int, int]] = []
        made: list[str] = []
        for m in pieces:
            piece = unicodedata.normalize("NFKC", m.group()).lower()
            made.append(piece)
            origin += [m.span()] * len(piece)
        if "".join(made) == whole:
            break
    else:
        return []
    return [(origin[m.start()][0], origin[m.end() - 1][1]) for m in WORD.finditer(whole)]


_ready: dict[int, Matcher] = {}


def _matcher(shared, window: int) -> Matcher:
    """One automaton a worker: the last one built stays for the next task."""
    if shared.id not in _ready:
        _ready.clear()
        _ready[shared.id] = Matcher(shared.value, window)
    return _ready[shared.id]


class _Shared:
    """A broadcast with a key by which a worker knows it again."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _passages(matcher: Matcher, docs, texts, near: int) -> pd.DataFrame | None:
    """Rows of SCHEMA of some texts; null without any."""
    rows = []
    for doc, text in zip(docs, texts, strict=True):
        if hits := matcher.scan(text, near):
            offsets = word_offsets(text)
            for *found, first, last, follows in hits:
                start, end = (offsets[first][0], offsets[last][1]) if offsets else (None, None)
                rows.append((doc, *found, start, end, follows))
    if not rows:
        return None
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"start_char": "Int32", "end_char": "Int32"})


#: Bits a window in the Bloom filter and hashes a window; the filter has at most MOST_BITS (64 MB).
BITS_A_WINDOW, FILTER_HASHES, MOST_BITS = 16, 3, 1 << 29
CHUNK = 1 << 14
#: Bytes of texts a task holds of one block.
TASK_BYTES = 64 << 20


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(hashes + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(FILTER_HASHES)]


def _window_sets(texts, window: int, known: WordHashes) -> list[np.ndarray]:
    """Different window hashes of each text."""
    flat, ends = flat_word_hashes(texts, known)
    return [np.unique(g) for g in split_grams(gram_hashes(flat, window), ends, window)]


def _item_windows(items: DataFrame, window: int, blocks: int) -> DataFrame:
    """(hash, block) of every window of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets = _window_sets(batch["text"], window, known)
            if any(map(len, sets)):
                yield pd.DataFrame({"hash": np.concatenate(sets).view(np.int64), "block": np.repeat(batch["block"].to_numpy(), [len(s) for s in sets])})

    keyed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    return keyed.select("text", "block").mapInPandas(run, "hash bigint, block int").distinct()


def _bloom(windows: DataFrame, bits: int) -> np.ndarray:
    """The filter of all windows, as 64-bit words; made of chunks that each combine before they meet."""

    def masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = np.concatenate(_positions(batch["hash"].to_numpy().view(np.uint64), bits)) if len(batch) else np.zeros(0, dtype=np.int64)
            word, bit = places >> 6, np.left_shift(np.uint64(1), (places & 63).astype(np.uint64))
            slots, inverse = np.unique(word, return_inverse=True)
            mask = np.zeros(len(slots), dtype=np.uint64)
            np.bitwise_or.at(mask, inverse, bit)
            yield pd.DataFrame({"slot": slots, "mask": mask.view(np.int64)})

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(CHUNK, dtype=np.int64)
        words[rows["slot"].to_numpy() % CHUNK] = rows["mask"].to_numpy()
        return pd.DataFrame({"chunk": [key[0]], "words": [words.tobytes()]})

    slots = windows.select("hash").mapInPandas(masks, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    chunks = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK)).groupBy("chunk").applyInPandas(chunk, "chunk bigint, words binary")
    out = np.zeros(max(bits >> 6, CHUNK), dtype=np.int64)
    for row in chunks.toLocalIterator():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.words, dtype=np.int64)
    return out


def _many_blocks(texts: DataFrame, items: DataFrame, window: int, near: int, blocks: int) -> DataFrame:
    """Passages of a set of items too large for one automaton; see the module's text."""
    spark = texts.sparkSession
    windows = cut_lineage(_item_windows(items, window, blocks))
    bits = min(MOST_BITS, 1 << max(20, (BITS_A_WINDOW * max(1, windows.count()) - 1).bit_length()))
    shared = spark.sparkContext.broadcast(_bloom(windows, bits))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, words = WordHashes(), shared.value.view(np.uint64)
        for batch in batches:
            sets = _window_sets(batch["text"], window, known)
            hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            passed = np.ones(len(hashes), dtype=bool)
            for place in _positions(hashes, bits):
                passed &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            if passed.any():
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].to_numpy()[owner[passed]],
                        "bytes": batch["text"].str.len().to_numpy()[owner[passed]],
                        "hash": hashes[passed].view(np.int64),
                    }
                )

    found = texts.mapInPandas(suspects, "doc_id bigint, bytes bigint, hash bigint").join(windows, "hash").select("doc_id", "block", "bytes").distinct()
    routed = cut_lineage(found)
    load = routed.groupBy("block").agg(F.ceil(F.sum(F.col("bytes")) * 4 / TASK_BYTES).cast("int").alias("salts"))
    keyed_docs = texts.join(routed.select("doc_id", "block"), "doc_id").join(load, "block").withColumn(
        "salt",
        F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"),
    )
    keyed_items = items.withColumn(
        "block",
        F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"),
    ).join(load, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def match(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")})
        if docs.empty or held.empty:
            return empty
        held = held.sort_values(["item_id", "text"])
        matcher = Matcher(list(zip(held["item_id"], held["text"], held["gold_answer"], strict=True)), window)
        made = _passages(matcher, docs["doc_id"], docs["text"], near)
        return empty if made is None else made

    left = keyed_docs.select("block", "salt", "doc_id", "text").groupBy("block", "salt")
    return left.cogroup(keyed_items.select("block", "salt", "item_id", "text", "gold_answer").groupBy("block", "salt")).applyInPandas(match, SCHEMA)


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = 12, near: int = 60, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document (doc_id, text), item (item_id, text, gold_answer) and run of common windows, runs counted from 1.

    windows counts the hits of the run, words its length; coverage is the share of the item's words inside hits anywhere in the
    document; start_char and end_char delimit the run in the original text (null where normalisation hides the offsets);
    answer_leaked tells whether the item's answer begins within `near` words after the run. Eager in the bytes of the items and, for
    a set over `block_bytes`, in their windows and the scan. A document id that occurs twice is two documents of that id up to
    `block_bytes`, so ids should be unique.
    """
    spark = documents.sparkSession
    held = items.where("text is not null").select("item_id", "text", "gold_answer")
    size = held.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("gold_answer"), F.lit(0))), F.count("*")).first()
    texts = spread(documents.select("doc_id", "text").where("text is not null"))
    if not size[1]:
        return spark.createDataFrame([], SCHEMA)
    if size[0] > block_bytes:
        return _many_blocks(texts, held, window, near, min(size[1], -(-size[0] // block_bytes)))
    shared = _Shared(spark.sparkContext.broadcast([tuple(r) for r in held.orderBy("item_id").collect()]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(shared, window)
        for batch in batches:
            if (made := _passages(matcher, batch["doc_id"], batch["text"], near)) is not None:
                yield made

    return texts.mapInPandas(scan, SCHEMA)


def leaked_items(passages: DataFrame) -> DataFrame:
    """Per item: documents that hold part of it, passages in them, the largest coverage, and passages that its answer follows."""
    return passages.groupBy("item_id").agg(
        F.count_if(F.col("run") == 1).alias("documents"),
        F.count("*").alias("passages"),
        F.max("coverage").alias("max_coverage"),
        F.count_if("answer_leaked").alias("with_answer"),
    )
