"""Shared pieces of the operators on pairs of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import WordHashes, flat_word_hashes, gram_hashes, split_grams


def shingle_batches(batches: Iterator[pd.DataFrame], size: int, counted: bool = False) -> Iterator[pd.DataFrame]:
    """(record, text) to (record, content, shingles, counts if counted): sorted different shingle hashes and a 128-bit key of them.

    Texts without a shingle are left out: their similarity to any text is 0.
    """
    known = WordHashes()
    for batch in batches:
        flat, ends = flat_word_hashes(batch["text"], known)
        sets = [np.unique(g, return_counts=True) for g in split_grams(gram_hashes(flat, size), ends, size)]
        kept = [i for i, (s, _) in enumerate(sets) if len(s)]
        if not kept:
            continue
        key = lambda i: sets[i][0].tobytes() + (sets[i][1].tobytes() if counted else b"")
        made = {
            "record": batch["record"].to_numpy()[kept],
            "content": [hashlib.blake2b(key(i), digest_size=16).hexdigest() for i in kept],
            "shingles": [sets[i][0].view(np.int64) for i in kept],
        }
        yield pd.DataFrame(made | {"counts": [sets[i][1].astype(np.int32) for i in kept]} if counted else made)


#: Ids that go to all workers. The driver builds their hash table: 1 million take it 0.2 GB at the peak, 4 million 0.6 GB and more.
MOST_IDS = 1_000_000


def only_needed(classes: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Classes (record, ...) among the ids (record), of which there are at most `most`.

    Few texts have a candidate, so their ids go to all workers and no other text is shuffled; more than MOST_IDS join by shuffle.
    """
    found = ids.where("record is not null").distinct()
    return classes.join(F.broadcast(found) if most <= MOST_IDS else found.hint("merge"), "record", "left_semi")
