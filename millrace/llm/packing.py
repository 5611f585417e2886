"""Filling containers of fixed capacity with texts: large items are matched in pairs, small ones fill the gaps best-fit.

Plan. Only (doc_id, size) moves. Ids are hashed into shards of about `shard_rows` rows, the number of shards follows a count of
the rows, so a task never grows with the data; each shard is packed on its own. A shard leaves at most a few loosely filled
containers at its end: the items of containers filled less than `repack_below` go into a second round with far fewer shards.
Texts are scanned once, for all kinds of containers: sizes are cut in the checkpoint folder, counted there and then meet every kind;
the first round is cut as well, as its two halves are read apart.

Within a shard. Texts larger than the capacity C give full containers and one rest; nothing else is split. Items over C/3 are
taken by size, largest first, and each gets as partner the largest unpaired one that fits, so a container holds at most two.
The others, largest first, go into the container with the least room that suffices, or open a new one.

Sizes. Tokens of the byte-level ByT5 tokenizer: one per UTF-8 byte and one end token. Null texts have no size and are left out;
an empty text is one token. Ties are broken by doc_id, so reruns and other partitionings give the same containers.
Rows with the same doc_id are items of their own only if `doc_id` is unique; duplicates are packed as often as they occur. A kind
without a positive capacity is an error when rows are packed; no kinds give no rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut_lineage

PACKED = "container_kind string, capacity int, container string, container_size int, doc_id bigint, doc_size bigint, piece int, piece_from bigint, piece_size int"


def byte_tokens(column: str) -> Column:
    """Size in tokens of the byte-level ByT5 tokenizer."""
    return F.octet_length(column).cast("bigint") + 1


_counters: dict[tuple[str, str | None], Callable[[list[str]], list[int]]] = {}


def _counter(path: str, pattern: str | None) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by a vocabulary file, loaded once a worker; the ending tells the library."""
    if (path, pattern) in _counters:
        return _counters[path, pattern]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        counter = lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    elif path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        counter = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    elif path.endswith(".tiktoken"):
        import base64

        import tiktoken

        if pattern is None:
            raise ValueError("ranks need the pattern that splits texts")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        counter = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    else:
        raise ValueError(f"unknown kind of vocabulary file: {path}")
    _counters[path, pattern] = counter
    return counter


def vocabulary_tokens(column: str, path: str, pattern: str | None = None) -> Column:
    """Size in tokens by a vocabulary file that every executor can read; null for null."""

    @F.pandas_udf("bigint")
    def sizes(texts: pd.Series) -> pd.Series:
        counts = iter(_counter(path, pattern)([t for t in texts if t is not None]))
        return pd.Series([None if t is None else next(counts) for t in texts], dtype="Int64")

    return sizes(F.col(column))


class Gaps:
    """Open containers by free room; the next suitable one is the lowest set bit at or over the size."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, container: int, room: int) -> None:
        if room:
            self.by_room[room].append(container)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The container with the least room that suffices, and its room."""
        above = self.mask >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        held = self.by_room[room]
        container = held.pop()
        if not held:
            self.mask &= ~(1 << room)
        return container, room


def pack(items: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Containers as lists of item positions, for items (size, tie) of at most the capacity."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1]))
    large = [i for i in order if 3 * items[i][0] > capacity]
    containers: list[list[int]] = []
    gaps = Gaps(capacity)
    ascending = [(items[i][0], -r) for r, i in enumerate(large)][::-1]  # by size, then later rank first
    while ascending:
        size, rank = ascending.pop()
        mine = [large[-rank]]
        room = capacity - size
        fits = bisect.bisect_right(ascending, (room, 1)) - 1
        if fits >= 0:
            other, rank = ascending.pop(fits)
            mine.append(large[-rank])
            room -= other
        gaps.add(len(containers), room)
        containers.append(mine)
    for i in order[len(large) :]:
        size = items[i][0]
        if found := gaps.take(size):
            container, room = found
            containers[container].append(i)
            gaps.add(container, room - size)
        else:
            gaps.add(len(containers), capacity - size)
            containers.append([i])
    return containers


def pack_group(kind: str, capacity: int, shard: str, rows: pd.DataFrame) -> pd.DataFrame:
    """Containers of one shard; rows are pieces (doc_id, doc_size, piece, piece_from, piece_size)."""
    rows = rows.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    containers = pack(list(zip(rows["piece_size"].tolist(), range(len(rows)), strict=True)), capacity)
    name, fill = [""] * len(rows), [0] * len(rows)
    sizes = rows["piece_size"].tolist()
    for k, members in enumerate(containers):
        filled = sum(sizes[i] for i in members)
        for i in members:
            name[i], fill[i] = f"{shard}-{k}", filled
    return rows.assign(container_kind=kind, capacity=capacity, container=name, container_size=fill)[[c.split()[0] for c in PACKED.split(", ")]]


def _pack_shards(pieces: DataFrame, shards: int, label: str) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, shard = key
        return pack_group(kind, int(capacity), f"{label}{shard}", rows)

    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return keyed.groupBy("container_kind", "capacity", "shard").applyInPandas(run, PACKED)


def pack_kinds(
    documents: DataFrame, limits: DataFrame, text: str = "text", key: str = "doc_id", shard_rows: int = 20_000, repack_below: float = 0.9, size: Column | None = None
) -> DataFrame:
    """Every piece of every non-null text with its container, for every kind of limits (container_kind, capacity).

    Columns: container_kind, capacity, container, container_size, doc_id, doc_size, piece, piece_from, piece_size; a container is
    named within its kind. Sizes are ByT5 tokens unless `size` gives others (see vocabulary_tokens); an item of size 0 needs no
    container. A text of at most the capacity is one piece 0. Eager in the sizes and the first round.
    """
    sized = cut_lineage(
        documents.select(F.col(key).alias("doc_id"), (byte_tokens(text) if size is None else size.cast("bigint")).alias("doc_size")).where("doc_size > 0")
    )
    shards = max(1, math.ceil(sized.count() / shard_rows))
    room = F.coalesce(
        F.when(F.col("capacity") > 0, F.col("capacity").cast("int")),
        F.raise_error(F.lit("a kind of container needs a positive capacity")).cast("int"),
    )
    kinds = limits.agg(F.collect_list(F.struct("container_kind", room.alias("capacity"))).alias("kinds")).scalar()
    wanted = sized.select("doc_id", "doc_size", F.inline(kinds))
    pieces = wanted.select(
        "container_kind", "capacity", "doc_id", "doc_size",
        F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("doc_size") - 1, F.col("capacity").cast("bigint"))).alias("piece", "piece_from"),
    ).withColumn("piece_size", F.least(F.col("capacity").cast("bigint"), F.col("doc_size") - F.col("piece_from")).cast("int"))
    names = [c.split()[0] for c in PACKED.split(", ")]
    whole = F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece")
    full = pieces.where("piece_size = capacity").withColumns({"container": whole, "container_size": F.col("piece_size")}).select(*names)
    first = _pack_shards(pieces.where("piece_size < capacity"), shards, "a")
    if shards == 1:
        return full.unionByName(first)
    first = cut_lineage(first)
    loose = F.col("container_size") < F.floor(F.col("capacity") * repack_below)
    again = first.where(loose).drop("container", "container_size")
    return full.unionByName(first.where(~loose)).unionByName(_pack_shards(again, max(1, math.ceil(shards / 50)), "b"))


def pack_texts(documents: DataFrame, capacity: int, **more) -> DataFrame:
    """pack_kinds for one capacity, without the columns of the kind."""
    limits = documents.sparkSession.createDataFrame([("one", capacity)], "container_kind string, capacity int")
    return pack_kinds(documents, limits, **more).drop("container_kind", "capacity")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind of container: containers, tokens, the least possible number of containers, and the share of unused room."""
    held = packed.groupBy("container_kind", "capacity", "container").agg(F.sum("piece_size").alias("held"))
    total = held.groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"))
    return total.select(
        "container_kind",
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"),
    )
