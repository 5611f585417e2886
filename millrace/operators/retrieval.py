"""Lexical and vector top-k retrieval, and the update rules of a memory of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import identifier_tokens, lexical_tokens
from millrace.operators.dedup import upsert
from millrace.runtime import spread

#: Queries a vector scan holds at a time; 4,096 vectors of 1,024 floats are 16 MB.
BLOCK = 4096


def top_k(scored: DataFrame, query: str | list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of every query. Spark limits the window's rows per task before the shuffle (WindowGroupLimit)."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col(name) <= k)


def item_tokens(text: Column, keywords: Column | None = None) -> Column:
    """Tokens of an item: its keywords as they are and the identifiers of its text."""
    own = identifier_tokens(F.coalesce(text, F.lit("")))
    return own if keywords is None else F.array_distinct(F.concat(F.coalesce(keywords, F.array().cast("array<string>")), own))


#: Scores a task holds at a time: 2 million doubles are 16 MB.
CELLS = 2_000_000


def _query_blocks(queries: DataFrame, columns: list[str], block: int) -> Iterator[list]:
    """The stated queries in blocks of bounded size."""
    held = []
    for row in queries.select(*columns).orderBy(columns[0]).toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _part_scores(part: pd.DataFrame, count: int, postings: dict[str, np.ndarray], sizes: np.ndarray, rule, weights) -> tuple[np.ndarray, np.ndarray]:
    """Common tokens and scores of a part of the items (rows) for all queries of a block (columns)."""
    common = np.zeros((len(part), count), dtype=np.int32)
    scores = np.zeros((len(part), count))
    for i, tokens in enumerate(part["tokens"]):
        sums = np.zeros(count)
        for token in tokens:
            if (places := postings.get(token)) is not None:
                common[i, places] += 1
                if weights is not None:
                    sums[places] += weights[token]
        scores[i] = rule(common[i], sums, sizes, len(tokens))
    return common, scores


def _postings(block: list) -> dict[str, np.ndarray]:
    """Token to the places of the block's queries that hold it."""
    lists: dict[str, list[int]] = {}
    for place, row in enumerate(block):
        for token in row[1]:
            lists.setdefault(token, []).append(place)
    return {t: np.array(p) for t, p in lists.items()}


def _scan(items: DataFrame, block: list, score, keep_zeros: bool, k: int, kinds: dict[str, str]) -> DataFrame:
    """(query_id, item_id, ordinal, common, score): the k best of every Arrow batch of items (item_id, ordinal, tokens) for each query.

    `score(common, sums, sizes, item_size)` gives the scores of one item for all queries; `sums` adds the weights of common tokens.
    """
    shared = items.sparkSession.sparkContext.broadcast(([r[0] for r in block], _postings(block), np.array([len(r[1]) for r in block]), score))
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, ordinal {kinds['ordinal']}, common bigint, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, postings, sizes, (rule, weights) = shared.value
        names = np.array(ids)
        step = max(1, CELLS // len(ids))
        for batch in batches:
            ordered = batch.sort_values("ordinal", kind="stable")
            for start in range(0, len(ordered), step):
                part = ordered.iloc[start : start + step]
                common, scores = _part_scores(part, len(ids), postings, sizes, rule, weights)
                best = np.argsort(-np.round(scores, 12), axis=0, kind="stable")[:k]
                chosen = np.take_along_axis(scores, best, 0).ravel()
                counts = np.take_along_axis(common, best, 0).ravel()
                out = pd.DataFrame(
                    {
                        "query_id": np.tile(names, len(best)),
                        "item_id": part["item_id"].to_numpy()[best.ravel()],
                        "ordinal": part["ordinal"].to_numpy()[best.ravel()],
                        "common": counts,
                        "score": chosen,
                    }
                )
                out = out if keep_zeros else out[out["common"] > 0]
                if len(out):
                    yield out

    return spread(items.select("item_id", "ordinal", "tokens")).mapInPandas(run, schema)


def _kinds(queries: DataFrame, items: DataFrame) -> dict[str, str]:
    return {
        "query_id": dict(queries.dtypes)["query_id"],
        "item_id": dict(items.dtypes)["item_id"],
        "ordinal": dict(items.dtypes).get("ordinal", dict(items.dtypes)["item_id"]),
    }


def _jaccard(common, _sums, sizes, size):
    union = sizes + size - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def _by_root(_common, sums, _sizes, size):
    return sums / max(1.0, np.sqrt(size))


def jaccard_top_k(queries: DataFrame, items: DataFrame, k: int, weight: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, common, score, rank): items (item_id, ordinal, tokens) by Jaccard similarity to queries (query_id, tokens).

    Zero scores are kept, ties go by ordinal. The stated queries are read in blocks; a block becomes an inverted index that every
    task scans its items against, and only a batch's own k best per query are shuffled. Token lists hold no token twice.
    """
    kinds = _kinds(queries, items)
    held = items.where("tokens is not null")
    parts = [_scan(held, b, (_jaccard, None), True, k, kinds) for b in _query_blocks(queries.where("tokens is not null"), ["query_id", "tokens"], block)]
    if not parts:
        return items.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, common bigint, score double, rank int")
    scored = _union(parts).withColumn("score", F.lit(weight) * F.col("score"))
    return top_k(scored, "query_id", [F.desc("score"), F.asc("ordinal")], k).drop("ordinal")


def memory_top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    keyword_weight: float = 0.5,
    embedding_weight: float = 0.5,
    order: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, memory_type, item_id, common, score, rank): the k first items of each store for every query.

    Queries are (query_id, tokens, vector), items (item_id, ordinal, memory_type, tokens, vector). The score is keyword_weight * Jaccard
    + embedding_weight * cosine, summed before any cut; a null or zero vector adds nothing. Zero scores are kept, ties go by ordinal.
    Each store is cut to 2k, put in the order of an outside ranker (query_id, memory_type, item_id, position) if given, and cut to k.
    Blocks of queries are scanned as in jaccard_top_k, in blocks of bounded size.
    """
    kinds = _kinds(queries, items)
    held = items.where("tokens is not null and memory_type is not null").select("item_id", "ordinal", "memory_type", "tokens", "vector")
    schema = f"query_id {kinds['query_id']}, memory_type string, item_id {kinds['item_id']}, ordinal {kinds['ordinal']}, common bigint, score double"
    by = ["query_id", "memory_type"]

    def scan(rows: list) -> DataFrame:
        width = next((len(r[2]) for r in rows if r[2] is not None), 0)
        asked = _unit(np.array([r[2] if r[2] is not None else np.zeros(width) for r in rows], dtype=np.float64))
        shared = items.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), _postings(rows), np.array([len(r[1]) for r in rows]), asked))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, postings, sizes, wanted = shared.value
            step = max(1, CELLS // len(ids))
            for batch in batches:
                for store, of_store in batch.groupby("memory_type"):
                    ordered = of_store.sort_values("ordinal", kind="stable")
                    for start in range(0, len(ordered), step):
                        part = ordered.iloc[start : start + step]
                        common, scores = _part_scores(part, len(ids), postings, sizes, _jaccard, None)
                        scores *= keyword_weight
                        if wanted.shape[1]:
                            vectors = np.array([v if v is not None else np.zeros(wanted.shape[1]) for v in part["vector"]], dtype=np.float64)
                            scores += embedding_weight * (_unit(vectors) @ wanted.T)
                        best = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[: 2 * k]
                        places = best.ravel()
                        yield pd.DataFrame(
                            {
                                "query_id": np.tile(ids, len(best)), "memory_type": store, "item_id": part["item_id"].to_numpy()[places], "ordinal": part["ordinal"].to_numpy()[places],
                                "common": np.take_along_axis(common, best, 0).ravel(), "score": np.take_along_axis(scores, best, 0).ravel(),
                            }
                        )

        return spread(held).mapInPandas(run, schema)

    parts = [scan(b) for b in _query_blocks(queries.where("tokens is not null"), ["query_id", "tokens", "vector"], block)]
    if not parts:
        return items.sparkSession.createDataFrame([], f"{schema}, rank int").drop("ordinal")
    ranked = top_k(_union(parts), by, [F.desc(F.round("score", 9)), F.asc("ordinal")], 2 * k).drop("ordinal")
    return (ranked if order is None else rerank(ranked, order, by)).where(F.col("rank") <= k)


def idf_top_k(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, score, rank): sum over common tokens of ln((N+1)/(df+1)) + 1, by the root of the item's token count.

    Queries are (query_id, text), items (item_id, text). Document frequencies cover all items; items without a common token are
    not ranked; ties go by item_id. Blocks of queries are scanned as in jaccard_top_k; the frequencies of a block's tokens, and
    no others, come to the driver. Eager in the count of items and in those frequencies.
    """
    kinds = _kinds(queries, items) | {"ordinal": dict(items.dtypes)["item_id"]}
    tokens = items.select("item_id", F.col("item_id").alias("ordinal"), lexical_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    asked = queries.select("query_id", lexical_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    spark, total, parts = items.sparkSession, items.count(), []
    for held in _query_blocks(asked, ["query_id", "tokens"], block):
        words = spark.createDataFrame([(t,) for t in sorted({t for r in held for t in r[1]})], "token string")
        found = tokens.select(F.explode("tokens").alias("token")).join(words, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df")).collect()
        weights = {r.token: float(np.log((total + 1.0) / (r.df + 1)) + 1) for r in found}
        parts.append(_scan(tokens, held, (_by_root, _Weights(weights)), False, k, kinds))
    if not parts:
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double, rank int")
    return top_k(_union(parts), "query_id", [F.desc(F.round("score", 9)), F.asc("item_id")], k).drop("ordinal", "common")


class _Weights(dict):
    """Weights of tokens; a token that no item holds weighs nothing."""

    def __missing__(self, _token: str) -> float:
        return 0.0


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest items (item_id, vector) of every query (query_id, vector) by cosine.

    The stated queries are read in blocks of bounded size and each block is scanned against all items in Arrow batches: a batch
    is one matrix product, of which only its own k best per query leave the task. Zero vectors score 0; nulls are left out.
    """
    spark = items.sparkSession

    def scan(block_rows: list) -> DataFrame:
        ids = np.array([r[0] for r in block_rows])
        shared = spark.sparkContext.broadcast((ids, _unit(np.array([r[1] for r in block_rows], dtype=np.float64))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, vectors = shared.value
            step = max(1, CELLS // len(own))
            for batch in batches:
                for start in range(0, len(batch), step):
                    part = batch.iloc[start : start + step].sort_values("item_id", kind="stable")
                    scores = vectors @ _unit(np.array(part["vector"].tolist(), dtype=np.float64)).T
                    best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame(
                        {
                            "query_id": np.repeat(own, best.shape[1]),
                            "item_id": part["item_id"].to_numpy()[best].ravel(),
                            "score": np.take_along_axis(scores, best, 1).ravel(),
                        }
                    )

        return items.where("vector is not null").select("item_id", "vector").mapInPandas(run, "query_id bigint, item_id bigint, score double")

    parts = [scan(b) for b in _query_blocks(queries.where("vector is not null"), ["query_id", "vector"], block)]
    if not parts:
        return spark.createDataFrame([], "query_id bigint, item_id bigint, score double, rank int")
    return top_k(_union(parts), "query_id", [F.desc(F.round("score", 9)), F.asc("item_id")], k)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def rerank(ranked: DataFrame, order: DataFrame, by: str | list[str] = "query_id") -> DataFrame:
    """Ranked rows (query_id, item_id, rank) in the order an outside ranker gave (query_id, item_id, position), within `by`.

    Ids it made up are dropped, items it left out follow in their old order.
    """
    keys = [by] if isinstance(by, str) else by
    joined = ranked.join(order, [*keys, "item_id"], "left")
    place = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("position"), "rank")
    return joined.withColumn("rank", F.row_number().over(place)).drop("position")


def memory_sizes(items: DataFrame, types: list[str]) -> DataFrame:
    """(memory_type, items) for every type, 0 where a store is empty."""
    all_types = items.sparkSession.createDataFrame([(t,) for t in types], "memory_type string")
    return all_types.join(items.groupBy("memory_type").agg(F.count("*").alias("items")), "memory_type", "left").fillna(0, ["items"])


def memory_outcome(final: Column, nodes: Column, edges: Column, failures: Column, repair: Column) -> Column:
    """success, failure or none of a rollout. Without edges their mean is 0, so such a rollout never counts as a success."""
    mean = lambda m: F.coalesce(F.try_divide(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x), F.size(m)), F.lit(0.0))
    clean = F.coalesce(F.size(failures) <= 0, F.lit(True))
    good = (final >= 1) & (mean(nodes) >= 0.8) & (mean(edges) >= 0.8) & clean
    return F.when(F.coalesce(good, F.lit(False)), "success").when(~clean | repair.isin("succeeded", "failed"), "failure").otherwise("none")


def update_memory(memory: DataFrame, additions: DataFrame) -> DataFrame:
    """A snapshot with new items over it. A batch retrieves against a snapshot and updates afterwards, unlike a loop that updates
    between problems; that is a documented difference."""
    return upsert(memory, additions, "id")
