"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

The index is cut into shards of documents.  A shard holds one list per term, in blocks of BLOCK postings:
places of documents as gaps of two bytes, occurrences in one byte or four, and for each block its first
and last place and the largest impact in it, where the impact of a posting is its score at weight 1.

A search joins the terms of the queries with the index and ranks inside every shard:

1. The lists of a query are ordered by their global bounds (weight times largest impact in any shard).
   They are read whole until the bounds of the rest cannot lift a document that has not been seen above
   the k-th score so far.  The rest are not essential.
2. A document that has been seen goes on only if its score so far and the block maxima of the lists that
   are not essential reach the k-th score.  Only blocks that hold such documents are decoded.
3. The best documents of all shards are merged.

Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower
case.  Null text has none.  With N documents that have terms, L terms in them, n in one of them, df
documents with a term and tf occurrences in one, the weight of a term is w =
floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + 50 n N div L, and a posting scores
w (10^9 tf div (1000 tf + 20 m)).  Equal scores rank by ascending ``doc_id``, a null one last.

Repeated rows are documents, or queries, of their own.  Documents or queries without terms give no rows,
and neither do empty tables.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage
from .text import word_list, words

K = 50
BLOCK = 128
#: A shard ends with the document that fills one of these.  Places must fit in two bytes.
SHARD_DOCS = 16_384
SHARD_BYTES = 1 << 24
#: Queries that are searched together in one shard.
QUERIES = 1024
#: Lists that are handed to Spark in one go.
BATCH_ROWS = 20_000

LISTS = (
    "shard long, term string, df long, top long, firsts array<int>, lasts array<int>, tops array<int>,"
    " gaps binary, tfs binary, wide_tfs binary"
)
_NO_ID = np.iinfo(np.int64).max


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Score of a posting at weight 1; ``norm`` is 20 m."""
    return (1_000_000_000 * tf) // (1000 * tf + norm)


class _Shard:
    """Documents of a shard that is being filled."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.sizes, self.terms, self.counts, self.bytes = [], [], [], [], 0

    def add(self, doc_id: int | None, found: list[bytes], size: int) -> None:
        number = self.vocabulary
        terms, counts = np.unique(
            np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)), return_counts=True
        )
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.terms.append(terms)
        self.counts.append(counts)
        self.bytes += size

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def norms(self, n_docs: int, n_terms: int) -> np.ndarray:
        return 20 * (50 + (50 * np.array(self.sizes, np.int64) * n_docs) // n_terms)

    def lists(self, norms: np.ndarray) -> dict[str, pa.Array]:
        """The columns of LISTS after the first, one row per term; all lists are packed in one go."""
        place = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts)
        order = np.argsort(term, kind="stable")
        term, place, tf = term[order], place[order], tf[order]
        bounds = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        sizes = np.diff(bounds)
        n_blocks = -(-sizes // BLOCK)
        block_bounds = np.concatenate([[0], np.cumsum(n_blocks)])
        within = np.arange(block_bounds[-1]) - np.repeat(block_bounds[:-1], n_blocks)
        starts = np.repeat(bounds[:-1], n_blocks) + within * BLOCK
        ends = np.minimum(starts + BLOCK, np.repeat(bounds[1:], n_blocks))
        tops = np.maximum.reduceat(impact(tf, norms[place]), starts)
        gaps = np.diff(place, prepend=0)
        gaps[starts] = 0
        wide = np.maximum.reduceat(tf, bounds[:-1]) > 255
        wide_tfs = np.full(len(sizes), None, object)
        for i in np.flatnonzero(wide).tolist():
            wide_tfs[i] = tf[bounds[i] : bounds[i + 1]].astype("<u4").tobytes()

        def blocks(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(block_bounds, pa.int32()), pa.array(values, pa.int32()))

        def packed(values: np.ndarray, width: int) -> pa.Array:
            offsets = pa.py_buffer((bounds * width).astype(np.int32).tobytes())
            data = pa.py_buffer(values.astype(f"<u{width}").tobytes())
            return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, data])

        return {
            "term": pa.array([t.decode("utf-8", "replace") for t in self.vocabulary], pa.string()),
            "df": pa.array(sizes, pa.int64()),
            "top": pa.array(np.maximum.reduceat(tops, block_bounds[:-1]), pa.int64()),
            "firsts": blocks(place[starts]),
            "lasts": blocks(place[ends - 1]),
            "tops": blocks(tops),
            "gaps": packed(gaps, 2),
            "tfs": packed(np.minimum(tf, 255), 1),
            "wide_tfs": pa.array(wide_tfs, pa.binary()),
        }


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(word_list(text)) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n"])


def _build(n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per list, and one with a null term per shard that holds its documents."""
    longs = pa.list_(pa.int64())

    def written(shard: _Shard, number: int) -> Iterator[pa.RecordBatch]:
        norms = shard.norms(n_docs, n_terms)
        lists = shard.lists(norms)
        n = len(shard.vocabulary)
        lists = {"shard": pa.array(np.full(n, number), pa.int64())} | lists
        lists |= {c: pa.nulls(n, longs) for c in ("ids", "norms")}
        batch = pa.RecordBatch.from_pydict(lists)
        for start in range(0, n, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)
        held = {"shard": [number], "ids": [shard.ids], "norms": [norms]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(held[f.name], f.type) if f.name in held else pa.nulls(1, f.type) for f in batch.schema],
            batch.schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                value = text.as_py()
                found = word_list(value)
                if found:
                    shard.add(doc_id, found, len(value))
                if shard.full:
                    yield from written(shard, number)
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield from written(shard, number)

    return run


class Index:
    """A written index: ``lists`` and ``shards``, and the number of documents with terms."""

    def __init__(self, lists: DataFrame, shards: DataFrame, n_docs: int):
        self.lists, self.shards, self.n_docs = lists, shards, n_docs


def build_index(docs: DataFrame) -> Index:
    """Index every document; its block maxima hold the lengths of all documents, so it is built anew
    when documents are added."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, n_terms = (
        rows.select("text")
        .mapInArrow(_count_terms, "n long")
        .agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)))
        .first()
    )
    built = stage(
        rows.mapInArrow(_build(n_docs, max(n_terms, 1)), f"{LISTS}, ids array<long>, norms array<long>"),
        "search-index",
    )
    lists = built.filter(F.col("term").isNotNull()).drop("ids", "norms")
    return Index(lists, built.filter(F.col("term").isNull()).select("shard", "ids", "norms"), n_docs)


class _List:
    """One list of a shard for the queries at hand; blocks are decoded when they are asked for."""

    def __init__(self, row, norms: np.ndarray):
        self.weight, self.bound = int(row.weight), int(row.weight) * int(row.bound)
        self.firsts, self.lasts = np.asarray(row.firsts), np.asarray(row.lasts)
        self.tops = np.asarray(row.tops, np.int64) * self.weight
        self.gaps = np.frombuffer(row.gaps, "<u2")
        wide = row.wide_tfs is not None
        self.tfs = np.frombuffer(row.wide_tfs, "<u4") if wide else np.frombuffer(row.tfs, "<u1")
        self.norms = norms
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of a block."""
        if b not in self.decoded:
            here = slice(b * BLOCK, (b + 1) * BLOCK)
            places = self.firsts[b] + np.cumsum(self.gaps[here], dtype=np.int64)
            scores = self.weight * impact(self.tfs[here].astype(np.int64), self.norms[places])
            self.decoded[b] = places, scores
        return self.decoded[b]

    def blocks_of(self, places: np.ndarray) -> np.ndarray:
        """The block that may hold each place, -1 if none."""
        b = np.searchsorted(self.firsts, places, side="right") - 1
        return np.where((b >= 0) & (places <= self.lasts[np.maximum(b, 0)]), b, -1)

    def maxima(self, places: np.ndarray) -> np.ndarray:
        b = self.blocks_of(places)
        return np.where(b >= 0, self.tops[np.maximum(b, 0)], 0)


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 with fewer above 0."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search_shard(lists: list[_List], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best documents of one shard for one query."""
    lists = sorted((x for x in lists if x.weight > 0), key=lambda x: -x.bound)
    rest = np.cumsum([0] + [x.bound for x in reversed(lists)])[::-1]
    total = np.zeros(len(ids), np.int64)
    least, essential = 0, 0
    for essential, found in enumerate(lists):
        # a document that no list so far holds scores at most rest
        if rest[essential] < least:
            break
        for b in range(len(found.firsts)):
            places, scores = found.block(b)
            total[places] += scores
        least = _kth(total[total > 0], k)
    else:
        essential = len(lists)
    places = np.flatnonzero(total)
    scores = total[places]
    others = lists[essential:]
    for j, found in enumerate(others):
        above = scores + sum((x.maxima(places) for x in others[j:]), np.zeros(len(places), np.int64))
        kept = above >= least
        places, scores = places[kept], scores[kept]
        b = found.blocks_of(places)
        for number in np.unique(b[b >= 0]).tolist():
            held, gained = found.block(number)
            asked = np.flatnonzero(b == number)
            at = np.minimum(np.searchsorted(held, places[asked]), len(held) - 1)
            scores[asked] += np.where(held[at] == places[asked], gained[at], 0)
        least = max(least, _kth(scores, k))
    best = np.lexsort((ids[places], -scores))[:k]
    return places[best], scores[best]


def _search(k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, lists: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int | None, int]] = []
        if len(lists):
            known = shard["ids"].iloc[0]
            ids = np.array([_NO_ID if i is None or i != i else i for i in known], np.int64)
            norms = np.asarray(shard["norms"].iloc[0], np.int64)
            of_query: dict[int, list[_List]] = {}
            for row in lists.itertuples():
                found = _List(row, norms)
                for query in row.queries:
                    of_query.setdefault(query, []).append(found)
            for query, its_lists in of_query.items():
                for place, score in zip(*search_shard(its_lists, ids, k)):
                    out.append((query, ids[place], score))
        frame = pd.DataFrame(out, columns=["query", "doc_id", "score"])
        frame["doc_id"] = frame["doc_id"].astype("Int64").mask(frame["doc_id"] == _NO_ID)
        return frame.astype({"query": "int64", "score": "int64"})

    return run


def search(index: Index, queries: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, rank, doc_id, score): the ``k`` best documents of every row of ``queries(key, text)``."""
    asked = stage(
        queries.select(
            F.monotonically_increasing_id().alias("query"),
            F.col(key).alias("key"),
            F.array_distinct(words(F.col("text").cast("string"))).alias("terms"),
        ),
        "queries",
    )
    n_groups = max(1, -(-asked.count() // QUERIES))
    terms = (
        asked.select("query", F.pmod(F.xxhash64("query"), F.lit(n_groups)).alias("group"), F.explode("terms").alias("term"))
        .groupBy("group", "term")
        .agg(F.collect_list("query").alias("queries"))
    )
    wanted = index.lists.join(terms.select("term").distinct(), "term", "left_semi")
    n = F.lit(index.n_docs)
    weights = wanted.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("bound")).select(
        "term", "bound", F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    )
    asked_terms = stage(terms.join(weights, "term"), "query-terms")
    lists = index.lists.drop("df", "top").join(asked_terms, "term").drop("term")
    # each group of queries meets each shard once
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long")))
    shards = index.shards.select(F.col("shard").alias("of_shard"), "ids", "norms", groups.alias("of_group"))
    found = (
        lists.groupBy("shard", "group")
        .cogroup(shards.groupBy("of_shard", "of_group"))
        .applyInPandas(_search(k), "query long, doc_id long, score long")
    )
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", F.col("key").alias(key)), "query").select(key, "rank", "doc_id", "score")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS t
  FROM documents
), q AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t
  FROM benchmark
), totals AS (
  SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0
), postings AS (
  SELECT id, doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT id, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY id, doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term
), asked AS (
  SELECT q, item_id, unnest(t) AS term FROM q
), scores AS (
  SELECT q, item_id, id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
