"""Hard negatives of anchor vectors by angular triangle filtering.

A component x becomes floor(256 x), and a score is the inner product of two such integer vectors.  For
each anchor and each of its first positives, the highest-scoring vectors of other labels are wanted whose
score lies between two shares of the positive's score.

1. For every vector its norm and its angles to a few reference directions are stored.
2. The angle between two vectors lies between the difference and the sum of their angles to a reference.
   The cosines of these, multiplied by both norms and widened for rounding, bound the score; the
   tightest bounds of all references hold.
3. Only vectors whose bounds overlap a window that is still open are scored, in integers.  For positives
   it opens at the lowest score kept for the anchor; for negatives it lies between the shares, and rises
   to the lowest score kept for an anchor and positive once that list is full.

Anchors are taken in blocks of at most about ANCHORS, which every task reads next to its part of all
vectors.  A task keeps a bounded list per anchor (and positive); lists are merged afterwards.

Rows with a null id, label, vector or component, or one that is not finite, take no part.  Vectors of
different lengths are compared as if padded with zeros.  Rows that repeat an id are vectors of their own,
also as anchors.  Equal scores rank by ascending id.  Without anchors, positives or negatives there are no
rows.  Norms of 2^31 and more are an error, as scores might not fit a long integer.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage

REFERENCES = 8
ANCHORS = 2048
POSITIVES = 5
NEGATIVES = 10
#: Shares of a positive's score, in percent, between which negatives lie.
SHARES = (30, 90)
#: Vectors bounded against a block of anchors in one go.
ROWS = 2048

Batches = Iterator[pa.RecordBatch]


def integer_vectors(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v): valid rows with integer components."""
    x = F.col(vector).cast("array<double>")
    valid = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return df.filter(F.col(key).isNotNull() & label.isNotNull() & x.isNotNull() & valid).select(
        F.col(key).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.transform(x, lambda e: F.floor(e * 256)).alias("v"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of a matrix, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _angles(references: np.ndarray) -> Callable[[Batches], Batches]:
    """Add the norm and the angle to each reference; a zero vector is at right angles to all."""
    unit = references / np.linalg.norm(references, axis=1, keepdims=True)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            v = _matrix(batch.column("v"), references.shape[1]).astype(float)
            norm = np.linalg.norm(v, axis=1)
            if (norm >= 2.0**31).any():
                raise ValueError("a vector is too long for integer scores")
            cosine = v @ unit.T / np.where(norm > 0, norm, 1)[:, None]
            angle = np.arccos(np.clip(cosine, -1, 1))
            offsets = np.arange(0, angle.size + 1, max(angle.shape[1], 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norm), pa.ListArray.from_arrays(pa.array(offsets), pa.array(angle.ravel()))],
                [*batch.schema.names, "norm", "angles"],
            )

    return run


class Vectors:
    """Some rows of the stored table, with cosines and sines of their angles."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, width: int):
        def column(name: str) -> pa.Array:
            found = batch.column(name)
            return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found

        self.row, self.id = column("row").to_numpy(), column("id").to_numpy()
        self.label, self.norm = column("label").to_numpy(), column("norm").to_numpy()
        self.v = _matrix(column("v"), width)
        angles = column("angles").flatten().to_numpy().reshape(len(self.row), -1)
        self.cos, self.sin = np.cos(angles), np.sin(angles)

    def __len__(self) -> int:
        return len(self.row)

    def part(self, start: int, stop: int) -> "Vectors":
        out = object.__new__(Vectors)
        for name, values in vars(self).items():
            setattr(out, name, values[start:stop])
        return out


def score_bounds(a: Vectors, b: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all of ``a`` (rows) with all of ``b`` (columns)."""
    low, high = np.full((len(a), len(b)), -1.0), np.full((len(a), len(b)), 1.0)
    for r in range(a.cos.shape[1]):
        both, crossed = np.outer(a.cos[:, r], b.cos[:, r]), np.outer(a.sin[:, r], b.sin[:, r])
        np.maximum(low, both - crossed, out=low)
        np.minimum(high, both + crossed, out=high)
    scale = np.outer(a.norm, b.norm)
    # angles near 0 and pi are known to about 2e-8 only
    slack = 1 + 1e-6 * scale
    return low * scale - slack, high * scale + slack


class _Best:
    """The best ``k`` (score, id, row) seen for each of some lists."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.kept = [tuple(np.empty(0, np.int64) for _ in range(3)) for _ in range(n)]
        #: the lowest kept score of a full list
        self.least = np.full(n, -np.inf)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = (np.concatenate(x) for x in zip(self.kept[i], (score, ids, rows)))
        best = np.lexsort((rows, ids, -score))[: self.k]
        self.kept[i] = score[best], ids[best], rows[best]
        if len(best) == self.k:
            self.least[i] = score[best[-1]]

    def batch(self, **keys: np.ndarray) -> pa.RecordBatch:
        """All kept rows, each with the values that ``keys`` hold for its list."""
        counts = [len(kept[0]) for kept in self.kept]
        columns = {name: np.repeat(values, counts) for name, values in keys.items()}
        for j, name in enumerate(("score", "id", "row")):
            columns[name] = np.concatenate([np.empty(0, np.int64), *[kept[j] for kept in self.kept]])
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in columns.items()})


def _parts(batches: Batches, width: int) -> Iterator[Vectors]:
    for batch in batches:
        all_rows = Vectors(batch, width)
        for start in range(0, len(all_rows), ROWS):
            yield all_rows.part(start, start + ROWS)


def _find_positives(anchors: Vectors, k: int) -> Callable[[Batches], Batches]:
    """(anchor, score, id, row): the best rows of the same label in the part of each task."""

    def run(batches: Batches) -> Batches:
        best = _Best(len(anchors), k)
        for part in _parts(batches, anchors.v.shape[1]):
            _, high = score_bounds(anchors, part)
            open_ = (high >= best.least[:, None]) & (anchors.label[:, None] == part.label)
            open_ &= anchors.row[:, None] != part.row
            for i in np.flatnonzero(open_.any(axis=1)).tolist():
                j = np.flatnonzero(open_[i])
                best.add(i, part.v[j] @ anchors.v[i], part.id[j], part.row[j])
        yield best.batch(anchor=anchors.row)

    return run


def _find_negatives(
    anchors: Vectors, of: np.ndarray, positives: np.ndarray, wanted: np.ndarray, k: int, shares: tuple[int, int]
) -> Callable[[Batches], Batches]:
    """(anchor, positive, score, id, row) for the pairs of an anchor's place ``of``, the row of a
    positive and its score ``wanted``."""
    lowest, highest = (share * wanted for share in shares)

    def run(batches: Batches) -> Batches:
        best = _Best(len(of), k)
        # places of the pairs of each anchor, which lie together
        bounds = np.searchsorted(of, np.arange(len(anchors) + 1))
        for part in _parts(batches, anchors.v.shape[1]):
            low, high = score_bounds(anchors, part)
            other = anchors.label[:, None] != part.label
            for i in range(len(anchors)):
                pairs = range(bounds[i], bounds[i + 1])
                opens = [max(lowest[p] / 100, best.least[p]) for p in pairs if lowest[p] <= highest[p]]
                if not opens:
                    continue
                closes = highest[bounds[i] : bounds[i + 1]].max() / 100
                j = np.flatnonzero(other[i] & (high[i] >= min(opens)) & (low[i] <= closes))
                if not len(j):
                    continue
                score = part.v[j] @ anchors.v[i]
                for p in pairs:
                    inside = (100 * score >= lowest[p]) & (100 * score <= highest[p]) & (score >= best.least[p])
                    if inside.any():
                        best.add(p, score[inside], part.id[j[inside]], part.row[j[inside]])
        yield best.batch(anchor=anchors.row[of], positive=positives)

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best_first = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    shares: tuple[int, int] = SHARES,
) -> DataFrame:
    """Negatives of every anchor and positive in ``vectors(id, label, v)``; see RESULT.

    ``is_anchor`` is a condition on these columns.
    """
    spark = vectors.sparkSession
    known = stage(vectors.withColumn("row", F.monotonically_increasing_id()), "integer-vectors")
    width = known.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    # any vectors do as references; these are bounded in number and the same in every run
    chosen = known.filter(F.exists("v", lambda e: e != 0)).orderBy(F.xxhash64("id", "v"), "row").limit(REFERENCES)
    references = np.zeros((REFERENCES, width))
    for i, row in enumerate(chosen.select("v").collect()):
        references[i, : len(row.v)] = row.v
    references = references[np.abs(references).sum(axis=1) > 0]
    if not len(references):
        return spark.createDataFrame([], RESULT)
    schema = "id long, label long, v array<long>, row long, norm double, angles array<double>"
    stored = stage(known.mapInArrow(_angles(references), schema), "vector-angles")
    anchors = stored.filter(is_anchor)
    n_blocks = -(-anchors.count() // ANCHORS)
    if not n_blocks:
        return spark.createDataFrame([], RESULT)
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks))

    def anchors_of(number: int) -> Vectors:
        return Vectors(anchors.filter(block == number).toArrow(), width)

    found = [
        stored.mapInArrow(
            _find_positives(anchors_of(b), n_positives), "anchor long, score long, id long, row long"
        )
        for b in range(n_blocks)
    ]
    positives = stage(_ranked(reduce(DataFrame.unionAll, found), ["anchor"], n_positives), "positives")
    negatives = []
    for b in range(n_blocks):
        here = anchors_of(b)
        order = np.argsort(here.row)
        mine_ = anchors.filter(block == b).select(F.col("row").alias("of_row"))
        pairs = positives.join(mine_, F.col("anchor") == F.col("of_row")).select("anchor", "row", "score").toArrow()
        of = order[np.searchsorted(here.row[order], pairs.column("anchor").to_numpy())]
        by_anchor = np.argsort(of, kind="stable")
        rows, wanted = (pairs.column(c).to_numpy()[by_anchor] for c in ("row", "score"))
        search = _find_negatives(here, of[by_anchor], rows, wanted, n_negatives, shares)
        negatives.append(
            stored.mapInArrow(search, "anchor long, positive long, score long, id long, row long")
        )
    mined = _ranked(reduce(DataFrame.unionAll, negatives), ["anchor", "positive"], n_negatives)
    of_pair = positives.select(
        "anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    of_anchor = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        mined.join(of_pair, ["anchor", "positive"])
        .join(of_anchor, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT a, anchor_id, b, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) AS k FROM scored WHERE same)
  WHERE k <= 5
), negatives AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) AS rank
  FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same
  WHERE 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""
