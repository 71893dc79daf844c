"""Language identification with a bit-sliced Bloom filter over character n-grams.

The filter is a table of bit masks, one bit per language.  A language's frequent n-grams set its bit
in the rows that k hash functions choose; the rows of an n-gram, combined with AND, give all
languages that (seem to) contain it.  A text is hashed into its n-grams, every n-gram looks up its
mask, and the masks' bits are counted per language.  Each count is corrected for the share of lookups
that the language's slice answers by chance, and the largest corrected share decides.

N-grams are runs of letters within words in lower case, with the word's ends marked.

Learning uses at most ``max_rows`` documents of each language, chosen by a hash of ``doc_id``, and
keeps n-grams with at least ``min_share`` of a language's n-grams, so at most ``1 / min_share`` each:
the filter's size is fixed.  Scoring covers every document and its whole text.

Null text or no letter: ``und`` with score 0.  Texts whose n-grams are all unknown: the first language
in alphabetical order, with score 0, as for ties.  Nothing to learn from: ``und`` for all.  Rows with
null or repeated ``doc_id`` are scored like all others.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import stage

ORDERS = (2, 3, 4)
#: Documents a language is learnt from, at most.
MAX_ROWS = 4000
MIN_SHARE = 2e-5
FILTER_ROWS = 1 << 21
HASHES = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread as in the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of a text, in no particular order; empty without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.concatenate(([0], _letters()[points], [0])).astype(np.uint64)
    # one mark between words, however many other characters lie there
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    letters = letters[keep]
    if len(letters) < 3:
        return np.empty(0, np.uint64)
    found = []
    for n in ORDERS:
        count = len(letters) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        for i in range(n):
            h = h * _MIX + letters[i : i + count]
        inner = np.ones(count, bool)
        for i in range(1, n - 1):
            inner &= letters[i : i + count] != 0
        found.append(_mixed(h[inner]))
    return np.concatenate(found)


def filter_rows(grams: np.ndarray, n_rows: int, hashes: int) -> Iterator[np.ndarray]:
    """The rows of each n-gram, one array per hash function."""
    low, high = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32)
    for k in range(hashes):
        yield ((low + np.uint64(k) * (high | np.uint64(1))) % np.uint64(n_rows)).astype(np.int64)


class LanguageFilter:
    """Bit masks of languages by row, and each language's share of answers by chance."""

    def __init__(self, languages: list[str], n_rows: int = FILTER_ROWS, hashes: int = HASHES) -> None:
        self.languages, self.n_rows, self.hashes = languages, n_rows, hashes
        # languages beyond 64 continue in further slices
        self.masks = np.zeros((max(1, -(-len(languages) // 64)), n_rows), np.uint64)

    def add(self, language: str, grams: np.ndarray) -> None:
        part, bit = divmod(self.languages.index(language), 64)
        for rows in filter_rows(grams, self.n_rows, self.hashes):
            np.bitwise_or.at(self.masks[part], rows, np.uint64(1) << np.uint64(bit))

    def finish(self) -> LanguageFilter:
        filled = [
            ((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
            for i in range(len(self.languages))
        ]
        self.by_chance = np.array(filled) ** self.hashes
        return self

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams it seems to contain."""
        rows = list(filter_rows(grams, self.n_rows, self.hashes))
        out = []
        for part, masks in enumerate(self.masks):
            found = masks[rows[0]]
            for more in rows[1:]:
                found = found & masks[more]
            for bit in range(min(64, len(self.languages) - 64 * part)):
                out.append(int(np.count_nonzero(found & (np.uint64(1) << np.uint64(bit)))))
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = gram_hashes(text)
        if not len(grams) or not self.languages:
            return "und", 0.0
        share = self.counts(grams) / len(grams)
        share = np.clip((share - self.by_chance) / (1 - self.by_chance), 0, None)
        best = int(share.argmax())
        total = float(share.sum())
        return self.languages[best], round(float(share[best]) / total, 6) if total > 0 else 0.0


#: N-grams that a task counts at a time.
CHUNK_GRAMS = 1 << 20


def _chunks(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The n-grams of the texts, a bounded number (or those of one text) at a time."""
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        held.append(gram_hashes(text))
        size += len(held[-1])
        if size >= CHUNK_GRAMS:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-gram counts of each language and chunk."""
    for batch in batches:
        for language, texts in batch.groupby("lang")["text"]:
            for grams in _chunks(texts):
                found, n = np.unique(grams, return_counts=True)
                yield pd.DataFrame({"lang": language, "gram": found.astype(np.int64), "n": n})


def learn(labelled: DataFrame, max_rows: int = MAX_ROWS, min_share: float = MIN_SHARE) -> LanguageFilter:
    """A filter from documents with a non-null ``lang``."""
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageFilter([]).finish()
    # a hash picks about max_rows documents of each language, the same ones on every run
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_rows / n))])
    draw = F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(draw < share[F.col("lang")]).select("lang", "text")
    counts = (
        sample.mapInPandas(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = stage(counts, "language-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(
        *[F.lit(x) for k, n in totals.items() for x in (k, max(1.0, min_share * n))]
    )
    # at most 1 / min_share n-grams of each language come to the driver
    kept = counts.filter(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toPandas()
    model = LanguageFilter(sorted(totals))
    for language, grams in kept.groupby("lang")["gram"]:
        model.add(language, grams.to_numpy().astype(np.uint64))
    return model.finish()


def identify(docs: DataFrame, model: LanguageFilter) -> Column:
    """Column of (lang_pred, score) for the text of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [shared.value.predict(t) for t in texts], columns=["lang_pred", "score"]
            )

    return predict(F.col("text"))
