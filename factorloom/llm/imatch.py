"""I-Match fingerprints of documents.

Terms whose document frequency lies in a band form the lexicon: neither so frequent that most texts
hold them nor so rare that a small edit brings new ones.  A document's distinct lexicon terms are
sorted and hashed, once for each of several random subsets of the lexicon.  Two documents agree on a
subset if they hold the same of its terms, so the share of subsets on which they agree is their
likeness.  Subsets hold an eighth to a sixty-fourth of the lexicon: small ones still agree when a
good part of the text has changed.

The lexicon has at most (mean number of distinct terms per document) / ``min_share`` terms, whatever
the number of documents, so it is sent to all tasks.  It is counted first: more than ``LEXICON_ROWS``
terms are an error, which asks for a narrower band; no term is left out.

Null text: empty.  Documents without a lexicon term are fingerprinted by all their terms, without any
term by the text itself.  Equal texts have equal fingerprints.  Repeated rows and null ``doc_id``s are
rows like others, ordered by ``doc_id`` (null first) and text; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cross_section import count_below
from ..workspace import stage
from .text import word_list, words

MIN_SHARE = 0.0005
MAX_SHARE = 0.02
#: One subset for each entry: it holds one of so many lexicon terms.
SUBSETS = (8, 16, 32, 64) * 8
LEXICON_ROWS = 2_000_000
#: Documents of one range of ids, about; at most ``MAX_RANGES`` ranges.
RANGE_ROWS = 4000
MAX_RANGES = 10_000

EMPTY = "-"


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """Written table ``term, df`` of the terms whose document frequency lies in the band."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    in_band = (F.col("df") >= max(2.0, min_share * n)) & (F.col("df") <= max(2.0, max_share * n))
    return stage(terms.groupBy("term").agg(F.count("*").alias("df")).filter(in_band), "lexicon")


def _hash(data: bytes, size: int = 4) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def draws(term: bytes) -> tuple[int, ...]:
    """The subsets that hold a term, by a hash of the term."""
    drawn = hashlib.blake2b(term, digest_size=len(SUBSETS)).digest()
    return tuple(i for i, one_in in enumerate(SUBSETS) if drawn[i] % one_in == 0)


def fingerprint(text: str, subsets_of: Callable[[bytes], tuple[int, ...] | None]) -> str:
    """Hash of all lexicon terms, then one for each subset, joined by dots.

    ``subsets_of`` gives the subsets that hold a lexicon term, and None for other terms.
    """
    terms = set(word_list(text))
    held = sorted((t, s) for t in terms if (s := subsets_of(t)) is not None)
    if held:
        whole = _hash(b" ".join(t for t, _ in held), 8)
    else:
        whole = _hash(b" ".join(sorted(terms)) if terms else b"\0" + text.encode("utf-8", "surrogatepass"), 8)
    parts: list[list[bytes]] = [[] for _ in SUBSETS]
    for t, subsets in held:
        for i in subsets:
            parts[i].append(t)
    return ".".join([whole, *(_hash(b" ".join(p)) if p else EMPTY for p in parts)])


def likeness(a: str, b: str) -> float:
    """Share of subsets with the same terms, among those of which either document holds a term."""
    if a == b:
        return 1.0
    pairs = [(x, y) for x, y in zip(a.split(".")[1:], b.split(".")[1:]) if x != EMPTY or y != EMPTY]
    return round(sum(x == y for x, y in pairs) / len(pairs), 6) if pairs else 0.0


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``bucket``, a range of ids, each followed by a copy of the row after it.

    Copies are marked by ``is_next``.  The last bucket is followed by the first row of all, so that
    rows of a bucket in order of (is_next, doc_id, text) each stand before the row that follows them.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    n = rows.count()
    n_ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    ticks = F.array(*[F.lit(i / n_ranges) for i in range(n_ranges)])
    # the bounds are ids of the table, so every range holds a row
    bounds = rows.agg(
        F.coalesce(F.percentile_approx("doc_id", ticks, F.lit(10 * n_ranges)), F.array().cast("array<long>")).alias("b")
    ).select(F.array_sort(F.array_distinct("b")).alias("b")).first()["b"]
    bounds = bounds[1:]
    listed = rows.withColumn("bounds", F.lit(bounds) if bounds else F.array().cast("array<long>"))
    ranged = count_below(listed, "bounds", "doc_id", "bucket", max(1, len(bounds)), inclusive=True)
    ranged = ranged.select("doc_id", "text", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("bucket")).alias("bucket"))
    firsts = ranged.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    after = firsts.select(
        "first.doc_id",
        "first.text",
        F.pmod(F.col("bucket") - 1, F.lit(len(bounds) + 1)).cast("int").alias("bucket"),
        F.lit(True).alias("is_next"),
    )
    return ranged.withColumn("is_next", F.lit(False)).unionByName(after)


SCHEMA = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    if terms.count() > LEXICON_ROWS:
        raise ValueError("narrow the band: the lexicon is too large to send to all tasks")
    known = docs.sparkSession.sparkContext.broadcast(
        frozenset(t.encode() for t in terms.select("term").toPandas()["term"])
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[bytes, tuple[int, ...]] = {}

        def subsets_of(term: bytes) -> tuple[int, ...] | None:
            if term not in known.value:
                return None
            if term not in drawn:
                drawn[term] = draws(term)
            return drawn[term]

        last = None
        for batch in batches:
            out = []
            for bucket, doc_id, text in zip(batch["bucket"], batch["doc_id"], batch["text"]):
                print_ = fingerprint(text, subsets_of)
                if last and last[0] == bucket:
                    changed = edited(last[2], text)
                    changed_print = fingerprint(changed, subsets_of)
                    out.append(
                        (
                            last[1],
                            len(last[2]),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            last[3],
                            changed_print,
                            likeness(last[3], changed_print),
                            likeness(last[3], print_),
                        )
                    )
                last = (bucket, doc_id, text, print_)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = in_order(docs)
    together = rows.repartition("bucket").sortWithinPartitions("bucket", "is_next", "doc_id", "text")
    listed = together.select("bucket", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return listed.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
