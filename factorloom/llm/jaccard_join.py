"""Similarity join of documents on word n-grams by vertical partitioning.

Documents link when the Jaccard similarity of their sets of word n-grams reaches a percentage.  The
result names for each document the smallest id that links lead to.

1. Every document becomes a sorted set of n-gram hashes.  A linked document must share a known part of
   the first n-grams of its set with others, in any fixed order.  Counting how many documents hold each
   of these n-grams leaves only documents that can link at all.  Equal sets become one class.
2. The n-grams of the classes that are left get a global order, rarest first.  Linked classes share an
   n-gram among the first ones of both, so these are the candidates.
3. The global order is cut into fragments of about equal size.  Each candidate pair's overlap is counted
   in each fragment separately, and the counts are summed per pair.
4. A long list of classes with one n-gram is not expanded into pairs.  Each class is compared with one
   pivot of the list, classes linked through pivots are merged, and lists within one group are done.
   Classes of different groups that still share a first n-gram are then compared with each other, so
   no link between groups is lost.

Words are split at ASCII white space, A-Z in lower case.  A text of fewer than ``n`` words is one n-gram.
Null or blank text: an empty set, linked with nothing.  Repeated rows and ``doc_id``s are documents of
their own; a null ``doc_id`` takes part, but names a group only if all its ids are null.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cross_section import count_below
from ..workspace import stage
from .text import bounded_side, free_name, keyed
from .workers import lean, text_batches

WORDS = 5
PERCENT = 75
FRAGMENTS = 8
#: Rounds of comparison with pivots before groups are compared with each other.
PIVOT_ROUNDS = 3
#: Class keys up to this many are broadcast, more are shuffled.
BROADCAST_ROWS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    count = len(words) - width + 1
    h = np.full(count, width, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * _MIX + each[i : i + count]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))).view(np.int64))


def least_overlap(n, percent: int):
    """Members that a set of ``n`` shares with any linked set, at least."""
    return -(-percent * n // 100)


def _describe(n_words: int, percent: int):
    """Set sizes, keys and first n-grams of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, keys, firsts = [], [], []
            for text in batch["text"]:
                members = shingle_set(text, n_words)
                n = len(members)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(members.tobytes()))
                firsts.append(members[: n - least_overlap(n, percent) + -(-n // 16)])
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n": sizes, "key": keys, "first": firsts}
            )

    return run


def described(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Written table of doc_id, text_key, n (set size), key (of the set), first (n-grams)."""
    rows = keyed(docs, F.col("text")).withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, text_key long, n long, key binary, first array<long>"
    sets = rows.mapInPandas(lean(_describe(n_words, percent)), schema)
    with text_batches(docs.sparkSession):
        return stage(sets.withColumn("doc_id", F.col("doc_id").cast("long")), "shingle-sets")


def linkable_classes(sets: DataFrame, percent: int) -> DataFrame:
    """Written table of the classes of equal sets that may link, or have copies.

    Columns: class, n, key, min_doc (smallest doc_id), and doc_id and text_key of one member.  A
    document with ``first`` of n - least + n/16 members holds at least n/16 of any linked set's
    members there; a linked set is at least ``percent`` as large, so both see at least that part of
    n/16 held by another document.
    """
    held = sets.select("doc_id", "text_key", "n", "key", F.explode("first").alias("h"))
    shared = held.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h")
    least = F.ceil(F.ceil(F.col("n") * percent / 100) / 16)
    kept = (
        held.select("key", "n", "h")
        .join(shared, "h")
        .groupBy("key", "n")
        .agg(F.count("*").alias("found"))
    )
    # a class of k copies finds each n-gram k times
    members = sets.filter("n > 0").groupBy("key", "n").agg(
        F.count("*").alias("copies"),
        F.min("doc_id").alias("min_doc"),
        F.min(F.struct("doc_id", "text_key")).alias("member"),
    )
    return stage(
        members.join(kept, ["key", "n"])
        .filter(F.col("found") >= least * F.col("copies"))
        .select(
            F.monotonically_increasing_id().alias("class"),
            "n",
            "key",
            "min_doc",
            "member.doc_id",
            "member.text_key",
        ),
        "linkable-classes",
    )


def class_members(docs: DataFrame, classes: DataFrame, n_words: int) -> DataFrame:
    """(class, n, h): the n-grams of each class, read again from the text of one member."""
    rows = keyed(docs, F.col("text"))
    wanted = bounded_side(
        classes.select("class", "n", F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")),
        BROADCAST_ROWS,
    )
    texts = rows.join(wanted, F.expr("doc_id <=> of_id AND text_key = of_key")).select("class", "n", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, n_words) for text in batch["text"]]
            yield pd.DataFrame({"class": batch["class"], "n": batch["n"], "h": sets})

    sets = texts.mapInPandas(lean(run), "class long, n long, h array<long>")
    return sets.select("class", "n", F.explode("h").alias("h"))


def ordered_sets(members: DataFrame, percent: int) -> DataFrame:
    """Written table (class, n, alone, members): the n-grams that other classes hold too, in the
    global order (rarest first, then by hash), after ``alone`` that no other class holds.

    Classes with too few shared n-grams to link are left out.
    """
    shared = members.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    listed = (
        members.join(shared, "h")
        .groupBy("class", "n")
        .agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("members"))
    )
    alone = F.col("n") - F.size("members")
    least = F.ceil(F.col("n") * percent / 100)
    # members come from texts
    with text_batches(members.sparkSession):
        return stage(
            listed.withColumn("alone", alone).filter(F.size("members") >= least), "ordered-sets"
        )


def first_members(sets: DataFrame, percent: int) -> DataFrame:
    """Written table (class, n, alone, h, place): the n-grams of which linked classes share at least
    one, with their place in the order of the class."""
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    cut = sets.select("class", "n", "alone", F.slice("members", F.lit(1), F.greatest(length, F.lit(0)).cast("int")).alias("m"))
    listed = cut.select("class", "n", "alone", F.posexplode("m").alias("pos", "x"))
    return stage(
        listed.select(
            "class", "n", "alone", F.col("x.h").alias("h"), (F.col("pos") + F.col("alone")).alias("place")
        ),
        "first-members",
    )


def fragments_of(sets: DataFrame, n_fragments: int) -> DataFrame:
    """Written table (class, fragment, part): each set cut at the same places of the global order."""
    members = sets.select("class", F.explode("members").alias("x"))
    # pivots on the frequency, then the hash: the leading component decides nearly everywhere
    ticks = F.array(*[F.lit(i / n_fragments) for i in range(1, n_fragments)])
    position = F.col("df") + (F.col("h") / F.lit(2.0**64) + 0.5)
    spots = members.select("class", F.col("x.df").alias("df"), F.col("x.h").alias("h")).withColumn("spot", position)
    pivots = spots.agg(
        F.coalesce(F.percentile_approx("spot", ticks, F.lit(1000)), F.array().cast("array<double>")).alias("p")
    ).select(F.array_sort(F.array_distinct("p")).alias("p")).first()["p"]
    cut = spots.withColumn("pivots", F.array(*[F.lit(p) for p in pivots]).cast("array<double>"))
    cut = count_below(cut, "pivots", "spot", "fragment", max(1, len(pivots)), inclusive=True)
    return stage(
        cut.groupBy("class", "fragment").agg(F.collect_list("h").alias("part")), "set-fragments"
    )


def may_link(percent: int) -> Column:
    """Whether classes a and b can link if the n-gram at which they meet is their first in common.

    The smaller set must be large enough for the larger one, and the n-grams from this place on must
    make up the overlap.  Every linked pair meets at its first n-gram in common.
    """
    return F.expr(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND"
        f" {100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"
    )


def linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, n_a, b, n_b) that link: partial overlaps per fragment, summed per pair."""
    left = fragments.select(F.col("class").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = fragments.select(F.col("class").alias("b"), "fragment", F.col("part").alias("part_b"))
    overlaps = (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "n_a", "b", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("partial"))
        .groupBy("a", "n_a", "b", "n_b")
        .agg(F.sum("partial").alias("overlap"))
    )
    return overlaps.filter(F.expr(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")).select("a", "b")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(a, b): for each node of the edges but the smallest of its component, that smallest one.

    Large stars and small stars in turn; every step only keeps minima and joins them back.
    """
    edges = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.inline(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))))
            .filter("a <> b")
            .distinct()
        )
        edges = stage(small, "edges")
    return edges


def _grouped(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (class, label) after the links between classes have joined their groups."""
    ends = links.join(labels.select(F.col("class").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("class").alias("b"), F.col("label").alias("lb")), "b"
    )
    roots = connected(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    joined = labels.join(roots.select(F.col("a").alias("label"), F.col("b").alias("root")), "label", "left")
    return stage(joined.select("class", F.coalesce("root", "label").alias("label")), "class-groups")


def link_groups(firsts: DataFrame, fragments: DataFrame, percent: int, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(class, label): classes with the same label are connected by links."""
    labels = stage(firsts.select("class").distinct().withColumn("label", F.col("class")), "class-groups")

    def open_lists() -> DataFrame:
        """Members of the lists of one n-gram that belong to more than one group."""
        marked = firsts.join(labels, "class")
        mixed = (
            marked.groupBy("h")
            .agg(F.min("label").alias("low"), F.max("label").alias("high"))
            .filter("low < high")
            .select("h")
        )
        return stage(marked.join(mixed, "h"), "open-lists")

    def candidates(here: DataFrame, other: DataFrame, unlike: str) -> DataFrame:
        """Pairs of different groups that meet at an n-gram and may link."""
        left = here.withColumnsRenamed(
            {"class": "a", "n": "n_a", "place": "place_a", "label": "label_a"}
        )
        right = other.withColumnsRenamed(
            {"class": "b", "n": "n_b", "place": "place_b", "label": "label_b"}
        )
        met = left.join(right, "h").filter(unlike).filter(may_link(percent))
        return met.select("a", "n_a", "b", "n_b").distinct()

    columns = ["class", "n", "alone", "place", "label"]
    for number in range(rounds):
        here = open_lists()
        # first the member with the smallest part of its own, the one most like all others; then any
        chosen = F.xxhash64(F.lit(number), "class")
        if number == 0:
            chosen = F.struct(F.col("alone") / F.col("n"), chosen)
        pivots = here.groupBy("h").agg(F.min_by(F.struct(*columns), chosen).alias("pivot"))
        pairs = candidates(here, pivots.select("h", "pivot.*"), "label_a <> label_b")
        labels = _grouped(labels, stage(linked(pairs, fragments, percent), "links"))
    # what is left: classes of different groups that meet at an n-gram
    here = open_lists()
    pairs = candidates(here, here, "a < b AND label_a <> label_b")
    return _grouped(labels, stage(linked(pairs, fragments, percent), "links"))


def _components(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id."""
    sets = described(docs, n_words, percent)
    classes = linkable_classes(sets, percent)
    ordered = ordered_sets(class_members(docs, classes, n_words), percent)
    labels = link_groups(first_members(ordered, percent), fragments_of(ordered, FRAGMENTS), percent)
    grouped = classes.join(labels, "class", "left").select(
        "key", "n", "min_doc", F.coalesce("label", "class").alias("label")
    )
    smallest = grouped.groupBy("label").agg(F.min("min_doc").alias("component_id"))
    named = stage(grouped.join(smallest, "label").select("key", "n", "component_id"), "components")
    return sets.join(named, ["key", "n"], "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def components(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _components(docs, n_words, percent).drop("text_key")


def keep_first(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents whose id is the smallest of their component, all columns kept.

    Rows with the same ``doc_id`` stay or go each by its own text.  Repeated rows of the id that names
    a component all stay, and so do rows without a ``doc_id``.
    """
    found = _components(docs, n_words, percent).filter("doc_id <> component_id")
    name, key = free_name(docs, "dropped_id"), free_name(docs, "dropped_key")
    dropped = stage(
        found.select(F.col("doc_id").alias(name), F.col("text_key").alias(key)).distinct(), "dropped"
    )
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    gone = (docs["doc_id"].cast("long") == F.col(name)) & (text_key == F.col(key))
    return docs.join(bounded_side(dropped, BROADCAST_ROWS), gone, "left_anti")


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT id, array_to_string(w[k:k + 4], ' ') AS shingle
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), pairs AS (
  SELECT x.id AS a, y.id AS b, count(*) AS n_both
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes na ON na.id = a JOIN sizes nb ON nb.id = b
  WHERE 100 * n_both >= 75 * (na.n + nb.n - n_both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id, id AS other FROM d
  UNION
  SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a
), smallest AS (
  SELECT reach.id, min(d.doc_id) AS component_id
  FROM reach JOIN d ON d.id = reach.other GROUP BY reach.id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM d JOIN smallest USING (id) LEFT JOIN sizes USING (id)
"""
