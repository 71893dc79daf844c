"""Benchmark decontamination through a positional inverted index of the training text.

The index holds postings ``(doc_id, text_key, term, pos)`` of the training tokens.  A benchmark item
is cut into windows of consecutive words.  Every window is looked up through its rarest terms: each
posting of such a term, shifted back by the term's offset in the window, is a possible start.  A
start on which the lists of all rare terms agree is compared word by word with the text.  Lists that
agree up to a small shift are proximity matches.

Postings are stored for the terms that some window looks up.  All other words of a window are more
frequent, so they would only lengthen the lists; the comparison with the text covers them.

Null text: no words.  Empty tables: no matches, every document is still returned.  Rows that repeat
a ``doc_id``, or a whole document, each get their own result.  Items with null or no words are never
found; a repeated ``item_id`` with several texts counts once.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..workspace import stage
from .text import bounded_side, free_name, keyed, same_row, words

#: Tables of the benchmark up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 500_000

WINDOW = 10
RARE_TERMS = 2
SHIFT = 2


def item_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """Distinct windows ``(window_id, terms, n)`` with the list of items that hold them.

    A window is ``length`` consecutive words; an item of fewer words, but not none, is one window.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")
    ).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    cut = items.select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.slice("w", F.col("at"), F.lit(length)).alias("terms")
    )
    return cut.groupBy("terms").agg(F.collect_set("item_id").alias("items")).select(
        F.xxhash64("terms").alias("window_id"), "terms", F.size("terms").alias("n"), "items"
    )


def _tokens(docs: DataFrame) -> DataFrame:
    """One row per training token."""
    return keyed(docs, F.posexplode(words(F.col("text"))).alias("pos", "word")).withColumn(
        "term", F.xxhash64("word")
    )


def lookup_terms(docs: DataFrame, windows: DataFrame, rare_terms: int) -> DataFrame:
    """The ``rare_terms`` rarest distinct terms of each window by their count in the training text.

    Columns: window_id, n, term, word, offset (of the term's first place in the window), rank.
    """
    places = windows.select("window_id", "n", F.posexplode("terms").alias("offset", "word"))
    places = places.groupBy("window_id", "n", "word").agg(F.min("offset").alias("offset"))
    places = stage(places.withColumn("term", F.xxhash64("word")), "window-places")
    vocabulary = stage(places.select("term", "word").distinct(), "benchmark-terms")
    counts = (
        _tokens(docs)
        .join(bounded_side(vocabulary, BROADCAST_ROWS), ["term", "word"])
        .groupBy("term", "word")
        .agg(F.count("*").alias("count"))
    )
    rarest = W.partitionBy("window_id").orderBy("count", "term", "word")
    return (
        places.join(counts, ["term", "word"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("rank", F.row_number().over(rarest))
        .filter(F.col("rank") <= rare_terms)
        .drop("count")
    )


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings ``(term, doc_id, text_key, pos)`` of the given terms."""
    wanted = stage(terms.select("term", "word").distinct(), "lookup-terms")
    postings = _tokens(docs).join(bounded_side(wanted, BROADCAST_ROWS), ["term", "word"])
    return stage(postings.select("term", "doc_id", "text_key", "pos"), "postings")


def intersect_lists(index: DataFrame, lookups: DataFrame, shift: int = 0) -> DataFrame:
    """Starts at which the offset-adjusted lists of the lookup terms of a window agree.

    The list of the rarest term gives the starts, and each further list keeps those it has a posting
    for, at most ``shift`` words from the place.  ``exact`` tells whether no list needed a shift.
    Columns: window_id, n, doc_id, text_key, start, exact.
    """
    row = ["window_id", "n", "doc_id", "text_key", "start"]
    first = lookups.filter("rank = 1").select("term", "window_id", "n", "offset")
    found = index.join(bounded_side(first, BROADCAST_ROWS), "term").select(
        *row[:-1], (F.col("pos") - F.col("offset")).alias("start"), F.lit(True).alias("exact")
    )
    cell = shift + 1  # places at most ``shift`` apart lie in the same or in neighbouring cells
    for rank in range(2, lookups.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0] + 1):
        wanted = lookups.filter(F.col("rank") == rank).select(
            F.col("window_id"), F.col("term").alias("wanted"), "offset"
        )
        asked = found.join(bounded_side(wanted, BROADCAST_ROWS), "window_id", "left").withColumn(
            "place", F.col("start") + F.col("offset")
        )
        around = F.array(*[F.floor(F.col("place") / cell) + d for d in ((0,) if not shift else (-1, 0, 1))])
        terms = wanted.select(F.col("wanted").alias("term")).distinct()
        postings = index.join(bounded_side(stage(terms, "rank-terms"), BROADCAST_ROWS), "term").select(
            F.col("term").alias("found_term"),
            F.col("doc_id").alias("found_id"),
            F.col("text_key").alias("found_key"),
            F.col("pos").alias("found_pos"),
            F.floor(F.col("pos") / cell).alias("found_cell"),
        )
        few = asked.filter("wanted IS NULL").select(*row, "exact")
        many = asked.filter("wanted IS NOT NULL").withColumn("cell", F.explode(around))
        agree = (
            "wanted = found_term AND cell = found_cell AND doc_id <=> found_id"
            f" AND text_key = found_key AND abs(found_pos - place) <= {int(shift)}"
        )
        met = many.join(postings, F.expr(agree)).select(
            *row, F.expr("exact AND found_pos = place").alias("exact")
        )
        found = few.unionByName(met.groupBy(*row).agg(F.max("exact").alias("exact")))
    return found


def phrase_matches(docs: DataFrame, windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose words equal the window's, with the items of the window.

    Repeated rows give repeated matches.
    """
    wanted = stage(candidates.select("doc_id", "text_key").distinct(), "candidate-rows")
    rows = keyed(docs, words(F.col("text")).alias("w"))
    texts = rows.join(bounded_side(wanted, BROADCAST_ROWS), same_row(rows, wanted), "left_semi")
    here = candidates.join(windows, ["window_id", "n"])
    return (
        here.join(texts, same_row(here, texts))
        .filter(F.slice("w", F.col("start") + 1, F.col("n")) == F.col("terms"))
        .select(here["doc_id"], here["text_key"], "window_id", "start", "n", "items")
    )


def covered_words(matches: DataFrame) -> DataFrame:
    """``n_hit`` per document: words inside any match, each once."""
    spans = matches.groupBy("doc_id", "text_key", "start").agg(F.max("n").alias("n"))
    before = (
        W.partitionBy("doc_id", "text_key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    )
    end = F.col("start") + F.col("n")
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), "start")), F.lit(0))
    return spans.withColumn("fresh", fresh).groupBy("doc_id", "text_key").agg(
        F.sum("fresh").cast("long").alias("n_hit")
    )


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int, rare_terms: int, shift: int
) -> tuple[DataFrame, DataFrame]:
    """Exact matches (doc_id, text_key, window_id, start, n, items), and proximity matches."""
    windows = stage(item_windows(benchmark, window), "benchmark-windows")
    lookups = stage(lookup_terms(docs, windows, rare_terms), "window-lookups")
    index = positional_index(docs, lookups)
    near = stage(intersect_lists(index, lookups, shift), "phrase-candidates")
    exact = phrase_matches(docs, windows, near.filter("exact AND start >= 0").drop("exact"))
    return stage(exact, "phrase-matches"), near.join(windows, ["window_id", "n"])


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    rare_terms: int = RARE_TERMS,
    shift: int = SHIFT,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, near_items.

    ``items`` are the sorted item ids with an exact window; ``near_items`` those of which only a
    proximity match was found: the rare terms of a window, each at most ``shift`` words from its
    place.
    """
    exact, near = matches(docs, benchmark, window, rare_terms, shift)

    def item_lists(found: DataFrame, name: str) -> DataFrame:
        listed = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
        return found.groupBy("doc_id", "text_key").agg(listed.alias(name))

    hits = _joined(
        _joined(item_lists(near, "near_items"), item_lists(exact, "items")), covered_words(exact)
    )
    rows = keyed(docs, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hits, same_row(rows, hits), "left").select(
        rows["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.array_except("near_items", F.coalesce("items", none)), none).alias("near_items"),
    )


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    rare_terms: int = RARE_TERMS,
    shift: int = SHIFT,
) -> DataFrame:
    """The documents without those that hold a window of an item, all columns kept."""
    exact, _ = matches(docs, benchmark, window, rare_terms, shift)
    found = stage(exact.select("doc_id", "text_key").distinct(), "contaminated")
    found_id, found_key = free_name(docs, "found_id"), free_name(docs, "found_key")
    found = bounded_side(found, BROADCAST_ROWS).withColumnsRenamed(
        {"doc_id": found_id, "text_key": found_key}
    )
    here = (docs["doc_id"].cast("long").eqNullSafe(F.col(found_id))) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(found_key)
    )
    return docs.join(found, here, "left_anti")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Add the columns of ``right`` to the rows of ``left``; both have one row per document."""
    more = [c for c in right.columns if c not in ("doc_id", "text_key")]
    return left.join(right, same_row(left, right), "left").select(left["*"], *[right[c] for c in more])


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), starts AS (
  SELECT id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (
    SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS k
    FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
  )
), found AS (
  SELECT DISTINCT id, k, n, item_id FROM starts JOIN windows USING (n, phrase)
), hits AS (
  SELECT id, count(*) AS n_hit FROM (
    SELECT DISTINCT id, unnest(range(k, k + n)) AS pos FROM found
  ) GROUP BY id
), items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM found) GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (id) LEFT JOIN items USING (id)
"""
