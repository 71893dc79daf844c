"""License scan by diagonal voting.

Every pair of neighbouring words of a text is joined by hash with the places of the same pair in
the license templates.  A match at word p of the text and word q of a template is a vote for the
diagonal p - q.  Votes are summed per diagonal, and diagonals at most ``max_shift`` apart in all
(words were put in or left out) are merged; the best of such neighbours is the span of a template.

A span is verified in three ways: it covers enough of its template's word pairs; against every
template that could be mistaken for its own (a version, say) it holds a pair that the other lacks; and
no span of another label that overlaps it covers more of its template, or as much of a longer one.  Phrases must be found whole and
without a shift.

Null text: no words.  Empty table: no rows.  Repeated rows and repeated ``doc_id``: each row gets its
own result.  Equal places are counted once.  Templates are at least two words long; other columns
of the documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import bounded_side, keyed, same_row, words

# Phrases with their labels.  They are found only whole.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Texts of license lines with their labels.  Small changes are tolerated.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "spdx license identifier apache 2 0": "apache-2.0",
    "spdx license identifier mit": "mit",
    "spdx license identifier isc": "isc",
    "spdx license identifier bsd 2 clause": "bsd",
    "spdx license identifier bsd 3 clause": "bsd",
    "spdx license identifier gpl 2 0": "gpl-2.0",
    "spdx license identifier gpl 3 0": "gpl-3.0",
    "spdx license identifier lgpl 2 1": "lgpl",
    "spdx license identifier lgpl 3 0": "lgpl",
    "spdx license identifier agpl 3 0": "agpl",
    "spdx license identifier mpl 2 0": "mpl",
    "apache org licenses license 2 0": "apache-2.0",
    "opensource org licenses mit": "mit",
    "gnu org licenses gpl 2 0": "gpl-2.0",
    "gnu org licenses gpl 3 0": "gpl-3.0",
    "mozilla org mpl 2 0": "mpl",
    "creativecommons org licenses by": "cc-by",
    "creativecommons org licenses by nc": "cc-by-nc",
    "creativecommons org licenses by sa": "cc-by-sa",
    "creativecommons org licenses by nd": "cc-by-nd",
}

#: Diagonals of one span of a template lie at most this far apart, the first from the last.
MAX_SHIFT = 2
#: Share of a template's word pairs that its span must cover.
MIN_COVER = 0.8

#: Words of a cell of the text in which overlapping spans meet.
CELL = 64

#: Template word pairs up to this many are broadcast.
BROADCAST_ROWS = 200_000


def telling_places(templates: dict[str, str], min_cover: float) -> dict[str, list[list[int]]]:
    """Per template, the places of its pairs that each template it could be mistaken for lacks.

    Two templates of different labels can be mistaken if one holds ``min_cover`` of the other's pairs.
    One that another holds whole has no such place; there the longer one wins by its cover.
    """
    pairs = {t: list(zip(t.split(), t.split()[1:])) for t in templates}
    return {
        t: [
            [at for at, pair in enumerate(mine) if pair not in pairs[other]]
            for other, label in templates.items()
            if label != templates[t]
            and min_cover * len(mine) <= sum(pair in pairs[other] for pair in mine) < len(mine)
        ]
        for t, mine in pairs.items()
    }


def template_pairs(
    spark, phrases: dict[str, str], templates: dict[str, str], min_cover: float = MIN_COVER
) -> DataFrame:
    """(template, label, base, at, n_pairs, a, b, telling): all word pairs of all templates."""
    telling = telling_places(templates, min_cover)
    rows = [
        (i, label, base, at, len(w) - 1, w[at], w[at + 1], [] if base else telling[text])
        for i, (text, label, base) in enumerate(
            [(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in templates.items()]
        )
        for w in [text.split()]
        for at in range(len(w) - 1)
    ]
    schema = (
        "template int, label string, base boolean, at int, n_pairs int, a string, b string,"
        " telling array<array<int>>"
    )
    return spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("a", "b"))


def votes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct votes (doc_id, text_key, template, diagonal, at)."""
    w = words(F.col("text"))
    rolling = keyed(docs, w.alias("w")).select(
        "doc_id",
        "text_key",
        F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 2147483647).alias("b"))).alias(
            "pos", "x"
        ),
    )
    rolling = rolling.select("doc_id", "text_key", "pos", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    rolling = rolling.withColumn("pair", F.xxhash64("a", "b"))
    return (
        rolling.join(bounded_side(pairs, BROADCAST_ROWS), ["pair", "a", "b"])
        .select(
            "doc_id", "text_key", "template", "label", "base", "n_pairs", "telling", "at",
            (F.col("pos") - F.col("at")).alias("diagonal"),
        )
        .distinct()
    )


def spans(found: DataFrame, max_shift: int = MAX_SHIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans (doc_id, text_key, label, base, start, end, cover); end is exclusive."""
    row = ["doc_id", "text_key", "template", "label", "base", "n_pairs", "telling"]
    diagonals = found.groupBy(*row, "diagonal").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    along = W.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    onward = along.rangeBetween(0, max_shift)
    first = F.col("diagonal") + F.get("ats", F.lit(0))
    last = F.col("diagonal") + F.get("ats", F.size("ats") - 1) + 2
    covered = F.array_distinct(F.flatten(F.collect_list("ats").over(onward)))
    spread = diagonals.select(
        *row,
        "diagonal",
        F.when(F.col("base"), F.col("ats")).otherwise(covered).alias("ats"),
        F.when(F.col("base"), first).otherwise(F.min(first).over(onward)).cast("long").alias("start"),
        F.when(F.col("base"), last).otherwise(F.max(last).over(onward)).cast("long").alias("end"),
    ).withColumn("n", F.size("ats"))
    # of neighbours that share diagonals, the one that covers most, the first of equal ones
    before = F.max("n").over(along.rangeBetween(-max_shift, -1))
    after = F.max("n").over(along.rangeBetween(1, max_shift))
    best = (F.coalesce(before, F.lit(0)) < F.col("n")) & (F.coalesce(after, F.lit(0)) <= F.col("n"))
    told = F.forall("telling", lambda places: F.arrays_overlap(places, F.col("ats")))
    chosen = spread.withColumn("cover", F.col("n") / F.col("n_pairs")).withColumn("best", best)
    whole = F.when(F.col("base"), F.col("n") == F.col("n_pairs")).otherwise(
        F.col("best") & (F.col("cover") >= min_cover) & told
    )
    names = ["doc_id", "text_key", "label", "base", "start", "end", "cover"]
    return without_lesser(chosen.filter(whole).select(*names, "n_pairs")).select(*names)


def without_lesser(verified: DataFrame) -> DataFrame:
    """Spans of templates that no overlapping span of another label exceeds in cover, then in length;
    all spans of phrases.

    Spans meet in cells of the text that hold at least the starts and ends of all spans in them, so
    the pairs of a cell are as few as the templates that can stand in it.
    """
    cell = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)))
    cells = verified.filter("NOT base").withColumn("cell", cell)
    other = cells.select(
        *[F.col(c).alias(f"other_{c}") for c in cells.columns if c != "base"]
    )
    exceeds = (
        "doc_id <=> other_doc_id AND text_key = other_text_key AND cell = other_cell"
        " AND label <> other_label AND start < other_end AND other_start < end"
        " AND (cover < other_cover OR cover = other_cover AND n_pairs < other_n_pairs)"
    )
    lesser = cells.join(other, F.expr(exceeds), "left_semi").select(
        *[F.col(c).alias(f"lesser_{c}") for c in ("doc_id", "text_key", "label", "start", "end")]
    )
    same = (
        "doc_id <=> lesser_doc_id AND text_key = lesser_text_key AND label = lesser_label"
        " AND start = lesser_start AND end = lesser_end AND NOT base"
    )
    return verified.join(lesser, F.expr(same), "left_anti")


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    max_shift: int = MAX_SHIFT,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """One row per document: doc_id, n_words, and the array ``spans`` of (start, end, label, base,
    cover), in order of the text."""
    pairs = template_pairs(docs.sparkSession, phrases, templates, min_cover)
    found = spans(votes(docs, pairs), max_shift, min_cover)
    listed = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "base", "cover"))).alias("spans")
    )
    rows = keyed(docs, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(listed, same_row(rows, listed), "left").select(
        rows["doc_id"],
        "n_words",
        F.coalesce(
            "spans",
            F.array().cast("array<struct<start:long,end:long,label:string,base:boolean,cover:double>>"),
        ).alias("spans"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from what ``scan`` returns."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def labels(found):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))))

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)), 6).alias("score"),
    )


def _values(phrases: dict[str, str], templates: dict[str, str]) -> str:
    listed = [(t, x, "true") for t, x in phrases.items()] + [(t, x, "false") for t, x in templates.items()]
    return ", ".join(f"({i}, '{t}', '{x}', {base})" for i, (t, x, base) in enumerate(listed))


SQL = f"""
WITH t AS (
  SELECT template, label, base, string_split(phrase, ' ') AS w
  FROM (VALUES {_values(PHRASES, TEMPLATES)}) v(template, phrase, label, base)
), pairs AS (
  SELECT template, label, base, len(w) - 1 AS n_pairs, k, w[k + 1] AS a, w[k + 2] AS b
  FROM (SELECT *, unnest(range(len(w) - 1)) AS k FROM t)
), d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents
), rolling AS (
  SELECT id, pos, w[pos + 1] AS a, w[pos + 2] AS b
  FROM (SELECT id, w, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1)
), telling AS (
  SELECT template, list(places) AS telling FROM (
    SELECT p.template, o.template AS other,
      list(k) FILTER (NOT EXISTS (FROM pairs q WHERE q.template = o.template AND q.a = p.a AND q.b = p.b))
        AS places,
      count(*) FILTER (EXISTS (FROM pairs q WHERE q.template = o.template AND q.a = p.a AND q.b = p.b))
        AS shared, any_value(n_pairs) AS n_pairs
    FROM pairs p JOIN t o ON o.label <> p.label AND NOT o.base AND NOT p.base GROUP BY 1, 2)
  WHERE shared >= {MIN_COVER} * n_pairs AND shared < n_pairs GROUP BY 1
), diagonals AS (
  SELECT id, template, label, base, n_pairs, pos - k AS diagonal, list(DISTINCT k) AS ats
  FROM rolling JOIN pairs USING (a, b) GROUP BY ALL
), spread AS (
  SELECT id, template, label, base, n_pairs, diagonal,
    CASE WHEN base THEN ats ELSE list_distinct(flatten(list(ats) OVER g)) END AS ats,
    CASE WHEN base THEN diagonal + list_min(ats) ELSE min(diagonal + list_min(ats)) OVER g END AS start,
    CASE WHEN base THEN diagonal + list_max(ats) ELSE max(diagonal + list_max(ats)) OVER g END + 2 AS stop
  FROM diagonals WINDOW g AS (PARTITION BY id, template ORDER BY diagonal
    RANGE BETWEEN CURRENT ROW AND {MAX_SHIFT} FOLLOWING)
), chosen AS (
  SELECT *, len(ats) AS n, len(ats)::DOUBLE / n_pairs AS cover,
    coalesce(max(len(ats)) OVER (PARTITION BY id, template ORDER BY diagonal
      RANGE BETWEEN {MAX_SHIFT} PRECEDING AND 1 PRECEDING), 0) < len(ats)
    AND coalesce(max(len(ats)) OVER (PARTITION BY id, template ORDER BY diagonal
      RANGE BETWEEN 1 FOLLOWING AND {MAX_SHIFT} FOLLOWING), 0) <= len(ats) AS best
  FROM spread
), verified AS (
  SELECT id, label, base, start, stop, cover, n_pairs FROM chosen LEFT JOIN telling USING (template)
  WHERE CASE WHEN base THEN n = n_pairs ELSE best AND cover >= {MIN_COVER}
    AND len(list_filter(coalesce(telling, []), lambda places: NOT list_has_any(places, ats))) = 0 END
), kept AS (
  SELECT * FROM verified v WHERE base OR NOT EXISTS (
    FROM verified o WHERE NOT o.base AND o.id = v.id AND o.label <> v.label
      AND v.start < o.stop AND o.start < v.stop
      AND (v.cover < o.cover OR v.cover = o.cover AND v.n_pairs < o.n_pairs))
), per_doc AS (
  SELECT id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM kept GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(coalesce(score, 0.0::DOUBLE), 6) AS score
FROM d LEFT JOIN per_doc USING (id)
"""
