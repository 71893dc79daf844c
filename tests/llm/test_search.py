"""Ranked search, hard negatives and removal of repeated strings against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import hard_negatives, ranked_search, suffix_dedup

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def ranked_by_force(docs, items, k=50):
    found = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    found = [(doc_id, counts) for doc_id, counts in found if counts]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts in found:
            m = 50 + 50 * sum(counts.values()) * n_docs // n_terms
            score = 0
            for t in set(terms_of(text)) & set(counts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        out += [(item_id, r, doc_id, -s) for r, (s, _, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, k=50):
    found = ranked_search.search(ranked_search.build_index(docs), items, "item_id", k).collect()
    return sorted(map(tuple, found), key=str)


@pytest.fixture(scope="module")
def word_docs():
    rng = random.Random(3)
    # a few very frequent words, many rare ones, and equal documents
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(700)]
    return docs + [(1000 + i, docs[i % 7][1]) for i in range(90)]


def test_ranked_search(spark, documents, word_docs, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERIES", 5)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices([f"w{i}" for i in range(450)], k=rng.randint(1, 12)))) for i in range(12)]
    items += [(50, "w0 w1 w2"), (50, "w0"), (51, ""), (52, None), (None, "w399 w3"), (53, "unknown")]
    df = spark.createDataFrame(items, "item_id long, text string")
    expected = ranked_by_force(word_docs, items, 10)
    assert searched(documents(word_docs).repartition(3), df, 10) == expected


def test_small_blocks_and_shards(word_docs):
    """The ranking inside one shard, block by block."""
    shard = ranked_search._Shard()
    for doc_id, text in word_docs:
        shard.add(doc_id, [t.encode() for t in terms_of(text)], len(text))
    n_docs, n_terms = len(word_docs), sum(shard.sizes)
    norms = shard.norms(n_docs, n_terms)
    rows = {t: {c: v[i].as_py() for c, v in shard.lists(norms).items()} for i, t in enumerate(shard.vocabulary)}
    decoded = 0

    class Row:
        def __init__(self, found):
            self.__dict__.update(found, weight=0, bound=found["top"])
            self.weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found["df"] + 1)))

    for text in ("w0 w1 w390 w395", "w2 w3 w4 w5 w350", "w399"):
        lists = [ranked_search._List(Row(rows[t.encode()]), norms) for t in text.split() if t.encode() in rows]
        places, scores = ranked_search.search_shard(lists, np.array(shard.ids), 5)
        got = [(shard.ids[p], s) for p, s in zip(places, scores)]
        assert got == [(d, s) for _, _, d, s in sorted(ranked_by_force(word_docs, [(0, text)], 5), key=lambda x: x[1])]
        decoded += sum(len(x.decoded) < len(x.firsts) for x in lists)
    assert decoded, "no list was left in part"


def test_ranked_search_edges(spark, documents, messy, empty):
    items = spark.createDataFrame([(1, "quick fox"), (2, "Ten eleven, WÖRDS")], "item_id long, text string")
    rows = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    expected = ranked_by_force(rows, [tuple(r) for r in items.collect()])
    assert searched(messy, items) == expected
    assert searched(empty, items) == []
    assert searched(messy, items.limit(0)) == []
    huge = documents([(1, "same " * 70_000), (2, "same other")])
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert searched(huge, items) == ranked_by_force([(1, "same " * 70_000), (2, "same other")], [(1, "same")])


VECTORS = "vec_id long, embedding array<float>, label int"


def mined_by_force(rows):
    known = []
    for r, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        known.append((r, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for r, vec_id, label, v in known:
        if vec_id % 100:
            continue
        score = {o[0]: sum(x * y for x, y in zip(v, o[3])) for o in known}
        order = sorted((o for o in known if o[0] != r), key=lambda o: (-score[o[0]], o[1], o[0]))
        for p in [o for o in order if o[2] == label][:5]:
            s = score[p[0]]
            fits = [o for o in order if o[2] != label and 30 * s <= 100 * score[o[0]] <= 90 * s][:10]
            out += [(vec_id, p[1], k, o[1], s, score[o[0]]) for k, o in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, schema=VECTORS):
    df = spark.createDataFrame(rows, schema)
    vectors = hard_negatives.integer_vectors(df, "vec_id", "embedding", F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(vectors, F.col("id") % 100 == 0).collect()))


def random_vectors(n, seed, size=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    rows = [(i, (centres[i % 4] + rng.normal(size=size) * 0.8).tolist(), i % 3) for i in range(n)]
    # copies of one vector, of other labels too
    return rows + [(n + i, rows[5][1], i % 3) for i in range(40)]


@pytest.mark.parametrize("anchors", [2048, 2])
def test_hard_negatives(spark, monkeypatch, anchors):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    data = random_vectors(500, seed=anchors)
    expected = mined_by_force(data)
    assert len(expected) > 100 and mined(spark, data) == expected


def test_hard_negatives_edges(spark):
    rows = random_vectors(210, seed=9, size=3)
    rows += [
        (300, None, 1), (301, [0.1, None, 0.2], 1), (302, [float("nan"), 1.0, 0.0], 1),
        (303, [float("inf"), 1.0, 0.0], 0), (304, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], 1),
        (400, [0.0, 0.0, 0.0], 1), (405, [0.0, 0.0, 0.0], 2), (500, [], 1), (501, [0.7], 2),
        (200, rows[200][1], 2), (100, rows[100][1], rows[100][2]), (600, [9e3, -9e3, 1e3], 0),
    ]
    assert mined(spark, rows) == mined_by_force(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(100, [0.0], 1), (2, [0.0], 2)]) == []
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(100, [1e12], 1), (2, [1.0], 2)])
    clash = [(*r, "x", "y", "z") for r in rows]
    assert mined(spark, clash, VECTORS + ", row string, norm string, v string") == mined_by_force(rows)


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, size=(300, 8))
    run = hard_negatives._angles(v[:8].astype(float))
    import pyarrow as pa

    table = pa.RecordBatch.from_pydict(
        {"id": list(range(300)), "label": [0] * 300, "v": pa.array(v.tolist(), pa.list_(pa.int64())), "row": list(range(300))}
    )
    known = hard_negatives.Vectors(next(run([table])), 8)
    low, high = hard_negatives.score_bounds(known, known)
    score = v @ v.T
    assert (low <= score).all() and (score <= high).all()
    assert ((high - low) < np.outer(known.norm, known.norm) * 1.5).mean() > 0.3


def cut_by_force(rows, length):
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    first = {}
    for doc_id, x in data:
        for p in range(len(x) - length + 1 if doc_id is not None else 0):
            s = x[p : p + length]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, x in data:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1 if doc_id is not None else 0):
            if first[x[p : p + length]] < doc_id:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(x) else 0
        out.append((doc_id, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut(df, **options):
    return sorted(map(tuple, suffix_dedup.dedup(df, **options).collect()), key=str)


@pytest.mark.parametrize("length, seed, letters", [(50, 24, 4), (20, 7, 2), (12, 12, 3), (30, 11, 1)])
def test_repeated_strings(documents, length, seed, letters):
    rng = random.Random(length)
    alphabet = "abé\0"[:letters]

    def noise(n):
        return "".join(rng.choices(alphabet + " ", k=n))

    passages = [noise(rng.randint(length - 3, 4 * length)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else noise(rng.randint(0, 90)) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if rows and rng.random() < 0.3:  # a near copy, cut at random or with a letter changed
            text = rng.choice(rows)[1] or ""
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "x", "é"]) + text[at + rng.randint(0, 1) :]
        rows.append((rng.choice([i, i, i, i // 2]), text))
    assert cut(documents(rows).repartition(3), length=length, seed=seed) == cut_by_force(rows, length)


def test_repeated_strings_edges(documents, messy, empty):
    assert cut(messy) == cut_by_force([tuple(r) for r in messy.select("doc_id", "text").collect()], 50)
    assert cut(empty) == []
    line = "a very common line of more than fifty bytes that is everywhere\n"
    rows = [(i, f"{i} begins\n{line}{'é' * (i % 40)}{line * (i % 3)}ends {i}") for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(50)] + [(None, rows[3][1]), (None, line)]
    rows += [(600, "z" * 3000), (601, "z" * 49), (602, "z" * 50), (603, "z" * 2000 + "y")]
    assert cut(documents(rows)) == cut_by_force(rows, 50)
    with pytest.raises(ValueError):
        suffix_dedup.dedup(empty, 100, 20)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_what_stands_alone_goes_across_batches(size):
    h = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6]
    rows = pa.RecordBatch.from_pydict({"h": h, "c": list(range(10)), "doc": [7] * 10})
    batches = [rows.slice(0, 0), *(rows.slice(i, size) for i in range(0, 10, size)), rows.slice(0, 0)]
    kept = pa.Table.from_batches(suffix_dedup._repeated(iter(batches)), rows.schema)
    assert kept["c"].to_pylist() == [1, 2, 4, 5, 6, 8, 9]
    assert list(suffix_dedup._repeated(iter([]))) == []


def test_names_are_shuffled_once(documents, spark, monkeypatch):
    passes = []
    emit = suffix_dedup._emit_seeds
    monkeypatch.setattr(suffix_dedup, "_emit_seeds", lambda *a: passes.append(a) or emit(*a))
    text = "the same passage stands in two documents and is long enough to count"
    docs = documents([(1, text), (2, "before it " + text), (3, "nothing that another has")])
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(docs).collect()}
    assert got == {1: 0, 2: len(text), 3: 0} and len(passes) == 1
