"""Licence scan, decontamination and sharding."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, license_scan, sharding
from factorloom.llm.text import word_list, words


def test_words_agree_in_both_languages(spark, messy):
    for r in messy.select("text", words(F.col("text")).alias("got")).collect():
        assert [x.encode() for x in r["got"]] == word_list(r["text"])


# licence scan


def scanned(df):
    return license_scan.digest(license_scan.scan(df))


def test_phrases_and_templates(documents):
    rows = scanned(
        documents(
            [
                (1, "cc by x CC-BY general public license"),
                (2, "x All rights, RESERVED. y all rights not reserved"),
                (3, "Licensed under the Apache License Version 2.0"),
                (4, "licensed under the new apache license version 2 0"),
                (5, "licensed by apache under version 2"),
                (6, None),
            ]
        )
    ).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[1]["n_base"], by_id[1]["first_word"], by_id[1]["last_word"]) == (3, 0, 5)
    assert by_id[1]["base_labels"] == "cc-by,gpl"
    assert (by_id[2]["n_base"], by_id[2]["first_word"], by_id[2]["labels"]) == (1, 1, "reserved")
    assert by_id[3]["labels"] == "apache-2.0" and by_id[3]["score"] == 1.0
    # a word put in shifts the diagonal, and breaks one of seven pairs
    assert by_id[4]["labels"] == "apache-2.0" and 0.8 <= by_id[4]["score"] < 1
    assert by_id[5]["labels"] == "" and by_id[5]["score"] == 0.0
    assert (by_id[6]["n_words"], by_id[6]["n_base"], by_id[6]["first_word"]) == (0, 0, None)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
        # no version, or another one: the phrase alone
        ("licensed under the GNU General Public License", "gpl"),
        ("licensed under the GNU General Public License version 4", "gpl"),
        ("licensed under the GNU Lesser General Public License version 2", "gpl,lgpl"),
        # pairs of a template strung out over more diagonals than one span may have
        ("released under under under the the the mit mit mit license", ""),
        ("under the released under the mit license under the", "mit"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0"),
        ("see https://opensource.org/licenses/MIT and", "mit"),
        ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
        ("https://creativecommons.org/licenses/by/4.0/", "cc-by"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "isc"),
    ],
)
def test_labels_of_one_licence(documents, text, labels):
    assert scanned(documents([(1, text)])).first()["labels"] == labels


def test_licence_sql_agrees(documents):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(11)
    vocabulary = [w for t in license_scan.TEMPLATES for w in t.split()]
    texts = []
    for _ in range(80):
        w = rng.choice(list(license_scan.TEMPLATES)).split() + rng.choices(vocabulary, k=6)
        w += rng.choice(list(license_scan.TEMPLATES)).split()
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w)), rng.choice(vocabulary))
        texts.append(" ".join(w))
    df = documents(list(enumerate(texts)) + [(0, texts[3]), (None, texts[4]), (None, None)])
    connection = duckdb.connect()
    connection.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    result = connection.sql(license_scan.SQL)
    got = Counter(tuple(r) for r in scanned(df).select(*result.columns).collect())
    assert got == Counter(result.fetchall())


def test_phrases_against_brute_force(documents):
    rng = random.Random(5)
    vocabulary = "cc by general public license all rights reserved x".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(60)]
    got = {r["doc_id"]: r for r in scanned(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        places = [
            p
            for phrase in license_scan.PHRASES
            for p in range(len(w))
            if w[p : p + len(phrase.split())] == phrase.split()
        ]
        assert got[i]["n_base"] == len(places)
        assert got[i]["first_word"] == min(places, default=None)
        assert got[i]["last_word"] == max(places, default=None)


def test_license_scan_edges(messy, empty):
    rows = scanned(messy).collect()
    assert len(rows) == messy.count()
    assert {r["labels"] for r in rows if r["doc_id"] == 1} == {"apache-2.0,reserved"}
    assert scanned(empty).count() == 0


# decontamination


@pytest.fixture(scope="module")
def benchmark(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string")

    return make


def brute_force(text, items, length=10):
    w = word_list(text)
    hit, found = set(), set()
    for item, item_text in items:
        v = word_list(item_text)
        n = min(length, len(v))
        for at in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[at : at + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(documents, benchmark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 30
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 14, 30])))) for i in range(12)]
    items += [(3, items[5][1]), (90, None), (91, "..."), (92, "Short one"), (92, "w1 w1 w1")]
    texts = [None, "", "short, ONE short one"]
    for _ in range(60):
        words_ = rng.choices(vocabulary, k=rng.randrange(80))
        v = rng.choice(items[:12])[1].split()
        at = rng.randrange(len(words_) + 1)
        cut = rng.randrange(len(v))
        texts.append(" ".join(words_[:at] + v[cut : cut + 12] + words_[at:] + v[:11]))
    docs = documents(list(enumerate(texts)) + [(0, texts[5]), (0, texts[5])])
    got = decontaminate.scan(docs, benchmark(items)).collect()
    assert len(got) == len(texts) + 2
    want = Counter(
        (i, n, k, tuple(f))
        for i, t in [*enumerate(texts), (0, texts[5]), (0, texts[5])]
        for n, k, f in [brute_force(t, items)]
    )
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want


def test_proximity_matches(documents, benchmark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    changed = item.replace("gamma", "gamma new")
    got = decontaminate.scan(documents([(1, changed), (2, item)]), benchmark([(7, item)]))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert (rows[2]["items"], rows[2]["near_items"]) == (["7"], [])
    assert rows[1]["items"] == [] and rows[1]["near_items"] in (["7"], [])


def test_decontamination_edges(messy, empty, benchmark):
    items = benchmark([(1, "one two three four five six seven eight nine ten"), (2, "jumps over"), (3, None)])
    rows = decontaminate.scan(messy, items).collect()
    assert len(rows) == messy.count()
    assert [r["n_hit"] for r in rows if r["items"] == ["1"]] == [10, 10, 10]
    assert [r["n_hit"] for r in rows if r["doc_id"] == 4] == [8000]
    assert decontaminate.scan(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.scan(messy, benchmark([])).collect()} == {0}
    kept = decontaminate.remove(messy, items)
    assert kept.columns == messy.columns
    assert kept.count() == messy.count() - 4


# sharding


def check_shards(rows, n_rows, n_shards):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n_rows
    assert all(n_rows // n_shards <= sizes[s] <= -(-n_rows // n_shards) for s in range(n_shards))
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))


def test_exact_sizes_over_many_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 4)
    monkeypatch.setattr(sharding, "FANOUT", 4)
    monkeypatch.setattr(sharding, "RUN_ROWS", 10)
    docs = documents([(i, f"text {i % 50}") for i in range(403)])
    rows = sharding.shuffle_to_shards(docs, n_shards=7, seed=3).collect()
    check_shards(rows, 403, 7)
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 9} == {zlib.crc32(b"text 9")}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    # a random order of 403 rows has about 201 descents
    assert 160 < sum(a > b for a, b in zip(order, order[1:])) < 245


def test_hypergeometric_draws(spark):
    total, good, draws, n = 60, 25, 17, 4000
    u = spark.range(n).select(sharding.uniform(F.lit(1), F.col("id")).alias("u"))
    args = [F.lit(float(x)) for x in (total, good, draws)]
    got = Counter(r[0] for r in u.select(sharding.hypergeometric(F.col("u"), *args)).collect())
    p = {k: math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws) for k in range(draws + 1)}
    assert sum(got.values()) == n
    chi2 = sum((got[k] - n * q) ** 2 / (n * q) for k, q in p.items() if n * q >= 5)
    assert chi2 < 40
    edge = spark.range(1).select(
        *[sharding.hypergeometric(F.lit(0.3), *[F.lit(float(x)) for x in a]) for a in ((5, 0, 3), (5, 5, 3), (5, 2, 0), (5, 2, 5), (0, 0, 0))]
    )
    assert list(edge.first()) == [0, 3, 0, 2, 0]


def test_log_factorial(spark):
    n = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10, 1000, 10**9)], "n double")
    for r in n.select("n", sharding.log_factorial(F.col("n")).alias("x")).collect():
        assert math.isclose(r["x"], math.lgamma(r["n"] + 1), rel_tol=1e-9, abs_tol=1e-9)


def test_sharding_edges(messy, empty):
    rows = sharding.shuffle_to_shards(messy, n_shards=5).collect()
    check_shards(rows, messy.count(), 5)
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {16}
    assert sharding.shuffle_to_shards(empty).count() == 0
    assert sharding.shuffle_to_shards(messy, n_shards=40).count() == messy.count()
