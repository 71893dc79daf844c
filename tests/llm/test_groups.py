"""Jaccard join, packing and the pipeline."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from factorloom.llm import jaccard_join, packing, queries, secret_scan
from factorloom.llm.text import word_list

# Jaccard join


def word_sets(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_components(rows):
    sets = [word_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return Counter(
        (doc_id, len(sets[i]), smallest.get(find(i)) if sets[i] else doc_id)
        for i, (doc_id, _) in enumerate(rows)
    )


def near_copies(rng, n_groups, vocabulary=300):
    """Groups of texts with edits that leave similarities on both sides of the bound."""
    words = [f"w{i}" for i in range(vocabulary)]
    shared = rng.choices(words, k=25)
    texts = []
    for _ in range(n_groups):
        base = rng.choices(words, k=rng.choice([3, 8, 30, 60, 120]))
        if rng.random() < 0.4:
            base = base + shared
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - rng.randrange(20))]
            texts.append(" ".join(copy))
    return texts


def found(docs):
    return Counter(tuple(r) for r in jaccard_join.components(docs).collect())


@pytest.mark.parametrize("rounds", [0, 2])
def test_components_against_brute_force(documents, monkeypatch, rounds):
    monkeypatch.setattr(jaccard_join, "FRAGMENTS", 3)
    monkeypatch.setattr(jaccard_join.link_groups, "__defaults__", (rounds,))
    rng = random.Random(rounds)
    texts = near_copies(rng, 40)
    rows = list(enumerate(texts)) + [(500, texts[0]), (501, texts[0].upper()), (502, None), (503, " \n")]
    rng.shuffle(rows)
    assert found(documents(rows)) == brute_components(rows)


def test_a_chain_of_links(documents):
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(words[3 * k : 3 * k + 60])) for k in range(12)]
    want = brute_components(rows)
    assert found(documents(rows)) == want and {c for _, _, c in want} == {89}


def test_join_edges(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    assert found(messy) == brute_components(rows)
    assert jaccard_join.components(empty).count() == 0
    kept = jaccard_join.keep_first(messy)
    assert kept.columns == messy.columns and kept.count() == messy.count()


def test_keep_first(documents):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents([(3, text), (2, text + " end"), (9, "other"), (1, None), (4, text)])
    assert sorted(r["doc_id"] for r in jaccard_join.keep_first(docs).collect()) == [1, 2, 9]


def test_keep_first_of_repeated_ids(documents):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents([(1, text), (2, text + " end"), (2, "a text of its own")], clashes=True)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, text), (2, "a text of its own")]


# packing

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer_path()


def check_pieces(rows, docs, window):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        want[doc_id] += len(ids)
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    by_id = {doc_id: text for doc_id, text in docs}
    for doc_id, n in Counter(d for d, _ in docs).items():
        if n > 1:
            continue
        ids = np.array([*tokenizer.encode(by_id[doc_id] or "", add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return by_sequence


TEXTS = [
    "Hello, world!!! 123 it's l'été <|endoftext|> <|ENDOFTEXT|>  x y a\x1cb",
    "İstanbul ẞ ΣΣ é ½ ² \U0001f600\U0001f468‍\U0001f469 word... a.b,c ***",
    "%%% $$$ |pipe| under_score 'quoted' don't we'll 한국어 日本語",
]


@pytest.mark.parametrize("text", TEXTS)
def test_cached_runs_equal_the_tokenizer(text):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    pieces = packing.PieceTokenizer(PATH)
    for _ in range(2):
        (ids,) = pieces.encode([text])
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, pieces.dtype).tolist() == want


def test_packing(documents):
    rng = random.Random(1)
    words = "stone river cloud engine forest market signal window".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(300)))) for i in range(120)]
    docs += [(200, "deep sea " * 3000), (201, None), (202, ""), (203, TEXTS[0])]
    rows = packing.pack(documents(docs), PATH, window=256, shard_docs=50).collect()
    sequences = check_pieces(rows, docs, 256)
    total = sum(r["length"] for r in rows)
    shards = {s >> 32 for s in sequences}
    assert len(sequences) * 256 - total < 256 * len(shards)


def test_neighbours_share_a_window():
    # two topics in turn: a window takes the documents that share the seed's terms
    terms = [[1, 2] if i % 2 else [3, 4] for i in range(12)]
    pieces = packing.fill_windows([10] * 12, terms, [[1.0, 1.0]] * 12, window=60)
    topics = {}
    for doc, _, _, sequence, _ in pieces:
        topics.setdefault(sequence, set()).add(doc % 2)
    assert topics == {0: {0}, 1: {1}}


def test_neighbours_by_any_term():
    # the first and the last share one term, which is not among the heaviest of either
    tokens = [[*range(14)] * 5 + [100], [50] * 71, [51] * 71, [*range(20, 34)] * 5 + [100]]
    told = [packing.telling_terms(np.array(x), np.ones(101), 71) for x in tokens]
    pieces = packing.fill_windows([10] * 4, [t for t, _ in told], [w for _, w in told], window=20)
    assert {doc for doc, _, _, sequence, _ in pieces if sequence == 0} == {0, 3}


class Counting:
    """A tokenizer that notes the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.words += [w for t in texts for w in t.split()]
        return self.tokenizer.encode_batch_fast(texts, **options)

    def encode(self, text, **options):
        self.words += text.split()
        return self.tokenizer.encode(text, **options)


def test_a_word_is_tokenized_once_in_any_case():
    pieces = packing.PieceTokenizer(PATH)
    pieces.tokenizer = counting = Counting(pieces.tokenizer)
    pieces.model = Counting(getattr(pieces, "model", None))
    pieces.encode(["Sundry sundry, SUNDRY! sUnDrY.", "sundrY?? Sundry"])
    words = counting.words + pieces.model.words
    assert Counter(w.lower() for w in words)["sundry"] == 1


def test_ids_over_chunks_and_after_forgetting(monkeypatch):
    rng = random.Random(5)
    letters = ["abcdeXYZ", "éÀßçñİıŠ", "0123456789²½", ".,;:!?*#$%&|'\"-<>", "\u0301\u0331\u200d", "한字ひアΣς", "\x1c\x85\xa0\u2003"]
    texts = []
    for _ in range(400):
        runs = ["".join(rng.choices(rng.choice([letters[0], letters[1], "".join(letters)]), k=rng.randrange(1, 9))) for _ in range(30)]
        texts.append(rng.choice([" ", "\n", "\t ", "  "]).join(r + rng.choice(["", "", ".", "!!", "'s", ",x"]) for r in runs))
    texts += ["", " ", "H\u0331 h\u0331 I\u0307 don't DON'T <|endoftext|>. x<|ENDOFTEXT|>"]
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for chunk, entries in ((1 << 24, 500_000), (700, 300), (1, 1)):
        monkeypatch.setattr(packing, "CHUNK_BYTES", chunk, raising=False)
        monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
        pieces = packing.PieceTokenizer(PATH)
        for _ in range(2):
            assert [np.frombuffer(x, pieces.dtype).tolist() for x in pieces.encode(texts)] == want


def plain_windows(lengths, terms, weights, window):
    """Every document scored against every seed, term by term of the seed."""
    postings = {}
    for doc, (ts, ws) in enumerate(zip(terms, weights)):
        for t, w in zip(ts, ws):
            postings.setdefault(t, []).append((doc, float(w)))
    left, pieces, sequence, room = list(lengths), [], 0, window

    def put(doc):
        nonlocal sequence, room
        take = min(left[doc], room)
        pieces.append((doc, lengths[doc] - left[doc], take, sequence, window - room))
        left[doc] -= take
        room -= take
        if not room:
            sequence, room = sequence + 1, window

    for seed in range(len(lengths)):
        while left[seed]:
            put(seed)
        if room == window:
            continue
        scores = [0.0] * len(lengths)
        for t, w in zip(terms[seed], weights[seed]):
            for doc, x in postings[t]:
                scores[doc] += x * float(w)
        for doc in sorted(range(len(lengths)), key=lambda d: (-scores[d], d)):
            if room < window and left[doc] and scores[doc] > 0:
                put(doc)
    return pieces


@pytest.mark.parametrize("vocabulary, copies", [(30, 1), (900, 1), (900, 40), (900, 400)])
def test_windows_are_filled_by_full_scores(vocabulary, copies):
    rng = np.random.default_rng(vocabulary + copies)
    lengths, terms, weights = [], [], []
    while len(lengths) < 700:
        n = int(rng.integers(0, 28))
        ts = rng.permutation(np.unique((vocabulary * rng.random(n) ** 2).astype(int))).astype("<u2")
        # few values, so that scores tie
        ws = rng.choice([0.25, 0.5, 1.5], len(ts)).astype(np.float32)
        for _ in range(int(rng.integers(1, copies + 1))):
            lengths.append(int(rng.integers(1, 90)))
            terms.append(ts)
            weights.append(ws)
    assert packing.fill_windows(lengths, terms, weights, 64) == plain_windows(lengths, terms, weights, 64)


def test_packing_edges(messy, empty):
    docs = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    check_pieces(packing.pack(messy, PATH).collect(), docs, 2048)
    assert packing.pack(empty, PATH).count() == 0


# pipeline

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_stage_by_stage(spark):
    docs = queries.documents(spark, SF_DIR)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "decontamination", "secret_scan", "packing"]
    tables = [docs]
    for _, apply in corpus_pipeline.STAGES[:-1]:
        tables.append(corpus_pipeline.stage(apply(spark, tables[-1], SF_DIR), "test-stage"))
    assert all(t.columns == docs.columns for t in tables)
    rows = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables]
    # each stage keeps documents of the one before it
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    components = brute_components(list(rows[1].items()))
    assert set(rows[2]) == {c for _, _, c in components}
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [word_list(t)] for i in range(max(1, len(w) - 9))}

    def clean(text):
        w = word_list(text)
        return not any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))

    assert set(rows[3]) == {i for i, t in rows[2].items() if clean(t)}
    assert set(rows[4]) == set(rows[3])
    for i, text in rows[4].items():
        assert not secret_scan.find_secrets(text)
        if not secret_scan.find_secrets(rows[3][i]):
            assert text == rows[3][i]
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    check_pieces(pieces, list(rows[4].items()), 2048)


def test_pipeline_on_messy_and_empty_tables(spark, messy, empty, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs, least in ((messy, 5), (empty, 0)):
        for _, apply in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stage(apply(spark, docs, str(tmp_path)), "test-stage")
            assert out.columns == docs.columns
            docs = out
        assert docs.count() >= least
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= least
