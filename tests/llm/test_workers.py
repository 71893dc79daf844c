"""Memory of Python workers."""

from __future__ import annotations

import subprocess
import sys

import pyarrow as pa

from factorloom.llm import jaccard_join, packing, workers
from factorloom.llm.queries import tokenizer_path

_TOKENIZE = """
import re, sys
from pathlib import Path
import numpy as np, pyarrow as pa
from factorloom.llm import packing
from factorloom.llm.workers import lean

def anonymous(name):
    return int(re.search(name + r":\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

letters = np.random.default_rng(1).integers(97, 123, 15_000_000).astype(np.uint8)
letters[::6] = 32
texts = pa.array([letters[i : i + 3000].tobytes() for i in range(0, len(letters), 3000)], pa.binary())
pieces = packing.PieceTokenizer(sys.argv[1])
del letters
at_first, most = anonymous("RssAnon"), anonymous("VmHWM")
n = sum(1 for _ in lean(pieces.encode_array)(texts))
print(anonymous("VmHWM") - most, anonymous("RssAnon") - at_first)
"""


def test_memory_of_a_tokenizing_worker():
    out = subprocess.run(
        [sys.executable, "-c", _TOKENIZE, tokenizer_path()], capture_output=True, text=True, check=True, timeout=300
    )
    most, left = map(float, out.stdout.split())
    # 1809 and 1313 MB with all words at once and nothing given back, 239 and none since
    assert most < 600 and left < 200


def test_texts_come_in_short_batches(spark, documents, monkeypatch):
    def checked(run):
        def wrapped(batches):
            def short():
                for batch in batches:
                    assert len(batch) <= 2
                    yield batch

            return run(short())

        return wrapped

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(workers, "TEXT_ROWS", 2)
    monkeypatch.setattr(jaccard_join, "lean", checked)
    docs = documents([(i, f"a b c d e {i % 3}") for i in range(9)]).coalesce(1)
    rows = jaccard_join.components(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i % 3 for i in range(9)}
    monkeypatch.setattr(packing, "_merged", checked(lambda batches: batches))
    assert packing.pack(docs, tokenizer_path()).count() == 9
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_merged_batches_hold_all_rows(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 100)
    texts = ["x" * (i % 90) for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 3])], ["text"]) for i in range(0, 50, 3)]
    merged = list(packing._merged(iter(batches)))
    assert [t for b in merged for t in b.column(0).to_pylist()] == texts and len(merged) < len(batches)
