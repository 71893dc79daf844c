"""Sequence packing with lexical neighbours.

Documents are cut into token sequences of a fixed length.  A seed document fills its window first;
the rest is filled with its nearest unused neighbours under BM25, each cut where the window is full.
What is cut off waits as an unused document for another window, so only the last window of a shard
has padding.

The inverted index is sharded: token ids are the terms, their document frequencies are counted over
all documents, and a document goes to the shard of its most telling term.  A term that leads many
documents gets several shards, and terms that lead few share one, so shards have about ``SHARD_DOCS``
documents whatever the text.  Each shard builds its index and fills its windows in one task; texts
and ids stay outside, a shard sees only lengths and the weighted terms of each document, all of them.
Scores to within a bound choose the documents that are scored in full, so the choice is that of full
scores of all.

Neighbours are searched in the shard of the seed only: documents with another leading term are never
found, nor those that a hot leading term puts into another shard.  The README has the recall.

Null text: empty, it still has its end token.  Repeated rows and ``doc_id``s are documents of their
own.  Ties between neighbours go to the smaller row number.  An empty table gives no pieces.  A very
long document is cut over many windows.  Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from string import ascii_lowercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import scratch_path, stage
from .workers import give_back, lean, text_batches

WINDOW = 2048
END = 1
SHARD_DOCS = 2000
#: Terms of a shard that are columns of a matrix, seeds that are multiplied with it at a time, and a
#: bound on the relative error of sums of that many products of 32 bits.
MATRIX_TERMS, BLOCK_SEEDS, MARGIN = 512, 256, 1e-4
#: Parameters of BM25.
K1, B = 1.2, 0.75
#: Runs and words whose ids a worker process remembers; when there are more, those not met again are forgotten.
CACHE_ENTRIES = 500_000
#: Bytes of text that are cut into runs at a time; a longer text is cut alone.
CHUNK_BYTES = 6 << 20
#: Words that the tokenizer gets, and values that are copied, at a time.
BLOCK_WORDS, BLOCK_VALUES = 1 << 14, 1 << 19

_TAIL = ".,;:!?*#$%&|"
#: The letter whose lower case ends in a mark, which the tokenizer joins to punctuation.
_DOTTED = "\u0130"
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def _ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of all pairs, one after the other."""
    ends = np.cumsum(lengths)
    shift = starts - (ends - lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    at = done = 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(ends, done + BLOCK_VALUES, "right")))
        end = int(ends[stop - 1])
        out[done:end] = values[np.repeat(shift[at:stop], lengths[at:stop]) + np.arange(done, end)]
        at, done = stop, end
    return out


def _bytes_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a large binary array."""
    _, bounds, data = parts.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(parts) + 1, 8 * parts.offset) if len(parts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), bounds


def _parts_of(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A large binary array of these bytes and lengths."""
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers)


class _Memory:
    """Parts of texts and their ids."""

    def __init__(self, dtype: str) -> None:
        self.parts = pa.array([], pa.large_binary())
        self.ids = np.empty(0, dtype)
        self.lengths = self.starts = np.empty(0, np.int64)
        self.met = np.empty(0, bool)

    def places(self, parts: pa.Array) -> np.ndarray:
        """Place of each part, -1 if it is not remembered."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy().astype(np.int64)
        self.met[at[at >= 0]] = True
        return at

    def add(self, parts: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of these parts, which are not remembered yet."""
        n = len(self.parts)
        self.parts = pa.concat_arrays([self.parts, parts])
        self.ids = np.concatenate([self.ids, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.met = np.concatenate([self.met, np.zeros(len(parts), bool)])
        return np.arange(n, len(self.parts))

    def shrink(self) -> None:
        """If there are too many parts, forgets those that were not met again, or all."""
        if len(self.parts) > CACHE_ENTRIES:
            kept = np.flatnonzero(self.met)
            kept = kept[: len(kept) if len(kept) <= CACHE_ENTRIES // 2 else 0]
            data, bounds = _bytes_of(self.parts)
            size, starts, lengths, ids = np.diff(bounds)[kept], self.starts[kept], self.lengths[kept], self.ids
            parts = _parts_of(_ranges(data, bounds[kept], size), size)
            self.__init__(ids.dtype)
            self.add(parts, _ranges(ids, starts, lengths), lengths)


class PieceTokenizer:
    """Token ids of texts as packed numbers, of 16 bits if the vocabulary allows.

    The tokenizer never joins characters across white space, nor a letter or digit with punctuation
    after it, so runs between white space, and words in them, are tokenized once and remembered.  Words
    of a-z go straight to the tokenizer's model if that gives the ids of its whole chain for a probe.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        probe = " ".join([*ascii_lowercase, ascii_lowercase, "the", "letters", "zqxjkv"])
        if not np.array_equal(self._ids(self.model, probe), self._ids(self.tokenizer, probe)):
            self.model = self.tokenizer
        self.runs, self.words = _Memory(self.dtype), _Memory(self.dtype)

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.asarray(found.ids, self.dtype)

    def _of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and their numbers."""
        found = [self._ids(self.tokenizer, t) for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)

    def _of_words(self, tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters only, each of which ends with its one end token."""
        if len(words) > BLOCK_WORDS:
            blocks = range(0, len(words), BLOCK_WORDS)
            found = [self._of_words(tokenizer, words.slice(i, BLOCK_WORDS)) for i in blocks]
            return tuple(np.concatenate(x) for x in zip(*found))
        data, bounds = _bytes_of(words)
        line = np.insert(data[bounds[0] : bounds[-1]], bounds[1:-1] - bounds[0], ord(" "))
        ids = self._ids(tokenizer, line.tobytes().decode())
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return self._of_texts(words)
        return ids, np.diff(ends, prepend=0)

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words and runs."""
        plain = pc.ascii_is_alpha(parts)
        # letters only, in lower case too
        word = pc.and_not(pc.and_not(pc.utf8_is_alpha(parts), pc.match_substring(parts, _DOTTED)), plain)
        rest = pc.invert(pc.or_(plain, word))
        # ASCII letters have the ids of their lower case
        coded = pc.ascii_lower(parts.filter(plain)).dictionary_encode()
        low, low_lengths = self._of_words(self.model, coded.dictionary)
        at = coded.indices.to_numpy()
        found = [
            (_ranges(low, (np.cumsum(low_lengths) - low_lengths)[at], low_lengths[at]), low_lengths[at]),
            self._of_words(self.tokenizer, parts.filter(word)),
            self._of_texts(parts.filter(rest)),
        ]
        ids, lengths = (np.concatenate(x) for x in zip(*found))
        kinds = [np.flatnonzero(kind.to_numpy(zero_copy_only=False)) for kind in (plain, word, rest)]
        place = np.argsort(np.concatenate(kinds))
        return _ranges(ids, (np.cumsum(lengths) - lengths)[place], lengths[place]), lengths[place]

    def _of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs, by their words if only punctuation follows these."""
        text = runs.view(pa.large_string())
        words = pc.ascii_rtrim(text, _TAIL)
        last = pc.utf8_slice_codeunits(words, -1)
        letter = pc.and_(pc.utf8_is_alpha(last), pc.not_equal(last, _DOTTED))
        words = pc.if_else(pc.or_(letter, pc.ascii_is_decimal(last)), words, text)
        data, bounds = _bytes_of(runs)
        size = np.diff(bounds) - pc.binary_length(words).to_numpy()
        tails = _parts_of(_ranges(data, bounds[1:] - size, size), size).view(pa.large_string()).dictionary_encode()
        coded = words.dictionary_encode()
        parts = coded.dictionary.view(pa.large_binary())
        at = self.words.places(parts)
        new = at < 0
        if new.any():
            some = pa.array(new)
            at[new] = self.words.add(parts.filter(some), *self._of_parts(coded.dictionary.filter(some)))
        at, tail = at[coded.indices.to_numpy()], tails.indices.to_numpy()
        tail_ids, tail_lengths = self._of_texts(tails.dictionary)
        tail_starts = len(self.words.ids) + np.cumsum(tail_lengths) - tail_lengths
        starts = np.stack([self.words.starts[at], tail_starts[tail]], 1)
        lengths = np.stack([self.words.lengths[at], tail_lengths[tail]], 1)
        ids = np.concatenate([self.words.ids, tail_ids])
        return _ranges(ids, starts.ravel(), lengths.ravel()), lengths.sum(axis=1)

    def _encode_chunk(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first, last = edge[:-1].copy(), edge[1:].copy()
        first[1:] |= ~inside[:-1]
        last[:-1] |= ~inside[1:]
        first &= inside
        last &= inside
        starts = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - starts
        del edge, first, last
        coded = _parts_of(data[inside], size).dictionary_encode()
        del inside, size
        at = self.runs.places(coded.dictionary)
        new = at < 0
        if new.any():
            runs = coded.dictionary.filter(pa.array(new))
            at[new] = self.runs.add(runs, *self._of_runs(runs))
        at = at[coded.indices.to_numpy()]
        lengths = self.runs.lengths[at]
        ids = _ranges(self.runs.ids, self.runs.starts[at], lengths)
        del at, coded
        before_run = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        self.runs.shrink()
        self.words.shrink()
        return ids, before_run[np.searchsorted(starts, bounds)]

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Packed ids of texts, and where each text's begin and the last one's end; few texts at a time."""
        data, bounds = _bytes_of(texts.cast(pa.large_binary()))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
            yield self._encode_chunk(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
            at = end

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Packed ids of each text."""
        rows = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
        return [
            ids[i:j].tobytes()
            for ids, bounds in self.encode_array(rows)
            for i, j in zip(bounds.tolist(), bounds.tolist()[1:])
        ]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``CHUNK_BYTES``, as each looks up all that is remembered."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > CHUNK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@lru_cache(maxsize=1)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """The tokenizer of a worker process, with what it remembers from task to task."""
    return PieceTokenizer(path)


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Written table of row (a number), doc_id, ids (packed, with the end token), n_tokens, width
    (bytes of an id)."""
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32()]
    names = ["row", "doc_id", "ids", "n_tokens", "width"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_tokenizer(tokenizer_path)
        width = np.dtype(pieces.dtype).itemsize
        for batch in _merged(batches):
            at = 0
            for ids, bounds in pieces.encode_array(batch.column("text")):
                n = len(bounds) - 1
                packed = np.insert(ids, bounds[1:], END)
                lengths = np.diff(bounds) + 1
                columns = [
                    batch.column("row").slice(at, n),
                    batch.column("doc_id").slice(at, n),
                    _parts_of(packed.view(np.uint8), lengths * width),
                    pa.array(lengths),
                    pa.array(np.full(n, width)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names)
                at += n

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = "row long, doc_id string, ids binary, n_tokens long, width int"
    path = scratch_path(docs.sparkSession, "token-ids")
    with text_batches(docs.sparkSession):
        rows.mapInArrow(lean(encode), schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _unpacked(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{width}")


def _packed_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Token ids of a batch's rows, one after the other, where each row's begin, and bytes of an id."""
    width = batch.column("width")[0].as_py() if batch.num_rows else 1
    data, bounds = _bytes_of(batch.column("ids").cast(pa.large_binary()))
    return data[bounds[0] : bounds[-1]].view(f"<u{width}"), (bounds - bounds[0]) // width, width


def _counted(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its different tokens, ascending, how often each occurs, and where each row's begin."""
    tokens = tokens.copy()
    for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
        tokens[i:j].sort()
    new = np.ones(len(tokens) + 1, bool)
    new[1:-1] = tokens[1:] != tokens[:-1]
    new[bounds] = True
    first = np.flatnonzero(new)
    return tokens[first[:-1]], np.diff(first), np.searchsorted(first, bounds)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's rows: in how many documents each token id occurs."""
    seen = np.zeros(1, np.int64)
    for batch in batches:
        tokens, bounds, _ = _packed_rows(batch)
        found = np.bincount(_counted(tokens, bounds)[0], minlength=len(seen))
        found[: len(seen)] += seen
        seen = found
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["token", "df"])


def _told(
    tokens: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean_length: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of documents, of each the one with the largest BM25 weight first, the weights, and
    where each document's begin."""
    terms, n, first = _counted(tokens, bounds)
    length = np.repeat(np.diff(bounds), np.diff(first))
    weight = idf[terms] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean_length))
    negative = -weight
    order = np.empty(len(terms), np.int64)
    for i, j in zip(first.tolist(), first[1:].tolist()):
        order[i:j] = np.argsort(negative[i:j], kind="stable")
    order += np.repeat(first[:-1], np.diff(first))
    return terms[order], weight[order].astype(np.float32), first


def telling_terms(tokens: np.ndarray, idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a document, the one with the largest BM25 weight first, and the weights."""
    terms, weights, _ = _told(tokens, np.array([0, len(tokens)]), idf, mean_length)
    return terms.astype(np.int32), weights


class _Shard:
    """The weighted terms of a shard's documents, as an inverted index.

    The most frequent terms are columns of a matrix of 32 bits, the others have postings.  Both together
    tell a score up to ``MARGIN``, as all weights are positive; the documents that may be among the
    nearest are then scored anew, with 64 bits and in the order of the seed's terms.
    """

    def __init__(self, terms: list, weights: list) -> None:
        sizes = np.array([len(ts) for ts in terms], np.int64)
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        listed = np.concatenate([np.empty(0, np.int64), *(np.asarray(ts, np.int64) for ts in terms)])
        n = np.bincount(listed, minlength=1)
        known = np.flatnonzero(n)
        self.term, n = (np.cumsum(n > 0) - 1)[listed], n[known]
        self.weight = np.concatenate([np.empty(0), *(np.asarray(ws, float) for ws in weights)])
        # documents with the same terms and weights have the same scores
        first: dict[tuple[bytes, bytes], int] = {}
        cuts = [slice(i, j) for i, j in zip(self.bounds.tolist(), self.bounds[1:].tolist())]
        told = [(self.term[x].tobytes(), self.weight[x].tobytes()) for x in cuts]
        self.same = np.array([first.setdefault(x, i) for i, x in enumerate(told)], np.int64)
        self.place = np.full(len(known), -1)
        column = np.full(len(known), -1)
        frequent = np.argsort(-n, kind="stable")[:MATRIX_TERMS]
        column[frequent] = np.arange(len(frequent))
        of_entry, doc = column[self.term], np.repeat(np.arange(len(terms)), sizes)
        self.matrix = np.zeros((len(terms), len(frequent)), np.float32)
        self.matrix[doc[of_entry >= 0], of_entry[of_entry >= 0]] = self.weight[of_entry >= 0]
        self.in_matrix = column >= 0
        rare = np.flatnonzero(of_entry < 0)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.postings = self.term[rare], doc[rare], self.weight[rare]
        self.block_end = 0

    def _next_block(self, seed: int, left: np.ndarray) -> None:
        """Scores of the frequent terms for some more seeds; documents used up leave the index."""
        self.unused = np.flatnonzero(left > 0)
        self.block_start, self.block_end = seed, seed + BLOCK_SEEDS
        self.scores = self.matrix[seed : self.block_end] @ self.matrix[self.unused].T
        term, doc, weight = self.postings
        kept = left[doc] > 0
        self.postings = term, doc, weight = term[kept], doc[kept], weight[kept]
        self.first = np.searchsorted(term, np.arange(len(self.place) + 1))
        self.posted = np.searchsorted(self.unused, doc)

    def nearest(self, seed: int, left: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with tokens left, ascending, and their scores: all that the nearest ones that fill
        the room may be among."""
        if seed >= self.block_end:
            self._next_block(seed, left)
        entries = slice(self.bounds[seed], self.bounds[seed + 1])
        term, weight = self.term[entries], self.weight[entries]
        rare = ~self.in_matrix[term]
        begin = self.first[term[rare]]
        n = self.first[term[rare] + 1] - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        about = self.scores[seed - self.block_start] + np.bincount(
            self.posted[at], self.postings[2][at] * np.repeat(weight[rare], n), len(self.unused)
        )
        tokens = left[self.unused]
        about[tokens == 0] = 0
        least = 0.0
        for some in (8, 64):
            if some < len(about):
                top = np.argpartition(about, -some)[-some:]
                if tokens[top].sum() >= room:
                    top = top[np.argsort(-about[top])]
                    least = about[top[np.searchsorted(np.cumsum(tokens[top]), room)]]
                    break
        near = self.unused[(about > 0) & (about * (1 + MARGIN) >= least * (1 - MARGIN))]
        # the sums of the nearest in full
        docs, of = np.unique(self.same[near], return_inverse=True)
        n = self.bounds[docs + 1] - self.bounds[docs]
        at = np.repeat(self.bounds[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.place[term] = np.arange(len(term))
        place = self.place[self.term[at]]
        self.place[term] = -1
        shared = np.flatnonzero(place >= 0)
        place = place[shared].astype(np.uint16 if len(term) <= 1 << 16 else np.int64)
        order = np.argsort(place, kind="stable")
        doc = np.repeat(np.arange(len(docs)), n)[shared[order]]
        return near, np.bincount(doc, self.weight[at[shared[order]]] * weight[place[order]], len(docs))[of]


def fill_windows(
    lengths: list[int], terms: list, weights: list, window: int = WINDOW
) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard's documents."""
    shard = _Shard(terms, weights)
    left = np.array(lengths, np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, room = 0, window

    def put(doc: int) -> None:
        """As much of the document as the open window holds; full windows are closed."""
        nonlocal sequence, room
        take = int(min(left[doc], room))
        pieces.append((doc, int(lengths[doc] - left[doc]), take, sequence, window - room))
        left[doc] -= take
        room -= take
        if not room:
            sequence, room = sequence + 1, window

    for seed in range(len(lengths)):
        while left[seed]:
            put(seed)
        if room == window or not len(terms[seed]):
            continue
        docs, scores = shard.nearest(seed, left, room)
        while room < window and len(docs) and scores[best := int(scores.argmax())] > 0:
            put(int(docs[best]))
            scores[best] = 0
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer_path)
    totals = rows.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_docs, mean_length = totals[0], max(1.0, totals[1] / max(1, totals[0]))
    # one entry for each id of the tokenizer
    counts = rows.select("ids", "width").mapInArrow(lean(_frequencies), "token long, df long")
    df = counts.groupBy("token").agg(F.sum("df").alias("df")).toPandas()
    idf = np.zeros(int(df["token"].max()) + 1 if len(df) else 1)
    idf[df["token"].to_numpy(int)] = np.log(1 + (n_docs - df["df"].to_numpy() + 0.5) / (df["df"].to_numpy() + 0.5))
    known = spark.sparkContext.broadcast(idf)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, bounds, width = _packed_rows(batch)
            n = np.diff(bounds)
            # without the end token
            inner = np.ones(len(tokens), bool)
            inner[bounds[1:] - 1] = False
            terms, weights, first = _told(
                tokens[inner], bounds - np.arange(len(bounds)), known.value, mean_length
            )
            size = np.diff(first)
            lead = np.full(len(n), -1)
            lead[size > 0] = terms[first[:-1][size > 0]]
            columns = [
                batch.column("row"),
                pa.array(n),
                batch.column("width"),
                pa.array(lead),
                _parts_of(terms.view(np.uint8), size * width).cast(pa.binary()),
                _parts_of(weights.view(np.uint8), size * 4).cast(pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_tokens", "width", "lead", "terms", "weights"])

    described = stage(
        rows.select("row", "ids", "width").mapInArrow(
            lean(describe), "row long, n_tokens long, width int, lead long, terms binary, weights binary"
        ),
        "pack-terms",
    )
    # shards of the leading terms: at most one entry for each id of the tokenizer
    lead = described.groupBy("lead").agg(F.count("*").alias("n")).orderBy("lead").toPandas()
    before = np.concatenate([[0], np.cumsum(lead["n"].to_numpy())[:-1]]) if len(lead) else np.empty(0)
    lead["first"] = (before // shard_docs).astype(np.int64)
    lead["n_shards"] = np.maximum(1, -(-lead["n"].to_numpy() // shard_docs)).astype(np.int64)
    routes = spark.createDataFrame(lead[["lead", "first", "n_shards"]], "lead long, first long, n_shards long")
    routed = described.join(F.broadcast(routes), "lead").withColumn(
        "shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("n_shards"))
    )

    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("row")
        number = shard["row"].to_numpy()
        lengths = [int(n) for n in shard["n_tokens"]]
        terms = [_unpacked(x, width) for x, width in zip(shard["terms"], shard["width"])]
        weights = [np.frombuffer(x, np.float32) for x in shard["weights"]]
        found = fill_windows(lengths, terms, weights, window)
        out = pd.DataFrame(found, columns=["doc", "start", "length", "sequence", "offset"], dtype=np.int64)
        out["row"] = number[out["doc"].to_numpy(int)] if len(out) else np.empty(0, np.int64)
        out["sequence_id"] = out["sequence"] + (int(shard["shard"].iloc[0]) << 32)
        give_back()
        return out[["row", "start", "length", "sequence_id", "offset"]]

    pieces = routed.groupBy("shard").applyInPandas(
        fill, "row long, start long, length long, sequence_id long, offset long"
    )
    listed = stage(
        pieces.groupBy("row").agg(
            F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces")
        ),
        "pack-pieces",
    )

    def checksums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out = []
            for doc_id, packed, width, n, cuts in zip(*[batch[c] for c in batch.columns]):
                ids = _unpacked(packed, width).astype("<u4")
                for p in cuts:
                    crc = zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
                    out.append((doc_id, p["start"], p["length"], crc, n, p["sequence_id"], p["offset"]))
            yield pd.DataFrame(out, columns=names)

    return (
        rows.join(listed, "row")
        .select("doc_id", "ids", "width", "n_tokens", "pieces")
        .mapInPandas(
            lean(checksums),
            "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
