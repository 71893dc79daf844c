"""Secret scan: patterns for common forms, and structural confirmation of encoded keys.

Patterns find assignments, access keys and long hexadecimal runs.  Beyond these, every long base64
or hexadecimal run is decoded, and reported only if its bytes have the structure of a secret:

- ``der``: nested ASN.1 lengths of a private key that add up to the whole run,
- ``openssh``: the magic of an OpenSSH private key and nested length-prefixed fields,
- ``jwt``: a signed token, three parts whose first is a JSON object with an algorithm.

A run may be broken over lines, as in a PEM block, with blanks around the line ends or with line ends
written as in a JSON string; base64 may have the alphabet of addresses.  A key ends where its outer length says, if that
is the end of a line; words of later lines do not belong to it.  Offsets are code points, ends exclusive.  Null
text: no secrets.  Repeated rows each get their own result; an empty table gives none.  Other columns
are kept, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import free_name
from .workers import lean

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# a run goes on in the next line, which may be indented, or follow a line end written as in a JSON string
_FOLD = r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*"
_BREAK = re.compile(_FOLD)
_HEX_BYTES = re.compile(
    "|".join(
        rf"(?<![0-9A-Za-z+/])(?:{digit}{{2}}){{16,}}(?:{_FOLD}(?:{digit}{{2}})+)*(?![0-9A-Za-z+/=])"
        for digit in ("[0-9a-f]", "[0-9A-F]")
    )
)
# the letter of an escape sequence in front is no part of the run
_BASE64 = re.compile(
    r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt]))"
    rf"[A-Za-z0-9+/]{{40,}}(?:{_FOLD}[A-Za-z0-9+/]+)*={{0,2}}"
)
_BASE64_URL = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{40,}={0,2}")
# every run above holds as many such characters in a row
_LONG = re.compile(r"[A-Za-z0-9+/_-]{32}")
# fixed values: how "{" and a quote, blank, tab or line end begin in base64
_HEADERS = ("eyJ", "eyA", "ewk", "ewo", "ew0")
_SIGNED = re.compile(
    rf"(?<![A-Za-z0-9_-])((?:{'|'.join(_HEADERS)})[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)"
)

_TO_PLAIN = str.maketrans("-_", "+/")
_OPENSSH = b"openssh-key-v1\0"


def _decoded(run: str) -> bytes | None:
    compact = _BREAK.sub("", run)
    try:
        return base64.b64decode(compact + "=" * (-len(compact) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first byte and end of the ASN.1 element at ``at``; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def is_private_key(data: bytes) -> bool:
    """A DER sequence that starts with a small version and holds key fields to its last byte."""
    top = _element(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    at, tags = top[1], []
    while at < top[2]:
        field = _element(data, at, top[2])
        if not field:
            return False
        if not tags and not (field[0] == 0x02 and field[2] - field[1] == 1 and data[field[1]] <= 3):
            return False
        tags.append(field[0])
        at = field[2]
    # PKCS#1 holds integers, SEC 1 an octet string, PKCS#8 an algorithm and an octet string
    return tags[1:] == [0x02] * 8 or tags[1:2] == [0x04] or tags[1:3] == [0x30, 0x04]


def outer_size(head: bytes) -> int | None:
    """Bytes of an ASN.1 sequence with its tag and length, from its first six bytes."""
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[0] != 0x30 or n > 4:
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def without_next_lines(run: str, bits: int = 6) -> str:
    """A run of several lines, up to the line end at which the outer ASN.1 length ends, if any.

    A character stands for ``bits`` bits: six in base64, four in hexadecimal digits.
    """
    if not _BREAK.search(run):
        return run
    size = outer_size(base64.b64decode(run[:8]) if bits == 6 else bytes.fromhex(run[:12]))
    if size is None:
        return run
    # characters of the key without padding; line ends lie between them
    left, upto = -(-size * 8 // bits), 0
    for gap in [*_BREAK.finditer(run), None]:
        here = (gap.start() if gap else len(run)) - upto
        if here >= left:
            return run[: upto + left] if here == left else run
        left -= here
        upto = gap.end() if gap else len(run)
    return run


def is_openssh_key(data: bytes) -> bool:
    """Cipher, derivation and options as length-prefixed fields, then the number of keys."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data):
            return False
    return at + 4 <= len(data) and int.from_bytes(data[at : at + 4], "big") >= 1


def is_signed_token(header: str) -> bool:
    try:
        said = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        # no JSON, or nested too deep for a header
        return False
    return isinstance(said, dict) and isinstance(said.get("alg"), str)


def _encoded_runs(text: str) -> list[tuple[int, str, bytes]]:
    """Start, characters and bytes of all runs that can be decoded."""
    digits = ((m.start(), without_next_lines(m[0], 4)) for m in _HEX_BYTES.finditer(text))
    runs = [(start, run, bytes.fromhex(_BREAK.sub("", run))) for start, run in digits]
    encoded = ((m.start(), without_next_lines(m[0])) for m in _BASE64.finditer(text))
    runs += [(start, run, data) for start, run in encoded if (data := _decoded(run))]
    for m in _BASE64_URL.finditer(text):
        if data := _decoded(m[0].translate(_TO_PLAIN)):
            runs.append((m.start(), m[0], data))
    return runs


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text, in order."""
    if not text:
        return []
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [
            (m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20
        ]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    runs = _encoded_runs(text) if _LONG.search(text) else []
    for start, run, data in runs:
        kind = "der" if is_private_key(data) else "openssh" if is_openssh_key(data) else None
        if kind:
            found.append((start, start + len(run), kind))
    if any(header in text for header in _HEADERS):
        found += [
            (m.start(), m.end(), "jwt") for m in _SIGNED.finditer(text) if is_signed_token(m[1])
        ]
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(
            [[{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t)] for t in texts],
            index=texts.index,
        )


def _spans(text: Column) -> Column:
    return F.pandas_udf(_found, "array<struct<start:long,end:long,kind:string>>")(text)



def scan(docs: DataFrame, out: str = "spans") -> DataFrame:
    """The documents with the array ``out`` of their secrets (start, end, kind)."""
    return docs.withColumn(out, _spans(F.col("text")))


def masked(text: str | None, mask: str) -> str | None:
    """The text with every secret replaced; overlapping spans give one mask."""
    parts, upto = [], 0
    for start, end, _ in find_secrets(text):
        if start >= upto:
            parts += [text[upto:start], mask]
        upto = max(upto, end)
    return "".join([*parts, text[upto:]]) if parts else text


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mask``.

    ``n_chars``, if there is one, is counted again where something was masked.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([masked(t, mask) for t in texts], index=texts.index, dtype=object)

    name = free_name(docs, "masked_text")
    both = docs.withColumn(name, F.pandas_udf(lean(run), "string")(F.col("text")))
    new = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        count = F.char_length(name).cast(docs.schema["n_chars"].dataType)
        same = F.col(name).eqNullSafe(F.col("text"))
        new["n_chars"] = F.when(same, F.col("n_chars")).otherwise(count)
    return both.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )


def digest(scanned: DataFrame, spans: str = "spans") -> DataFrame:
    """The contract's columns from what ``scan`` returns."""
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col(spans)).alias("spans"),
    )
