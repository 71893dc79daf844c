"""Python operators on malformed and extreme texts: no crash, and time in proportion."""

from __future__ import annotations

import base64
import random
import time

import pytest

from factorloom.llm.html_extract import main_text
from factorloom.llm.secret_scan import find_secrets


@pytest.mark.parametrize(
    "broken",
    ["<![foo[ x ]]>", "<![ ", "<![", "<![ ]>", "<!doctype [ <!x", "<!ENTITY %", "<![CDATA[ z", "<!--", "</", "<a b='"],
)
def test_malformed_declarations(broken):
    body = "A long line of prose that is the main text of this page, with many words in it. " * 3
    page = f"<html><body><article><p>{body}</p>{broken}</article></body></html>"
    assert body.strip() in main_text(page)
    main_text(broken)
    main_text(broken * 500)


@pytest.mark.parametrize("unit", ["<b>|</i>", "<b>|<p></p>", "<div>|</span>", "<li>|<li>", "<b>|</b>", "<p><i>|</p>"])
def test_many_tags_take_linear_time(unit):
    opens, closes = unit.split("|")

    def seconds(n):
        start = time.perf_counter()
        main_text(opens * n + "text " + closes * n)
        return time.perf_counter() - start

    seconds(500)
    small, large = seconds(4_000), seconds(32_000)
    assert large < 30 * small + 1


def test_deep_json_in_a_token_header():
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 10_000).decode().rstrip("=")
    assert "ey" == deep[:2]
    find_secrets(f"token {deep}.eyJhIjoxfQ.c2lnbmF0dXJl and more")
    wrapped = base64.urlsafe_b64encode(b'{"a":' + b"[" * 50_000 + b"]" * 50_000 + b"}").decode().rstrip("=")
    find_secrets(f"{wrapped}.eyJhIjoxfQ.c2lnbmF0dXJl")


def test_random_bytes_and_long_lines():
    rng = random.Random(5)
    for _ in range(200):
        text = bytes(rng.randrange(256) for _ in range(400)).decode("latin-1")
        main_text(text)
        find_secrets(text)
    main_text("<p>" + "word " * 1_000_000)
    find_secrets("abc def " * 500_000)
