"""Visible text and words of HTML, as plain Python over strings; used inside Arrow batches."""

from __future__ import annotations

import html
import re

#: A tag begins with a letter, a slash, an exclamation mark or a question mark; other angle brackets are text.
MARKUP = re.compile(r"<!--.*?-->|<[a-zA-Z/!?][^>]*>", re.DOTALL)
#: Characters without width.
ZERO_WIDTH = re.compile("[​‌‍‎‏⁠﻿­᠎]")
WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_TYPOGRAPHIC = re.compile("[\u2010-\u2027\u2030-\u205e\u00a0\u00a1\u00ab\u00b4\u00b7\u00bb\u00bf]")


def visible_text(source: str | None) -> str:
    """HTML with tags and comments as blanks, entities decoded, zero-width characters dropped, trimmed; '' for null."""
    if not source:
        return ""
    if "<" in source:
        source = MARKUP.sub(" ", source)
    if "&" in source:
        source = html.unescape(source)
    if not source.isascii():
        source = ZERO_WIDTH.sub("", source)
    return source.strip()


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    text = text.lower()
    if not text.isascii():
        text = _TYPOGRAPHIC.sub(" ", text)
        if not text.isascii():
            return WORD.findall(text)
    return text.encode().translate(_ASCII).decode().split()
