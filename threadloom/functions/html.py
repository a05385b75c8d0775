"""One walk over an HTML fragment gives all text and markup measures; an Arrow UDF for whole columns."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ["word_count", "code_characters", "code_lines", "links", "images"]
SCHEMA = T.StructType([T.StructField("visible_text", T.StringType()), *[T.StructField(n, T.LongType()) for n in NUMBERS]])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
#: Letters and digits with inner hyphens and apostrophes, not touching an underscore or another word character.
WORD = re.compile(r"(?<!\w)[^\W_]+(?:[-'][^\W_]+)*(?!\w)")


class Walker(HTMLParser):
    """Text nodes with the elements they stand in; an end tag closes the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # name, text nodes of it
        self.nodes: list[tuple[str, bool]] = []  # text, inside code or pre
        self.code_characters = self.code_lines = self.links = self.images = 0
        self.buffer: list[str] = []

    def _flush(self) -> None:
        if not self.buffer:
            return
        text, self.buffer = "".join(self.buffer), []
        names = {e[0] for e in self.open}
        if names & HIDDEN:
            return
        self.nodes.append((text, bool(names & {"code", "pre"})))
        for element in self.open:
            if element[0] in ("code", "pre"):
                element[1].append(text)

    def _close(self, element: list) -> None:
        if element[0] == "code":
            self.code_characters += sum(map(len, element[1]))
        elif element[0] == "pre":
            self.code_lines += sum(1 for line in "\n".join(element[1]).splitlines() if line.strip())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        if tag == "a":
            self.links += any(k == "href" for k, _ in attrs)
        elif tag == "img":
            self.images += 1
        if tag not in VOID:
            self.open.append([tag, []])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if any(e[0] == tag for e in self.open):
            while True:
                element = self.open.pop()
                self._close(element)
                if element[0] == tag:
                    return

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.open:
            self._close(self.open.pop())


def _joined(nodes) -> str:
    return " ".join(" ".join(x for t in nodes if (x := t.strip())).split())


def measure(source: str | None) -> tuple[str, int, int, int, int, int]:
    """Visible text, words outside code, code characters, non-blank code lines, links, images. Null is empty."""
    if not source:
        return "", 0, 0, 0, 0, 0
    w = Walker()
    w.feed(source)
    w.finish()
    words = len(WORD.findall(_joined(t for t, code in w.nodes if not code)))
    return _joined(t for t, _ in w.nodes), words, w.code_characters, w.code_lines, w.links, w.images


@F.pandas_udf(SCHEMA)
def html_measures(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in source], columns=SCHEMA.names)
