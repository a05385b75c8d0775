"""Publication: atomic text, TSV, JSON and XML, and guards of what exists."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Sequence
from typing import Any
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources import paths

#: What XML 1.0 cannot hold.
NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def guard(outputs: Iterable[str], inputs: Iterable[str] = (), overwrite: bool = False) -> None:
    """Refuse to overwrite outputs, unless asked to, and to write over an input in any case."""
    sources = {paths.real(p) for p in inputs}
    for out in outputs:
        if paths.real(out) in sources:
            raise ValueError(f"output {out} is an input")
        if paths.exists(out) and not overwrite:
            raise FileExistsError(out)


def atomic(path: str, write: Callable[[Any], None], mode: str = "w") -> None:
    """Write beside the destination, then rename; nothing is left behind on failure. Remote paths are uploaded, then renamed."""
    folder = None if paths.is_remote(path) else os.path.dirname(os.path.abspath(path))
    if folder:
        os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, mode, **({} if "b" in mode else {"encoding": "utf-8", "newline": ""})) as f:
            write(f)
        if folder:
            os.replace(temporary, path)
        else:
            paths.publish(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def tsv_value(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value)


def tsv_line(values: Sequence[Any]) -> str:
    """Minimal quoting, doubled quotation marks."""
    cells = []
    for v in map(tsv_value, values):
        cells.append('"' + v.replace('"', '""') + '"' if any(ch in v for ch in '\t\r\n"') else v)
    return "\t".join(cells)


def write_tsv(path: str, rows: Iterable[Sequence[Any]], columns: Sequence[str], end: str = "\r\n") -> None:
    """One ordered file for results small enough for one machine; rows may be DataFrame.toLocalIterator()."""

    def write(f) -> None:
        for line in [columns]:
            f.write(tsv_line(line) + end)
        for r in rows:
            f.write(tsv_line(r) + end)

    atomic(path, write)


@F.pandas_udf(T.StringType())
def _double_text(x):
    return x.map(repr, na_action="ignore")


def tsv_column(df: DataFrame, name: str) -> Column:
    """A column as TSV text, in the JVM but for doubles, which are written as Python writes them."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType.typeName()
    text = F.when(c, "TRUE").when(~c, "FALSE") if kind == "boolean" else _double_text(c) if kind == "double" else c.cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[\t\r\n\"]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_tsv_distributed(df: DataFrame, path: str, end: str = "\r\n", overwrite: bool = False) -> None:
    """A folder of TSV parts without header, in the order of df, for tables of any size; line breaks inside fields stay as they are."""
    df.select(F.concat_ws("\t", *[tsv_column(df, c) for c in df.columns]).alias("line")).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", end).text(path)


def write_json(path: str, value: Any) -> None:
    atomic(path, lambda f: f.write(json.dumps(value, indent=2, ensure_ascii=False) + "\n"))


def _text(value: Any) -> str:
    return NOT_XML.sub("�", str(value))


def _row(parent: ET.Element, tag: str, row: Any) -> ET.Element:
    """A lossless row gives its attributes in source order, empty ones too; another row its columns that are not null."""
    values = [(a["name"], a["value"]) for a in row["attrs"]] if "attrs" in row else [(k, v) for k, v in row.asDict().items() if v is not None]
    return ET.SubElement(parent, tag, {k: _text(v) for k, v in values})


def thread_tree(threads: Iterable[Any]) -> ET.ElementTree:
    """threads/thread/question with comments and answers; containers stay when they are empty."""
    root = ET.Element("threads")
    for t in threads:
        q = _row(ET.SubElement(root, "thread"), "question", t["question"])
        comments, answers = ET.SubElement(q, "comments"), ET.SubElement(q, "answers")
        for c in t["comments"]:
            _row(comments, "comment", c)
        for a in t["answers"]:
            _row(answers, "answer", a)
    return ET.ElementTree(root)


def summary_tree(rows: Iterable[Any]) -> ET.ElementTree:
    root = ET.Element("requests")
    for r in rows:
        request = ET.SubElement(root, "request")
        for field, value in r.asDict().items():
            ET.SubElement(request, field).text = _text(value) if value else None
    return ET.ElementTree(root)


def write_xml(path: str, tree: ET.ElementTree) -> None:
    ET.indent(tree)
    atomic(path, lambda f: tree.write(f, encoding="utf-8", xml_declaration=True), "wb")
