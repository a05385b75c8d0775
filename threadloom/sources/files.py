"""Files beside the data: required ones, their status, TSV tables and configuration."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.columns import COLUMNS, SUMMARY
from threadloom.sources import paths


def required(folder: str, names: list[str]) -> dict[str, str]:
    """Paths of required files; all that are missing are named together."""
    found = {n: paths.child(folder, n) for n in names}
    missing = [n for n, p in found.items() if not paths.is_file(p)]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    return found


status = paths.status


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with a header, all columns text, quoted line breaks allowed; gzip by extension."""
    if not paths.exists(path) or paths.is_file(path) and not paths.status(path)["size_bytes"]:
        raise FileNotFoundError(f"missing or empty: {path}")
    return spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"', nullValue=None, emptyValue="", inferSchema=False, enforceSchema=False)


def _config(path: str, needed: set[str]) -> list[dict[str, str]]:
    with open(path, encoding="utf-8-sig", newline="") as f:
        reader = csv.DictReader(f, delimiter="\t")
        if missing := needed - set(reader.fieldnames or []):
            raise ValueError(f"{path}: missing columns {', '.join(sorted(missing))}")
        return list(reader)


def load_schema(path: str | None = None) -> list[str]:
    """Column names in order from a schema TSV; the built-in contract without one."""
    if path is None:
        return [n for n, _ in COLUMNS]
    rows = _config(path, {"position", "characteristic"})
    names = []
    for i, r in enumerate(rows, 1):
        name = (r["characteristic"] or "").strip()
        if not (r["position"] or "").strip().isdigit() or int(r["position"]) != i:
            raise ValueError(f"{path}: position {r['position']!r} where {i} is due")
        if not name or name in names:
            raise ValueError(f"{path}: empty or repeated name {name!r}")
        names.append(name)
    if not names:
        raise ValueError(f"{path}: no rows")
    return names


def load_summary_fields(path: str) -> list[str]:
    """The included fields of a selection TSV, in its order. Mappings are fixed; only inclusion and order may change."""
    known = {f: (r, "".join(part.capitalize() for part in a.split("_"))) for f, r, a in SUMMARY}
    chosen, seen = [], set()
    for line, r in enumerate(_config(path, {"field", "include", "source_record", "source_attribute"}), 2):
        where, field, flag = f"{path}, row {line}", (r["field"] or "").strip(), (r["include"] or "").strip().lower()
        if field not in known:
            raise ValueError(f"{where}: unknown field {field!r}")
        if field in seen:
            raise ValueError(f"{where}: repeated field {field!r}")
        if (r["source_record"], r["source_attribute"]) != known[field]:
            raise ValueError(f"{where}: changed mapping of {field!r}")
        if flag not in ("true", "false"):
            raise ValueError(f"{where}: include of {field!r} is {r['include']!r}")
        seen.add(field)
        if flag == "true":
            chosen.append(field)
    if not chosen:
        raise ValueError(f"{path}: nothing is included")
    return chosen
