"""Command line: build the characteristic table, extract threads or summaries from a dump folder, write the dictionary."""

from __future__ import annotations

import argparse
import re
import sys
import time
from datetime import date, datetime, timezone

from pyspark.sql import SparkSession

from threadloom.plans import dictionary
from threadloom.plans.characteristics import build, issues, raise_issues, validation
from threadloom.plans.summary import DEFAULT_FIELDS, source_threads, summaries
from threadloom.session import local_session, materialize
from threadloom.sinks import publish
from threadloom.sources import files, paths, xml

HOST = re.compile(r"^(?!-)[a-z0-9-]+(\.[a-z0-9-]+)+$")
#: Version of the published schema.
SCHEMA_VERSION = "1.1"


def _day(text: str) -> str:
    return date.fromisoformat(text).isoformat()


def _positive(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="one row per question")
    b.add_argument("dump")
    b.add_argument("output")
    b.add_argument("--site", required=True)
    b.add_argument("--snapshot", type=_day, required=True)
    b.add_argument("--start", type=_day, required=True)
    b.add_argument("--end", type=_day, required=True)
    b.add_argument("--limit", type=_positive)
    b.add_argument("--schema")
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--parts", action="store_true", help="write the table as a folder of TSV parts, without passing the driver")
    d = sub.add_parser("dictionary", help="the data dictionary as a workbook")
    for name in ("catalogue", "schema", "sample", "output"):
        d.add_argument(name)
    d.add_argument("--check", action="store_true", help="compare with the workbook that is there")
    for name in ("threads", "summaries"):
        e = sub.add_parser(name)
        e.add_argument("dump")
        e.add_argument("output")
        e.add_argument("ids", nargs="+")
        e.add_argument("--fields")
        e.add_argument("--overwrite", action="store_true")
    return p


def run_build(spark: SparkSession, a: argparse.Namespace) -> None:
    if not HOST.match(a.site):
        raise ValueError(f"not a host name: {a.site}")
    if a.start > a.end or a.snapshot < a.end:
        raise ValueError("start <= end <= snapshot must hold")
    began = time.time()
    source = files.required(a.dump, ["Posts.xml", "Comments.xml", "Votes.xml"])
    out = {k: paths.child(a.output, n) for k, n in (("table", "characteristics.tsv"), ("validation", "validation.tsv"), ("metadata", "run.json"))}
    publish.guard(out.values(), source.values(), a.overwrite)
    names = files.load_schema(a.schema)
    posts, comments, votes = (materialize(xml.read_rows(spark, source[f], attrs), f[:-4].lower()) for f, attrs in (("Posts.xml", xml.POSTS), ("Comments.xml", xml.COMMENTS), ("Votes.xml", xml.VOTES)))
    raise_issues(issues(posts, comments, votes))
    table = materialize(build(posts, comments, votes, a.snapshot, a.site, a.start, a.end, a.limit), "table")
    checks = validation(table, names).collect()
    failed = [c["check_name"] for c in checks if c["status"] == "FAIL"]
    if failed:  # before anything is written
        raise ValueError("failed: " + ", ".join(failed))
    ordered = table.select(*names).orderBy("question_creation_datetime", table["question_id"].cast("bigint"))
    if a.parts:
        publish.write_tsv_distributed(ordered, out["table"], overwrite=a.overwrite)
    else:
        publish.write_tsv(out["table"], ordered.toLocalIterator(), names)
    publish.write_tsv(out["validation"], checks, ["check", "status", "observed", "expected_or_meaning"])
    rows = int(next(c["observed"] for c in checks if c["check_name"] == "rows_produced"))
    publish.write_json(out["metadata"], {"schema_version": SCHEMA_VERSION, "schema_path": a.schema, "site": a.site, "dump_snapshot_date": a.snapshot, "question_start_date": a.start, "question_end_date": a.end, "row_limit": a.limit, "row_count": rows, "generated_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "elapsed_seconds": round(time.time() - began, 3), "python_version": sys.version.split()[0], "source_files": {n: files.status(p) for n, p in source.items()}, "validation_failures": 0, "validation_warnings": sum(c["status"] == "WARN" for c in checks)})


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    source = files.required(a.dump, ["Posts.xml", "Comments.xml"])
    publish.guard([a.output], [*source.values(), *([a.fields] if a.fields else [])], a.overwrite)
    if a.command == "summaries":
        fields = files.load_summary_fields(a.fields) if a.fields else DEFAULT_FIELDS
        posts, comments = xml.read_rows(spark, source["Posts.xml"], xml.POSTS), xml.read_rows(spark, source["Comments.xml"], xml.COMMENTS)
        keyed = {r["question_id"]: r for r in summaries(posts, comments, ["question_id", *[f for f in fields if f != "question_id"]], a.ids).collect()}
        from threadloom.operators.threads import requested

        rows = [keyed[i] for i in requested(a.ids)]
        root = publish.summary_tree(rows)
        for request in root.getroot():
            for element in [e for e in request if e.tag not in fields]:
                request.remove(element)
            request[:] = sorted(request, key=lambda e: fields.index(e.tag))
        publish.write_xml(a.output, root)
    else:
        posts, comments = (xml.read_all_attributes(spark, source[f]) for f in ("Posts.xml", "Comments.xml"))
        publish.write_xml(a.output, publish.thread_tree(source_threads(posts, comments, a.ids).collect()))


def run_dictionary(spark: SparkSession, a: argparse.Namespace) -> None:
    publish.guard([], [a.catalogue, a.schema, a.sample])
    dictionary.run(spark, a.catalogue, a.schema, a.sample, a.output, a.check)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        {"build": run_build, "dictionary": run_dictionary}.get(a.command, run_extract)(spark or local_session("threadloom-cli"), a)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
