"""The data dictionary: a catalogue of characteristics, the schema that is produced and a sample, as one workbook.

Inputs are DataFrames of text columns. Every rule is one count over them, so a broken catalogue is described in full
before anything is written; the workbook itself is for people, and its rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sinks import workbook
from threadloom.sources.files import read_tsv

#: The columns of the catalogue with their headings.
CATALOGUE = {
    "catalogue_id": "Catalogue ID", "characteristic": "Canonical characteristic", "source_name_v5": "Dictionary v5 source name", "entity": "Entity", "implementation_status": "Implementation status", "current_output_field": "Current output field", "characteristic_group": "Calculation group", "availability_stage": "Availability stage", "role": "Analytical role",
    "source": "Exact source or required evidence", "data_type": "Data type", "unit_or_values": "Unit or allowed values", "definition": "Definition", "calculation": "Calculation method", "interpretation": "Interpretation", "empty_value_meaning": "Empty-value meaning", "evidence_or_reference": "Scientific evidence or reference", "notes": "Synthesis notes",
}
OPTIONAL = ("source_name_v5", "current_output_field", "evidence_or_reference", "notes")
STATUSES = ("Implemented", "Available in current source", "Requires additional dump file", "Requires Data Explorer source", "Requires manual assessment", "Requires model evaluation", "Literature-derived candidate", "Needs source review")
GROUPS = ("Non-calculated", "Calculated by Stack Exchange", "Calculated by project", "Assessed manually", "Calculated during model evaluation")
SCHEMA = ("position", "characteristic", "characteristic_group", "availability_stage", "role", "source", "data_type", "unit_or_values", "definition", "calculation", "interpretation", "empty_value_meaning")

IMPLEMENTED = "Implemented"


class BrokenDictionary(ValueError):
    """The inputs break rules; names all of them."""


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def catalogue_rules(catalogue: DataFrame) -> DataFrame:
    """(rule, rows) of the catalogue alone: how many rows break each rule."""
    number = F.try_to_number(F.substring("catalogue_id", 2, 9), F.lit("999999999")).cast("bigint")
    implemented = F.col("implementation_status") == IMPLEMENTED
    rules = {
        "empty_value": F.array_contains(F.array(*[_blank(c) for c in CATALOGUE if c not in OPTIONAL]), True),
        "unknown_status": ~F.coalesce(F.col("implementation_status").isin(*STATUSES), F.lit(False)),
        "unknown_group": ~F.coalesce(F.col("characteristic_group").isin(*GROUPS), F.lit(False)),
        "implemented_without_field": implemented & _blank("current_output_field"),
        "field_without_implementation": ~implemented & ~_blank("current_output_field"),
        "identifier_form": ~F.coalesce(F.col("catalogue_id").rlike("^C[0-9]{3,9}$"), F.lit(False)),
    }
    n = F.count("*")
    one = catalogue.agg(
        *[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()],
        (n - F.count_distinct("catalogue_id")).alias("repeated_identifier"),
        F.when((F.min(number) == 1) & (F.max(number) == n) & (F.count_distinct(number) == n), 0).otherwise(n).alias("identifiers_not_consecutive"),
        (n - F.count_distinct("characteristic")).alias("repeated_name"),
        (F.count_if(implemented) - F.count_distinct(F.when(implemented, F.col("current_output_field")))).alias("repeated_field"),
        F.when(n == 0, 1).otherwise(0).alias("no_rows"),
    )
    names = [*rules, "repeated_identifier", "identifiers_not_consecutive", "repeated_name", "repeated_field", "no_rows"]
    alone = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("bigint").alias("rows")) for k in names])).alias("r")).select("r.*")
    sources = catalogue.select(F.explode(F.split(F.coalesce("source_name_v5", F.lit("")), "; ")).alias("name")).where("name <> ''").groupBy("name").count().where("count > 1")
    return alone.unionByName(sources.agg(F.count("*").alias("rows")).select(F.lit("repeated_source_name").alias("rule"), "rows"))


def schema_rules(catalogue: DataFrame, schema: DataFrame) -> DataFrame:
    """(rule, rows) of the schema against the catalogue."""
    place, n = F.col("position").try_cast("bigint"), F.count("*")
    own = schema.agg(
        F.when((F.min(place) == 1) & (F.max(place) == n) & (F.count_distinct(place) == n), 0).otherwise(n).alias("positions_not_consecutive"), (n - F.count_distinct("characteristic")).alias("repeated_schema_name"),
    )
    own = own.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("bigint").alias("rows")) for k in own.columns])).alias("r")).select("r.*")
    implemented = catalogue.where(F.col("implementation_status") == IMPLEMENTED).select(F.col("current_output_field").alias("name")).distinct()
    produced = schema.select(F.col("characteristic").alias("name")).distinct()
    apart = [(label, a.join(b, "name", "left_anti").agg(F.count("*").alias("rows"))) for label, a, b in (("implemented_but_not_produced", implemented, produced), ("produced_but_not_implemented", produced, implemented))]
    for label, count in apart:
        own = own.unionByName(count.select(F.lit(label).alias("rule"), "rows"))
    return own


def check(catalogue: DataFrame, schema: DataFrame, sample: DataFrame) -> None:
    """Raise with every rule that is broken."""
    if catalogue.columns != list(CATALOGUE):
        raise BrokenDictionary("the catalogue's columns do not match the contract")
    if missing := [c for c in SCHEMA if c not in schema.columns]:
        raise BrokenDictionary(f"the schema lacks {', '.join(missing)}")
    broken = [f"{r['rule']} ({r['rows']})" for r in catalogue_rules(catalogue).unionByName(schema_rules(catalogue, schema)).where("rows > 0").orderBy("rule").collect()]
    names = [r[0] for r in schema.orderBy(F.col("position").try_cast("bigint")).select("characteristic").collect()]  # a schema is read by people
    if sample.columns != names:
        broken.append("sample_columns")
    if broken:
        raise BrokenDictionary("the dictionary breaks rules: " + ", ".join(broken))


def current_output(schema: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The schema's columns in order with identifier and entity of their catalogue entries."""
    entries = catalogue.select("characteristic", "catalogue_id", "entity")
    joined = workbook.current_output(schema.select(*SCHEMA), entries, "characteristic").withColumn("position", F.col("position").cast("bigint"))
    return joined.select("position", "characteristic", "catalogue_id", "entity", *SCHEMA[2:]).orderBy("position")


def sheets(catalogue: DataFrame, schema: DataFrame, sample: DataFrame) -> dict[str, tuple[list[str], list[list]]]:
    """Overview, catalogue, current output and sample."""
    accounts = {(r["column"], r["value"]): r["n"] for r in workbook.catalogue_accounts(catalogue, "implementation_status", "characteristic_group", "entity").collect()}
    rows = lambda df: [list(r) for r in df.collect()]
    own, fields, pilot = rows(catalogue.orderBy("catalogue_id")), rows(current_output(schema, catalogue)), rows(sample)
    overview = [["characteristics", len(own)], ["fields of the current output", len(fields)], ["rows of the sample", len(pilot)]]
    overview += [[f"{column}: {value}", n] for (column, value), n in sorted(accounts.items(), key=lambda x: (x[0][0], str(x[0][1])))]
    return {
        "Overview": (["item", "value"], overview), "Characteristic catalogue": (list(CATALOGUE.values()), own),
        "Current output": (["Position", "Current output field", "Catalogue ID", "Entity", *[CATALOGUE[c] for c in SCHEMA[2:]]], fields), "Current sample": (sample.columns, pilot),
    }


def run(spark: SparkSession, catalogue: str, schema: str, sample: str, output: str, verify: bool = False) -> None:
    """Write the workbook of three TSV files, or with `verify` raise unless the one that is there has the same values."""
    tables = [read_tsv(spark, p) for p in (catalogue, schema, sample)]
    check(*tables)
    content = sheets(*tables)
    if not verify:
        workbook.write_workbook(output, content)
    elif workbook.read_workbook(output) != {name: [[workbook.shown(v) for v in row] for row in [header, *rows]] for name, (header, rows) in content.items()}:
        raise BrokenDictionary(f"{output} is out of date")
