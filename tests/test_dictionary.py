import pytest

from threadloom import cli
from threadloom.plans import dictionary, explore_table
from threadloom.sinks import publish, workbook
from threadloom.sources import files, paths

from conftest import rows_of


def entry(number, name, **more):
    row = {c: "x" for c in dictionary.CATALOGUE}
    row |= {"catalogue_id": f"C{number:03}", "characteristic": name, "source_name_v5": f"old_{name}", "implementation_status": "Implemented", "current_output_field": name, "characteristic_group": "Non-calculated"}
    return row | more


def tables(spark, entries, names, sample=None):
    catalogue = spark.createDataFrame([tuple(e.values()) for e in entries], ", ".join(f"{c} string" for c in dictionary.CATALOGUE))
    schema = spark.createDataFrame([(str(i), n, *["x"] * (len(dictionary.SCHEMA) - 2)) for i, n in enumerate(names, 1)], ", ".join(f"{c} string" for c in dictionary.SCHEMA))
    return catalogue, schema, spark.createDataFrame([tuple("1" for _ in names)], ", ".join(f"{n} string" for n in sample or names))


GOOD = [entry(1, "a"), entry(2, "b"), entry(3, "c", implementation_status="Needs source review", current_output_field="", source_name_v5="")]


def test_rules(spark):
    catalogue, schema, sample = tables(spark, GOOD, ["a", "b"])
    dictionary.check(catalogue, schema, sample)
    assert [tuple(r)[:4] for r in dictionary.current_output(schema, catalogue).collect()] == [(1, "a", "C001", "x"), (2, "b", "C002", "x")]
    broken = {
        "empty_value": dict(definition=" "), "unknown_status": dict(implementation_status="Maybe"), "unknown_group": dict(characteristic_group="?"), "implemented_without_field": dict(current_output_field=""), "repeated_identifier": dict(catalogue_id="C001"),
        "identifiers_not_consecutive": dict(catalogue_id="C009"), "repeated_name": dict(characteristic="a"), "repeated_field": dict(current_output_field="a"), "repeated_source_name": dict(source_name_v5="new; old_a"), "identifier_form": dict(catalogue_id=None),
    }
    for rule, change in broken.items():
        with pytest.raises(dictionary.BrokenDictionary, match=rule):
            dictionary.check(*tables(spark, [GOOD[0], GOOD[1] | change, GOOD[2]], ["a", "b"]))
    with pytest.raises(dictionary.BrokenDictionary, match="field_without_implementation"):
        dictionary.check(*tables(spark, [*GOOD[:2], GOOD[2] | dict(current_output_field="c")], ["a", "b"]))
    with pytest.raises(dictionary.BrokenDictionary, match=r"produced_but_not_implemented \(1\), sample_columns"):
        dictionary.check(*tables(spark, GOOD, ["a", "b", "d"], ["a", "d", "b"]))
    with pytest.raises(dictionary.BrokenDictionary, match="no_rows"):
        dictionary.check(catalogue.where("false"), schema, sample)
    with pytest.raises(dictionary.BrokenDictionary, match="columns do not match"):
        dictionary.check(catalogue.drop("notes"), schema, sample)


def test_workbook_command(spark, tmp_path):
    inputs = []
    for name, df in zip(("catalogue", "schema", "sample"), tables(spark, GOOD, ["a", "b"])):
        inputs.append(str(tmp_path / f"{name}.tsv"))
        publish.write_tsv(inputs[-1], df.collect(), df.columns)
    out = str(tmp_path / "d.xlsx")
    assert cli.main(["dictionary", *inputs, out, "--check"], spark) == 1  # there is none yet
    assert cli.main(["dictionary", *inputs, out], spark) == 0 and cli.main(["dictionary", *inputs, out, "--check"], spark) == 0
    values = workbook.read_workbook(out)
    assert list(values) == ["Overview", "Characteristic catalogue", "Current output", "Current sample"]
    assert values["Current sample"] == [["a", "b"], ["1", "1"]] and ["implementation_status: Implemented", "2"] in values["Overview"]
    changed = tables(spark, [GOOD[0] | dict(notes="new"), *GOOD[1:]], ["a", "b"])[0]
    publish.write_tsv(inputs[0], changed.collect(), changed.columns)
    assert cli.main(["dictionary", *inputs, out, "--check"], spark) == 1


def test_settings_and_status(spark):
    assert explore_table.checked_settings("a.tsv", "b.tsv")["max_pairs"] == 20
    for bad in (dict(min_tag_questions=0), dict(min_observations=2), dict(max_cases=True), dict(alpha=0), dict(min_absolute_rho=1.1), dict(export="a.tsv"), dict(export="./a.tsv")):
        with pytest.raises(ValueError):
            explore_table.checked_settings("a.tsv", **bad)
    with pytest.raises(TypeError):
        explore_table.checked_settings("a.tsv", alpha="0.05")
    status = explore_table.run_status(spark, {"one": spark.range(3), "two": spark.range(0)})
    assert rows_of(status) == [(0, "one", "completed", 3), (1, "two", "no data", 0)]
    assert rows_of(explore_table.status_tally(status)) == [("completed", 1), ("no data", 1)] and explore_table.run_status(spark, {}).count() == 0


def test_paths_with_a_scheme(spark, tmp_path):
    """Guards, status and publication go through Spark's file systems where a path has a scheme."""
    folder = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError, match="a.tsv"):
        files.required(folder, ["a.tsv"])
    publish.write_tsv(f"{folder}/a.tsv", [(1, None)], ["x", "y"])
    publish.write_tsv(f"{folder}/a.tsv", [(2, None)], ["x", "y"])
    assert (tmp_path / "a.tsv").read_bytes() == b"x\ty\r\n2\t\r\n" and not list(tmp_path.glob("*.part"))
    assert files.required(folder, ["a.tsv"]) == {"a.tsv": f"{folder}/a.tsv"} and files.status(f"{folder}/a.tsv")["size_bytes"] == 9
    assert files.read_tsv(spark, f"{folder}/a.tsv").count() == 1 and paths.real(f"{folder}/a.tsv") == paths.real(str(tmp_path / "a.tsv"))
    with pytest.raises(FileExistsError):
        publish.guard([f"{folder}/a.tsv"])
    with pytest.raises(ValueError):
        publish.guard([str(tmp_path / "a.tsv")], [f"{folder}/a.tsv"], overwrite=True)
