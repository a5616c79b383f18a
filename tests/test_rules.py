"""Loading and validation of the patient table."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators import profile, rules
from cohortry.sources import readers

COLUMNS = ["id", *[f.name for f in rules.PATIENT_FIELDS]]
GOOD = [
    (1, "Male", 67.0, 0, 1, "Yes", "Private", "Urban", 228.69, "36.6", "formerly smoked", 1),
    (2, "Female", 61.0, 0, 0, "Yes", "Self-employed", "Rural", 202.21, "N/A", "never smoked", 1),
    (3, "Male", 80.0, 0, 1, "Yes", "Private", "Rural", 105.92, "32.5", "never smoked", 1),
    (4, "Female", 49.0, 0, 0, "No", "Private", "Urban", 171.23, "34.4", "smokes", 0),
    (5, "Other", 35.0, 0, 0, "No", "Govt_job", "Rural", 85.5, "25.0", "Unknown", 0),
]


def write(tmp_path, rows, columns=COLUMNS):
    path = tmp_path / "patients.csv"
    path.write_text("\n".join([",".join(columns), *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(path)


def changed(row, **values):
    out = list(row)
    for k, v in values.items():
        out[COLUMNS.index(k)] = v
    return tuple(out)


def test_valid_file(spark, tmp_path):
    df = readers.load_patients(spark, write(tmp_path, GOOD))
    assert (df.count(), len(df.columns)) == (5, 11)
    assert dict(df.dtypes)["age"] == "double" and dict(df.dtypes)["stroke"] == "int"
    assert df.filter(F.col("bmi").isNull()).count() == 1
    assert df.filter(F.col("gender") == "Female").count() == 3


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.load_patients(spark, str(tmp_path / "none.csv"))


def test_key_kept(spark, tmp_path):
    df = readers.load_patients(spark, write(tmp_path, GOOD), validate=False, drop_id=False)
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3, 4, 5]


def test_missing_tokens(spark, tmp_path):
    rows = [changed(GOOD[0], bmi=t) for t in ("N/A", "n/a", "NA", "", "NaN", "25.5")]
    found = readers.load_patients(spark, write(tmp_path, rows), validate=False).select("bmi").collect()
    assert [r["bmi"] for r in found] == [None] * 5 + [25.5]


@pytest.mark.parametrize("change,column", [
    ({"age": -5}, "age"), ({"age": 0}, "age"), ({"avg_glucose_level": -50}, "avg_glucose_level"), ({"stroke": 2}, "stroke"),
    ({"smoking_status": "invalid_status"}, "smoking_status"), ({"gender": "X"}, "gender"), ({"bmi": -1}, "bmi"),
    ({"age": "old"}, "age"), ({"age": ""}, "age"), ({"work_type": "Freelancer"}, "work_type"),
])
def test_bad_value(spark, tmp_path, change, column):
    path = write(tmp_path, [*GOOD, changed(GOOD[0], **change)])
    with pytest.raises(rules.ValidationError) as error:
        readers.load_patients(spark, path)
    assert {c for c, _, _ in error.value.failures} == {column}


def test_all_failures_at_once(spark, tmp_path):
    path = write(tmp_path, [*GOOD, changed(GOOD[0], age=-1, stroke=7), changed(GOOD[1], age=-2)])
    with pytest.raises(rules.ValidationError) as error:
        readers.load_patients(spark, path)
    assert sorted(error.value.failures) == [("age", "greater than 0", 2), ("stroke", "allowed values", 1)]


def test_required_level(spark, tmp_path):
    with pytest.raises(ValueError, match="Unknown"):
        readers.load_patients(spark, write(tmp_path, GOOD[:4]))
    df = readers.read_csv(spark, write(tmp_path, GOOD[:4]))
    with pytest.raises(ValueError, match="never smoked"):
        rules.require_level(df, "smoking_status", "Unknown")


def test_extra_and_missing_columns(spark, tmp_path):
    df = rules.merge_rare(readers.read_csv(spark, write(tmp_path, GOOD))).drop("id", "bmi").withColumn("extra", F.lit(1))
    with pytest.raises(rules.ValidationError) as error:
        rules.validate(df)
    assert {(c, w) for c, w, _ in error.value.failures} == {("bmi", "missing column"), ("extra", "undeclared column")}


def test_outlier_only_warns(spark, tmp_path):
    path = write(tmp_path, [*GOOD, changed(GOOD[0], id=6, avg_glucose_level=350), changed(GOOD[0], id=7, avg_glucose_level=400)])
    df = readers.load_patients(spark, path, drop_id=False)
    assert df.count() == 7
    row = rules.outlier_examples(df, "id", "avg_glucose_level", 300).first()
    assert (row["n_outliers"], row["examples"]) == (2, "350.0, 400.0")
    warned = rules.report(df, rules.PATIENT_FIELDS).filter("severity = 'warn'").first()
    assert warned["n_failed"] == 2


def test_infant_and_all_levels(spark, tmp_path):
    rows = [changed(GOOD[0], age=0.5, smoking_status=s) for s in rules.SMOKING]
    df = readers.load_patients(spark, write(tmp_path, rows))
    assert {r["smoking_status"] for r in df.collect()} == set(rules.SMOKING)


def test_rare_level_only_when_rare(spark, tmp_path):
    rows = [*GOOD, *[changed(GOOD[4], id=10 + i) for i in range(2)]]
    kept = rules.merge_rare(readers.read_csv(spark, write(tmp_path, rows)))
    assert kept.filter("gender = 'Other'").count() == 3


def test_scoring_rules(spark):
    good = {"gender": "Other", "age": 0, "hypertension": 0, "heart_disease": "1", "ever_married": "Yes", "work_type": "Private",
            "Residence_type": "Urban", "avg_glucose_level": 200, "smoking_status": "smokes"}
    cases = {"good": good, "age": {**good, "age": 121}, "glucose": {**good, "avg_glucose_level": 501}, "bmi": {**good, "bmi": 5},
             "text": {**good, "age": "x"}, "absent": {k: v for k, v in good.items() if k != "gender"}, "nan": {**good, "bmi": float("nan")}}
    df = readers.from_records(spark, list(cases.values()))
    marked = rules.annotate(df, rules.RECORD_FIELDS).collect()
    errors = {name: row["errors"] for name, row in zip(cases, marked)}
    assert errors["good"] == [] and errors["nan"] == []
    assert errors["age"] == ["age: between 0 and 120"] and errors["bmi"] == ["bmi: between 10 and 100"]
    assert errors["text"] == ["age: type double"] and errors["absent"] == ["gender: not null"]
    valid, rejected = rules.split_rows(df, rules.RECORD_FIELDS)
    assert (valid.count(), rejected.count()) == (2, 5)


def test_json_records(spark):
    df = spark.createDataFrame([(1, '{"gender":"Male","age":55}'), (2, "not json")], "n int, body string")
    rows = {r["n"]: r for r in readers.parse_json(df, "body").collect()}
    assert rows[1]["gender"] == "Male" and rows[1]["_corrupt"] is None and rows[2]["_corrupt"] == "not json"


def test_summary(spark, tmp_path):
    df = readers.load_patients(spark, write(tmp_path, GOOD))
    found = {(r["section"], r["name"]): r["value"] for r in
             profile.table_summary(df, "stroke", ["age", "avg_glucose_level"], ("avg_glucose_level", 300)).collect()}
    assert found[("shape", "rows")] == 5 and found[("missing", "bmi")] == 1 and found[("median", "age")] == 61.0
    assert found[("label", "1")] == 3 and found[("outliers", "avg_glucose_level")] == 0


def test_verify_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, float("nan"))], "a double, b double")
    assert rules.missing_cells(df, ["a", "b"]).first()["n_missing"] == 2
    with pytest.raises(AssertionError):
        rules.verify_complete(df, ["a", "b"])
    assert rules.verify_complete(df.limit(1), ["a", "b"])


def test_one_class_raises(spark):
    with pytest.raises(Exception, match="only one class"):
        profile.class_balance(spark.createDataFrame([(0,), (0,)], "y int"), "y").collect()


def test_shape_after_loading(spark, tmp_path):
    df = readers.load_patients(spark, write(tmp_path, GOOD), check_shape=True)
    assert (df.count(), len(df.columns)) == (5, 11)
    raw = readers.read_csv(spark, write(tmp_path, GOOD))
    assert rules.verify_shape(raw, raw.drop("id"), ["id"]).count() == 5
    with pytest.raises(AssertionError, match="5 rows became 2"):
        rules.verify_shape(raw, raw.limit(2))
    with pytest.raises(AssertionError, match="columns changed"):
        rules.verify_shape(raw, raw.drop("age"))
