"""Sources: CSV with missing-value tokens, JSON records, driver-side records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators import rules
from cohortry.operators.rules import Field

# Texts that mean "missing" in every column of a CSV file.
STRICT_TOKENS = ("N/A", "N/a", "n/a", "NA", "")
DEFAULT_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                  "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
MISSING_TOKENS = tuple(sorted({*STRICT_TOKENS, *DEFAULT_TOKENS}))


def read_csv(spark: SparkSession, path: str, tokens: Sequence[str] = MISSING_TOKENS, multi_line: bool = False) -> DataFrame:
    """All columns as text, missing tokens as NULL. A missing path raises FileNotFoundError.

    A line with more fields than the header, or a header that differs between files, is an error when the table is computed; a line
    with fewer fields has NULLs at its end. A quoted line break needs ``multi_line``, which keeps Spark from splitting files; without it a
    quote that is open at the end of a line is an error too. Types are not guessed from the data (that would read it
    twice); ``rules.coerce`` gives the declared ones.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "enforceSchema": False}
    try:
        header = spark.read.options(**options).csv(path).columns
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    line = "_line"
    while line in header:
        line += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, line]])
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=line).schema(schema).csv(path)
    columns = {c: F.col(f"`{c}`") for c in header}
    # marked are lines with too many and with too few fields; one field more than the header tells them apart
    wider = ", ".join(f"c{i} string" for i in range(len(header) + 1))
    surplus = F.from_csv(F.col(line), wider, {"escape": '"', "nullValue": "\0"})[f"c{len(header)}"].isNotNull()
    bad = F.when(F.col(line).isNotNull() & surplus, F.concat(F.lit("too many fields in line: "), F.col(line)))
    if not multi_line:
        for value in columns.values():
            bad = F.coalesce(bad, F.when(value.startswith('"'), F.concat(F.lit("a quote is open at the end of a line: "), value)))
    whole = raw.filter(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True))
    return whole.select([F.when(~F.trim(value).isin(*tokens), value).alias(c) for c, value in columns.items()])


def load_patients(spark: SparkSession, path: str, validate: bool = True, drop_id: bool = True,
                  fields: Sequence[Field] = rules.PATIENT_FIELDS, key: str = "id", check_shape: bool = False) -> DataFrame:
    """Read, merge the rare gender level, validate and coerce; ``drop_id`` leaves the key out. ``check_shape`` counts the rows read and
    given back, which must be the same."""
    raw = read_csv(spark, path)
    if check_shape:
        return rules.verify_shape(raw, load_patients(spark, path, validate, drop_id, fields, key), [key] if drop_id else [])
    df = rules.merge_rare(raw) if any(f.name == "gender" for f in fields) else raw
    if key in df.columns:
        df = df.withColumn(key, F.col(key).try_cast("long"))
    df = rules.drop_key(df, key, drop_id)
    return rules.validate(df, fields, keys=[key]) if validate else rules.coerce(df, fields)


def json_schema(fields: Sequence[Field]) -> T.StructType:
    """Everything as text, so that a wrong type is a finding of the rules and not a lost record."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in fields])


def parse_json(df: DataFrame, column: str, fields: Sequence[Field] = rules.RECORD_FIELDS, corrupt: str = "_corrupt") -> DataFrame:
    """JSON text to record columns; unreadable text is kept in ``corrupt``."""
    schema = json_schema(fields).add(corrupt, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    return df.withColumn("_r", F.from_json(F.col(column), schema, options)).select(*df.columns, "_r.*")


def from_records(spark: SparkSession, records: Sequence[dict], fields: Sequence[Field] = rules.RECORD_FIELDS) -> DataFrame:
    """A list of dictionaries, absent keys as NULL."""
    rows = [tuple(None if r.get(f.name) is None else str(r[f.name]) for f in fields) for r in records]
    return spark.createDataFrame(rows, json_schema(fields))
