"""Declarative table rules: strict columns, coercion, domains, bounds, warnings, required levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Raised once, with every failed check; ``failures`` holds ``(column, check, count)``."""

    def __init__(self, failures: list[tuple[str, str, int]]):
        self.failures = failures
        super().__init__("; ".join(f"{c}: {check} failed for {n}" for c, check, n in failures))


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    nullable: bool = False
    allowed: tuple | None = None
    above: float | None = None
    low: float | None = None
    high: float | None = None
    bounds_severity: str = "error"
    warn_above: float | None = None
    must_contain: str | None = None


@dataclass(frozen=True)
class Check:
    column: str
    name: str
    severity: str
    fails: Column


# The schema of the patient table and of a scoring record.
SMOKING = ("formerly smoked", "never smoked", "smokes", "Unknown")
GENDER = ("Male", "Female")
WORK = ("Private", "Self-employed", "Govt_job", "children", "Never_worked")
RESIDENCE = ("Urban", "Rural")
MARRIED = ("Yes", "No")
PATIENT_FIELDS = (
    Field("gender", "string", allowed=GENDER),
    Field("age", "double", above=0),
    Field("hypertension", "int", allowed=(0, 1)),
    Field("heart_disease", "int", allowed=(0, 1)),
    Field("ever_married", "string", allowed=MARRIED),
    Field("work_type", "string", allowed=WORK),
    Field("Residence_type", "string", allowed=RESIDENCE),
    Field("avg_glucose_level", "double", above=0, warn_above=300),
    Field("bmi", "double", nullable=True, above=0),
    Field("smoking_status", "string", allowed=SMOKING, must_contain="Unknown"),
    Field("stroke", "int", allowed=(0, 1)),
)
RECORD_FIELDS = (
    Field("gender", "string", allowed=(*GENDER, "Other")),
    Field("age", "double", low=0, high=120),
    Field("hypertension", "int"),
    Field("heart_disease", "int"),
    Field("ever_married", "string", allowed=MARRIED),
    Field("work_type", "string", allowed=WORK),
    Field("Residence_type", "string", allowed=RESIDENCE),
    Field("avg_glucose_level", "double", low=0, high=500),
    Field("bmi", "double", nullable=True, low=10, high=100),
    Field("smoking_status", "string", allowed=SMOKING),
)


def column_differences(df: DataFrame, fields: Sequence[Field], optional: Sequence[str] = ()) -> list[tuple[str, str]]:
    """V1: columns that are missing or not declared; metadata only."""
    declared = [f.name for f in fields]
    missing = [(c, "missing") for c in declared if c not in df.columns and c not in optional]
    return missing + [(c, "undeclared") for c in df.columns if c not in declared and c not in optional]


def coerced(field: Field) -> Column:
    """V2: the value in its declared type, NULL where it cannot be converted. NaN counts as missing."""
    value = F.col(field.name).try_cast(field.dtype)
    if field.dtype in ("double", "float"):
        return F.when(~F.isnan(value), value)
    return value


def known(field: Field) -> Column:
    raw = F.col(field.name)
    if field.dtype == "string":
        return raw.isNotNull()
    return raw.isNotNull() & ~F.coalesce(F.isnan(raw.try_cast("double")), F.lit(False))


def checks(fields: Sequence[Field]) -> list[Check]:
    """V2-V6 as failing conditions; a NULL value only fails the not-null check."""
    out: list[Check] = []
    for f in fields:
        value = coerced(f)
        out.append(Check(f.name, f"type {f.dtype}", "error", known(f) & value.isNull()))
        if not f.nullable:
            out.append(Check(f.name, "not null", "error", ~known(f)))
        if f.allowed is not None:
            out.append(Check(f.name, "allowed values", "error", ~value.isin(*f.allowed)))
        if f.above is not None:
            out.append(Check(f.name, f"greater than {f.above:g}", "error", ~(value > f.above)))
        if f.low is not None and f.high is not None:
            out.append(Check(f.name, f"between {f.low:g} and {f.high:g}", f.bounds_severity,
                             ~value.between(f.low, f.high)))
        if f.warn_above is not None:
            out.append(Check(f.name, f"greater than {f.warn_above:g} is an outlier", "warn", value > f.warn_above))
    return [replace(c, fails=F.coalesce(c.fails, F.lit(False))) for c in out]


def report(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """V8: every check in one pass: ``(column_name, check_name, severity, n_failed)``."""
    todo = checks(fields)
    levels = [f for f in fields if f.must_contain is not None]
    counts = [F.count_if(c.fails).alias(f"c{i}") for i, c in enumerate(todo)]
    counts += [F.count_if(F.col(f.name) == f.must_contain).alias(f"l{i}") for i, f in enumerate(levels)]

    def row(column, check, severity, n):
        return F.struct(F.lit(column).alias("column_name"), F.lit(check).alias("check_name"),
                        F.lit(severity).alias("severity"), n.alias("n_failed"))

    rows = [row(c.column, c.name, c.severity, F.col(f"c{i}")) for i, c in enumerate(todo)]
    rows += [row(f.name, f"must contain {f.must_contain}", "error", (F.col(f"l{i}") == 0).cast("long"))
             for i, f in enumerate(levels)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def coerce(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    return df.withColumns({f.name: coerced(f) for f in fields if f.name in df.columns})


def validate(df: DataFrame, fields: Sequence[Field] = PATIENT_FIELDS, keys: Sequence[str] = ()) -> DataFrame:
    """V1-V8: raise one error with all failures, or return the coerced table."""
    failures = [(c, f"{why} column", 1) for c, why in column_differences(df, fields, keys)]
    present = [f for f in fields if f.name in df.columns]
    failures += [(r["column_name"], r["check_name"], r["n_failed"]) for r in report(df, present)
                 .filter((F.col("n_failed") > 0) & (F.col("severity") == "error")).collect()]
    if failures:
        raise ValidationError(failures)
    return coerce(df, fields)


def annotate(df: DataFrame, fields: Sequence[Field], name: str = "errors") -> DataFrame:
    """Every row with the list of its errors; absent nullable columns are added as NULL."""
    for f in fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dtype))
    messages = [F.when(c.fails, F.lit(f"{c.column}: {c.name}")) for c in checks(fields) if c.severity == "error"]
    return df.withColumn(name, F.array_compact(F.array(*messages)))


def split_rows(df: DataFrame, fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """The valid rows in their declared types, and the rejected rows with their errors."""
    marked = annotate(df, fields)
    valid = coerce(marked.filter(F.size("errors") == 0).drop("errors"), fields)
    return valid, marked.filter(F.size("errors") > 0)


def failing_values(df: DataFrame, fields: Sequence[Field], key: str) -> DataFrame:
    """One row per failed check and row: ``(key, column_name, check_name, severity, value)``."""
    hits = [F.when(c.fails, F.struct(F.lit(c.column).alias("column_name"), F.lit(c.name).alias("check_name"),
                                     F.lit(c.severity).alias("severity"), F.col(c.column).cast("string").alias("value")))
            for c in checks(fields)]
    return df.select(key, F.inline(F.array_compact(F.array(*hits))))


def outlier_examples(df: DataFrame, key: str, column: str, threshold: float, examples: int = 5) -> DataFrame:
    """V6: how many values lie above the threshold, with the first few in key order; never fails."""
    hits = df.filter(F.col(column) > threshold)
    first = (hits.select(key, column).orderBy(key).limit(examples)
             .agg(F.array_sort(F.collect_list(F.struct(key, column))).alias("e")))
    counted = hits.agg(F.count("*").alias("n_outliers"))
    text = F.array_join(F.transform("e", lambda e: F.round(e[column], 2).cast("string")), ", ")
    name = F.lit(column).alias("column_name")
    return counted.select(name, "n_outliers").join(first.select(name, text.alias("examples")), "column_name")


class MissingLevel(ValueError):
    """A required level does not occur; ``levels`` is the table of all levels found with their counts."""

    def __init__(self, column: str, level: str, levels: DataFrame):
        self.levels = levels
        super().__init__(f"{column} must contain {level!r}; levels found: {[r[column] for r in levels.orderBy(column).toLocalIterator()]}")


def require_level(df: DataFrame, column: str, level: str) -> DataFrame:
    """V7: raise, naming the levels found, unless ``level`` occurs in ``column``."""
    levels = df.groupBy(column).agg(F.count("*").alias("n"))
    if levels.filter(F.col(column) == level).isEmpty():
        raise MissingLevel(column, level, levels)
    return df


def drop_key(df: DataFrame, key: str, drop: bool = True) -> DataFrame:
    """Drop the key column by flag; all other columns stay."""
    if not drop or key not in df.columns:
        return df
    out = df.drop(key)
    assert len(out.columns) == len(df.columns) - 1, f"dropping {key} changed other columns"
    return out


def verify_shape(before: DataFrame, after: DataFrame, dropped: Sequence[str] = ()) -> DataFrame:
    """``after`` has the rows of ``before``, and its columns but for the dropped ones; counts both."""
    want = [c for c in before.columns if c not in dropped]
    assert after.columns == want, f"columns changed: {sorted(set(want) ^ set(after.columns))}"
    n, m = before.count(), after.count()
    assert n == m, f"{n} rows became {m}"
    return after


def merge_rare(df: DataFrame, column: str = "gender", level: str = "Other", target: str = "Female",
               max_count: int = 2) -> DataFrame:
    """Move ``level`` into ``target`` when it occurs at most ``max_count`` times."""
    count = df.filter(F.col(column) == level).limit(max_count + 1).count()
    if not 1 <= count <= max_count:
        return df
    return df.withColumn(column, F.when(F.col(column) == level, target).otherwise(F.col(column)))


def missing_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of NULL or NaN cells in a feature table."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in columns]
    total = bad[0]
    for b in bad[1:]:
        total = total + b
    return df.agg(total.alias("n_missing"))


def verify_complete(df: DataFrame, columns: Sequence[str]) -> bool:
    n = missing_cells(df, columns).first()["n_missing"]
    assert n == 0, f"{n} missing values after preparation"
    return True
