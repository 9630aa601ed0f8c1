"""Readers: record tables, JSON lines, text folders, vectors and optional report inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortspark.functions.text import clean_text, ids_from_name, truncate
from cohortspark.runtime import has, present

DATE_COLUMNS = ("admission_date", "test_date")
METADATA_KEYS = ["hospital_code", "newpatient_ID", "admission_ID", "admission_year", "split"]


def to_whole_id(c: Column) -> Column:
    """Numeric id, null when it does not parse."""
    return c.try_cast("double").try_cast("long")


def coerce_records(df: DataFrame, id_col: str = "admission_ID") -> DataFrame:
    """Dates and the numeric id coerced; what does not parse becomes null."""
    out = {c: F.col(c).try_cast("timestamp") for c in present(df, list(DATE_COLUMNS))}
    if has(df, id_col):
        out[id_col] = to_whole_id(F.col(id_col))
    return df.withColumns(out)


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header (explicit schema, columns matched by name) or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return coerce_records(spark.read.parquet(path))
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if schema is None:  # one more pass over the file finds numbers among the texts
        return coerce_records(reader.option("inferSchema", True).csv(path))
    # the header may hold a subset of the known columns, in any order
    names = reader.csv(path).columns
    known = {f.name: f for f in schema.fields}
    chosen = T.StructType([known.get(n, T.StructField(n, T.StringType(), True)) for n in names])
    return coerce_records(reader.schema(chosen).csv(path))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line fails the query, an empty input is refused."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def document_frame(records: DataFrame, text_field: str = "retrieval_text", truncate_chars: int = 0) -> DataFrame:
    """Flat document table: cleaned (optionally truncated) text and the known metadata keys.

    A ``split`` inside ``metadata`` overrides the top-level one. In a table a key that is null and one that is not there are
    the same, so a null never overrides.
    """
    cleaned = clean_text(F.col(text_field))
    nested = []
    if has(records, "metadata"):
        inner = records.schema["metadata"].dataType
        nested = [k for k in METADATA_KEYS if isinstance(inner, T.StructType) and k in inner.fieldNames()]
    split = F.col("split") if has(records, "split") else F.lit(None).cast("string")
    if "split" in nested:
        split = F.coalesce(F.col("metadata.split"), split)
    return records.select(
        "doc_id", "patient_uid", "timepoint", split.alias("split"), F.lit(text_field).alias("text_field"),
        F.length(cleaned).alias("text_raw_n_chars"), truncate(cleaned, truncate_chars).alias("text_embedded"),
        *[F.col(f"metadata.{k}").alias(k) for k in nested if k != "split"])


def read_texts(spark: SparkSession, folder: str, suffix: str = ".narrative.md") -> DataFrame:
    """One row per file: path, whole text and the ids in the file name ("NA" when it does not fit)."""
    raw = (spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
           .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("_name")))
    patient, admission = ids_from_name(F.col("_name"), suffix)
    return raw.select(patient.alias("patient_ID"), admission.alias("admission_ID"), "path",
                      F.col("value").alias("text"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their metadata; both live in the same row, so nothing can be misaligned."""
    return spark.read.parquet(path)


def read_optional(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """What exists is read, a missing path is left out."""
    found = {}
    for name, path in paths.items():
        try:
            reader = spark.read
            found[name] = (reader.parquet(path) if not path.endswith(".csv")
                           else reader.option("header", True).option("inferSchema", True).csv(path))
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err.getCondition()):
                raise
    return found
