"""Reading and writing: tables are written from the given ones into the checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from catalog.registry import Tables, query, rounded
from cohortspark.operators import quality
from cohortspark.runtime import cut, ensure_checkpoint_dir
from cohortspark.sources import readers, writers


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/files/{uuid.uuid4().hex}"


@query("csv_records", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS "admission_ID", CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::TIMESTAMP END AS admission_date,
  o_totalprice AS price, o_orderpriority AS priority FROM orders""")
def csv_records(t):
    """Orders as a CSV file with ids and dates that do not parse; its header has fewer columns than the schema, in another order."""
    path = _folder(t)
    key = F.col("o_orderkey")
    writers.write_table(t.orders.select(
        F.col("o_orderpriority").alias("priority"), F.when(key % 5 == 0, F.concat(F.lit("x"), key)).otherwise(key.cast("string")).alias("admission_ID"),
        F.when(key % 7 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("admission_date"),
        F.col("o_totalprice").alias("price")), path, "csv")
    schema = T.StructType.fromDDL("admission_ID string, admission_date string, test_date string, price double, priority string")
    found = readers.read_records(t.spark, path, schema)
    return found.select("admission_ID", F.col("admission_date").cast("timestamp_ntz").alias("admission_date"), "price", "priority")


@query("json_lines", """
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE source END AS split, lang AS timepoint, length(source)::INT AS text_raw_n_chars FROM documents""")
def json_lines(t):
    """Documents as JSON lines with nested metadata, read again and flattened."""
    path = _folder(t)
    doc = F.col("doc_id")
    writers.write_table(t.documents.select(
        doc.cast("string").alias("doc_id"), F.col("source").alias("patient_uid"), F.col("lang").alias("timepoint"), F.col("source").alias("split"),
        F.col("source").alias("retrieval_text"), F.struct(F.when(doc % 3 == 0, "test").alias("split")).alias("metadata")), path, "json")
    schema = T.StructType.fromDDL("doc_id string, patient_uid string, timepoint string, split string, retrieval_text string, metadata struct<split: string>")
    found = readers.document_frame(readers.read_json_lines(t.spark, path, schema))
    return found.select("doc_id", "split", "timepoint", "text_raw_n_chars")


@query("shards_read_back", """
WITH r AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)
SELECT vec_id, (n // 128)::BIGINT AS shard_id, (n % 128)::BIGINT AS row_in_shard, len(embedding)::INT AS dims, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM r""")
def shards_read_back(t):
    """Vectors dealt to shards, written, appended to and read again."""
    path = _folder(t)
    placed = cut(writers.assign_shards(t.embeddings.select("vec_id", "embedding"), ["vec_id"], 128))
    writers.write_shards(placed.filter("shard_id < 2"), path)
    writers.write_shards(placed.filter("shard_id >= 2"), path, append=True)
    found = readers.read_vectors(t.spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(found.select("vec_id", "shard_id", "row_in_shard", F.size("embedding").alias("dims"), total.alias("total")), "total", digits=5)


@query("overwrite_guard", """
SELECT 'first' AS attempt, count(*)::BIGINT AS n, false AS refused FROM documents UNION ALL SELECT 'again', count(*), true FROM documents
UNION ALL SELECT 'overwrite', count(*), false FROM documents WHERE lang = 'en'""")
def overwrite_guard(t):
    """Texts written, refused the second time, and replaced on demand: what stands in the folder after each attempt."""
    path, rows = _folder(t), []
    texts = t.documents.select("doc_id", "text")
    english = t.documents.filter("lang = 'en'").select("doc_id", "text")
    for attempt, df, overwrite in (("first", texts, False), ("again", english, False), ("overwrite", english, True)):
        refused = False
        try:
            writers.write_narratives(df, path, overwrite)
        except AnalysisException as err:
            if "PATH_ALREADY_EXISTS" not in str(err.getCondition()):
                raise
            refused = True
        rows.append((attempt, readers.read_vectors(t.spark, path).count(), refused))
    return t.spark.createDataFrame(rows, "attempt string, n long, refused boolean")


@query("optional_inputs", "SELECT 'nation' AS name, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def optional_inputs(t):
    """Two inputs that are there, one as CSV, and one that is not."""
    path = _folder(t) + ".csv"
    writers.write_table(t.region, path, "csv")
    found = readers.read_optional(t.spark, {"nation": f"{t.folder}/nation.parquet", "region": path, "absent": f"{t.folder}/absent.parquet"})
    out = None
    for name, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("manifest_values", "SELECT row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS position, doc_id::VARCHAR AS value FROM (SELECT DISTINCT doc_id FROM documents)")
def manifest_values(t):
    """The distinct ids of the manifest in order: too many for a list on large tables, so they are rows."""
    return quality.distinct_values(t.documents, "doc_id")
