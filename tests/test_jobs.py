import os

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import joins, quality
from cohortspark.plans import embedding, narrative, reports, retrieval
from cohortspark.sources import readers, schemas, writers
from cohortspark.streaming.embed import embed_stream

ADM = "admission_ID long, newpatient_ID string, admission_date timestamp, age_at_test double, icu int, charlson_category string"


def admissions(spark):
    df = spark.createDataFrame([(1, "P1", "2020-03-01", 39.5, 2, "x"), (2, None, None, None, None, None), (None, "P3", "2020-01-01", 1.0, 1, "y")],
                               ADM.replace("admission_date timestamp", "admission_date string"))
    return readers.coerce_records(df)


def test_narrative_rules(spark):
    epi = readers.coerce_records(spark.createDataFrame(
        [(1, 2.0, "2020-02-01", "B", "m{Linezolid:R}", "Vancomycin:S; Vancomycin:S; Ampicillin:R"),
         (1, 1.0, None, "late", None, None), (1, 1.0, "2020-03-04", "A", None, "Vancomycin:S; Vancomycin:S; Ampicillin:R"),
         (2, None, "2020-03-04", "Z", None, None)],
        "admission_ID long, BSI_episode_num double, test_date string, BSI_episode_short string, AST_ab_result_by_microbe string, AST_ab_result_list_episode string"))
    got = {r["admission_ID"]: r for r in narrative.build(admissions(spark), epi).collect()}
    one = got[1]["text"]
    assert "Age group: ≥85" in one and "icu: no" in one and "Charlson categories: x" in one and "P1" not in one
    assert "Episode: 1\n- Timing: hospital day 3\n- Organism: A" in one and "Episode: 2\n- Timing: hospital day 0\n" in one
    assert "  o Vancomycin: S\n  o Vancomycin: S\n  o Ampicillin: R\n\nEpisode: 2" in one and one.endswith("  o NA\n")
    assert got[2]["text"].endswith("[Bloodstream infection episodes]\n") and got[2]["patient_id"] == "NA"
    report = {r["admission_ID"]: r["text"] for r in narrative.build(admissions(spark), epi, variant="report").collect()}
    assert "Patient pseudo-ID: P1" in report[1] and report[1].count("  o Ampicillin: R\n  o Vancomycin: S") == 2
    none = narrative.build(admissions(spark), epi.filter("false"), max_n=1).collect()
    assert len(none) == 1 and none[0]["text"].endswith("No BSI episodes recorded (NA)\n")
    only = narrative.build(admissions(spark), epi, ids=spark.createDataFrame([(2,)], "admission_ID long")).collect()
    assert [r["admission_ID"] for r in only] == [2]


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"doc_id": "a", "patient_uid": "p", "timepoint": "t", "split": "s", "retrieval_text": " x  y ", "metadata": {"split": "development", "hospital_code": "h"}}\n\n'
                    '{"doc_id": "b", "patient_uid": "p", "timepoint": "t", "split": "s", "retrieval_text": "long text"}\n')
    docs = readers.document_frame(readers.read_json_lines(spark, str(good), schemas.DOCUMENTS), truncate_chars=4)
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert rows["a"]["split"] == "development" and rows["b"]["split"] == "s" and rows["a"]["text_embedded"] == "x y" and rows["b"]["text_embedded"] == "long"
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "bad.jsonl"), schemas.DOCUMENTS).collect()
    (tmp_path / "empty.jsonl").write_text("\n\n")
    with pytest.raises(ValueError):
        readers.read_json_lines(spark, str(tmp_path / "empty.jsonl"), schemas.DOCUMENTS)


def test_record_and_text_files(spark, tmp_path):
    (tmp_path / "adm.csv").write_text("newpatient_ID,admission_ID,admission_date,age_at_test,extra\nP1,12.0,2020-01-05,40.5,z\nP2,x,bad,,\n")
    rows = readers.read_records(spark, str(tmp_path / "adm.csv"), schemas.ADMISSIONS).collect()
    assert rows[0]["admission_ID"] == 12 and rows[0]["admission_date"].year == 2020 and rows[0]["age_at_test"] == 40.5
    assert rows[1]["admission_ID"] is None and rows[1]["admission_date"] is None and rows[0]["extra"] == "z"
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "P_1_7.narrative.md").write_text("line 1\nline 2")
    (tmp_path / "n" / "odd.narrative.md").write_text("x")
    (tmp_path / "n" / "other.txt").write_text("x")
    texts = {r["admission_ID"]: r for r in readers.read_texts(spark, str(tmp_path / "n")).collect()}
    assert set(texts) == {"7", "NA"} and texts["7"]["patient_ID"] == "P_1" and texts["7"]["text"] == "line 1\nline 2"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        writers.write_table(df, path, fmt)
        with pytest.raises(Exception):
            writers.write_table(df, path, fmt)
        writers.write_table(df, path, fmt, overwrite=True)
    found = readers.read_optional(spark, {"a": str(tmp_path / "parquet"), "b": str(tmp_path / "nothing"), "c": str(tmp_path / "none.csv")})
    assert list(found) == ["a"] and found["a"].count() == 2
    sharded = writers.assign_shards(df, ["id"], shard_size=1)
    writers.write_shards(sharded, str(tmp_path / "shards"))
    back = readers.read_vectors(spark, str(tmp_path / "shards"))
    assert [tuple(r) for r in back.select("id", "shard_id", "row_in_shard").orderBy("id").collect()] == [(1, 0, 0), (2, 1, 0)]
    assert writers.first_free_shard(back) == 2 and writers.first_free_shard(None) == 0 and writers.first_free_shard(back.limit(0)) == 0
    assert '"n":2' in writers.manifest_json(df.agg(F.count("*").alias("n")), seed=42).first()[0]


def test_validations(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", ""), (None, "z"), ("c", None)], "doc_id string, text string")
    got = {r["rule"]: (r["n"], r["examples"]) for r in quality.validate_documents(docs, "doc_id", "text").collect()}
    assert got == {"duplicate_key": (2, "a"), "empty_text": (1, "b"), "missing_key": (1, ""), "missing_text": (1, "c")}
    with pytest.raises(ValueError, match="duplicate_key"):
        quality.validate_documents(docs, "doc_id", "text", strict=True)
    with pytest.raises(ValueError, match="not unique"):
        joins.left_one_to_one(docs, docs.limit(0), "doc_id")
    clean = docs.filter("text = 'x'")
    assert quality.validate_documents(clean, "doc_id", "text", strict=True).count() == 0


def test_embedding_resume_equals_one_run(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    embedder = embedding.HashedTextEmbedder(16)
    whole = embedding.run(docs, "doc_id", "text", embedder, shard_size=50)
    first = embedding.run(docs.filter("doc_id < 70"), "doc_id", "text", embedder, shard_size=50)
    second = embedding.run(docs, "doc_id", "text", embedder, first, shard_size=50)
    a = {r["doc_id"]: r["embedding"] for r in whole.collect()}
    b = {r["doc_id"]: r["embedding"] for r in first.unionByName(second).collect()}
    assert a == b and second.agg(F.min("shard_id")).first()[0] == 2
    norms = [sum(x * x for x in v) for v in a.values()]
    assert all(abs(n - 1) < 1e-5 or n == 0 for n in norms)
    fitted = embedder.fit(docs, "text")
    assert fitted(docs, "text", "v").select("v").first()["v"] != a[0]
    plug = embedding.function_embedder(lambda texts: [[len(x), 1.0] for x in texts], "lengths")
    lengths = {r["doc_id"]: r["v"][0] for r in plug(docs, "text", "v").collect()}
    assert lengths == {r["doc_id"]: float(len(r["text"])) for r in docs.collect()}


def test_stream_writes_each_key_once(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    embedder = embedding.HashedTextEmbedder(8)

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(source)
        embed_stream(spark, source, docs.schema, sink, state, embedder).awaitTermination()
        return spark.read.parquet(sink)

    assert arrive(docs.filter("doc_id < 50")).count() == 50
    again = arrive(docs.filter("doc_id >= 30").unionByName(docs.filter("doc_id = 60")))
    assert again.count() == docs.count() == again.select("doc_id").distinct().count()
    batch = {r["doc_id"]: r["v"] for r in embedder(docs, "text", "v").collect()}
    assert {r["doc_id"]: r["embedding"] for r in again.collect()} == batch


def test_stream_passes_a_key_once_over_batches_and_restarts(spark, tmp_path):
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = "doc_id long, text string"
    batches = [[(1, "a"), (2, "b"), (2, "b"), (None, "n")], [(2, "late"), (3, "c")], [(1, "x"), (3, "y"), (4, "d"), (5, None)], [(5, "again")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if n % 2:
            embed_stream(spark, source, spark.createDataFrame([], schema).schema, sink, state, embedding.ProjectedTextEmbedder(8),
                         max_files=1, shard_size=2).awaitTermination()
    got = sorted((r["doc_id"], r["batch"], r["shard_id"], r["row_in_shard"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, 0, 0, 0), (2, 0, 0, 1), (3, 1, 1, 0), (4, 2, 2, 0), (5, 2, 2, 1)]


def test_projection_is_a_product_with_a_sign_matrix(spark):
    import hashlib
    import math
    import re

    texts = ["one two two three", None, "", "?!", "Ünïcode 数 ABC abc", "one " * 500, "x" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: list(r["v"]) for r in embedding.ProjectedTextEmbedder(8, 3)(df, "text", "v").select("id", "v").collect()}
    for i, text in enumerate(texts):
        total = [0.0] * 8
        for word in re.findall(r"[^\W_]+", (text or "").lower()):
            for n in range(3):
                code = int(hashlib.md5(f"{word}/{n}".encode()).hexdigest()[:8], 16) % 16
                total[code % 8] += 1 if code < 8 else -1
        size = math.sqrt(sum(v * v for v in total)) or 1.0
        assert got[i] == pytest.approx([v / size for v in total], abs=1e-6)


def test_manifest_of_many_values(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "MOST_LISTED", 5)
    df = spark.createDataFrame([(i % 40, f"k{i % 3}", "t" * i) for i in range(200)], "a int, b string, text string")
    made = quality.text_length_manifest(df, "text", ["a", "b"], str(tmp_path)).first()
    assert made["b_values"] == ["k0", "k1", "k2"] and made["a_values"] is None and made["n_docs"] == 200
    table = spark.read.parquet(made["a_values_table"]).orderBy("position").collect()
    assert [(r["position"], r["value"]) for r in table] == list(enumerate(sorted(str(i) for i in range(40))))


def test_retrieval_edges(spark):
    corpus = spark.createDataFrame([(1, "p1", "t", "development", [1.0, 0.0]), (2, "p2", "t", "other", [0.0, 1.0])],
                                   "doc_id long, patient_uid string, timepoint string, split string, embedding array<double>")
    queries = corpus.select((F.col("doc_id") + 10).alias("doc_id"), "patient_uid", "timepoint", "split", F.transform("embedding", lambda x: -x).alias("embedding"))
    labels = spark.createDataFrame([(1, 1.0), (11, 0.0)], "doc_id long, y_true double")
    got = {r["query_doc_id"]: r for r in retrieval.run(queries, corpus, labels, 5)["summary"].collect()}
    # no positive similarity: the weighted risk falls back to the plain mean of the labelled neighbours
    assert got[11]["retrieval_neighborhood_risk_weighted"] == 1.0 and got[11]["n_neighbors_found"] == 2
    assert got[12]["neighbor_y_true_list"] == "1.0|nan" and got[12]["query_y_true"] is None and got[12]["top1_neighbor_doc_id"] == 1
    none = retrieval.run(queries, corpus.limit(0), labels, 5)["summary"].collect()
    assert all(r["n_neighbors_found"] == 0 and r["neighbor_doc_ids"] == "" and r["top1_similarity"] is None for r in none)
    assert [tuple(r) for r in retrieval.split_warning(corpus).collect()] == [("other", 1)]
    bundle = {r["check"]: r["value"] for r in retrieval.bundle_report(corpus, corpus, "doc_id", "m1", "m2").collect()}
    assert bundle["embedding_model_differs"] == 1 and bundle["duplicate_keys"] == 0
    records = corpus.withColumn("retrieval_text", F.lit(" a  b "))
    prepared = retrieval.prepare(records.drop("embedding"), embedding.HashedTextEmbedder(4))
    assert prepared["validation"].count() == 0 and prepared["documents"].count() == 2 and '"n_docs":2' in prepared["manifest"].first()[0]


def test_reports_leave_out_what_is_missing(spark):
    assert reports.tables({}) == {} and reports.plot_data({}) == {}
    summary = spark.createDataFrame([(0, 5), (1, 2)], "cluster_label int, n int")
    mortality = spark.createDataFrame([(1, 2), (2, 9)], "cluster int, n int")
    table = reports.tables({"summary": summary, "mortality": mortality})["table1_cluster_characterization"]
    assert {(r["cluster"], r["n_clustered"], r["n"]) for r in table.collect()} == {(0, 5, None), (1, 2, 2), (2, None, 9)}


def test_checkpoint_folder_comes_from_the_session(spark):
    from cohortspark.runtime import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark)
    assert folder and ensure_checkpoint_dir(spark) == folder
    assert os.path.isdir(folder.replace("file:", ""))


def test_projection_hashes_a_word_once(monkeypatch):
    import hashlib

    import pyarrow as pa

    asked = []
    monkeypatch.setattr(embedding.hashlib, "md5", lambda b, md5=hashlib.md5: asked.append(b) or md5(b))
    sums = embedding._projected(8, 3)(pa.array([["", "one", "two", "one"], [], ["one"] * 50, [""]]))
    assert len(asked) == 9 and len(sums) == 4 and sum(abs(x) for x in sums[2].as_py()) > 0
    assert sums[1].as_py() == [0.0] * 8 == sums[3].as_py()


def test_stream_query_deals_an_arrival_over_files(spark, tmp_path, monkeypatch):
    from catalog import vectors
    from catalog.registry import Tables

    docs = [(i, None if i % 50 == 0 else f"text {i} " * (i % 7)) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    files = []

    def counted(session, source, *args, **options):
        files.append(spark.read.parquet(source).select(F.input_file_name().alias("f")).distinct().count())
        return embed_stream(session, source, *args, **options)

    monkeypatch.setattr(vectors, "embed_stream", counted)
    found = []
    for rows in (20_000, 100):
        monkeypatch.setattr(vectors, "FILE_DOCUMENTS", rows)
        found.append(sorted(tuple(r) for r in vectors.embed_stream_documents(Tables(spark, str(tmp_path))).collect()))
    assert files == [2, 3, 8, 12] and found[0] == found[1] and {r[2] for r in found[0]} == {0, 1, 2}


def test_episodes_are_shuffled_once(spark):
    """As rows of the input and by admission; neither their texts nor the admissions travel again."""
    epi = spark.createDataFrame([(1, 1, "2020-03-04", "A")], "admission_ID long, BSI_episode_num int, test_date string, BSI_episode_short string")
    built = narrative.build(admissions(spark), readers.coerce_records(epi))
    assert built._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    dealt = narrative.build(admissions(spark), readers.coerce_records(epi).repartition("admission_ID"))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_first_row_within_a_key(spark):
    import random

    draw = random.Random(5)
    parts = [None, float("nan"), 0.0, -0.0, 1.0, 2.0]
    rows = [(draw.choice([None, 1, 2, 3]), draw.choice(parts), draw.choice([None, 1, 2, 3]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, p double, t int, i int").repartition(4)
    order = [("t", True), ("i", True)]
    got, want = (sorted(r["i"] for r in f.collect()) for f in (joins.first_row_within(df, "k", "p", order), joins.first_row(df, ["k", "p"], order)))
    assert got == want and len(got) == len({(k, str(p).replace("-", "")) for k, p, _, _ in rows})
