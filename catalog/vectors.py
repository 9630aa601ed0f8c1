"""Vector, graph, retrieval and clustering queries over the whole embeddings table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalog.registry import Tables, query, rounded
from cohortspark.functions.vectors import l2_normalize
from cohortspark.operators import approximate, density, graph, layout as lay, neighbors, spectral
from cohortspark.operators.ordered import global_row_number
from cohortspark.plans import embedding, phenotypes, retrieval
from cohortspark.runtime import cut, ensure_checkpoint_dir
from cohortspark.streaming.embed import embed_stream


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def corpus(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.concat(F.lit("D"), "vec_id").alias("doc_id"), F.concat(F.lit("P"), F.col("label").cast("string")).alias("patient_uid"),
        F.when(F.col("label") < 5, "early").otherwise("ast").alias("timepoint"), F.lit("development").alias("split"), "embedding")


def y_true(t: Tables) -> DataFrame:
    return t.labels.select(F.concat(F.lit("D"), "doc_id").alias("doc_id"), F.col("quality").alias("y_true"))


@query("l2_normalize", """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, i::INT AS i, round(x / greatest(n, 1e-12), 6) AS x FROM e""")
def l2_normalized(t):
    unit = l2_normalize(F.col("embedding"))
    return (t.embeddings.select("vec_id", F.posexplode(unit).alias("i", "x"))
            .select("vec_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x")))


SIM = """
u AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.id AS q, b.id AS c, a.label AS ql, b.label AS cl, list_inner_product(a.v, b.v) / (a.n * b.n) AS sim FROM u a CROSS JOIN u b)"""


@query("topk_neighbors", f"""
WITH {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, c) AS rank FROM s)
SELECT q AS query_id, c AS neighbor_id, rank::INT AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 5""")
def topk_neighbors(t):
    return rounded(neighbors.nearest(vectors(t), vectors(t), 5), "similarity")


LONG = f"""{SIM},
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, 'D' || c) AS rank FROM s {{where}}),
lg AS (SELECT 'D' || q AS query_doc_id, 'P' || ql AS query_patient_uid, CASE WHEN ql < 5 THEN 'early' ELSE 'ast' END AS query_timepoint,
         'development' AS query_split, a.quality::DOUBLE AS query_y_true, rank::INT AS rank, 'D' || c AS neighbor_doc_id, 'P' || cl AS neighbor_patient_uid,
         'development' AS neighbor_split, b.quality::DOUBLE AS neighbor_y_true, sim AS similarity
       FROM r LEFT JOIN labels a ON a.doc_id = q LEFT JOIN labels b ON b.doc_id = c WHERE rank <= 5)"""
SUMMARY = """
SELECT query_doc_id, any_value(query_patient_uid) AS query_patient_uid, any_value(query_timepoint) AS query_timepoint, any_value(query_split) AS query_split,
  any_value(query_y_true) AS query_y_true, 5::INT AS top_k, count(*)::BIGINT AS n_neighbors_found, max(neighbor_doc_id) FILTER (rank = 1) AS top1_neighbor_doc_id,
  round(max(similarity) FILTER (rank = 1), 6) AS top1_similarity, max(neighbor_y_true) FILTER (rank = 1) AS top1_neighbor_y_true,
  count(*) FILTER (neighbor_y_true = 1)::BIGINT AS n_positive_in_topk, round(avg(neighbor_y_true), 6) AS retrieval_neighborhood_risk_mean,
  round(CASE WHEN sum(greatest(similarity, 0)) FILTER (neighbor_y_true IS NOT NULL) > 0 THEN sum(greatest(similarity, 0) * neighbor_y_true)
    / sum(greatest(similarity, 0)) FILTER (neighbor_y_true IS NOT NULL) ELSE avg(neighbor_y_true) END, 6) AS retrieval_neighborhood_risk_weighted,
  string_agg(neighbor_doc_id::VARCHAR, '|' ORDER BY rank) AS neighbor_doc_ids, string_agg(neighbor_patient_uid, '|' ORDER BY rank) AS neighbor_patient_uids,
  string_agg(neighbor_split, '|' ORDER BY rank) AS neighbor_splits, string_agg(coalesce(neighbor_y_true::VARCHAR, 'nan'), '|' ORDER BY rank) AS neighbor_y_true_list,
  string_agg(round(similarity, 6)::VARCHAR, '|' ORDER BY rank) AS neighbor_similarity_list FROM lg GROUP BY query_doc_id"""
RISKS = ("top1_similarity", "retrieval_neighborhood_risk_mean", "retrieval_neighborhood_risk_weighted")


@query("retrieval_long", f"WITH {LONG.format(where='')} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM lg")
def retrieval_long(t):
    return rounded(retrieval.retrieve(corpus(t), corpus(t), y_true(t), 5), "similarity")


@query("retrieval_summary", f"WITH {LONG.format(where='')} {SUMMARY}")
def retrieval_summary(t):
    return rounded(retrieval.run(corpus(t), corpus(t), y_true(t), 5)["summary"], *RISKS)


@query("retrieval_datasets", f"""
WITH {LONG.format(where='WHERE (ql < 5) <> (cl < 5)')}
SELECT CASE WHEN query_timepoint = 'early' THEN 'early_in_ast' ELSE 'ast_in_early' END AS dataset, * FROM ({SUMMARY})""")
def retrieval_datasets(t):
    """Each half of the table as query set against the other half as corpus."""
    both = corpus(t)
    early, ast = both.filter(F.col("timepoint") == "early"), both.filter(F.col("timepoint") == "ast")
    runs = {"early_in_ast": (early, ast), "ast_in_early": (ast, early)}
    return rounded(retrieval.run_many(runs, y_true(t), 5)["summary"], *RISKS)


@query("neighbor_text", f"""
WITH {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, 'D' || c) AS rank FROM s),
d AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS x FROM documents)
SELECT 'D' || q AS query_doc_id, rank::INT AS rank, coalesce(CASE WHEN length(x) <= 80 THEN x ELSE rtrim(substring(x, 1, 77)) || '...' END, '') AS neighbor_text
FROM r LEFT JOIN d ON doc_id = c WHERE rank <= 3""")
def neighbor_text(t):
    both = corpus(t).join(t.documents.select(F.concat(F.lit("D"), "doc_id").alias("doc_id"), "text"), "doc_id", "left")
    found = retrieval.retrieve(both, both, y_true(t), 3, text_col="text", text_chars=80)
    return found.select("query_doc_id", "rank", "neighbor_text")


def document_records(t: Tables) -> DataFrame:
    """Documents as retrieval records with text ids; the source stands for the patient, the language for the time point."""
    return t.documents.select(F.concat(F.lit("D"), "doc_id").alias("doc_id"), F.col("source").alias("patient_uid"),
                              F.col("lang").alias("timepoint"), F.lit("development").alias("split"), F.col("text").alias("retrieval_text"))


DIMS = 16
PROJECTED = f"""
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
codes AS (SELECT doc_id, ('0x' || substr(md5(w || '/' || i), 1, 8))::BIGINT % {2 * DIMS} AS c FROM words, range(4) r(i)),
sums AS (SELECT doc_id, c % {DIMS} AS dim, sum(CASE WHEN c < {DIMS} THEN 1 ELSE -1 END)::DOUBLE AS x FROM codes GROUP BY ALL),
every AS (SELECT d.doc_id, r.i AS dim, coalesce(s.x, 0) AS x FROM documents d CROSS JOIN range({DIMS}) r(i)
  LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.dim = r.i),
vec AS (SELECT doc_id, (dim + 1)::INT AS dim, round((x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12))::FLOAT::DOUBLE, 5) AS x FROM every)"""


DOCUMENT_LONG = f"""{PROJECTED},
v AS (SELECT doc_id AS id, list(f ORDER BY dim) AS v FROM (SELECT doc_id, dim, (x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12))::FLOAT::DOUBLE AS f FROM every) GROUP BY doc_id),
u AS (SELECT id, source, lang, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS n FROM v JOIN documents ON doc_id = id),
s AS (SELECT a.id AS q, b.id AS c, a.source AS qs, b.source AS cs, a.lang AS ql, list_inner_product(a.v, b.v) / (a.n * b.n) AS sim FROM u a CROSS JOIN u b),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, 'D' || c) AS rank FROM s),
lg AS (SELECT 'D' || q AS query_doc_id, qs AS query_patient_uid, ql AS query_timepoint, 'development' AS query_split, a.quality::DOUBLE AS query_y_true,
  rank::INT AS rank, 'D' || c AS neighbor_doc_id, cs AS neighbor_patient_uid, 'development' AS neighbor_split, b.quality::DOUBLE AS neighbor_y_true, sim AS similarity
  FROM r LEFT JOIN labels a ON a.doc_id = q LEFT JOIN labels b ON b.doc_id = c WHERE rank <= 5)"""


@query("retrieval_from_documents", f"WITH {DOCUMENT_LONG} {SUMMARY}")
def retrieval_from_documents(t):
    """Records to vectors to neighbours to risks."""
    made = retrieval.prepare(document_records(t), embedding.ProjectedTextEmbedder(DIMS))
    # the search needs no texts, so they are not written once more
    corpus = cut(made["documents"].select("doc_id", "patient_uid", "timepoint", "split", "embedding"))
    return rounded(retrieval.run(corpus, corpus, y_true(t), 5)["summary"], *RISKS)


@query("approximate_neighbors")
def approximate_neighbors(t):
    """Neighbours by hash tables, with the share of the exact ones found for each query."""
    points = cut(vectors(t))
    found = cut(approximate.nearest(points, points, 5, exclude_same_id=True, bucket_rows=64))
    exact = neighbors.nearest(points, points, 5, exclude_same_id=True)
    return rounded(found.join(approximate.recall_per_query(found, exact).select("query_id", "recall"), "query_id"), "similarity")


@query("split_warning", "SELECT source AS split, count(*)::BIGINT AS n FROM documents WHERE source <> 'src0' GROUP BY source")
def split_warning(t):
    return retrieval.split_warning(t.documents.withColumn("split", F.col("source")), "src0")


@query("bundle_report", """
WITH v AS (SELECT doc_id FROM documents JOIN labels USING (doc_id))
SELECT 'metadata_rows' AS "check", count(*)::BIGINT AS value FROM documents UNION ALL SELECT 'vector_rows', count(*) FROM v
UNION ALL SELECT 'duplicate_keys', (count(*) - count(DISTINCT doc_id))::BIGINT FROM documents
UNION ALL SELECT 'missing_in_metadata', 0 UNION ALL SELECT 'extra_in_metadata', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v)
UNION ALL SELECT 'embedding_model_differs', 1""")
def bundle_report(t):
    """All documents as metadata, the labelled ones as vectors, another model in the manifest."""
    vectors_of = t.documents.join(t.labels.select("doc_id"), "doc_id")
    return retrieval.bundle_report(t.documents.select("doc_id"), vectors_of.select("doc_id"), "doc_id", "m1", "m2")


@query("knn_graph", f"""
WITH {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, c) AS rank FROM s WHERE q <> c)
SELECT q AS src, c AS dst, rank::INT AS rank, round(1 - sim, 6) AS dist FROM r WHERE rank <= 15""")
def knn_graph(t):
    return rounded(graph.knn_graph(vectors(t), 15), "dist")


EUCLID = """
u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id AS q, b.id AS c, list_distance(a.v, b.v) AS d FROM u a CROSS JOIN u b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 12), c) AS rank FROM s)"""


@query("mutual_reachability", f"""
WITH {EUCLID}, k AS (SELECT * FROM r WHERE rank <= 10), core AS (SELECT q AS id, max(d) AS core FROM k GROUP BY q),
p AS (SELECT least(q, c) AS a, greatest(q, c) AS b, min(d) AS d FROM k GROUP BY ALL)
SELECT a, b, round(greatest(d, x.core, y.core), 6) AS w FROM p JOIN core x ON x.id = a JOIN core y ON y.id = b""")
def mutual_reachability(t):
    return rounded(graph.mutual_reachability(cut(graph.knn_graph(vectors(t), 10, "euclidean")), 10), "w")


@query("components", f"""
WITH RECURSIVE {EUCLID}, e AS (SELECT q AS a, c AS b FROM r WHERE rank <= 2 UNION SELECT c, q FROM r WHERE rank <= 2),
reach AS (SELECT id AS a, id AS b FROM u UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS id, min(b)::BIGINT AS component FROM reach GROUP BY a""")
def components(t):
    knn = graph.knn_graph(vectors(t), 2, "euclidean")
    return graph.connected_components(knn.select(F.col("src").alias("a"), F.col("dst").alias("b")), vectors(t))


@query("fuzzy_graph", f"""
WITH RECURSIVE {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, c) AS rank FROM s WHERE q <> c),
k AS (SELECT q AS src, c AS dst, round(1 - round(sim, 12), 12) AS d FROM r WHERE rank <= 15),
l AS (SELECT src, list(d ORDER BY d) AS d, avg(d) AS mean, coalesce(min(d) FILTER (d > 0), 0) AS rho FROM k GROUP BY src),
g AS (SELECT src, mean, rho, list_transform(d, lambda x: greatest(x - rho, 0)) AS gap FROM l),
b AS (SELECT src, mean, rho, gap, 0 AS step, 0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1::DOUBLE AS sigma FROM g
  UNION ALL SELECT src, mean, rho, gap, step + 1, CASE WHEN above THEN low ELSE sigma END, CASE WHEN above THEN sigma ELSE high END,
    greatest(CASE WHEN NOT above AND isinf(high) THEN sigma * 2 ELSE (CASE WHEN above THEN low ELSE sigma END + CASE WHEN above THEN sigma ELSE high END) / 2 END, 1e-300)
  FROM (SELECT *, list_sum(list_transform(gap, lambda x: exp(-x / sigma))) > log2(15) AS above FROM b WHERE step < 64)),
w AS (SELECT src, rho, greatest(sigma, 1e-3 * CASE WHEN rho > 0 THEN mean ELSE (SELECT avg(d) FROM k) END) AS sigma FROM b WHERE step = 64),
a AS (SELECT src, dst, CASE WHEN d <= rho THEN 1.0 ELSE exp(-(d - rho) / sigma) END AS a FROM k JOIN w USING (src)),
p AS (SELECT src, dst, a FROM a UNION ALL SELECT dst, src, a FROM a)
SELECT src, dst, round(CASE WHEN count(*) = 1 THEN sum(a) ELSE sum(a) - min(a) * max(a) END, 6) AS weight FROM p GROUP BY src, dst""")
def fuzzy_graph(t):
    return rounded(graph.fuzzy_graph(cut(graph.knn_graph(vectors(t), 15)), 15), "weight")


def exact_tree(t: Tables, min_samples: int = 10) -> DataFrame:
    points = cut(vectors(t).withColumn("vec", F.transform("vec", lambda x: x.cast("double"))))
    knn = cut(graph.knn_graph(points, min_samples, "euclidean"))
    core = graph.core_distances(knn, min_samples)
    radius = knn.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("radius"))
    return graph.spanning_tree(graph.mutual_reachability(knn, min_samples), points.select("id"),
                               cut(points.join(core, "id")), cut(radius))


@query("spanning_forest", f"""
WITH RECURSIVE {EUCLID}, core AS (SELECT q AS id, max(d) AS core FROM r WHERE rank <= 10 GROUP BY q),
x AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM u), n AS (SELECT count(*) AS n FROM u),
m AS (SELECT a.i, list(CASE WHEN a.i = b.i THEN 'inf'::DOUBLE ELSE greatest(d, ca.core, cb.core) END ORDER BY b.i) AS far FROM x a CROSS JOIN x b
  LEFT JOIN s ON s.q = a.id AND s.c = b.id JOIN core ca ON ca.id = a.id JOIN core cb ON cb.id = b.id GROUP BY a.i),
p AS (SELECT 0 AS step, 1::BIGINT AS i, NULL::DOUBLE AS w, far AS best FROM m WHERE i = 1
  UNION ALL SELECT step + 1, j, best[j], list_transform(list_zip(best, far), lambda z: CASE WHEN z[1] = -1 THEN -1 ELSE least(z[1], z[2]) END)
  FROM (SELECT step, list_position(best, list_min(list_filter(best, lambda v: v >= 0))) AS j, best FROM (
    SELECT step, list_transform(best, lambda v, k: CASE WHEN k = p.i THEN -1 ELSE v END) AS best FROM p)) JOIN m ON m.i = j, n WHERE step < n - 1)
SELECT row_number() OVER (ORDER BY w) AS rank, round(w, 6) AS w FROM p WHERE step > 0""")
def spanning_forest(t):
    """The edge lengths in order: those of every lightest tree, whichever of equal edges it has."""
    return rounded(global_row_number(exact_tree(t).select("w"), ["w"], "rank"), "w")


@query("density_clusters")
def density_clusters(t):
    """Groups of near copies among the vectors."""
    return rounded(density.density_clusters(exact_tree(t, 2), vectors(t), min_cluster_size=3), "cluster_probability")


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    points = cut(vectors(t))
    return points, cut(graph.fuzzy_graph(cut(graph.knn_graph(points, 15)), 15))


def _coordinates(space: DataFrame, *names: str) -> DataFrame:
    return space.select("id", *[F.round(F.get("y", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


@query("layout_3d")
def layout_3d(t):
    points, weights = _graph(t)
    return _coordinates(lay.layout(weights, points, 3), "x", "y", "z")


@query("layout_2d")
def layout_2d(t):
    points, weights = _graph(t)
    return _coordinates(lay.layout(weights, points, 2), "x", "y")


@query("spectral_vectors")
def spectral_vectors(t):
    """Leading vectors of the neighbour graph with their eigenvalues and residuals."""
    _, weights = _graph(t)
    found, values = spectral.leading_vectors(weights, 3)
    known = t.spark.createDataFrame([(i + 1, v, r) for i, (v, r) in enumerate(values)], "component int, eigenvalue double, residual double")
    each = found.select("id", F.posexplode("vector").alias("at", "value")).select("id", (F.col("at") + 1).alias("component"), "value")
    return rounded(each.join(F.broadcast(known), "component"), "value", "eigenvalue", "residual")


@query("neighbour_preservation")
def neighbour_preservation(t):
    """Trustworthiness and continuity of the display layout, per row."""
    points, weights = _graph(t)
    space = cut(lay.layout(weights, points, 2))
    return rounded(lay.preservation(points, space, 15), "trustworthiness", "continuity")


@query("phenotype_clusters")
def phenotype_clusters(t):
    """Labels with outcomes, coordinates for clustering and for display."""
    outcomes = t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    found = phenotypes.phenotype(vectors(t), min_cluster_size=10, min_samples=3, outcomes=outcomes)
    both = found["labels"].join(found["coords"], "id").join(found["display"], "id")
    return rounded(both, "cluster_probability", "umap_c1", "umap_c2", "umap_c3", "umap_x", "umap_y")


@query("subgroup_clusters")
def subgroup_clusters(t):
    """The members of the subgroup, clustered on their own."""
    named = t.documents.select(F.col("doc_id").alias("id"), "lang")
    return rounded(phenotypes.subgroup(vectors(t), named, "lang", "EN")["labels"], "cluster_probability")


def _components(df: DataFrame) -> DataFrame:
    """One row per component of ``embedding``."""
    others = [c for c in df.columns if c != "embedding"]
    return df.select(*others, F.posexplode("embedding").alias("at", "x")).select(
        *others, (F.col("at") + 1).alias("dim"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("embed_batch", f"""
WITH {PROJECTED}, d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS early FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY early ORDER BY doc_id) - 1 AS n, count(*) FILTER (early) OVER () AS k FROM d)
SELECT doc_id, 'projected-words-{DIMS}' AS model, (n // 128 + CASE WHEN early THEN 0 ELSE (k + 127) // 128 END)::BIGINT AS shard_id,
  (n % 128)::BIGINT AS row_in_shard, dim, x FROM r JOIN vec USING (doc_id)""")
def embed_batch(t):
    """All documents, resumed after those with a label: model, shard positions and vectors."""
    embedder = embedding.ProjectedTextEmbedder(DIMS)
    docs = t.documents.select("doc_id", "text")
    done = cut(embedding.run(docs.join(t.labels, "doc_id", "left_semi"), "doc_id", "text", embedder, shard_size=128))
    both = done.unionByName(embedding.run(docs, "doc_id", "text", embedder, done, shard_size=128))
    return _components(both.select("doc_id", "model", "shard_id", "row_in_shard", "embedding"))


#: Which of three files a document is in; the last file holds those of the first one again.
FILE = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 3)"


#: Documents of the table per file of an arrival.
FILE_DOCUMENTS = 20_000


@query("embed_stream", f"""
WITH {PROJECTED}, f AS (SELECT doc_id, {FILE} AS batch FROM documents),
r AS (SELECT doc_id, batch, row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1 AS n FROM f),
s AS (SELECT batch, sum((c + 63) // 64) OVER (ORDER BY batch) - (c + 63) // 64 AS first FROM (SELECT batch, count(*) AS c FROM f GROUP BY batch))
SELECT doc_id, 'projected-words-{DIMS}' AS model, batch::BIGINT AS batch, (first + n // 64)::BIGINT AS shard_id, (n % 64)::BIGINT AS row_in_shard, dim, x
FROM r JOIN s USING (batch) JOIN vec USING (doc_id)""")
def embed_stream_documents(t):
    """The documents as three arrivals, the last with the keys of the first again: two batches, a restart, a third batch.

    An arrival is one file, of a large table so many files as keep them small; a batch takes the files of one arrival.
    """
    root = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    docs = t.documents.select("doc_id", "text")
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 3
    files = max(1, docs.count() // FILE_DOCUMENTS)

    def arrive(rows: DataFrame) -> None:
        # rows are dealt in turn, so each of the files gets some
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(f"{root}/files")

    def run() -> None:
        embed_stream(t.spark, f"{root}/files", docs.schema, f"{root}/sink", f"{root}/state", embedding.ProjectedTextEmbedder(DIMS),
                     max_files=files, shard_size=64).awaitTermination()

    arrive(docs.filter(part == 0))
    arrive(docs.filter(part == 1))
    run()
    arrive(docs.filter(part != 1))
    run()
    return _components(t.spark.read.parquet(f"{root}/sink").select("doc_id", "model", F.col("batch").cast("long").alias("batch"),
                                                                   "shard_id", "row_in_shard", "embedding"))
