"""Text queries: orders as admissions, line items as episodes, documents as free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import Tables, long, query
from cohortspark.functions import packed, text
from cohortspark.operators import quality
from cohortspark.operators.summary import first_ids
from cohortspark.plans import narrative

EPISODE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def admissions(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("admission_ID"), F.col("c_name").alias("newpatient_ID"),
        F.col("o_orderdate").alias("admission_date"), (F.round(F.col("o_totalprice") / 5000, 1)).alias("age_at_test"),
        F.col("o_orderstatus").alias("sex"), F.col("c_mktsegment").alias("treatment_department_eng"),
        F.col("o_orderpriority").alias("charlson_category"), F.col("c_nationkey").cast("double").alias("charlson_score"),
        F.col("c_nationkey").alias("icu"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("int")).alias("ventilator"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("SBP"), F.col("o_totalprice").alias("CRP"),
        (F.col("o_orderstatus") == "O").cast("int").alias("VRE_colonization"),
        F.when(F.col("c_nationkey") > 0, (F.col("c_nationkey") < 9).cast("int")).alias("carbaab_empiric"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_orderpriority"), F.lit(" plan"))).alias("ab_admission_name_clean"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("fungemia"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("fungemia_organism"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("fungemia_date"))


def _drug(flag: str):
    return F.when(F.col(flag) == "R", "Meropenem").when(F.col(flag) == "A", "Ampicillin").otherwise("Linezolid")


def episodes(t: Tables) -> DataFrame:
    # dealt by admission before the packed texts are made of them: these are three times as long
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).repartition("l_orderkey")
    pair = F.concat(_drug("l_returnflag"), F.lit(":"), F.col("l_returnflag"))
    return joined.select(
        F.col("l_orderkey").alias("admission_ID"), F.col("l_linenumber").alias("BSI_episode_num"),
        F.col("l_shipdate").alias("test_date"), F.col("p_type").alias("BSI_episode_short"),
        (F.col("l_returnflag") == "R").cast("int").alias("BSI_episode_polymicrobial"),
        (F.col("l_linestatus") == "F").cast("int").alias("BSI_episode_3GCR"),
        F.when(F.col("l_discount") > 0, F.concat_ws(", ", "p_name", "p_type", "p_name")).alias("ab_empiric72_name_clean"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit(" , "), F.col("p_brand"), F.lit(","))).alias("ab_empiric24_name_clean"),
        F.when(F.col("l_linestatus") == "F", F.concat(
            F.col("p_brand"), F.lit("{"), pair, F.lit("; Vancomycin : S;} | bad | "), F.col("p_type"), F.lit("{ na }")))
        .alias("AST_ab_result_by_microbe"),
        F.concat(F.lit("Tetracycline:I; "), pair, F.lit("; Cefotaxime:a:b; Tetracycline:I; none")).alias("AST_ab_result_list_episode"),
        *EPISODE_ORDER)


ADM = """
adm AS (SELECT o_orderkey AS id, c_name AS pid, o_orderdate AS d, round(o_totalprice / 5000, 1) AS age, o_orderstatus AS st,
               c_mktsegment AS seg, o_orderpriority AS pri, c_nationkey AS nk, c_acctbal AS bal, o_totalprice AS price
        FROM orders JOIN customer ON o_custkey = c_custkey)"""
BAND = """CASE WHEN age < 18 THEN '<18' WHEN age BETWEEN 18 AND 39 THEN '18–39' WHEN age BETWEEN 40 AND 64 THEN '40–64'
          WHEN age BETWEEN 65 AND 74 THEN '65–74' WHEN age BETWEEN 75 AND 84 THEN '75–84' ELSE '≥85' END"""
YES = "CASE WHEN {0} = 1 THEN 'yes' WHEN {0} IS NULL THEN 'NA' ELSE 'no' END"
EPI = """
epi AS (SELECT l_orderkey AS id, l_linenumber AS ep, l_shipdate AS t, p_type, p_name, p_brand, l_returnflag AS rf, l_linestatus AS ls,
               l_discount AS disc, l_tax AS tax,
               CASE l_returnflag WHEN 'R' THEN 'Meropenem' WHEN 'A' THEN 'Ampicillin' ELSE 'Linezolid' END AS drug,
               row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity,
                                  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
        FROM lineitem JOIN part ON l_partkey = p_partkey),
ep1 AS (SELECT *, chr(10) AS nl,
               CASE WHEN disc > 0 THEN '  o Antibiotic_1: ' || p_name || chr(10) || '  o Antibiotic_2: ' || p_type
                    WHEN tax > 0 THEN '  o Antibiotic_1: ' || p_brand ELSE {no_drug} END AS drugs,
               CASE WHEN ls = 'F' THEN (CASE WHEN rf = 'N' THEN '' ELSE '  o ' || drug || ': ' || rf || chr(10) END) || '  o Vancomycin: S'
                    ELSE {flat} END AS ast
        FROM epi WHERE rn = 1)"""
FLAT_RAW = """'  o Tetracycline: I' || chr(10) || (CASE WHEN rf = 'N' THEN '' ELSE '  o ' || drug || ': ' || rf || chr(10) END)
              || '  o Cefotaxime: a:b' || chr(10) || '  o Tetracycline: I'"""
FLAT_SORTED = """(CASE WHEN rf = 'A' THEN '  o Ampicillin: A' || chr(10) ELSE '' END) || '  o Cefotaxime: a:b' || chr(10)
              || (CASE WHEN rf = 'R' THEN '  o Meropenem: R' || chr(10) ELSE '' END) || '  o Tetracycline: I'"""
BLOCKS = """
txt AS (SELECT ep1.id, ep, concat_ws(chr(10), 'Episode: ' || ep, '- Timing: hospital day ' || greatest(0, date_diff('day', adm.d, t)),
               '{organism}: ' || p_type, '- Polymicrobial: ' || CASE WHEN rf = 'R' THEN 'yes' ELSE 'no' END,
               '- BSI_episode_3GCR: ' || CASE WHEN ls = 'F' THEN 'yes' ELSE 'no' END, '- BSI_episode_CarbaR: NA', '- BSI_episode_MRSA: NA',
               '- BSI_episode_VRE: NA', '- BSI_episode_CeftriaxoneR: NA', '- BSI_episode_CRAB: NA', '{empiric}', drugs,
               '- AST (selected antibiotics):', ast) AS b
        FROM ep1 JOIN adm ON ep1.id = adm.id),
blk AS (SELECT id, string_agg(b, chr(10) || chr(10) ORDER BY ep) AS body FROM txt GROUP BY id)"""
LABS = "CRP: ' || price::VARCHAR, 'Creatinine: NA', 'T_Bilirubin: NA', 'PLT_Count: NA', 'Albumin: NA', 'Hemoglobin: NA"

NARRATIVE = f"""
WITH {ADM}, {EPI.format(no_drug="'  o Antibiotic_1: NA'", flat=FLAT_RAW)},
{BLOCKS.format(organism='- Organism', empiric='- Early empiric antibiotics (≤72h):')}
SELECT adm.id AS "admission_ID", pid AS patient_id, concat_ws(chr(10), '[Case]',
  '[Administrative information (de-identified)]', 'Age group: ' || {BAND}, 'Sex: ' || st, 'Admission year: ' || year(d),
  'Treatment department: ' || seg, '[Comorbidities]', 'Infectious ICD categories: NA', 'All ICD10 codes: NA',
  'Charlson categories: ' || pri, 'Charlson score: ' || nk::DOUBLE::VARCHAR, '[Organ support and severity scores]',
  'icu: ' || {YES.format('nk')}, 'Vasopressin_any: NA', CASE st WHEN 'F' THEN 'ventilator: yes' WHEN 'O' THEN 'ventilator: no' END,
  'sofa_score_2: NA', 'sepsis_2: NA', 'quick_sofa_score_2: NA', 'sepsis_quicksofa_2: NA', '[Physiology and labs]',
  'SBP: ' || CASE WHEN bal >= 0 THEN bal::VARCHAR ELSE 'NA' END, 'RR: NA', 'PR: NA', 'Body_temperature: NA', 'GCS_2: NA', 'WBC_Count: NA',
  '{LABS}', '[Colonization and resistance flags]', 'VRE_colonization: ' || (st = 'O')::INT,
  'carbaab_empiric: ' || CASE WHEN nk > 0 THEN ((nk < 9)::INT)::VARCHAR ELSE 'NA' END,
  '[Bloodstream infection episodes]', coalesce(body, 'No BSI episodes recorded (NA)')) || chr(10) AS text
FROM adm LEFT JOIN blk ON adm.id = blk.id"""

REPORT = f"""
WITH {ADM}, {EPI.format(no_drug="'  o NA'", flat=FLAT_SORTED)},
{BLOCKS.format(organism='- Organism summary', empiric='- Early empiric antibiotics (≤72h concept):')}
SELECT adm.id AS "admission_ID", pid AS patient_id, concat_ws(chr(10), '[Case]',
  '[Administrative information (de-identified)]', 'Patient pseudo-ID: ' || pid, 'Age group: ' || {BAND}, 'Sex: ' || st,
  'Admission year: ' || year(d), 'Treatment department: ' || seg,
  '[Fungemia (known at or before index culture)]', 'Fungemia: ' || CASE WHEN pri = '1-URGENT' THEN 'yes' ELSE 'no' END,
  CASE WHEN pri = '1-URGENT' THEN 'Fungemia organism: ' || CASE WHEN bal >= 0 THEN seg ELSE 'NA' END END,
  CASE WHEN pri = '1-URGENT' THEN 'Fungemia timing: ' || CASE WHEN nk > 3 THEN 'hospital day ' || nk ELSE 'NA' END END,
  '[Comorbidities]', 'Infectious ICD categories: NA', 'All ICD10 codes (during admission): NA',
  'Charlson categories: ' || pri, 'Charlson score: ' || nk::DOUBLE::VARCHAR,
  '[Organ support and severity scores (at index time if available)]',
  'icu: ' || {YES.format('nk')}, 'Vasopressin_any: NA', CASE st WHEN 'F' THEN 'ventilator: yes' WHEN 'O' THEN 'ventilator: no' END,
  'sofa_score_2: NA', 'sepsis_2: NA', 'quick_sofa_score_2: NA', 'sepsis_quicksofa_2: NA',
  '[Physiology and labs (available at index time if provided)]',
  'SBP: ' || CASE WHEN bal >= 0 THEN bal::VARCHAR ELSE 'NA' END, 'RR: NA', 'PR: NA', 'Body_temperature: NA', 'GCS_2: NA', 'WBC_Count: NA',
  '{LABS}', 'AST: NA', 'ALT: NA', '[Colonization and resistance/spectrum flags]', 'VRE_colonization: ' || (st = 'O')::INT,
  'carbaab_empiric: ' || CASE WHEN nk > 8 THEN 'no' WHEN nk > 0 THEN 'yes' ELSE 'NA' END,
  '[Bloodstream infection episodes (microbiology/AST)]', coalesce(body, 'No BSI episodes recorded for this admission (NA)'),
  CASE WHEN st = 'F' THEN '[Additional structured metadata (filtered)]' || chr(10) || 'ab_admission_name_clean: ' || pri || ' plan' END) || chr(10) AS text
FROM adm LEFT JOIN blk ON adm.id = blk.id"""


@query("narrative_build", NARRATIVE)
def narrative_build(t):
    return narrative.build(admissions(t), episodes(t), episode_order=EPISODE_ORDER)


@query("report_build", REPORT)
def report_build(t):
    return narrative.build(admissions(t), episodes(t), variant="report", transaminases=True, episode_order=EPISODE_ORDER)


@query("ast_pairs", f"""
WITH {EPI.format(no_drug="''", flat="''")}
SELECT id AS "admission_ID", ep AS episode, CASE WHEN ls = 'F' THEN (CASE WHEN rf = 'N' THEN '' ELSE drug || ':' || rf || '|' END) || 'Vancomycin:S' ELSE '' END AS packed_pairs,
  'Tetracycline:I|' || (CASE WHEN rf = 'N' THEN '' ELSE drug || ':' || rf || '|' END) || 'Cefotaxime:a:b|Tetracycline:I' AS flat_pairs,
  CASE WHEN ls = 'F' THEN least(p_brand, p_type) || '|' || greatest(p_brand, p_type) ELSE '' END AS groups,
  CASE WHEN disc > 0 THEN p_name || '|' || p_type WHEN tax > 0 THEN p_brand ELSE '' END AS drugs FROM ep1""")
def ast_pairs(t):
    first = narrative.episode_rows(episodes(t), "admission_ID", EPISODE_ORDER)
    first = packed.with_blocks(narrative.with_episode_lists(first, report=False), "AST_ab_result_by_microbe", "_blocks")

    def shown(pairs):
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit(":"), p["result"])), "|")

    groups = F.array_sort(F.map_keys(packed.blocks_map(F.col("_blocks"))))
    return first.select("admission_ID", F.col("BSI_episode_num").alias("episode"),
                        shown(packed.block_pairs(F.col("_blocks"))).alias("packed_pairs"),
                        shown(packed.shown(packed.flat_pairs(F.col("AST_ab_result_list_episode")))).alias("flat_pairs"),
                        F.array_join(groups, "|").alias("groups"), F.array_join("_drugs", "|").alias("drugs"))


@query("flags_and_bands", f"""
WITH {ADM} SELECT id AS admission, {BAND} AS age_band, {YES.format('nk')} AS icu,
  CASE WHEN st IN ('F') THEN 'no' WHEN st = 'O' THEN 'yes' ELSE 'NA' END AS word_flag,
  CASE WHEN bal >= 0 AND bal < 1 THEN 'no' WHEN bal >= 1 AND bal < 2 THEN 'yes' ELSE 'no' END AS number_flag,
  price::VARCHAR AS price_text, (price * 100000)::VARCHAR AS large_text, (bal / 1000000)::VARCHAR AS small_text, year(d)::VARCHAR AS year_text FROM adm""")
def flags_and_bands(t):
    adm = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    double, string, integer = (adm.schema[c].dataType for c in ("c_acctbal", "c_name", "c_nationkey"))
    word = F.when(F.col("o_orderstatus") == "F", " False ").when(F.col("o_orderstatus") == "O", "Y").otherwise("1.0")
    return adm.select(
        F.col("o_orderkey").alias("admission"), text.band(F.round(F.col("o_totalprice") / 5000, 1)).alias("age_band"),
        text.yes_no(F.col("c_nationkey"), integer).alias("icu"), text.yes_no(word, string).alias("word_flag"),
        text.yes_no(F.col("c_acctbal"), double).alias("number_flag"), text.value_or_na(F.col("o_totalprice"), double).alias("price_text"),
        text.value_or_na(F.col("o_totalprice") * 100000, double).alias("large_text"),
        text.value_or_na(F.col("c_acctbal") / 1000000, double).alias("small_text"), text.year_text(F.col("o_orderdate")).alias("year_text"))


@query("day_offsets", """
SELECT l_orderkey AS admission, 'hospital day ' || greatest(0, date_diff('day', o_orderdate, l_shipdate)) AS timing, count(*)::BIGINT AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def day_offsets(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    timing = text.day_offset_text(F.col("l_shipdate"), F.col("o_orderdate"))
    return joined.groupBy(F.col("l_orderkey").alias("admission"), timing.alias("timing")).agg(F.count("*").alias("n"))


@query("sanitize_lines", r"""
SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)),
  lambda x: NOT regexp_matches(x, '(in-?hospital death|30[- ]?day mortality|death date|discharge date|expired|mortality|er the)', 'i')), chr(10)) AS text
FROM documents""")
def sanitize_lines(t):
    # invented prose never holds the fixed phrases, so a common word pair is added to exercise the filter
    pattern = text.LEAK_PATTERN[:-1] + "|er the)"
    return t.documents.select("doc_id", text.drop_leaky_lines(F.col("text"), pattern).alias("text"))


@query("sanitize_reports", f"""
WITH r AS ({REPORT})
SELECT "admission_ID", text FROM r""")
def sanitize_reports(t):
    """An outcome block and a leaking last line are put into every report, then removed again."""
    built = narrative.build(admissions(t), episodes(t), variant="report", transaminases=True, episode_order=EPISODE_ORDER)
    planted = F.concat(F.regexp_replace("text", r"\n\[Comorbidities\]", "\n[outcome]\nStatus: dead\nDay: 4\n[Comorbidities]"),
                       F.lit("Note: patient Expired\n"))
    return narrative.sanitize(built.select("admission_ID", planted.alias("text")), "text")


@query("leakage_audit", f"""
WITH n AS ({NARRATIVE}), r AS ({REPORT}), a AS (SELECT "admission_ID" AS id, patient_id, text FROM n UNION ALL
  SELECT "admission_ID" + 1000000000, patient_id, text || 'length_of_stay: 4' FROM r),
h AS (SELECT id, 'own_id' AS rule FROM a WHERE contains(text, patient_id) UNION ALL
      SELECT id, 'term:' || term FROM a, (SELECT unnest(['mortality', 'death_date', 'discharge_status', 'length_of_stay', 'follow_up',
        'time_to_event', 'cluster_label', 'inhospital_mortality', 'mortality_30d', 'days_to_death']) AS term) WHERE contains(lower(text), term))
SELECT rule, count(*)::BIGINT AS n, min(id)::BIGINT AS first_id FROM h GROUP BY rule""")
def leakage_audit(t):
    built = narrative_build(t).select(F.col("admission_ID").alias("id"), "patient_id", "text")
    reports = report_build(t).select((F.col("admission_ID") + 1000000000).alias("id"), "patient_id",
                                     F.concat("text", F.lit("length_of_stay: 4")).alias("text"))
    return quality.leakage_audit(built.unionByName(reports), "text", "patient_id", "id")


CLEAN = r"trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"


@query("text_clean", f"SELECT doc_id, {CLEAN} AS text, length({CLEAN})::INT AS n FROM documents")
def text_clean(t):
    cleaned = text.clean_text(F.col("text"))
    return t.documents.select("doc_id", cleaned.alias("text"), F.length(cleaned).alias("n"))


@query("text_truncate", f"""
WITH c AS (SELECT doc_id, {CLEAN} AS c FROM documents)
SELECT doc_id, substring(c, 1, 200) AS cut, CASE WHEN length(c) <= 200 THEN c ELSE rtrim(substring(c, 1, 197)) || '...' END AS short FROM c""")
def text_truncate(t):
    return t.documents.select("doc_id", text.truncate(text.clean_text(F.col("text")), 200).alias("cut"),
                              text.ellipsis(F.col("text"), 200).alias("short"))


@query("file_name_ids", """
WITH f AS (SELECT o_orderkey, c_name || CASE WHEN o_orderstatus = 'P' THEN '-' ELSE '_' END || o_orderkey || '.narrative.md' AS name
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT name, CASE WHEN regexp_matches(name, '^(.+)_(\\d+)\\.narrative\\.md$') THEN regexp_extract(name, '^(.+)_(\\d+)\\.narrative\\.md$', 1) ELSE 'NA' END AS "patient_ID",
       CASE WHEN regexp_matches(name, '^(.+)_(\\d+)\\.narrative\\.md$') THEN regexp_extract(name, '^(.+)_(\\d+)\\.narrative\\.md$', 2) ELSE 'NA' END AS "admission_ID" FROM f""".replace("\\\\", "\\"))
def file_name_ids(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat("c_name", F.when(F.col("o_orderstatus") == "P", "-").otherwise("_"), F.col("o_orderkey").cast("string"),
                    F.lit(".narrative.md"))
    named = joined.select(name.alias("name"))
    patient, admission = text.ids_from_name(F.col("name"))
    return named.select("name", patient.alias("patient_ID"), admission.alias("admission_ID"))


@query("first_ids", "SELECT DISTINCT o_orderkey AS admission FROM orders WHERE o_orderkey IS NOT NULL ORDER BY 1 LIMIT 100")
def first_admissions(t):
    return first_ids(t.orders.select(F.col("o_orderkey").alias("admission")), "admission", 100)


@query("validation_report", """
WITH d AS (SELECT doc_id, CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN NULL ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id)
           UNION ALL SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
           UNION ALL SELECT NULL, text FROM benchmark),
k AS (SELECT doc_id, count(*) AS c FROM d WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1),
v AS (SELECT 'missing_key' AS rule, doc_id::VARCHAR AS id, 1 AS c FROM d WHERE doc_id IS NULL UNION ALL
      SELECT 'duplicate_key', doc_id::VARCHAR, c FROM k UNION ALL
      SELECT 'missing_text', doc_id::VARCHAR, 1 FROM d WHERE text IS NULL UNION ALL
      SELECT 'empty_text', doc_id::VARCHAR, 1 FROM d WHERE text = ''),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY id) AS rn FROM v)
SELECT rule, sum(c)::BIGINT AS n, coalesce(string_agg(id, '|' ORDER BY id) FILTER (rn <= 10), '') AS examples FROM r GROUP BY rule""")
def validation_report(t):
    doc = t.documents.join(t.labels, "doc_id", "left")
    broken = doc.select("doc_id", F.when(F.col("quality") == 0, "").when(F.col("toxic") == 1, None).otherwise(F.col("text")).alias("text"))
    again = doc.filter(F.col("toxic") == 1).select("doc_id", "text")
    loose = t.benchmark.select(F.lit(None).cast("long").alias("doc_id"), "text")
    return quality.validate_documents(broken.unionByName(again).unionByName(loose), "doc_id", "text")


@query("corpus_manifest", f"""
WITH c AS (SELECT {CLEAN} AS text, lang, source FROM documents)
SELECT count(*)::BIGINT AS n_docs, round(avg(length(text)), 6) AS text_char_len_mean, array_to_string(list_sort(list_distinct(list(lang))), '|') AS lang_values,
  array_to_string(list_sort(list_distinct(list(source))), '|') AS source_values,
  round(quantile_cont(length(text), 0.5), 6) AS text_char_len_median, round(quantile_cont(length(text), 0.95), 6) AS text_char_len_p95 FROM c""")
def corpus_manifest(t):
    cleaned = t.documents.select(text.clean_text(F.col("text")).alias("text"), "lang", "source")
    made = quality.text_length_manifest(cleaned, "text", ["lang", "source"])
    return made.select("n_docs", *[F.round(c, 6).alias(c) for c in ("text_char_len_mean", "text_char_len_median", "text_char_len_p95")],
                       *[F.array_join(c, "|").alias(c) for c in ("lang_values", "source_values")])


@query("nested_flatten", """
SELECT event_id, 'U' || user_id AS patient_uid, event_type AS timepoint, CASE WHEN event_type = 'error' THEN event_type ELSE json_extract_string(props, '$.k') END AS split,
  length(trim(event_type))::INT AS text_raw_n_chars, json_extract_string(props, '$.k') AS hospital_code FROM events""")
def nested_flatten(t):
    """Event properties as document metadata; metadata.split overrides the top-level split."""
    from cohortspark.sources.readers import document_frame

    k = F.from_json("props", "k string")["k"]
    kind = F.col("event_type")
    records = t.events.select(
        F.col("event_id").alias("doc_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("patient_uid"),
        kind.alias("timepoint"), kind.alias("split"), kind.alias("retrieval_text"),
        F.struct(k.alias("hospital_code"), F.when(kind != "error", k).alias("split")).alias("metadata"))
    flat = document_frame(records)
    return flat.select(long("doc_id").alias("event_id"), "patient_uid", "timepoint", "split", "text_raw_n_chars", "hospital_code")
