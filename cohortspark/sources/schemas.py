"""Explicit schemas of the exchange tables (CSV, JSON lines)."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, DOUBLE, STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


ADMISSIONS = _struct([
    ("admission_ID", STRING), ("newpatient_ID", STRING), ("admission_date", STRING), ("test_date", STRING),
    ("age_at_test", DOUBLE), ("sex", STRING), ("treatment_department_eng", STRING),
    ("icd_categorized_onlyinfections", STRING), ("icd_all_codes", STRING),
    ("charlson_category_withcancermerged", STRING), ("charlson_score", DOUBLE),
    ("icu", INT), ("Vasopressin_any", INT), ("ventilator", INT), ("central_orarterial_line", INT),
    ("urinary_orrenal_catheter", INT), ("sofa_score_2", DOUBLE), ("sepsis_2", DOUBLE),
    ("quick_sofa_score_2", DOUBLE), ("sepsis_quicksofa_2", DOUBLE),
    ("SBP", DOUBLE), ("RR", DOUBLE), ("PR", DOUBLE), ("Body_temperature", DOUBLE), ("GCS_2", DOUBLE),
    ("WBC_Count", DOUBLE), ("CRP", DOUBLE), ("Creatinine", DOUBLE), ("T_Bilirubin", DOUBLE),
    ("PLT_Count", DOUBLE), ("Albumin", DOUBLE), ("Hemoglobin", DOUBLE),
])

EPISODES = _struct([
    ("admission_ID", STRING), ("BSI_episode_num", INT), ("test_date", STRING),
    ("BSI_episode_short_clean", STRING), ("BSI_episode_polymicrobial", INT), ("BSI_episode_3GCR", INT),
    ("BSI_episode_CarbaR", INT), ("BSI_episode_MRSA", INT), ("BSI_episode_VRE", INT),
    ("ab_empiric72_name_clean", STRING), ("ab_empiric48_name_clean", STRING),
    ("ab_empiric24_name_clean", STRING), ("tt_ab_name_list_episode", STRING),
    ("AST_ab_result_by_microbe", STRING), ("AST_ab_result_list_episode", STRING),
])

DOCUMENT_METADATA = _struct([
    ("hospital_code", STRING), ("newpatient_ID", STRING), ("admission_ID", STRING),
    ("admission_year", STRING), ("split", STRING),
])

DOCUMENTS = T.StructType(_struct([
    ("doc_id", STRING), ("patient_uid", STRING), ("timepoint", STRING), ("split", STRING),
    ("retrieval_text", STRING),
]).fields + [T.StructField("metadata", DOCUMENT_METADATA, True)])

EVAL_LABELS = _struct([("doc_id", STRING), ("timepoint", STRING), ("split", STRING), ("y_true", DOUBLE)])
