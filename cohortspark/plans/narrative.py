"""Record tables to one outcome-free text per admission, and checks on such texts.

Two section layouts exist: "narrative" (no patient id) and "report" (with pseudo id, fungemia block
and further metadata). The episode rows are reduced to one row per episode, rendered, and joined to
their admission once. Episodes are dealt by admission, so what is shuffled is the rows of the input, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.functions import packed, text
from cohortspark.operators.joins import children_of, first_row, first_row_within
from cohortspark.operators.summary import first_ids
from cohortspark.runtime import has

# Source columns in the order they are printed.
LABS = ["SBP", "RR", "PR", "Body_temperature", "GCS_2", "WBC_Count", "CRP", "Creatinine", "T_Bilirubin",
        "PLT_Count", "Albumin", "Hemoglobin"]
TRANSAMINASES = ["AST", "ALT"]
DEVICES = ["ventilator", "central_orarterial_line", "urinary_orrenal_catheter"]
SCORES = ["sofa_score_2", "sepsis_2", "quick_sofa_score_2", "sepsis_quicksofa_2"]
COLONIZATION = ["VRE_colonization", "CRE_colonization"]
SPECTRUM = ["antiMRSAab_empiric", "antiVREab_empiric", "antipseudoab_empiric", "carbaab_empiric"]
EPISODE_FLAGS = ["BSI_episode_3GCR", "BSI_episode_CarbaR", "BSI_episode_MRSA", "BSI_episode_VRE",
                 "BSI_episode_CeftriaxoneR", "BSI_episode_CRAB"]
EMPIRIC_LISTS = ["ab_empiric72_name_clean", "ab_empiric48_name_clean", "ab_empiric24_name_clean",
                 "tt_ab_name_list_episode"]
FUNGEMIA_FLAGS = ["is_fungemia_admission", "fungemia", "fungemia_admission"]
EXTRA = ["ab_admission_category_clean", "ab_admission_name_clean"]

# Headings of the two layouts.
HEADINGS = {
    "narrative": {
        "admin": "[Administrative information (de-identified)]",
        "comorbidities": "[Comorbidities]",
        "icd": "All ICD10 codes",
        "severity": "[Organ support and severity scores]",
        "labs": "[Physiology and labs]",
        "colonization": "[Colonization and resistance flags]",
        "episodes": "[Bloodstream infection episodes]",
        "no_episodes": "No BSI episodes recorded (NA)",
        "organism": "- Organism",
        "empiric": "- Early empiric antibiotics (≤72h):",
    },
    "report": {
        "admin": "[Administrative information (de-identified)]",
        "fungemia": "[Fungemia (known at or before index culture)]",
        "comorbidities": "[Comorbidities]",
        "icd": "All ICD10 codes (during admission)",
        "severity": "[Organ support and severity scores (at index time if available)]",
        "labs": "[Physiology and labs (available at index time if provided)]",
        "colonization": "[Colonization and resistance/spectrum flags]",
        "episodes": "[Bloodstream infection episodes (microbiology/AST)]",
        "no_episodes": "No BSI episodes recorded for this admission (NA)",
        "organism": "- Organism summary",
        "empiric": "- Early empiric antibiotics (≤72h concept):",
        "extra": "[Additional structured metadata (filtered)]",
    },
}


class _Row:
    """Expressions over the columns a table really has; an absent column renders as NA."""

    def __init__(self, df: DataFrame):
        self.df = df

    def has(self, name: str) -> bool:
        return has(self.df, name)

    def value(self, *names: str) -> Column:
        """Text of the first column that is present (presence, not null, decides)."""
        for name in names:
            if self.has(name):
                return text.value_or_na(F.col(name), self.df.schema[name].dataType)
        return F.lit("NA")

    def flag(self, name: str) -> Column:
        if not self.has(name):
            return F.lit("NA")
        return text.yes_no(F.col(name), self.df.schema[name].dataType)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _block(lines: list[Column]) -> Column:
    return F.concat_ws("\n", *lines)


def _admin(row: _Row, head: dict, report: bool) -> Column:
    age = text.band(F.col("age_at_test")) if row.has("age_at_test") else F.lit("NA")
    year = text.year_text(F.col("admission_date")) if row.has("admission_date") else F.lit("NA")
    lines = [F.lit(head["admin"])]
    if report:
        lines.append(_line("Patient pseudo-ID", row.value("newpatient_ID")))
    lines += [_line("Age group", age), _line("Sex", row.value("sex")), _line("Admission year", year),
              _line("Treatment department", row.value("treatment_department_eng"))]
    return _block(lines)


def _fungemia(row: _Row, head: dict) -> Column:
    source = next((c for c in FUNGEMIA_FLAGS if row.has(c)), None)
    flag = row.flag(source) if source else F.lit("NA")
    day = row.value("fungemia_date")
    timing = F.when(day != "NA", F.concat(F.lit("hospital day "), day)).otherwise("NA")
    positive = flag == "yes"
    return _block([F.lit(head["fungemia"]), _line("Fungemia", flag),
                   F.when(positive, _line("Fungemia organism", row.value("fungemia_organism"))),
                   F.when(positive, _line("Fungemia timing", timing))])


def _comorbidities(row: _Row, head: dict) -> Column:
    return _block([
        F.lit(head["comorbidities"]),
        _line("Infectious ICD categories", row.value("icd_categorized_onlyinfections")),
        _line(head["icd"], row.value("icd_all_codes")),
        _line("Charlson categories", row.value("charlson_category_withcancermerged", "charlson_category")),
        _line("Charlson score", row.value("charlson_score"))])


def _severity(row: _Row, head: dict) -> Column:
    lines = [F.lit(head["severity"]), _line("icu", row.flag("icu")), _line("Vasopressin_any", row.flag("Vasopressin_any"))]
    lines += [text.keep_informative(c, row.flag(c)) for c in DEVICES if row.has(c)]
    lines += [_line(c, row.value(c)) for c in SCORES]
    return _block(lines)


def _labs(row: _Row, head: dict, transaminases: bool) -> Column:
    names = LABS + (TRANSAMINASES if transaminases else [])
    return _block([F.lit(head["labs"])] + [_line(c, row.value(c)) for c in names])


def _colonization(row: _Row, head: dict, report: bool) -> Column:
    breadth = ["is_empiric_tt_excessivelylarge"] + (["is_admission_tt_excessivelylarge"] if report else [])
    lines = [F.lit(head["colonization"])]
    lines += [_line(c, row.value(c)) for c in COLONIZATION if row.has(c)]
    shown = row.flag if report else row.value
    lines += [_line(c, shown(c)) for c in SPECTRUM + breadth if row.has(c)]
    return _block(lines)


def _extra(row: _Row, head: dict) -> Column:
    """Null when no listed column carries a value, so the section disappears."""
    lines = [F.when(row.value(c) != "NA", _line(c, row.value(c))) for c in EXTRA if row.has(c)]
    if not lines:
        return F.lit(None).cast("string")
    body = F.concat_ws("\n", *lines)
    return F.when(body != "", F.concat(F.lit(head["extra"] + "\n"), body))


def episode_rows(episodes: DataFrame, key: str, tie_order: list[str]) -> DataFrame:
    """First row per (admission, episode) by test date, nulls last. A missing number is a group of its own."""
    order = [("test_date", True)] + [(c, True) for c in tie_order]
    kept = episodes.filter(F.col(key).isNotNull())
    if not has(episodes, "BSI_episode_num"):
        return first_row(kept, [key], order).withColumn("BSI_episode_num", F.lit(1))
    return first_row_within(kept, key, "BSI_episode_num", order)


def _drug_list(row: _Row, report: bool) -> Column:
    names = EMPIRIC_LISTS + (["tt_ab_name_list"] if report else [])
    # "has an item" is a cheap test, so only the list that is used gets parsed
    lists = [F.when(F.col(c).rlike(r"[^,\s]"), F.col(c)) for c in names if row.has(c)]
    return F.coalesce(*lists, F.lit(None).cast("string"))


def with_episode_lists(first: DataFrame, report: bool) -> DataFrame:
    """Adds the drug list (_drugs) and the shown (drug, result) pairs (_pairs) of each episode.

    The flat list is a fallback: for narratives only when the packed string had no block, for reports
    whenever no listed pair came out of it (then sorted and distinct). Every list is a column of its
    own, because an expression used twice would be parsed twice.
    """
    row = _Row(first)
    df = first.withColumn("_drugs", _drug_list(row, report)).withColumn("_drugs", packed.comma_list(F.col("_drugs")))
    if row.has("AST_ab_result_by_microbe"):
        df = packed.with_blocks(df, "AST_ab_result_by_microbe", "_blocks")
    else:
        df = df.withColumn("_blocks", F.array().cast("array<struct<grp:string,items:array<string>>>"))
    flat = (packed.shown(packed.flat_pairs(F.col("AST_ab_result_list_episode")))
            if row.has("AST_ab_result_list_episode") else F.array().cast(packed.PAIR_TYPE))
    df = df.withColumn("_boxed", packed.block_pairs(F.col("_blocks")))
    if report:
        pairs = F.when(F.size("_boxed") > 0, F.col("_boxed")).otherwise(packed.in_order(flat))
    else:
        pairs = F.when(F.size("_blocks") > 0, F.col("_boxed")).otherwise(flat)
    return df.withColumn("_pairs", pairs).drop("_blocks", "_boxed")


def episode_text(first: DataFrame, variant: str) -> Column:
    """The lines of one episode below its timing; its lists must be there."""
    head, report, row = HEADINGS[variant], variant == "report", _Row(first)
    no_drug = "  o NA" if report else "  o Antibiotic_1: NA"
    return F.concat_ws(
        "\n",
        _line(head["organism"], row.value("BSI_episode_short_clean", "BSI_episode_short")),
        _line("- Polymicrobial", row.flag("BSI_episode_polymicrobial")),
        *[_line(f"- {c}", row.flag(c)) for c in EPISODE_FLAGS],
        F.lit(head["empiric"]),
        F.coalesce(packed.drug_lines(F.col("_drugs")), F.lit(no_drug)),
        F.lit("- AST (selected antibiotics):"),
        F.coalesce(packed.pair_lines(F.col("_pairs")), F.lit("  o NA")))


def timed_text(episode: Column, admission_date: Column) -> Column:
    """All lines of an entry (_num, date, lines) of an admission's episodes; null without a number, which prints nothing."""
    timing = text.day_offset_text(episode["date"], admission_date)
    return F.concat(F.lit("Episode: "), episode["_num"].cast("long").cast("string"), F.lit("\n- Timing: "), timing, F.lit("\n"), episode["lines"])


def build(admissions: DataFrame, episodes: DataFrame, ids: DataFrame | None = None, max_n: int | None = None,
          transaminases: bool = False, variant: str = "narrative", key: str = "admission_ID",
          patient: str = "newpatient_ID", admission_order: list[str] | None = None,
          episode_order: list[str] | None = None) -> DataFrame:
    """(key, patient, text), one row per admission.

    ``admission_order`` and ``episode_order`` name the columns that decide between duplicate rows.
    """
    head, report = HEADINGS[variant], variant == "report"
    adm = admissions.filter(F.col(key).isNotNull())
    if ids is not None:
        adm = adm.join(ids.select(key), key, "left_semi")
    if max_n:
        adm = adm.join(first_ids(adm, key, max_n), key, "left_semi")
    adm = first_row(adm, [key], [(c, True) for c in (admission_order or [patient])])
    date = F.col("admission_date") if has(adm, "admission_date") else F.lit(None).cast("timestamp")
    patient_text = _Row(adm).value(patient)

    if ids is not None or max_n:
        episodes = episodes.join(adm.select(key), key, "left_semi")
    firsts = with_episode_lists(episode_rows(episodes, key, episode_order or []), report)
    entries = firsts.withColumn("_num", F.col("BSI_episode_num"))
    blocks = children_of(entries, key, ["_num"], {"date": F.col("test_date"), "lines": episode_text(firsts, variant)}, "_items")

    # the parent's date meets the episodes in the one join there is
    joined = adm.join(blocks, key, "left").withColumn("_admission_date", date)
    # an empty line between episodes; only the end of the last one is trimmed, which ends the section
    shown = F.array_join(F.transform("_items", lambda e: timed_text(e, F.col("_admission_date"))), "\n\n")
    joined = joined.withColumn("_episodes", shown).withColumn("_episodes", text.rstrip(F.col("_episodes")))
    row = _Row(joined)
    body = F.coalesce("_episodes", F.lit(head["no_episodes"]))
    episode_section = F.concat_ws("\n", F.lit(head["episodes"]), F.nullif(body, F.lit("")))
    sections = [_admin(row, head, report)]
    if report:
        sections.append(_fungemia(row, head))
    sections += [_comorbidities(row, head), _severity(row, head), _labs(row, head, transaminases),
                 _colonization(row, head, report), episode_section]
    if report:
        sections.append(F.rtrim(_extra(row, head), F.lit(text.SPACES)))
    # no section ends in white space, so the whole text needs no trimming
    full = F.concat_ws("\n", F.lit("[Case]"), *sections)
    return joined.select(key, patient_text.alias("patient_id"), F.concat(full, F.lit("\n")).alias("text"))


def sanitize(df: DataFrame, column: str) -> DataFrame:
    """Outcome block and leaky lines removed from a text column."""
    return df.withColumn(column, text.sanitize(F.col(column)))
