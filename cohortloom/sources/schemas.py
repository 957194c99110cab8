"""Explicit schemas of the clinical source tables (codes stay strings, missing measures NULL)."""

from __future__ import annotations

from pyspark.sql import types as T

_VITALS = "temperature double, heartrate double, resprate double, o2sat double, sbp double, dbp double"

SCHEMAS: dict[str, str] = {
    "triage": f"subject_id bigint, stay_id bigint, {_VITALS}, pain string, acuity double, chiefcomplaint string",
    "edstays": "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp, outtime timestamp, "
               "gender string, race string, arrival_transport string, disposition string",
    "patients": "subject_id bigint, gender string, anchor_age int, anchor_year int, "
                "anchor_year_group string, dod date",
    "categorized_diagnosis": "stay_id bigint, seq_num int, icd_code string, icd_version string, "
                             "icd_title string, category string",
    "services": "hadm_id bigint, transfertime timestamp, curr_service string",
    "medrecon": "stay_id bigint, name string, etcdescription string",
    "vitalsign": f"stay_id bigint, charttime string, {_VITALS}, rhythm string",
    "admissions": "subject_id bigint, hadm_id bigint, admittime timestamp",
    "diagnoses_icd": "subject_id bigint, hadm_id bigint, icd_code string",
    "discharge": "subject_id bigint, hadm_id bigint, text string",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])
