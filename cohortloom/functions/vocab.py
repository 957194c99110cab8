"""Keyword vocabularies and the flags they raise in free text.

A vocabulary is ``{category: [keywords]}``. The starter tables below hold common public clinical
terms; production vocabularies are passed in, for instance from a ``(keyword, category)`` table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

Vocab = Mapping[str, Sequence[str]]

# The history categories, in feature order.
HISTORY_CATEGORIES = [
    "Blood and Blood-Forming Organs", "Circulatory", "Digestive", "Endocrine, Nutritional, Metabolic",
    "Genitourinary", "Infectious and Parasitic", "Injury and Poisoning", "Mental Disorders",
    "Musculoskeletal", "Nervous System and Sense Organs", "Other", "Respiratory",
    "Skin and Subcutaneous Tissue",
]

HISTORY_TERMS: dict[str, list[str]] = {
    "Blood and Blood-Forming Organs": ["anemia", "thrombocytopenia", "sickle cell", "hemophilia", "neutropenia", "leukopenia"],
    "Circulatory": ["congestive heart failure", "chf", "hypertension", "htn", "high blood pressure", "coronary artery disease",
                    "cad", "atrial fibrillation", "afib", "myocardial infarction", "heart attack", "stroke", "dvt"],
    "Digestive": ["gerd", "acid reflux", "cirrhosis", "crohn's disease", "ulcerative colitis", "pancreatitis", "hernia", "gallstone"],
    "Endocrine, Nutritional, Metabolic": ["diabetes", "dm", "hypothyroidism", "hyperlipidemia", "high cholesterol", "obesity", "gout"],
    "Genitourinary": ["chronic kidney disease", "ckd", "kidney stone", "bph", "endometriosis", "fibroid"],
    "Infectious and Parasitic": ["hiv", "hepatitis b", "hepatitis c", "tuberculosis", "mrsa", "sepsis"],
    "Injury and Poisoning": ["prior fracture", "hip fracture", "concussion", "overdose", "traumatic brain injury"],
    "Mental Disorders": ["depression", "anxiety", "bipolar", "schizophrenia", "ptsd", "dementia", "alcohol abuse"],
    "Musculoskeletal": ["arthritis", "osteoarthritis", "osteoporosis", "fibromyalgia", "back pain", "scoliosis"],
    "Nervous System and Sense Organs": ["epilepsy", "seizure", "migraine", "multiple sclerosis", "parkinson's disease",
                                        "neuropathy", "glaucoma", "stroke"],
    "Other": ["cancer", "lymphoma", "leukemia", "melanoma", "tumor", "pregnancy"],
    "Respiratory": ["copd", "asthma", "emphysema", "sleep apnea", "pneumonia", "pulmonary embolism"],
    "Skin and Subcutaneous Tissue": ["psoriasis", "eczema", "cellulitis", "dermatitis", "pressure ulcer"],
}

# One reportable phrase per history category.
HISTORY_PHRASES = {
    "Blood and Blood-Forming Organs": "anemia",
    "Circulatory": "congestive heart failure",
    "Digestive": "gerd",
    "Endocrine, Nutritional, Metabolic": "diabetes",
    "Genitourinary": "chronic kidney disease",
    "Infectious and Parasitic": "hiv",
    "Injury and Poisoning": "prior fracture",
    "Mental Disorders": "depression",
    "Musculoskeletal": "arthritis",
    "Nervous System and Sense Organs": "epilepsy",
    "Other": "cancer",
    "Respiratory": "copd",
    "Skin and Subcutaneous Tissue": "psoriasis",
}

MED_CATEGORIES = ["has_cardiac_meds", "has_diabetes_meds", "has_psych_meds", "has_respiratory_meds",
                  "has_opioid_meds", "has_anticoagulant_meds", "has_gi_meds", "has_thyroid_meds",
                  "has_anticonvulsant_meds"]

# Starter words of drug-class descriptions, after the public class names of each organ system.
MED_CLASS_TERMS: dict[str, list[str]] = {
    "has_cardiac_meds": ["antihypertensive", "loop diuretic", "thiazide", "potassium-sparing diuretic", "statin",
                         "hmg-coa reductase inhibitor", "fibrate", "ace inhibitor", "angiotensin receptor blocker",
                         "beta blocker", "calcium channel blocker", "antiarrhythmic", "inotrope", "nitrate", "vasodilator"],
    "has_diabetes_meds": ["antidiabetic", "hypoglycemic", "insulin", "biguanide", "sulfonylurea", "thiazolidinedione",
                          "meglitinide", "incretin mimetic", "alpha-glucosidase inhibitor"],
    "has_psych_meds": ["psychotropic", "antidepressant", "serotonin reuptake inhibitor", "monoamine oxidase inhibitor",
                       "mood stabilizer", "antipsychotic", "neuroleptic", "anxiolytic", "benzodiazepine", "hypnotic", "stimulant"],
    "has_respiratory_meds": ["bronchodilator", "beta agonist", "inhaled steroid", "antitussive", "expectorant", "mucolytic",
                             "leukotriene modifier", "methylxanthine", "antihistamine"],
    "has_opioid_meds": ["opioid", "opiate", "narcotic analgesic", "opioid agonist", "opioid antagonist"],
    "has_anticoagulant_meds": ["anticoagulant", "antithrombotic", "antiplatelet", "salicylate", "heparin",
                               "vitamin k antagonist", "direct thrombin inhibitor", "factor xa inhibitor", "fibrinolytic"],
    "has_gi_meds": ["proton pump inhibitor", "antacid", "histamine-2 blocker", "antiemetic", "laxative", "antidiarrheal",
                    "prokinetic", "antispasmodic", "bile acid"],
    "has_thyroid_meds": ["thyroid hormone", "thyroid preparation", "antithyroid agent", "iodine product"],
    "has_anticonvulsant_meds": ["anticonvulsant", "antiepileptic", "barbiturate", "hydantoin", "gaba analogue"],
}

MED_NAMES: dict[str, list[str]] = {
    "has_cardiac_meds": ["lisinopril", "metoprolol", "atorvastatin", "simvastatin", "amlodipine", "furosemide", "losartan", "carvedilol"],
    "has_diabetes_meds": ["metformin", "insulin", "glipizide", "sitagliptin", "lantus"],
    "has_psych_meds": ["sertraline", "fluoxetine", "quetiapine", "lorazepam", "clonazepam", "trazodone"],
    "has_respiratory_meds": ["albuterol", "fluticasone", "salmeterol", "montelukast", "tiotropium", "advair"],
    "has_opioid_meds": ["oxycodone", "morphine", "hydromorphone", "tramadol", "percocet"],
    "has_anticoagulant_meds": ["warfarin", "aspirin", "clopidogrel", "apixaban", "enoxaparin"],
    "has_gi_meds": ["omeprazole", "pantoprazole", "ranitidine", "docusate", "ondansetron"],
    "has_thyroid_meds": ["levothyroxine", "methimazole", "calcitriol"],
    "has_anticonvulsant_meds": ["levetiracetam", "gabapentin", "phenytoin", "lamotrigine", "clonazepam"],
}

# Negation windows.
HISTORY_NEGATION = (r"\b(?:no(?:\s+(?:prior|known|history|h/?o))?|denies|negative\s+for|r/?o(?:\s+for)?"
                    r"|ruled\s+out(?:\s+for)?|without(?:\s+(?:history|h/?o))?|absent\s+of|free\s+of)\b"
                    r"(?:\s+\S+){0,6}")
CLASS_NEGATION = r"\bnon[-\s]+(opioid|salicylate|steroidal|insulin)s?\b"

# Answers that mean "nothing to report".
SKIP_ANSWERS = ["unknown", "none", "no", "skip", "n/a", "na", "-", "", "i don't know", "i dont know", "idk"]


def _literal(term: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", term)


def keyword_pattern(terms: Sequence[str]) -> str:
    """Whole-word alternation, longer terms first, with an optional plural s."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return r"\b(?:" + "|".join(_literal(t) for t in ordered) + r")s?\b"


def without_negated(col: Column, negation: str) -> Column:
    """Lower-cased text whose negated windows are blanked out."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "(?Ui)" + negation, " _NEG_ ")


def text_flags(df: DataFrame, col: str, vocab: Vocab | DataFrame, names: Mapping[str, str] | None = None,
               negation: str = HISTORY_NEGATION, keep: Sequence[str] | None = None) -> DataFrame:
    """Add one 0/1 column per category (named by ``names`` or the category itself). The vocabulary is a mapping, matched in
    the row, or a ``(keyword, category)`` table of any length, matched by joins; keywords may have several words.

    ``keep`` names the columns of ``df`` to return, all by default; a table stores these, so leave out long texts."""
    prepared = df.withColumn("__text", without_negated(F.col(col), negation))
    if keep is not None:
        prepared = prepared.drop(*[c for c in df.columns if c not in keep])
    if isinstance(vocab, DataFrame):
        return _table_flags(prepared, vocab, names or {})
    return prepared.withColumns({
        (names or {}).get(cat, cat): F.col("__text").rlike("(?U)" + keyword_pattern(terms)).cast("int")
        for cat, terms in vocab.items()}).drop("__text")


def _table_flags(df: DataFrame, table: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Flags of ``__text`` from a keyword table; the driver sees its categories, which become columns, a bounded filter of its phrases
    and a bounded number of these. Rows are numbered and stored with the runs of tokens that may be phrases, so each text is read once."""
    from ..operators.phrases import phrase_runs, phrase_table, settle_common
    categories = sorted(r[0] for r in table.where("trim(keyword) <> '' AND category IS NOT NULL").select("category").distinct().collect())
    phrases = phrase_table(table)
    runs = phrase_runs(df, F.col("__text"), phrases, "__runs").drop("__text")
    numbered = durable(settle_common(runs, "__runs", phrases, categories, "__found", "__rest")
                       .withColumn("__number", F.monotonically_increasing_id()))
    places = {c: f"__flag{i}" for i, c in enumerate(categories)}
    hits = numbered.select("__number", F.explode("__rest").alias("phrase")).join(phrases, "phrase")
    wide = hits.groupBy("__number").agg(F.lit(True).alias("__any"), *[
        F.max(F.array_contains("categories", c)).alias(p) for c, p in places.items()])
    joined = numbered.drop("__rest").join(wide, "__number", "left")
    flags = {names.get(c, c): (F.array_contains("__found", i) | F.coalesce(F.col(places[c]), F.lit(False))).cast("int")
             for i, c in enumerate(categories)}
    return joined.withColumns(flags).drop("__number", "__any", "__found", *places.values())


def history_flags(df: DataFrame, col: str, vocab: Vocab | DataFrame = HISTORY_TERMS,
                  names: Mapping[str, str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Condition flags; up to six words after a negation cue do not count."""
    return text_flags(df, col, vocab, names, HISTORY_NEGATION, keep)


def class_flags(df: DataFrame, col: str, vocab: Vocab | DataFrame = MED_CLASS_TERMS,
                names: Mapping[str, str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Drug-class flags; ``non-opioid`` and the like do not count."""
    return text_flags(df, col, vocab, names, CLASS_NEGATION, keep)


def flag_set(flags: Mapping[str, str]) -> Column:
    """Sorted array of the categories whose flag column is 1 (``category -> column``)."""
    return F.array_sort(F.filter(
        F.array(*[F.when(F.col(c) == 1, F.lit(cat)) for cat, c in flags.items()]), lambda x: x.isNotNull()))


def vocab_table(spark: SparkSession, vocab: Vocab) -> DataFrame:
    """``(keyword, category)`` rows for token joins."""
    return spark.createDataFrame(
        [(k, cat) for cat, terms in vocab.items() for k in terms], "keyword string, category string")


def name_tokens(col: Column) -> Column:
    """Alphabetic runs of a drug name."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def name_flags(df: DataFrame, col: str, vocab: Vocab = MED_NAMES,
               names: Mapping[str, str] | None = None) -> DataFrame:
    """Flags from exact tokens of a name, evaluated in the row (small vocabularies). For a large
    vocabulary table join the tokens instead: ``joins.flag_by_token``."""
    prepared = df.withColumn("__tokens", name_tokens(F.col(col)))
    return prepared.withColumns({
        (names or {}).get(cat, cat): F.arrays_overlap(
            F.col("__tokens"), F.array(*[F.lit(t) for t in terms])).cast("int")
        for cat, terms in vocab.items()}).drop("__tokens")


def row_flags(df: DataFrame, name: str, desc: str, names_vocab: Vocab = MED_NAMES,
              class_vocab: Vocab = MED_CLASS_TERMS) -> DataFrame:
    """Name flags OR class flags of one medication row."""
    out = name_flags(df, name, names_vocab, {c: f"__n_{c}" for c in names_vocab})
    out = class_flags(out, desc, class_vocab, {c: f"__c_{c}" for c in class_vocab})
    cats = list(dict.fromkeys([*names_vocab, *class_vocab]))
    cols = {c: F.greatest(*[F.col(p + c) for p in ("__n_", "__c_") if p + c in out.columns], F.lit(0)) for c in cats}
    return out.withColumns(cols).drop(*[f"__n_{c}" for c in cats], *[f"__c_{c}" for c in cats])


def is_skip(col: Column, answers: Sequence[str] = SKIP_ANSWERS) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit("")))).isin(*answers)


def classify_free_list(df: DataFrame, col: str, names_vocab: Vocab = MED_NAMES,
                       class_vocab: Vocab = MED_CLASS_TERMS) -> DataFrame:
    """Free-text medication list -> ``n_medications``, ``meds_unknown`` and category flags."""
    skip = is_skip(F.col(col))
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), ";| and ", ","), ",")
    n = F.greatest(F.size(F.filter(parts, lambda p: F.trim(p) != "")), F.lit(1))
    out = row_flags(df, col, col, names_vocab, class_vocab)
    cats = list(dict.fromkeys([*names_vocab, *class_vocab]))
    return out.withColumns({
        "n_medications": F.when(skip, F.lit(0)).otherwise(n).cast("bigint"),
        "meds_unknown": skip.cast("int"),
        **{c: F.when(skip, F.lit(0)).otherwise(F.col(c)) for c in cats}})


def flags_to_phrases(flags: Mapping[str, str], phrases: Mapping[str, str] = HISTORY_PHRASES) -> Column:
    """Raised flags -> comma-joined phrases, in category order (``category -> flag column``)."""
    return F.array_join(F.filter(
        F.array(*[F.when(F.col(flags[cat]) == 1, F.lit(text)) for cat, text in phrases.items() if cat in flags]),
        lambda x: x.isNotNull()), ", ")


def self_report_gap(reported: Column, recorded: Column) -> Column:
    """Categories the text reports but the record lacks, sorted."""
    return F.array_sort(F.array_except(reported, recorded))
