"""Diagnosis-code expressions: rollup rubric, chapter, hierarchical similarity."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the numeric ICD-9 chapters and the letters of the ICD-10 chapters.
ICD9_BOUNDS = [
    (139, "infectious"), (239, "neoplasms"), (279, "endocrine"), (289, "blood"), (319, "mental"),
    (389, "nervous"), (459, "circulatory"), (519, "respiratory"), (579, "digestive"),
    (629, "genitourinary"), (679, "pregnancy"), (709, "skin"), (739, "musculoskeletal"),
    (759, "congenital"), (779, "perinatal"), (799, "symptoms"), (999, "injury"),
]
ICD10_LETTERS = {
    "A": "infectious", "B": "infectious", "C": "neoplasms", "E": "endocrine", "F": "mental",
    "G": "nervous", "I": "circulatory", "J": "respiratory", "K": "digestive", "L": "skin",
    "M": "musculoskeletal", "N": "genitourinary", "O": "pregnancy", "P": "perinatal",
    "Q": "congenital", "R": "symptoms", "S": "injury", "T": "injury", "U": "special", "Z": "factors",
}
SAME_ROLLUP = 0.6
SAME_CHAPTER = 0.3


def _clean(code: Column) -> Column:
    return F.upper(F.trim(F.coalesce(code.cast("string"), F.lit(""))))


def rollup_code(code: Column, version: Column) -> Column:
    """Category rubric: three characters, four for ICD-9 E-codes."""
    c = _clean(code)
    nine = F.trim(version.cast("string")) == "9"
    return F.when(nine & c.startswith("E"), F.substring(c, 1, 4)).otherwise(F.substring(c, 1, 3))


def code_chapter(code: Column, version: Column) -> Column:
    """Chapter label shared by ICD-9 and ICD-10."""
    c = _clean(code)
    n9 = F.substring(c, 1, 3).try_cast("int")
    nine = F.when(c.startswith("E"), "external").when(c.startswith("V"), "factors")
    for hi, name in ICD9_BOUNDS:
        nine = nine.when(n9 <= hi, name)
    nine = nine.otherwise("other")
    letter = F.substring(c, 1, 1)
    n10 = F.coalesce(F.substring(c, 2, 2).try_cast("int"), F.lit(0))
    letters = F.create_map(*[F.lit(x) for x in chain.from_iterable(ICD10_LETTERS.items())])
    ten = (F.when(letter == "D", F.when(n10 <= 49, "neoplasms").otherwise("blood"))
           .when(letter == "H", F.when(n10 <= 59, "eye").otherwise("ear"))
           .when(letter.isin("V", "W", "X", "Y"), "external")
           .otherwise(F.coalesce(F.try_element_at(letters, letter), F.concat(F.lit("other:"), letter))))
    return F.when(c == "", "").when(F.trim(version.cast("string")) == "9", nine).otherwise(ten)


def code_similarity(code_a: Column, version_a: Column, code_b: Column, version_b: Column) -> Column:
    """1 for the same code, 0.6 for the same rubric, 0.3 for the same chapter, else 0."""
    return (F.when(_clean(code_a) == _clean(code_b), 1.0)
            .when(rollup_code(code_a, version_a) == rollup_code(code_b, version_b), SAME_ROLLUP)
            .when(code_chapter(code_a, version_a) == code_chapter(code_b, version_b), SAME_CHAPTER)
            .otherwise(0.0))
