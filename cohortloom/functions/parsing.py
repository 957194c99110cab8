"""Parsers for times, numbers, pressures, JSON blocks and reading lists, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vital ranges, abnormal limits and skip answers.
VITALS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp"]
CLIP_RANGES = {"temperature": (90.0, 110.0), "heartrate": (20.0, 250.0), "resprate": (4.0, 60.0),
               "o2sat": (50.0, 100.0), "sbp": (50.0, 300.0), "dbp": (20.0, 200.0)}
VITAL_MEDIANS = {"temperature": 98.1, "heartrate": 84, "resprate": 18, "o2sat": 98, "sbp": 134, "dbp": 78}
ABNORMAL = {
    "fever": ("temperature", ">", 100.4), "tachycardia": ("heartrate", ">", 100),
    "bradycardia": ("heartrate", "<", 60), "tachypnea": ("resprate", ">", 20),
    "hypoxia": ("o2sat", "<", 94), "hypertension": ("sbp", ">", 140), "hypotension": ("sbp", "<", 90),
}
ABNORMAL_TRIAGE = {
    "fever": ("temperature", ">", 100.4), "hypothermic": ("temperature", "<", 96.8),
    "tachycardic": ("heartrate", ">", 100), "bradycardic": ("heartrate", "<", 60),
    "tachypneic": ("resprate", ">", 20), "hypoxic": ("o2sat", "<", 94),
    "hypertensive": ("sbp", ">", 140), "hypotensive": ("sbp", "<", 90),
}
SKIP_WORDS = ["skip", "idk", "i don't know", "i dont know", "unknown", "no", "n/a", "na", "-",
              "not sure", "don't know", "dont know", ""]
SKIP_BLOBS = ["", "none", "null", "n/a", "na", "-", "{}", "unknown", "skip"]


def strip(col: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


# --- times -----------------------------------------------------------------------------------------

def parse_ts(col: Column) -> Column:
    """Timestamp, NULL on bad input."""
    return F.try_to_timestamp(col.cast("string"))


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone (sessions run in UTC)."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def hours_between(a: Column, b: Column) -> Column:
    """Fractional hours from ``a`` to ``b``."""
    return (micros(b) - micros(a)) / F.lit(3_600_000_000.0)


def days_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(86_400_000_000.0)


# --- intake answers --------------------------------------------------------------------------------

def _answer(col: Column) -> tuple[Column, Column]:
    text = F.lower(strip(F.coalesce(col, F.lit(""))))
    return text, text.isin(*SKIP_WORDS)


def parse_number(col: Column) -> Column:
    """The answer as a number, else the first run of digits and dots in it."""
    text, skip = _answer(col)
    return F.when(~skip, F.coalesce(text.try_cast("double"), F.regexp_extract(text, r"[\d.]+", 0).try_cast("double")))


def parse_bp(col: Column) -> Column:
    """``120/80`` or ``120 over 80`` -> struct(sbp, dbp); one number gives the first part only."""
    text, skip = _answer(col)
    text = F.replace(text, F.lit("over"), F.lit("/"))
    pair = r"(\d+)\s*/\s*(\d+)"
    both = text.rlike(pair)
    upper = F.when(both, F.regexp_extract(text, pair, 1)).otherwise(F.regexp_extract(text, r"\d+", 0))
    return F.struct(F.when(~skip, upper.try_cast("double")).alias("sbp"),
                    F.when(~skip & both, F.regexp_extract(text, pair, 2).try_cast("double")).alias("dbp"))


def parse_clock(col: Column) -> Column:
    """``14:30`` -> minutes since midnight; otherwise the first signed number; ``now`` -> NULL."""
    text, skip = _answer(col)
    clock = r"^(\d{1,2}):(\d{2})$"
    minutes = F.regexp_extract(text, clock, 1).try_cast("double") * 60 + F.regexp_extract(text, clock, 2).try_cast("double")
    number = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(~skip & ~text.isin("now", "current"), F.when(text.rlike(clock), minutes).otherwise(number))


# --- JSON ------------------------------------------------------------------------------------------

def parse_trajectory(col: Column, vitals: Sequence[str] = VITALS, texts: Sequence[str] = ("rhythm",)) -> Column:
    """Reading blob -> struct of arrays. A scalar becomes a one-element array; text that is no
    object, skip words and unusable entries give NULL arrays."""
    body = F.trim(F.coalesce(col, F.lit("")))
    usable = ~F.lower(body).isin(*SKIP_BLOBS) & body.startswith("{")
    lists = F.from_json(body, T.MapType(T.StringType(), T.StringType()))
    out = []
    for v in [*vitals, *texts]:
        raw = F.try_element_at(lists, F.lit(v))
        as_array = F.from_json(raw, T.ArrayType(T.StringType()))
        items = F.when(raw.startswith("["), as_array).otherwise(F.array(raw))
        if v in texts:
            kept = F.filter(F.transform(items, lambda x: F.trim(x)),
                            lambda x: x.isNotNull() & ~F.lower(x).isin(*SKIP_BLOBS))
        else:
            kept = F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
        out.append(F.when(usable & (F.size(kept) > 0), kept).alias(v))
    return F.struct(*out)


def parse_block(col: Column, schema: str | T.StructType, nested: str | None = None) -> Column:
    """Lookup block as a struct, NULL unless every field is there; ``nested`` unwraps an outer key."""
    text = col if nested is None else F.coalesce(F.get_json_object(col, f"$.{nested}"), col)
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json(text, st)
    complete = None
    for f in st:
        ok = parsed.getField(f.name).isNotNull()
        complete = ok if complete is None else complete & ok
    return F.when(complete, parsed)


def json_field_or_raw(col: Column, field: str) -> Column:
    """One field of a JSON object that may sit in a code fence or in prose; else the text itself."""
    text = strip(F.regexp_replace(strip(col), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    value = F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), f"$.{field}")
    return F.when(F.coalesce(value, F.lit("")) != "", strip(value)).otherwise(text)


# --- arrays ----------------------------------------------------------------------------------------

def order_rounds(rounds: Column, ts: str = "ts") -> Column:
    """Reading rounds by their time when every round has one, else in entry order. Equal times keep
    entry order."""
    timed = F.forall(rounds, lambda r: r[ts].isNotNull())
    keyed = F.transform(rounds, lambda r, i: F.struct(r[ts].alias("t"), i.alias("i"), r.alias("r")))
    return F.when(timed, F.transform(F.array_sort(keyed), lambda x: x["r"])).otherwise(rounds)


def array_series_stats(arr: Column, snapshot: Column) -> dict[str, Column]:
    """Min, max, last and delta of a reading array; without readings the snapshot and delta 0."""
    some = F.size(F.coalesce(arr, F.array().cast("array<double>"))) > 0
    return {
        "min": F.when(some, F.array_min(arr)).otherwise(snapshot),
        "max": F.when(some, F.array_max(arr)).otherwise(snapshot),
        "last": F.when(some, F.element_at(arr, -1)).otherwise(snapshot),
        "delta": F.when(some, F.element_at(arr, -1) - F.element_at(arr, 1)).otherwise(F.lit(0.0)),
    }


def array_count(arr: Column, op: str, limit: float, snapshot_flag: Column) -> Column:
    """Readings beyond a limit; without readings the snapshot's own flag."""
    some = F.size(F.coalesce(arr, F.array().cast("array<double>"))) > 0
    hit = (lambda x: x > limit) if op == ">" else (lambda x: x < limit)
    return F.when(some, F.size(F.filter(arr, hit))).otherwise(snapshot_flag).cast("bigint")


def clip_array(arr: Column, lo: float, hi: float) -> Column:
    return F.transform(arr, lambda x: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def neg_euclidean(a: Column, b: Column) -> Column:
    """Negative Euclidean distance of two arrays: higher means closer."""
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(arr: Column) -> Column:
    """Array scaled to length 1; an all-zero array stays as it is."""
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(arr, lambda x: x / norm)).otherwise(arr)


def minmax(value: Column, lo: Column, hi: Column, flat: float = 0.5) -> Column:
    """Position between ``lo`` and ``hi``; a flat range gives 0.5."""
    return F.when(hi - lo < 1e-12, F.lit(flat)).otherwise((value - lo) / (hi - lo))


def case_of(mapping: Mapping[str, str], col: Column, default: str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out
