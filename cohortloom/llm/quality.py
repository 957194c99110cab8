"""Line-first quality rules: judge every line, remove those that fail, reject documents that lose too much.

A line fails for its punctuation (symbols or cell separators for every few words), as navigation (few words between
separators, or menu words without a sentence), as boilerplate (license, copyright, consent and script notices) or as a
repetition of an earlier line. Document rules on length and repeated word triples come first."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
NAVIGATION = re.compile(
    r"(?:home|menu|about(?: us)?|contact(?: us)?|log ?in|sign ?(?:in|up)|register|search|next|previous|back|read more|share|"
    r"skip to (?:main )?content|click here|top|print|sitemap|rss)(?:\W+|$)", re.I)
BOILERPLATE = re.compile(
    r"all rights reserved|copyright\b|\(c\) \d{4}|©|licensed under|license, version|released under|is licensed under|"
    r"terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|accept (?:all )?cookies|enable javascript|"
    r"javascript is (?:disabled|required)|lorem ipsum|subscribe to our|unsubscribe", re.I)
SEPARATOR = re.compile(r"[|»›•·→]")
COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
           "n_failed_lines long, lost_chars long, base_failed boolean, kept boolean, clean_text string")


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    #: Highest share, in percent, of words inside repeated triples.
    repeat_percent: int = 50
    #: Highest number of symbols for ten words of a line.
    symbols_per_ten: int = 3
    #: Highest share, in percent, of word characters that failed lines may take with them.
    lost_percent: int = 30


def line_fails(line: str, words: int, rules: Rules) -> bool:
    symbols = sum(map(line.count, SYMBOLS))
    if 10 * symbols > rules.symbols_per_ten * words:
        return True
    if len(SEPARATOR.findall(line)) >= 2 and 10 * len(SEPARATOR.findall(line)) > rules.symbols_per_ten * words:
        return True
    if words <= 4 and line.rstrip()[-1:] not in ".!?:;…\"')" and NAVIGATION.match(line.lstrip()):
        return True
    return bool(BOILERPLATE.search(line)) and words <= 40


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    pair = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * len(numbers) + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = np.diff(triple[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= again
    return int(hit.sum())


def judge(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    repeat = repeated_words(words)
    seen: set[str] = set()
    dup = failed = lost = lines = 0
    kept_lines = []
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            kept_lines.append(line)
            continue
        lines += 1
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(line, n, rules):
            failed += 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            kept_lines.append(line)
    base_failed = len(words) < rules.least_words or 100 * repeat > rules.repeat_percent * len(words)
    kept = not base_failed and 100 * lost <= rules.lost_percent * word_chars
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeat, lines, failed, lost, base_failed, kept,
            "\n".join(kept_lines))


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the counts, base_failed, kept and clean_text (the lines that passed).

    Null and empty texts have no words and fail. Lines without words never fail or count. Repeated rows stay, other
    columns are ignored, no rows give no rows."""
    fields = [f.split() for f in COLUMNS.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(x.as_py(), rules) for x in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.record_batch([batch.column(0), *[pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]],
                                  names=["doc_id", *[n for n, _ in fields]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {COLUMNS}")
