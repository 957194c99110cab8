"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two strings sums over common subsequences of four letters, each weighted by ``DECAY`` per skipped letter
on either side, at most ``GAPS`` skipped: inserted and swapped characters lower a match but do not lose it. Characters
that are neither letters nor white space are left out beforehand, so ``i.d-i*o t`` reads as its letters.

Labels belong to documents, insults to single sentences, so training goes by multiple instances. Sequences of five
letters whose document counts speak for toxic labels are the first landmarks; each training document is then stood for
by its ``WITNESSES`` strongest windows, windows of clean documents join the landmarks, and a squared-hinge SVM is fitted on Nyström
features of these windows. That is repeated with the clean windows of all rounds, and a logistic curve is fitted on the
final scores. Because the kernel is an inner product of explicit subsequence counts, the fitted SVM
folds into one weight per subsequence: scoring a text is a pass of table look-ups, whatever the number of landmarks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

GAPS = 2
DECAY = 0.7
WINDOW = 8
PAD = 8
GRAM = 5
DROP = 255
WITNESSES = 3
#: Letters beyond a-z with a code of their own; all others share one.
ACCENTED = "äöüßéèêàâçîñáíóú"
BASE = 28 + len(ACCENTED)
PATTERNS = [((0, *c), DECAY ** (c[-1] - 3)) for c in combinations(range(1, 4 + GAPS), 3)]


@dataclass(frozen=True)
class Training:
    #: Bound of the labelled rows that the classifier is fitted on, taken by hash of the id.
    max_documents: int = 12_000
    toxic_landmarks: int = 160
    clean_landmarks: int = 64
    rounds: int = 2
    penalty: float = 0.05
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    offset: float


def _letters() -> np.ndarray:
    table = np.full(1 << 16, DROP, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isspace():
            table[cp] = 0
        elif c.isalpha():
            small = c.lower()[0]
            found = ACCENTED.find(small)
            table[cp] = ord(small) - 96 if "a" <= small <= "z" else 27 + found if found >= 0 else BASE - 1
    return table


LETTERS = _letters()


def codes(text: str | None) -> np.ndarray:
    """Letters from 1, white space 0 and never twice; white space between single letters is left out."""
    cps = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.where(cps < 1 << 16, LETTERS[np.minimum(cps, 0xFFFF)], BASE - 1).astype(np.uint8)
    x = np.concatenate([[0], x[x != DROP], [0]]).astype(np.uint8)
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
    if len(x) > 4:
        gap = x == 0
        alone = np.zeros(len(x), bool)
        alone[2:-2] = gap[2:-2] & gap[:-4] & gap[4:]
        x = x[~alone]
    return x


def together(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with padding between them, and where each starts."""
    pad = np.zeros(PAD, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + PAD for t in texts])])[:-1]
    return np.concatenate([p for t in texts for p in (t, pad)]), starts


def subsequences(x: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For every gap pattern: the subsequence that starts at each position, as a number, and its weight."""
    n = max(0, len(x) - 3 - GAPS)
    wide = x.astype(np.int32)
    for offsets, weight in PATTERNS:
        number = np.zeros(n, np.int32)
        for o in offsets:
            number = number * BASE + wide[o:o + n]
        yield number, weight


SEEN = WINDOW + 3 + GAPS
WEIGHTS = np.repeat([w for _, w in PATTERNS], WINDOW)
#: Letters that a worker scores at once.
HELD = 1 << 19
#: Rows of a training matrix that are worked on at once.
ROWS = 1 << 11


def window_features(windows: np.ndarray | Sequence[bytes]) -> np.ndarray:
    """Subsequence numbers of windows, one row each, in the order of ``WEIGHTS``; those that end in white space are 0.

    Windows are rows of ``SEEN`` codes, or byte strings that are cut or filled to that."""
    if not isinstance(windows, np.ndarray):
        flat = b"".join(w[:SEEN].ljust(SEEN, b"\0") for w in windows)
        windows = np.frombuffer(flat, np.uint8).reshape(-1, SEEN)
    out = np.zeros((len(windows), len(WEIGHTS)), np.int32)
    for j, (offsets, _) in enumerate(PATTERNS):
        number = out[:, j * WINDOW:(j + 1) * WINDOW]
        for o in offsets:
            number *= BASE
            number += windows[:, o:o + WINDOW]
        number[number % BASE == 0] = 0
    return out


def features(window: bytes) -> dict[int, float]:
    """Weighted subsequence counts of one window, scaled to a self-kernel of 1."""
    out: dict[int, float] = {}
    for k, weight in zip(window_features([window])[0].tolist(), WEIGHTS.tolist()):
        if k:
            out[k] = out.get(k, 0.0) + weight
    norm = np.sqrt(sum(v * v for v in out.values())) or 1.0
    return {k: v / norm for k, v in out.items()}


def window_scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel value of the window that starts at each position against the folded landmarks."""
    n = max(0, len(x) - 3 - GAPS)
    score = np.zeros(n + 1)
    for number, weight in subsequences(x):
        score[1:] += weight * weights[number]
    total = np.cumsum(score)
    ends = np.minimum(np.arange(n) + WINDOW, n)
    return total[ends] - total[:n]


def strongest(texts: Sequence[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sum of its best ``WITNESSES`` windows that do not overlap, where they start (-1: none), and the
    joined array. Windows that speak against toxicity never count."""
    x, starts = together(texts)
    s = window_scores(x, weights)
    best = np.zeros(len(texts))
    at = np.full((len(texts), WITNESSES), -1, np.int64)
    for i, (a, t) in enumerate(zip(starts.tolist(), texts)):
        part = s[a:a + len(t)]
        for k in range(WITNESSES):
            top = int(part.argmax()) if len(part) else 0
            if not len(part) or part[top] <= 0:
                break
            best[i] += part[top]
            at[i, k] = a + top
            part[max(0, top - WINDOW + 1):top + WINDOW] = 0
    return best, at, x


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = codes(text.as_py()).astype(np.int32)
            n = len(x) - GRAM + 1
            if n <= 0:
                continue
            number, inner = np.zeros(n, np.int32), np.ones(n, bool)
            for o in range(GRAM):
                number = number * BASE + x[o:o + n]
                if 0 < o < GRAM - 1:
                    inner &= x[o:o + n] > 0
            counts.append(np.unique(number[inner]).astype(np.int64) * 2 + int(label))
        if not counts:
            continue
        keys, n = np.unique(np.concatenate(counts), return_counts=True)
        toxic = keys & 1 == 1
        yield pa.record_batch([pa.array(keys >> 1), pa.array(np.where(toxic, n, 0)), pa.array(np.where(toxic, 0, n))],
                              names=["gram", "toxic", "clean"])


def _spell(gram: int) -> np.ndarray:
    return np.asarray([gram // BASE ** (GRAM - 1 - i) % BASE for i in range(GRAM)], np.uint8)


def _witnesses(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, values, held, size = [], [], [], 0
            for i, value in enumerate(batch.column(1)):
                held.append(codes(value.as_py()))
                size += len(held[-1])
                if size > HELD or i == batch.num_rows - 1:
                    best, at, x = strongest(held, weights.value)
                    found += [[x[i:i + SEEN].tobytes() for i in row if i >= 0] for row in at.tolist()]
                    values.append(best)
                    held, size = [], 0
            if found:
                yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.binary())), pa.array(np.concatenate(values))],
                                      names=["label", "seen", "score"])
    return run


def _fold(landmarks: Sequence[dict[int, float]], by: np.ndarray) -> np.ndarray:
    weights = np.zeros(BASE ** 4, np.float32)
    for z, b in zip(landmarks, by):
        for k, v in z.items():
            weights[k] += b * v
    return weights


def _kernel(rows: np.ndarray, landmarks: Sequence[dict[int, float]]) -> np.ndarray:
    """Kernel values of windows, given by their features, against the landmarks."""
    place = np.zeros(BASE ** 4, np.int32)
    numbers = sorted({k for z in landmarks for k in z})
    place[numbers] = np.arange(1, len(numbers) + 1)
    dense = np.zeros((len(numbers) + 1, len(landmarks)), np.float32)
    for j, z in enumerate(landmarks):
        for k, v in z.items():
            dense[place[k], j] = v
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for j, weight in enumerate(WEIGHTS):
        at = place[rows[:, j]]
        some = np.flatnonzero(at)
        out[some] += np.float32(weight) * dense[at[some]]
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear SVM with squared hinge loss, classes weighted alike, by Newton steps."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    ridge = np.full(x.shape[1] + 1, penalty)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1] + 1)
    for _ in range(30):
        grad, hess = ridge * w, np.diag(ridge)
        for i in range(0, len(x), ROWS):  # sums over blocks of rows, so that no copy of all of them is held
            part = slice(i, i + ROWS)
            a = np.hstack([x[part], np.ones((len(x[part]), 1))])
            slack = 1 - sign[part] * (a @ w)
            on = slack > 0
            grad -= (share[part] * sign[part] * np.maximum(slack, 0)) @ a
            hess += (a[on] * share[part][on, None]).T @ a[on]
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def logistic(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, with targets drawn in by the class sizes."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.std(score)))
    a = np.stack([(score - score.mean()) / scale, np.ones(len(score))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(0.0, float(w[0])) / scale
    return slope, float(w[1]) - slope * float(score.mean())


def fit(labelled: DataFrame, training: Training = Training()) -> Model:
    """Fit on ``labelled`` (label, text), which the caller has bounded. Without both labels or without any landmark the
    model gives every text the share of toxic rows."""
    spark = labelled.sparkSession
    labelled = durable(labelled.select(F.col("label").cast("int").alias("label"), "text").where("label IS NOT NULL"))
    pos, neg = labelled.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    base = (pos + 1) / (pos + neg + 2)
    flat = Model(np.zeros(BASE ** 4, np.float32), 0.0, float(np.log(base / (1 - base))))
    if not pos or not neg:
        return flat
    counted = (labelled.mapInArrow(_grams, "gram long, toxic long, clean long").groupBy("gram")
               .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 3"))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log(
        (1 - share) / (1 - base))).otherwise(0.0)
    counted = durable(counted.withColumn("gain", F.when(share > base, gain).otherwise(0.0)))
    least = float(np.log(max(1, counted.count()))) + 2.0
    top = (counted.where((F.col("gain") > least) & (share > 0.4)).orderBy(F.desc("gain"), "gram")
           .limit(training.toxic_landmarks).select("gram").collect())
    if not top:
        return flat
    toxic = [features(_spell(r["gram"]).tobytes()) for r in top]
    weights = _fold(toxic, np.ones(len(toxic)))

    def witnesses() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label, bag of windows and score of every row, in an order of their own values."""
        sent = spark.sparkContext.broadcast(weights)
        found = labelled.mapInArrow(_witnesses(sent), "label int, seen array<binary>, score double").toArrow()
        sent.destroy()
        label, value = (found.column(c).to_numpy() for c in ("label", "score"))
        bags = bags_of(found.column("seen").combine_chunks())
        by = np.lexsort((value, ordered(bags)[1], label > 0))
        return (label > 0)[by], bags[by], value[by]

    clean = np.zeros((0, WITNESSES, SEEN + 1), np.uint8)
    for _ in range(training.rounds):
        toxic_rows, bags, _ = witnesses()
        clean = np.concatenate([clean, bags[~toxic_rows]])
        clean = clean[ordered(clean)[0]]
        bags = np.concatenate([bags[toxic_rows], clean])
        first, place = ordered(bags.reshape(-1, 1, SEEN + 1))
        names = bags.reshape(-1, SEEN + 1)[first]
        place = np.where(bags[:, :, -1] > 0, place.reshape(len(bags), WITNESSES), len(names))  # behind the last: no window
        names = names[:, :SEEN]
        numbers = window_features(names)
        value = np.concatenate([weights[numbers] @ WEIGHTS.astype(np.float32), [0]])
        hard = np.unique(place[len(bags) - len(clean):])
        hard = hard[hard < len(names)]
        hard = hard[np.lexsort((hard, -value[hard]))][:training.clean_landmarks].tolist()
        landmarks = [*toxic, *[z for z in (features(names[i].tobytes()) for i in hard) if z]]
        gram = np.stack([[sum(v * y.get(k, 0.0) for k, v in x.items()) for y in landmarks] for x in landmarks])
        values, vectors = np.linalg.eigh(gram)
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        single = np.vstack([_kernel(numbers, landmarks), np.zeros((1, len(landmarks)), np.float32)])
        del numbers
        bag = np.zeros((len(bags), int(kept.sum())), np.float32)
        for i in range(0, len(bags), ROWS):
            bag[i:i + ROWS] = single[place[i:i + ROWS]].sum(axis=1, dtype=np.float64) @ root
        del single
        svm, _ = squared_hinge(bag, np.arange(len(bags)) < len(bags) - len(clean), training.penalty)
        weights = _fold(landmarks, root @ svm)
    label, _, value = witnesses()
    return Model(weights, *logistic(value, label.astype(int)))


def bags_of(seen: pa.ListArray) -> np.ndarray:
    """Windows of each row as codes, ``WITNESSES`` rows of ``SEEN`` filled with 0, and a last column that is 1 for a window."""
    out = np.zeros((len(seen), WITNESSES, SEEN + 1), np.uint8)
    count = np.diff(seen.offsets.to_numpy())
    row = np.repeat(np.arange(len(seen)), count)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    out[row, slot, SEEN] = 1
    windows = seen.flatten()
    size = np.asarray(pc.binary_length(windows).to_numpy(zero_copy_only=False), np.int64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat = np.frombuffer(b"".join(windows.to_pylist()), np.uint8)
    out[np.repeat(row, size), np.repeat(slot, size), at] = flat
    return out


def ordered(bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct bag occurs first, in the order of their bytes, and the number of each bag among them."""
    flat = np.ascontiguousarray(bags).reshape(len(bags), -1)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, number = np.unique(flat.view(f"V{flat.shape[1]}")[:, 0], return_index=True, return_inverse=True)[1:]
    return first, number.reshape(-1)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``name``: the strongest windows decide. Null, empty and letter-free
    texts score as one without any match."""
    kept = docs.drop(name)
    position = kept.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            out, held, size = [], [], 0
            for i, value in enumerate(batch.column(position)):
                held.append(codes(value.as_py()))
                size += len(held[-1])
                if size > HELD or i == batch.num_rows - 1:
                    out.append(strongest(held, m.weights)[0])
                    held, size = [], 0
            raw = np.concatenate(out) if out else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(m.slope * raw + m.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    schema = kept.withColumn(name, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for ids that never teach."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """(label, text) of at most about ``max_documents`` labelled rows that may teach, chosen by hash of the id.

    One label per id (the larger of repeated ones) and one text (that with the least hash); the labels joined are bounded
    by that number, so they are sent to all tasks and only texts of the sample move."""
    known = (labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
             .where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label")))
    n = known.count()
    share = min(1.0, training.max_documents / max(1, n))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(training.seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")


def toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training(), threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text); repeated rows stay."""
    model = fit(training_rows(docs, labels, training), training)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
