"""Evaluation reports over a predictions table.

Rows are reduced to counts first (per class pair, score bin, threshold bin or distinct score); every
derived number is computed on those small tables, so each report costs one aggregating pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import value_buckets, with_prior

# Reporting thresholds, the key ones among them and the live one.
THRESHOLDS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
KEY_THRESHOLDS = [0.15, 0.20, 0.30, 0.40, 0.50]
LIVE_THRESHOLD = 0.40


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


# --- multiclass --------------------------------------------------------------------------------------

def confusion(df: DataFrame, truth: str, pred: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """``(true_label, pred_label, n, row_share)`` for every label pair, zeros included."""
    counts = df.groupBy(*by, F.col(truth).alias("true_label"), F.col(pred).alias("pred_label")) \
        .agg(F.count("*").alias("n"))
    return complete_confusion(counts, labels, by)


def complete_confusion(counts: DataFrame, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Given label-pair counts, add the missing pairs and the share of each true class. Pairs with a NULL or unlisted
    label are no part of the table; ``confusion_remainder`` counts them."""
    lits = F.array(*[F.lit(x) for x in labels])
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    grid = groups.select("*", F.explode(lits).alias("true_label")).select("*", F.explode(lits).alias("pred_label"))
    keys = [*by, "true_label", "pred_label"]
    full = grid.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    row = F.sum("n").over(Window.partitionBy(*by, "true_label"))
    return full.withColumn("row_share", F.round(_div(F.col("n"), row), 6))


def confusion_remainder(df: DataFrame, truth: str, pred: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Rows that ``confusion`` leaves out: ``n_truth`` with a NULL or unlisted true label, ``n_pred`` with a listed true
    label but a NULL or unlisted prediction, and ``n`` rows in all. Listed pairs and these two add up to ``n``."""
    known = F.coalesce(F.col(truth).isin(*labels), F.lit(False))
    said = F.coalesce(F.col(pred).isin(*labels), F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~known).alias("n_truth"),
                               F.count_if(known & ~said).alias("n_pred"))


def confusion_wide(conf: DataFrame, labels: Sequence, prefix: str = "pred_") -> DataFrame:
    """One row per true label, one count column per predicted label."""
    wide = conf.groupBy("true_label").pivot("pred_label", list(labels)).agg(F.sum("n"))
    return wide.select("true_label", *[F.col(f"`{x}`").alias(f"{prefix}{x}") for x in labels])


def per_class(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, specificity, F1, support and the four counts per class."""
    n, hit = F.col("n"), F.col("true_label") == F.col("pred_label")
    zero = F.lit(0).cast("bigint")
    sides = conf.select(*by, F.col("true_label").alias("label"), n.alias("support"), zero.alias("predicted"),
                        F.when(hit, n).otherwise(0).alias("tp")) \
        .unionByName(conf.select(*by, F.col("pred_label").alias("label"), zero.alias("support"), n.alias("predicted"),
                                 zero.alias("tp")))
    agg = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    total = F.sum("support").over(Window.partitionBy(*by))
    out = agg.withColumn("__total", total)
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("__total") - tp - fp - fn
    p, r = _div(tp, F.col("predicted")), _div(tp, F.col("support"))
    return out.select(*by, "label", p.alias("precision"), r.alias("recall"),
                      (tn / F.greatest(tn + fp, F.lit(1))).alias("specificity"), _div(2 * p * r, p + r).alias("f1"),
                      "support", "tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))


def multiclass_report(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted averages from the per-class table."""
    s = F.sum("support")
    weighted = lambda c: _div(F.sum(F.col(c) * F.col("support")), s)
    return classes.groupBy(*by).agg(
        s.alias("n"), F.count("*").alias("n_classes"), _div(F.sum("tp"), s).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")])


def kappa(conf: DataFrame, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa: unweighted, linear and quadratic in the label positions."""
    pos = lambda c: F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c))
    gap = F.abs(pos("true_label") - pos("pred_label")).cast("double")
    total = F.sum("n").over(Window.partitionBy(*by))
    rows = F.sum("n").over(Window.partitionBy(*by, "true_label"))
    cols = F.sum("n").over(Window.partitionBy(*by, "pred_label"))
    cells = conf.select(*by, "n", gap.alias("gap"), (rows / total * cols).alias("expected"))
    def one(w: Column) -> Column:
        return 1.0 - F.sum(w * F.col("n")) / F.sum(w * F.col("expected"))
    g = F.col("gap")
    return cells.groupBy(*by).agg(one((g > 0).cast("double")).alias("kappa"), one(g).alias("kappa_linear"),
                                  one(g * g).alias("kappa_quadratic"))


# --- ranks and probabilities in the row ----------------------------------------------------------------

def rank_of_true(truth: Column, scores: Column) -> Column:
    """1-based rank of the true class in a score array; equal scores rank the lower class first.
    Evaluated inside the row, without a shuffle."""
    own = F.get(scores, truth)
    ahead = F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < truth)))
    return F.when(own.isNotNull(), F.size(ahead) + 1)


def top_k_classes(scores: Column, k: int) -> Column:
    """Classes of the ``k`` best scores, best first, ties to the lower class."""
    tagged = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("cls")))
    return F.transform(F.slice(F.array_sort(tagged), 1, k), lambda x: x["cls"])


def topk_mrr(df: DataFrame, truth: str, scores: str, ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = ()) -> DataFrame:
    """Top-k accuracy and mean reciprocal rank."""
    ranked = df.withColumn("__rank", rank_of_true(F.col(truth), F.col(scores)))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg((F.coalesce(F.col("__rank"), F.lit(2**31 - 1)) <= k).cast("int")).alias(f"top{k}") for k in ks],
        F.avg(F.coalesce(1.0 / F.col("__rank"), F.lit(0.0))).alias("mrr"))


def brier_multiclass(truth: Column, scores: Column) -> Column:
    """Squared error of a probability array against the one-hot truth (average it over rows)."""
    errors = F.transform(scores, lambda s, i: F.pow(s - F.when(i == truth, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(errors, F.lit(0.0), lambda a, e: a + e)


def log_loss_multiclass(truth: Column, scores: Column) -> Column:
    """Negative log of the renormalised true-class probability."""
    clip = lambda s: F.least(F.greatest(s, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + clip(s))
    return -F.log(clip(F.get(scores, truth)) / total)


# --- binary ------------------------------------------------------------------------------------------

def brier(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(truth), F.lit(2.0))).alias("brier"))


def log_loss_expr(truth: str, score: str, eps: float = 1e-12) -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1.0 - eps))
    return F.avg(-F.log(F.when(F.col(truth) == 1, p).otherwise(1.0 - p)))


def log_loss(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(log_loss_expr(truth, score).alias("log_loss"))


def threshold_counts(df: DataFrame, truth: str, score: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, tn, fp, fn, tp)``: rows are counted once per threshold interval, then the few
    interval counts are added up for each threshold."""
    ts = sorted(thresholds)
    reached = F.lit(0)
    for t in ts:
        reached = reached + (F.col(score) >= F.lit(float(t))).cast("int")
    cells = df.groupBy(*by, reached.alias("__bin")).agg(
        F.count_if(F.col(truth) == 1).alias("__pos"), F.count_if(F.col(truth) == 0).alias("__neg"))
    points = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ts)])
    yes = F.col("__bin") >= F.col("p.i")
    return cells.withColumn("p", F.explode(points)).groupBy(*by, F.col("p.threshold").alias("threshold")).agg(
        F.sum(F.when(yes, 0).otherwise(F.col("__neg"))).alias("tn"), F.sum(F.when(yes, F.col("__neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(yes, 0).otherwise(F.col("__pos"))).alias("fn"), F.sum(F.when(yes, F.col("__pos")).otherwise(0)).alias("tp"))


def binary_rates(counts: DataFrame) -> DataFrame:
    """Every rate that follows from ``tn, fp, fn, tp``. Denominators are at least 1, so an empty class
    gives 0. Under-triage is a share of the positives, ``under_rate_all`` a share of all rows."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    at_least = lambda x: F.greatest(x, F.lit(1.0))
    n = tn + fp + fn + tp
    sens, spec = tp / at_least(tp + fn), tn / at_least(tn + fp)
    ppv, npv = tp / at_least(tp + fp), tn / at_least(tn + fn)
    f1 = lambda a, b: 2 * a * b / F.greatest(a + b, F.lit(1e-12))
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns({
        "accuracy": (tp + tn) / at_least(n), "sensitivity": sens, "specificity": spec, "ppv": ppv, "npv": npv,
        "f1_admit": f1(ppv, sens), "f1_discharge": f1(npv, spec), "balanced_accuracy": (sens + spec) / 2,
        "mcc": _div(tp * tn - fp * fn, mcc_den),
        "under_triage": fn / at_least(fn + tp), "over_triage": fp / at_least(fp + tn),
        "under_rate_all": fn / at_least(n), "over_rate_all": fp / at_least(n),
        "predicted_admit_rate": (tp + fp) / at_least(n), "youden": sens + spec - 1})


def binary_at(df: DataFrame, truth: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return binary_rates(threshold_counts(df, truth, score, [threshold], by))


def threshold_sweep(df: DataFrame, truth: str, score: str, thresholds: Sequence[float] = THRESHOLDS,
                    key_points: Sequence[float] = KEY_THRESHOLDS, live: float = LIVE_THRESHOLD) -> DataFrame:
    """Rates at all thresholds, with 0/1 markers for the key thresholds and the live one."""
    out = binary_rates(threshold_counts(df, truth, score, thresholds))
    return out.withColumns({"is_key": F.col("threshold").isin([float(k) for k in key_points]).cast("int"),
                            "is_live": (F.col("threshold") == F.lit(float(live))).cast("int")})


def best_threshold(sweep: DataFrame, criteria: Sequence[str] = ("f1_admit", "youden", "accuracy")) -> DataFrame:
    """Threshold that maximises each criterion; the lower one on ties."""
    pick = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("threshold")).alias("neg")))
    return sweep.agg(*[F.round(-pick(c).getField("neg"), 6).alias(f"best_{c}") for c in criteria])


def sweep_deltas(sweep: DataFrame, current: float = 0.5,
                 cols: Sequence[str] = ("accuracy", "sensitivity", "specificity", "under_triage", "over_triage")) -> DataFrame:
    """Differences of every threshold against the current one; ``tp`` and ``fp`` as extra counts."""
    base = F.max(F.when(F.col("threshold") == F.lit(current), F.struct(*cols, "tp", "fp"))).over(Window.partitionBy())
    out = sweep.withColumn("__base", base)
    return out.select("threshold", *[(F.col(c) - F.col(f"__base.{c}")).alias(f"delta_{c}") for c in cols],
                      (F.col("tp") - F.col("__base.tp")).alias("extra_admits_caught"),
                      (F.col("fp") - F.col("__base.fp")).alias("extra_false_admits"))


def operating_points(df: DataFrame, truth: str, scores: Mapping[str, str], thresholds: Sequence[float]) -> DataFrame:
    """Accuracy, under- and over-rate (shares of all rows) for several scores at several thresholds."""
    long = df.select(F.col(truth).alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("score")) for n, c in scores.items()])).alias("s")) \
        .select("__y", "s.*")
    out = binary_rates(threshold_counts(long, "__y", "score", thresholds, ["model"]))
    return out.select("model", "threshold", "accuracy", F.col("under_rate_all").alias("under_rate"),
                      F.col("over_rate_all").alias("over_rate"))


# --- ranking metrics -----------------------------------------------------------------------------------

def ranking_metrics(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC and average precision with ties, NULL when one class is missing.

    Equal scores collapse to one row with two counts; counts of the better-scored rows come from
    bucketed prefix totals, so no task sees the whole score axis of a group."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, (-F.col(score).cast("double")).alias("__neg")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    placed = with_prior(counts, list(by), ["__neg"], value_buckets("__neg"),
                        {"pos_above": ("sum", "pos"), "neg_above": ("sum", "neg")}) \
        .fillna(0, subset=["pos_above", "neg_above"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("pos_above") + pos, F.col("neg_above") + neg
    agg = placed.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(pos * (F.col("neg_above") + neg / 2)).alias("__lost"),
        F.sum(F.when(pos > 0, pos * tp / (tp + fp)).otherwise(F.lit(0.0))).alias("__gain"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(*by, "n_pos", "n_neg",
                      F.when(both, 1.0 - F.col("__lost") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
                      F.when(both, F.col("__gain") / F.col("n_pos")).alias("average_precision"))


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, truth, score, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, truth, score, by).select(*by, "average_precision")


def auc_ovr(df: DataFrame, truth: str, scores: str) -> DataFrame:
    """One-vs-rest AUC per class position."""
    long = df.select(F.col(truth).alias("__t"), F.posexplode(scores).alias("label", "score"))
    return roc_auc(long.withColumn("y", (F.col("__t") == F.col("label")).cast("int")), "y", "score", ["label"])


# --- calibration ---------------------------------------------------------------------------------------

def bin_edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def bin_of(score: Column, n_bins: int) -> Column:
    """Number of inner edges at or below the score: equal-width, left-closed, 1.0 in the last bin."""
    idx = F.lit(0)
    for edge in bin_edges(n_bins)[1:-1]:
        idx = idx + (score >= F.lit(edge)).cast("int")
    return idx


def calibration(df: DataFrame, truth: str, score: str, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Reliability bins; empty bins do not appear."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    bins = df.groupBy(*by, bin_of(F.col(score), n_bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_predicted"),
        F.avg(F.col(truth).cast("double")).alias("observed_freq"))
    lo, hi = F.get(edges, F.col("bin")), F.get(edges, F.col("bin") + 1)
    return bins.select(*by, "bin", lo.alias("bin_lo"), hi.alias("bin_hi"), ((lo + hi) / 2).alias("bin_center"), "n",
                       "mean_predicted", "observed_freq",
                       F.abs(F.col("mean_predicted") - F.col("observed_freq")).alias("gap"))


def ece_mce(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error from reliability bins."""
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def ece_top_label(df: DataFrame, truth: str, pred: str, scores: str, n_bins: int = 10) -> DataFrame:
    """Calibration error of the largest class probability."""
    rows = df.select(F.array_max(scores).cast("double").alias("__conf"),
                     (F.col(truth) == F.col(pred)).cast("int").alias("__ok"))
    return ece_mce(calibration(rows, "__ok", "__conf", n_bins)).select(F.col("ece").alias("ece_top_label"))


# --- ordinal and grouped reports -------------------------------------------------------------------------

def ordinal_aggs(truth: str, pred: str, critical: Sequence[int] = (1, 2)) -> list[Column]:
    t, p = F.col(truth), F.col(pred)
    err = p - t
    share = lambda c: F.avg(c.cast("int"))
    crit = t.isin(*critical)
    missed = crit & ~p.isin(*critical)
    return [F.count("*").alias("n"), share(err == 0).alias("exact"), share(F.abs(err) <= 1).alias("within_1"),
            share(F.abs(err) <= 2).alias("within_2"), F.avg(F.abs(err)).alias("mae"),
            F.avg(err).alias("mean_signed_error"), share(err > 0).alias("under_triage_rate"),
            share(err < 0).alias("over_triage_rate"), share(missed).alias("critical_under_triage_overall"),
            F.avg(F.when(crit, missed.cast("int"))).alias("critical_under_triage_among_critical")]


def ordinal_report(df: DataFrame, truth: str, pred: str, critical: Sequence[int] = (1, 2),
                   by: Sequence[str] = ()) -> DataFrame:
    """Exact, within-1/2, errors and under/over rates; lower levels are more acute."""
    return df.groupBy(*by).agg(*ordinal_aggs(truth, pred, critical))


def level_distributions(df: DataFrame, truth: str, pred: str, levels: Sequence[int]) -> DataFrame:
    """Rows per level in the truth and in the predictions."""
    sides = F.array(F.struct(F.col(truth).alias("level"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                    F.struct(F.col(pred).alias("level"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    return df.select(F.explode(sides).alias("s")).select("s.*").filter(F.col("level").isin(*levels)) \
        .groupBy("level").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))


def report_by(df: DataFrame, truth: str, pred: str, group: str) -> DataFrame:
    return ordinal_report(df, truth, pred, by=[group])


def rate_by_level(df: DataFrame, truth: str, pred: str, outcome: str | None = None) -> DataFrame:
    """Accuracy per true level and, if given, the observed outcome rate."""
    aggs = [F.count("*").alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy")]
    if outcome:
        aggs.append(F.avg(F.col(outcome).cast("double")).alias("observed_rate"))
    return df.groupBy(F.col(truth).alias("level")).agg(*aggs)


def accuracy_by(df: DataFrame, truth: str, pred: str, group: str, min_n: int = 50) -> DataFrame:
    return (df.groupBy(group).agg(F.count("*").alias("n"),
                                  F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"))
            .filter(F.col("n") >= min_n))


def majority_baseline(df: DataFrame, truth: str, pred: str, train: DataFrame | None = None) -> DataFrame:
    """Majority class (smallest on ties), accuracy without it, and accuracy of always guessing the
    majority of the training rows."""
    cells = df.groupBy(F.col(truth).alias("t")).agg(
        F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(pred)).alias("ok"))
    learned = (train if train is not None else df).groupBy(F.col(truth).alias("t")).agg(F.count("*").alias("m"))
    both = cells.join(learned, "t", "full_outer").fillna(0, subset=["n", "ok", "m"])
    all_rows = Window.partitionBy()
    top = lambda c: F.min(F.struct((-F.col(c)).alias("neg"), F.col("t").alias("cls"))).over(all_rows).getField("cls")
    marked = both.withColumns({"majority_class": top("n"), "__learned": top("m")})
    rest = F.col("t") != F.col("majority_class")
    return marked.groupBy("majority_class").agg(
        (F.sum(F.when(rest, F.col("ok"))) / F.sum(F.when(rest, F.col("n")))).alias("accuracy_excl_majority"),
        (F.sum(F.when(F.col("t") == F.col("__learned"), F.col("n")).otherwise(0)) / F.sum("n")).alias("majority_baseline_acc"))


def random_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Expected accuracy of guessing classes by their training shares."""
    a = train.groupBy(label).agg(F.count("*").alias("a"))
    b = test.groupBy(label).agg(F.count("*").alias("b"))
    both = a.join(b, label, "full_outer").fillna(0, subset=["a", "b"])
    ad, bd = F.col("a").cast("double"), F.col("b").cast("double")
    return both.agg((F.sum(ad * bd) / (F.sum(ad) * F.sum(bd))).alias("weighted_random_baseline_acc"))


def accuracy_with_coverage(df: DataFrame, eligible: Column, produced: Column, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy over eligible rows (a missing prediction is a miss) and over produced predictions."""
    made = eligible & produced
    rows = df.groupBy(*by).agg(F.count_if(eligible).alias("n_eligible"), F.count_if(made).alias("n_produced"),
                               F.count_if(made & hit).alias("__ok"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return rows.select(*by, "n_eligible", "n_produced", ratio(F.col("n_produced"), F.col("n_eligible")).alias("coverage"),
                       ratio(F.col("__ok"), F.col("n_eligible")).alias("accuracy_over_eligible"),
                       ratio(F.col("__ok"), F.col("n_produced")).alias("accuracy_over_produced"))


def subgroup_report(df: DataFrame, truth: str, base: str, model: str, predicates: Mapping[str, Column],
                    threshold: float = LIVE_THRESHOLD, min_n: int = 200) -> DataFrame:
    """Overlapping subgroups: base and model accuracy, AUC and triage errors at the live threshold.
    Small or one-class subgroups carry a note instead."""
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in predicates.items()]), lambda x: x.isNotNull())
    rows = df.select(F.col(truth).alias("y"), F.col(base).cast("double").alias("b"), F.col(model).cast("double").alias("m"),
                     F.explode(tags).alias("subgroup"))
    yes = lambda c: (F.col(c) >= threshold).cast("int")
    acc = lambda c: F.avg((yes(c) == F.col("y")).cast("int"))
    rates = rows.groupBy("subgroup").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_pos"), F.avg(F.col("y").cast("double")).alias("admit_rate"),
        acc("b").alias("base_acc"), acc("m").alias("model_acc"),
        F.avg(((F.col("y") == 1) & (yes("m") == 0)).cast("int")).alias("__under"),
        F.avg(((F.col("y") == 0) & (yes("m") == 1)).cast("int")).alias("__over"))
    long = rows.select("subgroup", "y", F.explode(F.array(
        F.struct(F.lit("base").alias("model"), F.col("b").alias("score")),
        F.struct(F.lit("model").alias("model"), F.col("m").alias("score")))).alias("s")).select("subgroup", "y", "s.*")
    auc = roc_auc(long, "y", "score", ["subgroup", "model"]).groupBy("subgroup").agg(
        F.max(F.when(F.col("model") == "base", F.col("roc_auc"))).alias("base_auc"),
        F.max(F.when(F.col("model") == "model", F.col("roc_auc"))).alias("model_auc"))
    ok = (F.col("n") >= min_n) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    show = lambda c: F.when(ok, c)
    return rates.join(auc, "subgroup", "left").select(
        "subgroup", "n", show(F.col("admit_rate")).alias("admit_rate"), show(F.col("base_acc")).alias("base_acc"),
        show(F.col("model_acc")).alias("model_acc"), show(F.col("model_acc") - F.col("base_acc")).alias("delta_acc"),
        show(F.col("base_auc")).alias("base_auc"), show(F.col("model_auc")).alias("model_auc"),
        show(F.col("__under") / F.greatest(F.col("admit_rate"), F.lit(1e-9))).alias("under_triage"),
        show(F.col("__over") / F.greatest(1 - F.col("admit_rate"), F.lit(1e-9))).alias("over_triage"),
        F.when(~ok, "too small / single-class").alias("note"))


def binary_summary(df: DataFrame, truth: str, score: str, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Threshold-free numbers of a binary head: size, prevalence, AUC, AP, Brier, log-loss, ECE, MCE."""
    base = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col(truth).cast("double")).alias("prevalence"),
        F.avg(F.pow(F.col(score) - F.col(truth), F.lit(2.0))).alias("brier"), log_loss_expr(truth, score).alias("log_loss"))
    rank = ranking_metrics(df, truth, score, by).select(*by, "roc_auc", "average_precision")
    cal = ece_mce(calibration(df, truth, score, n_bins, by), by)
    if not by:
        tag = lambda x: x.withColumn("__k", F.lit(1))
        return tag(base).join(tag(rank), "__k").join(tag(cal), "__k").drop("__k")
    return base.join(rank, list(by)).join(cal, list(by))


def lift(df: DataFrame, truth: str, base: str, model: str, threshold: float = LIVE_THRESHOLD) -> DataFrame:
    """Model minus baseline on the same rows, per metric."""
    long = df.select(F.col(truth).alias("y"), F.explode(F.array(
        F.struct(F.lit("base").alias("model"), F.col(base).cast("double").alias("score")),
        F.struct(F.lit("model").alias("model"), F.col(model).cast("double").alias("score")))).alias("s")).select("y", "s.*")
    free = binary_summary(long, "y", "score", ["model"]).select("model", "roc_auc", "brier", "ece")
    live = binary_at(long, "y", "score", threshold, ["model"]).select(
        "model", "accuracy", "under_triage", "over_triage", "sensitivity", "specificity")
    wide = free.join(live, "model")
    metrics = [c for c in wide.columns if c != "model"]
    rows = wide.unpivot(["model"], [F.col(c).alias(c) for c in metrics], "metric", "value")
    return rows.groupBy("metric").agg(
        F.max(F.when(F.col("model") == "base", F.col("value"))).alias("base"),
        F.max(F.when(F.col("model") == "model", F.col("value"))).alias("model")) \
        .withColumn("lift", F.col("model") - F.col("base"))


def decision_flip(df: DataFrame, score: str, base: str, threshold: float = LIVE_THRESHOLD,
                  reasons: Mapping[str, Column] | None = None) -> DataFrame:
    """Decision at the threshold against the baseline's: flip, direction, probability band, reasons."""
    p = F.col(score)
    admit, before = p >= threshold, F.col(base) >= threshold
    # the margin is compared at nine places, so the band edges do not depend on float noise
    margin = F.round(p - F.lit(threshold), 9)
    band = (F.when(p > 0.85, "very high").when(p > 0.70, "high").when(margin.between(0, 0.10), "borderline admit")
            .when(margin > 0.10, "modest").when((margin < 0) & (margin >= -0.10), "borderline discharge")
            .otherwise("high discharge"))
    told = F.array(*[F.when(c, F.lit(n)) for n, c in (reasons or {}).items()]) if reasons else F.array().cast("array<string>")
    return df.withColumns({
        "decision": F.when(admit, "ADMIT").otherwise("DISCHARGE"), "flipped": (admit != before).cast("int"),
        "direction": F.when(admit & ~before, "discharge -> admit").when(~admit & before, "admit -> discharge"),
        "band": band, "reasons": F.array_join(F.filter(told, lambda x: x.isNotNull()), "; ")})
