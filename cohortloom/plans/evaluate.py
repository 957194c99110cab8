"""Queries of the evaluation layer: confusion, thresholds, ranking, calibration, subgroups, gates, trials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import comparison as K
from ..operators import metrics as M
from .registry import R, VISITS, query, r6, rounded, table, visits

_LEVELS = [1, 2, 3, 4, 5]
_V = f"WITH {VISITS}"
_CONF = f"""{_V}, lv AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS l), cc AS (SELECT acuity, acuity_pred, count(*) AS n FROM v GROUP BY 1, 2),
cf AS (SELECT a.l AS true_label, b.l AS pred_label, coalesce(n, 0)::BIGINT AS n FROM lv a CROSS JOIN lv b LEFT JOIN cc ON cc.acuity = a.l AND cc.acuity_pred = b.l)"""
_PC = f"""{_CONF}, tot AS (SELECT sum(n) AS total FROM cf),
sd AS (SELECT lv.l AS label, (SELECT sum(n) FROM cf WHERE true_label = lv.l)::BIGINT AS support, (SELECT sum(n) FROM cf WHERE pred_label = lv.l)::BIGINT AS predicted,
  (SELECT sum(n) FROM cf WHERE true_label = lv.l AND pred_label = lv.l)::BIGINT AS tp FROM lv),
pc AS (SELECT label, support, tp, predicted - tp AS fp, support - tp AS fn, (total - predicted - support + tp)::BIGINT AS tn,
  CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc FROM sd, tot),
pf AS (SELECT *, tn / greatest(tn + fp, 1) AS sp, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM pc)"""


def _conf(spark, sf):
    return M.confusion(visits(spark, sf), "acuity", "acuity_pred", _LEVELS)


@query("confusion", f"{_CONF} SELECT true_label, pred_label, n, {R('n / (sum(n) OVER (PARTITION BY true_label))')} AS row_share FROM cf")
def confusion(spark, sf):
    return _conf(spark, sf)


@query("confusion_wide", f"{_V} SELECT acuity AS true_label, {', '.join(f'count(CASE WHEN acuity_pred = {k} THEN 1 END) AS pred_{k}' for k in _LEVELS)} FROM v GROUP BY 1")
def confusion_wide(spark, sf):
    return M.confusion_wide(_conf(spark, sf), _LEVELS)


@query("per_class", f"""{_PC} SELECT label, {R('pr')} AS "precision", {R('rc')} AS recall, {R('sp')} AS specificity, {R('f1')} AS f1, support, tp, fp, fn, tn FROM pf""")
def per_class(spark, sf):
    return rounded(M.per_class(_conf(spark, sf)), "precision", "recall", "specificity", "f1")


@query("multiclass_report", f"""{_PC} SELECT sum(support)::BIGINT AS n, count(*) AS n_classes, {R('sum(tp) / sum(support)')} AS accuracy, {R('avg(CASE WHEN support > 0 THEN rc END)')} AS balanced_accuracy,
  {R('avg(pr)')} AS precision_macro, {R('avg(rc)')} AS recall_macro, {R('avg(f1)')} AS f1_macro, {R('sum(pr * support) / sum(support)')} AS precision_weighted,
  {R('sum(rc * support) / sum(support)')} AS recall_weighted, {R('sum(f1 * support) / sum(support)')} AS f1_weighted FROM pf""")
def multiclass_report(spark, sf):
    rep = M.multiclass_report(M.per_class(_conf(spark, sf)))
    return rounded(rep, *[c for c in rep.columns if c not in ("n", "n_classes")])


@query("confusion_remainder", f"""{_V} SELECT o_orderstatus, count(*) AS n, count(CASE WHEN acuity NOT IN (1, 2, 3) THEN 1 END) AS n_truth,
  count(CASE WHEN acuity IN (1, 2, 3) AND (pa IS NULL OR pa NOT IN (1, 2, 3)) THEN 1 END) AS n_pred
FROM (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN acuity_pred END AS pa FROM v) GROUP BY 1""")
def confusion_remainder(spark, sf):
    """Rows outside a table of three labels, some predictions missing."""
    v = visits(spark, sf).withColumn("pa", F.when(F.col("o_orderkey") % 11 != 0, F.col("acuity_pred")))
    return M.confusion_remainder(v, "acuity", "pa", [1, 2, 3], ["o_orderstatus"])


_KAPPA = "1 - sum({w} * n) / sum({w} * e)"


@query("kappa", f"""{_CONF}, ce AS (SELECT n, abs(true_label - pred_label) AS d, (sum(n) OVER (PARTITION BY true_label)) * (sum(n) OVER (PARTITION BY pred_label)) / (sum(n) OVER ()) AS e FROM cf)
SELECT {R(_KAPPA.format(w='(CASE WHEN d > 0 THEN 1 ELSE 0 END)'))} AS kappa, {R(_KAPPA.format(w='d'))} AS kappa_linear, {R(_KAPPA.format(w='d * d'))} AS kappa_quadratic FROM ce""")
def kappa(spark, sf):
    return rounded(M.kappa(_conf(spark, sf), _LEVELS), "kappa", "kappa_linear", "kappa_quadratic")


# Label quality with a score from the text length.
_LAB = """lb AS (SELECT l.doc_id, quality, toxic, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS grp, n_chars / (n_chars + 4000)::DOUBLE AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _labels(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "n_chars", "lang")
    return table(spark, sf, "labels").join(d, "doc_id").select(
        "doc_id", "quality", "toxic", F.when(F.col("lang") == "en", "en").otherwise("other").alias("grp"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(4000))).alias("score"))




def _rates_sql(counts: str) -> str:
    """CTE ``rt`` with every rate derived from the four counts of ``counts``."""
    return f"""r1 AS (SELECT *, (tn + fp + fn + tp)::DOUBLE AS nn, tp / greatest(tp + fn, 1) AS sens, tn / greatest(tn + fp, 1) AS spec, tp / greatest(tp + fp, 1) AS pp, tn / greatest(tn + fn, 1) AS np,
  sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS md FROM {counts}),
rt AS (SELECT *, {R('(tp + tn) / nn')} AS accuracy, {R('sens')} AS sensitivity, {R('spec')} AS specificity, {R('pp')} AS ppv, {R('np')} AS npv, {R('2 * pp * sens / greatest(pp + sens, 1e-12)')} AS f1_admit,
  {R('2 * np * spec / greatest(np + spec, 1e-12)')} AS f1_discharge, {R('(sens + spec) / 2')} AS balanced_accuracy, {R('CASE WHEN md = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / md END')} AS mcc,
  {R('fn / greatest(fn + tp, 1)')} AS under_triage, {R('fp / greatest(fp + tn, 1)')} AS over_triage, {R('fn / nn')} AS under_rate_all, {R('fp / nn')} AS over_rate_all,
  {R('(tp + fp) / nn')} AS predicted_admit_rate, {R('sens + spec - 1')} AS youden FROM r1)"""


_RATE_COLS = ["accuracy", "sensitivity", "specificity", "ppv", "npv", "f1_admit", "f1_discharge", "balanced_accuracy", "mcc",
              "under_triage", "over_triage", "under_rate_all", "over_rate_all", "predicted_admit_rate", "youden"]


def _counts_sql(src: str, truth: str, score: str, extra: str = "") -> str:
    g = f", {extra}" if extra else ""
    return f"""ct AS (SELECT t AS threshold{g}, count(CASE WHEN {truth} = 0 AND {score} < t THEN 1 END) AS tn, count(CASE WHEN {truth} = 0 AND {score} >= t THEN 1 END) AS fp,
  count(CASE WHEN {truth} = 1 AND {score} < t THEN 1 END) AS fn, count(CASE WHEN {truth} = 1 AND {score} >= t THEN 1 END) AS tp FROM {src}, ts GROUP BY ALL)"""


def _ts(values) -> str:
    return "ts(t) AS (VALUES " + ", ".join(f"({v!r}::DOUBLE)" for v in values) + ")"


_OUT = "threshold, tn, fp, fn, tp, " + ", ".join(_RATE_COLS)


@query("binary_at", f"WITH {_LAB}, {_ts([0.5])}, {_counts_sql('lb', 'quality', 'score')}, {_rates_sql('ct')} SELECT {_OUT} FROM rt")
def binary_at(spark, sf):
    return rounded(M.binary_at(_labels(spark, sf), "quality", "score", 0.5), *_RATE_COLS)


_SWEEP = f"{_V}, {_ts(M.THRESHOLDS)}, {_counts_sql('v', 'admitted', 'score')}, {_rates_sql('ct')}"


def _sweep(spark, sf):
    return M.threshold_sweep(visits(spark, sf), "admitted", "score")


@query("threshold_sweep", f"""{_SWEEP} SELECT {_OUT}, CAST(CASE WHEN threshold IN (0.15, 0.2, 0.3, 0.4, 0.5) THEN 1 ELSE 0 END AS INTEGER) AS is_key,
  CAST(CASE WHEN threshold = 0.4 THEN 1 ELSE 0 END AS INTEGER) AS is_live FROM rt""")
def threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf), *_RATE_COLS)


@query("best_threshold", f"""{_SWEEP} SELECT (SELECT threshold FROM rt ORDER BY 2 * pp * sens / greatest(pp + sens, 1e-12) DESC, threshold LIMIT 1) AS best_f1_admit,
  (SELECT threshold FROM rt ORDER BY sens + spec - 1 DESC, threshold LIMIT 1) AS best_youden, (SELECT threshold FROM rt ORDER BY (tp + tn) / nn DESC, threshold LIMIT 1) AS best_accuracy""")
def best_threshold(spark, sf):
    return M.best_threshold(_sweep(spark, sf))


_DELTAS = ["accuracy", "sensitivity", "specificity", "under_triage", "over_triage"]
_RAW = {"accuracy": "(tp + tn) / nn", "sensitivity": "sens", "specificity": "spec", "under_triage": "fn / greatest(fn + tp, 1)", "over_triage": "fp / greatest(fp + tn, 1)"}


@query("sweep_deltas", f"""{_SWEEP}, x AS (SELECT threshold, tp, fp, {', '.join(f'{e} AS m_{c}' for c, e in _RAW.items())} FROM rt)
SELECT a.threshold, {', '.join(f"{R(f'a.m_{c} - b.m_{c}')} AS delta_{c}" for c in _DELTAS)}, a.tp - b.tp AS extra_admits_caught, a.fp - b.fp AS extra_false_admits
FROM x a JOIN x b ON b.threshold = 0.5::DOUBLE""")
def sweep_deltas(spark, sf):
    return rounded(M.sweep_deltas(_sweep(spark, sf), 0.5), *[f"delta_{c}" for c in _DELTAS])


_OP = [0.3, 0.35, 0.4, 0.45, 0.5]


@query("operating_points", f"""{_V}, {_ts(_OP)}, w AS (SELECT 'incumbent' AS model, admitted, base_score AS s FROM v UNION ALL SELECT 'best', admitted, score FROM v),
{_counts_sql('w', 'admitted', 's', 'model')}, {_rates_sql('ct')} SELECT model, threshold, accuracy, under_rate_all AS under_rate, over_rate_all AS over_rate FROM rt""")
def operating_points(spark, sf):
    out = M.operating_points(visits(spark, sf), "admitted", {"incumbent": "base_score", "best": "score"}, _OP)
    return rounded(out, "accuracy", "under_rate", "over_rate")


def _auc_sql(src: str, y: str, s: str, by: str = "") -> str:
    """CTE ``au``: exact AUC and average precision from grouped scores."""
    part, sel = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""gs AS (SELECT {sel}{s} AS s, count(CASE WHEN {y} = 1 THEN 1 END) AS p, count(CASE WHEN {y} = 0 THEN 1 END) AS q FROM {src} GROUP BY ALL),
gw2 AS (SELECT *, sum(p) OVER ({part} ORDER BY s DESC) AS cp, sum(q) OVER ({part} ORDER BY s DESC) AS cq FROM gs),
au AS (SELECT {sel}sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN 1 - sum(p * (cq - q / 2)) / (sum(p)::DOUBLE * sum(q)) END AS auc,
  CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(CASE WHEN p > 0 THEN p * cp / (cp + cq) ELSE 0 END) / sum(p) END AS ap FROM gw2 {f'GROUP BY {by}' if by else ''})"""


@query("roc_auc", f"WITH {_LAB}, {_auc_sql('lb', 'quality', 'score', 'grp')} SELECT grp, {R('auc')} AS roc_auc FROM au")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(_labels(spark, sf), "quality", "score", ["grp"]), "roc_auc")


@query("average_precision", f"WITH {_LAB}, {_auc_sql('lb', 'toxic', 'score')} SELECT {R('ap')} AS average_precision FROM au")
def average_precision(spark, sf):
    return rounded(M.average_precision(_labels(spark, sf), "toxic", "score"), "average_precision")


@query("visit_ranking", f"{_V}, {_auc_sql('v', 'admitted', 'score', 'o_orderpriority')} SELECT o_orderpriority, n_pos, n_neg, {R('auc')} AS roc_auc, {R('ap')} AS average_precision FROM au")
def visit_ranking(spark, sf):
    return rounded(M.ranking_metrics(visits(spark, sf), "admitted", "score", ["o_orderpriority"]), "roc_auc", "average_precision")


_LL = "-ln(CASE WHEN {y} = 1 THEN least(greatest({s}, 1e-12), 1 - 1e-12) ELSE 1 - least(greatest({s}, 1e-12), 1 - 1e-12) END)"


@query("brier_logloss", f"WITH {_LAB} SELECT {R('avg(power(score - quality, 2))')} AS brier, {R('avg(' + _LL.format(y='quality', s='score') + ')')} AS log_loss FROM lb")
def brier_logloss(spark, sf):
    d = _labels(spark, sf)
    both = M.brier(d, "quality", "score").withColumn("log_loss", M.log_loss(d, "quality", "score").scalar())
    return rounded(both, "brier", "log_loss")


_EDGES = M.bin_edges(10)


def _bins_sql(src: str, y: str, s: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    idx = " + ".join(f"CAST({s} >= {e!r}::DOUBLE AS INTEGER)" for e in _EDGES[1:-1])
    return f"""bn AS (SELECT {sel}CAST({idx} AS INTEGER) AS bin, count(*) AS n, avg({s}) AS mp, avg({y}) AS ob FROM {src} GROUP BY ALL),
bx AS (SELECT *, abs(mp - ob) AS gap FROM bn)"""


@query("calibration_bins", f"""{_V}, {_bins_sql('v', 'admitted', 'score')}, e AS (SELECT [{', '.join(f'{e!r}::DOUBLE' for e in _EDGES)}] AS ed)
SELECT bin, {R('ed[bin + 1]')} AS bin_lo, {R('ed[bin + 2]')} AS bin_hi, {R('(ed[bin + 1] + ed[bin + 2]) / 2')} AS bin_center, n, {R('mp')} AS mean_predicted, {R('ob')} AS observed_freq, {R('gap')} AS gap FROM bx, e""")
def calibration_bins(spark, sf):
    return rounded(M.calibration(visits(spark, sf), "admitted", "score"), "bin_lo", "bin_hi", "bin_center", "mean_predicted", "observed_freq", "gap")


@query("ece_mce", f"{_V}, {_bins_sql('v', 'admitted', 'score', 'o_orderpriority')} SELECT o_orderpriority, {R('sum(n * gap) / sum(n)')} AS ece, {R('max(gap)')} AS mce FROM bx GROUP BY 1")
def ece_mce(spark, sf):
    by = ["o_orderpriority"]
    return rounded(M.ece_mce(M.calibration(visits(spark, sf), "admitted", "score", by=by), by), "ece", "mce")


@query("binary_summary", f"""{_V}, {_auc_sql('v', 'admitted', 'score')}, {_bins_sql('v', 'admitted', 'score')},
b AS (SELECT count(*) AS n, avg(admitted) AS pv, avg(power(score - admitted, 2)) AS br, avg({_LL.format(y='admitted', s='score')}) AS ll FROM v), c AS (SELECT sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM bx)
SELECT b.n, {R('pv')} AS prevalence, {R('br')} AS brier, {R('ll')} AS log_loss, {R('auc')} AS roc_auc, {R('ap')} AS average_precision, {R('ece')} AS ece, {R('mce')} AS mce FROM b, au, c""")
def binary_summary(spark, sf):
    rep = M.binary_summary(visits(spark, sf), "admitted", "score")
    return rounded(rep, *[c for c in rep.columns if c != "n"])


# Class scores: a softmax over ten sums, entry i of a vector counting for class i modulo 10; the label is the true class.
_SM = """sm AS (SELECT vec_id, label, list_transform(x, lambda e: e / list_sum(x)) AS p FROM (
  SELECT vec_id, label, list_transform(range(0, 10), lambda k: exp(round(list_sum(list_transform(range(k + 1, 65, 10), lambda i: embedding[i]::DOUBLE)), 9))) AS x FROM embeddings)),
lg AS (SELECT vec_id, label, unnest(range(0, 10)) AS cls, unnest(p) AS s FROM sm),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS rank FROM lg)"""


def _scores(spark, sf):
    e = table(spark, sf, "embeddings")
    entries = lambda k: F.filter("embedding", lambda v, i: i % 10 == k)
    sums = [F.aggregate(entries(k), F.lit(0.0), lambda s, v: s + v.cast("double")) for k in range(10)]
    x = F.array(*[F.exp(F.round(s, 9)) for s in sums])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return e.withColumn("x", x).select("vec_id", "label", F.transform("x", lambda v: v / total(F.col("x"))).alias("p"))


@query("rank_of_true", f"WITH {_SM} SELECT vec_id, CAST(rank AS INTEGER) AS rank FROM rk WHERE cls = label")
def rank_of_true(spark, sf):
    return _scores(spark, sf).select("vec_id", M.rank_of_true(F.col("label"), F.col("p")).alias("rank"))


@query("top_classes", f"WITH {_SM} SELECT vec_id, string_agg(cls, ',' ORDER BY rank) AS top3 FROM rk WHERE rank <= 3 GROUP BY 1")
def top_classes(spark, sf):
    top = F.transform(M.top_k_classes(F.col("p"), 3), lambda c: c.cast("string"))
    return _scores(spark, sf).select("vec_id", F.array_join(top, ",").alias("top3"))


@query("topk_mrr", f"""WITH {_SM}, t AS (SELECT rank FROM rk WHERE cls = label)
SELECT count(*) AS n, {', '.join(f"{R(f'avg(CASE WHEN rank <= {k} THEN 1 ELSE 0 END)')} AS top{k}" for k in (1, 3, 5))}, {R('avg(1 / rank)')} AS mrr FROM t""")
def topk_mrr(spark, sf):
    return rounded(M.topk_mrr(_scores(spark, sf), "label", "p"), "top1", "top3", "top5", "mrr")


@query("multiclass_losses", f"""WITH {_SM} SELECT {R('sum(power(s - CASE WHEN cls = label THEN 1 ELSE 0 END, 2)) / count(DISTINCT vec_id)')} AS brier,
  {R('sum(CASE WHEN cls = label THEN -ln(s) ELSE 0 END) / count(DISTINCT vec_id)')} AS log_loss FROM lg""")
def multiclass_losses(spark, sf):
    return _scores(spark, sf).agg(r6(F.avg(M.brier_multiclass(F.col("label"), F.col("p")))).alias("brier"),
                                  r6(F.avg(M.log_loss_multiclass(F.col("label"), F.col("p")))).alias("log_loss"))


@query("ece_top_label", f"""WITH {_SM}, tl AS (SELECT s AS conf, CASE WHEN cls = label THEN 1 ELSE 0 END AS ok FROM rk WHERE rank = 1), {_bins_sql('tl', 'ok', 'conf')}
SELECT {R('sum(n * gap) / sum(n)')} AS ece_top_label FROM bx""")
def ece_top_label(spark, sf):
    d = _scores(spark, sf).withColumn("pred", F.get(M.top_k_classes(F.col("p"), 1), F.lit(0)))
    return rounded(M.ece_top_label(d, "label", "pred", "p"), "ece_top_label")


@query("auc_ovr", f"""WITH {_SM}, oy AS (SELECT cls, s, CASE WHEN cls = label THEN 1 ELSE 0 END AS y FROM lg), {_auc_sql('oy', 'y', 's', 'cls')}
SELECT CAST(cls AS INTEGER) AS label, {R('auc')} AS roc_auc, {R('avg(auc) OVER ()')} AS macro_auc FROM au""")
def auc_ovr(spark, sf):
    out = M.auc_ovr(_scores(spark, sf), "label", "p")
    return rounded(out.withColumn("macro_auc", out.agg(F.avg("roc_auc")).scalar()), "roc_auc", "macro_auc")


# --- ordinal, baselines, groups ------------------------------------------------------------------------

_ORD_COLS = {"exact": "avg(CASE WHEN e = 0 THEN 1 ELSE 0 END)", "within_1": "avg(CASE WHEN abs(e) <= 1 THEN 1 ELSE 0 END)", "within_2": "avg(CASE WHEN abs(e) <= 2 THEN 1 ELSE 0 END)",
             "mae": "avg(abs(e))", "mean_signed_error": "avg(e)", "under_triage_rate": "avg(CASE WHEN e > 0 THEN 1 ELSE 0 END)", "over_triage_rate": "avg(CASE WHEN e < 0 THEN 1 ELSE 0 END)",
             "critical_under_triage_overall": "avg(CASE WHEN acuity <= 2 AND acuity_pred > 2 THEN 1 ELSE 0 END)",
             "critical_under_triage_among_critical": "avg(CASE WHEN acuity <= 2 THEN CASE WHEN acuity_pred > 2 THEN 1 ELSE 0 END END)"}
_ORD = "count(*) AS n, " + ", ".join(f"{R(e)} AS {c}" for c, e in _ORD_COLS.items())


@query("ordinal_report", f"{_V} SELECT {_ORD} FROM (SELECT *, acuity_pred - acuity AS e FROM v)")
def ordinal_report(spark, sf):
    return rounded(M.ordinal_report(visits(spark, sf), "acuity", "acuity_pred"), *_ORD_COLS)


@query("report_by_group", f"{_V} SELECT o_orderstatus, {_ORD} FROM (SELECT *, acuity_pred - acuity AS e FROM v) GROUP BY 1")
def report_by_group(spark, sf):
    return rounded(M.report_by(visits(spark, sf), "acuity", "acuity_pred", "o_orderstatus"), *_ORD_COLS)


@query("level_distributions", f"""{_V} SELECT level, sum(t)::BIGINT AS n_true, sum(p)::BIGINT AS n_pred FROM (SELECT acuity AS level, 1 AS t, 0 AS p FROM v UNION ALL SELECT acuity_pred, 0, 1 FROM v) GROUP BY 1""")
def level_distributions(spark, sf):
    return M.level_distributions(visits(spark, sf), "acuity", "acuity_pred", _LEVELS)


@query("rate_by_level", f"{_V} SELECT acuity AS level, count(*) AS n, {R('avg(CASE WHEN acuity = acuity_pred THEN 1 ELSE 0 END)')} AS accuracy, {R('avg(admitted)')} AS observed_rate FROM v GROUP BY 1")
def rate_by_level(spark, sf):
    return rounded(M.rate_by_level(visits(spark, sf), "acuity", "acuity_pred", "admitted"), "accuracy", "observed_rate")


@query("accuracy_by_group", f"""{_V} SELECT o_custkey, count(*) AS n, {R('avg(CASE WHEN acuity = acuity_pred THEN 1 ELSE 0 END)')} AS accuracy FROM v GROUP BY 1 HAVING count(*) >= 12""")
def accuracy_by_group(spark, sf):
    return rounded(M.accuracy_by(visits(spark, sf), "acuity", "acuity_pred", "o_custkey", 12), "accuracy")


_TRAIN = "o_orderstatus <> 'F'"


@query("majority_baseline", f"""{_V}, te AS (SELECT * FROM v WHERE NOT {_TRAIN}), tr AS (SELECT * FROM v WHERE {_TRAIN}),
m AS (SELECT acuity AS a FROM te GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), mt AS (SELECT acuity AS a FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT m.a AS majority_class, {R('(SELECT avg(CASE WHEN acuity = acuity_pred THEN 1 ELSE 0 END) FROM te, m WHERE acuity <> m.a)')} AS accuracy_excl_majority,
  {R('(SELECT avg(CASE WHEN acuity = mt.a THEN 1 ELSE 0 END) FROM te, mt)')} AS majority_baseline_acc FROM m""")
def majority_baseline(spark, sf):
    v = visits(spark, sf)
    out = M.majority_baseline(v.filter(f"NOT {_TRAIN}"), "acuity", "acuity_pred", v.filter(_TRAIN))
    return rounded(out, "accuracy_excl_majority", "majority_baseline_acc")


@query("random_baseline", f"""{_V}, a AS (SELECT acuity, count(*) AS n FROM v WHERE {_TRAIN} GROUP BY 1), b AS (SELECT acuity, count(*) AS n FROM v WHERE NOT {_TRAIN} GROUP BY 1)
SELECT {R('sum(a.n * b.n) / ((SELECT sum(n) FROM a)::DOUBLE * (SELECT sum(n) FROM b))')} AS weighted_random_baseline_acc FROM a JOIN b USING (acuity)""")
def random_baseline(spark, sf):
    v = visits(spark, sf)
    return rounded(M.random_baseline(v.filter(_TRAIN), v.filter(f"NOT {_TRAIN}"), "acuity"), "weighted_random_baseline_acc")


@query("accuracy_with_coverage", f"""{_V}, x AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 4 <> 0 THEN acuity_pred END AS p, acuity AS a FROM v WHERE admitted = 1)
SELECT o_orderpriority, count(*) AS n_eligible, count(p) AS n_produced, {R('count(p) / count(*)')} AS coverage, {R('count(CASE WHEN p = a THEN 1 END) / count(*)')} AS accuracy_over_eligible,
  {R('count(CASE WHEN p = a THEN 1 END) / count(p)')} AS accuracy_over_produced FROM x GROUP BY 1""")
def accuracy_with_coverage(spark, sf):
    made = F.col("o_orderkey") % 4 != 0
    out = M.accuracy_with_coverage(visits(spark, sf), F.col("admitted") == 1, made, F.col("acuity") == F.col("acuity_pred"), ["o_orderpriority"])
    return rounded(out, "coverage", "accuracy_over_eligible", "accuracy_over_produced")


_SUBS = {"large": "o_totalprice > 250000", "urgent": "o_orderpriority = '1-URGENT'", "early": "o_orderdate < TIMESTAMP '1996-01-01'", "tiny": "o_totalprice < 1500", "one_class": "o_orderstatus = 'F'"}


@query("subgroup_report", f"""{_V}, sg AS ({' UNION ALL '.join(f"SELECT '{n}' AS subgroup, * FROM v WHERE {c}" for n, c in _SUBS.items())}),
x AS (SELECT subgroup, count(*) AS n, sum(admitted) AS np, avg(admitted) AS ar, avg(CASE WHEN (base_score >= 0.4) = (admitted = 1) THEN 1 ELSE 0 END) AS ba, avg(CASE WHEN (score >= 0.4) = (admitted = 1) THEN 1 ELSE 0 END) AS ma,
  avg(CASE WHEN admitted = 1 AND score < 0.4 THEN 1 ELSE 0 END) AS un, avg(CASE WHEN admitted = 0 AND score >= 0.4 THEN 1 ELSE 0 END) AS ov FROM sg GROUP BY 1),
l AS (SELECT subgroup || '|b' AS k, admitted, base_score AS s FROM sg UNION ALL SELECT subgroup || '|m', admitted, score FROM sg), {_auc_sql('l', 'admitted', 's', 'k')},
y AS (SELECT x.*, b.auc AS bauc, m.auc AS mauc, n >= 200 AND np > 0 AND np < n AS ok FROM x LEFT JOIN au b ON b.k = subgroup || '|b' LEFT JOIN au m ON m.k = subgroup || '|m')
SELECT subgroup, n, {', '.join(f"CASE WHEN ok THEN {R(e)} END AS {c}" for c, e in {'admit_rate': 'ar', 'base_acc': 'ba', 'model_acc': 'ma', 'delta_acc': 'ma - ba', 'base_auc': 'bauc', 'model_auc': 'mauc', 'under_triage': 'un / greatest(ar, 1e-9)', 'over_triage': 'ov / greatest(1 - ar, 1e-9)'}.items())},
  CASE WHEN NOT ok THEN 'too small / single-class' END AS note FROM y""")
def subgroup_report(spark, sf):
    out = M.subgroup_report(visits(spark, sf), "admitted", "base_score", "score", {n: F.expr(c) for n, c in _SUBS.items()})
    return rounded(out, *[c for c in out.columns if c not in ("subgroup", "n", "note")])


@query("lift", f"""{_V}, w AS (SELECT 'base' AS model, admitted, base_score AS s FROM v UNION ALL SELECT 'model', admitted, score FROM v), {_ts([0.4])}, {_counts_sql('w', 'admitted', 's', 'model')}, {_rates_sql('ct')},
{_auc_sql('w', 'admitted', 's', 'model')}, {_bins_sql('w', 'admitted', 's', 'model')}, bb AS (SELECT model, avg(power(s - admitted, 2)) AS br FROM w GROUP BY 1), ec AS (SELECT model, sum(n * gap) / sum(n) AS ece FROM bx GROUP BY 1),
m AS (SELECT rt.model, unnest(['roc_auc', 'brier', 'ece', 'accuracy', 'under_triage', 'over_triage', 'sensitivity', 'specificity']) AS metric,
  unnest([auc, br, ece, (tp + tn) / nn, fn / greatest(fn + tp, 1), fp / greatest(fp + tn, 1), sens, spec]) AS val FROM rt JOIN au USING (model) JOIN bb USING (model) JOIN ec USING (model))
SELECT metric, {R("max(CASE WHEN model = 'base' THEN val END)")} AS base, {R("max(CASE WHEN model = 'model' THEN val END)")} AS model,
  {R("max(CASE WHEN model = 'model' THEN val END) - max(CASE WHEN model = 'base' THEN val END)")} AS lift FROM m GROUP BY 1""")
def lift(spark, sf):
    return rounded(M.lift(visits(spark, sf), "admitted", "base_score", "score"), "base", "model", "lift")


@query("decision_flip", f"""{_V}, d AS (SELECT *, score >= 0.4 AS ad, base_score >= 0.4 AS bf, round(score - 0.4, 9) AS mg FROM v)
SELECT CASE WHEN ad THEN 'ADMIT' ELSE 'DISCHARGE' END AS decision, CAST(CASE WHEN ad <> bf THEN 1 ELSE 0 END AS INTEGER) AS flipped,
  CASE WHEN ad AND NOT bf THEN 'discharge -> admit' WHEN bf AND NOT ad THEN 'admit -> discharge' END AS direction,
  CASE WHEN score > 0.85 THEN 'very high' WHEN score > 0.70 THEN 'high' WHEN mg BETWEEN 0 AND 0.10 THEN 'borderline admit' WHEN mg > 0.10 THEN 'modest' WHEN mg < 0 AND mg >= -0.10 THEN 'borderline discharge' ELSE 'high discharge' END AS band,
  concat_ws('; ', CASE WHEN acuity <= 2 THEN 'acute' END, CASE WHEN o_totalprice > 400000 THEN 'large order' END) AS reasons, count(*) AS n FROM d GROUP BY ALL""")
def decision_flip(spark, sf):
    out = M.decision_flip(visits(spark, sf), "score", "base_score", 0.4, {"acute": F.col("acuity") <= 2, "large order": F.col("o_totalprice") > 400000})
    return out.groupBy("decision", "flipped", "direction", "band", "reasons").agg(F.count("*").alias("n"))


# --- comparisons and trials ----------------------------------------------------------------------------

_LONG = "SELECT '{side}' AS side, unnest(['" + "', '".join(_ORD_COLS) + "']) AS metric, unnest([" + ", ".join(_ORD_COLS.values()) + "]) AS val FROM (SELECT *, acuity_pred - acuity AS e FROM v) WHERE {cond}"


def _long_report(spark, sf, cond):
    return K.to_long_metrics(M.ordinal_report(visits(spark, sf).filter(cond), "acuity", "acuity_pred")).filter("metric <> 'n'")


@query("compare_metrics", f"""{_V}, l AS ({_LONG.format(side='a', cond="o_orderstatus = 'F'")} UNION ALL {_LONG.format(side='b', cond="o_orderstatus = 'O'")}),
p AS (SELECT metric, max(CASE WHEN side = 'a' AND metric <> 'within_2' THEN val END) AS a, max(CASE WHEN side = 'b' THEN val END) AS b FROM l GROUP BY 1),
d AS (SELECT *, b - a AS dl, CASE WHEN regexp_matches(metric, 'under_triage|over_triage|mae|brier|log_loss|ece|mce|mean_signed_error') THEN 'lower_better' ELSE 'higher_better' END AS direction FROM p)
SELECT metric, direction, {R('a')} AS tool_a, {R('b')} AS tool_b, {R('dl')} AS delta, CASE WHEN abs(dl) > 1e-9 THEN CASE WHEN (direction = 'higher_better') = (dl > 0) THEN 'tool_b' ELSE 'tool_a' END ELSE '' END AS better FROM d""")
def compare_metrics(spark, sf):
    """Two groups of visits as two backends; one metric is missing on one side."""
    a = _long_report(spark, sf, "o_orderstatus = 'F'").filter("metric <> 'within_2'")
    out = K.compare_metrics(a, _long_report(spark, sf, "o_orderstatus = 'O'"), "tool_a", "tool_b")
    return rounded(out, "tool_a", "tool_b", "delta")


@query("parser_cost", f"""{_V}, l AS ({_LONG.format(side='r', cond="true")} UNION ALL {_LONG.format(side='d', cond="o_orderstatus = 'F'")} UNION ALL {_LONG.format(side='p', cond="o_orderstatus = 'P'")}),
p AS (SELECT metric, max(CASE WHEN side = 'r' THEN val END) AS r, max(CASE WHEN side = 'd' THEN val END) AS d, max(CASE WHEN side = 'p' THEN val END) AS p FROM l GROUP BY 1)
SELECT metric, {R('r')} AS reference, {R('d')} AS direct, {R('p')} AS parsed, {R('p - d')} AS parsed_cost,
  CASE WHEN regexp_matches(metric, 'under_triage|over_triage|mae|brier|log_loss|ece|mce|mean_signed_error') THEN 'lower_better' ELSE 'higher_better' END AS direction FROM p""")
def parser_cost(spark, sf):
    out = K.cost_decomposition(_long_report(spark, sf, "true"), _long_report(spark, sf, "o_orderstatus = 'F'"),
                               {"parsed": _long_report(spark, sf, "o_orderstatus = 'P'")})
    return rounded(out, "reference", "direct", "parsed", "parsed_cost")


@query("regression_gate", f"""{_V}, l AS ({_LONG.format(side='a', cond="o_orderstatus = 'F'")} UNION ALL {_LONG.format(side='b', cond="true")}),
p AS (SELECT metric, max(CASE WHEN side = 'a' AND metric <> 'mae' THEN val END) AS a, max(CASE WHEN side = 'b' AND metric <> 'exact' THEN val END) AS b FROM l GROUP BY 1)
SELECT metric, {R('a')} AS reference, {R('b')} AS new, {R('b - a')} AS delta, CASE WHEN b - a IS NULL THEN 'NO_REF' WHEN abs(b - a) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM p""")
def regression_gate(spark, sf):
    ref = _long_report(spark, sf, "o_orderstatus = 'F'").filter("metric <> 'mae'")
    new = _long_report(spark, sf, "true").filter("metric <> 'exact'")
    return rounded(K.regression_gate(new, ref, 0.01), "reference", "new")


@query("compare_per_class", f"""{_PC.replace('pf AS (', 'pf0 AS (').replace('FROM v GROUP', "FROM v WHERE o_orderstatus = 'F' GROUP")},
{_PC.split('AS base_score')[1].split('FROM orders),', 1)[1].replace('lv AS', 'lv2 AS').replace('FROM lv', 'FROM lv2').replace('JOIN lv b', 'JOIN lv2 b').replace('lv.l', 'lv2.l').replace('cc AS', 'cc2 AS').replace('JOIN cc ON cc.', 'JOIN cc2 cc ON cc.').replace('cf AS', 'cf2 AS').replace('FROM cf', 'FROM cf2').replace('tot AS', 'tot2 AS').replace('FROM sd, tot', 'FROM sd2, tot2').replace('sd AS', 'sd2 AS').replace('pc AS', 'pc2 AS').replace('FROM pc)', 'FROM pc2)').replace('pf AS', 'pf1 AS')}
SELECT a.label, b.support, {R('b.pr')} AS "precision", {R('b.rc')} AS recall, {R('b.f1')} AS f1, {R('a.pr')} AS base_precision, {R('a.rc')} AS base_recall, {R('a.f1')} AS base_f1, {R('b.rc - a.rc')} AS delta_recall
FROM pf1 b LEFT JOIN pf0 a ON a.label = b.label""")
def compare_per_class(spark, sf):
    v = visits(spark, sf)
    base = M.per_class(M.confusion(v.filter("o_orderstatus = 'F'"), "acuity", "acuity_pred", _LEVELS))
    out = K.compare_per_class(base, M.per_class(M.confusion(v, "acuity", "acuity_pred", _LEVELS)))
    return rounded(out, "precision", "recall", "f1", "base_precision", "base_recall", "base_f1", "delta_recall")


# Suppliers stand for trials: average price up, average discount down, average quantity up.
_TR = """tr AS (SELECT l_suppkey AS trial, round(avg(l_extendedprice), 2) AS price, round(avg(l_discount), 5) AS discount, round(avg(l_quantity), 3) AS quantity FROM lineitem GROUP BY 1)"""


def _trials(spark, sf):
    return table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity").groupBy(F.col("l_suppkey").alias("trial")).agg(
        F.round(F.avg("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 5).alias("discount"), F.round(F.avg("l_quantity"), 3).alias("quantity"))


def _sql_mean(col: str, digits: int) -> str:
    units, n, unit = f"sum(CAST(floor({col} * 1000000 + 0.5::DOUBLE) AS BIGINT))", f"count({col})", 10 ** 6
    half_up = f"(2 * abs({units}) * {10 ** digits} + {n} * {unit}) // (2 * nullif({n}, 0) * {unit})"
    return f"CAST(sign({units}) * ({half_up}) AS DOUBLE) / {float(10 ** digits)}::DOUBLE"


def _mean(col: str, digits: int) -> Column:
    """Mean of amounts of up to six places, rounded half up by whole numbers, so that neither the order of the rows nor the
    binary form of a mean that lies half way decides its last digit."""
    each = F.floor(F.col(col) * 1000000 + 0.5)
    n, whole = F.count(col), lambda c: c.cast("decimal(38,0)")
    ones = F.sum(F.call_function("div", each, F.lit(1000000).cast("bigint")))  # in two sums, as one may outgrow a bigint
    units = ones.cast("decimal(28,0)") * 1000000 + F.sum(each % 1000000)
    half_up = F.call_function("div", whole(F.abs(whole(units)) * (2 * 10 ** digits)) + whole(n * 10 ** 6),
                              whole(F.nullif(n, F.lit(0)) * (2 * 10 ** 6)))
    return F.signum(units) * half_up / float(10 ** digits)


# The same trials with exact means: a front of many equal trials hangs on their last digits.
_EXACT_TR = f"""tr AS (SELECT l_suppkey AS trial, {_sql_mean('l_extendedprice', 2)} AS price, {_sql_mean('l_discount', 5)} AS discount, {_sql_mean('l_quantity', 3)} AS quantity
  FROM lineitem GROUP BY 1)"""


def _exact_trials(spark, sf):
    return table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity").groupBy(F.col("l_suppkey").alias("trial")).agg(
        _mean("l_extendedprice", 2).alias("price"), _mean("l_discount", 5).alias("discount"), _mean("l_quantity", 3).alias("quantity"))


@query("pareto", f"""WITH {_EXACT_TR} SELECT trial, price, discount, quantity FROM tr a WHERE price IS NOT NULL AND discount IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tr b WHERE b.price >= a.price AND b.discount <= a.discount AND (b.price > a.price OR b.discount < a.discount))""")
def pareto(spark, sf):
    return K.pareto(_exact_trials(spark, sf), {"price": "max", "discount": "min"})


@query("pareto_three", f"""WITH {_EXACT_TR} SELECT trial, price, discount, quantity FROM tr a WHERE price IS NOT NULL AND discount IS NOT NULL AND quantity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tr b WHERE b.price >= a.price AND b.discount <= a.discount AND b.quantity >= a.quantity
  AND (b.price > a.price OR b.discount < a.discount OR b.quantity > a.quantity))""")
def pareto_three(spark, sf):
    return K.pareto(_exact_trials(spark, sf), {"price": "max", "discount": "min", "quantity": "max"})


@query("best_feasible", f"WITH {_TR} SELECT trial, price, discount FROM tr WHERE discount <= 0.05 ORDER BY price DESC, trial LIMIT 1")
def best_feasible(spark, sf):
    return K.best_feasible(_trials(spark, sf), "price", F.col("discount") <= 0.05).select("trial", "price", "discount")


@query("knee_point", f"""WITH {_TR}, fr AS (SELECT * FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.price >= a.price AND b.discount <= a.discount AND (b.price > a.price OR b.discount < a.discount)))
SELECT trial, price, CAST(CASE WHEN discount <= 0.0495 + 1e-9 THEN 1 ELSE 0 END AS INTEGER) AS feasible FROM fr ORDER BY feasible DESC, price DESC, trial LIMIT 1""")
def knee_point(spark, sf):
    front = K.pareto(_trials(spark, sf), {"price": "max", "discount": "min"})
    return K.knee_point(front, "price", "discount", F.lit(0.0495)).select("trial", "price", "feasible")


@query("version_table", f"""{_V}, y AS (SELECT year(o_orderdate)::INTEGER AS version, avg(CASE WHEN acuity = acuity_pred THEN 1 ELSE 0 END) AS exact, avg(score) AS mean_score FROM v GROUP BY 1)
SELECT version, {R('exact')} AS exact, {R('mean_score')} AS mean_score, {R('exact - lag(exact) OVER (ORDER BY version)')} AS delta_exact, {R('mean_score - lag(mean_score) OVER (ORDER BY version)')} AS delta_mean_score FROM y""")
def version_table(spark, sf):
    metas = visits(spark, sf).groupBy(F.year("o_orderdate").alias("version")).agg(
        F.avg((F.col("acuity") == F.col("acuity_pred")).cast("int")).alias("exact"), F.avg("score").alias("mean_score"))
    out = K.version_table(metas.withColumn("released", F.col("version")), "version", "released", ["exact", "mean_score"]).drop("released")
    return rounded(out, "exact", "mean_score", "delta_exact", "delta_mean_score")
