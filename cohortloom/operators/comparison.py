"""Report-to-report work: alignment, direction-aware comparison, gates, trial tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import number_rows, value_buckets, with_prior

# Metric-name parts for which lower is better.
LOWER_IS_BETTER = ("under_triage", "over_triage", "mae", "brier", "log_loss", "ece", "mce",
                   "mean_signed_error", "mean_absolute_error")


def to_long_metrics(report: DataFrame, key: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Nested report -> rows ``(<key>, metric, value)`` with dotted names. Structs, maps and arrays of
    numbers are unrolled; text and booleans are skipped."""
    items: list[Column] = []

    def walk(col: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype:
                walk(col.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.NumericType):
            items.append(F.transform(F.map_entries(col), lambda e: F.struct(
                F.concat(F.lit(name + "."), e["key"].cast("string")).alias("metric"), e["value"].cast("double").alias("value"))))
        elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.NumericType):
            items.append(F.transform(col, lambda v, i: F.struct(
                F.concat(F.lit(name + "["), i.cast("string"), F.lit("]")).alias("metric"), v.cast("double").alias("value"))))
        elif isinstance(dtype, T.NumericType):
            items.append(F.array(F.struct(F.lit(name).alias("metric"), col.cast("double").alias("value"))))

    for f in report.schema:
        if f.name not in key:
            walk(F.col(f.name), f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    empty = F.array().cast("array<struct<metric:string,value:double>>")
    rows = F.flatten(F.array(*[F.coalesce(i, empty) for i in items]))
    return report.select(*key, F.explode(rows).alias("m")).select(*key, "m.metric", "m.value").filter("value IS NOT NULL")


def direction(metric: Column, lower: Sequence[str] = LOWER_IS_BETTER) -> Column:
    hit = metric.contains(lower[0])
    for part in lower[1:]:
        hit = hit | metric.contains(part)
    return F.when(hit, "lower_better").otherwise("higher_better")


def compare_metrics(a: DataFrame, b: DataFrame, name_a: str, name_b: str, lower: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """Two ``(metric, value)`` reports with delta, direction and winner; one-sided metrics stay."""
    both = a.select("metric", F.col("value").alias(name_a)).join(
        b.select("metric", F.col("value").alias(name_b)), "metric", "full_outer")
    delta = F.col(name_b) - F.col(name_a)
    gain = F.when(direction(F.col("metric"), lower) == "higher_better", delta).otherwise(-delta)
    return both.select("metric", direction(F.col("metric"), lower).alias("direction"), name_a, name_b, delta.alias("delta"),
                       F.when(F.abs(delta) > 1e-9, F.when(gain > 0, name_b).otherwise(name_a)).otherwise("").alias("better"))


def cost_decomposition(reference: DataFrame, direct: DataFrame, parsed: Mapping[str, DataFrame]) -> DataFrame:
    """Parser cost per metric: each backend's parsed result minus the direct tool result."""
    out = reference.select("metric", F.col("value").alias("reference")).join(
        direct.select("metric", F.col("value").alias("direct")), "metric", "full_outer")
    for name, df in parsed.items():
        out = out.join(df.select("metric", F.col("value").alias(name)), "metric", "full_outer")
        out = out.withColumn(f"{name}_cost", F.col(name) - F.col("direct"))
    return out.withColumn("direction", direction(F.col("metric")))


def compare_per_class(base: DataFrame, other: DataFrame) -> DataFrame:
    """Per-class tables side by side with the recall difference; all classes of ``other`` stay."""
    b = base.select("label", *[F.col(c).alias(f"base_{c}") for c in ("precision", "recall", "f1")])
    return other.select("label", "support", "precision", "recall", "f1").join(b, "label", "left") \
        .withColumn("delta_recall", F.col("recall") - F.col("base_recall"))


def regression_gate(new: DataFrame, reference: DataFrame, tol: float = 2e-3) -> DataFrame:
    """``(metric, reference, new, delta, status)``: PASS within the tolerance, FAIL outside, NO_REF when
    one side is missing."""
    both = reference.select("metric", F.col("value").alias("reference")).join(
        new.select("metric", F.col("value").alias("new")), "metric", "full_outer")
    delta = F.col("new") - F.col("reference")
    return both.withColumn("delta", F.round(delta, 6)).withColumn(
        "status", F.when(delta.isNull(), "NO_REF").when(F.abs(delta) <= tol, "PASS").otherwise("FAIL"))


def gate_status(gate: DataFrame) -> DataFrame:
    return gate.agg(F.count_if(F.col("status") != "NO_REF").alias("n_checked"),
                    F.count_if(F.col("status") == "FAIL").alias("n_failed")) \
        .withColumn("status", F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL"))


def version_table(metas: DataFrame, version: str, order: str, metrics: Sequence[str]) -> DataFrame:
    """One row per version with each metric and its difference to the version before. The table holds
    one row per released version, so one ordered window over it is small."""
    w = Window.partitionBy().orderBy(order)
    return metas.select(version, order, *metrics, *[
        (F.col(m) - F.lag(m).over(w)).alias(f"delta_{m}") for m in metrics])


def _halves(pos: Column):
    """Node of a position at one binary digit: right halves beat, left halves ask there."""
    def at(digit: Column) -> Column:
        half = F.call_function("shiftright", pos, digit)
        right = half % 2 == 1
        return F.struct(digit.alias("digit"), F.when(right, half).otherwise(half + 1).alias("at"),
                        F.when(right, "beats").otherwise("asks").alias("role"))
    return at


def _dominated(points: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct points that another one beats in no objective less and in one more; all objectives rise.

    All but the last two objectives become dense positions. Two positions differ first at one binary digit: there the
    larger one lies in the right half of a node whose left half holds the smaller. So each point enters a node per
    digit, as a beater in right halves and as a candidate in left ones, and a node for equal positions. Inside a node only
    the last two objectives count: the best last value ahead comes from prefix totals. A point makes about log2(n)
    rows per such objective, and no two points are ever paired."""
    *heads, y, z = cols
    out, node, role = points, [], F.lit("both")
    for i, c in enumerate(heads):
        levels = number_rows(points.select(c).distinct(), [], [c], value_buckets(c), f"__pos{i}", f"__n{i}")
        out = out.join(levels, c)
        pos = F.col(f"__pos{i}")
        digits = F.length(F.bin(f"__n{i}"))
        steps = F.transform(F.sequence(F.lit(0), digits - 1), _halves(pos))
        same = F.array(F.struct(F.lit(-1).alias("digit"), pos.alias("at"), F.lit("both").alias("role")))
        out = out.withColumn(f"__node{i}", F.explode(F.concat(same, steps)))
        node += [F.col(f"__node{i}.digit").alias(f"__d{i}"), F.col(f"__node{i}.at").alias(f"__a{i}")]
        mine = F.col(f"__node{i}.role")
        role = F.when(role == "both", mine).when((mine == "both") | (mine == role), role)
    keys = [f"__{k}{i}" for i in range(len(heads)) for k in ("d", "a")]
    placed = out.select(*cols, *node, role.alias("__role"), (-F.col(y)).alias("__o"), (-F.col(z)).alias("__oz"),
                        F.when(role != "asks", F.col(z)).alias("__beat")).filter("__role IS NOT NULL")
    order = ["__o", (F.col("__role") == "asks").cast("int"), "__oz"]
    ahead = with_prior(placed, keys, order, value_buckets("__o"), {"__best": ("max", "__beat")})
    return ahead.filter((F.col("__role") != "beats") & (F.col("__best") >= F.col(z))).select(*cols).distinct()


def pareto(trials: DataFrame, objectives: Mapping[str, str]) -> DataFrame:
    """Rows that no other row dominates (``objective -> max|min``); a row without one of the values is left out.

    Two objectives: walk the first from its best value and keep what improves the second; the running
    best comes from prefix totals. More: the same inside the nodes of a binary cut of the other objectives."""
    names = list(objectives)
    cols = [f"__{c}" for c in names]
    up = [(F.col(c) if d == "max" else -F.col(c)).cast("double") + F.lit(0.0) for c, d in objectives.items()]
    points = trials.select(*[u.alias(c) for c, u in zip(cols, up)]).dropna().distinct()
    if len(names) == 2:
        lead = points.groupBy((-F.col(cols[0])).alias("__o")).agg(F.max(cols[1]).alias(cols[1]))
        walked = with_prior(lead, [], ["__o"], value_buckets("__o"), {"__ahead": ("max", cols[1])})
        front = walked.filter(F.col("__ahead").isNull() | (F.col(cols[1]) > F.col("__ahead"))) \
            .select((-F.col("__o")).alias(cols[0]), cols[1])
    else:
        front = points.join(_dominated(points, cols), cols, "left_anti")
    tagged = trials.withColumns(dict(zip(cols, up)))
    return tagged.join(front, cols, "left_semi").select(*trials.columns)


def best_feasible(trials: DataFrame, value: str, constraint: Column, trial: str = "trial") -> DataFrame:
    """Best row that satisfies the constraint; the first trial on ties."""
    return trials.filter(constraint).orderBy(F.desc(value), F.asc(trial)).limit(1)


def knee_point(front: DataFrame, headline: str, under: str, incumbent_under: Column, trial: str = "trial") -> DataFrame:
    """Best headline value among front points no worse than the incumbent on the dangerous error; the
    whole front when there is none."""
    ok = (F.col(under) <= incumbent_under + 1e-9).cast("int")
    return front.withColumn("feasible", ok).orderBy(F.desc("feasible"), F.desc(headline), F.asc(trial)).limit(1)
