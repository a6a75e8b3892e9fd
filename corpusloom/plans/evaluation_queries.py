"""Evaluation queries over predictions derived from the events table, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import bootstrap, catalog, experiments, metrics, ml
from corpusloom.scratch import Scratch
from corpusloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """``event_id, grp, label, score, generator, condition, seed``: a purchase is a positive, its generator one of four."""
    e = table(spark, d, "events")
    label = (F.col("event_type") == "purchase").cast("int")
    return e.select(
        "event_id", F.col("user_id").alias("grp"), label.alias("label"), F.round(F.least(F.col("value") / 500, F.lit(1.0)), 6).alias("score"),
        F.when(label == 1, F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string"))).otherwise("real").alias("generator"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("condition"), (F.col("event_id") % 5).alias("seed"),
    )


_P = """p AS (SELECT event_id, user_id AS grp, (event_type = 'purchase')::INT AS label, round(least(value / 500, 1.0), 6) AS score,
  CASE WHEN event_type = 'purchase' THEN 'g' || (user_id % 4)::VARCHAR ELSE 'real' END AS generator, 'c' || (event_id % 3)::VARCHAR AS condition, event_id % 5 AS seed FROM events)"""
T = 0.1


def _counts(keys: str, source: str = "p", t: str = str(T)) -> str:
    return f"SELECT {keys}, count(*) FILTER (label = 1 AND score >= {t}) AS tp, count(*) FILTER (label = 0 AND score >= {t}) AS fp, count(*) FILTER (label = 1 AND score < {t}) AS fn, count(*) FILTER (label = 0 AND score < {t}) AS tn, avg((score - label) * (score - label)) AS brier FROM {source} GROUP BY {keys}"


_RATES = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall1, round(tn / (tn + fp), 6) AS recall0, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 6) AS macro_f1"""


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {_P}, c AS ({_counts('condition')}) SELECT condition, tp, fp, fn, tn, round(brier, 6) AS brier, {_RATES} FROM c")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.confusion(predictions(spark, d), ["condition"], T), "brier", "accuracy", "recall1", "recall0", "balanced_accuracy", "precision", "macro_f1")


@query(f"""
WITH {_P}, c AS ({_counts('condition')}), m AS (SELECT condition, unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted, unnest([tn, fp, fn, tp]) AS rows, unnest([tn + fp, tn + fp, tp + fn, tp + fn]) AS n FROM c)
SELECT condition, actual, predicted, rows, round(rows / n, 6) AS rate FROM m""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _round(catalog.confusion_rates(metrics.confusion(predictions(spark, d), ["condition"], T), ["condition"]), "rate")


@query(f"""
WITH {_P}, b AS (SELECT condition, (SELECT max(i) FROM range(15) r(i) WHERE score >= i / 15.0::DOUBLE) AS bin, label, score FROM p),
a AS (SELECT condition, bin, count(*) AS n, avg(label) AS y, avg(score) AS s FROM b GROUP BY 1, 2) SELECT condition, round(sum(n * abs(y - s)) / sum(n), 6) AS ece FROM a GROUP BY 1""")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.calibration_error(predictions(spark, d), ["condition"]), "ece")


_CURVE = """q AS (SELECT condition, score, sum(label) AS p, sum(1 - label) AS n FROM p GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY condition) AS pos, sum(n) OVER (PARTITION BY condition) AS neg, lead(p) OVER o AS np, lead(n) OVER o AS nn FROM q
  WINDOW w AS (PARTITION BY condition ORDER BY score DESC ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY condition ORDER BY score DESC))"""


@query(f"WITH {_P}, {_CURVE} SELECT condition, round(sum(p * (neg - fp + n / 2)) / any_value(pos * neg), 6) AS roc_auc FROM c GROUP BY 1")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.roc_auc(metrics.curve(predictions(spark, d), ["condition"]), ["condition"]), "roc_auc")


@query(f"WITH {_P}, {_CURVE} SELECT condition, round(sum(p * tp / (tp + fp)) / any_value(pos), 6) AS pr_auc FROM c GROUP BY 1")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.average_precision(metrics.curve(predictions(spark, d), ["condition"]), ["condition"]), "pr_auc")


@query(f"WITH {_P}, {_CURVE} SELECT condition, round(min(fp) / any_value(neg), 6) AS fpr_at_tpr FROM c WHERE (np IS NULL OR np != p OR nn != n) AND tp >= 0.95 * pos GROUP BY 1")
def fpr_at_tpr95(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.fpr_at_tpr(metrics.curve(predictions(spark, d), ["condition"]), ["condition"]), "fpr_at_tpr")


@query(f"""
WITH {_P}, {_CURVE}, t AS (SELECT condition, score AS t, round((tp / pos + 1 - fp / neg) / 2, 12) AS b FROM c UNION ALL SELECT DISTINCT condition, u.t, 0.5 FROM c CROSS JOIN (VALUES (0.0), (1.0)) u(t)),
m AS (SELECT condition, t, max(b) AS b FROM t GROUP BY 1, 2)
SELECT condition, round(t, 6) AS threshold, round(b, 6) AS balanced_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY b DESC, t) AS r FROM m) WHERE r = 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.best_threshold(metrics.curve(predictions(spark, d), ["condition"]), ["condition"]), "threshold", "balanced_accuracy")


@query(f"""
WITH {_P}, g AS (SELECT a.condition, a.grp, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won, count(*) AS pairs
  FROM p a JOIN p b ON a.condition = b.condition AND a.grp = b.grp AND a.label = 1 AND b.label = 0 GROUP BY 1, 2)
SELECT condition, round(avg(won / pairs), 6) AS macro_rate, round(sum(won) / sum(pairs), 6) AS micro_rate, sum(pairs)::BIGINT AS pairs, count(*) AS groups FROM g GROUP BY 1""")
def group_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.group_ranking(predictions(spark, d), ["condition"], "grp"), "macro_rate", "micro_rate")


_NAMES = ("g0", "g1", "g2", "g3")
_SCOPES = "s AS (SELECT condition, 'all' AS scope, label, score FROM p UNION ALL SELECT condition, 'real_vs_' || g, label, score FROM p, (VALUES ('g0'), ('g1'), ('g2'), ('g3')) v(g) WHERE label = 0 OR generator = g)"
_SUMMARY = (
    f"WITH {_P}, {_SCOPES}, k AS ({_counts('condition, scope', 's')}), q AS (SELECT condition, scope, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1, 2, 3), "
    "c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER v AS pos, sum(n) OVER v AS neg FROM q WINDOW w AS (PARTITION BY condition, scope ORDER BY score DESC ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY condition, scope)), "
    "m AS (SELECT condition, scope, sum(p * (neg - fp + n / 2)) / any_value(pos * neg) AS roc_auc, sum(p * tp / (tp + fp)) / any_value(pos) AS pr_auc FROM c GROUP BY 1, 2), "
    "f AS (SELECT condition, scope, tn + fp AS n_real, tp + fn AS n_ai, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2 AS macro_f1, roc_auc, pr_auc FROM k JOIN m USING (condition, scope)) "
)


def _scope_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(metrics.scopes(predictions(spark, d), "generator", _NAMES), ["condition", "scope"], T)


@query(_SUMMARY + "SELECT condition, scope, n_real, n_ai, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM f")
def scope_table(spark: SparkSession, d: str) -> DataFrame:
    return _round(_scope_metrics(spark, d), "balanced_accuracy", "macro_f1", "roc_auc", "pr_auc")


@query(
    _SUMMARY + "SELECT condition, round(avg(balanced_accuracy), 6) AS macro_balanced_accuracy, round(avg(roc_auc), 6) AS macro_roc_auc, arg_min(scope, (round(balanced_accuracy, 9), scope)) AS worst_scope, round(min(balanced_accuracy), 6) AS worst_balanced_accuracy FROM f WHERE scope != 'all' GROUP BY 1"
)
def macro_worst(spark: SparkSession, d: str) -> DataFrame:
    f = _scope_metrics(spark, d).where("scope != 'all'")
    return _round(experiments.macro_and_worst(f, ["condition"], "scope"), "macro_balanced_accuracy", "macro_roc_auc", "worst_balanced_accuracy")


@query(f"""
WITH {_P}, h AS (SELECT DISTINCT grp, generator FROM p WHERE label = 1), s AS (SELECT generator AS slice, label, score FROM p WHERE label = 1 UNION ALL SELECT h.generator, 0, score FROM p JOIN h USING (grp) WHERE label = 0),
c AS ({_counts('slice', 's')}) SELECT slice, tp, fp, fn, tn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")
def generator_slices(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.confusion(metrics.sibling_slices(predictions(spark, d), "generator", "grp"), ["slice"], T), "balanced_accuracy").select("slice", "tp", "fp", "fn", "tn", "balanced_accuracy")


_RUNS = f"WITH {_P}, r AS (SELECT * REPLACE (condition AS condition) FROM p), k AS ({_counts('condition, seed', 'r')}), b AS (SELECT condition AS representation, seed, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM k), a AS (SELECT representation, avg(balanced_accuracy) AS mean_balanced_accuracy, stddev_samp(balanced_accuracy) AS std_balanced_accuracy, avg(accuracy) AS mean_accuracy, stddev_samp(accuracy) AS std_accuracy, count(*) AS runs, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds FROM b GROUP BY 1) "


def _runs(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.confusion(predictions(spark, d), ["condition", "seed"], T)
    return experiments.aggregate_seeds(c.withColumnRenamed("condition", "representation"), "representation", "seed", ["balanced_accuracy", "accuracy"])


@query(_RUNS + "SELECT representation, round(mean_balanced_accuracy, 6) AS mean_balanced_accuracy, round(std_balanced_accuracy, 6) AS std_balanced_accuracy, round(mean_accuracy, 6) AS mean_accuracy, round(std_accuracy, 6) AS std_accuracy, runs, seeds FROM a")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _round(_runs(spark, d), "mean_balanced_accuracy", "std_balanced_accuracy", "mean_accuracy", "std_accuracy")


@query(_RUNS + "SELECT representation, round(mean_balanced_accuracy, 6) AS mean_balanced_accuracy FROM a ORDER BY a.mean_balanced_accuracy DESC, mean_accuracy DESC, representation LIMIT 1")
def selection_rule(spark: SparkSession, d: str) -> DataFrame:
    return _round(experiments.choose(_runs(spark, d), "representation", ["mean_balanced_accuracy", "mean_accuracy"]), "mean_balanced_accuracy").select("representation", "mean_balanced_accuracy")


@query(f"WITH {_P} SELECT label, 1 / count(*) AS weight FROM p GROUP BY 1")
def label_weights(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_weights(predictions(spark, d))


@query(f"WITH {_P}, c AS (SELECT *, greatest(least(score, 1 - 1e-7), 1e-7) AS s FROM p) SELECT condition, round(avg(-(label * ln(s) + (1 - label) * ln(1 - s))), 6) AS log_loss FROM c GROUP BY 1")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.log_loss(predictions(spark, d), ["condition"]), "log_loss")


_REPEATS = 2000
_U64 = "18446744073709551616::UHUGEINT"


def _mixed(z: str, shift: int, by: int) -> str:
    return f"(xor({z}, {z} >> {shift})::UHUGEINT * {by}::UHUGEINT % {_U64})::UBIGINT"


#: Draws of every cluster of ``p``: splitmix64 of the cluster's number and the replicate, as a Poisson number.
_DRAWS = f"""
z0 AS (SELECT grp, replicate, (('0x' || substr(sha256(grp::VARCHAR), 1, 16))::UBIGINT::UHUGEINT + (replicate + 1)::UHUGEINT * {bootstrap.STEP}::UHUGEINT % {_U64}) % {_U64} AS z FROM (SELECT DISTINCT grp FROM p), range({_REPEATS}) r(replicate)),
z1 AS (SELECT grp, replicate, {_mixed("z::UBIGINT", 30, bootstrap.MIX[0])} AS z FROM z0), z2 AS (SELECT grp, replicate, {_mixed("z", 27, bootstrap.MIX[1])} AS z FROM z1),
w AS (SELECT * FROM (SELECT grp, replicate, {" + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in bootstrap.POISSON)} AS w FROM (SELECT grp, replicate, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM z2)) WHERE w > 0)"""


def _drawn(name: str, source: str, key: str) -> str:
    """Metrics of every replicate of ``source(key, grp, label, score)`` as ``name(key, metric, replicate, value)``."""
    return f"""
{name}_s AS (SELECT {key}, replicate, score, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM {source} JOIN w USING (grp) GROUP BY 1, 2, 3),
{name}_c AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER k AS pos, sum(n) OVER k AS neg FROM {name}_s WINDOW o AS (PARTITION BY {key}, replicate ORDER BY score DESC ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY {key}, replicate)),
{name}_m AS (SELECT {key}, replicate, sum(p * (neg - fp + n / 2)) / any_value(pos * neg) AS roc_auc, coalesce(sum(p) FILTER (score >= {T}), 0) AS tp, coalesce(sum(n) FILTER (score >= {T}), 0) AS fp, any_value(pos) AS pos, any_value(neg) AS neg,
  min(fp) FILTER (tp >= 0.95 * pos) / any_value(neg) AS fpr FROM {name}_c WHERE pos > 0 AND neg > 0 GROUP BY 1, 2),
{name} AS (UNPIVOT (SELECT {key}, replicate, roc_auc, (tp / pos + (neg - fp) / neg) / 2 AS balanced_accuracy, (2 * tp / (pos + tp + fp) + 2 * (neg - fp) / (neg + neg - fp + pos - tp)) / 2 AS macro_f1, fpr::DOUBLE AS fpr_at_tpr_95 FROM {name}_m)
  ON roc_auc, balanced_accuracy, macro_f1, fpr_at_tpr_95 INTO NAME metric VALUE value)"""


def _point(name: str, source: str, key: str) -> str:
    """The metrics of ``source`` itself as ``name(key, metric, value)``."""
    return f"""
{name}_q AS (SELECT {key}, score, sum(label) AS p, sum(1 - label) AS n FROM {source} GROUP BY 1, 2),
{name}_c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER k AS pos, sum(n) OVER k AS neg, lead(p) OVER o AS np, lead(n) OVER o AS nn FROM {name}_q
  WINDOW w AS (PARTITION BY {key} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY {key} ORDER BY score DESC), k AS (PARTITION BY {key})),
{name}_m AS (SELECT {key}, sum(p * (neg - fp + n / 2)) / any_value(pos * neg) AS roc_auc, coalesce(sum(p) FILTER (score >= {T}), 0) AS tp, coalesce(sum(n) FILTER (score >= {T}), 0) AS fp, any_value(pos) AS pos, any_value(neg) AS neg,
  min(fp) FILTER ((np IS NULL OR np != p OR nn != n) AND tp >= 0.95 * pos) / any_value(neg) AS fpr FROM {name}_c GROUP BY 1),
{name} AS (UNPIVOT (SELECT {key}, roc_auc, (tp / pos + (neg - fp) / neg) / 2 AS balanced_accuracy, (2 * tp / (pos + tp + fp) + 2 * (neg - fp) / (neg + neg - fp + pos - tp)) / 2 AS macro_f1, fpr::DOUBLE AS fpr_at_tpr_95 FROM {name}_m)
  ON roc_auc, balanced_accuracy, macro_f1, fpr_at_tpr_95 INTO NAME metric VALUE value)"""


_ENDS = "round(quantile_cont({v}, 0.025), 6) AS lower, round(quantile_cont({v}, 0.975), 6) AS upper"


@query(f"WITH {_P}, a0 AS (SELECT 0 AS k, grp, label, score FROM p), {_DRAWS}, {_drawn('a', 'a0', 'k')}, {_point('e', 'a0', 'k')} SELECT metric, round(any_value(e.value), 6) AS estimate, {_ENDS.format(v='a.value')}, count(a.value) AS repeats FROM e JOIN a USING (metric) GROUP BY 1")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Estimates and intervals of the four surveyed metrics over 2,000 resamples of the clusters."""
    return _round(bootstrap.cluster_intervals(predictions(spark, d), [], "grp", T, Scratch(spark, "bootstrap"), _REPEATS), "estimate", "lower", "upper")


@query(
    f"WITH {_P}, a0 AS (SELECT 0 AS k, grp, label, score FROM p), b0 AS (SELECT 0 AS k, grp, label, 1 - score AS score FROM p), {_DRAWS}, {_drawn('a', 'a0', 'k')}, {_drawn('b', 'b0', 'k')}, {_point('e', 'a0', 'k')}, {_point('f', 'b0', 'k')}, "
    f"d AS (SELECT metric, a.value - b.value AS value FROM a JOIN b USING (metric, replicate)) SELECT metric, round(any_value(e.value - f.value), 6) AS estimate, {_ENDS.format(v='d.value')}, count(d.value) AS repeats FROM e JOIN f USING (metric) JOIN d USING (metric) GROUP BY 1"
)
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The same of the difference between the scores and their complements, over the same draws."""
    p = predictions(spark, d)
    return _round(bootstrap.paired_intervals(p, p.withColumn("score", 1 - F.col("score")), "event_id", "grp", (T, T), Scratch(spark, "bootstrap"), _REPEATS), "estimate", "lower", "upper")


@query(f"""
WITH {_P}, l AS (SELECT event_id, label, grp FROM p WHERE event_id % 50 != 0), r AS (SELECT event_id, CASE WHEN event_id % 70 = 1 THEN 1 - label ELSE label END AS label, CASE WHEN event_id % 90 = 1 THEN grp + 1 ELSE grp END AS grp FROM p WHERE event_id % 60 != 0
  UNION ALL SELECT event_id, label, grp FROM p WHERE event_id % 500 = 7),
a AS (SELECT event_id, count(*) AS n, min(label) AS label, min(grp) AS grp FROM l GROUP BY 1), b AS (SELECT event_id, count(*) AS n, min(label) AS label, min(grp) AS grp FROM r GROUP BY 1),
j AS (SELECT a.n AS an, b.n AS bn, a.label AS al, b.label AS bl, a.grp AS ag, b.grp AS bg FROM a FULL JOIN b USING (event_id))
SELECT unnest(['left keys repeated', 'right keys repeated', 'only left', 'only right', 'labels differ', 'groups differ']) AS "check", unnest([count(*) FILTER (an > 1), count(*) FILTER (bn > 1), count(*) FILTER (bn IS NULL), count(*) FILTER (an IS NULL),
  count(*) FILTER (an > 0 AND bn > 0 AND al != bl), count(*) FILTER (an > 0 AND bn > 0 AND ag != bg)]) AS rows FROM j""")
def paired_alignment(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the predictions from being paired with a copy that lacks, repeats and changes some."""
    p = predictions(spark, d).select("event_id", "label", "grp")
    at = lambda n, k: F.col("event_id") % n == k
    changed = p.where(~at(60, 0)).select("event_id", F.when(at(70, 1), 1 - F.col("label")).otherwise(F.col("label")).alias("label"), F.when(at(90, 1), F.col("grp") + 1).otherwise(F.col("grp")).alias("grp"))
    return bootstrap.alignment_problems(p.where(~at(50, 0)), changed.union(p.where(at(500, 7))), "event_id", "label", "grp")


@query(
    f"WITH {_P}, s AS (SELECT scope, grp, label, score FROM (SELECT 'all' AS scope, grp, label, score FROM p WHERE condition = 'c0' UNION ALL SELECT 'real_vs_' || g, grp, label, score FROM p, (VALUES ('g0'), ('g1'), ('g2'), ('g3')) v(g) WHERE condition = 'c0' AND (label = 0 OR generator = g))), "
    f"{_DRAWS}, {_drawn('a', 's', 'scope')}, i AS (SELECT scope, metric, {_ENDS.format(v='value')}, count(value) AS repeats FROM a GROUP BY 1, 2) SELECT scope, "
    + ", ".join(f"max({c}) FILTER (metric = '{m}') AS {m}_{n}" for m in bootstrap.SURVEYED for c, n in (("lower", "ci_lower"), ("upper", "ci_upper"), ("repeats", "bootstrap_repeats")))
    + " FROM i GROUP BY 1"
)
def scope_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Flattened intervals of the scopes of the first condition, over resampled groups."""
    rows = metrics.scopes(predictions(spark, d).where("condition = 'c0'"), "generator", _NAMES)
    i = bootstrap.interval(bootstrap.replicate_values(rows, ["scope"], "grp", T, Scratch(spark, "bootstrap"), _REPEATS), ["scope", "metric"])
    return bootstrap.flattened(_round(i, "lower", "upper"), ["scope"])


def _statistics() -> tuple[dict, dict]:
    """Sums over rows and metrics over sums, for the bootstrap of any such metric."""
    s, y = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-7)), F.lit(1e-7)), F.col("label")
    sums = {"n": F.lit(1.0), "sq": F.pow(F.col("score") - y, 2), "loss": -(y * F.log(s) + (1 - y) * F.log(1 - s)), "pos": y, "pos_score": y * F.col("score")}
    return sums, {"brier": F.try_divide("sq", "n"), "log_loss": F.try_divide("loss", "n"), "mean_positive_score": F.try_divide("pos_score", "pos")}


@query(
    f"WITH {_P}, {_DRAWS}, k AS (SELECT grp, count(*) AS n, sum(pow(score - label, 2)) AS sq, sum(-(label * ln(greatest(least(score, 1 - 1e-7), 1e-7)) + (1 - label) * ln(1 - greatest(least(score, 1 - 1e-7), 1e-7)))) AS loss, sum(label) AS pos, sum(label * score) AS ps FROM p GROUP BY 1), "
    "v AS (SELECT replicate, sum(w * sq) / sum(w * n) AS brier, sum(w * loss) / sum(w * n) AS log_loss, sum(w * ps) / sum(w * pos) AS mean_positive_score FROM k JOIN w USING (grp) GROUP BY 1), u AS (UNPIVOT v ON brier, log_loss, mean_positive_score INTO NAME metric VALUE value) "
    f"SELECT metric, {_ENDS.format(v='value')}, count(value) AS repeats FROM u GROUP BY 1"
)
def statistic_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of metrics given as expressions over sums, over resampled clusters."""
    return _round(bootstrap.statistic_intervals(predictions(spark, d), "grp", *_statistics(), _REPEATS), "lower", "upper")


@query()
def row_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The same over resampled rows."""
    return _round(bootstrap.statistic_intervals(predictions(spark, d), "event_id", *_statistics(), _REPEATS), "lower", "upper")


def _file_rows(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.functions.text import folded

    t = table(spark, d, "highres_manifest").select(
        "source_id", "loaded_at", folded(F.col("split")).alias("split"), "label", *[F.log1p(F.col(c).cast("double")).alias(c) for c in ("source_width", "source_height", "source_file_bytes")],
        (F.col("source_width") / F.greatest("source_height", F.lit(1))).alias("ratio"), *[(F.upper("source_format") == f).cast("double").alias(n) for f, n in (("PNG", "png"), ("JPEG", "jpeg"), ("WEBP", "webp"))],
    )
    return t.where("label in (0, 1)").na.fill(0.0)


_FEATURES = ("source_width", "source_height", "source_file_bytes", "ratio", "png", "jpeg", "webp")


@query()
def logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Held-out scores of a balanced logistic regression on file features: a fit on the train rows, metrics of val and test at the threshold that val chose."""
    return ml.baseline(_file_rows(spark, d), "split", "label", list(_FEATURES))


#: A model given by its coefficients, to hold the scaling and scoring against SQL.
_WEIGHTS, _BIAS = (0.5, -0.25, 1.5, 0.1, -0.75, 0.3, 0.0), 0.2
_SCALED = " + ".join(f"{w} * ({f} - m.{f}_m) / m.{f}_s" for f, w in zip(_FEATURES, _WEIGHTS))


@query(
    "WITH r AS (SELECT source_id, loaded_at, lower(regexp_replace(split, '^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g')) AS split, coalesce(ln(1 + source_width), 0) AS source_width, coalesce(ln(1 + source_height), 0) AS source_height, "
    "coalesce(ln(1 + source_file_bytes), 0) AS source_file_bytes, coalesce(source_width / greatest(source_height, 1), 0) AS ratio, coalesce((upper(source_format) = 'PNG')::INT, 0) AS png, coalesce((upper(source_format) = 'JPEG')::INT, 0) AS jpeg, coalesce((upper(source_format) = 'WEBP')::INT, 0) AS webp "
    "FROM highres_manifest WHERE label IN (0, 1)), m AS (SELECT "
    + ", ".join(f"avg({f}) AS {f}_m, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS {f}_s" for f in _FEATURES)
    + f" FROM r WHERE split = 'train') SELECT source_id, loaded_at, round(1 / (1 + exp(-({_BIAS} + {_SCALED}))), 6) AS score FROM r, m WHERE split IN ('val', 'test')"
)
def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of val and test by given coefficients over features scaled by the train rows."""
    rows = _file_rows(spark, d)
    model = (ml.Scaler(rows.where("split = 'train'"), list(_FEATURES)), list(_WEIGHTS), _BIAS)
    return _round(ml.score(model, rows.where("split in ('val', 'test')"), ["source_id", "loaded_at"]), "score")


@query("""
WITH e AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE len(embedding) = 64)),
f AS (SELECT vec_id, (a.u + 4) % 8 AS y, (a.v + 4) % 8 AS x, ln(1 + sqrt(pow(sum(e.v * cos(2 * pi() * (a.u * e.y + a.v * e.x) / 8)), 2) + pow(sum(e.v * sin(2 * pi() * (a.u * e.y + a.v * e.x) / 8)), 2))) AS m
  FROM e, (SELECT u.range AS u, v.range AS v FROM range(8) u, range(8) v) a GROUP BY vec_id, a.u, a.v),
p AS (SELECT vec_id, quantile_cont(m, 0.01) AS lo, quantile_cont(m, 0.99) AS hi FROM f GROUP BY 1),
s AS (SELECT f.vec_id, greatest(0, least(1, (m - lo) / (hi - lo))) AS m, sqrt(pow(y - 3.5, 2) + pow(x - 3.5, 2)) AS r FROM f JOIN p ON f.vec_id = p.vec_id),
b AS (SELECT vec_id, ring.range AS ring, coalesce(avg(m) FILTER (r >= ring.range * sqrt(24.5) / 64 AND r < (ring.range + 1) * sqrt(24.5) / 64), 0) AS v FROM s, range(64) ring GROUP BY 1, 2)
SELECT vec_id, ring::INT AS ring, round(v, 3) AS mean FROM b""")
def radial_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings read as 8 by 8 rasters: means of their log magnitude spectrum over 64 rings, a row a ring."""
    from corpusloom.operators import kernels

    rows = kernels.radial_features(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 8)
    return rows.where("radial is not null").select("vec_id", F.posexplode("radial").alias("ring", "v")).select("vec_id", "ring", F.round(F.col("v").cast("double"), 3).alias("mean"))
