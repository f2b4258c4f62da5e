"""Queries that prepare, score and judge flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import ml_eval, ml_models, ml_prep
from tidewire.operators.boosting import BoostedTrees
from tidewire.plans.checks import sql
from tidewire.plans.inputs import fitted, labelled_flows, ruled_flows, stored_flows
from tidewire.plans.registry import query, r6
from tidewire.session import materialize

FLOW_ID = ["flow_key", "flow_seq"]
FEW = ["bytes", "packet_count", "mean_packet_length", "ack_count"]


def rows_of(spark, sf):
    return labelled_flows(stored_flows(spark, sf))


def _safe(c: str) -> str:
    return f"CASE WHEN isnan({c}::DOUBLE) OR {c} < 0 THEN 0 ELSE {c} END::DOUBLE"


_CLEAN = "clean AS (SELECT flow_key, flow_seq, " + ", ".join(
    f"{_safe('duration_ms' if c == 'flow_duration_ms' else c)} AS {c}" for c in ml_prep.BASE_FEATURES) + " FROM flows)"


@query("clean_features", sql("flows", "SELECT flow_key, flow_seq, psh_rate, round(stddev_packet_length, 6) AS "
                                      "stddev_packet_length, 0.0::DOUBLE AS absent, text_number FROM (SELECT *, "
                                      "CASE WHEN flow_seq % 3 = 0 THEN bytes ELSE 0 END::DOUBLE AS text_number "
                                      "FROM clean)", _CLEAN))
def _(spark, sf):
    rows = stored_flows(spark, sf).withColumn(
        "text_number", F.when(F.col("flow_seq") % 3 == 0, F.col("bytes").cast("string"))
        .when(F.col("flow_seq") % 3 == 1, "-Infinity").otherwise("no number"))
    out = ml_prep.clean_features(rows, ["psh_rate", "stddev_packet_length", "absent", "text_number"])
    return out.select(*FLOW_ID, "psh_rate", r6("stddev_packet_length").alias("stddev_packet_length"), "absent",
                      "text_number")


def _derived(small: str, columns: list[str]) -> str:
    def z(c):
        return f"CASE WHEN {c} = 0 THEN {small}::DOUBLE ELSE {c} END" if c in columns else c
    d, m = z("flow_duration_ms"), z("inter_arrival_time_mean")
    u, v = z("total_packets_upstream"), z("total_packets_downstream")
    return (f"SELECT flow_key, flow_seq, round(({d}) / (({u}) + ({v}) + 1e-6::DOUBLE), 4) AS avg_packet_interval_ms, "
            f"syn_count - fin_count AS syn_fin_diff, round(ack_count / (({d}) + 1e-6::DOUBLE), 4) AS ack_rate_per_ms, "
            f"round(inter_arrival_time_max / (({m}) + 1e-6::DOUBLE), 4) AS iat_max_to_mean_ratio FROM clean")


def _derived_query(version):
    def run(spark, sf):
        rows = stored_flows(spark, sf).withColumn("flow_duration_ms", F.col("duration_ms"))
        out = ml_prep.derived_features(ml_prep.clean_features(rows), version)
        return out.select(*FLOW_ID, *[F.round(c, 4).alias(c) for c in ml_prep.DERIVED_FEATURES])
    return run


query("derived_features", sql("flows", _derived("1e-6", ml_prep.ZERO_RULES["v2"][1]), _CLEAN))(_derived_query("v2"))
query("derived_features_v1", sql("flows", _derived("1.0", ml_prep.ZERO_RULES["v1"][1]), _CLEAN))(_derived_query("v1"))


@query("log_clip", sql("flows", """
SELECT flow_key, flow_seq, round(ln(1 + least(greatest(duration_ms::DOUBLE, 0), 1e8)), 6) AS duration_ms,
  round(ln(1 + least(greatest(bytes::DOUBLE, 0), 1e8)), 6) AS bytes FROM flows"""))
def _(spark, sf):
    out = ml_prep.log_clip(stored_flows(spark, sf), ["duration_ms", "bytes"])
    return out.select(*FLOW_ID, r6("duration_ms").alias("duration_ms"), r6("bytes").alias("bytes"))


@query("log_v1", sql("flows", """
SELECT flow_key, flow_seq, round(ln(1 + bytes_per_second), 6) AS bytes_per_second,
  round(ln(1 + packets_per_second), 6) AS packets_per_second, round(ln(1 + avg_packet_interval_ms), 4) AS avg_packet_interval_ms
FROM (SELECT c.*, d.avg_packet_interval_ms FROM clean c JOIN derived d USING (flow_key, flow_seq))""", _CLEAN,
    "derived AS (" + _derived("1.0", ml_prep.ZERO_RULES["v1"][1]).replace(", 4) AS avg_packet", ", 12) AS avg_packet") + ")"))
def _(spark, sf):
    rows = stored_flows(spark, sf).withColumn("flow_duration_ms", F.col("duration_ms"))
    out = ml_prep.log_v1(ml_prep.derived_features(ml_prep.clean_features(rows), "v1"))
    return out.select(*FLOW_ID, r6("bytes_per_second").alias("bytes_per_second"),
                      r6("packets_per_second").alias("packets_per_second"),
                      F.round("avg_packet_interval_ms", 4).alias("avg_packet_interval_ms"))


_SPLIT = """split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', flow_key,
    flow_seq::VARCHAR, '42')), flow_key, flow_seq) <= floor(count(*) OVER (PARTITION BY label) * 0.7::DOUBLE)
  THEN 'train' ELSE 'test' END AS part FROM labelled)"""


@query("stratified_split", sql("labelled", "SELECT flow_key, flow_seq, label, part FROM split", _SPLIT))
def _(spark, sf):
    rows = rows_of(spark, sf).select(*FLOW_ID, "label")
    return ml_prep.stratified_split(rows, FLOW_ID, "label")


@query("robust_scale", sql("labelled", "SELECT flow_key, flow_seq, " + ", ".join(
    f"round(({c} - (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM labelled WHERE y = 0)) / (SELECT CASE WHEN "
    f"quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) = 0 THEN 1 ELSE quantile_cont({c}::DOUBLE, 0.75)"
    f" - quantile_cont({c}::DOUBLE, 0.25) END FROM labelled WHERE y = 0), 6) AS {c}" for c in FEW) + " FROM labelled"))
def _(spark, sf):
    rows = rows_of(spark, sf)
    out = ml_prep.fit_robust(rows.where("y = 0"), FEW).apply(rows)
    return out.select(*FLOW_ID, *[r6(c).alias(c) for c in FEW])


@query("minmax_scale", sql("labelled", "SELECT flow_key, flow_seq, " + ", ".join(
    f"round(({c} - (SELECT min({c}) FROM labelled WHERE y = 0)) / (SELECT max({c}) - min({c}) FROM labelled WHERE y = 0), 6)"
    f" AS {c}" for c in FEW) + " FROM labelled"))
def _(spark, sf):
    rows = rows_of(spark, sf)
    out = ml_prep.fit_minmax(rows.where("y = 0"), FEW).apply(rows)
    return out.select(*FLOW_ID, *[r6(c).alias(c) for c in FEW])


@query("class_weight", sql("labelled", """
SELECT y, round(CASE WHEN y = 1 THEN (SELECT count(*) FILTER (y = 0) / count(*) FILTER (y = 1) FROM labelled) ELSE 1 END, 6)
  AS weight, count(*) AS flows FROM labelled GROUP BY y"""))
def _(spark, sf):
    out = ml_prep.class_weight(rows_of(spark, sf), "y")
    return out.groupBy("y", r6("weight").alias("weight")).agg(F.count(F.lit(1)).alias("flows"))


@query("bounded_sample", sql("labelled", """
SELECT flow_key, flow_seq FROM labelled ORDER BY md5(concat_ws('|', flow_key, flow_seq::VARCHAR, '42')), flow_key, flow_seq
LIMIT 1000"""))
def _(spark, sf):
    return ml_prep.bounded_sample(rows_of(spark, sf).select(*FLOW_ID), FLOW_ID, 1000)


_CONFUSION = """c AS (SELECT count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 0 AND score < 0.5) AS tn FROM labelled)"""


def _predicted(spark, sf):
    return rows_of(spark, sf).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("binary_metrics", sql("labelled", """
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""", _CONFUSION))
def _(spark, sf):
    out = ml_eval.binary_metrics(_predicted(spark, sf), "y", "predicted")
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


@query("classification_report", sql("labelled", """
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
SELECT * FROM k
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM k
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support)::BIGINT FROM k)""", _CONFUSION,
    """k AS (SELECT '1' AS name, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
  tp + fn AS support FROM c
UNION ALL SELECT '0', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fn + fp), tn + fp FROM c)"""))
def _(spark, sf):
    out = ml_eval.classification_report(_predicted(spark, sf), "y", "predicted")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("roc_pr_auc", sql("labelled", """
SELECT round(sum(pos * (neg_before + neg / 2)) / (max(p) * max(n)), 6) AS roc_auc,
  round(sum(pos * (pos_at / flagged)) / max(p), 6) AS average_precision
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
    sum(pos) OVER (ORDER BY score DESC) AS pos_at, sum(pos + neg) OVER (ORDER BY score DESC) AS flagged,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM labelled GROUP BY score))"""))
def _(spark, sf):
    out = ml_eval.roc_pr_auc(rows_of(spark, sf), "y", "score")
    return out.withColumns({c: r6(c) for c in out.columns})


def _best(op: str, steps: int) -> str:
    marks = " UNION ".join(f"SELECT quantile_cont(score, {p / 100}) AS thr FROM labelled"
                           for p in ml_eval.THRESHOLD_PERCENTILES)
    return sql("labelled", f"""
SELECT round(thr, 6) AS thr, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (
  SELECT thr, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
  FROM (SELECT thr, count(*) FILTER (y = 1 AND score {op} thr) AS tp, count(*) FILTER (y = 0 AND score {op} thr) AS fp,
    count(*) FILTER (y = 1 AND NOT score {op} thr) AS fn FROM thresholds, labelled GROUP BY thr))
ORDER BY f1 DESC, thr LIMIT 1""", f"""thresholds AS (SELECT CASE WHEN i = {steps - 1} THEN hi ELSE lo + i * ((hi - lo) / {steps - 1}) END AS thr
  FROM (SELECT min(score) AS lo, max(score) AS hi FROM labelled), range({steps}) AS g(i) UNION {marks})""")


@query("best_f1_threshold", _best(">=", 200))
def _(spark, sf):
    out = ml_eval.best_f1_threshold(rows_of(spark, sf), "y", "score", 200, inclusive=True)
    return out.select(*[r6(c).alias(c) for c in ("thr", "f1", "precision", "recall")])


@query("best_f1_threshold_error", _best(">", 100))
def _(spark, sf):
    out = ml_eval.best_f1_threshold(rows_of(spark, sf), "y", "score", 100, inclusive=False)
    return out.select(*[r6(c).alias(c) for c in ("thr", "f1", "precision", "recall")])


@query("score_histogram", sql("labelled", """
SELECT y, bin, round(max(lo) + bin * max(w), 6) AS lo, count(*) AS n, round(count(*) / (max(total) * max(w)), 6) AS density
FROM (SELECT y, least(floor((score - lo) / w), 69)::INT AS bin, lo, w, total FROM
  (SELECT y, score, e.lo, (e.hi - e.lo) / 70 AS w, total FROM labelled JOIN
    (SELECT y, min(score) AS lo, max(score) AS hi, count(*) AS total FROM labelled GROUP BY y) e USING (y)))
GROUP BY y, bin"""))
def _(spark, sf):
    out = ml_eval.score_histogram(rows_of(spark, sf), "y", "score")
    return out.withColumns({"lo": r6("lo"), "density": r6("density")})


@query("class_medians", sql("labelled", "SELECT y, round(quantile_cont(score, 0.5), 6) AS median FROM labelled GROUP BY y"))
def _(spark, sf):
    return ml_eval.class_medians(rows_of(spark, sf), "y", "score").withColumn("median", r6("median"))


@query("sigma_threshold", sql("labelled", """
SELECT flow_key, flow_seq, round(t, 6) AS threshold, bytes > t AS anomaly
FROM labelled, (SELECT avg(bytes) + 3 * stddev_pop(bytes) AS t FROM labelled WHERE y = 0)"""))
def _(spark, sf):
    rows = rows_of(spark, sf)
    out = ml_eval.sigma_threshold(rows.where("y = 0"), rows, "bytes")
    return out.select(*FLOW_ID, r6("threshold").alias("threshold"), "anomaly")


@query("percentile_threshold", sql("labelled", """
SELECT flow_key, flow_seq, CASE WHEN score < t THEN 'ANOMALY' ELSE 'NORMAL' END AS verdict,
  CASE WHEN score < t THEN 'ANOMALY' ELSE 'NORMAL' END AS by_sign
FROM labelled, (SELECT quantile_cont(score, 0.01) AS t FROM labelled WHERE y = 0)"""))
def _(spark, sf):
    rows = rows_of(spark, sf)
    out = ml_eval.percentile_threshold(rows.where("y = 0"), rows, "score")
    sign = F.when(F.col("score") < F.col("threshold"), -1).otherwise(1)
    return out.select(*FLOW_ID, "verdict", ml_eval.sign_verdict(sign).alias("by_sign"))


@query("score_flows_rules", sql("labelled", """
SELECT flow_key, flow_seq, CASE flow_seq % 4 WHEN 0 THEN 'ARP' WHEN 1 THEN 'UNKNOWN' ELSE
  CASE WHEN score >= 0.5 THEN 'MALICIOUS' ELSE 'BENIGN' END END AS verdict FROM labelled"""))
def _(spark, sf):
    rows = rows_of(spark, sf)
    slot = F.col("flow_seq") % 4
    protocol = F.when(slot == 0, "ARP").otherwise(F.col("protocol"))
    return rows.select(*FLOW_ID, ml_models.flow_verdict(F.when(slot != 1, F.col("score")), protocol).alias("verdict"))


# ---- models (rows only where the result depends on the fitted model)

@query("density_noise", sql("labelled", """
SELECT flow_key, flow_seq, NOT core AND NOT beside AS noise FROM pts JOIN (
  SELECT a.i, bool_or(a.core) AS core, bool_or(b.core) AS beside FROM cores a
  JOIN cores b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.25 GROUP BY a.i) USING (i)""",
    """pts AS (SELECT row_number() OVER () AS i, flow_key, flow_seq, ln(1 + least(bytes, 1e8)) AS x,
  ln(1 + least(duration_ms, 1e8)) AS y FROM labelled)""",
    """cores AS (SELECT a.i, any_value(a.x) AS x, any_value(a.y) AS y, count(*) >= 5 AS core FROM pts a
  JOIN pts b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.25 GROUP BY a.i)"""))
def _(spark, sf):
    rows = ml_prep.log_clip(rows_of(spark, sf).select(*FLOW_ID, "bytes", "duration_ms"), ["bytes", "duration_ms"])
    return ml_models.density_noise(rows, FLOW_ID, "bytes", "duration_ms", eps=0.5, min_rows=5).select(
        *FLOW_ID, "noise")


def _stored(rows, *more):
    """Rows with their model features, prepared and written once: fits and scores read them several times."""
    return materialize(rows.select(*FLOW_ID, *more, *ml_prep.MODEL_FEATURES), "prepared")


@query("isolation_scores")
def _(spark, sf):
    rows = _stored(ml_prep.prepare(rows_of(spark, sf)))
    forest = ml_models.fit_isolation_forest(rows, FLOW_ID, ml_prep.MODEL_FEATURES)
    return forest.label(forest.score(rows)).select(*FLOW_ID, "score", "sign")


@query("reconstruction_anomaly")
def _(spark, sf):
    rows = _stored(ml_prep.log_clip(ml_prep.prepare(rows_of(spark, sf))), "y")
    scaled = ml_prep.fit_minmax(rows.where("y = 0"), ml_prep.MODEL_FEATURES).apply(rows)
    errors = ml_models.reconstruction_error(scaled.where("y = 0"), scaled, ml_prep.MODEL_FEATURES)
    errors = materialize(errors.select(*FLOW_ID, "y", "error"), "errors")
    return ml_eval.sigma_threshold(errors.where("y = 0"), errors, "error").select(*FLOW_ID, "error", "anomaly")


@query("pca_2d")
def _(spark, sf):
    rows = _stored(ml_prep.log_clip(ml_prep.prepare(rows_of(spark, sf))))
    out, explained = ml_models.pca_2d(rows, ml_prep.MODEL_FEATURES)
    return out.select(*FLOW_ID, "pc1", "pc2", F.lit(explained[0]).alias("explained_1"),
                      F.lit(explained[1]).alias("explained_2"))


def _ruled(spark, sf):
    rows = ml_prep.log_clip(ml_prep.prepare(ruled_flows(stored_flows(spark, sf))))
    return ml_prep.stratified_split(rows, FLOW_ID, "label")


def rule_model(spark, sf) -> str:
    """Where the model of the flows labelled by a rule on their features is stored."""
    return fitted(spark, sf, "rule", lambda: ml_models.train_classifier(
        _ruled(spark, sf).where("part = 'train'"), ml_prep.MODEL_FEATURES, "y", FLOW_ID))


def _classifier(spark, sf):
    return BoostedTrees.load(spark, rule_model(spark, sf)), _ruled(spark, sf)


# The label follows from two counts, so a fit that is right finds it on every flow, seen or not.
_RULED_SPLIT = _SPLIT.replace("FROM labelled", "FROM ruled")


@query("train_classifier", sql("ruled", """
SELECT count(*) FILTER (y = 1) AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, count(*) FILTER (y = 0) AS tn,
  1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1
FROM split WHERE part = 'test'""", _RULED_SPLIT))
def _(spark, sf):
    model, split = _classifier(spark, sf)
    scored = ml_models.score_flows(model, split.where("part = 'test'").drop("label"))
    predicted = scored.withColumn("predicted", (F.col("label") == "MALICIOUS").cast("int"))
    return ml_eval.binary_metrics(predicted, "y", "predicted")


@query("score_flows", sql("ruled", "SELECT flow_key, flow_seq, label, true AS sure FROM ruled"))
def _(spark, sf):
    model, split = _classifier(spark, sf)
    return ml_models.score_flows(model, split.drop("label")).select(
        *FLOW_ID, "label", ((F.col("probability") > 0.9) | (F.col("probability") < 0.1)).alias("sure"))


@query("top_feature_importance", sql("ruled", "SELECT 'min_packet_length' AS feature FROM ruled LIMIT 1"))
def _(spark, sf):
    # The label follows from one feature: it must come first.
    rows = ml_prep.log_clip(ml_prep.prepare(stored_flows(spark, sf).withColumn("y", (F.col("min_packet_length") >= 200).cast("int"))))
    path = fitted(spark, sf, "length", lambda: ml_models.train_classifier(rows, ml_prep.MODEL_FEATURES, "y", FLOW_ID))
    return ml_models.feature_importance(BoostedTrees.load(spark, path), rows, top=1).select("feature")


@query("feature_importances")
def _(spark, sf):
    model, split = _classifier(spark, sf)
    return ml_models.feature_importance(model, split)
