"""Accuracy, threshold, supervised, alert and whole-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.config import settings
from siftlog.functions.text import alert_key
from siftlog.functions.levels import severity
from siftlog.operators import alerts as AL, evaluate as EV, rolling, supervised as SU
from siftlog.operators.safe_map import outcome_counts, safe_map as run_safe
from siftlog.plans import benchmark as BM
from siftlog.plans.analyze import detect
from siftlog.runtime import stage

from . import corpus as C
from . import sqltext as S

Q, SQL = {}, {}

# scores in (0, 1) made of the event value, and labels made of the event type
_SCORE = F_SCORE = "round(1 - exp(-value / 60.0D), 6)"
_DSCORE = "round(1 - exp(-value / 60.0::DOUBLE), 6)"
_EV = f"ev AS (SELECT event_id AS entry_id, user_id, event_type, {_DSCORE} AS score, CASE WHEN event_type = 'error' OR value > 150 THEN 1 ELSE 0 END AS label FROM events)"


def labelled_scores(spark, sf):
    e = C.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("entry_id"), "user_id", "event_type", F.expr(_SCORE).alias("score"),
                    F.expr("CASE WHEN event_type = 'error' OR value > 150 THEN 1 ELSE 0 END").alias("label"))


_PRF = """count_if(t AND p) AS tp, count_if(NOT t AND p) AS fp, count_if(t AND NOT p) AS fn, count_if(NOT t AND NOT p) AS tn, count_if(t) AS support_pos, count(*) AS n"""


def _prf(inner, by=""):
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall
      FROM (SELECT {by}{_PRF} FROM ({inner}) {'GROUP BY ' + by.rstrip(', ') if by else ''}))"""


Q["prf1"] = lambda spark, sf: EV.prf1(labelled_scores(spark, sf), "label", F.col("score") >= 0.7)
SQL["prf1"] = f"WITH {_EV} " + _prf("SELECT label = 1 AS t, score >= 0.7 AS p FROM ev")


def label_quality(spark, sf):
    """Toxic flag against quality flag of the labelled documents, per source."""
    j = C.table(spark, sf, "labels").join(C.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return EV.prf1(j, F.col("toxic") == 1, F.col("quality") == 0, ["source"])


Q["prf1_by_source"] = label_quality
SQL["prf1_by_source"] = _prf("SELECT d.source, l.toxic = 1 AS t, l.quality = 0 AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id", "source, ")
Q["false_alarm_rate"] = lambda spark, sf: EV.false_alarm_rate(labelled_scores(spark, sf).filter("label = 0"), F.col("score") >= 0.7)
SQL["false_alarm_rate"] = f"WITH {_EV} SELECT count(*) AS n, count_if(score >= 0.7) AS false_flags, 100 * count_if(score >= 0.7) / count(*)::DOUBLE AS rate_pct FROM ev WHERE label = 0"
Q["mean_f1"] = lambda spark, sf: EV.mean_f1(EV.prf1(labelled_scores(spark, sf), "label", F.col("score") >= 0.5, ["user_id"])).select(F.round("mean_f1", 9).alias("mean_f1"), "tasks")
SQL["mean_f1"] = f"WITH {_EV}, m AS (" + _prf("SELECT user_id, label = 1 AS t, score >= 0.5 AS p FROM ev", "user_id, ") + ") SELECT round(avg(f1), 9) AS mean_f1, count(*) AS tasks FROM m"


def threshold_sweep(spark, sf):
    c = EV.threshold_curve(labelled_scores(spark, sf))
    return c.select(F.round("th", 4).alias("th"), "tp", "flagged", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


_CURVE = f"""WITH {_EV}, th AS (SELECT DISTINCT round_even(score * 10000, 0) / 10000 AS th FROM ev),
c AS (SELECT th, count_if(label = 1) AS tp, count(score) AS flagged, (SELECT count_if(label = 1) FROM ev) AS pos FROM th LEFT JOIN ev ON ev.score >= th.th GROUP BY th),
pr AS (SELECT th, tp, flagged, tp / greatest(flagged, 1)::DOUBLE AS precision, tp / greatest(pos, 1)::DOUBLE AS recall FROM c),
curve AS (SELECT th, tp, flagged, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / greatest(precision + recall, 1e-9::DOUBLE), 9) AS f1 FROM pr)"""
Q["threshold_sweep"] = threshold_sweep
SQL["threshold_sweep"] = _CURVE + " SELECT th, tp, flagged, precision, recall, f1 FROM curve"
Q["best_thresholds"] = lambda spark, sf: EV.best_thresholds(threshold_sweep(spark, sf), 0.6)
SQL["best_thresholds"] = _CURVE + """ SELECT * FROM (SELECT 'f1_optimal' AS pick, th, precision, recall, f1, flagged FROM curve ORDER BY f1 DESC, th DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'recall_floor' AS pick, th, precision, recall, f1, flagged FROM curve WHERE recall >= 0.6 ORDER BY f1 DESC, th DESC LIMIT 1)"""


def grid_search(spark, sf):
    s = labelled_scores(spark, sf)
    both = s.withColumn("feature_weight", F.lit(0.3)).unionByName(s.withColumn("feature_weight", F.lit(0.5)).withColumn("score", F.round(F.col("score") * 0.9, 6)))
    return EV.grid_search(both, BM.GRID_THRESHOLDS)


Q["grid_search"] = grid_search
SQL["grid_search"] = f"WITH {_EV}, b AS (SELECT 0.3::DOUBLE AS feature_weight, score, label FROM ev UNION ALL SELECT 0.5, round(score * 0.9::DOUBLE, 6), label FROM ev) " + _prf(
    "SELECT feature_weight, flag_threshold, label = 1 AS t, score >= flag_threshold AS p FROM b, (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8)) v(flag_threshold)", "feature_weight, flag_threshold, ")
Q["otsu_threshold"] = lambda spark, sf: EV.otsu_threshold(labelled_scores(spark, sf)).select("n", F.round("threshold", 9).alias("threshold"))
SQL["otsu_threshold"] = f"""WITH {_EV}, h AS (SELECT least(floor(score * 64), 63) AS b, count(*) AS c FROM ev WHERE score > 0 AND score < 1 GROUP BY 1),
p AS (SELECT b, (b + 0.5) / 64.0::DOUBLE AS ct, c / sum(c) OVER ()::DOUBLE AS p, sum(c) OVER () AS n, sum(c) OVER (ORDER BY b) AS cum FROM h),
w AS (SELECT *, cum / n::DOUBLE AS om, sum(p * ct) OVER (ORDER BY b) AS mu, sum(p * ct) OVER () AS mt FROM p),
s AS (SELECT *, CASE WHEN cum < n THEN (mt * om - mu) ** 2 / (om * (1 - om)) ELSE 0 END AS sg FROM w)
SELECT CAST(max(n) AS BIGINT) AS n, round(least(greatest(arg_max(ct, (round(sg, 12), -b)), 0.35::DOUBLE), 0.95::DOUBLE), 9) AS threshold FROM s"""
Q["score_histogram"] = lambda spark, sf: EV.score_histogram(labelled_scores(spark, sf))
SQL["score_histogram"] = f"WITH {_EV} SELECT CAST(least(floor(least(greatest(score, 0), 0.9999::DOUBLE) * 20), 19) AS INT) AS bin, count(*) AS cnt FROM ev GROUP BY 1"
Q["top_services"] = lambda spark, sf: EV.top_services(C.logs(spark, sf).filter(severity("level") <= 4))
SQL["top_services"] = f"WITH {C.LOGS_DUCK} SELECT service, count(*) AS cnt FROM logs WHERE {S.severity('level')} <= 4 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
Q["anomaly_rate"] = lambda spark, sf: EV.anomaly_rate(labelled_scores(spark, sf).withColumn("flagged", F.col("score") >= 0.7))
SQL["anomaly_rate"] = f"WITH {_EV} SELECT count(*) AS total, count_if(score >= 0.7) AS anomalies, count_if(score >= 0.7) / count(*)::DOUBLE * 100 AS rate_pct FROM ev"

# --- supervised ------------------------------------------------------------


def labelled_entries(spark, sf):
    j = C.logs(spark, sf).join(labelled_scores(spark, sf).select("entry_id", "score", "label"), "entry_id")
    return j.select("source", "entry_id", "ts_raw", "level", "service", "message", "score", "label")


def feature_matrix(spark, sf):
    m = SU.feature_matrix(labelled_entries(spark, sf))
    return m.select("entry_id", *[F.round(c, 9).alias(c) for c in SU.COLUMNS])


_f = S.features("level", "service", "message")
Q["feature_matrix"] = feature_matrix
SQL["feature_matrix"] = (f"WITH {C.LOGS_DUCK}, {_EV} SELECT x.entry_id, round(score, 9) AS score, round({S.severity('level')} / 7.0::DOUBLE, 9) AS severity_scaled, "
                         + ", ".join(f"round({v}, 9) AS {k}" for k, v in _f.items() if k != "_norm")
                         + f" FROM (SELECT l.entry_id, l.level, l.service, l.message, ev.score, {_f['_norm'].replace('lower(message)', 'lower(l.message)')} AS nrm FROM logs l JOIN ev ON ev.entry_id = l.entry_id) x")


def stratified_split(spark, sf):
    s = SU.stratified_split(labelled_scores(spark, sf), "entry_id")
    return s.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("rows"))


Q["stratified_split"] = stratified_split
SQL["stratified_split"] = f"""WITH {_EV}, c AS (SELECT label, count(*) AS n, CAST(round(count(*) * 0.4::DOUBLE) AS BIGINT) AS k FROM ev GROUP BY label)
SELECT label, TRUE AS is_test, k AS rows FROM c UNION ALL SELECT label, FALSE, n - k FROM c"""
def head_input(spark, sf):
    """Key, label and columns of the head; staged, as ordering the rows reads them twice."""
    return stage(SU.feature_matrix(labelled_entries(spark, sf)).select("entry_id", "label", *SU.COLUMNS))


Q["supervised_head"] = lambda spark, sf: SU.train_and_evaluate(head_input(spark, sf), "entry_id", trees=30)
Q["supervised_logistic"] = lambda spark, sf: SU.train_and_evaluate(head_input(spark, sf), "entry_id", model="lr")


def detect_full(spark, sf):
    """The whole run with learned synonyms, vocabulary, clusters and scores."""
    d = detect(C.entries(spark, sf))
    return d.scored.select("entry_id", "template_id", "cluster", F.round("score", 6).alias("score"), "flagged", F.array_join("reason_codes", ",").alias("codes"))


Q["detect_full"] = detect_full


def benchmark_report(spark, sf):
    return BM.benchmark_report(labelled_entries(spark, sf).drop("score"), settings(learn_synonyms=False))


Q["benchmark_report"] = benchmark_report

# --- alerts and rolling state ----------------------------------------------


def _alerts(spark, sf):
    """Severe entries as alerts of three applications, one of which has most of them."""
    e = C.logs(spark, sf).filter(severity("level") <= 4)
    app = F.when(F.col("user_id") % 4 < 2, "app0").otherwise(F.concat(F.lit("app"), (F.col("user_id") % 2 + 1).cast("string")))
    return e.select(app.alias("app"), alert_key("level", F.lit("svc"), "message").alias("key"), F.col("sec").cast("double").alias("ts"), F.col("entry_id").alias("alert_id"))


_apps = "CASE WHEN user_id % 4 < 2 THEN 'app0' ELSE 'app' || (user_id % 2 + 1) END"
ALERTS = f"""{C.LOGS_DUCK}, al AS MATERIALIZED (SELECT app, key, ts, min(entry_id) AS alert_id, count(*) AS c FROM (SELECT {_apps} AS app, upper(level) || '|svc|' || substr(regexp_replace(lower(message), '\\S*\\d\\S*', '<id>', 'g'), 1, 120) AS key,
  sec::DOUBLE AS ts, entry_id FROM logs WHERE {S.severity('level')} <= 4) GROUP BY app, key, ts)"""
Q["alert_cooldown"] = lambda spark, sf: AL.alert_gate(_alerts(spark, sf), max_per_hour=None).select("app", "key", "ts", "alert_id")
SQL["alert_cooldown"] = f"""WITH RECURSIVE {ALERTS}, q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY app, key ORDER BY ts) AS k FROM al),
walk AS (SELECT app, key, ts, alert_id, k, ts AS last, TRUE AS ok FROM q WHERE k = 1
  UNION ALL SELECT q.app, q.key, q.ts, q.alert_id, q.k, CASE WHEN q.ts - w.last >= 300 THEN q.ts ELSE w.last END, q.ts - w.last >= 300 FROM walk w JOIN q ON q.app = w.app AND q.key = w.key AND q.k = w.k + 1)
SELECT app, key, ts, alert_id FROM walk WHERE ok"""
Q["alert_hourly_cap"] = lambda spark, sf: AL.alert_gate(_alerts(spark, sf), cooldown=30.0, max_per_hour=8).select("app", "key", "ts", "alert_id")
SQL["alert_hourly_cap"] = f"""WITH RECURSIVE {ALERTS}, q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY app ORDER BY ts, alert_id) AS k FROM al),
walk AS (SELECT app, key, ts, alert_id, k, TRUE AS ok, [{{'t': ts, 'key': key}}] AS st FROM q WHERE k = 1
  UNION ALL SELECT app, key, ts, alert_id, k, ok, CASE WHEN ok THEN list_append(st, {{'t': ts, 'key': key}}) ELSE st END FROM (
    SELECT q.app, q.key, q.ts, q.alert_id, q.k, list_filter(w.st, lambda s: q.ts - s.t < 3600) AS st,
      len(list_filter(w.st, lambda s: q.ts - s.t < 3600)) < 8 AND len(list_filter(w.st, lambda s: s.key = q.key AND q.ts - s.t < 30)) = 0 AS ok
    FROM walk w JOIN q ON q.app = w.app AND q.k = w.k + 1))
SELECT app, key, ts, alert_id FROM walk WHERE ok"""


def alert_stats(spark, sf):
    a = _alerts(spark, sf)
    return AL.alert_stats(a, AL.alert_gate(a, cooldown=30.0, max_per_hour=8))


Q["alert_stats"] = alert_stats
SQL["alert_stats"] = SQL["alert_hourly_cap"].replace("SELECT app, key, ts, alert_id FROM walk WHERE ok",
                                                     """SELECT o.app, CAST(o.offered AS BIGINT) AS offered, s.sent, CAST(o.offered - s.sent AS BIGINT) AS suppressed
FROM (SELECT app, sum(c) AS offered FROM al GROUP BY app) o JOIN (SELECT app, count_if(ok) AS sent FROM walk GROUP BY app) s ON s.app = o.app""")
Q["alert_min_level"] = lambda spark, sf: AL.alert_min_level(C.logs(spark, sf), "ERROR").select("entry_id", "level")
SQL["alert_min_level"] = f"WITH {C.LOGS_DUCK} SELECT entry_id, level FROM logs WHERE {S.severity('level')} <= 3"


def rolling_window_counts(spark, sf):
    """Severe entries among the last 500 of each conversation role, and of each log source."""
    e = C.logs(spark, sf).select("source", F.col("entry_id").alias("line_no"), severity("level").alias("sev"))
    from siftlog.operators.lines import number_entries
    from pyspark.sql import functions as F_

    pos = stage(number_entries(e, 1000, "pos"))
    starts = pos.groupBy("source").agg(F_.min("pos").alias("_s"))
    pos = pos.join(starts, "source").withColumn("pos", F_.col("pos") - F_.col("_s")).drop("_s")
    r = rolling.rolling_counts(pos, {}, 500, block_rows=1000, totals={"in_window": F_.lit(1), "severe": F_.col("sev") <= 3})
    return r.select("source", F_.col("line_no").alias("entry_id"), "in_window", "severe")


Q["rolling_window_counts"] = rolling_window_counts
SQL["rolling_window_counts"] = f"""WITH {C.LOGS_DUCK} SELECT source, entry_id, count(*) OVER w AS in_window, count_if({S.severity('level')} <= 3) OVER w AS severe FROM logs
WINDOW w AS (PARTITION BY source ORDER BY entry_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)"""


def rolling_turns(spark, sf):
    """The same frame over conversation turns: characters of the last three turns."""
    c = C.table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("bigint").alias("chars"))
    r = rolling.rolling_counts(c, {"chars_3": F.sum("chars")}, 3, block_rows=4, key="conv_id", pos="turn")
    return r.select("conv_id", "turn", "chars_3")


Q["rolling_turns"] = rolling_turns
SQL["rolling_turns"] = "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS chars_3 FROM conversations"


def _worker(message):
    if "timeout" in message:
        raise TimeoutError(message)
    return None if message.startswith("page") else message.split(" ")[0]


Q["safe_map"] = lambda spark, sf: outcome_counts(run_safe(C.logs(spark, sf), "entry_id", _worker, ["message"]))
SQL["safe_map"] = f"""WITH {C.LOGS_DUCK} SELECT count_if(message NOT LIKE '%timeout%' AND message NOT LIKE 'page%') AS processed,
  count_if(message NOT LIKE '%timeout%' AND message LIKE 'page%') AS skipped, count_if(message LIKE '%timeout%') AS errors FROM logs"""
