"""Templates, flags, bursts, baseline, scan, score and group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.config import Settings
from siftlog.functions import fixed as X
from siftlog.functions.features import feature_vector
from siftlog.functions.vectors import row_normalize
from siftlog.operators import (baseline as BL, bursts as BU, digest as DG, flags as FL, groups as G, outliers as OU, scan as SC,
                               score as SR, templates as TP)
from siftlog.operators.parse import render_entry
from siftlog.runtime import stage

from . import corpus as C
from . import sqltext as S

Q, SQL = {}, {}
CFG = Settings()


def prepared(spark, sf):
    """Entries with their derived columns, staged once per application like a table."""
    return C._once(spark, sf, "prepared", lambda: TP.prepare(C.entries(spark, sf)))


PREP = C.LOGS_DUCK + f""",
prep0 AS MATERIALIZED (SELECT source, entry_id, event_id, ts_raw, level, service, message, upper(level) AS lvl, {S.severity('level')} AS sev,
  {S.template_key('message')} AS template, epoch(CAST(left(replace(ts_raw, 'T', ' '), 19) AS TIMESTAMP)) AS epoch FROM logs),
prep AS (SELECT *, floor((epoch - (SELECT min(epoch) FROM prep0)) / 60.0::DOUBLE) AS win FROM prep0),
tot AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.25::DOUBLE) AS BIGINT) AS head_cut,
  greatest(5, CAST(floor(count(*) * 0.002::DOUBLE) AS BIGINT)) AS rec_cut FROM prep)"""
BURST = """,
wc AS (SELECT sev, win, count(*) AS cnt FROM prep WHERE epoch IS NOT NULL AND sev <= 4 GROUP BY sev, win),
ws AS (SELECT sev, median(cnt) AS base, sum(cnt) AS timed, count(*) AS wins FROM wc GROUP BY sev),
hot AS (SELECT wc.sev, wc.win, wc.cnt, ws.base, greatest(10.0::DOUBLE, 4.0::DOUBLE * greatest(ws.base, 1.0::DOUBLE)) AS cut FROM wc JOIN ws ON ws.sev = wc.sev
  WHERE ws.timed >= 10 AND ws.wins >= 2 AND (SELECT count(epoch) FROM prep) >= 20 AND wc.cnt >= greatest(10.0::DOUBLE, 4.0::DOUBLE * greatest(ws.base, 1.0::DOUBLE))),
bent AS (SELECT p.*, h.sev IS NOT NULL AS burst FROM prep p LEFT JOIN hot h ON h.sev = p.sev AND h.win = p.win)"""
TPL = """,
tpl0 AS (SELECT lvl, template, min(entry_id) AS template_id, min(sev) AS sev, count(*) AS cnt, min(entry_id) AS first_id, max(entry_id) AS last_id,
  count_if(entry_id < (SELECT head_cut FROM tot)) AS head_cnt, bool_or(burst) AS any_burst, arg_min(service, entry_id) AS rep_service,
  arg_min(message, entry_id) AS rep_message, arg_min(level, entry_id) AS rep_level FROM bent GROUP BY lvl, template),
tpl AS (SELECT *, cnt / n::DOUBLE AS share, CASE WHEN cnt > 1 THEN (last_id - first_id) / greatest(n - 1, 1)::DOUBLE ELSE 0.0::DOUBLE END AS span,
  head_cnt / cnt::DOUBLE AS head_share FROM tpl0, tot),
base AS (SELECT lvl || '|' || template AS template_key, count(*) AS base_count FROM prep WHERE entry_id % 2 = 0 AND event_id % 1000 < 700 GROUP BY 1),
cmp AS (SELECT t.*, coalesce(b.base_count, 0) AS base_count, coalesce(b.base_count, 0) = 0 AS novel,
  coalesce(b.base_count > 0 AND t.cnt / t.n::DOUBLE > 10 * (b.base_count / (SELECT sum(base_count) FROM base)::DOUBLE) AND t.cnt >= 3, FALSE) AS surge
  FROM tpl t LEFT JOIN base b ON b.template_key = t.lvl || '|' || t.template),
flg AS (SELECT *, sev <= 4 AND share >= 0.20 AS flood, share <= 0.005 AS global_rare, sev <= 4 AND cnt >= rec_cut AND NOT (NOT novel AND NOT surge) AS recurring,
  sev IN (3, 4) AND (share >= 0.15 OR cnt >= 25) AND span >= 0.50 AND NOT any_burst AS chronic FROM cmp)"""


def baseline(spark, sf):
    p = prepared(spark, sf)
    return BL.build_baseline(p.filter((F.col("entry_id") % 2 == 0) & (F.col("entry_id") % 1000 < 700)))


def template_counts(spark, sf):
    return TP.template_counts(TP.prepare(C.entries(spark, sf))).drop("first_id")


Q["template_counts"] = template_counts
SQL["template_counts"] = "WITH " + PREP + " SELECT lvl, template, count(*) AS cnt, max(entry_id) AS last_id FROM prep GROUP BY lvl, template"


def template_representatives(spark, sf):
    return TP.template_representatives(prepared(spark, sf))


Q["template_representatives"] = template_representatives
SQL["template_representatives"] = "WITH " + PREP + """ SELECT min(entry_id) AS template_id, lvl, template, arg_min(service, entry_id) AS service,
  arg_min(message, entry_id) AS rep_message FROM prep GROUP BY lvl, template"""


def entry_template_join(spark, sf):
    p = prepared(spark, sf)
    return TP.with_template_id(p, TP.build_templates(p)).select("entry_id", "template_id")


Q["entry_template_join"] = entry_template_join
SQL["entry_template_join"] = "WITH " + PREP + " SELECT entry_id, min(entry_id) OVER (PARTITION BY lvl, template) AS template_id FROM prep"

Q["template_redundancy"] = lambda spark, sf: TP.redundancy(prepared(spark, sf))
SQL["template_redundancy"] = "WITH " + PREP + """, t AS (SELECT count(*) AS c FROM prep GROUP BY lvl, template)
SELECT CAST(sum(c) AS BIGINT) AS entries, count(*) AS unique_templates, 1 - count(*) / sum(c)::DOUBLE AS redundancy FROM t"""
Q["level_counts"] = lambda spark, sf: TP.level_counts(C.entries(spark, sf))
SQL["level_counts"] = f"WITH {C.LOGS_DUCK} SELECT upper(level) AS level, count(*) AS cnt FROM logs GROUP BY 1"


def document_templates(spark, sf):
    """Templates of the lines of all documents: long, multilingual, repeated text."""
    docs = C.table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "message")).filter(F.trim("message") != "")
    t = TP.prepare(lines.select((F.col("doc_id") * 100000 + F.col("pos")).alias("entry_id"), "message", F.lit("INFO").alias("level"), F.lit("").alias("ts_raw")))
    return TP.template_counts(t)


Q["document_templates"] = document_templates


def burst_windows(spark, sf):
    return BU.hot_windows(BU.with_window(prepared(spark, sf))).select("sev", F.col("win").cast("bigint").alias("win"), "cnt", "base", "cut")


Q["burst_windows"] = burst_windows
SQL["burst_windows"] = "WITH " + PREP + BURST + " SELECT sev, CAST(win AS BIGINT) AS win, cnt, base, cut FROM hot"


def burst_entries(spark, sf):
    return BU.mark_bursts(prepared(spark, sf)).filter("burst").select("entry_id", "sev")


Q["burst_entries"] = burst_entries
SQL["burst_entries"] = "WITH " + PREP + BURST + " SELECT entry_id, sev FROM bent WHERE burst"

Q["incident_mode"] = lambda spark, sf: FL.incident(prepared(spark, sf), FL.Volumes(incident=0.15))
SQL["incident_mode"] = "WITH " + PREP + """ SELECT count(*) AS entries, count_if(sev <= 3) AS severe_entries, count_if(sev <= 3) / count(*)::DOUBLE AS severe_share,
  count_if(sev <= 3) / count(*)::DOUBLE >= 0.15 AS incident_mode, CASE WHEN count_if(sev <= 3) / count(*)::DOUBLE >= 0.15 THEN
  format('{:.0f}', count_if(sev <= 3) / count(*)::DOUBLE * 100) || '% of entries are ERROR or worse — corpus looks like an incident window' ELSE '' END AS incident_note FROM prep"""


def flagged_templates(spark, sf, with_baseline=True):
    p = BU.mark_bursts(prepared(spark, sf))
    n = prepared(spark, sf).count()
    t = stage(TP.build_templates(p, FL.head_cut(n)))
    if with_baseline:
        t = BL.compare(t, baseline(spark, sf), F.lit(n))
    return FL.add_flags(t, n, has_baseline=with_baseline)


def template_flags(spark, sf):
    t = flagged_templates(spark, sf)
    return t.select("lvl", "template", "cnt", F.round("share", 9).alias("share"), F.round("span", 9).alias("span"), F.round("head_share", 9).alias("head_share"),
                    "flood", "global_rare", "recurring", "chronic", "any_burst")


Q["template_flags"] = template_flags
SQL["template_flags"] = "WITH " + PREP + BURST + TPL + """ SELECT lvl, template, cnt, round(share, 9) AS share, round(span, 9) AS span, round(head_share, 9) AS head_share,
  flood, global_rare, recurring, chronic, any_burst FROM flg"""


def baseline_compare(spark, sf):
    return flagged_templates(spark, sf).select("lvl", "template", "cnt", "base_count", "novel", "surge")


Q["baseline_compare"] = baseline_compare
SQL["baseline_compare"] = "WITH " + PREP + BURST + TPL + " SELECT lvl, template, cnt, base_count, novel, surge FROM cmp"


def novel_templates(spark, sf):
    return BL.novel_templates(TP.build_templates(prepared(spark, sf)), baseline(spark, sf)).select("lvl", "template", "cnt")


Q["novel_templates"] = novel_templates
SQL["novel_templates"] = "WITH " + PREP + BURST + TPL + " SELECT lvl, template, cnt FROM cmp WHERE novel"

# --- scan ------------------------------------------------------------------


def template_scan(spark, sf):
    return SC.template_scan(C.entries(spark, sf)).select("level", "template", "cnt", "sample", "service", F.round("score", 3).alias("score"),
                                                         (F.col("score") >= 0.5).alias("anomaly"))


SCAN = f""",
m AS (SELECT level, {S.scan_mask('message')} AS template, count(*) AS cnt, arg_min(message, entry_id) AS sample, arg_min(service, entry_id) AS service FROM logs GROUP BY 1, 2),
t AS (SELECT sum(cnt)::DOUBLE AS total, count(*) AS uniq FROM m),
w AS (SELECT m.*, total, uniq, ln(1 + total / cnt) / ln(1 + total) AS rarity, CAST({S.case_map('level', X.SCAN_WEIGHT, '0.1')} AS DOUBLE) AS sev FROM m, t),
scan AS (SELECT level, template, cnt, sample, service, round(least(CASE WHEN uniq > 0.5 * total THEN 0.75::DOUBLE * sev + 0.25::DOUBLE * rarity
  ELSE 0.55::DOUBLE * rarity + 0.45::DOUBLE * sev END, 1.0::DOUBLE), 4) AS score FROM w)"""
Q["template_scan"] = template_scan
SQL["template_scan"] = "WITH " + C.LOGS_DUCK + SCAN + " SELECT level, template, cnt, sample, service, round(score, 3) AS score, score >= 0.5 AS anomaly FROM scan"


def scan_summary(spark, sf):
    return SC.scan_summary(SC.template_scan(C.entries(spark, sf)))


Q["scan_summary"] = scan_summary
SQL["scan_summary"] = "WITH " + C.LOGS_DUCK + SCAN + """, top AS (SELECT * FROM scan WHERE score >= 0.5 ORDER BY score DESC, level, template LIMIT 20)
SELECT CAST(sum(cnt) AS BIGINT) AS parsed_lines, count(*) AS unique_templates, round(1 - count(*) / sum(cnt)::DOUBLE, 4) AS redundancy,
  count_if(score >= 0.5) AS anomaly_count, (SELECT string_agg(level || ' x' || cnt || ' ' || left(sample, 200), chr(10) ORDER BY score DESC, level, template) FROM top) AS top_anomalies FROM scan"""


def flagship(spark, sf):
    """Lines → entries → masked templates → scored scan, best twenty."""
    from siftlog.operators.parse import parse_lines, with_format

    lines = C.logs(spark, sf).select("source", "entry_id", F.col("line").alias("value"))
    entries = parse_lines(with_format(lines))
    return (SC.scan_anomalies(SC.template_scan(entries)).orderBy(F.desc("score"), "level", "template").limit(20)
            .select("level", "template", "cnt", "sample", "service", "score"))


Q["scan_top"] = flagship
SQL["scan_top"] = "WITH " + C.LOGS_DUCK + SCAN + " SELECT level, template, cnt, sample, service, score FROM scan WHERE score >= 0.5 ORDER BY score DESC, level, template LIMIT 20"

# --- outliers and score ----------------------------------------------------
# The score checks take clusters as an input: templates with the same first word
# form a cluster, and first words with fewer than four entries are noise.


def with_word_clusters(t):
    word = F.substring_index("template", " ", 1)
    groups = t.groupBy(word.alias("word")).agg(F.sum("cnt").alias("_n"), F.min("template_id").alias("_c"))
    return (t.withColumn("word", word).join(groups, "word")
            .withColumn("cluster", F.when(F.col("_n") < 4, F.lit(-1)).otherwise(F.col("_c"))).drop("word", "_n", "_c"))


def with_outliers(t):
    vec = row_normalize(feature_vector("rep.level", "rep.service", "rep.message"))
    return OU.level_outliers(stage(t.withColumn("vec", vec)))


def level_outliers(spark, sf):
    t = with_outliers(TP.build_templates(prepared(spark, sf)))
    return t.select("template_id", "lvl", "outlier", F.round("outlier_z", 5).alias("outlier_z"), F.round("outlier_dist", 7).alias("outlier_dist"))


_f = S.features("rep_level", "rep_service", "rep_message")
_fv = "[" + ", ".join(v for k, v in _f.items() if k != "_norm") + "]"
OUT = f""",
vec0 AS MATERIALIZED (SELECT template_id, lvl, cnt, {_fv} AS f FROM (SELECT *, {_f['_norm']} AS nrm FROM tpl0)),
vec AS (SELECT template_id, lvl, cnt, list_transform(f, lambda x: x / s) AS v FROM (SELECT *, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS s FROM vec0)),
cen0 AS (SELECT lvl, i, sum(cnt * v[i]) / sum(cnt) AS c, count(*) AS k FROM vec, range(1, 15) r(i) GROUP BY lvl, i),
cen AS (SELECT lvl, list(c / nrm ORDER BY i) AS c FROM (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY lvl)) AS nrm FROM cen0) WHERE k >= 4 GROUP BY lvl),
dst AS (SELECT vec.*, 1 - list_dot_product(v, c) AS d FROM vec LEFT JOIN cen ON cen.lvl = vec.lvl),
dm AS (SELECT lvl, sum(cnt * d) / sum(cnt) AS m FROM dst WHERE d IS NOT NULL GROUP BY lvl),
dsd AS (SELECT dst.lvl, any_value(m) AS m, sqrt(sum(cnt * (d - m) * (d - m)) / sum(cnt)) AS s FROM dst JOIN dm ON dm.lvl = dst.lvl GROUP BY dst.lvl),
outl AS (SELECT template_id, dst.lvl, coalesce(d > m + 2 * s AND d > 0.05, FALSE) AS outlier,
  CASE WHEN coalesce(d > m + 2 * s AND d > 0.05, FALSE) THEN CASE WHEN s > 1e-9 THEN (d - m) / s ELSE 10.0 END ELSE 0.0::DOUBLE END AS outlier_z,
  CASE WHEN coalesce(d > m + 2 * s AND d > 0.05, FALSE) THEN d ELSE 0.0::DOUBLE END AS outlier_dist FROM dst LEFT JOIN dsd ON dsd.lvl = dst.lvl)"""
Q["level_outliers"] = level_outliers
SQL["level_outliers"] = "WITH " + PREP + BURST + TPL + OUT + " SELECT template_id, lvl, outlier, round(outlier_z, 5) AS outlier_z, round(outlier_dist, 7) AS outlier_dist FROM outl"


def scored_once(spark, sf):
    """Templates with all statistics and scored entries; staged, as a results table would be."""
    t = C._once(spark, sf, "stats", lambda: SR.add_level_and_cluster_sizes(with_outliers(with_word_clusters(flagged_templates(spark, sf)))))
    scored = C._once(spark, sf, "scored", lambda: SR.flag(SR.score_entries(BU.mark_bursts(prepared(spark, sf)), t), CFG.threshold))
    return t, scored


def score_entries(spark, sf):
    t = SR.add_level_and_cluster_sizes(with_outliers(with_word_clusters(flagged_templates(spark, sf))))
    s = SR.flag(SR.score_entries(BU.mark_bursts(prepared(spark, sf)), stage(t)), CFG.threshold)
    return s.select("entry_id", "template_id", "cluster", F.round("score", 6).alias("score"), F.array_join("reason_codes", ",").alias("codes"), "flagged")


SCORE = f""",
wrd AS (SELECT split_part(template, ' ', 1) AS word, sum(cnt) AS n, min(template_id) AS c FROM flg GROUP BY 1),
clu AS (SELECT f.*, CASE WHEN w.n < 4 THEN -1 ELSE w.c END AS cluster, o.outlier, o.outlier_z, o.outlier_dist FROM flg f
  JOIN wrd w ON w.word = split_part(f.template, ' ', 1) JOIN outl o ON o.template_id = f.template_id),
st AS (SELECT *, sum(cnt) OVER (PARTITION BY lvl)::DOUBLE AS level_total, sum(cnt) OVER (PARTITION BY cluster)::DOUBLE AS cluster_size,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, (head_share - 0.25) / 0.75::DOUBLE)) AS routine FROM clu),
s1 AS (SELECT *, sev <= 1 AS hard, sev IN (3, 4) AND cnt >= 5 AND span >= 0.40 AND routine > 0 AS hist,
  greatest(3.0::DOUBLE, floor(level_total * 0.02::DOUBLE)) AS rc, cnt <= greatest(2, floor(0.005::DOUBLE * level_total)) AS rare_t, cluster = -1 AS noise FROM st),
s2 AS (SELECT *, NOT noise AND cluster_size <= rc AS rare_c,
  CASE WHEN hard THEN 1.0::DOUBLE ELSE CASE sev WHEN 2 THEN 0.70::DOUBLE WHEN 3 THEN 0.55 WHEN 4 THEN 0.42 WHEN 5 THEN 0.08 ELSE 0.0 END
    * CASE WHEN chronic THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN hist THEN 1.0::DOUBLE - 0.45::DOUBLE * routine ELSE 1.0::DOUBLE END END AS b0,
  cnt / (cnt + 8.0::DOUBLE) * (1.0::DOUBLE - span) AS conc,
  outlier AND outlier_z >= 4.0 AND outlier_dist > 0.08 AS extreme FROM s1),
s3 AS (SELECT *, CASE WHEN noise THEN 0.75::DOUBLE WHEN rare_c THEN 0.45::DOUBLE + 0.30::DOUBLE * (1 - cluster_size / (rc + 1)) ELSE 0.0::DOUBLE END AS r0 FROM s2),
s4 AS (SELECT *, greatest(CASE WHEN outlier THEN greatest(r0, least(0.35::DOUBLE + 0.10::DOUBLE * greatest(0.0::DOUBLE, outlier_z - 2), 0.75::DOUBLE)) ELSE r0 END,
  CASE WHEN rare_t THEN 0.40::DOUBLE ELSE 0.0::DOUBLE END) * CASE WHEN sev >= 5 AND NOT noise AND NOT extreme THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN chronic THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS rar FROM s3),
sent AS (SELECT e.entry_id, e.source, e.level, e.lvl, e.service, e.message, e.template, e.ts_raw, e.sev, e.burst, s.* EXCLUDE (lvl, template, sev),
  {S.matches('e.message', X.CATASTROPHE_PATTERNS)} AND e.sev <= 4 AS cat, {S.matches('e.message', X.FAILURE_PATTERNS)} AND e.sev <= 4 AS fail,
  s.global_rare AND e.sev <= 4 AND NOT s.chronic AS gr
  FROM bent e JOIN s4 s ON s.lvl = e.lvl AND s.template = e.template),
raw AS (SELECT *, b0 + rar + CASE WHEN gr THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN burst THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN flood THEN 0.35::DOUBLE + 0.25::DOUBLE * least(1.0::DOUBLE, share) ELSE 0.0::DOUBLE END
  + CASE WHEN recurring THEN 0.02::DOUBLE + 0.25::DOUBLE * conc ELSE 0.0::DOUBLE END + CASE WHEN cat THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN fail THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN sev <= 4 AND novel THEN 0.35::DOUBLE WHEN sev <= 4 AND surge THEN 0.30::DOUBLE ELSE 0.0::DOUBLE END AS x FROM sent),
scored AS MATERIALIZED (SELECT *, CASE WHEN x <= 0.8 THEN greatest(0.0::DOUBLE, x) ELSE 0.8::DOUBLE + (1.0::DOUBLE - 0.8::DOUBLE) * (1 - exp(-(x - 0.8::DOUBLE) / 0.6::DOUBLE)) END AS score,
  list_filter([CASE WHEN hard THEN 'hard' END, CASE WHEN NOT hard AND hist THEN 'history' END, CASE WHEN NOT hard AND b0 > 0 THEN 'severity' END,
   CASE WHEN noise THEN 'noise' END, CASE WHEN rare_c THEN 'rare_cluster' END, CASE WHEN outlier THEN 'outlier' END, CASE WHEN rare_t AND NOT rare_c THEN 'rare_template' END,
   CASE WHEN chronic THEN 'chronic' END, CASE WHEN gr THEN 'global_rare' END, CASE WHEN burst THEN 'burst' END, CASE WHEN flood THEN 'flood' END,
   CASE WHEN recurring THEN 'recurring' END, CASE WHEN cat THEN 'catastrophe' END, CASE WHEN fail THEN 'failure' END,
   CASE WHEN sev <= 4 AND novel THEN 'novel' WHEN sev <= 4 AND surge THEN 'surge' END], lambda r: r IS NOT NULL) AS codes,
  list_filter([CASE WHEN hard THEN lvl || ' level is always flagged' END,
   CASE WHEN NOT hard AND hist THEN 'routine by own history (' || format('{{:.0f}}', head_share * 100) || '% of occurrences in leading window)' END,
   CASE WHEN NOT hard AND b0 > 0 THEN 'severity ' || lvl END, CASE WHEN noise THEN 'unclustered (semantic noise point)' END,
   CASE WHEN rare_c THEN 'rare pattern (' || CAST(cluster_size AS BIGINT) || ' of ' || CAST(level_total AS BIGINT) || ' ' || lvl || ' entries)' END,
   CASE WHEN outlier THEN 'semantic outlier within ' || lvl || ' level (z=' || format('{{:.1f}}', outlier_z) || ')' END,
   CASE WHEN rare_t AND NOT rare_c THEN 'template seen only ' || cnt || 'x' END, CASE WHEN chronic THEN 'chronic pattern (' || cnt || 'x) — damped as routine noise' END,
   CASE WHEN gr THEN 'globally rare (' || format('{{:.2f}}', share * 100) || '% of file)' END, CASE WHEN burst THEN 'rate burst (> 4x baseline in 60s window)' END,
   CASE WHEN flood THEN 'flood: pattern is ' || format('{{:.0f}}', share * 100) || '% of the whole file' END,
   CASE WHEN recurring THEN 'recurring ' || lvl || ' pattern (' || cnt || 'x, concentration ' || format('{{:.2f}}', conc) || ')' END,
   CASE WHEN cat THEN 'catastrophic keyword' END, CASE WHEN fail THEN 'failure keyword in severe entry' END,
   CASE WHEN sev <= 4 AND novel THEN 'never seen in baseline' WHEN sev <= 4 AND surge THEN 'frequency surge vs baseline (>10x)' END], lambda r: r IS NOT NULL) AS reasons
  FROM raw),
hit AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, entry_id) - 1 AS rank_id FROM scored WHERE score >= 0.70)"""
SCORED = "WITH " + PREP + BURST + TPL + OUT + SCORE
Q["score_entries"] = score_entries
SQL["score_entries"] = SCORED + " SELECT entry_id, template_id, cluster, round(score, 6) AS score, array_to_string(codes, ',') AS codes, score >= 0.70 AS flagged FROM scored"

# --- views over scored entries ---------------------------------------------


def _over_scored(name, fn, sql):
    Q[name] = lambda spark, sf: fn(*scored_once(spark, sf))
    SQL[name] = SCORED + " " + sql


def _ranked(scored):
    return G.rank_anomalies(scored)


_over_scored("entry_reasons", lambda t, s: s.select("entry_id", F.array_join("reasons", "; ").alias("reasons")),
             "SELECT entry_id, array_to_string(reasons, '; ') AS reasons FROM scored")
_over_scored("rank_anomalies", lambda t, s: _ranked(s.withColumn("score", F.round("score", 12))).select("rank_id", "entry_id", F.round("score", 6).alias("score")),
             "SELECT rank_id, entry_id, round(score, 6) AS score FROM hit")
_over_scored("anomaly_rows", lambda t, s: s.filter("flagged").select("entry_id", F.round("score", 4).alias("score"), render_entry("level", "service", "score", "message", "reasons").alias("line")),
             """SELECT entry_id, round(score, 4) AS score, '[' || level || ']' || CASE WHEN service IN ('', 'unknown') THEN '' ELSE ' ' || service END || ' (score ' || format('{:.2f}', score) || ') '
             || message || CASE WHEN len(reasons) > 0 THEN '  [' || array_to_string(reasons, '; ') || ']' ELSE '' END AS line FROM hit""")
_over_scored("anomaly_groups", lambda t, s: G.anomaly_groups(s).select(
    "lvl", "template", "cnt", F.round("score", 6).alias("score"), "rep_message", F.array_join("reasons", "; ").alias("reasons"), F.array_join("services", ",").alias("services")),
    """, rs AS (SELECT lvl, template, r, min(entry_id * 100 + i) AS ord FROM (SELECT lvl, template, entry_id, unnest(reasons) AS r, generate_subscripts(reasons, 1) AS i FROM hit) GROUP BY 1, 2, 3),
    ra AS (SELECT lvl, template, string_agg(r, '; ' ORDER BY ord) AS reasons FROM rs GROUP BY 1, 2),
    sv AS (SELECT lvl, template, array_to_string(list_sort(list_distinct(list(service)))[1:5], ',') AS services FROM hit GROUP BY 1, 2)
    SELECT h.lvl, h.template, count(*) AS cnt, round(max(score), 6) AS score, arg_min(message, entry_id) AS rep_message, any_value(ra.reasons) AS reasons, any_value(sv.services) AS services
    FROM hit h JOIN ra ON ra.lvl = h.lvl AND ra.template = h.template JOIN sv ON sv.lvl = h.lvl AND sv.template = h.template GROUP BY h.lvl, h.template""")
_over_scored("patterns", lambda t, s: G.patterns(s, s.count()).select("lvl", "template", "cnt", F.round("share", 9).alias("share"), "flagged", "rep_message", F.array_join("services", ",").alias("services")),
             """SELECT lvl, template, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM scored)::DOUBLE, 9) AS share, bool_or(score >= 0.70) AS flagged, arg_min(message, entry_id) AS rep_message,
             array_to_string(list_sort(list_distinct(list(service)))[1:5], ',') AS services FROM scored WHERE sev <= 4 GROUP BY lvl, template HAVING count(*) >= 5
             ORDER BY min(sev), count(*) DESC, lvl, template LIMIT 15""")
FAM = f""", fam AS (SELECT lvl, service, {S.family_key('message')} AS family, count(*) AS cnt, max(score) AS max_score, min(rank_id) AS first_rank, arg_min(message, rank_id) AS sample,
  arg_min(reasons, rank_id) FILTER (len(reasons) > 0) AS reasons FROM hit GROUP BY 1, 2, 3)"""
_over_scored("incident_families", lambda t, s: G.incident_families(_ranked(s.withColumn("score", F.round("score", 12)))).select(
    "lvl", "service", "family", "cnt", F.round("max_score", 6).alias("max_score"), "sample", F.array_join("reasons", "; ").alias("reasons")),
    FAM + " SELECT lvl, service, family, cnt, round(max_score, 6) AS max_score, sample, array_to_string(reasons, '; ') AS reasons FROM fam")
_over_scored("group_summaries", lambda t, s: DG.group_summaries(G.incident_families(_ranked(s.withColumn("score", F.round("score", 12))))),
             FAM + """ SELECT lvl, service, family, '[' || lvl || '] ' || service || ' (x' || cnt || ', score ' || format('{:.2f}', max_score) || '): ' || left(sample, 160)
             || CASE WHEN len(reasons) > 0 THEN ' | signals: ' || array_to_string(reasons, '; ') ELSE '' END AS line FROM fam ORDER BY round(max_score, 12) DESC, cnt DESC, first_rank LIMIT 40""")


def _digest(t, s):
    fams = G.incident_families(_ranked(s.withColumn("score", F.round("score", 12))))
    msgs = DG.family_messages(fams)
    from siftlog.runtime import number_ordered

    ranked = number_ordered(msgs, [F.desc("score"), F.desc("cnt"), F.asc("first_rank")], "rank_id")
    context = s.filter("not flagged").select(F.col("message").alias("line"), F.col("entry_id").alias("rank_id"))
    return DG.rca_digest(ranked, context, "event log")


_over_scored("rca_digest", _digest, FAM + """, rk AS (SELECT *, row_number() OVER (ORDER BY max_score DESC, cnt DESC, first_rank) AS k FROM (SELECT * REPLACE (round(max_score, 12) AS max_score) FROM fam)),
  top AS (SELECT k, '[' || lvl || '] ' || service || ': ' || sample || ' (occurred ×' || cnt || ', score ' || format('{:.2f}', max_score) || ')' || ' score=' || format('{:.2f}', max_score) || ' reason=' || array_to_string(reasons, '; ') AS l FROM rk WHERE k <= 40),
  ctx AS (SELECT entry_id, message AS l FROM scored WHERE score < 0.70 ORDER BY entry_id LIMIT 20)
  SELECT (SELECT count(*) FROM top) AS lines_sent, 'Log source: event log' || chr(10) || 'Total anomalies detected locally: ' || (SELECT count(*) FROM fam) || chr(10) || chr(10) || '--- ANOMALOUS LINES (top, by score) ---' || chr(10)
   || (SELECT string_agg(l, chr(10) ORDER BY k) FROM top) || chr(10) || chr(10) || '--- SURROUNDING NORMAL CONTEXT (sample) ---' || chr(10) || (SELECT string_agg(l, chr(10) ORDER BY entry_id) FROM ctx) AS digest""")
_over_scored("sorted_anomalies", lambda t, s: G.sorted_anomalies(G.report_rows(_ranked(s.withColumn("score", F.round("score", 12)))), "severity").select("entry_id", "level", "service"),
             f"""SELECT entry_id, level, service FROM hit WHERE upper(level) <> 'INFO' OR {S.any_word('lower(message)', X.REPORT_INFO_WORDS)}
             ORDER BY {S.case_map('upper(level)', X.SORT_SEVERITY, '2')} DESC, rank_id""")
_over_scored("explain_top", lambda t, s: G.explain_top(s.withColumn("score", F.round("score", 9)), 25).select("entry_id", "score", F.array_join("reasons", "; ").alias("reasons")),
             "SELECT entry_id, round(score, 9) AS score, array_to_string(reasons, '; ') AS reasons FROM scored ORDER BY round(score, 9) DESC, entry_id LIMIT 25")
_over_scored("cluster_sizes", lambda t, s: G.cluster_sizes(t), "SELECT cluster, CAST(sum(cnt) AS BIGINT) AS entries, count(*) AS templates FROM st GROUP BY cluster")
_over_scored("run_summary", lambda t, s: G.run_summary(s, G.anomaly_groups(s), G.patterns(s, s.count()), t),
             """SELECT count(*) AS entries, (SELECT count(DISTINCT cluster) FROM st WHERE cluster <> -1) AS clusters, count_if(score >= 0.70) AS anomalies, count_if(cluster = -1) AS noise_points,
             (SELECT count(*) FROM (SELECT DISTINCT lvl, template FROM hit)) AS anomaly_groups,
             (SELECT least(15, count(*)) FROM (SELECT 1 FROM scored WHERE sev <= 4 GROUP BY lvl, template HAVING count(*) >= 5)) AS patterns FROM scored""")
_over_scored("run_meta", lambda t, s: DG.run_meta(s, t, 0.7, 0.7, 0.5),
             """SELECT count(*) AS unique_templates, (SELECT count_if(sev <= 3) / count(*)::DOUBLE FROM scored) AS severe_share, 0.7::DOUBLE AS flag_threshold, 0.7::DOUBLE AS threshold_used,
             count_if(chronic) AS chronic_templates, count_if(global_rare) AS global_rare_templates, 0.5::DOUBLE AS eps FROM st""")
_over_scored("report_incident", lambda t, s: FL.report_incident(s.filter("flagged"), s.select(F.count(F.lit(1)).alias("n")).scalar()),
             """SELECT count(*) AS anomalies, count_if(upper(level) IN ('EMERGENCY', 'FATAL', 'CRITICAL', 'ERROR')) AS severe_anomalies, (SELECT count(*) FROM scored) AS entries,
             count_if(upper(level) IN ('EMERGENCY', 'FATAL', 'CRITICAL', 'ERROR')) / (SELECT count(*) FROM scored)::DOUBLE AS severe_share,
             count_if(upper(level) IN ('EMERGENCY', 'FATAL', 'CRITICAL', 'ERROR')) / (SELECT count(*) FROM scored)::DOUBLE >= 0.30 AS incident FROM hit""")
