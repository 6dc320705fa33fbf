"""The whole analysis as one Spark job: lines → entries → scores → reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings, settings
from ..operators import baseline as BL, bursts as BU, cluster as CL, digest as DG, evaluate as EV, flags as FL, groups as G, lines as L
from ..operators import neighbors as NB, outliers as OU, parse as P, score as SR, synonyms as SY, templates as TP, textvec as TV
from ..runtime import lookup_join, stage
from ..sources.readers import read_logs


RESULT_COLUMNS = {"lvl", "sev", "template", "epoch", "win", "burst", "template_id", "cluster", "raw_score", "score",
                  "reasons", "reason_codes", "flagged"}


@dataclass
class Detection:
    """Result tables of one run; all lazy except the staged ones."""

    scored: DataFrame          # one row per entry
    stats: DataFrame           # one row per template
    n: int
    eps: float
    threshold: float
    cfg: Settings

    @property
    def anomalies(self) -> DataFrame:
        return G.rank_anomalies(self.scored)

    @property
    def groups(self) -> DataFrame:
        return G.anomaly_groups(self.scored)

    @property
    def patterns(self) -> DataFrame:
        return G.patterns(self.scored, self.n, self.cfg.pattern_least, self.cfg.pattern_top)

    def families(self, limit: int | None = None) -> DataFrame:
        return G.incident_families(self.anomalies, limit)

    def summary(self) -> DataFrame:
        return G.run_summary(self.scored, self.groups, self.patterns, self.stats)

    def incident(self) -> DataFrame:
        return FL.incident(self.scored, self.cfg.volumes)

    def meta(self) -> DataFrame:
        return DG.run_meta(self.scored, self.stats, self.threshold, self.cfg.threshold, self.eps)

    def digest(self, source_name: str = "") -> DataFrame:
        ranked = self.anomalies.withColumn("reason", F.array_join("reasons", "; "))
        context = self.scored.filter(~F.col("flagged")).select(F.col("message").alias("line"), F.col("entry_id").alias("rank_id"))
        return DG.rca_digest(ranked, context, source_name)


def parse_logs(lines: DataFrame, fmt: str | None = None, independent_lines: bool = False) -> DataFrame:
    """Numbered lines (``source, line_no, value``) → numbered entries.

    ``fmt`` forces a format.  ``independent_lines`` takes every line as an entry
    in the format of its source's first line: no multi-line merge, no carried
    state, and so no pass over ordered blocks.
    """
    if independent_lines:
        if fmt is None:
            lines = lookup_join(lines, L.first_line_format(lines).select("source", "format"), ["source"])
        else:
            lines = lines.withColumn("format", F.lit(fmt))
        return L.number_entries(P.parse_lines(lines))
    merged = L.merge_multiline(lines)
    if fmt is None:
        merged = L.sticky_format(merged).drop("detected", "switched")
    else:
        merged = merged.withColumn("format", F.lit(fmt))
    return L.number_entries(L.append_continuations(P.parse_lines(merged)))


def template_vectors(prepared: DataFrame, templates: DataFrame, cfg: Settings, synonyms: DataFrame | None = None) -> DataFrame:
    """Fast mode: synonyms and vocabulary from all lines, vectors of the representatives."""
    if synonyms is None and cfg.synonyms:
        synonyms = stage(SY.merged_dictionary(SY.learn_synonyms(prepared.select("message"))))
    docs = TV.with_normalized(prepared.select("message"), synonyms)
    vocabulary = stage(TV.fit_vocabulary(docs, cfg.text))
    return TV.embed_templates(templates, vocabulary, cfg.text, synonyms)


def detect(entries: DataFrame, cfg: Settings = Settings(), baseline: DataFrame | None = None,
           vectors: DataFrame | None = None, synonyms: DataFrame | None = None) -> Detection:
    """Score entries (``entry_id, ts_raw, level, service, message``, plus any columns to keep).

    ``vectors`` (``template_id, vec``) replaces the built-in template vectors.
    The entries are staged once with their derived columns; afterwards only
    narrow column sets are read: windows, templates, and the final lookup join.
    """
    taken = RESULT_COLUMNS & set(entries.columns)
    if taken:
        raise ValueError(f"rename these columns, they are results: {sorted(taken)}")
    prepared = stage(TP.prepare(entries, cfg.year))
    n = prepared.count()
    if n == 0:
        raise ValueError("no entries")
    hot = None
    if cfg.bursts.on:
        hot = stage(BU.hot_windows(BU.with_window(prepared, cfg.bursts), cfg.bursts))
    marked = BU.mark_bursts(prepared, cfg.bursts, hot)
    templates = TP.build_templates(marked, FL.head_cut(n))
    if baseline is not None:
        templates = BL.compare(templates, baseline, F.lit(n), cfg.rarity.least)
    templates = stage(FL.add_flags(templates, n, cfg.volumes, has_baseline=baseline is not None))

    if vectors is None:
        vectors = template_vectors(prepared, templates, cfg, synonyms)
    vectors = stage(vectors)
    points = vectors.join(templates.select("template_id", F.col("cnt").alias("w")), "template_id").select(
        F.col("template_id").alias("id"), "w", "vec")
    eps = cfg.radius if cfg.radius is not None else float(NB.estimate_eps(points, cfg.core).first()["eps"])
    labels = CL.dbscan(points, eps, cfg.core).select(F.col("id").alias("template_id"), "cluster")

    joined = stage(templates.join(labels, "template_id").join(vectors, "template_id"))
    stats = stage(SR.add_level_and_cluster_sizes(OU.level_outliers(joined).drop("vec")))
    scored = stage(SR.score_entries(marked, stats, cfg.rarity, cfg.bursts))
    threshold = cfg.threshold
    if cfg.from_scores:
        threshold = EV.otsu_threshold(scored).first()["threshold"] or threshold
    return Detection(SR.flag(scored, threshold), stats, n, eps, float(threshold), cfg)


def analyze(spark: SparkSession, path: str | None = None, lines: list[str] | None = None, table: str | None = None,
            df: DataFrame | None = None, fmt: str | None = None, sensitivity: str = "normal", independent_lines: bool = False,
            baseline: DataFrame | None = None, cfg: Settings | None = None, **overrides) -> Detection:
    """Read, parse and score one corpus."""
    cfg = cfg or settings(sensitivity, **overrides)
    return detect(parse_logs(read_logs(spark, path, lines, table, df), fmt, independent_lines), cfg, baseline)
