"""Text vectors, neighbours, clustering and synonym queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.functions import fixed as X
from siftlog.functions.vectors import row_normalize
from siftlog.operators import cluster as CL, neighbors as NB, synonyms as SY, templates as TP, textvec as TV
from siftlog.operators.evaluate import cluster_separation as separation, isolation

from . import corpus as C
from . import sqltext as S
from .q_scalars import TERMS, TOKENS, WORDS
from .q_templates import prepared

Q, SQL = {}, {}
EPS = 1.14          # radius of the checks on the given vectors


def _docs(spark, sf):
    return TV.with_normalized(C.entries(spark, sf).select("entry_id", "message"))


def tfidf_vocab(spark, sf):
    return TV.fit_vocabulary(_docs(spark, sf)).select("idx", "term", "tf", "df", F.round("idf", 9).alias("idf"))


VOCAB = f""",
docs AS MATERIALIZED (SELECT entry_id, {S.normalize('message')} AS norm FROM logs),
words AS (SELECT entry_id, {WORDS.format('norm')} AS w FROM docs),
terms AS (SELECT entry_id, unnest({TERMS.format('w')}) AS term FROM words),
tc AS (SELECT entry_id, term, count(*) AS k FROM terms GROUP BY 1, 2),
voc AS (SELECT row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx, term, tf, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (
  SELECT term, CAST(sum(k) AS BIGINT) AS tf, count(*) AS df, (SELECT count(*) FROM docs) AS n FROM tc GROUP BY term HAVING count(*) >= 2) ORDER BY tf DESC, term LIMIT 256)"""
Q["tfidf_vocab"] = tfidf_vocab
SQL["tfidf_vocab"] = "WITH " + C.LOGS_DUCK + VOCAB + " SELECT CAST(idx AS INT) AS idx, term, tf, df, round(idf, 9) AS idf FROM voc"


def tfidf_vectors(spark, sf):
    docs = _docs(spark, sf)
    return TV.tfidf(docs, TV.fit_vocabulary(docs), "entry_id").select("entry_id", "term", F.round("weight", 6).alias("weight"))


Q["tfidf_vectors"] = tfidf_vectors
SQL["tfidf_vectors"] = "WITH " + C.LOGS_DUCK + VOCAB + """, x AS (SELECT tc.entry_id, tc.term, (1 + ln(k)) * idf AS r FROM tc JOIN voc ON voc.term = tc.term)
SELECT entry_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY entry_id)), 6) AS weight FROM x"""


def document_vocab(spark, sf):
    """Vocabulary of all documents, whole texts."""
    docs = C.table(spark, sf, "documents").select(F.col("text").alias("message"))
    return TV.fit_vocabulary(TV.with_normalized(docs)).select("term", "tf", "df")


Q["document_vocab"] = document_vocab
SQL["document_vocab"] = "WITH " + C.LOGS_DUCK + VOCAB.replace("SELECT entry_id, " + S.normalize("message"), "SELECT doc_id AS entry_id, " + S.normalize("text")).replace("AS norm FROM logs", "AS norm FROM documents") + " SELECT term, tf, df FROM voc"


def embed_templates(spark, sf):
    p = prepared(spark, sf)
    t = TP.build_templates(p)
    voc = TV.fit_vocabulary(TV.with_normalized(p.select("message")))
    v = TV.embed_templates(t, voc)
    return v.select("template_id", F.size("vec").cast("bigint").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


Q["embed_templates"] = embed_templates
SQL["embed_templates"] = "WITH " + C.LOGS_DUCK + f" SELECT min(entry_id) AS template_id, CAST(270 AS BIGINT) AS dims, 1.0::DOUBLE AS norm FROM (SELECT entry_id, upper(level) AS lvl, {S.template_key('message')} AS t FROM logs) GROUP BY lvl, t"


def points(spark, sf):
    """The given vectors at unit length, weighted by how often their label is even or odd."""
    e = C.table(spark, sf, "embeddings")
    v = row_normalize(F.col("embedding").cast("array<double>")).cast("array<float>")
    return e.select(F.col("vec_id").alias("id"), (1.0 + F.col("label") % 2).alias("w"), v.alias("vec"), "label")


UNIT = """u AS MATERIALIZED (SELECT vec_id AS id, 1.0::DOUBLE + label % 2 AS w, label,
  CAST(list_transform(e, lambda x: x / n) AS FLOAT[]) AS v FROM (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))),
pair AS MATERIALIZED (SELECT a.id, b.id AS other, a.w, b.w AS ow, sqrt(greatest(0, list_dot_product(CAST(a.v AS DOUBLE[]), CAST(a.v AS DOUBLE[])) + list_dot_product(CAST(b.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))
  - 2 * list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])))) AS dist FROM u a, u b)"""


def group_vectors(spark, sf):
    g = TV.group_vectors(points(spark, sf), ["label"])
    return g.select("label", F.round(F.get("vec", F.lit(0)), 5).alias("x0"), F.round(F.get("vec", F.lit(63)), 5).alias("x63"))


Q["group_vectors"] = group_vectors
SQL["group_vectors"] = "WITH " + UNIT.split("pair AS")[0].rstrip().rstrip(",") + """, m AS (SELECT label, i, avg(v[i]::DOUBLE) AS a FROM u, range(1, 65) r(i) GROUP BY label, i)
SELECT label, round(max(CASE WHEN i = 1 THEN a END) / sqrt(sum(a * a)), 5) AS x0, round(max(CASE WHEN i = 64 THEN a END) / sqrt(sum(a * a)), 5) AS x63 FROM m GROUP BY label"""


def eps_neighbors(spark, sf):
    return NB.eps_neighbors(points(spark, sf), EPS, tile_rows=128).select("id", "other", F.round("dist", 5).alias("dist"))


Q["eps_neighbors"] = eps_neighbors
SQL["eps_neighbors"] = f"WITH {UNIT} SELECT id, other, round(dist, 5) AS dist FROM pair WHERE id < other AND dist <= {EPS}"


def knn_distance(spark, sf):
    return NB.kth_distance(points(spark, sf), 4, block=128).select("id", F.round("dist", 5).alias("dist"))


KNN = ", kd AS (SELECT id, list_sort(list(dist))[4] AS dist FROM pair WHERE id <> other GROUP BY id)"
Q["knn_distance"] = knn_distance
SQL["knn_distance"] = f"WITH {UNIT}{KNN} SELECT id, round(dist, 5) AS dist FROM kd"


def estimate_eps(spark, sf):
    return NB.estimate_eps(points(spark, sf), 4, hi=2.0).select("n", F.round("eps", 5).alias("eps"))


Q["estimate_eps"] = estimate_eps
SQL["estimate_eps"] = f"""WITH {UNIT}{KNN}, r AS (SELECT dist, (row_number() OVER (ORDER BY dist, id) - 1) / (count(*) OVER () - 1)::DOUBLE AS x, min(dist) OVER () AS y0, max(dist) OVER () AS y1,
  row_number() OVER (ORDER BY dist, id) AS i FROM kd), c AS (SELECT dist, i, round(abs((y1 - y0) * x - dist + y0) / sqrt(1 + (y1 - y0) * (y1 - y0)), 12) AS d FROM r)
SELECT (SELECT count(*) FROM u) AS n, round(least(greatest((SELECT dist FROM c ORDER BY d DESC, i LIMIT 1), 0.15), 2.0), 5) AS eps"""


def dbscan_templates(spark, sf):
    return CL.dbscan(points(spark, sf), EPS, 4, tile_rows=128)


Q["dbscan_templates"] = dbscan_templates
SQL["dbscan_templates"] = f"""WITH RECURSIVE {UNIT}, ball AS (SELECT id, sum(ow) AS s FROM pair WHERE dist <= {EPS} GROUP BY id),
core AS (SELECT id FROM ball WHERE s >= 4), edge AS MATERIALIZED (SELECT p.id, p.other FROM pair p JOIN core a ON a.id = p.id JOIN core b ON b.id = p.other WHERE p.dist <= {EPS}),
reach AS (SELECT id, id AS root FROM core UNION SELECT e.other, r.root FROM reach r JOIN edge e ON e.id = r.id WHERE r.root < e.other),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id),
border AS (SELECT p.id, min(c.c) AS c FROM pair p JOIN comp c ON c.id = p.other WHERE p.dist <= {EPS} AND p.id NOT IN (SELECT id FROM core) GROUP BY p.id)
SELECT u.id, coalesce(c.c, b.c, -1) AS cluster, c.c IS NOT NULL AS core FROM u LEFT JOIN comp c ON c.id = u.id LEFT JOIN border b ON b.id = u.id"""


def cluster_separation(spark, sf):
    r = separation(points(spark, sf))
    return r.select("intra_count", "inter_count", *[F.round(c, 6).alias(c) for c in ("intra_mean", "inter_mean", "separation")])


Q["cluster_separation"] = cluster_separation
SQL["cluster_separation"] = f"""WITH {UNIT}, c AS (SELECT a.label = b.label AS same, list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))
  / sqrt(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(a.v AS DOUBLE[])) * list_dot_product(CAST(b.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))) AS s FROM u a JOIN u b ON a.id < b.id)
SELECT count_if(same) AS intra_count, count_if(NOT same) AS inter_count, round(avg(s) FILTER (same), 6) AS intra_mean, round(avg(s) FILTER (NOT same), 6) AS inter_mean,
  round(avg(s) FILTER (same) - avg(s) FILTER (NOT same), 6) AS separation FROM c"""


def anomaly_isolation(spark, sf):
    return isolation(points(spark, sf), F.col("label") == 9).select(F.round("isolation", 6).alias("isolation"))


Q["anomaly_isolation"] = anomaly_isolation
SQL["anomaly_isolation"] = "WITH " + UNIT.split("pair AS")[0].rstrip().rstrip(",") + """, x AS (SELECT label, i, v[i]::DOUBLE AS x FROM u, range(1, 65) r(i)),
c AS (SELECT i, avg(c) AS c FROM (SELECT label, i, avg(x) AS c FROM x WHERE label <> 9 GROUP BY label, i) GROUP BY i), a AS (SELECT i, avg(x) AS a FROM x WHERE label = 9 GROUP BY i)
SELECT round(1 - sum(a * c), 6) AS isolation FROM a JOIN c ON a.i = c.i"""

# --- synonyms --------------------------------------------------------------


def word_cooccurrence(spark, sf):
    return SY.word_cooccurrence(SY.token_sequences(C.entries(spark, sf)))


TOK = f"tok AS MATERIALIZED (SELECT entry_id, {TOKENS.format('message')} AS t FROM src)"
COOC = TOK + """,
wat AS MATERIALIZED (SELECT entry_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM tok),
cooc AS MATERIALIZED (SELECT a.word, b.word AS other, count(*) AS cnt FROM wat a JOIN wat b ON a.entry_id = b.entry_id AND abs(a.i - b.i) <= 3 AND a.word <> b.word GROUP BY 1, 2)"""
Q["word_cooccurrence"] = word_cooccurrence
SQL["word_cooccurrence"] = f"WITH {C.LOGS_DUCK}, src AS (SELECT entry_id, message FROM logs), {COOC} SELECT word, other, cnt FROM cooc"


def _abbreviated(spark, sf):
    """Event messages in which a third of the lines abbreviate some words."""
    e = C.logs(spark, sf)
    m = F.col("message")
    for long, short in (("upstream", "upstrm"), ("connection", "conctn"), ("payment", "paymnt"), ("available", "avlbl")):
        m = F.when(F.col("user_id") % 3 == 1, F.replace(m, F.lit(long), F.lit(short))).otherwise(m)
    return e.select("entry_id", m.alias("message"))


_abbr = "message"
for _l, _s in (("upstream", "upstrm"), ("connection", "conctn"), ("payment", "paymnt"), ("available", "avlbl")):
    _abbr = f"replace({_abbr}, '{_l}', '{_s}')"


def learn_synonyms(spark, sf):
    return SY.learn_synonyms(_abbreviated(spark, sf), threshold=0.5).select("word", "replacement", F.round("similarity", 9).alias("similarity"))


_skip = ", ".join(S.lit(w) for w in [*X.BASE_SYNONYMS, *X.STOPWORDS])
Q["learn_synonyms"] = learn_synonyms
SQL["learn_synonyms"] = f"""WITH {C.LOGS_DUCK}, src AS (SELECT entry_id, CASE WHEN user_id % 3 = 1 THEN {_abbr} ELSE message END AS message FROM logs), {COOC},
freq AS (SELECT word, count(*) AS f FROM wat GROUP BY word), mc AS (SELECT greatest(2, count(*) // 500) AS m FROM src),
total AS (SELECT word, sum(cnt) AS t FROM cooc GROUP BY word),
shared AS MATERIALIZED (SELECT a.word AS rare, b.word AS common, sum(least(a.cnt, b.cnt)) AS s FROM cooc a JOIN cooc b ON a.other = b.other AND length(b.word) > length(a.word) GROUP BY 1, 2),
cand AS (SELECT s.*, s / t::DOUBLE AS sim FROM shared s JOIN freq r ON r.word = rare JOIN freq c ON c.word = common JOIN total ON total.word = rare
  WHERE c.f >= r.f AND rare NOT IN ({_skip}) AND s >= (SELECT m FROM mc)
  AND len(list_intersect(list_distinct(string_split(rare, '')), list_distinct(string_split(common, '')))) / len(list_distinct(string_split(rare, '')))::DOUBLE >= 0.6)
SELECT rare AS word, arg_min(common, (-sim, common)) AS replacement, round(max(sim), 9) AS similarity FROM cand WHERE sim >= 0.5 GROUP BY rare"""


def synonym_dictionary(spark, sf):
    """Base dictionary with the learned words over it, through save and load."""
    import uuid

    from siftlog.runtime import staging_root
    from siftlog.sources.sinks import load_synonyms, save_synonyms

    messages = _abbreviated(spark, sf)
    path = f"{staging_root(spark)}/{spark.sparkContext.applicationId}/synonyms-{uuid.uuid4().hex}"
    save_synonyms(SY.learn_synonyms(messages, threshold=0.5), messages, path)
    return SY.merged_dictionary(load_synonyms(messages, path)).select("word", "replacement")


Q["synonym_dictionary"] = synonym_dictionary
_base = ", ".join(f"({S.lit(k)}, {S.lit(v)})" for k, v in X.BASE_SYNONYMS.items())
SQL["synonym_dictionary"] = SQL["learn_synonyms"].replace("SELECT rare AS word, arg_min", ", lrn AS (SELECT rare AS word, arg_min", 1) + f""")
SELECT word, replacement FROM lrn UNION ALL SELECT b.w, b.r FROM (VALUES {_base}) b(w, r) WHERE b.w NOT IN (SELECT word FROM lrn)"""
