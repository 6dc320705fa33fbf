"""DuckDB SQL of the operators that SQL can express."""

_TABLE = ("SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
          "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t")


def _crc(byte_list: str) -> str:
    """crc32 of a list of bytes, with the table of ``_TABLE`` as column ``t``."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte_list}), lambda c, b: xor(c // 256, t[xor(c & 255, b) + 1])))"


def _frame(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(number: str) -> str:
    return "sha256(" + " || ".join(_frame(c) for c in ("doc_id", "source", "lang", number, "text")) + ")"


def _levels(name: str, first: str) -> str:
    return f"""{name}(tree, level, idx, n, digest) AS (
  {first}
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 2, n)"""


def _fold(name: str, first: str, nodes: str) -> str:
    return f"""{name}(rid, tree, level, idx, n, digest, beside) AS (
  {first}
  UNION ALL
  SELECT f.rid, f.tree, f.level + 1, f.idx // 2, (f.n + 1) // 2,
    sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN f.idx % 2 = 1 THEN s.digest || f.digest ELSE f.digest || s.digest END), f.beside || coalesce(s.digest, '')
  FROM {name} f LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1)"""


MERKLE = f"""
WITH RECURSIVE crc AS ({_TABLE}),
hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {_crc("list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i]))")} % 7 = 0
      THEN {_leaf("n_chars + 1")} END AS other
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM hashed),
{_levels("low", "SELECT tree, 0, pos, n, leaf FROM placed")},
{_levels("high", "SELECT -1, 0, tree, count(*) OVER (), digest FROM low WHERE n = 1")},
{_fold("inner_path", "SELECT rid, tree, 0, pos, n, coalesce(other, leaf), '' FROM placed", "low")},
{_fold("outer_path", "SELECT rid, -1, 0, tree, (SELECT count(*) FROM high WHERE level = 0), digest, beside FROM inner_path WHERE n = 1", "high")}
SELECT p.doc_id, p.leaf, l.digest AS subroot, r.digest AS root, sha256(o.beside) AS proof_sha256, o.digest AS folded_root,
  o.digest = r.digest AS verified, p.other IS NOT NULL AS tampered
FROM placed p JOIN outer_path o ON o.rid = p.rid AND o.n = 1 JOIN low l ON l.tree = p.tree AND l.n = 1, (SELECT digest FROM high WHERE n = 1) r
"""

_BYTES = ("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), "
          "lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))")

SPELLING = f"""
WITH RECURSIVE crc AS ({_TABLE}),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, {_crc(_BYTES)} AS h FROM counted, crc),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
replaced AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
lost AS (SELECT DISTINCT c.word AS x, v.word AS y, c.n AS k, v.n AS m FROM cuts c JOIN vocab v ON v.word = c.rest),
near AS (SELECT x, y, m FROM replaced UNION SELECT x, y, m FROM lost UNION SELECT y, x, k FROM lost),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY m DESC, y) AS form, max(m) AS form_n FROM near GROUP BY x),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 5 * v.n THEN b.form END AS form, CASE WHEN b.form_n >= 5 * v.n THEN b.form_n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.x = v.word),
chain(word, last) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.last AS root FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""
