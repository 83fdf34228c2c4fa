"""The registered queries of the corpus operators and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, jaccard_join, license_scan, line_dedup, merkle, packing, periodic, quality, secret_scan, sharding, token_files, topk
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["kind"] != "novel")
    counts = [secret_scan.count_of(F.col("findings"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(F.encode(secret_scan.joined(base), "utf-8"), 256).alias("base_sha256"), secret_scan.joined(F.col("findings")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "line_stats.n_lines", "line_stats.n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.documents(*token_files.write(table(spark, sf_dir, "documents")), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), change=periodic.plant)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_topk, op4_quality, op5_html_extract, op6_decontaminate, op7_license_scan, op8_packing, op9_sharding, op10_jaccard_join, op11_merkle, op12_token_files, op13_periodic)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, ls[i] AS line, i,
             translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
      FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, (c.k IS NOT NULL AND l.doc_id <> c.keeper) AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n_shingles FROM g),
t AS (SELECT doc_id, hash(x) AS h1, md5_number_lower(x) AS h2 FROM (SELECT doc_id, unnest(s) AS x FROM g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.h1 = b.h1 AND a.h2 = b.h2 AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n_shingles, k.component_id FROM n JOIN k ON k.a = n.doc_id
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _grams_sql(words: str) -> str:
    return f"list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i+4], ' '))"


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

#: Every window of every class against every template, without bands: what exact containment finds.
OP7_SQL = f"""
WITH tpl(license, t) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in license_scan.TEMPLATES.items())}),
tw AS (SELECT license, {_WORDS.format("t")} AS w FROM tpl),
tg AS (SELECT license, len(w) AS n_words, unnest(list_distinct({_grams_sql("w")})) AS g FROM tw),
ts AS (SELECT license, count(*) AS size FROM tg GROUP BY license),
cls(win, stride, top) AS (VALUES {", ".join(f"({w}, {s}, {t})" for w, s, t in license_scan.lengths(license_scan.TEMPLATES))}),
own AS (SELECT license, n_words, min(win) AS win FROM (SELECT DISTINCT license, n_words FROM tg) JOIN cls ON top >= n_words GROUP BY ALL),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
dg AS (SELECT r, doc_id, unnest({_grams_sql("w")}) AS g, unnest(range(0, greatest(len(w) - 4, 0))) AS p FROM dw),
hit AS (SELECT * FROM dg JOIN tg USING (g) JOIN own USING (license, n_words) JOIN cls USING (win)),
win AS (SELECT r, doc_id, license, n_words, g, p, win, unnest(list_filter(range(0, p + 1, stride), lambda a: a + win - 4 > p)) AS a FROM hit),
cnt AS (SELECT r, doc_id, license, n_words, win, a, count(DISTINCT g) AS c, min(p) AS first FROM win GROUP BY ALL),
ok AS (SELECT cnt.*, c / size AS containment FROM cnt JOIN ts USING (license) WHERE c / size >= {license_scan.CONTAINMENT})
SELECT doc_id, license, max(containment) AS containment, CAST(arg_min(first, struct_pack(x := -containment, y := first)) AS INTEGER) AS first_word, any_value(n_words) AS n_words
FROM ok GROUP BY r, doc_id, license
"""


def _digest_sql(*fields: str) -> str:
    each = (f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields)
    return f"sha256({' || '.join(each)})"


def _tree_sql(name: str, leaves: str) -> str:
    """Two tables, name (grp, level, i, n, h) with all nodes of the trees over leaves (grp, i, n, h), and name_run (grp, level, run, hs) with the nodes of each run."""
    return f"""{name}(grp, level, i, n, h) AS (SELECT grp, 0, i, n, h FROM {leaves} UNION ALL
  SELECT grp, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY grp, level, n, i // 3),
{name}_run AS (SELECT grp, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _climb_sql(name: str, tree: str, start: str) -> str:
    """name (id, i, level, proof, h) goes up a tree from start (id, grp, i, proof, h): a level a step, to where no run is left."""
    own = "CAST(c.i % 3 AS INTEGER)"
    return f"""{name}(id, grp, i, level, proof, h) AS (SELECT id, grp, i, 0, proof, h FROM {start} UNION ALL
  SELECT c.id, c.grp, c.i // 3, c.level + 1, c.proof || array_to_string(r.hs[:{own}], '') || array_to_string(r.hs[{own} + 2:], ''),
         sha256(array_to_string(r.hs[:{own}], '') || c.h || array_to_string(r.hs[{own} + 2:], ''))
  FROM {name} c JOIN {tree}_run r ON r.grp = c.grp AND r.level = c.level AND r.run = c.i // 3)"""


#: crc32 by its table of 256 remainders, which is made here.
OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS UBIGINT), list_transform(range(8), lambda k: CAST(0 AS UBIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS id, doc_id, source, {_digest_sql("doc_id", "source", "lang", "n_chars", "text")} AS h, {_digest_sql("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} AS h2,
      xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, c: xor(a >> 8, t[CAST(xor(a, c) & 255 AS INTEGER) + 1]))) AS crc32 FROM documents, crc),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
{_tree_sql("a", "l")},
s AS (SELECT 0 AS grp, grp AS i, count(*) OVER () AS n, h FROM a WHERE n = 1),
{_tree_sql("b", "s")},
g AS (SELECT id, grp, i, '' AS proof, CASE WHEN crc32 % 2 = 0 THEN h2 ELSE h END AS h FROM l),
{_climb_sql("u", "a", "g")},
w AS (SELECT id, 0 AS grp, grp AS i, proof, h FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
{_climb_sql("v", "b", "w")},
z AS (SELECT id, proof, h FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(z.proof) AS proof_sha256, z.h AS folded_root, z.h = r.h AS verified
FROM l JOIN z ON z.id = l.id JOIN s ON s.i = l.grp, (SELECT h FROM b WHERE n = 1) r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_topk": OP3_SQL, "op7_license_scan": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op11_merkle": OP11_SQL}
