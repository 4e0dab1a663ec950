"""The thin queries over the given tables, one for each operator, and the SQL that states their results."""

from __future__ import annotations

from itertools import permutations

from . import decontaminate, embeddings, filter_audit, fingerprints, minhash, mixing, pii, quality, ranked, sentencepiece_scan, substring, suffixes, toxicity
from .common import table
from .terms import TERM


def op9_mixing(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))

def op6_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))

def op4_substring(spark, sf_dir):
    return substring.cut(table(spark, sf_dir, "documents"), length=20, texts=False)

def op8_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))

def op10_suffixes(spark, sf_dir):
    return suffixes.cut(table(spark, sf_dir, "documents"), length=400, texts=False)

def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)

def op7_toxicity(spark, sf_dir):
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)

def op5_quality(spark, sf_dir):
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)

def op3_embeddings(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)

def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"))

def op11_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)

def op12_filters(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

def op13_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)


QUERIES = {
    "op2_sentencepiece": op2_sentencepiece,
    "op3_embeddings": op3_embeddings,
    "op5_quality": op5_quality,
    "op7_toxicity": op7_toxicity,
    "op1_minhash": op1_minhash,
    "op10_suffixes": op10_suffixes,
    "op8_pii": op8_pii,
    "op4_substring": op4_substring,
    "op6_fingerprints": op6_fingerprints,
    "op9_mixing": op9_mixing,
    "op11_search": op11_search,
    "op12_filters": op12_filters,
    "op13_decontaminate": op13_decontaminate,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '{TERM}')"


def _audit_sql() -> str:
    """Masks per document, removals of all coalitions, then each order's steps; Shapley as the sum over the orders."""
    steps = ", ".join(f"('{''.join(o)}', {k + 1}, {1 << 'ABCDE'.index(f)}, {sum(1 << 'ABCDE'.index(x) for x in o[:k])})" for o in permutations("ABCDE") for k, f in enumerate(o))
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
 m AS (SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
 CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic FROM d),
 c AS (SELECT part, CAST(mask AS BIGINT) AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 v AS (SELECT part, s, coalesce(sum(n) FILTER (mask & s <> 0), 0) AS gone, coalesce(sum(good) FILTER (mask & s <> 0), 0) AS good, coalesce(sum(toxic) FILTER (mask & s <> 0), 0) AS toxic, sum(n) AS total FROM c, range(32) r(s) GROUP BY ALL),
 o(filter_order, step, own, before) AS (VALUES {steps}),
 x AS (SELECT b.part, filter_order, CAST(step AS INTEGER) AS step, own, b.total - a.gone AS kept, a.gone - b.gone AS removed, f.gone - a.gone + b.gone AS redundant, e.gone - w.gone AS unique_fails, a.good - b.good AS good_lost, a.toxic - b.toxic AS toxic_lost
 FROM o JOIN v b ON b.s = o.before JOIN v a ON a.part = b.part AND a.s = o.before + o.own JOIN v f ON f.part = b.part AND f.s = o.own JOIN v e ON e.part = b.part AND e.s = 31 JOIN v w ON w.part = b.part AND w.s = 31 - o.own)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x"""


#: Smallest node that links (a, b) reach from each node, both ways.
_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
 label AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

SQL: dict[str, str] = {
    "op1_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)), {_REACH}
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN label ON node = d.doc_id""",
    "op3_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 fit AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH}
 SELECT v.vec_id, (SELECT count(*) FROM both_ways l WHERE l.a = v.vec_id) AS n_links, coalesce(component, v.vec_id) AS component_id, coalesce(component, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN label ON node = v.vec_id""",
    "op4_substring": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS i) WHERE len(ws) >= 20),
 again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
 gone AS (SELECT DISTINCT doc_id, j FROM again, LATERAL (SELECT unnest(range(i, i + 20)) AS j)),
 per AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
 kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(js), 0) AS r, ws, js FROM w LEFT JOIN per ON per.doc_id = w.doc_id),
 left_over AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM kept) k LEFT JOIN gone USING (doc_id, j) WHERE gone.j IS NULL GROUP BY k.doc_id)
 SELECT k.doc_id, k.n AS n_words, k.r AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept k LEFT JOIN left_over l ON l.doc_id = k.doc_id""",
    "op11_search": f"""WITH dw AS (SELECT doc_id, {_TERMS} AS ws FROM documents), sizes AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS size FROM dw WHERE len(ws) > 0),
 corpus AS (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS words FROM sizes),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM dw) GROUP BY ALL),
 q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
 m AS (SELECT doc_id, 50 + (50 * size * docs) // words AS m FROM sizes, corpus),
 scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op12_filters": _audit_sql(),
    "op13_decontaminate": f"""WITH dw AS (SELECT doc_id, {_TERMS} AS ws FROM documents), bw AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
 iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s FROM bw, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i) WHERE len(ws) > 0),
 win AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s FROM dw, (SELECT DISTINCT k FROM iw), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i) WHERE len(ws) >= k),
 hits AS (SELECT doc_id, item_id, i, k FROM win JOIN iw USING (k, s)),
 covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY doc_id),
 found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
