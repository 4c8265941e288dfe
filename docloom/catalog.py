"""The registered queries and their DuckDB counterparts, each over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import adapters, chunk, encoders, evaluate, grounding, inverted, registry, rerank, search, structure, validate, vector_index
from docloom.session import table
from docloom.sources import io, lookup, pdf, snapshots, store, stored
from docloom.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- vectors and search
E_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS nv FROM e),
s AS (SELECT q.vec_id AS qid, c.vec_id AS cid, c.label, round(list_inner_product(q.v, c.v) / (q.nv * c.nv), 6) + 0 AS score
      FROM n q, n c WHERE q.vec_id % 50 = 0)"""


def _top_sql(name: str, where: str, k: int) -> str:
    return f", {name} AS (SELECT * FROM (SELECT qid, cid, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rk FROM s WHERE {where}) WHERE rk <= {k})"


def _fused_sql(*names: str) -> str:
    rows = " UNION ALL ".join(f"SELECT qid, cid, 1.0 / (rk + 1) AS part FROM {n}" for n in names)
    return f", f AS (SELECT qid, cid, round(sum(CAST(part AS DOUBLE)), 6) AS score FROM ({rows}) GROUP BY qid, cid), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rk FROM f)"


def _vectors(spark, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v"), "label")


@query(E_SQL + _top_sql("t", "true", 30) + " SELECT qid, cid, score, rk FROM t")
def knn_topk_cosine(spark, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return search.knn(q, c)


@query(E_SQL + _top_sql("t", "true", 30) + " SELECT qid, cid, score, rk FROM t")
def knn_indexed(spark, d: str) -> DataFrame:
    """The same hits through a stored index: cells whose bound is under a query's k-th score are not read."""
    q, c = _vectors(spark, d)
    dim = c.agg(F.max(F.size("v"))).first()[0]
    return vector_index.search(q, vector_index.build(c, dim), dim, search.DENSE_K)[0]


@query(E_SQL + _top_sql("t", "label % 2 = 0", 30) + " SELECT qid, cid, score, rk FROM t")
def knn_filtered_topk(spark, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return search.knn(q, c.where("label % 2 = 0"))


@query(E_SQL + _top_sql("a", "label % 2 = 0", 30) + _top_sql("b", "label % 3 = 0", 30) + _fused_sql("a", "b") + " SELECT qid, cid, score, rk FROM o WHERE rk <= 30")
def rrf_fuse_two_branches(spark, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    even, third = F.col("label") % 2 == 0, F.col("label") % 3 == 0
    return search.fuse([search.knn_branches(q, c, [(even, search.DENSE_K), (third, search.DENSE_K)])])


@query(E_SQL + _top_sql("a", "true", 30) + _top_sql("b", "label % 2 = 0", 5) + _top_sql("c", "label % 3 = 0", 5) + _fused_sql("a", "b", "c") + " SELECT qid, cid, score, rk FROM o WHERE rk <= 30")
def rrf_asymmetric_budgets(spark, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    branches = [(F.lit(True), search.DENSE_K), (F.col("label") % 2 == 0, search.SPARSE_K), (F.col("label") % 3 == 0, search.REWRITE_K)]
    return search.fuse([search.knn_branches(q, c, branches)])


def _candidates(spark, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    hits = search.knn(q, c)
    return hits.join(c.select("cid", F.col("label").alias("doc")), "cid").select("qid", "cid", "doc", "score", F.col("rk").alias("pos"))


@query(E_SQL + _top_sql("t", "true", 30) + ", m AS (SELECT *, max(score) OVER (PARTITION BY qid) * 0.10 AS cut FROM t) SELECT qid, cid, score, rk AS pos FROM m WHERE score >= cut")
def rerank_tail_cut(spark, d: str) -> DataFrame:
    return rerank.tail_cut(_candidates(spark, d)).select("qid", "cid", "score", "pos")


@query(E_SQL + _top_sql("t", "true", 30) + """
, a AS (SELECT qid, cid, label AS doc, score, rk AS pos, max(score) OVER (PARTITION BY qid) * 0.5 AS cut, count(DISTINCT label) OVER (PARTITION BY qid) AS nd FROM t)
, b AS (SELECT *, score >= cut AS ok FROM a)
, b2 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc, ok ORDER BY score DESC, pos) AS rd FROM b)
, c AS (SELECT *, ok AND (nd < 2 OR rd <= 2) AS elig FROM b2)
, g AS (SELECT *, elig AND row_number() OVER (PARTITION BY qid, elig ORDER BY score DESC, pos) <= 5 AS p1 FROM c)
, h AS (SELECT *, count(*) FILTER (p1) OVER (PARTITION BY qid) AS n1, bool_or(p1) OVER (PARTITION BY qid, doc) AS taken,
               row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, pos) AS rdoc FROM g)
, i AS (SELECT *, nd > 1 AND NOT taken AND rdoc = 1 AS cand FROM h)
, j AS (SELECT *, cand AND row_number() OVER (PARTITION BY qid, cand ORDER BY score DESC, pos) <= 5 - n1 AS p2 FROM i)
SELECT qid, cid, doc, score, pos, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p1 DESC, pos) AS rk FROM j WHERE p1 OR p2""")
def rerank_diversity_select(spark, d: str) -> DataFrame:
    return rerank.select_diverse(_candidates(spark, d), k=5, cap=2, ratio=0.5)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM e) SELECT vec_id, i - 1 AS p, round(v[i] / sqrt(list_inner_product(v, v)), 6) + 0 AS x FROM x""")
def vector_l2_normalise(spark, d: str) -> DataFrame:
    normed = table(spark, d, "embeddings").withColumn("n", V.norm(F.col("embedding")))
    unit = normed.select("vec_id", F.posexplode(V.l2_normalise(F.col("embedding"), F.col("n"))).alias("p", "x"))
    return unit.select("vec_id", F.col("p").cast("long").alias("p"), (F.round("x", 6) + 0.0).alias("x"))


CENTROID_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT label, v[i] AS x, i FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e)),
m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i),
g AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
u AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM g)"""


@query(CENTROID_SQL + " SELECT label, unnest(range(0, len(c))) AS p, round(unnest(c), 6) + 0 AS x FROM u")
def class_centroids(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("embedding").alias("v"))
    return evaluate.centroids(e, "label").select("label", F.posexplode("c").alias("p", "x")).select("label", F.col("p").cast("long").alias("p"), (F.round("x", 6) + 0.0).alias("x"))


ROUTE_SQL = CENTROID_SQL + """
, s AS (SELECT vec_id, u.label AS intent, round(list_inner_product(v, c) / sqrt(list_inner_product(v, v)), 6) + 0 AS sim FROM e, u)
, o AS (SELECT vec_id, max(sim) AS best, arg_min(intent, {'a': -sim, 'b': intent}) AS name FROM s WHERE intent <> 0 GROUP BY vec_id)
, z AS (SELECT vec_id, sim AS base FROM s WHERE intent = 0)
, r AS (SELECT vec_id AS id, CASE WHEN round(best - base, 6) < 0.05 THEN 0 ELSE name END AS intent, round(best - base, 6) + 0 AS margin_ FROM o JOIN z USING (vec_id))"""


@query(ROUTE_SQL + " SELECT id, intent, margin_ FROM r")
def nearest_centroid_route(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = evaluate.centroids(e.select("label", F.col("embedding").alias("v")), "label").select(F.col("label").alias("intent"), "c")
    return evaluate.classify_by_centroid(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), c, 0).withColumn("margin_", F.col("margin_") + 0.0)


@query(ROUTE_SQL + """ SELECT count(*) AS rows, count(*) FILTER (label = intent) AS exact, count(*) FILTER ((label = 0) = (intent = 0)) AS routed, count(*) FILTER (label = 0 AND intent <> 0) AS dangerous, count(*) FILTER (label <> 0 AND intent = 0) AS costly,
 count(*) FILTER (label <> intent AND label <> 0 AND intent <> 0) AS cosmetic, min(margin_) FILTER (label <> 0) AS other_min, max(margin_) FILTER (label <> 0) AS other_max, min(margin_) FILTER (label = 0) AS default_min, max(margin_) FILTER (label = 0) AS default_max
 FROM r JOIN embeddings ON vec_id = id""")
def intent_report(spark, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("expected"))
    return evaluate.intent_report(nearest_centroid_route(spark, d).join(own, "id").select("expected", F.col("intent").alias("got"), F.col("margin_").alias("margin")), 0)


# ---------------------------------------------------------------- text
@query("""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(160), ' '), chr(173), '') AS clean FROM documents""")
def clean_ligatures(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalise_unicode(F.coalesce("text", F.lit(""))).alias("clean"))


@query(r"""SELECT doc_id, regexp_replace(replace(coalesce(text, ''), ' of ', '-' || chr(10)), '([A-Za-z]+)-\n([a-z]+)', '\1-\2', 'g') AS clean FROM documents""")
def clean_hyphen_join(spark, d: str) -> DataFrame:
    broken = F.replace(F.coalesce("text", F.lit("")), F.lit(" of "), F.lit("-\n"))
    return table(spark, d, "documents").select("doc_id", T.join_hyphenated(broken).alias("clean"))


@query(r"""
WITH p AS (SELECT doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10) || '12' || chr(10) || chr(10) || '--- PAGE 3 ---' || chr(10)) || chr(10) || '99' AS t FROM documents),
q AS (SELECT doc_id, regexp_replace(t, '\n[ \t]*[0-9]+[ \t]*\n+(--- PAGE [0-9]+ ---)', chr(10) || '\1', 'g') AS t FROM p),
r AS (SELECT doc_id, regexp_replace(t, '\n[ \t]*[0-9]+[ \t]*\n*$', chr(10)) AS t FROM q)
SELECT doc_id, regexp_replace(t, '\n---[ \t]*PAGE[ \t]*[0-9]+[ \t]*---\n', chr(10), 'g') AS clean FROM r""")
def clean_page_footers(spark, d: str) -> DataFrame:
    paged = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n12\n\n--- PAGE 3 ---\n")), F.lit("\n99"))
    return table(spark, d, "documents").select("doc_id", T.remove_page_markers(T.remove_footer_numbers(paged)).alias("clean"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
s AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM l),
n AS (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM s WHERE l <> ''),
k AS (SELECT * FROM n WHERE prev IS NULL OR prev <> l),
b AS (SELECT k.*, lag(k.pos) OVER (PARTITION BY k.doc_id ORDER BY k.pos) AS pp FROM k),
c AS (SELECT doc_id, pos, sum(CASE WHEN l = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS blanks FROM s),
g AS (SELECT b.doc_id, b.pos, b.l, b.pp, c1.blanks - coalesce(c0.blanks, 0) AS between_ FROM b JOIN c c1 ON b.doc_id = c1.doc_id AND b.pos = c1.pos LEFT JOIN c c0 ON b.doc_id = c0.doc_id AND b.pp = c0.pos),
o AS (SELECT doc_id, string_agg(CASE WHEN pp IS NULL THEN '' WHEN between_ > 0 THEN chr(10) || chr(10) ELSE chr(10) END || l, '' ORDER BY pos) AS clean FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.clean, '') AS clean FROM documents d LEFT JOIN o USING (doc_id)""")
def normalise_lines(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalise_lines(F.coalesce("text", F.lit(""))).alias("clean"))


@query(r"""
SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' ELSE concat_ws(',',
  CASE WHEN regexp_matches(text, '--- PAGE [0-9]+ ---') THEN 'page markers' END, CASE WHEN regexp_matches(text, '(?m)^Contents$') THEN 'heading of the contents' END,
  CASE WHEN contains(text, 'Legislation as at') THEN 'imprint of the publisher' END, CASE WHEN regexp_matches(text, '(?m)\.{5,}\s+[0-9]+\s*$') THEN 'dots before page numbers' END,
  CASE WHEN contains(text, 'ﬁ') THEN 'fi ligature' END, CASE WHEN contains(text, 'ﬂ') THEN 'fl ligature' END, CASE WHEN contains(text, 'ﬀ') THEN 'ff ligature' END,
  CASE WHEN contains(text, 'ﬃ') THEN 'ffi ligature' END, CASE WHEN contains(text, 'ﬄ') THEN 'ffl ligature' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0B-\x1F]') THEN 'control characters' END, CASE WHEN regexp_matches(text, '\n\s*\n\s*\n') THEN 'blank lines' END) END AS errors
FROM documents""")
def text_quality_errors(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(chunk.text_errors(F.coalesce("text", F.lit(""))), ",").alias("errors"))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_texts(spark, d: str) -> DataFrame:
    return chunk.duplicates(table(spark, d, "documents").select(F.md5("text").alias("digest")), "digest")


def _units(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.lit("2024").alias("version"), F.col("source").alias("title"), F.col("lang").alias("language"),
        F.array(F.lit("Part 1"), F.concat(F.lit("Section "), F.col("doc_id").cast("string"))).alias("path"), "text")


CHUNK_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d WHERE length(t) > 4000),
f AS (
  SELECT doc_id, i, x, CASE WHEN length(x) > 4000 THEN 0 ELSE length(x) + 1 END AS size, CAST(1 AS BIGINT) AS grp, length(x) > 4000 AS hard FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.x,
    CASE WHEN length(l.x) > 4000 THEN 0 WHEN f.hard OR (f.size > 0 AND f.size + length(l.x) + 1 > 4000) THEN length(l.x) + 1 ELSE f.size + length(l.x) + 1 END,
    CASE WHEN length(l.x) > 4000 OR f.hard OR (f.size > 0 AND f.size + length(l.x) + 1 > 4000) THEN f.grp + 1 ELSE f.grp END, length(l.x) > 4000
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
g AS (SELECT doc_id, grp, bool_or(hard) AS hard, string_agg(x, chr(10) ORDER BY i) AS body FROM f GROUP BY doc_id, grp),
h AS (SELECT doc_id, grp, unnest(range(0, length(body), 4000)) AS o, body FROM g WHERE hard),
a AS (SELECT doc_id, grp, 0 AS o, body AS content FROM g WHERE NOT hard UNION ALL SELECT doc_id, grp, o, substr(body, o + 1, 4000) FROM h UNION ALL SELECT doc_id, 1, 0, t FROM d WHERE length(t) <= 4000),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, o) AS part, count(*) OVER (PARTITION BY doc_id) AS part_count FROM a WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
c AS (SELECT 'doc-' || doc_id AS document_id, CASE WHEN part_count > 1 THEN 'doc-' || doc_id || '@v2024-part-1-section-' || doc_id || '-part-' || part ELSE 'doc-' || doc_id || '@v2024-part-1-section-' || doc_id END AS chunk_id, CAST(part AS BIGINT) AS part, CAST(part_count AS BIGINT) AS part_count, content FROM b)"""


@query(CHUNK_SQL + " SELECT document_id, chunk_id, part, part_count, content FROM c")
def chunk_documents(spark, d: str) -> DataFrame:
    return chunk.build_chunks(_units(spark, d)).select("document_id", "chunk_id", F.col("part").cast("long").alias("part"), F.col("part_count").cast("long").alias("part_count"), "content")


@query(CHUNK_SQL + " SELECT document_id, count(*) AS chunks, count(*) FILTER (part_count > 1) AS split_chunks, CAST(max(length(content)) AS BIGINT) AS longest FROM c GROUP BY document_id")
def chunk_stats(spark, d: str) -> DataFrame:
    return chunk.chunk_stats(chunk.build_chunks(_units(spark, d))).withColumn("longest", F.col("longest").cast("long"))


@query(CHUNK_SQL + """ SELECT unnest(['rows', 'duplicate_ids', 'colliding_points', 'missing_fields', 'empty_content', 'over_limit', 'no_path']) AS "check",
 unnest([CAST(count(*) = 0 AS BIGINT), count(*) - count(DISTINCT chunk_id), count(DISTINCT chunk_id) - count(DISTINCT sha1(chunk_id)), count(*) FILTER (d.source IS NULL OR d.lang IS NULL OR d.doc_id % 10 = 0),
  count(*) FILTER (trim(content, ' ' || chr(9) || chr(10) || chr(13)) = ''), count(*) FILTER (length(content) > 4000), count(*) FILTER (d.doc_id IS NULL)]) AS bad FROM c LEFT JOIN documents d ON document_id = 'doc-' || d.doc_id""")
def chunk_constraints(spark, d: str) -> DataFrame:
    """All required fields; every tenth document names no source, which is found."""
    n = F.regexp_extract("document_id", "[0-9]+", 0).cast("long")
    full = chunk.build_chunks(_units(spark, d)).withColumns({
        "document_type": F.lit("act"), "jurisdiction": F.lit("x"), "effective_from": F.lit("2024-01-01"), "effective_to": F.lit(None).cast("string"), "in_force": F.lit(True), "as_at": F.lit("2024-06-01"),
        "unit_type": F.lit("section"), "source_name": F.when(n % 10 != 0, F.col("title"))})
    return chunk.chunk_errors(full)


UUID_SQL = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query(f"""
WITH a AS (SELECT sha1(unhex('{T.URL_NAMESPACE}') || encode('{T.POINT_NAMESPACE_NAME}')) AS h), n AS (SELECT replace({UUID_SQL}, '-', '') AS ns FROM a),
b AS (SELECT doc_id, sha1(unhex((SELECT ns FROM n)) || encode('doc-' || doc_id || '@v2024')) AS h FROM documents)
SELECT doc_id, {UUID_SQL} AS point_id FROM b""")
def point_ids_uuid5(spark, d: str) -> DataFrame:
    key = T.version_slug(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.lit("2024"))
    return table(spark, d, "documents").select("doc_id", T.point_id(key).alias("point_id"))


@query("""
WITH x AS (SELECT doc_id, coalesce(source, '') AS cited, coalesce(CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang END, '') AS title, coalesce(text, '') AS body FROM documents),
h AS (SELECT *, CASE WHEN title = '' OR (cited <> '' AND contains(lower(cited), lower(title))) THEN cited WHEN cited = '' THEN title ELSE cited || ': ' || title END AS head FROM x)
SELECT doc_id, head, md5('Corpus' || CASE WHEN head <> '' THEN chr(10) || head ELSE '' END || chr(10) || chr(10) || body) AS digest FROM h""")
def contextual_heading(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    head = T.heading(F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.col("lang")), F.col("source"))
    return docs.select("doc_id", head.alias("head"), F.md5(T.contextual_text(F.lit("Corpus"), head, F.coalesce("text", F.lit("")))).alias("digest"))


@query(r"""
WITH u AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \t\r\n\x0B\f]+', ' ', 'g'), ' .!?,;:') AS x FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN x IN ('hi', 'hey', 'hello', 'morning', 'good morning', 'good afternoon', 'good evening') THEN 'greeting'
 WHEN x IN ('who are you', 'what are you', 'what is your name', 'what can you do') THEN 'identity' WHEN x IN ('thanks', 'thank you') THEN 'gratitude'
 WHEN regexp_full_match(x, '(hello+|hey+|hi+|thanks? (a lot|so much|very much))') THEN CASE WHEN starts_with(x, 'thank') THEN 'gratitude' ELSE 'greeting' END END AS intent FROM u""")
def intent_exact_match(spark, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.exact_intent(F.col("text")).alias("intent"))


REWRITE_SQL = r"""
WITH p AS (SELECT item_id, unnest(string_split(text, '. ')) AS raw, unnest(range(0, len(string_split(text, '. ')))) AS pos FROM benchmark),
c AS (SELECT item_id, pos, trim(regexp_replace(raw, '[ \t\r\n\x0B\f]+', ' ', 'g'), ' "''.;,') AS x FROM p),
f AS (SELECT * FROM c WHERE x <> '' AND length(x) <= 120 AND NOT regexp_matches(x, '(?i)\b(?:article|art|section|sec|cap|chapter|part|schedule)\.?\s*\(?[0-9]|\bs\.\s*[0-9]|\bconstitution\b')
  AND NOT regexp_matches(x, '\b(?:Act|Code)\b') AND NOT regexp_matches(x, '(?i)[0-9]|\b(?:NUMBERS)\b')),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(x) ORDER BY pos) AS k FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rk FROM g WHERE k = 1)
SELECT b.item_id, coalesce(string_agg(x, '|' ORDER BY pos), '') AS phrases FROM benchmark b LEFT JOIN h ON b.item_id = h.item_id AND rk <= 3 GROUP BY b.item_id""".replace("NUMBERS", "|".join(T.NUMBER_WORDS))


@query(REWRITE_SQL)
def rewrite_clean(spark, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.rewrite_clean(F.split("text", r"\. ", -1)), "|").alias("phrases"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script\b.*?</script|style\b.*?</style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n\x0B\f]+', ' ', 'g'), ' ')) AS digest FROM pages""")
def page_text(spark, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(io.html_text(F.coalesce("html", F.lit("")))).alias("digest"))


@query("""
WITH p AS (SELECT doc_id AS doc, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents)
SELECT CAST(doc AS VARCHAR) AS doc, md5(string_agg(chr(10) || '--- PAGE ' || n || ' ---' || chr(10) || chr(10) || x, chr(10) ORDER BY n)) AS digest, count(*) AS pages FROM p GROUP BY doc""")
def pages_rebuilt(spark, d: str) -> DataFrame:
    """Each document from its lines as pages: a group is one document, never a source."""
    each = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "t"))
    return io.pages_digest(each.withColumn("n", F.col("n") + 1), "doc", "n", "t")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN NOT contains(coalesce(text, ''), 'License') THEN 'license' END, CASE WHEN NOT contains(coalesce(text, ''), ' the ') THEN 'article' END, CASE WHEN NOT contains(coalesce(text, ''), '. ') THEN 'sentence' END) AS missing FROM documents""")
def markers_missing(spark, d: str) -> DataFrame:
    found = chunk.missing_markers(F.coalesce("text", F.lit("")), {"license": "License", "article": " the ", "sentence": ". "})
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("missing"))


@query("""SELECT doc_id, lower(replace('Part ' || coalesce(lang, '') || '-Section ' || doc_id, ' ', '-')) AS slug, 'Part ' || coalesce(lang, '') || ' — Section ' || doc_id AS cited FROM documents""")
def citations_and_slugs(spark, d: str) -> DataFrame:
    path = F.array(F.concat(F.lit("Part "), F.coalesce("lang", F.lit(""))), F.concat(F.lit("Section "), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", T.slug(path).alias("slug"), T.citation(path).alias("cited"))


WS = "' ' || chr(9) || chr(10) || chr(13)"
GAP = "chr(10) || chr(10)"


@query(f"""
WITH a AS (SELECT item_id, text, item_id % 4 <> 0 AS sufficient, item_id % 2 = 0 AS polar, CASE item_id % 3 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'No.' END AS opening, list_append(string_split(text, '. '), '') AS st,
  CASE WHEN item_id % 5 <> 0 THEN text END AS q FROM benchmark),
b AS (SELECT *, trim(array_to_string(list_filter(st, lambda x: x <> ''), ' '), {WS}) AS told,
  trim(array_to_string(list_filter(string_split(text, '. '), lambda x: NOT contains(lower(x), 'an ') AND trim(x, {WS}) <> ''), '. '), {WS}) AS reason FROM a)
SELECT item_id, CASE WHEN sufficient THEN concat_ws({GAP}, nullif(CASE WHEN polar AND opening IS NOT NULL THEN trim(opening || ' ' || told, {WS}) ELSE told END, ''), 'Important qualifications:' || {GAP} || '- ' || q, 'Ask.')
 ELSE concat_ws({GAP}, 'Unknown.', nullif(reason, '')) END AS answer FROM b""")
def answers_rendered(spark, d: str) -> DataFrame:
    i = F.col("item_id")
    opening = F.when(i % 3 == 0, "Yes.").when(i % 3 == 1, "No.")
    qualifications = F.when(i % 5 != 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "benchmark").select("item_id", T.render(i % 4 != 0, i % 2 == 0, opening, F.concat(F.split("text", r"\. ", -1), F.array(F.lit(""))), qualifications, F.col("text"), "Unknown.", "Ask.", ["an "]).alias("answer"))


@query("SELECT item_id, '[1] Item ' || item_id || chr(10) || text || chr(10) || chr(10) || '[2] Start' || chr(10) || substr(text, 1, 50) AS context FROM benchmark")
def context_block(spark, d: str) -> DataFrame:
    source = lambda cited, content: F.struct(cited.alias("citation"), content.alias("content"))
    sources = F.array(source(F.concat(F.lit("Item "), F.col("item_id").cast("string")), F.col("text")), source(F.lit("Start"), F.substring("text", 1, 50)))
    return table(spark, d, "benchmark").select("item_id", T.source_block(sources).alias("context"))


# ---------------------------------------------------------------- lexical search
POSTING_SQL = """
p_{k} AS (SELECT {id} AS {k}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term, unnest(range(0, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))) AS p FROM {t}),
w_{k} AS (SELECT {k}, term, round(max(1.0 / (1.0 + ln(1.0 + CAST(p AS DOUBLE)))), 6) AS weight FROM p_{k} GROUP BY {k}, term)"""


@query("WITH " + POSTING_SQL.format(k="doc_id", id="doc_id", t="documents") + " SELECT term, count(*) AS docs, CAST(sum(CAST(round(weight * 1000000) AS BIGINT)) AS BIGINT) AS micro_weight FROM w_doc_id GROUP BY term")
def lexical_index(spark, d: str) -> DataFrame:
    p = search.postings(table(spark, d, "documents"), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.round(F.col("weight") * 1000000).cast("long")).alias("micro_weight"))


SPARSE_SQL = "WITH " + POSTING_SQL.format(k="cid", id="doc_id", t="documents") + "," + POSTING_SQL.format(k="qid", id="item_id", t="benchmark") + """,
h AS (SELECT qid, cid, round(sum(CAST(a.weight AS DOUBLE) * CAST(b.weight AS DOUBLE)), 6) AS score FROM w_qid a JOIN w_cid b USING (term) GROUP BY qid, cid),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rk FROM h)"""


def _sparse(spark, d: str, k: int) -> DataFrame:
    q = search.postings(table(spark, d, "benchmark").withColumnRenamed("item_id", "qid"), "qid")
    index = inverted.build(table(spark, d, "documents").withColumnRenamed("doc_id", "cid"))
    return inverted.search(q, index, k)[0]


@query(SPARSE_SQL + " SELECT qid, cid, score, rk FROM o WHERE rk <= 5")
def sparse_topk(spark, d: str) -> DataFrame:
    return _sparse(spark, d, search.SPARSE_K)


@query(SPARSE_SQL + """
, t AS (SELECT * FROM o WHERE rk <= 5), b AS (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY cid % 97, cid) AS rk FROM t)
, f AS (SELECT qid, cid, round(sum(CAST(part AS DOUBLE)), 6) AS score FROM (SELECT qid, cid, 1.0 / (rk + 1) AS part FROM t UNION ALL SELECT qid, cid, 1.0 / (rk + 1) FROM b) GROUP BY qid, cid)
SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rk FROM f""")
def hybrid_search_text(spark, d: str) -> DataFrame:
    lexical = _sparse(spark, d, search.SPARSE_K)
    other = lexical.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("cid") % 97, "cid")))
    return search.hybrid(other, lexical)


PAIR_TERMS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"


@query(SPARSE_SQL + f""", x AS (SELECT o.qid, o.cid, o.rk AS pos, {PAIR_TERMS.format("b.text")} AS a, {PAIR_TERMS.format("d.text")} AS c FROM o JOIN benchmark b ON b.item_id = o.qid JOIN documents d ON d.doc_id = o.cid WHERE o.rk <= 5)
SELECT qid, cid, pos, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, c)) / len(a) END, 6) AS score FROM x""")
def rerank_pairs(spark, d: str) -> DataFrame:
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("cid"), F.col("text").alias("passage"))
    return rerank.score_pairs(_sparse(spark, d, search.SPARSE_K).select("qid", "cid", F.col("rk").alias("pos")), questions, passages)


def _head(spark, d: str) -> encoders.Head:
    """A lexical head fitted on items of the benchmark: their first half belongs to the whole, and not to the next item."""
    b = table(spark, d, "benchmark").select("item_id", "text", F.substring("text", 1, 120).alias("query"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    own = b.select("query", F.col("text").alias("passage"), F.lit(1).alias("label"))
    return encoders.fit_head(own.unionByName(b.join(other, "item_id").select("query", F.col("next").alias("passage"), F.lit(0).alias("label"))))


@query()
def lexical_head_index(spark, d: str) -> DataFrame:
    """Terms of all documents with the weights of a fitted lexical head: how many documents have one, and their sum in millionths."""
    p = encoders.head_postings(table(spark, d, "documents"), "doc_id", _head(spark, d))
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.round(F.col("weight") * 1000000).cast("long")).alias("micro_weight"))


@query()
def encoded_chunks(spark, d: str) -> DataFrame:
    """Every chunk with its vector under its document's title and heading, by the encoder of subwords."""
    chunks = chunk.build_chunks(_units(spark, d))
    made = adapters.index_chunks(chunks, encoders.dense_encoder, F.col("title"), F.element_at("path", -1), F.col("citation"))
    return made.select("chunk_id", "vector")


def _share(questions: list[str], passages: list[str]) -> list[float]:
    """A model in place of a real one: the share of a question's terms that a passage holds."""
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    return [round(len(words(q) & words(p)) / len(words(q)), 6) if words(q) else 0.0 for q, p in zip(questions, passages, strict=True)]


@query(ORACLES["rerank_pairs"])
def rerank_banded(spark, d: str) -> DataFrame:
    """The same scores from a model that gets pairs in batches of like length."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("cid"), F.col("text").alias("passage"))
    return rerank.score_banded(_sparse(spark, d, search.SPARSE_K).select("qid", "cid", F.col("rk").alias("pos")), questions, passages, _share).select("qid", "cid", "pos", "score")


# ---------------------------------------------------------------- grounding
CLAIM_SQL = r"""
WITH c AS (
  SELECT item_id AS answer, pos, CASE WHEN pos < 2 THEN 'statement' ELSE 'qualification' END AS kind, 'b-' || (item_id + CASE WHEN pos = 2 THEN 1 ELSE 0 END) AS chunk_id,
    CASE pos WHEN 0 THEN substr(text, 1, 60) || '.' WHEN 1 THEN substr(text, 1, 45) || ' ... ' || substr(text, 80, 30) ELSE substr(text, 10, 30) END AS quote
  FROM (SELECT item_id, text, unnest([0, 1, 2]) AS pos FROM benchmark)),
s AS (SELECT 'b-' || item_id AS chunk_id, text AS content FROM benchmark)"""
FOLDED = grounding.DASHES + grounding.SINGLE_QUOTES + grounding.DOUBLE_QUOTES
FOLD_TO = "-" * len(grounding.DASHES) + "''" * len(grounding.SINGLE_QUOTES) + '"' * len(grounding.DOUBLE_QUOTES)
NORM_SQL = (
    "trim(lower(regexp_replace(replace(regexp_replace(translate({x}, '" + FOLDED + "' || chr(160), '" + FOLD_TO + " '), "
    r"'\((?:[a-z]{{1,3}}|[ivxl]{{1,6}}|[0-9]{{1,2}})\)', ' ', 'g'), '-', ' - '), '[ \t\r\n\x0B\f]+', ' ', 'g')), ' ')"
)
VERIFY_SQL = CLAIM_SQL + r""",
j AS (SELECT c.*, s.content, s.chunk_id IS NOT NULL AS known FROM c LEFT JOIN s ON c.chunk_id = s.chunk_id AND CAST(substr(s.chunk_id, 3) AS BIGINT) = c.answer),
k AS (SELECT *, list_filter(list_transform(regexp_split_to_array(quote, '\s*(?:\.\.\.+|…)\s*'), lambda x: trim(regexp_replace(trim(x, ' ' || chr(10)), '[.;,:]+$', ''), ' ' || chr(10))), lambda x: x <> '') AS parts FROM j),
m AS (SELECT *, """ + NORM_SQL.format(x="content") + """ AS hay, list_transform(parts, lambda x: """ + NORM_SQL.format(x="x") + """) AS nd FROM k),
v AS (SELECT answer, pos, kind, chunk_id, CASE WHEN NOT known THEN 'unknown_source'
  WHEN len(parts) BETWEEN 1 AND 3 AND list_sum(list_transform(parts, lambda x: length(x))) >= 40 AND list_min(list_transform(parts, lambda x: length(x))) >= 10
    AND strpos(hay, nd[1]) > 0 AND (len(nd) < 2 OR strpos(substr(hay, strpos(hay, nd[1]) + length(nd[1])), nd[2]) > 0) THEN NULL ELSE 'unsupported_quote' END AS failure FROM m)"""


def _claims(spark, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("answer"), "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    quote = F.when(F.col("pos") == 0, F.concat(F.substring("text", 1, 60), F.lit("."))).when(F.col("pos") == 1, F.concat(F.substring("text", 1, 45), F.lit(" ... "), F.substring("text", 80, 30))).otherwise(F.substring("text", 10, 30))
    claims = b.select("answer", "pos", F.when(F.col("pos") < 2, "statement").otherwise("qualification").alias("kind"), F.concat(F.lit("b-"), (F.col("answer") + (F.col("pos") == 2).cast("long")).cast("string")).alias("chunk_id"), quote.alias("quote"))
    sources = table(spark, d, "benchmark").select(F.col("item_id").alias("answer"), F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"))
    return grounding.verify(claims, sources)


@query(VERIFY_SQL + " SELECT answer, pos, kind, chunk_id, failure FROM v")
def quote_verification(spark, d: str) -> DataFrame:
    return _claims(spark, d).select("answer", "pos", "kind", "chunk_id", "failure")


WIDE = "０１２３４５６７８９"
QUOTED_SQL = "replace(replace(translate(upper(replace({x}, 'ß', 'ẞ')), '0123456789-', '" + WIDE + "—'), 'FI', 'ﬁ'), 'É', 'E' || chr(769))"
FULL_SQL = "replace(" + NORM_SQL.format(x="nfc_normalize(translate(replace({x}, 'ﬁ', 'fi'), '" + WIDE + "', '0123456789'))").replace("{{", "{").replace("}}", "}") + ", 'ß', 'ss')"


@query("""WITH n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT doc_id, doc_id % n AS answer, coalesce(text, '') AS content, CAST(length(coalesce(text, '')) AS BIGINT) AS size FROM documents, n),
c AS (SELECT answer, doc_id, CASE doc_id % 4 WHEN 3 THEN doc_id + 1 ELSE doc_id END AS cited, content, CASE doc_id % 4
  WHEN 1 THEN substr(content, size // 4 + 1, 30) || '…' || substr(content, 3 * size // 4 + 1, 30) WHEN 2 THEN substr(content, 3 * size // 4 + 1, 30) || ' ... ' || substr(content, size // 4 + 1, 30)
  ELSE """ + QUOTED_SQL.format(x="substr(content, size // 2 + 1, 60)") + """ END AS quote FROM d),
j AS (SELECT c.answer, c.doc_id, c.quote, s.content AS source, s.doc_id IS NOT NULL AS known FROM c LEFT JOIN d s ON s.doc_id = c.cited AND s.answer = c.answer),
k AS (SELECT *, list_filter(list_transform(regexp_split_to_array(quote, '\\s*(?:\\.\\.\\.+|…)\\s*'), lambda x: trim(regexp_replace(trim(x, ' ' || chr(10)), '[.;,:]+$', ''), ' ' || chr(10))), lambda x: x <> '') AS parts FROM j),
m AS (SELECT *, """ + FULL_SQL.replace("{x}", "source") + """ AS hay, list_transform(parts, lambda x: """ + FULL_SQL.replace("{x}", "x") + """) AS nd FROM k)
SELECT answer, doc_id AS pos, CASE WHEN NOT known THEN 'unknown_source'
  WHEN len(parts) BETWEEN 1 AND 3 AND list_sum(list_transform(parts, lambda x: length(x))) >= 40 AND list_min(list_transform(parts, lambda x: length(x))) >= 10
    AND strpos(hay, nd[1]) > 0 AND (len(nd) < 2 OR strpos(substr(hay, strpos(hay, nd[1]) + length(nd[1])), nd[2]) > 0)
    AND (len(nd) < 3 OR strpos(substr(substr(hay, strpos(hay, nd[1]) + length(nd[1])), strpos(substr(hay, strpos(hay, nd[1]) + length(nd[1])), nd[2]) + length(nd[2])), nd[3]) > 0) THEN NULL ELSE 'unsupported_quote' END AS failure FROM m""")
def quotes_over_documents(spark, d: str) -> DataFrame:
    """Answers that are given many documents each, with quotes in other letters, wide digits, ligatures, combining marks and fragments."""
    n = table(spark, d, "benchmark").count()
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % n).alias("answer"), F.coalesce("text", F.lit("")).alias("content"))
    size = F.length("content")
    part = lambda k, width: F.substr(F.col("content"), (k * size / 4).cast("int") + 1, F.lit(width))
    altered = F.translate(F.upper(F.replace(part(2, 60), F.lit("ß"), F.lit("ẞ"))), "0123456789-", WIDE + "—")
    altered = F.replace(F.replace(altered, F.lit("FI"), F.lit("ﬁ")), F.lit("É"), F.lit("E\u0301"))
    quote = F.when(F.col("doc_id") % 4 == 1, F.concat(part(1, 30), F.lit("…"), part(3, 30))).when(F.col("doc_id") % 4 == 2, F.concat(part(3, 30), F.lit(" ... "), part(1, 30))).otherwise(altered)
    chunk = lambda c: F.concat(F.lit("d-"), c.cast("string"))
    cited = chunk(F.when(F.col("doc_id") % 4 == 3, F.col("doc_id") + 1).otherwise(F.col("doc_id")))
    claims = docs.select("answer", F.col("doc_id").alias("pos"), F.lit("statement").alias("kind"), cited.alias("chunk_id"), quote.alias("quote"))
    passages = docs.select(chunk(F.col("doc_id")).alias("chunk_id"), "answer", "content")
    return grounding.verify(claims, passages.select("answer", "chunk_id"), passages.select("chunk_id", "content")).select("answer", "pos", "failure")


@query(VERIFY_SQL + """, n AS (SELECT answer, count(*) FILTER (failure IS NULL) AS kept, count(*) FILTER (failure IS NOT NULL) AS lost FROM v WHERE kind = 'statement' GROUP BY answer)
SELECT item_id AS answer, item_id % 5 <> 0 AND NOT (item_id % 5 <> 0 AND coalesce(kept, 0) <= coalesce(lost, 0)) AS sufficient, coalesce(kept, 0) AS kept, coalesce(lost, 0) AS lost, item_id % 5 <> 0 AND coalesce(kept, 0) <= coalesce(lost, 0) AS refused
FROM benchmark LEFT JOIN n ON item_id = answer""")
def grounding_downgrade(spark, d: str) -> DataFrame:
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("answer"), (F.col("item_id") % 5 != 0).alias("sufficient"))
    return grounding.downgrade(_claims(spark, d), answers)


@query(VERIFY_SQL + """, o AS (SELECT answer, chunk_id, min(CASE WHEN kind = 'statement' THEN 0 ELSE 10 END + pos) AS o FROM v WHERE failure IS NULL GROUP BY answer, chunk_id)
SELECT answer, chunk_id, row_number() OVER (PARTITION BY answer ORDER BY o) AS rk FROM o""")
def cited_sources_order(spark, d: str) -> DataFrame:
    return grounding.cited_order(_claims(spark, d))


# ---------------------------------------------------------------- evaluation
RESULT_SELECT = """SELECT d.doc_id AS id, d.lang AS suite, d.doc_id % 7 <> 0 AS answerable, quality = 1 AS retrieval_hit, quality = 1 AND toxic = 0 AS rerank_hit,
 quality = 1 AND toxic = 0 AND d.doc_id % 2 = 0 AS rerank_top1, toxic = 0 AS sufficient, quality = 1 AS cited_expected, d.doc_id % 3 AS ungrounded, d.doc_id % 11 = 0 AS refused_by_grounding,
 CASE WHEN toxic = 0 THEN quality = 1 END AS answer_quality, CASE d.doc_id % 4 WHEN 0 THEN 'overclaims' WHEN 1 THEN 'misreads' WHEN 2 THEN 'incomplete' END AS judge_defect"""
RESULT_SQL = f"WITH r AS ({RESULT_SELECT} FROM documents d LEFT JOIN labels l USING (doc_id))"


def _results(spark, d: str) -> DataFrame:
    joined = table(spark, d, "documents").alias("d").join(table(spark, d, "labels").withColumnRenamed("doc_id", "l_id"), F.col("d.doc_id") == F.col("l_id"), "left")
    return joined.selectExpr(*_select_list(RESULT_SELECT.removeprefix("SELECT ")))


def _select_list(text: str) -> list[str]:
    """Splits a select list at the commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in text.replace("\n", " "):
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


PASS_SQL = {0: "(NOT answerable OR coalesce(retrieval_hit, false))", 1: "(NOT answerable OR coalesce(rerank_hit, false))", 2: "(CASE WHEN answerable THEN coalesce(rerank_hit, false) AND coalesce(sufficient, false) ELSE NOT coalesce(sufficient, true) END)"}


@query(RESULT_SQL + " SELECT suite, " + ", ".join(f"count(*) FILTER (answerable AND {c}) AS {c}_passed, count({c}) FILTER (answerable) AS {c}_total" for c in ("retrieval_hit", "rerank_hit", "rerank_top1")) + f""",
 count(*) AS questions, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS out_of_scope, count(*) FILTER ({PASS_SQL[2]}) AS passed,
 count(*) FILTER (sufficient = answerable) AS refusal_correct_passed, count(sufficient) AS refusal_correct_total, count(*) FILTER (answerable AND NOT sufficient) AS false_refusal, count(*) FILTER (NOT answerable AND sufficient) AS false_answer,
 count(*) FILTER (answerable AND sufficient AND NOT cited_expected) AS wrong_authority, CAST(sum(ungrounded) AS BIGINT) AS ungrounded_claims, count(*) FILTER (ungrounded > 0) AS answers_with_ungrounded,
 count(*) FILTER (refused_by_grounding AND answerable) AS grounding_refused_answerable, count(*) FILTER (refused_by_grounding AND NOT answerable) AS grounding_refused_out_of_scope,
 count(*) FILTER (answer_quality) AS answer_quality_passed, count(answer_quality) AS answer_quality_total, count(*) FILTER (sufficient AND answer_quality IS NULL) AS not_judged FROM r GROUP BY suite""")
def eval_ratio_metrics(spark, d: str) -> DataFrame:
    return evaluate.suite_metrics(_results(spark, d), 2)


@query(RESULT_SQL + f" SELECT id, {PASS_SQL[0]} AS t0, {PASS_SQL[1]} AS t1, {PASS_SQL[2]} AS t2, sufficient = answerable AS refusal_correct, coalesce(answerable AND NOT sufficient, false) AS false_refusal, coalesce(NOT answerable AND sufficient, false) AS false_answer, coalesce(answerable AND sufficient AND NOT cited_expected, false) AS wrong_authority FROM r")
def eval_tier_pass(spark, d: str) -> DataFrame:
    return evaluate.outcome_flags(_results(spark, d)).select("id", *[evaluate.passed(t).alias(f"t{t}") for t in range(3)], "refusal_correct", "false_refusal", "false_answer", "wrong_authority")


@query(RESULT_SQL + f""", c AS (SELECT id, suite, {PASS_SQL[1]} AS ok FROM r WHERE id % 5 <> 0 AND suite <> 'de'), b AS (SELECT id, suite, {PASS_SQL[2]} AS ok FROM r WHERE id % 6 <> 0),
b2 AS (SELECT * FROM b WHERE suite IN (SELECT suite FROM c)),
j AS (SELECT coalesce(c.id, b2.id) AS id, c.ok AS now, b2.ok AS was FROM c FULL JOIN b2 ON c.id = b2.id),
k AS (SELECT id, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN was AND NOT now THEN 'regressed' WHEN NOT was AND now THEN 'improved' END AS change FROM j)
SELECT id, change FROM k WHERE change IS NOT NULL""")
def eval_compare_runs(spark, d: str) -> DataFrame:
    r = _results(spark, d)
    now = r.where("id % 5 <> 0 and suite <> 'de'").select("id", "suite", evaluate.passed(1).alias("ok"))
    return evaluate.compare_runs(now, r.where("id % 6 <> 0").select("id", "suite", evaluate.passed(2).alias("ok")))


@query(RESULT_SQL + """, m AS (SELECT suite, 'retrieval_hit' AS metric, count(*) FILTER (retrieval_hit) AS p, count(retrieval_hit) AS t FROM r GROUP BY suite UNION ALL SELECT suite, 'rerank_hit', count(*) FILTER (rerank_hit), count(rerank_hit) FROM r GROUP BY suite),
b AS (SELECT suite, 'retrieval_hit' AS metric, count(*) FILTER (retrieval_hit) AS p, count(retrieval_hit) AS t FROM r WHERE id % 2 = 0 GROUP BY suite)
SELECT suite, metric, round(100.0 * b.p / b.t, 6) AS before, round(100.0 * m.p / m.t, 6) AS after, round(CAST(100.0 AS DOUBLE) * m.p / m.t - CAST(100.0 AS DOUBLE) * b.p / b.t, 6) AS delta FROM m JOIN b USING (suite, metric) WHERE m.t > 0 AND b.t > 0""")
def eval_metric_deltas(spark, d: str) -> DataFrame:
    r = _results(spark, d)
    metric = lambda rows, c: rows.groupBy("suite").agg(F.lit(c).alias("metric"), F.count_if(c).alias("passed"), F.count(c).alias("total"))
    return evaluate.metric_deltas(metric(r, "retrieval_hit").unionByName(metric(r, "rerank_hit")), metric(r.where("id % 2 = 0"), "retrieval_hit"))


@query(RESULT_SQL + ", n AS (SELECT judge_defect, count(*) AS n FROM r WHERE NOT answer_quality AND judge_defect IS NOT NULL GROUP BY judge_defect) SELECT judge_defect, n, row_number() OVER (ORDER BY n DESC, judge_defect) AS rk FROM n")
def eval_defect_histogram(spark, d: str) -> DataFrame:
    return evaluate.defect_histogram(_results(spark, d))


@query(RESULT_SQL + f" SELECT suite, count(*) AS questions, count(*) FILTER ({PASS_SQL[1]}) AS passed, CAST(grouping(suite) AS INTEGER) AS overall FROM r GROUP BY ROLLUP (suite)")
def eval_rollup_suites(spark, d: str) -> DataFrame:
    return evaluate.rollup_suites(_results(spark, d))


RUN_SELECT = """SELECT event_id AS run, event_id % 13 <> 0 AS has_scope, CASE WHEN event_id % 17 <> 0 THEN event_id % 3 END AS tier, event_id % 11 = 0 AS selected_ids, event_id % 7 = 0 AS one_document, CASE WHEN event_id % 4 <> 0 THEN event_id % 5 <> 0 END AS reranked,
 event_id % 2 = 0 AS rewrite, event_id % 6 < 3 AS pipeline_rewrite, event_id % 8 < 5 AS rerank_rewrites, event_id % 9 AS cache_hits"""


@query(f"""WITH r AS ({RUN_SELECT} FROM events) SELECT run, CASE WHEN NOT has_scope OR tier IS NULL THEN 'no scope recorded' WHEN selected_ids THEN 'selected questions only' WHEN one_document THEN 'one document only' WHEN NOT coalesce(reranked, true) THEN 'reranking was off'
 WHEN rewrite <> pipeline_rewrite THEN 'rewriting differs from the pipeline' WHEN rewrite AND tier >= 1 AND NOT rerank_rewrites THEN 'reranker did not read the rewrites' WHEN cache_hits > 0 THEN 'cached results' END AS refusal FROM r""")
def promotion_guard(spark, d: str) -> DataFrame:
    runs = table(spark, d, "events").selectExpr(*_select_list(RUN_SELECT.removeprefix("SELECT ")))
    return runs.select("run", evaluate.promotion_refusal().alias("refusal"))


PAIR_RUNS = """event_id AS run, CASE WHEN event_id % 2 = 0 THEN 'e1' WHEN event_id % 3 = 0 THEN 'e2' WHEN event_id % 5 = 0 THEN '' END AS embedding_model, CASE WHEN event_id % 3 < 2 THEN 'r1' ELSE 'r2' END AS reranker_model, CASE WHEN event_id % 7 <> 0 THEN event_type END AS collection,
 CASE WHEN event_id % 11 <> 0 THEN event_id % 3 END AS tier, CASE WHEN event_id % 4 <> 0 THEN event_id % 5 <> 0 END AS reranked, CASE WHEN event_id % 6 <> 0 THEN event_id % 2 = 0 END AS rewrite, event_id % 8 < 5 AS rerank_rewrites,
 CASE WHEN event_id % 5 <> 1 THEN 'e1' END AS b_embedding_model, CASE WHEN event_id % 4 < 3 THEN 'r1' END AS b_reranker_model, CASE WHEN event_id % 9 < 5 THEN 'click' ELSE '' END AS b_collection,
 CASE WHEN event_id % 13 <> 0 THEN event_id % 2 END AS b_tier, event_id % 3 = 0 AS b_reranked, CASE WHEN event_id % 10 <> 0 THEN event_id % 4 < 2 END AS b_rewrite, CASE WHEN event_id % 3 <> 0 THEN event_id % 7 < 3 END AS b_rerank_rewrites"""


@query(f"""WITH r AS (SELECT {PAIR_RUNS} FROM events)
SELECT run, concat_ws(',', CASE WHEN embedding_model <> '' AND b_embedding_model <> '' AND embedding_model <> b_embedding_model THEN 'embedding_model' END, CASE WHEN reranker_model <> '' AND b_reranker_model <> '' AND reranker_model <> b_reranker_model THEN 'reranker_model' END,
 CASE WHEN collection <> '' AND b_collection <> '' AND collection <> b_collection THEN 'collection' END, CASE WHEN tier <> b_tier THEN 'tier' END, CASE WHEN reranked = false THEN 'reranked' END,
 CASE WHEN coalesce(rewrite, false) <> coalesce(b_rewrite, false) THEN 'rewrite' END, CASE WHEN coalesce(rerank_rewrites, false) <> coalesce(b_rerank_rewrites, false) THEN 'rerank_rewrites' END) AS reasons FROM r""")
def eval_incomparable(spark, d: str) -> DataFrame:
    runs = table(spark, d, "events").selectExpr(*_select_list(PAIR_RUNS))
    return runs.select("run", F.array_join(evaluate.incomparable_reasons(), ",").alias("reasons"))


@query("""WITH q AS (SELECT item_id AS id, unnest(['c-' || item_id, 'c-' || (item_id * 7)]) AS expected FROM benchmark), c AS (SELECT 'c-' || doc_id AS chunk_id FROM documents WHERE doc_id % 3 <> 0)
SELECT id, expected FROM q WHERE expected NOT IN (SELECT chunk_id FROM c)""")
def expected_not_in_corpus(spark, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("c-"), c.cast("string"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array(name(F.col("item_id")), name(F.col("item_id") * 7)).alias("expect_any_of"))
    return evaluate.missing_expected(q, table(spark, d, "documents").where("doc_id % 3 <> 0").select(name(F.col("doc_id")).alias("chunk_id")))


@query(E_SQL + _top_sql("t", "true", 30) + """, g AS (SELECT qid, min(CASE WHEN label = (SELECT label FROM embeddings x WHERE x.vec_id = qid) AND cid <> qid THEN rk END) AS first FROM t GROUP BY qid) SELECT qid, first, first IS NOT NULL AS hit FROM g""")
def eval_first_rank(spark, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("own"))
    rows = _candidates(spark, d).join(own, "qid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "cid"))).alias("r"), F.collect_list(F.when((F.col("doc") == F.col("own")) & (F.col("cid") != F.col("qid")), F.col("cid"))).alias("want"))
    ranked = F.transform("r", lambda x: x["cid"])
    return rows.select("qid", evaluate.first_rank(ranked, F.col("want")).cast("long").alias("first"), evaluate.hits(ranked, F.col("want")).alias("hit"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber + CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS n FROM lineitem), g AS (SELECT k, n, count(*) AS c FROM f GROUP BY k, n), t AS (SELECT k, max(n) AS top FROM f GROUP BY k),
e AS (SELECT k, unnest(range(1, CAST(top AS BIGINT) + 1)) AS n FROM t), m AS (SELECT e.k, e.n FROM e LEFT JOIN g ON e.k = g.k AND e.n = g.n WHERE g.n IS NULL)
SELECT t.k, coalesce((SELECT string_agg(n, ',' ORDER BY n) FROM m WHERE m.k = t.k), '') AS missing, coalesce((SELECT string_agg(n, ',' ORDER BY n) FROM g WHERE g.k = t.k AND c > 1), '') AS repeated FROM t""")
def sequence_gaps(spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + (F.col("l_partkey") % 4 == 0).cast("int")).alias("n"))
    gaps = structure.sequence_gaps(rows.withColumn("top", F.col("n")), "k", "n", "top")
    return gaps.select("k", F.array_join(F.array_sort("missing").cast("array<string>"), ",").alias("missing"), F.array_join(F.col("repeated").cast("array<string>"), ",").alias("repeated"))


@query("""WITH f AS (SELECT doc_id AS id, quality = 1 AS ok FROM labels), a AS (SELECT * FROM f WHERE NOT ok ORDER BY id LIMIT 10), b AS (SELECT * FROM f WHERE ok ORDER BY id LIMIT (20 - (SELECT count(*) FROM a))) SELECT * FROM a UNION ALL SELECT * FROM b""")
def review_sample(spark, d: str) -> DataFrame:
    return evaluate.review_sample(table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok")), 20)


@query("""WITH c AS (SELECT doc_id % 40 AS c, CASE WHEN doc_id % 5 <> 0 THEN CASE quality WHEN 1 THEN 'stated' ELSE 'absent' END END AS expected, CASE WHEN doc_id % 9 <> 0 THEN CASE toxic WHEN 0 THEN 'stated' ELSE 'absent' END END AS found FROM labels)
SELECT c AS "case", count(*) FILTER (expected = found) AS agreed, count(*) AS checks FROM c WHERE expected IS NOT NULL GROUP BY c""")
def judge_agreement(spark, d: str) -> DataFrame:
    c = table(spark, d, "labels").selectExpr("doc_id % 40 `case`", "case when doc_id % 5 <> 0 then case quality when 1 then 'stated' else 'absent' end end expected", "case when doc_id % 9 <> 0 then case toxic when 0 then 'stated' else 'absent' end end found")
    return evaluate.agreement(c)


VERDICT_SELECT = """doc_id, CASE WHEN doc_id % 10 = 0 THEN 'timeout' END AS error, CASE WHEN doc_id % 8 <> 0 THEN toxic = 0 END AS responsive, CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN quality = 1 THEN 'none' ELSE 'misreads' END END AS defect, CASE WHEN doc_id % 6 = 0 THEN 3 ELSE 2 END AS n_claims"""


@query(f"""WITH v AS (SELECT {VERDICT_SELECT}, [CASE WHEN doc_id % 3 = 0 THEN 'absent' ELSE 'stated' END, CASE WHEN doc_id % 17 <> 0 THEN 'stated' END] AS findings FROM labels),
w AS (SELECT * REPLACE (CASE WHEN error IS NOT NULL THEN error WHEN n_claims <> 2 THEN 'checked 2 of ' || n_claims || ' claims' END AS error) FROM v)
SELECT doc_id, error, CASE WHEN error IS NOT NULL OR responsive IS NULL THEN NULL ELSE responsive AND coalesce(defect, '') = 'none' AND findings[1] = 'stated' AND coalesce(findings[2], '') = 'stated' END AS quality,
 CASE WHEN error IS NOT NULL THEN NULL WHEN coalesce(defect, 'none') <> 'none' THEN defect WHEN NOT responsive THEN 'unresponsive' WHEN findings[1] <> 'stated' THEN findings[1] WHEN findings[2] IS NULL THEN NULL ELSE 'none' END AS headline FROM w""")
def judge_verdicts(spark, d: str) -> DataFrame:
    v = table(spark, d, "labels").selectExpr(*_select_list(VERDICT_SELECT), "array(case when doc_id % 3 = 0 then 'absent' else 'stated' end, case when doc_id % 17 <> 0 then 'stated' end) findings")
    return v.withColumn("error", evaluate.verdict_error()).select("doc_id", "error", evaluate.quality().alias("quality"), evaluate.headline().alias("headline"))


@query("""WITH q AS (SELECT doc_id // 2 AS id, CASE WHEN doc_id % 7 <> 0 THEN source ELSE '  ' END AS question, doc_id % 3 <> 0 AS answerable, doc_id % 4 <> 0 AS listed FROM documents)
SELECT id, 'repeated id' AS problem FROM q GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'no text' FROM q WHERE trim(coalesce(question, '')) = '' UNION ALL SELECT id, 'nothing expected' FROM q WHERE answerable AND NOT listed
UNION ALL SELECT id, 'expected out of scope' FROM q WHERE NOT answerable AND listed""")
def question_set_errors(spark, d: str) -> DataFrame:
    q = table(spark, d, "documents").selectExpr("doc_id div 2 id", "case when doc_id % 7 <> 0 then source else '  ' end question", "doc_id % 3 <> 0 answerable", "case when doc_id % 4 <> 0 then array('c') else array() end expect_any_of")
    return evaluate.question_errors(q)


@query("SELECT item_id AS id FROM benchmark WHERE item_id % 3 = 1 OR item_id % 5 = 1")
def questions_of_document(spark, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").selectExpr("item_id id", "array(concat('d', cast(item_id % 3 as string), '@v1-a'), concat('d', cast(item_id % 5 as string), '@v2-b')) expect_any_of")
    return evaluate.of_document(q, "d1").select("id")


@query("""WITH v AS (SELECT doc_id, quality = 1 AS expect_quality, CASE WHEN doc_id % 9 <> 0 THEN toxic = 0 END AS judged, [CASE WHEN doc_id % 3 = 0 THEN 'flagged' ELSE 'sound' END, CASE WHEN doc_id % 5 <> 0 THEN 'sound' END, 'flagged'] AS expects,
 [CASE WHEN doc_id % 2 = 0 THEN 'stated' ELSE 'absent' END, CASE WHEN doc_id % 7 <> 0 THEN 'stated' END] AS findings FROM labels)
SELECT doc_id AS "case", 0 AS pos, judged IS NOT DISTINCT FROM expect_quality AS agreed FROM v UNION ALL SELECT doc_id, i, coalesce((findings[i] <> 'stated') = (expects[i] = 'flagged'), false) FROM (SELECT *, unnest([1, 2, 3]) AS i FROM v) WHERE expects[i] IS NOT NULL""")
def judge_case_scores(spark, d: str) -> DataFrame:
    v = table(spark, d, "labels").selectExpr("doc_id `case`", "quality = 1 expect_quality", "case when doc_id % 9 <> 0 then toxic = 0 end judged", "array(case when doc_id % 3 = 0 then 'flagged' else 'sound' end, case when doc_id % 5 <> 0 then 'sound' end, 'flagged') expects",
                                             "array(case when doc_id % 2 = 0 then 'stated' else 'absent' end, case when doc_id % 7 <> 0 then 'stated' end) findings")
    return evaluate.case_checks(v)


# ---------------------------------------------------------------- registry and cache
def _registry(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("concat('d', cast(doc_id div 2 as string)) document_id", "concat('v', cast(doc_id % 2 as string)) version", "source title", "doc_id % 4 = 0 or doc_id % 6 = 1 in_force")


REGISTRY_SQL = """WITH r AS (SELECT 'd' || (doc_id // 2) AS document_id, 'v' || (doc_id % 2) AS version, source AS title, doc_id % 4 = 0 OR doc_id % 6 = 1 AS in_force FROM documents)"""


@query(REGISTRY_SQL + """ SELECT document_id, 'missing field' AS problem FROM r WHERE document_id IS NULL OR version IS NULL OR title IS NULL OR trim(title) = '' UNION ALL
 SELECT document_id, 'repeated version' FROM r GROUP BY document_id, version HAVING count(*) > 1 UNION ALL SELECT document_id, 'several in force' FROM r GROUP BY document_id HAVING count(*) FILTER (in_force) > 1""")
def registry_constraints(spark, d: str) -> DataFrame:
    return registry.registry_errors(_registry(spark, d))


@query(REGISTRY_SQL + """, q AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'd' || (doc_id // 2) || '@vv' || (doc_id % 2) WHEN doc_id % 3 = 1 THEN 'd' || (doc_id // 2) ELSE 'x' || doc_id END AS ref FROM documents),
s AS (SELECT document_id, count(*) AS n, count(*) FILTER (in_force) AS f, min(document_id || '@v' || version) AS only_, min(document_id || '@v' || version) FILTER (in_force) AS forced FROM r GROUP BY document_id),
e AS (SELECT DISTINCT document_id || '@v' || version AS slug FROM r)
SELECT ref, CASE WHEN e.slug IS NOT NULL THEN e.slug WHEN n = 1 THEN only_ WHEN f = 1 THEN forced END AS slug, CASE WHEN e.slug IS NOT NULL OR n = 1 OR f = 1 THEN 'resolved' WHEN n IS NOT NULL THEN 'ambiguous' ELSE 'unknown' END AS status
FROM q LEFT JOIN e ON ref = e.slug LEFT JOIN s ON ref = s.document_id""")
def registry_resolve(spark, d: str) -> DataFrame:
    refs = table(spark, d, "documents").selectExpr("case when doc_id % 3 = 0 then concat('d', cast(doc_id div 2 as string), '@vv', cast(doc_id % 2 as string)) when doc_id % 3 = 1 then concat('d', cast(doc_id div 2 as string)) else concat('x', cast(doc_id as string)) end ref")
    return registry.resolve(refs, _registry(spark, d))


@query("""WITH p AS (SELECT source, sha256(doc_id || '|' || coalesce(md5(text), 'unreadable') || '|' || coalesce(CAST(n_chars AS VARCHAR), '')) AS d FROM documents), b AS (SELECT source, substr(d, 1, 2) AS b, substr(d, 3, 2) AS b2, sha256(string_agg(d, ',' ORDER BY d)) AS d, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT source, sha256(string_agg(d, ',' ORDER BY b, b2)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY source""")
def corpus_fingerprint(spark, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("checksum"), F.col("n_chars").alias("chunks"))
    return registry.fingerprint(rows, "source", "doc_id", "checksum", "chunks")


@query("""WITH w AS (SELECT doc_id, substr(sha256('["' || doc_id || '","' || coalesce(source, '') || '"]'), 1, 24) AS key FROM documents), c AS (SELECT key, doc_id * 10 AS value FROM w WHERE doc_id % 3 = 0) SELECT w.key, doc_id, value, c.key IS NOT NULL AS hit FROM w LEFT JOIN c USING (key)""")
def cache_probe_join(spark, d: str) -> DataFrame:
    wanted = table(spark, d, "documents").select(T.cache_key(F.col("doc_id"), F.coalesce("source", F.lit(""))).alias("key"), "doc_id")
    return registry.probe(wanted, wanted.where("doc_id % 3 = 0").select("key", (F.col("doc_id") * 10).alias("value"))).select("key", "doc_id", "value", "hit")


@query("""WITH r AS (SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate + INTERVAL 400 DAY AS DATE) AS b FROM orders) SELECT document_id FROM r WHERE a <= DATE '1995-06-17' AND b > DATE '1995-06-17'""")
def registry_as_of(spark, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").cast("date").alias("effective_from"), F.date_add(F.col("o_orderdate").cast("date"), 400).alias("effective_to"))
    return registry.as_of(r, "1995-06-17").select("document_id")


# ---------------------------------------------------------------- structure
# Documents in the form of statutes: every sentence ({x}, the {i}th) of a text becomes one of these blocks in turn, with a number {n}.
ACT_BLOCKS = [
    ["{n}.", "Title {n}", "(1)", "{x}", "(a)", "first", "(b)", "{x}"],
    ["{n}.", "Title {n}", "Title {n}", "{x}"],
    ["Part IV – NAMED", "{n}.", "Title {n}", "{x}", "loose"],
    ["Chapter XV", "Its name", "{n}.", "[Repealed by an act]", "(1)", "{x}"],
    ["A cross heading", "{n}.", "Title {n}", "(1)", "(2)", "{x}", "more"],
    ["{n}A.", "Title {n}", "before", "(1)", "{x}", "(2)", "(a)", "{x}"],
    ["{n}.", "Title {n}", "(a)", "{x}"],
    ["{n}.", "Spent", "{x}"],
    ["{n}.", "Title {n}"],
    ["Part 2 - OTHERS", "{n}.", "Title {n}", "(1)", "{x}"],
]
ACT_START, ACT_END = ["Opening", "[Amended]", "1.", "Early", "(1)", "Above the parts", "Part I – GENERAL"], ["FIRST SCHEDULE", "9.", "After", "the end"]
CODE_BLOCKS = [
    ["{n}.", "Title {n}", "(1)", "{x}", "(a)", "first"],
    ["{n}.", "Title {n}", "Title {n}", "{x}"],
    ["Chapter TWO", "Its name", "{n}.", "Title {n}", "{x}"],
    ["{n}.", "Title {n}", "(a)", "{x}", "(2)", "(b)", "{x}"],
    ["SECOND SCHEDULE", "{x}", "(1)", "Third Schedule", "Chapter three", "FIRST SCHEDULE", "{n}.", "Title {n}", "(1)", "(2)", "{x}"],
]
CODE_START, CODE_END = ["We", "1.", "HERE", "before", "Chapter ONE", "GENERAL"], ["FIFTH SCHEDULE", "the end"]


def _form(start: list[str], blocks: list[list[str]], end: list[str]):
    """(column, SQL) of the same text in the form of a statute; every third document ends with ``end``, and starts over after it."""
    fill = {"{n}": "n", "{x}": "x"}

    def cut(line: str) -> list[str]:
        """A line as literals and the names that fill it."""
        parts = [line]
        for mark in fill:
            parts = [y for p in parts for y in ([p] if p in fill.values() else [z for k, w in enumerate(p.split(mark)) for z in ([fill[mark]] * (k > 0) + [w])])]
        return [p for p in parts if p]

    def column(text, ident):
        def block(x, i):
            value = {"n": (i % 900 + 1).cast("string"), "x": F.regexp_replace(x, r"\s+", " ")}
            made = [F.concat(*[value.get(p, F.lit(p)) for line in own for p in [*cut(line), "\n"]][:-1]) for own in blocks]
            out = made[-1]
            for k in range(len(blocks) - 2, -1, -1):
                out = F.when(i % len(blocks) == k, made[k]).otherwise(out)
            return out

        body = F.array_join(F.transform(F.split(text, r"\.\s+", -1), block), "\n")
        tail = F.when(ident % 3 == 0, F.concat(F.lit("\n" + "\n".join(end) + "\n"), body)).otherwise("")
        return F.concat(F.lit("\n".join(start) + "\n"), body, tail)

    quoted = lambda lines: " || chr(10) || ".join(f"'{x}'" for x in lines)
    value = {"n": "CAST((i - 1) % 900 + 1 AS VARCHAR)", "x": r"regexp_replace(x, '\s+', ' ', 'g')"}
    cases = " ".join(f"WHEN {k} THEN " + " || chr(10) || ".join(" || ".join(value.get(p, f"'{p}'") for p in cut(line)) for line in own) for k, own in enumerate(blocks))
    sql = f"""b AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(coalesce(text, ''), '\\.\\s+'), lambda x, i: CASE (i - 1) % {len(blocks)} {cases} END), chr(10)) AS body FROM documents),
t AS (SELECT doc_id AS doc, {quoted(start)} || chr(10) || body || CASE WHEN doc_id % 3 = 0 THEN chr(10) || {quoted(end)} || chr(10) || body ELSE '' END AS t FROM b),
r AS (SELECT doc, trim(unnest(string_split(t, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l, unnest(range(0, len(string_split(t, chr(10))))) AS p FROM t),
l AS (SELECT *, lag(l, 1, '') OVER o AS prev, lead(l, 1, '') OVER o AS nx FROM r WHERE l <> '' WINDOW o AS (PARTITION BY doc ORDER BY p))"""
    return column, sql


act_text, ACT_TEXT_SQL = _form(ACT_START, ACT_BLOCKS, ACT_END)
code_text, CODE_TEXT_SQL = _form(CODE_START, CODE_BLOCKS, CODE_END)
# From lines with a kind to units: what each line belongs to is its last marker above; a unit's text is its subsections, then its loose lines.
UNITS_SQL = """,
s AS (SELECT *, last_value(CASE WHEN kd = 'sec' THEN p END IGNORE NULLS) OVER o AS sec, last_value(CASE WHEN kd = 'sec' THEN l END IGNORE NULLS) OVER o AS sec_l, last_value(CASE WHEN kd = 'sec' THEN nx END IGNORE NULLS) OVER o AS title,
  last_value(CASE WHEN kd = 'part' THEN p END IGNORE NULLS) OVER o AS part, last_value(CASE WHEN kd = 'part' THEN l END IGNORE NULLS) OVER o AS part_l, last_value(CASE WHEN kd = 'chap' THEN p END IGNORE NULLS) OVER o AS chap,
  last_value(CASE WHEN kd = 'chap' THEN l END IGNORE NULLS) OVER o AS chap_l, last_value(CASE WHEN kd = 'sched' THEN p END IGNORE NULLS) OVER o AS sched FROM k WINDOW o AS (PARTITION BY doc ORDER BY p)),
u AS (SELECT *, last_value(CASE WHEN kd = 'sub' THEN p END IGNORE NULLS) OVER (PARTITION BY doc, sec ORDER BY p) AS sub FROM s WHERE sec IS NOT NULL AND sec >= coalesce(part, -1) AND sec >= coalesce(chap, -1) AND (sched IS NULL OR chap > sched)),
v AS (SELECT *, last_value(CASE WHEN kd = 'par' AND sub IS NOT NULL THEN p END IGNORE NULLS) OVER (PARTITION BY doc, sec, sub ORDER BY p) AS par FROM u),
w AS (SELECT doc, sec, any_value(sec_l) AS sec_l, any_value(title) AS title, any_value(CASE WHEN part IS NOT NULL THEN part_l END) AS part_l, any_value(CASE WHEN chap IS NOT NULL AND chap > coalesce(part, -1) THEN chap_l END) AS chap_l,
  sub IS NULL AS loose, CASE WHEN sub IS NULL THEN p ELSE coalesce(par, sub) END AS pos_, coalesce(max(CASE WHEN kd IN ('sub', 'par') AND sub IS NOT NULL THEN l || ' ' END), '')
    || coalesce(string_agg(CASE WHEN kd NOT IN ('sec', 'cross') AND NOT (kd IN ('sub', 'par') AND sub IS NOT NULL) THEN l END, ' ' ORDER BY p), '') AS line
  FROM v WHERE kd <> 'sec' AND kd <> 'cross' AND NOT (sub IS NULL AND l = title) GROUP BY doc, sec, sub IS NULL, CASE WHEN sub IS NULL THEN p ELSE coalesce(par, sub) END),
x AS (SELECT doc, sec, any_value(sec_l) AS sec_l, any_value(title) AS title, any_value(part_l) AS part_l, any_value(chap_l) AS chap_l, trim(string_agg(line, chr(10) ORDER BY loose, pos_), ' ' || chr(10)) AS body FROM w GROUP BY doc, sec)"""


@query("WITH " + ACT_TEXT_SQL + r""",
c AS (SELECT *, min(CASE WHEN regexp_matches(l, '^(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)\s+SCHEDULE\b\s*(?:\[[^\]]*\])?\s*$') THEN p END) OVER (PARTITION BY doc) AS stop FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(l, '^Part\s+([0-9]+|[IVXLCDM]+[A-Z]?)\s*[–—-]\s*(.*)$') THEN 'part' WHEN regexp_matches(l, '^Chapter\s+([IVXLCDM]+[A-Z]?)$') THEN 'chap'
  WHEN regexp_matches(nx, '^[0-9]{1,3}[A-Z]{0,2}\.\s*$') AND length(l) < 90 AND NOT starts_with(l, '[') AND NOT regexp_matches(l, '[.;,:\-–—]$') AND NOT regexp_matches(l, '^[0-9]+$') THEN 'cross'
  WHEN regexp_matches(l, '^[0-9]{1,3}[A-Z]{0,2}\.\s*$') THEN 'sec' WHEN regexp_matches(l, '^\([0-9]+\)$') THEN 'sub' WHEN regexp_matches(l, '^\([a-z]{1,4}\)$') THEN 'par' ELSE 'txt' END AS kd FROM c WHERE stop IS NULL OR p < stop)""" + UNITS_SQL + r"""
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY sec) AS ordinal, 'section' AS unit_type, regexp_extract(sec_l, '^([0-9A-Z]+)', 1) AS number, title,
 concat_ws(' > ', 'Part ' || regexp_extract(part_l, '^Part\s+([0-9]+|[IVXLCDM]+[A-Z]?)', 1), 'Chapter ' || regexp_extract(chap_l, '^Chapter\s+([IVXLCDM]+[A-Z]?)$', 1), 'Section ' || regexp_extract(sec_l, '^([0-9A-Z]+)', 1)) AS path, body
FROM x WHERE body <> '' AND NOT regexp_matches(ltrim(lower(title), '['), '^(repealed|deleted|spent)')""")
def parse_act_structure(spark, d: str) -> DataFrame:
    made = structure.parse_acts(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), act_text(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text")))
    return made.withColumns({"path": F.array_join("path", " > "), "ordinal": F.col("ordinal").cast("long")})


@query("WITH " + CODE_TEXT_SQL + r""",
c AS (SELECT *, min(CASE WHEN l = 'HERE' THEN p END) OVER (PARTITION BY doc) AS begin_ FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(l, '(?i)^Chapter\s+(ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|ELEVEN|TWELVE|THIRTEEN|FOURTEEN|FIFTEEN|SIXTEEN|SEVENTEEN|EIGHTEEN)$') THEN 'chap'
  WHEN regexp_matches(prev, '(?i)^Chapter\s+(ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|ELEVEN|TWELVE|THIRTEEN|FOURTEEN|FIFTEEN|SIXTEEN|SEVENTEEN|EIGHTEEN)$') THEN 'cross'
  WHEN regexp_matches(l, '(?i)^(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH) SCHEDULE$') THEN 'sched' WHEN regexp_matches(l, '^[0-9]{1,3}\.\s*$') THEN 'sec' WHEN regexp_matches(l, '^\([0-9]+\)$') THEN 'sub' WHEN regexp_matches(l, '^\([a-z]\)$') THEN 'par' ELSE 'txt' END AS kd FROM c WHERE p > begin_)""" + UNITS_SQL + r""",
y AS (SELECT doc, sched, p, l, kd FROM s WHERE sched IS NOT NULL AND sched > coalesce(chap, -1)),
z AS (SELECT doc, sched, max(l) FILTER (kd = 'sched') AS name, row_number() OVER (PARTITION BY doc ORDER BY sched) AS n, trim(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (kd <> 'sched'), ''), ' ' || chr(10)) AS body FROM y GROUP BY doc, sched),
a AS (SELECT doc, false AS late, sec AS pos_, 'article' AS unit_type, CAST(CAST(regexp_extract(sec_l, '^([0-9]+)', 1) AS INTEGER) AS VARCHAR) AS number, title, 'Chapter ' || regexp_extract(chap_l, '(?i)^Chapter\s+([a-z]+)$', 1) || ' > Article ' || CAST(CAST(regexp_extract(sec_l, '^([0-9]+)', 1) AS INTEGER) AS VARCHAR) AS path, body FROM x WHERE body <> '' AND chap_l IS NOT NULL
  UNION ALL SELECT doc, true, sched, 'schedule', CAST(n AS VARCHAR), name, name, body FROM z WHERE body <> '')
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY late, pos_) AS ordinal, unit_type, number, title, path, body FROM a""")
def parse_constitution_structure(spark, d: str) -> DataFrame:
    made = structure.parse_constitutions(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), code_text(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text")), "HERE")
    return made.withColumns({"path": F.array_join("path", " > "), "ordinal": F.col("ordinal").cast("long")})


# Rules by document: every fourth names no section count, every fifth exempts section 3.
RULES = {
    "n_sections": "CASE WHEN doc_id % 4 <> 3 THEN 1 + doc_id % 12 END",
    "n_parts": "doc_id % 3",
    "n_chapters": "CASE WHEN doc_id % 2 = 0 THEN 1 END",
}


@query("WITH " + ACT_TEXT_SQL + rf""",
h AS (SELECT doc, t, list_transform(regexp_extract_all(t, '(?m)^([0-9]{{1,3}})\.[ \t]*$', 1), lambda x: CAST(x AS INTEGER)) AS s, regexp_extract_all(t, '(?m)^([0-9]{{1,3}}[A-Z]{{1,2}})\.[ \t]*$', 1) AS lettered,
  len(regexp_extract_all(t, '(?m)^(Part[ \t]+(?:[0-9]+|[IVXLCDM]+[A-Z]?)[ \t]*[–—-].*)$', 1)) AS parts, len(regexp_extract_all(t, '(?m)^(Chapter[ \t]+[IVXLCDM]+[A-Z]?)$', 1)) AS chapters FROM t),
e AS (SELECT h.*, {', '.join(f'{v} AS {k}' for k, v in RULES.items())}, CASE WHEN doc_id % 5 = 0 THEN [3] ELSE [] END AS exempt FROM h JOIN documents ON doc = doc_id),
q AS (SELECT *, coalesce((SELECT list(n ORDER BY n) FROM (SELECT unnest(s) AS n) GROUP BY ALL HAVING false), []) AS none_, list_sort(list_filter(list_distinct(s), lambda n: len(list_filter(s, lambda m: m = n)) > 1)) AS twice FROM e),
p AS (
  SELECT doc, 'missing marker' AS problem, 'notice' AS detail FROM q WHERE NOT contains(t, 'FIRST SCHEDULE')
  UNION ALL SELECT doc, 'no sections', '' FROM q WHERE n_sections IS NOT NULL AND len(s) = 0
  UNION ALL SELECT doc, 'missing section', array_to_string(list_filter(range(1, n_sections + 1), lambda n: NOT list_contains(s, n)), ',') FROM q WHERE n_sections > 0 AND len(s) > 0
  UNION ALL SELECT doc, 'repeated section', array_to_string(list_filter(twice, lambda n: NOT list_contains(exempt, n)), ',') FROM q WHERE n_sections > 0 AND len(s) > 0
  UNION ALL SELECT doc, 'stale exemption', array_to_string(list_filter(exempt, lambda n: NOT list_contains(twice, n)), ',') FROM q WHERE n_sections > 0 AND len(s) > 0
  UNION ALL SELECT doc, 'missing lettered section', array_to_string(list_filter(['6A', '16A'], lambda n: NOT list_contains(lettered, n)), ',') FROM q
  UNION ALL SELECT doc, 'parts', n_parts || ' expected, ' || parts || ' found' FROM q WHERE n_parts <> parts
  UNION ALL SELECT doc, 'chapters', n_chapters || ' expected, ' || chapters || ' found' FROM q WHERE n_chapters <> chapters)
SELECT doc, problem, detail FROM p WHERE detail <> '' OR problem = 'no sections'""".replace("coalesce((SELECT list(n ORDER BY n) FROM (SELECT unnest(s) AS n) GROUP BY ALL HAVING false), []) AS none_, ", ""))
def text_expectations(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    texts = docs.select(F.col("doc_id").alias("doc"), act_text(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    markers = F.array(F.struct(F.lit("notice").alias("name"), F.lit("FIRST SCHEDULE").alias("marker")))
    rules = docs.select(
        F.col("doc_id").alias("doc"), markers.alias("markers"), *[F.expr(v).cast("int").alias(k) for k, v in RULES.items()], F.array(F.lit("6A"), F.lit("16A")).alias("want_lettered"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")).alias("exempt"))
    return validate.text_problems(texts, rules)


# The parsed units of all documents, as parse_act_structure has them.
UNIT_CTE = "WITH units AS (" + ORACLES["parse_act_structure"] + ")"


@query(UNIT_CTE + """,
n AS (SELECT doc_id AS doc, count(u.doc) AS n, count(*) FILTER (len(string_split(path, ' > ')) NOT IN (2, 3) AND u.doc IS NOT NULL) AS deep, bool_or(number = '6A') AS six, bool_or(number = '1') AS one FROM documents LEFT JOIN units u ON doc_id = u.doc GROUP BY doc_id),
f AS (SELECT doc, string_split(path, ' > ')[1] AS part, min(ordinal) AS o FROM units GROUP BY ALL), g AS (SELECT doc, string_agg(part, ',' ORDER BY o) AS parts FROM f GROUP BY doc),
p AS (
  SELECT doc, 'counts' AS problem, concat_ws(',', CASE WHEN doc % 7 = 0 THEN 'schedule 0 of 1' END, CASE WHEN n <> doc % 30 THEN 'section ' || n || ' of ' || doc % 30 END) AS detail FROM n
  UNION ALL SELECT doc, 'missing number', concat_ws(',', CASE WHEN NOT coalesce(one, false) THEN '1' END, CASE WHEN NOT coalesce(six, false) THEN '6A' END) FROM n
  UNION ALL SELECT doc, 'path depth', CAST(deep AS VARCHAR) FROM n WHERE doc % 2 = 0 AND deep > 0
  UNION ALL SELECT n.doc, 'part order', coalesce(parts, '') || ' ' FROM n LEFT JOIN g ON n.doc = g.doc WHERE n.doc % 3 <> 0 AND coalesce(parts, '') <> 'Section 1,Part I,Part IV,Part 2')
SELECT doc, problem, trim(detail) AS detail FROM p WHERE detail <> ''""")
def unit_expectations(spark, d: str) -> DataFrame:
    units = parse_act_structure(spark, d).withColumn("path", F.split("path", " > "))
    none = lambda kind: F.lit(None).cast(kind)
    i = F.col("doc_id")
    section = F.create_map(F.lit("section"), (i % 30).cast("int"))
    rules = table(spark, d, "documents").select(
        i.alias("doc"), F.when(i % 7 == 0, F.map_concat(section, F.create_map(F.lit("schedule"), F.lit(1)))).otherwise(section).alias("counts"), F.array(F.lit("1"), F.lit("6A")).alias("want_numbers"),
        F.when(i % 2 == 0, F.array(F.lit(2), F.lit(3))).otherwise(none("array<int>")).alias("depths"),
        F.when(i % 3 != 0, F.array(*map(F.lit, ("Section 1", "Part I", "Part IV", "Part 2")))).otherwise(none("array<string>")).alias("part_order"))
    return validate.unit_problems(units, rules)


@query(f"""WITH a AS ({ORACLES["parse_act_structure"]}), c AS ({ORACLES["parse_constitution_structure"]})
SELECT doc, unit_type, count(*) AS n FROM (SELECT a.doc, unit_type FROM a JOIN documents ON doc = doc_id WHERE lang = 'en' UNION ALL SELECT c.doc, unit_type FROM c JOIN documents ON doc = doc_id WHERE lang IS DISTINCT FROM 'en') GROUP BY doc, unit_type""")
def parse_by_document_type(spark, d: str) -> DataFrame:
    """Documents in English as acts, others as constitutions, each by the parser of its type."""
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    docs = table(spark, d, "documents").select(i.alias("doc"), F.when(english, act_text(t, i)).otherwise(code_text(t, i)).alias("text"), F.when(english, "act").otherwise("constitution").alias("document_type"))
    return adapters.parse_by_type(docs).groupBy("doc", "unit_type").agg(F.count("*").alias("n"))


@query(r"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS source, 'front' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'BEGIN' || chr(10) END || replace(coalesce(text, ''), '. ', '.' || chr(10) || 'Running head' || chr(10)) || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'FINIS' || chr(10) || 'index' END AS t FROM documents),
a AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN strpos(t, 'BEGIN') WHEN 1 THEN 1 ELSE 1 END AS a FROM p), b AS (SELECT *, CASE WHEN a > 0 THEN substr(t, a) END AS u FROM a),
c AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN strpos(u, 'FINIS') ELSE length(u) + 1 END AS z FROM b),
e AS (SELECT doc_id, CASE WHEN u IS NULL THEN 'no start marker' WHEN z = 0 THEN 'no end marker' END AS error, CASE WHEN z > 0 THEN substr(u, 1, z - 1) END AS v FROM c),
f AS (SELECT doc_id, error, CASE WHEN doc_id % 3 = 2 THEN regexp_replace(v, 'Running head\n', '', 'g') ELSE v END AS v FROM e)
SELECT doc_id, error, CASE WHEN error IS NULL THEN len(list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x = 'Running head')) END AS heads,
 CASE WHEN error IS NULL THEN contains(v, 'front') END AS front, CASE WHEN error IS NULL THEN contains(v, 'index') END AS tail FROM f""")
def clean_by_spec(spark, d: str) -> DataFrame:
    """Cleaning by each document's own patterns: a start, an end or a running header, by the id's remainder."""
    i = F.col("doc_id")
    text = F.concat(F.lit("front\n"), F.when(i % 5 == 0, "").otherwise("BEGIN\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\nRunning head\n")), F.lit("\n"), F.when(i % 7 == 0, "").otherwise("FINIS\nindex"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"))
    specs = docs.select("doc_id", F.when(i % 3 == 0, "BEGIN").alias("start"), F.when(i % 3 == 1, "FINIS").alias("end"), F.when(i % 3 == 2, "Running head\n").alias("header"))
    made = adapters.clean_by_document(docs, specs, "doc_id")
    heads = F.size(F.filter(F.split("clean", "\n"), lambda x: x == "Running head")).cast("long")
    return made.select("doc_id", "error", F.when(F.col("clean").isNotNull(), heads).alias("heads"), F.contains("clean", F.lit("front")).alias("front"), F.contains("clean", F.lit("index")).alias("tail"))


@query("SELECT doc_id, p, x FROM (SELECT doc_id, unnest([0, 1]) AS p, unnest([CAST(length(coalesce(text, '')) AS DOUBLE), CAST(len(string_split(coalesce(text, ''), ' ')) AS DOUBLE)]) AS x FROM documents)")
def encoded_texts(spark, d: str) -> DataFrame:
    """Texts through a pluggable encoder, here one that counts characters and spaces."""
    encode = adapters.encoder(lambda: lambda texts: [[len(t), t.count(" ") + 1] for t in texts])
    made = table(spark, d, "documents").select("doc_id", F.posexplode(encode(F.col("text"))).alias("p", "x"))
    return made


@query("""WITH r AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'no json' WHEN 1 THEN '{"verdict": "yes"}' WHEN 2 THEN '{"verdict": "yes", "sufficient": true, "statements": []}' WHEN 3 THEN '[1]' ELSE '{"statements": [], "more": {"verdict": 1}}' END AS raw FROM benchmark)
SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'no JSON object' WHEN 1 THEN 'missing sufficient,statements' WHEN 3 THEN 'no JSON object' WHEN 4 THEN 'missing sufficient,verdict' END AS error FROM r""")
def model_answers_checked(spark, d: str) -> DataFrame:
    i = F.col("item_id")
    raw = F.when(i % 5 == 0, "no json").when(i % 5 == 1, '{"verdict": "yes"}').when(i % 5 == 2, '{"verdict": "yes", "sufficient": true, "statements": []}').when(i % 5 == 3, "[1]").otherwise('{"statements": [], "more": {"verdict": 1}}')
    return validate.parsed_answers(table(spark, d, "benchmark").select("item_id", raw.alias("raw")), "raw", ["sufficient", "statements", "verdict"]).select("item_id", "error")


@query(f"""WITH r AS ({RUN_SELECT}, event_type AS suite, ts AS ts_ FROM events), p AS (SELECT run, suite, tier, ts_, CASE WHEN NOT has_scope OR tier IS NULL THEN 'x' WHEN selected_ids OR one_document OR NOT coalesce(reranked, true) OR rewrite <> pipeline_rewrite OR (rewrite AND tier >= 1 AND NOT rerank_rewrites) OR cache_hits > 0 THEN 'x' END AS refusal FROM r),
n AS (SELECT run, suite, tier FROM (SELECT *, row_number() OVER (PARTITION BY suite, tier ORDER BY ts_ DESC, run DESC) AS k FROM p WHERE refusal IS NULL) WHERE k = 1),
s AS (SELECT -1 - tier AS run, suite, tier FROM (SELECT DISTINCT event_type AS suite, unnest([0, 1, 2]) AS tier FROM events))
SELECT run, suite, tier FROM n UNION ALL SELECT run, suite, tier FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.suite = s.suite AND n.tier = s.tier)""")
def baselines_replaced(spark, d: str) -> DataFrame:
    """Stored baselines by suite and tier, replaced where a run may be promoted."""
    e = table(spark, d, "events")
    runs = e.selectExpr(*_select_list(RUN_SELECT.removeprefix("SELECT ")), "event_type suite", "ts at").withColumn("refusal", evaluate.promotion_refusal())
    stored = e.select(F.col("event_type").alias("suite")).distinct().withColumn("tier", F.explode(F.array(*[F.lit(t).cast("long") for t in range(3)]))).select((-1 - F.col("tier")).alias("run"), "suite", "tier")
    return evaluate.replace_baselines(stored, runs)


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type, event_id % 3 ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_id AS run, event_type AS suite, event_id % 3 AS tier FROM l WHERE k = 1""")
def last_runs(spark, d: str) -> DataFrame:
    runs = table(spark, d, "events").selectExpr("event_id run", "event_type suite", "event_id % 3 tier", "ts at")
    return evaluate.latest_runs(runs).select("run", "suite", "tier")


@query("""SELECT suite, count(*) AS n, count(kind) AS kinds FROM (SELECT 'product' AS suite, item_id AS id, 'advice' AS kind FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 'statutory', doc_id, NULL FROM documents) WHERE id IN (SELECT doc_id FROM documents) GROUP BY suite""")
def suites_labelled(spark, d: str) -> DataFrame:
    """Two question sets in one table, and those questions of it that are asked for by id."""
    product = table(spark, d, "benchmark").where("item_id % 3 = 0").select(F.col("item_id").alias("id"), F.lit("advice").alias("kind"))
    every = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    picked = evaluate.pick_questions(evaluate.label_suites({"product": product, "statutory": every}), every)
    return picked.groupBy("suite").agg(F.count("*").alias("n"), F.count("kind").alias("kinds"))


@query(ROUTE_SQL + """, i AS (SELECT vec_id AS id, CASE vec_id % 6 WHEN 0 THEN 'Hello!' WHEN 1 THEN 'who are you?' WHEN 2 THEN NULL ELSE 'what of it' END AS t FROM embeddings)
SELECT i.id, CASE id % 6 WHEN 0 THEN 'greeting' WHEN 1 THEN 'identity' ELSE CASE WHEN id % 7 = 0 THEN '0' ELSE CAST(intent AS VARCHAR) END END AS intent, CASE WHEN id % 6 < 2 THEN 'exact' WHEN id % 7 = 0 THEN 'default' ELSE 'centroid' END AS by FROM i JOIN r USING (id)""")
def intent_decision(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = evaluate.centroids(e.select("label", F.col("embedding").alias("v")), "label").select(F.col("label").cast("string").alias("intent"), "c")
    i = F.col("vec_id")
    said = F.when(i % 6 == 0, "Hello!").when(i % 6 == 1, "who are you?").when(i % 6 == 2, None).otherwise("what of it")
    return evaluate.decide_intent(e.select(i.alias("id"), said.alias("text"), F.when(i % 7 != 0, F.col("embedding")).alias("v")), c, "0")


@query("""WITH w AS (SELECT doc_id, source AS key FROM documents), c AS (SELECT DISTINCT source AS key FROM documents WHERE doc_id % 40 = 0)
SELECT w.key, CASE WHEN c.key IS NOT NULL THEN 'kept ' || c.key ELSE 'made ' || w.key END AS value, c.key IS NOT NULL AS hit, count(*) AS n FROM w LEFT JOIN c ON w.key = c.key GROUP BY ALL""")
def cache_filled(spark, d: str) -> DataFrame:
    """Wanted keys from a cache, misses computed once a key and added."""
    docs = table(spark, d, "documents")
    cache = docs.where("doc_id % 40 = 0").select(F.col("source").alias("key")).distinct().withColumn("value", F.concat(F.lit("kept "), F.col("key")))
    results, _ = adapters.through_cache(docs.select(F.col("source").alias("key")), cache, lambda missing: missing.select("key", F.concat(F.lit("made "), F.col("key")).alias("value")))
    return results.groupBy("key", "value", "hit").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN sha256(coalesce(text, '')) END AS key, CAST(length(coalesce(text, '')) AS VARCHAR) AS size FROM documents),
k AS (SELECT key, size, min(doc_id) AS least FROM w WHERE key IS NOT NULL GROUP BY ALL),
f AS (SELECT min(size) AS size FROM (SELECT size FROM w WHERE key IS NULL ORDER BY doc_id LIMIT 1))
SELECT doc_id, CASE WHEN w.key IS NULL THEN 'made ' || f.size WHEN k.least % 4 = 0 AND k.least % 12 <> 0 THEN CASE WHEN k.least % 8 = 0 THEN 'second ' ELSE 'first ' END || k.size ELSE 'made ' || w.size END AS value,
  w.key IS NOT NULL AND k.least % 4 = 0 AND k.least % 12 <> 0 AS hit FROM w LEFT JOIN k USING (key) CROSS JOIN f""")
def cache_stored(spark, d: str) -> DataFrame:
    """Results by the digest of a text through a stored cache: entries written twice, damaged ones, repeated and null keys."""
    docs = table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    wanted = docs.select(F.when(F.col("doc_id") % 50 != 0, F.sha2("t", 256)).alias("key"), "doc_id", F.length("t").cast("string").alias("size"))
    keys = wanted.where("key IS NOT NULL").groupBy("key", "size").agg(F.min("doc_id").alias("least")).where("least % 4 = 0")
    entry = lambda rows, name: rows.select("key", F.concat(F.lit(f"{name} "), "size").alias("value"))
    cache = store.open_store(spark, buckets=16)
    store.append(cache, entry(keys.where("least % 12 <> 0"), "first"), at=1)
    store.append(cache, entry(keys.where("least % 8 = 0 AND least % 12 <> 0"), "second"), at=2)
    damaged = entry(keys.where("least % 12 = 0"), "damaged").select("key", "value", F.lit(3).cast("long").alias("at"), F.lit("").alias("proof"))
    damaged.write.mode("append").format("parquet").bucketBy(cache.buckets, "key").sortBy("key").option("path", cache.path).saveAsTable(cache.table)
    made = store.through_store(wanted, cache, lambda missing: missing.select("key", F.concat(F.lit("made "), "size").alias("value")))
    return made.select("doc_id", "value", "hit")


@query("""WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), p AS (SELECT doc_id, l, unnest(range(0, CAST((len(l) - 1) // 30 AS BIGINT) + 1)) AS k FROM x),
t AS (SELECT doc_id, k, array_to_string(l[k * 30 + 1 : k * 30 + 30], chr(10)) AS page FROM p)
SELECT doc_id, md5(string_agg(chr(10) || '--- PAGE ' || (k + 1) || ' ---' || chr(10) || chr(10) || page, chr(10) ORDER BY k)) AS digest, count(*) AS pages FROM t GROUP BY doc_id""")
def pdf_pages(spark, d: str) -> DataFrame:
    """Documents as PDF files of 30 lines a page, their pages read back and put together under markers."""
    lines = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    docs = lines.select("doc_id", pdf.pdf_of(pdf.paged(F.col("lines"), 30)).alias("content"))
    pages = pdf.read_pages(docs, "doc_id")
    sure = pages.withColumn("page", F.when(F.col("error").isNull(), F.col("page")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "error"))))
    whole = io.pages_to_text(sure, "path", "page", "text")
    return whole.select(F.col("path").cast("long").alias("doc_id"), F.md5("text").alias("digest"), F.col("pages").cast("long").alias("pages"))


@query("""WITH b AS (SELECT item_id, text, 'suite' || (item_id % 3) AS suite FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY item_id) - 1 AS row FROM b)
SELECT suite, row, 'q' || item_id AS id, CASE WHEN item_id % 5 <> 0 THEN md5(text) END AS question, CASE WHEN item_id % 7 <> 0 THEN item_id % 2 = 0 END AS answerable, CASE WHEN item_id % 4 <> 0 THEN item_id % 4 END AS expected,
  CASE WHEN item_id % 5 = 0 AND item_id % 7 = 0 THEN 'question is missing; answerable is no boolean' WHEN item_id % 5 = 0 THEN 'question is missing' WHEN item_id % 7 = 0 THEN 'answerable is no boolean' END AS error FROM r
UNION ALL SELECT 'suite9', NULL, NULL, NULL, NULL, NULL, 'unreadable: ParserError'""")
def yaml_suites(spark, d: str) -> DataFrame:
    """Question sets written as YAML files, one of them broken, read back with what is wrong with each entry."""
    path = stored.new_path(spark, "suites")
    b = table(spark, d, "benchmark")
    i = F.col("item_id")
    answerable = F.when(i % 7 == 0, F.lit('"perhaps"')).otherwise((i % 2 == 0).cast("string"))
    fields = F.to_json(F.struct(F.concat(F.lit("q"), i.cast("string")).alias("id"), F.when(i % 5 != 0, F.col("text")).alias("question"), F.when(i % 4 != 0, F.array_repeat(F.lit("chunk"), (i % 4).cast("int"))).alias("expect_any_of")))
    entry = F.concat(F.lit("- "), F.regexp_replace(fields, r"\}$", ""), F.lit(', "answerable": '), answerable, F.lit("}"))
    lines = b.select(F.concat(F.lit("suite"), (i % 3).cast("string")).alias("suite"), i.alias("at"), entry.alias("line"))
    heads = lines.select("suite").distinct().select("suite", F.lit(-1).cast("long").alias("at"), F.lit("questions:").alias("line"))
    broken = spark.range(1).select(F.lit("suite9").alias("suite"), F.lit(0).cast("long").alias("at"), F.lit("questions: [{").alias("line"))
    lines.unionByName(heads).unionByName(broken).repartition("suite").sortWithinPartitions("suite", "at").select("suite", "line").write.partitionBy("suite").text(path)
    read = io.read_yaml_lists(spark, path, "id string, question string, answerable boolean, expect_any_of array<string>", "questions", ("id", "question", "answerable"))
    return read.select("suite", F.col("row").cast("long").alias("row"), "id", F.md5("question").alias("question"), "answerable", F.when(F.col("expect_any_of").isNotNull(), F.size("expect_any_of")).cast("long").alias("expected"), "error")


@query("""WITH r AS (SELECT lang, source, doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS size FROM documents),
u AS (SELECT lang, source, doc_id, -size AS size FROM r WHERE doc_id % 97 = 0 OR source = 'src2')
SELECT lang, source, doc_id, size FROM r WHERE source IS DISTINCT FROM 'src3' AND NOT EXISTS (SELECT 1 FROM u WHERE u.lang IS NOT DISTINCT FROM r.lang AND u.source IS NOT DISTINCT FROM r.source)
UNION ALL SELECT * FROM u WHERE source IS DISTINCT FROM 'src3'""")
def snapshot_upserts(spark, d: str) -> DataFrame:
    """Documents in a table of versions: written, some groups replaced, one deleted, compacted and read."""
    rows = table(spark, d, "documents").select("lang", "source", F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    t = snapshots.Table(spark, stored.new_path(spark, "snapshots"), ("lang", "source"), "lang string, source string, doc_id long, size long")
    t.upsert(rows)
    t.upsert(rows.where("doc_id % 97 = 0 OR source = 'src2'").withColumn("size", -F.col("size")))
    t.delete(rows.where("source = 'src3'"))
    return t.read(t.compact())


@query("""WITH x AS (SELECT item_id, item_id % 8 AS k, text FROM benchmark), e AS (SELECT *, CASE k WHEN 4 THEN 'statements is no array' WHEN 5 THEN 'a claim of qualifications is no object' WHEN 6 THEN 'missing verdict,missing' WHEN 7 THEN 'no JSON object' END AS error FROM x)
SELECT item_id, error, CASE WHEN error IS NULL THEN k <> 2 END AS sufficient, CASE WHEN error IS NULL THEN CASE k WHEN 2 THEN 'True' WHEN 3 THEN 'None' ELSE 'see ' || item_id END END AS missing,
  CASE WHEN error IS NULL THEN md5(trim(substr(text, 11, 60), ' ' || chr(10))) END AS first_quote, CASE WHEN error IS NULL THEN CASE WHEN k = 3 THEN '12.5' ELSE 'c-' || item_id END END AS first_chunk,
  CASE WHEN error IS NULL THEN 1 + item_id % 3 END AS statements, CASE WHEN error IS NULL THEN CASE WHEN k = 1 THEN 1 ELSE 0 END END AS qualifications FROM e""")
def model_answers_parsed(spark, d: str) -> DataFrame:
    """Answers as a model might give them, made of every item's text: sound ones, other types, claims of the wrong form, and broken JSON."""
    i, k = F.col("item_id"), F.col("item_id") % 8
    name = F.concat(F.lit("c-"), i.cast("string"))
    claim = F.to_json(F.struct(F.substring("text", 1, 40).alias("text"), name.alias("chunk_id"), F.concat(F.lit(" "), F.substring("text", 11, 60), F.lit("\n")).alias("quote")))
    claim = F.when(k == 3, F.replace(claim, F.concat(F.lit('"'), name, F.lit('"')), F.lit("12.5"))).otherwise(claim)
    many = F.concat(F.lit("["), F.array_join(F.array_repeat(claim, (i % 3 + 1).cast("int")), ","), F.lit("]"))
    parts = F.concat(
        F.lit('{"question_type": "polar", "sufficient": '), F.when(k == 1, '"yes"').when(k == 2, "0").otherwise("true"), F.lit(', "statements": '), F.when(k == 4, '"none"').otherwise(many),
        F.lit(', "qualifications": '), F.when(k == 1, '[{"text": "but"}]').when(k == 5, '["x"]').otherwise("[]"),
        F.when(k == 6, "").otherwise(F.concat(F.lit(', "verdict": "yes", "missing": '), F.when(k == 2, "true").when(k == 3, "null").otherwise(F.concat(F.lit('" see '), i.cast("string"), F.lit(' "'))))), F.when(k == 7, "").otherwise("}"))
    made = validate.answers_from_json(table(spark, d, "benchmark").select("item_id", parts.alias("raw")), "raw")
    return made.select("item_id", "error", "sufficient", "missing", F.md5(F.col("statements")[0]["quote"]).alias("first_quote"), F.col("statements")[0]["chunk_id"].alias("first_chunk"), F.when(F.col("error").isNull(), F.size("statements")).cast("long").alias("statements"), F.when(F.col("error").isNull(), F.size("qualifications")).cast("long").alias("qualifications"))


@query(CHUNK_SQL + """ SELECT c.chunk_id, c.document_id, CASE WHEN doc_id % 2 = 0 THEN 'act' ELSE 'constitution' END AS document_type, source AS title, 'here' AS jurisdiction, lang AS language, '2024' AS version, '2020-01-01' AS effective_from,
  CASE WHEN doc_id % 3 = 0 THEN '2023-12-31' END AS effective_to, doc_id % 3 <> 0 AS in_force, '2024-05-01' AS as_at, 'gazette' AS source_name, 'https://example.org/' || doc_id AS source_url, 'section' AS unit_type, CAST(doc_id AS VARCHAR) AS unit_number, 'Title ' || doc_id AS unit_title,
  'Part 1/Section ' || doc_id AS path, 'Part 1 — Section ' || doc_id AS citation, part, part_count, md5(content) AS content FROM c JOIN documents ON document_id = 'doc-' || doc_id""")
def chunk_rows(spark, d: str) -> DataFrame:
    """Chunks with all 21 fields of their document, unit and place."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").withColumns({"document_id": F.concat(F.lit("doc-"), i.cast("string")), "version": F.lit("2024")})
    registry = docs.select("document_id", "version", F.when(i % 2 == 0, "act").otherwise("constitution").alias("document_type"), F.col("source").alias("title"), F.lit("here").alias("jurisdiction"), F.col("lang").alias("language"), F.lit("2020-01-01").alias("effective_from"), F.when(i % 3 == 0, "2023-12-31").alias("effective_to"), (i % 3 != 0).alias("in_force"), F.lit("gazette").alias("source_name"), F.concat(F.lit("https://example.org/"), i.cast("string")).alias("source_url"))
    units = docs.select("document_id", "version", F.lit("section").alias("unit_type"), i.cast("string").alias("unit_number"), F.concat(F.lit("Title "), i.cast("string")).alias("unit_title"), F.array(F.lit("Part 1"), F.concat(F.lit("Section "), i.cast("string"))).alias("path"), "text")
    rows = chunk.chunk_rows(units, registry, F.lit("2024-05-01"))
    return rows.withColumns({"path": F.array_join("path", "/"), "part": F.col("part").cast("long"), "part_count": F.col("part_count").cast("long"), "content": F.md5("content")})


@query("""WITH a AS (SELECT DISTINCT 'd-' || CAST(item_id * 37 AS VARCHAR) AS chunk_id FROM benchmark) SELECT 'd-' || doc_id AS chunk_id, CAST(length(coalesce(text, '')) AS BIGINT) AS size, (SELECT count(*) FROM documents) AS stored FROM documents WHERE 'd-' || doc_id IN (SELECT chunk_id FROM a)""")
def chunk_lookup(spark, d: str) -> DataFrame:
    """Passages that cases cite, looked up in a table sorted by id; the table's rows are counted from its list of files."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("chunk_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    path = stored.new_path(spark, "chunks")
    lookup.write_sorted(docs, path, "chunk_id")
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("d-"), (F.col("item_id") * 37).cast("string")).alias("c")).distinct().limit(lookup.MOST + 1).collect()
    return lookup.look_up(spark, path, "chunk_id", [r["c"] for r in asked]).withColumn("stored", F.lit(lookup.count(spark, path)))


@query(E_SQL + _top_sql("t", "true", 30) + " SELECT qid, cid, rk AS pos FROM t WHERE rk <= 5")
def top_k_unranked(spark, d: str) -> DataFrame:
    """The first five of each query as retrieved, without reranking."""
    return validate.first_k(_candidates(spark, d), "qid", "pos").select("qid", "cid", "pos")


@query("""SELECT document_id, version, status, chunk_count, raw_sha256, cleaned_sha256 FROM (SELECT 'doc-' || doc_id AS document_id, '2024' AS version, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN 'processed' ELSE 'empty' END AS status, sha256(coalesce(text, '')) AS raw_sha256, sha256(replace(coalesce(text, ''), '. ', '.')) AS cleaned_sha256 FROM documents)
 LEFT JOIN (SELECT document_id AS d_, count(*) AS n_ FROM (""" + CHUNK_SQL + """ SELECT document_id FROM c) GROUP BY 1) ON document_id = d_, LATERAL (SELECT coalesce(n_, 0) AS chunk_count)""")
def metadata_manifest(spark, d: str) -> DataFrame:
    t = F.col("text")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.lit("2024").alias("version"), t.alias("raw"), t.alias("extracted"), F.replace(t, F.lit(". "), F.lit(".")).alias("cleaned"))
    made = io.metadata_manifest(docs, chunk.build_chunks(_units(spark, d)))
    return made.select("document_id", "version", "processing.status", "processing.chunk_count", "checksums.raw_sha256", "checksums.cleaned_sha256")


@query(SPARSE_SQL + """ SELECT qid, list(DISTINCT 'c' || cid ORDER BY 'c' || cid)[1] AS first_cited, count(*) AS considered, CAST(sum(length(substr(coalesce(text, ''), 1, 800))) AS BIGINT) AS shown, count(DISTINCT source) AS documents FROM o JOIN documents ON cid = doc_id WHERE rk <= 5 GROUP BY qid""")
def answer_responses(spark, d: str) -> DataFrame:
    """Responses with their sources, from retrieved passages in order."""
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("cid"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("title"), "text")
    found = _sparse(spark, d, search.SPARSE_K).join(passages, "cid").withColumn("content", T.excerpt(F.coalesce("text", F.lit("")), 800))
    claim = F.struct(F.col("chunk_id").alias("text"), "chunk_id")
    answers = found.groupBy("qid").agg(F.collect_list(claim).alias("statements"), F.collect_list(grounding.source_of(found.columns)).alias("considered"))
    none = F.array().cast("array<struct<text:string,chunk_id:string>>")
    made = answers.select("qid", grounding.response(F.lit("LEGAL"), F.lit(""), F.lit(True), F.col("statements"), none, none, F.col("considered")).alias("r"))
    size = F.aggregate(F.transform("r.considered", lambda x: F.length(x["content"])), F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("qid", F.array_min(grounding.cited_ids(F.col("r.statements"), none)).alias("first_cited"), F.size("r.considered").cast("long").alias("considered"), size.alias("shown"), F.size(F.array_distinct(F.transform("r.considered", lambda x: x["document"]))).cast("long").alias("documents"))


@query("""WITH c AS (SELECT item_id AS "case", unnest(['c-' || item_id, 'c-' || (item_id * 7)]) AS cite FROM benchmark), k AS (SELECT 'c-' || doc_id AS cite FROM documents WHERE doc_id % 3 <> 0)
SELECT "case", cite, cite IN (SELECT cite FROM k) AS known FROM c""")
def case_cites_checked(spark, d: str) -> DataFrame:
    """Citations of judged cases, and which of them the corpus lacks."""
    name = lambda c: F.concat(F.lit("c-"), c.cast("string"))
    cites = table(spark, d, "benchmark").select(F.col("item_id").alias("case"), F.explode(F.array(name(F.col("item_id")), name(F.col("item_id") * 7))).alias("cite"))
    kept, unknown = validate.known_only(cites, table(spark, d, "documents").where("doc_id % 3 <> 0").select(name(F.col("doc_id")).alias("cite")), "cite")
    lost = cites.join(unknown, "cite", "left_semi").select("case", "cite")
    return kept.withColumn("known", F.lit(True)).unionByName(lost.withColumn("known", F.lit(False)))


@query(RESULT_SQL + """, q AS (SELECT item_id AS id, 'bench' AS own FROM benchmark WHERE item_id % 2 = 0)
SELECT coalesce(own, 'statutory') AS suite, count(*) AS n, count(*) FILTER (retrieval_hit) AS hits FROM r LEFT JOIN q USING (id) GROUP BY 1""")
def suite_tags(spark, d: str) -> DataFrame:
    """Results under the suite of their question, or the default one."""
    q = table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.lit("bench").alias("suite"))
    return evaluate.tag_suites(_results(spark, d).drop("suite"), q).groupBy("suite").agg(F.count("*").alias("n"), F.count_if("retrieval_hit").alias("hits"))


@query("""SELECT doc_id, regexp_replace('/data/' || coalesce(source, '') || '/x.json', '^/data/', '') AS path, CAST(greatest(0.0, doc_id % 7 - 3.5) AS DOUBLE) AS active, regexp_matches(lower(trim(CASE doc_id % 4 WHEN 0 THEN ' O1-mini' WHEN 1 THEN 'gpt' WHEN 2 THEN 'o' ELSE 'o3' END)), '^o[0-9]') AS reasoning FROM documents""")
def small_rules(spark, d: str) -> DataFrame:
    """Paths under a root, activations of a linear head, and names of reasoning models."""
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, " O1-mini").when(i % 4 == 1, "gpt").when(i % 4 == 2, "o").otherwise("o3")
    return table(spark, d, "documents").select("doc_id", T.relative_path(F.concat(F.lit("/data/"), F.coalesce("source", F.lit("")), F.lit("/x.json")), "/data/").alias("path"), V.relu(i % 7 - 3.5).alias("active"), T.is_reasoning_model(name).alias("reasoning"))


@query("""WITH f AS (SELECT l_orderkey AS doc, l_returnflag AS unit_type, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT o_orderkey AS doc, unnest(['A', 'N', 'R']) AS unit_type, o_orderkey % 3 AS expected FROM orders)
SELECT e.doc, e.unit_type, expected, coalesce(n, 0) AS found FROM e LEFT JOIN f ON e.doc = f.doc AND e.unit_type = f.unit_type WHERE expected <> coalesce(n, 0)""")
def structure_counts(spark, d: str) -> DataFrame:
    units = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("unit_type"))
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("unit_type"), (F.col("o_orderkey") % 3).alias("expected"))
    return structure.count_errors(units, wanted)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def event_windows(spark, d: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, d, "events"))
