"""Search over vectors and texts, and the graph of facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import quantised
from ..operators import graph as G
from ..operators import retrieval as S
from ..operators import tables as R
from ..operators.analytics import ontology_summary
from ..operators.tables import first_wins
from ..session import Workspace, state_of
from . import views as V
from .views import sql

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return keep


#: Vector queries are the rows whose id is divisible by 50, against all rows.
_KNN = """vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, c.label, list_dot_product(q.u, c.u) AS cosine FROM unit q JOIN unit c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM near)"""


def _queries(s, d):
    return V.vectors(s, d).where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "embedding")


def _near(s, d, k=10, least=None):
    return S.knn(_queries(s, d), V.vectors(s, d).select("item_id", "embedding"), k, least=least)


@query("v2_knn", sql("SELECT query_id, item_id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10", _KNN))
def _(s, d):
    return _near(s, d).withColumn("cosine", F.round("cosine", 6))


@query("v2_knn_post_filter", sql("SELECT query_id, item_id, label FROM top WHERE rank <= 20 AND label < 3", _KNN))
def _(s, d):
    return S.post_filtered(_near(s, d, 20), V.vectors(s, d).select("item_id", "label"), "item_id", F.col("label") < 3).select("query_id", "item_id", "label")


@query("v10_knn_pre_filter", sql("SELECT query_id, item_id FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM near WHERE label < 3) WHERE r <= 5", _KNN))
def _(s, d):
    return S.knn(_queries(s, d), V.vectors(s, d).where("label < 3").select("item_id", "embedding"), 5).select("query_id", "item_id")


@query("v8_multi_concept", sql("SELECT label, round(avg(best), 6) AS score FROM (SELECT label, query_id, max(cosine) AS best FROM top WHERE rank <= 50 AND query_id IN (0, 50, 100) GROUP BY ALL) GROUP BY label HAVING count(*) = 3", _KNN))
def _(s, d):
    q = _queries(s, d).where(F.col("query_id").isin(0, 50, 100))
    found = S.knn(q, V.vectors(s, d).select("item_id", "embedding"), 50)
    return S.multi_concept(found, V.vectors(s, d), 3, "query_id", "item_id", "label").select("label", F.round("score", 6).alias("score"))


@query("v9_two_indexes", sql("""SELECT query_id, item_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM (
  SELECT query_id, item_id, max(cosine) AS cosine FROM (SELECT query_id, item_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS a FROM near WHERE label < 6) WHERE a <= 10
  UNION ALL SELECT query_id, item_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS a FROM near WHERE label >= 4) WHERE a <= 10) GROUP BY 1, 2)) WHERE r <= 8""", _KNN))
def _(s, d):
    v = V.vectors(s, d)
    parts = [S.knn(_queries(s, d), v.where(c).select("item_id", "embedding"), 10) for c in ("label < 6", "label >= 4")]
    return S.best_of(parts, "query_id", "item_id", 8).select("query_id", "item_id", F.round("cosine", 6).alias("cosine"))


@query("v14_other_labels", sql("SELECT query_id, t.label, count(*) AS hits FROM top t JOIN vec q ON q.vec_id = t.query_id WHERE rank <= 30 AND t.label <> q.label GROUP BY ALL", _KNN))
def _(s, d):
    v = V.vectors(s, d)
    own = v.select(F.col("item_id").alias("query_id"), F.col("label").alias("own"))
    return _near(s, d, 30).join(v.select("item_id", "label"), "item_id").join(own, "query_id").where("label != own").groupBy("query_id", "label").agg(F.count("*").alias("hits"))


@query("v16_repeats", sql("SELECT query_id, item_id, round(cosine, 6) AS cosine FROM top WHERE rank <= 3 AND cosine >= 0.35", _KNN))
def _(s, d):
    return _near(s, d, 3, 0.35).select("query_id", "item_id", F.round("cosine", 6).alias("cosine"))


@query("v17_surprise", sql("SELECT query_id, round(least(greatest(1 - max(cosine), 0), 1), 6) AS surprise FROM near GROUP BY 1", _KNN))
def _(s, d):
    return S.surprise(_near(s, d, 1), _queries(s, d)).withColumn("surprise", F.round("surprise", 6))


@query("s12_quantised", sql("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(least(greatest(floor(x * 127 + 0.5), -127), 127) AS INTEGER)) AS q FROM embeddings"))
def _(s, d):
    return V.vectors(s, d).select(F.col("item_id").alias("vec_id"), quantised("embedding").alias("q"))


@query("v25_exchange_knn", sql("SELECT query_id, item_id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT q.id AS query_id, c.id AS item_id, list_dot_product(q.u, c.u) AS cosine, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.u, c.u) DESC, c.id) AS rank FROM unit q JOIN unit c ON CAST('0x' || substr(q.id, 1, 8) AS BIGINT) % 50 = 0 AND q.id <> c.id) WHERE rank <= 5",
 """vec AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM ex WHERE len(embedding) = 384), unit AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec WHERE list_dot_product(v, v) > 0)"""))
def _(s, d):
    """The five nearest exchanges of each whose number is divisible by 50, exactly; an id counts by its last indexed row."""
    ex = V.table(s, d, "exchanges").withColumn("id", V.norm_id("id")).where("id is not null").select("id", "last_indexed", "embedding")
    ex = R.latest(ex, ["id"], [F.desc_nulls_last("last_indexed")]).where("size(embedding) = 384").select("id", "embedding")
    q = ex.where(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 50 == 0).select(F.col("id").alias("query_id"), "embedding")
    return S.knn(q, ex.withColumnRenamed("id", "item_id"), 5).withColumn("cosine", F.round("cosine", 6))


_TEXT = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents),
lens AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY 1), post AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT query_id, token, df, place FROM (SELECT p.doc_id AS query_id, p.token, df.df, row_number() OVER (PARTITION BY p.doc_id ORDER BY df.df, p.token) AS place FROM post p JOIN df USING (token) WHERE p.doc_id % 50 = 0 AND df.df > 1) WHERE place <= 4)"""


def _index(s, d):
    """The index of the documents, kept as long as the table is as it is."""
    return S.text_index(state_of(s, f"{d}/documents.parquet"), lambda: S.TextIndex(V.documents(s, d), Workspace(s, "index"), "doc_id", "text"))


def _rare(s, d, ix):
    """Of each document whose id is divisible by 50 the four rarest words that occur elsewhere too, with how many documents they occur in."""
    q = ix.post.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "token").join(ix.frequency.where("df > 1"), "token")
    w = Window.partitionBy("query_id").orderBy("df", "token")
    return q.withColumn("place", F.row_number().over(w)).where("place <= 4").select("query_id", "token", "df")


@query("v4_bm25", sql("""SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT query_id, p.doc_id, sum(ln(1 + ((SELECT count(*) FROM lens) - q.df + 0.5) / (q.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (SELECT avg(len) FROM lens)))) AS score FROM qt q JOIN post p USING (token) JOIN lens l ON l.doc_id = p.doc_id GROUP BY 1, 2)) WHERE rank <= 10""", _TEXT))
def _(s, d):
    ix = _index(s, d)
    return S.bm25(_rare(s, d, ix), ix.post, ix.docs, ix.mean_len, "doc_id", df=ix.frequency).select("query_id", "doc_id", "rank")


@query("v4_bm25_all_words", sql("""SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT q.doc_id AS query_id, p.doc_id, sum(ln(1 + ((SELECT count(*) FROM lens) - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * len / (SELECT avg(len) FROM lens)))) AS score FROM post q JOIN df USING (token) JOIN post p USING (token) JOIN lens l ON l.doc_id = p.doc_id WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)) WHERE rank <= 10""", _TEXT))
def _(s, d):
    """The same with all words of each query text, frequent ones too."""
    ix = _index(s, d)
    q = ix.post.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "token")
    return S.bm25(q, ix.post, ix.docs, ix.mean_len, "doc_id", df=ix.frequency).select("query_id", "doc_id", "rank")


@query("v4_all_tokens", sql("SELECT h.query_id, h.doc_id FROM (SELECT query_id, doc_id, count(*) AS n FROM qt JOIN post USING (token) GROUP BY 1, 2) h JOIN (SELECT query_id, count(*) AS n FROM qt GROUP BY 1) w ON w.query_id = h.query_id AND w.n = h.n", _TEXT))
def _(s, d):
    ix = _index(s, d)
    return S.bm25(_rare(s, d, ix), ix.post, 1, 1.0, "doc_id", k=2**31 - 1, all_tokens=True, df=ix.frequency).select("query_id", "doc_id")


@query("v5_rarest_ladder", sql("""SELECT query_id, doc_id, rung FROM (SELECT query_id, doc_id, rung, row_number() OVER (PARTITION BY query_id ORDER BY rung DESC, doc_id) AS r FROM (
  SELECT query_id, p.doc_id, CAST(CASE WHEN bool_or(place = 1) THEN CASE WHEN bool_or(place = 2) THEN CASE WHEN bool_or(place = 3) THEN CASE WHEN bool_or(place = 4) THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END ELSE 0 END AS INTEGER) AS rung FROM qt JOIN post p USING (token) GROUP BY 1, 2) WHERE rung > 0) WHERE r <= 20""", _TEXT))
def _(s, d):
    ix = _index(s, d)
    return S.rarest_ladder(_rare(s, d, ix), ix.post, "doc_id", df=ix.frequency).select("query_id", "doc_id", "rung")


@query("v7_hybrid", sql("""SELECT query_id, doc_id AS item_id, match FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pass) AS r FROM (
  SELECT query_id, item_id AS doc_id, 'vector' AS match, 0 AS pass FROM top WHERE rank <= 5
  UNION ALL SELECT query_id, doc_id, 'text', 1 FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
    SELECT query_id, p.doc_id, sum(ln(1 + ((SELECT count(*) FROM lens) - q.df + 0.5) / (q.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (SELECT avg(len) FROM lens)))) AS score FROM qt q JOIN post p USING (token) JOIN lens l ON l.doc_id = p.doc_id GROUP BY 1, 2)) WHERE rank <= 5)) WHERE r = 1""", _KNN + ", " + _TEXT))
def _(s, d):
    ix = _index(s, d)
    text = S.bm25(_rare(s, d, ix), ix.post, ix.docs, ix.mean_len, "doc_id", k=5, df=ix.frequency).withColumnRenamed("doc_id", "item_id")
    return S.hybrid(_near(s, d, 5), text, "query_id", "item_id").select("query_id", "item_id", "match")


@query("v20_provenance", sql("SELECT f.id, CAST(s.place AS INTEGER) AS place, e.id AS exchange_id, e.project, e.timestamp FROM (SELECT id, unnest(CAST(src AS VARCHAR[])) AS x, generate_subscripts(CAST(src AS VARCHAR[]), 1) - 1 AS place FROM facts) s JOIN facts f ON f.id = s.id JOIN ex e ON e.id = s.x"))
def _(s, d):
    return G.provenance(V.facts(s, d), V.exchange_meta(s, d))


@query("g3_relations_of_facts", sql("SELECT id, other, relation_type, CAST(incoming AS INTEGER) AS incoming FROM (SELECT source_id AS id, target_id AS other, relation_type, 0 AS incoming FROM edges UNION ALL SELECT target_id, source_id, relation_type, 1 FROM edges)"))
def _(s, d):
    return G.neighbours(V.edges(s, d)).select("id", "other", "relation_type", "incoming")


_STEP = """step AS (SELECT id, other, relation_type, created_at, incoming, CASE relation_type WHEN 'CONTRADICTS' THEN 0 WHEN 'SUPERSEDES' THEN 1 WHEN 'SUPPORTS' THEN 2 ELSE 3 END AS place FROM (
  SELECT source_id AS id, target_id AS other, relation_type, created_at, 0 AS incoming FROM edges UNION ALL SELECT target_id, source_id, relation_type, created_at, 1 FROM edges) WHERE other IN (SELECT id FROM facts WHERE is_active)),
seed AS (SELECT id AS seed, id FROM facts WHERE is_active AND CAST('0x' || substr(id, 1, 8) AS BIGINT) % 50 = 0)"""
_HOP = """h{n} AS (SELECT seed, other AS id, {n} AS hop, relevance, relation_type FROM (SELECT f.seed, t.other, t.relation_type, {base} * CASE WHEN t.relation_type IN ('CONTRADICTS', 'SUPERSEDES') THEN 0.7 ELSE 1.0 END AS relevance,
  row_number() OVER (PARTITION BY f.seed, t.other ORDER BY t.id, t.incoming, t.place, t.created_at NULLS FIRST, t.relation_type) AS r FROM {prev} f JOIN step t ON t.id = f.id
  WHERE {base} * CASE WHEN t.relation_type IN ('CONTRADICTS', 'SUPERSEDES') THEN 0.7 ELSE 1.0 END >= 0.2 AND NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.seed = f.seed AND s.id = t.other)) WHERE r = 1)"""
_HOPS = ", ".join([
    _STEP, _HOP.format(n=1, base=1.0, prev="seed", seen="seed"), "s1 AS (SELECT seed, id FROM seed UNION ALL SELECT seed, id FROM h1)",
    _HOP.format(n=2, base=0.6, prev="h1", seen="s1"), "s2 AS (SELECT seed, id FROM s1 UNION ALL SELECT seed, id FROM h2)", _HOP.format(n=3, base=0.36, prev="h2", seen="s2"),
])


def _seeds(s, d):
    return V.facts(s, d).where(F.col("is_active") & (F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 50 == 0)).select("id")


for _n in (1, 2, 3):

    def _related(s, d, n=_n):
        return G.related(_seeds(s, d), V.edges(s, d), V.facts(s, d), Workspace(s, "related"), hops=n).select("seed", "id", "hop", "relevance", "relation_type")

    query(f"g1_related_{_n}_hops", sql(" UNION ALL ".join(f"SELECT seed, id, CAST(hop AS INTEGER) AS hop, round(CAST(relevance AS DOUBLE), 6) AS relevance, relation_type FROM h{k}" for k in range(1, _n + 1)), _HOPS))(_related)


@query("g4_new_edges", sql("""SELECT DISTINCT target_id AS source_id, relation_type, source_id AS target_id FROM edges e WHERE relation_type NOT IN ('SUPPORTS', 'CONTRADICTS')
AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.source_id = e.target_id AND x.target_id = e.source_id AND x.relation_type = e.relation_type)"""))
def _(s, d):
    """Every edge proposed the other way round: kinds without direction are there already."""
    e = V.edges(s, d)
    turned = e.select(F.col("target_id").alias("source_id"), "relation_type", F.col("source_id").alias("target_id"))
    return G.new_edges(e, turned).select("source_id", "relation_type", "target_id")


@query("a22_edge_duplicates", sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_fact_id, relation_type_before, target_fact_id ORDER BY id) AS r FROM log WHERE source_fact_id IS NOT NULL AND target_fact_id IS NOT NULL) WHERE r > 1"))
def _(s, d):
    e = V.log(s, d).where("source_fact_id is not null and target_fact_id is not null").select("id", F.col("source_fact_id").alias("source_id"), F.col("relation_type_before").alias("relation_type"), F.col("target_fact_id").alias("target_id"))
    return G.edge_duplicates(e, "id").select("id")


@query("a12_consistency", sql("""SELECT a.active, c.contradicts, p.supersedes, o.orphans, s.single_fact_categories, round(CASE WHEN a.active > 0 THEN o.orphans / a.active ELSE 0.0 END, 6) AS orphan_rate FROM (SELECT count(*) AS active FROM facts WHERE is_active) a,
(SELECT count(*) AS contradicts FROM edges WHERE relation_type = 'CONTRADICTS' AND source_id IN (SELECT id FROM facts WHERE is_active) AND target_id IN (SELECT id FROM facts WHERE is_active)) c,
(SELECT count(*) AS supersedes FROM edges WHERE relation_type = 'SUPERSEDES' AND source_id IN (SELECT id FROM facts WHERE is_active) AND target_id IN (SELECT id FROM facts WHERE is_active)) p,
(SELECT count(*) AS orphans FROM facts WHERE is_active AND id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)) o,
(SELECT count(*) AS single_fact_categories FROM (SELECT category_id FROM facts WHERE is_active AND category_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1)) s"""))
def _(s, d):
    return G.consistency_counts(V.facts(s, d), V.edges(s, d))


@query("j3_conflicts", sql("SELECT source_id, target_id, a.fact AS source_fact, b.fact AS target_fact FROM edges JOIN facts a ON a.id = source_id AND a.is_active JOIN facts b ON b.id = target_id AND b.is_active WHERE relation_type = 'CONTRADICTS'"))
def _(s, d):
    return G.active_pairs(V.edges(s, d), V.facts(s, d), "CONTRADICTS").select("source_id", "target_id", "source_fact", "target_fact")


@query("j6_orphans", sql("SELECT id FROM facts WHERE is_active AND id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)"))
def _(s, d):
    return G.orphans(V.facts(s, d), V.edges(s, d)).select("id")


@query("j5_ontology_summary", sql("SELECT domain_id, c.category_id, count(f.id) AS facts FROM cats c LEFT JOIN facts f ON f.category_id = c.category_id AND f.is_active GROUP BY ALL"))
def _(s, d):
    return ontology_summary(V.facts(s, d), V.categories(s, d))


@query("g7_ontology_tree", sql("SELECT domain_id, list({'category_id': category_id, 'facts': facts} ORDER BY category_id) AS categories FROM (SELECT domain_id, c.category_id, count(f.id) AS facts FROM cats c LEFT JOIN facts f ON f.category_id = c.category_id AND f.is_active GROUP BY ALL) GROUP BY 1"))
def _(s, d):
    return G.ontology_tree(V.facts(s, d), V.categories(s, d))


@query("w8_latest_decisions", sql("SELECT relation_id, arg_max(id, id) AS id, arg_max(action, id) AS action, arg_max(verdict, id) AS verdict FROM log GROUP BY 1"))
def _(s, d):
    return G.latest_decisions(V.log(s, d)).select("relation_id", "id", "action", "verdict")


@query("src16_tombstones", sql("""SELECT source_fact_id, target_fact_id, relation_type_before, action FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY source_fact_id, target_fact_id, relation_type_before ORDER BY id DESC) = 1) l LEFT JOIN facts a ON a.id = l.source_fact_id LEFT JOIN facts b ON b.id = l.target_fact_id
WHERE action IN ('delete', 'retype') AND (l.source_fact IS NULL OR a.fact IS NULL OR l.source_fact = a.fact) AND (l.target_fact IS NULL OR b.fact IS NULL OR l.target_fact = b.fact)"""))
def _(s, d):
    return G.tombstoned(V.log(s, d), V.facts(s, d))


@query("g14_merge_candidates", sql("""SELECT CASE WHEN bn > an THEN b ELSE a END AS keep, CASE WHEN bn > an THEN a ELSE b END AS drop, round(cosine, 6) AS cosine, ad = bd AS same_domain FROM (
 SELECT m.a, m.b, m.cosine, x.n AS an, y.n AS bn, x.dom AS ad, y.dom AS bd FROM (SELECT least(query_id, item_id) AS a, greatest(query_id, item_id) AS b, max(cosine) AS cosine FROM top WHERE rank <= 5 AND cosine >= 0.3 GROUP BY 1, 2) m
 JOIN (SELECT vec_id AS id, label % 3 AS dom, vec_id % 9 AS n FROM vec) x ON x.id = m.a JOIN (SELECT vec_id AS id, label % 3 AS dom, vec_id % 9 AS n FROM vec) y ON y.id = m.b)""", _KNN))
def _(s, d):
    """Vectors stand for categories: label % 3 is the domain, id % 9 the number of facts."""
    sizes = V.vectors(s, d).select(F.col("item_id").alias("category_id"), (F.col("label") % 3).alias("domain_id"), (F.col("item_id") % 9).alias("facts"))
    return G.merge_candidates(_near(s, d, 5), sizes, 0.3).withColumn("cosine", F.round("cosine", 6))


@query("u1_first_wins", sql("SELECT item_id, pass_no FROM (SELECT item_id, pass_no, row_number() OVER (PARTITION BY item_id ORDER BY pass_no, query_id) AS r FROM (SELECT item_id, query_id, 0 AS pass_no FROM top WHERE rank <= 3 UNION ALL SELECT item_id, query_id, 1 FROM top WHERE rank BETWEEN 4 AND 10)) WHERE r = 1", _KNN))
def _(s, d):
    near = _near(s, d, 10)
    return first_wins([near.where("rank <= 3").select("item_id", "query_id"), near.where("rank > 3").select("item_id", "query_id")], ["item_id"], ["query_id"]).select("item_id", "pass_no")


QUERIES, ORACLE = Q, O
