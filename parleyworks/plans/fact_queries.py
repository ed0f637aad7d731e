"""Filters, rankings and vector statistics of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import filters as P
from ..operators import retrieval as S
from ..operators import tables as R
from ..operators.graph import WEAK, neighbours
from ..session import Workspace
from . import search_queries as SQ
from . import views as V
from .views import sql

NOW = "2026-07-01"
Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return keep


@query("filter_substantive", sql("""SELECT id FROM (SELECT id, trim(coalesce(user_message, ''), ' ') AS u, trim(coalesce(assistant_message, ''), ' ') AS a FROM ex)
WHERE NOT (u = '' OR u LIKE '<local-command-%' OR u LIKE '<command-name>%' OR u LIKE 'Caveat:%' OR regexp_matches(u, '^/[\\w:-]+$') OR (regexp_full_match(u, '(?i)(ok(ay)?|yes|no|y|n|thanks?|thank you|good|nice|great|done|go|proceed|continue)[.!~\\s]*') AND length(a) < 200) OR (length(u) < 5 AND length(a) < 80))"""))
def _(s, d):
    return V.exchanges(s, d).where(P.substantive(F.col("user_message"), F.col("assistant_message"))).select("id")


@query("filter_pollution", sql("SELECT id FROM ex WHERE coalesce(ends_with(project, '-main'), false) OR coalesce(starts_with(user_message, 'The nightly job'), false) OR (user_message = 'Warmup' AND coalesce(is_sidechain, false))"))
def _(s, d):
    return V.exchanges(s, d).where(P.pollution(F.col("project"), F.col("user_message"), F.col("is_sidechain"), "-main", ["The nightly job"])).select("id")


@query("filter_heritage", sql("SELECT id FROM facts WHERE coalesce(length(substr(created_at, 1, 10)) = 10 AND substr(created_at, 1, 10) < '2025-05-01', false) OR coalesce(len(list_filter(CAST(src AS VARCHAR[]), lambda x: starts_with(x, 'memory-doc:'))) > 0 AND regexp_matches(fact, '^(0[1-9]|10)-[a-z0-9-]+ memory\\b'), false)"))
def _(s, d):
    f = V.facts(s, d)
    return f.where(P.heritage(F.col("created_at"), F.col("fact"), F.col("source_exchange_ids"), "2025-05-01", "memory-doc:")).select("id")


@query("filter_folders", sql("SELECT id, cwd FROM ex WHERE cwd = '/work/orchard' OR starts_with(cwd, '/work/orchard/')"))
def _(s, d):
    return V.exchange_meta(s, d).where(P.under(F.col("cwd"), ["/work/orchard/"])).select("id", "cwd")


@query("a2_conditional_counts", sql("SELECT tool_name, count(*) FILTER (is_error) AS failed, count(*) FILTER (NOT is_error) AS fine, count(*) FILTER (is_error IS NULL) AS unknown, count(*) FILTER (tool_result IS NULL) AS silent FROM calls GROUP BY 1"))
def _(s, d):
    return V.calls(s, d).groupBy("tool_name").agg(F.count_if("is_error").alias("failed"), F.count_if(~F.col("is_error")).alias("fine"), F.count_if(F.col("is_error").isNull()).alias("unknown"), F.count_if(F.col("tool_result").isNull()).alias("silent"))


@query("a16_recent_prompts", sql("SELECT project, id, prompt FROM (SELECT project, id, CASE WHEN length(user_message) > 60 THEN trim(regexp_replace(substr(user_message, 1, 60), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') || '...' ELSE trim(regexp_replace(user_message, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') END AS prompt, row_number() OVER (PARTITION BY project ORDER BY timestamp DESC, id) AS r FROM ex WHERE project IS NOT NULL AND timestamp IS NOT NULL AND user_message IS NOT NULL) WHERE r <= 10"))
def _(s, d):
    ex = V.exchanges(s, d).where("project is not null and timestamp is not null and user_message is not null").select("project", "id", "timestamp", T.snippet("user_message", 60).alias("prompt"))
    return R.top_per_group(ex, ["project"], [F.desc("timestamp"), F.col("id")], 10).select("project", "id", "prompt")


@query("w4_project_quota", sql("""SELECT id, CAST(rank AS INTEGER) AS rank FROM (SELECT id, row_number() OVER (ORDER BY sure DESC, consolidated_count DESC, id) AS rank FROM (
  SELECT *, own AND row_number() OVER (PARTITION BY own ORDER BY consolidated_count DESC, id) <= 5 AS sure FROM (SELECT id, consolidated_count, coalesce(scope_project, '') IN ('/work/fjord/cli', '-work-fjord-cli') AS own FROM facts WHERE is_active))) WHERE rank <= 10"""))
def _(s, d):
    own = F.coalesce("scope_project", F.lit("")).isin("/work/fjord/cli", "-work-fjord-cli")
    f = V.facts(s, d).where("is_active").select("id", "consolidated_count", own.alias("own"))
    # the best ten of either kind are all that can win: the ranking is over those
    few = f.where("own").orderBy(F.desc("consolidated_count"), "id").limit(10).unionByName(f.where("not own").orderBy(F.desc("consolidated_count"), "id").limit(10))
    return R.with_quota(few.withColumn("g", F.lit(1)), ["g"], F.col("own"), [F.desc("consolidated_count"), F.col("id")], 10).select("id", "rank")


@query("t3_relevance", sql(f"""SELECT id, round(score, 6) AS score FROM (SELECT id, CASE WHEN consolidated_count > 0 THEN 3 * (1 + log2(consolidated_count + 1)) ELSE 3.0 END
 + CASE WHEN days <= 7 THEN 5 WHEN days <= 30 THEN 3 WHEN days <= 90 THEN 1 ELSE 0 END + CASE WHEN scope_type = 'project' THEN 2 ELSE 0 END AS score FROM (SELECT *, date_diff('day', TRY_CAST(substr(created_at, 1, 10) AS DATE), DATE '{NOW}') AS days FROM facts WHERE is_active)) ORDER BY round(score, 6) DESC, id LIMIT 25"""))
def _(s, d):
    score = F.round(P.relevance(F.col("consolidated_count"), F.col("created_at"), F.col("scope_type") == "project", NOW), 6)
    return V.facts(s, d).where("is_active").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(25)


@query("t8_new_facts", sql("SELECT id, created_at FROM facts WHERE is_active AND created_at > '2025-09-01'"))
def _(s, d):
    return V.facts(s, d).where("is_active and created_at > '2025-09-01'").select("id", "created_at")


@query("s9_canonical_scope", sql("""SELECT f.id, coalesce(m.cwd, f.scope_project) AS scope_project FROM facts f LEFT JOIN (SELECT slug, cwd FROM (SELECT regexp_replace(cwd, '[/._]', '-', 'g') AS slug, cwd, row_number() OVER (PARTITION BY regexp_replace(cwd, '[/._]', '-', 'g') ORDER BY count(*) DESC, cwd) AS r FROM ex WHERE cwd IS NOT NULL GROUP BY cwd) WHERE r = 1) m ON m.slug = f.scope_project"""))
def _(s, d):
    """Scopes stored as slugs get the path that most exchanges of that slug have."""
    seen = V.exchange_meta(s, d).select(T.path_slug("cwd").alias("scope_project"), "cwd")
    paths = A.most_frequent(seen, "scope_project", "cwd").select("scope_project", "cwd")
    return V.facts(s, d).select("id", "scope_project").join(paths, "scope_project", "left").select("id", F.coalesce("cwd", "scope_project").alias("scope_project"))


@query("s17_embedding_text", sql("SELECT id, substr('passage: ' || fact, 1, 2000) AS text FROM facts WHERE fact IS NOT NULL"))
def _(s, d):
    return V.facts(s, d).where("fact is not null").select("id", F.substring(F.concat(F.lit("passage: "), "fact"), 1, 2000).alias("text"))


@query("s23_set_hash", "SELECT lang, sha256(string_agg(line, '' ORDER BY item_id)) AS hash FROM (SELECT lang, item_id, item_id || chr(31) || text || chr(10) AS line FROM eval_items) GROUP BY 1")
def _(s, d):
    """A hash over a set that is stated as a whole, in order of its ids."""
    line = F.concat(F.col("item_id").cast("string"), F.lit("\x1f"), "text", F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("item_id", line.alias("line")))), lambda x: x["line"])
    return V.table(s, d, "eval_items").groupBy("lang").agg(F.sha2(F.array_join(lines, ""), 256).alias("hash"))


@query("j12_names_with_defaults", sql("SELECT f.id, coalesce(c.domain_id, 'Unclassified') AS domain, coalesce(f.category_id, '?') AS category_name FROM facts f LEFT JOIN cats c ON c.category_id = f.category_id"))
def _(s, d):
    return V.facts(s, d).join(V.categories(s, d), "category_id", "left").select("id", F.coalesce("domain_id", F.lit("Unclassified")).alias("domain"), F.coalesce("category_id", F.lit("?")).alias("category_name"))


@query("j13_conflicts_per_fact", sql("SELECT id, count(*) FILTER (relation_type = 'CONTRADICTS') AS contradicts, count(*) FILTER (relation_type = 'SUPERSEDES') AS supersedes FROM (SELECT source_id AS id, target_id AS other, relation_type FROM edges UNION ALL SELECT target_id, source_id, relation_type FROM edges) WHERE relation_type IN ('CONTRADICTS', 'SUPERSEDES') GROUP BY 1"))
def _(s, d):
    n = neighbours(V.edges(s, d)).where(F.col("relation_type").isin(WEAK))
    return n.groupBy("id").agg(F.count_if(F.col("relation_type") == "CONTRADICTS").alias("contradicts"), F.count_if(F.col("relation_type") == "SUPERSEDES").alias("supersedes"))


@query("src9_unprocessed_sessions", sql("SELECT DISTINCT lower(trim(sessionId, E' \\t\\r\\n\\f\\v')) AS session_id FROM short_conversation WHERE nullif(trim(sessionId, E' \\t\\r\\n\\f\\v'), '') IS NOT NULL AND lower(trim(sessionId, E' \\t\\r\\n\\f\\v')) NOT IN (SELECT lower(trim(session_id, E' \\t\\r\\n\\f\\v')) FROM ex WHERE session_id IS NOT NULL)"))
def _(s, d):
    seen = V.exchange_meta(s, d).select(V.norm_id("session_id").alias("session_id")).where("session_id is not null").distinct()
    return V.table(s, d, "short_conversation").select(V.norm_id("sessionId").alias("session_id")).where("session_id is not null").distinct().join(seen, "session_id", "left_anti")


@query("u8_cited_sessions", sql("SELECT DISTINCT e.session_id FROM (SELECT unnest(CAST(src AS VARCHAR[])) AS x FROM facts WHERE is_active) f JOIN ex e ON e.id = f.x WHERE e.session_id IS NOT NULL"))
def _(s, d):
    cited = V.facts(s, d).where("is_active").select(F.explode("source_exchange_ids").alias("id")).distinct()
    return V.exchange_meta(s, d).where("session_id is not null").join(cited, "id", "left_semi").select("session_id").distinct()


@query("s19_baseline", sql("SELECT c.vec_id, round(max(list_dot_product(c.u, q.u)), 6) AS baseline FROM unit c JOIN unit q ON q.vec_id < 8 AND c.vec_id <> q.vec_id GROUP BY 1", SQ._KNN))
def _(s, d):
    """The highest similarity of each vector to eight probes."""
    v = V.vectors(s, d).select("item_id", "embedding")
    near = S.knn(v.withColumnRenamed("item_id", "query_id"), v.where("item_id < 8"), 1)
    return near.select(F.col("query_id").alias("vec_id"), F.round("cosine", 6).alias("baseline"))


@query("v15_similar_labels", sql("""SELECT a.label AS query_id, b.label AS item_id FROM (SELECT a.label, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.m, b.m) DESC, b.label) AS r FROM cent a JOIN cent b ON a.label <> b.label) x JOIN cent a ON a.label = x.label JOIN cent b ON b.label = x.other WHERE r <= 3""",
    SQ._KNN + ", flat AS (SELECT label, i, avg(v[i]) AS m FROM vec, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL), cent AS (SELECT label, list(m ORDER BY i) AS m FROM flat GROUP BY 1)"))
def _(s, d):
    """The three labels whose mean vectors are nearest to each label's."""
    flat = V.vectors(s, d).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("embedding"))
    return S.knn(means.withColumnRenamed("label", "query_id"), means.withColumnRenamed("label", "item_id"), 3).select("query_id", "item_id")


@query("v18_surprise_quantiles", sql("SELECT p AS point, round(v[1 + least(len(v) - 1, CAST(floor(p * len(v)) AS BIGINT))], 6) AS value FROM (SELECT list(s ORDER BY s) AS v FROM (SELECT 1 - max(cosine) AS s FROM near GROUP BY query_id)), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p)", SQ._KNN))
def _(s, d):
    found = S.surprise(SQ._near(s, d, 1), SQ._queries(s, d))
    return A.quantiles(found, "surprise", [0.0, 0.25, 0.5, 0.75, 1.0], Workspace(s, "v18")).withColumn("value", F.round("value", 6))


@query("f2_surprise_in_order", sql("""SELECT query_id, round(least(greatest(1 - max(cosine), 0), 1), 6) AS surprise FROM near WHERE item_id % 50 <> 0 OR item_id < query_id GROUP BY 1""", SQ._KNN))
def _(s, d):
    """The rows whose id is divisible by 50 added one by one to the others."""
    corpus = V.vectors(s, d).where("item_id % 50 != 0").select("item_id", "embedding")
    return S.surprise_in_order(SQ._queries(s, d), corpus).withColumn("surprise", F.round("surprise", 6))


@query("g12_relation_candidates", sql("SELECT query_id, item_id, round(cosine, 6) AS cosine FROM (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM near n JOIN vec q ON q.vec_id = n.query_id WHERE q.label = n.label) WHERE r <= 2 AND cosine >= 0.25", SQ._KNN))
def _(s, d):
    """The two nearest of the same label that are alike enough."""
    v = V.vectors(s, d)
    q = v.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    return S.knn(q, v, 2, least=0.25, within="label").select("query_id", "item_id", F.round("cosine", 6).alias("cosine"))


@query("v6_all_then_ladder", sql("""SELECT query_id, doc_id, pass_no FROM (SELECT query_id, doc_id, pass_no, row_number() OVER (PARTITION BY query_id ORDER BY pass_no, o, doc_id) AS r FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pass_no, o) AS f FROM (
  SELECT h.query_id, h.doc_id, 0 AS pass_no, 0 AS o FROM (SELECT query_id, doc_id, count(*) AS n FROM qt JOIN post USING (token) GROUP BY 1, 2) h JOIN (SELECT query_id, count(*) AS n FROM qt GROUP BY 1) w ON w.query_id = h.query_id AND w.n = h.n
  UNION ALL SELECT query_id, doc_id, 1, -rung FROM (SELECT query_id, doc_id, rung, row_number() OVER (PARTITION BY query_id ORDER BY rung DESC, doc_id) AS r FROM (
  SELECT query_id, p.doc_id, CAST(CASE WHEN bool_or(place = 1) THEN CASE WHEN bool_or(place = 2) THEN CASE WHEN bool_or(place = 3) THEN CASE WHEN bool_or(place = 4) THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END ELSE 0 END AS INTEGER) AS rung FROM qt JOIN post p USING (token) GROUP BY 1, 2) WHERE rung > 0) WHERE r <= 20)) WHERE f = 1) WHERE r <= 10""", SQ._TEXT))
def _(s, d):
    ix = SQ._index(s, d)
    return S.all_then_ladder(SQ._rare(s, d, ix), ix.post, "doc_id", k=10, df=ix.frequency)


QUERIES, ORACLE = Q, O
