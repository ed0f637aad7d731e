"""Changes of state: imports, merges of categories, ledgers, revisions, what a project's last session was about."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import retrieval as S
from ..operators import tables as R
from ..schema import SYMMETRIC
from ..session import Workspace
from ..sources import sync
from ..streaming.ingest import ledger
from . import search_queries as SQ
from . import views as V
from .views import sql

NOW = "2026-06-15 00:00:00"
Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return keep


@query("w2_continuity", sql("""SELECT s.project, s.session_id, s.n AS exchanges, CASE WHEN length(e.user_message) > 300 THEN trim(regexp_replace(substr(e.user_message, 1, 300), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') || '...' ELSE trim(regexp_replace(e.user_message, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') END AS prompt, e.git_branch FROM
 (SELECT project, session_id, count(*) AS n, max(timestamp) AS last_at FROM ex WHERE project IS NOT NULL AND session_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY project, session_id QUALIFY row_number() OVER (PARTITION BY project ORDER BY max(timestamp) DESC, session_id) = 1) s
 JOIN (SELECT * FROM ex WHERE session_id IS NOT NULL AND timestamp IS NOT NULL AND project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, session_id ORDER BY timestamp DESC, id) = 1) e ON e.project = s.project AND e.session_id = s.session_id"""))
def _(s, d):
    """The last session of each project: how many exchanges, the last prompt and branch."""
    ex = V.exchanges(s, d).where("project is not null and session_id is not null and timestamp is not null")
    per = ex.groupBy("project", "session_id").agg(F.count("*").alias("exchanges"), F.max("timestamp").alias("last_at"))
    last = R.latest(per, ["project"], [F.desc("last_at"), F.col("session_id")])
    rows = ex.select("project", "session_id", "timestamp", "id", T.snippet("user_message", 300).alias("prompt"), "git_branch")
    end = R.latest(rows.join(last.select("project", "session_id"), ["project", "session_id"], "left_semi"), ["project", "session_id"], [F.desc("timestamp"), F.col("id")])
    return last.join(end, ["project", "session_id"]).select("project", "session_id", "exchanges", "prompt", "git_branch")


@query("s5_line_summary", sql("SELECT id, substr(array_to_string(list_filter(string_split(assistant_message, chr(10)), lambda x: length(trim(x, ' ')) > 10)[1:3], chr(10)), 1, 300) AS summary FROM ex WHERE assistant_message IS NOT NULL"))
def _(s, d):
    return V.exchanges(s, d).where("assistant_message is not null").select("id", T.line_summary("assistant_message").alias("summary"))


@query("s30_edge_keys", sql("SELECT DISTINCT CASE WHEN relation_type IN ('SUPPORTS', 'CONTRADICTS') THEN relation_type || '|' || least(source_id, target_id) || '|' || greatest(source_id, target_id) ELSE relation_type || '|' || source_id || '|' || target_id END AS key FROM edges"))
def _(s, d):
    return V.edges(s, d).select(T.edge_key("relation_type", "source_id", "target_id", SYMMETRIC).alias("key")).distinct()


@query("src15_import_facts", sql("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY fact, scope_type, coalesce(scope_project, '') ORDER BY created_at NULLS FIRST, id) AS r FROM facts f
WHERE NOT coalesce(confidence >= 0.7, false) AND fact IS NOT NULL AND NOT EXISTS (SELECT 1 FROM facts o WHERE coalesce(o.confidence >= 0.7, false) AND o.is_active AND o.fact = f.fact AND o.scope_type IS NOT DISTINCT FROM f.scope_type AND coalesce(o.scope_project, '') = coalesce(f.scope_project, ''))) WHERE r = 1"""))
def _(s, d):
    """The facts that a store of the sure ones gets from one of all."""
    facts = V.facts(s, d)
    sure = F.coalesce(F.col("confidence") >= 0.7, F.lit(False))
    edges = V.edges(s, d)
    return sync.merged(facts.where(sure), edges.limit(0), facts, edges)[0].select("id")


@query("src15_import_edges", sql("""SELECT DISTINCT CASE WHEN relation_type IN ('SUPPORTS', 'CONTRADICTS') THEN relation_type || '|' || least(source_id, target_id) || '|' || greatest(source_id, target_id) ELSE relation_type || '|' || source_id || '|' || target_id END AS key FROM edges
WHERE source_id IN (SELECT id FROM facts) AND target_id IN (SELECT id FROM facts) AND key NOT IN (SELECT CASE WHEN relation_type IN ('SUPPORTS', 'CONTRADICTS') THEN relation_type || '|' || least(source_id, target_id) || '|' || greatest(source_id, target_id) ELSE relation_type || '|' || source_id || '|' || target_id END FROM edges WHERE relation_type IN ('SUPPORTS', 'INFLUENCES'))"""))
def _(s, d):
    """The edges that a store with two of the kinds gets from one with all."""
    facts, edges = V.facts(s, d), V.edges(s, d)
    new = sync.merged(facts, edges.where(F.col("relation_type").isin("SUPPORTS", "INFLUENCES")), facts, edges)[1]
    return new.select(T.edge_key("relation_type", "source_id", "target_id", SYMMETRIC).alias("key"))


_MERGES = SQ._KNN + """, pair AS (SELECT least(query_id, item_id) AS a, greatest(query_id, item_id) AS b FROM top WHERE rank <= 5 AND cosine >= 0.3 GROUP BY 1, 2),
step AS (SELECT drop_id AS id, min(keep_id) AS too FROM (SELECT CASE WHEN b % 9 > a % 9 THEN b ELSE a END AS keep_id, CASE WHEN b % 9 > a % 9 THEN a ELSE b END AS drop_id FROM pair JOIN vec x ON x.vec_id = a JOIN vec y ON y.vec_id = b WHERE x.label % 3 = y.label % 3) GROUP BY 1),
follow AS (SELECT id, too, 0 AS n FROM step UNION ALL SELECT f.id, s.too, n + 1 FROM follow f JOIN step s ON s.id = f.too WHERE n < 40)"""


@query("g15_apply_merges", sql("SELECT vec_id AS id, coalesce(f.too, vec_id) AS category_id FROM vec LEFT JOIN (SELECT id, arg_max(too, n) AS too FROM follow GROUP BY 1) f ON f.id = vec_id", _MERGES, recursive=True))
def _(s, d):
    """Every vector stands for a category; those that merge within a domain move to the end of their chain."""
    sizes = V.vectors(s, d).select(F.col("item_id").alias("category_id"), (F.col("label") % 3).alias("domain_id"), (F.col("item_id") % 9).alias("facts"))
    merges = G.merge_candidates(SQ._near(s, d, 5), sizes, 0.3)
    facts = V.vectors(s, d).select(F.col("item_id").alias("id"), F.col("item_id").alias("category_id"))
    return G.apply_merges(facts, merges, Workspace(s, "g15")).select("id", "category_id")


@query("g16_small_to_stable", sql("""SELECT query_id AS category_id, item_id AS stable_id, round(cosine, 6) AS cosine FROM (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM near n JOIN vec q ON q.vec_id = n.query_id WHERE n.item_id % 9 > 1 AND q.label % 3 = n.label % 3) WHERE r = 1 AND cosine >= 0.25""", SQ._KNN))
def _(s, d):
    """Categories that are asked for, each with the nearest stable one (more than one fact) of its domain."""
    v = V.vectors(s, d).withColumn("domain", F.col("label") % 3)
    q = v.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    near = S.knn(q, v.where("item_id % 9 > 1"), 1, least=0.25, within="domain")
    return near.select(F.col("query_id").alias("category_id"), F.col("item_id").alias("stable_id"), F.round("cosine", 6).alias("cosine"))


@query("x5_ledger", sql(f"""SELECT session_id, list(id ORDER BY at, id) AS ids FROM (SELECT session_id, id, CAST(timestamp AS TIMESTAMPTZ) AS at, row_number() OVER (PARTITION BY session_id ORDER BY CAST(timestamp AS TIMESTAMPTZ) DESC, id DESC) AS r FROM ex
WHERE session_id IS NOT NULL AND TRY_CAST(timestamp AS TIMESTAMPTZ) >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 700 DAYS) WHERE r <= 5 GROUP BY 1""".replace(" AS at,", " AS seen,").replace("ORDER BY at, id", "ORDER BY seen, id")))
def _(s, d):
    shown = V.exchange_meta(s, d).where("session_id is not null").select("session_id", "id", F.try_to_timestamp("timestamp").alias("at")).where("at is not null")
    return ledger(shown, NOW, most=5, days=700)



@query("f6_consolidated", sql("""SELECT f.id, f.is_active AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.relation_type = 'SUPERSEDES' AND e.target_id = f.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.relation_type = 'CONTRADICTS' AND e.source_id = f.id) AS is_active,
CAST(f.consolidated_count + (SELECT count(*) FROM edges e WHERE e.relation_type = 'SUPERSEDES' AND e.source_id = f.id) AS INTEGER) AS consolidated_count FROM facts f"""))
def _(s, d):
    """Replacements taken as duplicates of the replacing fact, contradictions as its end."""
    kinds = F.when(F.col("relation_type") == "SUPERSEDES", "DUPLICATE").when(F.col("relation_type") == "CONTRADICTS", "CONTRADICTION")
    verdicts = V.edges(s, d).select(F.col("source_id").alias("old_id"), F.col("target_id").alias("new_id"), kinds.alias("verdict"), F.lit(None).cast("string").alias("merged")).where("verdict is not null")
    return L.consolidated(V.facts(s, d), verdicts, NOW)[0].select("id", "is_active", "consolidated_count")


@query("f19_unchanged_pairs", sql("""SELECT relation_id, source_fact_id, target_fact_id, action FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY id DESC) = 1) l JOIN facts a ON a.id = l.source_fact_id JOIN facts b ON b.id = l.target_fact_id WHERE l.source_fact IS NOT DISTINCT FROM a.fact AND l.target_fact IS NOT DISTINCT FROM b.fact"""))
def _(s, d):
    return L.unchanged_pairs(V.log(s, d), V.facts(s, d))


QUERIES, ORACLE = Q, O
