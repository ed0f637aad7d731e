"""Reports, rankings and set operations on exchanges, tool calls and facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import analytics as A
from ..operators import tables as R
from ..schema import DEFAULT_AGENT
from ..session import Workspace
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


@query("a1_coverage", sql("SELECT count(DISTINCT archive_path) AS conversations, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects, count(*) AS exchanges, min(timestamp) AS first_at, max(timestamp) AS last_at FROM ex"))
def _(s, d):
    return A.coverage(V.exchange_meta(s, d))


@query("a3_fact_counts", sql("""SELECT 'state' AS kind, CASE WHEN is_active THEN 'active' ELSE 'inactive' END AS value, count(*) AS n FROM facts GROUP BY ALL
UNION ALL SELECT 'category', category, count(*) FROM facts WHERE is_active GROUP BY ALL UNION ALL SELECT 'scope', coalesce(scope_type, 'none'), count(*) FROM facts WHERE is_active GROUP BY ALL"""))
def _(s, d):
    return A.fact_counts(V.facts(s, d))


@query("a4_facts_per_project", sql("SELECT regexp_replace(scope_project, '[/._]', '-', 'g') AS project, count(*) AS facts FROM facts WHERE is_active AND scope_project IS NOT NULL GROUP BY ALL"))
def _(s, d):
    return A.facts_per_slug(V.facts(s, d))


@query("a5_domains", sql("SELECT domain_id, count(*) AS facts, count(DISTINCT c.category_id) AS categories FROM facts f JOIN cats c ON c.category_id = f.category_id WHERE is_active GROUP BY ALL ORDER BY facts DESC, domain_id LIMIT 10"))
def _(s, d):
    return A.domain_counts(V.facts(s, d), V.categories(s, d)).orderBy(F.desc("facts"), "domain_id").limit(10)


@query("a6_project_report", sql("""SELECT p.*, coalesce(f.facts, 0) AS facts FROM (
  SELECT project, count(DISTINCT archive_path) AS conversations, count(DISTINCT session_id) AS sessions, count(*) AS exchanges, max(timestamp) AS last_at FROM ex GROUP BY project ORDER BY exchanges DESC, project NULLS FIRST LIMIT 20) p
LEFT JOIN (SELECT regexp_replace(scope_project, '[/._]', '-', 'g') AS project, count(*) AS facts FROM facts WHERE is_active AND scope_project IS NOT NULL GROUP BY ALL) f ON f.project = p.project"""))
def _(s, d):
    return A.project_report(V.exchange_meta(s, d), V.facts(s, d), 20)


@query("a7_timeline", sql("SELECT substr(timestamp, 1, 7) AS month, count(*) AS exchanges, count(DISTINCT session_id) AS sessions FROM ex WHERE timestamp IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12"))
def _(s, d):
    return A.monthly(V.exchange_meta(s, d), 12)


@query("a8_main_conversations", sql("""SELECT count(*) FILTER (m) AS main, count(*) FILTER (NOT m) AS other FROM (
  SELECT DISTINCT archive_path, regexp_matches(string_split(archive_path, '/')[-1], '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\\.jsonl$') AS m FROM ex WHERE archive_path IS NOT NULL)"""))
def _(s, d):
    return A.main_conversations(V.exchange_meta(s, d))


@query("a10_top_projects", sql("SELECT project, count(DISTINCT archive_path) AS conversations FROM ex WHERE project IS NOT NULL GROUP BY project ORDER BY conversations DESC, project LIMIT 10"))
def _(s, d):
    return A.project_rollup(V.exchange_meta(s, d)).where("project is not null").select("project", "conversations").orderBy(F.desc("conversations"), "project").limit(10)


@query("a11_graph_stats", sql("""SELECT 'facts' AS what, count(*) AS n FROM facts WHERE is_active UNION ALL SELECT 'relations', count(*) FROM edges UNION ALL SELECT 'domains', count(DISTINCT domain_id) FROM cats
UNION ALL SELECT 'categories', count(*) FROM cats UNION ALL SELECT relation_type, count(*) FROM edges GROUP BY 1"""))
def _(s, d):
    cats, edges = V.categories(s, d), V.edges(s, d)
    parts = [V.facts(s, d).where("is_active").agg(F.count("*").alias("n")).withColumn("what", F.lit("facts")), edges.agg(F.count("*").alias("n")).withColumn("what", F.lit("relations")), cats.agg(F.countDistinct("domain_id").alias("n")).withColumn("what", F.lit("domains")), cats.agg(F.count("*").alias("n")).withColumn("what", F.lit("categories")), edges.groupBy(F.col("relation_type").alias("what")).agg(F.count("*").alias("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("what", "n")


_STEPS = "'Write', 'Glob', 'LS'"


@query("a13_tool_frequency", sql("SELECT tool_name, count(*) AS calls FROM calls WHERE tool_name NOT IN ('Read', 'LS') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def _(s, d):
    return A.tool_frequency(V.calls(s, d), 8, ["Read", "LS"])


@query("a14_tool_sequences", sql(f"""SELECT a.tool_name, b.tool_name AS next_tool, count(*) AS n FROM calls a JOIN calls b ON a.exchange_id = b.exchange_id AND a.timestamp < b.timestamp
WHERE a.tool_name NOT IN ({_STEPS}) AND b.tool_name NOT IN ({_STEPS}) GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 5"""))
def _(s, d):
    return A.tool_sequences(V.calls(s, d), Workspace(s, "a14"), 3, 5, ["Write", "Glob", "LS"])


@query("a15_project_profile", sql(f"""SELECT count(*) AS exchanges, count(DISTINCT session_id) AS sessions, count(DISTINCT git_branch) AS branches, min(timestamp) AS first_at, max(timestamp) AS last_at,
CAST(date_diff('day', CAST(substr(min(timestamp), 1, 10) AS DATE), DATE '{NOW}') AS INTEGER) AS days FROM ex WHERE project = '-work-orchard-main'"""))
def _(s, d):
    return A.project_profile(V.exchange_meta(s, d), "-work-orchard-main", NOW)


@query("a16_daily_activity", sql("SELECT substr(timestamp, 1, 10) AS day, count(*) AS exchanges, count(DISTINCT session_id) AS sessions FROM ex WHERE timestamp IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 60"))
def _(s, d):
    return V.exchange_meta(s, d).where("timestamp is not null").groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(F.count("*").alias("exchanges"), F.countDistinct("session_id").alias("sessions")).orderBy(F.desc("day")).limit(60)


@query("a17_tools_by_project", sql("SELECT project, tool_name, count(*) AS calls FROM calls c JOIN ex e ON e.id = c.exchange_id WHERE project IS NOT NULL AND tool_name IS NOT NULL GROUP BY ALL"))
def _(s, d):
    return V.calls(s, d).select("exchange_id", "tool_name").where("tool_name is not null").join(V.exchange_meta(s, d).select(F.col("id").alias("exchange_id"), "project").where("project is not null"), "exchange_id").groupBy("project", "tool_name").agg(F.count("*").alias("calls"))


@query("a18_session_folder", sql("SELECT session_id, cwd, n FROM (SELECT session_id, cwd, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, cwd) AS rn FROM ex WHERE session_id IS NOT NULL AND cwd IS NOT NULL GROUP BY session_id, cwd) WHERE rn = 1"))
def _(s, d):
    return A.most_frequent(V.exchange_meta(s, d), "session_id", "cwd")


@query("a19_confidence_quantiles", sql("""SELECT p AS point, v[1 + least(len(v) - 1, CAST(floor(p * len(v)) AS BIGINT))] AS value FROM (SELECT list(confidence ORDER BY confidence) AS v FROM facts WHERE confidence IS NOT NULL), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p)"""))
def _(s, d):
    return A.quantiles(V.facts(s, d), "confidence", [0.0, 0.25, 0.5, 0.75, 1.0], Workspace(s, "a19"))


@query("a20_session_tools", sql("SELECT DISTINCT session_id, tool_name FROM calls c JOIN ex e ON e.id = c.exchange_id WHERE session_id IS NOT NULL AND tool_name IS NOT NULL"))
def _(s, d):
    return V.calls(s, d).where("tool_name is not null").join(V.exchange_meta(s, d).select(F.col("id").alias("exchange_id"), "session_id").where("session_id is not null"), "exchange_id").select("session_id", "tool_name").distinct()


@query("a21_repeated_documents", sql("""SELECT id, first_value(id) OVER (w ORDER BY created_at NULLS FIRST, id) AS keeper, count(*) OVER w AS copies FROM (SELECT doc_id AS id, text AS fact, lower(trim(lang)) AS lang, created_at FROM documents)
WINDOW w AS (PARTITION BY fact, lang) QUALIFY copies > 1"""))
def _(s, d):
    """Documents of one text and language label, and the first of them."""
    docs = V.documents(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("fact"), F.lower(F.trim("lang")).alias("scope_type"), F.lit(None).cast("string").alias("scope_project"), F.lit(1).alias("consolidated_count"), "created_at", F.lit(True).alias("is_active"))
    return A.content_duplicates(docs)


@query("a23_decisions_held", sql("""SELECT l.action, count(*) AS decisions, count(*) FILTER (e.rel_id IS NOT NULL) AS still_there, round(100.0 * count(*) FILTER (e.rel_id IS NOT NULL) / count(*), 1) AS rate FROM log l
LEFT JOIN edges e ON e.source_id = l.source_fact_id AND e.target_id = l.target_fact_id AND e.relation_type = l.relation_type_before GROUP BY 1"""))
def _(s, d):
    e = V.edges(s, d).select(F.col("source_id").alias("source_fact_id"), F.col("target_id").alias("target_fact_id"), F.col("relation_type").alias("relation_type_before"), "rel_id")
    j = V.log(s, d).select("action", "source_fact_id", "target_fact_id", "relation_type_before").join(e, ["source_fact_id", "target_fact_id", "relation_type_before"], "left")
    there = F.count_if(F.col("rel_id").isNotNull())
    return j.groupBy("action").agg(F.count("*").alias("decisions"), there.alias("still_there"), F.round(100.0 * there / F.count("*"), 1).alias("rate"))


@query("a25_agreement_by_threshold", sql("""SELECT t AS threshold, round(avg(CASE WHEN confidence >= t THEN 1.0 ELSE 0.0 END), 6) AS fired, round(avg(CASE WHEN confidence >= t THEN CAST(ok AS DOUBLE) END), 6) AS agreement
FROM (SELECT confidence, CAST(upper(verdict) LIKE '%CONTRADICTION%' AS INTEGER) AS ok FROM log WHERE relation_type_before = 'CONTRADICTS' AND NOT isnan(confidence)), (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) GROUP BY t"""))
def _(s, d):
    pairs = V.log(s, d).where("relation_type_before = 'CONTRADICTS' and confidence is not null and not isnan(confidence)").select("confidence", F.coalesce(F.upper("verdict").contains("CONTRADICTION"), F.lit(False)).cast("int").alias("ok"))
    return A.agreement_by_threshold(pairs, "confidence", "ok", [0.5, 0.6, 0.7, 0.8, 0.9])


@query("a26_confidence_by_kind", sql("SELECT round(avg(CASE WHEN scope_type = 'project' THEN confidence END), 9) AS specific, round(avg(CASE WHEN scope_type = 'global' THEN confidence END), 9) AS generic FROM facts WHERE is_active"))
def _(s, d):
    return V.facts(s, d).where("is_active").agg(F.round(F.avg(F.when(F.col("scope_type") == "project", F.col("confidence"))), 9).alias("specific"), F.round(F.avg(F.when(F.col("scope_type") == "global", F.col("confidence"))), 9).alias("generic"))


@query("j8_calls_of_exchanges", sql("SELECT id, tool_name FROM calls WHERE exchange_id IN (SELECT id FROM ex)"))
def _(s, d):
    return V.calls(s, d).join(V.exchange_meta(s, d).select(F.col("id").alias("exchange_id")), "exchange_id", "left_semi").select("id", "tool_name")


@query("j7_sessions_without_facts", sql("""SELECT session_id, count(*) AS exchanges FROM ex WHERE is_sidechain IS DISTINCT FROM true AND session_id IS NOT NULL
  AND session_id NOT IN (SELECT e.session_id FROM ex e JOIN (SELECT unnest(CAST(src AS VARCHAR[])) AS x FROM facts) f ON f.x = e.id WHERE e.session_id IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2"""))
def _(s, d):
    ex = V.exchange_meta(s, d)
    cited = V.facts(s, d).select(F.explode("source_exchange_ids").alias("id")).distinct()
    done = ex.join(cited, "id", "left_semi").select("session_id").where("session_id is not null").distinct()
    return ex.where("coalesce(is_sidechain, false) = false and session_id is not null").join(done, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("exchanges")).where("exchanges >= 2")


@query("j10_branch_connections", sql("SELECT a.git_branch AS project, b.git_branch AS other, count(*) AS links FROM ex a JOIN ex b ON a.session_id = b.session_id AND a.git_branch < b.git_branch GROUP BY 1, 2 HAVING count(*) > 2"))
def _(s, d):
    """Branches that sessions have in common: exchanges of either side in one session, counted before they meet. (No two projects share a session here.)"""
    ex = V.exchange_meta(s, d).select("session_id", F.col("git_branch").alias("project"))
    return A.project_connections(ex, 2)


@query("j11_latest_exchange", sql("SELECT project, id, timestamp FROM ex WHERE project IS NOT NULL AND timestamp IS NOT NULL QUALIFY rank() OVER (PARTITION BY project ORDER BY timestamp DESC) = 1"))
def _(s, d):
    ex = V.exchange_meta(s, d).where("project is not null and timestamp is not null")
    last = ex.groupBy("project").agg(F.max("timestamp").alias("timestamp"))
    return ex.select("project", "id", "timestamp").join(last, ["project", "timestamp"], "left_semi")


@query("filter_dates", sql("SELECT id, timestamp FROM ex WHERE timestamp >= '2025-06-01' AND timestamp <= '2025-09-01'"))
def _(s, d):
    return V.exchange_meta(s, d).where("timestamp >= '2025-06-01' and timestamp <= '2025-09-01'").select("id", "timestamp")


@query("filter_agent", sql("SELECT id, coalesce(coding_agent, 'claude-code') AS coding_agent FROM ex WHERE coalesce(coding_agent, 'claude-code') = 'codex'"))
def _(s, d):
    agent = F.coalesce("coding_agent", F.lit(DEFAULT_AGENT))
    return V.exchange_meta(s, d).where(agent == "codex").select("id", agent.alias("coding_agent"))


@query("filter_substring", sql("SELECT id, timestamp FROM ex WHERE contains(lower(user_message), 'drain_') OR contains(lower(assistant_message), 'drain_')"))
def _(s, d):
    return V.exchanges(s, d).where(F.coalesce(T.escaped_like("user_message", "drain_"), F.lit(False)) | F.coalesce(T.escaped_like("assistant_message", "drain_"), F.lit(False))).select("id", "timestamp")


@query("filter_scope", sql("SELECT id, scope_type, scope_project FROM facts WHERE is_active AND (scope_type = 'global' OR scope_project = '/work/fjord/cli' OR scope_project = '-work-fjord-cli')"))
def _(s, d):
    return V.facts(s, d).where("is_active and (scope_type = 'global' or scope_project in ('/work/fjord/cli', '-work-fjord-cli'))").select("id", "scope_type", "scope_project")


@query("filter_confidence", sql("SELECT id, confidence FROM facts WHERE confidence >= 0.7"))
def _(s, d):
    return V.facts(s, d).where("confidence is not null and confidence >= 0.7").select("id", "confidence")


@query("filter_reembed", sql("SELECT id FROM ex WHERE embedding_version IS DISTINCT FROM 3 OR embedding IS NULL"))
def _(s, d):
    return V.exchanges(s, d).where("not (embedding_version <=> 3) or embedding is null").select("id")


@query("filter_cutoff", sql("SELECT id, created_at FROM facts WHERE length(substr(created_at, 1, 10)) = 10 AND substr(created_at, 1, 10) < '2025-06-01'"))
def _(s, d):
    day = F.substring("created_at", 1, 10)
    return V.facts(s, d).where((F.length(day) == 10) & (day < "2025-06-01")).select("id", "created_at")


@query("w2_last_session", sql("""SELECT project, session_id, id FROM (SELECT project, session_id, id, row_number() OVER (PARTITION BY project ORDER BY timestamp DESC, id) AS rn FROM ex WHERE project IS NOT NULL AND session_id IS NOT NULL AND timestamp IS NOT NULL) WHERE rn = 1"""))
def _(s, d):
    ex = V.exchange_meta(s, d).where("project is not null and session_id is not null and timestamp is not null").select("project", "session_id", "id", "timestamp")
    return R.latest(ex, ["project"], [F.desc("timestamp"), F.col("id")]).select("project", "session_id", "id")


@query("w5_spread_batches", sql("""SELECT session_id, batch FROM (SELECT session_id, batch, max(batch) OVER (PARTITION BY session_id) + 1 AS n FROM (
  SELECT DISTINCT session_id, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY timestamp NULLS FIRST, id) - 1) / 2) AS INTEGER) AS batch FROM ex WHERE session_id IS NOT NULL))
WHERE n <= 3 OR batch IN (0, CAST(floor((n - 1) / 2.0 + 0.5) AS INTEGER), n - 1)"""))
def _(s, d):
    ex = V.exchange_meta(s, d).where("session_id is not null").select("session_id", F.coalesce("timestamp", F.lit("")).alias("at"), "id")
    b = R.batched(Workspace(s, "w5"), ex, ["session_id"], ["at", "id"], 2)
    return R.spread(b.select("session_id", "batch").distinct(), ["session_id"], "batch", 3).select("session_id", "batch")


@query("w6_batches", sql("SELECT id, CAST(floor((row_number() OVER (PARTITION BY scope_type ORDER BY created_at NULLS FIRST, id) - 1) / 20) AS INTEGER) AS batch FROM facts WHERE is_active"))
def _(s, d):
    f = V.facts(s, d).where("is_active").select("id", F.coalesce("scope_type", F.lit("")).alias("scope"), F.coalesce("created_at", F.lit("")).alias("at"))
    return R.batched(Workspace(s, "w6"), f, ["scope"], ["at", "id"], 20).select("id", "batch")


@query("w7_consecutive_pairs", sql("""SELECT id, next_id FROM (SELECT id, lead(id) OVER w AS next_id, row_number() OVER w AS rn FROM (SELECT f.id, e.session_id, f.created_at FROM facts f JOIN ex e ON e.id = f.src->>'$[0]')
  WINDOW w AS (PARTITION BY session_id ORDER BY created_at NULLS FIRST, id)) WHERE next_id IS NOT NULL AND rn <= 3"""))
def _(s, d):
    f = V.facts(s, d).select("id", "created_at", F.get("source_exchange_ids", F.lit(0)).alias("x"))
    j = f.join(V.exchange_meta(s, d).select(F.col("id").alias("x"), "session_id"), "x")
    # four rows of a session decide its first three pairs
    order = [F.asc_nulls_first("created_at"), F.col("id")]
    few = R.top_per_group(j, ["session_id"], order, 4)
    return few.select("id", F.lead("id").over(Window.partitionBy("session_id").orderBy(*order)).alias("next_id"), "rank").where("next_id is not null and rank <= 3").select("id", "next_id")


@query("t2_top_facts", sql("SELECT id, consolidated_count FROM facts WHERE is_active ORDER BY consolidated_count DESC, id LIMIT 20"))
def _(s, d):
    return V.facts(s, d).where("is_active").select("id", "consolidated_count").orderBy(F.desc("consolidated_count"), "id").limit(20)


@query("t4_keyset_page", sql("SELECT created_at, id FROM facts WHERE is_active AND created_at > '2025-06-01' ORDER BY created_at, id LIMIT 200"))
def _(s, d):
    return R.keyset_page(V.facts(s, d).where("is_active").select("created_at", "id"), ["created_at", "id"], ("2025-06-01", "~"), 200)


@query("t6_offset_page", sql("SELECT id, timestamp, (SELECT count(*) FROM ex WHERE timestamp IS NOT NULL) AS total FROM ex WHERE timestamp IS NOT NULL ORDER BY timestamp DESC, id LIMIT 50 OFFSET 100"))
def _(s, d):
    return R.offset_page(V.exchange_meta(s, d).where("timestamp is not null").select("id", "timestamp"), [F.desc("timestamp"), F.col("id")], 50, 100)


@query("t7_shown_of_all", sql("SELECT project, id, shown, n FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY timestamp DESC NULLS LAST, id) AS shown, count(*) OVER (PARTITION BY project) AS n FROM ex WHERE project IS NOT NULL) WHERE shown <= 3"))
def _(s, d):
    ex = V.exchange_meta(s, d).where("project is not null").select("project", "id", "timestamp")
    top = R.top_per_group(ex, ["project"], [F.desc_nulls_last("timestamp"), F.col("id")], 3, "shown")
    return top.join(ex.groupBy("project").agg(F.count("*").alias("n")), "project").select("project", "id", "shown", "n")


@query("u3_projects_with_all_agents", sql("SELECT project FROM ex WHERE coding_agent IN ('claude-code', 'codex') GROUP BY project HAVING count(DISTINCT coding_agent) = 2 AND project IS NOT NULL"))
def _(s, d):
    return V.exchange_meta(s, d).where(F.col("coding_agent").isin(DEFAULT_AGENT, "codex") & F.col("project").isNotNull()).groupBy("project").agg(F.countDistinct("coding_agent").alias("n")).where("n = 2").select("project")


@query("u4_id_difference", sql("""SELECT id, 'left' AS side FROM (SELECT DISTINCT exchange_id AS id FROM calls WHERE exchange_id IS NOT NULL EXCEPT SELECT id FROM ex) UNION ALL SELECT id, 'right' FROM (SELECT id FROM ex EXCEPT SELECT exchange_id FROM calls)"""))
def _(s, d):
    return R.set_difference(V.calls(s, d).where("exchange_id is not null").select(F.col("exchange_id").alias("id")), V.exchange_meta(s, d).select("id"), ["id"])


@query("u5_reconciled", sql("""SELECT path, CASE WHEN indexed IS NULL THEN 'missing' WHEN modified IS NULL THEN 'orphaned' WHEN modified > indexed THEN 'outdated' ELSE 'ok' END AS state FROM
 (SELECT archive_path AS path, max(timestamp) AS indexed FROM ex WHERE archive_path IS NOT NULL GROUP BY 1) i FULL JOIN (SELECT archive_path AS path, max(timestamp) AS modified FROM exchanges WHERE archive_path IS NOT NULL AND line_end > 3 GROUP BY 1) m USING (path)"""))
def _(s, d):
    files = V.table(s, d, "exchanges").where("archive_path is not null and line_end > 3").groupBy(F.col("archive_path").alias("path")).agg(F.max("timestamp").alias("modified"))
    index = V.exchange_meta(s, d).where("archive_path is not null").groupBy(F.col("archive_path").alias("path")).agg(F.max("timestamp").alias("indexed"))
    return R.reconciled(files, index)


@query("s_text_functions", sql("""SELECT id, CASE WHEN length(fact) > 80 THEN trim(regexp_replace(substr(fact, 1, 80), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') || '...' ELSE trim(regexp_replace(fact, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') END AS snippet,
 trim(regexp_replace(regexp_replace(lower(fact), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), '[.!。]+$', ''), ' ') AS comparable, regexp_replace(scope_project, '[/._]', '-', 'g') AS slug, CAST(len(regexp_extract_all(lower(fact), '[\\p{L}\\p{N}]+')) AS INTEGER) AS words FROM facts"""))
def _(s, d):
    return V.facts(s, d).select("id", T.snippet("fact", 80).alias("snippet"), T.comparable("fact").alias("comparable"), T.path_slug("scope_project").alias("slug"), F.size(T.tokens("fact")).alias("words"))


@query("s_exchange_ids", sql("SELECT id, md5(archive_path || ':' || line_start || '-' || line_end) AS made FROM ex"))
def _(s, d):
    return V.exchange_meta(s, d).select("id", T.exchange_id("archive_path", "line_start", "line_end").alias("made"))


@query("r10_last_indexed", sql("SELECT archive_path, max(last_indexed) AS last_indexed FROM ex WHERE archive_path IS NOT NULL GROUP BY 1"))
def _(s, d):
    return V.exchange_meta(s, d).where("archive_path is not null").groupBy("archive_path").agg(F.max("last_indexed").alias("last_indexed"))


@query("v22_line_counts", sql("SELECT archive_path, max(line_end) AS lines FROM ex WHERE archive_path IS NOT NULL GROUP BY 1"))
def _(s, d):
    return V.exchange_meta(s, d).where("archive_path is not null").groupBy("archive_path").agg(F.max("line_end").alias("lines"))


@query("v19_context_budget", sql("""WITH r AS (SELECT scope_project, id, fact, row_number() OVER w AS no, sum(least(length(fact), 160)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM facts WHERE is_active AND scope_project IS NOT NULL AND fact IS NOT NULL WINDOW w AS (PARTITION BY scope_project ORDER BY consolidated_count DESC, id)),
 o AS (SELECT *, max(CAST(used > 400 AND no > 1 AS INTEGER)) OVER (PARTITION BY scope_project ORDER BY no ROWS UNBOUNDED PRECEDING) AS over FROM r) SELECT scope_project, id, CAST(used AS BIGINT) AS used FROM o WHERE over = 0""".replace("WITH r AS", "SELECT * FROM (WITH r AS") + ")"))
def _(s, d):
    f = V.facts(s, d).where("is_active and scope_project is not null and fact is not null").select("scope_project", "id", "fact", "consolidated_count")
    return R.budgeted(f, ["scope_project"], [F.desc("consolidated_count"), F.col("id")], F.least(F.length("fact"), F.lit(160)), 400).select("scope_project", "id", F.col("used").cast("bigint").alias("used"))


@query("f16_committee", sql("""SELECT source_fact_id, target_fact_id, verdict, votes, cs[CAST(floor((votes - 1) / 2) AS INTEGER) + 1] AS confidence FROM (
  SELECT source_fact_id, target_fact_id, verdict, count(*) AS votes, list(c ORDER BY c) AS cs FROM (
    SELECT source_fact_id, target_fact_id, upper(trim(verdict)) AS verdict, id, max(coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, 0.0)) AS c FROM log WHERE source_fact_id IS NOT NULL AND target_fact_id IS NOT NULL AND verdict IS NOT NULL GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2)"""))
def _(s, d):
    votes = V.log(s, d).where("source_fact_id is not null and target_fact_id is not null and verdict is not null").select("id", "source_fact_id", "target_fact_id", F.upper(F.trim("verdict")).alias("verdict"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"))
    return A.majority(votes, ["source_fact_id", "target_fact_id"], "verdict", "confidence", "id", 2, upper=False)


@query("src14_export", sql("SELECT e.source_id, e.relation_type, e.target_id FROM edges e WHERE e.source_id IN (SELECT id FROM facts WHERE is_active) AND e.target_id IN (SELECT id FROM facts WHERE is_active)"))
def _(s, d):
    ids = V.facts(s, d).where("is_active").select("id")
    return V.edges(s, d).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "relation_type", "target_id")


@query("src12_upsert", sql("SELECT id, project, line_end FROM ex"))
def _(s, d):
    raw = V.table(s, d, "exchanges").withColumn("id", V.norm_id("id")).where("id is not null").select("id", "project", "line_end", "last_indexed")
    new = R.latest(raw, ["id"], [F.desc_nulls_last("last_indexed")])
    old = raw.dropDuplicates(["id"])
    return R.upsert(old, new, ["id"]).select("id", "project", "line_end")


QUERIES, ORACLE = Q, O
