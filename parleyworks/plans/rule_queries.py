"""Text functions, policies, queues and cursors over whole tables, and both dialects of transcripts read from lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vectors as N
from ..operators import analytics as A
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import policy as P
from ..operators import tables as R
from ..operators.filters import names_any, pollution
from ..schema import conform
from ..session import Workspace, table
from ..sources import transcripts as X
from ..sources.files import Store
from ..streaming.ingest import ingest_transcripts
from . import search_queries as SQ
from . import views as V
from .stream_queries import SESSION_MESSAGES
from .views import sql

NOW = "2026-06-15 00:00:00"
CURSOR = ("2025-06-01T00:00:00Z", "8")
Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return keep


_ONE = "trim(regexp_replace({c}, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ')"


@query("s3_clips", sql("SELECT id, CASE WHEN length(o) > 110 THEN substr(o, 1, 109) || '…' ELSE o END AS short, CASE WHEN length(o) > 160 THEN substr(o, 1, 159) || '…' ELSE o END AS long FROM (SELECT id, " + _ONE.format(c="fact") + " AS o FROM facts)"))
def _(s, d):
    return V.facts(s, d).select("id", T.clipped("fact", 110).alias("short"), T.clipped("fact", 160).alias("long"))


@query("s8_folder_names", sql("SELECT DISTINCT cwd, regexp_replace(regexp_replace(cwd, '/+$', ''), '[^A-Za-z0-9]', '-', 'g') AS folder FROM ex WHERE cwd IS NOT NULL"))
def _(s, d):
    return V.exchange_meta(s, d).where("cwd is not null").select("cwd", T.encoded_path("cwd").alias("folder")).distinct()


@query("s11_capped_tokens", """WITH t AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)),
u AS (SELECT doc_id, tok, min(pos) AS pos, n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(tok) DESC, tok) AS place FROM u),
k AS (SELECT doc_id, tok, CASE WHEN n <= 6 THEN 0 WHEN place <= 6 THEN 1 WHEN regexp_matches(tok, '[0-9]') THEN 2 END AS part, CASE WHEN n <= 6 OR place > 6 THEN pos ELSE place END AS spot FROM r)
SELECT doc_id, list_slice(list(tok ORDER BY part, spot), 1, 10) AS tokens FROM k WHERE part IS NOT NULL GROUP BY 1""")
def _(s, d):
    found = V.documents(s, d).select("doc_id", T.tokens("text").alias("w")).where("size(w) > 0")
    return found.select("doc_id", T.capped_tokens(F.col("w")).alias("tokens"))


@query("s13_similarities", """WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings)
SELECT a.vec_id, round(1 - list_distance(a.u, b.u) * list_distance(a.u, b.u) / 2, 6) AS cosine, round(1 - list_distance(a.u, b.u), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def _(s, d):
    """Of each vector and the next one: the cosine by their distance, and the similarity that searches show."""
    v = V.vectors(s, d).select("item_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    unit = v.select("item_id", F.transform("v", lambda x: x / F.sqrt(N.dot("v", "v"))).alias("u"))
    pairs = unit.select(F.col("item_id").alias("vec_id"), "u").join(unit.select((F.col("item_id") - 1).alias("vec_id"), F.col("u").alias("w")), "vec_id")
    gap = F.sqrt(F.aggregate(F.zip_with("u", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    return pairs.select("vec_id", gap.alias("gap")).select("vec_id", F.round(N.cosine_of_distance("gap"), 6).alias("cosine"), F.round(1 - F.col("gap"), 6).alias("similarity"))


@query("s16_unit_interval", sql("SELECT id, CASE WHEN confidence IS NOT NULL THEN least(greatest(confidence * 3 - 1.8, 0.0), 1.0) END AS c FROM facts"))
def _(s, d):
    return V.facts(s, d).select("id", T.unit_interval(F.col("confidence") * 3 - 1.8).alias("c"))


@query("s20_tool_names", sql("SELECT DISTINCT tool_name, regexp_replace(tool_name, '^mcp__[^_]+_[^_]+__', '') AS short FROM calls WHERE tool_name IS NOT NULL"))
def _(s, d):
    return V.calls(s, d).where("tool_name is not null").select("tool_name", T.short_tool("tool_name").alias("short")).distinct()


@query("s25_session_keys", sql("SELECT DISTINCT session_id, CASE WHEN length(k) >= 4 THEN k END AS key FROM (SELECT session_id, substr(regexp_replace(session_id, '[^A-Za-z0-9_-]', '', 'g'), 1, 80) AS k FROM ex WHERE session_id IS NOT NULL)"))
def _(s, d):
    return V.exchange_meta(s, d).where("session_id is not null").select("session_id", T.session_key("session_id").alias("key")).distinct()


@query("s27_json_of_answers", sql("""SELECT id, n, CASE WHEN json_valid(t) THEN trim(t) END AS found FROM (SELECT id, n, CASE n WHEN 0 THEN tool_input WHEN 1 THEN '[' || tool_input || ']' ELSE CASE WHEN contains(tool_input, '[') AND contains(tool_input, ']') THEN NULL ELSE tool_input END END AS t
FROM (SELECT DISTINCT id, tool_input FROM calls WHERE starts_with(tool_input, '{') AND ends_with(tool_input, '}') AND NOT contains(tool_input, '`') AND NOT contains(tool_input, '[')), range(3) r(n))"""))
def _(s, d):
    """Answers with the JSON of a call's input in a fence, in a list, or bare, with words around: what is found in each."""
    base = V.calls(s, d).where("startswith(tool_input, '{') and endswith(tool_input, '}') and not contains(tool_input, '`') and not contains(tool_input, '[')").select("id", "tool_input").distinct()
    each = base.select("id", "tool_input", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)])).alias("n"))
    wrapped = F.when(F.col("n") == 0, F.concat(F.lit("Here it is:\n```json\n"), "tool_input", F.lit("\n```\nDone."))).when(F.col("n") == 1, F.concat(F.lit("Sure: ["), "tool_input", F.lit("] as asked."))).otherwise(F.concat(F.lit("It is "), "tool_input", F.lit(" then.")))
    return each.select("id", "n", T.json_of(wrapped).alias("found"))


@query("s28_summaries", sql("SELECT id, trim(CASE WHEN trim(substr(fact, 3, 60), ' ') = '' THEN 'x <summary> ' || substr(fact, 3, 60) || ' </summary> y' ELSE substr(fact, 3, 60) END, ' ') AS summary FROM facts WHERE fact IS NOT NULL AND NOT contains(fact, '<summary>')"))
def _(s, d):
    marked = F.concat(F.lit("x <summary> "), F.substring("fact", 3, 60), F.lit(" </summary> y"))
    return V.facts(s, d).where("fact is not null and not contains(fact, '<summary>')").select("id", T.summary_of(marked).alias("summary"))


@query("s31_cells", sql("SELECT id, regexp_replace(replace(fact || ' | a', '|', '\\|'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g') AS cell FROM facts WHERE fact IS NOT NULL"))
def _(s, d):
    return V.facts(s, d).where("fact is not null").select("id", T.markdown_cell(F.concat("fact", F.lit(" | a"))).alias("cell"))


@query("s18_version_numbers", sql("SELECT DISTINCT tool_name, CAST(1000 + list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(tool_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) % 1000000 AS BIGINT) AS version FROM calls WHERE tool_name IS NOT NULL AND tool_name <> ''"))
def _(s, d):
    """A number for every name, by which vectors of different models are told apart."""
    return V.calls(s, d).where("tool_name is not null and tool_name != ''").select("tool_name", T.version_number("tool_name").alias("version")).distinct()


@query("s22_fresh", sql(f"SELECT id, coalesce(TRY_CAST(timestamp AS TIMESTAMPTZ) > TIMESTAMPTZ '{NOW}+00' - INTERVAL 300 DAYS, false) AS fresh FROM ex"))
def _(s, d):
    now = F.lit(NOW).cast("timestamp")
    return V.exchange_meta(s, d).select("id", P.is_fresh(F.lit(P.CLAIMED), F.col("timestamp"), now, "300 days").alias("fresh"))


@query("s24_slugs", "SELECT DISTINCT lower(trim(source, ' ')) AS slug, regexp_full_match(lower(trim(source, ' ')), '[a-z0-9][a-z0-9-]{0,63}') AS valid FROM documents WHERE source IS NOT NULL")
def _(s, d):
    return V.documents(s, d).where("source is not null").select(T.slug("source").alias("slug"), T.is_slug("source").alias("valid")).distinct()


_CODE = "CASE " + " ".join(f"WHEN regexp_extract(m, '{p}', 1) <> '' THEN CAST(regexp_extract(m, '{p}', 1) AS INTEGER)" for p in P.NUMBERED) + " END"


@query("s29_error_kinds", sql(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN code IS NOT NULL THEN CASE WHEN code IN (401, 403, 404, 429) OR code >= 500 THEN 'transient' WHEN code IN (400, 413, 422) THEN 'deterministic' ELSE 'unknown' END
WHEN regexp_matches(m, '{P.DETERMINISTIC}') THEN 'deterministic' WHEN regexp_matches(m, '{P.TRANSIENT}') THEN 'transient' ELSE 'unknown' END AS kind FROM (SELECT m, {_CODE} AS code FROM (SELECT lower(tool_result || ' status code ' || (length(tool_result) % 700)) AS m FROM calls WHERE tool_result IS NOT NULL UNION ALL SELECT lower(tool_result) FROM calls WHERE tool_result IS NOT NULL))) GROUP BY 1"""))
def _(s, d):
    """Results of tools read as error messages, with and without a number of a state at the end."""
    m = V.calls(s, d).where("tool_result is not null")
    both = m.select(F.concat("tool_result", F.lit(" status code "), (F.length("tool_result") % 700).cast("string")).alias("m")).unionByName(m.select(F.col("tool_result").alias("m")))
    return both.groupBy(P.error_kind(F.col("m")).alias("kind")).agg(F.count("*").alias("n"))


@query("g6_names_without_case", sql("SELECT a.asked, c.category_id, c.domain_id FROM (SELECT DISTINCT upper(category_id) AS asked FROM facts WHERE category_id IS NOT NULL) a JOIN cats c ON lower(c.category_id) = lower(a.asked)"))
def _(s, d):
    asked = V.facts(s, d).where("category_id is not null").select(F.upper("category_id").alias("asked")).distinct()
    return G.named_without_case(asked, V.categories(s, d), "asked", "category_id").select("asked", "category_id", "domain_id")


@query("g9_reused_categories", sql("SELECT query_id, CASE WHEN cosine >= 0.3 THEN 'label-' || label ELSE 'misc' END AS category FROM top WHERE rank = 1", SQ._KNN))
def _(s, d):
    """The label of the nearest vector where that is near enough, else the one for all others."""
    near = SQ._near(s, d, 1).join(V.vectors(s, d).select("item_id", "label"), "item_id")
    return near.select("query_id", G.reused(F.col("cosine"), F.concat(F.lit("label-"), "label"), 0.3, "misc").alias("category"))


_QUEUE = "queue AS (SELECT DISTINCT deactivated_fact_id AS id FROM log WHERE deactivated_fact_id IS NOT NULL UNION SELECT DISTINCT source_fact_id FROM log WHERE action = 'keep' AND source_fact_id IS NOT NULL)"


def _queue(s, d):
    log = V.log(s, d)
    return log.where("deactivated_fact_id is not null").select(F.col("deactivated_fact_id").alias("id")).unionByName(log.where("action = 'keep' and source_fact_id is not null").select(F.col("source_fact_id").alias("id"))).distinct()


@query("j14_queue_facts", sql(f"SELECT f.id, f.fact, f.created_at FROM queue q JOIN facts f ON f.id = q.id WHERE f.is_active AND (f.created_at > '{CURSOR[0]}' OR f.created_at = '{CURSOR[0]}' AND f.id > '{CURSOR[1]}')", _QUEUE))
def _(s, d):
    """Active facts of the queue behind a position, in order of creation and id."""
    waiting = V.facts(s, d).where("is_active").join(_queue(s, d), "id", "left_semi")
    return R.keyset_page(waiting, ["created_at", "id"], CURSOR, 2**31 - 1).select("id", "fact", "created_at")


@query("f13_unreconciled", sql("SELECT q.id FROM queue q WHERE q.id NOT IN (SELECT id FROM facts WHERE is_active)", _QUEUE))
def _(s, d):
    """Rows of the queue whose fact is gone or inactive, which leave it."""
    return _queue(s, d).join(V.facts(s, d).where("is_active").select("id"), "id", "left_anti")


@query("x4_cursor", sql(f"SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) = 1 AS next_position FROM (SELECT id, created_at FROM facts WHERE is_active AND (created_at > '{CURSOR[0]}' OR created_at = '{CURSOR[0]}' AND id > '{CURSOR[1]}') ORDER BY created_at, id LIMIT 40)"))
def _(s, d):
    """The next batch behind a position; its last row is the next position."""
    page = R.keyset_page(V.facts(s, d).where("is_active"), ["created_at", "id"], CURSOR, 40).select("id", "created_at")
    last = page.agg(F.max(F.struct("created_at", "id")).alias("last"))
    return page.crossJoin(F.broadcast(last)).select("id", "created_at", (F.struct("created_at", "id") == F.col("last")).alias("next_position"))  # one row


@query("f21_coverage", sql(f"SELECT CASE WHEN unchecked = 0 THEN 'complete' ELSE 'partial' END AS state, unchecked, queued FROM (SELECT count(*) FILTER (created_at > '{CURSOR[0]}' OR created_at = '{CURSOR[0]}' AND id > '{CURSOR[1]}') AS unchecked, count(*) FILTER (id IN (SELECT id FROM queue)) AS queued FROM facts WHERE is_active)", _QUEUE))
def _(s, d):
    return P.principle_coverage(V.facts(s, d), _queue(s, d), 3, CURSOR, True)


_ENDS = ("id", "fact", "scope_type", "scope_project", "consolidated_count")
_JUDGED = """judged AS (SELECT l.id AS log_id, l.relation_id, l.relation_type_before AS kind, CASE upper(trim(l.verdict)) WHEN 'INDEPENDENT' THEN 'UNRELATED'
  WHEN 'DUPLICATE' THEN CASE l.relation_type_before WHEN 'CONTRADICTS' THEN 'SUPERSEDED_BY_SOURCE' ELSE 'TARGET_REDUNDANT' END WHEN 'EVOLUTION' THEN CASE l.relation_type_before WHEN 'CONTRADICTS' THEN 'SUPERSEDED_BY_TARGET' ELSE 'SOURCE_REDUNDANT' END
  WHEN 'CONTRADICTION' THEN CASE l.relation_type_before WHEN 'CONTRADICTS' THEN 'RELATED_NOT_CONFLICTING' ELSE 'BOTH_VALID' END ELSE 'UNCLEAR' END AS verdict, l.confidence AS c, s.id AS sid, t.id AS tid, s.fact AS sf, t.fact AS tf, s.scope_type IS NOT DISTINCT FROM t.scope_type AND s.scope_project IS NOT DISTINCT FROM t.scope_project AS same, s.consolidated_count AS sn, t.consolidated_count AS tn,
  l.action, l.source_fact IS NOT DISTINCT FROM s.fact AND l.target_fact IS NOT DISTINCT FROM t.fact AS unchanged FROM {log} l JOIN facts s ON s.id = l.source_fact_id JOIN facts t ON t.id = l.target_fact_id),
plans AS (SELECT *, CASE WHEN sid = tid OR c IS NULL THEN 'keep'
  WHEN kind = 'CONTRADICTS' AND c >= 0.6 AND verdict IN ('RELATED_NOT_CONFLICTING', 'SUPERSEDED_BY_SOURCE', 'SUPERSEDED_BY_TARGET') THEN 'retype'
  WHEN kind IN ('CONTRADICTS', 'SUPERSEDES') AND c >= 0.6 AND verdict = 'UNRELATED' THEN 'delete'
  WHEN kind = 'SUPERSEDES' AND c >= 0.6 AND verdict = 'BOTH_VALID' THEN 'retype'
  WHEN kind = 'SUPERSEDES' AND c >= 0.9 AND same AND length(sf) <= 2000 AND length(tf) <= 2000 AND (verdict = 'TARGET_REDUNDANT' AND tn <= sn OR verdict = 'SOURCE_REDUNDANT' AND sn <= tn) THEN 'deactivate' ELSE 'keep' END AS plan FROM judged)"""
_PLAN_COLUMNS = """plan, CASE WHEN plan = 'retype' THEN CASE WHEN verdict IN ('RELATED_NOT_CONFLICTING', 'BOTH_VALID') THEN 'INFLUENCES' ELSE 'SUPERSEDES' END END AS plan_type,
CASE WHEN plan = 'keep' THEN NULL WHEN verdict IN ('SUPERSEDED_BY_TARGET', 'TARGET_REDUNDANT') THEN tid ELSE sid END AS plan_first, CASE WHEN plan = 'keep' THEN NULL WHEN verdict IN ('SUPERSEDED_BY_TARGET', 'TARGET_REDUNDANT') THEN sid ELSE tid END AS plan_second"""


def _pairs(s, d, log):
    facts = V.facts(s, d)
    ends = {p: facts.select(*[F.col(c).alias(f"{p}_{c}") for c in _ENDS]) for p in "st"}
    # the log here has other words for verdicts than the policy
    said, on_conflict = F.upper(F.trim("verdict")), F.col("relation_type_before") == "CONTRADICTS"
    words = {"DUPLICATE": ("SUPERSEDED_BY_SOURCE", "TARGET_REDUNDANT"), "EVOLUTION": ("SUPERSEDED_BY_TARGET", "SOURCE_REDUNDANT"), "CONTRADICTION": ("RELATED_NOT_CONFLICTING", "BOTH_VALID")}
    verdict = F.when(said == "INDEPENDENT", "UNRELATED")
    for word, (conflict, other) in words.items():
        verdict = verdict.when(said == word, F.when(on_conflict, conflict).otherwise(other))
    l = log.select(F.col("id").alias("log_id"), "relation_id", F.col("relation_type_before").alias("relation_type"), verdict.otherwise("UNCLEAR").alias("verdict"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "action", F.col("source_fact_id").alias("s_id"), F.col("target_fact_id").alias("t_id"), "source_fact", "target_fact")
    return l.join(ends["s"], "s_id").join(ends["t"], "t_id")


@query("f17_plans", sql(f"SELECT log_id, {_PLAN_COLUMNS} FROM plans", _JUDGED.format(log="(SELECT * REPLACE (CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence) FROM log)")))
def _(s, d):
    """What every judged pair of the log comes to with the facts as they are now."""
    return P.planned(_pairs(s, d, V.log(s, d))).select("log_id", "plan", "plan_type", "plan_first", "plan_second")


@query("f20_replans", sql(f"SELECT * FROM (SELECT relation_id, {_PLAN_COLUMNS}, row_number() OVER (ORDER BY relation_id) AS number FROM plans WHERE unchanged AND action IN ('keep', 'delete', 'retype') AND plan <> 'keep') WHERE number <= 500",
  _JUDGED.format(log="(SELECT * REPLACE (CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence) FROM log WHERE relation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relation_type_before, relation_id ORDER BY id DESC) = 1)")))
def _(s, d):
    """The first 500 changes that the last verdicts on unchanged facts come to; pairs that stay don't count."""
    last = R.latest(V.log(s, d).where("relation_id is not null"), ["relation_type_before", "relation_id"], [F.desc("id")])
    same = F.col("source_fact").eqNullSafe(F.col("s_fact")) & F.col("target_fact").eqNullSafe(F.col("t_fact"))
    plans = P.planned(_pairs(s, d, last).where(same & F.col("action").isin(P.REPLANNABLE))).where("plan != 'keep'").select("relation_id", "plan", "plan_type", "plan_first", "plan_second")
    return R.numbered(Workspace(s, "f20"), plans.withColumn("_all", F.lit(1)), ["_all"], ["relation_id", "plan_first", "plan_second", "plan"], "number").where("number < 500").withColumn("number", F.col("number") + 1).drop("_all")


_STATE = "states AS (SELECT session_id, CAST(CASE length(session_id) % 2 + CAST('0x' || substr(md5(session_id), 1, 4) AS INTEGER) % 5 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN -3 WHEN 3 THEN -4 WHEN 4 THEN -3 ELSE 7 END AS INTEGER) AS state, max(timestamp) AS since FROM ex WHERE session_id IS NOT NULL GROUP BY session_id)"


@query("f8_claims", sql(f"SELECT session_id, state, fresh, state = -4 OR state = -3 AND NOT fresh AS worker, NOT fresh AS own FROM (SELECT *, state = -3 AND coalesce(TRY_CAST(since AS TIMESTAMPTZ) > TIMESTAMPTZ '2025-09-01 00:00:00+00' - INTERVAL 30 MINUTES, false) AS fresh FROM states)", _STATE))
def _(s, d):
    """Which sessions a worker, and their own end, may take, by a state that stands for one of the table of states."""
    now = F.lit("2025-09-01 00:00:00").cast("timestamp")
    n = F.length("session_id") % 2 + F.conv(F.substring(F.md5("session_id"), 1, 4), 16, 10).cast("int") % 5
    state = F.when(n == 0, P.SEED).when(n == 1, P.PERMANENT).when(n.isin(2, 4), P.CLAIMED).when(n == 3, P.RETRIABLE).otherwise(7)
    ex = V.exchange_meta(s, d).where("session_id is not null").groupBy("session_id").agg(F.max("timestamp").alias("since")).withColumn("state", state)
    claim = lambda worker: P.may_claim(F.col("state"), F.col("since"), now, worker)
    return ex.select("session_id", "state", P.is_fresh(F.col("state"), F.col("since"), now).alias("fresh"), claim(True).alias("worker"), claim(False).alias("own"))


@query("f23_decisions", sql("SELECT id FROM ex WHERE regexp_matches(coalesce(user_message, '') || ' ' || coalesce(assistant_message, ''), '(?i)decision|decided|chose|approach|instead|because|rename|schema')"))
def _(s, d):
    """Exchanges that may hold a decision, before anything reads them."""
    words = ["decision", "decided", "chose", "approach", "instead", "because", "rename", "schema"]
    return V.exchanges(s, d).where(names_any("user_message", "assistant_message", words=words)).select("id")


@query("r15_runs", sql("SELECT relation_type_before AS kind, substr(ts, 1, 7) AS month, count(*) AS pairs, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action <> 'keep') AS changed, count(DISTINCT relation_id) AS relations FROM log GROUP BY 1, 2"))
def _(s, d):
    return V.log(s, d).groupBy(F.col("relation_type_before").alias("kind"), F.substring("ts", 1, 7).alias("month")).agg(F.count("*").alias("pairs"), F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") != "keep").alias("changed"), F.countDistinct("relation_id").alias("relations"))


@query("r17_conversation_text", sql("""SELECT session_id, CAST(n // 8 AS BIGINT) AS batch, string_agg('User: ' || coalesce(user_message, '') || chr(10) || chr(10) || 'Agent: ' || coalesce(assistant_message, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(timestamp, ''), id) - 1 AS n FROM ex WHERE session_id IS NOT NULL) GROUP BY 1, 2"""))
def _(s, d):
    """What a summariser reads of each session, eight exchanges at a time."""
    ex = V.exchanges(s, d).where("session_id is not null").select("session_id", "id", F.coalesce("timestamp", F.lit("")).alias("at"), "user_message", "assistant_message")
    return L.conversation_texts(R.batched(Workspace(s, "r17"), ex, ["session_id"], ["at", "id"], 8), "session_id")


@query("v12_annotated_facts", sql("""SELECT f.id, f.category_id, c.domain_id, coalesce(r.n, 0) AS revisions, coalesce(e.n, 0) AS relations, coalesce(e.conflicts, 0) AS conflicts FROM facts f LEFT JOIN cats c ON c.category_id = f.category_id
LEFT JOIN (SELECT lower(trim(id)) AS id, count(DISTINCT fact) AS n FROM sync_fact GROUP BY 1) r ON r.id = f.id
LEFT JOIN (SELECT id, count(*) AS n, count(*) FILTER (relation_type = 'CONTRADICTS') AS conflicts FROM (SELECT source_id AS id, relation_type FROM edges UNION ALL SELECT target_id, relation_type FROM edges) GROUP BY 1) e ON e.id = f.id WHERE f.is_active"""))
def _(s, d):
    """Active facts with all that a search shows beside a hit."""
    revisions = table(s, d, "sync_fact").groupBy(V.norm_id("id").alias("id")).agg(F.countDistinct("fact").alias("revisions"))
    return G.annotated(V.facts(s, d).where("is_active").select("id", "category_id"), V.categories(s, d), revisions, V.edges(s, d))


@query("a9_recommendations", sql("""SELECT what, n FROM (SELECT 'sessions without facts' AS what, count(DISTINCT session_id) AS n FROM ex WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT e.session_id FROM ex e JOIN (SELECT unnest(CAST(src AS VARCHAR[])) AS x FROM facts) f ON f.x = e.id WHERE e.session_id IS NOT NULL)
UNION ALL SELECT 'conversations without an answer', count(*) FROM (SELECT archive_path FROM ex WHERE archive_path IS NOT NULL GROUP BY 1 HAVING bool_and(trim(coalesce(assistant_message, ''), ' ') = ''))
UNION ALL SELECT 'failed calls', count(*) FROM calls WHERE is_error) WHERE n > 0"""))
def _(s, d):
    ex, cited = V.exchanges(s, d).select("id", "session_id", "archive_path", "assistant_message"), V.facts(s, d).select(F.explode("source_exchange_ids").alias("id")).distinct()
    done = ex.join(cited, "id", "left_semi").where("session_id is not null").select("session_id").distinct()
    open_ = ex.where("session_id is not null").select("session_id").distinct().join(done, "session_id", "left_anti")
    silent = ex.where("archive_path is not null").groupBy("archive_path").agg(F.bool_and(F.trim(F.coalesce("assistant_message", F.lit(""))) == "").alias("silent")).where("silent")
    return A.recommendations({"sessions without facts": open_, "conversations without an answer": silent, "failed calls": V.calls(s, d).where("is_error")})


def _lines(s, d):
    """Messages of ``short_conversation`` with the number of their line, where each session is a file in order of time."""
    m = table(s, d, "short_conversation").where(F.col("type").isin("user", "assistant"))
    m = m.select(V.norm_id("sessionId").alias("file"), V.norm_id("uuid").alias("id"), "type", "timestamp", "isSidechain", "sessionId", "cwd", "gitBranch", "version", F.struct(F.col("type").alias("role"), F.col("message.content").alias("content")).alias("message"), F.trim(F.coalesce(X.block_text(F.col("message.content")), F.lit(""))).alias("said"))
    once = m.where("file is not null and id is not null").groupBy("file", "id").agg(F.min_by(F.struct("type", "timestamp", "sessionId", "cwd", "gitBranch", "version", "message"), F.struct(F.coalesce("timestamp", F.lit("")), "said")).alias("r"))
    return once.select("file", F.coalesce("r.timestamp", F.lit("")).alias("at"), "id", "r.*")


_FOUND = f"""WITH {SESSION_MESSAGES},
g AS (SELECT *, sum(CAST(role = 'user' AND text <> '' AS INTEGER)) OVER (PARTITION BY file ORDER BY seen, uuid ROWS UNBOUNDED PRECEDING) AS turn FROM u)
SELECT file, max(CASE WHEN role = 'user' AND text <> '' THEN text END) AS user_message, string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY seen, uuid) AS assistant_message{{more}}
FROM g WHERE turn > 0 GROUP BY file, turn HAVING count(*) FILTER (role = 'assistant' AND text <> '') > 0"""


@query("src1_dialect_a", _FOUND.format(more=", CAST(sum(tools) AS BIGINT) AS tools"))
def _(s, d):
    """JSON lines of dialect A, a file a session, parsed to exchanges."""
    ws = Workspace(s, "src1a")
    line = F.to_json(F.struct("type", "timestamp", F.col("id").alias("uuid"), "sessionId", "cwd", "gitBranch", "version", "message"))
    raw = R.numbered(ws, _lines(s, d), ["file"], ["at", "id"], "line").select("file", (F.col("line") + 1).alias("line"), line.alias("text"))
    return X.exchanges(X.messages_a(raw), ws).select("file", "user_message", "assistant_message", F.size("tools").cast("bigint").alias("tools"))


@query("src2_dialect_b", _FOUND.format(more=", 'of ' || file AS session_id"))
def _(s, d):
    """The same messages as lines of dialect B, under a first line that names the session."""
    ws = Workspace(s, "src2b")
    numbered = R.numbered(ws, _lines(s, d), ["file"], ["at", "id"], "line")
    said = F.array(F.struct(F.lit("output_text").alias("type"), F.trim(F.coalesce(X.block_text(F.col("message.content")), F.lit(""))).alias("text")))
    payload = F.struct(F.lit("message").alias("type"), F.col("message.role").alias("role"), said.alias("content"))
    lines = numbered.select("file", (F.col("line") + 2).alias("line"), F.to_json(F.struct("timestamp", F.lit("response_item").alias("type"), payload.alias("payload"))).alias("text"))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("of "), "file").alias("id"), F.lit("/w").alias("cwd")).alias("payload")))
    heads = numbered.select("file").distinct().select("file", F.lit(1).cast("bigint").alias("line"), head.alias("text"))
    return X.exchanges(X.messages_b(lines.unionByName(heads), ws), ws).select("file", "user_message", "assistant_message", "session_id")


@query("src10_ingested", f"""WITH {SESSION_MESSAGES},
g AS (SELECT *, sum(CAST(role = 'user' AND text <> '' AS INTEGER)) OVER (PARTITION BY file[1] ORDER BY file, seen, uuid ROWS UNBOUNDED PRECEDING) AS turn FROM u)
SELECT 'bucket=' || file[1] AS project, max(CASE WHEN role = 'user' AND text <> '' THEN text END) AS user_message, string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY file, seen, uuid) AS assistant_message
FROM g WHERE turn > 0 GROUP BY file[1], turn HAVING count(*) FILTER (role = 'assistant' AND text <> '') > 0""")
def _(s, d):
    """Files of lines, some sessions in each, brought into a store in two runs; the second finds only the files that came since, and nothing twice."""
    ws = Workspace(s, "src10")
    line = F.to_json(F.struct("type", "timestamp", F.col("id").alias("uuid"), "sessionId", "cwd", "gitBranch", "version", "message"))
    rows = _lines(s, d).select(F.substring("file", 1, 1).alias("bucket"), "file", "at", "id", line.alias("value"))
    store, folder = Store(s, ws.child("store")), ws.child("lines")
    ordered = rows.repartitionByRange("bucket").sortWithinPartitions("bucket", "file", "at", "id").select("bucket", "value")
    for part in (F.col("bucket") < "8", F.col("bucket") >= "8"):
        ordered.where(part).write.mode("append").partitionBy("bucket").option("compression", "none").text(folder)
        ingest_transcripts(s, folder, store, ws, glob="*.txt")
    ingest_transcripts(s, folder, store, ws, glob="*.txt")
    return store.read("exchanges").select("project", "user_message", "assistant_message")


@query("src13_deleted", sql("SELECT 'exchanges' AS kind, count(*) AS n FROM ex WHERE NOT coalesce(is_sidechain, false) UNION ALL SELECT 'calls', count(*) FROM calls WHERE exchange_id IS NULL OR exchange_id NOT IN (SELECT id FROM ex WHERE is_sidechain)"))
def _(s, d):
    """What is left when the exchanges of sidechains go with their calls."""
    ex = V.exchange_meta(s, d)
    left, calls = R.delete_with_children(ex, [(V.calls(s, d), "exchange_id")], ex.where("is_sidechain").select("id"))
    return left.agg(F.count("*").alias("n")).select(F.lit("exchanges").alias("kind"), "n").unionByName(calls.agg(F.count("*").alias("n")).select(F.lit("calls").alias("kind"), "n"))


@query("f1_extracted", sql("""SELECT session_id, fact, confidence FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, fact) AS place FROM (
  SELECT session_id, substr(user_message, 1, 24) AS fact, (length(user_message) % 100) / 100.0 AS confidence FROM ex WHERE session_id IS NOT NULL AND user_message <> ''
  QUALIFY row_number() OVER (PARTITION BY session_id, trim(regexp_replace(regexp_replace(lower(substr(user_message, 1, 24)), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), '[.!。]+$', ''), ' ') ORDER BY (length(user_message) % 100) / 100.0 DESC, substr(user_message, 1, 24)) = 1 AND (length(user_message) % 100) / 100.0 >= 0.7)) WHERE place <= 20"""))
def _(s, d):
    """Facts of an extractor that takes the beginning of each message: gated, each text once a session, the surest twenty."""
    ex = V.exchanges(s, d).where("session_id is not null and user_message != ''").select("session_id", "user_message")

    def extractor(p):
        return p.assign(fact=p["user_message"].str[:24], confidence=(p["user_message"].str.len() % 100) / 100.0)[["session_id", "fact", "confidence"]]

    return L.extracted(ex, extractor, "session_id string, fact string, confidence double")


@query("f11_registry", "SELECT source AS slug, CAST(coalesce(max_repeats, 1) + 10 AS INTEGER) AS weight FROM mix_targets UNION ALL SELECT DISTINCT lower(trim(source, ' ')), 0 FROM documents WHERE source IS NOT NULL AND lower(trim(source, ' ')) NOT IN (SELECT source FROM mix_targets WHERE source IS NOT NULL)")
def _(s, d):
    """A registry by slug: the names that documents give, replaced by the entries that a later list has."""
    first = V.documents(s, d).where("source is not null").select(T.slug("source").alias("slug"), F.lit(0).alias("weight")).distinct()
    later = table(s, d, "mix_targets").select(F.col("source").alias("slug"), (F.coalesce("max_repeats", F.lit(1)) + 10).cast("int").alias("weight"))
    return R.upsert(first, later, ["slug"])


@query("f12_conflict_pairs", sql("""SELECT a, b, min(how) AS how FROM (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, '1 settled' AS how FROM edges WHERE relation_type = 'SUPERSEDES'
UNION ALL SELECT DISTINCT least(source_id, target_id), greatest(source_id, target_id), '2 open' FROM edges WHERE relation_type = 'CONTRADICTS') GROUP BY 1, 2"""))
def _(s, d):
    """Pairs in conflict beside those that are settled already, which stay as they are."""
    pair = lambda kind, how: V.edges(s, d).where(F.col("relation_type") == kind).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.lit(how).alias("how")).distinct()
    return R.insert_absent(pair("SUPERSEDES", "1 settled"), pair("CONTRADICTS", "2 open"), ["a", "b"])


@query("f14_valid_findings", sql("""SELECT batch, item_index, slug, confidence FROM (SELECT *, count(*) OVER (PARTITION BY batch, item_index, slug) AS n FROM (SELECT id // 20 AS batch, CAST(id % 23 - 1 AS INTEGER) AS item_index, lower(action) AS slug, confidence FROM log)
WHERE item_index >= 0 AND item_index < 20 AND slug IN ('keep', 'delete', 'retype') AND confidence >= 0.5 AND confidence <= 1 AND NOT isnan(confidence)) WHERE n = 1"""))
def _(s, d):
    """Rows of the log read as findings on the items of batches: those in range, of a known name, sure enough and claimed once."""
    found = V.log(s, d).select((F.floor(F.col("id") / 20)).cast("bigint").alias("batch"), (F.col("id") % 23 - 1).cast("int").alias("item_index"), F.lower("action").alias("slug"), "confidence")
    return L.valid_findings(found, 20, ["keep", "delete", "retype"], 0.5)


@query("f26_purged", sql("""SELECT 'exchanges' AS kind, count(*) AS n FROM ex WHERE id NOT IN (SELECT id FROM ex WHERE starts_with(user_message, 'The nightly job') OR (user_message = 'Warmup' AND is_sidechain))
UNION ALL SELECT 'calls', count(*) FROM calls WHERE exchange_id IS NULL OR exchange_id NOT IN (SELECT id FROM ex WHERE starts_with(user_message, 'The nightly job') OR (user_message = 'Warmup' AND is_sidechain))"""))
def _(s, d):
    """What is left when exchanges that are no conversation of a person go with their calls."""
    ex = V.exchanges(s, d).select("id", "project", "user_message", "is_sidechain")
    gone = ex.where(pollution(F.col("project"), F.col("user_message"), F.col("is_sidechain"), "no such project", ["The nightly job"])).select("id")
    left, calls = R.delete_with_children(ex, [(V.calls(s, d), "exchange_id")], gone)
    return left.agg(F.count("*").alias("n")).select(F.lit("exchanges").alias("kind"), "n").unionByName(calls.agg(F.count("*").alias("n")).select(F.lit("calls").alias("kind"), "n"))


@query("r11_conformed", "SELECT CAST(vec_id AS VARCHAR) AS id, TRY_CAST(CASE WHEN label % 2 = 0 THEN CAST(label AS VARCHAR) ELSE 'x' END AS INTEGER) AS label, CAST(NULL AS VARCHAR) AS note FROM embeddings WHERE label % 3 <> 0")
def _(s, d):
    """Rows of another shape brought to a schema: what can't be cast is null, a column that is missing too, unknown kinds are dropped."""
    raw = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, F.col("label").cast("string")).otherwise("x").alias("label"), F.when(F.col("label") % 3 == 0, "bad").otherwise("good").alias("kind"), "embedding")
    return conform(raw, StructType.fromDDL("id string, label int, note string, kind string"), {"kind": ["good"]}).drop("kind")


@query("src4_file_projects", f"""WITH {SESSION_MESSAGES}, w AS (SELECT nullif(lower(trim(sessionId, E' \\t\\r\\n\\f\\v')), '') AS file, cwd FROM short_conversation WHERE cwd IS NOT NULL AND type IN ('user', 'assistant') AND nullif(trim(uuid, E' \\t\\r\\n\\f\\v'), '') IS NOT NULL)
SELECT file, bool_or(cwd = '/work/orchard' OR starts_with(cwd, '/work/orchard/')) AS excluded FROM w WHERE file IS NOT NULL GROUP BY 1""")
def _(s, d):
    """Files of lines, and whether any folder that they name lies in an excluded one."""
    m = table(s, d, "short_conversation").where(F.col("type").isin("user", "assistant")).select(V.norm_id("sessionId").alias("file"), V.norm_id("uuid").alias("id"), F.monotonically_increasing_id().alias("line"), F.to_json(F.struct("type", "cwd")).alias("text"))
    return X.file_projects(m.where("file is not null and id is not null"), ["/work/orchard/"]).select("file", "excluded")


@query("src17_markdown_parts", """SELECT count(DISTINCT file) AS files, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS users, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS assistants FROM (
  SELECT nullif(lower(trim(sessionId, E' \\t\\r\\n\\f\\v')), '') AS file, nullif(lower(trim(uuid, E' \\t\\r\\n\\f\\v')), '') AS uuid, arg_min(type, coalesce(timestamp, '')) AS role FROM short_conversation WHERE type IN ('user', 'assistant') GROUP BY 1, 2) WHERE file IS NOT NULL AND uuid IS NOT NULL""")
def _(s, d):
    """Every session as Markdown: how many files, and headings of either speaker."""
    ws = Workspace(s, "src17")
    line = F.to_json(F.struct("type", "timestamp", "sessionId", F.struct(F.col("type").alias("role"), F.lit("words").alias("content")).alias("message")))
    raw = R.numbered(ws, _lines(s, d), ["file"], ["at", "id"], "line").select("file", (F.col("line") + 1).alias("line"), line.alias("text"))
    md = X.rendered(raw, ws)
    heads = lambda who: F.size(F.regexp_extract_all("markdown", F.lit(f"(?m)^## {who}$"), F.lit(0)))
    return md.agg(F.count("*").alias("files"), F.sum(heads("User").cast("bigint")).alias("users"), F.sum(heads("Assistant").cast("bigint")).alias("assistants"))


QUERIES, ORACLE = Q, O
