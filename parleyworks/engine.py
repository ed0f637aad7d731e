"""One entry point with a method per question, over DataFrames of exchanges, facts, edges and categories."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import clipped, line_summary, path_slug, snippet, tokens
from .operators import analytics as A
from .operators import graph as G
from .operators import retrieval as S
from .operators.tables import budgeted
from .schema import DEFAULT_AGENT
from .session import Workspace

_DAY = re.compile(r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])")


@dataclass(frozen=True)
class SearchRequest:
    """A batch of searches: (query_id, text, embedding) rows come as a DataFrame, what they share comes here."""

    limit: int = 10
    mode: str = "both"
    after: str | None = None
    before: str | None = None
    agent: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 50:
            raise ValueError("limit must be from 1 to 50")
        if self.mode not in ("vector", "text", "both"):
            raise ValueError("mode must be vector, text or both")
        for name in ("after", "before"):
            day = getattr(self, name)
            if day is not None and not _DAY.fullmatch(day):
                raise ValueError(f"{name} must be a date as YYYY-MM-DD")

    def keep(self):
        """The filter on exchanges; times are compared as strings, so ``before`` leaves out the named day itself."""
        cond = F.lit(True)
        if self.after:
            cond = cond & (F.col("timestamp") >= self.after)
        if self.before:
            cond = cond & (F.col("timestamp") <= self.before)
        if self.agent:
            cond = cond & (F.coalesce("coding_agent", F.lit(DEFAULT_AGENT)) == self.agent)
        return cond


@dataclass
class Engine:
    """The tables of one store. ``encoder`` turns a column of texts into vectors; without one, queries bring theirs."""

    spark: SparkSession
    exchanges: DataFrame
    facts: DataFrame
    edges: DataFrame
    categories: DataFrame
    encoder: Callable | None = None
    _post: DataFrame | None = field(default=None, repr=False)

    def workspace(self, label: str) -> Workspace:
        return Workspace(self.spark, label)

    def postings(self) -> DataFrame:
        """The words of all exchanges, written once."""
        if self._post is None:
            both = self.exchanges.select("id", F.concat_ws("\n", "user_message", "assistant_message").alias("text"))
            self._post = self.workspace("postings").save(S.postings(both, "id", "text"), "postings")
        return self._post

    def with_vectors(self, queries: DataFrame) -> DataFrame:
        return queries if "embedding" in queries.columns or self.encoder is None else queries.withColumn("embedding", self.encoder("text"))

    def search(self, queries: DataFrame, request: SearchRequest | None = None, prefilter: bool = True) -> DataFrame:
        """(query_id, id, match, similarity, snippet) for each query (query_id, text, embedding).

        Vector hits come first, then the text hits they lack. With ``prefilter`` the filters apply before the search, so a query gets
        its full number; without, after it.
        """
        request = request or SearchRequest()
        keep = request.keep()
        rows = self.exchanges.where(keep) if prefilter else self.exchanges
        parts = []
        if request.mode in ("vector", "both"):
            found = S.knn(self.with_vectors(queries).select("query_id", "embedding"), rows.select(F.col("id").alias("item_id"), "embedding"), request.limit, skip_same=False)
            parts.append(found.withColumn("match", F.lit("vector")))
        if request.mode in ("text", "both"):
            post = self.postings()
            n, mean = post.groupBy("id").agg(F.first("len").alias("len")).agg(F.count("*"), F.avg("len")).first()
            q = queries.select("query_id", F.explode(tokens("text")).alias("token"))
            found = S.bm25(q, post.join(rows.select("id"), "id", "left_semi") if prefilter else post, n, mean or 1.0, "id", k=request.limit).withColumnRenamed("id", "item_id")
            parts.append(found.select("query_id", "item_id", F.lit(None).cast("double").alias("cosine"), "rank", F.lit("text").alias("match")))
        hits = S.first_wins(parts, ["query_id", "item_id"], ["rank"]) if len(parts) > 1 else parts[0].withColumn("pass_no", F.lit(0))
        shown = self.exchanges.where(keep).select(F.col("id").alias("item_id"), "project", "timestamp", "archive_path", snippet("user_message").alias("snippet"), line_summary("assistant_message").alias("answer"))
        return hits.join(shown, "item_id").select("query_id", F.col("item_id").alias("id"), "match", F.col("cosine").alias("similarity"), "rank", "project", "timestamp", "archive_path", "snippet", "answer")

    def search_all(self, concepts: DataFrame, limit: int = 10) -> DataFrame:
        """Conversations that match every one of 2 to 5 concepts (query_id, embedding)."""
        n = concepts.count()
        if not 2 <= n <= 5:
            raise ValueError("2 to 5 concepts are needed")
        items = self.exchanges.select(F.col("id").alias("item_id"), "embedding", "archive_path")
        found = S.knn(concepts, items.select("item_id", "embedding"), 5 * limit, skip_same=False)
        return S.multi_concept(found, items, n, "query_id", "item_id", "archive_path").orderBy(F.desc("score"), "archive_path").limit(limit)

    def visible(self, project: str | None) -> DataFrame:
        """Active facts of the project, by slug or path, and the global ones; all where no project is given."""
        active = self.facts.where("is_active")
        if project is None:
            return active
        slug = re.sub(r"[/._]", "-", project)
        return active.where((F.col("scope_type") == "global") | (path_slug("scope_project") == slug))

    def search_facts(self, queries: DataFrame, vectors: list[DataFrame], project: str | None = None, limit: int = 5, least: float = 0.85, category: str | None = None, revisions: DataFrame | None = None) -> DataFrame:
        """Facts near each query in any of the indexes (item_id, embedding), within a project's sight, with their domain, their number of
        revisions (fact_id, ...), of relations and of conflicts."""
        ids = self.visible(project)
        ids = (ids.where(F.col("category") == category) if category else ids).select(F.col("id").alias("item_id"))
        parts = [S.knn(self.with_vectors(queries).select("query_id", "embedding"), v.join(ids, "item_id", "left_semi"), limit, skip_same=False, least=least) for v in vectors]
        best = S.best_of(parts, "query_id", "item_id", limit)
        hits = best.join(self.facts.select(F.col("id").alias("item_id"), clipped("fact").alias("fact"), "category", "scope_project", "category_id"), "item_id")
        changes = self.facts.select("id", F.lit(0).alias("revisions")).limit(0) if revisions is None else revisions.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("revisions"))
        return G.annotated(hits.withColumnRenamed("item_id", "id"), self.categories, changes, self.edges).withColumnRenamed("id", "item_id")

    def explore(self, seeds: DataFrame, hops: int = 2) -> DataFrame:
        """What seeds (id) reach within 1 to 3 hops, with the facts' texts."""
        if not 1 <= hops <= 3:
            raise ValueError("hops must be from 1 to 3")
        reached = G.related(seeds, self.edges, self.facts, self.workspace("explore"), hops=hops)
        return reached.join(self.facts.select("id", clipped("fact").alias("fact"), "category"), "id")

    def provenance(self, facts: DataFrame) -> DataFrame:
        return G.provenance(self.facts.join(facts.select("id"), "id", "left_semi"), self.exchanges)

    def context(self, hits: DataFrame, budget: int = 1_000, width: int = 160) -> DataFrame:
        """(query_id, block): facts found for each query as lines of at most ``width`` characters, as long as they fit the budget."""
        lines = hits.withColumn("line", F.concat(F.lit("- "), clipped("fact", width)))
        fit = budgeted(lines, ["query_id"], [F.col("rank")], F.length("line"), budget)
        return fit.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("block"))

    def answers(self, queries: DataFrame, vectors: list[DataFrame], answer: Callable, schema: str, project: str | None = None, limit: int = 10, least: float = 0.6) -> DataFrame:
        """Answers of an injected function over the facts found for each query: it gets pandas frames (query_id, block) and returns ``schema``."""
        hits = self.search_facts(queries, vectors, project, limit, least)

        def run(parts):
            for p in parts:
                yield answer(p)

        return self.context(hits, budget=10_000).mapInPandas(run, schema)

    def consistency(self) -> DataFrame:
        return G.consistency_counts(self.facts, self.edges)

    def ontology(self) -> DataFrame:
        return G.ontology_tree(self.facts, self.categories)

    def report(self, projects: int = 20, months: int = 12) -> str:
        """Coverage, projects, months and facts as Markdown."""
        parts = {"Coverage": A.coverage(self.exchanges), "Projects": A.project_report(self.exchanges, self.facts, projects), "Months": A.monthly(self.exchanges, months).orderBy("month"), "Facts": A.fact_counts(self.facts).orderBy("kind", "value"), "Consistency": self.consistency()}
        cited = self.facts.select(F.explode("source_exchange_ids").alias("id")).distinct()
        done = self.exchanges.join(cited, "id", "left_semi").select("session_id").where("session_id is not null").distinct()
        without = self.exchanges.select("session_id").where("session_id is not null").distinct().join(done, "session_id", "left_anti")
        silent = self.exchanges.where("coalesce(trim(assistant_message), '') = ''")
        parts["Recommendations"] = A.recommendations({"sessions without facts": without, "exchanges without an answer": silent})
        return "\n\n".join(f"## {name}\n\n{A.markdown_table(df)}" for name, df in parts.items())
