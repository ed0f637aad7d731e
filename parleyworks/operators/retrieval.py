"""Search: exact nearest neighbours of a stated set of queries, BM25, rarest-token ladder, and their combinations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..session import Workspace
from .tables import first_wins

#: Query vectors that go to every executor at once; more are searched in so many passes over the corpus.
QUERIES_PER_PASS = 20_000
K1, B = 1.2, 0.75
#: Tasks over which the postings of one word are spread in an index.
SPREAD = 16


def knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", skip_same: bool = True, least: float | None = None, chunk: int = 2048, within: str | None = None, earlier: bool = False) -> DataFrame:
    """(query_id, item_id, cosine, rank): the k corpus vectors with the highest cosine to each query vector, exactly.

    The queries, a stated set, go to the executors in passes of bounded size; each task scans its rows in blocks against all of
    them and keeps k per query, so what is shuffled is tasks x queries x k. Null, zero and other-length vectors have no neighbours
    and are none. ``skip_same`` leaves out the item with the query's own id; ``least`` drops what is less similar; ``within`` names a column
    in which both must be equal; with ``earlier`` only items of smaller id count. Ties go to the smaller id.
    """
    spark = corpus.sparkSession
    kinds = {"q": queries.schema[query_id].dataType.simpleString(), "i": corpus.schema[item_id].dataType.simpleString()}
    group = F.col(within).cast("string") if within else F.lit("")
    usable = queries.where(F.col(vector).isNotNull()).select(query_id, vector, group.alias("_group"))
    total = usable.count()
    passes = max(1, -(-total // QUERIES_PER_PASS))
    out = None
    for n in range(passes):
        rows = usable.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == n).collect()
        if not rows:
            continue
        dim = max(len(r[1]) for r in rows)
        rows = [r for r in rows if len(r[1]) == dim]
        q = np.array([r[1] for r in rows], dtype=np.float64)
        norm = np.sqrt((q * q).sum(axis=1))
        keep = np.isfinite(norm) & (norm > 0)
        q = q[keep] / norm[keep][:, None]
        ids = np.array([r[0] for r in rows], dtype=object)[keep]
        groups = np.array([r[2] for r in rows], dtype=object)[keep]
        held = spark.sparkContext.broadcast((ids, q, groups))
        # rows of a block, so that its similarities take no more than so many numbers
        rows_at_once = max(64, min(chunk, 10_000_000 // max(1, len(ids))))

        def scan(parts: Iterator[pd.DataFrame], held=held, dim=dim, chunk=rows_at_once) -> Iterator[pd.DataFrame]:
            ids, q, groups = held.value
            best_s = np.full((len(ids), 0), 0.0)
            best_i = np.empty((len(ids), 0), dtype=object)
            for p in parts:
                p = p[p[vector].map(lambda v: v is not None and len(v) == dim)]
                for a in range(0, len(p), chunk):
                    part = p.iloc[a : a + chunk]
                    x = np.array(part[vector].tolist(), dtype=np.float64)
                    with np.errstate(all="ignore"):
                        n = np.sqrt((x * x).sum(axis=1))
                        ok = np.isfinite(n) & (n > 0)
                        x = x[ok] / n[ok][:, None]
                    own = part[item_id].to_numpy(dtype=object)[ok]
                    s = q @ x.T
                    if within:
                        s[groups[:, None] != part["_group"].to_numpy(dtype=object)[ok][None, :]] = -np.inf
                    if earlier:
                        s[(own[None, :] >= ids[:, None]).astype(bool)] = -np.inf
                    if skip_same:
                        s[ids[:, None] == own[None, :]] = -np.inf
                    s = np.hstack([best_s, s])
                    i = np.hstack([best_i, np.broadcast_to(own, (len(ids), len(own)))])
                    if s.shape[1] > k + 16:
                        s, i = _kept(s, i, k)
                    best_s, best_i = s, i
            rows = [(ids[r], best_i[r, c], float(best_s[r, c])) for r in range(len(ids)) for c in range(best_s.shape[1]) if np.isfinite(best_s[r, c]) and (least is None or best_s[r, c] >= least)]
            yield pd.DataFrame(rows, columns=[query_id, item_id, "cosine"])

        found = corpus.select(item_id, vector, group.alias("_group")).where(F.col(vector).isNotNull()).mapInPandas(scan, f"`{query_id}` {kinds['q']}, `{item_id}` {kinds['i']}, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"`{query_id}` {kinds['q']}, `{item_id}` {kinds['i']}, cosine double")
    w = Window.partitionBy(query_id).orderBy(F.desc("cosine"), item_id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _kept(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k + 16 best columns of each row; where more than that tie with the k-th, those of the smaller ids."""
    width = k + 16
    near = np.argpartition(-s, width - 1, axis=1)[:, :width]
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    for r in np.flatnonzero((s >= kth[:, None]).sum(axis=1) > width):
        tied = np.flatnonzero(s[r] >= kth[r])
        near[r] = sorted(tied.tolist(), key=lambda c: (-s[r, c], i[r, c]))[:width]
    return np.take_along_axis(s, near, 1), np.take_along_axis(i, near, 1)


def post_filtered(found: DataFrame, rows: DataFrame, item_id: str, keep) -> DataFrame:
    """The neighbours that pass a filter applied after the search, so there may be fewer than k."""
    return found.join(rows.where(keep), item_id)


def best_of(parts: list[DataFrame], query_id: str, item_id: str, k: int) -> DataFrame:
    """Neighbours from several indexes: the highest cosine per item, ranked anew."""
    both = parts[0].select(query_id, item_id, "cosine")
    for p in parts[1:]:
        both = both.unionByName(p.select(query_id, item_id, "cosine"))
    best = both.groupBy(query_id, item_id).agg(F.max("cosine").alias("cosine"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("cosine"), item_id))).where(F.col("rank") <= k)


def surprise(nearest: DataFrame, items: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, surprise): 1 minus the highest cosine to any other, in 0..1; 1 where there is no other."""
    best = nearest.groupBy(query_id).agg(F.max("cosine").alias("best"))
    return items.select(query_id).join(best, query_id, "left").select(query_id, F.least(F.greatest(1 - F.coalesce("best", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("surprise"))


def multi_concept(found: DataFrame, items: DataFrame, concepts: int, query_id: str, item_id: str, group: str) -> DataFrame:
    """Groups in which every concept (query) has a hit: (group, score), the mean over concepts of its best similarity there."""
    per = found.join(items.select(item_id, group), item_id).groupBy(group, query_id).agg(F.max("cosine").alias("best"))
    return per.groupBy(group).agg(F.count("*").alias("n"), F.avg("best").alias("score")).where(F.col("n") == concepts).select(group, "score")


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(token, doc_id, tf, len): words of each text in small letters with their count and the text's number of words.

    Counted inside the row, so nothing is shuffled. Null and empty texts have no rows.
    """
    words = docs.select(doc_id, F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)).alias("w")).where(F.size("w") > 0)
    one = words.select(doc_id, F.size("w").alias("len"), F.explode("w").alias("token"))
    return one.groupBy(doc_id, "len", "token").agg(F.count("*").alias("tf")).select("token", doc_id, "tf", "len")


class TextIndex:
    """Postings of a table of texts, written once and read by every search: those of a token together and in order, with the number and mean length of the
    texts and in how many of them each token occurs."""

    def __init__(self, docs: DataFrame, ws: Workspace, doc_id: str, text: str):
        self.ws = ws
        made = postings(docs, doc_id, text)
        # the postings of a frequent word are spread over so many tasks
        spread = made.repartition("token", F.pmod(F.xxhash64(doc_id), F.lit(SPREAD)))
        self.post = ws.save(spread.sortWithinPartitions("token"), "postings")
        self.frequency = ws.save(document_frequency(self.post), "frequency")
        n = self.post.groupBy(doc_id).agg(F.first("len").alias("len")).agg(F.count("*"), F.avg("len")).first()
        self.docs, self.mean_len = n[0], n[1] or 1.0


_indexes: dict[tuple, TextIndex] = {}


def text_index(state: tuple, build: Callable[[], TextIndex]) -> TextIndex:
    """The index of a table in this state; built at the first search, and again when the table's files have changed or the index is gone."""
    known = _indexes.get(state)
    if known is None or not (known.ws.holds(known.post) and known.ws.holds(known.frequency)):
        for old in [k for k in _indexes if k[:2] == state[:2]]:
            del _indexes[old]
        known = _indexes[state] = build()
    return known


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def bm25(query_tokens: DataFrame, post: DataFrame, docs: int, mean_len: float, doc_id: str, query_id: str = "query_id", k: int = 10, all_tokens: bool = False, df: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 over the tokens of each query (query_id, token), k a query.

    Only tokens that occur in queries are joined. ``all_tokens`` keeps the documents that hold every token of the query. Ties go to
    the smaller id.
    """
    q = query_tokens.select(query_id, "token").distinct()
    used = post
    if df is None:
        used = post.join(q.select("token").distinct(), "token", "left_semi")
        df = document_frequency(used)
    idf = F.log(1 + (F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(mean_len))))
    hits = q.join(df, "token").join(used, "token").select(query_id, doc_id, "token", part.alias("part"))
    scored = hits.groupBy(query_id, doc_id).agg(F.sum("part").alias("score"), F.count("*").alias("n"))
    if all_tokens:
        scored = scored.join(q.groupBy(query_id).agg(F.count("*").alias("wanted")), query_id).where("n = wanted")
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), doc_id)
    return scored.select(query_id, doc_id, "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rarest_ladder(query_tokens: DataFrame, post: DataFrame, doc_id: str, query_id: str = "query_id", rungs: int = 4, k: int = 20, df: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rung): documents that hold the 4, 3, 2 or 1 rarest tokens of a query, the longest such rung first.

    Tokens that occur nowhere are dropped. All rungs come from one join: a document's rung is the number of the leading rarest
    tokens that it holds without a gap.
    """
    q = query_tokens.select(query_id, "token").distinct()
    used = post
    if df is None:
        used = post.join(q.select("token").distinct(), "token", "left_semi")
        df = document_frequency(used)
    ranked = q.join(df, "token").withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy("df", "token"))).where(F.col("place") <= rungs)
    hits = ranked.join(used.select("token", doc_id), "token").groupBy(query_id, doc_id).agg(F.array_sort(F.collect_set("place")).alias("places"))
    rung = F.aggregate("places", F.lit(0), lambda acc, p: F.when(p == acc + 1, p).otherwise(acc))
    out = hits.select(query_id, doc_id, rung.alias("rung")).where("rung > 0")
    w = Window.partitionBy(query_id).orderBy(F.desc("rung"), doc_id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """Vector hits, then the text hits they lack: (query_id, item_id, match, rank in its own list); not cut again."""
    v = vector_hits.select(query_id, item_id, F.col("rank"), F.lit("vector").alias("match"))
    t = text_hits.select(query_id, item_id, F.col("rank"), F.lit("text").alias("match"))
    return first_wins([v, t], [query_id, item_id], ["rank"]).drop("pass_no")


def all_then_ladder(query_tokens: DataFrame, post: DataFrame, doc_id: str, query_id: str = "query_id", k: int = 10, df: DataFrame | None = None) -> DataFrame:
    """Documents with every token of a query first, then those of the rarest-token ladder, at most ``k`` a query: (query_id, doc_id, pass_no)."""
    whole = bm25(query_tokens, post, 1, 1.0, doc_id, query_id, k=2**31 - 1, all_tokens=True, df=df).select(query_id, doc_id, F.lit(0).alias("order"))
    rungs = rarest_ladder(query_tokens, post, doc_id, query_id, k=2 * k, df=df).select(query_id, doc_id, (-F.col("rung")).alias("order"))
    merged = first_wins([whole, rungs], [query_id, doc_id], ["order"])
    w = Window.partitionBy(query_id).orderBy("pass_no", "order", doc_id)
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, doc_id, "pass_no")


def surprise_in_order(batch: DataFrame, corpus: DataFrame, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, surprise) of a batch that is added one by one: each row is compared with the corpus and the rows of smaller id before it."""
    base = knn(batch, corpus.withColumnRenamed(corpus.columns[0], "item_id"), 1, query_id, "item_id", vector).select(query_id, "cosine")
    own = knn(batch, batch.withColumnRenamed(query_id, "item_id"), 1, query_id, "item_id", vector, earlier=True).select(query_id, "cosine")
    return surprise(base.unionByName(own), batch, query_id)


def recall_at(found: DataFrame, truth: DataFrame, query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """(queries, recall): the mean share of each query's true items that were found."""
    hit = truth.join(found.select(query_id, item_id).distinct().withColumn("_hit", F.lit(1)), [query_id, item_id], "left")
    per = hit.groupBy(query_id).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("r"))
    return per.agg(F.count("*").alias("queries"), F.avg("r").alias("recall"))
