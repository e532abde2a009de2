"""Retrieval: postings, BM25, dense lanes, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import Rounds

K1, B = 1.4, 0.72


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, token, tf, doc_len`` of all documents' tokens."""
    rows = docs.select(key, tokens.alias("_t")).select(key, F.size("_t").alias("doc_len"), F.explode("_t").alias("token"))
    return rows.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"))


#: So many asked tokens at most are sent to the tasks that tokenise; of more, all tokens are kept and met by a join.
MOST_ASKED = 10_000


def asked_postings(docs: DataFrame, key: str, tokens: str, queries: DataFrame) -> tuple[DataFrame, int, float]:
    """(``key, token, tf, doc_len`` of the tokens of ``queries`` only, number of documents with a token, their mean length).

    The documents are tokenised once: lengths and the asked tokens are written, the sums over all
    documents taken in passing, and no other token is shuffled.
    """
    asked = [r[0] for r in queries.select("token").distinct().limit(MOST_ASKED + 1).collect()]
    kept = F.filter(tokens, lambda x: x.isin(asked)) if len(asked) <= MOST_ASKED else F.col(tokens)
    # no filter here: pushed below the tokenising, it would tokenise once more
    rows = docs.select(key, F.size(tokens).alias("doc_len"), kept.alias("kept"))
    rows = Rounds(docs.sparkSession).cut(rows, n=F.expr("count_if(doc_len > 0)"), total=F.sum("doc_len"))
    hits = rows.select(key, "doc_len", F.explode("kept").alias("token")).join(F.broadcast(queries.select("token").distinct()) if len(asked) <= MOST_ASKED else queries.select("token").distinct(), "token")
    n, total = rows.measured["n"], rows.measured["total"] or 0
    return hits.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len")), n, total / n if n else 0.0


def bm25(hits: DataFrame, n: int, mean: float, key: str, queries: DataFrame) -> DataFrame:
    """``query, key, score``: BM25 of each query (query, token; tokens distinct) over its tokens' postings among ``n`` documents of ``mean`` length.

    A token of a third of all rows is spread by the map-side sums of both groupings.
    """
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    wanted = queries.distinct().join(df, "token").withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(mean or 1.0)))
    return hits.join(wanted, "token").groupBy("query", key).agg(F.sum(part).alias("score"))


def top(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; the engine keeps ``k`` rows a task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """The dot product of two vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fused(lanes: list[tuple[DataFrame, float]], keys: list[str], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of lanes (``keys`` and ``rank``): ``score`` and the number of ``lanes``."""
    rows = None
    for i, (lane, weight) in enumerate(lanes):
        part = lane.select(*keys, (F.lit(float(weight)) / (k + F.col("rank"))).alias("_w"), F.lit(i).alias("_lane"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*keys).agg(F.sum("_w").alias("score"), F.countDistinct("_lane").alias("lanes"))


def dense_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, k: int, block: int = 256, slab: int = 65_536) -> DataFrame:
    """``query``, ``key``, ``score``, ``rank``: the ``k`` nearest of all ``vectors`` to each query (columns ``query`` and ``vector``) by dot product, itself left out.

    Queries go in blocks of about ``block`` and vectors in slabs of about ``slab``; each block meets
    each slab in one group of rows, so tasks grow with both and none holds all of either. Null
    vectors are in no result; ties go to the least key; scores are rounded to six digits.
    """
    vectors, queries = vectors.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    blocks, slabs = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // slab))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select(F.col(query), F.col(vector).alias("_q"), some(query, blocks).alias("_block")).groupBy("_block").agg(F.collect_list(F.struct(query, "_q")).alias("_qs")).withColumn("_slab", each(slabs))
    rows = vectors.select(F.col(key), F.col(vector), some(key, slabs).alias("_slab")).withColumn("_block", each(blocks)).join(asked, ["_block", "_slab"])
    met = rows.select(key, vector, F.explode("_qs").alias("_x")).where(F.col(key) != F.col(f"_x.{query}"))
    scored = met.select(F.col(f"_x.{query}").alias(query), key, F.round(dot(F.col("_x._q"), F.col(vector)), 6).alias("score"))
    return top(scored, [query], [F.desc("score"), F.col(key)], k)
