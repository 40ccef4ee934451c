"""Ranked text search: BM25, if asked blended with vectors, then weighed with recency, trust and causal degree."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fields import text_columns
from tidemark.model import OTHER_WEIGHT, PROVENANCE_WEIGHT, Facts
from tidemark.operators import graph, vector
from tidemark.session import cut

K1, B = 1.5, 0.75
BASE, RECENCY, TRUST, DEGREE = 0.70, 0.12, 0.12, 0.06


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def query_terms(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[^\w]|_", text.lower()) if w))


def document(view: DataFrame, enrichments: DataFrame | None) -> DataFrame:
    """``view`` with ``_text``: subject, top-level strings and the latest texts that enrich the event."""
    parts = [F.col("subject"), *[F.array_join(a, " ") for a in text_columns(view)]]
    if enrichments is not None:
        texts = enrichments.where("text is not null").groupBy(F.col("target_event").alias("_e")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("_more"))
        view = view.join(texts, view["event_id"] == texts["_e"], "left").drop("_e")
        parts.append(F.col("_more"))
    return view.withColumn("_text", F.concat_ws(" ", *parts))


def _is(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows of ``docs`` that hold a term, with ``_bm`` instead of ``_text``. Texts are read and split once: what is counted, without
    them, is written to the shared folder. From there one pass counts documents, words and each term's documents in a single row;
    the second scores. No term is exploded to a row of its own, nothing is shuffled but that row."""
    counted = docs.withColumn("_w", tokens(F.col("_text")))
    counted = counted.withColumns({"_n": F.size("_w"), "_tf": F.array(*[F.size(F.filter("_w", _is(t))) for t in terms])})
    counted = cut(counted.drop("_w", "_text"))
    total = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_avg"), *[F.sum((F.col("_tf")[i] > 0).cast("bigint")).alias(f"_df{i}") for i in range(len(terms))])
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col("_tf")[i], F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))).otherwise(0.0)
    hit = counted.where(F.aggregate("_tf", F.lit(0), lambda a, x: a + x) > 0)
    return hit.crossJoin(F.broadcast(total)).withColumn("_bm", score).drop("_tf", "_n", "_docs", "_avg", *[f"_df{i}" for i in range(len(terms))])  # one row


def _scaled(df: DataFrame, **cols: Column) -> DataFrame:
    """Each column min-max scaled over all rows; 1 where all are equal."""
    df = df.withColumns({f"_v_{k}": v.cast("double") for k, v in cols.items()})
    ends = df.agg(*[f(f"_v_{k}").alias(f"_{n}_{k}") for k in cols for n, f in (("lo", F.min), ("hi", F.max))])
    df = df.crossJoin(F.broadcast(ends))  # one row
    out = {k: F.when(F.col(f"_hi_{k}") > F.col(f"_lo_{k}"), (F.col(f"_v_{k}") - F.col(f"_lo_{k}")) / (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).otherwise(1.0) for k in cols}
    return df.withColumns({f"_s_{k}": v for k, v in out.items()}).drop(*[f"_{n}_{k}" for k in cols for n in ("v", "lo", "hi")])


def trust(df: DataFrame) -> Column:
    weight = F.lit(OTHER_WEIGHT)
    for name, w in PROVENANCE_WEIGHT.items():
        weight = F.when(F.col("provenance") == name, w).otherwise(weight)
    return F.col("confidence") * weight


def search(base: Facts, view: DataFrame, text: str, limit: int = 20, vector_of: Sequence[float] | None = None, alpha: float = 0.5, all_vectors: bool = False) -> DataFrame:
    """The best ``limit`` facts of ``view`` for the query: event_id, subject, facet, score, keyword (BM25 itself).

    ``vector_of`` blends in cosine similarity, for keyword hits only unless ``all_vectors``. An ``alpha`` outside (0, 1] is
    one half. Without terms there are no hits."""
    terms = query_terms(text)
    empty = view.select("event_id", "subject", "facet", F.lit(0.0).alias("score"), F.lit(0.0).alias("keyword")).limit(0)
    if not terms and not (vector_of is not None and all_vectors):
        return empty
    docs = document(view, base.enrichments).select("event_id", "subject", "facet", "recorded_time", "effective_time", "provenance", "confidence", "log_seq", "_text")
    hits = bm25(docs, terms or [""])
    if vector_of is not None:
        alpha = alpha if 0 < alpha <= 1 else 0.5
        vec = vector.latest(base.enrichments).select(F.col("target_event").alias("_e"), vector.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in vector_of])).alias("_cos"))
        if all_vectors:
            both = docs.drop("_text").join(vec, F.col("event_id") == F.col("_e")).select("event_id", "_cos")
            meta = docs.drop("_text")
            joined = hits.select("event_id", "_bm").join(both, "event_id", "full_outer")
            hits = meta.join(joined, "event_id").fillna(0.0, ["_bm", "_cos"])
        else:
            hits = hits.join(vec, hits["event_id"] == vec["_e"], "left").drop("_e").fillna(0.0, ["_cos"])
        hits = _scaled(hits, bm=F.col("_bm"), cos=F.col("_cos")).withColumn("_base", alpha * F.col("_s_bm") + (1 - alpha) * F.col("_s_cos")).drop("_s_bm", "_s_cos")
    else:
        hits = _scaled(hits, bm=F.col("_bm")).withColumnRenamed("_s_bm", "_base")
    near = graph.degree(base.links).withColumnRenamed("event_id", "_d")
    hits = hits.join(near, hits["event_id"] == near["_d"], "left").drop("_d")
    hits = _scaled(hits, base=F.col("_base"), recency=F.col("effective_time"), trust=trust(hits), degree=F.coalesce("degree", F.lit(0)))
    score = BASE * F.col("_s_base") + RECENCY * F.col("_s_recency") + TRUST * F.col("_s_trust") + DEGREE * F.col("_s_degree")
    return hits.select("event_id", "subject", "facet", score.alias("score"), F.col("_bm").alias("keyword"), "log_seq").orderBy(F.desc("score"), "subject", "facet", "log_seq").limit(limit or 20).drop("log_seq")
