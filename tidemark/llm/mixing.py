"""Mixing sources to target weights (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

BUCKETS = 4096
NOISE = "#$%&*|!0123456789"


def tokens(text: Column) -> Column:
    """Words between blanks."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\n\\t\\r]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are neither digits nor symbols, at least 0.05; null or empty text has 0.05."""
    t = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(0.05), F.length(F.translate(t, NOISE, "")) / F.greatest(F.length(t), F.lit(1)).cast("double"))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u from the identifier and the seed: the k smallest keys are a weighted sample without replacement."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(2**52 + 1))
    return -F.log(u) / weight


def _weighed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with source, key and bucket of each row."""
    rows = docs.withColumns({"__m_source": F.col("source"), "__m_key": exponential_key(F.col("doc_id"), quality_weight(F.col("text")), seed)})
    return rows.withColumn("__m_bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("__m_key")))).cast("int"))


def _tie(doc_id: Column, text: Column) -> dict[str, Column]:
    return {"__m_id": F.coalesce(doc_id.cast("long"), F.lit(-(2**63))), "__m_hash": F.xxhash64(text)}


def _plan(slim: DataFrame, factor: float, weights: dict[str, float] | None) -> DataFrame:
    """A row a source: complete epochs, the bucket in which the rest of its budget ends, and what that bucket still takes.

    No source is sorted as a whole: tokens are summed by source and bucket, and only the last bucket is ordered."""
    sums = slim.groupBy("__m_source", "__m_bucket").agg(F.sum("__m_tokens").alias("__m_sum"))
    order = Window.partitionBy("__m_source").orderBy("__m_bucket")
    sums = cut(sums.withColumn("__m_upto", F.sum("__m_sum").over(order)))  # sources x buckets: read several times below
    by = sums.groupBy("__m_source").agg(F.sum("__m_sum").alias("__m_all"))
    if weights is None:
        share = F.sqrt(F.col("__m_all").cast("double"))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("__m_source") == name, F.lit(float(w))).otherwise(share)
    by = by.withColumn("__m_share", share)
    whole = by.agg(F.sum("__m_all").alias("__m_total"), F.sum("__m_share").alias("__m_shares"))
    budget = F.when(F.col("__m_shares") > 0, F.floor(F.lit(float(factor)) * F.col("__m_total") * F.col("__m_share") / F.col("__m_shares"))).otherwise(0).cast("long")
    some = F.col("__m_all") > 0
    plan = (
        by.crossJoin(F.broadcast(whole))  # one row
        .withColumn("__m_budget", budget)
        .withColumn("__m_epochs", F.when(some, F.floor(F.col("__m_budget") / F.greatest(F.col("__m_all"), F.lit(1)))).otherwise(1).cast("long"))
        .withColumn("__m_rest", F.when(some, F.col("__m_budget") - F.col("__m_epochs") * F.col("__m_all")).otherwise(0))
        .select(F.col("__m_source").alias("__m_of"), "__m_epochs", "__m_rest")
    )
    # The first bucket whose running sum is over the rest is the edge; none if all fit.
    both = sums.join(plan, F.col("__m_source").eqNullSafe(F.col("__m_of")))
    over = F.col("__m_upto") > F.col("__m_rest")
    edge = both.groupBy("__m_of", "__m_epochs", "__m_rest").agg(F.coalesce(F.min(F.when(over, F.col("__m_bucket"))), F.lit(BUCKETS + 1)).alias("__m_edge"), F.coalesce(F.max(F.when(~over, F.col("__m_upto"))), F.lit(0)).alias("__m_before"))
    return cut(edge)


def _close(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of the last buckets, with ``__m_extra``: whether each is taken."""
    running = Window.partitionBy("__m_source").orderBy("__m_key", "__m_id", "__m_tokens", "__m_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.join(plan, F.col("__m_source").eqNullSafe(F.col("__m_of"))).where(F.col("__m_bucket") == F.col("__m_edge"))
    return rows.withColumn("__m_extra", (F.col("__m_before") + F.sum("__m_tokens").over(running) <= F.col("__m_rest")).cast("long"))


def _slim(docs: DataFrame, seed: int) -> DataFrame:
    """A narrow row a document, read several times: the texts are read once."""
    rows = _weighed(docs, seed)
    return cut(rows.select("doc_id", "__m_source", "__m_key", "__m_bucket", tokens(F.col("text")).alias("__m_tokens"), *[c.alias(k) for k, c in _tie(F.col("doc_id"), F.col("text")).items()]))


def report(docs: DataFrame, factor: float = 1.0, seed: int = 17, weights: dict[str, float] | None = None) -> DataFrame:
    """One row a document that is taken: doc_id, source, n_tokens, copies.

    The budget is ``factor`` times the corpus' tokens. Each source gets the share of its weight: as given (sources not named
    get none), or in proportion to the square root of its tokens. A source whose budget is e times its tokens and more gets e
    complete epochs; the rest goes to the documents with the smallest exponential keys whose running sum of tokens stays
    within it. Ties go by doc_id, tokens and a hash of the text; repeated rows are each taken on their own. Null sources are one
    source. Documents without tokens cost nothing; a null text has none. An empty table gives an empty table.
    """
    slim = _slim(docs.select("doc_id", "source", "text"), seed)
    plan = _plan(slim, factor, weights)
    rows = slim.join(plan, F.col("__m_source").eqNullSafe(F.col("__m_of"))).where(F.col("__m_bucket") != F.col("__m_edge"))
    clear = rows.withColumn("__m_extra", (F.col("__m_bucket") < F.col("__m_edge")).cast("long"))
    copies = (F.col("__m_epochs") + F.col("__m_extra")).cast("long")
    out = clear.unionByName(_close(slim, plan)).withColumn("copies", copies).where("copies > 0")
    return out.select("doc_id", F.col("__m_source").alias("source"), F.col("__m_tokens").alias("n_tokens"), "copies")


def sample(docs: DataFrame, factor: float = 1.0, seed: int = 17, weights: dict[str, float] | None = None) -> DataFrame:
    """The mixed corpus: every document as often as ``report`` takes it, with its columns as they were, clashing names too.

    What a source's last bucket takes is a prefix of its order, so that one bound a source decides over each row where it
    stands: the texts are read a second time and shuffled not at all. Rows that equal the bound in everything are numbered.
    """
    slim = _slim(docs.select("doc_id", "source", "text"), seed)
    plan = _plan(slim, factor, weights)
    close = _close(slim, plan)
    bound = F.struct("__m_key", "__m_id", "__m_tokens", "__m_hash")
    last = close.where("__m_extra = 1").groupBy("__m_source").agg(F.max(bound).alias("__m_last")).withColumnRenamed("__m_source", "__m_of2")
    equal = close.join(last, F.col("__m_source").eqNullSafe(F.col("__m_of2"))).where(bound == F.col("__m_last"))
    split = equal.groupBy("__m_of2", "__m_last").agg(F.sum("__m_extra").alias("__m_some"), F.count(F.lit(1)).alias("__m_same"))
    plan = cut(plan.join(split, F.col("__m_of").eqNullSafe(F.col("__m_of2")), "left").drop("__m_of2"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__m_row")  # whatever its columns are called
    docs, cols = docs.select(row, "doc_id", "source", "text"), [F.col("__m_row")]
    rows = _weighed(docs, seed).withColumns(_tie(F.col("doc_id"), F.col("text")))
    rows = rows.join(plan, F.col("__m_source").eqNullSafe(F.col("__m_of")))
    t, k = tokens(F.col("text")), F.col("__m_last")
    at = F.col("__m_bucket") == F.col("__m_edge")
    same = (F.col("__m_key") == k["__m_key"]) & (F.col("__m_id") == k["__m_id"]) & (t == k["__m_tokens"]) & (F.col("__m_hash") == k["__m_hash"])
    # Comparisons beyond the key are for ties; they are not computed otherwise.
    less = (F.col("__m_key") < k["__m_key"]) | ((F.col("__m_key") == k["__m_key"]) & ((F.col("__m_id") < k["__m_id"]) | ((F.col("__m_id") == k["__m_id"]) & ((t < k["__m_tokens"]) | ((t == k["__m_tokens"]) & (F.col("__m_hash") < k["__m_hash"]))))))
    cut_in_two = at & F.coalesce(same, F.lit(False)) & (F.col("__m_some") < F.col("__m_same"))
    taken = (F.col("__m_bucket") < F.col("__m_edge")) | (at & F.coalesce(less | same, F.lit(False)))
    out = rows.where(~cut_in_two).select(*cols, (F.col("__m_epochs") + taken.cast("long")).alias("__m_copies"))
    if not plan.where("__m_some < __m_same").isEmpty():
        among = Window.partitionBy("__m_source").orderBy("__m_key")
        few = rows.where(cut_in_two).withColumn("__m_nth", F.row_number().over(among))
        out = out.unionAll(few.select(*cols, (F.col("__m_epochs") + (F.col("__m_nth") <= F.col("__m_some")).cast("long")).alias("__m_copies")))
    out = out.where("__m_copies > 0")
    return out.select(*cols, F.explode(F.sequence(F.lit(1), F.col("__m_copies").cast("int"))).alias("__m_i")).select("__m_row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^ \n\t\r]+')), 0)::BIGINT AS n,
         greatest(0.05, length(translate(coalesce(text, ''), '#$%&*|!0123456789', '')) / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS w,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':17') AS h
  FROM documents),
k AS (SELECT *, -ln((('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0::DOUBLE) / w AS key FROM t),
s AS (SELECT source, sum(n)::BIGINT AS alln, sqrt(sum(n)::DOUBLE) AS share FROM k GROUP BY source),
b AS (SELECT source, alln, floor(1.0::DOUBLE * (sum(alln) OVER ())::DOUBLE * share / (sum(share) OVER ()))::BIGINT AS budget FROM s),
r AS (SELECT source, CASE WHEN alln > 0 THEN budget // greatest(alln, 1) ELSE 1 END AS epochs,
             CASE WHEN alln > 0 THEN budget - (budget // greatest(alln, 1)) * alln ELSE 0 END AS rest FROM b),
c AS (SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY key, doc_id, n, text ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT c.doc_id, c.source, c.n AS n_tokens, (r.epochs + (c.upto <= r.rest)::INT)::BIGINT AS copies
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
WHERE r.epochs + (c.upto <= r.rest)::INT > 0
"""
