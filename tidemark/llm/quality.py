"""Host-level quality rules (operator 8).

Every text is judged once, in one pass over its bytes and words: the rules below are counts, taken for a megabyte of texts side
by side. What hosts are made of are the numbers of failed rules alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as X
from tidemark.session import cut

#: Words that running prose of the four languages can hardly do without.
FUNCTION_WORDS = sorted(
    set(
        "the of and in to is it that was for on with as by at this from are be an or a have not but which they you he she his her we their has had were been "
        "der die das und zu den mit von ist im für auf ein eine nicht sich dem des als auch es aus bei nach wie einer einem werden war sie er wir ich "
        "le la les de du et en un une que qui dans pour par sur au aux ce il elle ne pas est avec plus se sont son sa ses nous vous ou mais "
        "el los las del y con para no al lo como más su sus o pero esta este fue ha ya".split()
    )
)
SYMBOLS, MARKS = "#$%&*|<>{}\\^~=", "#|!*$&%"
CAPITALS, DIGITS, BLANKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \n\t\r"
RULES = ("few_words", "word_length", "symbols", "marks", "capitals", "digits", "repeated_lines", "bullets", "ellipses", "few_function_words", "repeated_words", "repeated_grams")
GRAM = 5
HOSTS = 1 << 20  # so many rows of hosts are broadcast at most (about 64 MB); more of them meet the documents in a salted join
SALTS = 16


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True
_CLASSES = {"continued": _CONTINUED, "blanks": _bytes(BLANKS), "symbols": _bytes(SYMBOLS), "marks": _bytes(MARKS), "capitals": _bytes(CAPITALS), "digits": _bytes(DIGITS)}
_FUNCTION = np.sort(X.tokenize(pa.array([" ".join(FUNCTION_WORDS)])).hash)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Different keys of each of ``n`` documents."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return np.bincount(d[new], minlength=n)


def _follows(data: np.ndarray, at: np.ndarray, stop: np.ndarray, chars: bytes) -> np.ndarray:
    """Whether ``chars`` stand at each place, before ``stop``."""
    ok = at + len(chars) <= stop
    ok &= at >= 0
    for k, c in enumerate(chars):
        ok[ok] = data[at[ok] + k] == c
    return ok


def failed_rules(arr: pa.Array) -> np.ndarray:
    """Which rules (columns, as in ``RULES``) each text fails. Null text counts as empty."""
    n = len(arr)
    data, off = X.string_buffers(arr)
    size = len(data)
    total = lambda x: np.diff(np.r_[0, np.cumsum(x)][off])
    count = {k: total(c[data]) for k, c in _CLASSES.items()}
    solid = ~_CLASSES["blanks"][data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begin[first] = solid[first]
    words = total(begin)
    length = np.diff(off) - count["continued"]
    chars, per_word = np.maximum(length, 1).astype(float), np.maximum(words, 1).astype(float)
    mean = (length - count["blanks"]) / per_word
    # lines: text between line breaks; each text has one at least
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(off, breaks, side="right") - 1
    lo = np.sort(np.concatenate((off[:-1], breaks + 1)))  # an empty text's own line begins where the next text's does
    line_doc = np.sort(np.concatenate((np.arange(n), owner)))
    hi = np.sort(np.concatenate((off[1:], breaks)))
    lines = np.bincount(line_doc, minlength=n)
    power, inverse = X._grow(size + 1)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(X._BYTE[data] * power[:size], dtype=np.uint64)]
    same = lines - _distinct(line_doc, X.mix64((sums[hi] - sums[lo]) * inverse[np.minimum(lo, max(size - 1, 0))]), n)
    share = lambda mask: np.bincount(line_doc[mask], minlength=n) / np.maximum(lines, 1)
    bullets = share(_follows(data, lo, hi, b"-") | _follows(data, lo, hi, b"*") | _follows(data, lo, hi, "\u2022".encode()))
    ends = [np.where(hi - len(e) >= lo, hi - len(e), -1) for e in (b"...", "\u2026".encode())]
    ellipses = share(_follows(data, ends[0], hi, b"...") | _follows(data, ends[1], hi, "\u2026".encode()))
    # words in lower case, as everywhere in this package
    t = X.tokenize(arr)
    tokens = np.diff(t.ptr)
    owner = np.repeat(np.arange(n), tokens)
    some = np.maximum(tokens, 1).astype(float)
    at = np.minimum(np.searchsorted(_FUNCTION, t.hash), len(_FUNCTION) - 1)
    function = np.bincount(owner[_FUNCTION[at] == t.hash], minlength=n) / some
    again = np.zeros(len(t.hash), bool)
    again[1:] = (t.hash[1:] == t.hash[:-1]) & (owner[1:] == owner[:-1])
    grams, gram_doc = X.ngrams(t, GRAM)
    different = _distinct(gram_doc, grams, n)
    possible = np.maximum(tokens - GRAM + 1, 1).astype(float)
    out = {
        "few_words": words < 5,
        "word_length": (words > 0) & ((mean > 12) | (mean < 2)),
        "symbols": count["symbols"] / chars > 0.05,
        "marks": count["marks"] / per_word > 0.4,
        "capitals": count["capitals"] / chars > 0.3,
        "digits": count["digits"] / chars > 0.2,
        "repeated_lines": (lines >= 4) & (same / np.maximum(lines, 1) > 0.3),
        "bullets": (lines >= 3) & (bullets > 0.9),
        "ellipses": (lines >= 3) & (ellipses > 0.3),
        "few_function_words": (tokens >= 20) & (function > 0) & (function < 0.05),  # none at all: another language
        "repeated_words": (tokens >= 10) & (np.bincount(owner[again], minlength=n) / some > 0.2),
        "repeated_grams": (tokens >= 10) & ((tokens - GRAM + 1 - different) / possible > 0.3),
    }
    return np.stack([out[r] for r in RULES], 1)


def _judged(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with one more column: the number of rules that ``text`` fails."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [failed_rules(c).sum(1) for _, c in X.chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int32())], [*names, column])

    return docs.mapInArrow(X.tidy(run), T.StructType([*docs.schema.fields, T.StructField(column, T.IntegerType())]))


def host_verdicts(flags: DataFrame, most: float = 0.2) -> DataFrame:
    """One row a host, from (_host, _n), a row a document: documents, failures, shrunk rate and verdict.

    A host's failure rate is the share of its documents that fail a rule. Rates are shrunk to the hosts' own beta prior,
    fitted by moments: with mean m and variance v of the raw rates over hosts, alpha + beta = m (1 - m) / v - 1, at least 2
    (and 2 where v is 0 or there is one host). A host is bad if (failures + alpha) / (documents + alpha + beta) > ``most``.
    Null hosts form one host of their own. Documents are counted before anything is sent, so that a host of any size is a row
    a task.
    """
    by = flags.groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"), F.sum((F.col("_n") > 0).cast("long")).alias("_bad"))
    rate = F.col("_bad") / F.col("_docs").cast("double")
    prior = by.agg(F.avg(rate).alias("_m"), F.var_pop(rate).alias("_v"))
    strength = F.when(F.coalesce(F.col("_v"), F.lit(0.0)) <= 0, F.lit(2.0)).otherwise(F.greatest(F.lit(2.0), F.col("_m") * (1 - F.col("_m")) / F.when(F.col("_v") > 0, F.col("_v")) - 1))
    shrunk = (F.col("_bad") + F.col("_m") * F.col("_s")) / (F.col("_docs") + F.col("_s"))
    return (
        by.crossJoin(F.broadcast(prior.withColumn("_s", strength)))  # the prior is one row
        .select("_host", "_docs", "_bad", F.round(shrunk, 9).alias("_rate"))
        .withColumn("_host_bad", F.col("_rate") > most)
    )


def _with_hosts(rows: DataFrame, key: str, hosts: DataFrame, prefix: str, most: int = HOSTS) -> DataFrame:
    """``rows`` with the verdict of their hosts, columns ``prefix`` + rate and bad. The same rows whichever way they meet."""
    hosts = cut(hosts.select(F.col("_host").alias(prefix + "host"), F.col("_rate").alias(prefix + "rate"), F.col("_host_bad").alias(prefix + "bad")))
    same = rows[key].eqNullSafe(hosts[prefix + "host"])
    if hosts.count() <= most:
        return rows.join(F.broadcast(hosts), same, "left").drop(prefix + "host")
    salt = prefix + "salt"
    rows = rows.withColumn(salt, (F.rand(7) * SALTS).cast("int"))
    hosts = hosts.withColumn(prefix + "s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.join(hosts, rows[key].eqNullSafe(hosts[prefix + "host"]) & (rows[salt] == hosts[prefix + "s"]), "left").drop(prefix + "host", prefix + "s", salt)


def keep(docs: DataFrame, most: float = 0.2) -> DataFrame:
    """The documents that the rules keep, with their columns as they were, whatever they are called.

    A document goes if it fails two rules, or one while its host is bad; one that fails none stays whatever its host.
    Repeated rows each count, and go or stay together; null, empty and blank texts fail ``few_words`` alone; texts of any length
    are judged as a whole; null hosts are one host. An empty table gives an empty table.
    """
    own = "__q_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    rows = cut(_judged(docs, own + "n"))  # each text is judged once: hosts and documents are read from here
    hosts = host_verdicts(rows.select(F.col("source").alias("_host"), F.col(own + "n").alias("_n")), most)
    rows = _with_hosts(rows.where(F.col(own + "n") < 2), "source", hosts, own)
    gone = (F.col(own + "n") >= 1) & F.coalesce(F.col(own + "bad"), F.lit(False))
    return rows.where(~gone).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, most: float = 0.2) -> DataFrame:
    """One row a document: doc_id, host, rules_failed, host_rate, host_bad, kept. Odd rows as in ``keep``; columns besides doc_id,
    text and source are not read."""
    flags = cut(_judged(docs.select("doc_id", "source", "text"), "_n").select("doc_id", F.col("source").alias("_host"), "_n"))
    d = _with_hosts(flags, "_host", host_verdicts(flags, most), "__q_")
    kept = (F.col("_n") < 2) & ~((F.col("_n") == 1) & F.coalesce(F.col("__q_bad"), F.lit(False)))
    return d.select("doc_id", F.col("_host").alias("host"), F.col("_n").alias("rules_failed"), F.col("__q_rate").alias("host_rate"), F.col("__q_bad").alias("host_bad"), kept.alias("kept"))


_SQL_RULES = rf"""
    base AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
    token AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT rid, regexp_extract_all(lower(t), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+') AS w FROM base)),
    gram AS (SELECT rid, w, lag(w) OVER d AS before, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d AS g FROM token WINDOW d AS (PARTITION BY rid ORDER BY i)),
    said AS (SELECT rid, count(*) AS k, sum((w IN ({", ".join(f"'{w}'" for w in FUNCTION_WORDS)}))::INT) / count(*)::DOUBLE AS f, sum((w = before)::INT) / count(*)::DOUBLE AS again, (count(g) - count(DISTINCT g)) / greatest(count(g), 1)::DOUBLE AS twice FROM gram GROUP BY rid),
    shown AS (SELECT rid, doc_id, source, t, greatest(length(t), 1)::DOUBLE AS c, length(t) - length(translate(t, chr(32) || chr(10) || chr(9) || chr(13), '')) AS b,
                     len(regexp_extract_all(t, '[^ \n\t\r]+')) AS w, string_split(t, chr(10)) AS l FROM base),
    flags AS (
    SELECT doc_id, source,
           (w < 5)::INT
         + (w > 0 AND ((length(t) - b) / greatest(w, 1)::DOUBLE > 12 OR (length(t) - b) / greatest(w, 1)::DOUBLE < 2))::INT
         + ((length(t) - length(translate(t, '#$%&*|<>{{}}\^~=', ''))) / c > 0.05)::INT
         + ((length(t) - length(translate(t, '#|!*$&%', ''))) / greatest(w, 1)::DOUBLE > 0.4)::INT
         + ((length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) / c > 0.3)::INT
         + ((length(t) - length(translate(t, '0123456789', ''))) / c > 0.2)::INT
         + (len(l) >= 4 AND (len(l) - len(list_distinct(l))) / len(l)::DOUBLE > 0.3)::INT
         + (len(l) >= 3 AND len(list_filter(l, lambda x: x[1] IN ('-', '*', '•'))) / len(l)::DOUBLE > 0.9)::INT
         + (len(l) >= 3 AND len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) / len(l)::DOUBLE > 0.3)::INT
         + coalesce(k >= 20 AND f > 0 AND f < 0.05, false)::INT + coalesce(k >= 10 AND again > 0.2, false)::INT + coalesce(k >= 10 AND twice > 0.3, false)::INT AS n
    FROM shown LEFT JOIN said USING (rid))
"""
ORACLE = f"""
WITH {_SQL_RULES},
hosts AS (SELECT source, count(*) AS docs, sum((n > 0)::INT) AS bad FROM flags GROUP BY source),
prior AS (SELECT avg(bad / docs::DOUBLE) AS m, var_pop(bad / docs::DOUBLE) AS v FROM hosts),
strength AS (SELECT m, CASE WHEN v <= 0 THEN 2.0 ELSE greatest(2.0, m * (1 - m) / v - 1) END AS s FROM prior),
verdict AS (SELECT source, round((bad + m * s) / (docs + s), 9) AS rate FROM hosts, strength)
SELECT f.doc_id, f.source AS host, f.n AS rules_failed, v.rate AS host_rate, v.rate > 0.2 AS host_bad,
       NOT (f.n >= 2 OR (f.n >= 1 AND v.rate > 0.2)) AS kept
FROM flags f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source
"""
