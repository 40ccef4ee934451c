"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Queries go through the language's text where it has a statement for them. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.model import DAY, Facts
from tidemark.operators import graph, integrity, profile, read, retention, search, temporal, topology, txn, vector
from tidemark.operators.context import disagreements, pending_as_known
from tidemark.plans.ast import Query
from tidemark.sources import tables
from tidemark.sources.files import to_facts

FLAGSHIP = "agg_having"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = 1_750_000_000_000_000
T98, T99 = 883_612_800_000_000, 915_148_800_000_000  # the first days of 1998 and 1999, UTC

LINE = """
line AS (
  SELECT 'line:' || l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber AS event_id, 'part:' || l_partkey AS subject, l_returnflag AS facet,
         epoch_us(l_shipdate) AS eff, epoch_us(l_shipdate) + l_linenumber::BIGINT * 86400000000 AS rec,
         ((epoch_us(l_shipdate) + l_linenumber::BIGINT * 86400000000) // 86400000000) * 100000000000000 + l_orderkey * 100000 + l_suppkey * 10 + l_linenumber AS seq,
         l_extendedprice AS price, l_quantity AS qty, l_discount AS discount, l_tax AS tax, l_linestatus AS status, l_quantity >= 25 AS bulk, 1 - l_tax AS confidence,
         CASE WHEN l_linestatus = 'F' THEN 'SYSTEM_FEED' ELSE 'HUMAN_ENTRY' END AS provenance, 'order:' || l_orderkey AS ref
  FROM lineitem)"""
CURRENT = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, facet ORDER BY seq DESC) AS nth FROM line) WHERE nth = 1)"""
USERS = """
usr AS (
  SELECT 'evt:' || event_id AS event_id, 'user:' || user_id AS subject, event_type AS facet, epoch_us(ts) AS eff, event_id AS seq, value,
         json_extract_string(props, '$.k')::BIGINT AS k, user_id FROM events)"""
LINKS = """
link AS (SELECT * FROM (SELECT 'evt:' || lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS from_id, 'evt:' || event_id AS to_id FROM events) WHERE from_id IS NOT NULL)"""
DOCS = """
doc AS (SELECT 'doc:' || d.doc_id AS event_id, 'doc:' || lang || '/' || d.doc_id AS subject, text, lang, source, n_chars, d.doc_id AS seq, coalesce(quality::DOUBLE, 0.5) AS confidence,
               CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.85 END AS weight, (d.doc_id + 1) * 1000000 AS eff
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _line(s: SparkSession, d: str) -> Engine:
    return Engine(Facts.of(tables.line_facts(s, d), schemas=[]))


def _user(s: SparkSession, d: str) -> Engine:
    return Engine(Facts.of(tables.user_facts(s, d), tables.user_links(s, d)))


def _docs(s: SparkSession, d: str) -> Engine:
    return Engine(Facts.of(tables.doc_facts(s, d)))


def _ask(make: Callable[[SparkSession, str], Engine], text: str, sql: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: (make(s, d).sql if sql else make(s, d).query)(text, NOW).table


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str = "") -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def _facts_query(name: str, fields: str, tail: str, select: str, where: str = "", view: str = "cur") -> None:
    """FACTS over lines: the statement, and SQL over the same view."""
    _add(name, _ask(_line, f"FACTS {fields} OF part:* {tail}"), f"WITH {LINE}, {CURRENT} SELECT {select} FROM {view} {where}")


# ---- reads, predicates ----
_facts_query("facts_current", "subject, facet, event_id, price, qty", "", "subject, facet, event_id, price, qty")
_facts_query("facts_where_cmp", "subject, facet, price", "WHERE price > 50000 AND qty <= 40 AND status != 'O'", "subject, facet, price", "WHERE price > 50000 AND qty <= 40 AND status <> 'O'")
_facts_query("facts_where_in", "event_id, discount", "WHERE discount IN (0.02, 0.05) OR status IN ('X', 'O')", "event_id, discount", "WHERE discount IN (0.02, 0.05) OR status IN ('X', 'O')")
_facts_query("facts_like", "event_id, ref", "WHERE ref LIKE 'order:1*7' AND NOT facet LIKE 'R*'", "event_id, ref", "WHERE regexp_full_match(ref, 'order:1.*7') AND NOT regexp_full_match(facet, 'R.*')")
_facts_query("facts_exists", "event_id", "WHERE EXISTS price AND NOT EXISTS colour AND missing != 3", "event_id", "WHERE price IS NOT NULL")
_facts_query("facts_not_missing", "event_id, bulk", "WHERE NOT (bulk = true OR colour > 3)", "event_id, bulk", "WHERE NOT bulk")
_facts_query("facts_mixed_types", "event_id, qty", "WHERE qty > '7' AND status < 9 AND bulk >= 1", "event_id, qty", "WHERE qty::BIGINT::VARCHAR > '7' AND status < '9' AND bulk")
_facts_query("facts_namespace_facet", "namespace, facet, event_id", "FACET A WHERE namespace = part AND trust > 0.95", "'part' AS namespace, facet, event_id", "WHERE facet = 'A' AND confidence > 0.95")
_facts_query("facts_projection_rank_page", "rank, subject, facet, price", "ORDER BY price DESC LIMIT 25 OFFSET 10", "rank, subject, facet, price", "", "(SELECT *, row_number() OVER (ORDER BY price DESC, subject, facet) AS rank FROM cur) WHERE rank > 10 AND rank <= 35")
_facts_query("facts_rank_all", "rank, event_id", "ORDER BY qty", "row_number() OVER (ORDER BY qty, subject, facet) AS rank, event_id")
_add("facts_one_subject", _ask(_line, "FACTS event_id, facet, price OF part:17"), f"WITH {LINE}, {CURRENT} SELECT event_id, facet, price FROM cur WHERE subject = 'part:17'")
_add("facts_glob_inside", _ask(_line, "FACTS event_id, subject OF part:1*9"), f"WITH {LINE}, {CURRENT} SELECT event_id, subject FROM cur WHERE regexp_full_match(subject, 'part:1.*9')")
_add("facts_matches_any", _ask(_docs, "FACTS event_id, lang OF doc:* WHERE any MATCHES 'license'"), f"WITH {DOCS} SELECT event_id, lang FROM doc WHERE contains(lower(subject), 'license') OR contains(lower(text), 'license') OR contains(lower(lang), 'license') OR contains(lower(source), 'license')")
_add("facts_matches_field", _ask(_docs, "FACTS event_id OF doc:* WHERE lang MATCHES 'E' AND NOT n_chars MATCHES '1'"), f"WITH {DOCS} SELECT event_id FROM doc WHERE contains(lower(lang), 'e')")

# ---- two clocks ----
ASOF = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, facet ORDER BY eff DESC, seq DESC) AS nth FROM line WHERE {}) WHERE nth = 1"
_add("facts_asof", _ask(_line, "FACTS subject, facet, event_id, price OF part:* AS OF 1998-01-01"), f"WITH {LINE} SELECT subject, facet, event_id, price FROM ({ASOF.format(f'eff <= {T98}')})")
_add("facts_asof_known", _ask(_line, "FACTS subject, facet, event_id, price OF part:* AS OF 1998-01-01 AS KNOWN AT 1998-01-01"), f"WITH {LINE} SELECT subject, facet, event_id, price FROM ({ASOF.format(f'eff <= {T98} AND rec <= {T98}')})")
_add("facts_known_only", _ask(_line, "FACTS subject, facet, event_id OF part:* AS KNOWN AT 1999-01-01 WHERE price > 30000"), f"WITH {LINE} SELECT subject, facet, event_id FROM ({ASOF.format(f'eff <= {T99} AND rec <= {T99}')}) WHERE price > 30000")
_add(
    "asof_join",
    lambda s, d: temporal.as_of_each(tables.line_facts(s, d), tables.table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("subject"), F.lit("A").alias("facet"), (F.lit(T98) + F.col("p_size") * DAY).alias("at"))).select("subject", F.col("at").alias("moment"), F.col("fact.event_id").alias("event_id")),
    f"WITH {LINE} SELECT subject, t AS moment, (SELECT arg_max(event_id, (eff, seq)) FROM line WHERE line.subject = p.subject AND facet = 'A' AND eff <= p.t) AS event_id FROM (SELECT 'part:' || p_partkey AS subject, {T98} + p_size::BIGINT * 86400000000 AS t FROM part) p",
)
_add("history", _ask(_user, "HISTORY OF user:* WHERE value > 5"), "")
QUERIES["history"] = lambda s, d: _user(s, d).query("HISTORY OF user:* WHERE value > 5", NOW).table.select("event_id", "subject", "facet", "effective_time", "value.value")
ORACLES["history"] = f"WITH {USERS} SELECT event_id, subject, facet, eff AS effective_time, value FROM usr WHERE value > 5"
_add("history_latest", lambda s, d: _user(s, d).history("user:7", limit=20).select("event_id", "effective_time"), f"WITH {USERS} SELECT event_id, eff AS effective_time FROM usr WHERE subject = 'user:7' ORDER BY eff DESC, seq DESC LIMIT 20")
_add("superseded", lambda s, d: temporal.superseded(tables.line_facts(s, d)).select("event_id", "superseded_by", "effective_end"), f"WITH {LINE} SELECT event_id, lead(event_id) OVER w AS superseded_by, lead(eff) OVER w AS effective_end FROM line WINDOW w AS (PARTITION BY subject, facet ORDER BY seq)")
_add("subjects_like", _ask(_user, "SUBJECTS LIKE user:1*"), "SELECT DISTINCT 'user:' || user_id AS subject FROM events WHERE starts_with(user_id::VARCHAR, '1')")
_add("stats", lambda s, d: _user(s, d).query("STATS", NOW).table, "SELECT count(*) AS events, count(DISTINCT user_id) AS subjects, count(DISTINCT (user_id, event_type)) AS open_streams, 0::BIGINT AS pending, count(*) - count(DISTINCT user_id) AS links FROM events")
_add("byref", lambda s, d: _line(s, d).by_ref("order:77").select("event_id", "source_ref"), f"WITH {LINE} SELECT event_id, ref AS source_ref FROM line WHERE ref = 'order:77'")
_add("pending", lambda s, d: Engine(Facts.of(tables.order_facts(s, d))).query("PENDING fulfilment", NOW).table.select("event_id", "subject", "recorded_time"), "SELECT 'order:' || o_orderkey AS event_id, 'customer:' || o_custkey || '/order:' || o_orderkey AS subject, epoch_us(o_orderdate) AS recorded_time FROM orders WHERE o_orderstatus <> 'F'")
_add("pending_older", lambda s, d: temporal.pending(tables.order_facts(s, d), "fulfilment", 365, T99).select("event_id"), f"SELECT 'order:' || o_orderkey AS event_id FROM orders WHERE o_orderstatus <> 'F' AND epoch_us(o_orderdate) < {T99} - 365 * 86400000000")
_add("pending_as_known", lambda s, d: pending_as_known(tables.order_facts(s, d), T98).select("event_id"), f"SELECT 'order:' || o_orderkey AS event_id FROM orders WHERE epoch_us(o_orderdate) <= {T98} AND NOT (o_orderstatus = 'F' AND epoch_us(o_orderdate) + 86400000000 <= {T98})")
_add("activated", lambda s, d: temporal.activated(tables.order_facts(s, d)).where("type = 'DISTRIBUTED'").select("event_id", "activation_time"), "SELECT 'order:' || o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) + 86400000000 ELSE 0 END AS activation_time FROM orders")
_add("disagree", lambda s, d: _line(s, d).query("DISAGREE ON bulk", NOW).table.select("subject", "facet", "value.bulk"), f"WITH {LINE}, {CURRENT} SELECT subject, facet, bulk FROM cur WHERE subject IN (SELECT subject FROM cur GROUP BY subject HAVING count(DISTINCT bulk) > 1)")

# ---- aggregates ----


def _agg(name: str, text: str, sql: str, *rounded: str) -> None:
    _add(name, lambda s, d: _rounded(_line(s, d).query(text, NOW).table, *rounded), f"WITH {LINE}, {CURRENT} {sql}")


_agg("agg_count", "FACTS facet, COUNT(*), COUNT(colour) OF part:* GROUP BY facet", 'SELECT facet, count(*) AS "count(*)", 0::BIGINT AS "count(colour)" FROM cur GROUP BY facet')
_agg("agg_count_distinct", "FACTS COUNT(DISTINCT *), COUNT(DISTINCT discount), COUNT(DISTINCT bulk) OF part:*", 'SELECT count(DISTINCT subject) AS "count_distinct(*)", count(DISTINCT discount) AS "count_distinct(discount)", count(DISTINCT bulk) AS "count_distinct(bulk)" FROM cur')
_agg("agg_sum_avg_min_max", "FACTS facet, SUM(qty), AVG(price), MIN(price), MAX(price), SUM(bulk) OF part:* GROUP BY facet", 'SELECT facet, sum(qty) AS "sum(qty)", round(avg(price), 6) AS "avg(price)", min(price) AS "min(price)", max(price) AS "max(price)", sum(bulk::INT)::DOUBLE AS "sum(bulk)" FROM cur GROUP BY facet', "avg(price)")
_agg("agg_median", "FACTS status, MEDIAN(qty) OF part:* GROUP BY status", 'SELECT status, median(qty) AS "median(qty)" FROM cur GROUP BY status')
_agg("agg_stddev", "FACTS status, STDDEV(price) OF part:* GROUP BY status", 'SELECT status, round(stddev_pop(price), 4) AS "stddev(price)" FROM cur GROUP BY status')
QUERIES["agg_stddev"] = lambda s, d: _rounded(_line(s, d).query("FACTS status, STDDEV(price) OF part:* GROUP BY status", NOW).table, "stddev(price)", digits=4)
_agg("agg_listagg", "FACTS facet, LISTAGG(status), LISTAGG(bulk) OF part:* GROUP BY facet", "SELECT facet, (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT status AS x FROM cur c WHERE c.facet = g.facet)) AS \"listagg(status)\", (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT bulk::VARCHAR AS x FROM cur c WHERE c.facet = g.facet)) AS \"listagg(bulk)\" FROM (SELECT DISTINCT facet FROM cur) g")
_agg("agg_having", "FACTS facet, COUNT(*), AVG(price) OF part:* WHERE qty > 10 GROUP BY facet HAVING COUNT(*) > 10 AND AVG(price) > 1", 'SELECT facet, count(*) AS "count(*)", round(avg(price), 6) AS "avg(price)" FROM cur WHERE qty > 10 GROUP BY facet HAVING count(*) > 10 AND avg(price) > 1', "avg(price)")
_agg("agg_missing_key", "FACTS colour, COUNT(*) OF part:* GROUP BY colour", "SELECT '<nil>' AS colour, count(*) AS \"count(*)\" FROM cur")
_agg("agg_empty", "FACTS COUNT(*) OF nothing:*", 'SELECT 0::BIGINT AS "count(*)" FROM cur WHERE false')
_add("agg_namespace", _ask(_user, "FACTS namespace, COUNT(*) OF * GROUP BY namespace"), 'SELECT \'user\' AS namespace, count(DISTINCT (user_id, event_type)) AS "count(*)" FROM events')
_add("agg_by_number", _ask(_user, "FACTS k, COUNT(*) OF user:* GROUP BY k"), f'WITH {USERS}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, facet ORDER BY seq DESC) AS nth FROM usr) WHERE nth = 1) SELECT k::VARCHAR AS k, count(*) AS "count(*)" FROM cur GROUP BY k')
_add("agg_approx_distinct", lambda s, d: _line(s, d).query("FACTS APPROX_COUNT_DISTINCT(price), COUNT(DISTINCT price) OF part:*", NOW).table.select((F.abs(F.col("`approx_count_distinct(price)`") / F.col("`count_distinct(price)`") - 1) < 0.05).alias("close")), "SELECT true AS close")

# ---- lean SQL ----
_add("sql_select_where", _ask(_line, "SELECT subject, price AS p FROM part WHERE facet = 'R' AND (price >= 60000 OR qty IN (1, 2)) AND status LIKE 'F*'", True), f"WITH {LINE}, {CURRENT} SELECT subject, price FROM cur WHERE facet = 'R' AND (price >= 60000 OR qty IN (1, 2)) AND starts_with(status, 'F')")
_add("sql_select_group", lambda s, d: _rounded(_line(s, d).sql("SELECT facet, COUNT(*) AS n, AVG(price) FROM facts GROUP BY facet HAVING COUNT(*) > 5", NOW).table, "avg(price)"), f'WITH {LINE}, {CURRENT} SELECT facet, count(*) AS "count(*)", round(avg(price), 6) AS "avg(price)" FROM cur GROUP BY facet HAVING count(*) > 5')
_add("sql_select_system_time", _ask(_line, "SELECT event_id, subject FROM part WHERE price > 40000 FOR SYSTEM_TIME AS OF '1998-01-01'", True), f"WITH {LINE} SELECT event_id, subject FROM ({ASOF.format(f'eff <= {T98} AND rec <= {T98}')}) WHERE price > 40000")
_add("sql_null_literal", _ask(_line, "SELECT event_id FROM part WHERE colour = NULL OR NOT (price != NULL)", True), "SELECT 'x' AS event_id WHERE false")

# ---- causes ----
_add("why_trace", lambda s, d: graph.trace(_user(s, d).base, "evt:900", 6).select("depth", "position", "event_id", "subject"), f"WITH RECURSIVE {LINKS}, t AS (SELECT 'evt:900' AS event_id, 0 AS depth UNION ALL SELECT link.from_id, depth + 1 FROM t JOIN link ON link.to_id = t.event_id WHERE depth < 6) SELECT depth, depth AS position, t.event_id, 'user:' || user_id AS subject FROM t JOIN events ON 'evt:' || events.event_id = t.event_id")
_add("effects_trace", lambda s, d: _user(s, d).query("EFFECTS evt:5 DEPTH 4", NOW).table.select("depth", "event_id"), f"WITH RECURSIVE {LINKS}, t AS (SELECT 'evt:5' AS event_id, 0 AS depth UNION ALL SELECT link.to_id, depth + 1 FROM t JOIN link ON link.from_id = t.event_id WHERE depth < 4) SELECT depth, event_id FROM t")
_add("effects_fanout", lambda s, d: graph.trace(Facts.of(tables.order_facts(s, d).select(*_ENVELOPE).unionByName(tables.line_facts(s, d).select(*_ENVELOPE)), tables.line_links(s, d)), "order:77", 3, True).select("depth", "event_id"), f"WITH {LINE} SELECT 0 AS depth, 'order:77' AS event_id UNION ALL SELECT 1, event_id FROM line WHERE ref = 'order:77'")
_ENVELOPE = ["log_seq", "event_id", "subject", "facet", "type", "schema_id", "effective_time", "recorded_time", "provenance", "confidence", "source_system", "source_ref"]
REACH = "r AS (SELECT from_id AS a, to_id AS b, 1 AS hops FROM link UNION ALL SELECT r.a, link.to_id, hops + 1 FROM r JOIN link ON link.from_id = r.b WHERE hops < 3)"
_add("match_causes", lambda s, d: _user(s, d).query("MATCH user:1* CAUSES user:* DEPTH 3", NOW).table, f"WITH RECURSIVE {LINKS}, {USERS}, {REACH} SELECT a AS from_event, x.subject AS from_subject, b AS to_event, y.subject AS to_subject, hops, 'TRIGGERED' AS via FROM r JOIN usr x ON x.event_id = a JOIN usr y ON y.event_id = b WHERE starts_with(x.subject, 'user:1')")
_add("match_caused_by_via", lambda s, d: _user(s, d).query("MATCH user:2* CAUSED BY user:* VIA TRIGGERED DEPTH 2", NOW).table, f"WITH RECURSIVE {LINKS}, {USERS}, {REACH} SELECT b AS from_event, x.subject AS from_subject, a AS to_event, y.subject AS to_subject, hops, 'TRIGGERED' AS via FROM r JOIN usr x ON x.event_id = b JOIN usr y ON y.event_id = a WHERE hops <= 2 AND starts_with(x.subject, 'user:2')")
_add("match_via_none", lambda s, d: _user(s, d).query("MATCH user:* CAUSES user:* VIA ENRICHED_BY", NOW).table.select("from_event"), "SELECT 'x' AS from_event WHERE false")
_add("facts_why", lambda s, d: _user(s, d).query("FACTS OF user:3 WHY DEPTH 2", NOW).info.select("event_id", F.array_join("causes", ",").alias("causes"), F.array_join("effects", ",").alias("effects")), f"WITH {USERS}, ordered AS (SELECT *, lag(event_id) OVER w AS c1, lag(event_id, 2) OVER w AS c2, lead(event_id) OVER w AS e1, lead(event_id, 2) OVER w AS e2 FROM usr WINDOW w AS (PARTITION BY subject ORDER BY seq)), last AS (SELECT facet, max(seq) AS seq FROM usr WHERE subject = 'user:3' GROUP BY facet) SELECT event_id, concat_ws(',', c1, c2) AS causes, concat_ws(',', e1, e2) AS effects FROM ordered WHERE subject = 'user:3' AND seq IN (SELECT seq FROM last)")


def _with_back_edges(s: SparkSession, d: str) -> DataFrame:
    """The users' chains, all of more than one event closed to rings."""
    e = tables.table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("hi"), F.min("event_id").alias("lo")).where("hi > lo")
    back = e.select(F.col("hi").alias("log_seq"), F.concat(F.lit("evt:"), F.col("hi").cast("string")).alias("from_id"), F.concat(F.lit("evt:"), F.col("lo").cast("string")).alias("to_id"), F.lit("TRIGGERED").alias("type"))
    return tables.user_links(s, d).unionByName(back)


_add("cycles_acyclic", lambda s, d: s.createDataFrame([(_user(s, d).query("CYCLES IN CAUSES", NOW).info["cyclic"],)], "cyclic boolean"), "SELECT false AS cyclic")


def _found(s: SparkSession, d: str) -> DataFrame:
    """Whether a cycle is found, and is one: closed, and each of its steps a link."""
    links = _with_back_edges(s, d)
    cycle = graph.cycles(Facts.of(tables.user_facts(s, d), links))["cycle"]
    steps = s.createDataFrame(list(zip(cycle, cycle[1:])), "from_id string, to_id string")
    there = steps.join(links, ["from_id", "to_id"], "left_semi").count()
    return s.createDataFrame([(len(cycle) > 1, bool(cycle) and cycle[0] == cycle[-1] and there == len(cycle) - 1)], "cyclic boolean, real boolean")


_add("cycles_found", _found, "SELECT true AS cyclic, true AS real")
_add("causal_degree", lambda s, d: graph.degree(tables.user_links(s, d)), f"WITH {LINKS} SELECT event_id, count(*) AS degree FROM (SELECT from_id AS event_id FROM link UNION ALL SELECT to_id FROM link) GROUP BY event_id")

# ---- vectors, search ----
_add("similar_topk", lambda s, d: _rounded(vector.similar(tables.vector_facts(s, d), "vec:3", 10), "score"), "SELECT 'vec:' || vec_id AS event_id, 'vec:' || label || '/' || vec_id AS subject, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS score FROM embeddings WHERE vec_id <> 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) DESC, event_id LIMIT 10")
_add("similar_least", lambda s, d: _rounded(vector.similar(tables.vector_facts(s, d), "vec:8", None, 0.3), "score"), "SELECT 'vec:' || vec_id AS event_id, 'vec:' || label || '/' || vec_id AS subject, round(s, 6) AS score FROM (SELECT *, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 8)) AS s FROM embeddings) WHERE vec_id <> 8 AND s >= 0.3")
_TERMS = ("license", "the", "und")
_BM = (
    f"WITH {DOCS}, w AS (SELECT *, list_filter(regexp_split_to_array(lower(concat_ws(' ', subject, text, lang, source)), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') AS w FROM doc), "
    + "c AS (SELECT *, len(w) AS n, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS)) + " FROM w), "
    + "s AS (SELECT count(*) AS docs, avg(n) AS mean, " + ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(_TERMS))) + " FROM c), "
    + "k AS (SELECT c.*, " + " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (docs - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.5::DOUBLE / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) ELSE 0 END" for i in range(len(_TERMS))) + " AS bm FROM c, s WHERE " + " + ".join(f"tf{i}" for i in range(len(_TERMS))) + " > 0)"
)
_add("search_bm25", lambda s, d: _rounded(search.bm25(search.document(temporal.current(tables.doc_facts(s, d)), None).select("event_id", "_text"), _TERMS).select("event_id", F.col("_bm").alias("keyword")), "keyword"), f"{_BM} SELECT event_id, round(bm, 6) AS keyword FROM k")
_add(
    "search_signals",
    lambda s, d: _rounded(_docs(s, d).query("SEARCH 'License, the und' OF doc:* LIMIT 30", NOW).table.select("event_id", "score"), "score"),
    f"{_BM}, e AS (SELECT *, confidence * weight AS tr FROM k), m AS (SELECT min(bm) AS b0, max(bm) AS b1, min(eff) AS r0, max(eff) AS r1, min(tr) AS t0, max(tr) AS t1 FROM e), "
    "z AS (SELECT event_id, subject, seq, 0.70::DOUBLE * CASE WHEN b1 > b0 THEN (bm - b0) / (b1 - b0) ELSE 1 END + 0.12::DOUBLE * CASE WHEN r1 > r0 THEN (eff - r0) / (r1 - r0)::DOUBLE ELSE 1 END + 0.12::DOUBLE * CASE WHEN t1 > t0 THEN (tr - t0) / (t1 - t0) ELSE 1 END + 0.06::DOUBLE AS score FROM e, m) "
    "SELECT event_id, round(score, 6) AS score FROM z ORDER BY z.score DESC, subject LIMIT 30",
)

# ---- profile, context, transactions ----
_add(
    "profile_fields",
    lambda s, d: profile.fields(read.gather(tables.line_facts(s, d), Query("facts", "part:*"))).select("field", "type", F.round("coverage", 6).alias("coverage"), "distinct_values", "min", "max", F.round("avg", 6).alias("avg"), F.col("top")[0]["value"].alias("top_value"), F.col("top")[0]["count"].alias("top_count")),
    f"WITH {LINE}, {CURRENT}" + " UNION ALL ".join(f" SELECT '{c}' AS field, 'number' AS type, 1.0::DOUBLE AS coverage, least(count(DISTINCT {c}), 1000)::BIGINT AS distinct_values, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS avg, NULL::VARCHAR AS top_value, NULL::BIGINT AS top_count FROM cur" for c in ("price", "qty", "discount", "tax"))
    + "".join(f" UNION ALL SELECT '{c}', '{t}', 1.0::DOUBLE, count(*)::BIGINT, NULL, NULL, NULL, arg_max(v, (n, v))::VARCHAR, max(n)::BIGINT FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM cur GROUP BY v)" for c, t in (("status", "string"), ("bulk", "bool"))),
)
_add("profile_summary", lambda s, d: profile.summary(read.gather(tables.user_facts(s, d), Query("facts", "*"))).select("events", "subjects", F.col("facets")["click"].alias("clicks")), "SELECT count(DISTINCT (user_id, event_type)) AS events, count(DISTINCT user_id) AS subjects, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicks FROM events")
_PRICE = """
price AS (
  SELECT 'part:' || p_partkey AS subject, 'catalog' AS facet, p_retailprice AS price, p_partkey AS seq FROM part
  UNION ALL SELECT 'part:' || l_partkey, 'ledger', l_extendedprice / l_quantity, (epoch_us(l_shipdate) // 86400000000) * 100000000000000 + l_orderkey * 100000 + l_suppkey * 10 + l_linenumber FROM lineitem),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, facet ORDER BY seq DESC) AS nth FROM price) WHERE nth = 1)"""
_add("context_disagreements", lambda s, d: disagreements(temporal.current(tables.price_facts(s, d))).select("subject", "field", F.size("claims").alias("claims"), "resolved_facet"), f"WITH {_PRICE} SELECT subject, 'price' AS field, 2::INT AS claims, 'catalog' AS resolved_facet FROM cur GROUP BY subject HAVING count(*) = 2 AND min(price) <> max(price)")
# the offset moves prices, which have few decimals, off the ties of rounding
_add("consistency", lambda s, d: _rounded(topology.consistency(temporal.current(tables.price_facts(s, d)), "price", 200.0).withColumn("score", F.sqrt("score") + 0.00000137), "score", digits=4), f"WITH {_PRICE} SELECT subject, (1 + (max(price) - min(price) > 200)::INT)::INT AS components, round(max(price) - min(price) + 0.00000137::DOUBLE, 4) AS score, max(price) - min(price) <= 200 AS consistent, CASE WHEN max(price) - min(price) > 200 THEN 'catalog' END AS outlier FROM cur GROUP BY subject")
_add("drift", lambda s, d: _rounded(_user(s, d).query("DRIFT OF user:* ON value BUCKETS 4", NOW).table, "drift"), f"WITH {USERS}, o AS (SELECT value AS v, row_number() OVER (ORDER BY eff, seq) - 1 AS i, count(*) OVER () AS n FROM usr WHERE value IS NOT NULL), b AS (SELECT v, n, least(i // (n // 4), 3) AS b FROM o), g AS (SELECT b, any_value(n) AS n, list(v ORDER BY v) AS l FROM b GROUP BY b), p AS (SELECT x.b, x.n, x.l AS xl, y.l AS yl, unnest(range(1, greatest(len(x.l), len(y.l)) + 1)) AS i FROM g x JOIN g y ON y.b = x.b + 1) SELECT b::INT AS bucket, round(max(abs(xl[least(i, len(xl))] - yl[least(i, len(yl))])), 6) AS drift, any_value(n)::INT AS points FROM p GROUP BY b")


def _asof_sql(t: int, name: str) -> str:
    return f"{name} AS (SELECT subject, facet, event_id, price, qty FROM ({ASOF.format(f'eff <= {t} AND rec <= {t}')}))"


_SAME = "a.price = b.price AND a.qty = b.qty"
_add("diff_between", lambda s, d: _line(s, d).query("DIFF OF part:* BETWEEN 1998-01-01 AND 1998-03-01", NOW).table.select("subject", "facet", "change", F.col("before.price").alias("old_price"), F.col("after.price").alias("new_price")), f"WITH {LINE}, lf AS (SELECT * FROM line), {_asof_sql(T98, 'a')}, {_asof_sql(T98 + 59 * DAY, 'b')} SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.facet, b.facet) AS facet, CASE WHEN a.subject IS NULL THEN 'added' WHEN b.subject IS NULL THEN 'removed' ELSE 'changed' END AS change, a.price AS old_price, b.price AS new_price FROM a FULL JOIN b ON a.subject = b.subject AND a.facet = b.facet WHERE a.subject IS NULL OR b.subject IS NULL OR a.event_id <> b.event_id")
_add("rollback_plan", lambda s, d: txn.rollback_plan(tables.line_facts(s, d), T99).select("subject", "facet", "change", F.col("value.price").alias("price")), f"WITH {LINE}, {CURRENT}, {_asof_sql(T99, 'a')} SELECT cur.subject, cur.facet, CASE WHEN a.subject IS NULL THEN 'retired' ELSE 'restored' END AS change, a.price FROM cur LEFT JOIN a ON a.subject = cur.subject AND a.facet = cur.facet WHERE a.subject IS NULL OR a.event_id <> cur.event_id")
_add("retention_plan", lambda s, d: retention.plan(tables.user_facts(s, d), "user:*", 1_706_000_000_000_000).select("subject", "facet", "event_id"), f"WITH {USERS}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, facet ORDER BY seq DESC) AS nth FROM usr) WHERE nth = 1) SELECT subject, facet, event_id FROM c WHERE subject IN (SELECT subject FROM c GROUP BY subject HAVING max(eff) < 1706000000000000)")

# ---- sources, integrity, shape ----
_add("bulk_to_facts", lambda s, d: to_facts(tables.table(s, d, "supplier"), "supplier:{s_suppkey}/nation:{s_nationkey}", fields=["s_name"], ref="s_suppkey").select("subject", "facet", "value", "source_ref"), "SELECT 'supplier:' || s_suppkey || '/nation:' || s_nationkey AS subject, 'source' AS facet, '{\"s_name\":\"' || s_name || '\"}' AS value, s_suppkey::VARCHAR AS source_ref FROM supplier")
_add("merkle_roots", lambda s, d: integrity.segment_roots(tables.user_facts(s, d), 1000).select("segment", "records"), "SELECT event_id // 1000 AS segment, count(*) AS records FROM events GROUP BY 1")
_add("shape_betti", lambda s, d: s.createDataFrame([(i, b) for i, b in enumerate(_line(s, d).query("SHAPE OF part:* ON price, qty", NOW).info["betti"])], "dimension int, betti int"))
_add("shape_embedding", lambda s, d: s.createDataFrame([(i, b) for i, b in enumerate(Engine(tables.vector_facts(s, d)).query("SHAPE OF vec:* ON EMBEDDING", NOW).info["betti"])], "dimension int, betti int"))
