import numpy as np
import pytest

from tidemark.functions import naturaltime
from tidemark.plans.ast import Expr, Item, Query, QueryError, check
from tidemark.plans.parser import STATEMENTS, parse
from tidemark.plans.sqlfront import parse_sql

NOW = naturaltime.iso("2026-03-15T10:30:00Z")
DAY = 86_400_000_000


def at(text):
    return naturaltime.iso(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("now", NOW), ("today", NOW), ("NOW-7d", NOW - 7 * DAY), ("now+12h", NOW + DAY // 2), ("yesterday", at("2026-03-14")), ("tomorrow at 2pm", at("2026-03-16T14:00:00Z")),
        ("10 days ago", NOW - 10 * DAY), ("2 weeks back", NOW - 14 * DAY), ("an hour ago", NOW - DAY // 24), ("last month", at("2026-02-15")), ("last year", at("2025-03-15")),
        ("March 1, 2026", at("2026-03-01")), ("mar 1", at("2026-03-01")), ("1 March 2026 noon", at("2026-03-01T12:00:00Z")), ("3/1/2026 14:30", at("2026-03-01T14:30:00Z")),
        ("2026-03-01 9am EST", at("2026-03-01T14:00:00Z")), ("March 1 2026 9am EST", at("2026-03-01T14:00:00Z")), ("March 1 2026 midnight IST", at("2026-02-28T18:30:00Z")), ("2026-01-02T03:04:05+02:00", at("2026-01-02T01:04:05Z")), ("5000", 5000),
    ],
)
def test_moments(text, want):
    assert naturaltime.parse(text, NOW) == want


@pytest.mark.parametrize("text", ["soon", "25:00", "13pm", "3 fortnights ago", "Smarch 3"])
def test_no_moment(text):
    with pytest.raises(ValueError):
        naturaltime.parse(text, NOW)


CORPUS = """FACTS OF toy:robot
FACTS * OF item:*/store:4001 FACET shelf
FACTS subject, price, address.city OF item:* AS OF 2026-03-01 AS KNOWN AT 'yesterday 5pm' WHERE price >= 3 AND NOT (kind = 'K' OR a IN (1, 'b', true)) ORDER BY price DESC LIMIT 5 OFFSET 2 WHY DEPTH 4
FACTS COUNT(*), COUNT(DISTINCT kind), MEDIAN(price), LISTAGG(kind), APPROX_COUNT_DISTINCT(kind) OF item:* GROUP BY facet HAVING COUNT(*) > 1 AND AVG(price) >= -2
FACTS OF item:* WHERE any MATCHES 'late' AND name LIKE 'a*z' AND EXISTS price
FACTS OF item:* AS OF 10 DAYS AGO
HISTORY OF item:1 WHERE price > 3 LIMIT 10
PROFILE OF item:* WHERE price > 3
SUBJECTS LIKE item:* LIMIT 3
PUT item:1 FACET shelf TYPE distributed SET price = 3, kind = 'K', live = true EFFECTIVE NOW-1d CONFIDENCE 0.5 SCHEMA s PROVENANCE SYSTEM_FEED REF r:1
CORRECT item:1 SET price = 4
RETIRE item:1 FACET shelf
PENDING register OLDER THAN 3 DAYS
DISAGREE ON price
WHY e1 DEPTH 3
EFFECTS e1
SIMILAR TO e1 TOP 5 MIN 0.2
CONTEXT FOR item:1 AS KNOWN AT NOW-1d LIMIT 5
STATS
SCHEMAS
SCHEMA price
DEFINE SCHEMA price (price number REQUIRED MIN 1 MAX 9 UNIT cents, kind string) TITLE 'prices'
SHAPE OF item:* ON price, qty MAXDIM 2 RAW SCALE 3 METRIC cosine
SHAPE OF item:* ON EMBEDDING
SHAPE OF item:1 ON price WINDOW 4 STRIDE 2 FACET a
CONSISTENCY OF item:1 ON price ACROSS FACETS EPS 0.5
CYCLES IN CAUSES OF item:1
DRIFT OF item:* ON price FACET a BUCKETS 3
SEARCH 'late markdown' OF item:* SIMILAR TO e1 ALPHA 0.3 AS OF 2026-01-01 LIMIT 3
ASK 'does it scale?'
MATCH item:* CAUSED BY order:* VIA triggered DEPTH 2 LIMIT 4
ENRICH item:* FACET a USING m ON name AS kind LIMIT 3
SNAPSHOT 'before'
ROLLBACK OF item:* TO SNAPSHOT 'before'
ROLLBACK TO LAST
DIFF OF item:* BETWEEN 2026-01-01 AND NOW
WATCH ALL FACET a TYPE observed
RUN duty WITH item = 'x', units = 3
EXPLAIN ANALYZE FACTS OF item:*"""


@pytest.mark.parametrize("text", CORPUS.split("\n"))
def test_statements_parse(text):
    q = parse(text, NOW)
    assert check(q) is q


def test_corpus_has_every_statement():
    assert {t.split()[0] for t in CORPUS.split("\n")} == set(STATEMENTS)


@pytest.mark.parametrize("text", ["", "FETCH x", "FACTS item:1", "FACTS OF item:1 WHERE", "FACTS OF item:1 LIMIT x", "FACTS OF item:1 extra", "HISTORY OF a AS OF 3", "PUT item:* SET a = 1", "PUT item:1", "FACTS OF a WHERE (x = 1", "FACTS OF a WHERE x = 'y", "WATCH item:*", "DEFINE SCHEMA s (a decimal)", "FACTS COUNT( OF x", "FACTS OF a HAVING LISTAGG(x) > 1", "FACTS OF a WHERE " + "NOT " * 150 + "x = 1", "EXPLAIN " * 300 + "STATS"])
def test_bad_statements(text):
    with pytest.raises(QueryError):
        parse(text, NOW)


def test_precedence_and_literals():
    e = parse("FACTS OF a WHERE x = 1 OR y = true AND NOT z = word", NOW).where
    assert e == Expr("or", (Expr("=", name="x", value=1.0), Expr("and", (Expr("=", name="y", value=True), Expr("not", (Expr("=", name="z", value="word"),))))))


@pytest.mark.parametrize("q", [Query("nope"), Query("facts", where=Expr("xor", name="a")), Query("facts", where=Expr("not")), Query("facts", where=Expr("and")), Query("facts", items=[Item("a", "mode")]), Query("facts", limit=-1), Query("explain")])
def test_malformed_trees(q):
    with pytest.raises(QueryError):
        check(q)


def test_sql_is_the_same_statement():
    q = parse_sql("SELECT subject, price AS p FROM item WHERE facet = 'shelf' AND price >= 3 AND (kind = 'a' OR kind IN ('b', 'c')) ORDER BY price DESC LIMIT 5 OFFSET 2 AS OF '2026-01-01'", NOW)
    w = parse("FACTS subject, price OF item:* FACET shelf AS OF 2026-01-01 WHERE price >= 3 AND (kind = 'a' OR kind IN ('b', 'c')) ORDER BY price DESC LIMIT 5 OFFSET 2", NOW)
    assert q == w
    assert parse_sql("SELECT * FROM facts", NOW).subject == "*"
    assert parse_sql("SELECT * FROM 'item:1'", NOW).subject == "item:1"
    assert parse_sql("SELECT COUNT(*) FROM facts WHERE subject = 'item:1'", NOW).subject == "item:1"
    assert parse_sql("SELECT * FROM facts FOR SYSTEM_TIME AS OF '2026-01-01'", NOW).known_at == at("2026-01-01")
    assert parse_sql("SELECT * FROM facts WHERE a IS NOT NULL AND b = NULL", NOW).where.kids[1].value is None


@pytest.mark.parametrize("text", ["DELETE FROM facts", "SELECT * FROM a, b", "SELECT COUNT(DISTINCT x) FROM facts", "SELECT * FROM facts LIMIT 3 WHERE a = 1", "SELECT FROM x"])
def test_sql_refuses(text):
    with pytest.raises(QueryError):
        parse_sql(text, NOW)


def test_homology():
    from tidemark.operators.topology import homology, time_delay

    t = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    assert homology(np.c_[np.cos(t), np.sin(t)], 0.6)[0] == [1, 1]
    rng = np.random.default_rng(1)
    assert homology(np.r_[rng.normal(0, 0.1, (10, 5)), rng.normal(9, 0.1, (10, 5))], 2.0)[0][0] == 2
    octahedron = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1.0]])
    assert homology(octahedron, 1.5, 2)[0] == [1, 0, 1]
    wave = np.sin(np.arange(80) * 2 * np.pi / 20)
    assert homology(time_delay(wave, 6), 1.0)[0] == [1, 1]


def test_approximate_counts_beside_exact_ones_keep_no_buffer_for_each_value(spark):
    from tidemark.operators import read
    from tidemark.plans.ast import Having, Query

    facts = spark.range(3000).selectExpr("concat('x:', id) AS subject", "'f' AS facet", "'OBSERVED' AS type", "id AS log_seq", "struct(cast(id % 700 AS double) AS price, cast(id % 3 AS string) AS k) AS value")
    asked = read.items("approx_count_distinct(price)", "count_distinct(price)", "approx_count_distinct(*)", "approx_count_distinct(colour)")
    got = read.read(facts, Query("facts", "x:*", items=asked, having=[Having("approx_count_distinct", "price", ">", 1.0)]))
    alone = read.read(facts, Query("facts", "x:*", items=[i for i in asked if i.agg != "count_distinct"]))
    row, other = got.first().asDict(), alone.first().asDict()
    assert row.pop("count_distinct(price)") == 700 and row == other and other["approx_count_distinct(colour)"] == 0
    grouped = Query("facts", "x:*", items=[read.items("k")[0], *asked[:2]], group_by="k")
    assert [r["count_distinct(price)"] for r in read.read(facts, grouped).collect()] == [700, 700, 700]
    plan = read.read(facts, Query("facts", "x:*", items=asked[:2]))._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct(distinct" in plan and "Expand" not in plan
