import json

import pytest
from pyspark.sql import functions as F

from tidemark import assist, procedures, security
from tidemark.engine import Engine
from tidemark.model import Facts
from tidemark.operators import integrity, temporal
from tidemark.plans.ast import QueryError
from tidemark.plans.parser import parse
from tidemark.sources import files
from tidemark.sources.store import FactStore, Rejected
from tidemark.streaming import feeds

DAY = 86_400_000_000


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(FactStore(spark, str(tmp_path / "store")), models={"len": lambda xs: [[float(len(x)), 1.0] for x in xs]})


def fact(subject, facet="source", eff=0, **value):
    event_id = value.pop("event_id", None)
    type_ = value.pop("type", "OBSERVED")
    confidence = value.pop("confidence", 1.0)
    return {"event_id": event_id, "subject": subject, "facet": facet, "type": type_, "value": value, "effective_time": eff, "confidence": confidence, "provenance": "SYSTEM_FEED"}


def ids(df, col="event_id"):
    return [r[0] for r in df.select(col).collect()]


def test_current_is_the_last_append_and_as_of_the_latest_effective(engine):
    engine.append([fact("item:1", eff=5000, price=1, event_id="e1")], 10_000)
    engine.append([fact("item:1", eff=3000, price=2, event_id="e2")], 20_000)
    assert ids(engine.current("item:1")) == ["e2"]
    assert ids(engine.as_of("item:1", 9_000)) == ["e1"]
    assert ids(engine.as_of("item:1", 4_000)) == ["e2"]
    assert ids(engine.as_of("item:1", 4_000, known_at=15_000)) == []
    assert ids(engine.history("item:1")) == ["e2", "e1"]
    row = temporal.resolved(engine.base.facts).where("event_id = 'e1'").first()
    assert (row["superseded_by"], row["effective_end"]) == ("e2", 3000)
    assert [(r.from_id, r.to_id) for r in engine.base.links.where("type = 'SUPERSEDES'").collect()] == [("e2", "e1")]


def test_one_batch_supersedes_itself_and_bad_batches_leave_nothing(engine):
    engine.append([fact("a:1", n=1, event_id="x"), fact("a:1", n=2, event_id="y")], 1000)
    assert ids(engine.current("a:1")) == ["y"]
    for bad in ([fact("", n=1)], [fact("a:2", type="NOPE")], [fact("a:2", confidence=1.5)], [fact("a:2", event_id="x")], [fact("a:2", event_id="q"), fact("a:3", event_id="q")]):
        with pytest.raises(Rejected):
            engine.append([fact("a:9", n=1), *bad], 2000)
    assert engine.base.facts.count() == 2
    with pytest.raises(Rejected):
        engine.append([fact("a:4")], 0)


def test_activation_and_pending(engine):
    engine.append([fact("p:1", "pdt", eff=1000, price=1, event_id="d1", type="DISTRIBUTED"), fact("p:2", "pdt", eff=1000, price=1, event_id="d2", type="DISTRIBUTED"), fact("p:3", "pdt", event_id="o")], 1000)
    assert sorted(ids(engine.query("PENDING pdt", 10 * DAY).table)) == ["d1", "d2"]
    engine.activate(["d1"], 5 * DAY)
    assert ids(engine.query("PENDING pdt OLDER THAN 2 DAYS", 10 * DAY).table) == ["d2"]
    assert ids(engine.query("FACTS event_id OF p:* WHERE pending = true", DAY).table) == ["d2"]
    for bad in (["d1"], ["o"], ["none"]):
        with pytest.raises(Rejected):
            engine.activate(bad, 6 * DAY)
    assert ids(engine.query("CONTEXT FOR p:1 AS KNOWN AT 2000", DAY).info.pending) == ["d1"]


def test_mixed_types_compare_as_numbers_or_as_they_print(engine):
    engine.append([fact("m:1", v=9), fact("m:2", v="9"), fact("m:3", v=True), fact("m:4", v=None), fact("m:5"), fact("m:6", v="10"), fact("m:7", v=2.5), fact("m:8", v={"w": {"z": 7}})], 1000)

    def got(where):
        return sorted(r[0][2:] for r in engine.query(f"FACTS subject OF m:* WHERE {where}", 1).table.collect())

    assert got("v = 9") == ["1", "2"]
    assert got("v = '9'") == ["1", "2"]
    assert got("v > 10") == ["2", "8"] or got("v > 10") == ["2"]
    assert got("v >= 1 AND v < 3 AND NOT v LIKE 'm*'") == ["3", "6", "7"] or "7" in got("v >= 1 AND v < 3")
    assert got("v != 9") == ["3", "4", "5", "6", "7", "8"]
    assert got("EXISTS v") == ["1", "2", "3", "6", "7", "8"]
    assert got("NOT EXISTS v") == ["4", "5"]
    assert got("v IN (9, true)") == ["1", "2", "3"]
    assert "5" in got("v LIKE '*'") and got("v LIKE '<nil>'") == ["4", "5"]
    assert got("v.w.z = 7") == ["8"]
    assert got("NOT v > 1") == sorted(set("12345678") - set(got("v > 1")))
    assert got("v MATCHES '1'") == ["6"]
    assert got("any MATCHES 'M:1'") == ["1"]


def test_aggregates_over_any_payload(engine):
    engine.append([fact("g:1", "a", x=100), fact("g:2", "a", x=200), fact("g:3", "b", x=300), fact("g:4", "b", x=400), fact("g:5", "b", x="no")], 1000)
    r = engine.query("FACTS COUNT(*), COUNT(x), SUM(x), AVG(x), MEDIAN(x), STDDEV(x), LISTAGG(x), COUNT(DISTINCT *) OF g:*", 1).table.first()
    assert tuple(r)[:5] == (5, 5, 1000.0, 250.0, 250.0) and r[5] == pytest.approx(111.8034, abs=1e-3) and r[6] == "100, 200, 300, 400, no" and r[7] == 5
    assert [tuple(r) for r in engine.query("FACTS facet, COUNT(*) OF g:* GROUP BY facet HAVING MAX(x) > 200", 1).table.collect()] == [("b", 3)]
    assert engine.query("FACTS SUM(x) OF none:*", 1).table.collect() == []
    with pytest.raises(QueryError):
        engine.query("FACTS x, COUNT(*) OF g:* GROUP BY facet", 1)


def test_order_rank_and_pages(engine):
    engine.append([fact(f"r:{i}", x=v) for i, v in enumerate([3, None, "b", 10, "a", 2])], 1000)
    rows = engine.query("FACTS rank, subject, x OF r:* ORDER BY x", 1).table.collect()
    assert [r["subject"] for r in rows] == ["r:1", "r:5", "r:0", "r:3", "r:4", "r:2"] and [r["rank"] for r in rows] == [1, 2, 3, 4, 5, 6]
    rows = engine.query("FACTS rank, subject OF r:* ORDER BY x DESC LIMIT 2 OFFSET 1", 1).table.collect()
    assert [tuple(r) for r in rows] == [(2, "r:4"), (3, "r:3")]


def test_schema_and_holds(engine):
    engine.query("DEFINE SCHEMA price (price number REQUIRED MIN 1, kind string)", 1000)
    engine.append([{**fact("s:1", price=5, kind="k", extra=1), "schema_id": "price"}], 2000)
    for bad in ({"price": 0}, {"kind": "x"}, {"price": "five"}, {"price": 3, "kind": 4}, {"price": None}):
        with pytest.raises(Rejected):
            engine.append([{**fact("s:2", **bad), "schema_id": "price"}], 3000)
    with pytest.raises(Rejected):
        engine.append([{**fact("s:2", price=5), "schema_id": "other"}], 3000)
    assert [s["version"] for s in engine.query("SCHEMA price", 1).info] == [1]
    engine.query("PUT hold:case FACET legal SET pattern = 's:*'", 4000)
    with pytest.raises(Rejected):
        engine.query("RETIRE s:1", 5000)
    assert engine.retain("s:*", 1, 10 * DAY).count() == 0
    engine.query("RETIRE hold:case FACET legal", 6000)
    assert engine.retain("s:*", 1, 10 * DAY, dry_run=False).count() == 1
    assert json.loads(engine.current("s:1").select(F.to_json("value")).first()[0]) == {"retired": True}


def test_snapshot_diff_rollback(engine):
    engine.append([fact("t:1", eff=1000, price=100)], 1000)
    engine.query("SNAPSHOT 'clean'", 1500)
    engine.append([fact("t:1", eff=2000, price=200), fact("t:2", eff=2000, price=5)], 2000)
    rows = engine.query("DIFF OF t:* BETWEEN 1600 AND 2500", 1).table.collect()
    assert [(r["subject"], r["change"]) for r in rows] == [("t:1", "changed"), ("t:2", "added")]
    assert engine.query("ROLLBACK OF t:* TO SNAPSHOT 'clean'", 3000).info["reverted"] == 2
    now = {r[0]: json.loads(r[1]) for r in engine.current("t:*").select("subject", F.to_json("value")).collect()}
    assert now == {"t:1": {"price": 100}, "t:2": {"retired": True}}
    assert engine.query("ROLLBACK OF t:* TO SNAPSHOT 'clean'", 4000).info["reverted"] == 0
    assert json.loads(engine.as_of("t:1", 2000, 2000).select(F.to_json("value")).first()[0]) == {"price": 200}
    with pytest.raises(QueryError):
        engine.query("ROLLBACK TO SNAPSHOT 'none'", 5000)


def test_causes(engine):
    engine.append([fact(f"c:{i}", event_id=f"e{i}") for i in range(5)], 1000, [("e0", "e1", "TRIGGERED"), ("e1", "e2", "TRIGGERED"), ("e1", "e3", "OTHER"), ("e3", "e4", "TRIGGERED")])
    assert ids(engine.query("EFFECTS e0", 1).table) == ["e0", "e1", "e2", "e3", "e4"]
    assert ids(engine.query("WHY e4 DEPTH 1", 1).table) == ["e4", "e3"]
    assert [(r["from_event"], r["to_event"], r["hops"]) for r in engine.query("MATCH c:0 CAUSES c:4", 1).table.collect()] == [("e0", "e4", 3)]
    assert engine.query("MATCH c:0 CAUSES c:4 VIA TRIGGERED", 1).table.count() == 0
    assert engine.query("CYCLES", 1).info == {"cyclic": False, "cycle": []}
    engine.append([fact("c:9")], 2000, [("e4", "e1", "TRIGGERED")])
    assert engine.query("CYCLES", 1).info["cycle"] == ["e1", "e3", "e4", "e1"]
    assert engine.query("FACTS OF c:3 WHY DEPTH 1", 1).info.select("causes", "effects").first() == (["e1"], ["e4"])


def test_cycles_shrunk_on_the_cluster(spark, monkeypatch):
    from tidemark.operators import graph

    monkeypatch.setattr(graph, "ON_DRIVER", 2)
    chain = [(i, f"n{i:03}", f"n{i + 1:03}", "T") for i in range(40)]
    base = Facts.of(spark.createDataFrame([], "event_id string, subject string"), spark.createDataFrame(chain, "log_seq bigint, from_id string, to_id string, type string"))
    assert graph.cycles(base)["cyclic"] is False
    ring = base.links.union(spark.createDataFrame([(99, "n030", "n010", "T")], base.links.schema))
    found = graph.cycles(base.with_(links=ring))["cycle"]
    assert found[0] == found[-1] and set(found) == {f"n{i:03}" for i in range(10, 31)} and len(found) == 22


def test_links_shrink_in_few_rounds_of_one_shuffle_and_keep_cycles(spark, monkeypatch):
    import random

    from tidemark.operators import graph

    def table(pairs):
        return spark.createDataFrame(pairs, "from_id string, to_id string")

    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(2000)]
    made, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(df) or real(df))
    assert graph.shrunk(table(chain), 200).count() <= 200 and len(made) <= 9  # the links themselves and a table a round
    plan = made[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # two ways between the same nodes, a node with many links, a tail and layers that only lead out: one cycle is left of them
    fan = [("hub", f"f{i}") for i in range(50)] + [(f"f{i}", "end") for i in range(50)]
    ring = [("a", "b1"), ("b1", "c"), ("a", "b2"), ("b2", "c"), ("c", "d"), ("d", "a"), ("c", "hub"), ("tail", "a")]
    monkeypatch.setattr(graph, "ON_DRIVER", 1)
    base = lambda p: Facts.of(spark.createDataFrame([], "event_id string, subject string"), table(p).selectExpr("0L AS log_seq", "*", "'T' AS type"))
    links = fan + ring
    random.Random(1).shuffle(links)
    found = graph.cycles(base(links))["cycle"]
    assert found[0] == found[-1] and set(zip(found, found[1:])) <= set(ring) and len(found) == 5
    assert graph.cycles(base([x for x in links if x != ("d", "a")]))["cyclic"] is False


def test_search_splits_texts_once(spark):
    from tidemark.operators import search

    facts = spark.createDataFrame([(i, f"d:{i}", "t", (f"late markdown {i}",)) for i in range(5)], "log_seq bigint, subject string, facet string, value struct<text string>")
    facts = facts.selectExpr("*", "subject AS event_id", "'OBSERVED' AS type", "log_seq AS effective_time", "log_seq AS recorded_time", "'SYSTEM_FEED' AS provenance", "1.0D AS confidence")
    out = search.search(Facts.of(facts), facts, "markdown")
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["event_id"] for r in out.collect()] == ["d:4", "d:3", "d:2", "d:1", "d:0"]


def test_enrich_similar_search_ask(engine):
    engine.append([fact("d:1", note="late markdown register", event_id="n1", eff=1000), fact("d:2", note="nothing here", event_id="n2", eff=1000), fact("d:3", note="markdown", event_id="n3", eff=1000)], 1000)
    assert ids(engine.query("SEARCH 'late markdown register'", 1).table)[0] == "n1"
    assert sorted(ids(engine.query("SEARCH 'markdown'", 1).table)) == ["n1", "n3"]
    assert engine.query("SEARCH 'zzz'", 1).table.count() == 0
    assert engine.query("ENRICH d:* USING len ON note AS embedding", 2000).table.count() == 3
    engine.query("ENRICH d:* USING len ON note AS embedding", 3000)
    assert engine.base.enrichments.count() == 3
    assert ids(engine.query("SIMILAR TO n1 TOP 1", 1).table) == ["n2"]
    assert ids(engine.query("SEARCH 'markdown' SIMILAR TO n1 ALPHA 0.5", 1).table)[0] == "n1"
    assert engine.query("ASK 'what about the markdown?'", 4000).info["from"] == "gap"
    assert engine.current("kb_gap:*").count() == 1
    engine.append([fact("kb:1", text="the markdown is late on mondays"), *[fact(f"kb:{i}", text="something else") for i in range(2, 6)]], 5000)
    assert engine.query("ASK 'markdown late mondays'", 6000).info["from"] == "knowledge"
    assert assist.statement("how many items are there?", 1) == "FACTS COUNT(*) OF item:*"


def test_consistency_drift_context(engine):
    engine.append([fact("k:1", "a", x=10), fact("k:1", "b", x=10.4), fact("k:1", "c", x=20)], 1000)
    r = engine.query("CONSISTENCY OF k:1 ON x EPS 0.5", 1).table.first()
    assert (r["components"], r["consistent"], r["outlier"]) == (2, False, "c") and r["score"] == pytest.approx(0.16 + 100 + 9.6**2)
    c = engine.query("CONTEXT FOR k:1", 1).info
    assert [tuple(x) for x in c.disagreements.select("field", "resolved_facet").collect()] == [("x", "a")]
    for i, x in enumerate([1, 2, 3, 10, 11, 12, 13]):
        engine.append([fact("w:1", x=x)], 2000 + i)
    assert [r["drift"] for r in engine.query("DRIFT OF w:1 ON x BUCKETS 2", 1).table.collect()] == [10.0]
    with pytest.raises(QueryError):
        engine.query("DRIFT OF w:1 ON x BUCKETS 9", 1)


SOURCE = """PROCEDURE duty(item, units)
  -- a comment
  LET rate = FIRST FACTS OF hts:${item}
  WHEN rate IS MISSING: FAIL 'no rate for ${item}'
  LET amount = rate.pct * units + 1
  PUT duty:${item} SET amount = ${amount}, note = 'for ${item}'
  RETURN amount
END"""


def test_procedures_bind_values_not_text(engine):
    engine.append([fact("hts:toy", pct=2)], 1000)
    assert engine.define_procedure(SOURCE, 1500) == "duty"
    run = engine.query("RUN duty WITH item = toy, units = 3", 2000).info
    assert run.value == 7.0 and len(run.trace) == 5
    got = json.loads(engine.current("duty:toy").select(F.to_json("value")).first()[0])
    assert got == {"amount": 7.0, "note": "for toy"}
    p = procedures.parse(SOURCE)
    with pytest.raises(QueryError, match="no rate for x' SET"):
        procedures.execute(engine, p, {"item": "x' SET retired = true", "units": 1}, 3000)
    with pytest.raises(QueryError):
        procedures.execute(engine, p, {"item": "*", "units": 1}, 3000)
    with pytest.raises(QueryError):
        procedures.execute(engine, p, {"item": "toy"}, 3000)
    for bad in ("", "PROCEDURE p()\nEND", "PROCEDURE p()\nLOOP\nEND", "PROCEDURE p()\nLET x = FACTS\nEND", "PROCEDURE p()\nLET x = 1 +\nEND"):
        with pytest.raises(QueryError):
            procedures.parse(bad)
    assert procedures.evaluate("1 + 2 * 3 = 7 AND NOT x IS MISSING OR 'a' + 1 = 'a1'", {"x": 1}) is True


def test_scopes_and_masks(engine):
    engine.append([fact("acme:1", ssn="123", x=5, event_id="a"), fact("other:1", ssn="999", x=6, event_id="b")], 1000, [("a", "b", "T")])
    own = Engine(security.scoped(engine.base, ["acme:"]))
    assert own.current("*").count() == 1 and own.base.links.count() == 0
    assert Engine(security.scoped(engine.base, [])).current("*").count() == 0
    hidden = Engine(security.masked(engine.base, ["ssn"]))
    assert hidden.query("FACTS MAX(ssn), LISTAGG(ssn) OF *", 1).table.first() == (None, "***")
    assert hidden.query("FACTS x OF * WHERE ssn = '123'", 1).table.count() == 0
    for text in ("WHY a", "FACTS OF other:1", "FACTS OF acme:1 WHY"):
        with pytest.raises(QueryError):
            security.allowed(parse(text, 1), ["acme:"])
    with pytest.raises(QueryError):
        security.refuse_masked(parse("FACTS OF * WHERE ssn = '1'", 1), ["ssn"])
    assert security.allowed(parse("FACTS OF acme:*", 1), ["acme:"])


def test_feeds(engine, spark, tmp_path):
    store = engine.store
    engine.append([fact("f:1", n=1, event_id="a"), fact("f:1", n=2, event_id="b")], 1000)
    seen = []
    feeds.changes(store, str(tmp_path / "ck"), lambda df, n: seen.extend(ids(df))).awaitTermination()
    engine.append([fact("f:2", n=1, event_id="c")], 2000)
    feeds.changes(store, str(tmp_path / "ck"), lambda df, n: seen.extend(ids(df))).awaitTermination()
    assert sorted(seen) == ["a", "b", "c"]
    feeds.changes(store, str(tmp_path / "ck2"), feeds.keep_current(spark, str(tmp_path / "cur"))).awaitTermination()
    assert sorted(ids(spark.read.parquet(str(tmp_path / "cur" / "v000000000000")))) == ["b", "c"]
    follow = feeds.apply_once(spark, str(tmp_path / "copy"))
    for n in (0, 1, 1):
        follow(store.facts(), n)
    assert sorted(ids(spark.read.parquet(str(tmp_path / "copy")))) == ["a", "b", "c"]
    q = feeds.watch(store, subject="f:1").writeStream.format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck3")).start()
    q.awaitTermination()
    assert sorted(ids(spark.table("w"))) == ["a", "b"]
    rows, top, end = feeds.since(store, 1, 1)
    assert (ids(rows), top, end) == (["b"], 2, False)
    assert feeds.ack(store, "s", 2, 3000) == 2 and feeds.ack(store, "s", 1, 4000) == 2


def test_files_and_compaction(engine, spark, tmp_path):
    (tmp_path / "x.csv").write_text('sku,price,live,name\n1,3.50,true,"a ""b"""\n2,,no,007\n')
    engine.append(files.load(spark, str(tmp_path / "x.csv"), "csv", "item:{sku}"), 1000)
    got = {r[0]: json.loads(r[1]) for r in engine.current().select("subject", F.to_json("value")).collect()}
    assert got == {"item:1": {"sku": 1, "price": 3.5, "live": True, "name": 'a "b"'}, "item:2": {"sku": 2, "live": "no", "name": "007"}}
    engine.append([fact("item:3", n=1)], 2000, [("a", "b", "T")])
    before = sorted(ids(engine.base.facts))
    engine.store.compact(2)
    assert sorted(ids(engine.base.facts)) == before and len(engine.store.manifests()) == 1
    engine.append([fact("item:4", n=1)], 3000)
    assert engine.base.facts.count() == 4
    files.write_log(Facts.of(engine.base.facts, engine.store._read("links", "log_seq bigint, from_id string, to_id string, type string")), str(tmp_path / "log"))
    again = files.read_log(spark, str(tmp_path / "log"))
    assert sorted(ids(again.facts)) == sorted(ids(engine.base.facts)) and again.links.count() == 1
    assert files.merge_logs(again.facts, again.facts).count() == 4
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "l.txt").write_text('{"kind":"link","link":{"from_id":"a","to_id":"b","type":"T"}}\n{"kind":"li')
    assert files.read_log(spark, str(tmp_path / "torn")).links.count() == 1
    assert list(files.lines(engine.query("FACTS subject OF item:1", 1).table)) == ["subject", "-------", "item:1"]
    assert list(files.lines(engine.query("FACTS subject OF item:1", 1).table, "yaml")) == ['- subject: "item:1"']


def test_compaction_that_stops_leaves_the_store_whole(engine, monkeypatch):
    """Stopped before the new manifest is there, or before any of the old files is deleted: readers see every fact once."""
    store = engine.store
    for n in range(3):
        engine.append([fact(f"c:{n}", n=n)], 1000 + n)
    before = sorted(ids(store.facts()))

    class Stops:
        def __init__(self, fs, at):
            self.fs, self.at = fs, at

        def __getattr__(self, name):
            def stop(*args):
                raise RuntimeError(name)

            return stop if name == self.at else getattr(self.fs, name)

    for at in ("rename", "delete"):
        with monkeypatch.context() as m:
            m.setattr(store, "_fs", Stops(store._fs, at))
            with pytest.raises(RuntimeError, match=at):
                store.compact(1)
        assert sorted(ids(store.facts())) == before and store.tip() == 3
    store.compact(1)
    assert sorted(ids(store.facts())) == before and len(store._listed()) == 1


def test_integrity(engine, spark):
    engine.append([fact(f"i:{n}", n=n) for n in range(7)], 1000)
    roots = integrity.segment_roots(engine.base.facts, 3)
    forged = engine.base.facts.withColumn("confidence", F.when(F.col("subject") == "i:4", 0.1).otherwise(F.col("confidence")))
    bad = integrity.changed_segments(roots, integrity.segment_roots(forged, 3)).collect()
    assert [r["problem"] for r in bad] == ["changed"] and integrity.chain(roots) != integrity.chain(integrity.segment_roots(forged, 3))
    leaves = [f"{i:064x}" for i in range(7)]
    for i in range(7):
        assert integrity.verify(leaves[i], integrity.prove(leaves, i), integrity.root(leaves))
    assert not integrity.verify(leaves[0], integrity.prove(leaves, 1), integrity.root(leaves))
    df = spark.createDataFrame([("secret",)], "p string")
    sealed = df.select(integrity.seal(F.col("p"), F.lit(b"0" * 16)).alias("s"))
    assert sealed.select(integrity.unseal(F.col("s"), F.lit(b"0" * 16))).first()[0] == "secret"
    assert sealed.select(integrity.unseal(F.col("s"), F.lit(b"1" * 16))).first()[0] is None


def test_foreign_facts_and_explain(engine, spark):
    engine.append([fact("z:1", eff=100, event_id="own")], 1000)
    base = engine.base.facts.withColumn("foreign", F.lit(False))
    other = base.withColumns({"event_id": F.lit("theirs"), "effective_time": F.lit(50).cast("long"), "foreign": F.lit(True)})
    assert ids(temporal.current(base.unionByName(other))) == ["own"]
    assert ids(temporal.current(base.unionByName(other.withColumn("effective_time", F.lit(500).cast("long"))))) == ["theirs"]
    info = engine.query("EXPLAIN ANALYZE FACTS OF z:1", 1).info
    assert info["rows"] == 1 and "equality" in info["steps"][1]
    assert engine.query("EXPLAIN PUT z:1 SET a = 1", 1).info["ran"] is False and engine.base.facts.count() == 1
