import json

import pytest

from tidemark.engine import Engine
from tidemark.operators import temporal
from tidemark.sources import ddl, demo, messages
from tidemark.sources.store import FactStore

DDL = """
CREATE TABLE customers (id NUMBER(10) PRIMARY KEY, name VARCHAR2(20) NOT NULL, is_vip NUMBER(1), created_by VARCHAR(9), active_flag CHAR(1));
create table if not exists shop."orders" (
  order_id INT NOT NULL, customer_id INT NOT NULL, total DECIMAL(10, 2) DEFAULT 0, start_date DATE, -- a comment, with comma
  CONSTRAINT pk PRIMARY KEY (order_id), FOREIGN KEY (customer_id) REFERENCES customers (id));
CREATE TABLE orders_hist (id INT);
CREATE TABLE order_tags (order_id INT REFERENCES orders, tag_id INT REFERENCES tags, created_at DATE);
"""


def test_ddl(spark, tmp_path):
    got = ddl.convert(DDL)
    assert got.schemas == {
        "customer": {"id": {"type": "number", "required": True}, "name": {"type": "string", "required": True}, "is_vip": {"type": "bool", "required": False}},
        "order": {"order_id": {"type": "number", "required": True}, "customer_id": {"type": "number", "required": True}, "total": {"type": "number", "required": False, "min": 0}},
    }
    assert {n[0] for n in got.notes} >= {"orders_hist", "order_tags", "customers.created_by", "customers.active_flag", "orders.start_date", "orders.customer_id"}
    engine = Engine(FactStore(spark, str(tmp_path / "s")))
    for name, fields in got.schemas.items():
        engine.store.define_schema(name, fields, 1000)
    for p in got.procedures:
        engine.define_procedure(p, 1000)
    with pytest.raises(ValueError, match="no customer 7"):
        engine.query("RUN record_order WITH order_id = 1, customer_id = 7, total = 5", 2000)
    engine.query("RUN record_customer WITH id = 7, name = Ann, is_vip = true", 2000)
    assert engine.query("RUN record_order WITH order_id = 1, customer_id = 7, total = 5", 3000).info.value == 1.0
    with pytest.raises(ValueError, match="below"):
        engine.query("RUN record_order WITH order_id = 2, customer_id = 7, total = -5", 4000)
    with pytest.raises(ValueError):
        ddl.convert("SELECT 1")


def test_messages(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    lines = ['{"type": "RECORD", "record": {"stream": "u", "data": {"id": 5, "x": 1}}}', "not json", '{"type": "RECORD", "record": {"stream": "u", "data": {"x": 2}}}', '{"type": "STATE", "state": {"n": 1}}', '{"type": "RECORD", "record": {"stream": "u", "data": {"id": 6}}}']
    acked = messages.write(store, lines, 1000, key="id")
    assert next(acked)["state"] == {"n": 1}
    assert sorted(r[0] for r in store.facts().select("subject").collect()) == ["u:1", "u:5"]
    assert list(acked) == [] and store.facts().count() == 3
    out = list(messages.read(store, 1, 1))
    assert [m["type"] for m in out] == ["RECORD", "STATE", "RECORD", "STATE"] and out[-1]["state"]["data"]["cursor"] == 3
    assert json.dumps(out) and list(messages.read(store, 3))[0]["type"] == "STATE"
    rows = spark.createDataFrame([("t", 1, '{"k": "a"}'), ("t", 2, "{}")], "stream string, position int, data string")
    assert sorted(r[0] for r in messages.write_table(store, rows, 2000, key="k").select("subject").collect()) == ["t:2", "t:a"]


def test_demo_plants_what_is_stuck(spark):
    base = demo.price_changes(spark, 20, 5)
    sent = base.facts.where("type = 'DISTRIBUTED'")
    assert base.facts.where("type = 'INTENT'").count() == 400 and base.links.count() == sent.count()
    assert base.facts.select("event_id").distinct().count() == base.facts.count()
    for s in ("register", "shelf", "central"):
        assert temporal.pending(base.facts, s).count() == 0
    assert 0 < temporal.pending(base.facts, "handheld").count() < 40
