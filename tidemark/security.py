"""Scopes and masks, set once on the base that operators read, so that every operator inherits them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import Facts
from tidemark.plans.ast import Query, QueryError

MASK = "***"
_SUBJECT = frozenset("facts history profile search put diff rollback shape consistency drift context subjects".split())


def allowed(q: Query, prefixes: Iterable[str]) -> Query:
    """The statement if a holder of these subject prefixes may run it; deny by default. Statements that follow causes are refused,
    as they leave the prefix."""
    prefixes = tuple(prefixes)
    if q.kind == "explain":
        allowed(q.inner, prefixes)
        return q
    if q.kind not in _SUBJECT or q.why:
        raise QueryError(f"{q.kind.upper()} isn't open to scoped callers")
    if not any(p and q.subject.startswith(p) for p in prefixes):
        raise QueryError(f"subjects {q.subject!r} are out of scope")
    return q


def scoped(base: Facts, prefixes: Iterable[str]) -> Facts:
    """Only subjects with one of the prefixes, and only links and enrichments among them. No prefix, no facts."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("subject").startswith(p) if p else keep
    facts = base.facts.where(keep)
    ids = facts.select(F.col("event_id").alias("_id"))
    links = base.links.join(ids, base.links["from_id"] == ids["_id"], "left_semi").join(ids, F.col("to_id") == ids["_id"], "left_semi")
    enr = base.enrichments.join(ids, base.enrichments["target_event"] == ids["_id"], "left_semi")
    return base.with_(facts=facts, links=links, enrichments=enr)


def masked(base: Facts, fields: Iterable[str]) -> Facts:
    """Payload fields hidden at the source: whatever is projected, aggregated, ordered or searched sees ``***``. Texts and vectors
    made from masked facts go, too."""
    names = set(fields)
    if not names:
        return base
    kind = base.facts.schema["value"].dataType
    if isinstance(kind, T.StructType):
        cols = [F.when(F.col("value").getField(f.name).isNotNull(), F.lit(MASK)).alias(f.name) if f.name in names else F.col("value").getField(f.name).alias(f.name) for f in kind.fields]
        value = F.when(F.col("value").isNotNull(), F.struct(*cols))
    else:
        m = F.from_json(F.to_json("value"), "map<string,variant>")
        kept = F.map_zip_with(m, m, lambda k, a, b: F.when(k.isin(*names), F.parse_json(F.lit(f'"{MASK}"'))).otherwise(a))
        value = F.parse_json(F.to_json(kept))
    return base.with_(facts=base.facts.withColumn("value", value), enrichments=base.enrichments.limit(0))


def refuse_masked(q: Query, fields: Iterable[str]) -> Query:
    """A statement that tests, groups or orders by a masked field is refused: answers would tell what is hidden."""
    from tidemark.operators.read import names_of

    hidden = {f.lower() for f in fields}
    for n in names_of(Query(**{**q.__dict__, "items": []})):
        if n in hidden or n.split(".")[0] in hidden:
            raise QueryError(f"{n!r} is masked")
    return q
