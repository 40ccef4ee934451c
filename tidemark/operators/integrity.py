"""Tamper evidence: record hashes, a Merkle root a segment, inclusion proofs, a chain over segments, sealed payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaf(facts: DataFrame) -> Column:
    """SHA-256 of a record's canonical text, with a byte in front that no inner node has."""
    cols = [F.to_json("value") if c == "value" else F.col(c).cast("string") for c in sorted(facts.columns)]
    text = F.to_json(F.array(*[F.coalesce(c, F.lit("\x00")) for c in cols]))
    return F.sha2(F.concat(F.lit("\x00"), text), 256)


def _node(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + a + b).digest()


def root(leaves: Sequence[str]) -> str:
    """Merkle root of hex hashes; an odd one at the end of a level goes up as it is."""
    level = [bytes.fromhex(x) for x in leaves]
    if not level:
        return hashlib.sha256(b"").hexdigest()
    while len(level) > 1:
        level = [_node(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def prove(leaves: Sequence[str], index: int) -> list[tuple[str, str]]:
    """(side, hash) of the siblings from a leaf to the root."""
    if not 0 <= index < len(leaves):
        raise IndexError(index)
    level, out = [bytes.fromhex(x) for x in leaves], []
    while len(level) > 1:
        sibling = index ^ 1
        if sibling < len(level):
            out.append(("left" if sibling < index else "right", level[sibling].hex()))
        level = [_node(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        index //= 2
    return out


def verify(leaf_hash: str, proof: Sequence[tuple[str, str]], want: str) -> bool:
    h = bytes.fromhex(leaf_hash)
    for side, other in proof:
        o = bytes.fromhex(other)
        h = _node(o, h) if side == "left" else _node(h, o)
    return h.hex() == want


def segment_roots(facts: DataFrame, records: int = 10_000) -> DataFrame:
    """(segment, records, root): append order cut into runs of ``records`` append numbers, hashed side by side."""
    rows = facts.select(F.floor(F.col("log_seq") / records).alias("segment"), "log_seq", leaf(facts).alias("leaf"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["log_seq", "leaf"])
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "records": [len(pdf)], "root": [root(pdf["leaf"].tolist())]})

    return rows.groupBy("segment").applyInPandas(fold, "segment bigint, records bigint, root string")


def chain(roots: DataFrame) -> str:
    """One hash over all segments in order: a row a segment streams through the driver."""
    h = hashlib.sha256(b"").digest()
    for r in roots.orderBy("segment").toLocalIterator():
        h = hashlib.sha256(h + bytes.fromhex(r["root"])).digest()
    return h.hex()


def changed_segments(before: DataFrame, after: DataFrame) -> DataFrame:
    """(segment, problem): segments that are missing, new or not what they were."""
    b, a = before.select("segment", F.col("root").alias("_b")), after.select("segment", F.col("root").alias("_a"))
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return b.join(a, "segment", "full_outer").select("segment", problem.alias("problem")).where("problem is not null").orderBy("segment")


def seal(payload: Column, key: Column) -> Column:
    """AES-GCM; without the key the payload is gone. Keys have 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(payload.cast("binary"), key, F.lit("GCM")))


def unseal(sealed: Column, key: Column) -> Column:
    """The payload; null where the key is lost or wrong."""
    return F.try_aes_decrypt(F.unbase64(sealed), key, F.lit("GCM")).cast("string")
