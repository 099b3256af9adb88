"""Exact deduplication with an index of cuckoo filters.

The index holds the digests of the texts that live in it.  It is sharded by digest; a
shard is one row: a cuckoo filter, the stored digests the filter's slots point to,
and, for each digest, the row that stands for it and the number of copies.  Inserting,
deleting and looking up are joins of changes with shards, so work and memory per task
are bounded by the size of a shard, and shards are as many as the digests need.

A filter slot holds a 16-bit fingerprint.  A hit is verified against the digests stored
in the two buckets that can hold it.  When an insertion finds no place, the filter is
rebuilt with twice the buckets from the stored digests, so nothing is ever lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, col, only, prepared, written

SLOTS = 4
MAX_KICKS = 200
DIGEST_BYTES = 32
SHARD_ROWS = 20_000
MIN_SHARDS = 256
PRE_AGGREGATES = 16

STATE = "shard int, fingerprints binary, pointers binary, digests binary, refs binary, copies binary, live binary"
CHANGE = "op int, digest binary, doc_id bigint, rid bigint, n bigint, shard int"


class CuckooShard:
    """Cuckoo filter over stored digests; each digest has a reference ``(has id, id, row)`` and a count."""

    def __init__(self, buckets: int = 64):
        self.digests: list[bytes] = []
        self.refs: list[tuple[int, int, int]] = []
        self.copies: list[int] = []
        self.live: list[bool] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.fingerprints = [0] * (buckets * SLOTS)  # 0 is an empty slot
        self.pointers = [-1] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        # the shard number uses the first four bytes; these must not repeat it
        fingerprint = int.from_bytes(digest[12:14], "little") or 1
        first = int.from_bytes(digest[4:12], "little") % self.buckets
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        # buckets is a power of two, so this is its own inverse
        return bucket ^ (fingerprint * 0x5BD1E995 & (self.buckets - 1))

    def slot_of(self, digest: bytes) -> int:
        """Slot of a live digest, -1 if there is none: filter hit, then comparison with the stored digest."""
        fingerprint, *both = self._places(digest)
        for bucket in both:
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.fingerprints[slot] == fingerprint and self.digests[self.pointers[slot]] == digest:
                    return slot
        return -1

    def _place(self, digest: bytes, pointer: int) -> bool:
        fingerprint, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingerprints[slot]:
                    self.fingerprints[slot], self.pointers[slot] = fingerprint, pointer
                    return True
        bucket = first
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            self.fingerprints[slot], fingerprint = fingerprint, self.fingerprints[slot]
            self.pointers[slot], pointer = pointer, self.pointers[slot]
            bucket = self._other(bucket, fingerprint)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingerprints[slot]:
                    self.fingerprints[slot], self.pointers[slot] = fingerprint, pointer
                    return True
        return False

    def _resize(self) -> None:
        keys = [i for i, alive in enumerate(self.live) if alive]
        buckets = self.buckets * 2
        while True:
            self._clear(buckets)
            if all(self._place(self.digests[i], i) for i in keys):
                return
            buckets *= 2

    def insert(self, digest: bytes, ref: tuple[int, int, int], n: int) -> None:
        slot = self.slot_of(digest)
        if slot >= 0:
            at = self.pointers[slot]
            self.copies[at] += n
            self.refs[at] = max(self.refs[at], ref)
            return
        self.digests.append(digest)
        self.refs.append(ref)
        self.copies.append(n)
        self.live.append(True)
        if not self._place(digest, len(self.digests) - 1):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        slot = self.slot_of(digest)
        if slot < 0:
            return False
        self.live[self.pointers[slot]] = False
        self.fingerprints[slot], self.pointers[slot] = 0, -1
        return True

    def compact(self) -> None:
        """Forget the digests that were deleted."""
        keys = [i for i, alive in enumerate(self.live) if alive]
        if len(keys) < len(self.live):
            place = {old: new for new, old in enumerate(keys)}
            self.pointers = [place.get(p, -1) for p in self.pointers]
            for name in ("digests", "refs", "copies", "live"):
                values = getattr(self, name)
                setattr(self, name, [values[i] for i in keys])

    def to_row(self, shard: int) -> dict:
        return {
            "shard": shard,
            "fingerprints": np.array(self.fingerprints, "<u2").tobytes(),
            "pointers": np.array(self.pointers, "<i4").tobytes(),
            "digests": b"".join(self.digests),
            "refs": np.array(self.refs, "<i8").tobytes(),
            "copies": np.array(self.copies, "<i8").tobytes(),
            "live": np.array(self.live, bool).tobytes(),
        }

    @classmethod
    def from_row(cls, row) -> CuckooShard:
        self = cls()
        self.fingerprints = np.frombuffer(row.fingerprints, "<u2").tolist()
        self.pointers = np.frombuffer(row.pointers, "<i4").tolist()
        self.buckets = len(self.pointers) // SLOTS
        self.digests = [row.digests[i:i + DIGEST_BYTES] for i in range(0, len(row.digests), DIGEST_BYTES)]
        self.refs = [tuple(r) for r in np.frombuffer(row.refs, "<i8").reshape(-1, 3).tolist()]
        self.copies = np.frombuffer(row.copies, "<i8").tolist()
        self.live = np.frombuffer(row.live, bool).tolist()
        return self


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table ``doc_id, rid, digest``: one row per document, ``rid`` tells repeated rows apart."""
    normal = ascii_lower(F.coalesce(col(text_col), F.lit("")))
    rows = only(docs, [id_col, text_col]).select(
        col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
    )
    return written(rows, "digests")


def _sharded(changes: DataFrame, shards: int) -> DataFrame:
    head = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint")
    return changes.withColumn("shard", F.pmod(head, F.lit(shards)).cast("int"))


def shards_for(rows: int) -> int:
    """Shards hold about ``SHARD_ROWS`` digests each, whatever the input."""
    return max(MIN_SHARDS, ceil(rows / SHARD_ROWS))


def insertions(digests: DataFrame, shards: int) -> DataFrame:
    """Changes that insert the rows of ``text_digests``.

    Copies are counted per digest and one of ``PRE_AGGREGATES`` salts before they reach
    their shard, so a text that a third of all rows share arrives as a few changes.
    """
    salted = digests.groupBy("digest", F.pmod("rid", F.lit(PRE_AGGREGATES)).alias("_salt")).agg(
        F.max(F.struct("doc_id", "rid")).alias("ref"), F.count("*").alias("n"))
    changes = salted.select(F.lit(1).alias("op"), "digest", "ref.doc_id", "ref.rid", "n")
    return _sharded(changes, shards)


def deletions(digests: DataFrame, shards: int) -> DataFrame:
    """Changes that delete digests from the index."""
    keys = digests.select("digest").distinct()
    changes = keys.select(F.lit(0).alias("op"), "digest", F.lit(None).cast("bigint").alias("doc_id"),
                          F.lit(0).cast("bigint").alias("rid"), F.lit(0).cast("bigint").alias("n"))
    return _sharded(changes, shards)


def _apply(shard: CuckooShard, changes: pd.DataFrame) -> None:
    for op, digest, doc_id, rid, n in zip(
        changes["op"], changes["digest"], changes["doc_id"], changes["rid"], changes["n"]
    ):
        if op:
            ref = (0, 0, int(rid)) if pd.isna(doc_id) else (1, int(doc_id), int(rid))
            shard.insert(bytes(digest), ref, int(n))
        else:
            shard.delete(bytes(digest))


def _new_shard(key, changes: pd.DataFrame) -> pd.DataFrame:
    shard = CuckooShard()
    _apply(shard, changes)
    shard.compact()
    return pd.DataFrame([shard.to_row(int(key[0]))])


def _next_shard(key, state: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    shard = CuckooShard.from_row(next(state.itertuples())) if len(state) else CuckooShard()
    _apply(shard, changes)
    shard.compact()
    return pd.DataFrame([shard.to_row(int(key[0]))])


def build_index(changes: DataFrame) -> DataFrame:
    """A new index from insertions: one row per shard, written."""
    prepared(changes.sparkSession)
    return written(_exact_ids(changes).groupBy("shard").applyInPandas(_new_shard, STATE), "cuckoo")


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after insertions and deletions that were made for the same number of shards."""
    prepared(changes.sparkSession)
    stepped = index.groupBy("shard").cogroup(_exact_ids(changes).groupBy("shard")).applyInPandas(_next_shard, STATE)
    return written(stepped, "cuckoo")


def _exact_ids(changes: DataFrame) -> DataFrame:
    """Ids as text, for pandas would turn a column of bigints with nulls into doubles."""
    return changes.withColumn("doc_id", F.col("doc_id").cast("string"))


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            shard = CuckooShard.from_row(row)
            found = [shard.slot_of(d) for d in shard.digests]
            yield pd.DataFrame({
                "digest": [d for d, s in zip(shard.digests, found) if s >= 0],
                "keep_id": pd.array([r[1] if r[0] else None for r, s in zip(shard.refs, found) if s >= 0], "Int64"),
                "keep_rid": [r[2] for r, s in zip(shard.refs, found) if s >= 0],
                "group_size": [n for n, s in zip(shard.copies, found) if s >= 0],
            })


def entries(index: DataFrame) -> DataFrame:
    """What lives in the index: ``digest, keep_id, keep_rid, group_size``."""
    return index.mapInPandas(_entries, "digest binary, keep_id bigint, keep_rid bigint, group_size bigint")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal
    texts the row with the largest id stays; ids that are null come last, and of repeated
    rows with that id exactly one stays.  An empty table gives no rows.  Other columns of
    ``docs`` are not looked at.
    """
    digests = text_digests(docs, id_col, text_col)
    index = build_index(insertions(digests, shards_for(digests.count())))
    return (
        digests.join(entries(index), "digest")
        .select(
            "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
