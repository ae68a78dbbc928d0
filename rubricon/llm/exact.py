"""Exact de-duplication against a minimal perfect hash of historical digests.

Texts are equal when they are identical without their white space. Every document becomes one
narrow row (id, code points, SHA-256 of the stripped text); texts never move.

``index`` turns a history into buckets. Each bucket holds a minimal perfect hash over its distinct
digests: a cascade of bit arrays in which a key owns the first position that no other key shares,
the rank of that bit being the slot. A slot keeps the full digest and the locator of the winner
(id, code points, number of rows). A perfect hash also answers for keys it never saw, so a lookup
compares the 32 digest bytes with the slot's. Members are repeats of the slot; the others are
grouped among themselves. Both sides are aggregated per digest before they move, so a text that
owns a third of all rows costs one row per task, and buckets follow a hash of the digest and grow
in number, not in size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import SPACE, id_of, shown_id, text_of
from rubricon.session import stored

BUCKET_KEYS = 65_536
_SLOTS = "bucket long, n long, sizes array<long>, bits binary, digests binary, ids binary, chars binary, counts binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, digest of every row; null text counts as empty."""
    text = text_of(text_col)
    return docs.select(
        id_of(id_col).alias("id"),
        F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.regexp_replace(text, f"[{SPACE}]+", ""), 256)).alias("digest"),
    )


def _per_digest(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest: the winner (most code points, then smallest id) and the row count."""
    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("neg"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).select(
        F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"),
        "digest",
        F.bitwise_not(F.col("best.neg")).alias("id"),
        F.col("best.n_chars").alias("n_chars"),
        "n",
    )


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """Hash of digests (rows of four words) for one level of the cascade."""
    with np.errstate(over="ignore"):
        h = words[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _words(digest_bytes: bytes) -> np.ndarray:
    return np.frombuffer(digest_bytes, dtype="<u8").reshape(-1, 4)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and one byte per position of the cascade for distinct keys."""
    sizes, levels, left, level = [], [], words, 0
    while len(left):
        size = 2 * len(left) + 1
        at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
        level += 1
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots_of(words: np.ndarray, sizes: list[int], flags: np.ndarray) -> np.ndarray:
    """Slot of every key, -1 where the cascade ends without an owner."""
    ranks = np.cumsum(flags) - 1
    out = np.full(len(words), -1, dtype=np.int64)
    todo, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        if not len(todo):
            break
        at = base + (_mixed(words[todo], level) % np.uint64(size)).astype(np.int64)
        hit = flags[at]
        out[todo[hit]] = ranks[at[hit]]
        todo, base = todo[~hit], base + size
    return out


def _build(part: pd.DataFrame) -> pd.DataFrame:
    words = _words(b"".join(part["digest"]))
    sizes, flags = build_hash(words)
    order = np.argsort(slots_of(words, sizes, flags))
    column = lambda name: part[name].to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame(
        {
            "bucket": [int(part["bucket"].iloc[0])],
            "n": [len(part)],
            "sizes": [sizes],
            "bits": [np.packbits(flags).tobytes()],
            "digests": [words[order].tobytes()],
            "ids": [column("id")],
            "chars": [column("n_chars")],
            "counts": [column("n")],
        }
    )


def index(history: DataFrame, buckets: int) -> DataFrame:
    """The perfect-hash buckets over the distinct digests of ``history`` (id, n_chars, digest)."""
    return _per_digest(history, buckets).groupBy("bucket").applyInPandas(_build, _SLOTS)


def _look_up(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Merge a bucket's new digests into its slots: one row per distinct digest of either side."""
    ids, chars, counts = (new[c].to_numpy(np.int64) for c in ("id", "n_chars", "n"))
    words = _words(b"".join(new["digest"])) if len(new) else np.zeros((0, 4), np.uint64)
    if not len(held):
        return pd.DataFrame({"digest": list(new["digest"]), "keep": ids, "size": counts, "known": False})
    row = held.iloc[0]
    n, sizes = int(row["n"]), [int(s) for s in row["sizes"]]
    flags = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
    own = _words(row["digests"])
    slot_ids, slot_chars, slot_n = (np.frombuffer(row[c], np.int64).copy() for c in ("ids", "chars", "counts"))
    slots = slots_of(words, sizes, flags)
    member = (slots >= 0) & (own[np.maximum(slots, 0)] == words).all(axis=1)
    at = slots[member]
    better = (chars[member] > slot_chars[at]) | ((chars[member] == slot_chars[at]) & (ids[member] < slot_ids[at]))
    slot_n[at] += counts[member]
    slot_ids[at[better]] = ids[member][better]
    raw = own.tobytes()
    return pd.DataFrame(
        {
            "digest": [raw[32 * i : 32 * i + 32] for i in range(n)] + list(new["digest"][~member]),
            "keep": np.concatenate([slot_ids, ids[~member]]),
            "size": np.concatenate([slot_n, counts[~member]]),
            "known": np.concatenate([np.ones(n, bool), np.zeros((~member).sum(), bool)]),
        }
    )


def merge(new: DataFrame, slots: DataFrame, buckets: int) -> DataFrame:
    """Look the new rows up in the index: digest, keep, size, known for every distinct digest.

    ``known`` tells whether the history had the digest.
    """
    cogroups = _per_digest(new, buckets).groupBy("bucket").cogroup(slots.groupBy("bucket"))
    return cogroups.applyInPandas(_look_up, "digest binary, keep long, size long, known boolean")


def exact_groups(docs: DataFrame, history_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    The rows with the lower part (``history_share``) of the id range are the history that is
    indexed; the others are looked up in it. Any split gives the same rows.

    Null text counts as empty, so null and blank texts form one group. A null id loses against any
    other of as many code points; rows that repeat an id and text are one document and share its
    verdict. An empty table gives an empty one. Other columns of ``docs`` are not read.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    total, low, high = rows.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    buckets = max(1, math.ceil(total / BUCKET_KEYS))
    cut = 0 if low is None else low + int((high - low) * history_share)
    slots = index(rows.where(F.col("id") <= cut), buckets)
    groups = merge(rows.where(F.col("id") > cut), slots, buckets)
    # Only texts that occur again need their group's row.
    several = groups.where("size > 1").select("digest", "keep", "size")
    return _shown(rows.join(several, "digest", "left"))


def _shown(joined: DataFrame) -> DataFrame:
    full = joined.withColumn("_keep", F.coalesce("keep", "id"))
    return full.select(
        shown_id("id").alias("doc_id"),
        shown_id("_keep").alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id") == F.col("_keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
