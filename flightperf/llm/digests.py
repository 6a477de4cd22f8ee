"""Improbable-feature digests of documents.

Every 64-byte window of a text has a byte entropy. Its rank is the probability of that entropy
under a fixed bell curve of ordinary prose (``TYPICAL_BITS``, ``SPREAD_BITS``): the lower, the
rarer. In every run of ``NEIGHBOURS`` windows the rarest one (the first of equals) gets a vote;
windows with ``MIN_VOTES`` votes or more are the features. Windows of nearly one byte value
(under ``LEAST_BITS``) are never chosen. Features go, in text order and without repeats of the
last one, into a chain of 2048-bit Bloom filters, 5 bits each, ``PER_FILTER`` features a filter.

Likeness of two digests: each filter of the shorter chain takes its best match in the other
chain: shared bits above those expected by chance, over the most that could be shared, 0 to 1;
the mean over the chain, weighted by the filters' features. Equal digests have likeness 1.

Defined cases: a null text counts as empty; an empty text has an empty chain, like only to
another empty chain; a text without any chosen window (short or monotone) has its distinct
8-byte windows as features; repeated rows are each other's next document and have likeness 1; a table of one row
is its own next document; null ids come first; extra columns are ignored. Windows are worked
through in pieces of ``PIECE`` bytes, so a very long text needs bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import small_batches, text_bytes

WINDOW = 64
NEIGHBOURS = 64
MIN_VOTES = 16
TYPICAL_BITS = 3.74
SPREAD_BITS = 0.25
LEAST_BITS = 1.0
FILTER_BITS = 2048
HASHES = 5
PER_FILTER = 160
SHORT = 8
PIECE = 1 << 20
NEVER = 1 << 20

# c * log2(c) for the counts a window can hold, in fixed point: sums are exact wherever a piece starts
_UNIT = 1 << 20
_CLOGC = np.array([0] + [round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1)], dtype=np.int64)
_LEVELS = 1000                                          # of entropy, from 0 to log2(WINDOW) bits


def _rank_table() -> np.ndarray:
    bits = np.arange(_LEVELS + 1) * math.log2(WINDOW) / _LEVELS
    ranks = np.round(1000 * np.exp(-0.5 * ((bits - TYPICAL_BITS) / SPREAD_BITS) ** 2)).astype(np.int64)
    ranks[bits < LEAST_BITS] = NEVER
    return ranks


_RANKS = _rank_table()


def window_entropy(data: np.ndarray) -> np.ndarray:
    """Byte entropy of every 64-byte window of ``data`` (uint8, 64 bytes at least), in bits times _UNIT.

    Moving a window by one byte drops one count and raises another, so only the number of equal
    bytes among the 63 before (after) a byte is needed, read from sorted occurrence lists.
    """
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + WINDOW) + order
    rank = np.arange(n)
    before = rank - np.searchsorted(key, key - (WINDOW - 1))
    # a byte with ``before`` earlier ones in reach is in reach of each of those
    after = np.cumsum(np.bincount(rank - before, minlength=n) - 1)
    seen, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    seen[order], left[order] = before, after
    step = np.diff(_CLOGC)
    first = int(_CLOGC[np.bincount(data[:WINDOW], minlength=256)].sum())
    total = np.empty(n - WINDOW + 1, dtype=np.int64)
    total[0] = first
    total[1:] = first + np.cumsum(step[seen[WINDOW:]] - step[left[:n - WINDOW]])
    return int(math.log2(WINDOW)) * _UNIT - total // WINDOW


def feature_places(data: np.ndarray) -> np.ndarray:
    """Starts of the chosen windows of ``data`` (uint8), ascending."""
    n = len(data) - WINDOW + 1
    if n < NEIGHBOURS:
        return np.zeros(0, dtype=np.int64)
    found = []
    carry_votes = np.zeros(0, dtype=np.int64)           # votes for windows that the next piece goes on with
    for at in range(0, n - NEIGHBOURS + 1, PIECE):
        # runs that start in this piece, and the windows they hold
        runs = min(PIECE, n - NEIGHBOURS + 1 - at)
        windows = runs + NEIGHBOURS - 1
        bits = window_entropy(data[at:at + windows + WINDOW - 1])
        ranks = _RANKS[bits * _LEVELS // (int(math.log2(WINDOW)) * _UNIT)]
        low = (ranks << 32) | np.arange(windows)
        for s in (1, 2, 4, 8, 16, 32):                  # least of 2, 4, ... 64 windows
            low = np.minimum(low[:-s], low[s:])
        votes = np.bincount(low & 0xFFFFFFFF, minlength=windows)
        votes[:len(carry_votes)] += carry_votes
        done = windows if at + PIECE > n - NEIGHBOURS else runs
        carry_votes = votes[done:]
        found.append(at + np.flatnonzero((votes[:done] >= MIN_VOTES) & (ranks[:done] < NEVER)))
    return np.concatenate(found)


class Digest:
    """A chain of Bloom filters: ``bits`` (filters, 256 bytes) and the features in each."""

    def __init__(self, hashes: list[int]):
        hashes = [h for i, h in enumerate(hashes) if not i or h != hashes[i - 1]]
        n = -(-len(hashes) // PER_FILTER)
        self.counts = np.array([min(PER_FILTER, len(hashes) - i * PER_FILTER) for i in range(n)], dtype=np.int64)
        flat = np.zeros((n, FILTER_BITS), dtype=np.uint8)
        h = np.array(hashes, dtype=np.uint64)
        row = np.arange(len(hashes)) // PER_FILTER
        for i in range(HASHES):
            flat[row, ((h >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        self.bits = np.packbits(flat, axis=1)
        self.ones = flat.sum(axis=1, dtype=np.int64)

    def __str__(self) -> str:
        return f"{len(self.counts)}:{','.join(map(str, self.counts))}:{base64.b64encode(self.bits.tobytes()).decode()}"


def likeness(x: Digest, y: Digest) -> float:
    if len(x.counts) > len(y.counts):
        x, y = y, x
    if not len(x.counts):
        return 1.0 if not len(y.counts) else 0.0
    if len(x.counts) == len(y.counts) and np.array_equal(x.bits, y.bits):
        return 1.0
    total = 0.0
    yw = y.bits.view(np.uint64)
    for bits, ones, count in zip(x.bits.view(np.uint64), x.ones, x.counts):
        shared = np.bitwise_count(yw & bits).sum(axis=1, dtype=np.int64)
        expected = ones * y.ones / FILTER_BITS
        most = np.minimum(ones, y.ones)
        chance = expected + 2 * np.sqrt(expected * (1 - np.maximum(ones, y.ones) / FILTER_BITS))
        best = ((shared - chance) / np.maximum(most - chance, 1e-9))[most > chance]
        total += count * min(1.0, max(0.0, best.max() if len(best) else 0.0))
    return float(total / x.counts.sum())


def _hashes(raw: bytes, places) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if not len(places):
        return [digest(x) for x in dict.fromkeys(raw[i:i + SHORT] for i in range(max(1, len(raw) - SHORT + 1)))] if raw else []
    return [digest(raw[p:p + WINDOW]) for p in places.tolist()]


def digest_of(raw: bytes) -> tuple[Digest, np.ndarray]:
    """The digest of a text's bytes, and its feature places."""
    places = feature_places(np.frombuffer(raw, np.uint8))
    return Digest(_hashes(raw, places)), places


def digest_after_edit(raw: bytes, same: int, places: np.ndarray) -> Digest:
    """The digest of ``raw``, whose first ``same`` bytes are those of a text with feature ``places``.

    A window's votes depend on the windows within NEIGHBOURS of it, so places well before the
    change are taken over and the rest is worked out anew."""
    settled = same - WINDOW - NEIGHBOURS + 1            # windows before this one see only unchanged bytes
    start = settled - NEIGHBOURS + 1
    if start <= 0 or len(raw) - start - WINDOW + 1 < NEIGHBOURS:
        return digest_of(raw)[0]
    again = feature_places(np.frombuffer(raw, np.uint8, offset=start)) + start
    return Digest(_hashes(raw, np.concatenate([places[places < settled], again[again >= settled]])))


# --- next documents ----------------------------------------------------------------

def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, ...) with ``bucket`` and ``ahead``: ranges of doc_id in ascending order; the
    first rows of each range come a second time, marked ahead, in the range before (round the end).

    The driver sees one row a range, no more."""
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n)).first()[0] if n > 1 else None
    bounds = np.array(sorted(set(bounds or [])), dtype=np.int64)

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        return pa.array(_bucket(ids, bounds))

    placed = rows.withColumn("bucket", bucket_of("doc_id"))
    firsts = {r["bucket"]: r["low"] for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("low")).collect()}
    used = sorted(firsts)
    low = np.full(len(bounds) + 2, np.iinfo(np.int64).min)
    low[used] = [np.iinfo(np.int64).min if firsts[k] is None else firsts[k] for k in used]
    before = np.zeros(len(bounds) + 2, dtype=np.int32)
    before[used] = [used[-1], *used[:-1]] if used else []

    @F.arrow_udf("int")
    def ahead_in(ids: pa.Array) -> pa.Array:
        """The range that a first row of a range is looked at from; null for other rows."""
        own = _bucket(ids, bounds)
        first = ids.is_null().to_numpy(zero_copy_only=False) | (_numbers(ids) == low[own])
        return pa.array(before[own], mask=~first)

    spots = F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")),
                    F.when(F.col("again").isNotNull(), F.struct(F.col("again").alias("bucket"), F.lit(True).alias("ahead"))))
    spread = placed.withColumn("again", ahead_in("doc_id")).withColumn("spot", F.explode(F.filter(spots, lambda x: x.isNotNull())))
    return spread.select(*rows.columns, "spot.bucket", "spot.ahead")


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(0).to_numpy(zero_copy_only=False)


def _bucket(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """0 for null ids, else 1 + the number of bounds below the id."""
    out = 1 + np.searchsorted(bounds, _numbers(ids)).astype(np.int32)
    out[ids.is_null().to_numpy(zero_copy_only=False)] = 0
    return out


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _rows(batches):
    """(doc_id, bytes, bucket, ahead), sorted -> result rows."""
    def load(doc_id, raw):
        return (doc_id, raw.decode("utf-8", "replace"), raw, *digest_of(raw))

    def result(cur, nxt):
        doc_id, text, raw, own, places = cur
        k = len(text) // 4
        kept = text[:len(text) - k].encode()
        edited = kept + nxt[1][:k].encode()
        other = own if edited == raw else digest_after_edit(edited, len(kept), places)
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), str(own), str(other),
                likeness(own, other), likeness(own, nxt[3]))

    cur, at = None, None
    for b in small_batches(batches):
        out = []
        for doc_id, raw, bucket, ahead in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(),
                                              b.column(3).to_pylist()):
            if ahead and (cur is None or at != bucket):
                continue                                # a further first row of the next range
            row = load(doc_id, raw.as_py())
            if cur is not None:
                out.append(result(cur, row))
            cur, at = (None, bucket) if ahead else (row, bucket)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=[x.split()[0] for x in SCHEMA.split(", ")])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per row: its digest, the digest of its edited text, both likenesses."""
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("bytes"))
    n = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _bucketed(rows, n).repartition("bucket")
    return placed.sortWithinPartitions("bucket", "ahead", "doc_id", "bytes").mapInArrow(_rows, SCHEMA)
