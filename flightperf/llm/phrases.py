"""Phrase collocations from an FM-index per shard of the corpus.

Texts become words and pieces (see :func:`encoded`); each task cuts its texts into shards of about
``SHARD_BYTES`` of one language and writes, for each, an FM-index over the shard's own word ids: its
words with their counts, and the Burrows-Wheeler transform of the id sequence (0 ends a piece) whose
rows are sorted by their first ``DEPTH`` ids. Nothing longer than ``DEPTH`` words is ever asked for,
so that order is enough.

In this order the phrases of k words are intervals of rows. The LF map takes all intervals of k words
at once to those of k + 1 by their left extension; the interval of k words in which the longer one
lies is its other parent, the same phrase without its last word (:func:`levels`). So each phrase
carries its count and the phrases that it extends to the right and to the left.

Counts are summed across shards level by level, and two summaries of at most ``FILTER_BITS`` bits keep out of
the shuffle what can't become frequent:

* a phrase can only reach ``least`` if both of its parents do: the frequent phrases of k words are
  broadcast as a Bloom filter, and only phrases of k + 1 words with both parents in it are looked at;
* their counts are first added up, in all shards, in one of about as many counters as the corpus has words (a
  counter for many phrases); only phrases whose counter reaches ``least`` are reported with their words.

A shard reports them in rows of a block of phrases each, as many rows at every size; each block of a language is
summed in one pass over its rows.

Either summary can let a phrase pass that is not frequent, never the reverse, and the sums that follow are exact.

Defined cases: a null text is empty, a null language counts as ``und``; repeated documents count as
often as they occur; no length is too long (a piece longer than a shard makes a longer shard); ties
are ordered by phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightperf.llm.common import arrow_rows, share, taken, text_bytes, written

DEPTH = 4                   # words of the longest phrase
LEAST = 30                  # places that make a candidate
COVERED = 80                # percent of its places inside one longer phrase that drop a phrase
TOP = 2000                  # phrases a language
SHARD_BYTES = 3 << 20      # UTF-8 bytes of a shard
FILTER_BITS = 1 << 28       # most bits of a Bloom filter (32 MB)
BITS_EACH = 16              # bits a frequent phrase, while that makes at most FILTER_BITS
PROBES = 4

WORD, BLANK, STOP = 0, 1, 2
INDEX = "shard long, lang string, words array<string>, counts array<long>, bwt binary"


# --- words ------------------------------------------------------------------------------

def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = BLANK
    kinds[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = STOP
    return kinds


def encoded(texts: list[bytes]):
    """Texts -> (words, ids): distinct words as an Arrow array, and the sequence of ids from 1 in
    text order with one 0 after each piece. A-Z count as a-z; blanks are U+0020 and U+0009; the
    characters ``.,;:!?`` and U+000A to U+000D end a piece, as does the end of a text."""
    import pyarrow as pa
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    kind = _byte_kinds()[raw]
    inside = kind == WORD
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes()))
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int32) + 1
    # a piece ends between two words if a stop lies between them, and after the last word
    stops = np.flatnonzero(kind == STOP)
    last = np.r_[np.searchsorted(stops, starts[1:]) > np.searchsorted(stops, ends[:-1]), True]
    out = np.zeros(len(ids) + int(last.sum()), np.int32)
    out[np.arange(len(ids)) + np.r_[0, np.cumsum(last)[:-1]]] = ids
    return coded.dictionary.cast(pa.string()), out


# --- FM-index ---------------------------------------------------------------------------

def transform(ids: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Burrows-Wheeler transform of a sequence (taken as a ring), rows sorted by their first
    ``depth`` ids (a power of two): ranks of 1, 2, 4, ... ids by doubling."""
    rank, step = ids.astype(np.int64), 1
    order = np.argsort(rank) if depth == 1 else None
    while step < depth:
        pair = (rank << 32) | np.roll(rank, -step)
        order = np.argsort(pair)
        ahead = pair[order]
        place = np.cumsum(np.r_[0, ahead[1:] != ahead[:-1]])
        rank = np.empty_like(rank)
        rank[order] = place
        step *= 2
    return np.roll(ids, 1)[order]


class Level:
    """All phrases of k words of a shard: their first row, number of rows, word ids (one column a
    word), and the phrases of k - 1 words that they extend by a word on the right and on the left
    (as indexes into the level before)."""

    def __init__(self, start, count, words, without_last, without_first):
        self.start, self.count, self.words = start, count, words
        self.without_last, self.without_first = without_last, without_first


def levels(bwt: np.ndarray, n_words: int, depth: int, allowed=None):
    """The levels 1 to ``depth`` of an index, each by extending all intervals of the last one.

    ``allowed(level, k)``, if given, says which phrases of a level may be extended."""
    m = len(bwt)
    if not m:
        return
    # LF's inverse: row r comes from row back[r] (a stable sort of the transform, number in the low bits)
    back = bwt.astype(np.int64) << 32
    back |= np.arange(m)
    back.sort()
    back = back.astype(np.uint32)                       # the low half
    symbol = bwt[back]                                  # first id of each row
    # level 1: an interval a word; rows that start with 0 belong to none
    first = np.searchsorted(symbol, np.arange(1, n_words + 1))
    count = np.bincount(bwt, minlength=n_words + 1)[1:]
    here = Level(first, count, [np.arange(1, n_words + 1, dtype=np.int32)], None, None)
    yield here
    of = symbol - 1                                     # interval of each row, -1: none
    for k in range(2, depth + 1):
        if allowed is not None:
            ok = np.r_[allowed(here, k - 1), False]     # the last entry stands for "none"
            of = np.where(ok[of], of, np.int32(-1))
        # row r starts with symbol[r], then with the phrase of row back[r]
        rest = of[back]
        valid = (rest >= 0) & (of >= 0) & (symbol > 0)
        edge = np.r_[True, (symbol[1:] != symbol[:-1]) | (rest[1:] != rest[:-1])]
        starts = np.flatnonzero(edge)
        sizes = np.diff(np.r_[starts, m])
        keep = valid[starts]
        here_of = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32), sizes)
        starts, sizes = starts[keep], sizes[keep]
        head, tail, of = of[starts], rest[starts], here_of
        here = Level(starts, sizes, [symbol[starts], *(w[tail] for w in here.words)], head, tail)
        yield here


def _shards(shard_bytes: int):
    """(lang, bytes) -> index rows; a task's texts of one language fill a shard at a time."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        held, size, made = {}, {}, 0

        def index(lang):
            nonlocal made
            words, ids = encoded(held.pop(lang))
            size.pop(lang)
            if not len(ids):
                return None
            made += 1
            counts = np.bincount(ids, minlength=len(words) + 1)[1:]
            return pa.RecordBatch.from_arrays([
                pa.array([(task << 32) + made], pa.int64()), pa.array([lang], pa.string()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64())),
                pa.array([transform(ids).astype("<i4").tobytes()], pa.binary())],
                names=["shard", "lang", "words", "counts", "bwt"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("bytes")):
                text = text.as_py()
                if not text:
                    continue
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= shard_bytes:
                    row = index(lang)
                    if row is not None:
                        yield row
            # what a task holds of all languages together stays bounded as well
            while sum(size.values()) > 2 * shard_bytes:
                row = index(max(size, key=size.get))
                if row is not None:
                    yield row
        for lang in list(held):
            row = index(lang)
            if row is not None:
                yield row
    return run


def write_index(docs: DataFrame, shard_bytes: int | None = None) -> DataFrame:
    """(text, lang) documents as written FM-indexes, one row a shard."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_bytes().alias("bytes"))
    return written(texts.mapInArrow(_shards(shard_bytes or SHARD_BYTES), INDEX), "phrase-index")


# --- Bloom filters ----------------------------------------------------------------------

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _hashes(lang: str, words) -> np.ndarray:
    """64-bit hash of each word of a language."""
    import xxhash
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of each phrase from the hashes of its words."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(MIX[0])
        out ^= out >> np.uint64(29)
    return out


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bit numbers of each key, one row a probe (``bits`` is a power of two)."""
    step = (keys * np.uint64(MIX[1])) | np.uint64(1)
    return np.stack([((keys + np.uint64(i) * step) >> np.uint64(7)) & np.uint64(bits - 1) for i in range(PROBES)])


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = _slots(keys, len(bits) * 8)
    return ((bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def frequent_filter(frequent: DataFrame, most_bits: int | None = None):
    """A broadcast Bloom filter of the (lang, phrase) rows. The bits come to the driver 64 at a
    time, so at most ``most_bits`` / 64 rows, however many phrases there are."""
    n = max(1, frequent.count())
    bits = 1 << 10
    while bits < BITS_EACH * n and bits < (most_bits or FILTER_BITS):
        bits *= 2

    def run(batches):
        import pyarrow as pa
        for b in batches:
            langs, phrases = np.array(b.column("lang").to_pylist(), object), b.column("phrase").to_pylist()
            for lang in set(langs):
                mine = [phrases[i].split(" ") for i in np.flatnonzero(langs == lang)]
                keys = _joined([_hashes(lang, w) for w in zip(*mine)])
                slots = np.unique(_slots(keys, bits).ravel())
                at, bit = (slots >> np.uint64(6)).astype(np.int64), slots & np.uint64(63)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                cells = np.bitwise_or.reduceat(np.uint64(1) << bit, first)
                yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(cells.view(np.int64))], names=["at", "cell"])

    cells = frequent.select("lang", "phrase").mapInArrow(run, "at long, cell long")
    cells = cells.groupBy("at").agg(F.bit_or("cell").alias("cell")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column("at").to_numpy()] = cells.column("cell").to_numpy()
    return share(frequent.sparkSession, out.view(np.uint8))


# --- counts -----------------------------------------------------------------------------

BLOCKS = 64                 # parts that the counters, and the phrases of a language, are summed in
HELD = 200_000              # phrases of a block that are held before equal ones are added up
COUNTS = "lang string, block int, phrases array<string>, counts array<long>"


def _counter(keys: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each key (``bits`` is a power of two)."""
    return ((keys * np.uint64(MIX[1])) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _last_levels(batches, filters: list, k: int):
    """Index rows -> (lang, words, level k, keys of its phrases), with parents that may be frequent."""
    bits = [taken(f) for f in filters]
    for b in batches:
        for at in range(b.num_rows):
            lang, words = b.column("lang")[at].as_py(), b.column("words")[at].values
            hashes = np.r_[np.uint64(0), _hashes(lang, words.to_pylist())]

            def allowed(level, depth):
                return _has(bits[depth - 1], _joined([hashes[w] for w in level.words]))

            *_, last = levels(np.frombuffer(b.column("bwt")[at].as_py(), "<i4"), len(words), k, allowed)
            if len(last.count):
                yield lang, words, last, _joined([hashes[w] for w in last.words])


def _added_counts(filters: list, k: int, bits: int):
    """Index rows -> (block, at, n): the counts of a shard's phrases, by counter."""
    def run(batches):
        import pyarrow as pa
        for _, _, last, keys in _last_levels(batches, filters, k):
            at, back = np.unique(_counter(keys, bits), return_inverse=True)
            n = np.bincount(back, last.count).astype("<i8")
            block = at // (bits // BLOCKS)
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = [*first[1:], len(at)]
            yield pa.RecordBatch.from_arrays([
                pa.array(block[first], pa.int32()),
                pa.array([(at[a:z] % (bits // BLOCKS)).astype("<i4").tobytes() for a, z in zip(first, ends)], pa.binary()),
                pa.array([n[a:z].tobytes() for a, z in zip(first, ends)], pa.binary())], names=["block", "at", "n"])
    return run


def _full_counters(least: int, counters: int):
    """(block, at, n) in order of block -> (block, full): a bit for each counter that reaches ``least``."""
    def run(batches):
        import pyarrow as pa
        held, counts = None, None

        def bits():
            return pa.RecordBatch.from_arrays([
                pa.array([held], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())],
                names=["block", "full"])

        for b in batches:
            for block, at, n in zip(b.column("block").to_pylist(), b.column("at"), b.column("n")):
                if block != held:
                    if held is not None:
                        yield bits()
                    held, counts = block, np.zeros(counters, np.int64)
                counts[np.frombuffer(at.as_py(), "<i4")] += np.frombuffer(n.as_py(), "<i8")     # no counter twice
        if held is not None:
            yield bits()
    return run


def full_counters(index: DataFrame, filters: list, k: int, least: int, bits: int):
    """A broadcast bit for each of ``bits`` counters: whether the phrases of k words that share it have
    ``least`` places together. Every shard has a row for each of BLOCKS blocks; the blocks are dealt out and
    summed one at a time, and their bits (``bits`` / 8 bytes in all) come to the driver."""
    counts = index.select("lang", "words", "bwt").mapInArrow(_added_counts(filters, k, bits), "block int, at binary, n binary")
    full = (counts.repartition("block").sortWithinPartitions("block")
            .mapInArrow(_full_counters(least, bits // BLOCKS), "block int, full binary").toArrow())
    out, size = np.zeros(bits // 8, np.uint8), bits // BLOCKS // 8
    for block, cells in zip(full.column("block").to_pylist(), full.column("full").to_pylist()):
        out[block * size:(block + 1) * size] = np.frombuffer(cells, np.uint8)
    return share(index.sparkSession, out)


def _phrases(filters: list, counters, k: int, bits: int):
    """Index rows -> (lang, block, phrases, counts): the phrases of k words of a shard that may be frequent, in at
    most one row for each of BLOCKS blocks, however many they are."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        full = taken(counters)
        for lang, words, last, keys in _last_levels(batches, filters, k):
            at = _counter(keys, bits)
            keep = np.flatnonzero((full[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(keep):
                continue
            block = at[keep] // (bits // BLOCKS)
            order = np.argsort(block, kind="stable")
            keep, block = keep[order], block[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            text = pc.binary_join_element_wise(*(words.take(pa.array(w[keep] - 1)) for w in last.words), " ")
            ends = pa.array([*first, len(keep)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(first), pa.string()), pa.array(block[first], pa.int32()),
                pa.ListArray.from_arrays(ends, text), pa.ListArray.from_arrays(ends, pa.array(last.count[keep], pa.int64()))],
                names=["lang", "block", "phrases", "counts"])
    return run


def _summed(least: int):
    """(lang, block, phrases, counts) in order of lang and block -> (lang, phrase, f) of the phrases of all shards that
    have ``least`` places. Holds the distinct phrases of one block and about as many more."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        held, parts, size, limit = None, [], 0, HELD

        def added():
            sums = pa.concat_tables(parts).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
            return pa.table([sums.column("phrase"), sums.column("f_sum")], names=["phrase", "f"])

        def frequent():
            for b in added().filter(pc.field("f") >= least).to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([pa.array([held[0]] * b.num_rows, pa.string()), b.column("phrase"), b.column("f")],
                                                 names=["lang", "phrase", "f"])

        for b in batches:
            for lang, block, texts, counts in zip(b.column("lang").to_pylist(), b.column("block").to_pylist(),
                                                  b.column("phrases"), b.column("counts")):
                if (lang, block) != held:
                    if held is not None:
                        yield from frequent()
                    held, parts, size, limit = (lang, block), [], 0, HELD
                parts.append(pa.table([texts.values, counts.values], names=["phrase", "f"]))
                size += len(texts.values)
                if size > limit:
                    parts = [added()]
                    size = parts[0].num_rows
                    limit = HELD + 2 * size
        if held is not None:
            yield from frequent()
    return run


def frequent_phrases(index: DataFrame, least: int = LEAST, depth: int = DEPTH, most_bits: int | None = None):
    """(lang, phrase, k, f) of every phrase of up to ``depth`` words with at least ``least`` places, and
    (lang, n) of all words. Both are written."""
    words = index.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        "lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("count"))
    totals = written(index.select("lang", F.expr("aggregate(counts, 0L, (s, c) -> s + c)").alias("n"))
                     .groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    n = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = 1 << 10
    while bits < min(n, most_bits or FILTER_BITS):
        bits *= 2
    found, filters = None, []
    for k in range(1, depth + 1):
        with arrow_rows(index.sparkSession, 8):     # a few shards at a time
            if k == 1:
                summed = words.groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
            else:
                counts = index.select("lang", "words", "bwt").mapInArrow(
                    _phrases(filters, full_counters(index, filters, k, least, bits), k, bits), COUNTS)
                summed = (counts.repartition("lang", "block").sortWithinPartitions("lang", "block")
                          .mapInArrow(_summed(least), "lang string, phrase string, f long"))
            here = written(summed.select("lang", "phrase", F.lit(k).alias("k"), "f"), f"phrases-{k}")
        found = here if found is None else found.unionByName(here)
        if k < depth:
            filters.append(frequent_filter(here, most_bits))
    return found, totals


# --- ranking ----------------------------------------------------------------------------

def ranked(found: DataFrame, totals: DataFrame, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: phrases of two words or more by the score of their
    lowest cut, less those that one longer phrase covers."""
    word = F.split("phrase", " ")
    longer = found.where("k >= 2").select("lang", "phrase", "k", "f", word.alias("w"))

    def phrase(first, n):
        return F.array_join(F.slice("w", first, n), " ")

    # what every candidate needs to know of its parts: the two sides of each cut
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    sides = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit(True).alias("head"), phrase(F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit(False).alias("head"), phrase(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))).alias("side"))
    sides = sides.select("lang", "phrase", "a", "cut", "side.head", "side.part")
    parts = found.select("lang", F.col("phrase").alias("part"), "f")
    cut_sums = sides.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    # 2,000,000 a / (l + r) in decimals of 38 digits, whole part
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = cut_sums.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    # the most frequent longer phrase around each phrase
    around = longer.where("k >= 3").select("lang", "f", "k", "w", F.explode(F.expr("sequence(2, k - 1)")).alias("size")).select(
        "lang", "f", "w", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("first")).select(
        "lang", "f", phrase(F.col("first"), F.col("size")).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    hidden = F.col("longer").isNotNull() & (
        F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * covered)
    open_ = lowest.join(around, ["lang", "phrase"], "left").where(~hidden)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = open_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_bytes: int | None = None) -> DataFrame:
    """The collocations of every language of ``docs`` (text, lang)."""
    return ranked(*frequent_phrases(write_index(docs, shard_bytes), least), top=top)


def sql() -> str:
    """The same in SQL, from every place of every phrase."""
    places = ", ".join(f"lead(w, {i}) OVER p AS w{i}" for i in range(1, DEPTH))
    grams = "\n  UNION ALL ".join(
        "SELECT lang, {k} AS k, {text} AS phrase FROM s{cond}".format(
            k=k, text=" || ' ' || ".join(["w", *(f"w{i}" for i in range(1, k))]),
            cond=f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, DEPTH + 1))
    return f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT doc, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
numbered AS (SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
words AS (SELECT lang, piece_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM numbered),
s AS (SELECT lang, w, {places} FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY pos)),
g AS (
  {grams}),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= {LEAST}),
cut AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS pos FROM c),
sides AS (
  SELECT cut.lang, cut.phrase, a, pos, x.f AS l, y.f AS r,
    CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:pos], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[pos + 1:cut.k], ' ')),
low AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
span AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS size FROM c WHERE k >= 3),
part AS (SELECT lang, a, ws, size, unnest(range(1, k - size + 2)) AS first FROM span),
around AS (SELECT lang, array_to_string(ws[first:first + size - 1], ' ') AS phrase, max(a) AS longer FROM part GROUP BY ALL),
best AS (
  SELECT low.lang, low.phrase, low.a, l, r, score,
    row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, low.a DESC, encode(low.phrase)) AS rank
  FROM low LEFT JOIN around ON around.lang = low.lang AND around.phrase = low.phrase
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST({COVERED} AS HUGEINT) * low.a)
SELECT best.lang, rank, phrase, a, l, r, n, score FROM best JOIN n ON n.lang = best.lang WHERE rank <= {TOP}"""
