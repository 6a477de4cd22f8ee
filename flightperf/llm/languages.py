"""Language identification by interpolated Kneser-Ney character models.

A text is read as lower-cased letters with one blank for each run of other characters. Each language
has a model of up to ``ORDER`` characters:

    p(c | h) = max(n(hc) - D, 0) / n(h) + D t(h) / n(h) * p(c | h without its first character)

with counts at the highest order, numbers of different left neighbours below it, one discount D an order
and language, t(h) the different characters after h, and 1 / characters at the bottom. All models lie in
arrays of one set a level, sorted by a 64-bit hash of the characters: the finished log probability in every
language, and for contexts the weight with which they hand over to the level below. A character is looked
up once for all languages, at the longest known level.

The language with the least cross-entropy a character is chosen. Passages that no model has seen tell
how far to trust that: their own language (right), the best of the others when their own is left out, and
their letters shuffled (both to be rejected) calibrate a logistic score of the margin to the second
language, the excess over the language's usual entropy and the length. Below ``REJECT`` the text counts
as rejected. The models that answer are those of all passages, the calibrating ones included.

Learned from every labelled text, by one rule at every size: texts are cut every ``PASSAGE`` characters, equal passages
of a language count once, and all windows of ``ORDER`` characters of them are counted. The hash of a passage says whether it
calibrates (one in ``CALIBRATE``). The medians and the logistic score are found in passes over what the calibrating
passages give; only sums come to the driver. The driver and the tasks hold the distinct windows, with a number for each
language.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be
learned; texts are read whole, in segments of ``SEGMENT`` characters that each start without a context;
ties go to the first language in order; repeated rows are answered each; an empty table gives no rows;
rows without a language teach nothing; columns other than the text (and ``lang`` in training) are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import arrow_rows, per_process, share, taken, written
from flightperf.llm.linear import Logistic, sigmoid

ORDER = 5
PASSAGE = 1000              # characters
MAX_CELLS = 24_000_000      # (place, language) cells that are looked up at once
WINDOW_CHARS = 4_000_000    # characters whose windows are counted at once
BINS = 1024                 # parts that a range is cut into where a median is sought
SEGMENT = 1_000_000
CALIBRATE = 5               # one passage in so many calibrates
LENGTHS = (15, 40, 120, 400, PASSAGE)
REJECT = 0.5
UNKNOWN = "und"
MULTIPLIER = 0x9E3779B97F4A7C15
POWERS = [pow(MULTIPLIER, i, 2 ** 64) for i in range(ORDER)]
INVERSE = pow(MULTIPLIER, -1, 2 ** 64)
BLOCKS = 64                 # parts that the windows of a language are added up in
HELD = 500_000              # windows of a block that are held before equal ones are added up
COUNTS = "lang string, block int, grams binary, count binary, taught binary"


# --- characters -------------------------------------------------------------------------

def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _sequence(texts: list[str], letters: np.ndarray):
    """Texts -> (codes, at, of): one array in which each text follows ORDER - 1 zeros, the places of
    its characters, and the text that each belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = letters[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(texts)), sizes)
    before = np.r_[np.uint32(0), codes[:-1]]
    before[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = 0        # each text starts without a context
    keep = (codes != 0) | (before != 0)
    codes, of = codes[keep], of[keep]
    at = np.arange(len(codes)) + (ORDER - 1) * (of + 1)
    out = np.zeros(len(codes) + (ORDER - 1) * (len(texts) + 1), np.uint32)
    out[at] = codes
    return out, at, of


def _hash_levels(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last 1, 2, ... characters; ``columns`` are the characters from the last one back."""
    out = []
    power, key = 1, np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = key + (c.astype(np.uint64) + np.uint64(1)) * np.uint64(power)
        power = power * MULTIPLIER % 2 ** 64
        out.append(key)
    return out


def _spread(keys: np.ndarray) -> np.ndarray:
    """Mixes a hash, so that sorted arrays are evenly spread."""
    keys = keys ^ (keys >> np.uint64(31))
    return keys * np.uint64(0xBF58476D1CE4E5B9)


def _packed(rows: np.ndarray, alphabet: np.ndarray) -> np.ndarray | None:
    """Each row of code points as one number that sorts alike; None if 64 bits are too few."""
    bits = len(alphabet).bit_length()
    if bits * rows.shape[1] > 64:
        return None
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out = (out << np.uint64(bits)) | np.searchsorted(alphabet, column).astype(np.uint64)
    return out


def _unique_rows(rows: np.ndarray):
    """Distinct rows in order, and the place of each row among them."""
    packed = _packed(rows, np.unique(rows))
    if packed is None:
        distinct, back = np.unique(rows, axis=0, return_inverse=True)
        return distinct, back.ravel()
    _, first, back = np.unique(packed, return_index=True, return_inverse=True)
    return rows[first], back.ravel()


# --- model ------------------------------------------------------------------------------

class CharModels:
    """The models of all languages: for each level sorted hashes with log probabilities, and sorted hashes of
    the contexts with the log weights with which they hand over (one column a language)."""

    def __init__(self, languages: list[str], grams: np.ndarray, counts: np.ndarray):
        """``grams``: distinct windows of ORDER code points, one row each; ``counts``: one column a language."""
        self.languages = languages
        n_lang = len(languages)
        self.keys, self.logp, self.contexts, self.logw = [], [], [], []
        self.heads, self.context_heads = [], []
        # distinct grams of each level with its counts: raw at the top, left neighbours below
        tables = [None] * (ORDER + 1)
        tables[ORDER] = (grams, counts.astype(np.float64))
        for n in range(ORDER - 1, 0, -1):
            upper, c = tables[n + 1]
            lower, back = _unique_rows(upper[:, 1:])
            left = np.zeros((len(lower), n_lang))
            np.add.at(left, back, c > 0)
            tables[n] = (lower, left)
        self.order = ORDER
        floor = 1.0 / (len(tables[1][0]) + 1)
        self.unseen = np.full(n_lang, np.log(floor))
        below = None
        for n in range(1, ORDER + 1):
            g, c = tables[n]
            ones, twos = (c == 1).sum(0), (c == 2).sum(0)
            cut = np.where((ones > 0) & (twos > 0), ones / np.maximum(ones + 2.0 * twos, 1), 0.75)
            if n == 1:
                contexts, of = g[:1, :0], np.zeros(len(g), np.int64)
            else:
                contexts, of = _unique_rows(g[:, :-1])
            total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            weight = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
            if n == 1:
                rest = np.full((len(g), n_lang), floor)
            else:
                rest = np.exp(below[self._find(self.keys[-1], self.heads[-1], self._hash(g[:, 1:]))[0]])
            p = np.maximum(c - cut, 0) / np.maximum(total, 1)[of] + weight[of] * rest
            keys = self._hash(g)
            order = np.argsort(keys)
            if n == 1:
                self.start = np.log(weight[0]).astype(np.float32)
            else:
                held = self._hash(contexts)
                by_hash = np.argsort(held)
                self.contexts.append(held[by_hash])
                self.context_heads.append(self._heads(self.contexts[-1]))
                self.logw.append(np.log(weight[by_hash]).astype(np.float32))
            self.keys.append(keys[order])
            self.heads.append(self._heads(self.keys[-1]))
            below = np.log(p)[order]
            self.logp.append(below.astype(np.float32))

    @staticmethod
    def _hash(g: np.ndarray) -> np.ndarray:
        return _spread(_hash_levels([g[:, i] for i in range(g.shape[1] - 1, -1, -1)])[-1])

    @staticmethod
    def _heads(keys: np.ndarray) -> np.ndarray:
        """Place of the first of the sorted keys that starts with each number of a few bits (about four numbers a key)."""
        bits = max(1, len(keys).bit_length() + 1)
        return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)

    @staticmethod
    def _find(keys: np.ndarray, heads: np.ndarray, wanted: np.ndarray):
        at = heads[wanted >> np.uint64(65 - len(heads).bit_length())]
        np.minimum(at, len(keys) - 1, out=at)
        todo = np.flatnonzero(keys[at] < wanted)
        while len(todo):        # a few keys share their first bits
            todo = todo[at[todo] < len(keys) - 1]
            at[todo] += 1
            todo = todo[keys[at[todo]] < wanted[todo]]
        return at, keys[at] == wanted

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the character at each place (in ascending order) in every language."""
        step = max(1, MAX_CELLS // len(self.languages))
        if len(at) > step:
            parts = (at[i:i + step] for i in range(0, len(at), step))
            return np.concatenate([self.log_probabilities(codes[x[0] - ORDER + 1:x[-1] + 1], x - x[0] + ORDER - 1) for x in parts])
        # the hash of the ORDER characters up to each place; a level below has one term less
        plain = codes.astype(np.uint64) + np.uint64(1)
        key = plain[ORDER - 1:].copy()
        for i in range(1, ORDER):
            key += plain[ORDER - 1 - i:len(plain) - i] * np.uint64(POWERS[i])
        key = key[at - (ORDER - 1)]
        place, known = self._find(self.keys[-1], self.heads[-1], _spread(key))
        out = np.take(self.logp[-1], place, axis=0)
        todo = np.flatnonzero(~known)
        out[todo] = 0
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                place, known = self._find(self.keys[n - 1], self.heads[n - 1], _spread(key))
                out[todo[known]] += self.logp[n - 1][place[known]]
                todo, key = todo[~known], key[~known]
            else:
                key = key[todo]
            if not len(todo):
                return out
            if n > 1:       # the context (the characters but the last) hands over, where it is known
                before = (key - plain[at[todo]]) * np.uint64(INVERSE)
                place, known = self._find(self.contexts[n - 2], self.context_heads[n - 2], _spread(before))
                out[todo[known]] += self.logw[n - 2][place[known]]
                key -= plain[at[todo] - (n - 1)] * np.uint64(POWERS[n - 1])
            else:
                out[todo] += self.start + self.unseen
        return out

    def entropies(self, texts: list[str], letters: np.ndarray):
        """(characters, nats a character in each language) of whole texts."""
        n = np.zeros(len(texts), np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        parts, owner, size = [], [], 0

        def flush():
            nonlocal parts, owner, size
            if parts:
                codes, at, of = _sequence(parts, letters)
                if len(at):
                    lp = self.log_probabilities(codes, at)
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    own = np.array(owner)[of[first]]
                    np.add.at(total, own, np.add.reduceat(lp, first, axis=0, dtype=np.float64))
                    np.add.at(n, own, np.diff(np.r_[first, len(of)]))
            parts, owner, size = [], [], 0

        for i, text in enumerate(texts):
            for cut in range(0, len(text or ""), SEGMENT):
                part = text[cut:cut + SEGMENT]
                parts.append(part)
                owner.append(i)
                size += len(part)
                if size >= SEGMENT:
                    flush()
        flush()
        return n, -total / np.maximum(n, 1)[:, None]


class Identifier:
    """Models with their calibration."""

    def __init__(self, models: CharModels | None, usual=None, spread=None, trust: Logistic | None = None):
        self.models, self.usual, self.spread, self.trust = models, usual, spread, trust

    def features(self, n: np.ndarray, h: np.ndarray):
        """(chosen language, features of the choice) from entropies; a language may be left out by an
        infinite entropy."""
        chosen = h.argmin(1)
        rows = np.arange(len(h))
        best = h[rows, chosen]
        others = h.copy()
        others[rows, chosen] = np.inf
        second = others.min(1) if h.shape[1] > 1 else best
        margin = np.where(np.isfinite(second), second - best, 0.0)
        excess = (best - self.usual[chosen]) / self.spread[chosen]
        length = np.log1p(n)
        return chosen, np.column_stack([margin, margin * length, excess, excess * length, length])

    def answers(self, texts: list[str | None], letters: np.ndarray):
        """Per text: language, score."""
        if self.models is None or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        n, h = self.models.entropies(texts, letters)
        chosen, x = self.features(n, h)
        score = sigmoid(self.trust.logit(x)) if self.trust is not None else np.full(len(n), 0.5)
        return ([self.models.languages[c] if k else UNKNOWN for c, k in zip(chosen, n)], np.where(n > 0, score, 0.0))


# --- training ---------------------------------------------------------------------------

def _passages(calibrating: bool):
    """(lang, text) -> all passages (lang, passage, part), or those that calibrate (``part`` 0). Passages are
    compressed, as they are shuffled next."""
    def run(batches):
        import zlib

        import pyarrow as pa
        import xxhash
        for b in batches:
            for lang, cell in zip(b.column("lang").to_pylist(), b.column("text")):
                text = cell.as_py()
                rows = []
                for cut in range(0, len(text), PASSAGE):
                    passage = text[cut:cut + PASSAGE]
                    raw = passage.encode("utf-8", "surrogatepass")
                    h = xxhash.xxh64_intdigest(raw)
                    part = int(xxhash.xxh64_intdigest(h.to_bytes(8, "little")) % CALIBRATE)
                    if part == 0 or not calibrating:
                        rows.append((lang, zlib.compress(raw, 1), part))
                if rows:
                    lang_, passage_, part_ = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(lang_, pa.string()), pa.array(passage_, pa.binary()),
                                                      pa.array(part_, pa.int32())], names=["lang", "passage", "part"])
    return run


def _unpacked(passage: bytes) -> str:
    import zlib
    return zlib.decompress(passage).decode("utf-8", "surrogatepass")


def _distinct_windows(codes: np.ndarray, at: np.ndarray, marked: np.ndarray):
    """Distinct windows that end at these places, in order, one row of big-endian code points each; their places, and
    those of them that are marked."""
    alphabet = np.flatnonzero(np.bincount(codes))
    bits = len(alphabet).bit_length()
    if bits * ORDER > 63:
        grams = np.stack([codes[at - i] for i in range(ORDER - 1, -1, -1)], axis=1).astype(">u4")
        distinct, back, count = np.unique(_cells(grams), return_inverse=True, return_counts=True)
        return _rows(distinct.tobytes()), count, np.bincount(back, marked, len(distinct)).astype(np.int64)
    # a window is one number, with its mark in the last bit
    number = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    number[alphabet] = np.arange(len(alphabet))
    ids = number[codes]
    packed = ids[ORDER - 1:].copy()
    for i in range(1, ORDER):
        packed |= ids[ORDER - 1 - i:len(ids) - i] << np.uint64(bits * i)
    packed = (packed[at - (ORDER - 1)] << np.uint64(1)) | marked.astype(np.uint64)
    found, n = np.unique(packed, return_counts=True)
    whole = found >> np.uint64(1)
    first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
    count, taught = np.add.reduceat(n, first), np.add.reduceat(np.where(found & np.uint64(1), n, 0), first)
    low, distinct = np.uint64((1 << bits) - 1), whole[first]
    return np.stack([alphabet[(distinct >> np.uint64(bits * i)) & low] for i in range(ORDER - 1, -1, -1)], axis=1).astype(">u4"), count, taught


def _cells(grams: np.ndarray) -> np.ndarray:
    """Rows of big-endian code points as one value each, which sorts as the row does."""
    return np.ascontiguousarray(grams).view(f"S{4 * ORDER}").ravel()


def _rows(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").reshape(-1, ORDER)


def _windows(batches):
    """(lang, passage, part) -> (lang, block, grams, count, taught): windows of ORDER code points in order, with their places
    in all passages and in those that don't calibrate; a row for each block of windows."""
    import pyarrow as pa
    letters = per_process("letters", _letters)
    held, size = {}, {}

    def counted(lang):
        texts, teach = zip(*held.pop(lang))
        size.pop(lang)
        codes, at, of = _sequence(texts, letters)
        if len(at):
            grams, count, taught = _distinct_windows(codes, at, np.array(teach)[of])
            # windows with the same beginning stay together
            block = _spread(_hash_levels([grams[:, 0], grams[:, 1], grams[:, 2]])[-1]) >> np.uint64(32)
            block = (block % np.uint64(BLOCKS)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            grams, count, taught, block = grams[order], count[order].astype("<i8"), taught[order].astype("<i8"), block[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            cuts = list(zip(first, [*first[1:], len(block)]))
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(first), pa.string()), pa.array(block[first]),
                *(pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for x in (grams, count, taught))],
                names=["lang", "block", "grams", "count", "taught"])

    for b in batches:
        for lang, text, part in zip(b.column("lang").to_pylist(), b.column("passage").to_pylist(), b.column("part").to_pylist()):
            text = _unpacked(text)
            held.setdefault(lang, []).append((text, part > 0))
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= WINDOW_CHARS:
                yield from counted(lang)
        while sum(size.values()) > 4 * WINDOW_CHARS:
            yield from counted(max(size, key=size.get))
    for lang in list(held):
        yield from counted(lang)


def _added(batches):
    """(lang, block, grams, count, taught) in order of lang and block -> a row for each lang and block."""
    import pyarrow as pa
    held, parts, size, limit = None, [], 0, HELD

    def added():
        grams, count, taught = (np.concatenate(x) for x in zip(*parts))
        distinct, back = np.unique(grams, return_inverse=True)
        sums = [np.zeros(len(distinct), np.int64) for _ in range(2)]
        np.add.at(sums[0], back, count)
        np.add.at(sums[1], back, taught)
        return distinct, *sums

    def row():
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int32()),
                                           *(pa.array([x.tobytes()], pa.binary()) for x in added())],
                                          names=["lang", "block", "grams", "count", "taught"])

    for b in batches:
        for lang, block, *raw in zip(b.column("lang").to_pylist(), b.column("block").to_pylist(),
                                     *(b.column(c).to_pylist() for c in ("grams", "count", "taught"))):
            if (lang, block) != held:
                if held is not None:
                    yield row()
                held, parts, size, limit = (lang, block), [], 0, HELD
            parts.append((_cells(_rows(raw[0])), np.frombuffer(raw[1], "<i8"), np.frombuffer(raw[2], "<i8")))
            size += len(parts[-1][1])
            if size > limit:
                parts = [added()]
                size = len(parts[0][1])
                limit = HELD + 2 * size
    if held is not None:
        yield row()


ENTROPIES = "own int, kind int, n long, e double, h array<double>"


def _entropy_rows(shared):
    """Calibration passages, cut at every one of LENGTHS and with their letters shuffled ->
    (own, kind, n, e, h): the number of their language, kind 0 as they are, 1 shuffled, the entropy in
    their language and in all."""
    def run(batches):
        import zlib

        import pyarrow as pa
        models = taken(shared)
        letters = per_process("letters", _letters)
        number = {lang: i for i, lang in enumerate(models.languages)}
        for b in batches:
            owns, texts, kinds = [], [], []
            for lang, passage in zip(b.column("lang").to_pylist(), b.column("passage").to_pylist()):
                if lang not in number:
                    continue
                passage = _unpacked(passage)
                rng = np.random.default_rng(zlib.crc32(passage.encode("utf-8", "surrogatepass")))
                for size in LENGTHS:
                    if size < len(passage) or size == LENGTHS[-1]:
                        texts += [passage[:size], "".join(rng.permutation(list(passage[:size])))]
                        owns += [number[lang]] * 2
                        kinds += [0, 1]
            n, h = models.entropies(texts, letters)
            seen = np.flatnonzero(n > 0)
            own, h = np.array(owns, np.int32)[seen], h[seen]
            yield pa.RecordBatch.from_arrays([
                pa.array(own), pa.array(np.array(kinds, np.int32)[seen]), pa.array(n[seen]), pa.array(h[np.arange(len(h)), own]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))],
                names=["own", "kind", "n", "e", "h"])
    return run


def train(docs: DataFrame, rows: Column | None = None) -> Identifier:
    """An identifier from the text and ``lang`` of the rows of ``docs`` that ``rows`` selects."""
    spark = docs.sparkSession
    known = docs.where(rows) if rows is not None else docs
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL AND text <> ''")

    def passages(calibrating):
        return known.mapInArrow(_passages(calibrating), "lang string, passage binary, part int").distinct()

    # (the distinct windows of each language)
    grams = (passages(False).mapInArrow(_windows, COUNTS).repartition("lang", "block").sortWithinPartitions("lang", "block")
             .mapInArrow(_added, COUNTS).toArrow())
    if not grams.num_rows:
        return Identifier(None)
    taught, models = _models(grams, "taught"), _models(grams, "count")
    if taught is None:
        return Identifier(models, *_usual(models, {}), None)
    seen = written(passages(True).select("lang", "passage").mapInArrow(_entropy_rows(share(spark, taught)), ENTROPIES),
                   "language-entropies")
    with arrow_rows(spark, 10_000):
        return _calibrated(taught.languages, models, seen)


def _models(blocks, counted: str) -> CharModels | None:
    """Models of the windows (in blocks) with a count in this column."""
    grams, counts, langs = [], [], []
    for lang, raw, count in zip(*(blocks.column(c).to_pylist() for c in ("lang", "grams", counted))):
        count = np.frombuffer(count, "<i8")
        if count.any():
            grams.append(_rows(raw)[count > 0].astype(np.uint32))
            counts.append(count[count > 0])
            langs.append(lang)
    if not langs:
        return None
    languages, column = np.unique(np.array(langs, object), return_inverse=True)
    distinct, back = _unique_rows(np.concatenate(grams))
    out = np.zeros((len(distinct), len(languages)))
    out[back, np.repeat(column, [len(c) for c in counts])] = np.concatenate(counts)
    return CharModels(languages.tolist(), distinct, out)


def _usual(models: CharModels, known: dict):
    """Usual entropy and its spread of each language; the median of the others where not known."""
    middle = np.median(list(known.values()), axis=0) if known else np.array([3.0, 1.0])
    return np.array([known.get(x, middle) for x in models.languages]).T


def _medians(seen: DataFrame, n_lang: int, centre: np.ndarray | None = None) -> dict:
    """Number of a language -> exact median of e (of its distance from ``centre``) of its rows of kind 0. The range
    that holds the median is cut into BINS parts, pass by pass; counts and bounds of the parts come to the driver."""
    plain = seen.where("kind = 0").select("own", "e")

    def parts(low, width):
        def run(batches):
            import pyarrow as pa
            for b in batches:
                own, e = b.column("own").to_numpy(), b.column("e").to_numpy()
                if centre is not None:
                    e = np.abs(e - centre[own])
                inside = (e >= low[own]) & (e <= low[own] + width[own]) if width is not None else np.ones(len(e), bool)
                own, e = own[inside].astype(np.int64), e[inside]
                part = own * BINS
                if width is not None:
                    part += np.minimum((e - low[own]) / width[own] * BINS, BINS - 1).astype(np.int64)
                order = np.lexsort((e, part))
                part, e = part[order], e[order]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][:len(part)])
                last = np.r_[first[1:], len(part)][:len(first)]
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array((last - first).astype(np.int64)),
                                                  pa.array(e[first]), pa.array(e[last - 1])], names=["part", "n", "low", "high"])

        found = plain.mapInArrow(run, "part long, n long, low double, high double").groupBy("part").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("part").toArrow()
        return [found.column(c).to_numpy() for c in ("part", "n", "low", "high")]

    part, count, low, high = parts(None, None)
    # a language's open range, and the two ranks within it whose values the median lies between
    state = {int(p // BINS): (lo, hi, int((n - 1) // 2), int(n // 2)) for p, n, lo, hi in zip(part, count, low, high)}
    medians = {}
    while state:
        for i, (lo, hi, *_) in list(state.items()):
            if lo == hi:
                medians[i] = lo
                del state[i]
        if not state:
            break
        start, width = np.full(n_lang, np.inf), np.ones(n_lang)
        for i, (lo, hi, *_) in state.items():
            start[i], width[i] = lo, np.nextafter(hi - lo, np.inf)
        part, count, low, high = parts(start, width)
        for i, (_, _, a, z) in list(state.items()):
            mine = np.flatnonzero(part // BINS == i)
            ends = np.cumsum(count[mine])
            x, y = mine[np.searchsorted(ends, a, side="right")], mine[np.searchsorted(ends, z, side="right")]
            if x == y:
                before = int(ends[mine == x][0] - count[x])
                state[i] = (low[x], high[x], a - before, z - before)
            else:
                medians[i] = (high[x] + low[y]) / 2
                del state[i]
    return medians


def _examples(identifier: Identifier, own: np.ndarray, kind: np.ndarray, n: np.ndarray, h: np.ndarray):
    """Features and truth of passages as they are, with their letters shuffled, and as if their own language weren't there."""
    plain, mixed = kind == 0, kind == 1
    chosen, x = identifier.features(n[plain], h[plain])
    xs, ys = [x, identifier.features(n[mixed], h[mixed])[1]], [chosen == own[plain], np.zeros(mixed.sum(), bool)]
    if h.shape[1] > 1:
        without = h[plain].copy()
        without[np.arange(len(without)), own[plain]] = np.inf
        xs.append(identifier.features(n[plain], without)[1])
        ys.append(np.zeros(len(without), bool))
    return np.concatenate(xs), np.concatenate(ys).astype(float)


def _summed(seen: DataFrame, identifier: Identifier):
    """A function that adds up an array of the examples of a batch over all rows (a row a task comes to the driver)."""
    n_lang = len(identifier.usual)

    def total(job):
        def run(batches):
            import pyarrow as pa
            sums = None
            for b in batches:
                if b.num_rows:
                    h = b.column("h").flatten().to_numpy().reshape(-1, n_lang)
                    part = job(*_examples(identifier, *(b.column(c).to_numpy() for c in ("own", "kind", "n")), h))
                    sums = part if sums is None else sums + part
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<f8").tobytes()], pa.binary())], names=["sums"])
        found = seen.mapInArrow(run, "sums binary").toArrow()
        return sum(np.frombuffer(x, "<f8") for x in found.column("sums").to_pylist())
    return total


def _calibrated(languages: list[str], models: CharModels, seen: DataFrame) -> Identifier:
    """``models`` with the calibration of models of ``languages`` on passages that those haven't seen."""
    middle = _medians(seen, len(languages))
    if not middle:
        return Identifier(models, *_usual(models, {}), None)
    spread = _medians(seen, len(languages), np.array([middle.get(i, 0.0) for i in range(len(languages))]))
    known = {languages[i]: (m, max(1e-3, 1.4826 * spread[i])) for i, m in middle.items()}
    usual = np.array([known.get(x, np.median(list(known.values()), axis=0)) for x in languages]).T
    trust = Logistic().fit_sums(_summed(seen, Identifier(None, *usual)))
    return Identifier(models, *_usual(models, known), trust)


# --- identification ---------------------------------------------------------------------

def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, lang_pred, score and ``rejected`` of every row."""
    shared = share(docs.sparkSession, identifier)

    def run(batches):
        import pyarrow as pa
        known = taken(shared)
        letters = per_process("letters", _letters)
        for b in batches:
            langs, score = known.answers(b.column("text").to_pylist(), letters)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(score < REJECT)], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
