"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words. The labels say toxic of whole documents, so tokens of the training sample are
labelled first: a word is toxic inside toxic documents if it is far more frequent in toxic than
in clean documents (``RATIO`` times the rate, with ``MIN_EVIDENCE`` against chance); near copies
count once, by two smallest hashes of their runs of three words. The field has two tags; a token's state
score sums weights of its own word, the word before and the word after (words of two sampled
documents at least; all others share one slot), and tags have transition weights. It is trained by AdaGrad on the exact likelihood.

Forward-backward gives each token's marginal. A chain is worked in windows of ``CORE`` tokens with
``MARGIN`` tokens of context on both sides, so any text length takes bounded memory. A document's
score is a logistic function of its largest marginal, its expected toxic words, and its mean word
weight under a word-frequency model, calibrated on documents that did not teach the field; spans are runs of tokens above ``SPAN_FROM``.

The fit reads a bounded sample, ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled rows by a
hash of doc_id, weighted back to the labels' shares. A sampled text of more than ``MAX_WORDS`` words
teaches by ``PASSAGES`` passages spread over it and chosen by hash, about ``MAX_WORDS`` words; its
expected toxic words are scaled to its length for the calibration. Every document is scored whole.

Defined cases: null and empty texts have no token and the score of an untoxic text without words;
null labels are ignored, several labels of one doc_id are toxic if any is; without labels of both
classes every score is the smoothed share of toxic labels; repeated rows are scored each; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import per_process, share, small_batches, taken, text_bytes
from flightperf.llm.linear import Logistic, sigmoid
from flightperf.llm.licenses import words_of

MAX_TOXIC = 2500
MAX_CLEAN = 2500
MAX_WORDS = 10_000             # longer documents teach by passages: the sample's size stays bounded
PASSAGES = 20
RATIO = 6.0
MIN_EVIDENCE = 12.0           # nats; about one in 160,000 by chance
CORE, MARGIN = 512, 32
TRAIN_CORE = 64
EPOCHS = 3
BATCH_WINDOWS = 4096
RATE, L2 = 0.3, 1e-4
BATCH_TOKENS = 1_000_000
CACHE_WORDS = 500_000
CACHE_LETTERS = 48
SPAN_FROM = 0.5
PARTS = 4                      # of the sample, for the calibration
TOXIC_FROM = 0.3

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


# --- words -------------------------------------------------------------------------

EDGE, OTHER = 0, 1               # slots of a text's edge and of words the sample doesn't hold


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Slots(dict):
    """word (bytes) -> its slot in a sorted table of word hashes; OTHER if it isn't there."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        i = int(np.searchsorted(self.table, h))
        slot = i + 2 if i < len(self.table) and self.table[i] == h else OTHER
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(word) <= CACHE_LETTERS:
            self[word] = slot
        return slot

    def of(self, raw: bytes) -> np.ndarray:
        words = words_of(raw)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def passages(words: list[bytes], most: int | None = None, n: int = PASSAGES) -> list[bytes]:
    """``words``, or of more than ``most`` (default ``MAX_WORDS``) the ``n`` passages of ``most / n`` words
    that have the smallest hash in each of ``n`` equal stretches of the text."""
    most = MAX_WORDS if most is None else most
    if len(words) <= most:
        return words
    size = most // n
    pieces = [words[at:at + size] for at in range(0, len(words), size)]
    cuts = [len(pieces) * k // n for k in range(n + 1)]
    return [w for a, b in zip(cuts, cuts[1:])
            for w in min(pieces[a:b], key=lambda p: xxhash.xxh64_digest(b" ".join(p), seed=5))]


def windows(lengths: np.ndarray, core: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with these many tokens, laid out one after the other: (first token, core start, core
    end, last token) of every window, the text of each window and its number in the text."""
    ends = np.cumsum(lengths)
    n = -(-lengths // core)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    base = ends - lengths
    start = base[text] + k * core
    end = np.minimum(start + core, ends[text])
    first = np.maximum(start - margin, base[text])
    last = np.minimum(end + margin, ends[text])
    return np.column_stack([first, start, end, last]), text, k


# --- the field ---------------------------------------------------------------------

class Field:
    """Weights of the tag 1 against 0: ``state`` (own, before, after; each by slot), a bias and transitions."""

    def __init__(self, slots: int):
        self.slots = slots
        self.state = np.zeros((3, slots), dtype=np.float64)
        self.bias = -3.0
        self.trans = np.zeros((2, 2))

    def emission(self, own, before, after) -> np.ndarray:
        return self.bias + self.state[0][own] + self.state[1][before] + self.state[2][after]

    def marginals(self, e: np.ndarray, mask: np.ndarray):
        """P(tag 1) of padded chains (steps, chains), then the messages it came from.

        Messages are kept as the odds of tag 1 against tag 0, so each step is a few products."""
        steps, chains = e.shape
        t = np.exp(self.trans)
        odds = np.exp(np.clip(e, -30, 30))
        fwd = np.empty_like(e)
        fwd[0] = odds[0]
        for i in range(1, steps):
            f = fwd[i - 1]
            fwd[i] = (t[0, 1] + t[1, 1] * f) / (t[0, 0] + t[1, 0] * f) * odds[i]
        bwd = np.empty_like(e)
        bwd[-1] = 1.0
        for i in range(steps - 2, -1, -1):
            b = np.where(mask[i + 1], odds[i + 1] * bwd[i + 1], 0.0)
            step = (t[1, 0] + t[1, 1] * b) / (t[0, 0] + t[0, 1] * b)
            bwd[i] = np.where(mask[i + 1], step, 1.0)
        both = fwd * bwd
        return both / (1 + both), fwd, bwd, odds, t

    def pair_counts(self, fwd, bwd, odds, t, mask) -> np.ndarray:
        """Expected transitions over all chains."""
        a = fwd[:-1] / (1 + fwd[:-1])
        nxt = odds[1:] * bwd[1:]
        w00, w01 = (1 - a) * t[0, 0], (1 - a) * t[0, 1] * nxt
        w10, w11 = a * t[1, 0], a * t[1, 1] * nxt
        z = w00 + w01 + w10 + w11
        m = mask[1:]
        return np.array([[(x / z)[m].sum() for x in pair] for pair in ((w00, w01), (w10, w11))])

    def fit(self, texts: list[np.ndarray], tags: list[np.ndarray], epochs: int = EPOCHS) -> "Field":
        lengths = np.array([len(x) for x in texts])
        if not lengths.sum():
            return self
        own, y = np.concatenate(texts), np.concatenate(tags).astype(np.float64)
        before, after = neighbours(own, lengths)
        spans, _, _ = windows(lengths, TRAIN_CORE, 0)
        order = np.random.default_rng(7)
        seen = [np.full_like(self.state, 1e-3), np.full((2, 2), 1e-3), 1e-3]
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(spans)), -(-len(spans) // BATCH_WINDOWS)):
                at, mask = padded(spans[part], TRAIN_CORE)
                o, b, a = own[at], before[at], after[at]
                p, fwd, bwd, odds, t = self.marginals(self.emission(o, b, a), mask)
                tag = y[at]
                miss = np.where(mask, p - tag, 0.0)
                pairs = self.pair_counts(fwd, bwd, odds, t, mask)
                m = mask[1:]
                real = np.array([[((tag[:-1] == i) & (tag[1:] == j) & m).sum() for j in (0, 1)] for i in (0, 1)])
                for k, slots in enumerate((o, b, a)):
                    g = np.bincount(slots[mask], weights=miss[mask], minlength=self.slots) + L2 * self.state[k]
                    seen[0][k] += g * g
                    self.state[k] -= RATE * g / np.sqrt(seen[0][k])
                g = (pairs - real) + L2 * self.trans
                seen[1] += g * g
                self.trans -= RATE * g / np.sqrt(seen[1])
                g = miss.sum()
                seen[2] += g * g
                self.bias -= RATE * g / np.sqrt(seen[2])
        return self


def neighbours(own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots before and after each token; 0 beyond the edge of a text."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(lengths)
    full = lengths > 0
    before[(ends - lengths)[full]] = 0
    after[ends[full] - 1] = 0
    return before, after


def padded(spans: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, chains) token places of windows [first, last) and which of them are real."""
    first, last = spans[:, 0], spans[:, 3]
    steps = np.arange(min(width, int((last - first).max())))[:, None]
    mask = steps < (last - first)[None, :]
    return np.where(mask, first[None, :] + steps, first[None, :]), mask


# --- training ----------------------------------------------------------------------

def copy_mark(words: np.ndarray) -> int:
    """What near copies share: the two smallest hashes, by two functions, of runs of three words (hashes)."""
    if not len(words):
        return -1
    w = np.concatenate([words, [0, 0]]).astype(np.uint64)
    runs = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
    mark = 0
    for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = (runs ^ (runs >> np.uint64(32))) * np.uint64(k)
        mark = mark * 0x1000193 + int((h ^ (h >> np.uint64(29))).min())
    return mark % (1 << 63)


class ToxicModel:
    """The field, the words' weights and the calibrated document score."""

    def __init__(self, texts: list[np.ndarray], toxic: np.ndarray, n_toxic: int, n_clean: int, lengths: np.ndarray | None = None):
        """``texts``: word hashes of sampled documents (or of their passages); ``toxic``: their labels;
        n: labelled rows in all; ``lengths``: words of the whole documents (default: of ``texts``)."""
        scale = np.ones(len(texts)) if lengths is None else lengths / np.maximum(1, [len(x) for x in texts])
        seen, times = np.unique(np.concatenate([np.unique(x) for x in texts] or [np.zeros(0, np.int64)]), return_counts=True)
        self.table = seen[times > 1]
        self.slots = len(self.table) + 2
        marks = np.array([copy_mark(x) for x in texts], dtype=np.int64)
        texts = [self._slots(x) for x in texts]
        self.share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        self.usable = bool(len(texts)) and 0 < toxic.sum() < len(toxic)
        if not self.usable:
            return
        facts, y, part = [], [], np.arange(len(texts)) % PARTS
        for k in range(PARTS):                              # each part is judged by what the others taught
            if len(np.unique(toxic[part == k])) == len(np.unique(toxic[part != k])) == 2:
                self.teach([x for x, p in zip(texts, part) if p != k], toxic[part != k], marks[part != k])
                own = [x for x, p in zip(texts, part) if p == k]
                facts += [self.facts(own[i:i + 256], scale[part == k][i:i + 256])[0] for i in range(0, len(own), 256)]
                y.append(toxic[part == k])
        self.teach(texts, toxic, marks)
        if not facts:                                       # too few rows to part
            facts, y = [self.facts(texts, scale)[0]], [toxic]
        y = np.concatenate(y).astype(np.float64)
        weight = np.where(y == 1, n_toxic / max(1, y.sum()), n_clean / max(1, (1 - y).sum()))
        self.calibration = Logistic(1.0).fit(np.concatenate(facts), y, weight * len(y) / weight.sum())

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.table):
            return np.full(len(hashes), OTHER, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        return np.where(self.table[at] == hashes, at + 2, OTHER).astype(np.int32)

    def teach(self, texts: list[np.ndarray], toxic: np.ndarray, mark: np.ndarray) -> None:
        """Label the tokens, weigh the words and fit the field; texts of the same ``mark`` count once."""
        words = [np.unique(x) for x in texts]
        counts = np.zeros((2, self.slots))
        groups = [0, 0]
        for y in (0, 1):
            rows = np.flatnonzero(toxic == y)
            pairs = [np.column_stack([np.full(len(words[i]), mark[i]), words[i]]) for i in rows]
            pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            counts[y] = np.bincount(pairs[:, 1].astype(np.int64), minlength=self.slots)
            groups[y] = len(np.unique(mark[rows]))
        rate = (counts + 0.5) / (np.array(groups)[:, None] + 1.0)
        # by how much a word's toxic share exceeds that of all documents, as evidence in nats
        n, base = np.maximum(counts.sum(axis=0), 1), groups[1] / max(1, sum(groups))
        share = np.clip(counts[1] / n, 1e-9, 1 - 1e-9)
        evidence = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
        self.toxic_slots = (evidence >= MIN_EVIDENCE) & (share > base) & (rate[1] >= RATIO * rate[0])
        self.word_weight = np.log(rate[1] / rate[0])
        self.word_weight[counts.sum(axis=0) < 8] = 0.0
        self.word_weight[self.toxic_slots] = 0.0            # the field tells of those
        self.word_weight[EDGE], self.toxic_slots[[EDGE, OTHER]] = 0.0, False
        self.field = Field(self.slots).fit(texts, [self.toxic_slots[x] & bool(y) for x, y in zip(texts, toxic)])

    def facts(self, texts: list[np.ndarray], scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per document the largest marginal, the expected toxic words (times ``scale``, for passages of a
        longer document) and the mean word weight; and the marginals of all tokens, one text after the other."""
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        out = np.zeros((len(texts), 5))
        marg = np.zeros(int(lengths.sum()))
        if len(marg):
            own = np.concatenate(texts)
            before, after = neighbours(own, lengths)
            e = self.field.emission(own, before, after)
            spans, text, _ = windows(lengths, CORE, MARGIN)
            for part in np.array_split(np.argsort(spans[:, 0] - spans[:, 3], kind="stable"), -(-len(spans) // 1024)):
                at, mask = padded(spans[part], CORE + 2 * MARGIN)
                p = self.field.marginals(e[at], mask)[0]
                core = mask & (at >= spans[part, 1]) & (at < spans[part, 2])
                marg[at[core]] = p[core]
            full = np.flatnonzero(lengths)
            cuts = (np.cumsum(lengths) - lengths)[full]
            top = np.maximum.reduceat(marg, cuts)
            out[full, 0] = top
            out[full, 1] = np.clip(np.log(top / np.maximum(1 - top, 1e-12) + 1e-12), -12, 12)
            out[full, 2] = np.log1p(np.add.reduceat(marg, cuts) * (1.0 if scale is None else scale[full]))
            out[full, 3] = np.add.reduceat(self.word_weight[own], cuts) / lengths[full]
        out[lengths == 0, 1] = -12
        out[:, 4] = lengths == 0
        return out, marg

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents, and the marginals of all their tokens."""
        if not self.usable:
            return np.full(len(texts), self.share), np.zeros(sum(map(len, texts)))
        facts, marg = self.facts(texts)
        return sigmoid(self.calibration.logit(facts)), marg


def spans_of(raw: bytes, marg: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets [first, end) of runs of tokens with a marginal of SPAN_FROM or more."""
    hot = np.flatnonzero(marg >= SPAN_FROM)
    if not len(hot):
        return []
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    out: list[list[int]] = []
    last = -2
    for i in hot.tolist():
        if i == last + 1:
            out[-1][1] = places[i][1]
        else:
            out.append(list(places[i]))
        last = i
    points, at, chars = [], 0, 0
    for first, end in out:                                  # bytes to code points, along the text once
        chars += len(raw[at:first].decode("utf-8", "replace"))
        size = len(raw[first:end].decode("utf-8", "replace"))
        points.append((chars, chars + size))
        chars, at = chars + size, end
    return points


def train(docs: DataFrame, labels: DataFrame, fold=None, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``fold``: a condition on the
    column doc_id that says which labels may be learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(fold) if fold is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label"))
         .agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    share = F.when(F.col("label") > 0, F.lit(min(1 << 30, (1 << 30) * max_toxic // max(1, n.get(1, 0))))).otherwise(
        F.lit(min(1 << 30, (1 << 30) * max_clean // max(1, n.get(0, 0)))))
    some = known.where(place < share).select("doc_id", (F.col("label") > 0).cast("int").alias("label"))

    most = MAX_WORDS

    def run(batches):
        for b in small_batches(batches):
            texts = [words_of(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([[word_hash(w) for w in passages(t, most)] for t in texts], pa.list_(pa.int64()))],
                names=["label", "n_words", "words"])

    # the sample: about max_toxic + max_clean rows, two numbers each on the broadcast side
    rows = (docs.select(F.col("doc_id").cast("long"), text_bytes().alias("bytes")).join(F.broadcast(some), "doc_id")
            .select("label", "bytes").mapInArrow(run, "label int, n_words long, words array<bigint>").toArrow())
    texts = [np.array(x.values.to_numpy(), dtype=np.int64) for x in rows.column("words")]
    toxic = np.array(rows.column("label").to_pylist(), dtype=np.int64)
    order = sorted(range(len(texts)), key=lambda i: (toxic[i], xxhash.xxh64_digest(texts[i].tobytes())))
    lengths = rows.column("n_words").to_numpy()
    return ToxicModel([texts[i] for i in order], toxic[order], n.get(1, 0), n.get(0, 0), lengths[order])


def scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, predicted, spans (code-point offsets) of every row."""
    shared = share(docs.sparkSession, model)      # the sample's words
    held = f"toxicity_{xxhash.xxh64_hexdigest(model.table.tobytes())}"
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        model = taken(shared)
        table = per_process(held, lambda: Slots(model.table))

        def done(ids, raws, texts):
            score, marg = model.score(texts)
            cut = np.cumsum([0, *map(len, texts)])
            spans = [spans_of(r, marg[s:e]) for r, s, e in zip(raws, cut, cut[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(score), pa.array((score >= TOXIC_FROM).astype(np.int32)),
                 pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], span)],
                names=["doc_id", "score", "predicted", "spans"])

        ids, raws, texts, n = [], [], [], 0
        for b in small_batches(batches):
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                ids.append(doc_id)
                raws.append(raw)
                texts.append(table.of(raw))
                n += len(texts[-1])
                if n >= BATCH_TOKENS or len(ids) >= 8192:
                    yield done(ids, raws, texts)
                    ids, raws, texts, n = [], [], [], 0
        if ids:
            yield done(ids, raws, texts)

    return (docs.select(F.col("doc_id").cast("long"), text_bytes().alias("bytes"))
            .mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<first:bigint,end:bigint>>"))
