"""Language identification with a linear-chain conditional random field over words.

Each word of a document gets a language label. A word's emission score sums learned
weights of its affixes, character n-grams and the word itself (lexicon feature), hashed
to a fixed table; transitions between labels of neighbouring words are learned too, so
that code-switched text gets a label for each stretch. Forward-backward gives every
word's posterior; a document's language is the label with the greatest mean posterior,
which is its score.

Training uses a bounded sample: at most ``sample_docs`` ids, and of those at most twice as
many rows, chosen so that languages come out about equally often; at most ``sample_words``
words of each, in segments from all over the text, are drawn where the row is and reach the
driver. The ``MAX_LABELS`` most frequent languages are learned; the more there are, the
smaller the table of features, so the weights have a bound, and no array of training or
prediction has more numbers than words at hand times labels. Very long texts are read in
blocks. Segments of different
languages are spliced, because single documents never show a switch. Prediction reads every
whole text.

Defined cases: a word is a run of letters and their marks, and a longer one than
``WORD_CHARS`` counts as several; a null text or one without a letter is ``und`` with score 0;
of equal posteriors the label that sorts first wins; rows without a language or with a null
text aren't trained on; without any label to learn every text is ``und``; repeated rows are
predicted alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 1200
SAMPLE_WORDS = 400
#: Labels that are learned, and weights in the table of features, at most.
MAX_LABELS, WEIGHTS = 1024, 1 << 23
BUCKETS = 1 << 17
#: Characters of a word; longer runs of letters are cut.
WORD_CHARS = 24
CACHE_WORDS = 500_000
#: Numbers in one array of forward-backward: words times labels.
CHUNK = 1_600_000
#: The same for one text, beyond which it is read in blocks; labels whose products of matrices
#: are worth their memory; and numbers in a worker's cache of scores.
LONG, FEW_LABELS, CACHED = 8 * CHUNK, 16, 1 << 24
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (WORD_CHARS - 1))
#: The same for texts below U+0250, where its classes are a short list of ranges.
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{1,%d}" % WORD_CHARS)
_BEYOND = re.compile("[^\x00-\u024f]")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_WORD if _BEYOND.search(text) else _LATIN).findall(text)


def buckets_for(labels: int) -> int:
    """Feature buckets, a power of two, so that the weights stay within their bound."""
    n = BUCKETS
    while n * labels > WEIGHTS and n > 1024:
        n //= 2
    return n


def features(words: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Feature buckets of each word, one row a word, padded with the last bucket: the word
    itself, prefixes and suffixes of 1 to 3 characters, and n-grams of 2 and 3."""
    n = len(words)
    grid = np.zeros((n, WORD_CHARS + 2), dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    rows = np.repeat(np.arange(n), sizes)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    grid[rows, cols] = flat
    grid[:, 0] = 1  # edges of a word are characters too
    grid[np.arange(n), sizes + 1] = 2
    mix = np.uint64(0x9E3779B97F4A7C15)

    def slot(kind: int, *chars: np.ndarray) -> np.ndarray:
        h = np.full(chars[0].shape, kind + 1, dtype=np.uint64) * mix
        for c in chars:
            h = (h ^ c) * mix
            h ^= h >> np.uint64(29)
        return (h % np.uint64(buckets)).astype(np.int64)

    parts = [slot(0, np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.uint64, count=n))[:, None]]
    two = slot(1, grid[:, :-1], grid[:, 1:])
    three = slot(2, grid[:, :-2], grid[:, 1:-1], grid[:, 2:])
    two[np.arange(two.shape[1])[None, :] > sizes[:, None]] = buckets
    three[np.arange(three.shape[1])[None, :] >= sizes[:, None]] = buckets
    # Affixes of three characters; those of one and two are n-grams with an edge.
    at = np.arange(n)
    pre = slot(3, *(grid[at, np.minimum(k, sizes + 1)] for k in (1, 2, 3)))
    suf = slot(4, *(grid[at, np.maximum(sizes + 1 - k, 0)] for k in (1, 2, 3)))
    return np.concatenate([*parts, two, three, pre[:, None], suf[:, None]], axis=1)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (buckets + 1, labels); the last row pads
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.labels)), dtype=np.float32)
        step = max(64, min(20_000, CHUNK // 4 // max(1, len(self.labels))))
        for k in range(0, len(words), step):
            part = words[k : k + step]
            out[k : k + len(part)] = self.weights[features(part, len(self.weights) - 1)].sum(axis=1)
        return out


def messages(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of all sequences side by side, scaled emissions and transitions.
    No array has more numbers than words times labels."""
    k = scores.shape[1]
    offsets = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    offsets, by_size = offsets[order], sizes[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(transitions).astype(np.float64)
    longest = int(by_size[0]) if len(by_size) else 0
    live = np.searchsorted(-by_size, -np.arange(1, longest + 1), side="right")  # sequences of at least so many words
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = None
    for step in range(longest):
        at = offsets[: live[step]] + step
        a = (np.exp(start) if step == 0 else a[: live[step]] @ t) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.empty((0, k))
    for step in range(longest - 1, 0, -1):
        n = live[step]
        if len(b) < n:
            b = np.concatenate([b, np.ones((n - len(b), k))])
        at = offsets[:n] + step
        b = (e[at] * b) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[at - 1] = b
    return alpha, beta, e, t


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each word's label, and the expected number of each pair of neighbouring labels.
    The pairs are one product of matrices, scaled by each border's sum."""
    alpha, beta, e, t = messages(scores, sizes, transitions, start)
    inner = np.ones(len(e), dtype=bool)
    inner[np.cumsum(sizes)[sizes > 0] - 1] = False
    i = np.flatnonzero(inner)
    after = e[i + 1] * beta[i + 1]
    total = ((alpha[i] @ t) * after).sum(axis=1, keepdims=True)
    return _unit(alpha * beta), t * ((alpha[i] / total).T @ after)


def long_posteriors(score_of, n: int, transitions: np.ndarray, start: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Posteriors of one sequence of ``n`` words, in blocks from the last to the first; ``score_of``
    gives the scores of words lo .. hi - 1. Only the messages into each block are kept, and
    within a block they are made again, so memory holds a block and n / block messages."""
    t = np.exp(transitions).astype(np.float64)

    def emissions(lo: int) -> np.ndarray:
        x = score_of(lo, min(lo + block, n))
        return np.exp(x - x.max(axis=1, keepdims=True)).astype(np.float64)

    def forward(e: np.ndarray, a: np.ndarray) -> np.ndarray:
        out = np.empty_like(e)
        for k in range(len(e)):
            a = _unit(a * e[k])
            out[k] = a
            a = a @ t
        return out

    enter = [np.exp(start).astype(np.float64)]
    for lo in range(0, n - block, block):
        enter.append(forward(emissions(lo), enter[-1])[-1] @ t)
    b = np.ones(len(start))
    for lo in range((len(enter) - 1) * block, -1, -block):
        e = emissions(lo)
        alpha = forward(e, enter[lo // block])
        for k in range(len(e) - 1, -1, -1):
            alpha[k] *= b
            b = _unit((e[k] * b) @ t.T)
        yield _unit(alpha)


def forward_backward_posterior(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = 256) -> np.ndarray:
    """As forward_backward, without the pairs, and with few steps for long sequences: one
    is cut into blocks, the product of a block's step matrices carries the messages
    across it, and all blocks of all sequences run side by side. It is exact."""
    k = scores.shape[1]
    if k > FEW_LABELS:
        alpha, beta, _, _ = messages(scores, sizes, transitions, start)
        return _unit(alpha * beta)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    t, first = np.exp(transitions).astype(np.float64), np.exp(start).astype(np.float64)
    # Blocks: rows (begin, length), in order; begins of sequences are marked.
    counts = np.maximum(1, -(-sizes // block))
    offsets = np.cumsum(sizes) - sizes
    seq = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(len(seq)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[seq] + inside * block
    length = np.minimum(block, sizes[seq] - inside * block)
    order = np.argsort(-length, kind="stable")
    at, size = begin[order], length[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    # Products of step matrices within each block: m[b] maps the message before the block.
    m = np.broadcast_to(np.eye(k), (len(at), k, k)).copy()
    heads = inside[order] == 0
    for step in range(longest):
        n = live[step]
        if step == 0:
            w = np.where(heads[:, None, None], np.eye(k)[None], t[None]) * e[at][:, None, :]
            m = w
        else:
            m[:n] = (m[:n].reshape(-1, k) @ t).reshape(n, k, k) * e[at[:n] + step][:, None, :]
        m[:n] /= m[:n].sum(axis=(1, 2), keepdims=True)
    # Messages across blocks of one sequence, block by block.
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    enter = np.empty((len(at), k))
    leave = np.ones((len(at), k))
    most = int(counts.max()) if len(counts) else 0
    starts = np.cumsum(counts) - counts
    for j in range(most):
        s = starts[counts > j] + j
        enter[place[s]] = first if j == 0 else _unit(np.einsum("bi,bij->bj", enter[place[s - 1]], m[place[s - 1]]))
    for j in range(most - 2, -1, -1):
        s = starts[counts > j + 1] + j
        leave[place[s]] = _unit(np.einsum("bij,bj->bi", m[place[s + 1]], leave[place[s + 1]]))
    alpha, posterior = np.empty_like(e), np.empty_like(e)
    a = enter
    for step in range(longest):
        n = live[step]
        if step == 0:
            a = np.where(heads[:, None], enter, enter @ t) * e[at]
        else:
            a = (a[:n] @ t) * e[at[:n] + step]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at[:n] + step] = a
    b = np.empty((0, k))
    for step in range(longest - 1, -1, -1):
        n = live[step]
        if len(b) < n:
            b = np.concatenate([b, leave[len(b) : n]])
        rows = at[:n] + step
        posterior[rows] = alpha[rows] * b
        b = (e[rows] * b) @ t.T
        b /= b.sum(axis=1, keepdims=True)
    return _unit(posterior)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def drawn_words(text: str | None, seed: int, most: int = SAMPLE_WORDS) -> list[str]:
    """At most so many words of a text, in segments from all over it."""
    words = words_of(text)
    if len(words) <= most:
        return words
    rng = np.random.default_rng(seed)
    starts = np.sort(rng.choice(len(words) - 20, max(1, most // 20), replace=False)).tolist()
    return [w for s in starts for w in words[s : s + 20]][:most]


def fit(samples: list[list[str]], langs: list[str], epochs: int = 3, batch: int = 128, rate: float = 0.15, seed: int = 1) -> Crf:
    """Stochastic gradient (Adagrad) on the conditional log-likelihood of spliced segments of
    the samples' words."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    k = len(labels)
    code = {x: i for i, x in enumerate(labels)}
    vocabulary: dict[str, int] = {}
    pieces: list[tuple[np.ndarray, int]] = []
    for words, lang in zip(samples, langs, strict=True):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64)
        at = 0
        while at < len(ids):
            n = int(rng.integers(5, 30))
            pieces.append((ids[at : at + n], code[lang]))
            at += n
    buckets = buckets_for(k)
    crf = Crf(labels, np.zeros((buckets + 1, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k))
    if not pieces or k < 2:
        return crf
    feats = features(list(vocabulary), buckets)
    grad2, tgrad2 = np.full(crf.weights.shape, 1e-3, dtype=np.float32), np.full((k, k), 1e-3)
    for _ in range(epochs):
        perm = rng.permutation(len(pieces))
        # A third of the pieces follow a piece of another language, two thirds stand alone.
        groups, at = [], 0
        while at < len(perm):
            n = 1 if rng.random() < 0.5 else int(rng.integers(2, 4))
            groups.append(perm[at : at + n])
            at += n
        for lo in range(0, len(groups), batch):
            chosen = groups[lo : lo + batch]
            ids = np.concatenate([pieces[p][0] for g in chosen for p in g])
            gold = np.concatenate([np.full(len(pieces[p][0]), pieces[p][1]) for g in chosen for p in g])
            sizes = np.array([sum(len(pieces[p][0]) for p in g) for g in chosen])
            uniq, back = np.unique(ids, return_inverse=True)
            scores = crf.weights[feats[uniq]].sum(axis=1)[back]
            post, pairs = forward_backward(scores, sizes, crf.transitions, crf.start)
            delta = -post
            delta[np.arange(len(ids)), gold] += 1
            by_word = np.zeros((len(uniq), k))
            np.add.at(by_word, back, delta)
            rows = feats[uniq]
            g = np.zeros_like(crf.weights)
            for c in range(k):
                g[:, c] = np.bincount(rows.ravel(), np.repeat(by_word[:, c], rows.shape[1]), minlength=buckets + 1)
            g = g / len(chosen)
            g[buckets] = 0
            touched = np.flatnonzero(g.any(axis=1))
            grad2[touched] += g[touched] ** 2
            crf.weights[touched] += rate * g[touched] / np.sqrt(grad2[touched])
            inner = np.ones(len(ids), dtype=bool)
            inner[np.cumsum(sizes) - 1] = False
            i = np.flatnonzero(inner)
            seen = np.bincount(gold[i] * k + gold[i + 1], minlength=k * k).reshape(k, k)
            tg = (seen - pairs) / len(chosen)
            tgrad2 += tg**2
            crf.transitions += rate * tg / np.sqrt(tgrad2)
    return crf


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled rows (doc_id, text, lang) of at most ``sample_docs`` ids, about as many of each
    language: the least of a row's hash, as a fraction, times the count of its language. Where
    ids repeat, at most twice as many rows."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LABELS).collect()
    if not counts:
        return rows.select("doc_id", "text", "lang").limit(0)
    weight = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(float(r["count"])))])
    key = (F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) + 1) * weight[F.col("lang")]
    keyed = rows.select("doc_id", key.alias("k")).where("k IS NOT NULL")
    ids = [r[0] for r in keyed.orderBy("k", "doc_id").limit(sample_docs).collect()]
    known = [r["lang"] for r in counts]
    return rows.where(F.col("doc_id").isin(ids) & F.col("lang").isin(known)).select("doc_id", "text", "lang").orderBy("doc_id").limit(2 * sample_docs)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Crf:
    """Fit on a bounded sample of the documents that aren't held out. Only the words drawn from
    it reach the driver."""
    sample = training_sample(docs.where(~held_out()).select("doc_id", "text", "lang"), sample_docs)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            words = [drawn_words(t, zlib.crc32(str(i).encode()), sample_words) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), b.column(2)], names=["words", "lang"])

    rows = sample.mapInArrow(draw, "words array<string>, lang string").collect()
    return fit([r["words"] for r in rows], [r["lang"] for r in rows])


class Predictor:
    """Holds the emission scores of words seen so far in a worker, within a bound."""

    def __init__(self, crf: Crf):
        self.crf, self.ids = crf, {}
        self.scores = np.empty((0, len(crf.labels)), dtype=np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > min(CACHE_WORDS, CACHED // len(self.crf.labels)):
            self.ids.clear()
            self.scores = self.scores[:0]
        if new := [w for w in set(words) if w not in self.ids]:
            base = len(self.ids)
            self.ids.update((w, base + i) for i, w in enumerate(new))
            self.scores = np.concatenate([self.scores, self.crf.emissions(new)])
        get = self.ids.__getitem__
        return self.scores[np.fromiter(map(get, words), dtype=np.int64, count=len(words))]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.crf.labels:
            return [("und", 0.0)] * len(texts)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        words: list[str] = []
        sizes: list[int] = []
        where: list[int] = []

        def flush() -> None:
            if not words:
                return
            post = forward_backward_posterior(self.lookup(words), np.array(sizes), self.crf.transitions, self.crf.start)
            ends = np.cumsum(sizes)
            mean = np.add.reduceat(post, ends - np.array(sizes), axis=0) / np.array(sizes)[:, None]
            best = mean.argmax(axis=1)
            for k, (doc, b) in enumerate(zip(where, best.tolist(), strict=True)):
                out[doc] = (self.crf.labels[b], min(1.0, float(mean[k, b])))
            words.clear(), sizes.clear(), where.clear()

        for k, t in enumerate(texts):
            w = words_of(t)
            if len(w) * len(self.crf.labels) > LONG:
                out[k] = self.predict_long(w)
            elif w:
                words += w
                sizes.append(len(w))
                where.append(k)
            if len(words) * len(self.crf.labels) >= CHUNK:
                flush()
        flush()
        return out

    def predict_long(self, words: list[str]) -> tuple[str, float]:
        k = len(self.crf.labels)
        score_of = lambda lo, hi: self.lookup(words[lo:hi])
        mean = sum(p.sum(axis=0) for p in long_posteriors(score_of, len(words), self.crf.transitions, self.crf.start, max(1, CHUNK // k))) / len(words)
        return self.crf.labels[int(mean.argmax())], min(1.0, float(mean.max()))

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, posterior) in order: for code-switched text."""
        words = words_of(text)
        if not words or not self.crf.labels:
            return []
        post = forward_backward_posterior(self.lookup(words), np.array([len(words)]), self.crf.transitions, self.crf.start)
        return [(w, self.crf.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, post, strict=True)]


#: The worker's predictor and the number of its model: its cache outlives a task.
_CURRENT: list = [None, None]


def predictor_of(number: int, model) -> Predictor:
    if _CURRENT[0] != number:
        _CURRENT[:] = [number, Predictor(model.value)]
    return _CURRENT[1]


def identify(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, from its text alone."""
    model = docs.sparkSession.sparkContext.broadcast(crf)  # bounded by WEIGHTS and MAX_LABELS
    number = model._jbroadcast.id()
    d = docs.select("doc_id", held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = predictor_of(number, model)
        for b in batches:
            found = predictor.predict(b.column(2).to_pylist())
            cols = [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score"])

    return d.mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
