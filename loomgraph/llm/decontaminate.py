"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, normalised to words, build one automaton over word ids. Training documents
stream through it; at every word the automaton gives the longest match that ends there.
A match of at least ``window`` words, or one that spells out a whole shorter item, hits
the words it covers. Spans and documents over the limits can then be removed.

A benchmark of at most ``shard_words`` words is one automaton, which is broadcast. A larger
one is dealt into shards of about so many; the tasks build their automata, one at a time,
and scan the stretches of distinct texts that an exact join of window keys sends to them.
Both ways give the same rows.

Defined cases: a null or blank text has no words and no hits; items without words match
nothing; items with a null id are ignored, other ids are numbers or strings; repeated items
are matched alike; an empty benchmark hits nothing; input columns named like computed ones
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import FEW, FEW_ELEMENTS, discard, few, materialize, text_bytes
from .set_join import find_words, mixed, word_hashes
from .suffix_dedup import key_filter, may_hold

WINDOW = 13
#: Words of the items in one broadcast automaton.
SHARD_WORDS = 200_000
#: Characters of the items in one automaton, whose words may be long.
SHARD_CHARS = 16_000_000
#: Words of a piece of an item; longer items are cut with an overlap.
PIECE_WORDS = 4_096
#: Characters that one shard's task scans before the shard gets another task, and partitions of those.
SCAN_CHARS, MOST_TASKS = 32_000_000, 20_000
#: Tasks that share a hot text or passage in a shuffled join.
SALTS = 16
#: A document is contaminated if at least one in so many of its words is hit.
COVERAGE = 20

#: Bytes to word bytes: letters lower-cased, digits and non-ASCII kept, all else a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: A word, before its letters are lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Odd factor of the keys of windows.
_STEP = 0x9E3779B97F4A7C15
_DEALT = ["shard", "sub", "kind", "item_id", "text", "start", "words"]


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class SuffixAutomaton:
    """Of many word sequences: transitions by word id, suffix links and lengths."""

    def __init__(self, items: Iterable[tuple[int, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: dict[int, set[int]] = {}
        whole: list[tuple[int, int, int]] = []  # state, item, length of a short item
        self.shortest = window
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normal_words(text)]
            if not words or item is None:
                continue
            self.shortest = min(self.shortest, len(words))
            last = 0
            for w in words:
                last = self._extend(last, w)
                owners.setdefault(last, set()).add(item)
            if len(words) < window:
                whole.append((last, item, len(words)))
        # An item that has a state's string has those of its suffix links.
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if s in owners and self.link[s] > 0:
                owners.setdefault(self.link[s], set()).update(owners[s])
        #: By state: items that have the last `window` words of a match there.
        self.at_window: dict[int, frozenset[int]] = {}
        #: By state: (length, item) of short items that end a match there.
        self.at_end: dict[int, tuple[tuple[int, int], ...]] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for s, item, n in whole:
            ends.setdefault(s, []).append((n, item))
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            up = self.link[s]
            if self.length[up] >= window:
                self.at_window[s] = self.at_window[up]
            elif self.length[s] >= window:
                self.at_window[s] = frozenset(owners.get(s, ()))
            found = self.at_end.get(up, ()) + tuple(ends.get(s, ()))
            if found:
                self.at_end[s] = found
        # Word pairs that follow each other in an item, as bits of a fixed hash table.
        pairs = [(w, v) for s, step in enumerate(self.next) for w, t in step.items() for v in self.next[t]]
        self.pairs = np.zeros(1 << 22, dtype=bool)
        if pairs:
            a, b = np.array(pairs, dtype=np.int64).T
            self.pairs[self._slot(a, b)] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & ((1 << 22) - 1)

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest string and w, cut off from q if q also has longer ones."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._add(self.length[last] + 1), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self._split(p, w)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of word positions, merged, and the items that occur."""
        n, get = len(words), self.vocabulary.get
        if n < self.shortest or not self.vocabulary:
            return [], set()
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=n)
        # Only runs of known words, each pair of which occurs in an item, can match.
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        joined &= self.pairs[self._slot(ids[:-1], ids[1:])]
        if self.shortest == 1:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
            runs = edges.reshape(-1, 2)
        else:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
            runs = edges.reshape(-1, 2) + np.array([0, 1])
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for lo, hi in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
            self._walk(ids[lo:hi].tolist(), lo, spans, items)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def _walk(self, ids: list[int], at: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        state = matched = 0
        for i, w in enumerate(ids, at + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            if matched >= self.window:
                spans.append((i - matched, i))
                items |= self.at_window[state]
            # Short items that end here and aren't longer than the match.
            for n, item in self.at_end.get(state, ()):
                if n <= matched:
                    spans.append((i - n, i))
                    items.add(item)


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, words, n): the items' normal words in pieces of at most ``most`` words and
    the overlap that keeps every window whole. Items below a window are one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words, sizes = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                item = normal_words(text)
                for lo in range(0, max(1, len(item) - window + 1), most):
                    piece = item[lo : lo + most + window - 1]
                    if piece:
                        at.append(k)
                        words.append(b" ".join(piece).decode())
                        sizes.append(len(piece))
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.string()), pa.array(sizes, pa.int64())], names=["item_id", "words", "n"])

    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    named = benchmark.schema["item_id"].dataType == StringType()
    items = items.select(F.col("item_id").cast("string" if named else "bigint").alias("item_id"), "text")
    return items.mapInArrow(cut, f"item_id {'string' if named else 'bigint'}, words string, n bigint")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NEW = "hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<%s>, n_words bigint"


def _union(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, text: str = "text", owned: list[DataFrame] | None = None
) -> DataFrame:
    """``docs`` with hit_spans (word positions), hit_items and n_words. A benchmark of more
    than ``shard_words`` words leaves a table of hits that the result reads; ``owned`` gets it."""
    out = docs.drop("hit_spans", "hit_items", "n_words")
    pieces = _pieces(benchmark, window, max(window, min(PIECE_WORDS, shard_words)))
    words, chars = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    if words <= shard_words and chars <= SHARD_CHARS:
        return _scan_whole(out, pieces, window, text)
    shards = max(-(-words // shard_words), -(-chars // SHARD_CHARS))
    hits = _hits_of_shards(out.select(F.col(f"`{text}`").alias("text")), pieces, window, shards)
    if owned is not None:
        owned.append(hits)
    rows, elements = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("hit_spans") + F.size("hit_items")), F.lit(0))).first()
    out = out.withColumn("__key", F.md5(f"`{text}`"))
    on = ["__key"]
    if rows <= FEW and elements <= FEW_ELEMENTS:
        hits = F.broadcast(hits)
    else:  # copies of a text and nulls go to as many tasks
        out = out.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        hits = hits.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on.append("__salt")
    return out.join(hits.withColumnRenamed("key", "__key"), on, "left").select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("hit_spans", "hit_items", "n_words")],
        *[F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("hit_spans", "hit_items")],
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"),
    )


def _scan_whole(docs: DataFrame, pieces: DataFrame, window: int, text: str) -> DataFrame:
    """All documents against one broadcast automaton of all pieces."""
    items = [(r.item_id, r.words) for r in pieces.select("item_id", "words").collect()]  # at most a shard
    automaton = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(items, window))
    named = pieces.schema["item_id"].dataType == StringType()
    items_type = pa.list_(pa.string() if named else pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = automaton.value
        for batch in batches:
            spans, items, counts = [], [], []
            for t in batch.column(text).to_pylist():
                words = normal_words(t)
                s, i = sam.matches(words)
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(i))
                counts.append(len(words))
            cols = {n: batch.column(n) for n in batch.schema.names}
            cols |= {"hit_spans": pa.array(spans, _SPANS), "hit_items": pa.array(items, items_type), "n_words": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(scan, f"{_ddl(docs)}, {_NEW % ('string' if named else 'bigint')}")


# --- benchmarks of many shards ---


def _window_keys(raw: np.ndarray, ends: np.ndarray, lengths: list[int]):
    """Begins and ends of the words of texts, the text of each word, and for each length the
    (length, first word, key) of every run of so many words inside a text."""
    starts, stops = find_words(raw, ends)
    hashes = word_hashes(raw, starts, stops)
    of = np.searchsorted(ends, starts, side="right")
    runs = []
    for n in lengths:
        m = len(hashes) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            key = key * np.uint64(_STEP) + hashes[k : k + m]
        at = np.flatnonzero(of[:m] == of[n - 1 :])
        runs.append((n, at, mixed(key[at]).view(np.int64)))
    return starts, stops, of, runs


def _piece_keys(pieces: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """(key, shard) of every window, and of every item below one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, sizes = b.column(1).to_numpy(), np.minimum(b.column(2).to_numpy(), window)
            for first, raw, ends in text_bytes(b.column(0)):
                _, _, of, runs = _window_keys(raw, ends, lengths)
                for n, at, key in runs:
                    piece = first + of[at]
                    mine = sizes[piece] == n
                    yield pa.RecordBatch.from_arrays([pa.array(key[mine]), pa.array(shards[piece[mine]])], names=["key", "shard"])

    return pieces.select("words", "shard", "n").mapInArrow(run, "key bigint, shard bigint").distinct()


def _segments(texts: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """(text, start, words, keys): the maximal stretches of a text, known by its digest, whose
    overlapping runs of words the filter says yes to. Every match lies inside one of them."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, raw, ends in text_bytes(b.column(1), table=_NORMAL):
                starts, stops, of, runs = _window_keys(raw, ends, lengths)
                yes = [(at[ok], n, key[ok]) for n, at, key in runs for ok in [may_hold(held.value, key.view(np.uint64))]]
                lo = np.concatenate([np.empty(0, np.int64), *[at for at, _, _ in yes]])
                if not len(lo):
                    continue
                hi = np.concatenate([at + n for at, n, _ in yes])
                key = np.concatenate([k for _, _, k in yes])
                by = np.argsort(lo, kind="stable")
                lo, key, reach = lo[by], key[by], np.maximum.accumulate(hi[by])
                begin = np.flatnonzero(np.concatenate([[True], lo[1:] >= reach[:-1]]))
                end = np.append(begin[1:], len(lo))
                a, z = lo[begin], reach[end - 1]
                view = memoryview(raw)
                words = [str(view[starts[i] : stops[j - 1]], "utf-8") for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(first + of[a])), pa.array(a - np.searchsorted(of, of[a])), pa.array(words, pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.append(begin, len(lo)).astype(np.int32)), pa.array(key)),
                    ],
                    names=["text", "start", "words", "keys"],
                )

    return texts.select(F.md5("text").alias("key"), "text").where("text is not null").mapInArrow(run, "text string, start bigint, words string, keys array<bigint>")


def _scan_shards(dealt: DataFrame, window: int, item: str) -> DataFrame:
    """(key, spans, items) of dealt segments. Rows come sorted by (shard, sub, kind): the
    pieces of a shard, which build its automaton in the task, then what it scans."""
    items_type = pa.list_(pa.string() if item == "string" else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sam, build = None, None, []
        for b in batches:
            texts, spans, found = [], [], []
            for shard, sub, kind, owner, text, start, words in zip(*[b.column(n).to_pylist() for n in _DEALT], strict=True):
                if at != (shard, sub):
                    at, sam, build = (shard, sub), None, []
                if kind == 0:
                    build.append((owner, words))
                    continue
                if sam is None:
                    sam, build = SuffixAutomaton(build, window), []
                s, i = sam.matches(normal_words(words))
                if s:
                    texts.append(text)
                    spans.append([{"start": start + x, "end": start + y} for x, y in s])
                    found.append(sorted(i))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, _SPANS), pa.array(found, items_type)], names=["key", "spans", "items"])

    return dealt.mapInArrow(run, f"key string, spans array<struct<start:bigint,end:bigint>>, items array<{item}>")


def _merged(hits: DataFrame, item: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": x, "end": y} for x, y in _union([(s["start"], s["end"]) for s in row], [])] for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS), b.column(2)], names=["key", "hit_spans", "hit_items"])

    return hits.mapInArrow(run, f"key string, hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<{item}>")


def _hits_of_shards(texts: DataFrame, pieces: DataFrame, window: int, shards: int) -> DataFrame:
    """(key, hit_spans, hit_items) by the digest of a text with hits; a written table.

    Pieces are dealt to shards by hash. A filter of their windows leaves the stretches of texts
    that may match, an exact join of window keys says which shards a stretch meets, and only
    those scan it. The plan has the same depth for any number of shards."""
    item = pieces.schema["item_id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("item_id", "words"), F.lit(shards).cast("bigint"))
    pieces = materialize(pieces.withColumn("shard", own), "benchmark-pieces")
    lengths = sorted(r[0] for r in pieces.select(F.least("n", F.lit(window))).distinct().collect())  # at most `window`
    keys = materialize(_piece_keys(pieces, window, lengths), "benchmark-keys")
    once = _segments(texts, key_filter(keys), lengths).dropDuplicates(["text", "start"])  # copies of texts scan once
    segments = materialize(once, "benchmark-segments")
    met = segments.select("text", "start", F.explode(F.array_distinct("keys")).alias("key"))
    found = materialize(keys.join(met.select("key").distinct(), "key"), "benchmark-found")
    small = found.count() <= FEW
    if small:
        pairs = met.join(F.broadcast(found), "key")
    else:  # a passage of many texts goes to as many tasks
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = met.withColumn("salt", F.pmod(F.xxhash64("text", "start"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    pairs = pairs.select("text", "start", "shard").distinct()
    dealt = materialize(pairs.join(segments.drop("keys"), ["text", "start"]), "benchmark-dealt")
    loads = materialize(dealt.groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / SCAN_CHARS).alias("subs")), "benchmark-loads")
    tasks = loads.agg(F.coalesce(F.sum("subs"), F.lit(0))).first()[0]
    subs = few(loads)
    scanned = dealt.join(subs, "shard").select(
        "shard", F.pmod(F.xxhash64("text", "start"), F.col("subs")).alias("sub"), F.lit(1).alias("kind"), F.lit(None).cast(item).alias("item_id"), "text", "start", "words"
    )
    built = pieces.join(subs, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.lit(0).alias("kind"), "item_id",
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("start"), "words",
    )
    rows = built.unionByName(scanned).repartition(min(max(tasks, 1), MOST_TASKS), "shard", "sub").sortWithinPartitions("shard", "sub", "kind")
    by_text = _scan_shards(rows.select(*_DEALT), window, item).groupBy("key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    hits = materialize(_merged(by_text, item), "benchmark-hits")
    discard(pieces, keys, segments, found, dealt, loads)
    return hits


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def contaminated(n_hit, n_words, coverage: int = COVERAGE):
    return (n_hit > 0) & (coverage * n_hit >= n_words)


def _n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def judge_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_matches(docs.select("doc_id", "text"), benchmark, window).withColumn("n_hit", _n_hit())
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between those words."""
    raw = text.encode()
    normal = raw.translate(_NORMAL)
    starts = np.flatnonzero(np.diff(np.concatenate(([True], np.frombuffer(normal, np.uint8) == 32)).astype(np.int8)) == -1)
    words = normal.split()
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:starts[a]])
        at = int(starts[b - 1]) + len(words[b - 1])
    return b"".join([*parts, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """``docs`` with the columns they came with. ``mode`` says what is removed from what
    the coverage limit calls contaminated: "documents" the documents, "spans" the hit spans,
    from every document that has them."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    found = find_matches(whole, benchmark, window, text="_text")
    fields = [F.col("_doc").getField(c).alias(c) for c in docs.columns]
    if mode == "documents":
        return found.where(~contaminated(_n_hit(), F.col("n_words"), coverage)).select(*fields)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or not len(s) else _cut(t, [(x["start"], x["end"]) for x in s]))

    return found.select(*[cut("_text", "hit_spans").alias("text") if c == "text" else f for c, f in zip(docs.columns, fields, strict=True)])
