"""Removal of repeated byte strings: exact, by merging Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts earlier in the corpus
goes; earlier means a smaller doc_id, or the same document and an earlier start.

1. Each window of ``length`` bytes has a key, the least hash of its ``GRAM``-byte grams.
   Consecutive windows of one key form a segment, of at most ``PIECE`` windows, so equal
   windows lie in segments of the same key, and each window lies in one segment. A segment
   is its key, a digest of its bytes and its place. Keys that occur once can't hold a repeat:
   keys are counted first, and a filter of bounded size, made from those that repeat, drops
   nearly all others when the texts are read again; what it lets through is told apart below.
2. Of segments with equal bytes only the first needs a look: the windows of the others
   all start earlier there. So large groups of copies shrink to one segment.
3. First segments of keys with different bytes meet, and those whose surroundings of the
   key's gram occur nowhere else go: no window of theirs can repeat. Each shard sorts its
   suffixes and forms its Burrows-Wheeler transform; the transforms are then merged by
   iterative refinement of their interleave. After k rounds the interleave is sorted by
   the first k bytes, and the block borders found so far are the places where common
   prefixes are shorter than k: after ``length`` rounds the blocks are the repeated
   intervals. No suffix is sorted again across shards.
4. Of each block all but the first window are repeats. The segments of a key with more than
   ``shard`` of them, or with more than ``GROUP_BYTES``, are dealt into shards of which every
   two are merged in a group of their own, so a task's memory is bounded.

Defined cases: a null text is empty and keeps nothing; documents shorter than ``length``
lose nothing; a null doc_id comes after all others; texts of one doc_id, null included, come
in the order of their hashes; rows equal in doc_id and text are one place, so neither repeats
the other; a doc_id that isn't a number is refused; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize, numbered, text_bytes
from .set_join import mixed

LENGTH = 100
GRAM = 32
#: Windows of one segment at most.
PIECE = 1 << 14
#: Segments and bytes of one key that are merged in one group.
SHARD, GROUP_BYTES = 4096, 1 << 21
#: Bytes whose suffixes are sorted together, and bytes merged together.
SHARD_BYTES, MERGE_BYTES = 1 << 14, 1 << 19
#: A window holds one of so many surroundings of each of its grams.
PARTS = 4
#: Bits of the filter of repeated keys at most: 16 MB.
FILTER_BITS = 1 << 27
_NULL_ID = (1 << 63) - 1


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place; gram is a multiple of 8."""
    n = len(raw) - gram + 1
    words = sliding_window_view(raw, 8).copy().view("<u8").ravel()
    h = np.zeros(n, dtype=np.uint64)
    for k in range(0, gram, 8):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima over blocks of w."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, place in raw, windows) of each segment of texts that stand one after
    another; windows is negative if the key's gram occurs twice in the segment, without which
    no window can repeat within it."""
    if len(raw) < length:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    hashes, w = _gram_hashes(raw, gram), length - gram + 1
    keys = _sliding_min(hashes, w)
    n = len(keys)
    new = np.ones(n + 1, dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
    new[ends[ends < n]] = True  # windows of the next text, and before them those across its border
    tail = ends - length + 1
    new[tail[(tail > 0) & (tail < n)]] = True
    starts = np.flatnonzero(new)
    count, starts = np.diff(starts), starts[:-1]
    text = np.searchsorted(ends, starts, side="right")
    keep = starts + length <= ends[text]
    text, starts, count = text[keep], starts[keep], count[keep]
    pieces = -(-count // PIECE)
    if (pieces > 1).any():
        inside = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, starts, left = np.repeat(text, pieces), np.repeat(starts, pieces) + inside * PIECE, np.repeat(count, pieces) - inside * PIECE
        count = np.minimum(left, PIECE)
    key = keys[starts]
    views, last = sliding_window_view(hashes, w), starts + count - 1
    leftmost = starts + (views[starts] == key[:, None]).argmax(axis=1)
    rightmost = last + w - 1 - (views[last, ::-1] == key[:, None]).argmax(axis=1)
    return text, key, starts, np.where(leftmost == rightmost, count, -count)


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) > rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    yield from held


def segment_keys(docs: DataFrame, length: int) -> DataFrame:
    """(key, n) of every segment; n is negative as in segments()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, raw, ends in text_bytes(b.column(0)):
                _, key, _, n = segments(raw, ends, length)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], names=["key", "n"])

    return docs.select("text").mapInArrow(lambda batches: _joined(run(batches)), "key bigint, n int")


_SEGMENT = "doc_id bigint, sub bigint, key bigint, digest bigint, start int, n int"


def segment_rows(docs: DataFrame, length: int, bits: np.ndarray) -> DataFrame:
    """The segments whose key the filter says yes to."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs = b.column(0), b.column(1)
            for at, raw, ends in text_bytes(b.column(2)):
                text, key, place, n = segments(raw, ends, length)
                yes = may_hold(held.value, key)
                text, key, place, n = text[yes], key[yes], place[yes], n[yes]
                view, size = memoryview(raw), np.abs(n) + length - 1
                digest = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(place.tolist(), (place + size).tolist(), strict=True)), dtype=np.uint64, count=len(key))
                owner = pa.array(at + text)
                start = place - np.concatenate([[0], ends[:-1]])[text]
                yield pa.RecordBatch.from_arrays([
                    ids.take(owner), subs.take(owner), pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                ], names=[x.split()[0] for x in _SEGMENT.split(", ")])

    return docs.mapInArrow(lambda batches: _joined(run(batches)), _SEGMENT)


# --- a filter of keys ---


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """Two places of each key in a filter of ``size`` bits, a power of two."""
    h = mixed(keys.view(np.uint64))
    return np.concatenate([h & np.uint64(size - 1), h >> np.uint64(32) & np.uint64(size - 1)]).astype(np.int64)


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys, 8 * len(table))
    yes = (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return yes[: len(keys)] & yes[len(keys) :]


def key_filter(keys: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Bytes of a filter that says yes to all of the keys and to few others. Its size is bounded;
    its words are combined before they reach the driver. A crowded filter costs speed alone."""
    size = 1 << 16
    n = keys.count()
    while size < 12 * n and size < most:
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy(), size))
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = keys.select("key").mapInArrow(run, "word int, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size >> 6, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint8)


# --- Burrows-Wheeler transforms ---


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols (0 ends a string; ends are ordered by place) by doubling."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)  # below n + 257
    rank[ends] = np.arange(len(ends))
    k = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1
        code = rank * (n + 300) + second  # ranks are below 2^31: shards are small
        order = np.argsort(code)  # equal codes get one rank, in any order
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(code[order][1:] != code[order][:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler transform) of strings that each end with 0."""
    order = suffix_order(text)
    return order, text[order - 1]


def merge_transforms(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row among all shards' rows, its block) in merged order: rows of a block agree in
    their first ``depth`` symbols. Each round deals the rows out by the symbol before them,
    in the order so far; rows that came from one block with one symbol stay in one block.
    Rows alone in their block, or past the start of their string, can't repeat and leave.
    """
    joined = np.concatenate(bwts)
    lf = np.empty(len(joined), dtype=np.int32)  # the row of the suffix one symbol longer
    at = 0
    for b in bwts:
        lf[at + np.argsort(b, kind="stable")] = np.arange(at, at + len(b), dtype=np.int32)
        at += len(b)
    place, block = np.arange(len(joined), dtype=np.int32), np.zeros(len(joined), dtype=np.int32)
    for _ in range(depth):
        if not len(place):
            break
        symbol = joined[place]
        order = np.argsort(symbol, kind="stable")
        order = order[np.count_nonzero(symbol == 0) :]
        symbol, came = symbol[order], block[order]
        edge = np.ones(len(order) + 1, dtype=bool)
        np.logical_or(symbol[1:] != symbol[:-1], came[1:] != came[:-1], out=edge[1:-1])
        keep = ~(edge[:-1] & edge[1:])
        place, block = lf[place[order[keep]]], np.cumsum(edge[:-1], dtype=np.int32)[keep]
    return place, block


def repeated_windows(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For strings in corpus order: (string, offset) rows of all windows of ``length``
    bytes that have an equal, earlier one."""
    shards: list[tuple[int, int]] = []
    lo = size = 0
    for k, s in enumerate(strings):
        if size and size + len(s) > shard_bytes:
            shards.append((lo, k))
            lo, size = k, 0
        size += len(s) + 1
    shards.append((lo, len(strings)))
    bwts, owners, offsets = [], [], []
    for a, b in shards:
        text = np.frombuffer(b"\0".join(strings[a:b]) + b"\0", dtype=np.uint8).copy()
        ends = np.cumsum([len(s) + 1 for s in strings[a:b]])
        text += 1  # no byte of UTF-8 is above 0xF4
        text[ends - 1] = 0
        order, bwt = transform(text)
        owner = np.searchsorted(ends, order, side="right")
        begin = np.concatenate([[0], ends[:-1]])
        bwts.append(bwt)
        owners.append(owner + a)
        offsets.append(order - begin[owner])
    place, block = merge_transforms(bwts, length)
    owner, offset = np.concatenate(owners)[place], np.concatenate(offsets)[place]
    by = np.lexsort((offset, owner, block))
    owner, offset, block = owner[by], offset[by], block[by]
    again = np.concatenate([[False], block[1:] == block[:-1]]) if len(block) else np.empty(0, bool)
    return np.column_stack([owner[again], offset[again]])


def may_repeat(keys: list[int], strings: list[bytes], length: int, gram: int = GRAM) -> np.ndarray:
    """Which segments may hold a window that repeats in one of these segments.

    A window holds an occurrence of its key's gram with a bytes before and b behind,
    a + b = length - gram. Whatever a is, one of ``PARTS`` surroundings of the gram,
    about 1 / PARTS of that sum shorter than the window, lies within the window, so equal windows share it.
    """
    sizes = np.array([len(s) for s in strings])
    ends, joined = np.cumsum(sizes), b"".join(strings)
    hashes = _gram_hashes(np.frombuffer(joined, dtype=np.uint8), gram)
    at = np.flatnonzero(hashes == np.repeat(np.array(keys, dtype=np.int64).view(np.uint64), sizes)[: len(hashes)])
    owner = np.searchsorted(ends, at, side="right")
    begin, end = ends[owner] - sizes[owner], ends[owner]
    spare = length - gram
    owners, digests = [], []
    for k in range(PARTS):
        # a is one of spare + 1 numbers; of this part's, no a is less and no b is less.
        a = (spare + 1) * k // PARTS
        b = spare + 1 - (spare + 1) * (k + 1) // PARTS
        lo, hi = at - a, at + gram + b
        fits = (lo >= begin) & (hi <= end)
        owners.append(owner[fits])
        digests += [xxhash.xxh3_64_intdigest(joined[x:y], k) for x, y in zip(lo[fits].tolist(), hi[fits].tolist(), strict=True)]
    _, inverse, count = np.unique(np.array(digests, dtype=np.uint64), return_inverse=True, return_counts=True)
    keep = np.zeros(len(strings), dtype=bool)
    keep[np.concatenate(owners)[count[inverse] > 1]] = True
    return keep


# --- Spark jobs ---

_SPAN = ["doc_id", "sub", "start", "stop"]


def _texts_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, sub, start, bytes) of the wanted segments. ``wanted`` is a written table
    (doc_id, sub, keys, at) of a document's segments; at packs a start and a number of windows."""
    d = docs.join(few(wanted, lists="keys"), ["doc_id", "sub"]).select("doc_id", "sub", "text", "keys", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, sub, t, keys, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = (t or "").encode()
                start = np.array(at, dtype=np.int64) >> 32
                stop = start + (np.array(at, dtype=np.int64) & 0xFFFFFFFF) + length - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(np.full(len(keys), doc)), pa.array(np.full(len(keys), sub)), pa.array(start.astype(np.int32)),
                    pa.array([text[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary()),
                ], names=["key", "doc_id", "sub", "start", "bytes"])

    return d.mapInArrow(run, "key bigint, doc_id bigint, sub bigint, start int, bytes binary")


def _merged(parts: DataFrame, crowded: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, sub, start, stop) of repeated windows, found by merging transforms. Of a
    key in ``crowded`` (key, shards), any two shards i and j form a group."""
    one = F.lit(1)
    parts = parts.withColumn("shards", one) if crowded.isEmpty() else parts.join(few(crowded), "key", "left").withColumn("shards", F.coalesce("shards", one))
    own = F.pmod(F.xxhash64("doc_id", "sub", "start"), F.col("shards")).cast("int")
    dealt = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    dealt = dealt.select("key", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"), "doc_id", "sub", "start", "bytes")
    placed = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id", "sub", "start")

    def work(rows: list[tuple]) -> pa.RecordBatch:
        # Strings of one key follow the corpus order; keys share no window.
        keys, _, _, docs, subs, starts, strings = map(list, zip(*rows, strict=True))
        keep = np.flatnonzero(may_repeat(keys, strings, length)).tolist()
        docs, subs, starts, strings = ([x[k] for k in keep] for x in (docs, subs, starts, strings))
        found = repeated_windows(strings, length) if strings else np.empty((0, 2), dtype=np.int64)
        owner = found[:, 0]
        doc, sub, start = np.array(docs, dtype=np.int64)[owner], np.array(subs, dtype=np.int64)[owner], np.array(starts, dtype=np.int64)[owner] + found[:, 1]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _runs(doc, sub, start, length)], names=_SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows:
                    if row[:6] == rows[-1][:6]:  # rows equal in doc_id and text
                        continue
                    # Groups of one key don't mix: each string of theirs is in several.
                    if row[0] == rows[-1][0] and row[1:3] != rows[-1][1:3] or size > MERGE_BYTES and row[0] != rows[-1][0]:
                        yield work(rows)
                        rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield work(rows)

    return placed.mapInArrow(run, "doc_id bigint, sub bigint, start bigint, stop bigint")


def _runs(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Spans that cover the windows at these places."""
    by = np.lexsort((start, sub, doc))
    doc, sub, start = doc[by], sub[by], start[by]
    if not len(doc):
        return [doc, sub, start, start]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] > start[:-1] + length)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return [doc[at], sub[at], start[at], start[last] + length]


def _union(spans: np.ndarray) -> np.ndarray:
    """Packed spans without those that touch or overlap; few are left of a long passage."""
    spans = np.sort(spans)
    start = spans >> 32
    stop = np.maximum.accumulate(start + (spans & 0xFFFFFFFF))
    first = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    last = np.append(first[1:], len(spans)) - 1
    return start[first] << 32 | stop[last] - start[first]


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, sub, spans array<bigint>): for each document that loses bytes, the spans to
    remove, with a start in the upper and a length in the lower 32 bits; a written table."""
    keys = segment_keys(docs, length).groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("n")).where("c > 1 OR n < 0").select("key")
    keys = materialize(keys, "suffix-keys")
    held = materialize(segment_rows(docs, length, key_filter(keys)), "suffix-segments")
    discard(keys)
    place = F.struct("doc_id", "sub", "start")
    first = materialize(held.groupBy("key", "digest").agg(F.min(place).alias("first"), F.min("n").alias("n")), "suffix-firsts")
    # Later copies of a segment go whole.
    copies = held.join(first.select("key", "digest", "first"), ["key", "digest"]).where(place != F.col("first"))
    copies = copies.select("doc_id", "sub", F.col("start").cast("long").alias("start"), (F.col("start") + F.abs("n") + length - 1).cast("long").alias("stop"))
    copies = materialize(copies, "suffix-copies")
    # First segments of keys with different bytes, and those that may repeat within themselves, are merged.
    sizes = first.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.abs("n") + length - 1).alias("b"))
    over = F.greatest(F.col("c") / shard, F.col("b") / GROUP_BYTES)
    crowded = materialize(sizes.where(over > 1).select("key", F.ceil(over * 1.25).cast("int").alias("shards")), "suffix-crowded")
    at = F.shiftleft(F.col("first.start").cast("long"), 32).bitwiseOR(F.abs("n"))
    look = first.join(sizes, "key").where("c > 1 OR n < 0").select("first.*", F.struct("key", at.alias("at")).alias("s"))
    lists = look.groupBy("doc_id", "sub").agg(F.collect_list("s").alias("s"))  # at most a document's segments
    wanted = materialize(lists.select("doc_id", "sub", F.col("s.key").alias("keys"), F.col("s.at").alias("at")), "suffix-wanted")
    discard(held, first)
    spans = copies.union(_merged(_texts_of(docs, wanted, length), crowded, length))
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("stop") - F.col("start"))
    lists = spans.groupBy("doc_id", "sub").agg(F.collect_set(packed).alias("spans"))  # at most a document's bytes

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = [_union(np.array(x, dtype=np.int64)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merged, pa.list_(pa.int64()))], names=["doc_id", "sub", "spans"])

    out = materialize(lists.mapInArrow(union, "doc_id bigint, sub bigint, spans array<bigint>"), "suffix-spans")
    discard(copies, wanted, crowded)
    return out


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, text): sub tells the texts of a repeated doc_id apart and is zero else."""
    d = numbered(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = materialize(d.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("twice")), "suffix-ids")
    if twice.isEmpty():
        return d.select("doc_id", F.lit(0).cast("long").alias("sub"), "text")
    sub = F.when(F.col("twice"), F.xxhash64("text")).otherwise(0)
    return d.join(few(twice), "doc_id", "left").select("doc_id", sub.cast("long").alias("sub"), "text")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, removed array<start, stop>, kept binary) of every document."""
    d = _documents(docs)
    joined = d.join(few(repeated_spans(d, length, shard), lists="spans"), ["doc_id", "sub"], "left").select("doc_id", "text", "spans")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, removed, kept = [], [], [], []
            for doc, t, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = (t or "").encode()
                merged: list[list[int]] = []
                for s in sorted((x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                parts, at = [], 0
                for x, y in merged:
                    parts.append(text[at:x])
                    at = y
                ids.append(None if doc == _NULL_ID else doc)
                sizes.append(len(text))
                removed.append([{"start": x, "stop": y} for x, y in merged])
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary")


def judge_substrings(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and a digest of what is kept."""
    found = dedup_substrings(docs, length, shard)
    return found.select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
