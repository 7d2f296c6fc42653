"""Exact set-similarity self-join by prefix, positional and length filters.

A member of the join is a set of tokens with a place (doc_id, line). ``set_rows`` reads
texts into one row a set, its tokens ordered by rarity in the whole table. Two sets whose
Jaccard similarity reaches the threshold share a token of their prefixes, so each set
sends a small row for each prefix token; rows that meet pass length, positional and bitmap
filters. Jaccard is verified on all tokens of both sets, read from the texts again.

Sets of equal tokens share a digest, and the first of them stands for all in the join.
Tokens are told apart by their rarity and 46 bits of their hash, whole sets by two 64-bit
sums. Rarity comes from a table of token counts hashed to ``buckets``: any one order is
right, so the bound on its size costs speed, not results.

Groups of more than ``shard`` rows of one token are dealt into shards that meet pairwise,
each in its own task. Small sides are broadcast up to ``common.FEW`` rows, counted before;
beyond that the same join shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize, text_bytes

SHARD = 8192

# --- reading texts into hashed tokens ---

#: Letters A-Z to lower case; white space but the line feed to a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\x0b\x0c\r " else b for b in range(256))
#: Bytes of a word that the rolling hash reads; longer words are hashed one by one.
_LONG = 64
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    factors = np.full(_BLOCK + _LONG, base & (1 << 64) - 1, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word x[start:end], by sums of powers over blocks of bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = int(np.searchsorted(starts, lo + _BLOCK))
        s = starts[a:b] - lo
        e = np.minimum(ends[a:b] - lo, s + _LONG)
        size = int(e[-1])
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((x[lo : lo + size].astype(np.uint64) + np.uint64(1)) * _UP[:size], out=total[1:])
        out[a:b] = (total[e] - total[s]) * _DOWN[s]
        a = b
    out = mixed(out)
    for k in np.flatnonzero(ends - starts > _LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(x[starts[k] : ends[k]].tobytes())
    return out


def find_words(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of texts that stand one after another."""
    if not len(x):
        none = np.empty(0, dtype=np.int64)
        return none, none
    n = len(x)
    letter = np.empty(n + 1, dtype=bool)
    np.logical_and(x != 32, x != 10, out=letter[:-1])
    letter[-1] = False
    begins, stops = np.empty(n, dtype=bool), np.empty(n + 1, dtype=bool)
    begins[0], stops[0] = letter[0], False
    np.greater(letter[1:-1], letter[:-2], out=begins[1:])
    np.less(letter[1:], letter[:-1], out=stops[1:])
    cut = ends[:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[letter[cut] & letter[cut - 1]]  # a text ends and the next begins without white space
    begins[cut] = stops[cut] = True
    return np.flatnonzero(begins), np.flatnonzero(stops)


#: (text, line, first token, number of tokens) of each set, and all tokens' hashes.
Sets = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Reader = Callable[[np.ndarray, np.ndarray], Sets]


def read_lines(x: np.ndarray, ends: np.ndarray) -> Sets:
    """A set of words for each line with a word."""
    starts, stops = find_words(x, ends)
    h = word_hashes(x, starts, stops)
    begins = np.concatenate([[0], ends[:-1]])
    breaks = np.concatenate([begins, np.flatnonzero(x == 10) + 1])
    text = np.concatenate([np.arange(len(ends)), np.searchsorted(ends, breaks[len(ends) :] - 1, side="right")])
    by = np.lexsort((breaks, text))
    breaks, text = breaks[by], text[by]
    line = np.arange(len(breaks)) - np.searchsorted(text, text)
    # A line feed at the end of a text begins its last, empty line at the place of the next text.
    at = np.searchsorted(breaks, starts, side="right") - 1
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
    lo = np.flatnonzero(first)
    return text[at[lo]], line[at[lo]], lo, np.diff(np.append(lo, len(h))), h


def read_shingles(x: np.ndarray, ends: np.ndarray, size: int) -> Sets:
    """One set for each text: its shingles of ``size`` words. A text of fewer words is one
    shingle; a text without words is one token of its own."""
    starts, stops = find_words(x, ends)
    h = word_hashes(x, starts, stops)
    count = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    begin = np.cumsum(count) - count
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64))
    total = np.zeros(len(h), dtype=np.uint64)
    for k in range(min(size, len(h))):
        total[: len(h) - k] += h[k:] * factors[k]
    n = np.maximum(count - size + 1, 1)
    lo = np.cumsum(n) - n
    at = np.minimum(np.repeat(begin - lo, n) + np.arange(int(n.sum())), max(len(h) - 1, 0))
    tokens = total[at] if len(h) else np.zeros(len(at), dtype=np.uint64)
    for k in np.flatnonzero(count < size).tolist():
        part = h[begin[k] : begin[k] + count[k]]
        tokens[lo[k]] = (part * factors[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return np.arange(len(ends)), np.zeros(len(ends), dtype=np.int64), lo, n, mixed(tokens + np.uint64(1))


# --- rarity ---


#: Buckets whose counts are one row, and bytes of text for each bucket of the table.
_PART, _BYTES = 1 << 16, 80


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the tokens of these texts: in proportion, so that as large a share of the rare
    tokens has a bucket of its own at every size, up to a table of 128 MB."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(max(round(np.log2(max(size, 1) / _BYTES)), 16), 27)


def token_counts(docs: DataFrame, read: Reader, buckets: int | None = None) -> np.ndarray:
    """Half powers of two of how often a token of each bucket occurs: 0 for once, below 64.
    The table of counts has a bounded size; each task sends the buckets that it has met, in
    parts. A task counts to 65,535: more changes no order that matters."""
    buckets = buckets or bucket_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.uint32)
        for b in batches:
            for _, x, ends in text_bytes(b.column(0), table=_LOWER):
                np.add.at(total, (read(x, ends)[4] % np.uint64(buckets)).astype(np.int64), np.uint32(1))
        for k in range(0, buckets, _PART):
            if len(at := np.flatnonzero(part := total[k : k + _PART])):
                counts = np.minimum(part[at], 0xFFFF)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype("<u2").tobytes()]), pa.array([counts.astype("<u2").tobytes()])], names=["part", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(0, dtype=np.int64)

        def row() -> pa.RecordBatch:
            ranks = np.minimum(np.log2(np.maximum(total, 1)) * 2, 63).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ranks.tobytes()])], names=["part", "ranks"])

        for b in batches:
            for k, at, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if k != part:
                    if part is not None:
                        yield row()
                    part, total = k, np.zeros(min(_PART, buckets - k), dtype=np.int64)
                total[np.frombuffer(at, dtype="<u2")] += np.frombuffer(n, dtype="<u2")
        if part is not None:
            yield row()

    parts = docs.select("text").mapInArrow(run, "part int, at binary, n binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros(buckets, dtype=np.uint8)
    for r in parts.mapInArrow(add, "part int, ranks binary").collect():
        ranks = np.frombuffer(bytes(r["ranks"]), dtype=np.uint8)
        out[r["part"] : r["part"] + len(ranks)] = ranks
    return out


def _rank_of(n: int) -> int:
    return min(int(np.log2(n) * 2), 63)


# --- sets as rows ---

#: Sets sorted at once; their number fits the upper 12 bits of a sort key.
_SORTED = 4096
_WORD = np.uint64((1 << 52) - 1)
_ROW = "doc_id bigint, line int, size int, d0 bigint, d1 bigint, s0 bigint, s1 bigint, skip int, prefix array<bigint>"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _tokens(h: np.ndarray, count: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different tokens of each set by rarity, how many) for at most ``_SORTED`` sets."""
    rank = ranks[(h % np.uint64(len(ranks))).astype(np.int64)].astype(np.uint64)
    owner = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    code = np.sort(owner << np.uint64(52) | rank << np.uint64(46) | h >> np.uint64(18))
    if len(code):
        code = code[np.concatenate([[True], code[1:] != code[:-1]])]
    return code & _WORD, np.bincount((code >> np.uint64(52)).astype(np.int64), minlength=len(count))


def _row_arrays(doc: pa.Array, line: np.ndarray, words: np.ndarray, size: np.ndarray, threshold: float) -> list[pa.Array]:
    starts = np.cumsum(size) - size
    length = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    length[size < threshold * (size + 1) - 1e-9] = 0  # similar to equal sets only
    # A token found once meets no other set; those come first.
    place = np.arange(len(words)) - np.repeat(starts, size)
    inside = place < np.repeat(length, size)
    once = inside & (words >> np.uint64(46) == 0)
    skip = np.add.reduceat(once.astype(np.int64), starts) if len(size) else size
    offsets = np.concatenate([[0], np.cumsum(length - skip)])
    # Parity bitmaps: two sets differ in at least as many tokens as their bitmaps in bits.
    a, b = mixed(words), mixed(words ^ np.uint64(0x5555555555555555))
    one, zero = np.uint64(1) << (a & np.uint64(63)), np.uint64(0)
    low = (a >> np.uint64(6) & np.uint64(1)).astype(bool)

    def fold(how: np.ufunc, values: np.ndarray) -> pa.Array:
        return pa.array((how.reduceat(values, starts) if len(size) else values).view(np.int64))

    return [
        doc, pa.array(line.astype(np.int32)), pa.array(size.astype(np.int32)), fold(np.add, a), fold(np.add, b),
        fold(np.bitwise_xor, np.where(low, one, zero)), fold(np.bitwise_xor, np.where(low, zero, one)), pa.array(skip.astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words[inside & ~once].view(np.int64))),
    ]


def set_rows(docs: DataFrame, ranks, read: Reader, threshold: float, least: int = 1) -> DataFrame:
    """One row for each set of at least ``least`` different tokens: its size, a digest (d0, d1),
    a bitmap of token parities (s0, s1), and its prefix tokens from place ``skip`` on; tokens
    before that are in no other set. ``docs`` has doc_id, a bigint, and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        held: list[pa.RecordBatch] = []
        for b in batches:
            ids = b.column(0)
            for at, x, ends in text_bytes(b.column(1), table=_LOWER):
                text, line, lo, count, h = read(x, ends)
                for k in range(0, len(text), _SORTED):
                    part = slice(k, k + _SORTED)
                    first, last = int(lo[part][0]), int(lo[part][-1] + count[part][-1])
                    words, size = _tokens(h[first:last], count[part], table)
                    keep = size >= least
                    if not keep.all():
                        words = words[np.repeat(keep, size)]
                    doc = ids.take(pa.array(at + text[part][keep]))
                    held.append(pa.RecordBatch.from_arrays(_row_arrays(doc, line[part][keep], words, size[keep], threshold), names=_NAMES))
                    if sum(x.num_rows for x in held) > 4000:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held = []
        yield from held

    return docs.select("doc_id", "text").mapInArrow(run, _ROW)


def _place(doc: str = "doc_id", line: str = "line"):
    """The order of sets as one number, which hash aggregation can take the least of."""
    return F.col(doc).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(line)


def split_equal(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the first set of each group of equal sets; (doc_id, line) of the later ones; a table to
    discard after both). Counts are combined before the shuffle, however large a group is."""
    many = sets.groupBy("d0", "d1").agg(F.min(_place()).alias("p0"), F.count("*").alias("n")).where("n > 1").select("d0", "d1", "p0")
    many = materialize(many, "sets-equal")
    side = few(many)
    first = sets.join(side, ["d0", "d1"], "left").where(F.col("p0").isNull() | (F.col("p0") == _place()))
    later = sets.select("d0", "d1", "doc_id", "line").join(side, ["d0", "d1"]).where(F.col("p0") != _place())
    return first.select("doc_id", "line", "size", "s0", "s1", "skip", "prefix"), later.select("doc_id", "line"), many


def prefix_rows(first: DataFrame) -> DataFrame:
    """One row for each prefix token of each set, with the token's place in it."""
    rows = first.select("doc_id", "line", "size", "skip", "s0", "s1", F.posexplode("prefix").alias("k", "key"))
    return rows.select("key", "size", "doc_id", "line", (F.col("k") + F.col("skip")).alias("place"), "s0", "s1")


# --- candidates ---


def _need(a, b, threshold: float):
    """Shared tokens that two sets of these sizes need."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


class _Group:
    """Prefix rows sorted by group, then by size, and where each row's group begins."""

    def __init__(self, cols: list[np.ndarray], threshold: float):
        key, i, j, self.size, self.doc, self.line, self.place, s0, s1 = cols
        self.s0, self.s1 = s0.view(np.uint64), s1.view(np.uint64)  # bits are counted on unsigned integers
        self.threshold = threshold
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        n = np.arange(len(key))
        self.rank = n - np.maximum.accumulate(np.where(new, n, 0))
        self.least = np.ceil(threshold * self.size - 1e-9)

    def passes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Positional and bitmap filters; lengths were compared before. In the group of the
        first token that two sets share, none before it is shared: what follows must do."""
        a, b, p, q = self.size[x], self.size[y], self.place[x], self.place[y]
        need = _need(a, b, self.threshold)
        ok = np.minimum(a - p, b - q) >= need
        bits = np.bitwise_count(self.s0[x] ^ self.s0[y]).astype(np.int64) + np.bitwise_count(self.s1[x] ^ self.s1[y])
        return ok & (bits <= a + b - 2 * need)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one group in reach of each other's length, by distance in the order
        of sizes; (later, earlier) in the order of places."""
        x, d = np.flatnonzero(self.rank > 0), 1
        while len(x):
            x = x[self.size[x - d] >= self.least[x]]
            y = x - d
            swap = (self.doc[x] < self.doc[y]) | ((self.doc[x] == self.doc[y]) & (self.line[x] < self.line[y]))
            later, earlier = np.where(swap, y, x), np.where(swap, x, y)
            differ = (self.doc[x] != self.doc[y]) | (self.line[x] != self.line[y])
            yield later[differ], earlier[differ]
            x = x[self.rank[x] > d]
            d += 1

    def one_each(self) -> tuple[np.ndarray, np.ndarray]:
        """One earlier row that passes for each row of each group that has any."""
        settled = np.zeros(len(self.size), dtype=bool)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for later, earlier in self.steps():
            open_ = ~settled[later]
            later, earlier = later[open_], earlier[open_]
            hit = self.passes(later, earlier)
            out.append((later[hit], earlier[hit]))
            settled[later[hit]] = True
        return _joined(out)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that pass and join the same rows of a group as all pairs that pass do."""
        label = np.arange(len(self.size))
        members: dict[int, list[int]] = {}
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in self.steps():
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            hit = self.passes(x, y)
            used = []
            for a, b in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
                p, q = int(label[a]), int(label[b])
                if p == q:
                    continue
                used.append((a, b))
                mine, other = members.get(p, [p]), members.get(q, [q])
                if len(mine) < len(other):
                    p, q, mine, other = q, p, other, mine
                label[other] = p
                mine.extend(other)
                members[p] = mine
                members.pop(q, None)
            if used:
                out.append(tuple(np.array(used).T))
        return _joined(out)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = zip(*parts, strict=True)
    return np.concatenate(a), np.concatenate(b)


PAIR = ["doc_id", "line", "doc_id0", "line0"]
_PAIRS = "doc_id bigint, line int, doc_id0 bigint, line0 int"
#: Rows that are scanned at once.
_SCAN = 200_000


def candidates(rows: DataFrame, threshold: float, shard: int = SHARD, forest: bool = False) -> DataFrame:
    """Pairs of a later and an earlier set that pass: one for each set and shared token or,
    with ``forest``, for each token a spanning forest of all pairs that pass."""
    # A token's rank bounds how many sets have it, so only frequent tokens are counted.
    frequent = rows.where(F.col("key") >= _rank_of(shard) << 46)
    hot = materialize(frequent.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard), "sets-hot")
    cols = ["key", "i", "j", "size", "doc_id", "line", "place", "s0", "s1"]
    zero = F.lit(0)
    placed = rows.withColumns({"i": zero, "j": zero}).select(*cols)
    if not hot.isEmpty():
        side = few(hot)
        cold = rows.join(side.select("key"), "key", "left_anti").withColumns({"i": zero, "j": zero}).select(*cols)
        dealt = rows.join(side, "key").withColumn("m", F.ceil(F.col("n") / shard * 1.25).cast("int"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id", "line"), F.col("m")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("m") - 1)))
        dealt = dealt.withColumns({"i": F.greatest("own", "other"), "j": F.least("own", "other")})
        placed = cold.union(dealt.select(*cols))
    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "size", "doc_id", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            g = _Group(cols, threshold)
            x, y = g.forest() if forest else g.one_each()
            pairs = np.column_stack([g.doc[x], g.line[x], g.doc[y], g.line[y]])
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            kinds = (np.int64, np.int32, np.int64, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(pairs.T, kinds, strict=True)], names=PAIR)

        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n < _SCAN:
                continue
            cols = [np.concatenate(c).astype(np.int64, copy=False) for c in zip(*held, strict=True)]
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield work([c[:end] for c in cols])
            held, n = [[c[end:] for c in cols]], 0
        if held:
            cols = [np.concatenate(c).astype(np.int64, copy=False) for c in zip(*held, strict=True)]
            if len(cols[0]):
                yield work(cols)

    out = placed.mapInArrow(run, _PAIRS).distinct()
    out = materialize(out, "sets-pairs")
    discard(hot)
    return out


def all_candidates(first: DataFrame, again: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a set of ``again`` (doc_id, line) and an earlier one that pass, without
    those tried. The rows of ``again`` are broadcast if few; the filters run in the join."""
    mine = materialize(_whole_rows(first.join(few(again), ["doc_id", "line"], "left_semi")), "sets-again")
    x, y = few(mine).alias("x"), _whole_rows(first).alias("y")
    met = y.join(x, (F.col("x.key") == F.col("y.key")) & _earlier() & _passing(threshold) & _heads_pass(threshold))
    out = materialize(_met_pairs(met).join(tried, PAIR, "left_anti"), "sets-pairs")
    discard(mine)
    return out


#: Prefix tokens, the rarest, that a row carries for the filters of a join.
_HEAD = 32


def _whole_rows(first: DataFrame) -> DataFrame:
    """As prefix_rows, with the head of the prefix in each row."""
    rows = first.select("doc_id", "line", "size", "skip", "s0", "s1", F.slice("prefix", 1, _HEAD).alias("head"), F.posexplode("prefix").alias("k", "key"))
    return rows.withColumn("place", F.col("k") + F.col("skip"))


def _passing(threshold: float):
    """The length, positional and bitmap filters for rows x and y."""
    a, b, p, q = (F.col(c) for c in ("x.size", "y.size", "x.place", "y.place"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - 1e-9)
    bits = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    return (F.least(a, b) >= need) & (F.least(a - p, b - q) >= need) & (bits <= a + b - 2 * need)


def _heads_pass(threshold: float):
    """A pair passes at its first shared token only, and if the tokens that either head lacks
    although its order goes past them leave enough."""
    a, b, u, v = (F.col(c) for c in ("x.size", "y.size", "x.head", "y.head"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - 1e-9)

    def lacking(u, v, skip: str):
        return F.size(F.filter(F.array_except(u, v), lambda t: t < F.array_max(v))) + F.col(skip)

    one = F.coalesce(F.array_min(F.array_intersect(u, v)) == F.col("x.key"), F.lit(True))
    return one & (a - lacking(u, v, "x.skip") >= need) & (b - lacking(v, u, "y.skip") >= need)


def candidates_apart(first: DataFrame, failed: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """All pairs that pass and differ in label, among the sets of the prefix tokens that the
    two sets of a failed pair share. ``labels`` has (doc_id, q) where q isn't doc_id itself."""
    keyed = first.select("doc_id", "line", "prefix")
    other = keyed.toDF("doc_id0", "line0", "prefix0")
    ends = [materialize(failed.select(*names).distinct(), "sets-ends") for names in (PAIR[:2], PAIR[2:])]
    here, there = keyed.join(few(ends[0]), PAIR[:2], "left_semi"), other.join(few(ends[1]), PAIR[2:], "left_semi")
    both = failed.join(here, PAIR[:2]).join(there, PAIR[2:])
    keys = materialize(both.select(F.explode(F.array_intersect("prefix", "prefix0")).alias("key")).distinct(), "sets-keys")
    rows = prefix_rows(first).join(few(keys), "key", "left_semi").join(few(labels), "doc_id", "left")
    rows = materialize(rows.withColumn("q", F.coalesce("q", "doc_id")), "sets-again")
    mixed_keys = materialize(rows.groupBy("key").agg(F.min("q").alias("a"), F.max("q").alias("b")).where("a <> b").select("key"), "sets-mixed")
    rows_ = rows.join(few(mixed_keys), "key", "left_semi")
    x, y = rows_.alias("x"), rows_.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.q") != F.col("y.q")) & _earlier() & _passing(threshold))
    out = materialize(_met_pairs(met).join(failed, PAIR, "left_anti"), "sets-pairs")
    discard(*ends, keys, rows, mixed_keys)
    return out


def _earlier():
    x, y = (F.col("x.doc_id"), F.col("x.line")), (F.col("y.doc_id"), F.col("y.line"))
    return (y[0] < x[0]) | ((y[0] == x[0]) & (y[1] < x[1]))


def _met_pairs(met: DataFrame) -> DataFrame:
    return met.select("x.doc_id", "x.line", F.col("y.doc_id").alias("doc_id0"), F.col("y.line").alias("line0")).distinct()


# --- verification ---


def _set_tokens(docs: DataFrame, wanted: DataFrame, read: Reader) -> DataFrame:
    """(doc_id, line, words array<bigint>): all tokens of the sets of ``wanted`` (doc_id,
    lines), from the texts, which aren't shuffled while the documents are few."""
    d = docs.select("doc_id", "text").join(few(wanted, lists="lines"), "doc_id").select("doc_id", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(2)
            for at, x, ends in text_bytes(b.column(1), table=_LOWER):
                text, line, lo, count, h = read(x, ends)
                part = lists.slice(at, len(ends))
                owner = np.repeat(np.arange(len(ends)), np.diff(part.offsets.to_numpy()))
                asked = owner << 32 | part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                k = np.flatnonzero(np.isin(text << 32 | line, asked))
                tokens = [np.unique(h[lo[i] : lo[i] + count[i]]) for i in k.tolist()]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*tokens, np.empty(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + text[k])), pa.array(line[k].astype(np.int32)), words], names=["doc_id", "line", "words"])

    return d.mapInArrow(run, "doc_id bigint, line int, words array<bigint>").dropDuplicates(["doc_id", "line"])


def verified(docs: DataFrame, pairs: DataFrame, read: Reader, threshold: float) -> DataFrame:
    """The pairs whose Jaccard similarity reaches the threshold, as a written table."""
    ends = pairs.select("doc_id", "line").union(pairs.select("doc_id0", "line0"))
    # A list holds at most the lines of one document.
    wanted = materialize(ends.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines")), "sets-wanted")
    words = materialize(_set_tokens(docs, wanted, read), "sets-words")
    first = words.select(F.col("doc_id").alias("doc_id0"), F.col("line").alias("line0"), F.col("words").alias("words0"))
    both = pairs.join(words, ["doc_id", "line"]).join(first, ["doc_id0", "line0"])
    shared = F.size(F.array_intersect("words", "words0"))
    total = F.size("words") + F.size("words0") - shared
    out = materialize(both.where(shared >= F.ceil(threshold * total - 1e-9)).select(*PAIR), "sets-verified")
    discard(wanted, words)
    return out
