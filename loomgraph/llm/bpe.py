"""Byte-level BPE encoding and decoding by speculation and verification.

Words that a batch needs and the cache lacks are resolved together. A greedy longest
match proposes tokens for each. A sequence of tokens is the right encoding exactly if
every adjacent pair is compatible: undoing the merges of both sides from the border
outwards never meets a merge across the border that would have come first. That test
runs as array operations over all pairs of the batch. Words with a failing pair are
merged exactly, step by step.

Defined cases: a null text is encoded as the empty text (no tokens); repeated rows are
encoded alike; an empty table gives an empty result. Special tokens in a text become
their ids, as the file's settings say.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-tokenizer's pattern: fixed values, as the byte-level vocabulary files define it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the younger half of a worker's cache, beyond which it becomes the older half; what the
#: older half still lends moves to the younger, so frequent words stay.
CACHE_WORDS = 100_000
NONE = 1 << 40
#: Words that are merged together.
_MERGED = 4096
#: The same pattern for texts below U+0250, where its classes are short lists of ranges.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else U+0100 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model["ignore_merges"]:
            raise ValueError("only plain byte-level BPE files are read")
        value = {c: b for b, c in enumerate(byte_symbols())}
        vocab = model["vocab"]
        self.ids: dict[bytes, int] = {bytes(value[c] for c in t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with strip, word or normalizer flags aren't read")
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        # Order of a token: bytes first, then by the merge that makes it.
        self.order = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for r, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = (r, z)
            if self.order[z] < 0:
                self.order[z], self.left[z], self.right[z] = r, x, y
        codes = np.array([x * size + y for x, y in self.rank], dtype=np.int64)
        by = np.argsort(codes)
        self.size, self.pair_codes, self.pair_ranks = size, codes[by], np.array([r for r, _ in self.rank.values()], dtype=np.int64)[by]
        self.code_rank = {x * size + y: r for (x, y), (r, _) in self.rank.items()}
        self.made = [vocab[a + b] for a, b in pairs]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.byte_id_array, self.made_array = np.array(self.byte_ids, dtype=np.int64), np.array(self.made, dtype=np.int64)
        longest: dict[int, int] = {}
        for t in self.ids:
            longest[t[0]] = max(longest.get(t[0], 0), len(t))
        self.longest = longest
        self.pattern, self.latin, self.beyond = regex.compile(PATTERN), re.compile(LATIN_PATTERN), re.compile("[^\x00-\u024f]")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def propose(self, word: bytes) -> list[int]:
        out, i, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while i < n:
            j = min(n, i + longest[word[i]])
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: whether no merge across their border comes before the
        merges that make them. Both sides are undone, the later merge first; a merge
        across the border that beats the one just undone refutes the pair. On equal
        ranks the merge to the left happens first."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), dtype=bool)
        # The merge that must come before any merge across the border: rank and side.
        limit = np.full(len(a), NONE, dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            wrong = self.pair_rank(x, y) < limit[live]
            ok[live[wrong]] = False
            live = live[~wrong]
            x, y = a[live], b[live]
            rx, ry = self.order[x], self.order[y]
            done = (rx < 0) & (ry < 0)
            live, x, y, rx, ry = live[~done], x[~done], y[~done], rx[~done], ry[~done]
            # Undo the later merge; of one rank, the right one was made later.
            undo_left = rx > ry
            a[live[undo_left]] = self.right[x[undo_left]]
            limit[live[undo_left]] = rx[undo_left]
            b[live[~undo_left]] = self.left[y[~undo_left]]
            # A merge across the border of the same rank is to the left of this one: it wins.
            limit[live[~undo_left]] = ry[~undo_left] + 1
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact: the lowest-ranked merge, leftmost first, until none is left."""
        ids, ranks, made, size = [self.byte_ids[x] for x in word], self.code_rank, self.made, self.size
        get = ranks.get
        steps = [get(x * size + y, NONE) for x, y in zip(ids, ids[1:], strict=False)]
        while steps and (r := min(steps)) != NONE:
            i = steps.index(r)
            ids[i : i + 2] = [z] = made[r : r + 1]
            del steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] * size + z, NONE)
            if i < len(steps):
                steps[i] = get(z * size + ids[i + 1], NONE)
        return ids

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """As merge(), for many short words at once: a round does the next merge of each."""
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        ids = np.zeros((len(words), width), dtype=np.int64)
        ids[inside] = self.byte_id_array[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full((len(words), width), NONE, dtype=np.int64)
        both = inside[:, 1:]
        ranks[:, :-1][both] = self.pair_rank(ids[:, :-1][both], ids[:, 1:][both])
        live = np.arange(len(words))
        while len(live):
            at = ranks.argmin(axis=1)
            n = np.arange(len(live))
            least = ranks[n, at]
            done = least == NONE
            for k in np.flatnonzero(done).tolist():
                out[live[k]] = ids[k, : sizes[k]].astype("<u4")
            go = ~done
            live, ids, ranks, sizes, at, least = live[go], ids[go], ranks[go], sizes[go], at[go], least[go]
            if not len(live):
                break
            # The tail moves one place to the left over the right half of the merged pair.
            tail = np.arange(width - 1) > at[:, None]
            ids[:, :-1] = np.where(tail, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(tail | (np.arange(width - 1) == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            sizes -= 1
            n = np.arange(len(live))
            ids[n, at] = self.made_array[least]
            ranks[n, at] = NONE
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < sizes)
            ranks[left, at[left] - 1] = self.pair_rank(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self.pair_rank(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """As merge(), with a heap, for long words."""
        import heapq

        n = len(word)
        ids = [self.ids[word[i : i + 1]] for i in range(n)]
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = rank[x, y][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in rank:
                heapq.heappush(heap, (rank[p][0], h, *p))
        return [x for x in ids if x >= 0]

    def resolve(self, words: list[str]) -> None:
        """Put the encodings of new words into the cache."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(sizes.sum()))
        ends = np.cumsum(sizes)
        inside = np.ones(len(flat), dtype=bool)
        inside[ends - 1] = False  # the last token of a word has no partner
        first = np.flatnonzero(inside)
        owner = np.repeat(np.arange(len(words)), sizes)
        codes, back = np.unique(flat[first] * self.size + flat[first + 1], return_inverse=True)
        ok = self.compatible(codes // self.size, codes % self.size)[back]
        failed = set(owner[first[~ok]].tolist())
        # Words of about one length merge together.
        short = sorted((k for k in failed if len(raw[k]) < 64), key=lambda k: len(raw[k]))
        for lo in range(0, len(short), _MERGED):
            part = short[lo : lo + _MERGED]
            for k, exact in zip(part, self.merge_all([raw[k] for k in part]), strict=True):
                self.cache[words[k]] = exact.tobytes()
        data, starts = flat.astype("<u4"), ends - sizes
        for k, w in enumerate(words):
            if k in failed:
                if len(raw[k]) >= 64:
                    self.cache[w] = np.array(self.merge_long(raw[k]), dtype="<u4").tobytes()
            else:
                self.cache[w] = data[starts[k] : ends[k]].tobytes()

    def forget(self) -> None:
        """Give back the memory of the cache: a worker that stays alive holds it beside later stages."""
        self.cache, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list] = []
        for t in texts:
            find = (self.pattern if self.beyond.search(t) else self.latin).findall
            if self.split and any(s in t for s in self.special):
                pieces = self.split.split(t)
                parts.append([x for k, p in enumerate(pieces) for x in ([self.special[p]] if k % 2 else find(p))])
            else:
                parts.append(find(t))
        new: set[str] = set()
        for p in parts:
            new.update(x for x in set(p) if x.__class__ is str)
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, lent = self.cache, self.older.pop
        missing = []
        for w in new:
            if w not in cache:
                if (x := lent(w, None)) is None:
                    missing.append(w)
                else:
                    cache[w] = x
        if missing:
            self.resolve(missing)
        get, out = self.cache.__getitem__, []
        for p in parts:
            try:
                out.append(b"".join(map(get, p)))
            except KeyError:
                out.append(b"".join(get(x) if x.__class__ is str else x.to_bytes(4, "little") for x in p))
        return out

    def decode(self, ids: bytes) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One tokenizer a worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with about so many characters, so that a batch of long ones is bounded."""
    start = total = 0
    run: list[str] = []
    for k, t in enumerate(texts):
        run.append(t or "")
        total += len(run[-1])
        if total >= chars:
            yield start, run
            start, run, total = k + 1, [], 0
    if run:
        yield start, run


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every document; the general form, for writing token files."""
    d = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys = batch.column(0)
            for start, texts in _slices(batch.column(1).to_pylist()):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode(texts)]
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])
        bpe.forget()

    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); null ids give the empty text."""
    d = tokens.select(key, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode, in one pass: doc_id, n_tokens and digests of ids and text."""
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys = batch.column(0)
            for start, texts in _slices(batch.column(1).to_pylist()):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(start, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return d.mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
