"""Token ids in binary files of patched frame-of-reference blocks, and their readers.

A file holds whole documents in order: their ids, their token counts, then blocks of 1,024
token ids over all of them. Of a block the minimum is subtracted; what is left is packed
with as many bits as nine of ten values need; the others, with their places, stand in the
block's exception list. An index of block starts lets a reader decode any range alone.

Documents are encoded where they are; only ids are shuffled, two bytes each where the
vocabulary allows, into ranges of doc_id cut at the quantiles of the whole column. A null
or repeated doc_id that spans several ranges is split over them by a hash of its text. A
task sorts one range and streams it into files of bounded size. The files of failed or
repeated attempts stay out of the manifest, a table that Spark commits; readers take
only files that the manifest names. Files are read by Spark's binaryFile source. Positions
over all files come from one sum for each range, which is all that is broadcast.

Defined cases: a null text is the empty text; rows with a null doc_id come first; equal
doc_ids are ordered by a hash of their texts; a doc_id must be an integer; an empty table
gives no files and no rows; one document is never cut, so a longer one than a file's
bound has a larger file; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import few, materialize, shared_dir

END_ID = 1
#: Ids in a block, the share of a block's values that its width must hold, ids in a file, bytes of text in a range.
BLOCK, SHARE, FILE_IDS, RANGE_BYTES = 1024, 0.9, 1 << 22, 16 << 20
MAGIC, HEAD = b"PFR1", struct.Struct("<4sIQQQ")

# --- encoding ---

#: What the vocabulary files of this kind say: fixed values.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The same split below U+0180, where NFC changes nothing and lower case stays below U+0180.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: What keeps a run between spaces from being split that way, and what the two kinds of white space differ in.
BEYOND, SEPARATORS = re.compile("[^\0-įı-ſ]"), "\x1c\x1d\x1e\x1f"
#: Runs that a worker's cache holds twice over at most, and their length.
CACHE_WORDS, CACHE_CHARS = 300_000, 40


class Recent(dict):
    """Values made once for recent keys: a full cache becomes the old one, which is asked before
    a value is made again, so that frequent keys stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Words:
    """Ids, as bytes, of texts by their runs between white space, which no token crosses."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        same = normal.get("normalizers") == NORMAL and pre.get("pretokenizers") == [SPLIT, BYTES]
        self.plain = same and not spec["post_processor"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.marked = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        self.tokenize = self.library.model.tokenize
        self.symbols = dict(enumerate(byte_symbols()))
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind, code = ("<u4", "I") if self.wide else ("<u2", "H")
        self.code, self.packs = code, [struct.Struct(f"<{n}{code}").pack for n in range(24)]
        self.runs = Recent(self.run)

    def raw(self, ids: list[int]) -> bytes:
        n = len(ids)
        return self.packs[n](*ids) if n < 24 else struct.pack(f"<{n}{self.code}", *ids)

    def whole(self, text: str) -> bytes:
        return self.raw(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        """A letter run, digit or symbol run, below U+0180 and in lower case."""
        text = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.symbols)
        return self.raw([t.id for t in self.tokenize(text)])

    def run(self, text: str) -> bytes:
        if not text.isascii() and BEYOND.search(text):
            return self.whole(text)
        if text.isalpha():
            return self.piece(text.lower())
        if (word := text[:-1]).isalpha():  # a word and a mark or digit after it
            return self.runs[word.lower()] + self.runs[text[-1]]
        if self.marked(text):
            return self.whole(text)
        found = PIECES.findall(text.lower())
        return self.piece(found[0]) if len(found) == 1 else b"".join(map(self.runs.__getitem__, found))

    def encode(self, text: str) -> bytes:
        if not self.plain or any(c in text for c in SEPARATORS):
            return self.whole(text)
        if "<|" not in text and (text.isascii() or _latin(text)):
            text = text.lower()
        return b"".join(map(self.runs.__getitem__, text.split()))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_LOADED: dict[str, Words] = {}


def words(path: str) -> Words:
    """One encoder a worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, end_id: int | None = END_ID, ranges: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, hash, wide, range, ids): ids of every text as the library gives them without special
    tokens, then ``end_id``, as little-endian integers of two bytes, or four if ``wide``. hash
    tells texts apart; range is the document's place among ``ranges``, as _ranges gives them."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError("token files number documents: doc_id must be an integer")
    nulls, bounds = ranges or (0, np.empty(0, dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")

    def place(doc_ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        known, ids, limits = doc_ids.is_valid().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy(), shared.value
        first, after = np.searchsorted(limits, ids, side="left"), np.searchsorted(limits, ids, side="right")
        share = np.where(known, np.maximum(after - first, 1), max(nulls, 1))
        part = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        step = np.minimum((part * share).astype(np.int64), share - 1)
        return np.where(known, nulls + first + step, step).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        last = b"" if end_id is None else known.raw([end_id])
        for batch in batches:
            to = place(batch.column(0), batch.column(1))
            at, n = 0, batch.num_rows
            while at < n:  # some MB of text at a time
                chars, out, begin = 0, [], at
                while at < n and chars < 4_000_000:
                    text = batch.column(2)[at].as_py() or ""
                    out.append(known.encode(text) + last)
                    chars += len(text)
                    at += 1
                part = [c.slice(begin, at - begin) for c in batch.columns[:2]]
                columns = [*part, pa.array([known.wide] * (at - begin)), pa.array(to[begin:at]), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "wide", "range", "ids"])

    return d.mapInArrow(run, "doc_id bigint, hash bigint, wide boolean, range int, ids binary")


# --- the file format ---


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned integers, each with ``width`` bits, as rows of bytes."""
    if not width:
        return np.zeros((len(values), 0), dtype=np.uint8)
    to = "<u2" if width <= 16 else "<u4"
    bits = np.unpackbits(values.astype(to).view(np.uint8).reshape(len(values), -1, np.dtype(to).itemsize), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` values of each row of bytes."""
    if not width:
        return np.zeros((len(packed), n), dtype=np.uint32)
    kind, reach = (np.uint32, 3) if width <= 16 else (np.uint64, 5)
    at = np.arange(n) * width
    padded = np.pad(packed, ((0, 0), (0, reach)))
    out = np.zeros((len(packed), n), dtype=kind)
    for k in range(reach):
        out |= padded[:, (at >> 3) + k].astype(kind) << kind(8 * k)
    return (out >> (at & 7).astype(kind) & kind((1 << width) - 1)).astype(np.uint32)


BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("each", "u1"), ("exceptions", "<u2")])


def pack_blocks(ids: np.ndarray, block: int = BLOCK, share: float = SHARE) -> tuple[bytes, np.ndarray]:
    """(bytes of the blocks, starts of each and the end) of unsigned 32-bit integers. A block: head
    (minimum, width, bytes of an exception's value, number of exceptions), the low bits of all
    values, then its exceptions: how many values each passes over, a byte each, and what each
    has beyond the width. An exception stands at least in every 256th place, if there are any."""
    n = len(ids)
    count = -(-n // block)
    out: list[bytes] = []
    for lo in range(0, count, 128):  # a few hundred KB at a time
        part = ids[lo * block : (lo + 128) * block]
        rows = -(-len(part) // block)
        full = np.pad(part, (0, rows * block - len(part)), mode="edge").reshape(rows, block)
        least = full.min(axis=1)
        rest = full - least[:, None]
        bits = np.frexp(rest.astype(np.float32 if rest.max() < 1 << 24 else np.float64))[1].astype(np.uint8)
        at = max(0, math.ceil(share * block) - 1)
        width = np.partition(bits, at, axis=1)[:, at]
        each = np.array([0, 1, 2, 4, 4], dtype=np.uint8)[-(-(bits.max(axis=1) - width).astype(np.int64) // 8)]
        outside = bits > width[:, None]
        outside[:, 255::255] |= outside.any(axis=1)[:, None]
        row, place = np.nonzero(outside)
        gap = place - 1 - np.where(np.append(True, row[1:] != row[:-1])[: len(row)], -1, np.roll(place, 1))
        gap, high = gap.astype(np.uint8), rest[row, place] >> width[row].astype(np.uint32)
        ends = np.searchsorted(row, np.arange(rows + 1))
        low: list[bytes] = [b""] * rows
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            for k, raw in zip(of, _pack(rest[of] & np.uint32((1 << int(w)) - 1), int(w)), strict=True):
                low[k] = raw.tobytes()
        heads = np.empty(rows, dtype=BLOCK_HEAD)
        heads["least"], heads["width"], heads["each"], heads["exceptions"] = least, width, each, np.diff(ends)
        kept = {e: high.astype(f"<u{e}") for e in np.unique(each).tolist() if e}
        for k in range(rows):
            more = slice(ends[k], ends[k + 1])
            out.append(heads[k].tobytes() + low[k] + (gap[more].tobytes() + kept[int(each[k])][more].tobytes() if each[k] else b""))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype("<u8")
    return b"".join(out), starts


def unpack_blocks(data: bytes | memoryview, starts: np.ndarray, block: int) -> np.ndarray:
    """The ids of the blocks that begin at ``starts``, the last of which is their end."""
    raw, rows = np.frombuffer(data, dtype=np.uint8), len(starts) - 1
    out = np.empty((rows, block), dtype=np.uint32)
    begins = starts[:-1].astype(np.int64)
    size = BLOCK_HEAD.itemsize
    heads = raw[begins[:, None] + np.arange(size)].copy().view(BLOCK_HEAD)[:, 0] if rows else np.empty(0, BLOCK_HEAD)
    for w in np.unique(heads["width"]):
        for some in np.array_split(of := np.flatnonzero(heads["width"] == w), -(-len(of) // 128)):
            packed = raw[begins[some, None] + size + np.arange(-(-block * int(w) // 8))]
            out[some] = _unpack(packed, int(w), block)
    after = begins + size + -(-block * heads["width"].astype(np.int64) // 8)
    for each in np.unique(heads["each"]):
        of = np.flatnonzero((heads["each"] == each) & (heads["exceptions"] > 0))
        n = heads["exceptions"][of].astype(np.int64)
        if not len(of) or not each:
            continue
        first = np.cumsum(n) - n
        order = np.arange(n.sum()) - np.repeat(first, n)
        passed = np.cumsum(raw[np.repeat(after[of], n) + order].astype(np.int64) + 1)
        place = passed - np.repeat(np.concatenate([[0], passed[first[1:] - 1]]), n) - 1
        at = np.repeat(after[of] + n, n) + order * int(each)
        high = np.zeros(len(at), dtype=np.uint32)
        for k in range(int(each)):
            high |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
        row = np.repeat(of, n)
        out[row, place] |= high << heads["width"][row].astype(np.uint32)
    out += heads["least"][:, None]
    return out.reshape(-1)


def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, start: int, block: int = BLOCK) -> bytes:
    """A whole file: header, doc ids, their nulls, token counts, block starts, blocks.
    ``start`` is the number of ids in the same range's files before it."""
    blocks, starts = pack_blocks(ids, block)
    known = np.array([x is not None for x in doc_ids], dtype=bool)
    numbers = np.array([x or 0 for x in doc_ids], dtype="<i8")
    head = HEAD.pack(MAGIC, block, len(doc_ids), len(ids), start)
    return b"".join([head, numbers.tobytes(), np.packbits(known).tobytes(), np.array(counts, dtype="<u8").tobytes(), starts.tobytes(), blocks])


class TokenFile:
    """A file's documents and ids. Only the blocks that are asked for are decoded."""

    def __init__(self, data: bytes):
        magic, self.block, docs, self.n_ids, self.start = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        numbers = np.frombuffer(data, dtype="<i8", count=docs, offset=at)
        at += 8 * docs
        known = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-docs // 8), offset=at), count=docs).astype(bool)
        at += -(-docs // 8)
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        self.ends = np.cumsum(np.frombuffer(data, dtype="<u8", count=docs, offset=at).astype(np.int64))
        at += 8 * docs
        count = -(-self.n_ids // self.block)
        self.starts = np.frombuffer(data, dtype="<u8", count=count + 1, offset=at)
        self.data = memoryview(data)[at + 8 * (count + 1) :]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo .. hi - 1 of this file."""
        hi = min(hi, self.n_ids)
        if lo >= hi:
            return np.empty(0, dtype=np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        found = unpack_blocks(self.data, self.starts[first : last + 2], self.block)
        return found[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# --- writing and reading with Spark ---


def _ranges(docs: DataFrame, range_bytes: int) -> tuple[int, np.ndarray]:
    """(ranges for null doc_ids, upper bounds of the others but the last): about ``range_bytes``
    of text in each. Counts and quantiles are those of the whole table."""
    n, known, size = docs.agg(F.count("*"), F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil((size or 0) / range_bytes))
    nulls = math.ceil(parts * (n - known) / n) if n else 0
    if parts == 1 or not known:
        return nulls, np.empty(0, dtype=np.int64)
    shares = [k / parts for k in range(1, parts)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 10 * parts))).first()[0]
    return nulls, np.array(bounds, dtype=np.int64)


def in_ranges(encoded: DataFrame, parts: int) -> DataFrame:
    """Encoded documents in the partition of their range, and sorted there."""
    return encoded.repartitionById(parts, F.col("range")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/tokens-{uuid.uuid4().hex}"


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = END_ID, file_ids: int = FILE_IDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write every document's ids into files in ``folder``, in ascending doc_id order; return the
    manifest (range, name, start, n_docs, n_ids, n_bytes), a written table."""
    nulls, bounds = _ranges(docs, range_bytes)
    placed = in_ranges(encode_documents(docs, path, end_id, (nulls, bounds)), nulls + len(bounds) + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        done = 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        at = 0

        def flush() -> pa.RecordBatch:
            nonlocal done
            ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
            data = file_bytes(doc_ids, [len(p) for p in parts], ids, done)
            name = f"{at:08d}-{done:016d}-{uuid.uuid4().hex}.tokens"
            with store.open_output_stream(f"{top}/{name}") as f:
                f.write(data)
            row = [[at], [name], [done], [len(doc_ids)], [len(ids)], [len(data)]]
            done += len(ids)
            doc_ids.clear()
            parts.clear()
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["range", "name", "start", "n_docs", "n_ids", "n_bytes"])

        held = 0
        for batch in batches:
            columns = (batch.column(c) for c in ("range", "doc_id", "wide", "ids"))
            for to, i, wide, raw in zip(*columns, strict=True):
                at = to.as_py()
                found = np.frombuffer(raw.as_buffer(), dtype="<u4" if wide.as_py() else "<u2").astype(np.uint32)
                if held and held + len(found) > file_ids:
                    yield flush()
                    held = 0
                doc_ids.append(i.as_py())
                parts.append(found)
                held += len(found)
        if doc_ids:
            yield flush()

    return materialize(placed.mapInArrow(write, "range int, name string, start bigint, n_docs bigint, n_ids bigint, n_bytes bigint"), "token-manifest")


def _files(manifest: DataFrame, folder: str) -> DataFrame:
    """(base, content) of the files that the manifest names; base: ids in the ranges before."""
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("base"))
    named = manifest.select("range", "name").join(F.broadcast(bases), "range").select("name", "base")
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], "base bigint, content binary")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    return there.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(few(named), "name").select("base", "content")


def _documents(kind: pa.DataType, value):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0), batch.column(1), strict=True):
                file = TokenFile(content.as_buffer())
                n = len(file.doc_ids)
                begins = np.concatenate([[0], file.ends[:-1]]).astype(np.int64)
                lo = 0
                while lo < n:  # runs of documents, so that a large file isn't decoded at once
                    hi = max(lo + 1, int(np.searchsorted(file.ends, begins[lo] + (1 << 20), side="right")))
                    ids = file.ids(int(begins[lo]), int(file.ends[hi - 1]))
                    own = np.split(ids, begins[lo + 1 : hi] - begins[lo])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[lo:hi], pa.int64()), pa.array(base.as_py() + file.start + begins[lo:hi]),
                            pa.array(file.ends[lo:hi] - begins[lo:hi]), pa.array([value(x) for x in own], kind),
                        ], names=["doc_id", "start", "n_tokens", "value"],
                    )
                    lo = hi

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<bigint>) of every document; start: ids of all before."""
    run = _documents(pa.list_(pa.int64()), lambda ids: ids.astype(np.int64))
    return _files(manifest, folder).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, value array<bigint>").withColumnRenamed("value", "ids")


def token_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    run = _documents(pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    return _files(manifest, folder).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, value bigint").withColumnRenamed("value", "ids_crc32")
