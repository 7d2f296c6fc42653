"""Token files against the tokenizers library, and exact round trips."""

import os
import random
import zlib

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import registry, token_files

from ..conftest import DATA

PATH = registry.tokenizer_path("word_bpe_49k.json")


def brute(rows):
    """(doc_id, start, n_tokens, crc) by the library, rows in order."""
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_words_against_the_library():
    library, known = Tokenizer.from_file(PATH), token_files.words(PATH)
    rng = random.Random(1)
    chars = [chr(c) for c in range(0x180)] + list("İŉǅ́ͅ 　中文\U0001f600ﬁÅẞΣσ")
    texts = ["", " ", "it's THE end's 'll 12345 a1b2", "<|endoftext|>A <|startoftext|><|ENDOFTEXT|>", "é École", "a\x1cb", "\x00\x7f\x85\xa0", "STRASSE ẞ ΣΣ", "x" * 5000]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("ab'STLDMVE r3.É\n") for _ in range(40)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(known.encode(t), dtype="<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert known.plain and not token_files.words(registry.tokenizer_path()).plain


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 5)
    known, library = token_files.Words(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"w{k}x{'y' * (k % 80)}" for k in range(200))
    assert np.frombuffer(known.encode(text), dtype="<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    cache = known.runs
    assert len(cache) <= 5 and len(cache.old) <= 5 and max(map(len, cache)) <= token_files.CACHE_CHARS


@pytest.mark.parametrize("n", [0, 1, 7, 1024, 1025, 140_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), rng.zipf(1.3, n) % (1 << 32), np.full(n, (1 << 32) - 1), np.where(rng.random(n) < 0.05, 1 << 31, 7)):
        ids = ids.astype(np.uint32)
        data, starts = token_files.pack_blocks(ids)
        assert len(starts) == -(-n // token_files.BLOCK) + 1 and int(starts[-1]) == len(data)
        assert (token_files.unpack_blocks(data, starts, token_files.BLOCK)[:n] == ids).all()


def test_a_rare_large_value_is_an_exception():
    ids = np.full(1024, 5, dtype=np.uint32)
    ids[100] = 1 << 30
    data, _ = token_files.pack_blocks(ids)
    assert len(data) == 8 + 5 * (1 + 4)  # head, no bits for the others, one exception and four that break its way
    zipf = np.minimum(np.random.default_rng(1).zipf(1.4, 1 << 16), 49_407).astype(np.uint32)
    assert len(token_files.pack_blocks(zipf)[0]) < 0.7 * len(token_files.pack_blocks(zipf, share=1.0)[0])


def test_file_and_ranges():
    rng = np.random.default_rng(2)
    counts = [0, 5000, 1, 3000, 0]
    ids = rng.integers(0, 49_408, sum(counts)).astype(np.uint32)
    file = token_files.TokenFile(token_files.file_bytes([None, -5, 3, 3, 9], counts, ids, 77))
    assert file.doc_ids == [None, -5, 3, 3, 9] and file.start == 77
    assert [len(file.document(k)) for k in range(5)] == counts and (file.document(3) == ids[5001:8001]).all()
    for lo, hi in ((0, 1), (1023, 1025), (4000, 9999), (8000, 8001), (5, 5)):
        assert (file.ids(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(ValueError):
        token_files.TokenFile(b"\0" * 64)


def test_query_against_the_library(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in registry.op12_token_files(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute(rows)


def test_many_ranges_files_nulls_and_hot_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdeÉ.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice([None, 7, 7, 7, k]), rng.choice([text(), text(), None, "same"])) for k in range(400)]
    docs = spark.createDataFrame([(i, t, 3, "r") for i, t in rows], "doc_id int, text string, range int, name string").repartition(5)
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(docs, PATH, folder, file_ids=700, range_bytes=3000)
    assert manifest.count() > manifest.select("range").distinct().count() > 5
    sizes = [(r.n_docs, r.n_ids) for r in manifest.collect()]
    assert all(n <= 700 or docs_ == 1 for docs_, n in sizes) and sum(d for d, _ in sizes) == 400
    found = [tuple(r) for r in token_files.token_digests(manifest, folder).collect()]
    found.sort(key=lambda r: r[1])
    known = [i for i, *_ in found]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0))
    starts = np.cumsum([0, *[n for _, _, n, _ in found]])
    assert [r[1] for r in found] == starts[:-1].tolist()
    assert sorted(((i, n, c) for i, _, n, c in found), key=repr) == sorted(((i, n, c) for i, _, n, c in brute(rows)), key=repr)
    ids = {r.start: r.ids for r in token_files.read_token_files(manifest, folder).collect()}
    assert all(zlib.crc32(np.array(ids[s], dtype="<u4").tobytes()) == c and len(ids[s]) == n for _, s, n, c in found)
    assert spark.read.format("binaryFile").load(folder).count() == len(sizes)


def test_files_that_the_manifest_lacks_are_not_read(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(docs, PATH, folder)
    again = token_files.write_token_files(docs, PATH, folder)
    assert sorted(map(tuple, token_files.token_digests(manifest, folder).collect())) == brute([(1, "a b"), (2, "c")]) == sorted(map(tuple, token_files.token_digests(again, folder).collect()))


def test_no_documents_and_wrong_ids(spark):
    folder = token_files.new_folder(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_digests(token_files.write_token_files(docs, PATH, folder), folder).count() == 0
    with pytest.raises(TypeError):
        token_files.encode_documents(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)
