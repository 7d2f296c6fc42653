"""The training-data operators against SQL twins, brute force and the tokenizers library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat_template, decontaminate, html_text, language_id, line_dedup, quality_rules, registry, simhash, suffix_dedup, url_filters

from ..conftest import DATA

DOC = "doc_id long, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    return [*rows, (5000, None), (5001, ""), (5002, " \n\t "), (5003, "A b"), (5004, "x " * 3000), (5005, "de la " * 50)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


# --- URL filters ---


def test_urls_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, 0), (2, "no scheme", 0), (3, "http://A.Example.NET/en/x?q#f", 0), (4, "http://example.net", 0), (5, "http://xnet/", 0), (6, "http://bad.org/a.html?utm_x=1", 0), (6, "http://bad.org/a", 0)],
        "page_id long, url string, verdict int",
    )
    listed = spark.createDataFrame([("bad.org/a",), ("bad.org/a",), (None,)], "canon string")
    rows = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, listed).collect())
    assert rows == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (4, "example.net", "", None, "allow"), (5, "xnet", "/", None, "allow"), (6, "bad.org", "/a", None, "block"), (6, "bad.org", "/a.html", None, "block"),
    ]
    shuffled = url_filters.filter_urls(pages, listed, broadcast_bytes=0)
    assert sorted((r.page_id, r.verdict) for r in shuffled.collect()) == sorted((r[0], r[4]) for r in rows)
    assert url_filters.filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


# --- chat formatting ---


def test_template_language():
    run = lambda s, **env: "".join(p for p in chat_template.compile_template(s)(env) if isinstance(p, str))
    assert run("a{{ 'b' + 'c' }}{% if x == 'y' %}1{% elif not x %}2{% else %}3{% endif %}", x="y") == "abc1"
    assert run("{% for m in ms %}{{ loop.index }}{{ m.role | upper }}{% endfor %}", ms=iter([{"role": "u"}, {"role": "v"}])) == "0U1V"
    assert chat_template.parse("{% if 'a' == 'a' %}x{% endif %}y{{ 'z' }}") == [("text", "xyz")]
    for bad in ("{{ a.__class__ }}", "{{ f(1) }}", "{% if x %}", "{{ x | system }}", "{% include 'x' %}", "{{ }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)
    for text in ("<|im_end|>", "\\", "<\\|", "a\\n<|<|", "<<||"):
        assert chat_template.unescape(chat_template.escape(text)) == text and "<|" not in chat_template.escape(text)


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, 0, None, None, 1), (1, 1, "assistant", "<|im_end|>\n", 2), (None, 0, "us\ner", "x\\", 3), (2, 1, "assistant", "b", 4), (2, 0, "assistant", "a", 5)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_template.conversation_digests(chat_template.format_conversations(rows)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 11
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\n<|im_end|>\n\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"us\ner\nx\\\n").hexdigest()
    assert chat_template.format_conversations(rows.limit(0)).count() == 0


# --- BPE ---


def test_bpe_is_the_library(spark, sample):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = "abcdefghij thé ñç \n\t\r'<|>ABC0123½²日本　\x85\x1c\x1f\xa0😀é ſʼªɏɐ"
    texts = [t or "" for _, t in sample] + ["".join(rng.choice(alphabet) for _ in range(200)) for _ in range(200)]
    texts += ["a<|endoftext|>b <|endoftext|>", " " * 300 + "q", "ing" * 90, "!?" * 500]
    mine = bpe.tokenizer(path)
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False) == t
    d = docs_of(spark, sample)
    back = bpe.decode_documents(bpe.encode_documents(d, path), path)
    assert {tuple(r) for r in back.collect()} == {(i, t or "") for i, t in sample}
    assert bpe.round_trip(d, path).count() == len(sample)


def test_every_token_encodes_to_itself():
    b = bpe.tokenizer(registry.tokenizer_path())
    whole = [(t, i) for t, i in b.ids.items()]
    assert all((b.merge(t) if len(t) < 64 else b.merge_long(t)) == [i] for t, i in whole[::7])


# --- SimHash ---


def brute_fingerprint(text, size=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(keys, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark, sample):
    rows = sample + [(6000 + k, (sample[0][1] or "") + " x" * (k % 3)) for k in range(9)]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    want = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    for shard in (4096, 3):
        got = simhash.near_duplicates(docs_of(spark, rows), shard=shard).withColumn("h", simhash.hex_fingerprint("fp")).collect()
        assert {r.doc_id: (r.h, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    kept = {r.doc_id for r in simhash.keep_first(docs_of(spark, rows), size=4).collect()}
    assert kept == set(want.values())
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_bucket_tables_miss_nothing():
    rng = random.Random(5)
    masks = [m & (1 << 64) - 1 for m in simhash.bucket_masks()]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)
    members = np.array([rng.getrandbits(12) - (rng.getrandbits(1) << 63) for _ in range(400)], dtype=np.int64)
    members = np.unique(members)
    edges = simhash.spanning_edges(members, np.arange(len(members)))
    want = components(range(len(members)), lambda a, b: ((int(members[a]) ^ int(members[b])) & (1 << 64) - 1).bit_count() <= 4)
    assert len(edges) == len(members) - len(set(want.values()))


def test_stage_finds_all_similar_documents(spark):
    import corpus_pipeline
    from loomgraph.llm import similar_docs

    rng = random.Random(8)
    bases = [[rng.choice("abcdefghijklmnopqrst") + str(rng.randint(0, 60)) for _ in range(n)] for n in (6, 30, 120, 300)]
    rows = [(5000, None), (5001, " "), (5002, "a b"), (5003, "B  c"), (5004, "A\nb")]
    for k in range(160):
        w = list(bases[k % 4])
        for _ in range(rng.randint(0, 1 + len(w) // 40)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 3)}"
        rows.append((rng.randint(0, 9) * 1000 + k + 10, " ".join(w)))
    # A chain: the first two are only similar to the third.
    base = [f"v{k}" for k in range(104)]
    rows += [(20000, " ".join(base[:-14])), (20001, " ".join(base[14:])), (20002, " ".join(base))]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}

    sets = {i: shingles(t) for i, t in rows}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert not near(20000, 20001) and near(20000, 20002) and near(20001, 20002)
    want = set(components(sorted(sets), near).values())
    fp = {i: brute_fingerprint(t, 5) for i, t in rows}
    assert any(near(a, b) and (fp[a] ^ fp[b]).bit_count() > 4 for a, b in itertools.combinations(sorted(sets), 2))
    d = docs_of(spark, rows)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, DATA).collect()} == want
    assert {r.doc_id for r in similar_docs.keep_first(d, shard=5, buckets=64).collect()} == want
    assert similar_docs.keep_first(d.limit(0)).count() == 0


# --- HTML ---


def test_html():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div>"
        "<article><h1>Head</h1><p>One &amp; two<br>three\n four</p><p>No.</p><div class=comments>Nice!</div><p>End</article><footer>&copy;</footer>"
    )
    assert html_text.main_text(page) == "Head\nOne & two\nthree four\nNo.\nEnd"
    plain = "<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div id=sidebar>About us and more</div>" + "<p>" + "word " * 40 + "</p><p>Short.</p><p>" + "text " * 30 + "</p><form>Name</form></body>"
    assert html_text.main_text(plain) == ("word " * 40).strip() + "\nShort.\n" + ("text " * 30).strip()
    assert [html_text.main_text(x) for x in (None, "", "<p", "<!-- x", "<script>never ends")] == ["", "", "<p", "", ""]


# --- byte strings ---


def brute_suffix(rows, length):
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        runs = sum(1 for k in range(len(hit)) if hit[k] and (k == 0 or not hit[k - 1]))
        want[i] = (len(b), sum(hit), runs, hashlib.sha256(bytes(c for c, f in zip(b, hit, strict=True) if not f)).hexdigest())
    return want


def test_suffix_dedup(spark, sample):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = sample + [(9000 + i, base[rng.randint(0, 150) : rng.randint(200, 400)] + "".join(rng.choice("xyz") for _ in range(30)) + base[50:220]) for i in range(40)]
    rows += [(9100, "a" * 1000), (9101, "ab" * 300), (9102, "abcabc" * 90), (9103, "x" * 99)]
    want = brute_suffix(rows, 100)
    for shard in (4096, 3):
        got = suffix_dedup.judge_substrings(docs_of(spark, rows).repartition(3), shard=shard).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.judge_substrings(docs_of(spark, rows).limit(0)).count() == 0


def test_merged_transforms_are_sorted():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    found = {tuple(x) for x in suffix_dedup.repeated_windows(strings, 5, shard_bytes=60).tolist()}
    seen, want = set(), set()
    for k, s in enumerate(strings):
        for o in range(len(s) - 4):
            if s[o : o + 5] in seen:
                want.add((k, o))
            seen.add(s[o : o + 5])
    assert found == want


@pytest.mark.parametrize("offset", range(69))
def test_no_place_of_the_gram_in_a_window_is_missed(offset):
    rng = random.Random(offset)
    window = bytes(rng.randrange(97, 123) for _ in range(100))
    strings = [bytes(rng.randrange(65, 91) for _ in range(n)) + window + bytes(rng.randrange(65, 91) for _ in range(m)) for n, m in ((0, 0), (3, 5), (1, 0))]
    key = suffix_dedup._gram_hashes(np.frombuffer(window[offset : offset + 32], dtype=np.uint8), 32).view(np.int64)[0]
    assert suffix_dedup.may_repeat([key] * 3, strings, 100).all()
    assert not suffix_dedup.may_repeat([key] * 2, [strings[0], window[offset : offset + 32] * 4], 100)[0]


# --- language ---


def test_language(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    d = d.union(spark.createDataFrame([(9000, None, "en"), (9001, "123 !?", "en")], d.schema))
    rows = language_id.identify(d, language_id.train(d)).collect()
    lang = {r.doc_id: r.lang for r in d.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in rows if r.doc_id >= 9000} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    none = language_id.identify(d, language_id.train(d.withColumn("lang", F.lit(None).cast("string"))))
    assert none.where("lang_pred <> 'und'").count() == 0


def test_forward_backward_in_blocks():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 3, 700, 256, 257, 513, 2])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    t, s = rng.normal(size=(3, 3)), rng.normal(size=3)
    want, _ = language_id.forward_backward(scores, sizes, t, s)
    assert np.allclose(want, language_id.forward_backward_posterior(scores, sizes, t, s))


# --- lines ---


def test_lines(spark, sample):
    rows = sample + [(7000, "one two three four five six seven eight nine ten\nshort line"), (7001, "one two three four five six seven eight nine ELEVEN ten\nshort line")]
    lines = [(i, k, frozenset(x.encode().lower().split())) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5]
    by_word, want = defaultdict(list), set()
    for n, (i, k, s) in enumerate(lines):
        shared = Counter(m for w in s for m in by_word[w])
        if any(c >= 0.8 * (len(s) + len(lines[m][2]) - c) - 1e-9 for m, c in shared.items()):
            want.add((i, k))
        for w in s:
            by_word[w].append(n)
    for options in ({}, {"shard": 5, "buckets": 64}):
        assert {tuple(r) for r in line_dedup.repeated_lines(docs_of(spark, rows), **options).collect()} == want
    assert (7001, 0) in want
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert kept[7001] == "short line" and kept[5000] is None and len(kept) == len(rows)
    assert line_dedup.judge_lines(docs_of(spark, rows).limit(0)).count() == 0


def test_short_lines(spark, sample):
    rows = sample + [(7000, "Menu\n\nread more\na b c d e\nq r s t\nk l m"), (7001, "menu\n\nmore Read\na b c d\nq r s t v\nk l\nx x x x x x"), (7002, "x\nk l m n")]
    seen, want = [], set()
    for i, t in sorted((i, t or "") for i, t in rows):
        for k, x in enumerate(t.split("\n")):
            s = frozenset(x.encode().lower().split())
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                want.add((i, k))
            if s:
                seen.append(s)
    assert {x for x in want if x[0] > 7000} == {(7001, 0), (7001, 2), (7001, 3), (7001, 4), (7001, 6), (7002, 0)}
    for options in ({}, {"shard": 5, "buckets": 64}):
        assert {tuple(r) for r in line_dedup.repeated_lines(docs_of(spark, rows), min_words=1, **options).collect()} == want
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows), min_words=1).collect()}
    assert kept[7001] == "\nk l" and kept[7002] == "k l m n"
    judged = registry.op8_line_dedup(spark, DATA).collect()
    short = {(i, k) for i, t in sample for k, x in enumerate((t or "").split("\n")) if len(set(x.encode().lower().split())) < 5}
    assert {(r.doc_id, k) for r in judged for k in r.removed_lines} & short == {x for x in want & short if x[0] < 5000}


# --- contamination ---


def brute_contamination(text, items):
    words = decontaminate.normal_words(text)
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = decontaminate.normal_words(t)
        n = min(13, len(w))
        for windows in range(len(w) - n + 1) if n else ():
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[windows : windows + n]:
                    hit[k : k + n] = [True] * n
                    found.add(item)
    return len(words), sum(hit), len(found)


def test_contamination(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abc")
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 4, 12, 13, 20, 30])))) for k in range(12)] + [(50, ""), (51, None), (52, "Zed")]
    texts = [" ".join(word() for _ in range(60)) + " " + rng.choice(items[:12])[1].upper() + " q zed" * rng.randint(0, 1) for _ in range(40)] + [None, ""]
    d = docs_of(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: brute_contamination(t, items) for k, t in enumerate(texts)}
    for words in (200_000, 25):
        found = decontaminate.find_matches(d, bench, shard_words=words).withColumn("n_hit", decontaminate._n_hit()).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, len(r.hit_items)) for r in found} == want
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(d, bench, "spans").collect()}
    assert all(len(decontaminate.normal_words(cut[k])) == n - h for k, (n, h, _) in want.items())
    gone = {k for k, (n, h, _) in want.items() if h and 20 * h >= n}
    assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} == set(want) - gone
    assert decontaminate.judge_contamination(d, bench.limit(0)).where("n_hit > 0").count() == 0


# --- quality ---


def test_quality_edges(spark, sample):
    rows = docs_of(spark, sample).withColumns({"n_words": F.lit("clash"), "_w": F.lit(1)})
    kept = quality_rules.apply_quality_rules(rows)
    assert kept.columns == rows.columns and 0 < kept.count() < len(sample)
    judged = {r.doc_id: r for r in quality_rules.judge_quality(rows).collect()}
    assert judged[5000].n_words == 0 and judged[5000].base_failed and not judged[5000].kept
    assert judged[5004].n_repeat_words == 3000 and judged[5003].n_repeat_words == 0
    assert {r.doc_id for r in kept.collect()} == {k for k, r in judged.items() if r.kept}
    assert quality_rules.judge_quality(rows.limit(0)).count() == 0
