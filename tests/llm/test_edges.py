"""Nulls, repeats, clashing names, long and empty inputs of the training-data operators."""

import hashlib
import itertools
import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat_template, common, decontaminate, html_text, language_id, line_dedup, quality_rules, registry, set_join, simhash, similar_docs, suffix_dedup, url_filters

from ..conftest import DATA


def removed_bytes(places, length=100):
    """By brute force: {place: (n_bytes, n_removed, n_spans, digest)} for texts in order."""
    seen, out = set(), {}
    for place, t in places:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        runs = sum(1 for k in range(len(hit)) if hit[k] and (k == 0 or not hit[k - 1]))
        out[place] = (len(b), sum(hit), runs, hashlib.sha256(bytes(c for c, f in zip(b, hit, strict=True) if not f)).hexdigest())
    return out


def test_substrings_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    text = lambda: "".join(rng.choice("abcdefghij ") for _ in range(300))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (2, c), (3, d[:150] + c[:150]), (4, None), (4, "")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, sub int, key string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.judge_substrings(docs).collect())
    # Rows equal in id and text are one place; texts of one id in any order: here they share nothing.
    want = removed_bytes([((1, a), a), ((2, c), c), ((2, d), d), ((3, ""), d[:150] + c[:150]), ((4, ""), ""), ((None, a), a), ((None, b), b)])
    rest = {(3, d[:150] + c[:150]): (3, ""), (4, None): (4, "")}
    assert got == sorted((i is None, i or 0, *want[rest.get((i, t), (i, t))]) for i, t in rows)
    assert want[None, b][1] == 0 and want[None, a][1] == 300


def test_substrings_of_long_periodic_texts(spark):
    rng = random.Random(13)
    rows = [(1, "a" * 200_000), (2, "ab" * 30_000), (3, "b" + "a" * 120), (4, "a" * 99)]
    rows += [(10 + k, "".join(rng.choice("ab") for _ in range(20)) + "a" * rng.randint(90, 400)) for k in range(30)]
    want = removed_bytes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (4096, 3):
        got = suffix_dedup.judge_substrings(docs, shard=shard).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


# --- clashing names, empty tables, long texts ---

NAMES = ["doc", "at", "key", "lines", "line", "size", "sub", "n", "q", "head", "_doc", "_gone", "_b0", "_block", "_key", "_canon", "page", "spans", "fp", "text_", "words", "prefix", "_kept", "_row", "_w", "_text"]


def with_names(df):
    return df.withColumns({c: F.lit("kept") for c in NAMES})


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [(1, "one two three four five six\nsome other line of words here\nMenu"), (2, "six five four three two one\nMenu"), (3, None), (None, "one two three four five six"), (4, LONG), (5, LONG + " end"), (6, "")]


def test_clashing_names_pass_through(spark):
    path = registry.tokenizer_path()
    plain = docs_of(spark, ROWS)
    wide = with_names(plain)
    bench = spark.createDataFrame([("b1", "six five four")], "item_id string, text string")
    for step in (line_dedup.dedup_lines, similar_docs.keep_first, simhash.keep_first, quality_rules.apply_quality_rules, lambda d: decontaminate.decontaminate(d, bench)):
        a, b = step(plain), step(wide)
        assert b.columns == wide.columns
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select("doc_id", "text").collect()))
        assert b.where("n <> 'kept' OR _doc <> 'kept' OR at <> 'kept'").count() == 0
    for judge in (line_dedup.judge_lines, simhash.near_duplicates, suffix_dedup.judge_substrings, quality_rules.judge_quality, lambda d: bpe.round_trip(d, path), lambda d: decontaminate.judge_contamination(d, bench)):
        a, b = judge(plain), judge(wide)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    pages = with_names(spark.createDataFrame([(1, "http://bad.org/a?x=1", "h"), (2, None, "p")], "page_id long, url string, host string"))
    listed = spark.createDataFrame([("bad.org/a?x=1",)], "canon string")
    got = {r.page_id: r for r in url_filters.filter_urls(pages, listed).collect()}
    assert got[1].verdict == "block" and got[1].host == "bad.org" and got[2].host == "" and got[1]._b0 == got[2]._key == got[1].page == "kept"


def test_empty_tables(spark):
    none = docs_of(spark, ROWS).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labelled = none.withColumn("lang", F.lit("en"))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for found in (
        line_dedup.dedup_lines(none), similar_docs.keep_first(none), simhash.keep_first(none), suffix_dedup.judge_substrings(none), quality_rules.apply_quality_rules(none),
        bpe.round_trip(none, registry.tokenizer_path()), decontaminate.judge_contamination(none, bench), language_id.identify(labelled, language_id.train(labelled)),
        html_text.extract_text(pages), url_filters.filter_urls(pages, url_filters.listed_urls(pages)),
    ):
        assert found.count() == 0


def test_one_very_long_line_is_one_set(spark):
    gone = {tuple(r) for r in line_dedup.repeated_lines(docs_of(spark, ROWS), min_words=1).collect()}
    assert gone == {(2, 0), (2, 1), (5, 0)}
    assert {r.doc_id for r in similar_docs.keep_first(docs_of(spark, ROWS)).collect()} == {1, 2, 3, 4, None}


# --- BK-trees ---


def test_trees_have_inner_nodes_and_skip_edges():
    rng = np.random.default_rng(3)
    members = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    trees = simhash.BkForest(members, np.zeros(len(members), dtype=np.int64))
    near = {(int(q), int(m)) for a, b in trees.search(members, np.zeros(len(members), dtype=np.int64), 4) for q, m in zip(a, b, strict=True)}
    assert trees.depth >= 3 and len(trees.kids) == len(members) - 1
    assert len(members) < trees.visited < len(members) ** 2 // 2
    distance = np.bitwise_count(members[:, None] ^ members[None, :])
    assert near == {tuple(x) for x in np.argwhere(distance <= 4).tolist()}
    # A child is keyed by its distance to its parent, and one node has one child of a key.
    assert len(set(trees.codes.tolist())) == len(trees.codes)
    assert all(np.bitwise_count(members[k] ^ members[c // 65]) == c % 65 for k, c in zip(trees.kids.tolist(), trees.codes.tolist(), strict=True))


def test_trees_answer_on_the_given_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    fps = np.unique(np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64))
    kept = simhash.blocks_kept(len(fps))
    links, visited, depth = set(), 0, 0
    for mask in simhash.bucket_masks(4, kept):
        group = np.unique(fps & np.uint64(mask & (1 << 64) - 1), return_inverse=True)[1]
        by = np.argsort(group, kind="stable")
        edges, trees = simhash.group_edges(fps[by].view(np.int64), group[by], np.ones(len(fps), dtype=bool))
        links |= {frozenset((int(fps[by][a]), int(fps[by][b]))) for a, b in edges}
        visited, depth = visited + trees.visited, max(depth, trees.depth)
    assert kept == 1 and depth >= 1 and 0 < visited < len(fps) ** 2
    up = {int(f): int(f) for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in map(tuple, links):
        up[max(root(a), root(b))] = min(root(a), root(b))
    mine = {f: root(f) for f in up}
    up = {f: f for f in up}
    for a, b in np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1)).tolist():
        x, y = root(int(fps[a])), root(int(fps[b]))
        up[max(x, y)] = min(x, y)
    assert mine == {f: root(f) for f in up}


# --- words of lines and shingles ---


def test_readers_against_python():
    rng = random.Random(1)
    texts = [None, "", "a b", "a", "\n", "x y\nz\n", "q" * 100 + " r", "  lead trail  ", "A\tB\rC\x0bD", "é ü\nß", "end", "start\n\n\nmid  x", "\n\nq"]
    texts += ["".join(rng.choice("abC \n\té") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    seen: dict = {}
    for chars in (7, 50, 60_000):
        for at, x, ends in common.text_bytes(pa.array(texts), chars, set_join._LOWER):
            text, line, lo, count, h = set_join.read_lines(x, ends)
            got = [(at + t, k, h[a : a + c].tolist()) for t, k, a, c in zip(text.tolist(), line.tolist(), lo.tolist(), count.tolist(), strict=True)]
            want = [(i, k, w.split()) for i in range(at, at + len(ends)) for k, w in enumerate((texts[i] or "").encode().lower().split(b"\n")) if w.split()]
            assert [(i, k, len(w)) for i, k, w in want] == [(i, k, len(w)) for i, k, w in got]
            assert all(seen.setdefault(u, v) == v for (_, _, a), (_, _, b) in zip(want, got, strict=True) for u, v in zip(a, b, strict=True))
            _, _, lo, count, h = set_join.read_shingles(x, ends, 5)
            for k in range(len(ends)):
                w = (texts[at + k] or "").encode().lower().split()
                s = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))]
                assert len(s) == count[k] and all(seen.setdefault(u, v) == v for u, v in zip(s, h[lo[k] : lo[k] + count[k]].tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


# --- main text ---


class _Dom(HTMLParser):
    """The article's blocks by a parser of its own: text in the article or, without one, in the
    body, but not in nav, footer or an advert."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.part = [], [], ""

    def end(self):
        if self.part.split():
            self.blocks.append(" ".join(self.part.split()))
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "i"):
            self.end()
        if tag == "p" and self.open and self.open[-1][0] in ("p", "b"):
            while self.open and self.open[-1][0] in ("p", "b"):
                self.open.pop()
        if tag not in ("br", "meta"):
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i"):
            self.end()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in ("nav", "footer", "script", "style", "title") or c == "ad" for t, c in self.open):
            self.part += data


def test_main_text_of_pages_against_a_parser(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    for d in (pages, bare):
        html = {r.page_id: r.html for r in d.collect()}
        for r in html_text.extract_text(d).collect():
            dom = _Dom()
            dom.feed(html[r.page_id] or "")
            dom.close()
            dom.end()
            assert r.text == "\n".join(dom.blocks) and r.n_chars == len(r.text)


def test_the_curve_sets_the_borders():
    links = "".join(f"<div><a href={k}>Section number {k}</a></div>" for k in range(5))
    article = "".join(f"<p>{'word ' * 30}{k}.</p>" for k in range(3))
    page = f"<body><div>Log in</div>{links}{article}<div>Short end.</div>{links}<div>All rights reserved</div></body>"
    lines = [t for t, _, _, dropped in html_text.lines_of(page) if not dropped]
    want = [*(("word " * 30) + f"{k}." for k in range(3)), "Short end."]
    assert html_text.main_text(page).split("\n") == want and len(lines) == 16
    marked = f"<body><article>{article}{links}<p>{'more ' * 20}</p></article><div>About</div></body>"
    assert html_text.main_text(marked).split("\n") == [*want[:3], ("more " * 20).strip()]
    assert html_text.passages([0, 5, 0, 0, 0, 70, 0, 0, 0, 9, 0, 0, 0, 9]) == [(5, 6)]
    assert html_text.passages([3, 4, 90, 0, 0, 2, 0, 0, 0]) == [(0, 6)]


# --- language ---


def test_texts_without_letters_and_many_languages(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 30, f"l{k % 70:02}") for k in range(400)]
    rows += [(1000, "½ ²", "en"), (1001, "Ⅷ", "en"), (1002, "١٢ 3", "en"), (1003, None, "en"), (1004, "हिन्दी" * 20, "en"), (1005, "a" * 5000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(d, language_id.train(d)).collect()}
    assert len(got) == len(rows) and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002, 1003))
    assert got[1004].lang_pred != "und" and got[1005].lang_pred != "und"
    assert language_id.words_of("abc½d áe " + "z" * 30) == ["abc", "d", "áe", "z" * 24, "z" * 6]
    assert len(language_id.drawn_words("w " * 5000, 1, 400)) == 400


def test_posteriors_against_all_label_paths():
    rng = np.random.default_rng(5)
    for n, k in ((1, 2), (4, 3), (5, 2)):
        scores, t, s = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
        want, total = np.zeros((n, k)), 0.0
        for path in itertools.product(range(k), repeat=n):
            weight = np.exp(s[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for i, y in enumerate(path):
                want[i, y] += weight
        for found in (language_id.forward_backward(scores, np.array([n]), t, s)[0], language_id.forward_backward_posterior(scores, np.array([n]), t, s, 2)):
            assert np.allclose(found, want / total)


# --- digests of the queries ---


def test_token_digests(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in registry.op3_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_every_token_is_its_own_encoding():
    b = bpe.tokenizer(registry.tokenizer_path())
    assert all((b.merge(t) if len(t) < 64 else b.merge_long(t)) == [i] for t, i in b.ids.items())


def test_contamination_digests(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault((n, tuple(w[k : k + n])), set()).add(i)
    sizes = {n for n, _ in windows}
    got = {r.doc_id: r for r in registry.op9_decontaminate(spark, DATA).collect()}
    for d in docs:
        w = words(d.text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if owners := windows.get((n, tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= owners
        r = got[d.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))


def test_filter_has_no_false_negative_and_the_join_removes_false_positives(spark):
    listed = spark.range(400).select(F.concat(F.lit("l"), F.col("id").cast("string"), F.lit(".org/p")).alias("canon"))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://l"), F.col("id").cast("string"), F.lit(".org/p")).alias("url"))
    for keys in (2, 64):
        found = url_filters.filter_urls(pages, listed, keys_per_block=keys)
        by = {(r.maybe_listed, r.listed): r.n for r in found.groupBy("maybe_listed", "listed").agg(F.count("*").alias("n")).collect()}
        assert by[True, True] == 400 and (False, True) not in by and by[False, False] > (3000 if keys == 2 else 0)
        assert {r.page_id for r in found.where("verdict = 'block'").collect()} == set(range(400))
    assert by.get((True, False), 0) > 0  # a crowded filter says yes too often


# --- quality ---


def test_statistics_in_rules_are_those_of_the_query(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["a", "b", "cc", "#d", "E9"]) + rng.choice(["", "\n", "\t"]) for _ in range(rng.randint(0, 90)))) for k in range(60)] + [(100, None), (101, " ")]
    d = docs_of(spark, rows)
    a = quality_rules.quality_features(d).select("doc_id", *quality_rules.STATISTICS).collect()
    b = d.select("doc_id", *quality_rules._words_and_text(d, "text")).select("doc_id", *[F.expr(v).alias(k) for k, v in quality_rules.STATISTICS.items()]).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


def test_rules_are_ordered_by_what_reaches_them(spark):
    rule = quality_rules.Rule
    d = docs_of(spark, [(k, "A" * (k % 10) + "b" * 10) for k in range(300)])
    slow = "length(sha2(repeat(_text, 3000), 512)) > 0 AND "
    rules = [rule("costly", slow + "_text LIKE 'A%'"), rule("never", "_text LIKE 'zz%'"), rule("cheap", "_text LIKE 'A%'")]
    assert [r.name for r in quality_rules.order_rules(d, rules)][0] == "cheap"
    assert quality_rules.apply_quality_rules(d, rules).count() == 0


# --- chat ---


def test_a_long_conversation_is_one_digest(spark):
    turns = [(7, k, "assistant" if k % 2 else "user", f"text {k} <|im_start|>") for k in range(4000)]
    rows = spark.createDataFrame([*turns, (8, 0, "user", "x" * 300_000)], "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.conv_id: r for r in chat_template.conversation_digests(chat_template.format_conversations(rows)).collect()}
    loss = "".join(t for _, _, role, t in turns if role == "assistant")
    assert got[7].n_turns == 4000 and got[7].loss_chars == len(loss) and got[7].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    assert got[8].n_turns == 1 and got[8].loss_chars == 0


def test_urls_without_a_host_and_empty_keys(spark):
    long = "http://bad.org/" + "a/" * 100_000
    urls = [None, "", "no scheme", "http:///x", "http://bad.org/a", "://", long, None, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    listed = spark.createDataFrame([("",), ("bad.org/a",), (None,), ("/x",)], "canon string").union(pages.where("page_id = 6").select(url_filters.canonical(F.col("url"))))
    for limit in (32 << 20, 0):
        got = {r.page_id: (r.verdict, r.listed) for r in url_filters.filter_urls(pages, listed, broadcast_bytes=limit).collect()}
        assert len(got) == len(urls) and {k for k, v in got.items() if v == ("block", True)} == {4, 6}
        assert all(v == ("allow", False) for k, v in got.items() if k not in (4, 6))


def test_frequent_words_stay_cached_and_merges_in_bulk_are_exact(monkeypatch):
    """A full cache keeps what is still met; words merged together have the ids of the single merges."""
    b = bpe.ByteBpe(registry.tokenizer_path())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    asked = []
    real = b.resolve
    monkeypatch.setattr(b, "resolve", lambda words: asked.extend(words) or real(words))
    for k in range(20):
        b.encode([" ".join(["often", *(f"w{chr(97 + k)}{chr(97 + n)}" for n in range(8))])])
    assert asked.count("often") == 1 and len(b.cache) + len(b.older) <= 30
    words = sorted({w.encode() for t in ("aaaaaaa bababab ababa thethe", "hyperextraordinarily é ßß 日本語日本語", "x", "ab" * 31) for w in t.split(" ")})
    words += [bytes(97 + (7 * k * j) % 26 for j in range(1 + k % 40)) for k in range(300)]
    assert [x.tolist() for x in b.merge_all(words)] == [b.merge(w) for w in words]
    b.forget()
    assert not b.cache and not b.older
