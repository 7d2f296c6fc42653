"""The corpus pipeline, stage by stage, against brute force that uses none of its code."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import quality_rules, registry

from ..conftest import DATA

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return re.findall("[^ \\t-\\r]+", lowered(t))


def judged(folder):
    """doc_ids that the rules keep, by their SQL twin in another engine."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}


def without_lines(docs):
    seen, by_word, out = [], defaultdict(list), []
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            s = frozenset(words(line))
            shared = Counter(m for w in s for m in by_word[w])
            if not any(5 * c >= 4 * (len(s) + len(seen[m]) - c) for m, c in shared.items()):
                kept.append(line)
            if s:
                for w in s:
                    by_word[w].append(len(seen))
                seen.append(s)
        out.append((i, "\n".join(kept)))
    return out


def first_copies(docs):
    sets, up = {}, {i: i for i, _ in docs}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = []
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            linked.append(both / len(sets[a] | sets[b]))
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [(i, t) for i, t in docs if find(i) == i], linked


def clean(docs, items):
    read = lambda t: re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", lowered(t))
    windows = defaultdict(set)
    for t in items:
        w = read(t or "")
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k : k + n]))
    out = []
    for i, t in docs:
        w = read(t)
        hit = {k + j for n, known in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in known for j in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest documents, with copies of some with a few words changed, repeated short lines,
    passages of the benchmark, and empty and null rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(2)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = items.where("text IS NOT NULL").orderBy("item_id").first().text
    fresh = lambda n: ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(n)]

    def wrapped(w, shift):
        """In lines of twelve words that begin elsewhere in each copy, so that only documents are alike."""
        cuts = [0, *range(shift, len(w), 12), len(w)]
        return "\n".join(" ".join(w[a:b]) for a, b in itertools.pairwise(cuts) if a < b)

    texts = []
    for _ in range(8):
        base = fresh(400)
        texts.append(wrapped(base, 2))
        for shift, changes in ((4, 1), (6, 6), (8, 7), (10, 9), (12, 40)):  # a change takes up to five shingles
            copy = list(base)
            for k in rng.sample(range(400), changes):
                copy[k] = "changed" + str(rng.randint(0, 10**6))
            texts.append(wrapped(copy, shift))
    texts += [" ".join(fresh(120)) + "\nRead more\nMenu\n" + " ".join(fresh(30)) for _ in range(3)]
    texts += [" ".join(fresh(70)) + "\n" + item + "\n" + " ".join(fresh(9)), "", None, "\n \n", "a b", "x " * 500]
    rows += [(10_000 + k, t, "en", "made", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return folder, sorted((r[0], r[1] or "") for r in rows), [r.text for r in items.collect()]


def test_pipeline(spark, corpus):
    folder, rows, items = corpus
    kept = judged(folder)
    docs = without_lines([r for r in rows if r[0] in kept])
    assert any(t != dict(rows)[i] and i >= 10_000 and "Menu" not in t for i, t in docs)  # short lines went
    firsts, linked = first_copies(docs)
    assert len(firsts) < len(docs) and any(0.8 <= x < 0.9 for x in linked) and any(0.9 <= x < 1 for x in linked)
    rest = clean(firsts, items)
    assert len(rest) < len(firsts)
    library = Tokenizer.from_file(registry.tokenizer_path())
    want = []
    for i, t in rest:
        ids = library.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_keep_the_columns_and_take_odd_rows(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    folder, rows, _ = corpus
    text = next(t for i, t in rows if i >= 10_000 and len(t) > 1000)
    odd = [(None, text, "en", "s", 5), (None, None, None, None, None), (1, text, None, "s", None), (1, text, None, "s", None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "extra", 7) for r in odd], COLUMNS + ", key string, line int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= len(odd)
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(odd)


def test_a_failed_stage_leaves_no_table(spark, corpus, monkeypatch):
    dropped = []
    real = corpus_pipeline.discard
    monkeypatch.setattr(corpus_pipeline, "discard", lambda *d: dropped.extend(d) or real(*d))

    def fails(spark, docs, sf_dir):
        raise RuntimeError("stage")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("fails", fails), corpus_pipeline.STAGES[-1]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, corpus[0])
    assert len(dropped) == 2
