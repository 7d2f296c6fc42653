"""Decontamination against benchmarks of many shards."""

import random

import pytest

from loomgraph.llm import decontaminate, line_dedup, similar_docs, simhash, suffix_dedup

from .test_llm import brute_contamination


def made(named):
    """Items of which one in three opens alike, and documents of which a third quote that."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(40)}"
    opening = " ".join(word() for _ in range(15))
    items = []
    for k in range(1200):
        body = " ".join(word() for _ in range(rng.choice([3, 12, 13, 30, 90])))
        items.append((f"i{k}" if named else k, f"{opening} {body}" if k % 3 == 0 else body))
    items += [(items[0][0], items[0][1]), (None, "w1"), ("none" if named else 9000, None), ("blank" if named else 9001, " -- ")]
    texts = [None, "", "w1", "Ünï w2"]
    for k in range(40):
        own = " ".join(word() for _ in range(30))
        quoted = opening.upper() if k % 3 == 0 else items[rng.randrange(1200)][1].replace(" ", ", ")
        texts.append(f"{own} {quoted}! {own}")
    texts += [texts[10]] * 5 + [" ".join(items[k][1] for k in range(200, 230))]
    return items, texts


@pytest.mark.parametrize("named", [False, True])
@pytest.mark.parametrize("broadcast", [True, False])
def test_many_shards_against_brute_force(spark, monkeypatch, named, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "FEW", 0)
    items, texts = made(named)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "doc_id AS start", "text AS words", "1 AS n_words", "2 AS `a key`")
    bench = spark.createDataFrame(items, f"item_id {'string' if named else 'int'}, text string")
    owned = []
    found = decontaminate.find_matches(docs, bench, shard_words=40, owned=owned)
    assert found.columns == ["doc_id", "text", "start", "words", "a key", "hit_spans", "hit_items", "n_words"]
    got = {r.doc_id: r for r in found.collect()}
    whole = {r.doc_id: r for r in decontaminate.find_matches(docs, bench).collect()}
    assert len(owned) == 1 and len(got) == len(texts)
    assert {k: r.asDict() for k, r in got.items()} == {k: r.asDict() for k, r in whole.items()}
    distinct = [x for x in items if x[0] is not None]
    for k in (0, 1, 2, 3, 4, 5, 14, len(texts) - 1):
        r = got[k]
        n_hit = sum(s.end - s.start for s in r.hit_spans)
        assert (r.n_words, n_hit, len(r.hit_items)) == brute_contamination(texts[k], distinct)


def test_plan_has_one_depth_for_any_number_of_shards(spark):
    items, texts = made(False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    depth = set()
    for words in (20_000, 20):
        plan = decontaminate.find_matches(docs, bench, shard_words=words)._jdf.queryExecution().optimizedPlan().toString()
        depth.add(len(plan.splitlines()))
        assert "MapInArrow" not in plan  # the scans of shards are behind a written table
    assert len(depth) == 1


def test_pieces_keep_every_window(spark):
    words = [f"v{k}" for k in range(100)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join(words[:13]))], "item_id long, text string")
    pieces = [(r.item_id, r.words.split()) for r in decontaminate._pieces(items, 13, 20).collect()]
    windows = {(i, tuple(w[k : k + 13])) for i, w in pieces for k in range(len(w) - 12)}
    assert windows == {(1, tuple(words[k : k + 13])) for k in range(88)} | {(3, tuple(words[:13]))}
    assert [w for i, w in pieces if i == 2] == [words[:12]] and max(len(w) for _, w in pieces) == 32


def test_no_hits_and_no_documents(spark):
    items, texts = made(False)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "nothing of it"), (2, None)], "doc_id long, text string")
    assert [(r.n_words, r.hit_spans, r.hit_items) for r in decontaminate.find_matches(docs, bench, shard_words=40).orderBy("doc_id").collect()] == [(3, [], []), (0, [], [])]
    assert decontaminate.find_matches(docs.limit(0), bench, shard_words=40).count() == 0


def test_ids_that_are_no_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for refuses in (line_dedup.dedup_lines, line_dedup.judge_lines, suffix_dedup.judge_substrings, suffix_dedup.dedup_substrings, similar_docs.keep_first):
        with pytest.raises(ValueError, match="doc_id must be a number, not string"):
            refuses(docs)


def test_fingerprints_link_near_copies_before_the_join(spark, monkeypatch):
    """The pairs of near_dedup come from BK-trees of fingerprints; the exact join gets only what they left apart."""
    base = [f"w{k}" for k in range(400)]
    copies = [" ".join([*base[:-1], f"end{n}"]) for n in range(4)]
    texts = [*copies, " ".join(f"other{k}" for k in range(50)), copies[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    real = similar_docs.set_join.verified
    monkeypatch.setattr(similar_docs.set_join, "verified", lambda d, pairs, *a: seen.append({(r.doc_id, r.doc_id0) for r in pairs.collect()}) or real(d, pairs, *a))
    assert {r.doc_id for r in similar_docs.keep_first(docs).collect()} == {0, 4}
    fp = [simhash.fingerprint(t, similar_docs.SHINGLE) for t in texts]
    assert all((fp[a] ^ fp[0]).bit_count() <= 4 for a in range(4))
    assert len(seen[0]) >= 3 and {x for p in seen[0] for x in p} == {0, 1, 2, 3}
    assert not seen[1]
