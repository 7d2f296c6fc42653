"""Language ID with hundreds of languages and with very long texts, in bounded memory."""

import subprocess
import sys

import numpy as np
import pytest

from loomgraph.llm import language_id

CHILD = """
import resource, random
resource.setrlimit(resource.RLIMIT_AS, (3 << 30, 3 << 30))
from loomgraph.llm import language_id
rng = random.Random(1)
langs = [f"l{k:03d}" for k in range(300)]
stems = {x: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)] for x in langs}
text = lambda x, n: " ".join(rng.choice(stems[x]) for _ in range(n))
samples = [text(x, 60).split() for x in langs for _ in range(3)]
crf = language_id.fit(samples, [x for x in langs for _ in range(3)], epochs=2)
found = language_id.Predictor(crf).predict([text(x, 40) for x in langs] + [rng.choice(stems["l007"]) for _ in range(3000)] + [text("l005", 60_000)])
right = sum(f[0] == x for f, x in zip(found, langs))
print(len(crf.labels), right, found[-1][0])
"""


def test_three_hundred_languages_in_three_gigabytes():
    run = subprocess.run([sys.executable, "-c", CHILD], capture_output=True, text=True, env={"PYTHONPATH": ":".join(sys.path), "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"}, timeout=600)
    assert run.returncode == 0, run.stderr[-800:]
    labels, right, long = run.stdout.split()
    assert labels == "300" and int(right) > 270 and long == "l005"


@pytest.mark.parametrize("k", [2, 5, 20])
def test_ways_to_posteriors_agree(k):
    rng = np.random.default_rng(k)
    sizes = np.array([1, 7, 40, 3])
    scores, t, start = rng.normal(0, 2, (sizes.sum(), k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    want, pairs = language_id.forward_backward(scores, sizes, t, start)
    assert language_id.forward_backward_posterior(scores, sizes, t, start, block=8) == pytest.approx(want)
    assert pairs.sum() == pytest.approx(sizes.sum() - len(sizes))
    own = scores[8:48]
    for block in (1, 7, 40, 64):
        blocks = list(language_id.long_posteriors(lambda lo, hi: own[lo:hi], 40, t, start, block))
        assert np.concatenate(blocks[::-1]) == pytest.approx(want[8:48])


def test_a_long_text_as_a_short_one(monkeypatch):
    samples = [["der", "und", "nicht", "auch"] * 20, ["the", "and", "not", "also"] * 20] * 8
    crf = language_id.fit(samples, ["de", "en"] * 8)
    text = "der the und nicht also auch " * 300
    want = language_id.Predictor(crf).predict([text, text[:50]])
    monkeypatch.setattr(language_id, "LONG", 500)
    monkeypatch.setattr(language_id, "CHUNK", 100)
    got = language_id.Predictor(crf).predict([text, text[:50]])
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
