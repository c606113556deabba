"""Bounded memory: benchmarks of many words (also long items, equal windows), training on long texts."""

import os
import pickle
import random
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import numpy as np  # noqa: E402

from seedlabel.llm import decontaminate, quality  # noqa: E402

BUILD = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
from seedlabel.llm import decontaminate
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = np.random.default_rng(0)
def items():
    for i in range(20_000):
        yield str(i), b" ".join(b"w%d" % x for x in rng.zipf(1.2, 100) % 500_000)
made = decontaminate.matchers(items())
assert sum(len(m.keys) for m in made) == 20_000 * 91
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_two_million_benchmark_words_take_bounded_memory():
    done = subprocess.run([sys.executable, "-c", BUILD.format(root=ROOT)], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 500  # MB


def test_long_windows_and_equal_items():
    rng = random.Random(3)
    words = [rng.choice("abc") for _ in range(900)]
    long, text = " ".join(words[100:400]), " ".join(words).encode()
    made = decontaminate.matchers([("x", long.encode()), ("y", long.encode()), ("z", b"c c c c c c c c c c c")], window=300)
    made = pickle.loads(pickle.dumps(made))
    runs, items = decontaminate.hit_runs(decontaminate.words_of(text), made)
    assert {"x", "y"} <= items and any(a <= 100 and b >= 400 for a, b in zip(runs[::2], runs[1::2]))
    for n in (0, 1, 299):
        assert decontaminate.hit_runs(decontaminate.words_of(long.encode())[:n], made)[1] <= {"z"}


def test_clean_documents_by_blocks(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = spark.createDataFrame([(i, say(rng.randint(1, 8))) for i in range(3, 15)] + [(1, None), (2, "")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(i % 20, say(rng.randint(0, 12)), "x") for i in range(80)] + [(None, None, "x")] * 3,
                                 "doc_id long, text string, hit_digest string")
    for window in (4, 6):
        one = decontaminate.clean_documents(docs, items, window).collect()
        many = decontaminate.clean_documents(docs, items, window, block_words=5).collect()
        assert sorted(map(repr, one)) == sorted(map(repr, many)) and 3 <= len(one) < len(docs.collect())
        a = decontaminate.contamination(docs, items, window).collect()
        b = decontaminate.contamination(docs, items, window, block_words=5).collect()
        assert sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) == 83


FIT = """
import resource, sys, time
sys.path.insert(0, {root!r})
import numpy as np
from seedlabel.llm import quality
rng = np.random.default_rng(0)
rows = []
for i in range(3000):  # texts of 20,000 words
    used = np.unique(rng.zipf(1.15, 20_000) % quality.WORD_SLOTS).astype("<i4")
    rows.append((i % 2, used, np.full(len(used), len(used) ** -0.5, "<f4")))
quality.STEPS = 2
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality.fit(rows, 0.5)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, sum(len(r[1]) for r in rows))
"""


def test_training_on_long_texts_takes_bounded_memory():
    done = subprocess.run([sys.executable, "-c", FIT.format(root=ROOT)], capture_output=True, text=True, check=True)
    more, features = map(int, done.stdout.split())
    assert features > 10_000_000 and more < 8 * features / 2 ** 20 + 250  # MB


def test_chunks_of_the_sample_give_one_gradient():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        index = np.sort(rng.choice(200, rng.integers(1, 40), replace=False)).astype("<i4")
        rows.append((int(index.min() < 8), index, rng.random(len(index)).astype("<f4")))
    whole, cut = quality.fit(rows, 0.4), quality.fit(rows, 0.4, chunk_features=25)
    for _, index, value in rows:
        assert abs(whole.score(index, value) - cut.score(index, value)) < 1e-3
    # the gradient itself, by differences of the loss
    met = np.arange(200, dtype=np.int32)
    weight = rng.random(60).astype(np.float32)
    params = [np.zeros(1), rng.normal(0, 0.1, 200), rng.normal(0, 0.1, (200, quality.FACTORS))]
    grads = [np.zeros(p.shape) for p in params]
    for x in quality.chunks(rows, 50):
        quality.Chunk(rows[x], weight[x], met).add_gradient(params, grads)

    def loss():
        m = quality.FactorisationMachine(params[0][0], params[1], params[2])
        z = np.array([m.margin(i, v.astype(float)) for _, i, v in rows])
        y = np.array([r[0] for r in rows])
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum())

    for k, place in ((0, 0), (1, 5), (1, 77), (2, (3, 1)), (2, (120, 4))):
        params[k][place] += 1e-5
        up = loss()
        params[k][place] -= 2e-5
        down = loss()
        params[k][place] += 1e-5
        assert abs((up - down) / 2e-5 - grads[k][place]) < 1e-3
