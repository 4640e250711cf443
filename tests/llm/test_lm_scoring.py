import math
import resource
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pulcro.llm.lm_scoring import score_documents
from pulcro.llm.queries import op9_lm_scoring
from pulcro.llm.recurrent import Gru, score, train


def base(documents):
    """Plain unigram scores of (doc_id, text)."""
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0

    counts = Counter(w for i, t in documents if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = []
    for i, t in documents:
        own = tokens(t)
        logs = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        rows.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), n, logs))
    return rows


def check(rows, documents):
    expected = base(documents)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == sorted((e[:5] for e in expected), key=str)
    left = sorted((str(r["doc_id"]), r["base_score"]) for r in rows)
    right = sorted((str(e[0]), e[5]) for e in expected)
    for (_, a), (_, b) in zip(left, right, strict=True):
        assert a == pytest.approx(b, rel=1e-9)
    for r in rows:
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_whole_table(spark, sf):
    rows = op9_lm_scoring(spark, sf).collect()
    documents = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, documents)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_outside_the_frequent_list(spark, sf, monkeypatch):
    monkeypatch.setattr("pulcro.llm.lm_scoring.FREQUENT_WORDS", 500)
    monkeypatch.setattr("pulcro.llm.lm_scoring.VOCABULARY", 100)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    check(score_documents(frame).collect(), [tuple(r) for r in frame.select("doc_id", "text").collect()])


def test_special_texts(spark):
    documents = [
        (1, None), (2, ""), (None, "The the ÀÉ àé"), (3, "a\tb\x0bc\x0cd\re\nf g\xa0h"), (3, "a\tb\x0bc\x0cd\re\nf g\xa0h"),
        (4, "x" * 200_000), (5, "w " * 30_000), (11, "  \x1c a"),
    ]
    frame = spark.createDataFrame([(*d, "z") for d in documents], "doc_id long, text string, score string")
    check(score_documents(frame).collect(), documents)
    assert score_documents(frame.limit(0)).count() == 0
    only_held = [(None, "never learnt")]
    check(score_documents(spark.createDataFrame(only_held, "doc_id long, text string")).collect(), only_held)


def small(seed=1):
    random = np.random.default_rng(seed)
    return Gru.start(np.sort(random.integers(1, 100, 30))[::-1].astype(float), 5, 4, seed)


def test_gradients_are_those_of_the_loss():
    model = small()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    random = np.random.default_rng(2)
    seen, h = random.integers(0, 30, (6, 3)), random.standard_normal((3, 5))
    _, grads, _ = model.gradients(seen, h)
    for name, value in model.w.items():
        for _ in range(5):
            at = tuple(random.integers(0, s) for s in value.shape)
            old = value[at]
            losses = []
            for d in (1e-5, -1e-5):
                value[at] = old + d
                losses.append(model.gradients(seen, h)[0])
            value[at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_probabilities_sum_to_one_and_windows_do_not_matter():
    model = small()
    state = np.random.default_rng(3).standard_normal((1, 5)).astype(np.float32)
    logs = model.log_probs(np.repeat(state, 30, 0), np.arange(30))
    assert np.exp(logs).sum() == pytest.approx(1, rel=1e-5)
    random = np.random.default_rng(4)
    texts = [np.r_[random.integers(1, 30, n), 0] for n in (0, 1, 7, 200, 33)]
    one = [float(score(model, [t], 0)[0]) for t in texts]
    assert np.allclose(score(model, texts, 0, lanes=2, steps=8), one, rtol=1e-4)
    h, last, total = np.zeros((1, 5), dtype=np.float32), np.array([0]), 0.0
    for word in texts[2]:
        h = model.step(last, h)
        last = np.array([word])
        total += float(model.log_probs(h, last)[0])
    assert total == pytest.approx(one[2], rel=1e-4)


def test_training_learns_an_order():
    model = small()
    windows = np.tile(np.arange(33) % 7, (256, 1)).astype(np.uint16)
    text = [np.r_[np.arange(1, 29) % 7, 0]]
    before = score(model, text, 29)[0]
    for _ in range(8):
        train(model, windows, 16, 32, 0.02)
    assert score(model, text, 29)[0] > before + 10


def test_every_word_of_a_training_text_is_learnt():
    from pulcro.llm.lm_scoring import ROUNDS, WINDOW, _windows

    for n in (1, 31, 32, 33, 64, 65, 5000):
        ids = np.arange(1, n + 1).astype(np.uint16)
        found = _windows(ids, 0)
        assert found.shape[1] == WINDOW + 1
        assert set(found[:, 1:].ravel()) - {0} == set(range(1, n + 1)) and len(found) == -(-n // WINDOW)
        assert found[0, 0] == 0 and all(b == a + 1 for row in found for a, b in zip(row, row[1:]) if b)
        rounds = [found[(t + len(found)) % ROUNDS :: ROUNDS] for t in range(ROUNDS)]
        assert sum(map(len, rounds)) == len(found)


def test_sums_by_word_and_probabilities_equal_the_plain_ones():
    from pulcro.llm.lm_scoring import _gathered
    from pulcro.llm.recurrent import softmax, summed_rows

    random = np.random.default_rng(6)
    values, numbers = random.standard_normal((500, 7)), random.integers(3, 40, 500)
    plain = np.zeros((50, 7))
    np.add.at(plain, numbers, values)
    assert np.allclose(summed_rows(values, numbers, 50), plain)
    x, wanted = random.standard_normal((9, 20)) * 300, random.integers(0, 9, 20)
    top = x - x.max(0)
    shares, logs = softmax(x.copy(), wanted)
    assert np.allclose(shares, np.exp(top) / np.exp(top).sum(0))
    assert np.allclose(logs, top[wanted, range(20)] - np.log(np.exp(top).sum(0)))
    frames = [pd.DataFrame({"row": [i, -i], "ids": [b"ab" * n, b""]}) for i, n in enumerate((3, 0, 4, 9, 1))]
    put = list(_gathered(iter(frames), 5))
    assert [len(f) for f in put] == [6, 2, 2] and pd.concat(put)["row"].tolist() == pd.concat(frames)["row"].tolist()
    # Arrays that live for a step are not mapped anew each time: a page costs more than its arithmetic.
    model, windows = Gru.start(np.arange(1025, 0, -1).astype(float), 24, 32, 1), random.integers(0, 1025, (1024, 33))
    train(model, windows.astype(np.uint16), 16, 512, 0.01)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    train(model, windows.astype(np.uint16), 16, 512, 0.01)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 4 * 1000
