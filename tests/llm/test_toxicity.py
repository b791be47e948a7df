import random

import numpy as np
import pytest

from fieldstone.llm import toxicity as tx


def numeric_gradient(f, z, h=1e-6):
    return np.array([(f(z + h * e) - f(z - h * e)) / (2 * h) for e in np.eye(len(z))])


def test_fit_orders_thresholds_and_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    score = x @ [2.0, -1.0, 0.0] + r.logistic(size=600) * 0.3
    grade = np.digitize(score, [-1.0, 1.0, 2.0])
    w, t = tx.fit(x, grade, np.ones(600))
    assert (np.diff(t) > 0).all() and w[0] > 0 > w[1] and abs(w[2]) < 0.2 * w[0]
    p = tx.Model([b""] * 3, w, t).grades(x @ w)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    best = (np.digitize(x @ [2.0, -1.0, 0.0], [-1.0, 1.0, 2.0]) == grade).mean()  # of the true weights
    assert (p.argmax(axis=1) == grade).mean() > best - 0.03


def test_gradient_is_the_numeric_one():
    r = np.random.default_rng(2)
    x, grade, weight = r.normal(size=(60, 4)), r.integers(0, 4, 60), r.uniform(0.1, 2, 60)
    z = r.normal(size=4 + 3) * 0.5
    f = lambda z: tx.loss(z, x, grade, weight / weight.sum(), 0.01)
    assert np.allclose(f(z)[1], numeric_gradient(lambda v: f(v)[0], z), atol=1e-6)


def test_fit_is_the_plain_optimum():
    """Against plain descent on a likelihood that is written out row by row."""
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 2))
    grade = np.digitize(x @ [1.0, 0.5] + r.logistic(size=80), [-1.0, 1.0])
    sig = lambda v: 1 / (1 + np.exp(-v))

    def plain(z):
        t = [-np.inf, z[2], z[2] + np.exp(z[3]), np.inf]
        return -np.mean([np.log(sig(t[g + 1] - v @ z[:2]) - sig(t[g] - v @ z[:2])) for v, g in zip(x, grade, strict=True)]) + 2e-4 * z[:2] @ z[:2]

    w, t = tx.fit(x, grade, np.ones(80), steps=2000)
    z = np.concatenate([w, [t[0], np.log(t[1] - t[0])]])
    assert np.abs(numeric_gradient(plain, z)).max() < 1e-4
    slow = np.zeros(4)
    for _ in range(400):
        slow = slow - numeric_gradient(plain, slow)
    assert plain(z) <= plain(slow) + 1e-6 and np.allclose(z, slow, atol=0.05)


def brute_score(text, model):
    words = "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text or "").encode().split()
    counts = {}
    for w in words:
        for f in [b"=" + w, *(w[:k] for k in range(4, 9) if k < len(w))]:
            counts[f] = counts.get(f, 0) + 1
    s = sum(model.weights[i] * min(5.0, 100 * counts.get(f, 0) / (len(words) + 20)) for i, f in enumerate(model.names))
    upto = [*(1 / (1 + np.exp(-(t - s))) for t in model.thresholds), 1.0]
    p = np.diff([0.0, *upto])
    return sum(k * v for k, v in enumerate(p)), int(np.argmax(p)), 1 - p[0]


def test_scores_are_the_sums_written_out(spark):
    names = [b"=vile", b"zark", b"zarka", "=zärk".encode(), b"zoun", b"=a"]
    model = tx.Model(names, np.array([1.5, 0.4, -0.2, 2.0, 0.7, 0.1]), np.array([0.5, 1.0, 3.0]))
    r = random.Random(4)
    texts = [None, "", "Vile vile,vile", "ZÄRK zärk", "vile " * 60000, *[" ".join(r.choice(["vile", "zarka1", "Zounds!", "a", "b2", "zärk", "x" * 12]) for _ in range(r.randrange(80))) for _ in range(40)]]
    rows = [(i, t, 0) for i, t in enumerate([*texts, texts[7], texts[7]])] + [(None, texts[8], 1), (3, texts[3], 1)]
    got = tx.score(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for g in got:
        want = brute_score(by_id[g.doc_id], model)
        assert (g.expected_severity, g.p_toxic) == (pytest.approx(want[0]), pytest.approx(want[2])) and g.grade == want[1]


def test_severity_follows_a_grade_that_was_not_fitted(spark):
    """Texts with more and worse words have a higher expected severity, by an order that training does not see."""
    r = random.Random(6)
    rows, flags, order = [], [], []
    for i in range(900):
        worse = i % 3
        words = [r.choice("abcdefgh") + str(r.randrange(200)) for _ in range(100)]
        for _ in range(6 * worse):
            words[r.randrange(100)] = r.choice(["vile", "foul", "zark"])
        rows.append((i, " ".join(words)))
        flags.append((i, int(worse > 0)))
        order.append(worse)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in flags if x[0] < 450], "doc_id long, toxic int")
    got = {x.doc_id: x.expected_severity for x in tx.score(docs, tx.train(docs, known)).collect()}
    means = [np.mean([got[i] for i in range(450, 900) if order[i] == k]) for k in range(3)]
    assert means[0] < 0.2 and means[0] + 0.5 < means[1] and means[1] + 0.2 < means[2]


def test_a_labelled_id_with_many_rows_counts_once(spark):
    rows, labels = corpus(7, 300)
    docs = spark.createDataFrame(rows + [(9, "zz other text", 0.5)] * 500, "doc_id long, text string, x double")
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.names) > 0 and b"=other" not in model.names


def corpus(seed, n):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice("abcdefgh") + r.choice("klmnop") * r.randrange(1, 5) + str(r.randrange(40)) for _ in range(r.randrange(30, 200))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(max(2, len(words) // 40 * (1 + i % 2 * 3))):
                words[r.randrange(len(words))] = r.choice(["Zounds!", "zark" + r.choice("abc") + str(r.randrange(99)), "vile"])
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 1800)
    docs = spark.createDataFrame(rows + [(None, None, 0.1), (-1, "", 0.1)], "doc_id long, text string, grade double")
    half = spark.createDataFrame([x for x in labels if x[0] < 900] + [(3, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    model = tx.train(docs, half)
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    assert len(got) == len(rows) + 2 and not got[None].toxic and not got[-1].toxic
    truth = dict(labels)
    wrong = [k for k in range(900, 1800) if got[k].toxic != bool(truth[k])]
    assert len(wrong) <= 9
    assert all(0 <= r.expected_severity <= 2 for r in got.values()) and {r.grade for r in got.values()} == {0, 1, 2}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame(corpus(2, 20)[0], "doc_id long, text string, x double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in tx.score(docs, tx.train(docs, none)).collect()] == [False] * 20
    assert tx.score(docs.limit(0), tx.Model()).count() == 0
