import random
import re
from collections import Counter

import pytest

from fieldstone.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    r = random.Random(3)
    out = [None, "", " \n\t ", "one", "é ü x # |", "a b c d e a b c d e", "x\nx\n\n\nx \nx", "a " * 400, "\x1ca b\x0bc"]
    for _ in range(200):
        out.append("".join(r.choice(["a", "b", "cé", " ", " ", "\n", "a b c d e f\n", "#"]) for _ in range(r.randrange(200))))
    out.append(" ".join(f"w{r.randrange(9000)}" for _ in range(30000)))
    return out


def test_figures_match_brute_force():
    for t in texts():
        assert q.figures(t and t.encode())[:5] == brute(t), t


def test_binomial_tail_and_bound():
    assert q.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert q.binomial_tail(10, 10, 0.1) == 1
    assert q.binomial_tail(1, 3, 0.5) == pytest.approx(0.5)
    assert q.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01, abs=1e-6)


def test_certify_limits_false_rejection():
    n = len(q.GRID)
    none = [1000] + [0] * n
    few = [5] + [0] * n
    half = [500] + [0] * (n - 1) + [500]
    out = q.certify({"sure": none, "few": few, "bad": half}, 0.02, 0.95)
    assert out == {"sure": q.GRID[-1]}
    assert q.certify({}, 0.02, 0.95) == {}


def test_certify_holds_over_many_draws():
    r = random.Random(5)
    wrong = 0
    for _ in range(300):
        row = [0] * (len(q.GRID) + 1)
        for _ in range(400):  # the strictest cutoff rejects 3 % of good texts, the others 1 %
            u = r.random()
            row[len(q.GRID) if u < 0.01 else 1 if u < 0.03 else 0] += 1
        wrong += q.certify({"a": row}, 0.02, 0.9).get("a", 1.0) == q.GRID[-1]
    assert wrong <= 30


def test_judge_and_keep_agree(spark):
    rows = [(i, t, "en" if i % 3 else None, "src") for i, t in enumerate(texts())] + [(None, "a b c", "en", None)]
    clean = [(1000 + i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "s") for i in range(600)]
    junk = [(5000 + i, " ".join(f"J{i}X{k}$$$" for k in range(30)), "en", "s") for i in range(20)]
    docs = spark.createDataFrame(rows + clean + junk + junk[:2], "doc_id long, text string, lang string, severity string")
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(600)] + [(None, 1), (3, None), (99999, 1), (1000, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in q.judge(docs, labels).collect()}
    for i, t, _, _ in rows:
        words, chars, symbols, dup, repeated = brute(t)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, dup, repeated)
        assert r.base_failed == (words < 10 or 100 * repeated > 20 * words)
    assert all(out[1000 + i].kept for i in range(600)) and not any(out[5000 + i].kept for i in range(20))
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in out.items() if r.kept)
    assert q.judge(docs.limit(0), labels).count() == 0 and q.judge(docs, labels.limit(0)).filter("kept").count() > 600


def test_copies_are_one_holdout(spark):
    """Ten texts certify nothing, however often they are repeated, under the same id or under others."""
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(10)]
    rows = [(i * 100 + k % 50, t, "en") for i, t in enumerate(texts) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i * 100 + k, 1) for i in range(10) for k in range(50)], "doc_id long, quality int")
    assert q.calibrate(q.measure(docs), labels) == {}
    more = [(10_000 + i, " ".join(f"v{i}x{k}" for k in range(30)), "en") for i in range(600)]
    labels = labels.unionByName(spark.createDataFrame([(r[0], 1) for r in more], "doc_id long, quality int"))
    assert q.calibrate(q.measure(docs.unionByName(spark.createDataFrame(more, docs.schema))), labels) == {"en": q.GRID[-1]}


def test_verdicts_follow_from_the_labels(spark):
    """kept against the rule written out: counts of distinct good texts, exact tails by fractions, Holm's steps, cutoffs."""
    from fractions import Fraction
    from math import comb

    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        lang = "en" if i % 3 else "de"
        words = [f"w{r.randrange(10**6)}" for _ in range(30)]
        for _ in range(r.choice([0, 0, 0, 1, 4])):
            words[r.randrange(30)] = "Q$$$$"
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(words.count("Q$$$$") < 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    good, tests = dict(labels), []
    p = Fraction(2, 100)
    for lang in ("en", "de"):
        severity = [got[i].severity for i, _, s in rows if s == lang and good[i]]
        for g, cut in enumerate(q.GRID):
            k, n = sum(s >= cut for s in severity), len(severity)
            tail = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            tests.append((tail, lang, g))
    held = set()
    for i, (tail, lang, g) in enumerate(sorted(tests)):
        if tail > Fraction(5, 100) / (len(tests) - i):
            break
        held.add((lang, g))
    cutoff = {}
    for lang in ("en", "de"):
        for g in range(len(q.GRID)):
            if (lang, g) not in held:
                break
            cutoff[lang] = q.GRID[g]
    assert cutoff
    for i, _, lang in rows:
        assert got[i].kept == (not got[i].base_failed and not got[i].severity >= cutoff.get(lang, 2.0))


def test_numpy_and_column_severities_agree(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rows = [q.figures(t and t.encode()) for t in texts()]
    df = spark.createDataFrame(rows, list(q.FIGURES)).select(q.severity({k: F.col(k) for k in q.FIGURES}).alias("s"))
    assert np.allclose(sorted(r.s for r in df.collect()), sorted(q.severities(np.array(rows))), atol=1e-12)
