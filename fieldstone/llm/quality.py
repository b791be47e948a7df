"""Quality rules with risk-controlled thresholds.

Each text gets base figures and a few rule values, each a share between 0 and 1. A rule has a lenient value, at which
it says nothing, and a strict one, at which it is certain; the severity of a text is the largest of its rules'
positions between the two, so a cutoff on the severity is one number and stricter cutoffs reject nested sets.

Cutoffs are chosen per stratum from labelled holdout texts. For every stratum and every cutoff of a fixed grid, the
hypothesis "more than max_false_rejection of the good texts are rejected" is tested by the exact binomial tail; Holm's
step-down procedure over all of them keeps the chance of any wrong certification under 1 - confidence. A stratum uses
the strictest cutoff such that it and all more lenient ones are certified, and rejects nothing beyond the base rules
if none is. The rule scales are parameters and are not fitted, so all labelled texts are holdouts. A holdout is a
distinct text of a stratum: copies of it, under whatever ids, count once, as the test needs independent draws.

Defined cases: a null text has no words and fails the base rules; a text without words has all rule values 0; a label
for no document, a null label and a null stratum are ignored or form a stratum of their own; of several labels of one
document the lowest holds; rows that repeat are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.arrow import as_bytes, map_batches, pieces
from fieldstone.shared import written

#: Characters that count as symbols, and white space.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))

#: Rule: (lenient, strict).
RULES = {"symbols": (0.01, 0.08), "shouting": (0.30, 0.90), "exclaiming": (0.02, 0.12), "lines_again": (0.30, 0.80), "words_again": (0.12, 0.20)}
#: Cutoffs of the severity, lenient first.
GRID = tuple(round(1 - i / 20, 2) for i in range(20))
DIGEST = "text_digest"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim")


def repeated_words(ids: np.ndarray, n_ids: int, width: int = 5) -> int:
    """Words covered by windows of `width` words that occur twice or more. ids number the words from 0 below n_ids."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, bound = ids[:n].astype(np.int64), n_ids
    for k in range(1, width):
        if bound >= (1 << 62) // n_ids:  # number the keys anew; equal keys stay equal
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bound = n
        key, bound = key * n_ids + ids[k : k + n], bound * n_ids
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    found = np.flatnonzero(np.isin(key, again))
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + width, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def figures(text: bytes | None) -> tuple[int, ...]:
    """FIGURES of a UTF-8 text."""
    text = text or b""
    words = text.split()
    less = lambda drop: len(text) - len(text.translate(None, drop))
    lines = [x for x in text.split(b"\n") if x.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return (
        len(words), len(text) - less(SPACE + CONTINUATION), less(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)) if len(words) > len(numbers) else 0, len(lines), less(UPPER), less(LOWER), less(b"!"),
    )


def rule_values(**x):
    """Shares of a text that the rules look at, from its figures (columns, arrays or numbers)."""
    chars, words, lines, letters = x["word_chars"], x["n_words"], x["n_lines"], x["n_upper"] + x["n_lower"]
    return {"symbols": (x["n_symbols"], chars), "shouting": (x["n_upper"], letters), "exclaiming": (x["n_exclaim"], chars), "lines_again": (x["n_dup_lines"], lines), "words_again": (x["n_repeat_words"], words)}


def severity(columns: dict[str, Column], rules: dict = RULES) -> Column:
    """The largest position of any rule between its lenient and its strict value."""
    at = [((F.when(whole > 0, part / whole).otherwise(0.0) - rules[name][0]) / (rules[name][1] - rules[name][0])) for name, (part, whole) in rule_values(**columns).items()]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(*at)))


def severities(rows: np.ndarray, rules: dict = RULES) -> np.ndarray:
    """severity() of an array of FIGURES, with the same operations."""
    out = np.zeros(len(rows))
    for name, (part, whole) in rule_values(**{k: rows[:, i].astype(float) for i, k in enumerate(FIGURES)}).items():
        value = np.divide(part, whole, out=np.zeros(len(rows)), where=whole > 0)
        out = np.maximum(out, (value - rules[name][0]) / (rules[name][1] - rules[name][0]))
    return np.minimum(1.0, out)


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """`keep` columns, FIGURES and a digest of every text."""
    kept = docs.select(*keep, text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{k} long" for k in FIGURES), f"{DIGEST} binary"])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        import xxhash

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column(len(keep)))
            rows = np.array([figures(t) for t in texts], np.int64).reshape(-1, len(FIGURES))
            digests = pa.array([xxhash.xxh3_128_digest(t or b"") for t in texts], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(rows[:, i]) for i in range(len(FIGURES))), digests], [*keep, *FIGURES, DIGEST])

        return run

    return map_batches(kept, make, schema, text_col)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly up to rounding."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound of a rate of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > level else (lo, mid)
    return hi


def certify(counts: dict[str | None, list[int]], max_false_rejection: float, confidence: float, grid: tuple[float, ...] = GRID) -> dict[str | None, float]:
    """Cutoffs by stratum. counts: of good holdout texts by how many cutoffs of the grid reject them (0 to len(grid))."""
    tests = []
    for stratum, row in counts.items():
        n = sum(row)
        for g in range(len(grid)):
            rejected = sum(row[len(grid) - g :])  # texts which at least len(grid) - g cutoffs reject: those at or over grid[g]
            tests.append((binomial_tail(rejected, n, max_false_rejection) if n else 1.0, str(stratum), g, stratum))
    certified: dict[str | None, set[int]] = {}
    for i, (p, _, g, stratum) in enumerate(sorted(tests, key=lambda x: x[:3])):
        if p > (1 - confidence) / (len(tests) - i):
            break
        certified.setdefault(stratum, set()).add(g)
    out = {}
    for stratum, held in certified.items():
        depth = next((g for g in range(len(grid)) if g not in held), len(grid))
        if depth:
            out[stratum] = grid[depth - 1]
    return out


def calibrate(measured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", max_false_rejection: float = 0.02, confidence: float = 0.95) -> dict[str | None, float]:
    """Cutoffs by stratum from the labelled texts (labels: id, quality; 1 is good) that pass the base rules.

    Texts that have several labels, by their copies, are good only if all are. Only counts per stratum and cutoff reach
    the driver.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").alias("good"))
    passed = measured.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    level = sum(((severity({k: F.col(k) for k in FIGURES}) >= c).cast("int") for c in GRID), F.lit(0))
    texts = passed.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), DIGEST, level.alias("level")).join(known, F.col("id") == F.col("label_id"))
    texts = texts.groupBy("stratum", DIGEST, "level").agg(F.min("good").alias("good")).filter("good = 1")
    rows = texts.groupBy("stratum", "level").count().collect()
    counts: dict[str | None, list[int]] = {}
    for r in rows:
        counts.setdefault(r["stratum"], [0] * (len(GRID) + 1))[r["level"]] += r["count"]
    return certify(counts, max_false_rejection, confidence)


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", **risk) -> DataFrame:
    """One row per document: id, FIGURES, base_failed, severity, cutoff (null: none certified), kept."""
    measured = written(measure(docs, text_col, (id_col, stratum_col)), "quality")
    cutoffs = calibrate(measured, labels, stratum_col, id_col, **risk)
    cutoff = F.lit(None).cast("double")
    for stratum, at in cutoffs.items():
        cutoff = F.when(F.col(stratum_col).eqNullSafe(F.lit(stratum)), F.lit(at)).otherwise(cutoff)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    out = measured.withColumns({"severity": severity({k: F.col(k) for k in FIGURES}), "cutoff": cutoff})
    return out.select(id_col, *FIGURES, failed.alias("base_failed"), "severity", "cutoff", (~failed & ~F.coalesce(F.col("severity") >= F.col("cutoff"), F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", **risk) -> DataFrame:
    """The documents that judge() keeps, with their own columns. The texts are read twice and never shuffled."""
    cutoffs = calibrate(written(measure(docs, text_col, (id_col, stratum_col)), "quality"), labels, stratum_col, id_col, **risk)
    names = docs.columns

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col, 8 << 20):
                rows = np.array([figures(t) for t in as_bytes(batch.column(names.index(text_col)))], np.int64).reshape(-1, len(FIGURES))
                cutoff = np.array([cutoffs.get(s, 2.0) for s in batch.column(names.index(stratum_col)).to_pylist()])
                yield batch.filter(pa.array(~base_failed(rows[:, 0], rows[:, 4]) & (severities(rows) < cutoff)))

    return docs.mapInArrow(run, docs.schema)
