"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (lengths, shares of character classes, repeated lines, words and word triples,
variety of words) are binned at quantiles of the training rows. Trees grow by levels on gradient histograms
with the logistic loss; all trees lie in one array of nodes, so a batch of rows goes down all of them by array
steps. Labels come only from rows that are not held out; at most ``sample`` of them (those with the smallest
hash of the id) are read. Language, source, id and labels are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.llm.common import chunks, held_out, texts

SAMPLE = 12_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 80, 4, 0.15, 48, 12, 2.0
THRESHOLD = 0.3

NAMES = (
    "log_chars", "log_words", "mean_word", "long_words", "letters", "upper", "digits", "blanks", "punctuation",
    "symbols", "pipes", "bangs", "upper_words", "odd_word_ends", "distinct_words", "top_word", "top_three",
    "lines", "mean_line", "dup_lines", "dup_line_chars", "repeat_triples", "sentences", "one_letter_words",
    "chars_variety", "top_triple")

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]=~^\\]")
_DIGITS, _PUNCTUATION, _BLANKS, _ENDS = map(re.compile, (r"[0-9]", r"[.,;:!?]", r"\s", r"[.!?](?=\s|$)"))


def statistics(text: str) -> list[float]:
    """The numbers of ``NAMES`` for one text, over all of it; an empty text has zeros."""
    words = _WORDS(text)
    n, chars = len(words), len(text)
    if not n:
        return [float(np.log1p(chars))] + [0.0] * (len(NAMES) - 1)
    counted = Counter(words)
    top = [c for _, c in counted.most_common(3)]
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    by_line = Counter(lines)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = sum(c for c in triples.values() if c > 1)
    symbols, punctuation = len(_SYMBOLS.findall(text)), len(_PUNCTUATION.findall(text))
    blanks, digits = len(_BLANKS.findall(text)), len(_DIGITS.findall(text))
    letters = max(chars - symbols - punctuation - blanks - digits, 0)
    upper_words = sum(c for w, c in counted.items() if len(w) > 1 and w.isupper())
    odd_ends = sum(c for w, c in counted.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'")
    return [
        float(np.log1p(chars)), float(np.log1p(n)), sum(len(w) * c for w, c in counted.items()) / n,
        sum(c for w, c in counted.items() if len(w) > 15) / n, letters / chars,
        sum(map(str.isupper, text)) / chars if upper_words or text[:1].isupper() else 0.0,
        digits / chars, blanks / chars, punctuation / chars, symbols / chars, text.count("|") / n,
        text.count("!") / n, upper_words / n, odd_ends / n, len(counted) / n, top[0] / n, sum(top) / n,
        len(lines) / n, float(np.log1p(chars / len(lines))), 1 - len(by_line) / len(lines),
        sum(len(x) * (c - 1) for x, c in by_line.items()) / chars, repeated / max(n - 2, 1),
        len(_ENDS.findall(text)) / n, sum(c for w, c in counted.items() if len(w) == 1) / n,
        len(set(text)) / chars, max(triples.values(), default=0) / max(n - 2, 1)]


@dataclass(frozen=True)
class Trees:
    """All trees in one run of nodes; children of a leaf are the leaf itself, and ``value`` counts at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[line, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def fit_trees(
    rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
    bins: int = BINS, least: int = LEAST_ROWS, ridge: float = RIDGE,
) -> Trees:
    """Boosted trees for 0/1 labels. No rows give the score 0.5; one class gives that class everywhere."""
    n, width = rows.shape
    share = (labels.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else rows
    offset = np.arange(width) * bins
    margin = np.full(n, base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node(v: float = 0.0) -> int:
        at = len(feature)
        for column, x in zip((feature, cut, left, right, value), (0, 0.0, at, at, v), strict=True):
            column.append(x)
        return at

    for _ in range(trees if 0 < labels.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = labels - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            below = []
            for at, mine in level:
                sum_g, sum_h = g[mine].sum(), h[mine].sum()
                best = None
                if d < depth and len(mine) >= 2 * least:
                    where = (binned[mine] + offset).ravel()
                    size = width * bins
                    hist = [np.bincount(where, np.repeat(w, width), size).reshape(width, bins).cumsum(axis=1)
                            for w in (g[mine], h[mine], np.ones(len(mine)))]
                    lg, lh, ln = hist
                    gain = lg**2 / (lh + ridge) + (sum_g - lg) ** 2 / (sum_h - lh + ridge) - sum_g**2 / (sum_h + ridge)
                    gain[(ln < least) | (len(mine) - ln < least)] = -1
                    j, b = divmod(int(gain.argmax()), bins)  # ties: first feature, lowest cut
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        best = j, b
                if best is None:
                    value[at] = float(rate * sum_g / (sum_h + ridge))
                    margin[mine] += value[at]
                    continue
                j, b = best
                goes = binned[mine, j] <= b
                feature[at], cut[at], left[at], right[at] = j, float(edges[j][b]), node(), node()
                below += [(left[at], mine[goes]), (right[at], mine[~goes])]
            level = below
    if not roots:
        roots.append(node())
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots), base, depth)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("pick"), batch.column("label"), rows], ["pick", "label", "stats"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Trees:
    """Learn from labelled rows that are not held out.

    Labels other than 0 and 1, null ids and null labels are passed over; a document labelled both ways gives
    both rows; repeated equal labels count once.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    # at most ``sample`` pairs of numbers: bounded by that parameter
    picked = known.withColumn("pick", F.xxhash64("doc_id")).orderBy("pick", "doc_id", "label").limit(sample)
    rows = texts(docs).join(F.broadcast(picked), "doc_id").select("pick", "label", "text").mapInArrow(
        _measure, "pick long, label int, stats array<double>").collect()
    rows.sort(key=lambda r: (r["pick"], r["label"], r["stats"]))
    matrix = np.array([r["stats"] for r in rows]).reshape(len(rows), len(NAMES))
    return fit_trees(matrix, np.array([r["label"] for r in rows], float))


def score_quality(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, from its whole text (null: empty).

    Repeated rows and null ids keep a row each. Only the id and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # a few thousand nodes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = np.array([statistics(t.as_py()) for t in part.column("text")]).reshape(-1, len(NAMES))
                score = shared.value.score(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score),
                     pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
