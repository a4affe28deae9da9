"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed character n-grams (1 to 3 characters; anything but letters counts as one
blank), damped, weighted by inverse document frequency and scaled to length one. Each language has
``k`` centroids from spherical k-means over its sample. A text gets the language of the centroid with the
highest cosine; its score is that cosine. Where the score lies below the language's own bound, the text is
rejected. The bound costs a stated share of the language's own sample rows, scored by centroids made without them.
Known languages lie farther from each other than some unseen language does, so the bound goes as far as that loss
allows; the tests leave out each language in turn.

The fit reads at most ``per_language`` rows of each language (those with the smallest hash of the id) that are
not held out. Sample vectors are made in tasks; k-means runs per language over that bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplepanel.llm.common import chunks, held_out, texts
from ripplepanel.session import cut

DIMS = 4096
PER_LANGUAGE, CENTROIDS, ROUNDS = 600, 4, 12
PARTS = 20
#: The share of a language's own rows that its bound may reject, and the folds of the sample that measure it.
LOSS, FOLDS = 0.05, 4
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them; one table per worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, one row per text, and whether each text has a letter."""
    lowered = [f" {t.lower()} " for t in batch]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    letter = _letters()[codes]
    has = np.zeros(len(lowered), bool)
    has[row[letter]] = True
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)  # a run of other characters is one blank
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    codes, row = codes[keep].astype(np.uint64), row[keep]
    counts, gram = np.zeros(len(lowered) * DIMS, np.float32), np.zeros(len(codes), np.uint64)
    for n in range(1, 4):
        size = len(codes) - n + 1
        if size <= 0:
            break
        gram = (gram[:size] * np.uint64(0x100000001B3)) ^ (codes[n - 1 :] + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        hashed = (gram * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(52)
        inside = row[:size] == row[n - 1 :]
        where = row[:size][inside] * DIMS + hashed[inside].astype(np.int64)
        counts += np.bincount(where, minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(lowered), DIMS), has


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped TF-IDF rows of length one; a row without grams stays zero."""
    vectors = np.log1p(counts) * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, one row per centroid, the language of each row, and the least score to accept."""

    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, has = gram_counts(batch)
        if not self.languages:
            return [UNKNOWN] * len(batch), np.zeros(len(batch)), np.ones(len(batch), bool)
        cosine = weigh(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)  # ties go to the language first in order
        score = np.clip(cosine[np.arange(len(batch)), best].astype(float), 0, 1)
        score[~has] = 0
        rejected = ~has | (score < self.floor[self.owner[best]])
        names = [self.languages[o] if h else UNKNOWN for o, h in zip(self.owner[best], has, strict=True)]
        return names, score, rejected


def _sample_vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            counts, has = gram_counts(part.column("text").to_pylist())
            langs = part.column("lang").filter(pa.array(has))
            data = pa.array([r.tobytes() for r in counts[has].astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([langs, part.column("pick").filter(pa.array(has)), data], ["lang", "pick", "grams"])


def _document_frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = np.zeros(DIMS), 0
    for batch in batches:
        for grams in batch.column("grams"):
            found += np.frombuffer(grams.as_py(), np.float32) > 0
            rows += 1
    yield pa.RecordBatch.from_pydict({"rows": [rows], "found": [found.tolist()]})


def spherical_means(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids of at most ``k`` groups; starts from rows far from each other, in a fixed order."""
    mean = vectors.mean(axis=0)
    chosen = [mean / (np.linalg.norm(mean) or 1)]
    nearest = vectors @ chosen[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(vectors[nearest.argmin()])
        nearest = np.maximum(nearest, vectors @ chosen[-1])
    centres = np.stack(chosen)
    for _ in range(rounds):
        group = (vectors @ centres.T).argmax(axis=1)
        fresh = np.stack([vectors[group == g].sum(axis=0) if (group == g).any() else centres[g] for g in range(len(centres))])
        fresh /= np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
        if np.allclose(fresh, centres, atol=1e-7):
            break
        centres = fresh
    return centres


def _means(idf: np.ndarray, k: int, loss: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("pick")
        counts = np.stack([np.frombuffer(g, np.float32) for g in table.column("grams").to_pylist()])
        vectors = weigh(counts, idf)
        centres = spherical_means(vectors, k, ROUNDS)
        low = own_bound(vectors, table.column("pick").to_numpy() % FOLDS, k, loss)
        return pa.table({"lang": [key[0].as_py()] * len(centres), "part": list(range(len(centres))),
                         "floor": [low] * len(centres), "centre": [c.astype(np.float32).tobytes() for c in centres]})

    return run


def own_bound(vectors: np.ndarray, fold: np.ndarray, k: int, loss: float) -> float:
    """The cosine that the share ``loss`` of the rows misses, each scored by centroids of the other folds."""
    if len(np.unique(fold)) < 2:
        return 0.0
    scores = np.empty(len(vectors))
    for f in np.unique(fold):
        scores[fold == f] = (vectors[fold == f] @ spherical_means(vectors[fold != f], k, ROUNDS).T).max(axis=1)
    return float(np.quantile(scores, loss))


def fit_languages(
    docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, loss: float = LOSS
) -> LanguageModel:
    """Learn centroids from rows with a language that are not held out; none such gives an empty model."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out())
    # in salted parts of a language, so that a language of most rows is not ranked in one task
    known = known.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    by = Window.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("n", F.row_number().over(by)).where(F.col("n") <= -(-per_language // PARTS))
    picked = picked.select("doc_id", "lang").distinct().withColumn("pick", F.xxhash64("doc_id"))
    # the picked rows are at most per_language (and one for each part) of each language: small by that parameter
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("own"), "text").join(
        F.broadcast(picked), "doc_id").where(F.col("own") == F.col("lang")).select("lang", "pick", "text")
    vectors = cut(sample.mapInArrow(_sample_vectors, "lang string, pick long, grams binary"), "language_sample")
    # one row per task of a bounded sample reaches the driver
    sums = vectors.coalesce(4).mapInArrow(_document_frequency, "rows long, found array<double>").collect()
    n = sum(r["rows"] for r in sums)
    if not n:
        return LanguageModel((), np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    found = np.sum([r["found"] for r in sums], axis=0)
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    rows = vectors.groupBy("lang").applyInArrow(
        _means(idf, k, loss), "lang string, part long, floor double, centre binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["part"]))
    languages = tuple(dict.fromkeys(r["lang"] for r in rows))
    floor = {r["lang"]: r["floor"] for r in rows}
    return LanguageModel(
        languages, idf, np.stack([np.frombuffer(r["centre"], np.float32) for r in rows]),
        np.array([languages.index(r["lang"]) for r in rows]), np.array([floor[x] for x in languages]))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row, from the whole text.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Repeated rows and null ids
    keep a row each. No other column is read, so clashing names do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x k rows of DIMS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                at = 0
                while at < part.num_rows:  # 256 rows of DIMS counts at once
                    few = part.slice(at, 256)
                    names, score, rejected = shared.value.predict(few.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [few.column("doc_id"), few.column("held_out"), pa.array(names, pa.string()),
                         pa.array(score, pa.float64()), pa.array(rejected)],
                        ["doc_id", "held_out", "lang_pred", "score", "rejected"])
                    at += 256

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, in one pass; ``lang`` is the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_lang = docs.columns.index("lang")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                for at in range(0, part.num_rows, 256):
                    few = part.slice(at, 256)
                    names, _, rejected = shared.value.predict([t or "" for t in few.column("text").to_pylist()])
                    few = few.set_column(at_lang, "lang", pa.array(names, few.schema.field("lang").type))
                    yield few.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
