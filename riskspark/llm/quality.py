"""Quality classifier: hashed word n-gram logistic regression, FTRL-trained.

Three families of hashed n-grams: the words themselves (1 and 2), and the word
*shapes* (1, 2 and 3: letter runs collapse to ``a``/``A``/``Aa``, digits to ``0``,
other characters stay, a word equal to the one before is marked). A family's
values are relative frequencies, so a document's score is the sum over families
of the mean weight of its n-grams: a sparse dot product.

The model is fitted in one task on at most ``bound`` labelled rows (a documented
parameter; chosen by the hash of their id) and is sent to the scoring tasks as an
array of fixed size. Every row of the table is scored over its whole text.

Defined cases: null and empty texts have no n-grams and get the score of the bias
alone. Labels that are null are not learned; a label given twice counts once. With
no label at all every score is 0.5. Repeated rows each give a row. Columns beyond
the named ones are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_map, bounded_sample, fold, id_text, keep_rows, ship, to_arrow
from riskspark.llm.linear import Ftrl, epochs, probabilities

BITS = 18
DIM = 1 << BITS
SCALE = 8.0                # frequencies are multiplied by this
THRESHOLD = 0.3
BOUND = 2500               # labelled rows the fit may use
MEMO_WORDS = 200_000

RUN_UP = re.compile(r"[^\W\d_a-zà-öø-ÿ]{2,}")
RUN_LOW = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+")
RUN_DIGIT = re.compile(r"\d+")


def shape_of(word: str) -> str:
    """Letter runs as ``a`` or ``A``, digit runs as ``0``; the rest as it is."""
    stem = word.rstrip(".,;:")
    if stem.isalpha():  # nearly every word
        if stem.islower():
            return "a" + word[len(stem):]
        if stem.istitle():
            return "Aa" + word[len(stem):]
    up = RUN_UP.sub("A", word)
    return RUN_DIGIT.sub("0", RUN_LOW.sub("a", up))[:24]


class WordIds(dict):
    """word -> hash of the word (high 32 bits) and of its shape (low 32 bits),
    remembered per worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = out = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(shape_of(word).encode())
        return out


WORDS = WordIds()


def mixed(h: np.ndarray, family: int) -> np.ndarray:
    """Spread 64-bit sums over ``DIM`` features, apart by family."""
    h = (h + np.uint64(family * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(text: str | None) -> list[np.ndarray]:
    """Feature numbers of every n-gram, one array per family."""
    words = (text or "").split()
    if not words:
        return []
    both = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    s *= np.uint64(2)
    s[1:] += w[1:] == w[:-1]
    b, c = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    return [mixed(w, 1), mixed(w[:-1] * b + w[1:], 2), mixed(s, 3), mixed(s[:-1] * b + s[1:], 4),
            mixed((s[:-2] * b + s[1:-1]) * c + s[2:], 5)]


def example(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and values; feature 0 is the bias."""
    idx, val = [np.zeros(1, np.int64)], [np.ones(1)]
    for f in ngrams(text):
        if len(f):
            u, c = np.unique(f, return_counts=True)
            idx.append(u)
            val.append(c * (SCALE / len(f)))
    u, back = np.unique(np.concatenate(idx), return_inverse=True)
    return u, np.bincount(back, np.concatenate(val))


def logit(text: str | None, w: np.ndarray) -> float:
    return float(w[0] + SCALE * sum(w[f].mean() for f in ngrams(text) if len(f)))


def fit(texts: list[str | None], labels: list[int], passes: int = 2) -> np.ndarray:
    rows = [example(t) for t in texts]
    model = Ftrl(DIM, 1, alpha=0.3, beta=1.0, l1=1e-4, l2=1e-3)
    for order in epochs(len(rows), passes):
        for i in order:
            model.update(*rows[i], np.array([float(labels[i])]))
    return model.weights()[:, 0].astype(np.float32)


def fit_task(sample: DataFrame, order_col: str, train) -> list:
    """Run ``train(rows)`` in one task over a sample of bounded size (columns as in
    ``sample``); it returns the model as bytes, or None if there are no rows."""
    ship(sample.sparkSession)
    schema = to_arrow("model binary")

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (str(r[order_col]), str(r)))
        yield pa.RecordBatch.from_arrays([pa.array([train(rows)], pa.binary())], schema=schema)

    out = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return [r[0] for r in out if r[0] is not None]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``bound`` training rows (``doc_id, y, text``): ids are chosen from the
    labels table alone, then their texts are fetched by a broadcast of those ids."""
    y = (labels.select(labels[id_col].alias("doc_id"), labels[label].cast("int").alias("y"))
         .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0))
         .groupBy("doc_id").agg(F.max("y").alias("y")))
    chosen = bounded_sample(y, "doc_id", bound)
    return id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]) \
        .select("doc_id", "y", "text")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND, id_col: str = "doc_id",
                text_col: str = "text") -> Broadcast:
    """The fitted weights, broadcast as ``DIM`` floats (all zero without labels)."""
    def train(rows):
        return fit([r["text"] for r in rows], [r["y"] for r in rows]).tobytes() if rows else None

    model = fit_task(labelled_sample(docs, labels, label, bound, 5, id_col, text_col), "doc_id", train)
    return docs.sparkSession.sparkContext.broadcast(model[0] if model else np.zeros(DIM, np.float32).tobytes())


def quality_scores(texts: list[str | None], weights: bytes) -> np.ndarray:
    w = np.frombuffer(weights, np.float32)
    return probabilities(np.array([logit(t, w) for t in texts], float)[:, None])[:, 0]


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD,
                  bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    weights = fit_quality(docs, labels, label, bound, id_col, text_col)
    d = id_text(docs, id_col, text_col)

    def score(b: pa.RecordBatch):
        yield {"doc_id": b.column(0).to_pylist(), "score": quality_scores(b.column(1).to_pylist(), weights.value).tolist()}

    out = arrow_map(d, score, f"doc_id {dict(d.dtypes)['doc_id']}, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches the threshold."""
    weights = fit_quality(docs, labels, text_col=text_col, **kw)
    return keep_rows(docs, text_col, lambda texts: quality_scores(texts, weights.value) >= threshold)
