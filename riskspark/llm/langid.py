"""Language identification: multinomial logistic regression on TF-IDF character
n-grams, FTRL-trained with an elastic net, temperature-calibrated.

Texts are lower-cased, runs of anything but letters become one gap, and all
character 1-, 2- and 3-grams are hashed to ``DIM`` features. Document frequencies
(the IDF part) come from all training documents by a distributed sum of ``DIM``
counters; the weights are fitted in one task on the ``bound`` training rows with the
smallest hashes (a documented parameter) and, so that every language is learned, on
at least ``PER_LANGUAGE`` rows (or all) of each. A fifth of a language's rows is kept
aside to fit the temperature.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Documents without a language are not learned from. With no training document at
all every text is ``und``. Repeated rows each give a row; columns beyond the named
ones are ignored; ties go to the language that sorts first.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_map, bounded_sample, fold, id_text, keep_rows, ship, stored, to_arrow
from riskspark.llm.linear import Ftrl, epochs, probabilities
from riskspark.llm.quality import fit_task

BITS = 14
DIM = 1 << BITS
BOUND = 2000
PER_LANGUAGE = 100         # rows of each language that are learned whatever its share
SLICE = 1 << 20            # characters turned into features at a time
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which of the first 65,536 code points are letters."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def features(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text (taken in bounded slices)."""
    counts = None
    for at in range(0, max(1, len(text)), SLICE):
        part = text[max(0, at - 2):at + SLICE].lower()
        a = np.frombuffer(f" {part} ".encode("utf-32-le"), np.uint32)
        a = a * ((a > 0xFFFF) | letters()[a & np.uint32(0xFFFF)])  # others become 0
        gap = a == 0
        a = a[~(gap & np.append(gap[1:], False))]                 # runs of them one 0
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
        h = np.concatenate((a[1:-1] * np.uint32(0x165667B1), two, three))
        h *= np.uint32(0x9E3779B1)
        c = np.bincount(h >> np.uint32(32 - BITS), minlength=DIM)
        counts = c if counts is None else counts + c
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx = np.flatnonzero(counts)
    val = np.sqrt(counts[idx]) * idf[idx]
    norm = np.sqrt(val @ val)
    return idx, val / norm if norm else val


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss (golden-section search)."""
    def loss(t):
        p = probabilities(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, g = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(texts: list[str], langs: list[str], idf: np.ndarray, passes: int = 2) -> dict:
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rows = [tfidf(features(t), idf) for t in texts]
    # dealt by language, so that none is known from rows kept aside alone
    aside = np.zeros(len(rows), bool)
    for k in range(len(names)):
        aside[np.flatnonzero(y == k)[4::5]] = True
    train = np.flatnonzero(~aside)
    # a class more than one column: with one language softmax needs a rival
    k = max(2, len(names))
    model = Ftrl(DIM, k, alpha=0.5, beta=1.0, l1=0.02, l2=0.01)
    eye = np.eye(k)
    for order in epochs(len(train), passes):
        for i in train[order].tolist():
            model.update(*rows[i], eye[y[i]])
    w = model.weights().astype(np.float32)
    held = np.flatnonzero(aside)
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in held])
    t = temperature(logits, y[held]) if len(held) else 1.0
    return {"names": names, "w": w, "t": t}


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """How many training documents have each feature: one counter per task, sent at
    its end and summed by feature (``DIM + 1`` rows reach the driver)."""
    ship(train.sparkSession)
    schema = to_arrow("f int, n long")

    def count(batches):
        df = np.zeros(DIM + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                df[:DIM] += features(t) > 0
                df[DIM] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])], schema=schema)

    rows = train.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for f, n in rows:
        out[f] = n
    return out[:DIM], int(out[DIM])


def language_sample(train: DataFrame, bound: int, each: int = PER_LANGUAGE) -> DataFrame:
    """The rows to learn from, as (doc_id, lang): the ``bound`` smallest hashes of all, and
    the ``each`` smallest of every language. What is ranked within a language is cut
    to about ``2 * each + 100`` rows by the hash before, so no language fills a task."""
    ids = stored(train.where("doc_id IS NOT NULL").select("doc_id", "lang").distinct(), "language-ids")
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    h, some = F.xxhash64(F.col("doc_id").cast("string")), 2 * each + 100
    low = ids.join(F.broadcast(counts), "lang").where(
        (F.col("n") <= some) | (h < (F.lit(2.0 * some) / F.col("n") - 1) * float(1 << 63)))
    least = Window.partitionBy("lang").orderBy(h, "doc_id")
    of_each = low.withColumn("r", F.row_number().over(least)).where(F.col("r") <= each).select("doc_id", "lang")
    return bounded_sample(ids, "doc_id", bound).union(of_each).distinct()


def fit_language(docs: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", folds: int = 3, held: int = 1) -> Broadcast:
    """The model, broadcast: names and temperature, weights, IDF (fixed size for a
    given number of languages). Learns from rows outside the held-out fold."""
    train = (docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
             .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)
                    & (fold(F.col("doc_id"), folds) != held)))
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    lettered = train.where(F.col("text").rlike(r"\p{L}"))
    chosen = language_sample(lettered, bound)
    sample = lettered.join(F.broadcast(chosen), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"]).select("doc_id", "text", "lang")

    def learn(rows):
        rows = [r for r in rows if has_letter(r["text"])]
        if not rows:
            return None
        m = fit([r["text"] for r in rows], [r["lang"] for r in rows], idf)
        return json.dumps({"names": m["names"], "t": m["t"]}).encode() + b"\0" + m["w"].tobytes()

    model = fit_task(sample, "doc_id", learn)
    head, _, raw = (model[0] if model else b"").partition(b"\0")
    return docs.sparkSession.sparkContext.broadcast((json.loads(head) if head else {"names": [], "t": 1.0}, raw, idf))


def predictions(texts: list[str | None], model: tuple) -> tuple[list[str], list[float]]:
    meta, raw, idf = model
    names, t = meta["names"], meta["t"]
    w = np.frombuffer(raw, np.float32).reshape(DIM, -1) if names else None
    langs, scores = [], []
    for text in texts:
        if not names or not has_letter(text):
            langs.append(UNDETERMINED)
            scores.append(0.0)
            continue
        idx, val = tfidf(features(text), idf)
        p = probabilities((val @ w[idx])[:len(names)] / t) if len(names) > 1 else np.ones(1)
        best = int(p.argmax())
        langs.append(names[best])
        scores.append(float(p[best]))
    return langs, scores


def identify_language(docs: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    model = fit_language(docs, bound, id_col, text_col, lang_col, folds, held)
    d = id_text(docs, id_col, text_col)

    def predict(b: pa.RecordBatch):
        langs, scores = predictions(b.column(1).to_pylist(), model.value)
        yield {"doc_id": b.column(0).to_pylist(), "lang_pred": langs, "score": scores}

    out = arrow_map(d, predict, f"doc_id {dict(d.dtypes)['doc_id']}, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, unchanged, that have a language of at least that score."""
    model = fit_language(docs, text_col=text_col, **kw)

    def mask(texts):
        return [lang != UNDETERMINED and s >= least for lang, s in zip(*predictions(texts, model.value))]

    return keep_rows(docs, text_col, mask)
