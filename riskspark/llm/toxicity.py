"""Toxic passages by maximum-scoring segments over token log-odds.

Token log-odds compare toxic with other training documents under Dirichlet priors
whose mean is the estimate for a shorter prefix of the token, so a word that was
never seen takes the odds of its longest known prefix. A linear-time scan (all
maximal scoring segments) finds every passage whose log-odds outweigh the drift of
ordinary text. A segment's score S in a text of n tokens has the expected number
E = K n exp(-lambda S) of chance hits (Karlin-Altschul); lambda and K come from
clean documents. A document's evidence is the sum of -ln E over its significant
segments (or that of its best one), and a logistic curve fitted on cross-fitted
training documents turns it into the score.

The model is fitted in one task on at most ``bound`` labelled rows (a documented
parameter) and holds at most ``MAX_STRINGS`` strings; every row of the table is
scored over its whole text.

Defined cases: null and empty texts have no segment and get the curve's value for
no evidence. Null labels are not learned; with no toxic (or no other) training
row every score is 0. Repeated rows each give a row. Columns beyond the named ones
are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_map, fold, id_text
from riskspark.llm.linear import platt
from riskspark.llm.quality import fit_task, labelled_sample

BOUND = 4000
PREFIXES = (6, 5, 4, 3)    # lengths backed off to, longest first
PRIOR = 4.0                # strength of the prior, in documents
LEAST_DOCS = 3             # a string in fewer training documents is left to its prefix
MAX_STRINGS = 300_000
DRIFT, HIGHEST, LOWEST = 1.2, 6.0, -2.0
SIGNIFICANCE = 0.05
MAX_LAMBDA = 8.0
MEMO_WORDS = 200_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def parents(token: str) -> list[str]:
    """The token and its prefixes, most specific first; prefixes end in ``*``."""
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) >= k)]


def log_odds(toxic: list[set[str]], other: list[set[str]]) -> dict[str, float]:
    """String -> log-odds of a toxic document, by document counts in each class.

    The classes weigh the same: counts of the larger one are scaled down."""
    t, c = Counter(), Counter()
    for docs, into in ((toxic, t), (other, c)):
        for d in docs:
            into.update({s for w in d for s in parents(w)})
    scale = min(1.0, len(toxic) / len(other))
    up = min(1.0, len(other) / len(toxic))
    share: dict[str, float] = {}

    def estimate(chain: list[str]) -> float:
        s = chain[0]
        if s not in share:
            prior = estimate(chain[1:]) if len(chain) > 1 else 0.5
            a, b = t[s] * up, c[s] * scale
            share[s] = (a + PRIOR * prior) / (a + b + PRIOR) if t[s] + c[s] >= LEAST_DOCS else prior
        return share[s]

    words = {w for d in (*toxic, *other) for w in d}
    for w in words:
        estimate(parents(w))
    out = {}
    for s, q in share.items():
        if t[s] + c[s] >= LEAST_DOCS:
            out[s] = math.log(q / (1 - q))
    kept = sorted(out, key=lambda s: (-abs(out[s]), s))[:MAX_STRINGS]
    return {s: out[s] for s in kept}


class TokenScores(dict):
    """Raw token -> its log-odds less the drift, remembered per worker."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, raw: str) -> float:
        if len(self) > MEMO_WORDS:
            self.clear()
        token = EDGE.sub("", raw)
        odds = 0.0
        for s in parents(token) if token else ():
            if s in self.odds:
                odds = self.odds[s]
                break
        self[raw] = out = min(max(odds, LOWEST), HIGHEST) - DRIFT
        return out


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def plain_tokens(text: str | None) -> set[str]:
    return {w for w in (EDGE.sub("", t) for t in set(tokens(text))) if w}


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in linear time.

    Works on runs of positive scores; ``link`` points to the latest earlier
    candidate whose left sum is lower, so no candidate is looked at in vain twice."""
    up = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], up.view(np.int8), [0]))))
    if not len(edge):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))[edge].tolist()
    edge = edge.tolist()
    found: list[tuple[int, int, float, float, int]] = []   # start, end, left, right, link
    for k in range(0, len(edge), 2):
        start, end, left, right = edge[k], edge[k + 1], sums[k], sums[k + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(s, e, right - left) for s, e, left, right, _ in found]


def karlin_lambda(sample: np.ndarray) -> float:
    """The positive solution of mean(exp(lambda * score)) = 1 over clean tokens, at
    most ``MAX_LAMBDA``: where clean text has next to no positive score, the equation
    would make any trace of one significant."""
    if not len(sample) or sample.mean() >= 0:
        return 1.0
    lo, hi = 1e-6, MAX_LAMBDA
    if np.exp(hi * sample).mean() < 1:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.exp(mid * sample).mean() < 1 else (lo, mid)
    return (lo + hi) / 2


def token_scores(text: str | None, scores: TokenScores) -> np.ndarray:
    """One score per token; a token equal to the one before it says nothing new."""
    ts = tokens(text)
    out = np.fromiter(map(scores.__getitem__, ts), np.float64, len(ts))
    again = np.fromiter(map(str.__eq__, ts[1:], ts), bool, max(len(ts) - 1, 0))
    out[1:][again] = -DRIFT
    return out


def evidence(values: np.ndarray, lam: float, log_k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of -ln E over significant segments (else of the best), and those segments."""
    segments = maximal_segments(values)
    if not segments:
        return 0.0, []
    shift = log_k + math.log(len(values))
    hits = [(s, e, lam * v - shift) for s, e, v in segments]
    strong = [h for h in hits if h[2] > -math.log(SIGNIFICANCE)]
    if strong:
        return sum(h[2] for h in strong), strong
    return min(max(h[2] for h in hits), -math.log(SIGNIFICANCE)), []


def squeeze(x: float) -> float:
    return math.copysign(math.log1p(abs(x)), x)


def fit(texts: list[str | None], labels: list[int]) -> dict | None:
    once = {t or "": k for t, k in zip(texts, labels)}     # copies are one example
    texts, y = list(once), np.array(list(once.values()))
    sets = [plain_tokens(t) for t in texts]
    if y.min() == y.max():
        return None

    def odds(rows):
        return log_odds([sets[i] for i in rows if y[i]], [sets[i] for i in rows if not y[i]])

    # cross-fitting: each half is scored by the odds of the other
    halves = [[i for i in range(len(y)) if i % 2 == k] for k in (0, 1)]
    if any(len({int(y[i]) for i in h}) < 2 for h in halves):
        halves = [list(range(len(y)))] * 2
    values = {}
    for mine, other in (halves, halves[::-1]):
        scores = TokenScores(odds(other))
        for i in mine:
            values[i] = token_scores(texts[i], scores)
    clean = [values[i] for i in values if not y[i] and len(values[i])]
    lam = karlin_lambda(np.concatenate(clean) if clean else np.zeros(0))
    # the largest of n chance segments has mean (ln(K n) + Euler's constant) / lambda
    tops = [lam * max(v for _, _, v in seg) - math.log(len(x)) for x in clean if (seg := maximal_segments(x))]
    log_k = float(np.mean(tops)) - 0.5772156649 if tops else 0.0
    rows = sorted(values)
    x = np.array([squeeze(evidence(values[i], lam, log_k)[0]) for i in rows])
    slope, start = platt(x, y[rows].astype(float))
    return {"odds": odds(range(len(y))), "lam": lam, "log_k": log_k, "slope": slope, "start": start}


def document_score(text: str | None, model: dict, scores: TokenScores) -> tuple[float, list[tuple[int, int, float]]]:
    e, hits = evidence(token_scores(text, scores), model["lam"], model["log_k"])
    z = model["slope"] * squeeze(e) + model["start"]
    return 1 / (1 + math.exp(-min(max(z, -40), 40))), hits


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5,
                   bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` for every row of ``docs``;
    a passage is ``(start, end, surprise)`` in tokens, surprise being -ln E."""
    def train(rows):
        m = fit([r["text"] for r in rows], [r["y"] for r in rows]) if rows else None
        return json.dumps(m).encode() if m else None

    model = fit_task(labelled_sample(docs, labels, label, bound, 5, id_col, text_col), "doc_id", train)
    sent = docs.sparkSession.sparkContext.broadcast(model[0] if model else b"null")
    d = id_text(docs, id_col, text_col)

    def score(b: pa.RecordBatch):
        model, scores = loaded(sent.value)
        out = [document_score(t, model, scores) if model else (0.0, []) for t in b.column(1).to_pylist()]
        yield {"doc_id": b.column(0).to_pylist(), "score": [s for s, _ in out],
               "passages": [[{"start": s, "end": e, "surprise": v} for s, e, v in h] for _, h in out]}

    out = arrow_map(d, score, f"doc_id {dict(d.dtypes)['doc_id']}, score double, "
                              "passages array<struct<start:long,end:long,surprise:double>>")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


LOADED: dict = {}


def loaded(raw: bytes) -> tuple[dict | None, TokenScores]:
    """The model and its memo, kept per worker for the last model seen."""
    key = hash(raw)
    if key not in LOADED:
        LOADED.clear()
        model = json.loads(raw)
        LOADED[key] = (model, TokenScores(model["odds"] if model else {}))
    return LOADED[key]
