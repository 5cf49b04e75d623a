import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import langid, quality, toxicity
from riskspark.llm.common import bounded_sample, fold
from riskspark.llm.linear import Ftrl, epochs, platt, probabilities

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


def rank_accuracy(score, y):
    pos, neg = [s for s, k in zip(score, y) if k], [s for s, k in zip(score, y) if not k]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.fixture(scope="module")
def graded(spark, prose):
    """Good prose, shouted or repeated junk, insults; nulls and odd rows besides."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(300):
        t = prose(k, rng.randint(20, 120))
        q = int(k % 4 != 0)
        if not q:
            w = t.split()
            t = " ".join(x.upper() + "!!" for x in w) if k % 8 else " ".join(x for x in w[:9] for _ in range(12))
        x = int(k % 5 == 0)
        if x:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum", "morons", "idiotic"]))
            t = " ".join(w)
        rows.append((k, t))
        if k % 3:
            labels.append((k, q, x, "clash"))
    rows += [(900, None), (901, ""), (902, " \n"), (7, rows[7][1]), (None, rows[1][1]), (903, prose(1, 20_000))]
    labels += [(1, None, None, None), (None, 1, 1, None), (2, labels[1][1], labels[1][2], "twice")]
    return (rows, {i: (q, x) for i, q, x, _ in labels if q is not None and i is not None},
            spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, predicted int, y string"),
            spark.createDataFrame(labels, LABELS))


def test_ftrl_learns_and_keeps_zero_weights():
    rng = np.random.default_rng(0)
    m = Ftrl(51, 1, alpha=0.5, l1=4.0, l2=0.01)          # 50 is the bias
    for _ in range(3000):
        idx = np.append(np.sort(rng.choice(50, 5, replace=False)), 50)
        m.update(idx, np.ones(6), np.array([float(3 in idx)]))
    w = m.weights()[:, 0]
    assert w[3] > 2 and (w == 0).sum() > 2 and np.delete(w, 3).max() < w[3] / 2
    assert np.allclose(probabilities(np.array([[1.0, 1.0]])), 0.5)
    assert [list(x) for x in epochs(5, 2)] == [list(x) for x in epochs(5, 2)]


def test_platt_recovers_a_curve():
    x = np.linspace(-3, 3, 4000)
    y = (np.random.default_rng(1).random(4000) < 1 / (1 + np.exp(-(2 * x + 0.5)))).astype(float)
    a, b = platt(x, y)
    assert abs(a - 2) < 0.3 and abs(b - 0.5) < 0.2


@pytest.mark.parametrize("score,label,cut,pos", [(quality.score_quality, "quality", 0.3, 0), (toxicity.score_toxicity, "toxic", 0.5, 1)])
def test_held_out_scores(graded, score, label, cut, pos):
    rows, labels, docs, table = graded
    out = score(docs, table).collect()
    assert sorted([r.doc_id for r in out], key=str) == sorted([i for i, _ in rows], key=str)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (held(r.doc_id, 5) == 0) for r in out)
    truth = [(r.score, labels[r.doc_id][pos]) for r in out if r.held_out and r.doc_id in labels]
    assert rank_accuracy(*zip(*truth)) > 0.95
    blank = {r.score for r in out if r.doc_id in (900, 901, 902)}
    assert len(blank) == 1
    assert len({r.score for r in out if r.doc_id == 7}) == 1          # repeated rows


def test_without_labels(graded, empty, spark):
    _, _, docs, table = graded
    none = table.where("quality = 99")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert quality.score_quality(empty, table).collect() == [] == toxicity.score_toxicity(empty, table).collect()


def test_labels_of_the_held_out_fold_are_not_learned(graded, spark):
    _, _, docs, table = graded
    flipped = table.withColumn("quality", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert flipped.exceptAll(table).count() > 10
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.score_quality(docs, t).collect()) for t in (table, flipped))
    assert a == b


def test_quality_keeps_rows_unchanged(graded):
    rows, _, docs, table = graded
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns
    good = sorted(str(r.doc_id) for r in quality.score_quality(docs, table).collect() if r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == good


def brute_segments(s):
    """Maximal segments by their definition: split at the best segment, recurse."""
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += s[b]
                if total > 1e-12 and (top is None or total > top[0] + 1e-9 or (abs(total - top[0]) <= 1e-9 and (b - a) < top[2] - top[1] - 1)):
                    top = (total, a, b + 1)
        return [] if top is None else best(lo, top[1]) + [top] + best(top[2], hi)
    return [(a, b) for _, a, b in best(0, len(s))]


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        s = rng.normal(-0.2, 1, rng.integers(0, 25))
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute_segments(s.tolist())
    assert toxicity.maximal_segments(np.zeros(0)) == [] == toxicity.maximal_segments(-np.ones(4))
    s = np.tile([1.0, -1.0], 200_000)               # linear time
    assert len(toxicity.maximal_segments(s)) == 200_000


def test_karlin_lambda_solves_its_equation():
    s = np.array([-1.0] * 9 + [2.0])
    lam = toxicity.karlin_lambda(s)
    assert abs(np.exp(lam * s).mean() - 1) < 1e-6 and lam > 0


def test_passages_are_found(graded, spark):
    _, _, docs, table = graded
    out = toxicity.score_toxicity(docs, table).where("size(passages) > 0").collect()
    text = dict((r.doc_id, r.text) for r in docs.collect())
    assert out
    hits = [" ".join(toxicity.tokens(text[r.doc_id])[p.start:p.end]) for r in out for p in r.passages]
    assert np.mean([any(w in h for w in ("idiot", "moron", "scum")) for h in hits]) > 0.9


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    sounds = {"xx": ["ka", "to", "ri", "shi", "mu"], "yy": ["ße", "ich", "ung", "ver", "ste"], "zz": ["ción", "os", "ll", "ña", "que"]}
    rows = []
    for k in range(240):
        lang = "xyz"[k % 3] * 2
        rows.append((k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))),
                     lang if k % 7 else None))
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 !! 4", "yy"), (903, "katori " * 30_000, "xx"), (5, rows[5][1], "zz"), (None, "katori mu", "xx")]
    return rows, spark.createDataFrame([(*r, "clash", 0.1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_languages_held_out(spoken):
    rows, docs = spoken
    out = langid.identify_language(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    truth = {i: "xyz"[i % 3] * 2 for i in range(240)}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]) > 0.97
    assert all(r.held_out == (held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in out)
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (900, 901, 902))
    assert all(r.lang_pred == "xx" for r in out if r.doc_id == 903)


def test_a_rare_language_is_learned(spark):
    """Six documents among 600 (one without a letter), a sample of 40: still a language."""
    rng = random.Random(4)
    say = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    rows = [(k, say(["ka", "to", "ri"]) if k % 2 else say(["sch", "ung", "lich"]), "aa" if k % 2 else "bb") for k in range(600)]
    rare = [i for i in range(1000, 1100) if held(i, 3) != 1][:6]
    rows += [(i, "12 !" if i == rare[0] else say(["ñu", "xe", "žo"]), "rr") for i in rare]
    rows += [(2000 + k, say(["ñu", "xe", "žo"]), None) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in langid.identify_language(docs, bound=40).collect()}
    assert [out[2000 + k] for k in range(5)] == ["rr"] * 5
    assert np.mean([out[i] == lang for i, _, lang in rows[:600]]) > 0.97


def test_language_features_of_slices_add_up():
    text = "abc déf, ghi! " * 50
    whole = langid.features(text)
    old, langid.SLICE = langid.SLICE, 97
    try:
        parts = langid.features(text)
    finally:
        langid.SLICE = old
    assert abs(int(whole.sum()) - int(parts.sum())) < 60 and np.corrcoef(whole, parts)[0, 1] > 0.98


def test_languages_without_training(spoken, empty):
    _, docs = spoken
    out = langid.identify_language(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in out} == {"und"}
    assert langid.identify_language(empty).collect() == []
    one = langid.identify_language(docs.where("lang = 'xx' OR lang IS NULL")).collect()
    assert {r.lang_pred for r in one} <= {"xx", "und"}


def test_temperature_flattens_overconfident_logits():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 3000)
    z = np.eye(3)[np.where(rng.random(3000) < 0.7, y, rng.integers(0, 3, 3000))] * 20
    assert langid.temperature(z, y) > 5


# ------------------------------------------------- whole scores, recomputed plainly

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def brute_quality(text, w):
    """Counts of hashed n-grams times weights, in plain integers."""
    words = (text or "").split()
    a = [zlib.crc32(x.lower().encode()) for x in words]
    s = [2 * zlib.crc32(quality.shape_of(x).encode()) + (i > 0 and a[i] == a[i - 1]) for i, x in enumerate(words)]
    b, c = 0x100000001B3, 0x9E3779B97F4A7C15
    families = [a, [x * b + y for x, y in zip(a, a[1:])], s, [x * b + y for x, y in zip(s, s[1:])],
                [(x * b + y) * c + z for x, y, z in zip(s, s[1:], s[2:])]]
    logit = float(w[0])
    for k, grams in enumerate(families, 1):
        for g in grams:
            h = (g + k * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & M64
            place = ((h ^ h >> 29) * 0x94D049BB133111EB & M64) >> 64 - quality.BITS
            logit += quality.SCALE / len(grams) * float(w[place])
    return 1 / (1 + np.exp(-logit))


def test_quality_scores_of_every_row_against_brute_force(graded):
    rows, _, docs, table = graded
    w = np.frombuffer(quality.fit_quality(docs, table).value, np.float32)
    got = sorted((str(r.doc_id), r.score) for r in quality.score_quality(docs, table).collect())
    want = sorted((str(i), brute_quality(t, w)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-4


def test_a_score_at_the_cut_counts(graded):
    _, _, docs, table = graded
    score = sorted(r.score for r in quality.score_quality(docs, table).collect())[150]
    assert {r.predicted for r in quality.score_quality(docs, table, threshold=score).collect() if r.score == score} == {1}
    tox = sorted(r.score for r in toxicity.score_toxicity(docs, table).collect())[150]
    assert {r.predicted for r in toxicity.score_toxicity(docs, table, threshold=tox).collect() if r.score == tox} == {1}


def brute_toxicity(text, m):
    ts = (text or "").lower().split()
    values = []
    for i, raw in enumerate(ts):
        token = toxicity.EDGE.sub("", raw)
        known = [m["odds"][s] for s in [token, *(token[:k] + "*" for k in (6, 5, 4, 3) if len(token) >= k)] if token and s in m["odds"]]
        odds = min(max(known[0] if known else 0.0, toxicity.LOWEST), toxicity.HIGHEST)
        values.append(-toxicity.DRIFT if i and ts[i - 1] == raw else odds - toxicity.DRIFT)
    # surprise of every segment: -ln(K n exp(-lambda S))
    found = [m["lam"] * sum(values[a:b]) - m["log_k"] - np.log(len(ts)) for a, b in brute_segments(values)]
    limit = -np.log(toxicity.SIGNIFICANCE)
    strong = [x for x in found if x > limit]
    e = sum(strong) if strong else min(max(found), limit) if found else 0.0
    return 1 / (1 + np.exp(-(m["slope"] * np.sign(e) * np.log1p(abs(e)) + m["start"]))), len(strong)


def test_toxicity_scores_against_brute_segments(graded):
    rows, _, docs, table = graded
    sample = [r.asDict() for r in quality.labelled_sample(docs, table, "toxic", toxicity.BOUND).collect()]
    sample.sort(key=lambda r: (str(r["doc_id"]), str(r)))
    m = toxicity.fit([r["text"] for r in sample], [r["y"] for r in sample])
    short = [(i, t) for i, t in rows if len((t or "").split()) < 200]
    assert len(short) == len(rows) - 1                          # all but the text of 20,000 words
    got = sorted((str(r.doc_id), r.score, len(r.passages)) for r in toxicity.score_toxicity(docs, table).collect() if r.doc_id != 903)
    want = sorted((str(i), *brute_toxicity(t, m)) for i, t in short)
    assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in want]
    assert max(abs(a - b) for (_, a, _), (_, b, _) in zip(got, want)) < 1e-6


def brute_counts(text):
    """Hashed 1-, 2- and 3-grams of letters and single gaps, in plain integers."""
    a = []
    for ch in f" {text.lower()} ":
        x = ord(ch) if ord(ch) > 0xFFFF or ch.isalpha() else 0
        if x or not a or a[-1]:
            a.append(x)
    two = [(x * 0x9E3779B1 + y * 0x85EBCA6B) & M32 for x, y in zip(a, a[1:])]
    grams = [x * 0x165667B1 for x in a[1:-1]] + two + [t * 0xC2B2AE35 + z * 0x27D4EB2F for t, z in zip(two, a[2:])]
    counts = {}
    for g in grams:
        k = (g * 0x9E3779B1 & M32) >> 32 - langid.BITS
        counts[k] = counts.get(k, 0) + 1
    return counts


def test_languages_of_every_row_against_brute_force(spoken):
    rows, docs = spoken
    meta, raw, idf = langid.fit_language(docs).value
    w = np.frombuffer(raw, np.float32).reshape(langid.DIM, -1)
    learned = [brute_counts(t) for i, t, lang in rows if t and lang and held(i, 3) != 1]
    df = np.zeros(langid.DIM)
    for counts in learned:
        df[list(counts)] += 1
    assert np.allclose(idf, np.log((1 + len(learned)) / (1 + df)) + 1)
    want = []
    for i, t, _ in rows:
        if not any(ch.isalpha() for ch in t or ""):
            want.append((str(i), "und", 0.0))
            continue
        val = {k: n ** 0.5 * idf[k] for k, n in brute_counts(t).items()}
        norm = sum(v * v for v in val.values()) ** 0.5
        logits = [sum(v / norm * float(w[k, j]) for k, v in val.items()) / meta["t"] for j in range(len(meta["names"]))]
        p = [1 / sum(np.exp(y - x) for y in logits) for x in logits]
        want.append((str(i), meta["names"][p.index(max(p))], max(p)))
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.identify_language(docs).collect())
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want)) < 1e-5


def test_equal_probabilities_go_to_the_first_language():
    flat = np.zeros((langid.DIM, 3), np.float32)
    model = ({"names": ["aa", "bb", "cc"], "t": 1.0}, flat.tobytes(), np.ones(langid.DIM))
    assert langid.predictions(["some text"], model) == (["aa"], [pytest.approx(1 / 3)])


def test_bounded_samples_are_the_smallest_hashes(spark):
    rows = [(k,) for k in range(3000)] + [(None,), (7,), (7,)]
    df = spark.createDataFrame(rows, "k long").repartition(13)
    every = [r.k for r in df.orderBy(F.xxhash64(F.col("k").cast("string")), "k").collect()]
    for bound in (1, 2, 160, 2000, 3003, 5000):
        assert sorted((r.k for r in bounded_sample(df, "k", bound).collect()), key=str) == sorted(every[:bound], key=str)
    same = spark.createDataFrame([("a",)] * 50, "k string")
    assert bounded_sample(same, "k", 20).count() == 20 and bounded_sample(same, "k", 99).count() == 50
    assert bounded_sample(df.where("k < 0"), "k", 10).count() == 0


def test_a_bounded_sample_sorts_few_rows_whatever_the_partitions(spark):
    """What reaches the sort: the rows whose hash is short enough, about twice the bound."""
    df = spark.range(40_000).repartition(200)
    for bound in (50, 500):
        plan = bounded_sample(df, "id", bound)._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "Filter":
            plan = plan.children().head()
        short = plan.condition().sql()
        kept = df.where(short).count()
        assert bound <= kept <= 3 * bound


def test_document_frequencies_count_documents(spark, graded):
    texts = [t for _, t in graded[0] if t]
    got, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(langid.DIM, np.int64)
    for t in texts:
        want += langid.features(t) > 0
    assert n == len(texts) and (got == want).all()
    got, n = langid.document_frequencies(spark.createDataFrame([], "text string"))
    assert n == 0 and not got.any()
