import random
import re
from collections import Counter, defaultdict

import numpy as np

from riskspark.llm.collocations import BITS, PhraseGraph, collocations, counted


def brute(rows, least, top):
    """Plain counts of every phrase, scored with Python's whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        heavy = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in heavy.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in heavy.items()):
                continue
            score, k, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", "y") for k, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, head string, node string")


def invented(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "ÉTÉ", "x#", "a", "b", "c d", "new", "York", "city", "\U0001f600"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.5:
            text += " once upon a time in a far away land there was a king."
        out.append((rng.choice(["en", "en", "fr", None]), rng.choice([text, text, text, None, ""])))
    return out + [("de", "la la la la la la la la la la la la la"), ("de", " "), ("es", "one"), ("en", "Ab cd " * 3000)]


def test_against_plain_counts(spark):
    rows = invented(1, 300)
    for top in (2000, 7):
        got = sorted(map(tuple, collocations(table(spark, rows), least=10, top=top).collect()))
        assert got == brute(rows, 10, top) and got


def test_ties_at_the_limit_of_score_and_count(spark):
    rows = [("en", ". ".join(f"w{k} v{k}" for k in range(40)))] * 12 + [("en", "w0 v0")]
    for top in (1, 5, 40):
        got = sorted(map(tuple, collocations(table(spark, rows), least=10, top=top).collect()))
        assert got == brute(rows, 10, top) and len(got) == top


def test_unary_paths_hold_each_edge_once(spark):
    rows = invented(2, 200)
    graph = PhraseGraph(table(spark, rows), least=10)
    paths = graph.paths().collect()
    edges = Counter((r.lang, " ".join(r.words[i:i + 3]), r.c) for r in paths for i in range(len(r.words) - 2))
    assert edges == Counter((r.lang, f"{r.head} {r.tail}", r.c) for r in graph.edges.collect())
    assert any("upon a time in" in " ".join(r.words) for r in paths)         # a passage is one path


def test_many_different_words_in_one_text():
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 9, (3, 2000))
    for words in (1 << BITS, 10):
        x, y, z, n = counted(a, b, c, words)
        assert dict(zip(zip(x.tolist(), y.tolist(), z.tolist()), n.tolist())) == Counter(zip(a.tolist(), b.tolist(), c.tolist()))


def test_large_products_are_exact(spark):
    from riskspark.llm.collocations import scored
    a, left, right = 9_000_000_000, 9_000_000_001, 9_123_456_789_012
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(scored("a", "l", "r").alias("s"))
    assert df.first().s == 1_000_000 * a * a // (left * right)


def test_empty_and_wordless(spark):
    assert collocations(table(spark, [])).collect() == []
    assert collocations(table(spark, [("en", None), (None, " ,.")])).collect() == []
