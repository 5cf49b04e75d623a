import random

import numpy as np
import pytest

from riskspark.llm import ngram_join as nj
from riskspark.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()), key=repr)


def test_all_cases_against_brute_force(docs, rows_of):
    assert result(docs) == brute(rows_of(docs))


def family(rng, words, n, copies, edits):
    base = [rng.choice(words) for _ in range(n)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = rng.choice(words) + "x"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def tangled(spark, words):
    """Families around the threshold, shared passages, size neighbours."""
    rng = random.Random(6)
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = family(rng, words, 80, 60, 4) + family(rng, words, 300, 25, 9) + family(rng, words, 12, 15, 1)
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(k % 40)) for k in range(50)]
    texts += [" ".join(passage.split()[:50 + k % 11]) for k in range(25)]
    return list(enumerate(texts))


@pytest.mark.parametrize("small,blocks,rare,salt", [(3, 8, 2, 100_000), (2, 4, 4, 5)])
def test_hot_keys_lose_no_link(spark, tangled, monkeypatch, small, blocks, rare, salt):
    """Thresholds that send everything through the block comparison, salted or not,
    give the same components as those that send nothing."""
    for name, value in (("SMALL", small), ("BLOCK_SETS", blocks), ("RARE_BELOW", rare), ("SALT_ROWS", salt)):
        monkeypatch.setattr(nj, name, value)
    monkeypatch.setattr(nj.frequent_tokens, "__defaults__", (rare, nj.MAX_FREQUENT))
    df = spark.createDataFrame(tangled, "doc_id long, text string")
    assert result(df) == brute(tangled)


def test_frequency_threshold_rises(spark, tangled):
    d = spark.createDataFrame(tangled, "doc_id long, text string")
    keys, df = nj.frequent_tokens(d, 16, 4, least=2, most=10)
    assert len(keys) <= 10 and (np.diff(keys.astype(object)) > 0).all() and (df >= 2).all()


def test_prefixes_of_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = rng.random(len(x)) < rng.random() * 0.16
        y = np.unique(np.concatenate((x[~drop], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 7)), dtype=np.uint64))))
        common = len(np.intersect1d(x, y))
        if not len(y) or np.array_equal(x, y) or not nj.linked(common, len(x), len(y), 85):
            continue
        share = rng.choice([0.0, 0.3, 0.9, 1.0])
        frequent = lambda t: np.where((t % np.uint64(1000)) < share * 1000, 50, 0).astype(np.int64)
        a, b = nj.prefix_keys(x, frequent(x))[0], nj.prefix_keys(y, frequent(y))[0]
        assert len(np.intersect1d(a, b)), (len(x), len(y), share)


def test_words_of_slices(monkeypatch):
    text = " ".join(f"word{k}" for k in range(2000)) + " " + "z" * 5000 + "\tend"
    whole = nj.word_hashes(text)
    monkeypatch.setattr(nj, "SLICE", 1024)
    parts = nj.word_hashes(text)
    assert len(whole) == len(parts) == 2002
    assert (whole[:2000] == parts[:2000]).all() and whole[-1] == parts[-1]


def test_spanning_links_connect_what_is_linked():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    near = {(i, j) for i in range(40) for j in range(i) if nj.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 60)}
    for links in (nj.spanning_links(sets, sets, list(range(40)), 60),
                  nj.spanning_links(sets[:15], sets[15:], list(range(40)), 60)):
        assert all((max(a, b), min(a, b)) in near for a, b in links) and len(links) < 40


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(5001, 5100)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    root = lambda i: i if up.get(i, i) == i else root(up[i])
    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_per_group(docs, rows_of):
    rows = rows_of(docs)
    kept = [tuple(r) for r in nj.one_per_group(docs).select("doc_id", "text").collect()]
    comp = {}
    for (i, t), (_, n, c) in zip(sorted(rows, key=lambda r: repr((r[0], len(shingles(r[1]))))), brute(rows)):
        comp.setdefault((i, t), (n, c))
    assert all((i, t) in rows for i, t in kept)
    assert sum(not shingles(t) for _, t in kept) == sum(not shingles(t) for _, t in rows)
    ids = [i for i, t in kept if shingles(t)]
    assert 100 not in ids and 101 not in ids and 102 not in ids and 107 not in ids and {2, 3, 106, 109} <= set(ids)
    assert nj.one_per_group(docs).columns == docs.columns
    full = nj.jaccard_components(docs).where("group_id is not null").select("group_id").distinct().count()
    assert len(ids) == full


def test_empty_table(empty):
    assert nj.jaccard_components(empty).collect() == [] == nj.one_per_group(empty).collect()


def test_runs_of_sorted_parts():
    part = np.array([0, 0, 3, 3, 3, 1 << 40], np.uint64)
    assert nj.runs_of(part) == [(0, 0, 2), (3, 2, 5), (1 << 40, 5, 6)] and nj.runs_of(part[:0]) == []


def test_near_copies_are_few_pairs(spark, words):
    """Every common key gave each pair again (near copies share some tenth of their tokens)."""
    texts = family(random.Random(8), words, 400, 6, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.sparkContext.broadcast(nj.Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64), 16))
    pairs = nj.candidates(nj.index_entries(df, none, 16, 4, 85), 85).where("NOT large").select("a", "b")
    classes = len({frozenset(shingles(t)) for t in texts})
    assert pairs.distinct().count() == classes * (classes - 1) // 2 and pairs.count() <= 4 * classes * (classes - 1) // 2


def test_a_text_travels_once_per_cluster(spark, words, monkeypatch):
    """Pairs of a cluster carried both whole sets each; now its texts are wanted once."""
    seen, write = {}, nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name: seen.setdefault(name, write(df, name)))
    monkeypatch.setattr(nj, "release", lambda *tables: None)
    texts = family(random.Random(9), words, 300, 20, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(df) == brute(list(enumerate(texts)))
    assert seen["wanted"].count() == seen["wanted"].select("node").distinct().count() <= 20 < seen["dealt-pairs"].count()


def test_frequent_tokens_as_a_bitmap():
    rng = np.random.default_rng(5)
    tokens = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2))
    keys = np.unique(nj.frequency_key(tokens[::2], 7))
    df = np.full(len(keys), 40)
    df[:3] = nj.SALT_ROWS + 5
    f = nj.Frequent(keys, df, 7)
    got = f.frequencies(tokens)
    assert (got[::2] > 0).all() and (got[1::2] > 0).mean() < 0.08 and (got > nj.SALT_ROWS).sum() == 3
    assert not nj.Frequent(keys[:0], df[:0], 7).frequencies(tokens).any()
    assert f.bits.nbytes <= 4 * len(keys) and nj.MAX_FREQUENT >= 8_000_000


def test_stored_tables_are_released(spark):
    from pathlib import Path

    from riskspark.llm.common import DROP_SHUFFLES, release, stored
    before = spark.conf.get(DROP_SHUFFLES)
    t = stored(spark.range(20).repartition(3), "t")
    at = Path(t.stored_at.removeprefix("file:"))
    assert t.count() == 20 and at.is_dir() and spark.conf.get(DROP_SHUFFLES) == before
    release(t)
    assert not at.parent.exists()
