import hashlib
import random
from itertools import combinations

from pyspark.sql import functions as F

from riskspark.llm.simhash import block_masks, edited_fingerprints, hamming_pairs, near_counts, successor


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_edits_and_neighbours_against_brute_force(docs, rows_of):
    rows = sorted(rows_of(docs), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = edited_fingerprints(docs).collect()
    assert len(out) == len(rows)
    fp = {r.doc_id: r.fp for r in out}
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out)
    want = []
    for k, (i, t) in enumerate(rows):
        t = t or ""
        m, after = len(t) // 3, rows[(k + 1) % len(rows)][1] or ""
        want.append((str(i), len(t), hashlib.sha256((t[:len(t) - m] + after[:m]).encode()).hexdigest()))
    assert got == sorted(want)
    for k, (i, _) in enumerate(rows):
        j = rows[(k + 1) % len(rows)][0]
        if i != j and [x for x, _ in rows].count(i) == [x for x, _ in rows].count(j) == 1:
            r = next(r for r in out if r.doc_id == i)
            assert abs(r.near_next - (1 - bits(r.fp, fp[j]) / 64)) < 1e-12
            assert abs(r.near_edited - (1 - bits(int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) / 64)) < 1e-12
    assert len({r.fingerprint for r in out if r.doc_id in (2, 100, 101)}) == 1                 # copies
    assert {r.fingerprint for r in out if r.doc_id in (103, 104, 105)} == {"0" * 16}          # no terms
    assert bits(fp[3], fp[102]) < 20 < bits(fp[3], fp[4]) + 8                                   # a near copy
    assert 106 in fp and fp[106] == fp[107]                                                     # case is folded


def test_single_document_and_empty_table(docs, empty):
    one = edited_fingerprints(docs.where("doc_id = 11")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert edited_fingerprints(empty).collect() == []


def test_successor_goes_through_all_levels(spark):
    rng = random.Random(1)
    ids = sorted({rng.randrange(-(1 << 52), 1 << 52) for _ in range(300)} | {0, 1, 2, 65535, 65536, 1 << 48})
    got = dict((r.id, r.next) for r in successor(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect())
    assert got == {b: a for a, b in zip(ids, ids[1:])} | {ids[0]: ids[-1]}


def test_block_tables_find_every_pair(spark):
    assert sum(block_masks(6)) == (1 << 64) - 1
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(4)] + base + [0]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, "x") for f in signed] + [(None, "x")], "fp long, a string")
    for radius, blocks in ((3, 6), (2, 4), (5, 7)):
        want = {tuple(sorted(p)) for p in combinations(set(signed), 2) if bits(*p) <= radius}
        pairs = hamming_pairs(df, radius, blocks).collect()
        assert sorted((r.a, r.b) for r in pairs) == sorted(want) and all(r.distance == bits(r.a, r.b) for r in pairs)
    near = {r.near_fp: r.n_near for r in near_counts(df).collect()}
    assert near == {f: n for f in set(signed) if (n := sum(0 < bits(f, g) <= 3 for g in set(signed)))}


def test_no_python_in_the_plan(docs):
    out = edited_fingerprints(docs)
    plan = out.join(near_counts(out.select("fp")), F.col("fp") == F.col("near_fp"), "left")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
