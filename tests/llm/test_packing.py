import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from riskspark.llm.packing import balanced_windows, differencing, fill_up, pack_documents, power_tails

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(TOKENIZER)


def test_differencing_balances():
    assert sorted(sorted([8, 7, 6, 5, 4][i] for i in w) for w in differencing([8, 7, 6, 5, 4], 2)) == [[4, 5, 7], [6, 8]]
    rng = random.Random(1)
    sizes = [rng.randint(1, 2000) for _ in range(256)]
    windows = differencing(sizes, 130)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(256)) and max(sums) - min(sums) < 900
    assert differencing([], 3) == []


def test_window_count_rises_until_all_fit():
    assert len(balanced_windows([60, 60, 60], 100)) == 3
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 40))]
        windows = balanced_windows(sizes, 100)
        assert all(sum(sizes[i] for i in w) <= 100 for w in windows) and sorted(i for w in windows for i in w) == list(range(len(sizes)))


def test_filling_loses_nothing():
    rng = random.Random(3)
    for _ in range(100):
        windows = [[(("d", w, k), 0, rng.randint(1, 30)) for k in range(rng.randint(1, 3))] for w in range(rng.randint(1, 9))]
        full, left = fill_up([list(w) for w in windows], 100)
        tails = power_tails(left)
        assert all(sum(p[2] for p in s) == 100 for s in full)
        assert all((n := sum(p[2] for p in s)) & (n - 1) == 0 for s in tails)
        covered = defaultdict(list)
        for s in full + tails:
            for d, a, n in s:
                covered[d] += range(a, a + n)
        assert {d: sorted(x) for d, x in covered.items()} == {d: list(range(n)) for w in windows for d, _, n in w}


def check(rows, pieces):
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(TOK.encode(t or "", add_special_tokens=False).ids + [1])
    pool = {i: [[*x] for x in xs] for i, xs in want.items()}
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    total = 0
    for i, docs in pool.items():
        got = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[i])
        total += sum(g[1] for g in got)
        assert sum(g[1] for g in got) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for start, length, crc, n in got:
                assert start == at and n == len(docs[0])
                assert crc == zlib.crc32(np.array(docs[0][at:at + length], "<u4").tobytes())
                at += length
    seq = defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append((p.offset, p.length))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_whole_table(docs, rows_of):
    check(rows_of(docs), pack_documents(docs, TOKENIZER, group_docs=8).collect())


def test_carried_pieces_across_batches(spark, docs, rows_of):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(rows_of(docs), pack_documents(docs.coalesce(1), TOKENIZER, group_docs=2).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_table(empty):
    assert pack_documents(empty, TOKENIZER).collect() == []
