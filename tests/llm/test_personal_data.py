import hashlib
import random
import re

import pytest

from riskspark.llm.personal_data import KINDS, candidates, fit_classifier, pattern_counts, personal_data, personal_data_digest, reliabilities

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or \
                    kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def check(rows, got):
    want = sorted(((i, *(sum(s.startswith(k) for s in brute(t)) for k in KINDS), hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == want
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append(r.spans)
    for i, t in rows:
        assert any(set(brute(t)) <= set(s.split(",") if s else ()) for s in spans[i])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    parts = ["a.b@c.d", "x@y", "@", "a@b@c.de", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "4465758382889437", "+1 (743) 555-3824", "+49 30 1", "+1(2)3", "555-123-4567", "\U0001f600", "é", " ", "\n", "..", "%a@b-c.d-e.", "12", "-", "+", "(", "word"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25))) for _ in range(400)]


def test_base_spans_against_plain_patterns(spark, texts):
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "7" * 30_000 + "@"), (903, "a" * 30_000 + ".b" * 9000 + "@c" + ".d" * 9000),
            (904, "1.2.3.4 " * 3000), (905, "+1" * 5000), (906, "4111111111111111 " * 900), (3, "a@b.c"), (3, texts[3]), (None, "a@b.c")]
    table = spark.createDataFrame([(i, t, "found", 1) for i, t in rows], "doc_id long, text string, found string, b int")
    check(rows, personal_data_digest(table).collect())


def test_whole_table(docs, rows_of):
    check(rows_of(docs), personal_data_digest(docs).collect())


def test_adds_what_the_base_misses(spark):
    """A run of two card numbers, a phone number without a country code and a spelled
    address are found; numbers that fail their checks, versions and prose are not."""
    base = [f"Mail me: user{k}@mail{k % 9}.example.com or call +1 (212) 555-{1000 + k}." for k in range(300)]
    base += [f"card 4111111111111111 and server 10.1.{k}.7" for k in range(200)] + [f"order no. {k * 7919 % 10**9:012d}" for k in range(300)]
    new = ["pay by card 4465758382889437 4465758382889437 now", "call (212) 555-0199 today", "contact: jane [at] example [dot] com please"]
    clean = ["release 4465758382889438 4465758382889431 of it", "we look at the house", "plain words only", "hash 3ed3cc8548923d6, version 1.2.3"]
    texts = base + new + clean
    out = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [[(s.kind, s.text) for s in out[len(base) + k]] for k in range(len(new))]
    assert found == [[("card", "4465758382889437")] * 2, [("phone", "(212) 555-0199")], [("email", "jane [at] example [dot] com")]]
    assert all(not out[len(base) + len(new) + k] for k in range(len(clean)))
    for i, spans in out.items():
        for s in spans:
            assert texts[i][s.start:s.end] == s.text and 0 <= s.score <= 1


def test_reliabilities_of_known_labelers():
    """Votes drawn by labelers of known accuracy: the estimates come near it."""
    rng = random.Random(2)
    right = {"form": 0.9, "check": 0.85, "gazetteer": 0.7, "border": 0.75}
    count = {}
    for _ in range(20_000):
        y = rng.random() < 0.6
        votes = tuple(int(y) if rng.random() < p else 1 - int(y) for p in right.values())
        count[votes] = count.get(votes, 0) + 1
    model, post = reliabilities([({**dict(zip(right, v)), "context": None, "against": None}, n) for v, n in count.items()])
    assert abs(model.share - 0.6) < 0.05
    for j, p in right.items():
        assert abs(model.votes[j][1, 1] - p) < 0.06 and abs(model.votes[j][0, 0] - p) < 0.06
    assert all(0 <= q <= 1 for q in post)


def test_patterns_are_bounded_and_fit_is_repeatable(spark, texts):
    found = candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = pattern_counts(found)
    assert sum(r.n for r in rows) == sum(len(r.found) for r in found.collect())
    a, b = fit_classifier(rows)[0], fit_classifier(list(rows))[0]
    assert a.tolist() == b.tolist() and fit_classifier([])[0] is None


def test_empty(empty):
    assert personal_data_digest(empty).collect() == []
