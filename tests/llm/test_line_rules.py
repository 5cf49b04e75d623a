import re
from collections import Counter, defaultdict

from riskspark.llm.line_rules import quality_rules

GAP = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows, min_docs, host_pct, share_docs=10, host_docs=100):
    norm = lambda x: " ".join(w for w in GAP.split(re.sub("[A-Z]", lambda m: m[0].lower(), x)) if w)
    lines = lambda t: [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    host = defaultdict(set)
    for _, t, h in rows:
        host[h].add(t or "")
    seen = Counter((h, n) for h, ts in host.items() for t in ts for n in {norm(x) for x in lines(t)})

    def frequent(h, x):
        n, of = seen[h, x], len(host[h])
        return n > min_docs or (of >= host_docs and n >= share_docs and n * 100 > host_pct * of)

    out = []
    for i, t, h in rows:
        t = t or ""
        w = [x for x in GAP.split(t) if x]
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        c = Counter(tri)
        rep = len({k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)})
        ls = lines(t)
        lost = sum(len(norm(x).split(" ")) for x in ls if frequent(h, norm(x)))
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(ls) - len(set(ls)), rep, failed,
                    not failed and 100 * (len(w) - lost) >= 50 * len(w), lost))
    return out


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def test_all_cases_against_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert same([tuple(r) for r in quality_rules(docs).collect()], brute(rows, 20, 5))


def test_frequent_lines_deplete_documents(spark, prose):
    shared = "Shared  LINE of many words here and some more of them"
    rows = [(k, "\n".join([shared, prose(k, 60), shared.lower()] + ["a b c d e f g"] * (k % 3)), None if k % 5 == 0 else "h") for k in range(40)]
    rows += [(90, "\n".join([shared + " x"] * 3 + [shared.upper()] * 9), "h"), (91, "\n".join([shared] * 2 + ["u v w x y z " * 20]), "h")]
    rows += [rows[0], rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [tuple(r) for r in quality_rules(df, line_min_docs=2, line_host_pct=10).collect()]
    assert same(out, brute(rows, 2, 10))
    assert any(r[-1] > 0 for r in out) and any(not r[6] and not r[7] for r in out) | any(r[7] for r in out)


def hosted(prose, name, n, times):
    """``n`` documents of a host, the first ``times`` with more words of boilerplate than their own."""
    lines = "".join("\n" + " ".join(f"{w}{j}" for w in "some shared words of this one host that come again and again".split()) for j in range(7))
    return [(f"{name}{k}", prose(1000 + k, 60) + (lines if k < times else ""), name) for k in range(n)]


def test_limits_by_the_size_of_the_host(spark, prose):
    rows = hosted(prose, "large", 900, 30)         # 3.3 % of the documents: the absolute limit
    rows += hosted(prose, "small", 10, 10)         # every document, but a small host
    rows += hosted(prose, "medium", 120, 12)       # 10 %: the share
    rows += hosted(prose, "rare", 120, 9)          # too few documents for the share
    out = quality_rules(spark.createDataFrame(rows, "doc_id string, text string, source string"))
    got = [tuple(r) for r in out.collect()]
    assert same(got, brute(rows, 20, 5))
    rejected = {r[0] for r in got if not r[6] and not r[7]}
    assert rejected == {f"large{k}" for k in range(30)} | {f"medium{k}" for k in range(12)}


def test_copies_do_not_make_their_lines_frequent(spark, prose):
    rows = [(k, prose(1, 80), "h") for k in range(30)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_min_docs=2, line_host_pct=0)
    assert all(r.kept and r.removed_words == 0 for r in out.collect())


def test_empty_table(empty):
    assert quality_rules(empty).collect() == []
