"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates come from generators: four base patterns, whose valid matches are always
kept, and looser ones (card numbers inside longer runs of digits, phone numbers without
a country code, addresses written with ``at`` and ``dot``, long IP addresses). Regex,
gazetteer and context labelers vote on each candidate (1, 0, or no vote). Expectation
maximisation estimates, for each kind, the share of personal data and how each
labeler votes on true and on false candidates; its posteriors are the soft labels of a
logistic regression on votes and on the shape of the span, which decides about the
candidates that are not base spans.

Texts are read once, without a shuffle: positions come from the lengths of what stands
between matches. The candidates (a few per text) are a table in the shared folder. The
fit sees all of them as counts per pattern of votes and shape, at most ``PATTERNS``
rows whatever the corpus, and only these reach the driver. Patterns are possessive and
start at run borders (or where the last match ended), so they are linear in a text.

Defined cases: a null text is empty and has no spans. Repeated rows each give a row.
Columns beyond the named ones are ignored. An empty table gives no rows; without
candidates there is no classifier and nothing is added. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import id_text, stored

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5
CONTEXT = 40                 # code points of the text before a candidate, up to the last match, that labelers read
PATTERNS = len(KINDS) * 3 * 2 * 2 * 2 * 2 * 2 * 5 * 5
CHUNK = 256                  # lengths summed at a time, so that many matches in a text stay cheap

# The base patterns, written so that no start inside a run is tried again.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}       # a text without it has no match
LOOSE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?: ?[\[({{]at[\])}}] ?[A-Za-z0-9-]++(?: ?[\[({{]dot[\])}}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"
             r"| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3} ?|(?<![0-9+.-]))(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
LOOSE_NEEDED = {"email": ("at]", "at)", "at}", " dot "), "ip": (":",), "card": None, "phone": (")", " ", "-", ".")}

# Gazetteers (top-level domains, issuer prefixes, calling codes) and context words.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|int|info|biz|io|co|me|eu|de|fr|es|it|uk|us|ca|au|nl|ch|at|be|se|no|dk|fi|pl|pt|br|mx|ar|jp|cn|in|ru)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-8]|30[0-5]|62|65|6011|64[4-9])"
CALLING = (r"^\+(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]"
           r"|9[0-58]|9[679][0-9])|^\(?[2-9][0-9]")
RESERVED = r"^(?:0+|127|22[4-9]|2[3-5][0-9])\."
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
WORDS = {
    "email": r"(?i)mail|contact|write to|courriel|correo|kontakt",
    "ip": r"(?i)\bip\b|address|server|host|adresse|direcci",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|\btel|call|mobile|\bfax|\bcell|anruf|appel|telefon|tel.fono|llam",
}
AGAINST = r"(?i)version|\bv\.? ?$|isbn|\bean\b|order|invoice|section|chapter|\bpage|figure|token|key|hash|password"


# ------------------------------------------------------------ matches and places


def any_of(text: str, needles: tuple | None) -> Column:
    return F.lit(True) if needles is None else reduce(Column.__or__, (F.contains(F.col(text), F.lit(n)) for n in needles))


def find_all(df: DataFrame, patterns: dict[str, tuple[str, tuple | None]], text: str = "text") -> DataFrame:
    """Adds, per name, an array of (start, end, found, left, right) of all matches, and
    drops the text. Positions are code points."""
    names, rest = list(patterns), [c for c in df.columns if c != text]
    none = F.array().cast("array<string>")
    df = df.select("*", *(F.when(any_of(text, need), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{n}_m")
                          for n, (p, need) in patterns.items()))
    # what stands between the matches, one more than they are
    df = df.select(*rest, *(f"{n}_m" for n in names),
                   *(F.when(F.size(f"{n}_m") > 0, F.split(text, p, -1)).otherwise(none).alias(f"{n}_s") for n, (p, _) in patterns.items()))
    zero = F.lit(0).cast("long")

    def lengths_of(n):
        return F.transform(f"{n}_m", lambda m, i: (F.length(m) + F.length(F.get(f"{n}_s", i))).cast("long"))

    def total(lengths):
        return F.aggregate(lengths, zero, lambda a, x: a + x)

    def chunk_starts(n):
        chunks = F.sequence(F.lit(0), F.floor((F.size(f"{n}_l") - 1) / CHUNK).cast("int"))
        return F.when(F.size(f"{n}_l") > 0, F.aggregate(chunks, F.array(zero), lambda a, c: F.concat(
            a, F.array(F.get(a, c) + total(F.slice(f"{n}_l", c * CHUNK + 1, CHUNK))))))

    df = df.select("*", *(lengths_of(n).alias(f"{n}_l") for n in names))
    df = df.select("*", *(chunk_starts(n).alias(f"{n}_c") for n in names))

    def place(n):
        def one(m, i):
            chunk = F.floor(i / CHUNK).cast("int")
            before = F.get(f"{n}_c", chunk) + total(F.slice(f"{n}_l", chunk * CHUNK + 1, i - chunk * CHUNK))
            gap = F.get(f"{n}_s", i)
            start = before + F.length(gap)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"),
                            F.substring(gap, -CONTEXT, CONTEXT).alias("left"), F.substring(F.get(f"{n}_s", i + 1), 1, 1).alias("right"))
        return F.transform(f"{n}_m", one)

    return df.select(*rest, *(place(n).alias(n) for n in names))


# ------------------------------------------------------------ checks and votes


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of 12 to 19 digits passes the Luhn check."""
    def add(acc, i):
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(x)
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, s: Column) -> Column:
    """Whether a base match is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    return luhn(digits(s)) if kind == "card" else F.length(digits(s)).between(9, 15)


def checked(kind: str, s: Column) -> Column:
    if kind == "email":
        return s.rlike(r"(?:\.|dot[\])}]? ?)[A-Za-z]{2,}$")
    return s.contains(":") | valid(kind, s) if kind == "ip" else valid(kind, s)


def listed(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.regexp_replace(s, r" ?[\[({ ]dot[\])} ] ?", ".").rlike(DOMAINS)
    if kind == "ip":
        return ~s.rlike(RESERVED)
    return digits(s).rlike(ISSUERS) if kind == "card" else s.rlike(CALLING)


VOTES = ("form", "check", "gazetteer", "context", "against", "border")
SHAPES = ("join", "size")


def candidate(kind: str, x: Column, base: bool) -> Column:
    """A match with its votes and shape; ``base`` says which generator found it."""
    s = x["found"]
    ok = valid(kind, s) if base else F.lit(False)
    form = F.when(ok, 1).otherwise(F.lit(0 if base else None).cast("int"))
    glued = x["right"].rlike("^[A-Za-z0-9_@]") | x["left"].rlike("[A-Za-z0-9_@]$")
    n = F.length(digits(s))
    return F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), s.alias("found"), ok.alias("base"), F.lit(not base).alias("open"),
        form.cast("int").alias("form"), F.when(checked(kind, s), 1).otherwise(0).alias("check"), F.when(listed(kind, s), 1).otherwise(0).alias("gazetteer"),
        F.when(x["left"].rlike(WORDS[kind]), 1).alias("context"), F.when(x["left"].rlike(AGAINST), 0).alias("against"),
        F.when(glued, 0).otherwise(1).alias("border"),
        F.when(s.rlike(r"[()\[{]"), 4).when(s.contains(" "), 3).when(s.contains("-"), 2).when(s.contains("."), 1).otherwise(0).alias("join"),
        F.when(n < 9, 0).when(n < 12, 1).when(n < 16, 2).when(n < 20, 3).otherwise(4).alias("size"))


def voted(kind: str, base: bool):
    return lambda x: candidate(kind, x, base)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: every text's candidates. Those of loose generators that touch a
    base span are left out: it already covers them."""
    d = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    patterns = {f"b_{k}": (BASE[k], NEEDED[k] and (NEEDED[k],)) for k in KINDS} | {f"l_{k}": (LOOSE[k], LOOSE_NEEDED[k]) for k in KINDS}
    d = find_all(d, patterns)
    every = lambda lead, base: F.concat(*(F.transform(f"{lead}_{k}", voted(k, base)) for k in KINDS))
    d = d.select("doc_id", every("b", True).alias("b"), every("l", False).alias("l"))
    d = d.select("doc_id", "b", "l", F.filter("b", lambda x: x["base"]).alias("sure"))
    free = F.when(F.size("l") == 0, F.col("l")).otherwise(F.filter("l", lambda x: ~F.exists("sure", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))))
    return d.select("doc_id", F.concat("b", free).alias("found"))


# ------------------------------------------------------------ reliabilities and classifier


@dataclass
class Reliability:
    """Of one kind: share of personal data, and P(vote | truth) by labeler; a vote is
    1, 0 or None."""
    share: float
    votes: dict[str, dict[tuple[int, int | None], float]]


def reliabilities(patterns: list[tuple[dict, int]], rounds: int = 200, believe: float = 0.8) -> tuple[Reliability, list[float]]:
    """Expectation maximisation over vote patterns (votes, count) of one kind; also
    the posterior of each pattern.

    A prior worth a twentieth of the candidates (20 at least) says that a labeler is
    right in ``believe`` of its votes: it keeps the two classes from changing places, and
    from merging where all candidates look alike."""
    n = sum(c for _, c in patterns)
    prior = 20 + n / 20
    said = [[v for v in p.values() if v is not None] for p, _ in patterns]
    post = [sum(s) / len(s) if s else 0.5 for s in said]
    model = Reliability(0.5, {})
    for _ in range(rounds):
        mass = [sum(c * (q if y else 1 - q) for q, (_, c) in zip(post, patterns)) for y in (0, 1)]
        share = (mass[1] + 2) / (n + 4)
        votes = {}
        for j in VOTES:
            # no vote is as likely as it is overall: only votes tell the classes apart
            silent = sum(c for p, c in patterns if p[j] is None) / n
            table: dict = {(y, None): max(silent, 1e-9) for y in (0, 1)}
            one_sided = j in ("context", "against")
            for y in (0, 1):
                weight = {v: sum(c * (q if y else 1 - q) for q, (p, c) in zip(post, patterns) if p[j] == v) for v in (0, 1)}
                if one_sided:
                    # these vote one way only: how often they speak is what tells
                    v = 1 if j == "context" else 0
                    rate = (weight[v] + prior * (0.3 if v == y else 0.05)) / (mass[y] + prior)
                    table |= {(y, v): rate, (y, 1 - v): 1e-9, (y, None): 1 - rate}
                else:
                    spoke = weight[0] + weight[1]
                    for v in (0, 1):
                        table[y, v] = (1 - silent) * (weight[v] + prior * (believe if v == y else 1 - believe)) / (spoke + prior) + 1e-9
            votes[j] = table
        model = Reliability(share, votes)
        new = [posterior(model, p) for p, _ in patterns]
        change = max((abs(a - b) for a, b in zip(new, post)), default=0.0)
        post = new
        if change < 1e-9:
            break
    return model, post


def posterior(model: Reliability, votes: dict) -> float:
    odds = math.log(model.share) - math.log(1 - model.share) + sum(math.log(model.votes[j][1, v] / model.votes[j][0, v]) for j, v in votes.items())
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def indicators(row) -> list[float]:
    """Features of a pattern: kind, kind by vote, and shape, all 0 or 1."""
    return [float(v) for v in feature_values(row["kind"], {j: row[j] for j in VOTES}, row["join"], row["size"])]


def feature_values(kind, votes, join, size) -> list[bool]:
    out = [kind == k for k in KINDS]
    out += [votes[j] == v for j in VOTES for v in (0, 1)]
    out += [join == k for k in range(1, 5)] + [size == k for k in range(1, 5)]
    return out


def fit_classifier(rows: list, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray | None, dict[str, Reliability]]:
    """Weights of the final classifier (bias last) from pattern rows with their count
    ``n``: soft labels by ``reliabilities``, logistic regression by Newton's method."""
    if not rows:
        return None, {}
    models, soft = {}, [0.0] * len(rows)
    for kind in KINDS:
        mine = [i for i, r in enumerate(rows) if r["kind"] == kind]
        if mine:
            models[kind], post = reliabilities([({j: rows[i][j] for j in VOTES}, rows[i]["n"]) for i in mine])
            for i, q in zip(mine, post):
                soft[i] = q
    x = np.array([[*indicators(r), 1.0] for r in rows])
    y, n = np.array(soft), np.array([float(r["n"]) for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (n * p * (1 - p)) @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w, models


def pattern_counts(found: DataFrame) -> list:
    """Counts of all candidates by votes and shape, at most ``PATTERNS`` rows."""
    x = found.select(F.explode("found").alias("x")).select("x.kind", *(f"x.{c}" for c in (*VOTES, *SHAPES)))
    return sorted(x.groupBy("kind", *VOTES, *SHAPES).agg(F.count("*").alias("n")).limit(PATTERNS).collect(), key=str)


def score(x: Column, weights: np.ndarray) -> Column:
    """The classifier's probability for a candidate, as a Column."""
    terms = feature_values(x["kind"], {j: x[j] for j in VOTES}, x["join"], x["size"])
    z = reduce(Column.__add__, (F.when(t, float(w)).otherwise(0.0) for t, w in zip(terms, weights)), F.lit(float(weights[-1])))
    return 1 / (1 + F.exp(-z))


# ------------------------------------------------------------ the operator


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``doc_id, spans``: per row the personal data found, ordered by place: kind, start,
    end (code points), the text itself, whether it is a base span, and its score."""
    found = stored(candidates(docs, id_col, text_col), "span-candidates")
    weights, _ = fit_classifier(pattern_counts(found))
    rated = (lambda x: F.lit(0.0)) if weights is None else (lambda x: score(x, weights))
    order = lambda x: F.when(x["kind"] == "email", 0).when(x["kind"] == "ip", 1).when(x["kind"] == "card", 2).otherwise(3)
    spans = F.transform("found", lambda x: F.struct(x["start"].alias("start"), order(x).alias("order"), x["end"].alias("end"), x["kind"].alias("kind"),
                                                    x["found"].alias("text"), x["base"].alias("base"), x["open"].alias("open"), rated(x).alias("score")))
    kept = F.array_sort(F.filter("spans", lambda x: x["base"] | (x["open"] & (x["score"] >= accept))))
    return found.select("doc_id", spans.alias("spans")).select("doc_id", F.transform(kept, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["base"].alias("base"), x["score"].alias("score"))).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Per row: counts of base spans by kind, their hash, and all spans as text."""
    found = personal_data(docs).select("doc_id", "spans", F.filter("spans", lambda x: x["base"]).alias("base"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
