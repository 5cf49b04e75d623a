"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces and words. An edge is a longest gram (three words) from the
node of its first two words to the node of its last two; its weight is its number of
occurrences. Shorter phrases are never counted on their own: a node's count is the
weight that leaves it plus the pieces that end there, and a word's count is the flow
of the nodes that begin with it plus the pieces that end with it. Flows are additive,
so every task sums those of its own part of the graph and only the sums are shuffled:
once, by (language, node), which also holds all edges that leave a node together.

Edges that pass a node through which all of its flow runs (one edge in, one out, all
of equal weight) are compacted into unary paths by pointer doubling; the candidates
of a path share its weight, and so do the nodes inside it, whose counts need no join.

Only edges and nodes that occur often enough are kept after the sums, which loses
nothing: a phrase occurs at least as often as a longer one that holds it, so parts of
candidates are always there. The best phrases of a language are found without
gathering its candidates: a histogram of scores, then of counts at the limiting
score, gives the least (score, count) that can be among them.

Defined cases: a null text has no words; a null language is ``und``; rows that repeat
count each. A word, like a piece, may be of any length. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import ship, stored

LEAST, TOP, HELD_PCT = 10, 2000, 50
BROADCAST_LANGUAGES = 100_000
FLUSH_WORDS, FLUSH_VOCABULARY = 1 << 21, 1 << 18      # a task sums its graph in parts of this size
BORDER = b"\xff"             # stands in no UTF-8 text
# upper case to lower case, tab to space, every end of a piece to BORDER
FORM = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + BORDER * 10)
BITS = 21                    # of a word's number within a part


def counted(a: np.ndarray, b: np.ndarray, c: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Distinct triples of word numbers with their counts."""
    if words < 1 << BITS:
        edges, n = np.unique(a << 2 * BITS | b << BITS | c, return_counts=True)
        step = (1 << BITS) - 1
        return edges >> 2 * BITS, edges >> BITS & step, edges & step, n
    # one text with millions of different words: number the nodes first
    nodes, node = np.unique(a << 31 | b, return_inverse=True)
    edges, n = np.unique(node.astype(np.int64) << 31 | c, return_counts=True)
    pair, step = nodes[edges >> 31], (1 << 31) - 1
    return pair >> 31, pair & step, edges & step, n


class PartialGraph:
    """Edges and flows of a part of the texts, by language."""

    def __init__(self):
        self.schema = pa.schema([("lang", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("c", pa.int64())])
        self.clear()

    def clear(self) -> None:
        self.number = defaultdict(count().__next__)
        self.number[BORDER]                      # the border is word 0
        self.texts: dict[str, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        words = text.encode().translate(FORM).replace(BORDER, b" " + BORDER + b" ").split()
        words.append(BORDER)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.texts[lang].append(ids)
        self.size += len(ids)

    def full(self) -> bool:
        return self.size >= FLUSH_WORDS or len(self.number) >= FLUSH_VOCABULARY

    def flush(self):
        """Record batches of (lang, head, tail, c): an edge has both; without a tail c is
        a node's ends of pieces (head of two words), a word's flow (one word) or the
        number of words (none)."""
        words = pa.array([b"", *list(self.number)[1:]], pa.binary()).cast(pa.string())
        for lang, parts in self.texts.items():
            ids = np.concatenate([*parts, np.zeros(2, np.int64)])
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            pair = (a > 0) & (b > 0)
            x, y, z, n = counted(a[pair], b[pair], c[pair], len(words))          # z = 0: the piece ends at the node
            heads = pc.binary_join_element_wise(words.take(pa.array(x)), words.take(pa.array(y)), " ")
            yield from self.batches(lang, heads, words.take(pa.array(z)), n)
            # a word's flow: what leaves its nodes, and pieces that end with it
            flow = np.bincount(x, n, len(words)) + np.bincount(a[(a > 0) & (b == 0)], None, len(words))
            used = np.flatnonzero(flow)
            flow = flow[used].astype(np.int64)
            none = words.take(pa.array(np.zeros(len(used) + 1, np.int64)))
            yield from self.batches(lang, words.take(pa.array(np.append(used, 0))), none, np.append(flow, flow.sum()))
        self.clear()

    def batches(self, lang: str, heads, tails, n: np.ndarray):
        for at in range(0, len(n), 50_000):
            part = slice(at, at + 50_000)
            k = len(n[part])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), heads[part], tails[part], pa.array(n[part], pa.int64())],
                                             schema=self.schema)


def graph_sums(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, head, tail, c``: sums of edges and flows over parts of the texts."""
    ship(docs.sparkSession)

    def run(batches):
        graph = PartialGraph()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                graph.add(lang, text)
                if graph.full():
                    yield from graph.flush()
        yield from graph.flush()

    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(run, "lang string, head string, tail string, c long")


def last_word(phrase: str | Column) -> Column:
    return F.substring_index(phrase, " ", -1)


class PhraseGraph:
    """The frequent part of the graph, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST):
        sums = graph_sums(docs, text_col, lang_col)
        width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # one shuffle: a node's edges lie together, so both sums below need no other
        edges = sums.repartition(width, "lang", "head").groupBy("lang", "head", "tail").agg(F.sum("c").alias("c"))
        nodes = edges.groupBy("lang", "head").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | (F.col("head") == ""))
        # a condition on the sum, so that it is not pushed below the shuffle that both share
        both = edges.where(F.when(F.col("tail") != "", F.col("c")) >= least).unionByName(nodes.withColumn("tail", F.lit("")))
        self.table = stored(both.select("lang", "head", "tail", "c"), "phrase-graph")
        empty = F.col("tail") == ""
        spaced = F.instr("head", " ") > 0
        self.edges = self.table.where(~empty)
        self.nodes = self.table.where(empty & spaced).select("lang", F.col("head").alias("node"), F.col("c").alias("flow"))
        self.words = self.table.where(empty & ~spaced & (F.col("head") != "")).select("lang", F.col("head").alias("word"), F.col("c").alias("f"))
        self.totals = self.table.where(F.col("head") == "").select("lang", F.col("c").alias("n"))

    def paths(self) -> DataFrame:
        """``lang, words, c``: unary paths, each edge in one of them, all edges of a path
        of its weight. A piece is finite, so a path has a first edge."""
        e = self.edges.select("lang", "head", "tail", "c", F.concat_ws(" ", last_word("head"), "tail").alias("into"))
        into, out = self.nodes.withColumnRenamed("node", "into"), self.nodes.withColumnRenamed("node", "head")
        # all of the flow of node ``via`` comes in by ``edge`` and leaves by ``next``
        come = e.join(into, ["lang", "into"]).where("c = flow").select("lang", F.col("into").alias("via"), F.concat_ws(" ", "head", "tail").alias("edge"))
        leave = e.join(out, ["lang", "head"]).where("c = flow").select("lang", F.col("head").alias("via"), F.concat_ws(" ", "head", "tail").alias("next"))
        links = stored(come.join(leave, ["lang", "via"]).select("lang", F.col("next").alias("edge"), F.col("edge").alias("before"), F.lit(1).cast("long").alias("step")),
                       "path-links")
        while True:
            # each link reaches twice as far back, until all reach a first edge
            up = links.select("lang", F.col("edge").alias("before"), F.col("before").alias("further"), F.col("step").alias("more"))
            wider = stored(links.join(up, ["lang", "before"], "left").select(
                "lang", "edge", F.coalesce("further", "before").alias("before"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"),
                F.col("further").isNotNull().alias("open")), "path-links")
            links = wider.select("lang", "edge", "before", "step")
            if wider.where("open").isEmpty():
                break
        all_edges = self.edges.select("lang", F.concat_ws(" ", "head", "tail").alias("edge"), "tail", "c")
        placed = all_edges.join(links, ["lang", "edge"], "left").select(
            "lang", F.coalesce("before", "edge").alias("first"), F.coalesce("step", F.lit(0)).alias("step"), "tail", "c")
        # the words of a path: those of its first edge, then the last words of the others
        return placed.groupBy("lang", "first").agg(
            F.min("c").alias("c"), F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.struct("step", "tail")))).alias("rest")).select(
            "lang", F.concat(F.split("first", " "), F.col("rest.tail")).alias("words"), "c")

    def triples(self) -> DataFrame:
        """Candidates of three words from the paths, with the counts of their nodes:
        inside a path a node's count is the path's weight."""
        p = self.paths().select("lang", "words", "c", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("i"))
        word = lambda k: F.get("words", F.col("i") + k)
        t = stored(p.select("lang", F.concat_ws(" ", word(0), word(1)).alias("left"), F.concat_ws(" ", word(1), word(2)).alias("right"),
                            word(0).alias("w1"), word(2).alias("w3"), F.col("c").alias("a"),
                            (F.col("i") > 0).alias("left_inside"), (F.col("i") < F.size("words") - 3).alias("right_inside")), "triples")
        left = self.nodes.select("lang", F.col("node").alias("left"), F.col("flow").alias("f12"))
        right = self.nodes.select("lang", F.col("node").alias("right"), F.col("flow").alias("f23"))
        inner = t.where("left_inside").withColumn("f12", F.col("a")).unionByName(t.where("not left_inside").join(left, ["lang", "left"]))
        return inner.where("right_inside").withColumn("f23", F.col("a")).unionByName(inner.where("not right_inside").join(right, ["lang", "right"]))


def scored(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: products are decimals of 38 digits."""
    a, left, right = (F.col(c).cast("decimal(38,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * a * a, left * right).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 held_pct: int = HELD_PCT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of two and
    three words of each language, without those that a longer candidate mostly holds."""
    graph = PhraseGraph(docs, text_col, lang_col, least)
    first, last = graph.words.withColumnsRenamed({"word": "w1", "f": "f1"}), graph.words.withColumnsRenamed({"word": "w3", "f": "f3"})
    triples = stored(graph.triples(), "counted-triples")
    t = triples.join(first, ["lang", "w1"]).join(last, ["lang", "w3"])
    t = t.select("lang", F.concat_ws(" ", "left", "w3").alias("phrase"), "a",
                 F.struct(scored("a", "f1", "f23").alias("s"), F.col("f1").alias("l"), F.col("f23").alias("r")).alias("x"),
                 F.struct(scored("a", "f12", "f3").alias("s"), F.col("f12").alias("l"), F.col("f3").alias("r")).alias("y"))
    best = F.when(F.col("x.s") <= F.col("y.s"), F.col("x")).otherwise(F.col("y"))
    three = t.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", F.col("b.s").alias("score"))
    # the heaviest longer candidate around each node
    around = triples.select("lang", F.explode(F.array("left", "right")).alias("node"), "a").groupBy("lang", "node").agg(F.max("a").alias("longest"))
    two = graph.nodes.join(around, ["lang", "node"], "left").where("longest is null or 100 * longest < %d * flow" % held_pct)
    two = two.select("lang", F.col("node").alias("phrase"), F.col("flow").alias("a"), F.substring_index("node", " ", 1).alias("w1"), last_word("node").alias("w3"))
    two = two.join(first, ["lang", "w1"]).join(last, ["lang", "w3"]).select(
        "lang", "phrase", "a", F.col("f1").alias("l"), F.col("f3").alias("r"), scored("a", "f1", "f3").alias("score"))
    found = stored(three.unionByName(two), "phrases")
    out = best_of_each(found, top).join(graph.totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best_of_each(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase.

    Two histograms bound what a language sends to one task: its scores are at most
    1,000,001 numbers, and the counts at one score far fewer than its candidates."""
    above = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("v"))) - F.col("k")
    histogram = lambda df, v: df.groupBy("lang", F.col(v).alias("v")).agg(F.count("*").alias("k")).withColumn("above", above).where(F.col("above") < top)
    limit = stored(histogram(found, "score").groupBy("lang").agg(F.min("v").alias("least_score"), F.max("above").alias("above")), "score-limits")
    few = F.broadcast if limit.count() <= BROADCAST_LANGUAGES else (lambda df: df)
    f = found.join(few(limit), "lang").where("score >= least_score")
    f = f.join(few(histogram_at(f, top)), "lang").where("score > least_score or a >= least_a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return f.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("least_score", "least_a", "above")


def histogram_at(f: DataFrame, top: int) -> DataFrame:
    """Least count, at the limiting score, that can still be among the first ones."""
    k = f.where("score = least_score").groupBy("lang", "above", "a").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("a"))) - F.col("k") + F.col("above")
    return k.withColumn("before", before).where(F.col("before") < top).groupBy("lang").agg(F.min("a").alias("least_a"))
