"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of word 4-shingles ("tokens"). Equal sets are one class. Two
different sets x, y with Jaccard similarity >= t share at least ceil(t max(|x|, |y|))
tokens, so a set misses at most ``e = |x| - ceil(t |x|)`` tokens of its partner.

Prefixes. Tokens are ordered: those in fewer than ``F`` documents (rare) first, then
the frequent ones, by hash within a class. A prefix of rare tokens alone is indexed
token by token and has e + 1 of them. Where a set has fewer rare tokens, the prefix
goes on into the frequent class, whose tokens are indexed in pairs: they are dealt to
``m`` sub-classes by hash, and every two prefix tokens of the same sub-class make one
key. A sub-class with k prefix tokens can only be left without a common pair by
missing k - 1 of them, so the prefix ends as soon as

    rare tokens + sum over sub-classes of max(0, k - 1)  >=  e + 1.

Both prefixes follow one order, so the pair shares a key. ``m`` depends on the size
octave; a set near the top of its octave is indexed under the next one's ``m`` too,
so any two sets that can be linked have a common scheme.

Verification. Keys with few sets give pairs, pruned by size and by an exact bound
from parity bitmaps (the bits in which two bitmaps differ never outnumber the tokens
in which the sets differ), then checked on the whole sets: the pairs that are left
form clusters, each cluster is one task's (a large one is parted in blocks), and a set
travels to its cluster once, as text. A pair is given by the least key that one of its
sets has, if both have it as their least, and else by each common key. Keys with many
sets give no pairs: sets connected by such keys form groups, which are compared in blocks by
matrix products inside tasks that return spanning links only. First each block is
compared with itself and its neighbour; then only blocks that may still join
different components.

Links are contracted to connected components; every step is a table in the shared
folder or a lineage of plain scans.

Sets are identified by a 64-bit hash of all their tokens and tokens by 64-bit hashes.

Defined cases: a null or empty text, or one without words, has no token, links with
nothing and is its own component. A text with fewer words than ``size`` is one token.
Repeated rows and copies are one class and so one component. A component's id is the
smallest non-null document id in it. Columns beyond the named ones are ignored. An
empty table gives an empty result. Texts are used whole; a long text is hashed in
slices.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_map, id_text, release, ship, stored, to_arrow
from riskspark.llm.components import connected_components

SIZE, PERCENT = 4, 85
RARE_BELOW = 32            # least document frequency of a frequent token
MAX_FREQUENT = 1 << 23     # frequent tokens, broadcast as a bitmap of 2 to 4 bytes each; F doubles until they fit
SMALL = 32                 # a key with at most so many sets gives pairs
SALT_ROWS = 100_000        # a pair of tokens more frequent than this is dealt to several parts
FLUSH = 1 << 19            # tokens gathered in a task before they are sent on
PART_TOKENS = 1 << 20      # tokens of a part, on average
SLICE = 1 << 20            # bytes hashed at a time
BITMAP = 1024
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 22
BROADCAST_NODES = 400_000  # needed classes up to this many are broadcast, more are joined by shuffle

U = np.uint64
M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


# ------------------------------------------------------------------- tokens


@lru_cache(maxsize=1)
def hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random words per byte, and powers of the base and of its inverse."""
    rng = np.random.default_rng(20240917)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    letters[space] = 0
    power = np.ones(SLICE + 1, np.uint64)
    inverse = np.ones(SLICE + 1, np.uint64)
    back = U(pow(BASE, -1, 1 << 64))
    # doubling: powers of the second half are those of the first times one power
    n = 1
    while n <= SLICE:
        m = min(n, SLICE + 1 - n)
        power[n:n + m] = power[:m] * U(pow(BASE, n, 1 << 64))
        inverse[n:n + m] = inverse[:m] * U(pow(int(back), n, 1 << 64))
        n += m
    return letters, power, inverse


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def slice_hashes(part: bytes) -> np.ndarray:
    letters, power, inverse = hash_tables()
    a = np.frombuffer(part, np.uint8)
    values = letters[a]
    inside = values != 0
    sums = np.cumsum(values * power[:len(a)])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, stop = edge[0::2], edge[1::2]
    before = np.where(start > 0, sums[start - 1], U(0))
    return finish((sums[stop - 1] - before) * inverse[start] + (stop - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, ASCII white space between them)."""
    data = text.encode("utf-8").lower()
    if len(data) <= SLICE:
        return slice_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut < 0:     # one word fills the slice: hash it by itself
                ends = [p for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") if (p := data.find(c, end)) >= 0]
                stop = min(ends, default=len(data))
                out.append(np.frombuffer(hashlib.blake2b(data[at:stop], digest_size=8).digest(), np.uint64))
                at = stop
                continue
            end = cut + 1
        out.append(slice_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def token_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(size, len(w))
    h = w[:len(w) - n + 1] + U(n)
    for k in range(1, n):
        h = h * U(0xBF58476D1CE4E5B9) + w[k:len(w) - n + 1 + k]
    h = np.sort(finish(h))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return h[new]


def class_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_bitmap(tokens: np.ndarray) -> list[int]:
    """Which of the bits are hit by an odd number of tokens; at least two bits per
    token. The bitmap with half the bits is the exclusive or of the two halves."""
    bits = max(BITMAP, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def folded(x, y):
    """Bitmap ``x`` brought to the size of ``y``, which is as large or half as large
    (sizes of sets that may be linked are within a factor of two)."""
    half = (F.size(x) / 2).cast("int")
    return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)


def allowance(n: int, percent: int = PERCENT) -> int:
    """How many tokens of a set of n tokens a linked set may miss."""
    return n - (percent * n + 99) // 100


# --------------------------------------------------- document frequencies


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> U(32)) * U(parts)) >> U(32)


def frequency_key(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Part and low half of a token: what frequencies are counted by. Tokens that
    share it count together, which only makes both look more frequent."""
    return part_of(tokens, parts) << U(32) | (tokens & U(0xFFFFFFFF))


def runs_of(part: np.ndarray) -> list[tuple[int, int, int]]:
    """``(part, from, to)`` for each part present in a sorted array: a flush costs what
    it holds, however many parts there are."""
    present, start = np.unique(part, return_index=True)
    return list(zip(present.tolist(), start.tolist(), [*start[1:].tolist(), len(part)]))


class Gather:
    """Distinct sets of a task, handed on in flushes of about ``FLUSH`` tokens."""

    def __init__(self):
        self.seen: set[int] = set()
        self.rows: list = []
        self.size = 0

    def add(self, key: int, row, size: int) -> bool:
        if key in self.seen:
            return False       # copies within a task are gathered once
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        self.seen.add(key)
        self.rows.append(row)
        self.size += size
        return self.size >= FLUSH

    def take(self) -> list:
        rows, self.rows, self.size = self.rows, [], 0
        return rows


def frequent_tokens(docs: DataFrame, parts: int, size: int, least: int = RARE_BELOW, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and document frequencies of the frequent tokens.

    Tasks count their own tokens and send each part's counts as compact arrays; a
    part is added up in one task. The threshold doubles until at most ``most`` tokens
    are above it, so what is collected is bounded at any size. Above ``SMALL`` it makes
    large keys of rare tokens, which join unrelated sets to groups: ``most`` is far out."""
    schema = to_arrow("part int, once binary, more binary, counts binary")
    ship(docs.sparkSession)

    def rows_of(gathered):
        u, c = np.unique(np.concatenate(gathered), return_counts=True)
        low = u.astype(np.uint32)
        cols: list[list] = [[], [], [], []]
        for p, a, b in runs_of(part_of(u, parts)):
            many = c[a:b] > 1
            for col, v in zip(cols, (p, low[a:b][~many].tobytes(), low[a:b][many].tobytes(), c[a:b][many].astype(np.uint32).tobytes())):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def count(batches):
        g = Gather()
        for b in batches:
            for text in b.column(0).to_pylist():
                s = token_set(text, size)
                if len(s) and g.add(class_key(s), s, len(s)):
                    yield rows_of(g.take())
        if g.rows:
            yield rows_of(g.take())

    total = to_arrow("key long, df long")

    def add_up(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        get = lambda name: np.concatenate([np.frombuffer(x, np.uint32) for x in t.column(name).to_pylist()])
        once, more = get("once"), get("more")
        tokens, weight = np.concatenate((once, more)), np.concatenate((np.ones(len(once)), get("counts")))
        u, back = np.unique(tokens, return_inverse=True)
        df = np.bincount(back, weight).astype(np.int64)
        use = df >= least
        keys = (np.uint64(part) << U(32) | u[use].astype(np.uint64)).view(np.int64)
        return pa.Table.from_arrays([pa.array(keys), pa.array(df[use])], schema=total)

    counts = stored(docs.select("text").mapInArrow(count, "part int, once binary, more binary, counts binary")
                    .groupBy("part").applyInArrow(add_up, "key long, df long"), "frequencies")
    octaves = counts.groupBy(F.expr("cast(floor(log2(df)) as int)").alias("o")).agg(F.count("*").alias("n")).collect()
    floor = least
    while sum(n for o, n in octaves if 2 ** (o + 1) > floor) > most:
        floor *= 2
    found = counts.where(F.col("df") >= floor).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    release(counts)
    return keys[order], found["df"].to_numpy(np.int64)[order]


class Frequent:
    """Which tokens are frequent, as a bitmap of at least 16 bits per frequent token, and
    the frequencies of the hottest. A rare token that meets a set bit counts as
    frequent, in every set alike."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, parts: int):
        self.parts = parts
        self.width = 1 << max(6, (16 * len(keys) // parts).bit_length())      # bits of a part
        self.bits = np.zeros(parts * self.width // 8, np.uint8)
        at = self.place(keys)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        hot = df > SALT_ROWS
        self.keys, self.df = keys[hot], df[hot]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> U(32)) * U(self.width) + (keys & U(self.width - 1))).astype(np.int64)

    def frequencies(self, tokens: np.ndarray) -> np.ndarray:
        """The frequency of a hot token, 1 of any other frequent one, 0 of a rare one."""
        k = frequency_key(tokens, self.parts)
        at = self.place(k)
        df = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            df = np.where(self.keys[near] == k, self.df[near], df)
        return df


# ------------------------------------------------------------------ prefixes


def octaves_of(n: int, percent: int = PERCENT) -> list[int]:
    """The octave of a size, and the next one if a linked set may lie in it."""
    o = n.bit_length() - 1
    return [o, o + 1] if 100 * n >= percent * (2 << o) else [o]


def sub_classes(octave: int) -> int:
    return max(1, (1 << octave) // 4)


def prefix_keys(tokens: np.ndarray, df: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set and how many sets may share each. ``df``: the frequency of
    each token if it is frequent, else 0."""
    n = len(tokens)
    need = allowance(n, percent) + 1
    rare = tokens[df == 0]
    if len(rare) >= need:
        keys = rare[:need]      # tokens are sorted by hash
        return keys, np.zeros(len(keys), np.int64)
    common, freq = tokens[df > 0], df[df > 0]
    keys, sizes = [rare], [np.zeros(len(rare), np.int64)]
    for octave in octaves_of(n, percent):
        m = sub_classes(octave)
        sub = (common * U(0x9FB21C651E98DF25) >> U(33)) % U(m)
        first = np.zeros(len(common), bool)
        first[np.unique(sub, return_index=True)[1]] = True
        cover = len(rare) + np.cumsum(~first)
        stop = int(np.searchsorted(cover, need)) + 1
        order = np.argsort(sub[:stop], kind="stable")
        s, c, f = sub[:stop][order], common[:stop][order], freq[:stop][order]
        for gap in range(1, stop):
            same = np.flatnonzero(s[gap:] == s[:-gap])
            if not len(same):
                break
            a, b = c[same], c[same + gap]      # a < b: both orders are by hash
            keys.append(finish(a * U(0xC2B2AE3D27D4EB4F) + b + U(octave * 2 + 1)))
            sizes.append(np.minimum(f[same], f[same + gap]))
    return np.concatenate(keys), np.concatenate(sizes)


def index_entries(docs: DataFrame, frequent, parts: int, size: int, percent: int) -> DataFrame:
    """Index entries (key, class, size, forced, least key of the class) as arrays per
    part. Keys that very many sets may share are dealt to several parts and marked, so
    that their sets never meet in one task and are always treated as a large key."""
    schema_text = "part int, keys binary, nodes binary, sizes binary, forced binary, firsts binary"
    schema = to_arrow(schema_text)
    ship(docs.sparkSession)

    def rows_of(rows):
        key = np.concatenate([k for k, _, _, _ in rows])
        many = np.concatenate([c for _, c, _, _ in rows])
        lens = [len(k) for k, _, _, _ in rows]
        node = np.repeat(np.array([x for _, _, x, _ in rows], np.int64), lens)
        n = np.repeat(np.array([x for _, _, _, x in rows], np.uint32), lens)
        first = np.repeat(np.array([k.min() if len(k) else 0 for k, _, _, _ in rows], np.uint64), lens)
        ways = np.maximum(1, -(-many // SALT_ROWS)).astype(np.uint64)
        salt = finish(node.view(np.uint64)) % ways
        part = finish(key + salt * U(BASE)) % U(parts)
        order = np.argsort(part, kind="stable")
        cols: list[list] = [[] for _ in schema]
        forced = (ways > 1).astype(np.uint8)
        for p, a, b in runs_of(part[order]):
            at = order[a:b]
            for col, v in zip(cols, (p, key[at].tobytes(), node[at].tobytes(), n[at].tobytes(), forced[at].tobytes(), first[at].tobytes())):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches):
        known = frequent.value
        g = Gather()
        for b in batches:
            for text in b.column(0).to_pylist():
                s = token_set(text, size)
                if not len(s):
                    continue
                node = class_key(s)
                if node in g.seen:
                    continue
                keys, many = prefix_keys(s, known.frequencies(s), percent)
                if g.add(node, (keys, many, node, len(s)), len(keys)):
                    yield rows_of(g.take())
        if g.rows:
            yield rows_of(g.take())

    return docs.select("text").mapInArrow(run, schema_text)


def fits(a, b, percent: int):
    """Whether the sizes allow a link."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """``large, a, b, na, nb``: pairs of classes from small keys, and memberships
    (key, class) of large ones, each once per part. Near copies share most of their keys:
    two classes with the same least key are a pair of that key alone."""
    text = "large boolean, a long, b long, na long, nb long"
    schema = to_arrow(text)

    def run(t: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])
        key, node, n, forced = get("keys", np.uint64), get("nodes", np.int64), get("sizes", np.uint32).astype(np.int64), get("forced", np.uint8)
        first = get("firsts", np.uint64)
        order = np.lexsort((node, key))
        key, node, n, forced, first = key[order], node[order], n[order], forced[order], first[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, forced, first = key[new], node[new], n[new], forced[new], first[new]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        run_of = np.cumsum(head) - 1
        length = np.bincount(run_of)[run_of] if len(key) else np.zeros(0, np.int64)
        large = (length > SMALL) | (forced > 0)
        rows = []
        small = np.flatnonzero((length > 1) & ~large)
        k, x, s, f = key[small], node[small], n[small], first[small]
        pairs = []
        for gap in range(1, min(SMALL, len(small))):
            same = np.flatnonzero((k[gap:] == k[:-gap]))
            if not len(same):
                break
            same = same[fits(s[same], s[same + gap], percent) & ((f[same] != f[same + gap]) | (f[same] == k[same]))]
            pairs.append(np.stack((x[same], x[same + gap], s[same], s[same + gap]), 1))
        if pairs:
            p = np.concatenate(pairs)
            p = np.unique(p, axis=0)
            rows.append((np.zeros(len(p), bool), *p.T))
        if large.any():
            m = np.flatnonzero(large)
            rows.append((np.ones(len(m), bool), key[m].view(np.int64), node[m], np.zeros(len(m), np.int64), n[m]))
        cols = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, bool), *[np.zeros(0, np.int64)] * 4]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return entries.groupBy("part").applyInArrow(run, text)


# -------------------------------------------------------------- verification


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def verified_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the pairs ``a, b``, thinned where others connect their ends. The pairs
    that the bitmaps leave form clusters of bounded blocks; a task gets the texts of a
    few small clusters, or of two blocks of a large one, each text once."""
    maps = nodes.select("node", "bitmap")
    p = (pairs.join(maps.select(F.col("node").alias("a"), F.col("bitmap").alias("ma")), "a")
         .join(maps.select(F.col("node").alias("b"), F.col("bitmap").alias("mb")), "b"))
    p = p.select("a", "b", "na", "nb", folded(F.col("ma"), F.col("mb")).alias("ma"), folded(F.col("mb"), F.col("ma")).alias("mb"))
    differ = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    left = stored(p.where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b"), "close-pairs")
    if left.isEmpty():
        return left
    members = stored(connected_components(left).join(nodes.select("node", "n", F.col("doc_id").alias("rep")), "node"), "needed")
    parts = int(-(-(members.agg(F.sum("n")).first()[0]) // PART_TOKENS))
    count = members.groupBy("label").agg(F.ceil(F.count("*") / sets_of_block(F.max("n"))).cast("long").alias("k"))
    at = stored(members.join(count, "label").select("node", "rep", "label", "k", F.pmod(F.xxhash64("node"), "k").alias("i")), "clusters")
    near = left.join(at.select(F.col("node").alias("a"), "label", "k", F.col("i").alias("ia")), "a").join(at.select(F.col("node").alias("b"), F.col("i").alias("ib")), "b")
    batch = F.when(F.col("k") == 1, F.pmod(F.xxhash64("label"), F.lit(parts))).otherwise(F.xxhash64("label", F.least("ia", "ib"), F.greatest("ia", "ib")))
    dealt = stored(near.select(batch.alias("batch"), "a", "b"), "dealt-pairs")
    want = dealt.select("batch", F.explode(F.array("a", "b")).alias("node")).distinct()
    want = stored(want.join(at.select("node", "rep"), "node"), "wanted")
    texts = docs.join(small(want), F.col("doc_id").eqNullSafe(F.col("rep"))).select("batch", "node", "text")
    text = "a long, b long"
    schema = to_arrow(text)

    def run(edges: pa.Table, t: pa.Table) -> pa.Table:
        have: dict[int, np.ndarray] = {}
        for node, x in zip(t.column("node").to_pylist(), t.column("text")):
            if node not in have:
                s = token_set(x.as_py(), size)
                if len(s) and class_key(s) == node:     # ids may repeat with other texts
                    have[node] = s
        up: dict[int, int] = {}

        def root(i):
            while up.get(i, i) != i:
                up[i] = i = up.get(up[i], up[i])
            return i

        out = []
        for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist()):
            if (ra := root(a)) == (rb := root(b)) or a not in have or b not in have:
                continue
            x, y = have[a], have[b]
            if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                up[ra] = rb
                out.append((a, b))
        return pa.Table.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)

    ship(docs.sparkSession)
    links = stored(dealt.groupBy("batch").cogroup(texts.groupBy("batch")).applyInArrow(run, text), "links")
    release(left, members, at, dealt, want)
    return links


def sets_of_block(longest):
    """How many sets, the longest of so many tokens, a block may have."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_TOKENS) / longest).cast("int")))


def size_class(n, percent: int):
    """Sizes that may be linked lie in the same or in neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")


def spanning_links(x: list[np.ndarray], y: list[np.ndarray], names: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between two lists of sets (the same list twice: within it), thinned to
    a spanning forest. Common tokens are counted by products of 0/1 matrices over
    slices of the common vocabulary."""
    within = x is y
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])

    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (tx, rx), (ty, ry) = flat(x), flat(y)
    vocabulary = np.unique(tx)
    if within:
        u, c = np.unique(tx, return_counts=True)
        vocabulary = u[c > 1]
    else:
        vocabulary = np.intersect1d(vocabulary, np.unique(ty), assume_unique=True)
    common = np.zeros((len(x), len(y)), np.float32)
    if len(vocabulary):
        px, py = np.searchsorted(vocabulary, tx), np.searchsorted(vocabulary, ty)
        hit_x = vocabulary[np.minimum(px, len(vocabulary) - 1)] == tx
        hit_y = vocabulary[np.minimum(py, len(vocabulary) - 1)] == ty
        px, rx, py, ry = px[hit_x], rx[hit_x], py[hit_y], ry[hit_y]
        for at in range(0, len(vocabulary), 8192):
            width = min(8192, len(vocabulary) - at)
            a, b = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
            ix, iy = (px >= at) & (px < at + width), (py >= at) & (py < at + width)
            a[rx[ix], px[ix] - at] = 1
            b[ry[iy], py[iy] - at] = 1
            common += a @ b.T
    near = linked(common, nx[:, None], ny[None, :], percent)
    total = len(x) if within else len(x) + len(y)
    full = np.zeros((total, total), bool)
    if within:
        full[:] = near
    else:
        full[:len(x), len(x):] = near
        full[len(x):, :len(x)] = near.T
    out, new = [], np.ones(total, bool)
    for start in range(total):
        if not new[start]:
            continue
        new[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(full[i] & new)
            new[found] = False
            out += [(names[i], names[j]) for j in found.tolist()]
            queue += found.tolist()
    return out


def block_links(blocks: DataFrame, whole: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Spanning links of the given block pairs. ``blocks``: block, node; ``whole``: node,
    tokens; ``pairs``: x, y (blocks, x = y for within). One task step holds two blocks,
    whose size is bounded; every block travels once per pair that it is in."""
    text = "a long, b long"
    schema = to_arrow(text)
    numbered = pairs.withColumn("pair", F.xxhash64("x", "y"))
    sides = (numbered.select("pair", F.col("x").alias("block"), F.lit(0).alias("side"))
             .union(numbered.where("x <> y").select("pair", F.col("y"), F.lit(1))))
    rows = sides.join(blocks, "block").join(whole, "node").select("pair", "side", "node", "tokens")

    def run(t: pa.Table) -> pa.Table:
        side = np.array(t.column("side").to_pylist())
        node = t.column("node").to_pylist()
        lists = t.column("tokens").combine_chunks()
        values, edge = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        sets = [values[a:b] for a, b in zip(edge, edge[1:])]
        ix, iy = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
        x = [sets[i] for i in ix]
        y = [sets[i] for i in iy] or x
        out = spanning_links(x, y, [node[i] for i in ix + iy], percent) if x and y else []
        return pa.Table.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)

    return rows.groupBy("pair").applyInArrow(run, text)


def group_links(members: DataFrame, sets, percent: int) -> DataFrame:
    """Links among sets that share large keys (``key, node, n`` rows).

    No pair of sets is ever a row: blocks of sets are compared, in two rounds."""
    spark = members.sparkSession
    lead = members.groupBy("key").agg(F.min("node").alias("lead"))
    star = members.join(lead, "key").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    group = connected_components(star)
    m = members.select("node", "n").distinct()
    m = m.join(group, "node").select("node", "n", F.col("label").alias("grp"))
    # sets of a key that is large by its mark alone may be single: they have no edge
    m = stored(m.withColumn("c", size_class(F.col("n"), percent)), "group-members")
    if m.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    whole = sets(m.select("node"))

    def blocked(d: DataFrame, pool):
        """Deal the sets of each (group, pool, size class) to blocks of bounded size."""
        d = d.withColumn("pool", pool)
        count = stored(d.groupBy("grp", "pool", "c").agg(F.ceil(F.count("*") / sets_of_block(F.max("n"))).cast("long").alias("k")), "block-counts")
        # one row per class against all its sets: a hot class is not shuffled into one task for it
        d = d.join(small(count), ["grp", "pool", "c"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")))
        d = d.withColumn("block", F.xxhash64("grp", "pool", "c", "i"))
        return stored(d.select("block", "node"), "blocks"), count

    def expand(count: DataFrame, near: bool) -> DataFrame:
        return count.select("grp", "pool", "c", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))

    def name(g, pool, c, i):
        return F.xxhash64(g, pool, c, i)

    # first round: a block with itself, with the next of its class, and the first
    # block of each class with the first of the next class
    blocks, count = blocked(m, F.lit(0).cast("long"))
    b = expand(count, True)
    own = b.select(name("grp", "pool", "c", "i").alias("x"), name("grp", "pool", "c", "i").alias("y"))
    after = b.where("i + 1 < k").select(name("grp", "pool", "c", "i").alias("x"), name("grp", "pool", "c", F.col("i") + 1).alias("y"))
    zero = F.lit(0).cast("long")
    nxt = count.select("grp", "pool", (F.col("c") - 1).alias("c"))
    across = count.join(nxt, ["grp", "pool", "c"]).select(name("grp", "pool", "c", zero).alias("x"),
                                                          name("grp", "pool", F.col("c") + 1, zero).alias("y"))
    first = stored(block_links(blocks, whole, own.union(after).union(across), percent), "first-links")
    # second round: whatever may still join two components of a group. Components
    # with at least a block's sets keep to themselves, the small ones share a pool.
    comp = connected_components(first)
    d = m.join(comp, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    big = d.groupBy("grp", "comp").agg(F.count("*").alias("members"))
    d = d.join(big, ["grp", "comp"])
    several = big.groupBy("grp").agg(F.count("*").alias("comps")).where("comps > 1").select("grp")
    d = stored(d.join(several, "grp"), "open-groups")
    blocks, count = blocked(d, F.when(F.col("members") >= BLOCK_SETS, F.col("comp")).otherwise(F.lit(0)))
    b = expand(count, False)
    left = b.select("grp", F.col("pool").alias("p1"), F.col("c").alias("c1"), F.col("i").alias("i1"))
    right = b.select("grp", F.col("pool").alias("p2"), F.col("c").alias("c2"), F.col("i").alias("i2"), F.explode(F.array(F.col("c"), F.col("c") - 1)).alias("c1"))
    # c1 = c2 or c1 = c2 - 1; blocks of one class once, by their order
    both = (left.join(right, ["grp", "c1"])
            .where((F.col("c1") < F.col("c2")) | (F.struct("p1", "i1") <= F.struct("p2", "i2")))
            .where((F.col("p1") != F.col("p2")) | (F.col("p1") == 0))
            .select(name("grp", "p1", "c1", "i1").alias("x"), name("grp", "p2", "c2", "i2").alias("y")))
    second = stored(block_links(blocks, whole, both, percent), "second-links")
    release(whole, m, d)
    return first.union(second)


# ------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                       percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, group_id, text_hash`` per row of
    ``docs``. ``class_id`` identifies the set and ``group_id`` the component (null
    without a token)."""
    spark = docs.sparkSession
    d = id_text(docs, id_col, text_col)
    kind = dict(d.dtypes)["doc_id"]

    def describe(b: pa.RecordBatch):
        ids, nodes, ns, maps = b.column(0).to_pylist(), [], [], []
        for text in b.column(1).to_pylist():
            s = token_set(text, size)
            nodes.append(class_key(s) if len(s) else None)
            ns.append(len(s))
            maps.append(parity_bitmap(s) if len(s) else None)
        yield {"doc_id": ids, "text_hash": b.column(2).to_pylist(), "node": nodes, "n": ns, "bitmap": maps}

    rows = stored(arrow_map(d.withColumn("text_hash", F.xxhash64("text")), describe,
                            f"doc_id {kind}, text_hash long, node long, n long, bitmap array<long>"), "classes")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"),
                                                                      F.first("bitmap").alias("bitmap")), "nodes")
    tokens = nodes.agg(F.sum("n")).first()[0] or 0
    parts = int(max(16, -(-tokens // PART_TOKENS)))
    frequent = spark.sparkContext.broadcast(Frequent(*frequent_tokens(d, parts, size), parts))
    # entries are a fifth of the tokens, with seven times the bytes
    found = stored(candidates(index_entries(d, frequent, parts, size, percent), percent), "candidates")

    def sets(needed: DataFrame) -> DataFrame:
        """Whole sets of the needed classes, from the text of one document each."""
        want = stored(nodes.join(needed.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("rep")), "needed")
        j = d.join(small(want), F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

        def make(b: pa.RecordBatch):
            have, raw = [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = token_set(text, size)
                if len(s) and class_key(s) == node:     # ids may repeat with other texts
                    have.append(node)
                    raw.append(s.view(np.int64))
            yield {"node": have, "tokens": raw}

        # a repeated row gives its set twice, which only repeats a comparison
        return stored(arrow_map(j, make, "node long, tokens array<long>"), "sets")

    pairs = found.where("NOT large").select("a", "b", "na", "nb").distinct()
    members = found.where("large").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("nb").alias("n")).distinct()
    links = verified_pairs(pairs, nodes, d, size, percent).union(group_links(members, sets, percent))
    label = connected_components(links)
    release(found)
    of_node = nodes.select("node", "doc_id").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = of_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    comp = of_node.join(ids, "label").select(F.col("node").alias("class_id"), F.col("label").alias("group_id"), "component_id")
    return (rows.join(comp, F.col("node") == F.col("class_id"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    "class_id", "group_id", "text_hash"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, unchanged, but one of each group of linked documents: the
    row with the smallest id (a null id counts as the largest; of equal rows, one).
    Rows without a token are linked with nothing and all stay."""
    key = [F.col("doc_id"), F.col("text_hash")]
    found = stored(jaccard_components(docs, id_col, text_col, **kw).where("group_id IS NOT NULL")
                   .groupBy("group_id", *key).agg(F.count("*").alias("rows")), "groups")
    best = found.groupBy(F.col("group_id").alias("g")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("best"))
    judged = found.join(best, F.col("group_id") == F.col("g"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    # rows to take out: all that do not stay, and those that stay more than once,
    # which are then put back once
    out = stored(judged.where(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias("out_id"), F.col("text_hash").alias("out_hash"), stays.alias("back")), "taken-out")
    hashed = docs.withColumn("__text_hash", F.xxhash64(docs[text_col].cast("string")))
    same = F.col(id_col).eqNullSafe(F.col("out_id")) & (F.col("__text_hash") == F.col("out_hash"))
    rest = hashed.join(small(out), same, "left_anti")
    again = hashed.join(small(out.where("back")), same, "left_semi").dropDuplicates([id_col, "__text_hash"])
    return rest.unionByName(again).select(*docs.columns)


def small(df: DataFrame) -> DataFrame:
    """A broadcast of a stored table of a few numbers per row if it has at most
    ``BROADCAST_NODES`` rows; else the table as it is, joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df
