"""SimHash fingerprints and a Hamming search over permuted block tables.

Everything here is a composition of DataFrame functions (no Python workers).

Terms are word 5-shingles (the whole sequence if a text has fewer words); a term
weighs as often as it occurs. Every term's 64-bit hash votes +1 or -1 on each bit.
Votes are counted packed: bit j and bit j + 32 of a hash sit in the two halves of
``(h >> j) & 0x0000000100000001``, so 32 long sums count all 64 bits in generated
code and combine map-side.

Search: 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints within ``radius``
agree on at least ``BLOCKS - radius`` blocks, so one of the tables keyed by each
choice of that many blocks holds both; candidates are verified by their distance.

Defined cases: a null text is empty; an empty text has no terms and the zero
fingerprint. Repeated rows each give a row (the next document of one is the
other). A null id comes last in descending order. A single document is its own
next. Columns beyond the named ones are ignored. An empty table gives no row.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import stored

SHINGLE = 5
LANES = 32
LANE_MASK = 0x0000000100000001
LOW = 0xFFFFFFFF
RADIUS = 3
BLOCKS = 6
WORD_GAP = "[\\x20\\x09-\\x0D]+"
NO_ID = -(1 << 63)
BUCKET_SHIFT = 10          # ids of a bucket: at most 2 ** 10 different ones


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def vote_sums(term: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(term, j).bitwiseAND(F.lit(LANE_MASK))).alias(f"v{j}") for j in range(LANES)]


def fingerprint_of(n: Column) -> Column:
    """Bits whose votes have the majority, from the packed sums and the term count."""
    bits = []
    for j in range(LANES):
        v = F.coalesce(F.col(f"v{j}"), F.lit(0))
        low, high = v.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(v, 32)
        bits.append(F.when(low * 2 > n, F.lit(1 << j)).otherwise(F.lit(0).cast("long")))
        bits.append(F.when(high * 2 > n, F.lit(signed(1 << (j + 32)))).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, keep: list[Column] | None = None,
                 size: int = SHINGLE) -> DataFrame:
    """``keys, fp`` (64-bit long) for every distinct key; ``keep`` are further
    aggregates (constant per key)."""
    d = texts.select(*keys, *[c for c in texts.columns if c not in keys and c != text_col],
                     F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WORD_GAP),
                              lambda w: w != "").alias("_words"))
    d = d.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))")).drop("_words")
    d = d.withColumn("_terms", F.expr(
        f"CASE WHEN size(_hashes) > {size} THEN transform(sequence(1, size(_hashes) - {size - 1}), "
        f"i -> xxhash64({', '.join(f'_hashes[i + {k - 1}]' for k in range(size))})) "
        "WHEN size(_hashes) > 0 THEN array(xxhash64(_hashes)) "
        "ELSE cast(array() AS array<bigint>) END")).drop("_hashes")
    others = [c for c in d.columns if c not in keys and c != "_terms"]
    exploded = d.select(*keys, *others, F.explode_outer("_terms").alias("_t"))
    out = exploded.groupBy(*keys).agg(*vote_sums(F.col("_t")), F.count("_t").alias("_n"), *(keep or []))
    extra = [c for c in out.columns if c not in keys and c != "_n" and not (c[0] == "v" and c[1:].isdigit())]
    return out.select(*keys, *extra, fingerprint_of(F.col("_n")).alias("fp"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


# ------------------------------------------------------- order of documents


def successor(ids: DataFrame, col: str, shifts: tuple[int, ...] = (16, 16, 16)) -> DataFrame:
    """``col, next``: the next smaller value of a column of distinct longs; after
    the smallest comes the largest.

    Works by levels: within a group of ids with the same high bits a window gives
    the next one, and a group's last id takes the first of the next group, found by
    the same step one level up. The top level has few ids by its width, so no
    window ever holds all rows of a table."""
    ids = ids.select(F.col(col).alias("id"))
    if not shifts:
        w = Window.orderBy(F.col("id").desc())  # at most 2 ** (64 - 10 - 48) = 64 ids
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return ids.select(F.col("id").alias(col), F.coalesce(F.lead("id").over(w), F.first("id").over(every)).alias("next"))
    g = ids.withColumn("g", F.shiftright("id", shifts[0]))
    inner = g.select("id", "g", F.lead("id").over(Window.partitionBy("g").orderBy(F.col("id").desc())).alias("n"))
    tops = g.groupBy("g").agg(F.max("id").alias("top"))
    up = successor(tops, "g", shifts[1:]).select(F.col("g").alias("g0"), F.col("next").alias("g1"))
    after = up.join(tops.select(F.col("g").alias("g1"), "top"), "g1").select(F.col("g0").alias("g"), "top")
    return inner.join(after, "g").select(F.col("id").alias(col), F.coalesce("n", "top").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``bucket, rn, next_bucket, next_rn, next_text`` added.

    Documents are ordered by descending id inside buckets of neighbouring ids; only
    the first row of each bucket travels to the bucket before it."""
    d = docs.withColumn("bucket", F.shiftright(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), BUCKET_SHIFT))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    ranked = d.withColumn("rn", F.row_number().over(w)).withColumn("lead_text", F.lead("text").over(w))
    firsts = ranked.where("rn = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("first_text"))
    after = successor(stored(d.select("bucket").distinct(), "buckets"), "bucket").select("bucket", F.col("next").alias("next_bucket"))
    border = after.join(firsts, "next_bucket").select("bucket", "next_bucket", "first_text")
    last = F.col("lead_text").isNull()
    return (ranked.join(border, "bucket")
            .select("doc_id", "text", "bucket", "rn",
                    F.when(last, F.col("next_bucket")).otherwise(F.col("bucket")).alias("next_bucket"),
                    F.when(last, F.lit(1)).otherwise(F.col("rn") + 1).alias("next_rn"),
                    F.when(last, F.col("first_text")).otherwise(F.col("lead_text")).alias("next_text")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likenesses."""
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    e = with_next(d).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(length(text) div 3 AS int))"),
                                                   F.expr("left(next_text, cast(length(text) div 3 AS int))")))
    # only numbers go through the aggregate over the terms: a string among its buffers would sort every term
    info = e.select("doc_id", "bucket", "rn", "next_bucket", "next_rn", n.cast("long").alias("n_chars"),
                    F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    flat = e.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"),
                                                      F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    fp = fingerprints(flat.select("bucket", "rn", "v.kind", F.col("v.text").alias("text")), ["bucket", "rn", "kind"], "text")
    pair = fp.groupBy("bucket", "rn").agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
                                          F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    pair = info.join(pair, ["bucket", "rn"])
    # a few numbers per document, read twice below and by any search: a written table
    pair = stored(pair, "fingerprints")
    nxt = pair.select(F.col("bucket").alias("next_bucket"), F.col("rn").alias("next_rn"), F.col("fp").alias("next_fp"))
    return pair.join(nxt, ["next_bucket", "next_rn"]).select(
        "doc_id", "n_chars", "edited_sha256", "fp", hex_of(F.col("fp")).alias("fingerprint"),
        hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


# ----------------------------------------------------------- Hamming search


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """Masks of ``blocks`` runs of neighbouring bits that cover all 64."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def table_masks(radius: int, blocks: int) -> list[int]:
    """One mask per permuted table: the blocks on which its key agrees."""
    return [sum(c) for c in combinations(block_masks(blocks), blocks - radius)]


def hamming_pairs(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, fp_col: str = "fp") -> DataFrame:
    """All pairs ``a < b`` of *different* fingerprints at distance <= ``radius``.

    Equal fingerprints are one row here, so a group of copies is one key. A pair is
    given by the first table in which both agree, and so only once."""
    if not 0 < radius < blocks:
        raise ValueError("need 0 < radius < blocks")
    masks = table_masks(radius, blocks)
    one = fps.where(F.col(fp_col).isNotNull()).select(F.col(fp_col).alias("fp")).distinct()
    keyed = one.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "k"))
    a = keyed.select(F.col("fp").alias("a"), "t", "k")
    b = keyed.select(F.col("fp").alias("b"), F.col("t").alias("t2"), F.col("k").alias("k2"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = reduce(lambda rest, im: F.when(x.bitwiseAND(F.lit(signed(im[1]))) == 0, F.lit(im[0])).otherwise(rest),
                   reversed(list(enumerate(masks))), F.lit(-1))
    return (a.join(b, (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2")) & (F.col("a") < F.col("b"))
                   & (F.bit_count(x) <= radius))
            .where(F.col("t") == first).select("a", "b", F.bit_count(x).alias("distance")))


def near_counts(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fp, n_near``: how many different fingerprints lie within the radius."""
    pairs = hamming_pairs(fps, radius, blocks)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("near_fp"))
    return ends.groupBy("near_fp").agg(F.count("*").alias("n_near"))
