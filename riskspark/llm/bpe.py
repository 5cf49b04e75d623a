"""Byte-level BPE encoding by content-defined chunk reuse, and decoding.

A rolling hash over code points cuts every text into chunks whose borders depend
on nearby content only, so passages shared by documents give equal chunks. Chunks
that occur more than once are encoded once for the whole corpus and joined back;
the others are encoded where they stand. A chunk border may split a word, so each
seam is repaired: the text between the last safe border before the seam and the
first one after it is encoded anew and must agree with the ids it replaces.

A border is safe between a character that is not white space and a following
space or line feed: no pre-token of the byte-level pattern spans it, whatever
stands around it.

Defined cases: a null text is the empty text and has no ids. Repeated rows each
give a row. Columns beyond the named ones are ignored. An empty table gives an
empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_map, id_text, stored

LONG_TEXT = 100_000        # longer texts are encoded in portions, cut at safe borders
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
SPACE = re.compile(r"\s")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable bytes for
    themselves, the others by the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Exact ids of a byte-level BPE tokenizer, given as a tokenizers JSON file.

    If ids number the merges in order (checked, see ``merge_ranks``), tiktoken runs the
    same merges some times faster, without a memo; any other file is left to the
    tokenizers library. Both give the same ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.separable = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                          and not spec.get("normalizer")
                          and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or SPACE.search(a["content"])
                                      for a in spec.get("added_tokens", [])))
        self.bytes_of: list[bytes] = []
        self.strings: list[str] = []
        self.fast = self.merge_ranks(spec["model"]) if self.separable else None

    def merge_ranks(self, model: dict):
        """The tiktoken encoding of the same merges, or None where it would differ."""
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                                     "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if any(x >= y for x, y in zip(made, made[1:])) or made and min(made) < 256 or len(vocab) - len(self.added.keys() & vocab.keys()) != 256 + len(made):
            return None
        import tiktoken
        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        # every token's own text must come out as the library gives it
        probe = [t for t in (b.decode("utf-8", "ignore") for b in ranks) if t]
        same = all(fast.encode(t, allowed_special="all") == x.ids
                   for t, x in zip(probe, self.tok.encode_batch_fast(probe, add_special_tokens=False)))
        return fast if same else None

    def encode(self, text: str) -> np.ndarray:
        if not self.separable or len(text) <= LONG_TEXT:
            return self.portion(text)
        return np.concatenate([self.portion(p) for p in self.portions(text)])

    def portion(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= 2 * LONG_TEXT:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def portions(text: str) -> list[str]:
        """Parts of a long text, cut at safe borders at least half of LONG_TEXT apart;
        a part without a border may be longer."""
        parts, at = [], 0
        while len(text) - at > LONG_TEXT:
            cut = SAFE_CUT.search(text, at + LONG_TEXT // 2)
            if cut is None:
                break
            parts.append(text[at:cut.start()])
            at = cut.start()
        return [*parts, text[at:]]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Equal texts are encoded once."""
        known: dict[str, np.ndarray] = {}
        for t in texts:
            if t not in known:
                known[t] = self.encode(t)
        return [known[t] for t in texts]

    def tables(self) -> None:
        """Decimal text and bytes of every id (added tokens by their content)."""
        size = self.tok.get_vocab_size(with_added_tokens=True)
        byte_of = byte_alphabet()
        added = {a["id"]: a["content"].encode() for a in json.loads(self.tok.to_str()).get("added_tokens", [])}
        self.bytes_of = [b""] * size
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = added.get(i) if i in added else bytes(byte_of[c] for c in token)
        self.strings = [str(i) for i in range(size)]

    def decode(self, ids: list[int]) -> str:
        if not self.bytes_of:
            self.tables()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def id_list(self, ids: list[int]) -> str:
        if not self.strings:
            self.tables()
        return ",".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


# ------------------------------------------------- content-defined chunks


def content_cuts(text: str, least: int = MIN_CHUNK, bits: int = MEAN_BITS, most: int = MAX_CHUNK) -> list[int]:
    """End positions of the chunks of ``text``. A position ends a chunk if the
    hash of the 16 code points before it has ``bits`` leading zeros."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    base = 0x01000193
    for w in (1, 2, 4, 8):  # windows of 2, 4, 8 and 16 code points
        wide = h.copy()
        wide[w:] += h[:-w] * np.uint32(pow(base, w, 1 << 32))
        h = wide
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    marks = (np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1).tolist()
    cuts, last = [], 0
    for m in [*marks, n]:
        while m - last > most:
            last += most
            cuts.append(last)
        if m - last >= least and m < n:
            cuts.append(m)
            last = m
    if last < n:
        cuts.append(n)
    return cuts


def chunk_key(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8"), digest_size=16).digest()


def safe_borders(chunk: str) -> tuple[int, int] | None:
    """First and last safe border inside the chunk."""
    first = SAFE_CUT.search(chunk, 1)
    if not first:
        return None
    last = max(chunk.rfind(" "), chunk.rfind("\n"))
    while last > 0 and (chunk[last] not in " \n" or SPACE.match(chunk[last - 1])):
        last -= 1
    return first.start(), last


def repaired(chunks: list[str], ids: list[np.ndarray], enc: Encoder) -> np.ndarray:
    """Join the chunks' ids; every seam is encoded anew between safe borders."""
    if len(chunks) == 1 or not enc.separable:
        return ids[0] if len(chunks) == 1 else enc.encode("".join(chunks))
    borders = [safe_borders(c) for c in chunks]
    ends = [p for c, b in zip(chunks, borders) if b for p in (c[:b[0]], c[b[1]:])]
    coded = iter(enc.encode_many(ends))
    seams: list[str] = []
    inner: list[np.ndarray] = []
    carry = ""
    for c, x, b in zip(chunks, ids, borders):
        if b is None:           # no safe border: the seam goes on through this chunk
            carry += c
            continue
        head, tail = next(coded), next(coded)
        stop = len(x) - len(tail)
        seams.append(carry + c[:b[0]])
        if len(head) <= stop and np.array_equal(x[:len(head)], head) and np.array_equal(x[stop:], tail):
            inner.append(x[len(head):stop])
        else:                   # no agreement with the chunk's own ids: encode the whole of it
            inner.append(enc.encode(c[b[0]:b[1]]))
        carry = c[b[1]:]
    joints = enc.encode_many([*seams, carry])
    out = [joints[0]]
    for x, s in zip(inner, joints[1:]):
        out += [x, s]
    return np.concatenate(out)


def split_chunks(text: str) -> tuple[list[int], list[str]]:
    ends = content_cuts(text)
    starts = [0, *ends[:-1]] if ends else []
    return starts, [text[a:b] for a, b in zip(starts, ends)]


# ------------------------------------------------------------- the operator


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks, n_reused`` per row
    (and ``ids`` with ``keep_ids``). ``tokenizer_path`` names a tokenizers JSON
    file with a byte-level BPE that every worker can open."""
    d = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # the key of a row: hashes of its id and of its text (never null)
    d = d.select("doc_id", "text", F.xxhash64("doc_id").alias("ih"), F.xxhash64("text").alias("th"))
    kind = dict(d.dtypes)["doc_id"]

    def refs_of(b: pa.RecordBatch):
        cols = {k: [] for k in ("ih", "th", "pos", "key")}
        for t, ih, th in zip(*(b.column(k).to_pylist() for k in range(3))):
            for pos, chunk in zip(*split_chunks(t)):
                for k, v in zip(cols, (ih, th, pos, chunk_key(chunk))):
                    cols[k].append(v)
        yield cols

    refs = stored(arrow_map(d.select("text", "ih", "th"), refs_of, "ih long, th long, pos long, key binary"), "chunk-refs")
    # chunks that occur more than once, with one place where each stands
    shared = (refs.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("ih", "th", "pos")).alias("at"))
              .where("n > 1"))
    wanted = (shared.select("at.ih", "at.th", F.struct(F.col("at.pos").alias("pos"), "key").alias("c"))
              .groupBy("ih", "th").agg(F.collect_list("c").alias("wanted")))

    def pack(b: pa.RecordBatch):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        yield {"doc_id": b.column(0).to_pylist(), "ih": b.column(2).to_pylist(), "th": b.column(3).to_pylist(),
               "packed": [squeeze(t.encode("utf-8")) for t in b.column(1).to_pylist()]}

    # the texts, compressed, are dealt out once by their key; both joins use that one
    # exchange: each reads all its columns, and the condition that an inner join would
    # push below it (keys are never null, but the schema does not say so) stands there for both
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = arrow_map(d, pack, f"doc_id {kind}, ih long, th long, packed binary").where("ih IS NOT NULL AND th IS NOT NULL").repartition(width, "ih", "th")

    def unpack(column):
        loose = zstandard.ZstdDecompressor().decompress
        return [loose(x).decode("utf-8") for x in column.to_pylist()]

    def encode_shared(b: pa.RecordBatch):
        enc = encoder(tokenizer_path)
        keys, chunks, done = [], [], set()
        for t, want in zip(unpack(b.column(1)), b.column(2).to_pylist()):
            parts = dict(zip(*split_chunks(t)))
            for w in want:
                if w["key"] not in done:
                    done.add(w["key"])
                    keys.append(w["key"])
                    chunks.append(parts[w["pos"]])
        yield {"key": keys, "ids": [x.tobytes() for x in enc.encode_many(chunks)]}

    # rows that repeat share their key: their chunks are encoded once all the same
    encoded = arrow_map(dealt.join(wanted, ["ih", "th"]).select("doc_id", "packed", "wanted"), encode_shared, "key binary, ids binary").dropDuplicates(["key"])
    # one row per document: the ids of its shared chunks
    ready = (refs.join(encoded, "key").select("ih", "th", F.struct("pos", "ids").alias("c"))
             .groupBy("ih", "th").agg(F.collect_list("c").alias("ready")))

    def assemble(b: pa.RecordBatch):
        enc = encoder(tokenizer_path)
        doc_ids, texts, readies = b.column(0).to_pylist(), unpack(b.column(1)), b.column(2).to_pylist()
        cols = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused", "ids")}
        for i, t, r in zip(doc_ids, texts, readies):
            have = {x["pos"]: np.frombuffer(x["ids"], np.uint32) for x in r or ()}
            starts, chunks = split_chunks(t)
            own = iter(enc.encode_many([c for s, c in zip(starts, chunks) if s not in have]))
            ids = [have[s] if s in have else next(own) for s in starts]
            joined = repaired(chunks, ids, enc).tolist() if chunks else []
            row = (i, len(joined), hashlib.sha256(enc.id_list(joined).encode()).hexdigest(),
                   hashlib.sha256(enc.decode(joined).encode("utf-8")).hexdigest(), len(chunks), len(have),
                   joined if keep_ids else None)
            for k, v in zip(cols, row):
                cols[k].append(v)
        if not keep_ids:
            del cols["ids"]
        yield cols

    schema = (f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long, n_reused long"
              + ", ids array<int>" * keep_ids)
    return arrow_map(dealt.join(ready, ["ih", "th"], "left").select("doc_id", "packed", "ready"), assemble, schema)
