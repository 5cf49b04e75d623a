"""Repair of conversation structure by Knuth's lightest-derivation agenda.

The rows of a conversation, in order, are edited (kept, given another role, deleted,
or joined by an inserted turn) until their roles read as an optional system turn and
pairs of user and assistant. Repairs are items of a weighted hypergraph: ``(i, state)``
says that the first i rows are repaired and end in ``state``; a deduction takes such
an item and the axiom of row i, and gives the next item. Its value is (cost, audit),
the audit being the initials of the edits. Every deduction only adds to the cost and
appends to the audit, so its function is superior and monotone, and the agenda, popped
by the least value, finalises each item with its lightest derivation.

Conversations of up to ``LONG_ROWS`` rows and ``LONG_CHARS`` characters are repaired in
one pass, grouped by one shuffle. Longer ones (a hot conversation may hold a third of
all rows) are sorted into blocks of at most 2^``BLOCK_BITS`` rows; each block finalises its
items from every entering state on its own, a small table of costs per block chooses
the states between blocks, and only then the blocks' edits are made. An insertion is
made before a row or at the very end, never at the end of a block, so no audit of a
block is a prefix of another and the least audits of blocks give the least audit of
all. What a long conversation still sends through one task is what its result asks
for: its audit, one cell of a byte per edit, and its texts, streamed into one hash.

Defined cases: a null conversation id is a conversation of its own; null roles and
texts count as one space; null turns come first; rows with equal turns are taken by
role, then text (byte order). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import ship, stored, to_arrow

LONG_ROWS, LONG_CHARS, BLOCK_BITS = 4096, 16 << 20, 10
BROADCAST_IDS = 100_000            # long conversations are few; beyond this many ids the join shuffles
RETRY, REMOVE, INSERT, CUT_OFF = 1, 2, 5, 5      # costs of Rerole, Delete, Insert and of a truncated row that stays
WHITE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
SPOKEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}       # the state after an inserted or reroled turn
AT_END = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}                  # insertions that complete a state
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
GOAL = 4           # the item that ends a derivation

REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------ the agenda


def lightest(axioms: dict, deduce: Callable, goals: set) -> dict:
    """Knuth's generalisation of Dijkstra's search: the least value of each goal.

    ``axioms`` gives items their values; ``deduce(item, value)`` yields (item, value) of
    the deductions whose last missing premise is ``item``. Values are ordered, and no
    deduction gives less than its premises. Ends when all goals are final."""
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    final, open_goals = {}, set(goals)
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if item in open_goals:
            open_goals.remove(item)
            if not open_goals:
                break
        for nxt, worth in deduce(item, value):
            if nxt not in final:
                heapq.heappush(agenda, (worth, nxt))
    return {g: final[g] for g in goals if g in final}


def row_edits(state: int, row: str, value: tuple) -> Iterable[tuple]:
    """(next state, value) of the edits that consume a row; ``row`` is its initial
    (a space for none) and its fault."""
    (cost, audit), initial, fault = value, row[0], int(row[1])
    yield state, (cost + REMOVE, audit + "D")
    if fault < DUPLICATE:
        more = CUT_OFF if fault == TRUNCATED else 0
        if (state, initial) in STEP:
            yield STEP[state, initial], (cost + more, audit + "K")
        yield SPOKEN[state], (cost + more + RETRY, audit + "R")


@lru_cache(maxsize=20_000)
def short_repair(rows: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation, two characters a row; conversations of
    the same roles and faults share one derivation."""
    n = len(rows) // 2

    def deduce(item, value):
        i, state = item
        cost, audit = value
        yield (i, SPOKEN[state]), (cost + INSERT, audit + "I")
        if i < n:
            for to, worth in row_edits(state, rows[2 * i:2 * i + 2], value):
                yield (i + 1, to), worth
        elif state in (START, ASSISTANT):
            yield (n, GOAL), value

    goal = (n, GOAL)
    return lightest({(0, START): (0, "")}, deduce, {goal})[goal]


def block_repair(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(entering state, leaving state) -> (cost, audit) of a block whose audit ends with
    the edit of its last row."""
    n, out = len(rows) // 2, {}

    def deduce(item, value):
        i, state = item
        if i < n:
            cost, audit = value
            yield (i, SPOKEN[state]), (cost + INSERT, audit + "I")
            for to, worth in row_edits(state, rows[2 * i:2 * i + 2], value):
                yield (i + 1, to), worth

    for start in range(4):
        found = lightest({(0, start): (0, "")}, deduce, {(n, q) for q in range(4)})
        out |= {(start, q): value for (_, q), value in found.items()}
    return out


def choose_states(blocks: list[dict[tuple[int, int], tuple[int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost over consecutive blocks and the states at their borders; ``blocks``
    give (cost, rank of the audit among those from the same state)."""
    ahead = {q: INSERT * len(AT_END[q]) for q in range(4)}
    picks = []
    for table in reversed(blocks):
        best = {}
        for (a, b), (cost, rank) in table.items():
            best[a] = min(best.get(a, (1 << 62, 0, 0)), (cost + ahead[b], rank, b))
        picks.append(best)
        ahead = {a: v[0] for a, v in best.items()}
    state, path = START, []
    for best in reversed(picks):
        path.append((state, best[state][2]))
        state = path[-1][1]
    return ahead[START], path


def edited(audit: str, turns: Iterable[tuple[str, str]], state: int = START) -> Iterable[tuple[str, str, str]]:
    """The repaired turns (role, text, edit) that an audit makes of the rows."""
    rows = iter(turns)
    for edit in audit:
        if edit == "I":
            state = SPOKEN[state]
            yield NAMES[state], "", edit
            continue
        role, text = next(rows)
        if edit == "K":
            state = STEP[state, role[0]]
            yield role, text, edit
        elif edit == "R":
            state = SPOKEN[state]
            yield NAMES[state], text, edit


def illegal_pairs(initials: str) -> int:
    return sum(p not in ("su", "ua", "au") for p in neighbours(initials))


def neighbours(s: str) -> list[str]:
    return [s[i:i + 2] for i in range(len(s) - 1)]


# ------------------------------------------------------------ faults of rows


def row_code(role: str, text: str, seen: bool) -> str:
    core = text.rstrip(WHITE)
    fault = BLANK if not core else DUPLICATE if seen else TRUNCATED if core[-1] not in ".!?" else FINE
    return (role[:1] or " ") + str(fault)


def damage(conversations: DataFrame) -> DataFrame:
    """The op11 contract's damage: ``conv_id, turn, role, text, live``; a dropped row
    stays as one that is not live, so that its conversation is still known."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                             (F.crc32(key.cast("binary")) % 20).alias("k"))
    c = c.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                 (F.col("k") != 0).alias("live"), "k")
    return c.withColumn("again", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again", "k")


def tidy(rows: DataFrame) -> DataFrame:
    live = F.col("live") if "live" in rows.columns else F.lit(True)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.coalesce(live, F.lit(True)).alias("live"))


# ------------------------------------------------------------ short conversations


def runs(batches: Iterable[pa.RecordBatch]) -> Iterable[tuple]:
    """(conv_id, rows) of sorted batches; rows are (turn, role, text, live)."""
    def rows():
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in range(5)))

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, [r[1:] for r in group]


def short_report(conv, rows: list[tuple]) -> tuple:
    live = [r for r in rows if r[3]]
    if not live:
        return conv, 0, 0, 0, 0, 0, 0, "", EMPTY_HASH
    turns, code = repair_turns(live)
    cost, audit = short_repair(code)
    known = {r[0] for r in live} - {None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    faults = code[1::2]
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text, _ in edited(audit, turns)).encode()).hexdigest()
    return (conv, gaps, faults.count(str(BLANK)), faults.count(str(DUPLICATE)), faults.count(str(TRUNCATED)),
            illegal_pairs(code[::2]), cost, audit, digest)


def repair_turns(live: list[tuple]) -> tuple[list[tuple[str, str]], str]:
    seen, code = set(), []
    turns = [(role, text) for _, role, text, _ in live]
    for t in turns:
        code.append(row_code(*t, t in seen))
        seen.add(t)
    return turns, "".join(code)


def short_turns(conv, rows: list[tuple]) -> Iterable[tuple]:
    turns, code = repair_turns([r for r in rows if r[3]])
    for at, (role, text, edit) in enumerate(edited(short_repair(code)[1], turns)):
        yield conv, at, role, text, edit


def mapped(rows: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """``fn(conv_id, rows)`` yields result rows; conversations are grouped by one shuffle."""
    ship(rows.sparkSession)
    schema = to_arrow(ddl)

    def run(batches):
        out, size = [], 0
        for conv, group in runs(batches):
            for r in fn(conv, group):
                out.append(r)
                size += sum(len(x) for x in r if isinstance(x, str))
            if len(out) >= 10_000 or size >= 4 << 20:
                yield as_batch(out, schema)
                out, size = [], 0
        if out:
            yield as_batch(out, schema)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, ddl)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# ------------------------------------------------------------ long conversations


class LongConversations:
    """Blocks of the long conversations; every table but the costs is spread by block."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        ship(spark)
        self.kind = dict(rows.dtypes)["conv_id"]
        live = rows.where("live").select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("salt"))
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
        ordered = live.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
        # increasing along the order, and by steps of one within a partition
        self.rows = stored(ordered.drop("salt").select("*", F.monotonically_increasing_id().alias("at"),
                                                       F.md5(F.col("text")).alias("digest")), "long-rows")
        first = self.rows.groupBy("conv_id", "role", "digest", F.length("text").alias("size")).agg(F.min("at").alias("first"))
        last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
        r = self.rows.select("conv_id", "role", "digest", F.length("text").alias("size"), "at", last.alias("last"))
        fault = (F.when(F.col("last") == "", BLANK).when(F.col("at") > F.col("first"), DUPLICATE)
                 .when(F.col("last").isin(".", "!", "?"), FINE).otherwise(TRUNCATED))
        coded = joined(r, first, ["conv_id", "role", "digest", "size"]).select(
            "conv_id", "at", F.shiftright("at", BLOCK_BITS).alias("block"),
            F.concat(F.rpad(F.substring("role", 1, 1), 1, " "), fault.cast("string")).alias("code"))
        # a block's codes in order: a bounded number of short strings
        blocks = coded.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("codes"))
        self.blocks = stored(blocks.select("conv_id", "block", F.array_join(F.col("codes.code"), "").alias("codes")), "long-blocks")
        self.paths = self.choose()

    def choose(self) -> DataFrame:
        """The chosen derivation of every block: ``conv_id, block, enter, audit, cost``."""
        schema = f"conv_id {self.kind}, block long, enter int, leave int, cost long, rank int, audit string"
        out = to_arrow(schema)

        def derive(batches):
            for b in batches:
                rows = []
                for conv, block, codes in zip(*(b.column(k).to_pylist() for k in range(3))):
                    found = block_repair(codes)
                    ranks = {a: r for r, a in enumerate(sorted({v[1] for v in found.values()}))}
                    rows += [(conv, block, a, z, cost, ranks[audit], audit) for (a, z), (cost, audit) in found.items()]
                if rows:
                    yield as_batch(rows, out)

        derived = stored(self.blocks.mapInArrow(derive, schema), "long-derivations")
        picked_schema = f"conv_id {self.kind}, block long, enter int, leave int, total long"
        picked_out = to_arrow(picked_schema)

        def pick(table: pa.Table) -> pa.Table:
            # sixteen numbers a block, whatever the texts
            tables: dict[int, dict] = {}
            for block, a, z, cost, rank in zip(*(table.column(k).to_pylist() for k in ("block", "enter", "leave", "cost", "rank"))):
                tables.setdefault(block, {})[a, z] = (cost, rank)
            order = sorted(tables)
            total, path = choose_states([tables[k] for k in order])
            conv = table.column("conv_id")[0].as_py()
            return pa.Table.from_batches([as_batch([(conv, k, a, z, total) for k, (a, z) in zip(order, path)], picked_out)])

        picked = derived.drop("audit").groupBy("conv_id").applyInArrow(pick, picked_schema)
        return stored(joined(derived, picked, ["conv_id", "block", "enter", "leave"]).drop("cost", "rank"), "long-paths")

    def turns(self) -> DataFrame:
        """``conv_id, block, at, role, text, edit``: repaired turns by block."""
        schema = f"conv_id {self.kind}, block long, at long, role string, text string, edit string"
        out = to_arrow(schema)
        rows = self.rows.select("conv_id", F.shiftright("at", BLOCK_BITS).alias("block"), "at", "role", "text")

        def run(key, table: pa.Table, path: pa.Table) -> pa.Table:
            t, (conv, block) = table.sort_by("at"), (k.as_py() for k in key)
            turns = zip(t.column("role").to_pylist(), t.column("text").to_pylist())
            made = edited(path.column("audit")[0].as_py(), turns, path.column("enter")[0].as_py())
            made = [(conv, block, at, *turn) for at, turn in enumerate(made)]
            return pa.Table.from_batches([as_batch(made, out)] if made else [], out)

        keys = ["conv_id", "block"]
        inner = rows.groupBy(*keys).cogroup(self.paths.select(*keys, "enter", "audit").groupBy(*keys)).applyInArrow(run, schema)
        ends = self.endings()
        return inner.unionByName(ends.select("conv_id", (F.col("block") + 1).alias("block"), F.col("p.at").cast("long").alias("at"),
                                             F.col("p.role").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))

    def endings(self) -> DataFrame:
        """Turns inserted after the last row."""
        last = self.paths.groupBy("conv_id").agg(F.max_by("leave", "block").alias("leave"), F.max("block").alias("block"))
        user, agent = (F.struct(F.lit(at).alias("at"), F.lit(role).alias("role")) for at, role in ((0, "user"), (1, "assistant")))
        return last.withColumn("p", F.explode(F.when(F.col("leave") == USER, F.array(agent))
                                              .when(F.col("leave") == SYSTEM, F.array(user, agent)).otherwise(F.array().cast("array<struct<at:int,role:string>>"))))

    def report(self) -> DataFrame:
        codes = self.blocks.select("conv_id", "block", F.col("codes").alias("c"))
        schema = f"conv_id {self.kind}, block long, head string, tail string, illegal long, n{TRUNCATED} long, n{DUPLICATE} long, n{BLANK} long"
        out = to_arrow(schema)

        def tally(batches):
            for b in batches:
                rows = []
                for conv, block, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                    faults = c[1::2]
                    rows.append((conv, block, c[0], c[-2], illegal_pairs(c[::2]), *(faults.count(str(f)) for f in (TRUNCATED, DUPLICATE, BLANK))))
                if rows:
                    yield as_batch(rows, out)

        t = codes.mapInArrow(tally, schema)
        # pairs across block borders
        ends = t.groupBy("conv_id").agg(F.sum("illegal").alias("inside"), *(F.sum(f"n{f}").alias(f"n{f}") for f in (TRUNCATED, DUPLICATE, BLANK)),
                                        F.array_sort(F.collect_list(F.struct("block", "head", "tail"))).alias("b"))
        pairs = F.expr("size(filter(transform(sequence(1, size(b)), i -> if(i = size(b), 'su', concat(b[i - 1].tail, b[i].head))), "
                       "x -> x not in ('su', 'ua', 'au')))")
        facts = ends.select("conv_id", (F.col("inside") + pairs).cast("long").alias("illegal"), F.col(f"n{BLANK}").alias("blank"),
                            F.col(f"n{DUPLICATE}").alias("duplicate"), F.col(f"n{TRUNCATED}").alias("truncated"))
        gaps = self.rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("x")).groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
        audits = self.paths.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("a"),
                                                   F.max_by("leave", "block").alias("leave"), F.max("total").alias("cost"))
        tail = F.when(F.col("leave") == USER, "I").when(F.col("leave") == SYSTEM, "II").otherwise("")
        audits = audits.select("conv_id", "cost", F.concat(F.array_join(F.col("a.audit"), ""), tail).alias("audit"))
        r = facts
        for part in (gaps, audits, self.digests()):
            r = joined(r, part, ["conv_id"], "left")
        return r.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))

    def digests(self) -> DataFrame:
        """The hash of each conversation's turns, streamed in order."""
        schema = f"conv_id {self.kind}, repaired_sha256 string"
        out = to_arrow(schema)

        def run(batches):
            def rows():
                for b in batches:
                    yield from zip(*(b.column(k).to_pylist() for k in range(3)))

            for conv, group in groupby(rows(), key=lambda r: r[0]):
                h, lead = hashlib.sha256(), ""
                for _, role, text in group:
                    h.update(f"{lead}{role}:{text}".encode())
                    lead = "\n"
                yield as_batch([(conv, h.hexdigest())], out)

        ordered = self.turns().repartition("conv_id").sortWithinPartitions("conv_id", "block", "at").select("conv_id", "role", "text")
        return ordered.mapInArrow(run, schema)


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; ``b`` adds its other columns."""
    b = b.withColumnsRenamed({k: f"other_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
    return a.join(b, same, how).drop(*(f"other_{k}" for k in keys))


# ------------------------------------------------------------ the operator


def parted(rows: DataFrame, long_rows: int, long_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations and, if there are any, of long ones."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.when(F.col("live"), 1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long_ids = stored(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("long_id")), "long-ids")
    n = long_ids.count()
    if not n:
        return rows, None
    if n <= BROADCAST_IDS:
        long_ids = F.broadcast(long_ids)
    same = rows.conv_id.eqNullSafe(long_ids.long_id)
    return rows.join(long_ids, same, "left_anti"), rows.join(long_ids, same, "left_semi")


def repair_report(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text`` and, if some
    rows only name their conversation, ``live``): gaps and faults before the repair,
    its cost and audit, and the hash of the repaired turns (``role:text`` by lines)."""
    rows = tidy(rows)
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, {REPORT}"
    few, many = parted(rows, long_rows, long_chars)
    out = mapped(few, lambda conv, group: [short_report(conv, group)], ddl)
    return out if many is None else out.unionByName(LongConversations(many).report())


def repaired_turns(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """``conv_id, block, at, role, text, edit``: the turns after the repair, in the order
    of ``block, at`` in each conversation (``edit``: K kept, R reroled, I inserted)."""
    rows = tidy(rows)
    few, many = parted(rows, long_rows, long_chars)
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, at long, role string, text string, edit string"
    out = mapped(few, short_turns, ddl).select("conv_id", F.lit(0).cast("long").alias("block"), "at", "role", "text", "edit")
    return out if many is None else out.unionByName(LongConversations(many).turns())
