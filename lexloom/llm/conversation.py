r"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)? of a dialogue.

A conversation's rows by turn have faults: blank (no character but white space), duplicate (role and text stand earlier),
truncated (the last such character is none of .!?); the first that applies counts. Edits are Keep (0), Rerole to user or
assistant (2), Delete (3, the only one for blank and duplicate rows) and Insert of an empty user or assistant row (2); a truncated
row that stays adds 1. The cheapest edits are found by Dijkstra's algorithm on the lattice of (row, state of the grammar), which is
never built: priority is (cost, audit), audit being the edits' initials so far, and the first accepting end node that is
popped ends the search. Paths to one node with equal costs hold equally many insertions, so neither audit is a beginning of
the other, and the smaller one stays smaller whatever follows.

    order    rows are sorted by ranges of (conversation, turn, role, text), so a long conversation falls to many tasks. Rows
             whose text stands at an earlier turn are found by an aggregate over digests and a join, and come as
             markers that sort just before them
    blocks   runs of at most BLOCK rows: a conversation that lies within one is repaired there; of any other, Dijkstra's
             search gives the cheapest edits from each state to each state
    chain    blocks of a conversation in order: of each state the cheapest way is kept, with its hash, so that a task holds one
             block and four ways. SHA-256 has no parallel form, so a conversation's text passes one task, as a stream

Order of rows: by turn (null first), role, the text's first 64 characters, its SHA-256. Defined results: null roles and texts are
one space, as are null ids and turns where they are hashed; null conv_id is one conversation; a conversation without rows has zeros,
an empty audit and the hash of nothing; roles count by their first character, and a row whose role is empty has none, so that it
cannot be kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rows and bytes of a block.
BLOCK, BLOCK_BYTES = 256, 1 << 21
START, SYSTEM, USER, ASSISTANT = range(4)
#: State and initial of a role to the next state.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that an inserted or reroled row leads to, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTING = (START, ASSISTANT)
FAULTS = ("", "blank", "duplicate", "truncated")
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with the faults that crc32 of `conv_id:turn` deals out; gone rows are marked."""
    hit = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    out = rows.select("conv_id", "turn", hit.alias("hit"), role.alias("role"), text.alias("text"))
    return out.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") == 0).alias("gone"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def cheapest(rows: list[tuple[str, int]], start: int, ends: bool) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from a state before the rows (initial, fault) to states after them.

    ends: only to the first accepting one that is popped; else to every state that can be reached.
    """
    heap, done, found, n = [(0, "", 0, start)], set(), {}, len(rows)
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == n:
            if not ends or s in ACCEPTING:
                found[s] = cost, audit
                if ends:
                    break
        else:
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            if fault not in (BLANK, DUPLICATE):
                more = fault == TRUNCATED
                if (s, initial) in STEPS:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEPS[s, initial]))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, NEXT[s]))
        if (i, NEXT[s]) not in done:
            heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[s]))
    return found


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """Lines `role:text` that the edits of an audit leave of rows (role, text)."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit in "IR":
            state = NEXT[state]
            yield f"{ROLE[state]}:{text}"
        elif edit == "K":
            state = STEPS[state, role[:1]]
            yield f"{role}:{text}"


class Digest:
    """SHA-256 of lines joined by newlines, which can be continued in several ways."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def then(self, lines: Iterable[str]) -> Digest:
        out = Digest()
        out.sha, out.any = self.sha.copy(), self.any
        for line in lines:
            if out.any:
                out.sha.update(b"\n")
            out.sha.update(line.encode())
            out.any = True
        return out


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
WAYS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
#: Of an unfinished block: its rows, first and last turn, distinct turns, and the ways through it.
OPEN = [("at", pa.int64()), ("closed", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("ways", WAYS)]
OPEN_DDL = "at long, closed boolean, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long, ways array<struct<a:int,b:int,cost:long,audit:string>>"


def _wrapped(x: int) -> int:
    """As a 64-bit number: turns can lie that far apart."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else _wrapped(last - first + 1 - turns)


class Block:
    """Rows of a conversation that stand next to each other."""

    def __init__(self, conv: object):
        self.conv, self.rows, self.faults, self.turns, self.bytes = conv, [], [], [], 0

    def row(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        core = text.rstrip(SPACES)
        self.faults.append(BLANK if not core else DUPLICATE if duplicate else TRUNCATED if core[-1] not in ".!?" else OK)
        self.rows.append((role, text))
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.bytes += len(text)

    def out(self, at: int, whole: bool) -> dict:
        """Columns of the block; whole: it is all of its conversation."""
        initials = [role[:1] for role, _ in self.rows]
        out = {"conv_id": self.conv, "at": at, "closed": whole}
        out |= {name: self.faults.count(k) for k, name in enumerate(FAULTS) if k}
        out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        first, last, n = (self.turns[0], self.turns[-1], len(self.turns)) if self.turns else (None, None, 0)
        lattice = list(zip(initials, self.faults, strict=True))
        if whole:
            ((cost, audit),) = cheapest(lattice, START, ends=True).values()
            digest = Digest().then(repaired(self.rows, audit, START))
            return out | {"gaps": _gaps(first, last, n), "cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}
        ways = [{"a": a, "b": b, "cost": cost, "audit": audit} for a in range(4) for b, (cost, audit) in cheapest(lattice, a, ends=False).items()]
        return out | {"roles": [r for r, _ in self.rows], "texts": [t for _, t in self.rows], "first_turn": first, "last_turn": last, "turns": n, "ways": ways}


def _batches(rows: Iterable[dict], kind: Callable[[], pa.DataType], columns: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        schema = pa.schema([("conv_id", kind()), *columns])
        return pa.record_batch([pa.array([r.get(f.name) for r in held], f.type) for f in schema], schema=schema)

    for r in rows:
        held.append(r)
        size += 200 + sum(map(len, r.get("texts") or ()))
        if size > BLOCK_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _blocks(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = []

        def blocks() -> Iterator[dict]:
            at, now, part, last, marked = TaskContext.get().partitionId() << 33, None, 0, None, None
            for b in batches:
                kinds.append(b.schema.field(0).type)
                for conv, turn, role, digest, kind, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if now is None or now.conv != conv:
                        if now is not None:
                            # the first and the last conversation of a task may go on in others
                            yield now.out(at, whole=part == 0 and at & ((1 << 33) - 1) > 0)
                            at += 1
                        now, part, last, marked = Block(conv), 0, None, None
                    if len(now.rows) == block or now.bytes > BLOCK_BYTES:
                        yield now.out(at, whole=False)
                        at, part = at + 1, part + 1
                        now = Block(conv)
                    key = (turn, role, digest)
                    if kind == 0:
                        marked = key
                    elif kind == 1:
                        now.row(turn, role, text, key == marked or key == last)
                        last = key
            if now is not None:
                yield now.out(at, whole=False)

        yield from _batches(blocks(), lambda: kinds[0], [*RESULT, *OPEN])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = []

    class Chain:
        def __init__(self, conv: object):
            self.sums = {"conv_id": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            self.ways, self.decided = {START: (0, "", Digest())}, []
            self.first, self.last, self.turns, self.role = None, None, 0, None

        def add(self, r: dict) -> None:
            for k in ("blank", "duplicate", "truncated", "illegal"):
                self.sums[k] += r[k]
            rows = list(zip(r["roles"], r["texts"], strict=True))
            if rows:
                self.sums["illegal"] += self.role is not None and self.role + rows[0][0][:1] not in LEGAL
                self.role = rows[-1][0][:1]
            if r["turns"]:
                self.turns += r["turns"] - (self.last == r["first_turn"])
                self.first, self.last = r["first_turn"] if self.first is None else self.first, r["last_turn"]
            best: dict[int, tuple[int, str, int, str]] = {}
            for w in r["ways"]:
                if w["a"] in self.ways:
                    cost, audit, _ = self.ways[w["a"]]
                    way = cost + w["cost"], audit + w["audit"], w["a"], w["audit"]
                    best[w["b"]] = min(best.get(w["b"], way), way)
            self.ways = {b: (cost, audit, self.ways[a][2].then(repaired(rows, own, a))) for b, (cost, audit, a, own) in best.items()}
            audits = [audit for _, audit, _ in self.ways.values()]
            low, high = min(audits), max(audits)
            same = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
            self.decided.append(low[:same])  # all ways that are left begin so
            self.ways = {b: (cost, audit[same:], digest) for b, (cost, audit, digest) in self.ways.items()}

        def out(self) -> dict:
            cost, audit, digest = min((w for s, w in self.ways.items() if s in ACCEPTING), key=lambda w: w[:2])
            return self.sums | {"gaps": _gaps(self.first, self.last, self.turns), "cost": cost, "audit": "".join(self.decided) + audit, "repaired_sha256": digest.sha.hexdigest()}

    def rows() -> Iterator[dict]:
        now = None
        for b in batches:
            kinds.append(b.schema.field(0).type)
            for i in range(b.num_rows):
                r = {f.name: c[i].as_py() for f, c in zip(b.schema, b.columns, strict=True)}
                if now is not None and (r["closed"] or now.sums["conv_id"] != r["conv_id"]):
                    yield now.out()
                    now = None
                if r["closed"]:
                    yield r
                else:
                    now = now or Chain(r["conv_id"])
                    now.add(r)
        if now is not None:
            yield now.out()

    yield from _batches(rows(), lambda: kinds[0], RESULT)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, gone): its faults, cheapest edits and repaired hash.

    gone rows name their conversation and are otherwise left out. block: rows that are searched at once.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    sent = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.col("gone").alias("gone"))
    # texts of a conversation that stand at several turns: markers for all turns but the first
    light = rows.filter(~F.col("gone") & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), sent.alias("digest"))
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    first = light.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("_first"), F.max(turn).alias("_last")).filter("_first <> _last").drop("_last")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    again = light.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    markers = again.filter(turn > F.col("_first")).select("conv_id", "turn", "role", "head", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    kind = F.when(F.col("gone"), F.lit(2)).otherwise(F.lit(1))
    own = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), sent.alias("digest"), kind.alias("kind"), F.when(~F.col("gone"), F.col("text")).alias("text"))
    order = ["conv_id", "turn", "role", "head", "digest"]
    ranges = own.unionByName(markers).repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    blocks = ranges.select("conv_id", "turn", "role", "digest", "kind", "text").mapInArrow(_blocks(block), f"conv_id {conv}, {RESULT_DDL}, {OPEN_DDL}")
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_chain, f"conv_id {conv}, {RESULT_DDL}")


def repair_damaged(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """repair() of the rows that damage() leaves."""
    return repair(damage(rows), block)
