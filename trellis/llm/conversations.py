"""Conversation structure repair: faults, and the cheapest edits that mend the roles.

Rows are sorted by conversation and turn and cut into blocks of BLOCK rows, so a
conversation of any length is worked on in pieces. A dynamic program reads a piece row
by row and keeps, for each state of the role grammar, the least cost and the least
string of edits. The strings are linked nodes that share prefixes; each node knows its
ancestors at distances of powers of two and the rolling hash of its string, so two
strings of equal cost are compared at the end of their longest common prefix, found by
binary lifting. Prefixes taken as equal by hash are compared letter by letter unless
they are one node.

A piece that may be part of a longer conversation is solved from every state to every
state; its strings are ranked. A string of edits is a sequence of one code word a row
(inserts, then what becomes of the row), no code word is the beginning of another, so
strings over several pieces compare as their pieces' ranks do: the same program runs
over the pieces, and the path that it chooses is carried back to them.

Rows of equal turn go by role, then text (the first 64 characters, then a hash); null
turns go first; a null conv_id is a conversation of its own. Null roles and texts count
as one space. Repeated rows are rows. An empty table gives an empty result. The audit
of a conversation is one string, so the last step holds a letter for each of its rows.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import read, write_read

#: Rows of a block (a power of two).
BLOCK = 1 << 10

#: Costs of the edits, the role grammar and what a row ends with.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK, DUPLICATE, CUT = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what the roles so far end with
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role of an inserted or rerolled row
INSERTED = {START: (START, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT),
            ASSISTANT: (ASSISTANT, USER)}  # states after 0, 1, 2 inserts; more come back to a state at a cost
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # inserts that end the grammar
LEGAL = frozenset(("su", "ua", "au"))

_MOD = (1 << 61) - 1
_BASE = 0x1F3A5C7D9B24E681 % _MOD

STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"
PIECE = (f"conv_id {{}}, block long, start long, closed boolean, low long, high long, turns long, {STATS}, head string, "
         "last string, costs array<long>, ranks array<int>, audits array<string>, cost long, audit string, repaired_sha256 string")
PATH = f"conv_id {{}}, block long, start long, choice int, tail string, cost long, {STATS}"


class Strings:
    """Strings as linked nodes: a node adds one symbol to its parent's string."""

    def __init__(self):
        self.symbol, self.depth, self.hash, self.up = [0], [0], [0], [()]
        self.same: set[tuple[int, int]] = set()  # different nodes, equal strings

    def add(self, node: int, symbol: int) -> int:
        self.symbol.append(symbol)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + symbol + 1) % _MOD)
        up, x, k = [node], node, 0
        while k < len(self.up[x]):  # the 2^k-th ancestor of the 2^k-th ancestor
            x = self.up[x][k]
            up.append(x)
            k += 1
        self.up.append(tuple(up))
        return len(self.symbol) - 1

    def lift(self, node: int, depth: int) -> int:
        while (far := self.depth[node] - depth) > 0:
            node = self.up[node][min(far.bit_length(), len(self.up[node])) - 1]
        return node

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the string of ``a`` is less, equal or greater."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.hash[x] != self.hash[y]:
            for k in range(len(self.up[x]) - 1, -1, -1):  # keep both just behind the common prefix
                if k < len(self.up[x]) and k < len(self.up[y]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            less = self._differ(self.up[x][0], self.up[y][0]) or (self.symbol[x] > self.symbol[y]) - (self.symbol[x] < self.symbol[y])
        else:
            less = self._differ(x, y)
        return less or (self.depth[a] > self.depth[b]) - (self.depth[a] < self.depth[b])

    def _differ(self, x: int, y: int) -> int:
        """The order of two strings of equal length and hash: 0 unless the hash collides."""
        order, path = 0, []
        while x != y and (x, y) not in self.same:
            path.append((x, y))
            if self.symbol[x] != self.symbol[y]:
                order = 1 if self.symbol[x] > self.symbol[y] else -1  # the earliest difference decides
            x, y = self.up[x][0], self.up[y][0]
        if not order and path:
            self.same.add(path[0])
        return order

    def symbols(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.symbol[node])
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int) -> str:
        return "".join(map(chr, self.symbols(node)))


class Best:
    """The cheapest string that leads to each state, ties to the least string."""

    def __init__(self, strings: Strings):
        self.strings, self.found = strings, {}

    def offer(self, state: int, cost: int, node: int, symbols: tuple[int, ...]) -> None:
        have = self.found.get(state)
        if have is not None and have[0] <= cost:
            if have[0] < cost or self.strings.compare(self._node(have), self._node(new := [cost, node, symbols])) <= 0:
                return
            self.found[state] = new
        else:
            self.found[state] = [cost, node, symbols]

    def _node(self, entry: list) -> int:
        for s in entry[2]:
            entry[1] = self.strings.add(entry[1], s)
        entry[2] = ()
        return entry[1]

    def items(self) -> dict[int, tuple[int, int]]:
        return {state: (entry[0], self._node(entry)) for state, entry in self.found.items()}


_WORDS = {(k, letter): tuple(map(ord, "I" * k + letter)) for k in range(3) for letter in "DKR"}


def solve(strings: Strings, rows: list[tuple[str, int]], entry: int) -> dict[int, tuple[int, int]]:
    """{state: (cost, string)} behind (role initial, fault) rows, from state ``entry``."""
    now = {entry: (0, 0)}
    for initial, fault in rows:
        best = Best(strings)
        extra = TRUNCATED if fault == CUT else 0
        for state, (cost, node) in now.items():
            for k, at in enumerate(INSERTED[state]):
                base = cost + INSERT * k
                best.offer(at, base + DELETE, node, _WORDS[k, "D"])
                if fault in (BLANK, DUPLICATE):
                    continue
                if (at, initial) in KEEPS:
                    best.offer(KEEPS[at, initial], base + extra, node, _WORDS[k, "K"])
                best.offer(NEXT[at], base + REROLE + extra, node, _WORDS[k, "R"])
        now = best.items()
    return now


def closing(strings: Strings, states: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """(cost, string, state) of the cheapest end; the closing inserts are not in the string."""
    ends = [(cost + INSERT * CLOSING[s], node, s) for s, (cost, node) in states.items()]
    least = min(e[0] for e in ends)
    # two strings of one piece never begin with each other, so the closing inserts decide nothing
    return min((e for e in ends if e[0] == least), key=cmp_to_key(lambda a, b: strings.compare(a[1], b[1])))


def repaired(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[str]:
    """``role:text`` of (role, text) rows after the edits of ``audit``, from ``state``."""
    out, left = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(ROLES[state] + ":")
            continue
        role, text = next(left)
        if edit == "K":
            state = KEEPS[state, role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = NEXT[state]
            out.append(f"{ROLES[state]}:{text}")
    return out


# jobs

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that crc32 of ``conv_id:turn`` plants; rows that it
    drops stay as ``gone``, so that their conversation stays."""
    src = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                               *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    return (src.select("conv_id", "turn", kind.alias("kind"), "role", "text",
                       F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1).cast("int"))))
            .select("conv_id", "turn", (F.col("kind") == 0).alias("gone"),
                    F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text")))


def placed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with their place in the order of conversations and turns, and their block."""
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "gone"]
    return write_read(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("place", F.monotonically_increasing_id())
                      .withColumn("block", F.floor(F.col("place") / block).cast("long")), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: the first that counts of blank, duplicate, truncated."""
    copy = ["conv_id", "role", "digest"]
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    first = (rows.where(~F.col("gone")).groupBy(*copy).agg(F.min("place").alias("first"), F.max("place").alias("final"))
             .where(F.col("first") < F.col("final")).select(*[F.col(c).alias(f"f_{c}") for c in copy], "first"))
    met = rows.join(first, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in copy], "left")
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0))
    return met.select("conv_id", "turn", "gone", "role", "text", "place", "block", fault.alias("fault"))


def _pieces(batches, key: int, block: int):
    """Runs of rows that agree in conversation and block (columns ``key`` and ``block``)."""
    have, run = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if run and (row[key], row[block]) != have:
                yield run
                run = []
            have = row[key], row[block]
            run.append(row)
    if run:
        yield run


def _solve_pieces(batches, schema: pa.Schema):
    """One row a piece; a conversation within a block is done, others give their costs
    and strings from every state to every state."""
    out, ahead, previous = [], None, None
    for run in _pieces(batches, 0, 6):
        if ahead is not None:
            out.append(_piece(ahead, previous == ahead[0][6], run[0][6] == ahead[0][6]))
            previous = ahead[0][6]
        ahead = run
        if len(out) >= 512:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if ahead is not None:
        out.append(_piece(ahead, previous == ahead[0][6], False))
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _piece(run: list[tuple], after: bool, before: bool) -> dict:
    """``after``, ``before``: another conversation's row stands before, behind it in the block."""
    rows = [r for r in run if not r[2]]
    initials = [r[3][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    out = {"conv_id": run[0][0], "block": run[0][6], "start": run[0][5], "closed": after and before,
           "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
           "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
           "head": initials[0] if rows else None, "last": initials[-1] if rows else None}
    out |= {name: sum(r[7] == f for r in rows) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))}
    strings, seen = Strings(), [(i, r[7]) for i, r in zip(initials, rows)]
    if out["closed"]:
        cost, node, state = closing(strings, solve(strings, seen, START))
        audit = strings.text(node) + "I" * CLOSING[state]
        text = "\n".join(repaired([(r[3], r[4]) for r in rows], audit))
        return out | {"gaps": gaps(out["low"], out["high"], out["turns"]), "cost": cost, "audit": audit,
                      "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
    cells = [c for entry in range(4) for states in (solve(strings, seen, entry),) for c in (states.get(s) for s in range(4))]
    order = cmp_to_key(lambda a, b: strings.compare(a[1], b[1]))
    rank, last, ranks = -1, None, [None] * 16
    for i in sorted((i for i, c in enumerate(cells) if c), key=lambda i: order(cells[i])):
        rank += last is None or strings.compare(last, cells[i][1]) != 0
        last, ranks[i] = cells[i][1], rank
    return out | {"costs": [c and c[0] for c in cells], "ranks": ranks, "audits": [c and strings.text(c[1]) for c in cells]}


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _chain(batches, schema: pa.Schema):
    """The path through the pieces of each conversation (rows in order of their start)."""
    names = None

    def done(pieces):
        strings, now, links = Strings(), {START: (0, 0)}, {}
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        low = high = last = None
        for p in pieces:
            best = Best(strings)
            for state, (cost, node) in now.items():
                for to in range(4):
                    if p["costs"][4 * state + to] is not None:
                        best.offer(to, cost + p["costs"][4 * state + to], node, (p["ranks"][4 * state + to] * 16 + 4 * state + to,))
            now = best.items()
            for k in total:
                total[k] += p[k]
            if p["low"] is not None:
                total["turns"] -= p["low"] == high  # both pieces have counted it
                low, high = p["low"] if low is None else low, p["high"]
            if p["head"] is not None:
                total["illegal"] += last is not None and last + p["head"] not in LEGAL
                last = p["last"]
        cost, node, state = closing(strings, now)
        path = [s % 16 for s in strings.symbols(node)]
        out = [{"conv_id": p["conv_id"], "block": p["block"], "start": p["start"], "choice": c} for p, c in zip(pieces, path)]
        out[-1] |= {"tail": "I" * CLOSING[state], "cost": cost, "gaps": gaps(low, high, total.pop("turns")), **total}
        return pa.RecordBatch.from_pylist(out, schema=schema)

    pieces = []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            p = dict(zip(names, row))
            if pieces and pieces[0]["conv_id"] != p["conv_id"]:
                yield done(pieces)
                pieces = []
            pieces.append(p)
    if pieces:
        yield done(pieces)


def _rewrite(batches, schema: pa.Schema):
    """The audit and the repaired text of each piece on its conversation's path."""
    for run in _pieces(batches, 0, 1):
        choice, tail, audits = run[0][6:9]
        audit = audits[choice]
        rows = [(r[3], r[4]) for r in run if not r[5]]
        lines = repaired(rows, audit + (tail or ""), choice // 4)
        yield pa.RecordBatch.from_pylist([{"conv_id": run[0][0], "start": run[0][9], "audit": audit + (tail or ""),
                                           "lines": len(lines), "text": "\n".join(lines)}], schema=schema)


def _join_up(batches, schema: pa.Schema):
    """The whole audit and the hash of the whole text, piece after piece."""
    have, audit, sha, lines = None, [], None, 0

    def row():
        return pa.RecordBatch.from_pylist([{"conv_id": have[0], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=schema)

    for batch in batches:
        for conv, _, part, n, text in zip(*[c.to_pylist() for c in batch.columns]):
            if have != (conv,):
                if have:
                    yield row()
                have, audit, sha, lines = (conv,), [], hashlib.sha256(), 0
            audit.append(part)
            if n:
                sha.update((b"\n" if lines else b"") + text.encode())
                lines += n
    if have:
        yield row()


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation of ``rows`` (conv_id, turn, gone, role, text)."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["conv_id"]
    turns = placed(rows, block)
    piece, path = _arrow(spark, PIECE.format(kind)), _arrow(spark, PATH.format(kind))
    pieces = write_read(faults(turns).repartition("block").sortWithinPartitions("place")
                        .mapInArrow(lambda it: _solve_pieces(it, piece), PIECE.format(kind)), "conversation-pieces")
    result = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    closed = pieces.where("closed").select(*result)

    edge = pieces.where("not closed")
    chained = write_read(edge.drop("closed", "gaps", "audits", "cost", "audit", "repaired_sha256")
                         .repartition("conv_id").sortWithinPartitions("conv_id", "start")
                         .mapInArrow(lambda it: _chain(it, path), PATH.format(kind)), "conversation-paths")
    chosen = (chained.select("conv_id", "start", "choice", "tail").alias("c")
              .join(edge.select("conv_id", "start", "block", "audits").alias("e"),
                    F.col("c.start") == F.col("e.start"))  # a place belongs to one piece
              .select(F.col("c.conv_id").alias("p_conv"), F.col("e.block").alias("p_block"), "choice", "tail", "audits", "c.start"))
    text = f"conv_id {kind}, start long, audit string, lines long, text string"
    whole = f"conv_id {kind}, audit string, repaired_sha256 string"
    text_arrow, whole_arrow = _arrow(spark, text), _arrow(spark, whole)
    texts = (turns.join(chosen, (F.col("block") == F.col("p_block")) & F.col("conv_id").eqNullSafe(F.col("p_conv")))
             .select("conv_id", "block", "place", "role", "text", "gone", "choice", "tail", "audits", "start")
             .repartition("block").sortWithinPartitions("place")
             .mapInArrow(lambda it: _rewrite(it, text_arrow), text))
    audits = (texts.repartition("conv_id").sortWithinPartitions("conv_id", "start")
              .mapInArrow(lambda it: _join_up(it, whole_arrow), whole))
    stats = chained.where(F.col("cost").isNotNull()).select(F.col("conv_id").alias("s_conv"), *result[1:7])
    opened = audits.join(stats, F.col("conv_id").eqNullSafe(F.col("s_conv"))).select(*result)
    return closed.unionByName(opened)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))
