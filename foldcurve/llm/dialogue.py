"""Conversation structure repair: the cheapest edits, by an auction algorithm over a lattice of edits.

A conversation is in order when its roles read: perhaps a system turn, then user and
assistant in turn. Edits, in order of their initials: Delete a row (2), Insert an empty
user or assistant row anywhere (5), Keep a row (0), Rerole a row to user or assistant
(1). A blank row and a duplicate (role and text seen earlier) must go; a row that breaks
off costs 5 more unless it goes. What has been put out so far is in one of four states
(nothing, s, u, a), and in each state one role at most can be inserted, so an edit's
initial names its arc.

Prices. Nodes are (row, state), arcs edits with whole costs. An auction holds a path and
a price for each node, never above the node's distance to the end. It extends the path
by an arc that is tight (price = cost + price behind it), the least initial first; where
there is none it raises the node's price to the least offer and contracts the path by
one node. Blocks of rows are settled from the end, all four states of a block's first
row each, so that no path grows beyond a block. The prices that have converged then
expose the tight arcs, and a last auction traces them: prices only rise, so a smaller
initial that it passed by is on no cheapest path, and the trace is the least.

Spark. Rows are ranged by conversation, turn, role and text and cut into chunks of
bounded size; a conversation that lies within one task is solved there. Of one that
spans tasks or chunks, each chunk is a 4 x 4 table of costs; the tables of a
conversation are folded from its end, then each chunk is traced from all four states
and the states are followed from the start. A hot conversation is thus solved by as many
tasks as it fills; only its text hash and its audit string, one value each, are put
together in one task, as a stream (a value of Spark ends at 2^31 bytes, which bounds
the folded tables too). Rows equal in all columns are counted before they are dealt.

Null role and text count as one space (a role of no known initial; a blank text). Null
turns come first; rows of one turn go by role and text; null conversation ids are one
conversation. Very long texts lie in a chunk of their own. Empty tables give no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.llm.common import SPACE, partitions, written

#: Rows and bytes of text in a chunk, and rows that one auction spans.
CHUNK_ROWS, CHUNK_BYTES, BLOCK = 1024, 4 << 20, 16

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kept rows: initial to the states it may follow and the state it leads to.
KEPT = {"s": ((EMPTY,), SYSTEM), "u": ((EMPTY, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: States from which each state can be reached.
BEHIND = ((EMPTY,), (EMPTY, SYSTEM), (EMPTY, SYSTEM, USER, ASSISTANT), (EMPTY, SYSTEM, USER, ASSISTANT))
DELETE, INSERT, REROLE, BROKEN = 2, 5, 1, 5
#: Cost of what must still be inserted behind the last row.
FINAL = (0, 2 * INSERT, INSERT, 0)
ENDS = ("", "II", "I", "")
FAR = 1 << 40

#: In a shape, a row's initial (x: none known), a capital if it breaks off, or this if it must go.
GOES = "-"


def arcs_of(symbol: str, state: int) -> list[tuple[int, int, int, str]]:
    """(cost, rows passed, state behind, initial) by initial."""
    out = [(DELETE, 1, state, "D"), (INSERT, 0, NEXT[state], "I")]
    if symbol != GOES:
        more = BROKEN if symbol.isupper() else 0
        after, leads = KEPT.get(symbol.lower(), ((), EMPTY))
        if state in after:
            out.append((more, 1, leads, "K"))
        out.append((REROLE + more, 1, NEXT[state], "R"))
    return out


ARCS = {x: [arcs_of(x, q) for q in range(4)] for x in GOES + "suaxSUAX"}


def auction(prices: list[int], shape: str, row: int, state: int, stop: int, allowed=BEHIND[-1]) -> tuple[int, list[str]]:
    """Raises `prices` (four a row) until a path of tight arcs leads from (row, state) to row `stop`; its last state and initials."""
    path, letters = [(row, state)], []
    while path[-1][0] < stop:
        i, q = path[-1]
        best, step = FAR * 2, None
        for cost, ahead, behind, letter in ARCS[shape[i]][q]:
            if behind in allowed and cost + prices[4 * (i + ahead) + behind] < best:
                best, step = cost + prices[4 * (i + ahead) + behind], ((i + ahead, behind), letter)
        if best > prices[4 * i + q]:
            prices[4 * i + q] = min(best, FAR)
            if len(path) > 1:
                path.pop()
                letters.pop()
            elif best >= FAR:
                break
        else:
            path.append(step[0])
            letters.append(step[1])
    return path[-1][1], letters


def settled(shape: str, exits: tuple[int, ...], allowed=BEHIND[-1]) -> list[int]:
    """Converged prices of the first states of all blocks, given those behind the last row."""
    n = len(shape)
    prices = [0] * (4 * n) + list(exits)
    for start in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        stop = min(n, start + BLOCK)
        prices[4 * start : 4 * stop] = [min(prices[4 * stop : 4 * stop + 4])] * (4 * (stop - start))
        for q in range(4):
            if q in allowed:
                auction(prices, shape, start, q, stop, allowed)
            else:
                prices[4 * start + q] = FAR
    return prices


@lru_cache(maxsize=1 << 14)
def traced(shape: str, entry: int, exits: tuple[int, ...]) -> tuple[str, int, int]:
    """Initials of the cheapest edits from `entry`, the state they end in, and the distance from entry."""
    prices = settled(shape, exits)
    state, letters = auction(prices, shape, 0, entry, len(shape))
    return "".join(letters), state, prices[entry]


def costs(shape: str) -> list[int]:
    """Costs from each state ahead of the rows to each state behind them, row by row of the table."""
    out = [[FAR] * 4 for _ in range(4)]
    for end in range(4):
        prices = settled(shape, tuple(0 if q == end else FAR for q in range(4)), BEHIND[end])
        for q in BEHIND[end]:
            out[q][end] = min(prices[q], FAR)
    return [x for row in out for x in row]


def applied(letters: str, entry: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, number of the row or None, role, text) for each initial; a deleted row keeps its own."""
    state, row = entry, 0
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield letter, None, NAMES[state], ""
            continue
        role = roles[row]
        if letter == "R":
            state = NEXT[state]
            role = NAMES[state]
        elif letter == "K":
            state = KEPT[role[0]][1]
        yield letter, row, role, texts[row]
        row += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """Damage to test the repair with: by crc32 of `conv_id:turn` mod 20 rows are dropped, emptied, cut, repeated or given to the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of different rows, with copies (how often each is there), blank, broken, and seen (role and text stand at an earlier turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    different = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    different = different.withColumn("sign", F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.octet_length("role").cast("string"), F.lit("\x00"), F.col("text")).cast("binary"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = different.groupBy("conv_id", "sign").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("sign").alias("of_sign"), "first")
    joined = different.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("sign") == F.col("of_sign")), "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("broken"),
        F.coalesce(F.col("first") < order, F.lit(False)).alias("seen"),
    )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Chunk:
    """Rows of one conversation in their order, and what its report needs of them."""

    FIELDS = (
        "conv_id {conv}, task int, number int, whole boolean, shape string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, "
        "first string, last string, low long, high long, n_turns long, turns array<long>, roles array<string>, texts array<string>, entry int, edits string, cost long"
    )

    def __init__(self, conv_id):
        self.conv_id, self.shape, self.size = conv_id, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.low = self.high = None
        self.n_turns, self.turns, self.roles, self.texts = 0, [], [], []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1] if role[:1] in KEPT else "x"
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.shape.append(GOES if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.first, self.last = self.first or initial, initial
        if turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def row(self, task: int, number: int, whole: bool) -> tuple:
        shape = "".join(self.shape)
        edits, cost = None, None
        if whole:
            edits, state, cost = traced(shape, EMPTY, FINAL)
            edits += ENDS[state]
        counts = (self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.n_turns)
        return (self.conv_id, task, number, whole, shape, *counts, self.turns, self.roles, self.texts, EMPTY if whole else None, edits, cost)


def chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Chunks of marked rows, those of whole conversations solved. Chunks of a conversation follow each other by (task, number)."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    fields = Chunk.FIELDS.format(conv=conv)
    names = [f.split()[0] for f in fields.split(", ")]
    keys = ["conv_id", "turn", "role"]
    # Bounds are drawn from the start of the text, so that one turn may fill several ranges and no long text is a bound.
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [kinds.get(f.split()[1]) for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, size = TaskContext.get().partitionId(), 0, [], 0
        chunk, cut = None, True  # cut: the chunk's conversation may go on ahead of it or behind it

        def packed() -> pa.RecordBatch:
            own = [conv_type, *types[1:]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), own)], names)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "blank", "broken", "seen")]
            for conv_id, turn, role, text, copies, blank, broken, seen in zip(*columns):
                for copy in range(copies):
                    if chunk is not None and chunk.conv_id != conv_id:
                        out.append(chunk.row(task, number, not cut))
                        size += chunk.size
                        chunk, cut, number = None, False, number + 1
                    elif chunk is not None and (len(chunk.shape) >= chunk_rows or chunk.size >= CHUNK_BYTES):
                        out.append(chunk.row(task, number, False))
                        size += chunk.size
                        chunk, cut, number = None, True, number + 1
                    if size >= CHUNK_BYTES or len(out) >= 4096:
                        yield packed()
                        out, size = [], 0
                    if chunk is None:
                        chunk = Chunk(conv_id)
                    chunk.add(turn, role, text, "blank" if blank else "duplicate" if seen or copy else "truncated" if broken else "")
        if chunk is not None:
            out.append(chunk.row(task, number, False))
        if out:
            yield packed()

    return written(dealt.mapInArrow(run, fields))


def solved(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks with the state they are entered in (entry), the initials of their edits and their cost."""
    chunks = chunked(marked(rows), chunk_rows)
    conv = chunks.schema["conv_id"].dataType.simpleString()
    parts = chunks.where("not whole")

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = [costs(s) for s in batch.column("shape").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(table, pa.list_(pa.int64()))], ["conv_id", "task", "number", "costs"])

    def folded(group: pa.Table) -> pa.Table:
        group = group.sort_by([("task", "ascending"), ("number", "ascending")])
        behind, out = FINAL, []
        for table in reversed(group.column("costs").to_pylist()):
            out.append(behind)
            behind = tuple(min(FAR, *(table[4 * q + e] + behind[e] for e in range(4))) for q in range(4))
        return group.select(["conv_id", "task", "number"]).append_column("exits", pa.array(out[::-1], pa.list_(pa.int64())))

    at = f"conv_id {conv}, task int, number int"
    table = parts.select("conv_id", "task", "number", "shape").mapInArrow(priced, at + ", costs array<long>")
    exits = written(table.groupBy("conv_id").applyInArrow(folded, at + ", exits array<long>")).drop("conv_id")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = []
            for shape, behind in zip(batch.column("shape").to_pylist(), batch.column("exits").to_pylist()):
                found = [traced(shape, q, tuple(behind)) for q in range(4)]
                routes.append([{"edits": e, "state": s, "cost": c - behind[s]} for e, s, c in found])
            kind = pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32()), ("cost", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(routes, kind)], ["conv_id", "task", "number", "routes"])

    shapes = parts.select("conv_id", "task", "number", "shape").join(exits, ["task", "number"])
    routes = written(shapes.select("conv_id", "task", "number", "shape", "exits").mapInArrow(routed, at + ", routes array<struct<edits:string,state:int,cost:long>>"))

    def followed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("task", "ascending"), ("number", "ascending")])
        state, entries = EMPTY, []
        for states in group.column("states").to_pylist():
            entries.append(state)
            state = states[state]
        ends = [""] * (len(entries) - 1) + [ENDS[state]]
        return group.select(["conv_id", "task", "number"]).append_column("into", pa.array(entries, pa.int32())).append_column("ends", pa.array(ends))

    states = routes.select("conv_id", "task", "number", F.transform("routes", lambda r: r["state"]).alias("states"))
    entries = written(states.groupBy("conv_id").applyInArrow(followed, at + ", into int, ends string")).drop("conv_id")
    route = F.get("routes", F.col("into"))
    chosen = routes.drop("conv_id").join(entries, ["task", "number"])
    chosen = chosen.select("task", "number", "into", F.concat(route["edits"], "ends").alias("found"), (route["cost"] + F.length("ends") * INSERT).alias("paid"))
    pieces = parts.join(chosen, ["task", "number"]).withColumns({"entry": F.col("into"), "edits": F.col("found"), "cost": F.col("paid")})
    return chunks.where("whole").unionByName(pieces.select(*chunks.columns))


def repaired(solution: DataFrame) -> DataFrame:
    """The repaired rows and those deleted: conv_id, task, number and place (their order), edit, turn (null where inserted), role, text."""
    conv = solution.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = {n: batch.column(n)[i].as_py() for n in ("conv_id", "task", "number", "entry", "edits", "turns", "roles", "texts")}
                rows = [(p, e, None if r is None else c["turns"][r], role, text) for p, (e, r, role, text) in enumerate(applied(c["edits"], c["entry"], c["roles"], c["texts"]))]
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    arrays = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)]
                    same = [pa.array([c["conv_id"]] * len(rows), batch.schema.field("conv_id").type), *(pa.array([c[n]] * len(rows), pa.int32()) for n in ("task", "number"))]
                    yield pa.RecordBatch.from_arrays([*same, *arrays], ["conv_id", "task", "number", "place", "edit", "turn", "role", "text"])

    return solution.mapInArrow(run, f"conv_id {conv}, task int, number int, place long, edit string, turn long, role string, text string")


class Report:
    """What is returned of one conversation, put together chunk by chunk."""

    FIELDS = "conv_id {conv}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"

    def __init__(self, conv_id):
        self.conv_id, self.sums, self.audit, self.sha, self.begun = conv_id, [0] * 5, [], hashlib.sha256(), False
        self.last = self.low = self.high = None
        self.n_turns = 0

    def add(self, c: dict) -> None:
        joint = self.last is not None and self.last + c["first"] not in ("su", "ua", "au")
        for i, n in enumerate((c["n_blank"], c["n_duplicate"], c["n_truncated"], c["n_illegal"] + joint, c["cost"])):
            self.sums[i] += n
        self.last = c["last"]
        if c["low"] is not None:
            self.n_turns += c["n_turns"] - (self.high == c["low"])
            self.low, self.high = c["low"] if self.low is None else self.low, c["high"]
        self.audit.append(c["edits"])
        for edit, _, role, text in applied(c["edits"], c["entry"], c["roles"], c["texts"]):
            if edit != "D":
                self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return (self.conv_id, gaps, *self.sums, "".join(self.audit), self.sha.hexdigest())


def report(solution: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation that has rows."""
    conv = solution.schema["conv_id"].dataType.simpleString()
    fields = Report.FIELDS.format(conv=conv)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_report, out, kind = None, [], None

        def packed() -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                c = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if open_report is None or open_report.conv_id != c["conv_id"]:
                    if open_report is not None:
                        out.append(open_report.row())
                    open_report = Report(c["conv_id"])
                open_report.add(c)
            if len(out) >= 4096:
                yield packed()
                out = []
        if open_report is not None:
            out.append(open_report.row())
        if out:
            yield packed()

    parts = solution.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "number")
    return solution.where("whole").mapInArrow(run, fields).unionByName(parts.mapInArrow(run, fields))


def digest(conversations: DataFrame) -> DataFrame:
    """The report of the damaged `conversations`, a row for every original conv_id."""
    conv = conversations.schema["conv_id"].dataType
    found = report(solved(damaged(conversations)))
    ids = conversations.select(F.col("conv_id").alias("original")).distinct()
    joined = ids.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    nothing = hashlib.sha256().hexdigest()
    return joined.select(F.col("original").cast(conv).alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
