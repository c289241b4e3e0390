"""Cheapest repair of conversations: a parallel Viterbi over chunks of rows whose cost vectors converge in rank."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edlens.llm import shared as S
from edlens.operators.ordered import MAX_GROUP_ROWS, in_order

#: Rows of a chunk; a conversation of any length is a chain of chunks.
CHUNK = 4096
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row. A user row follows any but a user row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a kept row of each initial may stand, and the state after it.
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after an inserted or reroled row: the one row that may come next.
NEXT = (USER, USER, ASSISTANT, USER)
#: Costs of ending in each state, the missing rows inserted.
END = (0, 2 * INSERT, INSERT, 0)
GONE = "x"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20; nulls read as one space, ``turn`` and ``conv_id`` stay null.

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it a user row. ``tie`` keeps the
    first role and text, by which rows of one turn are ordered, and the number of the copy.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("h"))
    rows = rows.where("h <> 0").withColumn("copy", F.explode(F.expr("if(h = 3, array(0, 1), array(0))")))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.col("role").alias("tie_role"), F.col("text").alias("tie_text"), F.col("copy").alias("tie_copy"))


def backward(codes: str, last: tuple) -> list[tuple]:
    """Cost vectors before each live row, from the vector ``last`` behind them: entry i holds, for each state, the cheapest way on.

    A code is the row's initial (``o``: none of s, u, a), in upper case for a truncated row.
    """
    vectors = [tuple(last)]
    for code in reversed(codes):
        after, initial = vectors[-1], code.lower()
        stay = TRUNCATED if code != initial else 0
        keeps = KEEPS.get(initial, {})
        now = [min(after[q] + DELETE, after[keeps[q]] + stay if q in keeps else after[q] + DELETE, after[NEXT[q]] + REROLE + stay) for q in STATES]
        now[USER] = min(now[USER], INSERT + now[ASSISTANT])
        for q in (START, SYSTEM, ASSISTANT):
            now[q] = min(now[q], INSERT + now[USER])
        vectors.append(tuple(now))
    return vectors[::-1]


def trace(codes: str, vectors: list[tuple], state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a chunk's rows from ``state`` on, and the state behind them; inserts come before a row."""
    out, i = [], 0
    for code in codes:
        if code == GONE:
            out.append("D")
            continue
        initial = code.lower()
        stay = TRUNCATED if code != initial else 0
        while True:
            here, after = vectors[i], vectors[i + 1]
            if here[state] == after[state] + DELETE:
                out.append("D")
                break
            if here[state] == here[NEXT[state]] + INSERT:
                out.append("I")
                state = NEXT[state]
                continue
            to = KEEPS.get(initial, {}).get(state)
            if to is not None and here[state] == after[to] + stay:
                out.append("K")
                state = to
            else:
                out.append("R")
                state = NEXT[state]
            break
        i += 1
    return "".join(out), state


def parallel(x: Column, y: Column) -> Column:
    """Two cost vectors differ by a constant."""
    lead = lambda v, q: F.get(v, F.lit(q)) - F.get(v, F.lit(START))
    return reduce(lambda a, b: a & b, (lead(x, q) == lead(y, q) for q in (SYSTEM, USER, ASSISTANT)))


def cost_vectors(links: DataFrame, chained: bool) -> DataFrame:
    """``used`` and ``out`` of each chunk with live rows: the vector behind it, right but for a constant, and the one before it.

    All chunks start from the same speculative vector, the right one for the last of a conversation. A pass hands
    each chunk the vector its successor found and runs it again where that is no constant away from the one it
    used; passes end when none is. A row usually forgets what stands far behind it, so a few passes do.
    """

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            out = [o if o is not None else list(backward(c.replace(GONE, ""), tuple(u))[0]) for c, u, o in zip(cols["codes"], cols["used"], cols["out"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], names=batch.schema.names)

    kind = "k string, chunk bigint, following bigint, first boolean, codes string, used array<bigint>, out array<bigint>"
    fresh = links.select("k", "chunk", "following", "first", "codes", F.array(*(F.lit(x).cast("bigint") for x in END)).alias("used"), F.lit(None).cast("array<bigint>").alias("out"))
    now = S.written(fresh.mapInArrow(swept, kind), "repair-vectors")
    while chained:
        behind = now.select(F.col("k").alias("k2"), F.col("chunk").alias("c2"), F.col("out").alias("given"))
        met = now.join(behind, (F.col("k") == F.col("k2")) & (F.col("following") == F.col("c2")), "left")
        stale = F.col("given").isNotNull() & ~parallel(F.col("given"), F.col("used"))
        if not met.where(stale).take(1):
            break
        again = met.select("k", "chunk", "following", "first", "codes", F.when(stale, F.col("given")).otherwise(F.col("used")).alias("used"), F.when(~stale, F.col("out")).alias("out"))
        now = S.written(again.mapInArrow(swept, kind), "repair-vectors")
    return now


def plans(chunks: DataFrame) -> DataFrame:
    """``k``, ``chunk``, ``ops`` (edits of the chunk's rows), ``cost`` (its share), from ``k``, ``chunk``, ``codes``."""
    live = F.col("codes").rlike(f"[^{GONE}]")
    dead = chunks.where(~live).select("k", "chunk", F.regexp_replace("codes", GONE, "D").alias("ops"), F.lit(0).cast("bigint").alias("cost"))
    order = Window.partitionBy("k").orderBy("chunk")
    links = S.written(chunks.where(live).select("k", "chunk", F.lead("chunk").over(order).alias("following"), F.lag("chunk").over(order).isNull().alias("first"), "codes"), "repair-links")
    chained = bool(links.where("following is not null").take(1))
    vectors = cost_vectors(links, chained)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ops, ends = [], []
            for codes, used, first in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                costs = backward(codes.replace(GONE, ""), tuple(used))
                found = [trace(codes, costs, q) for q in ((START,) if first else STATES)]
                ops.append([x[0] for x in found])
                ends.append([x[1] for x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(5), pa.array(ops, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], ["k", "chunk", "following", "ops", "ends"])

    paths = vectors.select("k", "chunk", "codes", "used", "first", "following").mapInArrow(traced, "k string, chunk bigint, following bigint, ops array<string>, ends array<int>")
    share = F.when(F.col("first"), F.get("out", F.lit(0))).otherwise(F.lit(0))
    if not chained:
        costs = vectors.select("k", F.col("chunk").alias("c"), share.alias("cost"))
        done = paths.withColumnRenamed("k", "k1").join(costs, (F.col("k1") == F.col("k")) & (F.col("chunk") == F.col("c"))).select("k", "chunk", F.get("ops", F.lit(0)).alias("ops"), "cost")
        return done.union(dead)
    # Start states: each chunk hands its end for the state it was told; told anew until all agree.
    paths = S.written(paths, "repair-paths")
    starts = S.written(paths.select("k", "chunk", "following", "ends", F.lit(0).alias("state")), "repair-starts")
    while True:
        told = starts.where("following is not null").select(F.col("k").alias("k2"), F.col("following").alias("c2"), F.get("ends", F.col("state")).alias("told"))
        met = starts.join(told, (F.col("k") == F.col("k2")) & (F.col("chunk") == F.col("c2")), "left")
        if not met.where("told <> state").take(1):
            break
        starts = S.written(met.select("k", "chunk", "following", "ends", F.coalesce("told", "state").alias("state")), "repair-starts")
    behind = vectors.select(F.col("k").alias("k2"), F.col("chunk").alias("c2"), F.get("out", F.lit(0)).alias("given"))
    # The constant by which the vector a chunk used lies off the stitched one.
    costs = vectors.join(behind, (F.col("k") == F.col("k2")) & (F.col("following") == F.col("c2")), "left")
    costs = costs.select(F.col("k").alias("k3"), F.col("chunk").alias("c3"), (share + F.coalesce(F.col("given") - F.get("used", F.lit(0)), F.lit(0))).alias("cost"))
    states = starts.select(F.col("k").alias("k4"), F.col("chunk").alias("c4"), "state")
    done = paths.join(states, (F.col("k") == F.col("k4")) & (F.col("chunk") == F.col("c4"))).join(costs, (F.col("k") == F.col("k3")) & (F.col("chunk") == F.col("c3")))
    return done.select("k", "chunk", F.get("ops", F.col("state")).alias("ops"), "cost").union(dead)


def faulty_rows(rows: DataFrame, tie: list[str], max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rows with ``k`` (conversation), ``pos``, ``chunk``, ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated), ``illegal``, ``code``."""
    own = rows.select(F.concat(F.lit("="), F.col("conv_id").cast("string")).alias("k"), "conv_id", "turn", "role", "text", *tie)
    bare = F.btrim("text", F.lit(S.SPACE_CHARS))
    own = own.select(F.coalesce("k", F.lit("")).alias("k"), "conv_id", "turn", "role", "text", *tie, F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256).alias("digest"),
                     (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.substring("role", 1, 1).alias("initial"), F.monotonically_increasing_id().alias("rid"))
    own = S.written(own, "repair-rows")
    order = ["turn", *tie, "rid"]
    placed = in_order(own, ["k"], order, position="pos", previous={"before": "initial"}, max_group_rows=max_group_rows)
    placed = S.written(placed.drop(*tie, "rid"), "repair-placed")
    seen = placed.groupBy("k", "digest").agg(F.min("pos").alias("at"), F.count("*").alias("c")).where("c > 1").select(F.col("k").alias("k2"), F.col("digest").alias("d2"), "at")
    seen = S.written(seen, "repair-seen")
    met = placed.join(seen, (F.col("k") == F.col("k2")) & (F.col("digest") == F.col("d2")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("at"), 2).when(F.col("cut"), 3).otherwise(0)
    illegal = F.coalesce((~F.concat("before", "initial").isin("su", "ua", "au")).cast("int"), F.lit(0))
    code = F.when(F.col("fault").isin(1, 2), GONE).otherwise(F.expr("if(fault = 3, upper(letter), letter)"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    found = met.select("k", "conv_id", "turn", "role", "text", "pos", F.expr(f"(pos - 1) div {CHUNK}").alias("chunk"), fault.alias("fault"), illegal.alias("illegal"), letter.alias("letter"))
    return S.written(found.withColumn("code", code).drop("letter"), "repair-faults")


def streamed(rows: DataFrame, all_ids: DataFrame, max_group_rows: int, tie: list[str]) -> DataFrame:
    """Per conversation, in sorted partitions: one row that names it, then for each chunk its plan and its rows in order."""
    found = faulty_rows(rows, tie, max_group_rows)
    codes = found.groupBy("k", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    plan = plans(S.written(codes.select("k", "chunk", F.array_join(F.col("c.code"), "").alias("codes")), "repair-chunks"))
    ids = all_ids.select("conv_id").union(rows.select("conv_id")).select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("k"), "conv_id").distinct()
    nothing = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    text, number = (lambda n: F.lit(None).cast("string").alias(n)), (lambda n, x=0: F.lit(x).cast("bigint").alias(n))
    heads = ids.select("k", number("chunk", -1), number("pos"), "conv_id", nothing("turn"), text("role"), text("text"), number("fault"), number("illegal"), text("ops"), number("cost"))
    orders = plan.select("k", "chunk", number("pos"), nothing("conv_id"), nothing("turn"), text("role"), text("text"), number("fault"), number("illegal"), "ops", "cost")
    lines = found.select("k", "chunk", "pos", nothing("conv_id"), "turn", "role", "text", F.col("fault").cast("bigint").alias("fault"), F.col("illegal").cast("bigint").alias("illegal"), text("ops"), number("cost"))
    return heads.union(orders).union(lines).repartition(S.wide(rows), "k").sortWithinPartitions("k", "chunk", "pos")


class Reader:
    """Walks one conversation's rows, applies the edits of its plan and sums up what it sees."""

    def __init__(self, conv):
        self.conv, self.state, self.ops, self.audit, self.cost = conv, START, iter(""), [], 0
        self.faults, self.illegal, self.turns, self.low, self.high, self.last = [0] * 4, 0, 0, None, None, None

    def plan(self, ops: str, cost: int) -> None:
        self.ops = iter(ops)
        self.cost += cost
        self.audit.append(ops)

    def added(self) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        return "I", "user" if self.state == USER else "assistant", ""

    def row(self, turn, role: str, text: str, fault: int, illegal: int) -> Iterator[tuple[str, str, str]]:
        """The edits (letter, role, text) up to and with this row; a deleted row gives none."""
        self.faults[fault] += 1
        self.illegal += illegal
        self.cost += DELETE if fault in (1, 2) else 0
        if turn is not None:
            self.turns += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        for op in self.ops:
            if op == "I":
                yield self.added()
                continue
            if op == "K":
                self.state = KEEPS[role[0]][self.state]
                yield op, role, text
            elif op == "R":
                yield op, self.added()[1], text
            return

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (SYSTEM, USER):
            self.audit.append("I")
            # A plan's cost holds the inserts that its last state needs; without live rows there are none.
            yield self.added()


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Reader, Iterator[tuple[str, str, str]], bool]]:
    """(conversation, its next edits, whether they are its last) along a sorted partition; edits must be used up in order."""
    reader = None
    for batch in batches:
        for chunk, pos, conv, turn, role, text, fault, illegal, ops, cost in zip(*(batch.column(i).to_pylist() for i in range(1, 11))):
            if chunk < 0:
                if reader:
                    yield reader, reader.end(), True
                reader = Reader(conv)
            elif ops is not None:
                reader.plan(ops, cost)
            else:
                yield reader, reader.row(turn, role, text, fault, illegal), False
    if reader:
        yield reader, reader.end(), True


def arranged(conversations: DataFrame, tie: list[str]) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", space("role"), space("text"), *tie)


def repair(rows: DataFrame, all_ids: DataFrame | None = None, tie: tuple[str, ...] = (), max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row per conversation: what is wrong with it, and its cheapest repair.

    Rows are taken by ``turn`` (nulls first), then ``tie`` or else role and text. A row's fault is the first of blank (no
    character but white space), duplicate (role and text stood earlier), truncated (last such character is none of
    ``.!?``). Edits keep a row (0), give it the role user or assistant (3), delete it (4, a must for blank and duplicate
    ones) or insert an empty row (3); a truncated row that stays costs 3. The roles' initials must then read
    ``(s?(ua)+)?``. ``audit`` lists the edits' initials of the cheapest repair, the ASCII-least of several.

    Positions and duplicates come from Spark; each chunk of rows is a word of codes. Chunks run backwards from
    speculative cost vectors at once, passes mend them until they differ from the right ones by constants, and the
    stitched vectors lead the trace. No step holds more than a chunk, but for the audit, which is one value; a
    conversation's digest is a sequential hash, so its rows stream through one task.

    Null role and text read as one space: such a text is blank, such a role can't be kept, nor can an empty one. A null
    ``conv_id`` is a conversation of its own. Repeated rows are duplicates. ``all_ids`` names conversations to list
    even without rows: zeros, empty audit, digest of the empty text. ``gaps``: max - min + 1 - different
    turns, 0 without turns. Empty table: no rows. Rows are equal when the SHA-256 of role and text is.
    """
    tie = list(tie)
    own = arranged(rows, tie) if tie else arranged(rows, tie).select("*", F.col("role").alias("tie_role"), F.col("text").alias("tie_text"))
    sorted_rows = streamed(own, rows if all_ids is None else all_ids, max_group_rows, tie or ["tie_role", "tie_text"])
    id_type = rows.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, first = [], hashlib.sha256(), True
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        flush = lambda: pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], kinds[i]) for i, n in enumerate(names)})
        kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]

        def stream():
            for batch in batches:
                kinds[0] = batch.schema.field(3).type
                yield batch

        for reader, edits, last in read(stream()):
            for _, role, text in edits:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if last:
                gaps = int(reader.high - reader.low + 1 - reader.turns) if reader.turns else 0
                out.append((reader.conv, gaps, *reader.faults[1:], reader.illegal, reader.cost, "".join(reader.audit), digest.hexdigest()))
                digest, first = hashlib.sha256(), True
                if len(out) >= 4096:
                    yield flush()
                    out = []
        if out:
            yield flush()

    return sorted_rows.mapInArrow(summed, schema)


def repaired_rows(rows: DataFrame, tie: tuple[str, ...] = (), max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id``, ``place`` (from 0), ``role``, ``text``, ``edit`` (I, K or R); rules as in ``repair``."""
    tie = list(tie)
    own = arranged(rows, tie) if tie else arranged(rows, tie).select("*", F.col("role").alias("tie_role"), F.col("text").alias("tie_text"))
    sorted_rows = streamed(own, rows, max_group_rows, tie or ["tie_role", "tie_text"])
    id_type = rows.schema["conv_id"].dataType

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [None]

        def stream():
            for batch in batches:
                kind[0] = batch.schema.field(3).type
                yield batch

        out, place = [], 0
        flush = lambda: pa.RecordBatch.from_pydict({"conv_id": pa.array([x[0] for x in out], kind[0]), "place": pa.array([x[1] for x in out], pa.int64()), **{n: pa.array([x[i] for x in out], pa.string()) for i, n in ((2, "role"), (3, "text"), (4, "edit"))}})
        for reader, edits, last in read(stream()):
            for edit, role, text in edits:
                out.append((reader.conv, place, role, text, edit))
                place += 1
            place = 0 if last else place
            if len(out) >= 4096:
                yield flush()
                out = []
        if out:
            yield flush()

    return sorted_rows.mapInArrow(listed, f"conv_id {id_type.simpleString()}, place bigint, role string, text string, edit string")
