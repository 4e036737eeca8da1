"""Repair of the turn structure of conversations.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: maybe a
system turn, then user and assistant in turn. Turns that are blank or repeat an
earlier one must go. The edits are: delete a turn (D), insert an empty one (I),
keep one (K), give one another role (R). Each has a cost.

A cost-to-go is worked out backwards for every turn and each of the four states
of the grammar; then a walk from the start takes at each step the ASCII-least
edit among those that are tight, that is, whose cost and the cost-to-go behind
it make up the cost-to-go here. The next letter follows from the state, so an
audit string stands for one repair only.

Conversations up to a number of turns and bytes are each edited in one task.
Longer ones are cut into blocks: costs compose as products of 4 by 4 matrices
over (min, +), so each block gives its matrix, the cost-to-go at the ends of
blocks is folded from those, every block is then walked from each of the four
states, and the states in which blocks are entered are folded in turn. So no
task edits a long conversation as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialise, partitions, tidied

FAULTS = ("clean", "truncated", "blank", "duplicate")
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
#: States of the grammar: nothing yet, after s, after u, after a; the state and letter that follow; where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT, LETTER, FINAL = (USER, USER, ASSISTANT, USER), ("u", "u", "a", "u"), (START, ASSISTANT)
INITIALS = ("", "s", "u", "a")
FAR = 1 << 60


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


# --- one conversation ---------------------------------------------------------------------------


def after_inserts(v: list[int], c: Costs) -> list[int]:
    """Costs-to-go if turns may be inserted first; two steps lead round the cycle of user and assistant."""
    for _ in range(3):
        v = [min(x, c.insert + v[NEXT[q]]) for q, x in enumerate(v)]
    return v


def taken(initial: int, q: int) -> int | None:
    """The state after a kept turn, if the grammar allows it."""
    if INITIALS[initial] == LETTER[q]:
        return NEXT[q]
    return SYSTEM if q == START and initial == SYSTEM else None


def at_end(c: Costs) -> list[int]:
    return after_inserts([0 if q in FINAL else FAR for q in range(4)], c)


def backward(turns: list[tuple[int, int]], end: list[int], c: Costs) -> list[list[int]]:
    """Costs-to-go before each turn (initial, fault) and, last, ``end``."""
    out = [end]
    for initial, fault in reversed(turns):
        v, here = out[-1], []
        for q in range(4):
            best = c.delete + v[q]
            if fault <= TRUNCATED:
                more = c.truncated if fault == TRUNCATED else 0
                best = min(best, c.rerole + more + v[NEXT[q]])
                if (to := taken(initial, q)) is not None:
                    best = min(best, more + v[to])
            here.append(min(best, FAR))
        out.append(after_inserts(here, c))
    return out[::-1]


def forward(turns: list[tuple[int, int]], v: list[list[int]], q: int, c: Costs, last: bool) -> tuple[list[list[str]], int]:
    """The edits at each turn, inserted turns before it (after the last one, if this is the ``last`` block, behind it too), and the state at the end.

    Inserted turns and new roles have their letter behind the edit's initial.
    """
    out = []
    for i, (initial, fault) in enumerate(turns):
        edits, to = [], v[i + 1]
        more = c.truncated if fault == TRUNCATED else 0
        while True:
            here, kept = v[i][q], taken(initial, q)
            if c.delete + to[q] == here:
                edits.append("D")
            elif c.insert + v[i][NEXT[q]] == here:
                edits.append("I" + LETTER[q])
                q = NEXT[q]
                continue
            elif kept is not None and fault <= TRUNCATED and more + to[kept] == here:
                edits.append("K")
                q = kept
            else:
                edits.append("R" + LETTER[q])
                q = NEXT[q]
            break
        out.append(edits)
    while last and out and v[-1][q]:
        out[-1].append("I" + LETTER[q])
        q = NEXT[q]
    return out, q


def plan(turns: list[tuple[int, int]], c: Costs) -> list[list[str]]:
    return forward(turns, backward(turns, at_end(c), c), START, c, True)[0]


def illegal(before: int | None, initial: int) -> bool:
    """Whether no conversation may have these two roles one after the other."""
    return before is not None and (before, initial) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


# --- tables ---------------------------------------------------------------------------------------


def seen(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text`` with ``initial``, ``fault`` (as far as a turn alone shows it) and ``said``, a digest of role and text."""
    r, t = (F.coalesce(turns[f"`{x}`"].cast("string"), F.lit(" ")) for x in (role, text))
    rows = turns.select(turns[f"`{conv}`"].alias("conv"), turns[f"`{turn}`"].cast("long").alias("turn"), r.alias("role"), t.alias("text"))
    first, initial = F.substring("role", 1, 1), F.lit(0)
    for i, x in enumerate(INITIALS[1:], 1):
        initial = F.when(first == x, i).otherwise(initial)
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv", "turn", "role", "text", initial.cast("int").alias("initial"), fault.cast("int").alias("fault"), said.alias("said"))


def by_conversation(batches: Iterator[pa.RecordBatch], column: str = "conv") -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups of rows that lie together, with where each group starts and ends."""
    held: pa.Table | None = None
    for b in batches:
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new])
        at = _edges(held.column(column).to_pylist())
        if len(at) > 2:
            yield held.slice(0, at[-2]), list(zip(at[:-2], at[1:-1], strict=True))
            held = held.slice(at[-2])
    if held is not None and held.num_rows:
        yield held, [(0, held.num_rows)]


def _edges(keys: list) -> list[int]:
    return [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else [0]


def with_columns(table: pa.Table, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    for name, values in columns.items():
        at = table.schema.get_field_index(name)
        table = table.append_column(name, values) if at < 0 else table.set_column(at, name, values)
    yield from table.combine_chunks().to_batches()


def short(rows: DataFrame, c: Costs) -> DataFrame:
    """``conv, turn, role, text, initial, fault, illegal, edits``; rows of a conversation lie together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in by_conversation(batches):
            initials, faults, said = (table.column(x).to_pylist() for x in ("initial", "fault", "said"))
            edits, odd = [], []
            for lo, hi in groups:
                known: set[bytes] = set()
                for i in range(lo, hi):
                    if said[i] in known and faults[i] != BLANK:
                        faults[i] = DUPLICATE
                    known.add(said[i])
                edits += plan(list(zip(initials[lo:hi], faults[lo:hi], strict=True)), c)
                odd += [illegal(initials[i - 1] if i > lo else None, initials[i]) for i in range(lo, hi)]
            yield from with_columns(table.drop_columns(["said"]), fault=pa.array(faults, pa.int32()), illegal=pa.array(odd, pa.bool_()), edits=pa.array(edits, pa.list_(pa.string())))

    kind = dict(rows.dtypes)["conv"]
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(tidied(run), f"conv {kind}, turn long, role string, text string, initial int, fault int, illegal boolean, edits array<string>")


def mapped(df: DataFrame, by: list[str], order: list[Column | str], schema: str, each: Callable[[tuple, pa.Table], Iterator[tuple]], names: list[str]) -> DataFrame:
    """Rows that ``each`` makes of every group of ``df``, which meets in one task, in ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target: pa.Schema | None = None
        for table, groups in by_conversation(batches, "__group"):
            out: list[tuple] = []
            for lo, hi in groups:
                part = table.slice(lo, hi - lo)
                out += each(tuple(part.column(x)[0].as_py() for x in by), part)
            if target is None:
                target = pa.schema([pa.field(n, table.schema.field(n).type if n in by else types[n]) for n in names])
            yield from pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target).to_batches()

    types = {"edits": pa.list_(pa.list_(pa.string())), "illegal": pa.bool_(), "pos": pa.int64(), "block": pa.int64(), "entry": pa.int32(), "before": pa.int32(), "costs": pa.list_(pa.int64()), "exits": pa.list_(pa.int32()), "tail": pa.int32()}
    keyed = df.withColumn("__group", F.struct(*by)).repartition(*by).sortWithinPartitions(*by, *order)
    return keyed.mapInArrow(tidied(run), schema)


def long(rows: DataFrame, c: Costs, block: int) -> DataFrame:
    """As :func:`short`, for conversations that are cut into blocks of about ``block`` turns; with ``pos``, the order of turns."""
    kind = dict(rows.dtypes)["conv"]
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "long-turns")
    n = max(partitions(rows.sparkSession), -(-rows.count() // block))
    # Ranges end anywhere, also among equal turns; a number in a sorted partition gives the order over all of them.
    ordered = rows.repartitionByRange(n, "conv", "turn", "role", "text", "row").sortWithinPartitions("conv", "turn", "role", "text", "row")
    ordered = materialise(ordered.withColumn("pos", F.monotonically_increasing_id()).drop("row"), "ordered-turns")
    first = ordered.groupBy("conv", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    light = ordered.select("conv", F.shiftright("pos", 33).alias("block"), "pos", "initial", "fault").join(first, "pos", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    light = materialise(light.select("conv", "block", "pos", "initial", fault.cast("int").alias("fault")), "faults")

    def turns(t: pa.Table) -> list[tuple[int, int]]:
        return list(zip(t.column("initial").to_pylist(), t.column("fault").to_pylist(), strict=True))

    def matrix(key: tuple, t: pa.Table) -> Iterator[tuple]:
        x = turns(t)
        columns = [backward(x, [0 if q == end else FAR for q in range(4)], c)[0] for end in range(4)]
        yield (*key, [columns[end][q] for q in range(4) for end in range(4)], x[-1][0])

    def ends(key: tuple, t: pa.Table) -> Iterator[tuple]:
        v, last = at_end(c), True
        for b, m in zip(t.column("block").to_pylist(), t.column("costs").to_pylist(), strict=True):
            yield (*key, b, [*v, int(last)])
            v, last = [min(min(m[4 * q + e] + v[e] for e in range(4)), FAR) for q in range(4)], False

    def walks(key: tuple, t: pa.Table) -> Iterator[tuple]:
        x, (*end, last) = turns(t), t.column("costs")[0].as_py()
        v = backward(x, end, c)
        ways = [forward(x, v, q, c, bool(last)) if v[0][q] < FAR else ([[] for _ in x], q) for q in range(4)]
        for i, pos in enumerate(t.column("pos").to_pylist()):
            yield (*key, pos, [w[0][i] for w in ways], illegal(x[i - 1][0], x[i][0]) if i else None, [w[1] for w in ways])

    def entries(key: tuple, t: pa.Table) -> Iterator[tuple]:
        q, before = START, None
        for b, exits, tail in zip(t.column("block").to_pylist(), t.column("exits").to_pylist(), t.column("tail").to_pylist(), strict=True):
            yield (*key, b, q, before)
            q, before = exits[q], tail

    pair = f"conv {kind}, block long"
    costs = materialise(mapped(light, ["conv", "block"], ["pos"], f"{pair}, costs array<long>, tail int", matrix, ["conv", "block", "costs", "tail"]), "block-costs")
    end = mapped(costs, ["conv"], [F.col("block").desc()], f"{pair}, costs array<long>", ends, ["conv", "block", "costs"])
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["block"] == b["block"])
    walked = light.join(end, same(light, end)).select(light["conv"], light["block"], "pos", "initial", "fault", "costs")
    walked = materialise(mapped(walked, ["conv", "block"], ["pos"], f"{pair}, pos long, edits array<array<string>>, illegal boolean, exits array<int>", walks, ["conv", "block", "pos", "edits", "illegal", "exits"]), "walks")
    exits = walked.groupBy("conv", "block").agg(F.min("exits").alias("exits"))
    exits = exits.join(costs, same(exits, costs)).select(exits["conv"], exits["block"], "exits", "tail")
    entry = mapped(exits, ["conv"], ["block"], f"{pair}, entry int, before int", entries, ["conv", "block", "entry", "before"])
    chosen = walked.join(entry, same(walked, entry)).select("pos", F.get("edits", F.col("entry")).alias("edits"), "illegal", "before")
    chosen = chosen.join(light.select("pos", "fault", F.col("initial").alias("own")), "pos")
    fits = F.lit(False)
    for a, b in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
        fits = fits | ((F.col("before") == a) & (F.col("own") == b))
    odd = F.coalesce("illegal", F.col("before").isNotNull() & ~fits)
    out = ordered.drop("fault", "said").join(chosen.select("pos", "fault", odd.alias("illegal"), "edits"), "pos")
    return out.select("conv", "turn", "role", "text", "initial", "fault", "illegal", "edits", "pos")


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    costs: Costs = Costs(), most_turns: int = 50_000, most_bytes: int = 64 << 20, block: int = 65_536,  # noqa: B008
) -> DataFrame:
    """One row per edit: ``conv_id, turn, edit, fault, illegal, role, text, cost``.

    Rows of a conversation go by turn (nulls first; ties by role, then text), and
    lie together and in order as long as the result isn't dealt anew. Null
    roles and texts count as one space. ``fault`` is the first of blank (no
    character but ASCII white space), duplicate (role and text seen earlier in
    the conversation) and truncated (the last such character is none of .!?),
    else clean; null for inserted rows. ``illegal`` says that the roles of this
    row and the one before it, as they came, can't follow each other. ``role``
    and ``text`` are those after the edit, null for deleted rows. Null
    ``conv_id``s are one conversation. Columns besides these four are not read;
    an empty table gives no rows. Turns must be integers. A conversation above
    ``most_turns`` or ``most_bytes`` is cut into blocks.
    """
    rows = seen(turns, conv, turn, role, text)
    size = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    many = size.where((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select(F.col("conv").alias("c"))
    if many.limit(1).isEmpty():
        done = short(rows, costs)
    else:
        many = materialise(many, "long-conversations")
        same = F.col("conv").eqNullSafe(F.col("c"))
        whole = long(rows.join(many, same, "left_semi"), costs, block)
        done = short(rows.join(many, same, "left_anti"), costs).unionByName(whole.repartition("conv").sortWithinPartitions("conv", "pos").drop("pos"))
    step = done.select("*", F.explode("edits").alias("e")).drop("edits")
    letter = F.substring("e", 2, 1)
    own = F.substring("e", 1, 1) != "I"
    new = F.when(letter == "u", "user").when(letter == "a", "assistant")
    edit, gone = F.substring("e", 1, 1), F.col("e") == "D"
    cost = F.when(edit == "D", costs.delete).when(edit == "I", costs.insert).when(edit == "R", costs.rerole).otherwise(0)
    cost = cost + F.when((F.col("fault") == TRUNCATED) & own & ~gone, costs.truncated).otherwise(0)
    return step.select(
        F.col("conv").alias("conv_id"), F.when(own, F.col("turn")).alias("turn"), edit.alias("edit"),
        F.when(own, F.get(F.array(*[F.lit(x) for x in FAULTS]), F.col("fault"))).alias("fault"), F.when(own, F.col("illegal")).alias("illegal"),
        F.when(~gone, F.coalesce(new, F.col("role"))).alias("role"), F.when(~gone, F.when(own, F.col("text")).otherwise("")).alias("text"), cost.cast("long").alias("cost"),
    )


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`'s result, whose rows still lie together and in order.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``: missing turn numbers, rows of each fault, illegal
    neighbours, the cost of all edits, their initials, and the digest of the
    repaired ``role:text``, joined by newlines. Rows stream through; what is
    held of a conversation is its audit string.
    """
    kind = dict(edits.dtypes)["conv_id"]
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out, key_type = None, [], pa.int64()
        for b in batches:
            key_type = b.schema.field("conv_id").type
            for conv, turn, edit, fault, odd, role, text, cost in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "fault", "illegal", "role", "text", "cost")), strict=True):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        out.append(open_.row())
                    open_ = _Open(conv)
                open_.add(turn, edit, fault, odd, role, text, cost)
            yield table_of(out, key_type)
            out = []
        if open_ is not None:
            yield table_of([open_.row()], key_type)

    def table_of(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, *[pa.int64()] * len(counts), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", *counts, "audit", "repaired_sha256"])

    return edits.mapInArrow(tidied(run), f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


class _Open:
    """A conversation of which rows are still coming."""

    def __init__(self, conv: object) -> None:
        self.conv, self.audit, self.sha, self.some = conv, bytearray(), hashlib.sha256(), False
        self.faults, self.odd, self.cost = dict.fromkeys(FAULTS, 0), 0, 0
        self.least: int | None = None
        self.last: int | None = None
        self.turns = 0

    def add(self, turn: int | None, edit: str, fault: str | None, odd: bool | None, role: str | None, text: str | None, cost: int) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if fault is not None:
            self.faults[fault] += 1
            self.odd += bool(odd)
            if turn is not None and turn != self.last:
                self.least = turn if self.least is None else self.least
                self.last, self.turns = turn, self.turns + 1
        if role is not None:
            self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.some = True

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return (self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.odd, self.cost, self.audit.decode(), self.sha.hexdigest())


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says."""
    return df.withColumn("__n", F.explode(F.array_repeat(F.lit(0), times))).drop("__n")


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with known faults, for tests: by the checksum of ``conv_id:turn`` modulo 20 a row goes (0), loses its text (1) or its ends
    of sentences (2), comes twice (3), or is the user's (4). Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("__code")).where("__code <> 0")
    text = F.when(F.col("__code") == 1, "").when(F.col("__code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__code") == 4, "user").otherwise(F.col("role"))
    return repeated(rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "__code"), F.when(F.col("__code") == 3, 2).otherwise(1)).drop("__code")


def report(originals: DataFrame, edits: DataFrame) -> DataFrame:
    """:func:`digest` with a row for every ``conv_id`` of ``originals``; one of which no row is left has zeros."""
    ids = originals.select(F.col("conv_id").alias("__id")).distinct()
    got = digest(edits)
    joined = ids.join(got, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("__id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
