"""Conversation structure repair by a retained-subsequence dynamic program.

A repaired conversation has the roles ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn. What is kept
or given another role is a subsequence of the turns; between two retained turns all others are deleted, and the roles of
the two say what has to be inserted. So the cheapest way to end in a retained turn needs, for each role that the retained
turn before it can have, the smallest price so far less the deletions up to there (their prefix sum): a running minimum.
Of equally cheap ways the one with the ASCII-least audit (initials of its edits) stays. Ways to different roles have
different audits, none of which starts another, so it is enough to carry the order of these four audits along; a way
dearer than another by more than ``LEAD`` can't win any more and is dropped. What is left takes few values, so a turn's
step is looked up (``_step``).

The program reads no texts, only a role's initial and a fault for each turn, in order, and keeps nine bytes a turn until
the conversation ends; ``repaired`` joins the texts to the edits by conversation and place. One conversation's
turns pass through one task, in narrow rows and bounded memory, as its order asks for; texts are not gathered.

Defined cases: null roles and texts are one space (a blank turn of a role that cannot stay); turns of one number are in
order of role, then text, and repeated rows stay, the later ones as duplicates; null turn numbers come first; rows with a
null conv_id form one conversation; texts are taken whole; an empty table gives no rows; other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.stage import texts

BLANKS = " \t\n\x0b\x0c\r"
#: Prices of edits; a retained turn with a truncated text costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The role before: none, system, user, assistant.
STATES = NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Turns to insert between two retained ones, by their roles, and behind the last.
BETWEEN = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
BEHIND = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: From the cheapest state all that another can do costs at most so much more: a deleted system turn and an insertion.
LEAD = DELETE + INSERT
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
EDIT = "conv_id long, step long, edit string, pos long, role string, cost long"
#: Rows of a batch that leaves Python.
ROWS = 10_000


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn, role, text, fault (null, blank, duplicate or truncated: the first that holds), illegal
    (its role cannot follow the one before), fresh (the first with its turn number). One shuffle, by conversation."""
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    both = F.concat(F.left(F.lag("role").over(order), F.lit(1)), F.left("role", F.lit(1)))
    t = t.select("*", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.coalesce(~both.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("fresh"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    t = t.withColumn("again", again)  # partitioned by conversation already
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(shown == "", "blank").when(F.col("again"), "duplicate").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    return t.select("conv_id", "pos", "turn", "role", "text", fault.alias("fault"), "illegal", "fresh")


def summary(faulty: DataFrame) -> DataFrame:
    """conv_id, gaps (turn numbers that are missing within its range), and how many turns have each fault."""
    n = lambda c: F.count_if(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - n(F.col("fresh")), F.lit(0))
    return faulty.groupBy("conv_id").agg(gaps.alias("gaps"), *[n(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")], n(F.col("illegal")).alias("illegal"))


@lru_cache(maxsize=1 << 16)
def _step(best: tuple, order: tuple, initial: int, fault: str | None) -> tuple:
    """One more turn. best: for each state its price less the deletions so far, from 0 (none: there is no way); order: the
    places of their audits. Gives these anew, what was taken from all prices, and how each state was reached."""
    found = {p: (best[p], order[p], "D", p) for p in STATES if best[p] is not None}  # the turn deleted: its prefix sum grows with it
    if fault not in ("blank", "duplicate"):
        for (p, r), gap in BETWEEN.items():
            if best[p] is None:
                continue
            ways = ([("K", 0)] if initial == r else []) + ([("R", REROLE)] if r in NAMES else [])
            for edit, price in ways:
                way = (best[p] + gap * INSERT + price + (TRUNCATED if fault == "truncated" else 0) - DELETE, order[p], "I" * gap + edit, p)
                if r not in found or way < found[r]:
                    found[r] = way
    least = min(w[0] for w in found.values())
    found = {r: w for r, w in found.items() if w[0] <= least + LEAD}
    place = {r: k for k, r in enumerate(sorted(found, key=lambda r: found[r][1:3]))}
    return (
        tuple(found[r][0] - least if r in found else None for r in STATES),
        tuple(place.get(r) for r in STATES),
        least,
        tuple((found[r][3], found[r][2]) if r in found else None for r in STATES),
    )


class Conversation:
    """The program over one conversation's turns."""

    def __init__(self):
        self.best, self.order, self.price, self.n = (0, None, None, None), (0, None, None, None), 0, 0
        self.back: list[tuple] = []  # shared tuples: one reference a turn
        self.truncated = bytearray()

    def add(self, initial: int, fault: str | None) -> None:
        self.best, self.order, taken, how = _step(self.best, self.order, initial, fault)
        self.price += taken
        self.n += 1
        self.back.append(how)
        self.truncated.append(fault == "truncated")

    def price_and_end(self) -> tuple[int, int]:
        """The price of the cheapest edits, and the role of the last turn that they retain."""
        price, _, p = min((self.best[p] + BEHIND[p] * INSERT, self.order[p], p) for p in STATES if self.best[p] is not None)
        return self.price + price + DELETE * self.n, p

    def backwards(self) -> Iterator[tuple]:
        """(edit, pos, role, price) from the last edit to the first: no pos for what is inserted, a role only where it's given."""
        p = self.price_and_end()[1]
        yield from (("I", None, NAMES[r], INSERT) for r in (ASSISTANT, USER)[: BEHIND[p]])
        for pos in range(self.n - 1, -1, -1):
            before, tail = self.back[pos][p]
            if tail == "D":
                yield "D", pos, None, DELETE
            else:
                given = tail[-1] == "R"
                yield tail[-1], pos, NAMES[p] if given else None, (REROLE if given else 0) + (TRUNCATED if self.truncated[pos] else 0)
                if tail[0] == "I":
                    yield "I", None, NAMES[USER if p == ASSISTANT else ASSISTANT], INSERT
            p = before

    def edits(self) -> tuple[int, list[tuple]]:
        return self.price_and_end()[0], list(self.backwards())[::-1]


def _sorted(rows: DataFrame, place: str) -> DataFrame:
    return texts(rows.repartition("conv_id").sortWithinPartitions("conv_id", place))


def edits(faulty: DataFrame) -> DataFrame:
    """conv_id, step (from 0), edit (K, R, D or I), pos (of the turn that it is about; null for I), role (that a turn is
    given or that is inserted; null for K and D), cost (of this edit). Reads no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, rows = None, None, []

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            last = sum(1 for _ in now.backwards()) - 1
            for k, e in enumerate(now.backwards()):
                rows.append((own, last - k, *e))
                if len(rows) == ROWS:
                    yield batch(rows)
                    rows = []

        for b in batches:
            for conv, initial, fault in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                if now is None or conv != own:
                    if now is not None:
                        yield from ended()
                    now, own = Conversation(), conv
                now.add(INITIALS.get(initial, NONE), fault)
        if now is not None:
            yield from ended()
        if rows:
            yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "step", "edit", "pos", "role", "cost"])

    narrow = _sorted(faulty.select("conv_id", "pos", F.left("role", F.lit(1)).alias("initial"), "fault"), "pos")
    return narrow.select("conv_id", "initial", "fault").mapInArrow(run, EDIT)


def applied(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, step, edit, role, text, cost: the edits with the turns they leave; role and text are null where deleted."""
    t = faulty.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), F.col("role").alias("_role"), "text")
    d = found.join(t, F.expr("conv_id <=> _conv AND pos = _pos AND edit <> 'D'"), "left")
    left = lambda c: F.when(F.col("edit") != "D", c)
    return d.select("conv_id", "step", "edit", left(F.coalesce("role", "_role")).alias("role"), left(F.coalesce("text", F.lit(""))).alias("text"), "cost")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, step, edit, role, text: the turns of all conversations after repair, those deleted left out."""
    faulty = faults(turns)
    return applied(faulty, edits(faulty)).where("edit <> 'D'").select("conv_id", "step", "edit", "role", "text")


def digests(edited: DataFrame) -> DataFrame:
    """conv_id, cost, audit, repaired_sha256 (of role:text, joined by line feeds) of ``applied`` edits, read in order: a
    conversation's text is never in memory as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, audit, cost, digest, out = None, None, 0, None, []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "cost", "audit", "repaired_sha256"])

        for b in batches:
            for conv, edit, role, text, price in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if audit is None or conv != own:
                    if audit is not None:
                        out.append((own, cost, audit.decode(), digest.hexdigest()))
                    own, audit, cost, digest, first = conv, bytearray(), 0, hashlib.sha256(), True
                audit += edit.encode()
                cost += price
                if edit != "D":
                    digest.update(f"{'' if first else '\n'}{role}:{text}".encode())
                    first = False
            if len(out) >= ROWS:
                yield batch()
                out = []
        if audit is not None:
            out.append((own, cost, audit.decode(), digest.hexdigest()))
        if out:
            yield batch()

    rows = _sorted(edited, "step").select("conv_id", "edit", "role", "text", "cost")
    return rows.mapInArrow(run, "conv_id long, cost long, audit string, repaired_sha256 string")


def damaged(turns: DataFrame, number: Column) -> DataFrame:
    """Rows with a number of 0 dropped, of 1 emptied, of 2 without sentence ends, of 3 twice, of 4 said by the user."""
    text = F.when(number == 1, "").when(number == 2, F.translate(F.col("text"), ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(number == 3, 2).otherwise(1)))
    return turns.where(number != 0).select("conv_id", "turn", F.when(number == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
