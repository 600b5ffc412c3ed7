"""Conversation structure repair by generalised LR parsing with weighted edits.

* Damage and faults are column expressions.  Equal rows of a turn are folded with a count; a row repeats an earlier one if its
  role and text have a smaller turn (an aggregate over 128-bit names, joined back), or from its second copy on.
* Grammar of the role initials: Talk -> empty | Body | s Body; Body -> Pair | Body Pair; Pair -> u a.  ``SHIFT``, ``REDUCE`` and
  ``GOTO`` are its LR automaton.  The graph-structured stack has one top per state, with the states below it for reductions.
  Each row is kept, reroled or deleted on every top, with inserts before and after.  Equal tops merge to the least (cost, audit);
  what may follow a state does not depend on what lies below it here, so the way that lost is never needed again.
* A top carries its cost, its audit and a running digest of the repaired conversation, so rows stream: sorted by conversation
  and turn inside the partition, one at a time.  What all tops share of their audits is put aside at once.  The digest is over one
  conversation in order, so a conversation is one stream in one task, whatever its length; only its audit, a character an edit,
  grows there.  All other work (damage, names, repeats, sorting) is spread by row.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.llm.common import slices, stash, utf8

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WORDS = {"u": "user", "a": "assistant"}
VISIBLE = r"[^\x20\x09-\x0D]"
OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
       "n_rows long, n_repaired long")

# LR automaton.  Shifts: state -> initial -> next state.  Reductions: state -> (symbols popped, nonterminal).  Gotos: state -> nonterminal -> state.
START, SYSTEM, USER, TURN, BODY, SYSTEM_BODY, PAIR, MORE = range(8)
SHIFT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": TURN}, BODY: {"u": USER}, SYSTEM_BODY: {"u": USER}}
REDUCE = {TURN: (2, "Pair"), PAIR: (1, "Body"), MORE: (2, "Body")}
GOTO = {START: {"Pair": PAIR, "Body": BODY}, SYSTEM: {"Pair": PAIR, "Body": SYSTEM_BODY}, BODY: {"Pair": MORE}, SYSTEM_BODY: {"Pair": MORE}}
ACCEPT = (START, BODY, SYSTEM_BODY)


def settled(stack: tuple[int, ...]) -> tuple[int, ...]:
    """The stack after all reductions; the grammar has no conflicts, so there is one."""
    while stack[-1] in REDUCE:
        pops, name = REDUCE[stack[-1]]
        stack = stack[:-pops]
        stack += (GOTO[stack[-1]][name],)
    return stack


class Top:
    """A top of the graph-structured stack: the states below it, cost, audit beyond what all tops share, digest so far, rows kept."""

    __slots__ = ("stack", "cost", "audit", "digest", "rows")

    def __init__(self, stack: tuple[int, ...], cost: int, audit: str, digest, rows: int):
        self.stack, self.cost, self.audit, self.digest, self.rows = stack, cost, audit, digest, rows


Tops = dict[int, Top]


def offer(tops: Tops, stack: tuple[int, ...], top: Top, edit: str, cost: int, line: bytes | None = None) -> bool:
    """Put ``top`` with one more edit on a stack, unless an equal top has a smaller (cost, audit)."""
    cost, audit = top.cost + cost, top.audit + edit
    old = tops.get(stack[-1])
    if old is not None and (old.cost, old.audit) <= (cost, audit):
        return False
    digest = top.digest
    if line is not None:
        digest = digest.copy()
        digest.update(b"\n" + line if top.rows else line)
    tops[stack[-1]] = Top(stack, cost, audit, digest, top.rows + (line is not None))
    return True


def inserted(tops: Tops) -> Tops:
    """The tops with what inserted rows reach, until nothing gets cheaper."""
    out, open_ = dict(tops), list(tops)
    while open_:
        top = out[open_.pop()]
        for initial, state in SHIFT.get(top.stack[-1], {}).items():
            if initial in WORDS:
                to = settled(top.stack + (state,))
                if offer(out, to, top, "I", INSERT, f"{WORDS[initial]}:".encode()):
                    open_.append(to[-1])
    return out


def consumed(tops: Tops, role: bytes, text: bytes, must_go: bool, truncated: bool) -> Tops:
    """Every top after one row, which is deleted, kept or given another role."""
    out: Tops = {}
    stay = TRUNCATED if truncated else 0
    initial = role[:1].decode("latin-1")
    for top in tops.values():
        offer(out, top.stack, top, "D", DELETE)
        if must_go:
            continue
        for shift, state in SHIFT.get(top.stack[-1], {}).items():
            to = settled(top.stack + (state,))
            if shift == initial:
                offer(out, to, top, "K", stay, role + b":" + text)
            if shift in WORDS:
                offer(out, to, top, "R", REROLE + stay, WORDS[shift].encode() + b":" + text)
    return out


class Talk:
    """One conversation on its way: counters and the graph-structured stack."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.shared: list[str] = []
        self.first_turn = self.last_turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.n_rows = 0
        self.tops: Tops = {START: Top((START,), 0, "", hashlib.sha256(), 0)}

    def add(self, turn: int | None, role: bytes, text: bytes, copies: int, blank: bool, truncated: bool, repeats: bool) -> None:
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        initial = role[:1]
        for copy in range(copies):
            again = not blank and (repeats or copy > 0)
            cut = truncated and not again
            self.blank += blank
            self.duplicate += again
            self.truncated += cut
            self.illegal += self.initial is not None and self.initial + initial not in (b"su", b"ua", b"au")
            self.initial = initial
            self.n_rows += 1
            self.tops = consumed(inserted(self.tops), role, text, blank or again, cut)
            if max(len(t.audit) for t in self.tops.values()) >= 64:
                self.put_aside()

    def put_aside(self) -> None:
        same = os.path.commonprefix([t.audit for t in self.tops.values()])
        if same:
            self.shared.append(same)
            for t in self.tops.values():
                t.audit = t.audit[len(same):]

    def row(self) -> tuple:
        ends = [t for state, t in inserted(self.tops).items() if state in ACCEPT]
        best = min(ends, key=lambda t: (t.cost, t.audit))
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, "".join(self.shared) + best.audit,
                best.digest.hexdigest(), self.n_rows, best.rows)


def repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> a row per conversation."""
    talk, done = None, []
    names = [c.split()[0] for c in OUT.split(", ")]

    def batch() -> pa.RecordBatch:
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)

    for b in slices(batches, 3):
        for conv_id, turn, role, text, copies, blank, truncated, repeats in zip(*(c.to_pylist() for c in b.columns)):
            if talk is None or conv_id != talk.conv_id:
                done += [talk.row()] if talk else []
                talk = Talk(conv_id)
            talk.add(turn, role, text, copies, blank, truncated, repeats)
        if len(done) >= 1024:
            yield batch()
            done = []
    done += [talk.row()] if talk else []
    if done:
        yield batch()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with a column ``copies`` (none, one or two), harmed by crc32('conv_id:turn') % 20; a null is one space there and in role and text."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    harm = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                       F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"))


def names_of(role: Column, text: Column) -> list[Column]:
    """128 bits that stand for role and text."""
    return [F.xxhash64(F.lit(salt), role, text) for salt in (1, 2)]


def repair_conversations(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``, and ``copies`` if rows stand for several or none).

    Rows are taken by turn, a null turn first, those of one turn by role and text; equal rows follow each other.  A null role or
    text is one space.  A null conv_id is a conversation of its own.  Each row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated (last visible character is not one of ``.!?``).  ``audit`` are the initials of the cheapest
    edits that give the grammar's roles, the least in ASCII of several: K keep, R rerole, D delete, I insert; rows that are
    blank or duplicates are deleted.  ``repaired_sha256`` is over ``role:text``, joined by newlines.  A conversation without rows
    (all ``copies`` 0) has zeros, an empty audit and the digest of nothing.  An empty table gives an empty result.
    """
    space = F.lit(" ")
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"),
                        F.coalesce("text", space).alias("text"), (F.col("copies") if "copies" in rows.columns else F.lit(1)).cast("bigint").alias("copies"))
    named = plain.select("*", *[c.alias(n) for c, n in zip(names_of(F.col("role"), F.col("text")), ("k1", "k2"))])
    folded = stash(named.where("copies > 0").groupBy("conv_id", "turn", "k1", "k2").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies")), "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))
    firsts = folded.groupBy("conv_id", "k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
    on = folded["conv_id"].eqNullSafe(firsts["f_conv"]) & (folded["k1"] == firsts["f1"]) & (folded["k2"] == firsts["f2"])
    text, last = F.col("text"), F.regexp_extract("text", rf"(?s)({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    judged = folded.join(firsts, on, "left").select(
        "conv_id", "turn", utf8("role").alias("role"), utf8("text").alias("text"), "copies", (last == "").alias("blank"),
        (~last.isin("", ".", "!", "?")).alias("truncated"), F.coalesce(place != F.col("first"), F.lit(False)).alias("repeats"))
    streams = judged.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    repaired = streams.mapInArrow(repair_batches, OUT)
    every = plain.select(F.col("conv_id").alias("every_id")).distinct()
    nothing = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_rows", "n_repaired")}
    nothing |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    out = every.join(repaired, every["every_id"].eqNullSafe(repaired["conv_id"]), "left").withColumns(nothing)
    return out.select(F.col("every_id").alias("conv_id"), *[c.split()[0] for c in OUT.split(", ")[1:]])
