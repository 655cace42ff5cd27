"""Repair of conversations whose turns break the role grammar, by generalised LR parsing.

The grammar, over the first characters of roles, is a system turn at most and then pairs of user and assistant, or
nothing at all. It is parsed from the last turn to the first, so that an edit is put before the audit it belongs
to and two audits of the same rest compare like their first edits and the order of what follows. At each
turn the graph-structured stack holds one node for each top state of the LR automaton; equal tops are merged into the
one of least (cost, audit). For every node one byte says which edit led to it and from which node, so a conversation
takes a few bytes a turn, and the cheapest derivation is read off from the front.

Edits: keep (K), rerole to user or assistant (R), delete (D), insert an empty user or assistant turn (I). Blank and
duplicate turns must go; a truncated turn that stays costs extra.

Null roles and texts are one space. Turns are ordered by number (null first), then role, then digest of role and
text. Rows without a conversation id belong to none. Repeated rows are duplicates. Each conversation is
read twice: its turns as a few bytes for the parse, then its texts, one after the other, for the digest of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from savora.llm.common import record_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_BLANKS = " \t\n\x0b\x0c\r"

# LR automaton of the reversed grammar: C -> (nothing) | P | P s, P -> a u | P a u.
SHIFT = {0: {"a": 1}, 1: {"u": 2}, 3: {"a": 4, "s": 6}, 4: {"u": 5}, 6: {}}
REDUCE = {2: (2, "P"), 5: (3, "P")}
GOTO = {(0, "P"): 3}
ACCEPT = (0, 3, 6)
# The states below each state on any stack, as many as a reduction may pop.
BELOW = {0: (), 1: (0,), 2: (1, 0), 3: (0,), 4: (3, 0), 5: (4, 3, 0), 6: (3, 0)}


def _after(state: int, symbol: str) -> int | None:
    """The top state after a shift and the reductions it calls for."""
    top = SHIFT[state].get(symbol)
    if top in REDUCE:
        pops, made = REDUCE[top]
        return GOTO[BELOW[top][pops - 1], made]
    return top


NEXT = {(state, symbol): _after(state, symbol) for state in SHIFT for symbol in "uas" if _after(state, symbol) is not None}
# Edits by code: the letter of the audit, and the turn that it makes.
EDITS = ("K", "D", "Ru", "Ra", "Iu", "Ia")
_CODE = {e: i for i, e in enumerate(EDITS)}


def _merged(tops: dict, state: int, cost: int, key: tuple, link: int) -> bool:
    """Merge a stack top into the frontier; whether it is now the best of its state."""
    known = tops.get(state)
    if known is not None and (known[0], known[1]) <= (cost, key):
        return False
    tops[state] = (cost, key, link)
    return True


def _with_inserts(tops: dict) -> None:
    """Add the tops that inserted turns reach, cheapest first."""
    open_, done = set(tops), set()
    while open_:
        state = min(open_, key=lambda s: tops[s][:2])
        open_.remove(state)
        done.add(state)
        cost, key, _ = tops[state]
        for symbol in "ua":
            reached = NEXT.get((state, symbol))
            if reached is not None and reached not in done and _merged(tops, reached, cost + INSERT, ("I", key), _CODE["I" + symbol] * 8 + state):
                open_.add(reached)


def repaired(turns: str) -> tuple[int, list[int]]:
    """The least cost for turns given as letters, and the codes of its edits in order.

    A letter is the first character of a role, u, a, s or o for any other; x for a turn that must go; upper case
    for a truncated one.
    """
    tops: dict = {0: (0, (), 0)}
    _with_inserts(tops)
    links = [bytearray(len(turns) + 1) for _ in range(7)]
    for at in range(len(turns), -1, -1):
        for state, (_, _, link) in tops.items():
            links[state][at] = link
        if at == 0:
            break
        # Audits as ranks: they are compared with each other only.
        order = {key: rank for rank, key in enumerate(sorted({top[1] for top in tops.values()}))}
        turn, before = turns[at - 1], tops
        letter, extra = turn.lower(), TRUNCATED if turn.isupper() else 0
        tops = {}
        for state, (cost, key, _) in before.items():
            rank = order[key]
            _merged(tops, state, cost + DELETE, ("D", rank), _CODE["D"] * 8 + state)
            if letter == "x":
                continue
            kept = NEXT.get((state, letter))
            if kept is not None:
                _merged(tops, kept, cost + extra, ("K", rank), _CODE["K"] * 8 + state)
            for symbol in "ua":
                made = NEXT.get((state, symbol))
                if made is not None:
                    _merged(tops, made, cost + extra + REROLE, ("R", rank), _CODE["R" + symbol] * 8 + state)
        _with_inserts(tops)
    state = min((s for s in ACCEPT if s in tops), key=lambda s: tops[s][:2])
    cost, at, edits = tops[state][0], 0, []
    while True:
        if at == len(turns) and state == 0:
            return cost, edits
        edit, state = divmod(links[state][at], 8)
        edits.append(edit)
        at += EDITS[edit][0] != "I"


_short = lru_cache(maxsize=50_000)(repaired)


def plan_of(turns: str) -> tuple[int, bytes]:
    cost, edits = _short(turns) if len(turns) <= 40 else repaired(turns)
    return cost, bytes(edits)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``gone`` of the rows with their seeded damage; dropped rows stay, marked."""
    one = F.lit(" ")
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    rows = conversations.where(conv.isNotNull()).select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
        (F.crc32(F.concat(conv.cast("string"), F.lit(":"), F.coalesce(turn.cast("string"), one)).cast("binary")) % 20).alias("harm"),
    )
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("harm") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


REPORT = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("edits", pa.binary())]
REPORTS = pa.schema([("conv_id", pa.int64()), *REPORT])
REPORT_DDL = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, edits binary"
RESULTS = pa.schema([("conv_id", pa.int64()), *REPORT[:-1], ("audit", pa.string()), ("repaired_sha256", pa.string())])
RESULTS_DDL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Conversation:
    """What the parse needs of one conversation, turn by turn."""

    def __init__(self, conv_id: int):
        self.conv_id = conv_id
        self.low = self.high = self.before = self.previous = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.letters = bytearray()

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += turn != self.previous
            self.previous = turn
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        letter = "x" if fault in ("b", "d") else initial if initial in ("u", "a", "s") else "o"
        self.letters += (letter.upper() if fault == "t" else letter).encode()

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *plan_of(self.letters.decode())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, initial, fault, gone) to one report a conversation."""

    def rows() -> Iterator[tuple]:
        now: _Conversation | None = None
        for batch in batches:
            for conv, turn, initial, fault, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        yield now.report()
                    now = _Conversation(conv)
                if not gone:
                    now.add(turn, initial, fault)
        if now is not None:
            yield now.report()

    return record_batches(rows(), REPORTS)


def reports(turns: DataFrame) -> DataFrame:
    """Faults, cost and edits of each conversation."""
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    slim = turns.select(
        "conv_id", "turn", "role", "gone", _digest().alias("digest"),
        F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("").alias("fault"),
    )
    # By conversation and digest, so that a huge conversation is spread.
    seen = Window.partitionBy("conv_id", "digest", "role", "gone").orderBy(F.col("turn").asc_nulls_first())
    slim = slim.withColumn("seen", F.row_number().over(seen))
    fault = F.when(F.col("fault") == "b", "b").when(F.col("seen") > 1, "d").otherwise(F.col("fault"))
    placed = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "seen")
    return placed.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "gone").mapInArrow(_parsed, f"conv_id bigint, {REPORT_DDL}")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation its report, then its turns in order, to its result."""
    made = {"u": "user", "a": "assistant"}

    def rows() -> Iterator[tuple]:
        report, at, digest, lines = None, 0, hashlib.sha256(), 0

        def write(line: str) -> None:
            nonlocal lines
            digest.update(("\n" * (lines > 0) + line).encode())
            lines += 1

        def inserts() -> None:
            nonlocal at
            edits = report[-1]
            while at < len(edits) and EDITS[edits[at]][0] == "I":
                write(made[EDITS[edits[at]][1]] + ":")
                at += 1

        def result() -> tuple:
            inserts()
            return *report[:-1], "".join(EDITS[e][0] for e in report[-1]), digest.hexdigest()

        for batch in batches:
            for is_turn, role, text, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_turn:
                    if report is not None:
                        yield result()
                    report, at, digest, lines = values, 0, hashlib.sha256(), 0
                    continue
                inserts()
                edit = EDITS[report[-1][at]]
                at += 1
                if edit != "D":
                    write(f"{role if edit == 'K' else made[edit[1]]}:{text}")
        if report is not None:
            yield result()

    return record_batches(rows(), RESULTS)


def repairs(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired text of every conversation, after its seeded damage."""
    turns = damaged(conversations)
    columns = [f.name for f in REPORTS][1:]
    nulls = [F.lit(None).cast(kind).alias(c) for c, kind in (part.split() for part in REPORT_DDL.split(", "))]
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("turn", "bigint"), ("role", "string"), ("digest", "binary"), ("text", "string"))]
    first = reports(turns).select("conv_id", F.lit(False).alias("is_turn"), *none, *columns)
    texts = turns.where("not gone").select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", _digest().alias("digest"), "text", *nulls)
    placed = first.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", F.col("turn").asc_nulls_first(), "role", "digest")
    return placed.select("is_turn", "role", "text", "conv_id", *columns).mapInArrow(_written, RESULTS_DDL)
