"""Repair of a conversation's structure by error-correcting Earley parsing over a weighted role grammar.

A conversation's rows become tokens: the initial of the role and whether the row is sound, truncated or has to go. The
grammar asks for an optional system turn and then pairs of a user and an assistant turn, or nothing; error productions
delete, rerole and insert turns at a cost. Chart items keep their least (cost, audit), so the completed chart holds the
cheapest repair and, of equally cheap ones, the ASCII-least audit.

The productions lean to the left: every item of a phrase starts where the parse starts, so a chart column has a bounded
number of items and time grows with the number of rows. Such a phrase may also be given at the start, which lets a
conversation be cut: rows are range-partitioned in order, each block of rows is parsed from every phrase that may stand
before it, and a conversation's blocks are put together from those small tables. No task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, schema_of

#: Rows and bytes of text of a block, which is parsed and repaired in one piece. They only decide where blocks end.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
_SPACES = " \t\n\x0b\x0c\r"

#: Phrases that may stand before a block, and those that a conversation may end with.
PHRASES = ("Empty", "Opened", "Asked", "Answered")
ENDS = ("Empty", "Answered")
#: Productions: left side, right side, cost, edit. Small letters are tokens with that initial, ``*`` any token that may stay, ``.`` any token.
GRAMMAR = (
    ("Empty", ("Empty", "Deleted"), 0, ""),
    ("Opened", ("Empty", "System"), 0, ""),
    ("Opened", ("Opened", "Deleted"), 0, ""),
    ("Asked", ("Empty", "User"), 0, ""),
    ("Asked", ("Opened", "User"), 0, ""),
    ("Asked", ("Answered", "User"), 0, ""),
    ("Asked", ("Asked", "Deleted"), 0, ""),
    ("Answered", ("Asked", "Assistant"), 0, ""),
    ("Answered", ("Answered", "Deleted"), 0, ""),
    ("System", ("s",), 0, "K"),
    ("User", ("u",), 0, "K"),
    ("User", ("*",), 1, "R"),
    ("User", (), 5, "I"),
    ("Assistant", ("a",), 0, "K"),
    ("Assistant", ("*",), 1, "R"),
    ("Assistant", (), 5, "I"),
    ("Deleted", (".",), 2, "D"),
)
#: What a truncated row costs unless it is deleted.
TRUNCATED = 5


def token(initial: str, fault: str) -> str:
    """``x`` for a row that has to go, else s, u, a or o (any other role); upper case if it is truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = initial if initial in ("s", "u", "a") and initial else "o"
    return letter.upper() if fault == "truncated" else letter


def _scans(symbol: str, tok: str) -> int | None:
    """What it costs that a terminal stands for a token; None where it cannot."""
    if symbol == ".":
        return 0
    if tok == "x" or symbol not in ("*", tok.lower()):
        return None
    return TRUNCATED if tok.isupper() else 0


@lru_cache(1 << 16)
def parse(tokens: str, given: str = "Empty") -> dict[str, tuple[int, str]]:
    """The least (cost, audit) of each phrase over all tokens, where the phrase ``given`` stands before them."""
    rules_of: dict[str, list[int]] = {}
    for k, (left, *_) in enumerate(GRAMMAR):
        rules_of.setdefault(left, []).append(k)
    chart: list[dict] = []
    seeds: dict = {}
    for at in range(len(tokens) + 1):
        items, waiting, done = {}, {}, {}  # item -> value; symbol -> items before it; (phrase, origin) -> value
        chart.append((items, waiting))
        agenda: list = []

        def offer(item, value):
            if item not in items or value < items[item]:
                items[item] = value
                agenda.append(item)

        def complete(left, origin, value):
            if (left, origin) in done and done[left, origin] <= value:
                return
            done[left, origin] = value
            before, held = chart[origin]
            for item in list(held.get(left, ())):
                offer((item[0], item[1] + 1, item[2]), (before[item][0] + value[0], before[item][1] + value[1]))

        if at == 0:
            for phrase in PHRASES:
                for k in rules_of[phrase]:
                    offer((k, 0, 0), (0, ""))
            while agenda:
                item = agenda.pop()
                waiting.setdefault(GRAMMAR[item[0]][1][0], set()).add(item)
            complete(given, 0, (0, ""))
        for item, value in seeds.items():
            offer(item, value)
        while agenda:
            item = agenda.pop()
            k, dot, origin = item
            left, right, cost, edit = GRAMMAR[k]
            value = items[item]
            if dot == len(right):
                complete(left, origin, (value[0] + cost, value[1] + edit))
                continue
            symbol = right[dot]
            if symbol not in rules_of:
                waiting.setdefault(symbol, set()).add(item)
                continue
            waiting.setdefault(symbol, set()).add(item)
            for other in rules_of[symbol]:  # predict
                if symbol not in PHRASES:
                    offer((other, 0, at), (0, ""))
            if (symbol, at) in done:  # a phrase of no tokens that was completed before
                inner = done[symbol, at]
                offer((k, dot + 1, origin), (value[0] + inner[0], value[1] + inner[1]))
        if at == len(tokens):
            return {phrase: done[phrase, 0] for phrase in PHRASES if (phrase, 0) in done}
        seeds = {}
        for symbol, held in waiting.items():
            cost = _scans(symbol, tokens[at]) if symbol not in rules_of else None
            if cost is not None:
                for k, dot, origin in held:
                    value = items[k, dot, origin]
                    seeds[k, dot + 1, origin] = (value[0] + cost, value[1])
    raise AssertionError


def apply_edits(audit: str, given: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired rows of a block."""
    out_roles, out_texts, at, turns = [], [], 0, {"Empty": 0, "Opened": 0, "Asked": 1, "Answered": 0}[given]
    for edit in audit:
        if edit == "I":
            role, text = ("user", "assistant")[turns % 2], ""
        else:
            role, text, at = roles[at], texts[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = ("user", "assistant")[turns % 2]
        turns += not (edit == "K" and role[:1] == "s")
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def _fault(text: Column, again: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated, or nothing."""
    end = F.rtrim(text, F.lit(_SPACES))
    return F.when(end == "", "blank").when(again > 1, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


_TABLE = "array<struct<given:string,phrase:string,cost:bigint,audit:string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


class _Block:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv, fresh: bool):
        self.conv, self.fresh, self.bytes = conv, fresh, 0
        self.roles, self.texts, self.tokens, self.counts = [], [], [], dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = None
        self.n_turns = 0

    def add(self, turn, role, text, fault):
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.counts["illegal"] += 1
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.n_turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.roles.append(role)
        self.texts.append(text)
        self.tokens.append(token(role[:1], fault))
        self.bytes += len(text)

    def row(self, uid: int) -> dict:
        tokens = "".join(self.tokens)
        table = [{"given": g, "phrase": p, "cost": c, "audit": a} for g in (PHRASES[:1] if self.fresh else PHRASES) for p, (c, a) in parse(tokens, g).items()]
        return {"uid": uid, "conv_id": self.conv, **self.counts, "first_role": self.roles[0][:1], "last_role": self.roles[-1][:1], "first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.n_turns, "cuts": table, "roles": self.roles, "texts": self.texts}


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df)


def _blocks(rows: DataFrame, conv: str, block_rows: int, block_bytes: int) -> DataFrame:
    """Parsed blocks of rows that come in order; uids ascend in that order."""
    schema = schema_of(uid="bigint", conv_id=conv, **dict.fromkeys(_COUNTS, "bigint"), first_role="string", last_role="string", first_turn="bigint", last_turn="bigint", n_turns="bigint", cuts=_TABLE, roles="array<string>", texts="array<string>")
    arrow = _arrow(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, held, block, first = TaskContext.get().partitionId() << 32, [], None, True
        size = 0
        for batch in batches:
            for conv_id, turn, role, text, fault in zip(*(batch.column(k).to_pylist() for k in range(5))):
                same = block is not None and block.conv == conv_id
                if block is not None and (not same or len(block.roles) >= block_rows or block.bytes >= block_bytes):
                    held.append(block.row(uid))
                    size, uid = size + block.bytes + 256, uid + 1
                    block = None
                if block is None:
                    block = _Block(conv_id, not (first or same))
                    first = False
                block.add(turn, role, text, fault)
                if len(held) >= 1024 or size >= 4 * BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held, size = [], 0
        if block is not None:
            held.append(block.row(uid))
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return rows.mapInArrow(run, schema)


def _fold(blocks: DataFrame, conv: str) -> DataFrame:
    """Per conversation (uid null) its counts, cost and audit; per block the phrases before and behind it on the cheapest way."""
    schema = schema_of(conv_id=conv, uid="bigint", given="string", phrase="string", gaps="bigint", **dict.fromkeys(_COUNTS, "bigint"), cost="bigint", audit="string")
    arrow = _arrow(blocks.sparkSession.createDataFrame([], schema).schema)

    def finish(conv_id, uids, ways, counts, first_turn, last_turn, n_turns):
        cost, audit, route = min(ways[e] for e in ENDS if e in ways)
        phrases = ["Empty", *(PHRASES[int(x)] for x in route)]
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - n_turns
        rows = [{"conv_id": conv_id, "uid": u, "given": g, "phrase": p} for u, g, p in zip(uids, phrases, phrases[1:])]
        return [*rows, {"conv_id": conv_id, "gaps": gaps, **counts, "cost": cost, "audit": audit}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, last_role = [], None, ""
        for batch in batches:
            for b in batch.to_pylist():
                if state is None or state[0] != b["conv_id"]:
                    if state is not None:
                        held += finish(*state)
                    state, last_role = [b["conv_id"], [], {"Empty": (0, "", "")}, dict.fromkeys(_COUNTS, 0), None, None, 0], ""
                for k in _COUNTS:
                    state[3][k] += b[k]
                if state[1] and last_role + b["first_role"] not in _LEGAL:
                    state[3]["illegal"] += 1
                last_role = b["last_role"]
                if b["first_turn"] is not None:
                    state[6] += b["n_turns"] - (b["first_turn"] == state[5])
                    state[4] = b["first_turn"] if state[4] is None else state[4]
                    state[5] = b["last_turn"]
                ways: dict = {}
                for c in b["cuts"]:
                    if c["given"] in state[2]:
                        cost, audit, route = state[2][c["given"]]
                        way = (cost + c["cost"], audit + c["audit"], route + str(PHRASES.index(c["phrase"])))
                        ways[c["phrase"]] = min(way, ways.get(c["phrase"], way))
                state[1].append(b["uid"])
                state[2] = ways
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
        if state is not None:
            held += finish(*state)
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    small = blocks.drop("roles", "texts")
    return small.repartition("conv_id").sortWithinPartitions("conv_id", "uid").mapInArrow(run, schema)


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired rows of conversations with columns conv_id, turn (integer), role and text; others are ignored.

    Summaries: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row a conversation. Repaired rows
    come in blocks: conv_id, uid (ascending in order), roles, texts.

    Rows go by turn, nulls first; rows of one turn by role, then by a hash of the text. A null role or text is one
    space; rows of a null conv_id are one conversation. Repeated rows are duplicates from the second on. An empty table
    gives none.
    """
    work = Work(conversations.sparkSession)
    conv = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    rows = rows.withColumn("again", again).withColumn("tie", F.xxhash64("text"))
    rows = rows.select("conv_id", "turn", "role", "text", _fault(F.col("text"), F.col("again")).alias("fault"), "tie", "again")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("again")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    blocks = work.saved(_blocks(ordered, conv, block_rows, block_bytes), "blocks")
    ways = work.saved(_fold(blocks, conv), "ways")
    chosen = ways.where("uid IS NOT NULL").select("uid", F.col("given").alias("_given"), F.col("phrase").alias("_phrase"))
    cut = F.filter("cuts", lambda c: (c["given"] == F.col("_given")) & (c["phrase"] == F.col("_phrase")))[0]["audit"]
    found = blocks.join(chosen, "uid").select("conv_id", "uid", "_given", cut.alias("_audit"), "roles", "texts")
    out = schema_of(conv_id=conv, uid="bigint", roles="array<string>", texts="array<string>")
    arrow = _arrow(conversations.sparkSession.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                roles, texts = apply_edits(b["_audit"], b["_given"], b["roles"], b["texts"])
                rows.append({"conv_id": b["conv_id"], "uid": b["uid"], "roles": roles, "texts": texts})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return ways.where("uid IS NULL").drop("uid", "given", "phrase"), found.mapInArrow(run, out)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the SHA-256 of ``role:text`` lines joined by newlines, block after block."""
    conv = repaired.schema["conv_id"].dataType.simpleString()
    schema = schema_of(conv_id=conv, repaired_sha256="string")
    arrow = _arrow(repaired.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv_id, state, lines = [], None, None, 0
        for batch in batches:
            for b in batch.to_pylist():
                if state is None or b["conv_id"] != conv_id:
                    if state is not None:
                        held.append({"conv_id": conv_id, "repaired_sha256": state.hexdigest()})
                    conv_id, state, lines = b["conv_id"], hashlib.sha256(), 0
                for role, text in zip(b["roles"], b["texts"]):
                    state.update(("\n" * (lines > 0) + role + ":" + text).encode("utf-8"))
                    lines += 1
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "repaired_sha256": state.hexdigest()}], arrow)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "uid").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Test damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The summaries and digests of the repaired ``rows``, with a row of zeros for conversations that have none left."""
    summaries, repaired = repair(rows)
    none = lambda kind: F.lit(None).cast(kind)
    numbers = ("gaps", *_COUNTS, "cost")
    every = conversations.select("conv_id", *(none("bigint").alias(c) for c in numbers), none("string").alias("audit"), none("string").alias("repaired_sha256"))
    found = summaries.select("conv_id", *numbers, "audit", none("string").alias("repaired_sha256"))
    hashed = digests(repaired).select("conv_id", *(none("bigint").alias(c) for c in numbers), none("string").alias("audit"), "repaired_sha256")
    merged = every.union(found).union(hashed).groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))
    return merged.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
