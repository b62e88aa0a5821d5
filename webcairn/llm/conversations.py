"""Repair of conversation structure at least cost, with one automaton for all conversations.

A row's signature is its role initial and its first fault.  A conversation is a word of
signatures in blocks of ``BLOCK`` rows.  Words are compared from their ends: sorted by
reversed signature and dealt by range, words with a common suffix stand together, so a task
builds each node of the suffix-shared automaton (one per distinct suffix) once, keeping only
the path to the word at hand.  A node holds, for each grammar state, the cost to go, the best
audit suffix and the state at the block's end, from the node one signature shorter.  Words
that many conversations share may cross a range border and only repeat their path there.

The first edit of an optimal audit fixes the next node and state, so the ASCII-least edit of
least cost gives the ASCII-least audit.  A block that is not the last of its conversation
starts from the costs of the block behind it: cost matrices of blocks compose by a prefix scan
with a fixed fan-in, then state maps do the same forwards.  No task holds more than
``BLOCK`` signatures or ``FAN`` matrices; a conversation's text is only streamed, in order,
through the task that writes it out.

Nulls: a null conversation id is a conversation of its own, null turns sort first and do not
count as turns, a null role or text is one space.  Rows of one turn follow each other by role
and then by a hash of the text, so equal rows are neighbours; repeated rows are duplicates.
An empty table has no conversations.  Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webcairn.llm.common import materialize, table
from webcairn.operators.ranking import positions

BLOCK = 1024
FAN = 1024
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Grammar states of (s?(ua)+)?: start, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state a user or assistant row made at a state leads to.
MADE = (USER, USER, ASSISTANT, USER)
#: A kept row: signature class (s, u, a, other) and state to the next state.
KEPT = {(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (2, USER): ASSISTANT, (1, ASSISTANT): USER}
CLASSES = "sua"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
FINAL = "-:0,6,3,0"
NEVER = 1 << 60
ROLE = {USER: "user", ASSISTANT: "assistant"}


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (the four columns) dropped, emptied, stripped, repeated or re-roled by a hash of ``conv:turn``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    return (
        rows.select(conv, turn, blank(role).alias("__role"), blank(text).alias("__text"), fate.alias("__fate"))
        .where("__fate <> 0")
        .select(
            conv,
            turn,
            F.when(F.col("__fate") == 4, F.lit("user")).otherwise(F.col("__role")).alias(role),
            F.when(F.col("__fate") == 1, F.lit(""))
            .when(F.col("__fate") == 2, F.regexp_replace("__text", "[.!?]", ""))
            .otherwise(F.col("__text"))
            .alias(text),
            F.explode(F.when(F.col("__fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
        )
        .drop("__copy")
    )


def _keyed(rows, conv, turn, role, text) -> DataFrame:
    """The rows under fixed names, with a conversation key that is never null."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("")).alias("conv"),
        F.col(conv).alias("id"),
        F.col(turn).cast("long").alias("turn"),
        value(role).alias("role"),
        value(text).alias("text"),
    ).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, at (place from 0), cls, fault of keyed rows; texts stay behind."""
    last = F.substring(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", ""), -1, 1)
    narrow = rows.select(
        "conv",
        "turn",
        "role",
        "digest",
        F.when(last == "", F.lit(BLANK)).when(last.isin(".", "!", "?"), F.lit(SOUND)).otherwise(F.lit(TRUNCATED)).alias("fault"),
    )
    placed = materialize(
        positions(narrow, ["conv"], ["turn", "role", "digest"], "at").withColumn("at", F.col("at") - 1)
    )
    # a row is no duplicate when it is the first of its role and text; (conv, at) is unique, so no join key is hot
    first = placed.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("conv", "at", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    return placed.join(first, ["conv", "at"], "left").select(
        "conv",
        "turn",
        "at",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("cls"),
        F.when(F.col("fault") == BLANK, F.lit(BLANK))
        .when(F.col("first").isNull(), F.lit(DUPLICATE))
        .otherwise(F.col("fault"))
        .alias("fault"),
    )


def blocks(signed: DataFrame, size: int) -> DataFrame:
    """conv, block, last, word (reversed signatures) and peek (the signature after the block, or -)."""
    sign = F.char(F.lit(97) + 4 * F.col("cls") + F.col("fault"))
    own = F.expr(f"at div {size}")
    edge = (F.col("at") % size == 0) & (F.col("at") > 0)
    rows = signed.select(
        "conv", "at", sign.alias("sign"), F.explode(F.when(edge, F.array(own, own - 1)).otherwise(F.array(own))).alias("block")
    )
    packed = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("at", "sign"))).alias("rows"))
    word = F.concat_ws("", F.col("rows.sign"))
    last = signed.groupBy("conv").agg(F.expr(f"max(at) div {size}").alias("last"))
    return (
        packed.withColumn("signs", word)
        .join(last, "conv")
        .select(
            "conv",
            "block",
            "last",
            F.reverse(F.expr(f"left(signs, {size})")).alias("word"),
            F.when(F.length("signs") > size, F.expr("right(signs, 1)")).otherwise(F.lit("-")).alias("peek"),
        )
    )


def _terminal(key: str):
    """The node at a block's end: costs to go, audits, end states, illegal pairs and class of what follows."""
    peek, costs = key.split(":")
    costs = tuple(NEVER if c == "x" else int(c) for c in costs.split(","))
    audits = ("", "II", "I", "") if peek == "-" else ("",) * 4
    return costs, audits, (0, 1, 2, 3), 0, None if peek == "-" else (ord(peek) - 97) >> 2


def _node(sign: str, behind):
    """The node for one signature in front of the node ``behind``."""
    cls, fault = divmod(ord(sign) - 97, 4)
    cost, audit, end, illegal, next_cls = behind
    spare = TRUNCATED_COST if fault == TRUNCATED else 0
    best = []
    for state in range(4):
        picks = [(cost[state] + DELETE_COST, DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            if (cls, state) in KEPT:
                picks.append((cost[KEPT[cls, state]] + spare, KEEP, KEPT[cls, state]))
            picks.append((cost[MADE[state]] + spare + REROLE_COST, REROLE, MADE[state]))
        price, edit, after = min(picks)
        best.append((price, edit, after))
    # inserted rows lead from state to state at this place; two reach every state that helps
    out = []
    for state in range(4):
        step, picks = state, []
        for n in range(3):
            price, edit, after = best[step]
            picks.append((price + n * INSERT_COST, INSERT * n + edit + audit[after], end[after]))
            step = MADE[step]
        out.append(min(picks))
    pair = next_cls is not None and (cls, next_cls) not in ((0, 1), (1, 2), (2, 1))
    return (
        tuple(min(o[0], NEVER) for o in out),
        tuple(o[1] for o in out),
        tuple(o[2] for o in out),
        illegal + pair,
        cls,
    )


def _walk(batches):
    """Sorted (conv, block, end, word): one path of the automaton at a time."""
    held, path, nodes = None, "", []
    for batch in batches:
        out = []
        for conv, block, end, word in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if end != held:
                held, path, nodes = end, "", [_terminal(end)]
            same = 0
            for same, (a, b) in enumerate(zip(path, word)):  # noqa: B007
                if a != b:
                    break
            else:
                same = min(len(path), len(word))
            del nodes[same + 1 :]
            for sign in word[same:]:
                nodes.append(_node(sign, nodes[-1]))
            path = word
            cost, audit, state, illegal, _ = nodes[-1]
            out.append((conv, block, end, list(cost), list(audit), list(state), illegal))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[i] for r in out], t)
                for i, t in enumerate(
                    (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64())
                )
            ],
            ["conv", "block", "end", "costs", "audits", "ends", "illegal"],
        )


def automaton(words: DataFrame) -> DataFrame:
    """costs, audits, ends (by state at the start) and illegal of every (conv, block, end, word)."""
    rows = materialize(words.select("conv", "block", "end", "word"))
    return (
        rows.repartitionByRange("end", "word", "conv", "block")
        .sortWithinPartitions("end", "word")
        .mapInArrow(
            _walk,
            "conv string, block bigint, end string, costs array<bigint>, audits array<string>, ends array<bigint>, illegal bigint",
        )
    )


def _plus(a, b):
    """Cost matrices one after the other, as flat lists of 16."""
    a, b = np.reshape(a, (4, 4)), np.reshape(b, (4, 4))
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER).ravel().tolist()


def _then(a, b):
    """State maps one after the other."""
    return [b[s] for s in a]


def scan(values: DataFrame, compose, identity: list[int], fan: int = FAN) -> DataFrame:
    """conv, at, before: what the values ahead of each (conv, at, value) compose to.

    Groups of ``fan`` neighbours are composed, their totals scanned in the same way, and each
    group then starts from its total: as many rounds as the count has digits to base ``fan``.
    """
    group = F.expr(f"at div {fan}")
    rows = values.select("conv", "at", "value", group.alias("part"))

    def total(frame):
        held = identity
        for value in frame.sort_values("at")["value"]:
            held = compose(held, list(value))
        return frame.head(1).assign(at=frame["part"].iloc[0], value=[held])[["conv", "at", "value"]]

    def inside(frame):
        frame = frame.sort_values("at")
        held, out = list(frame["start"].iloc[0]), []
        for value in frame["value"]:
            out.append(held)
            held = compose(held, list(value))
        return frame.assign(before=out)[["conv", "at", "before"]]

    if values.agg(F.max("at")).first()[0] < fan:
        rows = rows.withColumn("start", F.array(*[F.lit(x).cast("long") for x in identity]))
    else:
        totals = materialize(
            rows.groupBy("conv", "part").applyInPandas(total, "conv string, at bigint, value array<bigint>")
        )
        starts = scan(totals, compose, identity, fan).select("conv", F.col("at").alias("part"), F.col("before").alias("start"))
        rows = rows.join(starts, ["conv", "part"])
    return materialize(rows.groupBy("conv", "part").applyInPandas(inside, "conv string, at bigint, before array<bigint>"))


def solved(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """conv, block, audit, illegal and cost (of the whole conversation, on its first block)."""
    parts = materialize(parts)
    final = automaton(parts.where("block = last").withColumn("end", F.lit(FINAL)))
    long = parts.where("last > 0")
    if long.isEmpty():
        return final.select("conv", "block", F.col("audits")[0].alias("audit"), "illegal", F.col("costs")[0].alias("cost"))
    # cost matrices: a block behind which only one state is allowed, once for each state
    unit = F.explode(F.array(*[F.lit(",".join("0" if i == t else "x" for i in range(4))) for t in range(4)]))
    units = automaton(long.select("conv", "block", "word", unit.alias("unit")).withColumn("end", F.concat(F.lit("a:"), "unit")))
    columns = units.groupBy("conv", "block").agg(
        *[F.max(F.when(F.col("end") == "a:" + ",".join("0" if i == t else "x" for i in range(4)), F.col("costs"))).alias(f"to{t}") for t in range(4)]
    )
    # at counts from the end, so later blocks come first; matrices are transposed for that order
    matrix = F.array(*[F.col(f"to{t}")[s] for t in range(4) for s in range(4)])
    matrices = materialize(
        columns.join(long.select("conv", "block", "last"), ["conv", "block"]).select(
            "conv", (F.col("last") - F.col("block")).alias("at"), matrix.alias("value")
        )
    )
    one = [0 if s == t else NEVER for s in range(4) for t in range(4)]
    behind = scan(matrices, _plus, one, fan)
    goal = [0, 6, 3, 0]
    # the last block keeps the terminal; every other starts from the block behind it, less the least cost
    least = lambda s: F.array_min(F.array(*[F.col("before")[4 * t + s] + goal[t] for t in range(4)]))
    tails = (
        behind.where("at > 0")
        .select("conv", "at", *[least(s).alias(f"v{s}") for s in range(4)])
        .withColumn("base", F.least("v0", "v1", "v2", "v3"))
    )
    inner = (
        long.withColumn("at", F.col("last") - F.col("block"))
        .join(tails, ["conv", "at"])
        .withColumn("end", F.concat("peek", F.lit(":"), F.concat_ws(",", *[(F.col(f"v{s}") - F.col("base")).cast("string") for s in range(4)])))
    )
    inner = materialize(inner.select("conv", "block", "word", "end", "base"))
    answers = materialize(
        final.withColumn("base", F.lit(0).cast("long")).unionByName(
            automaton(inner).join(inner.select("conv", "block", "base"), ["conv", "block"])
        )
    )
    maps = answers.join(long.select("conv", "block"), ["conv", "block"], "left_semi").select(
        "conv", F.col("block").alias("at"), F.col("ends").alias("value")
    )
    entry = scan(maps, _then, [0, 1, 2, 3], fan).select(
        "conv", F.col("at").alias("block"), F.col("before")[0].cast("int").alias("state")
    )
    state = F.coalesce("state", F.lit(0))
    return answers.join(entry, ["conv", "block"], "left").select(
        "conv",
        "block",
        F.get("audits", state).alias("audit"),
        "illegal",
        F.when(F.col("block") == 0, F.col("costs")[0] + F.col("base")).alias("cost"),
    )


def _apply(batches):
    """Audits and then rows of each conversation in order: the repaired rows."""
    conv, edits, used, state, place, ident = None, "", 0, 0, 0, None
    out = []

    def made(edit):
        nonlocal state, place
        state = MADE[state]
        out.append((conv, ident, place, edit, ROLE[state], "" if edit == INSERT else None))
        place += 1

    def finish():
        nonlocal used
        while used < len(edits):
            used += 1
            made(INSERT)

    def packed():
        cols = list(zip(*out)) or [[]] * 6
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), id_type, pa.int64(), pa.string(), pa.string(), pa.string()))],
            ["conv", "id", "place", "edit", "role", "text"],
        )

    id_type = pa.null()
    for batch in batches:
        id_type = batch.schema.field("id").type
        col = {n: batch.column(n).to_pylist() for n in ("conv", "id", "audit", "role", "text")}
        for key, name, audit, role, text in zip(*col.values()):
            if key != conv:
                finish()
                conv, edits, used, state, place, ident = key, [], 0, 0, 0, name
            if audit is not None:
                edits.append(audit)
                continue
            if isinstance(edits, list):
                edits = "".join(edits)
            ident = name
            while edits[used] == INSERT:
                used += 1
                made(INSERT)
            edit = edits[used]
            used += 1
            if edit == REROLE:
                made(REROLE)
                out[-1] = (*out[-1][:5], text)
            elif edit == KEEP:
                state = KEPT[CLASSES.index(role[0]), state]
                out.append((conv, ident, place, KEEP, role, text))
                place += 1
        yield packed()
    finish()
    if out:
        yield packed()


def _digest(batches):
    """SHA-256 of ``role:text`` lines of each conversation, as they stream by."""
    conv, sha = None, None
    for batch in batches:
        out = []
        for key, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
            if key != conv:
                if conv is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"conv": pa.array([r[0] for r in out], pa.string()), "sha": pa.array([r[1] for r in out], pa.string())})
    if conv is not None:
        yield pa.RecordBatch.from_pydict({"conv": pa.array([conv]), "sha": pa.array([sha.hexdigest()])})


class Repair:
    """Audits, counts and repaired rows of the conversations of a table."""

    def __init__(self, rows: DataFrame, conv="conv_id", turn="turn", role="role", text="text", block: int = BLOCK, fan: int = FAN):
        self.conv, self.names = conv, (turn, role, text)
        self.rows = _keyed(rows, conv, turn, role, text)
        self.signed = materialize(faults(self.rows))
        self.audits = materialize(solved(blocks(self.signed, block), fan))

    def report(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit; one row per conversation with rows."""
        count = lambda f: F.count(F.when(F.col("fault") == f, 1))
        counts = self.signed.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            count(BLANK).alias("blank"),
            count(DUPLICATE).alias("duplicate"),
            count(TRUNCATED).alias("truncated"),
        )
        audits = self.audits.groupBy("conv").agg(
            F.sum("illegal").alias("illegal"),
            F.max("cost").alias("cost"),
            F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"])).alias("audit"),
        )
        return counts.join(audits, "conv")

    def _stream(self) -> DataFrame:
        first = self.audits.select(
            "conv", F.lit(0).alias("kind"), "block", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
            F.lit(None).cast("binary").alias("digest"), "audit", F.lit(None).cast("string").alias("text"),
        )
        then = self.rows.select(
            "conv", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "turn", "role", "digest",
            F.lit(None).cast("string").alias("audit"), "text", "id",
        )
        order = ["conv", "kind", "block", "turn", "role", "digest"]
        rows = first.unionByName(then, allowMissingColumns=True).repartition("conv").sortWithinPartitions(*order)
        kind = then.schema["id"].dataType.simpleString()
        return rows.mapInArrow(_apply, f"conv string, id {kind}, place bigint, edit string, role string, text string")

    def repaired(self) -> DataFrame:
        """Rows of the repaired conversations: id, place from 0, edit (K, R or I), role, text."""
        turn, role, text = self.names
        out = self._stream().select(F.col("id").alias(self.conv), "place", "edit", F.col("role").alias(role), F.col("text").alias(text))
        return out

    def digests(self) -> DataFrame:
        """conv, sha of every conversation that keeps a row; its text passes one task as a stream."""
        return self._stream().mapInArrow(_digest, "conv string, sha string")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = Repair(damaged(rows))
    every = _keyed(rows, "conv_id", "turn", "role", "text").groupBy("conv").agg(F.first("id").alias("conv_id"))
    out = every.join(repair.report(), "conv", "left").join(repair.digests(), "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The same from the contract's words: a table of crc32, costs from the last row back, then the edits applied."""
    keeps = {0: ((1, "s"), (2, "u")), 1: ((2, "u"),), 2: ((3, "a"),), 3: ((2, "u"),)}
    best = []
    for state in range(4):
        made = MADE[state]
        picks = [f"{{'c': v[{state + 1}].c + 4, 'a': 'D' || v[{state + 1}].a}}"]
        picks.append(f"CASE WHEN fault NOT IN ('b', 'd') THEN {{'c': v[{made + 1}].c + 3 + spare, 'a': 'R' || v[{made + 1}].a}} END")
        for after, initial in keeps[state]:
            picks.append(
                f"CASE WHEN fault NOT IN ('b', 'd') AND initial = '{initial}' THEN {{'c': v[{after + 1}].c + spare, 'a': 'K' || v[{after + 1}].a}} END"
            )
        best.append(f"list_sort(list_filter([{', '.join(picks)}], lambda x: x IS NOT NULL))[1]")
    insert = []
    for state in range(4):
        one, two = MADE[state], MADE[MADE[state]]
        insert.append(
            f"list_sort([b[{state + 1}], {{'c': b[{one + 1}].c + 3, 'a': 'I' || b[{one + 1}].a}}, {{'c': b[{two + 1}].c + 6, 'a': 'II' || b[{two + 1}].a}}])[1]"
        )
    made = lambda s: f"CASE {s} WHEN 2 THEN 3 ELSE 2 END"
    name = lambda s: f"CASE {s} WHEN 2 THEN 'user' ELSE 'assistant' END"
    return rf"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, coalesce('c' || conv_id, '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), fated AS (
  SELECT named.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate FROM named, crc
), damaged AS (
  SELECT key, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT key, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS final FROM damaged
), judged AS MATERIALIZED (
  SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS spare FROM (
    SELECT *, lead(initial) OVER (PARTITION BY key ORDER BY pos) AS following,
      CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 THEN 'd'
        WHEN final IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault
    FROM placed)
), costs AS (
  SELECT key, max(pos) + 1 AS pos, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 6::BIGINT, 'a': 'II'}}, {{'c': 3::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] AS v
  FROM judged GROUP BY key
  UNION ALL
  SELECT key, pos, [{", ".join(insert)}] FROM (
    SELECT key, j.pos, [{", ".join(best)}] AS b FROM costs c JOIN judged j USING (key) WHERE j.pos = c.pos - 1)
), solved AS MATERIALIZED (
  SELECT key, v[1].c AS cost, v[1].a AS audit, regexp_extract_all(v[1].a, 'I*[KRD]') AS edits, len(regexp_extract(v[1].a, 'I*$')) AS more
  FROM costs WHERE pos = 1
), applied AS (
  SELECT key, 0::BIGINT AS pos, 0 AS state, []::VARCHAR[] AS lines FROM solved
  UNION ALL
  SELECT key, pos, CASE edit WHEN 'D' THEN s WHEN 'R' THEN {made('s')} ELSE CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END,
    list_concat(lines, CASE WHEN n >= 1 THEN [{name(made('state'))} || ':'] ELSE [] END, CASE WHEN n = 2 THEN [{name(made(made('state')))} || ':'] ELSE [] END,
      CASE edit WHEN 'D' THEN [] WHEN 'R' THEN [{name(made('s'))} || ':' || text] ELSE [role || ':' || text] END)
  FROM (
    SELECT *, CASE n WHEN 0 THEN state WHEN 1 THEN {made('state')} ELSE {made(made('state'))} END AS s FROM (
      SELECT a.key, j.pos, a.state, a.lines, j.role, j.text, j.initial, right(s.edits[j.pos], 1) AS edit, len(s.edits[j.pos]) - 1 AS n
      FROM applied a JOIN judged j USING (key) JOIN solved s USING (key) WHERE j.pos = a.pos + 1))
), texts AS (
  SELECT key, array_to_string(list_concat(lines, CASE WHEN more >= 1 THEN [{name(made('state'))} || ':'] ELSE [] END,
    CASE WHEN more = 2 THEN [{name(made(made('state')))} || ':'] ELSE [] END), chr(10)) AS repaired
  FROM applied JOIN solved USING (key) WHERE pos = len(edits)
), counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY key
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT key, any_value(conv_id) AS conv_id FROM named GROUP BY key) LEFT JOIN counts USING (key) LEFT JOIN solved USING (key) LEFT JOIN texts USING (key)
"""


OP13_SQL = _sql()
