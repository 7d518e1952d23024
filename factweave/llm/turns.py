"""Conversation structure repair: the cheapest edits that give legal turns, by Four-Russians block tables.

A conversation is a sequence of rows. Each row may be kept (0), get the role user or assistant (1) or be deleted (2, and it must
be where it is blank or a duplicate); an empty user or assistant row may be inserted anywhere (5); a truncated row that
stays adds 5. The initials of the roles left must read (s?(ua)+)?. Of the cheapest edit sequences the one whose initials
(D, I, K, R) are least in ASCII order counts.

An automaton of four states reads the roles, and a row is one of nine symbols (initial s, u, a or other, truncated or not; or to be
deleted), so the least costs to go from the four states, less their minimum, take few values: their closure is found once.
For every such cost vector and every block of LENGTH symbols a table gives the vector before the block and what the minimum
grew by. A conversation is read from its end by look-ups. Going forward again, each block is expanded backward from the vector at its end, which gives
the costs to go at every row, and the first edit in ASCII order that lies on a cheapest path is taken: ties are decided as
on the whole string, for every edit leads from a state to one other.

A conversation may hold any share of all rows: rows are ordered by a sort that can spill, cut in segments of SEGMENT rows,
and the segments of a conversation are read as a stream, backward and then forward, with a vector or a state as all that is carried.

Null role or text: one space. Order: by turn (null first); rows of one turn by role and text. Roles by their first character; a role of no
characters is none of s, u, a. Rows of a null conv_id are one conversation. Repeated rows are duplicates. A conversation without rows
has no edits. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.base import table, written

SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant.
EMPTY, S, U, A = range(4)
#: Symbols: 2 * initial + truncated, with the initials in this order and then any other; and a row that must go.
INITIALS, GONE, SYMBOLS = "sua", 8, 9
KEEP = {(EMPTY, 0): S, (EMPTY, 1): U, (S, 1): U, (A, 1): U, (U, 2): A}
#: The one state that a row inserted or given a new role leads to.
NEXT = (U, U, A, U)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LENGTH, SEGMENT = 4, 1024


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: initial, cost and next state, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        initial, truncated = divmod(symbol, 2)
        if (state, initial) in KEEP:
            out.append(("K", TRUNCATED * truncated, KEEP[state, initial]))
        out.append(("R", REROLE + TRUNCATED * truncated, NEXT[state]))
    return out


def with_inserts(costs: list[float]) -> tuple[float, ...]:
    """Least costs to go where rows may be inserted first."""
    for _ in range(4):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


END = with_inserts([0, float("inf"), float("inf"), 0])


class Tables:
    """vectors: the normalised costs to go. step, grown: by vector and symbol; block, more: by vector and block of LENGTH symbols (the first the most significant)."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.vectors = [tuple(int(c) for c in END)]
        place = {self.vectors[0]: 0}
        step, grown = [], []
        for v in self.vectors:  # grows
            row, add = [], []
            for x in range(SYMBOLS):
                costs = with_inserts([min(cost + v[to] for _, cost, to in edits(q, x)) for q in range(4)])
                least = int(min(costs))
                new = tuple(int(c) - least for c in costs)
                if new not in place:
                    place[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append(place[new])
                add.append(least)
            step.append(row)
            grown.append(add)
        self.step, self.grown = np.array(step), np.array(grown)
        self.block, self.more = self.step, self.grown
        for _ in range(length - 1):
            # One symbol more in front of each block.
            before = self.step[self.block], self.grown[self.block]
            n = len(self.vectors)
            self.block, self.more = before[0].transpose(0, 2, 1).reshape(n, -1), (self.more[:, None, :] + before[1].transpose(0, 2, 1)).reshape(n, -1)
        self.traced: dict[tuple[int, int, int], tuple[tuple[str, ...], int]] = {}

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The whole blocks of a segment as codes, and the symbols left over at its end."""
        whole = len(symbols) // self.length * self.length
        return symbols[:whole].reshape(-1, self.length) @ SYMBOLS ** np.arange(self.length)[::-1], symbols[whole:]

    def backward(self, symbols: np.ndarray, vector: int) -> tuple[int, int]:
        """The vector before a segment, from that after it, and what the minimum grew by."""
        blocks, rest = self.codes(symbols)
        cost = 0
        for x in rest[::-1].tolist():
            cost, vector = cost + int(self.grown[vector, x]), int(self.step[vector, x])
        for code in blocks[::-1].tolist():
            cost, vector = cost + int(self.more[vector, code]), int(self.block[vector, code])
        return vector, cost

    def expanded(self, symbols: list[int], vector: int, state: int) -> tuple[tuple[str, ...], int]:
        """Each row's edits from a state on, and the state after; the vectors between the rows are found backward from the last."""
        after = [vector]
        for x in reversed(symbols):
            after.append(int(self.step[after[-1], x]))
        after.reverse()
        out = []
        for i, x in enumerate(symbols):
            here, there, grown = self.vectors[after[i]], self.vectors[after[i + 1]], int(self.grown[after[i + 1], x])
            piece = ""
            while True:
                choices = [(c, to) for c, cost, to in edits(state, x) if cost + there[to] == here[state] + grown]
                if INSERT + here[NEXT[state]] == here[state] and not (choices and choices[0][0] == "D"):
                    state = NEXT[state]
                    piece += "u" if state == U else "a"
                    continue
                edit, state = choices[0]
                piece += ("U" if state == U else "A") if edit == "R" else edit
                break
            out.append(piece)
        return tuple(out), state

    def forward(self, symbols: np.ndarray, vector: int, state: int, last: bool) -> tuple[list[str], int]:
        """Each row's edits, given the vector after the segment and the state before it; u, a: inserted, U, A: new role, K, D. last: nothing follows."""
        blocks, rest = self.codes(symbols)
        parts, ends = [rest.tolist()], [vector]
        for x in rest[::-1].tolist():
            vector = int(self.step[vector, x])
        after = []
        for code in blocks[::-1].tolist():
            after.append(vector)
            vector = int(self.block[vector, code])
        out: list[str] = []
        for k, (code, end) in enumerate(zip(blocks.tolist(), after[::-1], strict=True)):
            if (end, code, state) not in self.traced:
                self.traced[end, code, state] = self.expanded(symbols[k * self.length : (k + 1) * self.length].tolist(), end, state)
            pieces, state = self.traced[end, code, state]
            out += pieces
        pieces, state = self.expanded(parts[0], ends[0], state)
        out += pieces
        while last and END[state]:
            state = NEXT[state]
            out[-1] += "u" if state == U else "a"
        return out, state


@lru_cache(maxsize=4)
def tables(length: int = LENGTH) -> Tables:
    return Tables(length)


def symbols_of(digits: str) -> np.ndarray:
    return np.frombuffer(digits.encode(), dtype=np.uint8).astype(np.int64) - ord("0")


def read_backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to segments, each conversation's last first, the vector after each, whether it is the last, and the cost from it on."""
    t, key, vector, base = tables(), None, 0, 0
    for pdf in frames:
        out = []
        for k, seg, digits in zip(pdf["key"], pdf["seg"], pdf["symbols"], strict=True):
            last = k != key
            if last:
                key, vector, base = k, 0, 0
            after = vector
            vector, more = t.backward(symbols_of(digits), vector)
            base += more
            out.append((k, seg, digits, after, last, base + t.vectors[vector][EMPTY]))
        yield pd.DataFrame(out, columns=["key", "seg", "symbols", "after", "last", "cost"])


def read_forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each segment's edits by row, with the first segments first."""
    t, key, state = tables(), None, EMPTY
    for pdf in frames:
        out = []
        for k, seg, digits, after, last, cost in zip(pdf["key"], pdf["seg"], pdf["symbols"], pdf["after"], pdf["last"], pdf["cost"], strict=True):
            if k != key:
                key, state = k, EMPTY
            pieces, state = t.forward(symbols_of(digits), after, state, last)
            out.append((k, seg, pieces, cost))
        yield pd.DataFrame(out, columns=["key", "seg", "edits", "cost"])


def keyed(conversations: DataFrame) -> DataFrame:
    """key (a text that is never null), conv_id, turn, role, text."""
    name = F.col("conv_id").cast("string")
    key = F.concat(F.when(name.isNull(), "0").otherwise("1"), F.coalesce(name, F.lit("")))
    return conversations.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of keyed as a broken export leaves them: by crc32(conv_id:turn) % 20, 0 is dropped, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 gets the role user."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.withColumn("fault", (F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20).cast("int")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return out.select("key", "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """key, seq (from 0), seg, role, text, symbol, and whether the row is blank, duplicate, truncated, illegal after the one before, and the first of its turn.

    What was said before is found by a count of role and digest, so that one text said by a third of the rows is summed where it lies.
    """
    end = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumns({"digest": F.sha2("text", 256), "end": F.substring(end, -1, 1), "initial": F.substring("role", 1, 1), "at": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))})
    again = rows.groupBy("key", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    w = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag(F.struct("turn", "role", "digest", "initial")).over(w)
    rows = rows.join(again, ["key", "role", "digest"], "left").withColumns({"seq": F.row_number().over(w).cast("long") - 1, "before": before})
    b = F.col("before")
    blank = F.col("end") == ""
    same = F.coalesce(b["turn"].eqNullSafe(F.col("turn")) & (b["role"] == F.col("role")) & (b["digest"] == F.col("digest")), F.lit(False))
    duplicate = ~blank & (same | F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    truncated = ~blank & ~duplicate & ~F.col("end").isin(".", "!", "?")
    illegal = b.isNotNull() & ~F.concat(b["initial"], F.col("initial")).isin("su", "ua", "au")
    turn = F.col("turn").isNotNull() & (b.isNull() | ~b["turn"].eqNullSafe(F.col("turn")))
    place = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    symbol = F.when(blank | duplicate, GONE).otherwise(2 * place + truncated.cast("int"))
    flags = {"blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "new_turn": turn}
    return rows.select("key", "conv_id", "seq", F.floor(F.col("seq") / SEGMENT).cast("long").alias("seg"), "turn", "role", "text", symbol.alias("symbol"), *[v.alias(k) for k, v in flags.items()])


def segments(rows: DataFrame) -> DataFrame:
    """key, seg, symbols (a digit for each of SEGMENT rows at most), counts of the flags and the ends of the turns."""
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("symbol").cast("string").alias("symbol")))), lambda x: x["symbol"]), "")
    n = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return rows.groupBy("key", "seg").agg(digits.alias("symbols"), *[n(c) for c in ("blank", "duplicate", "truncated", "illegal", "new_turn")], F.min("turn").alias("low"), F.max("turn").alias("high"))


def planned(parts: DataFrame) -> DataFrame:
    """key, seg, edits (one text for each row), cost (of what lies from this segment on)."""
    back = parts.select("key", "seg", "symbols").repartition("key").sortWithinPartitions("key", F.desc("seg")).mapInPandas(read_backward, "key string, seg long, symbols string, after int, last boolean, cost long")
    # The partitions stay as they are: only the order within them changes.
    return back.sortWithinPartitions("key", "seg").mapInPandas(read_forward, "key string, seg long, edits array<string>, cost long")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """key, conv_id, seq, part, edit (I, K, R), role, text: the repaired conversations' rows, in order of seq and part."""
    piece = F.split(F.element_at("edits", (F.col("seq") % SEGMENT + 1).cast("int")), "")
    each = rows.join(plan.select("key", "seg", "edits"), ["key", "seg"]).select("key", "conv_id", "seq", "role", "text", F.posexplode(piece).alias("part", "code")).where("code not in ('D', '')")
    code: Column = F.col("code")
    new = code.isin("u", "a")
    role = F.when(code == "K", F.col("role")).when(F.lower("code") == "u", "user").otherwise("assistant")
    edit = F.when(code == "K", "K").when(new, "I").otherwise("R")
    return each.select("key", "conv_id", "seq", "part", edit.alias("edit"), role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"))


def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key and the SHA-256 of role:text, newline-joined, of rows in order; only the hash is carried from one batch to the next."""
    key, sha = None, None
    for pdf in frames:
        out = []
        for k, role, text in zip(pdf["key"], pdf["role"], pdf["text"], strict=True):
            if k != key:
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
    if sha is not None:
        yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "repaired_sha256"])


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of conversations (of keyed): what ails its rows (of keyed, or damaged), the edits, and the digest of what they give."""
    rows = written(flagged(rows), "turns")
    parts = written(segments(rows), "segments")
    plan = written(planned(parts), "edits")
    hashed = repaired(rows, plan).select("key", "seq", "part", "role", "text").repartition("key").sortWithinPartitions("key", "seq", "part").mapInPandas(digests, "key string, repaired_sha256 string")
    counts = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "new_turn")], F.min("low").alias("low"), F.max("high").alias("high"))
    letters = F.translate(F.array_join("edits", ""), "uaUA", "IIRR")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", letters.alias("x")))), lambda x: x["x"]), "")
    cost = F.max(F.when(F.col("seg") == 0, F.col("cost"))).alias("cost")
    out = conversations.groupBy("key").agg(F.first("conv_id").alias("conv_id")).join(counts, "key", "left").join(plan.groupBy("key").agg(audit.alias("audit"), cost), "key", "left").join(hashed, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = zero(F.col("high") - F.col("low") + 1 - F.col("new_turn")).alias("gaps")
    return out.select(
        "conv_id", gaps, *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(table(spark, sf_dir, "conversations"))
    return audited(rows, damaged(rows))
