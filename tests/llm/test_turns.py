"""Conversation repair against an exhaustive search and against a plain recursion from the end."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from factweave.llm import turns

COLUMNS = "conv_id long, turn long, role string, text string, key string, seq string, seg string, symbol string, edits string, cost string"
SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], COLUMNS).repartition(3)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            one = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [one, one] if k == 3 else [one]
    return out


def fault(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def least(rows, faults):
    """By recursion from the end over whole (cost, audit, lines), with the roles so far as the state."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ())}

    def with_inserts(best):
        for _ in range(4):
            for q, r in step.items():
                if r in best:
                    cost, audit, lines = best[r]
                    new = (cost + 5, "I" + audit, (full[r] + ":", *lines))
                    best[q] = min(best.get(q, new), new)
        return best

    best = with_inserts(best)
    for (_, _, role, text), f in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for q in step:
            options = []
            if q in best:
                cost, audit, lines = best[q]
                options.append((cost + 2, "D" + audit, lines))
            if f not in ("blank", "duplicate"):
                extra = 5 * (f == "truncated")
                r = role[:1]
                if r in ("s", "u", "a") and (r == step[q] or (r == "s" and q == "")) and r in best:
                    cost, audit, lines = best[r]
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
                if step[q] in best:
                    cost, audit, lines = best[step[q]]
                    options.append((cost + extra + 1, "R" + audit, (f"{full[step[q]]}:{text}", *lines)))
            if options:
                now[q] = min(options)
        best = with_inserts(now)
    return best[""]


def exhaustive(rows, faults):
    """Every edit sequence with up to two inserts between rows whose roles could still become legal."""
    legal, begun = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")
    inserts = [i for k in range(3) for i in itertools.product("ua", repeat=k)]
    found = []

    def go(i, roles, audit, cost, lines):
        for new in inserts:
            at = roles + "".join(new)
            if not begun.fullmatch(at):
                continue
            more = (*lines, *[("user:" if x == "u" else "assistant:") for x in new])
            c, t = cost + 5 * len(new), audit + "I" * len(new)
            if i == len(rows):
                if legal.fullmatch(at):
                    found.append((c, t, more))
                continue
            _, _, role, text = rows[i]
            go(i + 1, at, t + "D", c + 2, more)
            if faults[i] not in ("blank", "duplicate"):
                c += 5 * (faults[i] == "truncated")
                if role[:1] and begun.fullmatch(at + role[:1]):
                    go(i + 1, at + role[:1], t + "K", c, (*more, f"{role}:{text}"))
                for r in ("user", "assistant"):
                    if begun.fullmatch(at + r[0]):
                        go(i + 1, at + r[0], t + "R", c + 1, (*more, f"{r}:{text}"))

    go(0, "", "", 0, ())
    return min(found)


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = fault(own)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = least(own, faults)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def audited(df):
    rows = turns.keyed(df)
    return sorted(map(tuple, turns.audited(rows, turns.damaged(rows)).collect()), key=str)


def drawn(rng, n_conversations, most):
    texts = ["Hi.", "ok", "why?", "no!", "", " ", None, "a. b", "x.\n ", "é?", "Hi."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "agent"]
    return [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts)) for c in [*range(n_conversations), None] for t in sorted(rng.sample(range(12), rng.randint(0, most)) + [3] * (rng.random() < 0.2))]


def test_recursion_is_least():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(0, t, *r[2:]) for t, r in enumerate(drawn(rng, 1, 4)[:4])]
        rows = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
        assert least(rows, fault(rows)) == exhaustive(rows, fault(rows))


@pytest.mark.parametrize("length", [1, 2, 4])
def test_blocks_give_the_least_edits(length):
    t, rng = turns.Tables(length), random.Random(length)
    for n in [*range(12), 50, 333]:
        rows = [(0, k, rng.choice(["system", "user", "assistant", "tool"]), rng.choice([f"{k}.", f"{k}", ""])) for k in range(n)]
        faults = fault(rows)
        cost, audit, _ = least(rows, faults)
        s = [turns.GONE if f in ("blank", "duplicate") else 2 * min("suat".index(r[2][0]), 3) + (f == "truncated") for r, f in zip(rows, faults, strict=True)]
        import numpy as np

        s = np.array(s, dtype=np.int64)
        vector, base = t.backward(s, 0)
        assert base + t.vectors[vector][turns.EMPTY] == cost
        if n:
            pieces, state = t.forward(s, 0, turns.EMPTY, True)
            assert "".join(pieces).translate(str.maketrans("uaUA", "IIRR")) == audit and state in (turns.EMPTY, turns.A)


def test_odd_conversations(spark):
    rng = random.Random(2)
    rows = drawn(rng, 60, 9)
    rows += rows[:7]  # repeated rows
    rows += [(500, 1, "user", "x" * 200_000 + "."), (500, 2, "assistant", "." * 100_000 + " " * 100_000 + "y"), (501, None, None, None), (502, None, "user", "Hi."), (502, None, "assistant", "Yes.")]
    assert audited(frame(spark, rows)) == expected(rows)


def test_long_conversation(spark):
    rng = random.Random(3)
    n = 2 * turns.SEGMENT + 77
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "same.", ""])) for t in range(n)] + [(2, t, "user", f"{t}.") for t in range(turns.SEGMENT)]
    assert audited(frame(spark, rows)) == expected(rows)


def test_dropped_and_none(spark):
    dropped = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert audited(frame(spark, [(9, dropped, "user", "Hi.")])) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert audited(frame(spark, [])) == []


def test_repaired_rows(spark):
    rows = turns.keyed(frame(spark, [(1, 1, "tool", "Hi."), (1, 2, "user", "one?"), (1, 3, "user", "two?"), (1, 4, "assistant", "Yes.")]))
    flags = turns.flagged(rows)
    out = turns.repaired(flags, turns.planned(turns.segments(flags))).orderBy("seq", "part")
    assert [tuple(r) for r in out.select("edit", "role", "text").collect()] == [("R", "user", "Hi."), ("R", "assistant", "one?"), ("K", "user", "two?"), ("K", "assistant", "Yes.")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = turns.op12_block_tables(spark, SF)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {t for _, t in out.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows)
