"""Operator 13 against a brute force over all edits in order of (cost, ASCII)."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from facetlens.llm import conversation_repair as repair_of

COLUMNS = "conv_id bigint, turn bigint, role string, text string, dropped boolean"
LEGAL = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(initials, faults):
    """Uniform-cost search on whole audits: the first accepted is the cheapest, then the ASCII-least."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(faults) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))

        def step(edit, more, j, to):
            if to is None or to in LEGAL[last]:
                heapq.heappush(heap, (cost + more, audit + edit, j, last if to is None else to))

        for role in "ua":
            step("I", 5, i, role)
        if i < len(faults):
            step("D", 2, i + 1, None)
            if faults[i] not in (repair_of.BLANK, repair_of.DUPLICATE):
                cut = 5 * (faults[i] == repair_of.TRUNCATED)
                if initials[i] in "sua":
                    step("K", cut, i + 1, initials[i])
                for role in "ua":
                    step("R", 1 + cut, i + 1, role)


def brute(rows):
    """Expected row of one conversation from its (turn, role, text) rows."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    faults = []
    for k, (_, role, text) in enumerate(rows):
        body = text.strip(" \t\n\x0b\x0c\r")
        seen = (role, text) in [x[1:] for x in rows[:k]]
        faults.append(repair_of.BLANK if not body else repair_of.DUPLICATE if seen
                      else repair_of.OK if body[-1] in ".!?" else repair_of.TRUNCATED)
    initials = "".join(r[:1] or " " for _, r, _ in rows)
    cost, audit = cheapest(initials, faults)
    turns = [t for t, _, _ in rows if t is not None]
    out, at, names = [], 0, {"u": "user", "a": "assistant"}
    for e in audit:
        last = out[-1][0][:1] if out else ""
        new = names["a" if last == "u" else "u"]
        if e == "I":
            out.append((new, ""))
            continue
        if e != "D":
            out.append((rows[at][1] if e == "K" else new, rows[at][2]))
        at += 1
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (1, 2, 3)),
            sum(initials[k:k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows, **sizes):
    got = {r["conv_id"]: tuple(r[c] for c in FIELDS)
           for r in repair_of.repair(spark.createDataFrame(rows, COLUMNS), **sizes).collect()}
    groups = {}
    for conv, turn, role, text, dropped in rows:
        groups.setdefault(conv, []).extend([] if dropped else [(turn, role, text)])
    assert got == {c: brute(g) for c, g in groups.items()}


def random_rows(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            rows.append((None if c == 3 else c, None if rng.random() < 0.05 else rng.randrange(most),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Hi.", "Yes!", "cut off", "", " \n", None, "why?", f"text {t}.", "Hi. \t", "naïve 你好."]),
                         rng.random() < 0.1))
    return rows


def test_search_is_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randrange(0, 9)
        initials = "".join(rng.choice("suat ") for _ in range(n))
        faults = [rng.randrange(4) for _ in range(n)]
        search = repair_of.Search(initials, faults)
        audit = search.audit()
        assert (search.known[0][0], audit) == cheapest(initials, faults)


def test_search_of_a_long_conversation():
    rng = random.Random(2)
    initials = "".join(rng.choice("suuaat") for _ in range(3000))
    faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in initials]
    search = repair_of.Search(initials, faults)
    audit = search.audit()
    assert (search.known[0][0], audit) == cheapest(initials, faults)


def test_repair_matches_brute_force(spark):
    rows = random_rows(7, 60, 14)
    rows += [(900, 0, "user", "x" * 300_000, False), (901, 0, "user", "Hi.", True), (902, None, "user", "A.", False)]
    check(spark, rows)


@pytest.mark.parametrize("piece", [1, 3, 8])
def test_long_conversations_in_pieces(spark, piece):
    """Every conversation of more than 4 rows takes the path by pieces."""
    check(spark, random_rows(11, 25, 20), longest=4, piece=piece)


def test_one_conversation_holds_most_rows(spark):
    rows = random_rows(5, 10, 8) + [(77, t // 2, ("user", "assistant")[t % 2 if t % 7 else 0], f"line {t % 400}{'.' * (t % 5 > 0)}", False)
                                    for t in range(1500)]
    check(spark, rows, longest=100, piece=64)


def test_damage_and_clashing_columns(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Line {t}. More?") for c in range(40) for t in range(6)]
    rows += [(None, None, None, None), (50, 2, None, "End!")]
    extra = [F.lit("x").alias(c) for c in ("fault", "dropped", "copy", "there", "pos", "seen", "cost", "audit")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", *extra)
    import zlib

    want = {}
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = blank(text)
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        new = (turn, "user" if fault == 4 else blank(role), text)
        want.setdefault(conv, []).extend([] if fault == 0 else [new] * (2 if fault == 3 else 1))
    got = {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in repair_of.repair(repair_of.damaged(df)).collect()}
    assert got == {c: brute(g) for c, g in want.items()}


def test_empty_table(spark):
    assert repair_of.repair(repair_of.damaged(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0
