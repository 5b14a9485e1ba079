"""Operator 13: cheapest repair of a conversation's structure, by iterative-deepening A*.

Rows of a conversation in order of turn are edited so that the role initials read
``(s?(ua)+)?``. Edits, named by their initials: Keep (0; allowed unless the row is
blank or a duplicate), Rerole to user or assistant (1, likewise), Delete (2),
Insert an empty user or assistant row anywhere (5); a truncated row that is not
deleted costs 5 more.

A depth-first search tries the edits in ASCII order under a cost bound. A state
is the next row and the last role; a table keeps for every state that failed the
least cost it is known to need, and no state is entered again with less. When
the search fails, the root's entry is the next bound. The first accepting path is
thus the cheapest, and the ASCII-least of the cheapest. The table starts with the
least cost of each remaining row on its own. Suffixes of long conversations are
solved first, from the back, in steps of ``STEP`` rows with the same table: the
effort grows with the number of rows, not with rows times cost.

Conversations of at most ``longest`` rows are gathered, one row each. Longer ones
are range-partitioned by (conversation, turn, role, text) and searched in pieces,
for each role before and after the piece; a piece ends with an edit of one of its
rows, so no piece's edits are a prefix of another way through it and the pieces'
least ways combine exactly. Per conversation only the pieces' costs meet; the
digest of a long repaired conversation is streamed.

Defined results: a null role or text is one space; an empty role counts as the
initial of one space; a null conversation id is a conversation; rows of equal
turn are ordered by role, then text, so repeated rows are adjacent; a conversation
without rows (all marked ``dropped``) has zeros, an empty audit and the digest of
the empty string; an empty table gives an empty result; further columns are
ignored; texts of any length are compared and digested whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, partitions, python_ready

SPACE = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 60
STEP = 16
#: State: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Role that may be written next, and the state then.
WRITES = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEAST = (0, 2, 2, 2)        # cost of a row on its own, by fault
LONG_IDS = 1_000_000        # ids of long conversations that are broadcast


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by crc32 of ``conv_id:turn`` mod 20; a dropped row stays, marked ``dropped``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace(blank("text"), "[.!?]", ""))
            .otherwise(blank("text")))
    return (rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", fault.alias("fault"))
            .select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
                    text.alias("text"), (F.col("fault") == 0).alias("dropped"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


def initial(role: str) -> str:
    return role[:1] or " "


def fault_of(text: str, seen: bool) -> int:
    body = text.strip(SPACE)
    return BLANK if not body else DUPLICATE if seen else OK if body[-1] in ".!?" else TRUNCATED


class Search:
    """Cheapest edits of some rows, given as role initials and faults, to one of the states ``ends``.

    ``trailing``: whether rows may be inserted behind the last one.
    """

    def __init__(self, initials: str, faults: list[int], ends=ENDS, trailing: bool = True):
        self.initials, self.faults, self.ends, self.trailing, n = initials, faults, ends, trailing, len(faults)
        rest = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            rest[i] = rest[i + 1] + LEAST[faults[i]]
        #: state -> least cost it is known to need; raised whenever the state fails
        self.known = [[h] * 4 for h in rest]
        self.known[n] = [0 if s in ends else 5 if trailing else FAR for s in range(4)]
        if not trailing:         # a state that no way leads from to the ends must not be searched for ever
            self._close_dead_ends()
        self.solved = n + 1      # from this row on the entries of every STEP-th row are exact
        for start in range((n - 1) // STEP * STEP, 0, -STEP):
            for s in range(4):
                self.audit(start, s, whole=False)
            self.solved = start

    def _close_dead_ends(self) -> None:
        alive = [s in self.ends for s in range(4)]
        for i in range(len(self.faults) - 1, -1, -1):
            alive = [any(alive[t] for edit, _, _, t in self.edits(i, s) if edit != "I") for s in range(4)]
            for _ in range(2):   # at most two inserts lead to a state that was not there before
                alive = [alive[s] or alive[WRITES[s][0]] for s in range(4)]
            self.known[i] = [h if ok else FAR for h, ok in zip(self.known[i], alive)]

    def edits(self, i: int, s: int):
        """(initial, cost, next row, next state) in ASCII order."""
        there, out = i < len(self.faults), []
        to = WRITES[s][0]
        if there:
            out.append(("D", 2, i + 1, s))
        if there or self.trailing:
            out.append(("I", 5, i, to))
        if there and self.faults[i] not in (BLANK, DUPLICATE):
            more = 5 if self.faults[i] == TRUNCATED else 0
            kept = AFTER[s].get(self.initials[i])
            if kept is not None:
                out.append(("K", more, i + 1, kept))
            out.append(("R", 1 + more, i + 1, to))
        return out

    def audit(self, i: int = 0, s: int = 0, whole: bool = True) -> str | None:
        """Edits from row ``i`` in state ``s`` (None: no way); ``known`` has the cost. Not whole: only as far as solved."""
        while self.known[i][s] < FAR:
            path = self._within(i, s, self.known[i][s], whole)
            if path is not None:
                return path
        return None

    def _within(self, i: int, s: int, bound: int, whole: bool) -> str | None:
        known, n, path = self.known, len(self.faults), []
        if i == n and s in self.ends:
            return ""
        stack = [[i, s, bound, iter(self.edits(i, s)), FAR, 0]]
        while stack:
            frame = stack[-1]
            left = frame[2]
            for edit, cost, j, t in frame[3]:
                need = cost + known[j][t]
                if need > left:
                    frame[4] = min(frame[4], need)
                    continue
                path.append(edit)
                if j == n and t in self.ends or not whole and j == self.solved:
                    return "".join(path)
                stack.append([j, t, left - cost, iter(self.edits(j, t)), FAR, cost])
                break
            else:
                i, s, _, _, least, cost = stack.pop()
                known[i][s] = max(known[i][s], least)
                if stack:
                    path.pop()
                    stack[-1][4] = min(stack[-1][4], cost + known[i][s])
        return None


def applied(audit: str, rows, s: int = 0):
    """(role, text) of the repaired rows, one by one; ``rows`` may be any iterator of (role, text)."""
    rows = iter(rows)
    for edit in audit:
        if edit == "I":
            s, role = WRITES[s]
            yield role, ""
            continue
        role, text = next(rows)
        if edit == "R":
            s, role = WRITES[s]
        elif edit == "K":
            s = AFTER[s][initial(role)]
        if edit != "D":
            yield role, text


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = ", ".join(f"{c} bigint" for c in COUNTS)


def repair(rows: DataFrame, longest: int = 20_000, piece: int = 4_096) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, repaired_sha256 per conversation.

    ``repaired`` is an array of (role, text), null for conversations of more than
    ``longest`` rows. Rows with a true ``dropped`` (if there is such a column)
    only name their conversation.
    """
    python_ready(rows.sparkSession)
    there = ~F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(True)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"),
                       blank("text").alias("text"), there.alias("there"))
    long_ids = kept_table(rows.groupBy("conv_id").agg(F.count_if("there").alias("n")).where(F.col("n") > longest)
                          .select(F.col("conv_id").alias("long_id")))
    n_long = long_ids.count()
    if not n_long:
        return _repair_short(rows)
    if n_long <= LONG_IDS:
        long_ids = F.broadcast(long_ids)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _repair_short(rows.join(long_ids, is_long, "left_anti"))
    return short.unionByName(_repair_long(rows.where("there").join(long_ids, is_long, "left_semi").drop("there"), piece),
                             allowMissingColumns=True)


def _repair_short(rows: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes)["conv_id"]
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.when(F.col("there"), F.struct("turn", "role", "text")))).alias("rows"))

    def run(batches):
        import pyarrow as pa

        lines = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for conversation in b.column(1).to_pylist():
                said, seen, faults = [(r["role"], r["text"]) for r in conversation], set(), []
                for pair in said:
                    faults.append(fault_of(pair[1], pair in seen))
                    seen.add(pair)
                turns = [r["turn"] for r in conversation if r["turn"] is not None]
                initials = "".join(initial(role) for role, _ in said)
                search = Search(initials, faults)
                audit = search.audit()
                for x, v in zip(out, (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                                      faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
                                      illegal_pairs(initials), search.known[0][0], audit,
                                      [{"role": a, "text": t} for a, t in applied(audit, said)])):
                    x.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.string()), pa.array(out[7], lines)],
                names=["conv_id", *COUNTS, "audit", "repaired"])

    done = whole.mapInArrow(run, f"conv_id {kind}, {_SUMMARY}, audit string, repaired array<struct<role: string, text: string>>")
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return done.withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n"), 256))


# ---------------------------------------------------------------- long conversations, in pieces

_PIECE = ("pos bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, least_turn bigint, "
          "most_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "costs array<bigint>, places array<int>, audits array<string>")


def _piece(rows: list[dict]) -> tuple:
    """Counts and, for state before * 4 + state after, cost, place among the ways from that state, and edits."""
    initials = "".join(initial(r["role"]) for r in rows)
    faults = [fault_of(r["text"], r["seen"]) for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    searches = [Search(initials, faults, (end,), trailing=False) for end in range(4)]
    audits = [searches[end].audit(0, s) for s in range(4) for end in range(4)]
    costs = [searches[end].known[0][s] for s in range(4) for end in range(4)]
    places = [sorted(filter(None, audits[k // 4 * 4:k // 4 * 4 + 4])).index(a) if a else 4 for k, a in enumerate(audits)]
    return (rows[0]["pos"], initials[0], initials[-1], rows[0]["turn"], rows[-1]["turn"], min(turns, default=None),
            max(turns, default=None), len(set(turns)), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
            illegal_pairs(initials), costs, places, audits)


def _way(pieces) -> tuple[int, list[int], str]:
    """Cheapest way through the pieces: its cost, the way taken in each piece, and the rows inserted at the end.

    Two ways to one state differ inside some piece, where the ASCII-lesser is
    ahead for good; so the few ways alive are kept in their order.
    """
    alive, back = {0: (0, 0)}, []          # state -> (cost, place among the ways alive)
    for costs, places in pieces:
        best: dict[int, tuple] = {}
        for s, (cost, place) in alive.items():
            for end in range(4):
                k = s * 4 + end
                if costs[k] < FAR:
                    best[end] = min(best.get(end, (FAR,)), (cost + int(costs[k]), place, int(places[k]), k))
        back.append({end: x[3] for end, x in best.items()})
        order = sorted(best, key=lambda e: best[e][1:3])
        alive = {end: (best[end][0], order.index(end)) for end in best}
    tails = {0: "", 1: "II", 2: "I", 3: ""}
    cost, _, s = min((c + 5 * len(tails[s]), place, s) for s, (c, place) in alive.items())
    tail, ways = tails[s], []
    for step in reversed(back):
        ways.append(step[s])
        s = step[s] // 4
    return cost, ways[::-1], tail


def _repair_long(rows: DataFrame, piece: int) -> DataFrame:
    import pandas as pd

    kind, tasks = dict(rows.dtypes)["conv_id"], partitions(rows.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys, "uid")
    placed = kept_table(dealt.drop("uid").sortWithinPartitions(*keys)).withColumn("pos", F.monotonically_increasing_id())
    same = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"),
                           F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = placed.withColumn("same", same)
    first = placed.groupBy("same").agg(F.min("pos").alias("first"))
    ready = kept_table(placed.join(first, "same").withColumn("seen", F.col("pos") > F.col("first"))
                       .select("conv_id", "pos", "turn", "role", "text", "seen")
                       .repartitionByRange(tasks, "pos").sortWithinPartitions("pos"))

    def cut(batches):
        import pyarrow as pa

        names = ["conv_id", *(f.split()[0] for f in _PIECE.split(", "))]
        types = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()),
                 "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
        types = [types[f.split()[1]] for f in _PIECE.split(", ")]
        held, of = [], None

        def out():
            return pa.RecordBatch.from_arrays([of, *(pa.array([v], t) for v, t in zip(_piece(held), types))], names=names)

        for b in batches:
            for k, row in enumerate(b.to_pylist()):
                if held and (len(held) == piece or held[0]["conv_id"] != row["conv_id"]):
                    yield out()
                    held = []
                if not held:
                    of = b.column(0).slice(k, 1)
                held.append(row)
        if held:
            yield out()

    pieces = kept_table(ready.mapInArrow(cut, f"conv_id {kind}, {_PIECE}"))

    def combine(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        cost, ways, tail = _way(zip(p["costs"], p["places"]))
        joints = illegal = 0
        last = None
        for x in p.itertuples():
            if last is not None:
                illegal += illegal_pairs(last.last_initial + x.first_initial)
                joints += last.last_turn is not None and last.last_turn == x.first_turn
            last = x
        least, most = p["least_turn"].min(), p["most_turn"].max()
        gaps = int(most - least + 1 - (p["turns"].sum() - joints)) if pd.notna(least) else 0
        counts = [gaps, *(int(p[c].sum()) for c in COUNTS[1:4]), int(p["illegal"].sum()) + illegal, cost]
        return pd.DataFrame({"pos": p["pos"], "way": ways, "tail": [""] * (len(p) - 1) + [tail],
                             "nth": range(len(p)), **{c: v for c, v in zip(COUNTS, counts)}})

    small = pieces.drop("audits").withColumn("conv", F.struct("conv_id"))   # a struct groups a null id, too
    chosen = small.groupBy("conv").applyInPandas(combine, f"pos bigint, way int, tail string, nth bigint, {_SUMMARY}")
    chosen = kept_table(chosen.join(pieces.select("conv_id", "pos", "audits"), "pos")
                        .withColumn("edits", F.concat(F.element_at("audits", F.col("way") + 1), "tail")).drop("audits"))
    summary = chosen.groupBy("conv_id").agg(
        *(F.max(c).alias(c) for c in COUNTS),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "edits"))), lambda x: x["edits"]), "").alias("audit"))

    lines = (chosen.select("conv_id", "pos", F.lit(0).alias("kind"), (F.col("way") / 4).cast("int").alias("state"), F.col("edits").alias("role"),
                           F.lit(None).cast("string").alias("text"))
             .unionByName(ready.select("conv_id", "pos", F.lit(1).alias("kind"), F.lit(0).alias("state"), "role", "text"))
             .repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "pos", "kind"))

    def digest(batches):
        """Streams the rows of a conversation past its edits; only one piece of edits is held."""
        import pyarrow as pa

        of = edits = None

        def out():
            return pa.RecordBatch.from_arrays([of, pa.array([edits.close()], pa.string())], names=["conv_id", "repaired_sha256"])

        for b in batches:
            for k, row in enumerate(b.to_pylist()):
                if edits is None or edits.conv_id != row["conv_id"]:
                    if edits is not None:
                        yield out()
                    of, edits = b.column(0).slice(k, 1), _Digest(row["conv_id"])
                edits.take(row)
        if edits is not None:
            yield out()

    digests = lines.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "digest_of")
    return summary.join(digests, F.col("conv_id").eqNullSafe(F.col("digest_of"))).drop("digest_of")


class _Digest:
    """sha256 of the repaired lines, from pieces of edits and the rows that follow each."""

    def __init__(self, conv_id):
        self.conv_id, self.hash, self.empty = conv_id, hashlib.sha256(), True
        self.edits, self.at, self.state = "", 0, 0

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state, role = WRITES[self.state]
            self.write(role, "")
            self.at += 1

    def take(self, row: dict) -> None:
        if row["kind"] == 0:
            self.inserts()
            self.edits, self.at, self.state = row["role"], 0, row["state"]
            return
        self.inserts()
        for role, text in applied(self.edits[self.at], [(row["role"], row["text"])], self.state):
            self.write(role, text)
            self.state = AFTER[self.state][initial(role)]
        self.at += 1

    def close(self) -> str:
        self.inserts()
        return self.hash.hexdigest()
