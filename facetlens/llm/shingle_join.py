"""Operator 7: n-gram Jaccard join by a token-group matrix.

A document is its set of distinct word 5-shingles (64-bit hashes). Documents
with equal sets are one class. The join then finds, exactly, which classes are
connected by links of Jaccard similarity ``share / 100`` or more:

1. Shingles get one global order, rare ones first. Two linked sets share a
   shingle among the first ``n - ceil(share * n) + 1`` of each, so only those
   entries are shuffled, packed by shingle bucket.
2. Similar classes form groups: in every shingle's run the class that meets
   the shingle earliest is a leader, each class asks the leader it meets most
   often (at least half as often as linked sets of their sizes have to), and
   classes that full comparisons connect this way are one group. Many classes
   that ask the same leader in vain resemble each other too: they form mixed
   groups, whose members are not yet connected; a few of them stay alone.
   Large groups are cut into parts.
3. The matrix holds one row per shingle and group: the union of the entries of
   the group's members, with the largest rest of a member behind its first shared
   entry and the members' size range. A query set meets a group only through the
   matrix; the rests and sizes bound its overlap with any member. Groups it is
   already connected with are skipped; the members of a mixed group also ask
   their own group.
4. Only groups whose bound reaches the threshold are opened: the query is
   compared in full with the members it is not yet connected with.

Components of the links found are those of all links: a skipped pair was
already connected, and a pruned pair cannot reach the threshold. The cost of a
very common passage stays small because its shingles come last in the order.

Defined results: null texts and texts without words have ``n_shingles`` 0 and
their own ``doc_id`` as component; rows with a null ``doc_id`` are returned
with a null component and link nothing; rows that repeat a ``doc_id`` are
returned once each; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, partitions, python_ready
from .components import components
from .tokens import groups_by_size

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64((1 << 63) - 1)
_POWERS = np.array([1], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 64), np.uint64(0x100000001B3 | 1), np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes (63 bits), document after document, and set sizes."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    gap = _SPACE[b]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    n_docs = len(texts)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
    length = ends - starts
    first = np.cumsum(length) - length
    pos = np.arange(int(length.sum())) - np.repeat(first, length)
    word = np.add.reduceat((b[~gap].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[pos], first)
    word = _mix(word + length.astype(np.uint64) * _K)
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    words = np.bincount(doc, minlength=n_docs)
    h = word[:max(0, len(word) - width + 1)].copy()
    for k in range(1, width):
        h = _mix(h * _K + word[k:len(word) - width + 1 + k])
    ok = doc[:len(h)] == doc[width - 1:] if len(h) else np.zeros(0, bool)
    token, owner = h[ok] & _TOP, doc[:len(h)][ok]
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        at = np.cumsum(words) - words
        extra = []
        for d in short:
            s = np.uint64(words[d])
            for w in word[at[d]:at[d] + words[d]]:
                s = _mix(np.array([s]) * _M2 + w)[0]
            extra.append(s & _TOP)
        token = np.concatenate([token, np.array(extra, np.uint64)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        token, owner = token[order], owner[order]
    per = np.bincount(owner, minlength=n_docs)
    return _sorted_sets(token, per)


def _sorted_sets(token: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each document's values and drop repeats."""
    ends = np.cumsum(per)
    token = token.copy()
    for a, e in zip(ends - per, ends):
        token[a:e].sort()
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    new[(ends - per)[per > 0]] = True
    owner = np.repeat(np.arange(len(per)), per)
    return token[new], np.bincount(owner[new], minlength=len(per))


def _sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sum of each document's values modulo 2**64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]


def set_names(token: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each document's set."""
    salt = per.astype(np.uint64) * _K
    return (_mix(_sums(_mix(token + _K), per) + salt).view(np.int64),
            _mix(_sums(_mix(token ^ _M1), per) + salt).view(np.int64))


def frequency_order(token: np.ndarray, per: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort keys: rare shingles by hash, then the frequent ones by their rank."""
    key = token.copy()
    if len(often):
        at = np.minimum(np.searchsorted(often, token), len(often) - 1)
        known = often[at] == token
        key[known] = (np.uint64(1) << np.uint64(63)) | rank[at[known]].astype(np.uint64)
    ends = np.cumsum(per)
    for a, e in zip(ends - per, ends):
        key[a:e].sort()
    return key


def prefix_sizes(n: np.ndarray, share: int) -> np.ndarray:
    return np.where(n > 0, n - -(-share * n // 100) + 1, 0)


def _least_overlap(n, m, share: int):
    """Smallest intersection of linked sets of sizes n and m (as a float bound)."""
    return share * (n + m) / (100.0 + share)


def _least_shared(n, m, share: int):
    """Least common entries of the prefixes of linked sets of sizes n and m."""
    return _least_overlap(n, m, share) - share * np.maximum(n, m) / 100 - 1


def jaccard_components(docs: DataFrame, share: int = 75, width: int = 5, frequent: int = 200_000,
                       group_size: int = 64, broadcast_ids: int = 1_000_000,
                       bucket_rows: int = 250_000, mixed_from: int = 9, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    ``by_text`` adds ``text_key`` (hash of the text) and ``component`` (a hash that
    tells components apart whose documents share their smallest doc_id).

    ``frequent``: how many of the most frequent shingles get an exact rank (the
    order stays right without it, only slower). ``broadcast_ids``: ids of
    documents to compare are broadcast up to this count and shuffled beyond it.
    ``mixed_from``: so many classes form a mixed group; fewer meet one by one.
    """
    spark = docs.sparkSession
    python_ready(spark)
    parts = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches):
        import pyarrow as pa

        names = ["doc_id", "text_key", "n", "sid", "sid2", "token", "times"]
        held, size = [], 0

        def often_here():
            # shingles that this part of the corpus holds several times
            token = np.sort(np.concatenate(held))
            cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            times = np.diff(np.concatenate([cut, [len(token)]]))
            many = times >= 4
            k = int(many.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 5 + [
                pa.array(token[cut[many]].view(np.int64)), pa.array(times[many].astype(np.int64))], names=names)

        for b in batches:
            named_ = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
            for ids, some in groups_by_size(named_, b.column(1).to_pylist(), 2_000_000):
                token, per = shingle_sets(some, width)
                a, c = set_names(token, per)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], pa.int64()), pa.array([k for _, k in ids], pa.int64()),
                                                  pa.array(per), pa.array(a), pa.array(c)]
                                                 + [pa.nulls(len(ids), pa.int64())] * 2, names=names)
                held.append(token)
                size += len(token)
                if size >= 4_000_000:
                    yield often_here()
                    held, size = [], 0
        if size:
            yield often_here()

    first = kept_table(texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(
        describe, "doc_id bigint, text_key bigint, n bigint, sid bigint, sid2 bigint, token bigint, times bigint"))
    rows = first.where("token is null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "sid", "sid2")
    live = rows.where("n_shingles > 0 and doc_id is not null")
    classes = kept_table(live.groupBy("sid", "sid2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # the most frequent shingles of all documents: a bounded list
    ranks = (first.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
             .orderBy(F.desc("times"), "token").limit(frequent).toPandas().sort_values(["times", "token"]))
    often = ranks["token"].to_numpy(np.int64).astype(np.uint64)
    place = np.argsort(often, kind="stable")
    order_list = spark.sparkContext.broadcast((often[place], place.astype(np.uint32)))
    entries = live.agg(F.sum(F.col("n_shingles") * (100 - share) / 100 + 2).alias("n")).head()["n"] or 0
    buckets = max(2 * parts, int(entries // bucket_rows) + 1)

    def prefixes(batches):
        import pyarrow as pa

        often_, rank_ = order_list.value
        done: set = set()
        for b in batches:
            for ids, some in groups_by_size(b.column(0).to_pylist(), b.column(1).to_pylist(), 4_000_000):
                token, per = shingle_sets(some, width)
                sid, _ = set_names(token, per)
                if len(done) > 200_000:
                    done.clear()
                use = np.zeros(len(per), bool)  # a copy met before in this task adds nothing
                for i, s in enumerate(sid.tolist()):
                    if ids[i] is not None and per[i] and s not in done:
                        use[i] = True
                        done.add(s)
                key = frequency_order(token, per, often_, rank_)
                ends = np.cumsum(per)
                owner = np.repeat(np.arange(len(per)), per)
                pos = np.arange(len(key)) - (ends - per)[owner]
                pick = use[owner] & (pos < prefix_sizes(per, share)[owner])
                key, owner, pos = _mix(key[pick]), owner[pick], pos[pick]
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                filled = np.flatnonzero(np.diff(cuts))
                payload = []
                for k in filled:
                    at = by[cuts[k]:cuts[k + 1]]
                    o = owner[at]
                    wide = 2 if per[o].max() < 1 << 16 else 4   # bytes of a size or place
                    payload.append(bytes([wide]) + (key[at] >> np.uint64(32)).astype("<u4").tobytes()
                                   + sid[o].astype("<i8").tobytes() + per[o].astype(f"<u{wide}").tobytes()
                                   + pos[at].astype(f"<u{wide}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(payload, pa.binary())],
                                                 names=["bucket", "payload"])

    def shared_runs(pdf):
        import pandas as pd

        tok, sid, n, pos = [], [], [], []
        for p in pdf["payload"]:
            wide = p[0]
            k = len(p) // (12 + 2 * wide)
            tok.append(np.frombuffer(p, "<u4", k, 1))
            sid.append(np.frombuffer(p, "<i8", k, 1 + 4 * k))
            n.append(np.frombuffer(p, f"<u{wide}", k, 1 + 12 * k))
            pos.append(np.frombuffer(p, f"<u{wide}", k, 1 + (12 + wide) * k))
        tok, sid, n, pos = (np.concatenate(x) for x in (tok, sid, n, pos))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        some = np.argsort(tok, kind="stable")      # most shingles occur once: drop them first
        t = tok[some]
        alone = np.ones(len(t), bool)
        alone[1:] &= t[1:] != t[:-1]
        alone[:-1] &= t[1:] != t[:-1]
        some = some[~alone]
        tok, sid, n, pos = tok[some], sid[some], n[some], pos[some]
        o = np.lexsort((pos, sid, tok))
        tok, sid, n, pos = tok[o], sid[o], n[o], pos[o]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
        tok, sid, n, pos = tok[new], sid[new], n[new], pos[new]
        o = np.lexsort((sid, n, pos, tok))
        tok, sid, n, pos = tok[o], sid[o], n[o], pos[o]
        if not len(tok):
            return pd.DataFrame({"token": [], "sid": [], "n": [], "rest": [], "leader": [], "needed": [], "least": []})
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.concatenate([start, [len(tok)]]))
        lead = np.repeat(start, size)
        rest = n - pos
        near = 100 * np.minimum(n, n[lead]) >= share * np.maximum(n, n[lead])
        fits = near & (np.minimum(rest, rest[lead]) >= _least_overlap(n, n[lead], share)) & (lead != np.arange(len(tok)))
        leader = np.where(fits, sid[lead], sid)
        # linked sets of sizes n and m share so many entries of their prefixes (one less allows for two
        # shingles with one 32-bit name): most for equal sizes, fewest for the smallest or largest m in reach
        needed = _least_shared(n, n[lead], share)
        run, span = np.repeat(np.arange(len(size)), size), int(n.max()) + 1
        own = run * span + n
        by_size = np.sort(own)
        a = np.searchsorted(by_size, run * span - (-share * n // 100))
        b = np.searchsorted(by_size, run * span + np.minimum(100 * n // share, span - 1), "right") - 1
        keep = a < b   # others in reach: an entry without them is settled
        small, large = (by_size[np.where(keep & (by_size[x] == own), x + d, x)] - run * span for x, d in ((a, 1), (b, -1)))
        least = np.floor(np.minimum(_least_shared(n, small, share), _least_shared(n, large, share)))
        token = int(pdf["bucket"].iloc[0]) << 32 | tok.astype(np.int64)
        return pd.DataFrame({"token": token[keep], "sid": sid[keep], "n": n[keep], "rest": rest[keep],
                             "leader": leader[keep], "needed": needed[keep],
                             "least": least[keep].astype(np.int64)})

    runs = kept_table(texts.mapInArrow(prefixes, "bucket int, payload binary").groupBy("bucket").applyInPandas(
        shared_runs, "token bigint, sid bigint, n bigint, rest bigint, leader bigint, needed double, least int"))

    rep = classes.select("sid", F.col("rep").alias("doc_id"))

    def open_groups(asks: DataFrame, members: DataFrame, at_once: int) -> DataFrame:
        """Links (q, m) that connect every asking class (q, gid) with the members (m, gid, tie) it links to.

        Members of one ``tie`` are connected already. The sets are made from the
        texts again and sent where they are compared: one task compares about
        ``at_once`` queries with one group.
        """
        cuts = kept_table(asks.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / at_once).alias("cuts")))
        a = asks.join(cuts, "gid").select(F.col("q").alias("sid"), "gid", F.pmod(F.xxhash64("q"), "cuts").alias("part"),
                                          F.lit(None).cast("bigint").alias("tie"))
        m = members.join(cuts, "gid").select(F.col("m").alias("sid"), "gid", F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("part"), "tie")
        roles = kept_table(a.union(m).join(rep, "sid").groupBy("sid", "doc_id", F.floor(F.col("part") / 1000))
                           .agg(F.collect_list(F.struct("gid", "part", F.col("tie").isNotNull().alias("member"), "tie")).alias("roles"))
                           .select("doc_id", "sid", "roles"))
        wanted = F.broadcast(roles) if roles.count() <= broadcast_ids else roles

        def send(batches):
            import pyarrow as pa

            for b in batches:
                sids, roles_ = b.column("sid").to_pylist(), b.column("roles").to_pylist()
                for some, texts_ in groups_by_size(list(range(b.num_rows)), b.column("text").to_pylist(), 2_000_000):
                    token, per = shingle_sets(texts_, width)
                    name, _ = set_names(token, per)
                    ends = np.cumsum(per)
                    out: tuple = ([], [], [], [], [], [])
                    for i, own, a, e in zip(some, name.tolist(), ends - per, ends):
                        if own != sids[i]:   # another text under the same doc_id
                            continue
                        raw = token[a:e].tobytes()
                        for r in roles_[i]:
                            for x, v in zip(out, (r["gid"], r["part"], r["member"], r["tie"], own, raw)):
                                x.append(v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()),
                         pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())],
                        names=["gid", "part", "member", "tie", "sid", "tokens"])

        def compare(pdf):
            import pandas as pd

            inside = pdf["member"].to_numpy(bool)
            sid, root, members, tied = pdf["sid"].tolist(), {}, [], {}

            def top(s):
                while root.setdefault(s, s) != s:
                    s = root[s]
                return s

            for i in np.flatnonzero(inside):
                first = tied.setdefault(pdf["tie"].iloc[i], sid[i])
                root[top(sid[i])] = top(first)
                members.append((sid[i], np.frombuffer(pdf["tokens"].iloc[i], np.uint64)))
            found = []
            for i in np.flatnonzero(~inside):
                x, q = np.frombuffer(pdf["tokens"].iloc[i], np.uint64), sid[i]
                for m, y in members:
                    if 100 * min(len(x), len(y)) < share * max(len(x), len(y)) or top(q) == top(m):
                        continue
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= share * (len(x) + len(y) - both):
                        found.append((q, m))
                        root[top(q)] = top(m)
            return pd.DataFrame(found, columns=["q", "m"], dtype="int64")

        sent = texts.join(wanted, "doc_id").select("sid", "roles", "text").mapInArrow(
            send, "gid bigint, part bigint, member boolean, tie bigint, sid bigint, tokens binary")
        return kept_table(sent.groupBy("gid", "part").applyInPandas(compare, "q bigint, m bigint"))

    liked = kept_table(runs.where("leader <> sid").groupBy("sid", "leader")
                       .agg(F.count(F.lit(1)).alias("times"), F.first("needed").alias("needed")).where("8 * times >= needed")
                       .groupBy("sid").agg(F.max_by(F.struct(F.col("leader").alias("gid"), (2 * F.col("times") >= F.col("needed")).alias("asks")),
                                                    F.struct("times", "leader")).alias("best"))
                       .select(F.col("sid").alias("q"), "best.*"))
    # a class that meets its leader less often does not ask: what it links to is found through the matrix
    best = liked.where("asks").select("q", "gid")
    joined = open_groups(best, best.select(F.col("gid").alias("m"), "gid", F.col("gid").alias("tie")).distinct(), 64)

    # groups: the classes that links to leaders connect; of the others, those that leaders bring together
    group = kept_table(components(joined.select(F.col("q").alias("a"), F.col("m").alias("b")))
                       .select(F.col("node").alias("sid"), F.col("label").alias("group")))
    alike = (components(liked.select(F.col("q").alias("a"), F.col("gid").alias("b")))
             .select(F.col("node").alias("sid"), F.col("label").alias("kin")))
    each = (runs.groupBy("sid").agg(F.max("n").alias("n"), F.max("rest").alias("first_rest"), F.count(F.lit(1)).alias("entries"))
            .join(group, "sid", "left").join(alike, "sid", "left")
            .withColumn("mixed", F.col("group").isNull())
            .withColumn("kin", F.coalesce("group", "kin", "sid")))
    cuts = (each.groupBy("kin", "mixed").agg(F.count(F.lit(1)).alias("size"))
            .withColumn("alone", F.col("mixed") & (F.col("size") < mixed_from))
            .withColumn("cuts", F.ceil(F.col("size") / group_size))
            .withColumn("size", F.when(F.col("alone"), F.lit(1).cast("bigint"))
                        .when(F.col("mixed"), F.floor(F.col("size") / F.col("cuts"))).otherwise(F.col("size"))))
    gid = (F.when(F.col("alone"), F.xxhash64("mixed", "sid"))
           .when((F.col("cuts") > 1) | F.col("mixed"), F.xxhash64("kin", "mixed", F.pmod(F.xxhash64("sid"), "cuts"))))
    # of two groups the one with fewer classes asks: few queries meet the few unions of a large group
    place = F.struct("size", F.when(F.col("mixed"), F.col("gid")).otherwise(F.col("kin")).alias("name"))
    named = kept_table(each.join(cuts, ["kin", "mixed"]).withColumn("gid", gid.otherwise(F.col("kin"))).select(
        "sid", "n", "first_rest", "entries", "gid", "mixed", "alone", place.alias("group"), F.coalesce("group", "sid").alias("tie")))
    bounds = kept_table(named.groupBy("gid").agg(
        F.first("group").alias("other"), F.max("first_rest").alias("most"), F.min("n").alias("low"),
        F.max("n").alias("high"), (F.first("mixed") & (F.count(F.lit(1)) > 1)).alias("open")))
    # an entry is settled, too, if the class has fewer entries than a link to any class met there needs
    entry = kept_table(runs.select("token", "sid", "least").join(named.select("sid", "n", "first_rest", "entries", "group", "gid"), "sid")
                       .where("least <= entries").drop("least", "entries"))
    matrix = entry.select("token", "gid").distinct().join(bounds, "gid")
    low = F.greatest(F.col("low"), share * F.col("n") / 100)
    high = F.least(F.col("high"), 100 * F.col("n") / share)
    # with a member of m shingles a linked query shares the first overlap - share * max(n, m)
    # entries of both prefixes; one less allows for two shingles with one 32-bit name
    needed = F.least(_least_overlap(F.col("n"), low, share) - share * F.col("n") / 100,
                     _least_overlap(F.col("n"), high, share) - share * high / 100) - 1
    open_ = (entry.join(matrix.withColumnRenamed("gid", "at"), "token")
             .where(((F.col("group") < F.col("other")) | ((F.col("group") == F.col("other")) & F.col("open"))) & (100 * F.col("n") >= share * F.col("low"))
                    & (100 * F.col("high") >= share * F.col("n"))
                    & (F.least("first_rest", "most") >= _least_overlap(F.col("n"), low, share)))
             .groupBy(F.col("sid").alias("q"), F.col("at").alias("gid"), needed.alias("needed"))
             .agg(F.count(F.lit(1)).alias("shared")).where("shared >= needed").select("q", "gid"))
    # classes that met as one asked the other have been compared
    met = best.union(best.select("gid", "q")).toDF("q", "sid").join(named.where("alone").select("sid", "gid"), "sid")
    open_ = kept_table(open_.join(met.select("q", "gid").distinct(), ["q", "gid"], "left_anti"))
    asked = open_.select("gid").distinct()
    links = joined.union(open_groups(open_, named.join(asked, "gid").select(F.col("sid").alias("m"), "gid", "tie"),
                                     4 * group_size))

    # classes as nodes, ordered by their smallest document and told apart by their set
    node = rep.select("sid", F.struct("doc_id", "sid").alias("node"))
    edges = (links.join(node.select(F.col("sid").alias("q"), F.col("node").alias("a")), "q")
             .join(node.select(F.col("sid").alias("m"), F.col("node").alias("b")), "m").select("a", "b"))
    found = components(edges).select(F.col("node.sid").alias("sid"), "label")
    shared = kept_table(classes.join(found, "sid", "left").where("copies > 1 or label is not null")
                        .select("sid", "sid2", F.coalesce("label.doc_id", "rep").alias("shared"),
                                F.coalesce("label.sid", "sid").alias("component")))
    out = rows.join(shared, ["sid", "sid2"], "left")
    more = ["text_key", F.coalesce("component", "sid").alias("component")] if by_text else []
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0),
                                                     F.coalesce("shared", "doc_id"))
                      .otherwise(F.col("doc_id")).alias("component_id"), *more)
