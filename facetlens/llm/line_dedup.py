"""Operator 5: line dedup by a log-template tree.

Two kinds of lines are dropped from all documents:

* lines that are literally equal (but for white space) in ``least_same`` documents,
* lines of a template met in ``least_docs`` documents. Lines are parsed by a tree
  of fixed depth: the first level is the number of tokens, the next levels are the
  leading tokens; a token with a digit or an ``@`` counts as a variable field from
  the start. In every leaf that enough documents reach, a token at a position is
  constant if enough documents have it there, and a variable field otherwise, which
  turns the leaf's lines into templates. A template needs a ``similarity`` share of
  constant tokens.

Documents are counted as distinct texts, so the copies of one text count once, and
so do several lines of one text. Texts are scanned for the keys of their lines, keys
are counted and joined in Spark, and every text meets the keys of the lines it loses
by its hash; texts with many copies are salted. Keys are broadcast up to
``keys_at_once`` and shuffled beyond that.

Defined results: a null text stays null and has no lines; blank lines and lines
under ``least_tokens`` tokens stay; a null ``doc_id`` is kept; rows are cleaned one
by one and repeated rows all returned; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, kept_table, partitions, python_ready

FIELD = "<*>"
_VARIABLE = re.compile(r"\S*[0-9@]\S*")
_HAS = re.compile(r"[0-9@]")


def parse(line: str) -> list[str]:
    """Tokens of a line with its evident variable fields replaced."""
    return (_VARIABLE.sub(FIELD, line) if _HAS.search(line) else line).split()


def leaf_of(tokens: list[str], depth: int) -> str:
    return "\0".join([str(len(tokens)), *tokens[:depth]])


def key_of(text: str) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))).astype(np.int64))


def _few(keys: DataFrame, most: int) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= most else keys


def _lines_with(lines: DataFrame, counts: DataFrame, keys: DataFrame, on: str, most: int) -> DataFrame:
    """(doc, same) of ``lines`` whose ``on`` is among ``keys``; ``counts`` (on, n) tells the keys too frequent to shuffle."""
    if keys.count() <= most:
        return lines.join(F.broadcast(keys), on, "left_semi").select("doc", "same")
    hot = kept_table(hot_keys(counts, on, lines.count(), partitions(lines.sparkSession)).select(on))
    return (lines.join(F.broadcast(hot.join(keys, on, "left_semi")), on, "left_semi")
            .union(lines.join(F.broadcast(hot), on, "left_anti").join(keys, on, "left_semi")).select("doc", "same"))


def _met(shapes: DataFrame, lines: DataFrame, by: list[str], least: int) -> DataFrame:
    """Values of ``by`` that the lines of ``least`` documents have; ``shapes`` has (*by, key, documents).

    Lines of one text may share a value, so sums of documents only bound the count
    from above and the most frequent line bounds it from below; what lies between is
    counted, and its lines are all rare.
    """
    sums = kept_table(shapes.groupBy(*by).agg(F.sum("documents").alias("most"), F.max("documents").alias("fewest"))
                      .where(F.col("most") >= least))
    unsure = shapes.join(sums.where(F.col("fewest") < least).select(*by), by, "left_semi").select(*by, "key")
    counted = (unsure.join(lines.select("key", "doc"), "key").select(*by, "doc").distinct()
               .groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    return kept_table(sums.where(F.col("fewest") >= least).select(*by).union(counted.select(*by)))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("doc"))


def _meet(texts: DataFrame, copies: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Join by ``doc``; rows of texts with many copies are spread by a salt."""
    spread = texts.join(F.broadcast(copies), "doc", "left").withColumn("salt", F.when(F.col("n_salts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("n_salts")).cast("int"))).drop("n_salts")
    each = (side.join(F.broadcast(copies), "doc", "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1))).drop("n_salts"))
    return spread.join(each, ["doc", "salt"], how).drop("salt")


def _copies(texts: DataFrame) -> DataFrame:
    counts = kept_table(texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return kept_table(hot_keys(counts, "doc", texts.count(), partitions(texts.sparkSession)))


def line_keys(texts: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """(doc, same, key, leaf) of every distinct line of every distinct text: keys of the literal line, its parsed
    form and its leaf."""
    least_tokens = max(1, least_tokens)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out: tuple = ([], [], [], [])
            for doc, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                for same in {" ".join(x.split()) for x in (t or "").split("\n")}:
                    p = parse(same)
                    if len(p) >= least_tokens:
                        k = key_of(same)
                        line = " ".join(p)
                        for x, v in zip(out, (doc, k, k if line == same else key_of(line), key_of(leaf_of(p, depth)))):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc", "same", "key", "leaf"])

    return kept_table(texts.select("doc", "text").mapInArrow(run, "doc bigint, same bigint, key bigint, leaf bigint")
                      .distinct())


def recurring_lines(texts: DataFrame, copies: DataFrame, lines: DataFrame, least_docs: int, depth: int,
                    similarity: float, keys_at_once: int) -> DataFrame:
    """(key, template): parsed lines whose template occurs in ``least_docs`` documents."""
    leaves = kept_table(lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") >= least_docs).select("leaf"))
    parsed = (lines.select("leaf", "key", "doc").distinct().groupBy("leaf", "key")
              .agg(F.count(F.lit(1)).alias("documents"), F.min("doc").alias("doc")))
    known = kept_table(parsed.join(_few(leaves, keys_at_once), "leaf", "left_semi"))

    def tokens(batches):
        import pyarrow as pa

        for b in batches:
            keys, found = [], []
            for t, want in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                left = set(want)
                for p in map(parse, set(t.split("\n"))):
                    k = key_of(" ".join(p))
                    if k in left:
                        left.discard(k)
                        keys.append(k)
                        found.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                                             names=["key", "tokens"])

    wanted = known.groupBy("doc").agg(F.collect_list("key").alias("wanted"))
    spelled = (_meet(texts, copies, wanted, "inner").select("text", "wanted")
               .mapInArrow(tokens, "key bigint, tokens array<string>").groupBy("key").agg(F.first("tokens").alias("tokens")))
    words = kept_table(known.join(spelled, "key").select(
        "leaf", "key", "documents", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "word")))
    constant = (_met(words.where(F.col("word") != FIELD).select("leaf", "at", "word", "key", "documents"), lines,
                     ["leaf", "at", "word"], least_docs).withColumn("fixed", F.lit(True)))
    shaped = kept_table(
        words.join(constant, ["leaf", "at", "word"], "left").groupBy("leaf", "key", "documents", "n")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("word")).otherwise(FIELD)
                                                  .alias("word")))).alias("w"),
             F.count("fixed").alias("fixed"))
        .where(F.col("fixed") >= similarity * F.col("n"))
        .select("key", "documents", F.concat_ws(" ", F.col("w.word")).alias("template"))
        .withColumn("t", F.xxhash64("template")))
    often = _met(shaped.select("t", "key", "documents"), lines, ["t"], least_docs)
    return shaped.join(often, "t", "left_semi").select("key", "template")


def drop_recurring_lines(docs: DataFrame, least_docs: int = 10, depth: int = 3, similarity: float = 0.5,
                         least_tokens: int = 4, keys_at_once: int = 2_000_000,
                         least_same: int | None = None) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_dropped. ``least_same`` is ``least_docs`` unless given."""
    python_ready(docs.sparkSession)
    texts = _texts(docs)
    copies = _copies(texts)
    lines = line_keys(texts, depth, least_tokens)
    counts = kept_table(lines.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    literal = (counts if (least_same or least_docs) > 1 else lines.groupBy("same").agg(F.count(F.lit(1)).alias("n")))
    same = kept_table(literal.where(F.col("n") >= (least_same or least_docs)).select("same"))
    keys = kept_table(recurring_lines(texts, copies, lines, least_docs, depth, similarity, keys_at_once)
                      .select("key").distinct())
    per_key = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    lost = (_lines_with(lines, counts, same, "same", keys_at_once)
            .union(_lines_with(lines, per_key, keys, "key", keys_at_once)))
    gone = kept_table(lost.groupBy("doc").agg(F.collect_set("same").alias("gone")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts_, n_lines, dropped = [], [], []
            for t, keys_ in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                all_lines = [] if t is None else t.split("\n")
                out = all_lines
                if keys_:
                    drop = set(keys_)
                    out = [x for x in all_lines if key_of(" ".join(x.split())) not in drop]
                texts_.append(None if t is None else "\n".join(out))
                n_lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(out))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(texts_, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return (_meet(texts, copies, gone, "left").select("doc_id", "text", "gone")
            .mapInArrow(run, "doc_id bigint, text string, n_lines bigint, n_dropped bigint"))
