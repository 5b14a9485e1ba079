"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup as _exact
from . import hard_negatives as _hard
from . import topk as _topk
from .byte_bpe import decode_ids, encode_texts
from .common import read, shared_path
from .conversation_repair import damaged, repair
from .language import identify_language
from .line_dedup import drop_recurring_lines
from .packing import pack
from .pieces import piece_round_trip
from .quality import classify_quality
from .shingle_join import jaccard_components
from .token_store import read_store, write_store
from .toxicity import classify_toxicity


def op1_pieces(spark, sf_dir):
    return piece_round_trip(read(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_store(spark, sf_dir):
    path = shared_path(spark, "token-store")
    write_store(read(spark, sf_dir, "documents"), path)
    return read_store(spark, path)


def op4_toxicity(spark, sf_dir):
    return classify_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_line_templates(spark, sf_dir):
    """Digest of the cleaned texts; the operator itself returns the texts."""
    out = drop_recurring_lines(read(spark, sf_dir, "documents"), least_docs=3, least_tokens=1, least_same=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("bigint").alias("n_chars_kept"),
                      F.sha2("text", 256).alias("text_sha256"))


def op6_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


def op7_jaccard(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(read(spark, sf_dir, "documents"))


def op9_top_k(spark, sf_dir):
    return _topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language(spark, sf_dir):
    return identify_language(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    """Every seventh label is wrong by one class, as in mislabelled training data."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return _hard.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_byte_bpe(spark, sf_dir):
    """Digests of the ids and of the bytes decoded from them."""
    out = decode_ids(encode_texts(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark, sf_dir):
    """Repairs damaged conversations; the operator itself returns the repaired rows, too."""
    out = repair(damaged(read(spark, sf_dir, "conversations")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES = {f.__name__: f for f in (op1_pieces, op2_quality, op3_token_store, op4_toxicity, op5_line_templates,
                                   op6_packing, op7_jaccard, op8_exact_dedup, op9_top_k, op10_language,
                                   op11_hard_negatives, op12_byte_bpe, op13_conversation_repair)}
SQL = {"op8_exact_dedup": _exact.SQL, "op9_top_k": _topk.SQL, "op11_hard_negatives": _hard.SQL}
