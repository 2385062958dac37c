"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import Tables
from . import bpe, exact_dedup, html_text, langid, mixing, order_minhash, periodic, pii, secrets_scan, simhash, spelling, topk, urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return Tables(spark, sf_dir).documents


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return html_text.extract(Tables(spark, sf_dir).pages)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(_documents(spark, sf_dir))


# The rules of the query, and listed sites for urls that no rule fits.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URL_LIST = [f"{site}.example.{top}/" for site in ("adult-x", "casino-win") for top in ("com", "net", "org")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    rows = [(k, v, True) for k, v in URL_RULES] + [(k, "block", False) for k in URL_LIST]
    return urls.judge(Tables(spark, sf_dir).pages, spark.createDataFrame(rows, "key string, verdict string, is_rule boolean"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_study(_documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.find_secrets(_documents(spark, sf_dir), _tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), _tokenizer_file("word_bpe_49k.json"), digests=True)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def drop_letter(doc_id: int | None, run: str) -> str:
    """The contract's planted deletion: one code point, where 97 divides the checksum."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 97 else run[:at] + run[at + 1:]


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir), change=drop_letter)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted period: in a tenth of the documents the words from
    one on repeat."""
    n = len(words)
    g, tenth = divmod(zlib.crc32(str("" if doc_id is None else doc_id).encode()), 10)
    if tenth or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic(_documents(spark, sf_dir), change=repeat_tail).withColumnRenamed("id", "doc_id")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return topk.search(Tables(spark, sf_dir).embeddings, F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_pii, op2_source_mix, op3_html_text, op4_exact_dedup, op5_secrets, op6_url_filter, op7_order_minhash, op8_bpe, op9_language, op10_simhash,
                                      op11_spelling, op12_periodic_runs, op13_topk)}
