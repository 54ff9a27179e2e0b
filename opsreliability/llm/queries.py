"""Queries over the given tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsreliability.llm import (collocations, decontaminate, fim, license_scan, line_dedup, neighbours, packing,
                                pii, quality_rules, sharding, simhash, substring_dedup, toxicity)
from opsreliability.llm.checks import ORACLE  # noqa: F401
from opsreliability.llm.common import result


def _docs(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_simhash(spark, folder):
    g = simhash.simhash_groups(_docs(spark, folder), words=3, max_bits=2)
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_packing(spark, folder):
    return result(packing.pack(_docs(spark, folder)), doc_id="long", piece="int", start="long",
                  length="long", ids_crc32="long", sequence_id="long", offset="long")


def op3_line_dedup(spark, folder):
    out = line_dedup.dedup_lines(_docs(spark, folder), with_text=False)
    return result(out, doc_id="long", n_lines="long", n_dropped="long", kept_sha256="string")


def op4_substring_dedup(spark, folder):
    out = substring_dedup.dedup_substrings(_docs(spark, folder), with_text=False)
    return result(out, doc_id="long", n_words="long", n_removed="long", kept_sha256="string")


def op5_toxicity(spark, folder):
    docs, labels = _docs(spark, folder), _docs(spark, folder, "labels")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    model = toxicity.fit(docs, labels.filter(~held))
    out = toxicity.score(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_license_scan(spark, folder):
    out = license_scan.scan(_docs(spark, folder))
    return result(out, doc_id="long", n_words="long", n_base="long", first_word="long",
                  last_word="long", base_labels="string", labels="string", score="double")


def op7_sharding(spark, folder):
    out = sharding.shard(_docs(spark, folder), shards=8)
    return result(out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None)),
                  doc_id="long", size="long", text_crc32="long", law="string", shard="int",
                  slot="long", grown_shard="int")


def op8_decontamination(spark, folder):
    h = decontaminate.hits(_docs(spark, folder), _docs(spark, folder, "benchmark"))
    return h.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


def op9_pii(spark, folder):
    out = pii.find(_docs(spark, folder))
    return result(out, doc_id="long", n_email="long", n_ip="long", n_card="long", n_phone="long",
                  base_sha256="string", spans="string")


def op10_quality_rules(spark, folder):
    out = quality_rules.judge(_docs(spark, folder))
    return result(out, doc_id="long", n_words="long", word_chars="long", n_symbols="long",
                  n_dup_lines="long", n_repeat_words="long", base_failed="boolean", kept="boolean")


def op11_fill_in_middle(spark, folder):
    out = fim.fill_in_middle(_docs(spark, folder), with_text=False)
    return result(out, doc_id="long", n="long", form="string", prefix_chars="long", middle_chars="long",
                  output_sha256="string", restored_sha256="string")


def op12_nearest_neighbours(spark, folder):
    out = neighbours.nearest(_docs(spark, folder, "embeddings"), F.col("id") % 50 == 0)
    return result(out, query_id="long", rank="int", vec_id="long", score="double")


def op13_collocations(spark, folder):
    out = collocations.collocations(_docs(spark, folder))
    return result(out, lang="string", rank="long", phrase="string", a="long", l="long", r="long", n="long",
                  score="long")


def pipeline(spark, folder):
    return import_module("corpus_pipeline").run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_line_dedup, op4_substring_dedup,
                                   op5_toxicity, op6_license_scan, op7_sharding,
                                   op8_decontamination, op9_pii, op10_quality_rules, op11_fill_in_middle,
                                   op12_nearest_neighbours, op13_collocations, pipeline)}
