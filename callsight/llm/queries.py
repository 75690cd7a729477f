"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm import chosenpath, classifier, debruijn, decontam, eliasfano, lexical, licenses, lines, packing, periods, repetition, simhash, warc
from callsight.llm.common import table
from callsight.session import scratch_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = debruijn.dedup_substrings(table(spark, sf_dir, "documents"), k=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), wrapped=True).drop("blocks")


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_deleted", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op7_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    eliasfano.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return eliasfano.read_token_files(spark, path)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.scores(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, single = scratch_path(spark, "warc-streams"), scratch_path(spark, "warc-members")
    written = warc.write_archives(table(spark, sf_dir, "pages"), found)
    normalised = warc.normalise_archives(written, found, single)
    return warc.read_archives(normalised, single).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(table(spark, sf_dir, "documents"), exponent=4, shortest=6, order=periods.planted, details=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_vector_packing, op3_license_scan, op4_repetition_rules, op5_decontamination,
        op6_line_winnowing, op7_elias_fano, op8_simhash, op9_quality_classifier, op10_warc, op11_chosen_path, op12_ranked_search,
        op13_periodic_runs,
    )
}
ORACLE: dict[str, str] = {"op11_chosen_path": chosenpath.oracle(shingle=4, percent=80), "op12_ranked_search": lexical.oracle(k=50)}
