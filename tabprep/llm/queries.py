"""One query per operator over its whole table, with production parameters, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import (
    decontaminate, infill, jaccard, language, lines, periodic, personal, pieces, ppm, quality, rules, simhash, toxicity,
)
from tabprep.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_registry)


@query
def op1_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


@query
def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


@query
def op3_quality_classifier(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality_rules(spark, sf_dir):
    return rules.repetition_rules(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op7_pii(spark, sf_dir):
    return personal.personal_data(table(spark, sf_dir, "documents"))


@query
def op8_lm_scoring(spark, sf_dir):
    return ppm.language_model_scores(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark, sf_dir):
    return lines.deduplicate_lines(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.planted)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2("runs", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_fill_in_middle(spark, sf_dir):
    return infill.fill_in_middle(table(spark, sf_dir, "documents"))
