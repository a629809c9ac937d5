"""A training corpus from ``documents``: classify, apply rules, deduplicate, mix, pack.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last
returns one row per token piece with its place in a sequence. A document the mix takes several
times is several rows from then on, each packed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fm, mixing, ngram_join, packing, quality_rules
from tidemark.llm.store import stored
from tidemark.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    machine = fm.train(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return fm.reject(docs.select(*COLUMNS), machine)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are content by their lines.

    The field is fitted on labelled rows of the whole table: what the stage before has kept
    has hardly a bad line left to learn from.
    """
    field = quality_rules.train(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return quality_rules.keep(docs.select(*COLUMNS), field)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_copies(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram jaccard join", deduplicate),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

# A trained classifier, a Viterbi decoding and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's rows are written and read again."""
    docs = _documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
