"""Whole jobs: the curation of a corpus, its evaluation, and a training set, each as one plan. Splits and reports run counting jobs while the
plan is built."""

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import curation, evaluate, prepare
from ..sources import records


@dataclass
class Curated:
    train: DataFrame
    test: DataFrame
    funnel: DataFrame
    totals: DataFrame
    statuses: DataFrame


def check_corpus(spark: SparkSession, folders: list[str], tool: str, checker: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Read a corpus, tag each record with its file, and check every command."""
    corpus = records.read_corpus(spark, *folders).drop("status", "error")
    return curation.validate(
        curation.gate_commands(curation.tag_with_file(corpus), tool), checker
    )


def curate(main: DataFrame, repaired: DataFrame, tool: str, key: str, fraction: float = 0.1, seed: int = 0) -> Curated:
    """Admit usable records of both corpora, split off the test part, and report the funnel."""
    per_command = curation.funnel(main, repaired, tool)
    train, test = curation.holdout_split(curation.admit(main, repaired, tool), key, fraction, seed)
    return Curated(
        train,
        test,
        per_command,
        curation.funnel_totals(per_command),
        curation.distinct_statuses(curation.concatenate(main, repaired)),
    )


def evaluate_model(cases: DataFrame, model, embedder, **settings) -> DataFrame:
    """Generate an answer to each test prompt and score it against the expected response."""
    return evaluate.score_answers(evaluate.generate(cases, model, **settings), embedder)


def training_tokens(df: DataFrame, tokenizer, key: str, seed: int = 42) -> DataFrame:
    """Records in template form, tokenised, in a seeded order."""
    texts = df.select(key, prepare.render_record().alias("text"))
    return curation.shuffle_rows(prepare.tokenise(texts, tokenizer), key, seed)
