"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinstone.llm import ball_tree, bpe, decontaminate, exponion, fingerprints, mixing, quality, secrets, shards, simhash, suffix_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_divergence_rules": quality.query,
        "op2_randomness_battery": secrets.query,
        "op3_suffix_factors": suffix_dedup.query,
        "op4_prefix_fingerprints": fingerprints.query,
        "op5_hypergeometric_tree": mixing.query,
        "op6_byte_bpe": bpe.query,
        "op7_balanced_labels": shards.query,
        "op8_warc_salvage": warc.query,
        "op9_toxicity_zstd": toxicity.query,
        "op10_simhash_gray": simhash.query,
        "op11_winnowing": decontaminate.query,
        "op12_ball_tree": ball_tree.query,
        "op13_exponion": exponion.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_divergence_rules": quality.SQL,
        "op3_suffix_factors": suffix_dedup.SQL,
        "op5_hypergeometric_tree": mixing.SQL,
        "op8_warc_salvage": warc.SQL,
        "op11_winnowing": decontaminate.SQL,
        "op12_ball_tree": ball_tree.SQL,
        "op13_exponion": exponion.SQL,
    }
