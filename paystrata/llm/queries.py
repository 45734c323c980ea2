"""The registered queries of the subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paystrata.llm.divergence import OP12_SQL, op12_source_divergence
from paystrata.llm.embeddings import OP6_SQL, op6_embedding_near_dedup
from paystrata.llm.graph import op11_graph_neighbours
from paystrata.llm.licenses import op5_license_scan
from paystrata.llm.lines import op8_substring_dedup
from paystrata.llm.merkle import OP13_SQL, op13_merkle_manifest
from paystrata.llm.mixing import OP2_SQL, op2_mix_sources
from paystrata.llm.packing import op9_pack
from paystrata.llm.quality import op4_quality_rules
from paystrata.llm.simhash import op10_simhash_near_dedup
from paystrata.llm.suffixes import op3_suffix_dedup
from paystrata.llm.tokenfile import op7_token_files
from paystrata.llm.toxicity import op1_toxicity
from paystrata.session import ship_package

_QUERIES = (op1_toxicity, op2_mix_sources, op3_suffix_dedup, op4_quality_rules, op5_license_scan, op6_embedding_near_dedup,
            op7_token_files, op8_substring_dedup, op9_pack, op10_simhash_near_dedup,
            op11_graph_neighbours, op12_source_divergence, op13_merkle_manifest)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the workers have got the package."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: _shipped(query) for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op6_embedding_near_dedup": OP6_SQL, "op12_source_divergence": OP12_SQL,
            "op13_merkle_manifest": OP13_SQL}
