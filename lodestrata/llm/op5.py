"""Query op5: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.packing import ids_crc32, pack
from lodestrata.llm.session import table


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", ids_crc32(pieces["ids"]).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
