"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, grulm, iblt, media, mixing, packing, quality, resampling, simhash, toxicity, urlrules, vectorcodes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gru": grulm.op1_gru,
    "op2_iblt": iblt.op2_iblt,
    "op3_quality": quality.op3_quality,
    "op4_media": media.op4_media,
    "op5_packing": packing.op5_packing,
    "op6_urls": urlrules.op6_urls,
    "op7_simhash": simhash.op7_simhash,
    "op8_bpe": bpe.op8_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
    "op11_resampling": resampling.op11_resampling,
    "op12_codes": vectorcodes.op12_codes,
    "op13_mixing": mixing.op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op10_warc": warc.OP10_SQL,
    "op12_codes": vectorcodes.OP12_SQL,
}
