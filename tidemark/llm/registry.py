"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .chat import op3_chat_format
from .licenses import op4_license_scan
from .media import op2_media_copies
from .mixing import op8_entropy_mixing
from .packing import op5_concat_and_cut
from .pii import op9_pii
from .quality import op1_quality_rules
from .repeats import op7_suffix_dedup
from .simhash import op10_simhash_near_dedup
from .warc import op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_media_copies, op3_chat_format, op4_license_scan, op5_concat_and_cut, op6_warc, op7_suffix_dedup, op8_entropy_mixing, op9_pii, op10_simhash_near_dedup)
}
ORACLE_SQL: dict[str, str] = {"op3_chat_format": oracles.CHAT, "op4_license_scan": oracles.LICENSES, "op6_warc": oracles.WARC}
