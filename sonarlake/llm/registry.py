"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lines
from .decontaminate import op1_lsa_decontamination
from .html import op4_crf_html
from .langid import op8_ecoc_langid
from .lines import op7_winnow_lines
from .media import op5_media_tiles
from .neardup import op9_may_ozerov_neardup
from .packing import op6_gga_packing
from .pii import op3_semicrf_pii
from .store import tidy
from .substrings import op10_paragraph_minhash
from .toxicity import op2_ftrl_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: tidy(f.__name__, f) for f in (op1_lsa_decontamination, op2_ftrl_toxicity, op3_semicrf_pii, op4_crf_html, op5_media_tiles, op6_gga_packing, op7_winnow_lines, op8_ecoc_langid, op9_may_ozerov_neardup, op10_paragraph_minhash)
}
ORACLES: dict[str, str] = {"op7_winnow_lines": lines.ORACLE_SQL}
