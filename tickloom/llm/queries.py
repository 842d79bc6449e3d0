"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import OP12_SQL, op12
from .decontam import OP9_SQL, op9
from .importance import OP11_SQL, op11
from .langid import op4
from .near_dedup import OP1_SQL, op1
from .neighbours import op13
from .packing import op8
from .quality import op6
from .repetition import OP2_SQL, op2
from .secrets import OP5_SQL, op5
from .sharding import OP7_SQL, op7
from .warc import OP3_SQL, op3
from .wrapper import op10


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1,
        "op2_repetition": op2,
        "op3_warc": op3,
        "op4_language": op4,
        "op5_secrets": op5,
        "op6_quality": op6,
        "op7_sharding": op7,
        "op8_packing": op8,
        "op9_decontamination": op9,
        "op10_wrapper": op10,
        "op11_importance": op11,
        "op12_codes": op12,
        "op13_neighbours": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": OP1_SQL,
        "op2_repetition": OP2_SQL,
        "op3_warc": OP3_SQL,
        "op5_secrets": OP5_SQL,
        "op7_sharding": OP7_SQL,
        "op9_decontamination": OP9_SQL,
        "op11_importance": OP11_SQL,
        "op12_codes": OP12_SQL,
    }
