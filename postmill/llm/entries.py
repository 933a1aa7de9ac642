"""The subpackage's queries, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import ship
from .bpe import op7_rank_queue_bpe
from .cutting_stock import op2_cutting_stock
from .decision_list import op8_decision_list
from .golomb import OP9_SQL, op9_golomb_exchange
from .html_text import op6_text_to_tag
from .licenses import op3_suffix_automaton
from .planes import op1_bit_planes
from .signature_tree import op4_signature_tree
from .toxicity import op10_classifier_chain
from .url_lists import OP5_SQL, op5_temporal_lists

_QUERIES = [op1_bit_planes, op2_cutting_stock, op3_suffix_automaton, op4_signature_tree, op5_temporal_lists, op6_text_to_tag, op7_rank_queue_bpe, op8_decision_list, op9_golomb_exchange, op10_classifier_chain]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_temporal_lists": OP5_SQL, "op9_golomb_exchange": OP9_SQL}
