"""The query catalog: every operator's query and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.core import Operator
from ..operators.cross_section import CROSS_SECTION
from ..operators.evaluation import EVALUATION
from ..operators.inference import INFERENCE
from ..operators.recursions import RECURSIONS, Scan
from ..operators.relational import RELATIONAL
from ..operators.samples import SAMPLES
from ..operators.studies import STUDIES
from ..operators.windows import WINDOWS
from ..sources.bars import bars, bars_sql
from . import io_queries, stream_queries, study_queries  # noqa: F401
from .functional import FUNCTIONAL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "SMP02_samples"


def register(op: Operator | Scan) -> None:
    """Query an operator over the bars of its mapping."""
    QUERIES[op.name] = lambda spark, sf_dir: op(bars(spark, sf_dir, op.mapping))
    ORACLES[op.name] = op.oracle(bars_sql(op.mapping))


for _operator in (*WINDOWS, *RECURSIONS, *CROSS_SECTION, *RELATIONAL, *EVALUATION, *INFERENCE, *SAMPLES, *STUDIES):
    register(_operator)

for _name, (_function, _oracle) in FUNCTIONAL.items():
    QUERIES[_name] = _function
    if _oracle:
        ORACLES[_name] = _oracle
