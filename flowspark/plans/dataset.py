"""Dataset preparation: raw flows to a labelled, balanced, fitted table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowspark.operators.prepare import raw_to_nfv1
from flowspark.operators.split import balance
from flowspark.operators.stats import collect_params
from flowspark.schemas import FittedParams
from flowspark.specs import NFV1, DatasetSpec


def prepare_dataset(
    raw: DataFrame, id_col: str, attack: str, label: str | None = None, strategy: str | None = "downsample",
    spec: DatasetSpec = NFV1, top_k: int = 32, window_size: int = 8, seed: int = 42,
) -> tuple[DataFrame, FittedParams]:
    """Rename and drop, label, balance into a random order, fit scaling and levels.

    ``label`` sets one class for all rows; None keeps the class column the table has.
    """
    flows = raw_to_nfv1(raw, label)
    if strategy is not None:
        flows = balance(flows, id_col, attack, spec.benign_label, strategy, seed, spec.class_column)
    return flows, collect_params(flows, spec, top_k, window_size=window_size)
