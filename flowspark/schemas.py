"""Declared schemas of packets and flows, and the fitted parameters of the encoders."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

# DDL strings: readers and createDataFrame take them as they are.
PACKET_SCHEMA = (
    "packet_id BIGINT, ts TIMESTAMP, src_ip STRING, src_port INT, dst_ip STRING, dst_port INT, "
    "protocol INT, bytes BIGINT, syn BOOLEAN, ack BOOLEAN, fin BOOLEAN, rst BOOLEAN, "
    "psh BOOLEAN, urg BOOLEAN"
)

NFV1_SCHEMA = (
    "IPV4_SRC_ADDR STRING, L4_SRC_PORT INT, IPV4_DST_ADDR STRING, L4_DST_PORT INT, PROTOCOL INT, "
    "FLOW_DURATION_MILLISECONDS BIGINT, OUT_PKTS BIGINT, OUT_BYTES BIGINT, IN_PKTS BIGINT, "
    "IN_BYTES BIGINT, L7_PROTO STRING, TCP_FLAGS INT, Attack STRING"
)

PARAMS_SCHEMA = (
    "feature STRING, kind STRING, min DOUBLE, range DOUBLE, levels ARRAY<STRING>, "
    "level_type STRING, n_levels INT"
)


def require_columns(df: DataFrame, names) -> None:
    """Name every missing column before any job starts."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


@dataclass(frozen=True)
class NumericParams:
    min: float
    range: float


@dataclass(frozen=True)
class CategoricalParams:
    levels: tuple
    n_levels: int


@dataclass(frozen=True)
class FittedParams:
    """What the encoders need; its size is features x top-K, whatever the data size."""

    numerical: dict[str, NumericParams]
    categorical: dict[str, CategoricalParams]
    window_size: int = 8
    top_k: int = 32
    clip_numerical: bool = False
    meta: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numerical, *self.categorical]

    def with_dims(self, dims: dict[str, int]) -> FittedParams:
        """Cut or widen each categorical feature to the width a model expects."""
        unknown = [f for f in dims if f not in self.categorical]
        if unknown:
            raise ValueError(f"features without categorical parameters: {unknown}")
        cat = dict(self.categorical)
        for name, dim in dims.items():
            cat[name] = CategoricalParams(cat[name].levels[:dim], dim)
        return replace(self, categorical=cat)

    def width_mismatches(self, dims: dict[str, int]) -> list[tuple[str, int, int]]:
        return [
            (f, self.categorical[f].n_levels if f in self.categorical else 0, dim)
            for f, dim in dims.items()
            if f not in self.categorical or self.categorical[f].n_levels != dim
        ]

    def check_widths(self, dims: dict[str, int], allow_mismatch: bool = False) -> list:
        found = self.width_mismatches(dims)
        if found and not allow_mismatch:
            raise ValueError(f"categorical widths differ (feature, fitted, model): {found}")
        return found

    # -- JSON and one-row-per-feature forms ------------------------------------------------
    def to_json(self) -> str:
        doc = {
            "numerical_features": list(self.numerical),
            "categorical_features": list(self.categorical),
            "numerical_params": {k: asdict(v) for k, v in self.numerical.items()},
            "categorical_params": {
                k: {"levels": list(v.levels), "n_levels": v.n_levels}
                for k, v in self.categorical.items()
            },
            "window_size": self.window_size,
            "top_k": self.top_k,
            "clip_numerical": self.clip_numerical,
        }
        return json.dumps(doc, indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> FittedParams:
        doc = json.loads(text)
        num = {f: NumericParams(**doc["numerical_params"][f]) for f in doc["numerical_features"]}
        cat = {}
        for f in doc["categorical_features"]:
            p = doc["categorical_params"][f]
            cat[f] = CategoricalParams(tuple(p["levels"]), int(p.get("n_levels", len(p["levels"]))))
        return cls(
            num, cat, int(doc.get("window_size", 8)), int(doc.get("top_k", 32)),
            bool(doc.get("clip_numerical", False)),
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(f, "numerical", float(p.min), float(p.range), None, None, None)
                for f, p in self.numerical.items()]
        for f, p in self.categorical.items():
            tag = level_type_of(p.levels)
            rows.append((f, "categorical", None, None, [str(v) for v in p.levels], tag, p.n_levels))
        return spark.createDataFrame(rows, PARAMS_SCHEMA)

    @classmethod
    def from_rows(cls, rows: list[Row], **settings) -> FittedParams:
        """Build from the rows of a parameter table (one per feature)."""
        num, cat = {}, {}
        for r in rows:
            if r["kind"] == "numerical":
                num[r["feature"]] = NumericParams(r["min"], r["range"])
            else:
                read = {"int": int, "float": float}.get(r["level_type"], str)
                cat[r["feature"]] = CategoricalParams(
                    tuple(read(v) for v in r["levels"]), r["n_levels"]
                )
        return cls(num, cat, **settings)


def level_type_of(levels) -> str:
    if levels and all(isinstance(v, int) and not isinstance(v, bool) for v in levels):
        return "int"
    if levels and all(isinstance(v, (int, float)) for v in levels):
        return "float"
    return "string"


def level_type_of_column(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType,)):
        return "float"
    return "string"


@dataclass(frozen=True)
class ModelInputSpec:
    """Feature order, widths and classes of an encoded table."""

    feature_names: tuple[str, ...]
    n_numeric: int
    levels_per_categorical: tuple[int, ...]
    categorical_format: str  # "integers" or "onehot"
    classes: tuple[str, ...] = ()
    attack_classes: tuple[str, ...] = ()

    @property
    def numeric_features(self) -> tuple[str, ...]:
        return self.feature_names[: self.n_numeric]

    @property
    def categorical_features(self) -> tuple[str, ...]:
        return self.feature_names[self.n_numeric:]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> ModelInputSpec:
        doc = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in doc.items()})
