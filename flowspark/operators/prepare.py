"""Row preparation: renaming, labelling, filtering, filling. All map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.numeric import NUMERIC_FILTER, clean_numeric, quoted
from flowspark.schemas import FittedParams, require_columns
from flowspark.session import lookup_join
from flowspark.specs import DatasetSpec

# Raw flow column -> flow record column. IN is destination to source.
RAW_TO_NFV1 = {
    "src_ip": "IPV4_SRC_ADDR",
    "dst_ip": "IPV4_DST_ADDR",
    "src_port": "L4_SRC_PORT",
    "dst_port": "L4_DST_PORT",
    "protocol": "PROTOCOL",
    "application_name": "L7_PROTO",
    "udps.tcp_flags": "TCP_FLAGS",
    "dst2src_packets": "IN_PKTS",
    "dst2src_bytes": "IN_BYTES",
    "src2dst_packets": "OUT_PKTS",
    "src2dst_bytes": "OUT_BYTES",
    "bidirectional_duration_ms": "FLOW_DURATION_MILLISECONDS",
}

# Raw flow columns no flow record keeps.
RAW_DROPPED = (
    "id", "expiration_id", "src_mac", "src_oui", "dst_mac", "dst_oui", "ip_version", "vlan_id",
    "src2dst_first_seen_ms", "src2dst_last_seen_ms", "tunnel_id", "application_category_name",
    "application_is_guessed", "application_confidence", "requested_server_name",
    "client_fingerprint", "server_fingerprint", "user_agent", "content_type",
    "bidirectional_first_seen_ms", "bidirectional_last_seen_ms", "bidirectional_packets",
    "bidirectional_bytes", "dst2src_last_seen_ms", "dst2src_first_seen_ms",
    "dst2src_duration_ms", "src2dst_duration_ms",
)


def rename_raw(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RAW_TO_NFV1)


def drop_unneeded(df: DataFrame) -> DataFrame:
    return df.drop(*RAW_DROPPED)


def add_label(df: DataFrame, label: str, column: str = "Attack") -> DataFrame:
    return df.withColumn(column, F.lit(label))


def raw_to_nfv1(df: DataFrame, label: str | None = None) -> DataFrame:
    """Raw flows to flow records, with an optional constant label."""
    out = drop_unneeded(rename_raw(df))
    return out if label is None else add_label(out, label)


def label_by_address(
    df: DataFrame, address: str, attack_label: str, benign_label: str = "Benign",
    address_column: str = "IPV4_SRC_ADDR", label_column: str = "Attack",
) -> DataFrame:
    """Attack label where the address column equals ``address``; an old label is overwritten."""
    require_columns(df, [address_column])
    hit = quoted(address_column).cast("string") == F.lit(str(address))
    return df.withColumn(label_column, F.when(hit, attack_label).otherwise(benign_label))


def label_by_addresses(
    df: DataFrame, labels: DataFrame, benign_label: str = "Benign",
    address_column: str = "IPV4_SRC_ADDR", label_column: str = "Attack",
) -> DataFrame:
    """The same for a table (address, label) with unique addresses."""
    require_columns(df, [address_column])
    table = labels.select(F.col("address").cast("string").alias("_addr"), F.col("label").alias("_label"))
    keyed = df.withColumn("_addr", quoted(address_column).cast("string"))
    joined = lookup_join(keyed, table, ["_addr"])
    return joined.withColumn(label_column, F.coalesce("_label", F.lit(benign_label))).drop("_addr", "_label")


def application_or_unknown(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("Unknown"))


def to_model_rows(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Raw flows to the ten model columns, a missing application named ``Unknown``."""
    order = [
        "dst2src_packets", "src2dst_packets", "dst2src_bytes", "src2dst_bytes",
        "bidirectional_duration_ms", "src_port", "dst_port", "protocol", "application_name",
        "udps.tcp_flags",
    ]
    cols = [quoted(c) for c in keep or []]
    for c in order:
        x = application_or_unknown(quoted(c)) if c == "application_name" else quoted(c)
        cols.append(x.alias(RAW_TO_NFV1[c]))
    return df.select(*cols)


def project_spec(df: DataFrame, spec: DatasetSpec, keep: list[str] | None = None) -> DataFrame:
    """Kept columns, then numerical and categorical features in declared order, then the class."""
    names = [*(keep or []), *spec.features, spec.class_column]
    require_columns(df, names)
    return df.select(*[quoted(n) for n in dict.fromkeys(names)])


def fill_missing(df: DataFrame, params: FittedParams) -> DataFrame:
    """Missing numbers become 0, missing categories the first known level (or 0 without levels);
    an absent column is added the same way."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for name in params.numerical:
        if name not in types:
            new[name] = F.lit(0.0)
            continue
        x = quoted(name).cast("double")
        new[name] = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    for name, p in params.categorical.items():
        first = F.lit(p.levels[0] if p.levels else 0)
        if name not in types:
            new[name] = first
            continue
        x = quoted(name)
        gone = x.isNull()
        if isinstance(types[name], T.FractionalType):
            gone = gone | F.isnan(x)
        new[name] = F.when(gone, first.cast(types[name])).otherwise(x)
    return df.withColumns(new)


def drop_rows_containing(df: DataFrame, *keywords: str) -> DataFrame:
    """Drop a row if the text of any column contains any keyword (case-sensitive)."""
    keep = F.lit(True)
    for kw in keywords:
        for name in df.columns:
            keep = keep & ~F.coalesce(F.contains(quoted(name).cast("string"), F.lit(kw)), F.lit(False))
    return df.filter(keep)


def clean_numericals(df: DataFrame, names: list[str], limit: float = NUMERIC_FILTER) -> DataFrame:
    require_columns(df, names)
    return df.withColumns({n: clean_numeric(quoted(n), limit) for n in names})
