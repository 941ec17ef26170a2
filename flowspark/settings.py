"""Model metadata and class labels: small driver-side settings."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field

from flowspark.session import read_text, write_text

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ModelMetadata:
    input_names: tuple[str, ...] = ()
    dims: dict[str, int] = field(default_factory=dict)
    class_labels: tuple[str, ...] = ()
    benign_label: str | None = None
    benign_class_index: int | None = None
    path: str | None = None

    @property
    def usable(self) -> bool:
        return bool(self.input_names or self.dims or self.class_labels)


def _as_int(value) -> int | None:
    try:
        return None if value is None else int(value)
    except (TypeError, ValueError):
        return None


def class_labels_of(doc: dict) -> list[str]:
    """``class_labels``, else ``class_map`` by integer key, else ``label_encoder_classes``."""
    labels = doc.get("class_labels")
    if isinstance(labels, list) and labels:
        return [str(v) for v in labels]
    mapping = doc.get("class_map")
    if isinstance(mapping, dict) and mapping:
        numbered = {_as_int(k): str(v) for k, v in mapping.items()}
        numbered.pop(None, None)
        return [numbered[k] for k in sorted(numbered)]
    classes = doc.get("label_encoder_classes")
    return [str(v) for v in classes] if isinstance(classes, list) else []


def parse_metadata(doc: dict, path: str | None = None) -> ModelMetadata:
    names = doc.get("model_input_names", doc.get("input_names", []))
    names = [n for n in names if isinstance(n, str) and n] if isinstance(names, list) else []
    raw = doc.get("model_expected_dims", {})
    dims = {str(k): _as_int(v) for k, v in raw.items()} if isinstance(raw, dict) else {}
    benign = doc.get("benign_label")
    return ModelMetadata(
        tuple(names), {k: v for k, v in dims.items() if v is not None and v > 0},
        tuple(class_labels_of(doc)), None if benign is None else str(benign),
        _as_int(doc.get("benign_class_index")), path,
    )


def load_metadata(model_path: str, metadata_path: str | None = None) -> ModelMetadata | None:
    """The first usable of: the given file, ``stem.meta.json``, ``stem.json``."""
    stem = os.path.splitext(_full(model_path))[0]
    candidates = [metadata_path and _full(metadata_path), f"{stem}.meta.json", f"{stem}.json"]
    for path in dict.fromkeys(p for p in candidates if p):
        try:
            text = read_text(path)
            if text is None:
                continue
            found = parse_metadata(json.loads(text), path)
        except (OSError, ValueError, AttributeError) as e:
            log.warning("cannot read model metadata %s: %s", path, e)
            continue
        if found.usable:
            return found
        log.warning("model metadata %s holds nothing usable", path)
    return None


def _full(path: str) -> str:
    return path if "://" in path else os.path.abspath(path)


def load_class_info(path: str | None) -> ModelMetadata | None:
    if path is None:
        return None
    text = read_text(path)
    if text is None:
        raise FileNotFoundError(path)
    return parse_metadata(json.loads(text), path)


@dataclass(frozen=True)
class VerdictSettings:
    labels: list[str]
    benign_label: str = "Benign"
    benign_class_index: int | None = None
    threshold: float = 0.5


def resolve_verdict_settings(
    metadata: ModelMetadata | None = None, class_info: ModelMetadata | None = None,
    benign_label: str | None = None, benign_class_index: int | None = None, threshold: float = 0.5,
) -> VerdictSettings:
    """Precedence: explicit arguments, then the class info file, then metadata, then defaults."""
    labels: list[str] = []
    label, index = "Benign", None
    for source in (metadata, class_info):
        if source is None:
            continue
        labels = list(source.class_labels) or labels
        label = source.benign_label if source.benign_label is not None else label
        index = source.benign_class_index if source.benign_class_index is not None else index
    label = benign_label if benign_label is not None else label
    index = benign_class_index if benign_class_index is not None else index
    return VerdictSettings(labels, label, index, min(max(float(threshold), 0.0), 1.0))


def write_metadata(
    path: str, input_names: list[str], widths: dict[str, int], classes: list[str],
    benign_label: str = "Benign",
) -> dict:
    """Metadata beside a fitted model: input names, widths above 1, class map, benign index."""
    doc = {
        "model_input_names": list(input_names),
        "model_expected_dims": {k: v for k, v in widths.items() if v > 1},
        "class_map": {str(i): c for i, c in enumerate(classes)},
        "class_labels": list(classes),
        "benign_label": benign_label,
        "benign_class_index": classes.index(benign_label) if benign_label in classes else None,
    }
    write_text(path, json.dumps(doc, indent=2, ensure_ascii=False))
    return doc
