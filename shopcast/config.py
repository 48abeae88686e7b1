"""Feature, treatment and outcome settings: metadata that lives on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

DATA_TYPES = ("binary", "percent", "integer", "int", "float", "string")


@dataclass(frozen=True)
class FeatureSpec:
    """One described column.  ``domain`` is used by profile features only."""

    name: str
    description: str
    data_type: str = "float"
    domain: str | None = None


@dataclass(frozen=True)
class ModelSettings:
    """How prompts are cut into calls, paced and repeated.

    A worker starts a call at most every ``seconds_per_batch`` seconds, so
    ``max_workers`` workers handle one batch window in that time.
    """

    batch_size: int = 20
    max_workers: int = 2
    seconds_per_batch: float = 0.0
    chunk_rows: int | None = None
    retries: int = 8
    retry_wait_seconds: float = 0.0

    @property
    def chunk_size(self) -> int:
        return self.chunk_rows or max(1, self.batch_size // self.max_workers)


def model_settings(settings: Mapping, stage: str, retries: int = 8) -> ModelSettings:
    """Settings of one stage (``profile`` or ``prediction``) from a ``batch_processing`` section."""
    body = settings["batch_processing"]
    return ModelSettings(
        batch_size=body[f"{stage}_batch_size"],
        max_workers=body[f"{stage}_max_workers"],
        seconds_per_batch=body[f"{stage}_seconds_per_batch"],
        retries=retries,
    )


def read_settings(path: str) -> dict:
    """Read a YAML or JSON settings file into a dict."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise ImportError("YAML settings need the yaml module; use JSON instead") from exc
    return yaml.safe_load(text)


def feature_specs(settings: Mapping) -> list[FeatureSpec]:
    """Specs from ``{customer_features: {name: {description, domain, data_type}}}``."""
    return [
        FeatureSpec(name, body["description"], body["data_type"], body["domain"])
        for name, body in settings["customer_features"].items()
    ]


def listed_specs(settings: Mapping, section: str) -> list[FeatureSpec]:
    """Specs from ``{section: [{feature_name, feature_description, data_type}]}``."""
    return [
        FeatureSpec(
            body["feature_name"], body["feature_description"], body.get("data_type", "float")
        )
        for body in settings[section]
    ]


def resolve(
    specs: Iterable[FeatureSpec], columns: Sequence[str], missing: str = "error"
) -> list[FeatureSpec]:
    """Keep the specs whose column exists; ``missing`` is ``error`` or ``drop``."""
    specs = list(specs)
    absent = [spec.name for spec in specs if spec.name not in columns]
    if absent and missing == "error":
        raise ValueError(f"features without a column: {absent}")
    return [spec for spec in specs if spec.name in columns]


def by_domain(specs: Iterable[FeatureSpec]) -> dict[str, list[FeatureSpec]]:
    """Group specs by domain, domains in order of first appearance."""
    grouped: dict[str, list[FeatureSpec]] = {}
    for spec in specs:
        grouped.setdefault(spec.domain or "", []).append(spec)
    return grouped


def name_list(names: str | Iterable[str] | None) -> list[str]:
    """A plain string means one name, never a substring test."""
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)
