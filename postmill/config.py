"""Settings, with overrides from the environment (``POSTMILL_`` and the field's name in upper case)."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from .functions import fixed

TRUE = {"1", "true", "yes", "y", "on"}


@dataclass
class Config:
    # paths
    input_path: str | None = None
    combined_path: str | None = None
    hourly_path: str | None = None
    yearly_path: str | None = None
    out_dir: str = "out"
    # fast or precise
    mode: str = "precise"
    min_tokens: int = 15
    max_words: int = 0
    reference_date: str | None = None
    # fuzzy titles
    fuzzy_titles: bool = False
    fuzzy_similarity: int = 90
    fuzzy_scorer: str = "token_sort_ratio"
    fuzzy_collapse: bool = False
    fuzzy_keep: str = "first"
    fuzzy_columns: bool = True
    # labels and classifier
    tau: float = 0.15
    model_kind: str = "logreg"
    rule: str = "default"
    positive_titles: list[str] = field(default_factory=lambda: list(fixed.POSITIVE_TITLES))
    positive_descriptions: list[str] = field(default_factory=lambda: list(fixed.POSITIVE_DESCRIPTIONS))
    negative_titles: list[str] = field(default_factory=lambda: list(fixed.NEGATIVE_TITLES))
    domain_allowlist: list[str] = field(default_factory=lambda: list(fixed.DOMAIN_ALLOWLIST))
    # topics
    topic_min_chars: int = 200
    topic_cutoff: float = 0.5
    topic_use_label: bool = False
    topic_text_mode: str = "legacy"
    embedding_model: str = ""
    # topic labels
    label_examples: int = 5
    label_chars: int = 400

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None) -> Config:
        environ = dict(os.environ) if environ is None else environ
        out = cls()
        for f in fields(cls):
            raw = environ.get(f"POSTMILL_{f.name.upper()}")
            if raw is None:
                continue
            old = getattr(out, f.name)
            if isinstance(old, bool):
                value = raw.strip().lower() in TRUE
            elif isinstance(old, list):
                value = raw.split("\n")
            else:
                value = type(old)(raw) if isinstance(old, (int, float)) else raw
            setattr(out, f.name, value)
        if out.mode not in ("fast", "precise"):
            out.mode = "precise"
        return out
