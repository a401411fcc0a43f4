"""Settings of the evidence pipeline, with overrides from the session and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    sub_queries: int = 7
    page_size: int = 50
    excerpt_tokens: int = 3072
    evidence_words: int = 250
    abstract_batch: int = 50
    full_text_batch: int = 10
    max_full_text: int = 30
    max_abstract_only: int = 30
    top_k: int = 60
    full_text_enrichment: bool = True

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        """lodestone.<name> of the session, else LODESTONE_<NAME> of the environment; values that don't fit are passed over."""
        given = {}
        for f in fields(cls):
            raw = (spark.conf.get(f"lodestone.{f.name}", None) if spark else None) or os.environ.get(f"LODESTONE_{f.name.upper()}")
            if raw is None:
                continue
            try:
                given[f.name] = raw.strip().lower() in ("1", "true", "yes") if f.type == "bool" else int(raw)
            except ValueError:
                continue
        return cls(**given)
