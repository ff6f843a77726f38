"""Sources, converters and processors by name: functions over DataFrames that a recipe can ask for."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Registry:
    """Functions by name. ``call`` refuses unknown names and unknown options, before anything runs."""

    kind: str
    known: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register(self, name: str) -> Callable:
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.known:
                raise ValueError(f"the {self.kind} {name} exists already")
            self.known[name] = f
            return f

        return add

    def options(self, name: str) -> dict[str, Any]:
        """The options of a function with their defaults."""
        return {p.name: None if p.default is p.empty else p.default for p in inspect.signature(self._of(name)).parameters.values() if p.kind is p.KEYWORD_ONLY or p.default is not p.empty}

    def call(self, name: str, *inputs: DataFrame, **options: Any) -> DataFrame:
        f = self._of(name)
        try:
            inspect.signature(f).bind(*inputs, **options)
        except TypeError as e:
            raise ValueError(f"{self.kind} {name}: {e}") from e
        return f(*inputs, **options)

    def _of(self, name: str) -> Callable[..., DataFrame]:
        if name not in self.known:
            raise ValueError(f"unknown {self.kind} {name}; there are {sorted(self.known)}")
        return self.known[name]


def _filled() -> tuple[Registry, Registry, Registry]:
    from tessera.functions import mentions
    from tessera.operators import catalogue, density, joins, results, sampling, sets, trees, vectors
    from tessera.sources import arrays, arrow_shards, collection, corpus, digest, files, mapping

    sources, converters, processors = Registry("source"), Registry("converter"), Registry("processor")
    for name, f in {"jsonl": files.read_jsonl, "csv": files.read_csv, "json": files.read_json, "shards": files.read_shards, "arrow_shards": arrow_shards.read_arrow_shards, "parquet_shards": arrow_shards.read_parquet_shards, "media": files.media_table, "collection": collection.read_collection, "npy": arrays.read_npy, "mat": arrays.read_mat, "bundle": arrays.read_bundle}.items():
        sources.register(name)(f)
    for name, f in {"keyed_rows": files.keyed_rows, "named_arrays": files.named_arrays, "records": files.to_records, "mapped": mapping.mapped, "grouped": joins.group_tables, "pivot_folds": joins.pivot_folds, "collapse_variants": joins.collapse_variants, "interleave": sampling.interleave, "asset_units": sets.asset_units, "references": files.follow_references, "described": files.described, "discovered": digest.discovered, "ris": corpus.ris_records, "mentions": mentions.framed_mentions, "component_batches": sets.component_batches, "previews": catalogue.previews}.items():
        converters.register(name)(f)
    for name, f in {"k_means": vectors.k_means, "neighbours": vectors.neighbours, "outlier_scores": vectors.outlier_scores, "density_clusters": vectors.density_clusters, "density_hierarchy": density.hierarchy, "hierarchical_clusters": trees.hierarchical_clusters, "cluster_summaries": vectors.cluster_summaries, "research_import": results.import_research, "detector_view": results.detector_view}.items():
        processors.register(name)(f)
    return sources, converters, processors


SOURCES, CONVERTERS, PROCESSORS = _filled()
