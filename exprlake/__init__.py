"""Spark-native analysis of gene-expression releases.

A release is an expression matrix, its sample metadata and its compound chemistry.  Give
the releases as files (`ReleaseFiles`) or DataFrames (`ReleaseFrames`), then list, query,
load, combine and validate them.  All results are lazy Spark DataFrames.
"""

from .operators.coverage import coverage
from .operators.export import export_samples_by_genes, obs_table, sample_vectors, var_table
from .operators.intervals import interval_join
from .operators.matrix import (
    combine,
    drop_unexpressed,
    estimate_size,
    expressed_genes,
    gene_column,
    join_releases,
    keep_samples,
    shared_gene_column,
    to_long,
    to_blocks,
    to_wide,
)
from .operators.ordered import asof_join, running
from .operators.profile import summarize_parts, summarize_table
from .operators.selection import exact_quantiles, stratified_sample
from .operators.sketches import gene_sketches, merge_sketches
from .operators.validate import release_report, summarize
from .plans.experiments import (
    Combined,
    Experiment,
    load_chem,
    load_dataset,
    load_experiment,
    load_experiments,
    load_metadata,
)
from .plans.release_check import ReleaseCheck, validate_releases
from .plans.sql import describe, query
from .session import engine_session
from .sources.catalog import (
    catalog_stats,
    list_datasets,
    resolve_dataset_url,
    resolve_job,
    select_releases,
)
from .sources.files import ReleaseFiles
from .sources.frames import ReleaseFrames
from .sources.store import Store, append, ingest, open_store

__all__ = [
    "Combined",
    "Experiment",
    "ReleaseCheck",
    "ReleaseFiles",
    "ReleaseFrames",
    "Store",
    "append",
    "asof_join",
    "catalog_stats",
    "combine",
    "coverage",
    "describe",
    "drop_unexpressed",
    "engine_session",
    "estimate_size",
    "exact_quantiles",
    "export_samples_by_genes",
    "expressed_genes",
    "gene_column",
    "gene_sketches",
    "ingest",
    "interval_join",
    "join_releases",
    "keep_samples",
    "list_datasets",
    "load_chem",
    "load_dataset",
    "load_experiment",
    "load_experiments",
    "load_metadata",
    "merge_sketches",
    "obs_table",
    "open_store",
    "query",
    "release_report",
    "resolve_dataset_url",
    "resolve_job",
    "running",
    "sample_vectors",
    "select_releases",
    "shared_gene_column",
    "stratified_sample",
    "summarize",
    "summarize_parts",
    "summarize_table",
    "to_blocks",
    "to_long",
    "to_wide",
    "validate_releases",
    "var_table",
]
