"""Table schemas of the release model.

The expression matrix is held long: one row per (release, gene, sample).  A wide
matrix (one column per sample) is only an import and export shape.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_TEXT = T.StringType()
_REAL = T.DoubleType()
_INT = T.LongType()
_FLAG = T.BooleanType()
_TEXTS = T.ArrayType(T.StringType())

# One row per release, then where its three parts are stored.
CATALOG = _struct(
    ("job_id", _TEXT),
    ("job_name", _TEXT),
    ("imported_at", T.TimestampType()),
    ("is_public", _FLAG),
    ("parquet_file_size_bytes", _INT),
    ("datapoint_count", _INT),
    ("cell_lines", _TEXTS),
    ("timepoints", _TEXTS),
    ("metadata_row_count", _INT),
    ("data_path", _TEXT),
    ("metadata_path", _TEXT),
    ("chemistry_path", _TEXT),
)

# Core sample columns.  A release may carry more; those stay text.
METADATA = _struct(
    ("sequenced_id", _TEXT),
    ("job_id", _TEXT),
    ("compound", _TEXT),
    ("user_compound_id", _TEXT),
    ("compound_concentration", _REAL),
    ("compound_concentration_unit", _TEXT),
    ("cell_line", _TEXT),
    ("timepoint", _TEXT),
    ("is_control", _FLAG),
    ("total_sequenced_reads", _INT),
    ("percent_mitochondrial", _REAL),
    ("percent_mapped", _REAL),
    ("percent_duplicated", _REAL),
    ("ngenes3", _INT),
)

# Column names and order of the chemistry table.
CHEMISTRY = _struct(
    ("compound", _TEXT),
    ("user_compound_id", _TEXT),
    ("smiles", _TEXT),
    ("purity_pct", _REAL),
    ("molecular_weight", _REAL),
    ("log_p", _REAL),
    ("tpsa", _REAL),
    ("inchi_key", _TEXT),
    ("num_rotatable_bonds", _INT),
    ("num_h_acceptors", _INT),
    ("num_h_donors", _INT),
    ("num_atoms", _INT),
    ("num_bonds", _INT),
)

SEQUENCING = _struct(
    ("job_id", _TEXT),
    ("gene_id", _TEXT),
    ("sequenced_id", _TEXT),
    ("value", _REAL),
)

# The same with the ordinal of the matrix row that a cell comes from, where its source has one.
SEQUENCING_ROWS = T.StructType([*SEQUENCING.fields, T.StructField("gene_row", _INT, True)])

# A release part that could not be read, or a column check that failed.
PROBLEMS = _struct(("job_id", _TEXT), ("source", _TEXT), ("message", _TEXT))

REPORT = _struct(
    ("job_id", _TEXT),
    ("job_name", _TEXT),
    ("n_genes", _INT),
    ("n_samples_metadata", _INT),
    ("n_samples_parquet", _INT),
    ("n_samples_intersection", _INT),
    ("output_path", _TEXT),
    ("issues", _TEXTS),
    ("fatal", _TEXT),
    ("status", _TEXT),
)

METADATA_TYPES = {f.name: f.dataType for f in METADATA.fields}
CHEMISTRY_COLUMNS = CHEMISTRY.fieldNames()
SEQUENCING_COLUMNS = SEQUENCING.fieldNames()
