from __future__ import annotations

import json

import pytest

from exprlake.schemas import SEQUENCING

from .compare import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4)


@pytest.fixture()
def long_of(spark):
    """Long matrix from (job, gene, sample, value) tuples."""

    def make(*cells):
        return spark.createDataFrame([(j, g, s, None if v is None else float(v)) for j, g, s, v in cells], SEQUENCING)

    return make


@pytest.fixture()
def rows():
    def as_set(df, *columns):
        return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}

    return as_set


METADATA_CSV = {
    # The column order differs on purpose; `note` exists in one release only.
    "r1": "sequenced_id,job_id,compound,user_compound_id,cell_line,is_control,percent_mitochondrial,total_sequenced_reads\n"
    "0012,r1,c1,Bort,THP-1,false,10.5,2000000\n"
    "a1,r1,c1,Bort,THP-1,false,25.0,1500000\n"
    "A1,r1,c0,DMSO,THP-1,true,8.3,1500000\n",
    "r2": "job_id,note,sequenced_id,compound,user_compound_id,cell_line,is_control,total_sequenced_reads,percent_mitochondrial\n"
    'r2,"a ""quoted"", note",b1,c1,Bort,THP-1,false,900,3.5\n'
    "r2,,b2,c0,DMSO,K562,true,not-a-number,4.5\n"
    "r2,again,b2,c9,Late,K562,true,7,4.6\n",
}

COMPOUNDS = {
    "r1": [
        {"compound": "c1", "user_compound_id": "Bort", "smiles": "CC", "log_p": 0.36, "num_atoms": 27},
        {"compound": "c0", "user_compound_id": "DMSO", "smiles": "CS", "log_p": -1.35},
    ],
    "r2": [{"compound": "c1", "user_compound_id": "Bort", "smiles": "CC", "log_p": 0.36}],
}


@pytest.fixture()
def release_files(spark, tmp_path):
    """Four releases on disk: r1 and r2 whole (wide), r3 without chemistry and metadata, r4 without matrix."""
    from exprlake import engine_session

    session = engine_session(spark)
    columns = {"r1": ["gene_id", "0012", "a1", "A1"], "r2": ["gene_id", "b1", "b2"], "r3": ["gene_id", "z1"]}
    matrices = {
        "r1": [("g1", 0.0, 1.0, 0.0), ("g2", 0.0, 0.0, 0.0), ("g3", 2.0, None, 4.0)],
        "r2": [("g1", 0.0, 0.0), ("g4", 5.0, 0.0)],
        "r3": [("g1", 1.0)],
    }
    datasets = []
    for job, name in (("r1", "first"), ("r2", "second"), ("r3", "third"), ("r4", "fourth")):
        entry = {
            "job_id": job,
            "job_name": name,
            "imported_at": "2026-01-01T00:00:00+00:00",
            "is_public": True,
            "cell_lines": ["THP-1"],
            "timepoints": ["24h"],
            "data_path": str(tmp_path / "matrix" / f"{job}.parquet"),
            "metadata_path": str(tmp_path / f"{job}.csv"),
            "chemistry_path": str(tmp_path / f"{job}.json"),
        }
        if job in matrices:
            session.createDataFrame(
                matrices[job], ", ".join(f"`{c}` {'string' if c == 'gene_id' else 'double'}" for c in columns[job])
            ).coalesce(1).write.parquet(entry["data_path"])
        if job in METADATA_CSV:
            (tmp_path / f"{job}.csv").write_text(METADATA_CSV[job])
        if job in COMPOUNDS:
            (tmp_path / f"{job}.json").write_text(json.dumps({"compounds": COMPOUNDS[job]}, indent=2))
        datasets.append(entry)
    datasets.append({"job_id": "", "job_name": "no id"})
    (tmp_path / "catalog.json").write_text(json.dumps({"datasets": datasets}, indent=2))

    from exprlake import ReleaseFiles

    return session, ReleaseFiles(str(tmp_path / "catalog.json")), tmp_path
