"""Logical files: known names first, then a pattern, in a folder that the environment may name."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Fixed names: logical name, file names in order, pattern.
CATALOG = {
    "expression": (["OmicsExpressionTPMLogp1HumanProteinCodingGenes.csv", "OmicsExpressionProteinCodingGenesTPMLogp1.csv"], "OmicsExpression*TPM*ProteinCoding*.csv"),
    "expression_counts": (["OmicsExpressionGenesExpectedCountProfile.csv"], "*ExpectedCount*.csv"),
    "crispr": (["CRISPRGeneEffect.csv", "CRISPRGeneEffectUncorrected.csv"], "CRISPRGeneEffect*.csv"),
    "model": (["Model.csv", "Model (1).csv", "Model__1_.csv", "sample_info.csv"], "Model*.csv"),
    "prism_matrix": (
        [
            "Repurposing_Public_24Q2_Extended_Primary_Data_Matrix.csv", "Repurposing_Public_24Q2_LFC_COLLAPSED.csv", "Repurposing_Public_23Q2_LFC_COLLAPSED.csv",
            "primary-screen-replicate-collapsed-logfold-change.csv",
        ],
        "*[Pp]rimary*[Dd]ata*[Mm]atrix*.csv",
    ),
    "prism_compounds": (["Repurposing_Public_24Q2_Extended_Primary_Compound_List.csv", "primary-screen-replicate-treatment-info.csv"], "*[Cc]ompound*[Ll]ist*.csv"),
    "prism_cell_lines": (["primary-screen-cell-line-info.csv"], "*cell*line*info*.csv"),
}


def data_dir(default: str = ".") -> str:
    return os.environ.get("LOOMGRID_DATA_DIR", default)


def processed_dir(default: str = "./processed") -> str:
    return os.environ.get("LOOMGRID_PROCESSED_DIR", default)


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def resolve_file(spark: SparkSession, name: str, folder: str | None = None, required: bool = True) -> str | None:
    """The path of a logical file, None if it is optional and not there.

    An unknown name is a KeyError, whether required or not; a required file
    that is missing is a FileNotFoundError that lists what the folder holds.
    """
    if name not in CATALOG:
        raise KeyError(f"unknown file {name!r}; known: {', '.join(CATALOG)}")
    folder = folder or data_dir()
    names, pattern = CATALOG[name]
    for candidate in [*names, pattern]:
        found = list_files(spark, f"{folder}/{candidate}")
        if found:
            return found[0]
    if not required:
        return None
    raise FileNotFoundError(f"no file for {name!r} in {folder}; it holds: {', '.join(os.path.basename(p) for p in list_files(spark, folder + '/*')) or 'nothing'}")
