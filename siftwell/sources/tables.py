"""Constant tables: reference cutoffs, study manifest, catalogue of methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.schema import ADJUSTMENTS, LOSS_TESTS, SELECTIONS, mito_cutoff

# Species, tissue, cell context, cutoff, evidence.
REFERENCE = [
    ("human", "global", "scRNA-seq", 0.10, "species-level literature prior"),
    ("mouse", "global", "scRNA-seq", 0.05, "species-level literature prior"),
    ("human", "adipose", "adipose tissue scRNA-seq", 0.10, "species-level prior with tissue caution"),
    ("mouse", "heart", "heart tissue scRNA-seq", 0.05, "species-level prior with tissue caution"),
    ("mouse", "kidney", "kidney tissue scRNA-seq", 0.05, "species-level prior with tissue caution"),
    ("human", "PBMC", "peripheral blood mononuclear cells", 0.10, "species-level prior with PBMC caution"),
]
SOURCE, DOI = "Osorio and Cai 2021", "https://doi.org/10.1093/bioinformatics/btaa751"

# Accession, species, tissue, context, journal, year, annotations, priority, status.
MANIFEST = [
    ("GSE135893", "human", "lung", "IPF vs control", "Science Advances", 2020, True, "highest", "in_progress"),
    ("GSE136831", "human", "lung", "IPF/COPD/control", "Science Advances", 2020, True, "high", "planned"),
    ("GSE157996", "human", "lung", "IPF vs healthy", "Journal of Clinical Investigation", 2022, False, "medium", "executed"),
    ("GSE159354", "human", "lung", "ILD/IPF/control", "mixed downstream publications", 2020, False, "medium", "planned"),
    ("GSE159929", "human", "multi-organ", "healthy reference", "Genome Biology", 2020, True, "high", "executed"),
    ("GSE200090", "mouse", "multi-organ", "healthy reference", "Communications Biology", 2022, True, "medium", "executed"),
    ("GSE307046", "rat", "kidney", "CIH/OSA vs normoxia", "Scientific Reports", 2025, False, "exploratory", "executed"),
    ("GSE233285", "pig", "multi-organ", "healthy reference", "bioRxiv / GEO atlas", 2025, False, "medium", "executed"),
    ("GSE176512", "cattle", "liver", "healthy liver reference", "GEO atlas", 2022, False, "exploratory", "executed"),
    ("GSE158117", "cattle", "mammary", "development/lactation reference", "citation missing / GEO atlas", 2023, False, "exploratory", "executed"),
    ("GSE184343", "sheep", "testis", "development reference", "Current Issues in Molecular Biology", 2022, False, "exploratory", "executed"),
    ("GSE224329", "chicken", "PBMC", "healthy immune reference", "BMC Genomics", 2024, False, "exploratory", "in_progress"),
    ("GSE183300", "duck", "lung", "cross-species lung reference", "Nature Communications", 2021, False, "medium", "in_progress"),
]


def reference_table(spark: SparkSession) -> DataFrame:
    rows = [(k, s, t, c, v, "fraction", e, "species_global_prior" + ("" if t == "global" else "_with_tissue_note"), False, SOURCE, DOI, "A prior for review, not a hard filter.") for k, (s, t, c, v, e) in enumerate(REFERENCE)]
    return spark.createDataFrame(rows, "ord int, species string, tissue string, cell_context string, reference_cutoff double, unit string, evidence_level string, reference_scope string, is_tissue_specific boolean, source_short string, doi_or_url string, note string")


def same(c: str, value: str) -> Column:
    return F.lower(F.col(c)) == value.lower()


def reference_cutoffs(spark: SparkSession, species: str | None = None, tissue: str | None = None) -> DataFrame:
    """Rows of the species and tissue, in any case; a tissue without a row falls back to the species' global row."""
    out = reference_table(spark)
    if species is not None:
        out = out.where(same("species", species))
    if tissue is not None:
        level = F.when(same("tissue", tissue), 0).when(same("tissue", "global") & F.lit(species is not None), 1)
        ranked = out.withColumn("level", level).where("level is not null")
        best = ranked.agg(F.min("level").alias("level"))
        out = ranked.join(F.broadcast(best), "level").drop("level")  # one row
    return out.drop("ord")


@dataclass(frozen=True)
class Reference:
    cutoff: float | None = None
    species: str | None = None
    tissue: str | None = None
    source: str | None = None
    found: bool = False


def reference_for(species: str | None = None, tissue: str | None = None, given: float | None = None, table: DataFrame | None = None) -> Reference:
    """A given cutoff; else the exact tissue's, else the species' global row; the first row counts."""
    if given is not None:
        return Reference(mito_cutoff(given, "reference_cutoff"), species, tissue, "user_provided", True)
    if species is None and tissue is None:
        return Reference()
    if table is None:
        rows = [(s, t, c, SOURCE) for s, t, _, c, _ in REFERENCE]
    else:
        missing = {"species", "tissue", "reference_cutoff"} - set(table.columns)
        if missing:
            raise ValueError(f"reference table lacks {', '.join(sorted(missing))}")
        some = table if species is None else table.where(same("species", species))
        some = some if tissue is None else some.where(same("tissue", tissue) | same("tissue", "global"))
        source = F.col("source_short") if "source_short" in table.columns else F.lit(None).cast("string")
        rows = [tuple(r) for r in some.select("species", "tissue", "reference_cutoff", source).collect()]  # a table of parameters
    low = lambda x: (x or "").lower()
    fits = [r for r in rows if species is None or low(r[0]) == low(species)]
    exact = [r for r in fits if tissue is None or low(r[1]) == low(tissue)]
    if not exact and species is not None:
        exact = [r for r in fits if low(r[1]) == "global"]
    if not exact:
        return Reference(None, species, tissue)
    s, t, c, source = exact[0]
    return Reference(mito_cutoff(c, "reference_cutoff"), s, t, source, True)


def manifest(spark: SparkSession, role: list[str] | None = None, species: list[str] | None = None, tissue: list[str] | None = None) -> DataFrame:
    """Public studies for validation; filters are lists and tell cases apart."""
    roles = ["main_text"] + ["independent_validation"] * 3 + ["supplementary_extension"] * 9
    rows = [(a, s, t, d, j, y, a, r, True, n, False, p, st) for (a, s, t, d, j, y, n, p, st), r in zip(MANIFEST, roles, strict=True)]
    out = spark.createDataFrame(rows, "dataset_id string, species string, tissue string, disease_context string, journal string, year int, accession_or_portal string, role string, has_raw_counts boolean, has_author_annotations boolean, availability_validated boolean, manuscript_priority string, status string")
    for name, values in (("role", role), ("species", species), ("tissue", tissue)):
        if values is not None:
            out = out.where(F.col(name).isin([values] if isinstance(values, str) else list(values)))
    return out


def methods(spark: SparkSession) -> dict[str, DataFrame]:
    """What detection can be asked for, with the defaults marked."""
    named = lambda names, default: spark.createDataFrame([(n, n == default) for n in names], "method string, `default` boolean")
    return {
        "loss_tests": named(LOSS_TESTS, "mad_zscore"),
        "p_adjust_methods": named(("none", *ADJUSTMENTS), "BH"),
        "sample_cutoff_methods": named(SELECTIONS, "largest_drop"),
        "final_cutoff_rule": spark.createDataFrame([("sample_supported_global_cutoff", True)], "rule string, `default` boolean"),
    }
