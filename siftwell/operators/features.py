"""Mitochondrial features and fractions from long count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.schema import check_columns, checked_ratio

# Gene symbols and name patterns by species.
BARE = ("ND1", "ND2", "COX1", "COX2", "ATP8", "ATP6", "COX3", "ND3", "ND4L", "ND4", "ND5", "ND6", "CYTB", "12S", "16S", "RNR1", "RNR2")
HUMAN = ("MT-ND1", "MT-ND2", "MT-CO1", "MT-CO2", "MT-ATP8", "MT-ATP6", "MT-CO3", "MT-ND3", "MT-ND4L", "MT-ND4", "MT-ND5", "MT-ND6", "MT-CYB", "MT-RNR1", "MT-RNR2")
MOUSE = ("mt-Nd1", "mt-Nd2", "mt-Co1", "mt-Co2", "mt-Atp8", "mt-Atp6", "mt-Co3", "mt-Nd3", "mt-Nd4l", "mt-Nd4", "mt-Nd5", "mt-Nd6", "mt-Cytb", "mt-Rnr1", "mt-Rnr2")
COMMON = ("^MT-", "^mt-", "^Mt-", "^MT\\.", "^MT_", "^mt\\.", "^mt_", "^mitochondrial")
HUMAN_NAMES = ("^MT-", "^MT\\.", "^MT_")
RODENT_NAMES = ("^mt-", "^Mt-", "^MT-", "^mt\\.", "^MT\\.", "^mt_", "^MT_")
LIVESTOCK = ("pig", "cow", "cattle", "sheep", "goat", "chicken", "duck", "goose")
METADATA = ("gene_name", "gene_short_name", "symbol", "feature_name", "name")
SPECIES = ("auto", "human", "mouse", "rat", *LIVESTOCK, "mixed")


def resolved_species(species: str | None) -> str:
    """One of SPECIES; a prefix that fits just one of them will do."""
    species = species or "auto"
    if species in SPECIES:
        return species
    fits = [s for s in SPECIES if s.startswith(species)]
    if len(fits) != 1:
        raise ValueError(f"species must be one of {', '.join(SPECIES)}")
    return fits[0]


def presets(species: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Patterns and exact symbols of a species."""
    s = resolved_species(species)
    patterns = {"human": HUMAN_NAMES, "mouse": RODENT_NAMES, "rat": RODENT_NAMES}.get(s, COMMON)
    rodent = tuple(dict.fromkeys(MOUSE + HUMAN))
    exact = {"human": HUMAN, "mouse": rodent, "rat": rodent, "mixed": tuple(dict.fromkeys(BARE + HUMAN + MOUSE)), "auto": ()}.get(s, BARE)
    return patterns, exact


def matches(name: Column, patterns: tuple[str, ...], exact: tuple[str, ...], any_case: bool) -> Column:
    regex = "|".join(f"(?:{p})" for p in patterns)
    found = name.rlike(f"(?i){regex}" if any_case else regex) if patterns else F.lit(False)
    if exact:
        found = found | (F.upper(name).isin([x.upper() for x in exact]) if any_case else name.isin(list(exact)))
    return F.coalesce(found, F.lit(False))


def mito_features(features: DataFrame, species: str | None = None, listed: list[str] | None = None, pattern: str | list[str] | None = None) -> DataFrame:
    """feature, source: the matches of the first stage of the cascade that has any.

    Stages: a given list; feature names as they are; in any case; then each metadata column, as it is and in any case.
    Every stage is a flag of one pass over the features; the least stage with a match wins.
    """
    if listed is not None:
        return features.where(F.col("feature").isin(list(listed))).select("feature", F.lit("user_supplied_features").alias("source")).distinct()
    patterns, exact = presets(species)
    if pattern is not None:
        patterns = (pattern,) if isinstance(pattern, str) else tuple(pattern)
    stages = [("feature", "feature_names", False), ("feature", "feature_names_case_insensitive", True)]
    stages += [(c, f"feature_metadata:{c}", any_case) for c in METADATA if c in features.columns for any_case in (False, True)]
    hits = F.array_compact(F.array(*(F.when(matches(F.col(c).cast("string"), patterns, exact, i), F.lit(k)) for k, (c, _, i) in enumerate(stages))))
    marked = features.where("feature is not null").select("feature", F.explode(hits).alias("stage"))
    first = marked.agg(F.min("stage").alias("stage"))
    named = F.element_at(F.array(*(F.lit(s) for _, s, _ in stages)), F.col("stage") + 1)
    return marked.join(F.broadcast(first), "stage").select("feature", named.alias("source")).distinct()  # first is one row


def cell_metrics(counts: DataFrame, mito: DataFrame, scale: str = "fraction", column: str = "mitoRatio", keys: list[str] = ()) -> DataFrame:
    """One row a cell: nFeature_RNA, nCount_RNA and the mitochondrial fraction (or per cent); null for a cell without counts.

    counts: cell_id, feature, count, and `keys` that a cell has one value of. The mito features are a few names out of a
    feature table; Spark broadcasts them by their size or joins by shuffle.
    """
    flagged = counts.join(mito.select("feature", F.lit(True).alias("__mito")).distinct(), "feature", "left")
    total, part = F.sum("count"), F.sum(F.when(F.col("__mito"), F.col("count")).otherwise(0))
    ratio = F.try_divide(part.cast("double"), total.cast("double"))
    return flagged.groupBy("cell_id", *keys).agg(F.count_if(F.col("count") > 0).alias("nFeature_RNA"), total.alias("nCount_RNA"), (ratio * 100 if scale == "percent" else ratio).alias(column))


def ensure_mito_ratio(cells: DataFrame, counts: DataFrame | None = None, features: DataFrame | None = None, column: str = "mitoRatio", species: str | None = None, listed: list[str] | None = None, pattern: str | list[str] | None = None, overwrite: bool = False, convert_percent: bool = True, auto_add: bool = True) -> DataFrame:
    """cells with a valid fraction column: the existing one checked, or a new one from counts (cell_id, feature, count)."""
    if column in cells.columns and not overwrite:
        return checked_ratio(cells, column, convert_percent)
    if not auto_add:
        raise ValueError(f"column {column} is absent and auto_add is off")
    if counts is None:
        raise ValueError(f"column {column} needs counts to be computed from")
    features = counts.select("feature").distinct() if features is None else features
    mito = mito_features(features, species, listed, pattern)
    if mito.isEmpty():
        some = [r[0] for r in features.select("feature").limit(20).collect()]
        raise ValueError(f"no mitochondrial features found for species {species or 'auto'}; first features: {some}")
    return cells.drop(column).join(cell_metrics(counts, mito, column=column).select("cell_id", column), "cell_id", "left")


def add_mito_ratio(cells: DataFrame, counts: DataFrame, scale: str = "fraction", column: str = "mitoRatio", **options) -> DataFrame:
    """Always computes the column, as a fraction or in per cent."""
    if scale not in ("fraction", "percent"):
        raise ValueError("scale must be fraction or percent")
    out = ensure_mito_ratio(cells, counts, column=column, overwrite=True, **options)
    return out.withColumn(column, F.col(column) * 100) if scale == "percent" else out


def ratio_provenance(column: str, species: str | None, source: str, features: list[str]) -> dict:
    return {"column": column, "species": species or "auto", "source": source, "n_features": len(features), "features": sorted(features)}


def creation_filters(counts: DataFrame, min_cells: int = 3, min_features: int = 200) -> DataFrame:
    """Cells with min_features detected features, then features that min_cells of these cells have."""
    check_columns(counts, ["cell_id", "feature", "count"], ["count"])
    seen = counts.where("count > 0")
    cells = seen.groupBy("cell_id").agg(F.countDistinct("feature").alias("n")).where(F.col("n") >= min_features).select("cell_id")
    left = counts.join(cells, "cell_id", "left_semi")
    kept = left.where("count > 0").groupBy("feature").agg(F.countDistinct("cell_id").alias("n")).where(F.col("n") >= min_cells).select("feature")
    return left.join(kept, "feature", "left_semi")
