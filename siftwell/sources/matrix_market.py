"""Readers: 10x-style Matrix Market folders as long count tables, Parquet cells, and loaders that label them."""

from __future__ import annotations

import os
import tarfile
import urllib.request

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.operators.features import cell_metrics, creation_filters, mito_features

EXPRESSION = "Gene Expression"


def either(folder: str, *names: str) -> str | None:
    """The first of the names that is there, plain or gzipped."""
    for n in names:
        for x in (n, f"{n}.gz"):
            if os.path.isfile(os.path.join(folder, x)):
                return os.path.join(folder, x)
    return None


def find_folder(root: str) -> str:
    """The first folder below root with a matrix, barcodes, and features or genes."""
    for folder, dirs, _ in os.walk(root):
        dirs.sort()
        if either(folder, "matrix.mtx") and either(folder, "barcodes.tsv") and either(folder, "features.tsv", "genes.tsv"):
            return folder
    raise FileNotFoundError(f"no Matrix Market folder below {root}")


def cache_folder(path: str | None) -> str:
    if not path:
        raise ValueError("a cache folder is needed")
    os.makedirs(path, exist_ok=True)
    return path


def local_file(path: str) -> str:
    if not os.path.isfile(path) or not os.path.getsize(path):
        raise FileNotFoundError(f"{path} is no file or empty")
    return path


def fetched(urls: list[str], cache: str, name: str) -> str:
    """The cached file if it isn't empty, else the first URL that gives one."""
    target = os.path.join(cache_folder(cache), name)
    if os.path.isfile(target) and os.path.getsize(target):
        return target
    errors = []
    for url in urls:
        try:
            urllib.request.urlretrieve(url, target)
            return local_file(target)
        except OSError as e:
            errors.append(f"{url}: {e}")
    raise OSError("; ".join(errors) or "no URL")


def unpacked(archive: str, into: str) -> str:
    with tarfile.open(archive) as t:
        t.extractall(into, filter="data")
    return find_folder(into)


def numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small tab-separated file with 1-based line numbers. The file is one partition (names of cells or features)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("i", "line"))
    parts = F.split("line", "\t")
    names = schema.split()
    return rows.select((F.col("i") + 1).cast("long").alias("i"), *(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)))


def read_matrix_market(spark: SparkSession, folder: str, modality: str | None = EXPRESSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """counts (cell_id, feature, count), features (feature, gene_name, modality), cells (cell_id).

    Entries split over tasks as any text file does; names join by number. Repeated gene names get .1, .2 and so on.
    """
    matrix, barcodes, names = either(folder, "matrix.mtx"), either(folder, "barcodes.tsv"), either(folder, "features.tsv", "genes.tsv")
    if not (matrix and barcodes and names):
        raise FileNotFoundError(f"{folder} holds no matrix, barcodes and features")
    features = numbered(spark, names, "gene_id gene_name modality")
    if modality is not None:
        features = features.where(F.coalesce("modality", F.lit(modality)) == modality)
    again = F.row_number().over(Window.partitionBy("gene_name").orderBy("i")) - 1
    named = F.coalesce("gene_name", "gene_id")
    features = features.withColumn("k", again).withColumn("feature", F.when(F.col("k") > 0, F.concat_ws(".", named, "k")).otherwise(named))
    cells = numbered(spark, barcodes, "cell_id")
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(matrix).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    entries = lines.select(F.get(fields, F.lit(0)).cast("long").alias("f"), F.get(fields, F.lit(1)).cast("long").alias("c"), F.get(fields, F.lit(2)).cast("double").alias("count"))
    # the size line (features, cells, entries) reads like an entry of the last feature and cell: of such lines, one goes
    size = lines.limit(1).select(*(F.get(fields, F.lit(k)).cast("double") for k in range(3))).first()
    if size is not None:
        alike = (F.col("f") == size[0]) & (F.col("c") == size[1])
        last = entries.where(alike & (F.col("count") != size[2])).unionByName(entries.where(alike & (F.col("count") == size[2])).limit(2).groupBy("f", "c", "count").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        entries = entries.where(~alike).unionByName(last)
    counts = entries.join(features.select(F.col("i").alias("f"), "feature"), "f").join(cells.select(F.col("i").alias("c"), "cell_id"), "c").select("cell_id", "feature", "count")
    return counts, features.select("feature", "gene_name", "gene_id", "modality"), cells.select("cell_id")


def load_folder(spark: SparkSession, folder: str, labels: dict[str, str] | None = None, species: str = "human", add_mito: bool = True, column: str = "mitoRatio", min_cells: int = 3, min_features: int = 200) -> tuple[DataFrame, DataFrame]:
    """cells (with counts, fraction and constant labels) and counts of a folder, after the creation filters."""
    counts, features, _ = read_matrix_market(spark, find_folder(folder))
    counts = creation_filters(counts, min_cells, min_features)
    mito = mito_features(features, species) if add_mito else features.select("feature").limit(0)
    cells = cell_metrics(counts, mito, column=column)
    cells = cells if add_mito else cells.drop(column)
    return cells.withColumns({k: F.lit(v) for k, v in (labels or {}).items()}), counts


# Labels of the public example sets.
EXAMPLES = {
    "pbmc3k": {"dataset": "pbmc3k", "sample": "pbmc3k", "species": "human", "tissue": "PBMC"},
    "heart10k": {"dataset": "heart10k", "sample": "heart10k", "species": "mouse", "tissue": "heart"},
    "mousebrain5k": {"dataset": "mousebrain5k", "sample": "mousebrain5k", "species": "mouse", "tissue": "brain"},
}


def load_example(spark: SparkSession, name: str, path: str | None = None, urls: list[str] = (), cache: str | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """A public set from a local folder or archive, or from URLs by way of a cache folder."""
    if name not in EXAMPLES:
        raise ValueError(f"one of {', '.join(EXAMPLES)}")
    if path is None:
        path = fetched(list(urls), cache_folder(cache), f"{name}.tar.gz")
    if path.endswith((".h5", ".hdf5")):
        raise ValueError("HDF5 has no Spark source: convert the file to Matrix Market or Parquet first")
    folder = path if os.path.isdir(path) else unpacked(local_file(path), os.path.join(cache_folder(cache), name))
    labels = EXAMPLES[name]
    return load_folder(spark, folder, labels, labels["species"], **more)


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """A cell table in Parquet; serialised objects of other systems can't be read."""
    if path.endswith(".rds"):
        raise ValueError("RDS objects can't be read: export cells and counts to Parquet first")
    return spark.read.parquet(path)
