"""Named text sources: registry, split resolution, reads, previews (A1–A5, B1).

A source is declared once (path, format, text column, offered splits and an
optional row predicate) and read lazily with ``spark.read``. Sources that
share a path are read with one scan and labelled by their predicates, so a
registry of many genres over one table costs one pass, not one per genre.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import options

# The split names a source may offer.
SPLITS = ("train", "validation", "test")

# ---------------------------------------------------------------------------
# The six genre names in registry order, and the optional
# config name the last one is loaded with.
# ---------------------------------------------------------------------------
GENRES = ("literature", "wiki", "textbook", "research", "web", "cc100")
CC100_CONFIG_NAME = "ja"


@dataclass(frozen=True)
class SourceSpec:
    """One named source: where it lives and which column holds the text."""

    genre: str
    path: str
    name: str | None = None
    text_column: str = "text"
    available_splits: tuple[str, ...] = ("train",)
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    where: str | None = None  # SQL predicate selecting this source's rows
    id_column: str | None = "doc_id"  # a key of any type; None: rows have a text only (see document_key)


class SourceRegistry:
    """Ordered mapping genre -> SourceSpec with the checks the loaders need."""

    def __init__(self, specs: Iterable[SourceSpec]):
        self._specs = {s.genre: s for s in specs}

    def __contains__(self, genre: object) -> bool:
        return genre in self._specs

    def __getitem__(self, genre: str) -> SourceSpec:
        options.check(genre=(genre, options.one_of(self._specs)))
        return self._specs[genre]

    @property
    def genres(self) -> list[str]:
        return list(self._specs)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s.genre, s.path, s.name, s.text_column, list(s.available_splits), s.format, s.where)
            for s in self._specs.values()
        ]
        schema = (
            "genre string, path string, name string, text_column string, "
            "available_splits array<string>, format string, predicate string"
        )
        return spark.createDataFrame(rows, schema)


def documents_registry(sf_dir: str) -> SourceRegistry:
    """The six genres over the driver's ``documents`` table.

    Genre index = source number mod 6, in registry order; row order inside a
    genre is ``doc_id``.
    """
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    specs = []
    for i, g in enumerate(GENRES):
        specs.append(
            SourceSpec(
                genre=g,
                path=path,
                name=CC100_CONFIG_NAME if g == "cc100" else None,
                where=f"pmod(cast(substr(source, 4) as int), 6) = {i}",
            )
        )
    return SourceRegistry(specs)


def genre_index_expr() -> F.Column:
    """Genre index of a ``documents`` row under :func:`documents_registry`."""
    return F.pmod(F.substring("source", 4, 100).cast("int"), F.lit(6))


def resolve_split(spec: SourceSpec, split: str) -> str:
    """``split`` if the source has it; a name no source can have and one this source lacks are told apart."""
    known = options.one_of(SPLITS)
    rule = options.one_of(spec.available_splits) if known.holds(split) else known
    options.check(**{f"the split read from {spec.genre!r}": (split, rule)})
    return split


def document_key(df: DataFrame, spec: SourceSpec) -> F.Column:
    """``doc_id`` of a source's rows, a long that the ranks can order.

    A whole-number key is taken as it is; a key of another type as its non-negative 64-bit
    hash. Rows without a key are named by where they lie: in Parquet by the hash of file and
    row number, in other formats by split and row number (equal for equal files and splits).
    """
    positive = F.lit((1 << 63) - 1)
    if spec.id_column is None:
        if spec.format == "parquet":
            return F.xxhash64("_metadata.file_path", "_metadata.row_index").bitwiseAND(positive)
        return F.monotonically_increasing_id()
    options.check(id_column=(spec.id_column, options.one_of(df.columns)))
    if df.schema[spec.id_column].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.col(spec.id_column).cast("long")
    return F.xxhash64(spec.id_column).bitwiseAND(positive)


def _labelled(df: DataFrame, spec: SourceSpec, genre: F.Column) -> DataFrame:
    """(doc_id, genre, text) of a scan, with the text column checked."""
    options.check(text_column=(spec.text_column, options.one_of(df.columns)))
    return df.select(document_key(df, spec).alias("doc_id"), genre.alias("genre"), F.col(spec.text_column).cast("string").alias("text"))


def _scan(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Batch scan: any ``spark.read`` format (parquet, json, csv, text, ...) or a catalog table."""
    from quire.session import spread_scan

    read = spark.read.options(**dict(spec.options))
    df = read.table(spec.path) if spec.format == "table" else read.format(spec.format).load(spec.path)
    return spread_scan(df, spec.id_column) if spec.id_column else df  # a row's place is its key: rows stay


def stream_source(spark: SparkSession, registry: SourceRegistry, genre: str, split: str = "train") -> DataFrame:
    """Incremental read of one source (A4): a file stream (or a table stream)
    with the schema of the batch source, text column only. Pair it with
    ``trigger(availableNow=True)`` to process what has arrived."""
    spec = registry[genre]
    resolve_split(spec, split)
    if spec.format == "table":
        df = spark.readStream.table(spec.path)
    else:
        schema = spark.read.format(spec.format).options(**dict(spec.options)).load(spec.path).schema
        df = spark.readStream.format(spec.format).options(**dict(spec.options)).schema(schema).load(spec.path)
    rows = df.where(spec.where) if spec.where else df
    return _labelled(rows, spec, F.lit(genre))


def read_source(spark: SparkSession, registry: SourceRegistry, genre: str, split: str = "train") -> DataFrame:
    """(doc_id, genre, text) of one source; fails at once on a bad split or missing column."""
    spec = registry[genre]
    resolve_split(spec, split)
    df = _scan(spark, spec)
    rows = df.where(spec.where) if spec.where else df
    return _labelled(rows, spec, F.lit(genre))


def read_sources(spark: SparkSession, registry: SourceRegistry, genres: Iterable[str], split: str = "train") -> DataFrame:
    """(doc_id, genre, text) of several sources; one scan per distinct path."""
    genres = list(genres)
    by_path: dict[tuple, list[SourceSpec]] = {}
    for g in genres:
        spec = registry[g]
        resolve_split(spec, split)
        key = (spec.path, spec.format, tuple(sorted(dict(spec.options).items())), spec.text_column, spec.id_column)
        by_path.setdefault(key, []).append(spec)
    parts = []
    for specs in by_path.values():
        first = specs[0]
        df = _scan(spark, first)
        if all(s.where for s in specs):
            label = F.expr(" ".join(["CASE"] + [f"WHEN {s.where} THEN '{s.genre}'" for s in specs] + ["END"]))
        elif len(specs) == 1:
            label = F.lit(first.genre)
        else:
            raise options.OptionError([f"{len(specs)} sources read {first.path}: each needs a predicate that selects its rows"])
        parts.append(_labelled(df, first, label).where(F.col("genre").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview(df: DataFrame, n: int = 3, prefix: str = "Sample", by: str = "genre", order: str = "doc_id") -> DataFrame:
    """First ``n`` rows per source: ``"{prefix} {i}: {first 100 chars}..."``.

    ``row_number() <= n`` lets Spark place a partial group limit before the
    shuffle, so only n rows per source and map task cross the network.
    """
    w = Window.partitionBy(by).orderBy(order)
    ranked = df.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n)
    return ranked.select(
        by,
        F.col("i").cast("long").alias("i"),
        F.concat(F.lit(prefix + " "), F.col("i").cast("string"), F.lit(": "), F.substring("text", 1, 100), F.lit("...")).alias("line"),
    )
