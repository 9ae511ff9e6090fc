"""Sinks (A6–A9): corpus text, training blocks, piece table, metric log.

Every sink writes many part files in parallel into a folder (never one file
through one task); readers take the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import mix as M
from quire.operators import offsets as O
from quire.operators import order as D
from quire.session import stored
from quire.sources import registry as R

GIB = 1024**3


def corpus_lines(
    spark: SparkSession,
    registry: R.SourceRegistry,
    mix: dict[str, float] | None = None,
    *,
    max_documents: int = 1_000_000,
    max_bytes: int = 4 * GIB,
    seed: int = 42,
    check_every: int = 1000,
    terminators=(T.SENTENCE_TERMINATOR,),
) -> DataFrame:
    """The corpus the writer would produce (A6): mix with ``all_exhausted``,
    seeded shuffle, sentence break, then the document cap (D6) and the byte
    cap checked every ``check_every`` rows (D7). ``(pos, doc_id, body)`` where
    ``body`` is a document's text with line breaks, without its last newline.
    NULL text is dropped at the source (the sequential writer cannot write it)."""
    options.check(max_documents=(max_documents, options.COUNT), max_bytes=(max_bytes, options.COUNT), check_every=(check_every, options.COUNT))
    choice = M.Choice.of(registry, M.recommended_mix("balanced") if mix is None else mix)
    genres, weights = list(choice.genres), list(choice.weights)
    sources = R.read_sources(spark, registry, genres).where(F.col("text").isNotNull())
    plan = M.interleave_plan(spark, sources, genres, weights, seed=seed, strategy="all_exhausted")
    # order, caps and byte counts on narrow rows; the text joins only the kept rows
    shuffled = D.seeded_shuffle(plan.rows.select("k", "genre", "doc_id", "salt"), seed, ["doc_id", "k"], n_rows=plan.n, out="pos")
    body = T.sentence_break(F.col("text"), terminators)
    sizes = sources.select("doc_id", "genre", F.octet_length(body).alias("nbytes"))
    # what is left after a cap is written: it is read several times, and if it is small the texts need not be shuffled
    first = stored(shuffled.where(F.col("pos") < max_documents).select("pos", "genre", "doc_id", "salt"), "corpus-order")
    sized = plan.attach(first, sizes)
    bk = O.position_bucketing("pos", min(plan.n, max_documents), spark)
    capped = D.corpus_byte_cap(
        sized, max_bytes, bk, max_documents=max_documents, check_every=check_every, weight=F.col("nbytes")
    )
    texts = sources.select("doc_id", "genre", body.alias("line")).select(
        "doc_id", "genre", F.expr("substring(line, 1, length(line) - 1)").alias("body")
    )
    kept = stored(capped.select("pos", "genre", "doc_id", "salt"), "corpus-kept")
    return plan.attach(kept, texts).select("pos", "doc_id", "body")


def write_corpus(lines: DataFrame, out_dir: str) -> str:
    """Write corpus lines as text part files, in stream order (range-partitioned sort)."""
    lines.orderBy("pos").select("body").write.mode("overwrite").text(out_dir)
    return out_dir


MANIFEST = "_manifest"  # readers of the folder pass over names with an underscore


def write_blocks(blocks: DataFrame, out_dir: str, ordered: bool = False) -> str:
    """Training blocks as parquet partitioned by shard (A7), in stream order, with a manifest.

    Blocks are dealt in ranges of (shard, block) and sorted, so every file holds consecutive
    blocks of one shard in order; with ``ordered`` the partitions are such ranges already, and
    no block is moved. The manifest has a row per file: shard, first_block,
    last_block, n_blocks, file (relative to ``out_dir``). It is written aside and moved into
    place last, in one step: a folder with a manifest is complete.
    """
    spark = blocks.sparkSession
    dealt = blocks if ordered else blocks.repartitionByRange("shard", "block_id")
    dealt = dealt.sortWithinPartitions("shard", "block_id")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(out_dir)
    files = spark.read.parquet(out_dir).select("shard", "block_id", F.col("_metadata.file_path").alias("path"))
    rows = files.groupBy("shard", "path").agg(
        F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"), F.count("*").alias("n_blocks")
    )
    file = F.regexp_extract("path", "(shard=[^/]*/[^/]*)$", 1).alias("file")
    manifest = rows.select("shard", "first_block", "last_block", "n_blocks", file)
    manifest.write.mode("overwrite").parquet(f"{out_dir}/{MANIFEST}-new")
    folder = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    made, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{n}") for n in (f"{MANIFEST}-new", MANIFEST))
    if not fs.rename(made, place):
        raise RuntimeError(f"the manifest could not be moved to {place}")
    return out_dir


def read_blocks(spark: SparkSession, out_dir: str) -> DataFrame:
    """The blocks of :func:`write_blocks` with ``place``, their position in their shard as a trainer gets them that
    reads the shard's files in the manifest's order, row after row. A folder without a manifest is an error."""
    manifest = spark.read.parquet(f"{out_dir}/{MANIFEST}")
    before = Window.partitionBy("shard").orderBy("first_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)).alias("base"))  # a row per file
    rows = spark.read.parquet(out_dir).withColumns({
        "file": F.regexp_extract(F.col("_metadata.file_path"), "(shard=[^/]*/[^/]*)$", 1), "row": F.col("_metadata.row_index")
    })
    return rows.join(F.broadcast(bases), "file").withColumn("place", F.col("base") + F.col("row")).drop("file", "row", "base")


def write_pieces(pieces: DataFrame, out_dir: str) -> str:
    """Piece table (A8) as parquet and JSON lines; bounded by the vocabulary size."""
    pieces.write.mode("overwrite").parquet(f"{out_dir}/parquet")
    pieces.orderBy("id").coalesce(1).write.mode("overwrite").json(f"{out_dir}/json")
    return out_dir


def append_metrics(metrics: DataFrame, out_dir: str) -> str:
    """Append ``(run, step, tag, value)`` rows, or with ``text`` those of samples too, to the metric log."""
    metrics.write.mode("append").parquet(out_dir)
    return out_dir


def make_corpus(spark: SparkSession, registry: R.SourceRegistry, out_dir: str, mix: dict[str, float] | None = None,
                **kw) -> str:
    """Corpus text files for vocabulary training (A6): :func:`corpus_lines`
    written by :func:`write_corpus`. Returns the folder."""
    return write_corpus(corpus_lines(spark, registry, mix, **kw), out_dir)
