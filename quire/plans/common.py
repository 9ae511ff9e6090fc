"""Frames shared by the registered queries: documents, the word model, the token stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import encode as E
from quire.operators import order as D
from quire.operators import vocab as V
from quire.plans import params as P
from quire.sources import registry as R

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# tables whose rows carry heavy per-row work (text, vectors), with their id column
TEXT_TABLES = {
    "documents": "doc_id", "conversations": "conv_id", "benchmark": "item_id", "pages": "page_id", "embeddings": "vec_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables are spread where the caller asks for it (see ``spread_scan``)."""
    from quire.session import spread_scan

    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_scan(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def count_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count from the scan (parquet footers), without any redistribution."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, genre) of all documents, genre from the test registry."""
    reg = R.documents_registry(sf_dir)
    return R.read_sources(spark, reg, reg.genres)


_MODEL: dict = {}


def reset_query_scope() -> None:
    """Forget the word model learned for the previous query (called per query)."""
    _MODEL.clear()


_TRAINED: dict = {}


def trained(spark: SparkSession, key: tuple, train):
    """A sub-word vocabulary that several queries use, trained once per application and input."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _TRAINED:
        _TRAINED[key] = train()
    return _TRAINED[key]


def word_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vocab, pieces) of the word model, learned once per query."""
    key = (id(spark), sf_dir, P.VOCAB_SIZE)
    if key not in _MODEL:
        _MODEL[key] = V.learn_word_pieces(spark, table(spark, sf_dir, "documents"), P.VOCAB_SIZE)
    return _MODEL[key]


def word_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned word pieces ``(id, word, piece, cnt)`` over all documents."""
    return word_model(spark, sf_dir)[0]


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full piece table of the word model (specials, bytes, learned words)."""
    return word_model(spark, sf_dir)[1]


def pieces_bound() -> int:
    return T.FIRST_LEARNED_ID + P.VOCAB_SIZE


def encode(spark: SparkSession, sf_dir: str, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return E.encode_words(df, word_vocab(spark, sf_dir), P.VOCAB_SIZE, id_col=id_col, text_col=text_col, keep=keep)


def doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in ``doc_id`` order: ``(doc_id, text, pos, shard)``.

    Shards are contiguous over the raw stream (before unusable rows are
    skipped), as a loader splits its source before tokenizing. Positions are
    ranked on the narrow id column and join back to the text by id.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(positions(spark, sf_dir), "doc_id")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, pos, shard)`` of all documents in ``doc_id`` order."""
    n = count_rows(spark, sf_dir, "documents")
    ids = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id")
    with_pos = D.stream_positions(ids, "doc_id", n_rows=n)
    return with_pos.withColumn("shard", D.contiguous_shard(F.col("pos"), n, P.SHARDS))


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable encoded documents of the stream: ``(shard, pos, doc_id, ids)``."""
    st = doc_stream(spark, sf_dir)
    return encode(spark, sf_dir, st, keep=("shard", "pos"))
