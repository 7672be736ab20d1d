"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import fingerprints, jaccard, kneserney, langid, mixing, pieces, sharding, topk, toxicity, urlfilter
from docloom.session import scratch, table

Query = Callable[[SparkSession, str], DataFrame]

RULES = (urlfilter.Rule("net/", "block"), urlfilter.Rule("example.net/en/", "allow"), urlfilter.Rule("example.com/de/", "block"), urlfilter.Rule("org/fr/", "allow"))


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every page's URL judged by RULES."""
    return urlfilter.url_filter(table(spark, d, "pages"), RULES)


def remainder(n: int, id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document, learned from the folds 1 to 4 of 5."""
    docs = table(spark, d, "documents")
    model = langid.learn(docs, remainder(5) != 0)
    found = langid.predict(docs, model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "languages", "shares")


def op3_exact_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The five best rows for each row of embeddings whose id is divisible by 50."""
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


#: Words of an n-gram of the language model.
LM_ORDER = 3


def op4_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    """The log10 probability of every document by a model of order LM_ORDER, learned from the folds 1 to 9 of 10."""
    found = kneserney.score(table(spark, d, "documents"), remainder(10) != 0, order=LM_ORDER)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard.join(table(spark, d, "documents"))


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of the folds 1 to 4 of 5."""
    docs = table(spark, d, "documents")
    model = toxicity.learn(docs, table(spark, d, "labels"), remainder(5) != 0)
    return toxicity.predict(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


#: The SentencePiece model that is used where the session's PIECES_SETTING names no other; its place is a parameter, never part of the repository.
PIECES_SETTING, PIECES_MODEL = "docloom.pieces.model", "/opt/tokenizers/piece_bpe_32k.model"


def pieces_model(spark: SparkSession) -> bytes:
    """The model file's content, read on the driver."""
    path = spark.conf.get(PIECES_SETTING, PIECES_MODEL)
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as error:
        raise FileNotFoundError(f"No SentencePiece model at {path}; name one in the session's setting {PIECES_SETTING}.") from error


def op7_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    return pieces.encode_documents(table(spark, d, "documents"), pieces_model(spark))


def op9_order_minhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_pairs(table(spark, d, "documents"))


N_OLD_SHARDS, N_SHARDS = 16, 24


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    """documents from 16 shards by CRC of the id to 24 shards of equal bytes, as the rewritten files have them."""
    placed = sharding.rewrite(table(spark, d, "documents"), remainder(N_OLD_SHARDS), N_OLD_SHARDS, N_SHARDS, scratch(spark, "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def domain_of(source: str = "source") -> F.Column:
    """The four domains of the production tree: sources numbered alike modulo 4 are one domain."""
    return F.concat(F.lit("domain"), F.coalesce(F.pmod(F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(4)), F.lit(0)).cast("string"))


def mix_levels() -> dict[str, F.Column]:
    return {"domain": domain_of(), "lang": F.col("lang"), "source": F.col("source")}


#: Target weights: of domains, and of languages within the first domain; whatever is not named weighs 1.
MIX_WEIGHTS = {("domain0",): 4.0, ("domain1",): 2.0, ("domain2",): 1.0, ("domain3",): 1.0, ("domain0", "en"): 3.0}


def op10_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Half of all tokens given out by MIX_WEIGHTS, with up to two epochs of a leaf."""
    return mixing.mix(table(spark, d, "documents"), mix_levels(), MIX_WEIGHTS)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_exact_top_k, op4_lm_scoring, op5_jaccard_join, op6_toxicity, op7_sentencepiece, op8_sharding, op9_order_minhash, op10_source_mixing)}
