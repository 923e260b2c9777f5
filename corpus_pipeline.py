"""A corpus pipeline over ``documents``: filter, deduplicate, decontaminate and mix.

Each stage takes the documents that the one before kept. All but the last return the columns of
``documents``; the last returns each kept document's id, tokens, domain and rate. A document is a row:
rows with null or repeated ids are judged by their own texts. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkatlas.llm import decontam, mixing, simhash, suffix, toxicity
from linkatlas.llm.common import kept, text_key

#: Bytes of a passage that the suffix-array stage cuts. Passages of over 50 words are longer (the shortest seen has
#: 289 bytes); ``op7_suffix`` has the 400 bytes of its own contract.
PASSAGE = 240


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored toxic (0.5 or more).

    Null, empty and letterless texts score as texts without a toxic passage and stay; repeated rows fare alike;
    long texts are scored whole; an empty table stays empty; other columns, whatever their names, pass through.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxic_passages(docs, model).where("score < 0.5").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, id, key): each row whole, its id and its text's key, so that no other column's name matters."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the smallest id, then the least text key.

    Links are those of ``op4_simhash``: fingerprints of three-word shingles within two bits. (Sets of five-word
    shingles at a similarity of 0.8 are beyond 64-bit fingerprints; see the README.)
    Documents without an id go after those with one; of equal rows one stays; null and empty texts are each
    other's copies; an empty table stays empty; other columns, whatever their names, pass through.
    """
    groups = simhash.simhash_groups(docs.select("doc_id", "text", text_key().alias("th")), 3, "th")
    rows = kept(groups.groupBy("component", "doc_id", "th").agg(F.count("*").alias("n")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("of"), F.col("th").alias("text"), F.col("n").alias("copies")))
    stays = kept(rows.groupBy("component").agg(first.alias("s")).select("s.of", "s.text", "s.copies"), "stays")
    found = _keyed(docs).join(stays, (F.col("key") == F.col("text")) & F.col("id").eqNullSafe(F.col("of")))
    return found.where("copies = 1").select("row.*").unionByName(found.where("copies > 1").dropDuplicates(["id", "key"]).select("row.*"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of ``PASSAGE`` bytes or more that occur twice out of the texts; no document goes.

    Null texts stay null, texts shorter than a passage stay whole; of equal rows all lose the passage, as do all
    other places where it stands; an empty table stays empty; other columns, whatever their names, pass through.
    ``n_chars``, where it is there, is counted anew.
    """
    out = suffix.strip_repeats(docs, PASSAGE)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    cols = {"text": text}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select([(cols[c] if c in cols else F.col("row")[c]).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, each by its own text.

    Null, empty and short texts hold nothing and stay; equal texts fare alike, whatever their ids; empty tables
    stay empty, and an empty benchmark rejects nothing; other columns, whatever their names, pass through.
    """
    texts = docs.select(text_key().alias("key"), "text")
    held = decontam.leaks_by("key", texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("key").alias("held")).distinct()
    held = kept(held, "leaks")
    return _keyed(docs).join(held, F.col("key") == F.col("held"), "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates for the documents that are left: doc_id, n_tokens, domain, p_domain, rate and the domain's totals.

    Null and empty texts have no tokens and get the rate of their posterior; equal rows get equal rates; of
    equally likely domains the first by name is named; an empty table gives no rows; other columns are ignored.
    """
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: SQL expresses neither the fitted models nor the suffix sorting; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
