"""From raw documents to token ids: five stages, each a table that the next one reads."""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.llm import quality_classifier, sentencepiece_codec, simhash_dedup, source_mixing, substring_dedup
from protomill.llm.common import numbered, read_table, stored
from protomill.llm.queries import SOURCE_WEIGHTS, vocabulary

#: Near duplicates have a Jaccard similarity of 0.8 or more between their sets of five-word shingles, which is counted exactly.  Candidates come from the
#: vantage-point tree over SimHash fingerprints and, beyond its bits, from shared minima.  SimHash bits also tell which candidates are compared: a pair at 0.8 differs in a bit with probability 0.1875 at most (4 of 5 shingles; 0.161 from 12 shingles on, 0.152 for long
#: texts), so the bounds are the mean and four standard deviations of 64 bits (12 + 4 x 3.12) and of four lanes' 256 (48 + 4 x 6.24), rounded up.
FIRST_LANE_BITS, ALL_LANES_BITS, LANES, SIMILARITY = 25, 73, 4, 0.8
#: Files of a stored table whose first places are broadcast (about 10 MB).
BROADCAST_FILES = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A score depends on the text alone: rows that repeat, and texts under several ids, stay or go together; null and empty texts have the score of no bytes.
    """
    net = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    plain, names = numbered(docs, ["text"])
    scored = quality_classifier.score(plain, net, names)
    return scored.where("predicted = 1").select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of the documents that are linked by the similarity of their shingles: the one with the smallest id.

    Rows are told apart by id and text.  Rows without an id come last in a group and are one group only if their texts are linked; of rows that repeat, one
    stays.  Texts under the same id are documents of their own.
    """
    plain, names = numbered(docs, ["doc_id", "text"])
    return simhash_dedup.one_of_each(plain, FIRST_LANE_BITS, ALL_LANES_BITS, SIMILARITY, words=5, lanes=LANES).select(*names).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that stand elsewhere too go; texts without any are unchanged, and all rows stay."""
    plain, names = numbered(docs, ["doc_id", "text", "n_chars"])
    left = substring_dedup.remove_duplicates(plain, [c for c in names if c not in ("text", "n_chars")], texts=True)
    length = F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])
    return left.withColumns({"text": F.col("kept_text"), "n_chars": length}).select(*names).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order in which sources are interleaved to their target weights.

    Null sources are a source of their own.  Rows are ordered by id, null first, and then by text; rows that repeat follow each other, and all stay.
    """
    plain, names = numbered(docs, ["doc_id", "text", "source"])
    mixed = source_mixing.mix(plain, SOURCE_WEIGHTS, tie_cols=["text"])
    return source_mixing.in_order(mixed).select(*names).toDF(*docs.columns)


def with_place(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and __place, the row's number (from 0) in a stored table whose files were written in order.

    Readers pack files by size and promise no order, so the place comes from a row's file and its index there.  The driver adds up one count for each file,
    of which there are as many as tasks that wrote them; the sums are broadcast up to ``BROADCAST_FILES``.
    """
    name = F.col("_metadata.file_name")
    try:
        rows = docs.select(*columns, name.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not read from files
        return with_place(stored(docs, "ordered"), columns)
    # files of a write: part-<task>-<id>-c<number>
    number = [F.regexp_extract(name, p, 1).cast("long") for p in (r"^part-([0-9]+)", r"-c([0-9]+)[^-]*$")]
    files = docs.groupBy(number[0].alias("p"), number[1].alias("c"), name.alias("__file")).count().collect()
    files.sort(key=lambda r: (r["p"] or 0, r["c"] or 0, r["__file"]))
    before = accumulate((r["count"] for r in files), initial=0)
    table = docs.sparkSession.createDataFrame([(r["__file"], n) for r, n in zip(files, before, strict=False)], "__file string, __before long")
    table = F.broadcast(table) if len(files) <= BROADCAST_FILES else table
    return rows.join(table, "__file").select(*columns, (F.col("__before") + F.col("__row")).alias("__place"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, checked by decoding them, and its place in the mixture.

    One row for each document, also for rows that repeat, which have places of their own; null and empty texts have the end id only.
    """
    placed = with_place(docs, ["doc_id", "source", "text"])
    found = sentencepiece_codec.encode_decode(placed, vocabulary("piece_bpe_32k.model"), ["doc_id", "source", "__place"])
    return found.withColumnRenamed("__place", "place")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: No stage but the passages' can be expressed in SQL.  Tests hold near duplicates, passages and places against brute-force versions, the mixture
#: against a schedule of its rules, tokens against the library and the classifier's scores against their definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
