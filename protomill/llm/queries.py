"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.llm import (
    jpeg_media,
    license_scan,
    merkle_manifest,
    multi_index,
    quality_classifier,
    sentencepiece_codec,
    simhash_dedup,
    source_mixing,
    substring_dedup,
    token_counts,
    tokenizer_alignment,
    toxicity,
    url_filter,
)
from protomill.llm.common import read_table

#: (verdict, host, path) of the rules that op2 judges by.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Target weights of op3 and the pipeline; sources without one have weight 1.
SOURCE_WEIGHTS = {"src0": 5}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode_decode(docs, vocabulary("piece_bpe_32k.model"), ["doc_id"])


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list that op2 blocks: canonical URLs that were crawled as numbered listings (``page=`` in the query)."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listing = pages.where(F.col("url").rlike(r"[?&]page=[0-9]"))
    return listing.select(url_filter.canonical_url(host, path).alias("canonical")).distinct()


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, URL_RULES, listed_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return source_mixing.mix(docs, SOURCE_WEIGHTS)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_duplicates(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(read_table(spark, sf_dir, "documents"))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(read_table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, net, ["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ["doc_id"])


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media_columns(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        "doc_id",
        "lang",
        merkle_manifest.leaf_digest(*fields, F.col("text")).alias("leaf"),
        F.when(tampered, F.unhex(merkle_manifest.leaf_digest(*fields, lowered))).alias("altered"),
    )
    rows = merkle_manifest.manifest(leaves, ["doc_id", "altered"])
    now = F.coalesce(F.lower(F.hex("altered")), F.col("leaf"))
    rows = rows.withColumns({"proof_sha256": merkle_manifest.proof_digest(F.col("proof")), "folded_root": merkle_manifest.fold(now, F.col("proof"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return tokenizer_alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), ["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  without it, this subpackage's queries don't count as present

    own = (
        op1_sentencepiece,
        op2_url_filter,
        op3_source_mixing,
        op4_license_scan,
        op5_substring_dedup,
        op6_simhash_dedup,
        op7_nearest_vectors,
        op8_quality_classifier,
        op9_token_counts,
        op10_jpeg_media,
        op11_merkle_manifest,
        op12_toxicity,
        op13_tokenizer_alignment,
        pipeline,
    )
    return {f.__name__: f for f in own}


_FIELDS = "concat_ws('', {}, {}, {}, {}, {})".format(*[f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")])
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""
_HOST = "translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({_FIELDS.format(text="text")}) AS leaf,
         CASE WHEN {_CRC32} % 3 = 0 THEN sha256({_FIELDS.format(text=_LOWERED)}) END AS altered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes(level, lang, pos, node, n) AS (
  SELECT 0, lang, pos, leaf, n FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 8
), subroots AS (
  SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM nodes WHERE n = 1
), upper(level, pos, node, n) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, pos // 8
), runs AS (
  SELECT level, lang, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM nodes WHERE n > 1 GROUP BY ALL
), upper_runs AS (
  SELECT level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM upper WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.r, g.level AS k, (p.pos // (8 ** g.level)::BIGINT) % 8 AS place, g.nodes
  FROM placed p JOIN runs g ON g.lang IS NOT DISTINCT FROM p.lang AND g.run = p.pos // (8 ** (g.level + 1))::BIGINT
  UNION ALL
  SELECT p.r, s.height + g.level, (s.tree // (8 ** g.level)::BIGINT) % 8, g.nodes
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN upper_runs g ON g.run = s.tree // (8 ** (g.level + 1))::BIGINT
), sides AS (
  SELECT r, k, coalesce(array_to_string(nodes[1 : place], ''), '') AS before, coalesce(array_to_string(nodes[place + 2 :], ''), '') AS after FROM steps
), proofs AS (
  SELECT r, string_agg(before || after, '' ORDER BY k) AS siblings FROM sides GROUP BY r
), folded(r, k, h) AS (
  SELECT r, 0, coalesce(altered, leaf) FROM placed
  UNION ALL
  SELECT f.r, f.k + 1, sha256(s.before || f.h || s.after) FROM folded f JOIN sides s ON s.r = f.r AND s.k = f.k
), last AS (
  SELECT r, arg_max(h, k) AS folded_root FROM folded GROUP BY r
), root AS (
  SELECT node AS root FROM upper WHERE n = 1
)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(f.siblings, '')) AS proof_sha256, l.folded_root, l.folded_root = root.root AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN last l ON l.r = p.r LEFT JOIN proofs f ON f.r = p.r, root
""",
    "op2_url_filter": f"""
WITH parts AS (
  SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') END AS canonical
  FROM parts
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, url, h || p AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id, url ORDER BY length(h || p) DESC, h || p) AS place
  FROM named, rules r
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE regexp_matches(url, '[?&]page=[0-9]') AND canonical IS NOT NULL
)
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named n
LEFT JOIN fits f ON f.page_id = n.page_id AND f.url = n.url AND f.place = 1
LEFT JOIN listed l ON l.canonical = n.canonical
""",
    "op5_substring_dedup": """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM split)
), again AS (
  SELECT body FROM windows GROUP BY body HAVING count(*) > 1
), starts AS (
  SELECT doc_id, i FROM windows SEMI JOIN again USING (body)
), each_word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), marked AS (
  SELECT w.doc_id, w.word, w.i,
         coalesce(max(s.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM each_word w LEFT JOIN starts s ON s.doc_id = w.doc_id AND s.i = w.i
), rest AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS body
  FROM marked GROUP BY doc_id
)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM split s LEFT JOIN rest r USING (doc_id)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
