"""The opN_ queries: whole tables in, whole results out, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, licenses, media, periodic, quality, urls, warc
from .common import Scratch, table
from .decontaminate import find_leaks
from .lines import dedup_lines
from .minhash import near_duplicates
from .mixing import mix
from .sharding import shard
from .toxicity import score, train


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents with the first line of its component (operator 1); see dedup_lines for nulls and repeats."""
    return dedup_lines(table(spark, sf_dir, "documents"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law bytes (operator 2); a null text has size 1 and the checksum of an empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    cut = shard(docs.withColumn("text_crc32", crc), parts=8)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and top probability of every document (operator 3), fitted on all labels; null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    graded = docs.select("doc_id", quality.grade(F.col("text"), model, spark).alias("g"))
    return graded.select("doc_id", F.col("g.expected").alias("expected_grade"), F.col("g.top").alias("top_probability"), (F.col("g.top") >= 0.5).alias("kept"))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document (operator 4), fitted on labels whose id is not held out; a null id is not held out and never fitted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def held(c: str) -> Column:
        return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))

    model = train(docs, table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & ~held("doc_id")))
    scored = docs.select("doc_id", held("doc_id").alias("held_out"), score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op5_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document (operator 5); null texts have size 0, null is a source of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, weights=(5.0, 2.0, 1.0), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies over whole documents (operator 6); null and wordless texts stand alone."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back through both index levels (operator 7); null bodies are empty."""
    folder = Scratch(spark, "archives").folder("pages")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, folder, revisit_from=0)
    # Every page is looked up by its URL; pages of one URL key find each other's captures too, which count once.
    found = warc.lookup(pages.select(F.coalesce("url", F.lit("")).alias("url")), folder).select("file", "offset", "length").distinct()
    records = warc.read_records(found, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window (operator 8); null texts have no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = find_leaks(docs, table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_join(F.array_sort("leak.items"), ",")
    return marked.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document (operator 9); null texts are empty."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored in an ISO media file and read back (operator 10); null texts are empty."""
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op11_split_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every text and its exact way back (operator 11); null texts are empty."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL (operator 12); a null URL has an empty host and path."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.*")
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("strict").cast("long").alias("n_strict"), F.size("soft").cast("long").alias("n_soft"))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text and its digest without them (operator 13); null texts have no words."""
    return periodic.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fuzzy_lines": op1_fuzzy_lines,
    "op2_histogram_sort": op2_histogram_sort,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
    "op5_entropy_balance": op5_entropy_balance,
    "op6_bbit_minhash": op6_bbit_minhash,
    "op7_warc_index": op7_warc_index,
    "op8_suffix_automaton": op8_suffix_automaton,
    "op9_license_rules": op9_license_rules,
    "op10_iso_media": op10_iso_media,
    "op11_split_fim": op11_split_fim,
    "op12_url_vocabulary": op12_url_vocabulary,
    "op13_harmonic_runs": op13_harmonic_runs,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOW.format(f"coalesce({column}, '')")}, '{pattern}')"


#: Plain SQL for the queries that it can express; a window or shingle is its words with a space between.
ORACLE_SQL: dict[str, str] = {
    "op6_bbit_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words_sql("text", _SPACED)} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach(node, label) AS (SELECT doc_id, doc_id FROM w UNION SELECT t.b, r.label FROM reach r JOIN both_ways t ON t.a = r.node),
        least_of AS (SELECT node, min(label) AS label FROM reach GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, label AS component_id, w.doc_id = label AS kept FROM w LEFT JOIN n USING (doc_id) JOIN least_of ON node = w.doc_id""",
    "op7_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM r""",
    "op8_suffix_automaton": f"""
        WITH d AS (SELECT doc_id, {_words_sql("text", _ALNUM)} AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql("text", _ALNUM)} AS ws FROM benchmark),
        bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
        hit AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON bw.k = dw.k AND bw.n = dw.n),
        spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hit GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_url_vocabulary": urls.oracle(),
}
