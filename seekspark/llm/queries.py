"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, decontam, histsort, line_spread, lineblock, packing, prefix_counts, quality_rules, resampling, simhash, simple8b, tokens, vector_codes, zlang
from .common import table, written


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of near-equal bytes."""
    out = histsort.shard(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    out = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.vocabulary(packing.VOCABULARY))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                      F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and digest of every document's ids, read back from the token files."""
    folder = simple8b.token_folder(spark)
    files = simple8b.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder,
                                  tokens.vocabulary(simple8b.VOCABULARY))
    out = simple8b.read_tokens(files, folder)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))


def op5_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, whether it is over the limit, and how many of its characters are not."""
    out = prefix_counts.prefix_tables(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      tokens.vocabulary(prefix_counts.VOCABULARY))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > prefix_counts.LIMIT).alias("over_limit"),
                      F.col("within").alias("chars_within_limit"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    dictionaries = zlang.fit(docs.filter(~F.col("held_out")))
    out = zlang.identify(docs.select("doc_id", "held_out", "text"), dictionaries)
    return out.select("doc_id", "held_out", "__lang.lang_pred", "__lang.score", "__lang.accepted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document and a digest of the text that stays."""
    out = line_spread.strip_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_removed").cast("long").alias("n_removed"),
                      F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items hit in every document."""
    out = decontam.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.score(docs, table(spark, sf_dir, "labels"), evidence=quality_rules.EVIDENCE)
    return out.select("doc_id", "__base.n_words", "__base.word_chars", "__base.n_symbols", "__base.n_dup_lines",
                      "__base.n_repeat_words", "__base.base_failed", "__base.kept", "__base.score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = table(spark, sf_dir, "pages").select("page_id", "url", lineblock.extract(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document by its likeness to the benchmark."""
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, and the digest of the codebooks."""
    kept = vector_codes.points(table(spark, sf_dir, "embeddings"))
    books = vector_codes.train(kept)
    out = vector_codes.with_label_error(written(vector_codes.assign(kept, books), "vector-codes"))
    return out.select("vec_id", "code", "error", "label_error",
                      F.lit(books and books.sha256()).cast("string").alias("codebooks_sha256"))


def op13_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    path = tokens.vocabulary(bpe_replay.VOCABULARY)
    out = bpe_replay.encode(table(spark, sf_dir, "documents"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2(bpe_replay.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_histogram_sort, op2_simhash_neardup, op3_best_fit_packing, op4_simple8b_files, op5_prefix_counts, op6_language_id, op7_line_dedup, op8_decontamination, op9_quality_rules,
                                    op10_html_extraction, op11_target_resampling, op12_orchard_codes, op13_bpe_replay)}

_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

ORACLE = {
    "op8_decontamination": f"""
        WITH items AS (
            SELECT item_id, words, least(len(words), {decontam.WINDOW}) AS size
            FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
        windows AS (
            SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM items)),
        docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        places AS (
            SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
            FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
                  FROM docs, (SELECT DISTINCT size FROM items))),
        found AS (SELECT doc_id, item_id, p.size, i FROM places p JOIN windows w ON p.win = w.win AND p.size = w.size),
        hit AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, size, i FROM found))
            GROUP BY doc_id),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id""",
    "op7_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents),
        normal AS (
            SELECT *, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM lines),
        long_lines AS (
            SELECT * FROM normal WHERE norm <> '' AND len(string_split(norm, ' ')) >= {line_spread.MIN_WORDS}),
        wide AS (
            SELECT norm, min((doc_id, pos)) AS first FROM long_lines
            GROUP BY norm HAVING count(DISTINCT coalesce(source, '')) >= {line_spread.MIN_SITES}),
        gone AS (
            SELECT l.doc_id, l.pos FROM long_lines l JOIN wide w ON l.norm = w.norm AND (l.doc_id, l.pos) <> w.first),
        kept AS (
            SELECT n.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                   coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE g.pos IS NULL), '') AS body
            FROM normal n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               CASE WHEN text IS NOT NULL THEN length(body) END AS kept_chars,
               CASE WHEN text IS NOT NULL THEN md5(body) END AS kept_md5
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    # CRC-32 of each distinct word from a table of 256 states, byte by byte.
    "op11_target_resampling": f"""
        WITH crc_table AS MATERIALIZED (
            SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
                        ORDER BY b) AS t
            FROM (SELECT unnest(range(0, 256)) AS b)),
        docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
        doc_words AS (SELECT doc_id, unnest(words) AS word FROM docs),
        item_words AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
        vocabulary AS MATERIALIZED (
            SELECT DISTINCT word, hex(encode(word)) AS h
            FROM (SELECT word FROM doc_words UNION ALL SELECT word FROM item_words)),
        placed AS MATERIALIZED (
            SELECT word, xor(list_reduce(range(0, len(h) // 2), lambda c, i:
                             xor(c >> 8, t[(xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255) + 1]), 4294967295),
                             4294967295) % {resampling.BUCKETS} AS bucket
            FROM vocabulary, crc_table),
        corpus AS (SELECT bucket, count(*) AS s FROM doc_words JOIN placed USING (word) GROUP BY bucket),
        target AS (SELECT bucket, count(*) AS t FROM item_words JOIN placed USING (word) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM corpus) + {resampling.BUCKETS})
                   / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM target) + {resampling.BUCKETS}))))::BIGINT AS gain
            FROM corpus FULL JOIN target USING (bucket)),
        weighed AS (
            SELECT doc_id, sum(gain)::BIGINT AS weight FROM doc_words JOIN placed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                       / 4294967296)))::BIGINT AS score
            FROM docs LEFT JOIN weighed USING (doc_id)),
        ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
            FROM scored WHERE n_features >= {resampling.MIN_WORDS})
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {resampling.PERCENT} // 100 THEN r END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)""",
}
