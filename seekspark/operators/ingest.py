"""Ingestion: dumps and pages to cleaned, stemmed sections with dense ids
(SRC-2, FIL-1..3, TXT-9..16, RNK-14, ING-1..3, ID-1, JOI-13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import with_stem
from ..util import materialize

DOC_SEP = "<doc id="          # fixed: the dump's article marker
MIN_ARTICLE_CHARS = 500       # fixed: shorter raw articles are skipped
MAX_HEADING_CHARS = 100       # fixed: longer lines are never headings


def split_articles(dumps: DataFrame, text_col: str = "value", id_col: str = "file") -> DataFrame:
    """SRC-2 on whole-file rows: split on the marker, drop empty pieces and
    put the marker back in front of each: ``(file, article_no, article)``.
    For large files read them with ``read_dump`` (one article per row)."""
    parts = dumps.select(id_col, F.posexplode(F.split(text_col, DOC_SEP)).alias("n", "piece"))
    kept = parts.filter(F.col("piece") != "")
    w = Window.partitionBy(id_col).orderBy("n")
    return kept.select(id_col, F.row_number().over(w).alias("article_no"),
                       F.concat(F.lit(DOC_SEP), F.col("piece")).alias("article"))


def article_fields(articles: DataFrame, col: str = "article") -> DataFrame:
    """TXT-11/12 + FIL-1: url, title line, raw length filter."""
    return articles.filter(F.length(col) >= MIN_ARTICLE_CHARS) \
        .withColumn("url", T.first_url(col)).withColumn("title", F.coalesce(T.line_at(col, 1), F.lit("")))


def page_lines(pages: DataFrame, html_col: str = "html", container: str = "article") -> DataFrame:
    """A page as the reference's article lines: ``(page_id, url, title,
    lines)`` where lines are the tag-stripped paragraphs of every ``container``
    element (TXT-9/10), blank lines removed, and title is the ``h1`` text. A
    page without such an element gives the paragraphs of its whole body."""
    parts = F.regexp_extract_all(html_col, F.lit(f"(?s)<{container}\\b[^>]*>(.*?)</{container}>"), 1)
    body = F.regexp_replace(html_col, "(?s)<(head|script|style)\\b[^>]*>.*?</\\1>", "")
    art = F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(body)
    title = T.strip_tags(F.regexp_extract(html_col, "(?s)<h1[^>]*>(.*?)</h1>", 1))
    body = F.regexp_replace(F.regexp_replace(art, "(?s)<h1[^>]*>.*?</h1>", ""), "<br>|</p>|</li>|</h[1-6]>", "\n")
    lines = F.split(T.remove_strings(T.strip_tags(body), []), "\n")
    return pages.select("page_id", "url", title.alias("title"),
                        F.filter(F.transform(lines, lambda l: F.trim(l)), lambda l: l != "").alias("lines"))


def sections(docs: DataFrame, headings: DataFrame, emit_last: bool = True, stop_list=()) -> DataFrame:
    """RNK-14 + TXT-15 + TXT-5/6/16: split each document's body lines into
    sections at heading lines (gaps and islands: a running count of heading
    lines numbers the sections).

    ``docs``: ``(page_id, url, title, lines)``; ``headings``: ``(page_id,
    headings)``. Documents without headings are skipped (FIL-2, inner join).
    A section with no body line is dropped; the last section of a document
    is kept when ``emit_last`` (the reference loses it: ``emit_last=False``).
    Returns ``(page_id, section_no, url, title, article, proc_article,
    proc_len, stem_article)``.
    """
    d = docs.join(headings, "page_id")
    ln = d.select("page_id", "url", "title", "headings", F.posexplode("lines").alias("i", "line"))
    is_head = (F.length("line") < MAX_HEADING_CHARS) & F.array_contains("headings", F.col("line"))
    w = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("h", is_head.cast("int")).withColumn("section_no", F.sum("h").over(w))
    heads = ln.filter(F.col("h") == 1).select("page_id", "section_no", F.col("line").alias("heading"))
    body = ln.filter(F.col("h") == 0).groupBy("page_id", "section_no").agg(
        F.first("url").alias("url"), F.first("title").alias("title"),
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("b"))
    sec = body.join(heads, ["page_id", "section_no"], "left").withColumn("heading", F.coalesce("heading", F.lit("")))
    if not emit_last:
        last = ln.groupBy("page_id").agg(F.max("section_no").alias("last"))
        sec = sec.join(last, "page_id").filter(F.col("section_no") < F.col("last")).drop("last")
    text = F.concat(F.col("title"), F.lit(". "), F.col("heading"), F.lit(" "),
                    F.array_join(F.transform("b", lambda s: s["line"]), " "))
    out = sec.select("page_id", "section_no", T.section_url("url", "heading").alias("url"),
                     T.section_title("title", "heading").alias("title"), text.alias("article"))
    out = out.withColumn("proc_article", T.clean_string("article", stop_list)) \
        .withColumn("proc_len", T.word_count("proc_article"))
    return out


def long_enough(pages: DataFrame, col: str, min_chars: int = MIN_ARTICLE_CHARS) -> DataFrame:
    """FIL-1: rows whose raw text, markup included, has ``min_chars`` characters."""
    return pages.filter(F.length(col) >= min_chars)


def whole_articles(articles: DataFrame, stop_list=(), col: str = "article") -> DataFrame:
    """ING-2: each article as one document: ``url, title, article, proc_article,
    proc_len`` beside the other columns. Without tags, the title is what stands
    between the first line end and the first blank line, the article the rest
    without line ends. A text without a blank line has an empty title."""
    text = T.strip_tags(col)
    cut = F.instr(text, "\n\n")
    out = articles.withColumn("url", T.first_url(col)) \
        .withColumn("title", F.when(cut > 1, F.substr(text, F.lit(2), cut - 2)).otherwise("")) \
        .withColumn("article", F.replace(F.when(cut > 0, F.substr(text, cut)).otherwise(text), F.lit("\n"), F.lit("")))
    return out.withColumn("proc_article", T.clean_string("article", stop_list)) \
        .withColumn("proc_len", T.word_count("proc_article"))


def section_store(secs: DataFrame, start=0) -> DataFrame:
    """ING-1 / ING-3: sections as the metadata store keeps them, with
    ``stem_article`` and running ids from ``start`` on. Vectors made from its
    rows (ING-4) carry the same ids."""
    stemmed = stem_text(secs, ["page_id", "section_no"], "proc_article", "stem_article")
    return dense_ids(stemmed, ["page_id", "section_no"], start=start)


def lookup_text(cands: DataFrame, meta: DataFrame, stemmed: bool = False) -> DataFrame:
    """JOI-2: candidates with url, article and the processed text, stemmed or not, as ``text``."""
    return cands.join(meta.select("doc_id", "url", "article", F.col("stem_article" if stemmed else "proc_article").alias("text")),
                      "doc_id")


def stem_text(df: DataFrame, key_cols, src: str, dst: str) -> DataFrame:
    """TXT-6 on whole texts: stem every token, keep order, join by spaces."""
    toks = df.select(*key_cols, F.posexplode_outer(F.split(src, " ")).alias("p", "tok"))
    toks = with_stem(toks.filter(F.col("tok").isNotNull() & (F.col("tok") != "")), "tok", "st")
    back = toks.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct("p", "st"))).alias("l")) \
        .select(*key_cols, F.array_join(F.transform("l", lambda s: s["st"]), " ").alias(dst))
    return df.join(back, list(key_cols), "left").withColumn(dst, F.coalesce(dst, F.lit("")))


def dense_ids(df: DataFrame, order_cols, start=0, id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """ID-1: contiguous ids ``start, start+1, ...`` in ``order_cols`` order
    (a unique key), with no unpartitioned window: range-partition on the
    key, record each row's range number, count rows per range (one small
    row per range reaches the driver), then id = offset of the range +
    position inside it. ``start`` may be the current store size (STA-8)."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    ranged = materialize(df.repartitionByRange(n, *order_cols).withColumn("__r", F.spark_partition_id()))
    counts = sorted((r["__r"], r["n"]) for r in ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("n")).collect())
    offs, acc = {}, int(start)
    for r, c in counts:
        offs[r] = acc
        acc += c
    off_col = F.create_map(*[x for r, o in offs.items() for x in (F.lit(r), F.lit(o))]) if offs else F.create_map().cast("map<int,bigint>")
    w = Window.partitionBy("__r").orderBy(*order_cols)
    return ranged.withColumn(id_col, (off_col[F.col("__r")] + F.row_number().over(w) - 1).cast("bigint")).drop("__r")


def store_consistency(vectors: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """JOI-13: both stores hold the same keys: counts of each side and of
    keys found on one side only."""
    v = vectors.select(key).withColumn("v", F.lit(1))
    m = meta.select(key).withColumn("m", F.lit(1))
    j = v.join(m, key, "full")
    return j.agg(F.sum(F.coalesce("v", F.lit(0))).alias("n_vectors"), F.sum(F.coalesce("m", F.lit(0))).alias("n_meta"),
                 F.sum((F.col("v").isNotNull() & F.col("m").isNotNull()).cast("int")).alias("n_both"),
                 F.sum(F.col("m").isNull().cast("int")).alias("only_vectors"),
                 F.sum(F.col("v").isNull().cast("int")).alias("only_meta"))
