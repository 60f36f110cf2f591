"""Corpus statistics: tokens, postings, document lengths, df / idf (STA-1..3, 8).

The stores of the reference (text index, metadata table, df table) become
DataFrames keyed by ``doc_id``. They are plain functions of the documents
table so they can be written once as parquet (``write_index``) and read back,
or derived on the fly by a query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import with_stem
from ..functions.text import clean_tokens
from ..util import broadcast_if_small, materialize


def doc_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
               stop_list=(), id_out: str = "doc_id", preprocess=None) -> DataFrame:
    """``(doc_id, tokens)`` with tokens = TXT-5 ``clean_string`` split, or what ``preprocess``
    (text column -> array column, e.g. TXT-8 ``whitespace_tokens``) makes of the text."""
    tokens = preprocess(F.col(text_col)) if preprocess else clean_tokens(text_col, stop_list)
    return docs.select(F.col(id_col).alias(id_out), tokens.alias("tokens"))


def token_rows(tokens: DataFrame, id_col: str = "doc_id", stem: bool = True, keep_empty: bool = False) -> DataFrame:
    """One row per token occurrence: ``(id, dl, pos, term)`` (0-based pos).

    Stemming runs here, on single tokens, as staged Column expressions.
    ``keep_empty`` keeps one row with a null term for a text without tokens.
    """
    # posexplode_outer: a plain posexplode lets the optimizer infer
    # ``size(tokens) > 0`` and push it below the projection that builds the
    # tokens, which would tokenise every text twice.
    rows = tokens.select(id_col, F.size("tokens").alias("dl"), F.posexplode_outer("tokens").alias("pos", "token"))
    if not keep_empty:
        rows = rows.filter(F.col("token").isNotNull())
    if stem:
        rows = with_stem(rows, "token", "term").drop("token")
    else:
        rows = rows.withColumnRenamed("token", "term")
    return rows


def postings(tokens: DataFrame, stem: bool = True, with_positions: bool = True,
             keep_empty: bool = False) -> DataFrame:
    """STA-3 + inverted index: ``(doc_id, term, tf, dl, positions)``.

    Occurrences of one (doc, term) all sit in the row of that doc, so the
    partial aggregate before the shuffle already reduces them to one row.
    """
    aggs = [F.count("pos").cast("int").alias("tf"), F.first("dl").cast("int").alias("dl")]
    if with_positions:
        aggs.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    return token_rows(tokens, "doc_id", stem, keep_empty).groupBy("doc_id", "term").agg(*aggs)


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """STA-2 (corpus side): ``(doc_id, dl)`` = number of tokens."""
    return tokens.select("doc_id", F.size("tokens").cast("int").alias("dl"))


def doc_freq(post: DataFrame, n_docs) -> DataFrame:
    """STA-1: ``(term, df, idf)`` with ``idf = ln(N / df)``.

    ``n_docs`` is a number or a scalar Column (e.g. ``docs.select(count).scalar()``).
    """
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(float(n_docs))
    return (post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .withColumn("idf", F.log(n.cast("double") / F.col("df"))))


def query_terms(queries: DataFrame, id_col: str, text_col: str, stop_list=(), stem: bool = True,
                materialized: bool = True, preprocess=None) -> DataFrame:
    """Query tokens with multiplicity: ``(query_id, term, mult, qlen)``.

    ``qlen`` is the length of the query token list (duplicates counted).
    The batch is materialized once: it is read by several joins."""
    toks = doc_tokens(queries, text_col, id_col, stop_list, id_out="query_id", preprocess=preprocess)
    rows = token_rows(toks, "query_id", stem)
    out = (rows.groupBy("query_id", "term")
           .agg(F.count(F.lit(1)).cast("int").alias("mult"), F.first("dl").cast("int").alias("qlen")))
    return materialize(out) if materialized else out


@dataclass
class CorpusIndex:
    """The three stores of one corpus, as DataFrames."""
    tokens: DataFrame      # doc_id, tokens
    postings: DataFrame    # doc_id, term, tf, dl, positions
    lengths: DataFrame     # doc_id, dl
    dfs: DataFrame         # term, df, idf
    n_docs: object         # scalar Column or number
    _blocks: object = field(default=None, repr=False)

    @property
    def blocks(self):
        """The postings by term, in blocks (``operators.blocks``); made when first asked for, unless read."""
        if self._blocks is None:
            from .blocks import TermBlocks
            self._blocks = TermBlocks.build(self)
        return self._blocks

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              stop_list=(), stem: bool = True, materialized: bool = True, preprocess=None) -> "CorpusIndex":
        """Tokenise once; the postings (plus one null-term row per document
        without tokens, which carries its length 0) are materialized and
        every other store is derived from them."""
        tok = doc_tokens(docs, text_col, id_col, stop_list, preprocess=preprocess)
        raw = postings(tok, stem, keep_empty=True)
        if materialized:
            raw = materialize(raw)
        post = raw.filter(F.col("term").isNotNull())
        lengths = raw.groupBy("doc_id").agg(F.max("dl").alias("dl"))
        if materialized:
            lengths = materialize(lengths)
        n = lengths.select(F.count(F.lit(1)).cast("double")).scalar()  # every document has a length
        dfs = doc_freq(post, n)
        if materialized:
            dfs = materialize(dfs)
        return cls(tok, post, lengths, dfs, n)

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Persist the stores, postings sorted by term and the blocks of every term."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id") \
            .write.mode(mode).parquet(f"{path}/postings")
        self.lengths.write.mode(mode).parquet(f"{path}/lengths")
        self.dfs.write.mode(mode).parquet(f"{path}/dfs")
        self.blocks.write(path, mode)

    @classmethod
    def read(cls, spark, path: str) -> "CorpusIndex":
        from .blocks import TermBlocks
        lengths = spark.read.parquet(f"{path}/lengths")
        return cls(None, spark.read.parquet(f"{path}/postings"), lengths, spark.read.parquet(f"{path}/dfs"),
                   lengths.select(F.count(F.lit(1)).cast("double")).scalar(), TermBlocks.read(spark, path))


def candidate_cells(cands: DataFrame, qterms: DataFrame, index: CorpusIndex,
                    positions: bool = False) -> DataFrame:
    """Per candidate pair and distinct query term: ``(query_id, doc_id, term,
    mult, qlen, dl, tf[, positions])``; ``tf`` is 0 when the doc lacks the term.

    Every candidate keeps its rows even when it shares no term (it scores 0).
    The postings are first cut map-side to the batch's query terms and
    candidate documents (both sides broadcast after a size check on their
    materialized rows), so the index itself is never shuffled; only the two
    reduced sides meet in the final join. The result is materialized because
    every ranker reads it more than once (per-query averages, local df).
    """
    pairs = cands.select("query_id", "doc_id").distinct()
    docs = broadcast_if_small(pairs.select("doc_id").distinct())
    terms = broadcast_if_small(qterms.select("term").distinct())
    cols = ["doc_id", "term", "tf"] + (["positions"] if positions else [])
    hits = index.postings.select(*cols).join(terms, "term").join(docs, "doc_id")
    lens = index.lengths.join(docs, "doc_id")
    cells = pairs.join(lens, "doc_id").join(qterms, "query_id")
    out = cells.join(hits, ["doc_id", "term"], "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    return materialize(out)
