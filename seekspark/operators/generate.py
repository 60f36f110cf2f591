"""Lemmas and query generation text handling (TXT-7, GEN-2, FIL-7).

The remote text generator itself is not built; these functions build the
prompt column, run a user-supplied generator on it (``generate_queries``) and parse
its replies.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import broadcast_if_small, materialize

N_QUERIES = 5   # fixed: questions asked per article
MAX_TRIES = 15  # fixed: replies asked for one article at most


def lemmatize(df: DataFrame, key_cols, tokens_col: str, lemmas: DataFrame, out: str = "lemmas") -> DataFrame:
    """TXT-7: replace each token by its lemma from a user ``(form, lemma)``
    dictionary (first normal form), tokens without an entry stay as they
    are; order and duplicates are kept. The dictionary is joined on the
    exploded tokens, broadcast only after a size check."""
    keys = list(key_cols)
    toks = df.select(*keys, F.posexplode(tokens_col).alias("p", "form"))
    lem = toks.join(broadcast_if_small(lemmas.select("form", "lemma")), "form", "left") \
        .withColumn("w", F.coalesce("lemma", "form"))
    back = lem.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "w"))).alias("l")) \
        .select(*keys, F.transform("l", lambda s: s["w"]).alias(out))
    return df.join(back, keys, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def query_prompts(articles: DataFrame, title_col: str = "title", text_col: str = "article") -> DataFrame:
    """GEN-2: one prompt per article asking for questions that do not name
    the title."""
    prompt = F.concat(F.lit(f"Write {N_QUERIES} different search questions that this text answers. "
                            "Do not use the title in the questions. Title: "),
                      F.col(title_col), F.lit("\nText: "), F.col(text_col))
    return articles.withColumn("prompt", prompt)


def parse_reply(df: DataFrame, reply_col: str = "reply", out: str = "queries") -> DataFrame:
    """GEN-2 reply cleanup: keep the reply from its first '1', one question
    per non-empty line, the leading ``n.`` number removed."""
    start = F.locate("1", F.col(reply_col))
    body = F.when(start > 0, F.substring(F.col(reply_col), start, 1 << 30)).otherwise(F.lit(""))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    return df.withColumn(out, F.transform(lines, lambda l: F.trim(F.regexp_replace(l, r"^\d+\s*[.)]\s*", ""))))


def generate_queries(articles: DataFrame, make_generator: Callable, max_tries: int = MAX_TRIES, title_col: str = "title",
                     text_col: str = "article") -> tuple[DataFrame, DataFrame]:
    """GEN-2 + FIL-7: ask for questions, check them for the title, ask again for those articles whose questions all hold it.

    ``make_generator()`` is called once in each task and gives ``generator(prompts, tries) -> replies`` over lists, ``tries`` being the
    number of the try from 1. Only articles that were rejected go into the next round, at most ``max_tries`` rounds; a reply
    rejected in the last one is kept, marked ``leak``. A reply without any question counts as rejected.

    Returns the articles with ``queries``, ``tries`` and ``leak``, and a report ``(tries, asked, accepted, left)`` with a row
    for each round. Every round is written before the next one starts, so a lost executor repeats no finished round."""
    from .evaluate import title_leak
    asked = materialize(query_prompts(articles, title_col, text_col))
    schema = ", ".join(f"`{n}` {t}" for n, t in asked.dtypes) + ", reply string"
    done, report = [], []
    for n in range(1, max_tries + 1):
        def run(batches, tries=n):
            generator = make_generator()
            for pdf in batches:
                replies = generator(pdf["prompt"].tolist(), [tries] * len(pdf))
                yield pdf.assign(reply=pd.Series(list(replies), index=pdf.index, dtype=object))
        judged = title_leak(parse_reply(asked.mapInPandas(run, schema)), title_col, "queries")
        judged = materialize(judged.withColumn("leak", F.coalesce("leak", F.lit(True)) | (F.size("queries") == 0)).drop("reply"))
        good, bad = judged.filter(~F.col("leak")), judged.filter("leak")
        sizes = judged.agg(F.count(F.lit(1)).alias("asked"), F.coalesce(F.sum(F.col("leak").cast("long")), F.lit(0)).alias("left")).first()
        report.append((n, sizes["asked"], sizes["asked"] - sizes["left"], sizes["left"]))
        done.append((good if n < max_tries else judged).withColumn("tries", F.lit(n)))
        if not sizes["left"]:
            break
        asked = bad.drop("queries", "leak")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("prompt"), articles.sparkSession.createDataFrame(report, "tries int, asked long, accepted long, left long")
