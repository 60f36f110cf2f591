"""TXT-6: Russian Snowball stemming as built-in Column expressions.

The word is split once into a prefix (through its first vowel) and RV, the
region after it. Every step is an end-anchored ``regexp_replace`` on RV, so
the whole stemmer is a JVM expression with no Python worker. "Group 1"
endings must follow а or я inside RV, written as a look-behind. Tokens
without Cyrillic letters come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix classes of the published Russian Snowball
# algorithm, each class listed in its natural order.
VOWELS = "аеиоуыэюя"
PERFECTIVE_GERUND_1 = ["в", "вши", "вшись"]
PERFECTIVE_GERUND_2 = ["ив", "ивши", "ившись", "ыв", "ывши", "ывшись"]
ADJECTIVE = ["ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом",
             "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею"]
PARTICIPLE_1 = ["ем", "нн", "вш", "ющ", "щ"]
PARTICIPLE_2 = ["ивш", "ывш", "ующ"]
REFLEXIVE = ["ся", "сь"]
VERB_1 = ["ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны",
          "ть", "ешь", "нно"]
VERB_2 = ["ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им",
          "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть",
          "ишь", "ую", "ю"]
NOUN = ["а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой",
        "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию",
        "ью", "ю", "ия", "ья", "я"]
SUPERLATIVE = ["ейш", "ейше"]
DERIVATIONAL = ["ост", "ость"]


def _alt(words) -> str:
    # longest first, so an ending never loses to one of its own suffixes
    return "|".join(sorted(set(words), key=lambda w: (-len(w), w)))


def _group1(words) -> str:
    return f"(?<=[ая])(?:{_alt(words)})"


_PG = f"(?:{_group1(PERFECTIVE_GERUND_1)}|{_alt(PERFECTIVE_GERUND_2)})$"
_REFL = f"(?:{_alt(REFLEXIVE)})$"
_ADJ = f"(?:{_group1(PARTICIPLE_1)}|{_alt(PARTICIPLE_2)})?(?:{_alt(ADJECTIVE)})$"
_VERB = f"(?:{_group1(VERB_1)}|{_alt(VERB_2)})$"
_NOUN = f"(?:{_alt(NOUN)})$"
_SUPER = f"(?:{_alt(SUPERLATIVE)})$"
_DERIV = f"(?:{_alt(DERIVATIONAL)})$"


def _cut(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def with_stem(df, src: str, dst: str):
    """Add ``dst`` = Russian Snowball stem of the lower-case token ``src``.

    Each step is its own projection over named columns, so no step's
    expression is repeated inside the next one: the optimizer keeps the
    projections apart because the regex steps are not cheap to duplicate.
    Callers materialize the stemmed rows (see ``CorpusIndex.build``) before
    joining on them, so no inferred filter is pushed below these projections.
    """
    V, C = f"[{VOWELS}]", f"[^{VOWELS}]"
    t = "__stem_"
    c = lambda n: F.col(t + n)
    w = F.replace(F.col(src), F.lit("ё"), F.lit("е"))
    out = (df
           .withColumn(t + "cyr", F.col(src).rlike("[а-яё]"))
           # null for a token without Cyrillic letters: every later step is
           # then null too and costs nothing
           .withColumn(t + "w", F.when(c("cyr"), w))
           .withColumn(t + "pre", F.regexp_extract(c("w"), f"^({C}*{V})", 1))
           .withColumn(t + "r2", F.length(F.regexp_extract(c("w"), f"^(.*?{V}{C}.*?{V}{C})", 1)))
           .withColumn(t + "rv", F.when(c("pre") == "", F.lit(""))
                       .otherwise(F.substring(c("w"), F.length(c("pre")) + 1, 1 << 20)))
           .withColumn(t + "pre", F.when(c("pre") == "", c("w")).otherwise(c("pre")))
           # step 1: perfective gerund, else reflexive then adjectival / verb / noun
           .withColumn(t + "nr", _cut(c("rv"), _REFL))
           .withColumn(t + "s1", F.when(c("rv").rlike(_PG), _cut(c("rv"), _PG))
                       .when(c("nr").rlike(_ADJ), _cut(c("nr"), _ADJ))
                       .when(c("nr").rlike(_VERB), _cut(c("nr"), _VERB))
                       .otherwise(_cut(c("nr"), _NOUN)))
           # step 2
           .withColumn(t + "s2", _cut(c("s1"), "и$"))
           # step 3: the derivational ending must lie wholly in R2
           .withColumn(t + "d", F.length(F.regexp_extract(c("s2"), f"({_DERIV[:-1]})$", 1)))
           .withColumn(t + "s3", F.when((c("d") > 0) & (c("r2") > 0)
                                        & (F.length(c("pre")) + F.length(c("s2")) - c("d") >= c("r2")),
                                        F.substring(c("s2"), F.lit(1), F.length(c("s2")) - c("d")))
                       .otherwise(c("s2")))
           # step 4: undouble н, or superlative then undouble, or final ь
           .withColumn(t + "s4", F.when(c("s3").rlike("нн$"), F.regexp_replace(c("s3"), "н$", ""))
                       .when(c("s3").rlike(_SUPER), F.regexp_replace(_cut(c("s3"), _SUPER), "нн$", "н"))
                       .otherwise(_cut(c("s3"), "ь$")))
           .withColumn(dst, F.when(c("cyr"), F.concat(c("pre"), c("s4"))).otherwise(F.col(src))))
    return out.drop(*[x for x in out.columns if x.startswith(t)])
