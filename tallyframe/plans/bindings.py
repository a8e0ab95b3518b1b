"""How the given tables stand in for evaluation data, once for Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: How far a bootstrap error may lie from the formula it is compared with, as a share. 200 resamples know a standard
#: deviation to about 5 percent; the formula of a ratio is itself good to a few percent in small groups.
AGREE = 0.2

# The full row in order, because (l_orderkey, l_linenumber) is not unique.
ATTEMPT_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
ATTEMPT_ORDER_SQL = ", ".join(ATTEMPT_ORDER)


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts at problems: an order is a problem, its lines are the attempts."""
    return table(spark, sf, "lineitem").withColumn("correct", F.col("l_returnflag") == "R")


ATTEMPTS_SQL = f"""(
  select *, l_returnflag = 'R' as correct,
         row_number() over (partition by l_orderkey order by {ATTEMPT_ORDER_SQL}) as attempt
  from lineitem)"""


def choice_scores(spark: SparkSession, sf: str, n: int = 64) -> DataFrame:
    """Log-likelihoods of n choices with a gold index, from the embedding vectors."""
    e = table(spark, sf, "embeddings")
    lls = F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("doc_id"), lls.alias("lls"), F.col("label").alias("gold"))


def choice_scores_sql(n: int = 64) -> str:
    return f"(select vec_id as doc_id, list_transform(embedding[1:{n}], lambda x: x::double) as lls, label as gold from embeddings)"


def gold_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Binary gold and predicted labels."""
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("pred"))


GOLD_PRED_SQL = "(select doc_id, quality as gold, 1 - toxic as pred from labels)"


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with the user turn before them: prediction and reference texts."""
    c = table(spark, sf, "conversations")
    user = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    bot = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred"))
    return bot.join(user, ["conv_id", "turn"])


REPLIES_SQL = """(
  select b.conv_id, b.turn, b.text as pred, u.text as ref
  from conversations b join conversations u on b.conv_id = u.conv_id and b.turn = u.turn + 1
  where b.role = 'assistant' and u.role = 'user')"""


def doc_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A document as prediction and the next document as reference."""
    d = table(spark, sf, "documents")
    ref = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ref"))
    return d.select("doc_id", F.col("text").alias("pred"), "lang", "source").join(ref, "doc_id")


DOC_PAIRS_SQL = """(
  select a.doc_id, a.text as pred, b.text as ref, a.lang, a.source
  from documents a join documents b on a.doc_id = b.doc_id - 1)"""

# ---------------------------------------------------------------- SQL text helpers

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PUNCT_SQL = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE_SQL}'), lambda w: w <> '')"


def sql_normalize(text: str) -> str:
    return f"translate({text}, '{UPPER}{PUNCT_SQL}', '{LOWER}')"


def sql_drop_punctuation(text: str) -> str:
    return f"translate({text}, '{PUNCT_SQL}', '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE_SQL}|{SPACE_SQL}$', '', 'g')"


def sql_overlap(a: str, b: str) -> str:
    """Multiset overlap of two token lists."""
    return (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least("
        f"len(list_filter({a}, lambda q: q = w)), len(list_filter({b}, lambda q: q = w))))), 0)"
    )


def sql_ngrams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def bench_ngrams_sql(n: int) -> str:
    return f"""(select item_id, unnest({sql_ngrams('t', n)}) as ngram
      from (select item_id, {sql_words(sql_normalize('text'))} as t from benchmark))"""


def doc_ngrams_sql(n: int) -> str:
    return f"""(select doc_id, unnest({sql_ngrams('t', n)}) as ngram
      from (select doc_id, {sql_words(sql_normalize('text'))} as t from documents))"""
