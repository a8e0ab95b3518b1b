"""Host-level quality rules.

Every text gets its own rule figures inside the row. Rule failures are summed per host, shrunk towards an empirical
beta prior (moments over the hosts), and the verdict of the host is joined back to its documents.

Defined cases: null or empty text has no words and fails the length rule. A null host is a host of its own. Repeated
rows are judged row by row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.registry import query
from tallyframe.llm.shared import SPACE, SPACE_CHARS, cut, table, text_of, words_of

# Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A host whose shrunk failure rate of any rule lies above this share loses all its documents.
HOST_RATE = 0.5
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "2 * n_dup_lines > n_lines",
}


def repeat_positions(windows: Column, ordered: Column) -> Column:
    """Number of words that lie in a window found twice or more, from (window, place) pairs sorted by window."""
    same = lambda e, i: (e["w"] == F.get(ordered, i - 1)["w"]) | (e["w"] == F.get(ordered, i + 1)["w"])
    spans = F.transform(
        F.filter(F.transform(ordered, lambda e, i: F.when(same(e, i), e["p"])), lambda p: p.isNotNull()),
        lambda p: F.sequence(p, p + (WINDOW - 1)),
    )
    return F.size(F.array_distinct(F.flatten(spans)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rule figures per row: one pass over the text, no exchange."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("t"))
    rows = rows.select(
        "doc_id", "host", words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1))).alias("lines"),
        F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    at = lambda i: [F.get(F.col("w"), i + k) for k in range(WINDOW)]
    windows = F.when(
        F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*at(i)))
    )
    rows = rows.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts with a repeated window pay for sorting the places.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn(
        "ordered",
        F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("w"), i.alias("p"))))),
    )
    counted = F.when(F.col("ordered").isNull(), 0).otherwise(repeat_positions(F.col("windows"), F.col("ordered")))
    return rows.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        counted.cast("long").alias("n_repeat_words"),
    )


def host_rates(measured: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per host: rows, failures and shrunk rate of every rule."""
    fails = [F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(f"f_{name}") for name, rule in rules.items()]
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *fails)
    share = lambda name: F.col(f"f_{name}") / F.col("n")
    moments = hosts.agg(
        *[F.avg(share(x)).alias(f"m_{x}") for x in rules], *[F.var_samp(share(x)).alias(f"v_{x}") for x in rules]
    ).first()  # one row of a few numbers
    for name in rules:
        m, v = moments[f"m_{name}"], moments[f"v_{name}"]
        mean = min(max(m if m is not None else 0.5, 1e-6), 1 - 1e-6)
        weight = min(max(mean * (1 - mean) / v - 1, 1.0), 1e6) if v else 1e6
        hosts = hosts.withColumn(f"rate_{name}", (F.col(f"f_{name}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))
    return hosts


def judge_hosts(docs: DataFrame, rules: dict[str, str] = RULES, host_rate: float = HOST_RATE, **columns: str) -> DataFrame:
    """Figures of each document, the shrunk rates of its host, and whether it is kept."""
    measured = cut(measure(docs, **columns))
    hosts = host_rates(measured, rules)
    verdict = F.greatest(F.lit(0.0), *[F.col(f"rate_{x}") for x in rules]) > host_rate
    hosts = hosts.select(F.col("host").alias("h"), verdict.alias("host_failed"), *[F.round(f"rate_{x}", 6).alias(f"rate_{x}") for x in rules])
    failed = F.expr(f"{rules['short']} OR {rules['repeats']}")
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").withColumns(
        {"base_failed": failed, "kept": ~failed & ~F.col("host_failed")}
    ).drop("h")


SQL9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 4)) AS p FROM win JOIN rep USING (doc_id, g)),
np AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY 1),
m AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS word_chars,
       length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
       len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
       len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_distinct,
       coalesce(np.n, 0) AS n_repeat_words FROM w LEFT JOIN np USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_words < 10) AS f1,
       count(*) FILTER (WHERE 100 * n_repeat_words > 20 * n_words) AS f2,
       count(*) FILTER (WHERE 10 * n_symbols > 3 * n_words) AS f3,
       count(*) FILTER (WHERE 2 * (n_lines - n_distinct) > n_lines) AS f4
      FROM f JOIN documents USING (doc_id) GROUP BY 1),
l AS (SELECT source, n, unnest([f1, f2, f3, f4]) AS f, unnest([1, 2, 3, 4]) AS r FROM h),
p AS (SELECT r, least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS m, var_samp(f / n) AS v FROM l GROUP BY 1),
s AS (SELECT r, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM p),
v AS (SELECT source, bool_or((f + m * k) / (n + k) > 0.5) AS host_failed FROM l JOIN s USING (r) GROUP BY 1)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_lines - n_distinct AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN documents d ON d.doc_id = f.doc_id JOIN v ON v.source IS NOT DISTINCT FROM d.source
"""


@query(SQL9)
def op9_host_rules(spark, sf_dir):
    out = judge_hosts(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
