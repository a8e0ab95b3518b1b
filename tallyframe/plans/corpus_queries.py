"""Queries over corpus text metrics (inventory A11, A12, H31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import words
from tallyframe.operators import corpus as C
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query


def sql_steps(text: str) -> str:
    for old, new in C.TOKENIZE_13A:
        if old == "^|$":
            text = f"(' ' || {text} || ' ')"
            continue
        o, n = old.replace("'", "''"), new.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''")
        o = o.replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, '{o}', '{n}', 'g')"
    return text


def gram_sums(src: str, orders: range, sep: str = "chr(31)") -> str:
    """CTEs m1.. with the clipped matches per row of ``src`` (id, p, r token lists)."""
    parts = []
    for n in orders:
        cut = lambda t: f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], {sep}))"
        for side in ("p", "r"):
            parts.append(f"{side}{n} as (select id, g, count(*) as c from (select id, unnest({cut(side)}) as g from {src}) group by id, g)")
        parts.append(f"m{n} as (select a.id, sum(least(a.c, b.c)) as m from p{n} a join r{n} b on a.id = b.id and a.g = b.g group by a.id)")
    return ", ".join(parts)


REPLY_IDS = "(select conv_id * 1000 + turn as id, pred, ref from " + B.REPLIES_SQL + ")"
TOK13 = f"t as (select id, {B.sql_words(sql_steps('pred'))} as p, {B.sql_words(sql_steps('ref'))} as r from {REPLY_IDS})"
TOTALS = ", ".join(f"(select sum(m) from m{n})::double as m{n}, (select sum(greatest(len(p) - {n} + 1, 0)) from t)::double as t{n}" for n in range(1, 5))


@query(
    "A11",
    f"""with {TOK13}, {gram_sums('t', range(1, 5))}, s as (select {TOTALS}, (select sum(len(p)) from t)::double as pl, (select sum(len(r)) from t)::double as rl)
        select round(100 * (case when pl < rl then exp(1 - rl / pl) else 1 end) * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4), 6) as bleu from s""",
)
def corpus_bleu(spark, sf):
    out = C.corpus_bleu(B.replies(spark, sf), F.col("pred"), F.array("ref"))
    return out.select(F.round("bleu", 6).alias("bleu"))


HALF = f"array_to_string({B.sql_words('ref')}[1:ceil(len({B.sql_words('ref')}) / 2)::int], ' ')"
TWO_REFS = f"""with t as (select id, {B.sql_words(sql_steps('pred'))} as p, {B.sql_words(sql_steps('ref'))} as a, {B.sql_words(sql_steps('half'))} as b
    from (select *, {HALF} as half from {REPLY_IDS})),
  q as (select id, 1 as k, a as r from t union all select id, 2, b from t)""" + "".join(
    f""", p{n} as (select id, g, count(*) as c from (select id, unnest(list_transform(range(1, len(p) - {n} + 2), lambda i: array_to_string(p[i:i + {n - 1}], chr(31)))) as g from t) group by 1, 2),
  r{n} as (select id, g, max(c) as c from (select id, k, g, count(*) as c from
    (select id, k, unnest(list_transform(range(1, len(r) - {n} + 2), lambda i: array_to_string(r[i:i + {n - 1}], chr(31)))) as g from q) group by 1, 2, 3) group by 1, 2),
  m{n} as (select x.id, sum(least(x.c, y.c)) as m from p{n} x join r{n} y on x.id = y.id and x.g = y.g group by 1)""" for n in range(1, 5)
)
NEAREST = "case when abs(len(a) - len(p)) < abs(len(b) - len(p)) then len(a) when abs(len(a) - len(p)) > abs(len(b) - len(p)) then len(b) else least(len(a), len(b)) end"


@query(
    "A11",
    f"""{TWO_REFS}, s as (select {TOTALS}, (select sum(len(p)) from t)::double as pl, (select sum({NEAREST}) from t)::double as rl)
        select round(100 * (case when pl < rl then exp(1 - rl / pl) else 1 end) * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4), 6) as bleu from s""",
)
def corpus_bleu_two_references(spark, sf):
    """References of unequal length: the whole text and its first half. A match is clipped by the better one, the nearer length counts."""
    w = words(F.col("ref"))
    half = F.array_join(F.slice(w, F.lit(1), F.ceil(F.size(w) / 2).cast("int")), " ")
    out = C.corpus_bleu(B.replies(spark, sf).withColumn("half", half), F.col("pred"), F.array("ref", "half"))
    return out.select(F.round("bleu", 6).alias("bleu"))


# Linear part of each row in the logarithm of BLEU: its standard error by the delta method.
BLEU_ERROR = f"""with {TOK13}, {gram_sums('t', range(1, 5))}, s as (select {TOTALS}, (select sum(len(p)) from t)::double as pl, (select sum(len(r)) from t)::double as rl),
  b as (select *, 100 * (case when pl < rl then exp(1 - rl / pl) else 1 end) * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) as bleu from s),
  i as (select t.id, ({' + '.join(f'(coalesce(m{n}.m, 0) / b.m{n} - greatest(len(p) - {n} + 1, 0) / b.t{n})' for n in range(1, 5))}) / 4
    + case when pl < rl then rl * len(p) / (pl * pl) - len(r) / pl else 0 end as d, bleu
    from t {' '.join(f'left join m{n} on m{n}.id = t.id' for n in range(1, 5))}, b)
  select count(*) as n, round(any_value(bleu) * sqrt(sum(d * d)), 5) as formula, true as agrees from i"""


@query("A30 A11", BLEU_ERROR)
def bootstrap_bleu_stderr(spark, sf):
    """The bootstrap error of corpus BLEU beside the delta method's; they have to agree within ``AGREE``."""
    r = B.replies(spark, sf)
    rows = r.select(C.bleu_counts(C.tokens_13a(F.col("pred")), F.array(C.tokens_13a(F.col("ref")))).alias("c")).select("c.*")
    s = rows.agg(*[F.sum(c).cast("double").alias(f"s_{c}") for c in rows.columns])
    total = {c: F.col(f"s_{c}") for c in rows.columns}
    bleu = C.bleu_from_sums([total[f"m{n}"] for n in range(1, 5)], [total[f"t{n}"] for n in range(1, 5)], total["pred_len"], total["ref_len"])
    d = sum((F.col(f"m{n}") / total[f"m{n}"] - F.col(f"t{n}") / total[f"t{n}"] for n in range(1, 5)), F.lit(0.0)) / 4
    short = F.when(total["pred_len"] < total["ref_len"], total["ref_len"] * F.col("pred_len") / total["pred_len"] ** 2 - F.col("ref_len") / total["pred_len"])
    one = F.lit(1)
    per_row = rows.withColumn("k", one).join(F.broadcast(s.withColumn("k", one)), "k")
    formula = per_row.agg(F.count("*").alias("n"), (F.max(bleu) * F.sqrt(F.sum((d + F.coalesce(short, F.lit(0.0))) ** 2))).alias("formula")).withColumn("k", one)
    boot = C.bleu_stderr(r, F.col("pred"), F.array("ref"), iters=400).withColumn("k", one)
    both = formula.join(boot, "k")
    return both.select("n", F.round("formula", 5).alias("formula"), (F.abs(F.col("stderr") / F.col("formula") - 1) < B.AGREE).alias("agrees"))


CODE = lambda c: B.sql_words(f"replace(array_to_string(regexp_extract_all(lower({c}), '([\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_])', 1), ' '), '_', ' _ ')")
LOGS = " + ".join(
    f"ln(coalesce(m{n}.m, 0) + {0 if n == 1 else 1} + 2.2250738585072014e-308) - ln(greatest(len(p) - {n} + 1, 0) + {0 if n == 1 else 1} + 2.2250738585072014e-308)"
    for n in range(1, 5)
)


@query(
    "A11",
    f"""with t as (select id, {CODE('pred')} as p, {CODE('ref')} as r from {REPLY_IDS}), {gram_sums('t', range(1, 5))}
        select round(100 * avg(exp(({LOGS}) / 4 + least(0, 1 - (len(r) + 1)::double / (len(p) + 1)))), 6) as bleu4
        from t {' '.join(f'left join m{n} on m{n}.id = t.id' for n in range(1, 5))}""",
)
def smoothed_bleu4(spark, sf):
    r = B.replies(spark, sf)
    return r.agg(F.round(100 * F.avg(C.smoothed_bleu4(F.col("pred"), F.array("ref"))), 6).alias("bleu4"))


CHARS = lambda c: f"list_filter(string_split(regexp_replace({c}, '[\\s\\p{{Z}}]+', '', 'g'), ''), lambda w: w <> '')"
CHRF = ", ".join(
    f"(select sum(m) from m{n})::double / (select sum(case when len(r) >= {n} then greatest(len(p) - {n} + 1, 0) else 0 end) from t) as p{n}, "
    f"(select sum(m) from m{n})::double / (select sum(greatest(len(r) - {n} + 1, 0)) from t) as r{n}"
    for n in range(1, 7)
)


@query(
    "A12",
    f"""with t as (select id, {CHARS('pred')} as p, {CHARS('ref')} as r from {REPLY_IDS}), {gram_sums('t', range(1, 7), "''")}, s as (select {CHRF}),
        a as (select (p1 + p2 + p3 + p4 + p5 + p6) / 6 as p, (r1 + r2 + r3 + r4 + r5 + r6) / 6 as r from s)
        select round(100 * 5 * p * r / (4 * p + r), 6) as chrf from a""",
)
def corpus_chrf(spark, sf):
    return C.corpus_chrf(B.replies(spark, sf), F.col("pred"), F.col("ref")).select(F.round("chrf", 6).alias("chrf"))


RTOK = lambda c: f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda w: w <> '')"


@query(
    "H31",
    f"""with t as (select doc_id as id, {RTOK('pred')} as p, {RTOK('ref')} as r from {B.DOC_PAIRS_SQL}), {gram_sums('t', range(1, 3))}
        select t.id as doc_id, round(coalesce(2.0 * m1.m / (len(p) + len(r)), 0), 9) as rouge1,
        round(coalesce(2.0 * m2.m / (greatest(len(p) - 1, 0) + greatest(len(r) - 1, 0)), 0), 9) as rouge2
        from t left join m1 on m1.id = t.id left join m2 on m2.id = t.id""",
)
def rouge_n(spark, sf):
    d = B.doc_pairs(spark, sf)
    return d.select(
        "doc_id", F.round(C.rouge_n(F.col("pred"), F.col("ref"), 1), 9).alias("rouge1"), F.round(C.rouge_n(F.col("pred"), F.col("ref"), 2), 9).alias("rouge2")
    )


SENTENCES = lambda c: f"list_transform(list_filter(string_split(replace({c}, ' . ', '.' || chr(10)), chr(10)), lambda x: x <> ''), lambda x: {RTOK('x')})"
# Lengths of common subsequences row by row for every pair of sentences, then the walk back from the last cell.
LSUM = f"""with recursive t as (select conv_id * 1000 + turn as id, {SENTENCES('pred')} as p, {SENTENCES('ref')} as r from {{src}}),
  a as (select id, unnest(range(1, len(r) + 1)) as ri, unnest(r) as r from t), b as (select id, unnest(range(1, len(p) + 1)) as pi, unnest(p) as p from t),
  s as (select id, ri, pi, r, p from a join b using (id) where len(r) > 0 and len(p) > 0),
  d as (select id, ri, pi, r, p, 0 as i, list_transform(range(0, len(p) + 1), lambda x: 0::bigint) as v from s
    union all select id, ri, pi, r, p, i + 1, list_prepend(0::bigint, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))) from
      (select *, list_transform(range(1, len(p) + 1), lambda k: case when r[i + 1] = p[k] then v[k] + 1 else v[k + 1] end) as c from d where i < len(r))),
  w as (select id, ri, pi, r, p, len(r)::bigint as i, len(p)::bigint as j, null::bigint as hit from s
    union all select w.id, w.ri, w.pi, w.r, w.p, case when w.r[w.i] = w.p[w.j] or x.v[w.j] <= y.v[w.j + 1] then w.i - 1 else w.i end,
      case when w.r[w.i] = w.p[w.j] or x.v[w.j] > y.v[w.j + 1] then w.j - 1 else w.j end, case when w.r[w.i] = w.p[w.j] then w.i end
      from w join d x on x.id = w.id and x.ri = w.ri and x.pi = w.pi and x.i = w.i join d y on y.id = w.id and y.ri = w.ri and y.pi = w.pi and y.i = w.i - 1
      where w.i > 0 and w.j > 0),
  h as (select id, g, count(*) as n from (select distinct id, ri, hit, r[hit] as g from w where hit is not null) group by 1, 2),
  k as (select id, g, count(*) as n from (select id, unnest(flatten(p)) as g from t) group by 1, 2),
  m as (select id, sum(least(h.n, k.n)) as m from h join k using (id, g) group by 1),
  f as (select id, case when m > 0 then 2.0::double * m / (len(flatten(p)) + len(flatten(r))) else 0 end as f from t left join m using (id))"""
FALSE_TEXT = "In the end . And of the nothing\nof the kind"


@query("H31", LSUM.replace("{src}", B.REPLIES_SQL) + " select id // 1000 as conv_id, id % 1000 as turn, round(f, 9) as rouge_lsum from f")
def rouge_lsum(spark, sf):
    """Summary-level ROUGE-L of every reply with the turn before it."""
    return C.with_rouge_lsum(B.replies(spark, sf), "pred", "ref").select("conv_id", "turn", F.round("rouge_lsum", 9).alias("rouge_lsum"))


@query(
    "H31",
    f"""with yes as ({LSUM.replace('{src}', B.REPLIES_SQL)} select id, f as y from f),
        no as ({LSUM.replace('{src}', "(select conv_id, turn, pred, replace('" + FALSE_TEXT.replace(chr(10), '~') + "', '~', chr(10)) as ref from " + B.REPLIES_SQL + ")")} select id, f as n from f)
        select id // 1000 as conv_id, id % 1000 as turn, round(y, 9) as rouge_lsum_max, round(y - n, 9) as rouge_lsum_diff, (y > n)::int as rouge_lsum_acc from yes join no using (id)""",
)
def true_false_rouge_lsum(spark, sf):
    """Summary-level similarity of a reply with a true and with a false reference."""
    r = B.replies(spark, sf).withColumn("false", F.lit(FALSE_TEXT))
    both = C.with_rouge_lsum(C.with_rouge_lsum(r, "pred", "ref", "t"), "pred", "false", "f")
    out = both.select("conv_id", "turn", *C.true_false_scores(F.array("t"), F.array("f"), "rouge_lsum"))
    return out.withColumns({c: F.round(c, 9) for c in ("rouge_lsum_max", "rouge_lsum_diff")})


@query(
    "H31",
    f"""with recursive t as (select conv_id, turn, {RTOK('pred')} as p, {RTOK('ref')} as r from {B.REPLIES_SQL}),
        d as (select conv_id, turn, r, p, 0 as i, list_transform(range(0, len(p) + 1), lambda x: 0::bigint) as v from t
          union all select conv_id, turn, r, p, i + 1, list_prepend(0::bigint, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))) from
            (select *, list_transform(range(1, len(p) + 1), lambda k: case when r[i + 1] = p[k] then v[k] + 1 else v[k + 1] end) as c from d where i < len(r)))
        select conv_id, turn, round(case when v[-1] > 0 then 2.0::double * v[-1] / (len(p) + len(r)) else 0 end, 9) as rouge_l from d where i = len(r)""",
)
def reply_rouge_l(spark, sf):
    """ROUGE-L of every reply as one sequence; :func:`rouge_l` scores whole documents, for which tables of lengths are too large in SQL."""
    return C.with_rouge_l(B.replies(spark, sf), "pred", "ref").select("conv_id", "turn", F.round("rouge_l", 9).alias("rouge_l"))


@query("H31")
def rouge_l(spark, sf):
    return C.with_rouge_l(B.doc_pairs(spark, sf), "pred", "ref").select("doc_id", F.round("rouge_l", 9).alias("rouge_l"))


@query(
    "H31",
    f"""with t as (select conv_id, turn, {RTOK('pred')} as p, {RTOK('ref')} as r, ['nothing', 'of', 'the', 'kind'] as f from {B.REPLIES_SQL}),
       m as (select *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda a: a = w)), len(list_filter(r, lambda b: b = w))))), 0) as mt,
                    coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda a: a = w)), len(list_filter(f, lambda b: b = w))))), 0) as mf from t),
       s as (select conv_id, turn, case when mt > 0 then 2.0::double * mt / (len(p) + len(r)) else 0 end as t, case when mf > 0 then 2.0::double * mf / (len(p) + 4) else 0 end as f from m)
       select conv_id, turn, t as rouge1_max, t - f as rouge1_diff, (t > f)::int as rouge1_acc from s""",
)
def true_false_rouge(spark, sf):
    """Similarity of a reply with the turn before it (true) and with a fixed wrong text (false)."""
    r = B.replies(spark, sf)
    score = lambda ref: C.rouge_n(F.col("pred"), ref, 1)
    return r.select("conv_id", "turn", *C.true_false_scores(F.array(score(F.col("ref"))), F.array(score(F.lit("nothing of the kind"))), "rouge1"))
