"""Queries over n-grams and contamination (inventory N1-N7, A35, A41, J4, J5, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import let
from tallyframe.operators import ngrams as N
from tallyframe.plans import bindings as B
from tallyframe.plans.registry import query
from tallyframe.session import small_tasks

n13 = 13


def docs(spark, sf):
    return B.table(spark, sf, "documents")


def dealt_docs(spark, sf):
    """Texts in tasks whose n-grams are counted in memory."""
    return small_tasks(docs(spark, sf).select("doc_id", "text"), "text")


def bench(spark, sf):
    return B.table(spark, sf, "benchmark")


def dirty_documents(spark, sf):
    grams = N.register_contaminants(bench(spark, sf), "text", n13)
    return N.documents_with_ngrams(docs(spark, sf), ["doc_id"], "text", grams, n13)


@query("N1 N5", f"select doc_id, count(*) as n, count(distinct ngram) as n_distinct, min(ngram) as lo, max(ngram) as hi from {B.doc_ngrams_sql(13)} group by doc_id")
def word_ngrams(spark, sf):
    """Figures of each text's n-grams, from the array inside the row: nothing is exploded or shuffled."""
    figures = lambda g: F.struct(
        F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct"), F.array_min(g).alias("lo"), F.array_max(g).alias("hi")
    )
    # The array is bound once; a text without n-grams gives no row.
    none = F.array().cast("array<struct<n:bigint,n_distinct:bigint,lo:string,hi:string>>")
    one = let(N.ngram_array(N.normalize(F.col("text")), n13), lambda g: F.when(F.size(g) > 0, F.array(figures(g))).otherwise(none))
    return docs(spark, sf).select("doc_id", F.inline(one))


@query("N3", f"select distinct ngram from {B.bench_ngrams_sql(13)}")
def register_contaminants(spark, sf):
    return N.register_contaminants(bench(spark, sf), "text", n13)


@query(
    "J4",
    f"""select distinct item_id from {B.bench_ngrams_sql(13)} b
        where ngram in (select ngram from {B.doc_ngrams_sql(13)})""",
)
def contaminated_items(spark, sf):
    return N.contaminated_docs(docs(spark, sf), "text", bench(spark, sf), ["item_id"], "text", n13)


@query(
    "J4",
    f"select distinct doc_id from {B.doc_ngrams_sql(13)} where ngram in (select ngram from {B.bench_ngrams_sql(13)})",
)
def contaminating_documents(spark, sf):
    return dirty_documents(spark, sf)


@query(
    "A35 N6",
    f"""select ngram, count(distinct doc_id) as n_docs from {B.doc_ngrams_sql(13)} group by ngram having count(distinct doc_id) > 1""",
)
def frequent_ngrams(spark, sf):
    index = N.word_ngrams(dealt_docs(spark, sf), ["doc_id"], "text", n13, once=True)
    return N.ngram_doc_frequency(index, "doc_id", min_docs=1, distinct_rows=True)


@query(
    "A35 N6",
    f"""select ngram, count(distinct doc_id) as n_docs from {B.doc_ngrams_sql(5)} group by ngram having count(distinct doc_id) > 10""",
)
def sketched_frequent_ngrams(spark, sf):
    """5-grams of more than ten documents; a sketch keeps the hashes of rare ones from travelling."""
    index = N.word_ngrams(docs(spark, sf), ["doc_id"], "text", 5, once=True)
    return N.ngram_doc_frequency(index, "doc_id", min_docs=10, distinct_rows=True, cells=1 << 20)


@query(
    "A41",
    f"""with c as (select ngram, count(*) as n from {B.doc_ngrams_sql(13)} group by ngram), b as (select distinct ngram from {B.bench_ngrams_sql(13)})
        select sum(n)::bigint as total_ngrams, count(*) as unique_ngrams, count(*) filter (ngram in (select ngram from b)) as matching_unique,
        count(*) filter (ngram not in (select ngram from b)) as non_matching_unique from c""",
)
def contamination_report(spark, sf):
    corpus = N.word_ngrams(dealt_docs(spark, sf), [], "text", n13)
    return N.contamination_report(corpus, N.register_contaminants(bench(spark, sf), "text", n13))


@query(
    "J4 A41",
    f"select distinct ngram from {B.bench_ngrams_sql(13)} where ngram in (select ngram from {B.doc_ngrams_sql(13)})",
)
def matched_ngrams(spark, sf):
    grams = N.register_contaminants(bench(spark, sf), "text", n13)
    return N.match_ngrams(N.word_ngrams(docs(spark, sf), [], "text", n13), grams)


DIRTY = f"(select distinct doc_id from {B.doc_ngrams_sql(13)} where ngram in (select ngram from {B.bench_ngrams_sql(13)}))"


@query(
    "J5 N7",
    f"""with d as {DIRTY}, s as (select doc_id, n_chars::double as v, doc_id in (select doc_id from d) as dirty from documents)
        select round(avg(v), 6) as all_docs, round(avg(v) filter (not dirty), 6) as clean_docs, round(avg(v) filter (dirty), 6) as contaminated_docs,
        count(*) filter (dirty) as n_contaminated, count(*) as n_all from s""",
)
def decontaminated_scores(spark, sf):
    dirty = dirty_documents(spark, sf)
    out = N.decontaminated_scores(docs(spark, sf).select("doc_id", "n_chars"), dirty, "doc_id", "n_chars")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns[:3]], *out.columns[3:])


@query("J5", f"select doc_id, lang, n_chars from documents where doc_id not in (select doc_id from {DIRTY})")
def clean_subset(spark, sf):
    dirty = dirty_documents(spark, sf)
    clean, _ = N.split_clean(docs(spark, sf).select("doc_id", "lang", "n_chars"), dirty, "doc_id")
    return clean


SPANS = """select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: struct_pack(
    g := array_to_string(w[i:i + 12], ' '), s := list_sum(list_transform(p[1:i * 2 - 1], lambda x: length(x)))::int,
    e := (list_sum(list_transform(p[1:(i + 12) * 2], lambda x: length(x))) - 1)::int))) as x
  from (select doc_id, list_filter(q, lambda x: regexp_matches(x, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]')) as w,
        case when regexp_matches(q[1], '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]') then list_prepend('', q) else q end as p
        from (select doc_id, regexp_extract_all(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+') as q from documents))"""


@query("N2", f"select doc_id, count(*) as n, sum(x.s)::bigint as starts, sum(x.e)::bigint as ends, max(x.g) as hi from ({SPANS}) group by doc_id")
def word_ngrams_indices(spark, sf):
    """Figures of each text's n-grams and places, summed up inside the row, then per id."""
    total = lambda g, name: F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: acc + x[name]).alias(f"{name}s")
    figures = lambda g: F.struct(
        F.size(g).cast("long").alias("n"), total(g, "start"), total(g, "end"), F.array_max(F.transform(g, lambda x: x["ngram"])).alias("hi")
    )
    g = N.word_ngrams_indices(docs(spark, sf), ["doc_id"], "text", n13, figures)
    return g.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n", "starts", "ends")], F.max("hi").alias("hi"))


# Hits in order, at most ten per document; what lies between the cuts, then what lies behind the last one.
CHUNKS = f"""with h as (select s.doc_id, list(x order by x.s) as h from ({SPANS}) s
         where {B.sql_normalize('x.g')} in (select ngram from {B.bench_ngrams_sql(13)}) group by 1),
       d as (select doc_id, text, length(text) as n, coalesce(h, []) as h from documents left join h using (doc_id)),
       c as (select doc_id, text, n, list_transform(h, lambda x: greatest(0, x.s - 200)) as f, list_transform(h, lambda x: least(n, x.e + 200)) as t from d where len(h) <= 10),
       k as (select doc_id, text, list_filter(list_transform(range(1, len(f) + 1), lambda i: struct_pack(a := case when i = 1 then 0 else t[i - 1] end, b := f[i])), lambda p: p.b - p.a > 200)
               || case when coalesce(t[-1], -1) < n - 200 then [struct_pack(a := coalesce(t[-1], -1) + 1, b := n)] else [] end as p from c),
       e as (select doc_id, text, unnest(range(1, len(p) + 1)) as i, p from k)
       select doc_id, (i - 1)::int as chunk_id, substr(text, p[i].a + 1, p[i].b - p[i].a) as chunk from e"""


@query("N4", CHUNKS)
def clean_corpus(spark, sf):
    dirt = N.register_contaminants(bench(spark, sf), "text", n13)
    return N.clean_corpus(docs(spark, sf), "doc_id", "text", dirt)
