import re

from pyspark.sql import functions as F

from tallyframe.llm import licenses

TEXTS = [
    (1, "Some prose here.\nReleased under the MIT License.\nMore prose."), (2, "word " * 100 + "Licensed under the Apache License, Version 2.0. " + "more " * 80),
    (3, None), (4, ""), (5, "\n\n"), (6, "The driver showed a license to the officer of the public library."), (7, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3."),
    (8, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (1, "Some prose here.\nReleased under the MIT License.\nMore prose."),
]
FOUND = {1: {"mit"}, 2: {"apache-2.0"}, 3: set(), 4: set(), 5: set(), 6: set(), 7: {"gpl"}, 8: {"cc-by-nc", "proprietary"}}


def test_families_and_edges(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("licenses", F.lit(1))
    out = licenses.scan(docs, licenses.train(docs)).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert {x.family for x in r.licenses if x.confirmed} == FOUND[r.doc_id], r.doc_id
    assert {r.doc_id: r.n_paragraphs for r in out} == {1: 3, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 2}
    assert [x.line for r in out if r.doc_id == 8 for x in r.licenses] == [0, 1]


def test_held_out_wordings():
    model = licenses.fit([])
    assert model.least >= 0.5 and len(model.vocabulary) > 200


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(docs, licenses.train(docs)).count() == 0


def test_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = licenses.scan(docs, licenses.train(docs)).select("doc_id", F.transform(F.filter("licenses", lambda x: x["confirmed"]), lambda x: x["family"]).alias("f"))
    rows = docs.select("doc_id", "text").join(found, "doc_id").collect()
    for family, line in (("mit", "Released under the MIT License."), ("cc-by-nc", "Licensed under CC BY-NC 4.0.")):
        assert {r.doc_id for r in rows if family in r.f} == {r.doc_id for r in rows if line in r.text}


def grams(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
    return {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def test_every_template_is_found_with_its_exact_similarity(spark):
    wordings = [(f, t) for f, group in licenses.TEMPLATES.items() for t in group]
    texts = [(i, f"Plain words before it.\n{t}\nand after.") for i, (_, t) in enumerate(wordings)]
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), licenses.fit([])).collect()}
    hit = 0
    for i, (family, text) in enumerate(wordings):
        for x in found[i]:
            if x.line == 1:
                line = grams(text)
                share = max(len(line & grams(t)) / len(grams(t)) for t in licenses.TEMPLATES[x.family])
                assert abs(share - x.similarity) < 1e-6 and x.confirmed == (share >= licenses.SIMILAR)
        hit += any(x.family == family and x.confirmed for x in found[i])
    # A wording that two families share may go to the other one.
    assert hit >= 0.95 * len(wordings)


def test_held_out_wordings_of_new_projects(spark):
    """Recall on wordings that the training never saw: another holder, another lead, a missing tail."""
    cases = [(f, v) for f, group in licenses.TEMPLATES.items() for t in group for v in (f"Widget 7 by J. Doe. {t}", f"Note: {t} Thanks to all contributors!")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(v for _, v in cases)), "doc_id long, text string"), licenses.fit([])).collect()
    found = {r.doc_id: {x.family for x in r.licenses if x.confirmed} for r in rows}
    assert sum(f in found[i] for i, (f, _) in enumerate(cases)) >= 0.9 * len(cases)


def test_very_long_lines_ties_null_ids_and_repeated_rows(spark):
    notice = "Released under the MIT License."
    long = "filler " * 20_000 + notice + " filler" * 20_000 + " " + notice
    rows = [(1, long), (None, notice), (None, notice), (3, f"{notice}\n{notice}"), (4, f"{notice} {notice}")]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.fit([])).collect()
    found = sorted((r.doc_id or -1, [(x.line, x.family) for x in r.licenses if x.confirmed]) for r in out)
    assert found == [(-1, [(0, "mit")]), (-1, [(0, "mit")]), (1, [(0, "mit")]), (3, [(0, "mit"), (1, "mit")]), (4, [(0, "mit")])]


def test_sample_covers_all_lines_of_long_documents(spark):
    """Pieces behind the twentieth line and of documents of any size can be drawn."""
    rows = [(1, "\n".join(f"line number {i} of the driver's license" for i in range(400))), (2, "word " * 10_000)]
    model = licenses.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 0.5 <= model.least <= 1
