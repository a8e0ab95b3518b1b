import textwrap

from tallyframe.llm import licenses

NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish and distribute copies.",
}


def test_wrapped_notices(spark):
    rows, expected = [], {}
    for family, text in NOTICES.items():
        for width in (30, 40, 70, 80):
            for mark in ("", "# ", " * "):
                wrapped = "\n".join(mark + x for x in textwrap.wrap(text, width))
                for before in ("", "Some prose of two lines\nthat says nothing.\n\n", "A sentence about the weather.\n" * 30):
                    expected[len(rows)] = (family, before.count("\n"))
                    rows.append((len(rows), f"{before}{wrapped}\n\nMore prose."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.scan(docs, licenses.fit([])).collect():
        family, line = expected[r.doc_id]
        sure = [x for x in r.licenses if x.confirmed]
        assert {x.family for x in sure} == {family}, r.doc_id
        assert line <= min(x.line for x in sure) <= line + 2, r.doc_id


def test_prose_lines_make_no_notice(spark):
    docs = spark.createDataFrame([(1, "\n".join(licenses.OTHERS)), (2, "All rights\n\nreserved.")], "doc_id long, text string")
    assert all(not x.confirmed for r in licenses.scan(docs, licenses.fit([])).collect() for x in r.licenses)
