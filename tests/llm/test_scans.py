import random
import re
import html

import duckdb
import numpy as np

from quillon.llm import decontamination, html_text, licenses

BSD = """# Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
# following conditions are met:
# 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
# disclaimer in the documentation and/or other materials provided with the distribution.
{third}#
# THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
THIRD = "# 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def test_license_rules(spark, odd, none):
    rows = [(1, BSD.format(third=THIRD)), (2, BSD.format(third="")), (3, "word\nReleased under the MIT License.\nmore"), (4, "A. All rights reserved."), (5, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (6, "licensed under nothing"), (7, None)]
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: "MIT", 4: "All-rights-reserved", 5: "Apache-2.0,CC-BY-NC-4.0", 6: "", 7: ""}
    assert {r.licenses for r in licenses.scan(odd).collect()} == {""}
    assert licenses.scan(none).count() == 0


def test_license_sql(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd.where("doc_id != -7 or doc_id is null")):
        documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
        want = duckdb.sql(licenses.oracle_sql()).fetchall()
        key = lambda r: str(tuple(r))
        norm = lambda r: tuple(None if x is None or x != x else x for x in r)
        assert sorted((norm(r) for r in want), key=key) == sorted((tuple(r) for r in licenses.scan(docs).collect()), key=key)


HOLDER = "Copyright (c) 2020 Jane Doe\n"
MIT_FILE = """MIT License

{holder}
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
APACHE_NOTICE = """{holder}
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
APACHE_FILE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
GPL_NOTICE = """A program that does one thing
{holder}
This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{end} either version {n} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD_FILE = """BSD License

Copyright (c) 2020, Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{gap}{marks[0]} Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
{gap}{marks[1]} Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD_THIRD = """{gap}{mark} Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""


def test_license_files(spark):
    """Usual files with title and copyright line, also behind comment marks."""
    wanted = [(MIT_FILE.format(holder=HOLDER), "MIT"), (APACHE_NOTICE.format(holder=HOLDER), "Apache-2.0"), (APACHE_FILE, "Apache-2.0")]
    wanted += [(GPL_NOTICE.format(holder=HOLDER, mark=m, end=e, n=n), f"GPL-{n}.0-or-later") for n, m, e in ((2, ";", ";"), (3, ":", ","))]
    for gap in ("", "\n"):
        for marks in (("1.", "2.", "3."), ("*", "*", "*")):
            wanted += [(BSD_FILE.format(gap=gap, marks=marks, third=t), f"BSD-{n}-Clause") for n, t in ((3, BSD_THIRD.format(gap=gap, mark=marks[2])), (2, ""))]
    wanted += [("".join(f" * {line}".rstrip() + "\n" for line in t.split("\n")), name) for t, name in wanted[:5]] + [(t.replace("\n", "\r\n"), name) for t, name in wanted]
    rows = [(i, t) for i, (t, _) in enumerate(wanted)]
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(wanted))] == [name for _, name in wanted]


def test_license_anchors_span_no_white_space(spark):
    documents = spark.createDataFrame([(1, "All rights\nreserved."), (2, "All rights  reserved."), (3, "All rights\treserved.")], "doc_id long, text string")
    found = sorted(tuple(r) for r in licenses.scan(documents).collect())
    assert [r[1] for r in found] == ["All-rights-reserved"] * 3
    documents = documents.toPandas()
    assert sorted(duckdb.sql(licenses.oracle_sql()).fetchall()) == found
    assert all(any(a in s for a in licenses.ANCHORS) for s in (licenses.SENTENCES | licenses.PARTS).values()) and not any(" " in a for a in licenses.ANCHORS)


def plain_fewest(window, text):
    row = list(range(len(window) + 1))
    best = row[-1]
    for x in text:
        new = [0]
        for i, y in enumerate(window):
            new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_alignment():
    rng = random.Random(3)
    for _ in range(200):
        w = np.array([rng.choice([1, 2, 3]) for _ in range(rng.randint(8, 20))])
        c = np.array([rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 40))])
        best = plain_fewest(w.tolist(), c.tolist())
        got = decontamination.aligned(w, c, len(w) - 1)
        assert (got is None and best == len(w)) or got[0] == best


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 45)))) for i in range(25)] + [(50, "tiny"), (51, ""), (None, "an item without an id but of words")]
    docs = []
    for d in range(90):
        text = " ".join(word() for _ in range(60))
        if d % 3 == 0:
            item = rng.choice(items[:25])[1]
            passage = list(item[rng.choice([0, 0, len(item) // 3]) :])
            for _ in range(rng.randint(0, 8)):
                passage[rng.randrange(len(passage))] = rng.choice("xyz")
            text = f"{text[:150]} {''.join(passage)} {text[150:]}"
        docs.append((d, text.upper() if d % 7 == 0 else text))
    want = set()
    for i, t in items[:25]:
        index = decontamination.Index([(i, t)])
        for d, text in docs:
            codes = decontamination.canonical(text)[0].tolist()
            if any(plain_fewest(w.codes.tolist(), codes) <= w.edits for w in index.windows):
                want.add((d, i))
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 15


def fewest_of_all_windows(item, text, width=64):
    """Fewest edits of any window of the item, one starting at each character, by the plain table for all windows at once."""
    windows = np.array([[ord(c) for c in item[i : i + width]] for i in range(len(item) - width + 1)])
    places = np.arange(width + 1)
    row = np.tile(places, (len(windows), 1))
    best = row[:, -1].min()
    for x in text:
        new = np.zeros_like(row)
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != ord(x)), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - places, axis=1) + places
        best = min(best, row[:, -1].min())
    return int(best)


def test_passages_from_every_place_of_an_item():
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    items = [" ".join(word("etaoin") for _ in range(40)) for _ in range(2)]
    index = decontamination.Index(list(enumerate(items)))
    other = lambda: " ".join(word("xyzq") for _ in range(8))
    places = range(len(items[0]) - 63)
    texts = [f"{other()} {items[0][i : i + 64]} {other()}" for i in places]
    found = {r[0]: r[1:] for r in decontamination.find(index, texts)}
    assert set(found) == set(places) and {r[0] for r in found.values()} == {0} and {r[4] for r in found.values()} == {0}
    assert all(items[0][i + 4 : i + 60] in texts[i][found[i][1] : found[i][2]] for i in places)
    texts = []
    for _ in range(100):
        item = rng.choice(items)
        at = rng.randrange(len(item) - 63)
        passage = list(item[at : at + rng.randint(62, 80)])
        for _ in range(rng.randint(0, 7)):
            i, kind = rng.randrange(len(passage)), rng.random()
            passage[i : i + (kind < 0.6)] = [] if kind < 0.3 else [rng.choice("xyzq")]
        texts.append(f"{other()} {''.join(passage).strip()} {other()}")
    texts = [" ".join(t.split()) for t in texts]
    want = {(n, i): e for n, t in enumerate(texts) for i, item in enumerate(items) if (e := fewest_of_all_windows(item, t)) <= 4}
    assert {(r[0], r[1]): r[5] for r in decontamination.find(index, texts)} == want and 40 < len(want) < 90


def test_leak_places_and_blocks(spark, monkeypatch, odd, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items.items()] + [(1000, "nothing of it")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in decontamination.leaks(docs, bench).collect()}
    for i, t in items.items():
        a, b, e = found[i, i]
        assert e == 0 and f"before {t} after"[a:b] in t and b - a >= len(t) - 1
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 500)
    assert {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in decontamination.leaks(docs, bench).collect()} == found
    assert decontamination.leaks(odd, bench).count() == 0
    assert decontamination.leaks(none, bench).count() == decontamination.leaks(docs, bench.limit(0)).count() == 0
    left = decontamination.without_leaks(docs.unionByName(spark.createDataFrame([(None, f"x {items[0]}"), (None, "clean")], "doc_id long, text string")), bench)
    assert sorted(r.text for r in left.collect()) == ["clean", "nothing of it"]
    assert decontamination.without_leaks(odd, bench).count() == odd.count()


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><a href="/x">no</a></nav>
<div class="cookie-notice">no</div><header><h1>no</h1></header>{open}<h1>Title &amp; more</h1><p><b>one
 <i>t</i>wo<br>three<p>four &lt;5&nbsp;&#233;</p><ul><li>a<li>b</ul><div class="ad">no</div><form><label>no</label><input></form>{close}
<section id="comments"><article><p>no</p></article></section><aside>no</aside><footer>&copy; no</footer></body></html>"""
TEXT = "Title & more\none two three\nfour <5 é\na\nb"


def test_extraction_without_other_pages():
    assert html_text.extract(PAGE.format(open="<article>", close="</article>")) == TEXT
    assert html_text.extract(PAGE.format(open='<div role="main">', close="</div>")) == TEXT
    assert html_text.extract(PAGE.format(open="<div>", close="</div>")) == TEXT
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x") == ""
    assert html_text.extract("a < b <c") == "a < b <c"


def test_articles_of_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r for r in pages.collect()}
    found = html_text.main_text(pages).collect()
    assert len(found) == len(raw)
    for r in found:
        inner = re.search(r"<article>(.*)</article>", raw[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == raw[r.page_id].url


def test_template_finds_the_container(spark, monkeypatch):
    """Pages without semantic tags: the slot that varies and holds most of the text is the article."""
    rng = random.Random(1)
    rows = []
    for i in range(30):
        body = "".join(f"<p>{' '.join(rng.choice(['one', 'two', 'three', 'four']) for _ in range(40))} {i}</p>" for _ in range(rng.randint(2, 6)))
        rows.append((i, f"http://h.example/{i}", f"<html><body><div class='top'><span>Site</span></div><div class='body'><div class='text'>{body}</div></div><div class='low'>end {i}</div></body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = html_text.templates(pages.selectExpr("'h.example' as host", "*")).first()
    assert told["container"].endswith("div.text") and any(len(c) > 3 for c in told["template"])
    found = sorted(map(tuple, html_text.main_text(pages).collect()))
    for page_id, _, text, _ in found:
        assert "Site" not in text and "end" not in text and text.count(str(page_id)) >= 2
    monkeypatch.setattr(html_text, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, html_text.main_text(pages).collect())) == found


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (2, "not a url", "", "c"), (2, "http://u:p@H.example:80/x?y", "<p>t", "c"), (None, None, "<p>" + "long " * 50_000, "c")], "page_id long, url string, html string, container string")
    found = sorted(map(tuple, html_text.main_text(pages).collect()), key=str)
    assert [(r[0], r[3]) for r in found] == [(1, 0), (2, 1), (2, 0), (None, 249_999)]
    assert html_text.main_text(pages.limit(0)).count() == 0
