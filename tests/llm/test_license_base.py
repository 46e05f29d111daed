"""The rule base on usual texts, against a reading written in plain Python."""

import random
import re

import pytest

from quillon.llm import licenses
from test_scans import BSD_FILE, BSD_THIRD, GPL_NOTICE, MIT_FILE

ISC_FILE = """ISC License

Copyright (c) 2021, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
MPL_NOTICE = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int main() {}
"""
LGPL_NOTICE = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
ASF_HEADER = """# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
EPL_HEADER = """/*
 * Copyright (c) 2020 Some One
 *
 * This program and the accompanying materials are made
 * available under the terms of the Eclipse Public License 2.0
 * which is available at https://www.eclipse.org/legal/epl-2.0/
 *
 * SPDX-License-Identifier: EPL-2.0
 */
"""
GPL_TWO = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2, or
(at your option) any later version.
"""
ADVERT = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of Somewhere.

4. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
MIT_CUT = "Permission is hereby granted, free of charge," + MIT_FILE.partition("Permission is hereby granted, free of charge,")[2].partition("The above copyright notice")[0]
CASES = {
    "spdx-or": ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "Apache-2.0,MIT"),
    "spdx-with": ("/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause */", "BSD-3-Clause,GPL-2.0-or-later"),
    "spdx-plus": ("# SPDX-License-Identifier: LGPL-2.1+\n", "LGPL-2.1-or-later"),
    "spdx-old": ("# SPDX-License-Identifier: GPL-2.0\n", "GPL-2.0-only"),
    "spdx-made-up": ("# SPDX-License-Identifier: AGPL-2.1-or-later\n", ""),
    "see-file": ("This project is licensed under the MIT License - see the LICENSE.md file for details", "MIT"),
    "see-link": ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.", "MIT"),
    "terms": ("Licensed under the terms of the MIT license", "MIT"),
    "either": ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
    "gpl-plus": ("The code in this repository is licensed under GPLv3+", "GPL-3.0-or-later"),
    "gpl-plus-files": ("All files are licensed under the GPLv3+.", "GPL-3.0-or-later"),
    "lgpl-name": ("This library is distributed under the GNU Lesser General Public License v2.1 or later", "LGPL-2.1-or-later"),
    "exception": ("This project is licensed under the MIT License except for the logo.", ""),
    "not": ("This project is not licensed under the MIT License.", ""),
    "asf": (ASF_HEADER, "Apache-2.0"),
    "epl": (EPL_HEADER, "EPL-2.0"),
    "gpl-two": (GPL_TWO, "GPL-2.0-or-later"),
    "bsd-four": (BSD_FILE.format(gap="\n", marks=("1.", "2."), third=ADVERT), "BSD-4-Clause"),
    "cc-three": ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    "cc-share": ("Our documentation is available under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    "mit-cut": (MIT_CUT, "MIT"),
    "isc": (ISC_FILE, "ISC"),
    "mpl": (MPL_NOTICE, "MPL-2.0"),
    "lgpl": (LGPL_NOTICE, "LGPL-2.1-or-later"),
    "spdx": ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
    "spdx-later": ("# SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0-or-later"),
    "university": (BSD_FILE.format(gap="\n", marks=("1.", "2."), third=BSD_THIRD.format(gap="\n", mark="3.").replace("the copyright holder", "the University of California, Berkeley")), "BSD-3-Clause"),
    "regents": (BSD_FILE.format(gap="\n", marks=("1.", "2."), third=BSD_THIRD.format(gap="\n", mark="3.")).replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS"), "BSD-3-Clause"),
    "stars": (BSD_FILE.format(gap="", marks=("*", "*"), third=""), "BSD-2-Clause"),
    "changed": (BSD_FILE.format(gap="\n", marks=("1.", "2."), third="\n3. You must sing a song about this software before each use of it.\n"), ""),
    "notice": ("This project is licensed under the Mozilla Public License 2.0.", "MPL-2.0"),
    "readme": ("Use it well.\nThis software is released under the BSD 3-Clause License.\nBye", "BSD-3-Clause"),
    "mit": (MIT_FILE.format(holder="Copyright (c) 2020 Jane Doe\n"), "MIT"),
    "gpl": (GPL_NOTICE.format(holder="", mark=";", end=";", n=2), "GPL-2.0-or-later"),
    "title": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted", "GPL-3.0-only"),
}


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(3)
    texts = [t for t, _ in CASES.values()]
    texts += ["\n".join(t.split("\n")[: rng.randint(1, 14)]) + rng.choice(["", "\nother words. and more\n"]) + rng.choice(texts) for t in texts for _ in range(6)]
    texts += [" ".join(rng.choice(["MIT License", "licensed under the", "1. ", "All rights reserved.", "\n", "\n\n", "Redistribution"]) for _ in range(12)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, {r.doc_id: r for r in licenses.scan(frame).collect()}


def test_usual_texts(scanned):
    _, found = scanned
    assert {name: found[i].licenses for i, name in enumerate(CASES)} == {name: want for name, (_, want) in CASES.items()}


def plain_notice(words):
    """Names of a notice, taken word by word; None if the sentence is none."""
    if not re.search("licen|gpl", " ".join(words)):
        return None
    words = list(words)
    nouns = "project software work file files program library code package module repository script content contents documentation data dataset".split()
    if words[:6] == "use of this source code is".split():
        words = words[6:]
    elif words and words[0] in ("this", "the", "all", "our"):
        at = next((i for i in range(1, 5) if words[i : i + 1] and words[i] in nouns and words[i + 1 : i + 2] in (["is"], ["are"])), None)
        if at is None:
            return None
        words = words[at + 2 :]
    text = " ".join(words) + " "
    for lead in ("dual ", "made "):
        text = text.removeprefix(lead) if lead == "dual " or text.startswith("made available ") else text
    verb, _, text = text.partition(" ")
    if verb not in "licensed released distributed available provided published governed covered".split():
        return None
    if not text.startswith(("under ", "by ")):
        return None
    text = " " + text.partition(" ")[2]
    for have, want in ((" licence ", " "), (" license ", " "), (" version ", " "), ("gplv", "gpl ")):
        text = text.replace(have, want)
    text = re.sub(r" v ?(?=\d)", " ", text)
    for family, code in (("affero ", "agpl"), ("lesser ", "lgpl"), ("library ", "lgpl"), ("", "gpl")):
        text = text.replace(f" gnu {family}general public ", f" {code} ").replace(f" {family}general public ", f" {code} ").replace(f" gnu {code} ", f" {code} ")
    for later in ("at your option any later", "at your option later", "any later", "later", "any newer", "newer"):
        text = text.replace(f" or {later} ", " orlater ")
    for have, want in (("public", ""), ("creative commons", "cc"), ("attribution", "by"), ("sharealike", "sa"), ("share alike", "sa"), ("noncommercial", "nc"), ("non commercial", "nc"), ("noderivatives", "nd"), ("no derivatives", "nd"), ("international", ""), ("unported", "")):
        text = text.replace(f" {have} ", f" {want} " if want else " ")
    text = text.strip() + " "
    for lead in (("either of ", "either "), ("the ",), ("terms of ", "terms and conditions of "), ("the ", "a ", "an ")):
        text = next((text.removeprefix(x) for x in lead if text.startswith(x)), text)
    tail = set("see the license licence licenses licences public copying file files md txt rst in accompanying included at your option for more full further details information text copy of".split())

    def rests(rest):
        return len(rest.split()) <= 20 and set(rest.split()) <= tail

    for name in licenses.NAMED:
        if text.startswith(name + " "):
            rest = text.removeprefix(name + " ")
            if rests(rest):
                return [licenses.NAMED[name]]
            for other in licenses.NAMED:
                for join in ("or ", "and ", "or the ", "and the "):
                    if rest.startswith(join + other + " ") and rests(rest.removeprefix(join + other + " ")):
                        return [licenses.NAMED[name], licenses.NAMED[other]]
    return None


def plain_reading(text, ends):
    """Identifiers of a text's sentences, None for unknown ones; sentences cut by a regular expression."""
    known = {s: i for i, s in (licenses.SENTENCES | licenses.PARTS).items()}
    out = []
    text = re.sub(r"(gpl[a-z .-]{0,3}\d(?:\.\d)?)\+", r"\1-or-later", text.lower())
    for part in re.split(ends, text + "\n"):
        words = " ".join(re.findall("[a-z0-9]+", part))
        words = re.sub(r"neither the names? of .{1,160}? nor the names? of (?:its|their|the|any)(?: other)? contributors? may be used", "neither the name of the copyright holder nor the names of its contributors may be used", words)
        words = re.sub(r"this software is provided by .{1,160}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express", words)
        words = re.sub(r"this product includes software developed by .{1,160}", "this product includes software developed by the copyright holder", words)
        words = re.sub(r"this \w{1,40} is (free software you can redistribute it|distributed in the hope that it will be useful)", r"this program is \1", words)
        if words.startswith("spdx license identifier "):
            operands = re.split(" (?:or(?! later)|and|with) ", words.removeprefix("spdx license identifier "))
            found = [licenses.OPERANDS[x] for x in (o.replace(" or later", " orlater") for o in operands) if x in licenses.OPERANDS]
            out += [f"{x.lower()}-spdx" for x in found] or [None]
        elif words and not re.fullmatch("[0-9]{1,3}|[a-z]|[ivx]{1,5}", words):
            names = None if words in known else plain_notice(words.split())
            out += [f"{n.lower()}-notice" for n in names] if names else [known.get(words)]
    return out


def plain_names(sequence):
    """Rules on a list: longer ones first, each use taken out and replaced by its name."""
    rules = sorted([(n, ids) for n, ids in licenses.PART_RULES + licenses.RULES if len(ids) > 1], key=lambda r: -len(r[1]))
    single = {ids[0]: n for n, ids in licenses.PART_RULES + licenses.RULES if len(ids) == 1}
    names, rest = set(), list(sequence)
    for name, ids in rules:
        i = 0
        while i <= len(rest) - len(ids):
            if rest[i : i + len(ids)] == ids:
                names.add(name)
                rest[i : i + len(ids)] = [None]
            i += 1
    single |= {f"{n.lower()}-{kind}": n for kind, table in (("notice", licenses.NAMED), ("spdx", licenses.OPERANDS)) for n in table.values()}
    return names | {single[i] for i in rest if i in single}


def test_rules_match_a_plain_reading(scanned):
    texts, found = scanned
    for n, text in enumerate(texts):
        names = set()
        for ends in (r"[.!?]+[ \t\r\n]|\n", r"[.!?]+[ \t\r\n]", r"[.!?]+[ \t\r\n]|\n[^a-z0-9\n]*\n"):
            names |= plain_names(plain_reading(text, ends))
        assert found[n].licenses == ",".join(sorted(names)), text
