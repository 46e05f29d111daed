"""License scans by sentences and rules.

A text is cut into sentences, each is normalised and mapped to the identifier of a known license sentence; the
sequence of identifiers is matched against ordered rules, longer rules first, so that a part of a license that a
longer rule has used is not reported again. An unknown sentence ends a rule: what stands in the middle of a license may change it. Names of
holders are put in a common form, and numbers and bullets of clauses are no sentences. A notice is a head, one license's name or two and a tail, and
gives an identifier for each name; an identifier expression gives one for each operand it knows, exceptions none. Texts are read three times: with line ends as sentence ends
(short notices on lines of their own), without (license texts wrapped over lines), and with blank lines alone as ends (license files under a title and
a copyright line). Everything is one projection: no row moves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licenses, lower case, with one blank for each run of other characters than a-z and 0-9.
SENTENCES: dict[str, str] = {
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2-short": "licensed under the apache license version 2 0",
    "apache-2-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-2-short": "this work is licensed under the gnu general public license version 2",
    "gpl-3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-4-short": "licensed under cc by 4 0",
    "cc-by-sa-4-short": "licensed under cc by sa 4 0",
    "cc-by-nc-4-short": "licensed under cc by nc 4 0",
    "cc-by-nd-4-short": "licensed under cc by nd 4 0",
    "cc-by-4-deed": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-deed": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-deed": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "reserved": "all rights reserved",
}
RULES: list[tuple[str, list[str]]] = [
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("MIT", ["mit-grant", "mit-as-is", "mit-liability"]),
    ("Apache-2.0", ["apache-2-grant", "apache-2-copy", "apache-2-see"]),
    ("GPL-3.0-or-later", ["gpl-3-grant", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-2-grant", "gpl-warranty", "gpl-see"]),
    ("MIT", ["mit-grant"]),
    ("Apache-2.0", ["apache-2-grant"]),
    ("GPL-3.0-or-later", ["gpl-3-grant"]),
    ("GPL-2.0-or-later", ["gpl-2-grant"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("Apache-2.0", ["apache-2-short"]),
    ("GPL-3.0-only", ["gpl-3-short"]),
    ("GPL-2.0-only", ["gpl-2-short"]),
    ("CC-BY-4.0", ["cc-by-4-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-short"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-short"]),
    ("CC-BY-4.0", ["cc-by-4-deed"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-deed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-deed"]),
    ("All-rights-reserved", ["reserved"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-2-grant"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-as-is"]),
    ("BSL-1.0", ["boost-grant"]),
    ("CC0-1.0", ["cc0-dedicated"]),
]
SENTENCES |= {
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl-2-grant": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "boost-grant": "distributed under the boost software license version 1 0",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
}
SENTENCES |= {
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "asf-to": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "asf-notice": "see the notice file distributed with this work for additional information regarding copyright ownership",
    "asf-grant": "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by the copyright holder",
    "epl-2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-2-terms-plain": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at http www eclipse org legal epl 2 0",
    "epl-1-terms": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl-1-terms-alone": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
}
RULES += [
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is"]),
    ("Apache-2.0", ["asf-to", "asf-notice", "asf-grant", "apache-2-copy", "apache-2-see"]),
    ("Apache-2.0", ["asf-grant", "apache-2-copy", "apache-2-see"]),
    ("Apache-2.0", ["asf-grant"]),
    ("MIT-0", ["mit-0-grant", "mit-as-is", "mit-liability"]),
    ("EPL-2.0", ["epl-2-terms"]),
    ("EPL-2.0", ["epl-2-terms-plain"]),
    ("EPL-1.0", ["epl-1-terms"]),
    ("EPL-1.0", ["epl-1-terms-alone"]),
]
# License identifiers, and names that notices give them, in the short forms that SHORT makes.
NAMES: dict[str, list[str]] = {
    "MIT": ["mit", "mit x11", "mit expat", "expat"],
    "MIT-0": ["mit 0", "mit no by"],
    "Apache-2.0": ["apache 2 0", "apache 2", "asl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD-4-Clause": ["bsd 4 clause", "4 clause bsd", "original bsd"],
    "ISC": ["isc"],
    "MPL-1.1": ["mozilla 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla 2 0", "mpl 2 0"],
    "EPL-1.0": ["eclipse 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse 2 0", "epl 2 0"],
    "Zlib": ["zlib", "zlib libpng"],
    "BSL-1.0": ["boost software 1 0", "boost software"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc zero 1 0"],
    "Artistic-2.0": ["artistic 2 0"],
    "EUPL-1.2": ["european union 1 2", "eupl 1 2"],
    "OFL-1.1": ["sil open font 1 1", "ofl 1 1"],
    "WTFPL": ["wtfpl"],
}
#: Short forms of the words of names, made in this order; {1} is the group.
SHORT = (
    (" licen[cs]e ", " "),
    (" version ", " "),
    (" v ?([0-9])", " {1}"),
    ("gplv", "gpl "),
    (" (?:gnu )?affero general public ", " agpl "),
    (" (?:gnu )?(?:lesser|library) general public ", " lgpl "),
    (" (?:gnu )?general public ", " gpl "),
    (" gnu ([al]?gpl) ", " {1} "),
    (" or (?:at your option )?(?:any )?(?:later|newer) ", " orlater "),
    (" public ", " "),
    (" creative commons ", " cc "),
    (" attribution ", " by "),
    (" share ?alike ", " sa "),
    (" non ?commercial ", " nc "),
    (" no ?deriv(?:ative|atives|s) ", " nd "),
    (" (?:international|unported|generic|universal) ", " "),
)
# Families of the GNU licenses with their versions, and conditions of the Creative Commons ones with theirs.
GNU = {"general": ("GPL", ("1", "2", "3")), "lesser general": ("LGPL", ("2.1", "3")), "library general": ("LGPL", ("2",)), "affero general": ("AGPL", ("3",))}
COMMONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
SPDX = (
    "MIT MIT-0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 Zlib BSL-1.0 Unlicense 0BSD CC0-1.0 CDDL-1.0 CDDL-1.1 Artistic-1.0 Artistic-2.0 WTFPL EUPL-1.1 EUPL-1.2 OFL-1.1 PostgreSQL PSF-2.0 Python-2.0 Ruby X11 curl NCSA OpenSSL BlueOak-1.0.0 UPL-1.0 MS-PL MS-RL AFL-3.0 OSL-3.0 Unicode-3.0"
).split()


def _normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _spdx_version(family: str, version: str) -> str:
    return f"{family}-{version if '.' in version else version + '.0'}"


#: Names as notices have them, and the license each means.
NAMED: dict[str, str] = {}
#: Operands of identifier expressions, normalised, "or later" as one word; old identifiers without "only" are those with it.
OPERANDS: dict[str, str] = {_normal(name): name for name in SPDX}


def _derived() -> None:
    """What follows from the tables: names and operands of the two families, and grants of the GNU one."""
    NAMED.update({alias: name for name, aliases in NAMES.items() for alias in aliases})
    for name in (f"CC-{kind}-{version}" for kind in COMMONS for version in COMMONS_VERSIONS):
        NAMED[_normal(name)] = OPERANDS[_normal(name)] = name
    known = set(SENTENCES.values())
    for family, (short, versions) in GNU.items():
        for version in versions:
            spdx, v, code = _spdx_version(short, version), _normal(version), short.lower()
            for number in {v, _normal(spdx.removeprefix(f"{short}-"))}:
                NAMED.update({f"{code} {number}": f"{spdx}-only", f"{code} {number} orlater": f"{spdx}-or-later"})
            OPERANDS.update({_normal(spdx): f"{spdx}-only", f"{_normal(spdx)} only": f"{spdx}-only", f"{_normal(spdx)} orlater": f"{spdx}-or-later"})
            head = f"this program is free software you can redistribute it and or modify it under the terms of the gnu {family} public license"
            published = "as published by the free software foundation"
            grants = {
                "later": f"{head} {published} either version {v} of the license or at your option any later version",
                "later-short": f"{head} {published} either version {v} or at your option any later version",
                "only": f"{head} version {v} {published}",
                "only-after": f"{head} {published} version {v} of the license",
            }
            for form, sentence in grants.items():
                if sentence not in known:
                    identifier = f"{spdx.lower()}-{family.split()[0]}-{form}"
                    SENTENCES[identifier] = sentence
                    RULES.append((f"{spdx}-or-later" if form.startswith("later") else f"{spdx}-only", [identifier]))


_derived()
#: A notice: what is licensed and how, one name or two, and where to read on.
NOTICE_HEAD = (
    "(?:(?:(?:this|the|all|our) (?:[a-z0-9]+ ){0,3}?(?:project|software|work|file|files|program|library|code|package|module|repository|script|content|contents|documentation|data|dataset) (?:is|are)"
    "|use of this source code is) )?(?:dual )?(?:licensed|released|distributed|made available|available|provided|published|governed|covered) (?:under|by) (?:either of |either )?(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
)
NOTICE_TAIL = "(?: (?:see|the|licen[cs]es?|public|copying|file|files|md|txt|rst|in|accompanying|included|at|your|option|for|more|full|further|details|information|text|copy|of)){0,20}"
_ANY_NAME = "|".join(sorted(NAMED, key=lambda n: (-len(n), n)))
NOTICE = f"^{NOTICE_HEAD}({_ANY_NAME})(?: (?:or|and) (?:the )?({_ANY_NAME}))?{NOTICE_TAIL} ?$"
IDENTIFIER = "spdx license identifier "
#: Every known sentence has one of these, which hold no white space that a text may have otherwise; other texts need no second look.
ANCHORS = ("licen", "copyright", "permission", "warrant", "reserved", "redistribut", "software", "gpl")
#: Pieces that blank lines and bullets leave of the above, and titles.
PARTS: dict[str, str] = {
    "mit-permission": SENTENCES["mit-grant"].partition(" the above copyright notice")[0],
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-2-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-2-title-s": "apache license version 2 0 january 2004 https www apache org licenses",
    "bsd-met": SENTENCES["bsd-redistribution"].removesuffix(" 1"),
    "bsd-met-source": SENTENCES["bsd-redistribution"].removesuffix("1") + SENTENCES["bsd-source"],
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-2.1-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl-3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl-2-title": "mozilla public license version 2 0",
}
_BSD = [["bsd-met", "bsd-source"], ["bsd-met-source"]]
PART_RULES: list[tuple[str, list[str]]] = [
    *[("BSD-3-Clause", [*start, "bsd-binary", "bsd-endorse", "bsd-as-is"]) for start in _BSD],
    *[("BSD-2-Clause", [*start, "bsd-binary", "bsd-as-is"]) for start in _BSD],
    *[("BSD-4-Clause", [*start, "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is"]) for start in _BSD],
    ("MIT", ["mit-permission", "mit-notice"]),
    ("MIT", ["mit-permission"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("Apache-2.0", ["apache-2-title-s"]),
    ("GPL-3.0-only", ["gpl-3-title"]),
    ("GPL-2.0-only", ["gpl-2-title"]),
    ("LGPL-3.0-only", ["lgpl-3-title"]),
    ("LGPL-2.1-only", ["lgpl-2.1-title"]),
    ("AGPL-3.0-only", ["agpl-3-title"]),
    ("MPL-2.0", ["mpl-2-title"]),
]
#: Common forms of sentences that name a holder, and of what numbers a clause. Stretches stay within a sentence.
HOLDERS = (
    ("neither the names? of [^\x01]{1,160}? nor the names? of (its|their|the|any)( other)? contributors? may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("this software is provided by [^\x01]{1,160}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("this product includes software developed by [^\x01]{1,160}", "this product includes software developed by the copyright holder"),
    ("this [a-z0-9]{1,40} is free software you can redistribute it", "this program is free software you can redistribute it"),
    ("this [a-z0-9]{1,40} is distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful"),
)
#: A plus after a version of a GNU license, which normal forms would lose.
PLUS = "(gpl[a-z .-]{0,3}[0-9](?:[.][0-9])?)[+]"
NUMBER = "[0-9]{1,3}|[a-z]|[ivx]{1,5}"


def sequence_sql(duckdb: bool, lines: bool, paragraphs: bool = False) -> str:
    """SQL of a text's sequence of known sentences: <id> for each, | for unknown ones between.

    Of ``paragraphs``, lines without a letter or digit (blank ones, or of comment marks) end sentences too.
    """
    every = ", 'g'" if duckdb else ""
    first = chr(92) if duckdb else "$"
    low = f"regexp_replace(lower(coalesce(text, '')), '{PLUS}', '{first}1-or-later'{every})"
    ends = "[.!?]+[ \t\r\n]" + ("|[\n]" if lines else "") + ("|[\n][^a-z0-9\n]*[\n]" if paragraphs else "")
    cut = f"regexp_replace({low} || chr(10), '{ends}', chr(1){every})"
    plain = f"regexp_replace({cut}, '[^a-z0-9' || chr(1) || ']+', ' '{every})"
    for pattern, form in HOLDERS:
        plain = f"regexp_replace({plain}, '{pattern}', '{form}'{every})"
    known = {sentence: f"<{identifier}>" for identifier, sentence in (SENTENCES | PARTS).items()}
    notices = {alias: f"<{name.lower()}-notice>" for alias, name in NAMED.items()}
    operands = {operand: f"<{name.lower()}-spdx>" for operand, name in OPERANDS.items()}
    expression = f"replace(substr(trim(s), {len(IDENTIFIER) + 1}), ' or later', ' orlater')"
    if duckdb:

        def look(key: str, table: dict[str, str]) -> str:
            return f"CASE {key} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())} END"

        cutting = f"string_split_regex({expression}, ' (?:or|and|with) ')"
        operand = f"array_to_string(list_transform({cutting}, lambda x: coalesce({look('trim(x)', operands)}, '')), '')"
        over, empty = "array_to_string(list_transform(string_split({}, chr(1)), lambda s: {}), '')", f"regexp_full_match(trim(s), '{NUMBER}') OR trim(s) = ''"
        like, bound = "regexp_matches", "list_transform([{}], lambda t: {})[1]"
    else:

        def look(key: str, table: dict[str, str]) -> str:
            return f"try_element_at(map({', '.join(f"'{k}', '{v}'" for k, v in table.items())}), {key})"

        cutting = f"split({expression}, ' (?:or|and|with) ')"
        operand = f"array_join(transform({cutting}, x -> coalesce({look('trim(x)', operands)}, '')), '')"
        over, empty = "array_join(transform(split({}, chr(1)), s -> {}), '')", f"trim(s) rlike '^({NUMBER})?$'"
        like, bound = "regexp_like", "transform(array({}), t -> {})[0]"
    short = "concat(trim(s), ' ')"
    for pattern, form in SHORT:
        short = f"regexp_replace({short}, '{pattern}', '{form.replace('{1}', first + '1')}'{every})"
    named = [f"coalesce({look(f"regexp_extract(t, '{NOTICE}', {n})", notices)}, '')" for n in (1, 2)]
    # an array of one, so that the short form is made once
    notice = bound.format(short, f"coalesce(nullif(concat({', '.join(named)}), ''), '|')")
    other = f"CASE WHEN starts{'_' if duckdb else ''}with(trim(s), '{IDENTIFIER}') THEN coalesce(nullif({operand}, ''), '|') WHEN {like}(trim(s), 'licen|gpl') THEN {notice} ELSE '|' END"
    each = f"CASE WHEN {empty} THEN '' ELSE coalesce({look('trim(s)', known)}, {other}) END"
    return f"regexp_replace({over.format(plain, each)}, '[|]+', '|'{every})"


def _long_rules() -> list[tuple[str, str]]:
    """Name and sequence of the rules of several sentences, longer ones first."""
    rules = [(name, ids) for name, ids in PART_RULES + RULES if len(ids) > 1]
    return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in sorted(rules, key=lambda r: -len(r[1]))]


def _hits(sequence: str) -> str:
    """The sequence with rules of several sentences in place of these."""
    out = sequence
    for name, ids in _long_rules():
        out = f"replace({out}, '{ids}', '<={name}>')"
    return out


def _single() -> dict[str, str]:
    """What a sentence, or a rule that stands in place of several, says by itself."""
    marked = {f"{name.lower()}-{kind}": name for kind, names in (("notice", NAMED), ("spdx", OPERANDS)) for name in names.values()}
    return {ids[0]: name for name, ids in PART_RULES + RULES if len(ids) == 1} | {f"={name}": name for name, _ in _long_rules()} | marked


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (different names in alphabetic order, comma between), sentences (known identifiers of the reading by lines) and wrapped (of that without) of every document.

    Empty strings where nothing is known: null and empty texts too. Repeated rows are scanned each; other
    columns are left out. Text of any length is one row's expression. licenses has those of the reading by paragraphs too, which has no column.
    """
    low = F.lower(F.col("text"))
    possible = F.lit(False)
    for a in ANCHORS:
        possible = possible | low.contains(a)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(possible, F.col("text").cast("string")).alias("text"))
    # without such a line the reading by paragraphs is the wrapped one
    parted = f"if(lower(text) rlike '[\n][^a-z0-9\n]*[\n]', {sequence_sql(False, False, True)}, '')"
    told = rows.select("doc_id", F.expr(sequence_sql(False, True)).alias("sentences"), F.expr(sequence_sql(False, False)).alias("wrapped"), F.expr(parted).alias("parted"))
    both = f"concat({_hits('sentences')}, {_hits('wrapped')}, {_hits('parted')})"
    names = ", ".join(f"'{i}', '{name}'" for i, name in _single().items())
    each = f"transform(regexp_extract_all({both}, '<([^>]+)>', 1), i -> try_element_at(map({names}), i))"
    out = told.withColumn("licenses", F.expr(f"array_join(array_sort(array_distinct(array_compact({each}))), ',')"))
    return out.select("doc_id", "licenses", *[F.replace(c, F.lit("|"), F.lit("")).alias(c) for c in ("sentences", "wrapped")])


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    cases = " ".join(f"WHEN '{i}' THEN '{name}'" for i, name in _single().items())
    each = f"list_transform(regexp_extract_all(hits, '<([^>]+)>', 1), lambda i: CASE i {cases} END)"
    return f"""
        WITH told AS (SELECT doc_id, {sequence_sql(True, True)} AS sentences, {sequence_sql(True, False)} AS wrapped, {sequence_sql(True, False, True)} AS parted FROM documents),
        hits AS (SELECT *, concat({_hits("sentences")}, {_hits("wrapped")}, {_hits("parted")}) AS hits FROM told)
        SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter({each}, lambda x: x IS NOT NULL))), ','), '') AS licenses, replace(sentences, '|', '') AS sentences, replace(wrapped, '|', '') AS wrapped FROM hits"""
