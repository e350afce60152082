"""Licence scans: known sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table, texts

#: Normalised sentences and their identifiers (fixed values: public licence texts).
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "this project is licensed under the mit license": "mit-name",
    "licensed under the apache license version 2.0": "apache2-name",
    "licensed under the apache license version 2.0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-name",
    "licensed under the gnu general public license version 3": "gpl3-name",
    "licensed under the gnu general public license version 2": "gpl2-name",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2-name",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2-copy",
    "licensed under cc by 4.0": "ccby4-name",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4-name",
    "licensed under cc by sa 4.0": "ccbysa4-name",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "ccbysa4-name",
    "licensed under cc by nc 4.0": "ccbync4-name",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "ccbync4-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-name",
    "all rights reserved": "reserved",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "apache license version 2.0 january 2004": "apache2-title",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2.1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "fsf-verbatim",
    "mozilla public license version 2.0": "mpl2-title",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "see the gnu affero general public license for more details": "agpl-see",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1.0": "bsl1-name",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at": "epl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at": "epl1-copy",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
}
#: Licences that short statements name, and the words they use for them.
NAMED = {
    "MIT": ["mit license", "mit licence"], "Apache-2.0": ["apache license 2.0", "apache 2.0 license", "apache license version 2.0"], "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license"], "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license"],
    "ISC": ["isc license"], "MPL-2.0": ["mozilla public license 2.0", "mozilla public license version 2.0", "mpl 2.0"], "GPL-3.0-only": ["gnu general public license version 3", "gpl v3", "gplv3"], "GPL-2.0-only": ["gnu general public license version 2", "gpl v2", "gplv2"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl v3"], "LGPL-2.1-only": ["gnu lesser general public license version 2.1", "lgpl v2.1"], "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl v3"],
    "EPL-2.0": ["eclipse public license 2.0"], "BSL-1.0": ["boost software license version 1.0"], "CC0-1.0": ["cc0 1.0"], "CC-BY-4.0": ["cc by 4.0"], "CC-BY-SA-4.0": ["cc by sa 4.0"], "CC-BY-NC-4.0": ["cc by nc 4.0"], "CC-BY-ND-4.0": ["cc by nd 4.0"], "CC-BY-NC-SA-4.0": ["cc by nc sa 4.0"],
}
#: Licences of which only the tag of a file header is known.
TAGGED = ["GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "Unlicense", "Zlib", "0BSD", "MIT-0", "EPL-1.0", "Artistic-2.0", "PSF-2.0", "EUPL-1.2", "OFL-1.1", "MS-PL"]
_SAYS = ["licensed under the {}", "released under the {}", "distributed under the {}", "available under the {}", "this project is licensed under the {}", "this software is licensed under the {}", "this work is licensed under the {}"]


def _plain(name: str) -> str:
    return name.lower().replace("-", " ")


for _name, _forms in NAMED.items():
    for _form in _forms:
        for _say in _SAYS:
            _says = _say if "licen" in _form or "gpl" in _form or _form.startswith("mpl") else _say.replace(" the", "")
            SENTENCES.setdefault(_says.format(_form), f"name:{_name}")
for _name in [*NAMED, *TAGGED]:
    SENTENCES.setdefault(f"spdx license identifier {_plain(_name)}", f"name:{_name}")

#: Tags of former versions of the list, and what they mean now.
FORMER = {"GPL-3.0": "GPL-3.0-only", "GPL-2.0": "GPL-2.0-only", "LGPL-3.0": "LGPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "AGPL-3.0": "AGPL-3.0-only"}
for _old, _name in FORMER.items():
    SENTENCES.setdefault(f"spdx license identifier {_plain(_old)}", f"name:{_name}")

#: Rules in the order they are tried; what one has matched is gone for the later ones.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty", "gpl-see"]),
    ("MPL-2.0", ["mpl2-name", "mpl2-copy"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("Apache-2.0", ["apache2-head"]),
    ("Apache-2.0", ["apache2-name"]),
    ("MIT", ["mit-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("CC-BY-4.0", ["ccby4-name"]),
    ("CC-BY-SA-4.0", ["ccbysa4-name"]),
    ("CC-BY-NC-4.0", ["ccbync4-name"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-name", "unlicense-grant"]),
    ("Unlicense", ["unlicense-name"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "gpl-warranty", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-warranty", "lgpl-see"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-warranty", "agpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("Apache-2.0", ["apache2-title"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("GPL-2.0-only", ["gpl2-title"]),
    ("LGPL-3.0-only", ["lgpl3-title"]),
    ("LGPL-2.1-only", ["lgpl21-title"]),
    ("AGPL-3.0-only", ["agpl3-title"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("BSL-1.0", ["bsl1-name"]),
    ("EPL-2.0", ["epl2-copy"]),
    ("EPL-1.0", ["epl1-copy"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("MIT-0", ["mit0-grant", "mit-warranty"]),
    *((name, [f"name:{name}"]) for name in [*NAMED, *TAGGED]),
]


def hints(known: dict[str, str]) -> str:
    """A pattern that any text with one of the sentences has: one long word of each, as few words as cover all."""
    left, out = {s: {w for w in s.split(" ") if w.isalpha()} for s in known}, []
    while left:
        held: dict[str, list[str]] = {}
        for s, words in left.items():
            for w in words or {s.split(" ")[0]}:
                held.setdefault(w, []).append(s)
        # common words would let any text through: long ones first, then the one that most sentences have
        word = max(held, key=lambda w: (len(w) >= 6, len(held[w]), len(w), w))
        out.append(word.replace(".", "[.]"))
        for s in held[word]:
            del left[s]
    return "|".join(out) or "(?!)"


#: What may stand at the end of a known sentence: the address that its notice names.
TAILS = {
    "apache2-title": "https?[ \n](?:www[.])?apache[.]org[ \n]licenses",
    "mpl2-copy": "https?[ \n](?:www[.])?mozilla[.]org[ \n]mpl[ \n]2[.]0",
    "apache2-copy": "https?[ \n](?:www[.])?apache[.]org[ \n]licenses[ \n]license[ \n]2[.]0",
    "epl2-copy": "https?[ \n](?:www[.])?eclipse[.]org[ \n]legal[ \n]epl[ \n]2[.]0",
    "epl1-copy": "https?[ \n](?:www[.])?eclipse[.]org[ \n]legal[ \n]epl[ \n]v10[.]html",
}

# A line break inside a sentence goes on with a small letter.
_WRAP = "\\n[ \\t]*([a-z])"
_STOP = "([.!?;:])[ \\t]+"
_MARK = "[^a-z0-9.]+"
# Words that may stand for ``*`` in a known sentence: a holder's name.
_SLOT = "[^ \n]+(?:[ \n][^ \n]+){0,15}?"
_TAG = "spdx-license-identifier:"


def _one_tag_each(low: Column) -> Column:
    """Lower-case text in which a tag with an expression is one tag for each licence of it; ``+`` means later versions, exceptions go."""
    after = f"(?<={_TAG}[^\n]{{0,500}})[ \\t]+"
    split = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "(gpl-[0-9.]+)[+]", "$1-or-later"), f"{after}with[ \\t]+[a-z0-9.-]+", ""), f"{after}(?:or|and)[ \\t]+", f"\n{_TAG} ")
    return F.when(F.contains(low, F.lit(_TAG)), split).otherwise(low)


def sentences(text: Column) -> Column:
    """Array of normalised sentences that aren't empty: lower-case words, digits and inner dots, single blanks."""
    # a tag ends with its line
    text = F.when(text.rlike(f"(?i){_TAG}"), F.regexp_replace(text, f"(?i)({_TAG}[^\n]*)\n", "$1\n\n")).otherwise(text)
    low = F.translate(F.regexp_replace(text, _WRAP, " $1"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = F.regexp_replace(_one_tag_each(low), _STOP, "$1\n")
    parts = F.transform(F.split(whole, "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, _MARK, " "), "[.]+( |$)", "$1")))
    return F.filter(parts, lambda s: s != "")


# The number or letter of a list item before its sentence.
_ITEM = "(?:(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[ \\n])?"


def segments(text: Column, known: dict[str, str]) -> Column:
    """Array of the known sentences of a text, each over one or more pieces of :func:`sentences`, with "" for any other piece.

    A known sentence begins and ends with a piece (before it a list number,
    after it the address of its notice may stand); the pieces inside are joined
    whatever cut them, the longest sentence first.
    """
    tail = lambda s: f"(?:[ \n]{TAILS[known[s]]})?" if known[s] in TAILS else ""
    words = lambda s: "[ \n]".join(_SLOT if w == "*" else w.replace(".", "[.]") for w in s.split(" "))
    any_of = "|".join(words(s) + tail(s) for s in sorted(known, key=lambda s: (-len(s), s)))
    joined = F.array_join(sentences(text), "\n")
    # anchored to the start of a piece by what was matched before it
    found = F.regexp_extract_all(joined, F.lit(f"(?:^|\n)(?:{_ITEM}({any_of})(?=\n|\\z)|[^\n]+)"), F.lit(1))
    ends = "(" + "|".join(f"[ ]{t.replace('[ \n]', '[ ]')}" for t in TAILS.values()) + ")$"

    def plain(s: Column) -> Column:
        s = F.regexp_replace(F.translate(s, "\n", " "), ends, "")
        for slotted in (k for k in known if "*" in k.split(" ")):
            head, _, rest = slotted.partition("*")
            s = F.when(F.startswith(s, F.lit(head)) & F.endswith(s, F.lit(rest)), F.coalesce(F.when(s.isin([k for k in known if k.startswith(head)]), s), F.lit(slotted))).otherwise(s)
        return s

    return F.transform(found, plain)


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """doc_id, n_known, sequence, licenses, n_matches for every row of ``docs``.

    A text is cut at line breaks and at ``.!?;:`` before a blank; a line that
    starts with a small letter goes on with the last.  A known sentence is one
    of these pieces or several that follow each other (see :func:`segments`), so
    wrapped lines, marks inside it and list numbers don't hide it.  ``sequence``
    has the identifiers of the known sentences in order, with ``|`` between
    those that aren't neighbours.  The rules are tried in order on runs of
    neighbours, each match taking its sentences away; ``licenses`` has the
    names found, in the order of the rules, comma-joined.

    A null or empty text has no sentence.  Nothing is shuffled: rows with null
    or repeated doc_id stay as they are.  An empty table gives no rows.
    """
    known = SENTENCES if known is None else known
    rules = RULES if rules is None else rules
    table_ = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    named = F.transform(segments(F.col("text"), known), lambda s, i: F.struct(i.alias("at"), F.try_element_at(table_, s).alias("id")))
    found = F.when(F.lower("text").rlike(hints(known)), F.filter(named, lambda x: x["id"].isNotNull()))
    rows = texts(docs).select("doc_id", found.alias("found"))
    sequence = F.expr("""aggregate(found, named_struct('at', CAST(NULL AS int), 's', ''),
        (a, x) -> named_struct('at', x.at, 's', concat(a.s, CASE WHEN x.at > a.at + 1 THEN '|' ELSE '' END, '<', x.id, '>')), a -> a.s)""")
    rows = rows.select("doc_id", F.coalesce(F.when(F.size("found") > 0, F.size("found")), F.lit(0)).cast("long").alias("n_known"), F.when(F.size("found") > 0, sequence).alias("sequence"))
    # one pass over the rules: what a rule matches becomes a gap for the later ones
    want = F.array(*(F.lit("".join(f"<{i}>" for i in ids)) for _, ids in rules)) if rules else F.array().cast("array<string>")
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<long>").alias("hits"))

    def step(acc, w):
        less = F.replace(acc["rest"], w, F.lit("|"))
        n = F.floor((F.length(acc["rest"]) - F.length(less)) / (F.length(w) - 1)).cast("long")
        return F.struct(less.alias("rest"), F.concat(acc["hits"], F.array(n)).alias("hits"))

    hits = F.when(F.col("sequence").isNotNull(), F.aggregate(want, start, step, lambda acc: acc["hits"]))
    rows = rows.withColumn("hits", hits)
    names = F.array(*(F.lit(name) for name, _ in rules)) if rules else F.array().cast("array<string>")
    named = F.array_distinct(F.filter(names, lambda n, k: F.get("hits", k) > 0))
    return rows.select(
        "doc_id", "n_known", F.coalesce("sequence", F.lit("")).alias("sequence"), F.when(F.col("hits").isNotNull(), F.array_join(named, ",")).otherwise("").alias("licenses"),
        F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0)).cast("long").alias("n_matches"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def scan_sql(known: dict[str, str] = SENTENCES, rules: list = RULES) -> str:
    """DuckDB SQL of :func:`scan` over ``documents``, for texts whose known sentences are single pieces."""
    steps = ",\n".join(
        f"s{k + 1} AS (SELECT * EXCLUDE (rest), replace(rest, '{w}', '|') AS rest, (length(rest) - length(replace(rest, '{w}', '|'))) // {len(w) - 1} AS n{k} FROM s{k})"
        for k, w in enumerate("".join(f"<{i}>" for i in ids) for _, ids in rules)
    )
    order = list(dict.fromkeys(name for name, _ in rules))
    any_of = {name: " OR ".join(f"n{k} > 0" for k, r in enumerate(rules) if r[0] == name) for name in order}
    return rf"""
WITH known(sentence, id) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in known.items())}),
d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(regexp_replace(translate(
        regexp_replace(text, '\n[ \t]*([a-z])', ' \1', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS parts
      FROM documents),
u AS (SELECT rid, unnest(range(0, len(parts))) AS pos, unnest(parts) AS part FROM d),
f AS (SELECT rid, pos, known.id AS id, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS last
      FROM (SELECT rid, s, row_number() OVER (PARTITION BY rid ORDER BY pos) AS pos FROM (SELECT rid, pos, trim(regexp_replace(regexp_replace(part, '[^a-z0-9.]+', ' ', 'g'), '[.]+( |$)', '\1', 'g')) AS s FROM u) y WHERE s <> '') x JOIN known ON known.sentence = x.s),
g AS (SELECT rid, count(*) AS n_known, string_agg(CASE WHEN pos > last + 1 THEN '|' ELSE '' END || '<' || id || '>', '' ORDER BY pos) AS sequence FROM f GROUP BY rid),
s0 AS (SELECT *, sequence AS rest FROM g),
{steps}
SELECT d.doc_id, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, coalesce(sequence, '') AS sequence,
  CASE WHEN sequence IS NULL THEN '' ELSE concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in any_of.items())}) END AS licenses,
  CAST({" + ".join(f"coalesce(n{k}, 0)" for k in range(len(rules)))} AS BIGINT) AS n_matches
FROM d LEFT JOIN s{len(rules)} AS z ON d.rid = z.rid
"""


ORACLE_SQL = {"op3_license_scan": scan_sql()}
