import re
import textwrap

from cases import frame

from vetra.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def scan(spark, *texts):
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    return [r for r in sorted(licenses.scan(frame(spark, rows)).collect(), key=lambda r: r.doc_id)]


def test_every_sentence_has_a_hint_and_is_normal():
    for s in licenses.SENTENCES:
        assert re.search(licenses.hints(licenses.SENTENCES), s), s
        assert re.fullmatch(r"([a-z0-9.]+|[*])( ([a-z0-9.]+|[*]))*", s) and not re.search(r"[.](?= |$)(?<!v[.])", s), s
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES.values())


def test_rules_in_order(spark):
    a, b, c, d, e = scan(
        spark,
        MIT,
        "Some words.\nReleased under the MIT License.\nOther words.\nLicensed under the Apache License, Version 2.0.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        None,
        "",
    )
    assert (a.licenses, a.n_matches, a.n_known) == ("MIT", 1, 3)
    assert (b.licenses, b.n_matches) == ("Apache-2.0,MIT", 2) and "|" in b.sequence
    assert (c.licenses, c.n_known, c.n_matches) == ("", 1, 0)
    assert [tuple(x)[1:] for x in (d, e)] == [(0, "", "", 0)] * 2


def test_awkward_and_empty(spark):
    assert licenses.scan(frame(spark)).count() == frame(spark).count()
    assert licenses.scan(frame(spark, [])).count() == 0


MIT_TAIL = """

IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
NOTICES = [
    ("MIT", 4, MIT.replace("\n", " ") + MIT_TAIL),
    ("GPL-3.0-or-later", 3, GPL.format(":", ",", 3)),
    ("GPL-2.0-or-later", 3, GPL.format(";", ";", 2)),
    ("MPL-2.0", 2, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", 3, BSD),
    ("BSD-3-Clause", 4, BSD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", 5, APACHE),
]


def wrapped(text, width, mark):
    return "\n".join(f"{mark}{line}" for part in text.split("\n") for line in (textwrap.wrap(part, width, break_on_hyphens=False) or [""]))


def test_standard_notices_wrapped_and_unwrapped(spark):
    forms = [(name, n, "Copyright someone.\n\n" + form) for name, n, t in NOTICES for form in (t, *(wrapped(t, w, mark) for w in (40, 61, 76) for mark in ("", "# ", " * ")))]
    for (name, n, text), r in zip(forms, scan(spark, *(f[2] for f in forms))):
        assert (r.licenses, r.n_matches, r.n_known) == (name, 1, n), text


def test_other_notices_and_tags(spark):
    lgpl = GPL.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
    got = scan(
        spark, lgpl.format(";", ";", "2.1"), GPL.replace("GNU General", "GNU Affero General").format(":", ",", "3"), "// SPDX-License-Identifier: GPL-2.0-or-later\n", "This project is licensed under the BSD 3-Clause License.",
        "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    )
    assert [r.licenses for r in got] == ["LGPL-2.1-or-later", "AGPL-3.0-or-later", "GPL-2.0-or-later", "BSD-3-Clause", "AGPL-3.0-only", "EPL-2.0"]


def test_sentences_and_rules_of_the_caller(spark):
    docs = frame(spark, [(1, "Use is allowed for anyone.", None, None, 0), (2, "1 2 x", None, None, 0)])
    got = {r.doc_id: r.licenses for r in licenses.scan(docs, {"use is allowed for anyone": "x", "1 2 x": "y"}, [("Own", ["x"]), ("Two", ["y"])]).collect()}
    assert got == {1: "Own", 2: "Two"}


NAMED_BSD = BSD + """

3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE_TEXT = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""


def test_a_holder_may_have_any_name(spark):
    names = ["the copyright holder", "Foo Inc.", "the University of X, its Regents", "Foo"]
    got = scan(spark, *(NAMED_BSD.format(n) for n in names), NAMED_BSD.format("x " * 40))
    assert [r.licenses for r in got] == ["BSD-3-Clause"] * 4 + ["BSD-2-Clause"]


def test_whole_apache_text(spark):
    (r,) = scan(spark, APACHE_TEXT)
    assert (r.licenses, r.n_matches) == ("Apache-2.0", 1) and r.sequence.startswith("<apache2-title><apache2-terms>")


def test_expressions_of_tags(spark):
    tag = "// SPDX-License-Identifier: "
    said = ["MIT", "(MIT OR Apache-2.0)", "GPL-2.0+", "GPL-2.0-only WITH Classpath-exception-2.0", "MIT AND (ISC OR BSD-3-Clause)", "GPL-3.0", "MIT or words of no licence", "Nothing-1.0"]
    got = scan(spark, *(f"{tag}{x}\nint main() {{ this or that with care }}\n" for x in said))
    assert [set(r.licenses.split(",")) - {""} for r in got] == [{"MIT"}, {"MIT", "Apache-2.0"}, {"GPL-2.0-or-later"}, {"GPL-2.0-only"}, {"MIT", "ISC", "BSD-3-Clause"}, {"GPL-3.0-only"}, {"MIT"}, set()]


def test_the_plan_has_no_python(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions"))
