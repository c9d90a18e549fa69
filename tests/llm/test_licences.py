"""The licence scan against notices as their licences publish them, with labels that don't come from the code."""

import textwrap

import duckdb
import pytest

from tests.compare import assert_same
from vademecum.llm import licences

MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """Copyright (c) 2020 A. Author

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
APACHE = """Copyright 2020 A. Author

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
BSD_HEAD = """Copyright (c) 2020, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def gnu(subject, name, version, free, comma, end):
    return f"""This {subject} is free software{free} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.

This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {subject}{end}
"""


NOTICES = [
    (MIT, "MIT"), (ISC, "ISC"), (APACHE, "Apache-2.0"), (BSD_HEAD + BSD_TAIL, "BSD-2-Clause"), (BSD_HEAD + BSD_THIRD + BSD_TAIL, "BSD-3-Clause"), (MPL, "MPL-2.0"),
    (gnu("program", "General Public License", "3", ":", ",", ". If not, see <https://www.gnu.org/licenses/>."), "GPL-3.0-or-later"),
    (gnu("program", "General Public License", "2", ";", ";", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."), "GPL-2.0-or-later"),
    (gnu("program", "Affero General Public License", "3", ":", ",", ". If not, see <https://www.gnu.org/licenses/>."), "AGPL-3.0-or-later"),
    (gnu("library", "Lesser General Public License", "2.1", ";", ";", "; if not, write to the Free Software Foundation"), "LGPL-2.1-or-later"),
    (gnu("library", "Lesser General Public License", "3", ":", ",", ". If not, see <http://www.gnu.org/licenses/>."), "LGPL-3.0-or-later"),
]


def wrapped(text, width, mark=""):
    paragraphs = [textwrap.wrap(p, width) for p in text.split("\n")]
    return "\n".join(mark + line for p in paragraphs for line in p or [""])


def test_full_notices_however_wrapped(spark):
    rows = []
    for text, name in NOTICES:
        forms = [text, text.upper(), text.lower(), "Some prose before. " + text + " and prose after it", text.replace("\n", "\r\n"), text.replace(" ", "  ")]
        forms += [wrapped(text, width) for width in (30, 41, 63, 72, 80)] + [wrapped(text, 70, mark) for mark in ("# ", " * ", "// ", "\t")]
        rows += [(name, f) for f in forms]
    got = licences.scan(spark.createDataFrame(rows, "name string, text string").repartition(4)).collect()
    assert [(r["name"], r.licences, r.unknown_notices, r.text[:80]) for r in got if r.licences != [r["name"]] or r.unknown_notices] == []


def test_several_notices_and_near_misses(spark):
    cases = [
        (APACHE + "\n" + MIT, ["MIT", "Apache-2.0"], 0),
        (MIT + MIT, ["MIT"], 0),
        ("text\nReleased under the MIT License.\nAll rights reserved.", ["MIT", "All-Rights-Reserved"], 0),
        ("Licensed under the GPLv2, licensed under the GPLv3.", ["GPL-3.0-only", "GPL-2.0-only"], 0),
        ("See the GNU General Public License for more details.", [], 1),
        ("Permission is granted to nobody. No warranty, and no licence, of the software.", [], 0),
        ("Unreleased under the MIT Licenses", [], 0),
        ("Licensed under the GNU General Public License version 2.1 of another kind", [], 0),
        ("x" * 200_000 + "\n" + MPL, ["MPL-2.0"], 0),
        (None, [], 0),
        ("", [], 0),
    ]
    rows = [(i, text, names, n) for i, (text, names, n) in enumerate(cases)] * 2
    got = licences.scan(spark.createDataFrame(rows, "id int, text string, names array<string>, n int")).collect()
    assert len(got) == 2 * len(cases)
    assert [(r.id, r.licences, r.unknown_notices) for r in got if r.licences != r.names or r.unknown_notices != r.n] == []


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, _match string, licences int, a string, b string, sentence_ids string"
    assert licences.scan(spark.createDataFrame([], schema)).count() == 0
    row = licences.scan(spark.createDataFrame([(1, MPL, "kept", 5, "a", "b", "replaced")], schema)).first()
    assert row["_match"] == "kept" and row.a == "a" and row.licences == ["MPL-2.0"] and row.sentence_ids == ["mpl2.short", "mpl2.copy"]


@pytest.mark.parametrize("text", ["v. 2.0 of v.2.0", "a.b", "...", "1.5.2. x", "www.x.org/2.0.", "Été no. 5"])
def test_table_and_texts_are_normalised_alike(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(licences.normalised("t")).first()[0] == f" {licences.plain(text)} "


BSD_HOLDERS = [
    "Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of The Regents of the University of California nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the names of the copyright holders nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "The names of the contributors may not be used to endorse or promote products derived from this software without specific prior written permission.",
]
TAIL_REGENTS = BSD_TAIL.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS")
ADVERT = "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software developed by the University.\n"
X11 = MIT + "\nExcept as contained in this notice, the name of A. Author shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from A. Author.\n"
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software'

#: Notices as they are met, with the licences that a reader finds in them, and how many notices stay unknown.
BY_HAND = [
    *((BSD_HEAD + "3. " + clause + TAIL_REGENTS, ["BSD-3-Clause"], 0) for clause in BSD_HOLDERS),
    *((BSD_HEAD + "3. " + clause + BSD_TAIL, ["BSD-3-Clause"], 0) for clause in BSD_HOLDERS[:2]),
    (BSD_HEAD + TAIL_REGENTS, ["BSD-2-Clause"], 0),
    (BSD_HEAD + ADVERT + "4. " + BSD_HOLDERS[1] + TAIL_REGENTS, ["BSD-4-Clause"], 0),
    (BSD_HEAD + "3. Neither the name of Foo may be mentioned at all." + BSD_TAIL, [], 1),
    (X11, ["X11"], 0),
    (MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS BE", "A. AUTHOR BE"), ["MIT"], 0),
    (ZLIB, ["Zlib"], 0),
    (BOOST, ["BSL-1.0"], 0),
    (ISC.replace("THE AUTHOR", "FOO CORP."), ["ISC"], 0),
    ("SPDX-License-Identifier: MIT", ["MIT"], 0),
    ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"], 0),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"], 0),
    ("/* SPDX-License-Identifier: GPL-2.0 */", ["GPL-2.0-only"], 0),
    ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"], 0),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"], 0),
    ("SPDX-License-Identifier: LGPL-2.1-only AND BSD-3-Clause", ["BSD-3-Clause", "LGPL-2.1-only"], 0),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA-4.0"], 0),
    ("SPDX-License-Identifier: CC0-1.0", ["CC0-1.0"], 0),
    ("SPDX-License-Identifier: MPL-2.0", ["MPL-2.0"], 0),
    ("SPDX-License-Identifier: LicenseRef-Own", [], 1),
    ("Licensed under the GNU General Public License version 3.0.", ["GPL-3.0-only"], 0),
    ("Licensed under the GPL v3", ["GPL-3.0-only"], 0),
    ("released under the GPLv2+.", ["GPL-2.0-or-later"], 0),
    ("Licensed under the GNU GPL, version 2 or later.", ["GPL-2.0-or-later"], 0),
    ("available under the terms of the GNU Lesser General Public License, version 2.1", ["LGPL-2.1-only"], 0),
    ("distributed under the terms of the GNU Lesser General Public License (LGPL) version 3 or any later version", ["LGPL-3.0-or-later"], 0),
    ("Released under the AGPLv3.", ["AGPL-3.0-only"], 0),
    ("This file is licensed under the terms of the MIT license.", ["MIT"], 0),
    ("Licensed under MIT", ["MIT"], 0),
    ("Released under the MIT licence", ["MIT"], 0),
    ("Licensed under the Apache License 2.0", ["Apache-2.0"], 0),
    ("is licensed under the Apache 2.0 license", ["Apache-2.0"], 0),
    ("Licensed under the Apache Software License, version 2.0", ["Apache-2.0"], 0),
    ("Dual licensed under the MIT license or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"], 0),
    ("licensed under both the MIT License and the Apache License 2.0", ["MIT", "Apache-2.0"], 0),
    ("Licensed under the 3-Clause BSD License", ["BSD-3-Clause"], 0),
    ("licensed under the New BSD license", ["BSD-3-Clause"], 0),
    ("Released under the BSD-2-Clause license", ["BSD-2-Clause"], 0),
    ("licensed under the Simplified BSD License.", ["BSD-2-Clause"], 0),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License", ["CC-BY-4.0"], 0),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"], 0),
    ("Text is available under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License", ["CC-BY-NC-ND-4.0"], 0),
    ("licensed under CC-BY-NC-SA 2.5", ["CC-BY-NC-SA-2.5"], 0),
    ("Licensed under the Mozilla Public License, Version 1.1", ["MPL-1.1"], 0),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", ["EPL-1.0"], 0),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"], 0),
    ("licensed under the Business Source License 1.1", ["BUSL-1.1"], 0),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation", ["GFDL-1.2-or-later"], 0),
    ("licensed under the SIL Open Font License, Version 1.1", ["OFL-1.1"], 0),
    ("Licensed under the EUPL v1.2", ["EUPL-1.2"], 0),
    ("Foo Bar is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", ["GPL-2.0-only"], 0),
    ("foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"], 0),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"], 0),
    ("To the extent possible under law, Jane Q. Author has waived all copyright and related or neighboring rights to this work.", ["CC0-1.0"], 0),
    ("This is not licensed under the MIT License.", [], 0),
    ("This file isn't released under the GPLv3.", [], 0),
    ("It is no longer distributed under the Apache License 2.0", [], 0),
    ("must not be distributed under the MIT license", [], 0),
    ("The committee sat under the tree by the zlib pond and was covered by the snow.", [], 0),
    ("Licensed under the Foo License 7", [], 0),
    ("He was subject to the terms of the contract", [], 0),
    ("There is neither the time nor the name", [], 0),
]


def test_notices_as_they_are_met(spark):
    assert len(BY_HAND) >= 60
    rows = [(i, text, names, n) for i, (text, names, n) in enumerate(BY_HAND)]
    got = licences.scan(spark.createDataFrame(rows, "id int, text string, names array<string>, n int")).collect()
    assert [(r.id, r.text[:90], r.licences, r.unknown_notices) for r in got if r.licences != r.names or r.unknown_notices != r.n] == []


def test_every_known_sentence_is_hinted(spark):
    rows = spark.createDataFrame([(s,) for s in licences.WHOLE], "t string")
    assert [r.t for r in rows.where(~licences.hinted(rows["t"])).collect()] == []


def test_sql_says_the_same_of_all_notices(spark, tmp_path):
    texts = [(i, t) for i, t in enumerate([t for t, *_ in BY_HAND] + [t for t, _ in NOTICES] + [wrapped(t, 41, "# ") for t, _ in NOTICES] + ["", None])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    con = duckdb.connect()
    docs.write.parquet(str(tmp_path / "documents"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rows = licences.scan(docs)
    rows = rows.select("doc_id", licences.F.array_join("sentence_ids", " ").alias("sentence_ids"), licences.F.array_join("licences", " ").alias("licences"), "unknown_notices")
    assert_same(rows, con, licences.oracle())
