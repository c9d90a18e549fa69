"""Licence scan by sentence rules.

A text is normalised: letters are lower-cased and everything but a-z, 0-9 and the full stops inside numbers is a gap
between words, so line breaks, comment marks, wrapping and case don't matter. Sentences known from licence texts, which
are normalised the same way, are found between gaps in one pass of one pattern, longer ones first, and stand for their
identifiers. Where a sentence names a holder, any few words may stand. Short statements ("licensed under the ...",
"SPDX-License-Identifier: ...") are built from beginnings and from the names of licences with their versions, and may
list several names. A sentence that begins with a denial ("not licensed under ...") stands for nothing.

The identifiers of a document, in order, are matched against ordered licence rules: a rule that finds its run of
identifiers names a licence and takes these identifiers away, so a general rule never claims what a special one has. A
rule may also refuse: where a clause is opened whose wording isn't known, no licence is named. Identifiers that no rule
takes, and refused runs, are reported as unknown notices.

All of it is expressions on one row: no shuffle, no Python. Texts without a word that licence sentences share are
answered at once. A null or empty text has no identifiers and no licences; a very long one is scanned whole; repeated
sentences count each time and repeated rows are alike; an empty table stays empty. Extra columns are kept; those named
sentence_ids, licences or unknown_notices are replaced. Full texts of the long licences are recognised by the notices
in them only.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vademecum.llm.shared import free_prefix

#: Sentences of licence notices and texts, by identifier. <a|b> is either word, <*n> is one to n words.
SENTENCES = {
    "mit.grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit.keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit.as.is": ["The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."],
    "mit.liable": [
        "In no event shall <*8> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "x11.name": ["Except as contained in this notice, the <name|names> of <*12> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization"],
    "isc.grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0bsd.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc.as.is": ["The software is provided \"as is\" and <*8> <disclaims|disclaim> all warranties with regard to this software including all implied warranties of merchantability and fitness."],
    "isc.liable": [
        "In no event shall <*8> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ],
    "apache2.grant": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache2.comply": ["you may not use this file except in compliance with the License."],
    "apache2.copy": [
        "You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ],
    "apache2.as.is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache2.see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gnu.hope": ["distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsd.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd.advert": ["All advertising materials mentioning features or use of this software must display the following <acknowledgement|acknowledgment>"],
    "bsd.endorse": [
        "Neither the <name|names> of <*24> may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The <name|names> of <*12> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd.third": ["Neither the name", "Neither the names"],
    "bsd.as.is": ["This software is provided by <*16> \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."],
    "bsd.liable": [
        "In no event shall <*16> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ],
    "zlib.grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost.grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "mpl2.short": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2.copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc0.waive": ["To the extent possible under law, <*10> <has|have> waived all copyright and related or neighboring rights to"],
    "public.domain": ["This work is in the public domain.", "Released into the public domain."],
    "unlicense.text": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}
#: The licences of the GNU notices: identifier, name and version in the notice, and licence.
GNU = [
    ("gpl2", "General", "2", "GPL-2.0"), ("gpl3", "General", "3", "GPL-3.0"), ("agpl3", "Affero General", "3", "AGPL-3.0"),
    ("lgpl2", "Library General", "2", "LGPL-2.0"), ("lgpl21", "Lesser General", "2.1", "LGPL-2.1"), ("lgpl3", "Lesser General", "3", "LGPL-3.0"),
]
GNU_FREE = "free software; you can redistribute it and/or modify it under the terms of the GNU <name> Public License as published by the Free Software Foundation, either version <version> of the License, or (at your option) any later version."
GNU_ONLY = [
    "free software; you can redistribute it and/or modify it under the terms of the GNU <name> Public License as published by the Free Software Foundation, version <version> of the License",
    "free software; you can redistribute it and/or modify it under the terms of the GNU <name> Public License version <version> as published by the Free Software Foundation",
    "it under the terms of the GNU <name> Public License version <version> as published by the Free Software Foundation.",
]
GNU_SEE = "See the GNU <name> Public License for more details."
GNU_COPY = "You should have received a copy of the GNU <name> Public License along with"
GFDL = "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version <version> or any later version published by the Free Software Foundation"
for _id, _name, _version, _ in GNU:
    SENTENCES[f"{_id}.free"] = [GNU_FREE.replace("<name>", _name).replace("<version>", _version)]
    SENTENCES[f"{_id}.only"] = [t.replace("<name>", _name).replace("<version>", _version) for t in GNU_ONLY]
for _name in dict.fromkeys(n for _, n, _, _ in GNU):
    _id = "gnu." + _name.split()[0].lower()
    SENTENCES[f"{_id}.see"], SENTENCES[f"{_id}.copy"] = [GNU_SEE.replace("<name>", _name)], [GNU_COPY.replace("<name>", _name)]
for _version in ("1.1", "1.2", "1.3"):
    SENTENCES[f"gfdl{_version}.free"] = [GFDL.replace("<version>", _version)]

#: Licences by the short form of their name in statements and SPDX lines. What else a name may hold is
#: taken out by SHORTER first.
NAMED = {
    "mit": "MIT", "expat": "MIT", "x11": "X11", "isc": "ISC", "zlib": "Zlib", "wtfpl": "WTFPL", "unlicense": "Unlicense", "apache2": "Apache-2.0",
    "0bsd": "0BSD", "bsd0clause": "0BSD", "bsdzeroclause": "0BSD", "zeroclausebsd": "0BSD",
    "bsd4clause": "BSD-4-Clause", "4clausebsd": "BSD-4-Clause", "fourclausebsd": "BSD-4-Clause", "originalbsd": "BSD-4-Clause",
    "bsd3clause": "BSD-3-Clause", "3clausebsd": "BSD-3-Clause", "threeclausebsd": "BSD-3-Clause", "newbsd": "BSD-3-Clause", "modifiedbsd": "BSD-3-Clause", "revisedbsd": "BSD-3-Clause",
    "bsd2clause": "BSD-2-Clause", "2clausebsd": "BSD-2-Clause", "twoclausebsd": "BSD-2-Clause", "simplifiedbsd": "BSD-2-Clause", "freebsd": "BSD-2-Clause",
    "cc0": "CC0-1.0", "cc01": "CC0-1.0", "cczero": "CC0-1.0", "cczero1": "CC0-1.0",
    "bsl1": "BSL-1.0", "bsl1.1": "BUSL-1.1",
}
#: Families by short form, with their versions, and whether "or later" is said of them.
FAMILIES = [
    ("AGPL", ["3.0", "1.0"], True), ("LGPL", ["3.0", "2.1", "2.0"], True), ("GPL", ["3.0", "2.0", "1.0"], True), ("GFDL", ["1.3", "1.2", "1.1"], True), ("MPL", ["2.0", "1.1"], False), ("EPL", ["2.0", "1.0"], False),
    ("EUPL", ["1.2", "1.1"], False), ("CDDL", ["1.1", "1.0"], False), ("Artistic", ["2.0"], False), ("OFL", ["1.1"], False),
    *((f"CC-{c}", ["4.0", "3.0", "2.5", "2.0", "1.0"], False) for c in ("BY-NC-SA", "BY-NC-ND", "BY-NC", "BY-SA", "BY-ND", "BY")),
]
for _short, _versions, _later in FAMILIES:
    for _version in _versions:
        _form = _short.lower().replace("-", "") + _version.removesuffix(".0")
        NAMED |= {_form: f"{_short}-{_version}-only", _form + "+": f"{_short}-{_version}-or-later"} if _later else {_form: f"{_short}-{_version}"}
#: From a name without blanks to its short form, in order.
SHORTER = [
    ("licen[sc]e|version|gnu|software|^sil", ""), ("oranylater|oratyouroptionanylater|orlater|ornewer|plus", "+"), ("only", ""),
    ("generalpublic", "gpl"), ("affero(?:gpl)", "agpl"), ("(?:lesser|library)gpl", "lgpl"), ("freedocumentation", "fdl"), ("mozillapublic", "mpl"), ("eclipsepublic", "epl"),
    ("europeanunionpublic", "eupl"), ("commondevelopmentanddistribution", "cddl"), ("openfont", "ofl"), ("boost", "bsl"), ("businesssource|busl", "bsl"), ("^asl", "apache"),
    ("creativecommons", "cc"), ("attribution", "by"), ("noncommercial", "nc"), ("sharealike", "sa"), ("noderivatives|noderivs", "nd"), ("international|unported|generic|universal", ""), ("([0-9])public", "$1"),
    ("cccc", "cc"), ("agplagpl", "agpl"), ("lgpllgpl", "lgpl"), ("gplgpl", "gpl"), ("fdlg?fdl", "fdl"), ("^g?fdl", "gfdl"), ("mplmpl", "mpl"), ("eplepl", "epl"), ("eupleupl", "eupl"), ("cddlcddl", "cddl"), ("oflofl", "ofl"), ("bslbsl", "bsl"),
    ("([a-z])v([0-9])", "$1$2"), ("([0-9])[.]0", "$1"),
]
_LATER = "(?:  (?:or  later|plus|or  any  later  version|or  at  your  option  any  later  version|or  newer|only))?"
_NUMBER = "(?:(?:  (?:version|v))?  v?|v?)[0-9](?:[.][0-9])?"
_VERSIONED = [
    "(?:gnu  )?(?:(?:affero  |lesser  |library  )?general  public  licen[sc]e(?:  [al]?gpl)?|[al]?gpl|free  documentation  license(?:  g?fdl)?|g?fdl)", "mozilla  public  license(?:  mpl)?|mpl",
    "eclipse  public  license(?:  epl)?|epl", "european  union  public  licen[sc]e(?:  eupl)?|eupl", "boost  software  license(?:  bsl)?|business  source  license(?:  bu?sl)?|bu?sl",
    "common  development  and  distribution  license(?:  cddl)?|cddl", "artistic(?:  license)?", "(?:sil  )?open  font  license(?:  ofl)?|ofl", "asl|apache(?:  software)?(?:  license)?",
]
_CC = "(?:cc|creative  commons)  (?:by|attribution)(?:  (?:nc|noncommercial|non  commercial))?(?:  (?:sa|sharealike|share  alike|nd|noderivatives|noderivs|no  derivatives))?"
#: A name of a licence, normalised; those with versions first.
_NAME = (
    f"(?:(?:{'|'.join(_VERSIONED)}){_NUMBER}(?:{_LATER}|(?:  license)?)|{_CC}{_NUMBER}(?:  (?:international|unported|generic))?(?:  public)?(?:  license)?"
    "|(?:cc0|creative  commons  (?:zero|cc0))(?:  v?1[.]0)?(?:  universal)?(?:  license)?|(?:mit|expat|x11|isc|zlib)(?:  licen[sc]e)?|wtfpl|unlicense|0bsd"
    "|bsd  (?:[0234]|zero)  clause(?:  license)?|(?:[234]|zero|two|three|four)  clause  bsd(?:  license)?|(?:new|modified|revised|simplified|original)  bsd(?:  license)?|freebsd(?:  license)?)"
)


#: Ordered rules; a run of identifiers and the licence it means, None for a refusal. In brackets: may be
#: missing. Short statements come between the first rules and the last.
RULES = [
    ("mit.grant mit.keep [mit.as.is] [mit.liable] x11.name", "X11"),
    ("mit.grant mit.keep [mit.as.is] [mit.liable]", "MIT"),
    ("isc.grant [isc.as.is] [isc.liable]", "ISC"),
    ("0bsd.grant [isc.as.is] [isc.liable]", "0BSD"),
    ("apache2.grant [apache2.comply] [apache2.copy] [apache2.as.is] [apache2.see]", "Apache-2.0"),
    ("[reserved] bsd.grant bsd.source bsd.binary bsd.advert [bsd.endorse] [bsd.as.is] [bsd.liable]", "BSD-4-Clause"),
    ("[reserved] bsd.grant bsd.source bsd.binary bsd.endorse [bsd.as.is] [bsd.liable]", "BSD-3-Clause"),
    ("[reserved] bsd.grant bsd.source bsd.binary bsd.third [bsd.as.is] [bsd.liable]", None),
    ("[reserved] bsd.grant bsd.source bsd.binary [bsd.as.is] [bsd.liable]", "BSD-2-Clause"),
    *((f"{i}.{kind} [gnu.hope] [gnu.{n.split()[0].lower()}.see] [gnu.{n.split()[0].lower()}.copy]", licence + end) for i, n, _, licence in GNU for kind, end in (("free", "-or-later"), ("only", "-only"))),
    *((f"gfdl{v}.free", f"GFDL-{v}-or-later") for v in ("1.3", "1.2", "1.1")),
    ("mpl2.short [mpl2.copy]", "MPL-2.0"),
    ("zlib.grant", "Zlib"),
    ("boost.grant", "BSL-1.0"),
]
LAST_RULES = [("cc0.waive", "CC0-1.0"), ("unlicense.text", "Unlicense"), ("public.domain", "Public-Domain"), ("reserved", "All-Rights-Reserved")]
#: What a short statement begins with, what stands between two names in it, and what denies any sentence.
BEGINS = (
    "(?:(?:licensed|licenced|sublicensed|relicensed|released|distributed|available|published|provided|offered|covered)  (?:under|by)|subject  to|spdx  license  identifier)"
    "(?:  (?:both|either))?(?:  the)?(?:  terms(?:  and  conditions)?  of)?(?:  (?:the|an|a))?"
)
BETWEEN = "(?:or|and  or|and)(?:  under)?(?:  the)?(?:  terms  of)?(?:  the)?"
DENIED = "(?:not|never|longer|t|nor)  (?:be  |been  )?"
#: A text holds a known sentence only if it holds one of these words, or a name soon after "under".
HINTS = ["licen", "copyright", "permission", "redistribut", "warrant", "unencumbered", "advertising", "liable", "domain", "mozilla", "neither", "reserved", "endorse", "disclaim"]
#: Normalising, in order: pattern and what stands for it. Words end up with two blanks between them, so that
#: neighbouring sentences don't share the blank that parts them.
STEPS = [("([0-9])[+]", "$1 plus "), ("[^a-z0-9.]+", " "), ("([a-z])\\.+", "$1 "), ("\\.+( |$)", " "), ("(^| )\\.+", " "), (" +", "  ")]


def plain(text: str) -> str:
    """A normalised text, as ``normalised`` makes it."""
    text = text.lower()
    for pattern, to in STEPS:
        text = re.sub(pattern, to.replace("$1", "\\1"), text)
    return text.strip(" ")


def _words(sentence: str) -> list[list[str]]:
    """The words of a sentence, for every choice of its <a|b>; <*n> stays a word."""
    parts = re.split(r"<([^>]*)>", sentence)
    choices = [[f"<{p}>"] if i % 2 and p.startswith("*") else p.split("|") if i % 2 else [p] for i, p in enumerate(parts)]
    return [[w for part in chosen for w in ([part] if part.startswith("<*") else plain(part).split())] for chosen in itertools.product(*choices)]


def _pattern(sentences: list[list[str]]) -> str:
    """One pattern of all sentences, by common beginnings; of sentences that go on alike the longer one is found."""
    tree: dict = {}
    for words in sentences:
        at = tree
        for word in words:
            at = at.setdefault(word, {})
        at[""] = {}

    def below(at: dict) -> str:
        ways = []
        for word in sorted((w for w in at if w), key=lambda w: (w.startswith("<"), w)):
            own = f"[a-z0-9.]+(?:  [a-z0-9.]+){{0,{int(word[2:-1]) - 1}}}?" if word.startswith("<") else word.replace(".", "[.]")
            rest = below(at[word])
            ways.append(own + (f"(?:  {rest})?" if rest and "" in at[word] else f"  {rest}" if rest else ""))
        return "" if not ways else ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return below(tree)


ALL_WORDS = [(words, name) for name, texts in SENTENCES.items() for t in texts for words in _words(t)]
#: Identifier of whole sentences; and of those with holders by their first and last words.
WHOLE = {"  ".join(words): name for words, name in ALL_WORDS if not any(w.startswith("<") for w in words)}
HOLDING = sorted({("  ".join(words[: _at]) + "  ", "  " + "  ".join(words[_at + 1 :]), name) for words, name in ALL_WORDS for _at in [next((i for i, w in enumerate(words) if w.startswith("<")), -1)] if _at >= 0})
FOUND = f" ((?:{DENIED})?(?:{_pattern([w for w, _ in ALL_WORDS])}|{BEGINS}  {_NAME}(?:  {BETWEEN}  {_NAME})*|spdx  license  identifier)) "
WHOLE["spdx  license  identifier"] = "spdx.other"  # before a name that isn't known
SHORT = "short."
ORDER = list(dict.fromkeys(NAMED.values()))
UNDER = "under[^a-z0-9]+(?:[a-z]+[^a-z0-9]+){0,4}(?:gnu|[al]?gpl|g?fdl|mpl|epl|eupl|bu?sl|cddl|artistic|sil|ofl|asl|apache|cc|creative|cc0|mit|expat|x11|isc|zlib|wtfpl|0bsd|bsd|freebsd|[0-9]|new|modified|revised|simplified|original|two|three|four|zero)"


def _runs(rule: str) -> list[str]:
    """The marked runs that a rule allows, longest first."""
    runs = [""]
    for part in rule.split():
        name = f"<{part.strip('[]')}>"
        runs = [r + name for r in runs] + (runs if part.startswith("[") else [])
    return sorted(set(runs), key=lambda r: (-r.count("<"), r))


#: (marked run, licence; "" for a refusal) in the order of the rules.
ALLOWED, LAST = ([(run, licence or "") for rule, licence in rules for run in _runs(rule)] for rules in (RULES, LAST_RULES))


def normalised(text: Column) -> Column:
    """A blank, the words of the text with two blanks between them, and a blank."""
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.concat(F.lit(" "), F.trim(out), F.lit(" "))


def hinted(text: Column) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit("under")) & low.rlike(UNDER)
    for hint in reversed(HINTS):
        out = F.contains(low, F.lit(hint)) | out
    return out


def _table(rows: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rows])


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; short.X for a statement that names X."""
    names = lambda m: F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(m, f"^{BEGINS}  ", ""), F.lit(" ")), F.lit(f" ({_NAME}) "), F.lit(1))

    def short(name: Column) -> Column:
        name = F.replace(name, F.lit(" "), F.lit(""))
        for pattern, to in SHORTER:
            name = F.regexp_replace(name, pattern, to)
        return F.concat(F.lit(SHORT), F.try_element_at(_map(NAMED), name))

    def ids(m: Column) -> Column:
        out = F.filter(F.transform(names(m), short), lambda n: n.isNotNull())
        for first, last, name in reversed(HOLDING):
            out = F.when(m.startswith(first) & m.endswith(last), F.array(F.lit(name))).otherwise(out)
        known = F.try_element_at(_map(WHOLE), m)
        out = F.when(known.isNotNull(), F.array(known)).otherwise(out)
        return F.when(m.rlike(f"^{DENIED}"), F.array().cast("array<string>")).otherwise(out)

    return F.flatten(F.transform(F.regexp_extract_all(normalised(text), F.lit(FOUND), F.lit(1)), ids))


def _applied(state: Column, rules: list[tuple[str, str]]) -> Column:
    def apply(state: Column, rule: Column) -> Column:
        hit, refused = F.contains(state["rest"], rule["a"]), rule["b"] == ""
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["a"], F.when(refused, F.lit("|<?>")).otherwise(F.lit("|")))).otherwise(state["rest"]).alias("rest"),
            F.when(hit & ~refused, F.array_union(state["licences"], F.array(rule["b"]))).otherwise(state["licences"]).alias("licences"),
        )

    return F.aggregate(_table(rules), state, apply)


def matched(ids: Column) -> Column:
    """Struct of ``licences`` (in rule order, each once) and ``rest`` (marked identifiers that no rule took)."""
    marked = F.array_join(F.transform(F.filter(ids, lambda i: ~i.startswith(SHORT)), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    first = _applied(F.struct(marked.alias("rest"), F.array().cast("array<string>").alias("licences")), ALLOWED)
    said = F.filter(F.array(*map(F.lit, ORDER)), lambda x: F.array_contains(ids, F.concat(F.lit(SHORT), x)))
    middle = F.transform(F.array(first), lambda s: F.struct(s["rest"].alias("rest"), F.array_union(s["licences"], said).alias("licences")))[0]
    return _applied(middle, LAST)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds sentence_ids (array), licences (array) and unknown_notices (how many identifiers no rule took)."""
    empty = F.array().cast("array<string>")
    match = free_prefix(docs.columns) + "match"
    rows = docs.withColumn("sentence_ids", F.when(hinted(F.col(text)), sentence_ids(F.col(text))).otherwise(empty))
    rows = rows.withColumn(match, F.when(F.size("sentence_ids") > 0, matched(F.col("sentence_ids"))))
    rest = F.coalesce(F.col(match)["rest"], F.lit(""))
    rows = rows.withColumn("licences", F.coalesce(F.col(match)["licences"], empty))
    return rows.withColumn("unknown_notices", F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit("")))).drop(match)


def oracle() -> str:
    """The scan's columns for ``documents`` as DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda t: "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in t.items()) + "}"
    norm = "lower(text)"
    for pattern, to in STEPS:
        norm = f"regexp_replace({norm}, {quoted(pattern)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    short = "replace(n, ' ', '')"
    for pattern, to in SHORTER:
        short = f"regexp_replace({short}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    hint = " OR ".join([*(f"contains(lower(text), {quoted(h)})" for h in HINTS), f"regexp_matches(lower(text), {quoted(UNDER)})"])
    holding = " ".join(f"WHEN starts_with(m, {quoted(a)}) AND suffix(m, {quoted(b)}) THEN [{quoted(name)}]" for a, b, name in HOLDING)
    steps = [
        f"named AS (SELECT unnest(map_keys(t)) AS k, unnest(map_values(t)) AS v FROM (SELECT {table(NAMED)} AS t))",
        f"whole AS (SELECT unnest(map_keys(t)) AS k, unnest(map_values(t)) AS v FROM (SELECT {table(WHOLE)} AS t))",
        f"t AS (SELECT doc_id, CASE WHEN {hint} THEN ' ' || trim({norm}, ' ') || ' ' ELSE '' END AS t FROM documents)",
        f"f AS (SELECT doc_id, regexp_extract_all(t, {quoted(FOUND)}, 1) AS found FROM t)",
        "m AS (SELECT doc_id, unnest(found) AS m, unnest(range(len(found))) AS pos FROM f)",
        f"n AS (SELECT doc_id, m, pos, unnest(regexp_extract_all(' ' || regexp_replace(m, {quoted('^' + BEGINS + '  ')}, '') || ' ', {quoted(f' ({_NAME}) ')}, 1)) AS n, "
        f"unnest(range(len(regexp_extract_all(' ' || regexp_replace(m, {quoted('^' + BEGINS + '  ')}, '') || ' ', {quoted(f' ({_NAME}) ')}, 1)))) AS n_pos FROM m "
        f"WHERE NOT regexp_matches(m, {quoted('^' + DENIED)}) AND m NOT IN (SELECT k FROM whole) AND (CASE {holding} END) IS NULL)",
        f"i AS (SELECT doc_id, pos, n_pos, {quoted(SHORT)} || v AS id FROM n JOIN named ON k = {short}"
        f" UNION ALL SELECT doc_id, pos, 0, v FROM m JOIN whole ON k = m WHERE NOT regexp_matches(m, {quoted('^' + DENIED)})"
        f" UNION ALL SELECT doc_id, pos, 0, (CASE {holding} END)[1] FROM m WHERE NOT regexp_matches(m, {quoted('^' + DENIED)}) AND m NOT IN (SELECT k FROM whole) AND (CASE {holding} END) IS NOT NULL)",
        "s0 AS (SELECT doc_id, list(id ORDER BY pos, n_pos) AS ids FROM i GROUP BY doc_id)",
        f"r0 AS (SELECT doc_id, ids, coalesce(list_aggregate(list_transform(list_filter(ids, lambda i: NOT starts_with(i, {quoted(SHORT)})), lambda i: '<' || i || '>'), 'string_agg', ''), '') AS rest, ''::VARCHAR AS found FROM s0)",
    ]

    def rules(at: int, allowed: list[tuple[str, str]]) -> int:
        for run, name in allowed:
            mark, label = quoted(run), quoted(name)
            named = f"CASE WHEN contains(rest, {mark}) AND NOT list_contains(string_split(found, ' '), {label}) THEN trim(found || ' ' || {label}) ELSE found END" if name else "found"
            steps.append(f"r{at + 1} AS (SELECT doc_id, ids, replace(rest, {mark}, {quoted('|' if name else '|<?>')}) AS rest, {named} AS found FROM r{at})")
            at += 1
        return at

    at = rules(0, ALLOWED)
    order = "[" + ", ".join(map(quoted, ORDER)) + "]"
    said = f"list_aggregate(list_filter({order}, lambda x: list_contains(ids, {quoted(SHORT)} || x) AND NOT list_contains(string_split(found, ' '), x)), 'string_agg', ' ')"
    steps.append(f"r{at + 1} AS (SELECT doc_id, ids, rest, trim(found || ' ' || coalesce({said}, '')) AS found FROM r{at})")
    at = rules(at + 1, LAST)
    return (
        "WITH " + ", ".join(steps) + " SELECT d.doc_id, coalesce(list_aggregate(ids, 'string_agg', ' '), '') AS sentence_ids, coalesce(found, '') AS licences, "
        f"CAST(coalesce(length(rest) - length(replace(rest, '<', '')), 0) AS INT) AS unknown_notices FROM documents d LEFT JOIN r{at} r USING (doc_id)"
    )
