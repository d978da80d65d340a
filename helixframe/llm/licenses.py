"""Licence texts found by template markup compiled to token automata.

A template is wording with ``<<beginOptional>> ... <<endOptional>>`` regions and
``<<var;min=a;max=b;match=regex>>`` regions.  It becomes a nondeterministic
automaton over words; a place in a text is accepted when every mandatory word
stands there in order, optional regions are whole or absent, and each
replaceable region has as many fitting words as it allows.  Case of A-Z,
punctuation and white space do not count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.textkernels import ALPHANUMERIC, hash_of, word_blocks

# The base phrases and their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Wordings of licences and of notices that refer to them, with what may be left out or replaced.
_COPYRIGHT = "<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=16>> <<beginOptional>>all rights reserved<<endOptional>><<endOptional>>"
_BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """
This software is provided by <<var;min=1;max=12>> "as is" and any express or implied warranties, including, but not limited to, the implied
warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall <<var;min=1;max=12>> be liable for any
direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or
services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict
liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility
of such damage."""
TEMPLATES = {
    "0bsd": f"""{_COPYRIGHT} Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
The software is provided "as is" and <<var;min=1;max=6>> disclaims all warranties with regard to this software including all implied warranties
of merchantability and fitness. In no event shall <<var;min=1;max=6>> be liable for any special, direct, indirect, or consequential damages or any
damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising
out of or in connection with the use or performance of this software.""",
    "apache-2.0-appendix": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0-notice": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>",
    "bsd-2-clause": f"{_COPYRIGHT} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"""{_COPYRIGHT} {_BSD_CONDITIONS} <<beginOptional>>3<<endOptional>> Neither the name of <<var;min=1;max=12>> nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted <<beginOptional>>provided that the following conditions are met<<endOptional>>",
    "cc-notice": "licensed under <<beginOptional>>a<<endOptional>> <<var;min=1;max=2;match=cc|creative|commons>> by <<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> <<var;min=1;max=2;match=\\d+>>",
    "gpl-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>gnu<<endOptional>> general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;min=1;max=1;match=\\d+>>",
    "gpl-program-notice": """This <<var;min=1;max=4>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, <<beginOptional>>either<<endOptional>> version <<var;min=1;max=1;match=\\d+>> of the
License<<beginOptional>>, or (at your option) any later version<<endOptional>>. <<beginOptional>>This <<var;min=1;max=4>> is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details.<<endOptional>>""",
    "isc": f"""{_COPYRIGHT} Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and
<<var;min=1;max=6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event
shall <<var;min=1;max=6>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use,
data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of
this software.""",
    "mit-text": f"""{_COPYRIGHT} Permission is hereby granted, free of charge, to any person obtaining a
copy of this <<var;min=1;max=3>> and associated documentation <<beginOptional>>files<<endOptional>> (the "<<var;min=1;max=3>>"), to deal in the <<var;min=1;max=3>> without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
<<var;min=1;max=3>>, and to permit persons to whom the <<var;min=1;max=3>> is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the <<var;min=1;max=3>>.
The <<var;min=1;max=3>> is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement. In no event shall <<var;min=1;max=8>> be liable for any claim, damages or other liability, whether
in an action of contract, tort or otherwise, arising from, out of or in connection with the <<var;min=1;max=3>> or the use or other dealings in the
<<var;min=1;max=3>>.""",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this <<var;min=1;max=3>> <<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>the software<<endOptional>> to deal in the software without restriction",
    "mit-notice": "<<var;min=1;max=1;match=released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "spdx-identifier": "spdx license identifier <<var;min=1;max=4>>",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": f"""{_COPYRIGHT} This software is provided 'as-is', without any express or implied warranty. In no event will the author<<beginOptional>>s<<endOptional>> be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1<<endOptional>> The origin of this software must
not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution.""",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """States 0..n; ``words[s]``: (word or regex or None, next state); ``free[s]``: states reached without a word."""

    words: list[list[tuple[str, object, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0

    def state(self) -> int:
        self.words.append([])
        self.free.append([])
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def longest(self, word_at, most: int) -> int:
        """Words that the longest accepted run of ``word_at(0)``, ``word_at(1)``, ... has, of ``most`` there are; 0 if none is accepted."""
        states, n, best = self.closure({0}), 0, 0
        while states and n < most:
            word = word_at(n)
            states = self.closure({t for s in states for kind, x, t in self.words[s] if (kind == "word" and x == word) or (kind == "any" and (x is None or x.fullmatch(word)))})
            n += 1
            if self.final in states:
                best = n
        return best

    def first_words(self) -> list[str]:
        """Words that a run can begin with; a replaceable region may begin one only if it lists its words."""
        out = []
        for s in self.closure({0}):
            for kind, x, _ in self.words[s]:
                if kind == "word":
                    out.append(x)
                elif x is None or not re.fullmatch(r"[\w|]+", x.pattern):
                    raise ValueError("a template can't begin with a region that any word fits")
                else:
                    out += x.pattern.split("|")
        return sorted(set(out))


def compile_template(markup: str) -> Automaton:
    a = Automaton()
    at, opened = 0, []
    for piece in re.split(r"(<<[^>]*>>)", markup):
        if piece == "<<beginOptional>>":
            opened.append(at)
        elif piece == "<<endOptional>>":
            end = a.state()
            a.free[at].append(end)
            a.free[opened.pop()].append(end)
            at = end
        elif piece.startswith("<<var"):
            options = dict(x.split("=", 1) for x in piece[2:-2].split(";")[1:])
            low, high = int(options.get("min", 0)), int(options.get("max", 1))
            fits = re.compile(options["match"]) if "match" in options else None
            end = a.state()
            for k in range(high):
                if k >= low:
                    a.free[at].append(end)
                nxt = a.state()
                a.words[at].append(("any", fits, nxt))
                at = nxt
            a.free[at].append(end)
            at = end
        else:
            for word in _WORD.findall(piece.lower()):
                nxt = a.state()
                a.words[at].append(("word", word, nxt))
                at = nxt
    if opened:
        raise ValueError("an optional region has no end")
    a.final = at
    return a


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document with the licences that its whole text states.

    ``n_base``, ``first_word`` and ``last_word`` count places of the base
    phrases; ``labels`` also holds the accepted templates.  ``score`` is 1 for an
    accepted template, else 0.5 for a base phrase, else 0.  Null and empty text
    have no words and score 0; repeated rows give a row each; a null doc_id is
    kept; other columns are ignored; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    automata = [(name, True, compile_template(x)) for name, x in BASE.items()] + [(name, False, compile_template(x)) for name, x in templates.items()]
    starts: dict[int, list[int]] = {}
    for i, (_, _, a) in enumerate(automata):
        for word in a.first_words():
            starts.setdefault(int(hash_of(word)), []).append(i)
    anchors = np.array(sorted(starts), np.uint64)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words_of, hits = np.zeros(n, np.int64), [None] * n
            for a, b, data, words in word_blocks(batch.column(1), ALPHANUMERIC):
                words_of[a:b] = np.diff(words.first)
                found = np.flatnonzero(np.isin(words.hash, anchors))
                raw = data.tobytes() if len(found) else b""
                for i in found.tolist():
                    doc = int(words.doc[i])
                    first, end = int(words.first[doc]), int(words.first[doc + 1])
                    word_at = lambda n, i=i, words=words, raw=raw: raw[words.start[i + n] : words.end[i + n]].decode().translate(_LOWER)
                    for k in starts[int(words.hash[i])]:
                        name, base, automaton = automata[k]
                        if automaton.longest(word_at, end - i):
                            row = hits[a + doc] = hits[a + doc] or ([], set(), set())
                            row[2].add(name)
                            if base:
                                row[0].append(i - first)
                                row[1].add(name)
            rows = [([], set(), set()) if h is None else h for h in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words_of),
                    pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array([min(r[0], default=None) for r in rows], pa.int64()),
                    pa.array([max(r[0], default=None) for r in rows], pa.int64()),
                    pa.array([",".join(sorted(r[1])) for r in rows], pa.string()),
                    pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                    pa.array([1.0 if r[2] - r[1] else 0.5 if r[1] else 0.0 for r in rows], pa.float64()),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


_LOWER = {c: c + 32 for c in range(65, 91)}
