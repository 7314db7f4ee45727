"""License scans with a generalised suffix automaton of license tokens.

The automaton holds every run of words of all templates. A file's words are streamed through it;
after each word the state gives the longest run ending there that some template contains
(matching statistics), and its suffix links give the shorter runs that further templates contain.
Long matches whose places in one template follow each other are chained into spans, and a span's
covered share of the template decides about its label.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .arrow import add_columns
from .textbuf import NOT_ALNUM, Texts, span_hash, words

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence texts, whole or by their sections, and the notices by which they are applied.
TEMPLATES = {
    "mit": (
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
        to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
        to whom the software is furnished to do so subject to the following conditions""",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
        "licensed under the mit license",
        "this software is released under the mit license",
    ),
    "apache": (
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www
        apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
        """unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any
        kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
        """grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty
        free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in
        source or object form""",
        """this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use
        in describing the origin of the work and reproducing the content of the notice file""",
        """unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis without warranties or
        conditions of any kind either express or implied including without limitation any warranties or conditions of title non infringement merchantability or fitness for a
        particular purpose""",
        "licensed under the apache license version 2 0",
    ),
    "gpl": (
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either
        version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public
        license along with this program if not see""",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either
        version 2 of the license or at your option any later version""",
        """the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is
        intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users""",
        "this work is licensed under the gnu general public license version 3",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc 4 0",
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        "licensed under cc by sa 4 0",
    ),
    "bsd": (
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code
        must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the
        copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential
        damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
        liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility
        of such damage""",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "isc": (
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
        use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    ),
    "zlib": (
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
        acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as
        being the original software 3 this notice may not be removed or altered from any source distribution""",
    ),
    "unlicense": (
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source
        code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    ),
}


class Automaton:
    """Suffix automaton of several word sequences; each state knows one end in each template that has it."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [defaultdict(list)]
        for number, tokens in enumerate(templates):
            last = 0
            for place, x in enumerate(tokens):
                last = self._extend(last, x)
                self.ends[last][number].append(place + 1)
        # ends flow from longer to shorter contexts
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                for number, places in self.ends[s].items():
                    self.ends[self.link[s]][number] += places

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(dict(moves))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(defaultdict(list))
        return len(self.next) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q])
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:  # an earlier template has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, x, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """After each token: (length of the longest match that ends there, its state)."""
        out, s, n = [], 0, 0
        for x in tokens:
            while s and x not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            s = self.next[s].get(x, 0)
            n = n + 1 if s else 0
            out.append((n, s))
        return out


@dataclass(frozen=True)
class Scan:
    """least: words of a match that starts or continues a chain; gap: words a chain may skip; cover: share of a template that labels."""

    least: int = 4
    gap: int = 12
    cover: float = 0.8


class Scanner:
    def __init__(self, scan: Scan) -> None:
        self.scan = scan
        self.names, texts = [], []
        for label, several in TEMPLATES.items():
            for x in several:
                self.names.append(label)
                texts.append(x.split())
        every = sorted({x for t in texts for x in t} | {x for p in PHRASES for x in p.split()})
        self.number = {x: i for i, x in enumerate(every)}
        self.texts = [[self.number[x] for x in t] for t in texts]
        data = np.frombuffer("".join(every).encode(), np.uint8)
        stop = np.cumsum([len(x.encode()) for x in every])
        h = span_hash(data, np.concatenate([[0], stop[:-1]]), stop)
        order = np.argsort(h)
        self.hash, self.of = h[order], order
        self.names_of = every
        self.automaton = Automaton(self.texts)
        self.size = len(every) + 1  # codes of ``least`` words stay below 2**63 for a vocabulary of some thousands
        least = scan.least
        self.grams = np.unique([sum(x * self.size ** (least - 1 - k) for k, x in enumerate(t[i : i + least])) for t in self.texts for i in range(len(t) - least + 1)])
        self.phrases = [(np.array([self.number[x] for x in p.split()]), label) for p, label in PHRASES.items()]

    def numbers(self, t: Texts, w) -> np.ndarray:
        """Vocabulary number of each word, -1 for the rest; a hash that matches is compared byte by byte."""
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        number = np.where(self.hash[at] == w.hash, self.of[at], -1)
        for i in np.flatnonzero(number >= 0).tolist():
            if t.data[w.start[i] : w.stop[i]].tobytes().decode("utf-8").lower() != self.names_of[number[i]]:
                number[i] = -1
        return number

    def matches(self, run: list[int]) -> dict[int, list[tuple[int, int, int]]]:
        """By template, the matches that cannot be made longer on the right: (file end, template end, words), by file end."""
        automaton, least = self.automaton, self.scan.least
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, (n, s) in enumerate(automaton.statistics(run)):
            seen: set[tuple[int, int]] = set()
            # shorter contexts of the match are in more places
            while s > 0 and n >= least:
                for template, places in automaton.ends[s].items():
                    text = self.texts[template]
                    for at in places:
                        if (template, at) not in seen:
                            seen.add((template, at))
                            if i + 1 == len(run) or at == len(text) or run[i + 1] != text[at]:
                                out[template].append((i + 1, at, n))
                s = automaton.link[s]
                n = automaton.length[s]
        return out

    def chains(self, run: list[int], start: int) -> list[tuple[int, int, int, int]]:
        """Spans (template, first word, end, template words covered) that meet the cover and do not overlap.

        A match goes on from the earlier match within ``gap`` words, in the file and in the template, with
        which it covers most. Templates are alike, so of spans that overlap only one stays: that which covers
        most words, then the largest share of its template, then the first.
        """
        every = []
        gap = self.scan.gap
        for template, found in self.matches(run).items():
            found.sort()
            best: list[tuple[int, int]] = []  # words covered by the chain that ends with a match, and its first word
            for k, (end, at, n) in enumerate(found):
                own = (n, end - n)
                for p in range(k - 1, -1, -1):
                    file_end, template_end, _ = found[p]
                    if end - n - file_end > gap:
                        break  # all others end earlier still
                    if file_end < end and template_end < at and at - n - template_end <= gap:
                        new = min(end - max(file_end, end - n), at - max(template_end, at - n))
                        own = max(own, (best[p][0] + new, best[p][1]))
                best.append(own)
            enough = self.scan.cover * len(self.texts[template])
            every += [(-c, -c / len(self.texts[template]), f, e, template) for (c, f), (e, _, _) in zip(best, found, strict=True) if c >= enough]
        out: list[tuple[int, int, int, int]] = []
        for covered, _, low, end, template in sorted(every):
            if all(end <= a - start or low >= b - start for _, a, b, _ in out):
                out.append((template, start + low, start + end, -covered))
        return out

    def promising(self, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Words inside some run of ``least`` template words: every match lies in these."""
        least = self.scan.least
        count = len(number) - least + 1
        mask = np.zeros(len(number), bool)
        if count <= 0:
            return mask
        code = np.zeros(count, np.int64)
        fine = row[least - 1 :] == row[:count]
        for k in range(least):
            code = code * self.size + number[k : k + count]
            fine &= number[k : k + count] >= 0
        at = np.flatnonzero(fine)
        hit = at[np.isin(code[at], self.grams)]
        for k in range(least):
            mask[hit + k] = True
        return mask

    def scan_chunk(self, t: Texts) -> dict[str, list]:
        w = words(t, NOT_ALNUM, lower=True)
        number = self.numbers(t, w)
        rows = len(t)
        n_words = np.diff(w.first)
        places: list[list[tuple[int, str]]] = [[] for _ in range(rows)]
        room = w.first[1:][w.row] if len(w.row) else np.zeros(0, np.int64)
        for phrase, label in self.phrases:
            at = np.flatnonzero(number == phrase[0])
            at = at[at + len(phrase) <= room[at]]
            for k in range(1, len(phrase)):
                at = at[number[at + k] == phrase[k]]
            for i in at.tolist():
                places[w.row[i]].append((i - int(w.first[w.row[i]]), label))
        # stretches of template words of one text, joined over short gaps, go through the automaton
        spans: list[list[tuple[str, int, int, float]]] = [[] for _ in range(rows)]
        known = np.flatnonzero(self.promising(number, w.row))
        if len(known):
            apart = (np.diff(known) > self.scan.gap + 1) | (np.diff(w.row[known]) > 0)
            for part in np.split(known, np.flatnonzero(apart) + 1):
                row, low = int(w.row[part[0]]), int(part[0])
                got = self.chains(number[low : int(part[-1]) + 1].tolist(), low - int(w.first[row]))
                spans[row] += [(self.names[k], a, b, covered / len(self.texts[k])) for k, a, b, covered in got]
        out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "span_first", "span_last")}
        for p, found in zip(places, spans, strict=True):
            base = sorted({x for _, x in p})
            out["n_base"].append(len(p))
            out["first_word"].append(min((x for x, _ in p), default=None))
            out["last_word"].append(max((x for x, _ in p), default=None))
            out["base_labels"].append(",".join(base))
            out["labels"].append(",".join(sorted({*base, *(x[0] for x in found)})))
            out["score"].append(min(1.0, max((x[3] for x in found), default=0.5 if p else 0.0)))
            out["span_first"].append(min((x[1] for x in found), default=None))
            out["span_last"].append(max((x[2] - 1 for x in found), default=None))
        return {"n_words": n_words, **out}


def license_scan(docs: DataFrame, scan: Scan | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Words, base phrase places and labels, all labels, the best covered share and the covered span of each row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case; a null text is
    empty. Without a phrase the places are null and the labels empty strings; score is the largest
    covered share of a template, 0.5 where only a phrase was found, else 0. ``span_first`` and ``span_last``
    are the first and last word of all covered spans. A very long text is scanned whole, as a chunk of its
    own. Repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """
    scan = scan or Scan()
    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, span_first bigint, span_last bigint"
    return add_columns(docs, text, [key], schema, lambda: Scanner(scan).scan_chunk)


