r"""Operator 10, license scans: winnowed fingerprints of templates pick candidates, banded alignment reports matches.

Templates and texts are cut into lower-cased words. Hashes of every ``K`` words are winnowed: of each ``W`` in a row the
least is kept, so any shared run of ``K + W - 1`` words shares a kept hash. The templates' kept hashes form an inverted
index from hash to (template, place), broadcast in blocks of templates of bounded size. A text's
kept hashes that are in the index are seeds. Seeds of a template that go forward in both, ``GAP`` words of the text apart at most,
form chains: each seed follows the one that makes its chain cover most of the template, with the least shift between diagonals.
Every chain is aligned in a band that follows it: within ``BAND`` words of its diagonals, and of all that lie between two of
them where words were put in or left out. Only chains beside which the text has too few of the template's words to cover it are
passed over. Matches that cover ``COVER`` of a template or more are reported; of overlapping ones the one that matches most
words stays, each word between them that it does not match counting half against it, or the one that covers more of its
template if they are equal. What the reported matches leave of a text is searched again
until nothing more is found. Of licenses that differ by a word or a number (``PHRASES``) a match has to hold the words that tell
them apart together and as they are. Templates named ``-head`` are the first part of a notice, for texts that stop there.

Texts are scanned whole, in one Arrow map without a shuffle; only texts with seeds are aligned, and an alignment's cost is
bounded by the template's length times the band, however long the text.

Defined results: a null or empty text matches nothing; a template of fewer than ``K`` words has no
hashes and is never matched; every occurrence in a text is a row of its own; rows are independent, so repeated rows repeat;
equal matches of two templates at one place give the one whose name comes first; other columns are not read; an empty
table, or one without matches, gives no rows; a very long text is cut into words once and takes memory in proportion to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import table
from ferrule.llm.decontamination import words_of

K, W, BAND, GAP, COVER, BLOCK = 3, 2, 6, 64, 0.8, 1 << 20
#: What a chain loses for each word between two diagonals, in words covered.
SHIFT = 0.01
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A word as ``words_of`` cuts it, in code points.
POINTS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
    HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
    TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def gnu(short: str, name: str, version: str, what: str = "program") -> dict[str, str]:
    """The notice of a GNU license up to its warranty, and whole with each of its two endings."""
    head = f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
        Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        {name} for more details."""
    whole = f"{head} You should have received a copy of the {name} along with this {what}"
    post = "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    return {f"{short}-head": head, f"{short}-notice": f"{whole}. If not, see https://www.gnu.org/licenses/.", f"{short}-post": f"{whole}; {post}"}


#: Public license notices and texts.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-head": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization
        obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished
        to do so, all subject to the following:""",
    "CC0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to
        the public domain worldwide. This software is distributed without any warranty.""",
    "EPL-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
        at https://www.eclipse.org/legal/epl-2.0/""",
    "ISC-head": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    "MIT-head": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
        notice may not be removed or altered from any source distribution.""",
    **gnu("AGPL-3.0", "GNU Affero General Public License", "3"),
    **gnu("GPL-2.0", "GNU General Public License", "2"),
    **gnu("GPL-3.0", "GNU General Public License", "3"),
    **gnu("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"),
    **gnu("LGPL-3.0", "GNU Lesser General Public License", "3"),
}
TEMPLATES |= {
    "BSD-2-Clause": f"{TEMPLATES['BSD-head']} {WARRANTY}",
    "BSD-3-Clause": f"""{TEMPLATES['BSD-head']} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. {WARRANTY}""",
    "ISC": f"""{TEMPLATES['ISC-head']} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
        OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": f"""{TEMPLATES['MIT-head']} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
}


#: Licenses that differ by a word or a number have lines for each, and the words of one that have to stand together, as they are, in a match.
PHRASES = {f"CC-{kind}-{v}-line": f"CC {kind} {v}" for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")}
TEMPLATES |= {name: f"Licensed under {said}." for name, said in PHRASES.items()}
GNU = {f"{short}-{v if '.' in v else v + '.0'}-line": f"{name}, version {v}" for short, name, versions in (("GPL", "GNU General Public License", "2 3"), ("LGPL", "GNU Lesser General Public License", "2.1 3"), ("AGPL", "GNU Affero General Public License", "3")) for v in versions.split()}
TEMPLATES |= {name: f"This work is licensed under the {said}." for name, said in GNU.items()}
PHRASES |= GNU


def winnow(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the kept hashes of ``words``: of ``W`` hashes in a row the least, the rightmost if several."""
    n = len(words) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = np.fromiter(map(crc32, words), np.uint64, len(words))
    h = c[:n].copy()
    for i in range(1, K):
        h = (h ^ (h >> np.uint64(31))) * MIX + c[i : n + i]
    h = h * MIX
    keep = np.zeros(n, bool)
    if n < W:
        keep[n - 1 - int(np.argmin(h[::-1]))] = True
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, W)
        keep[np.arange(n - W + 1) + W - 1 - np.argmin(windows[:, ::-1], axis=1)] = True
    at = np.flatnonzero(keep)
    return at, h[at]


class Index:
    """Templates and the inverted index of their kept hashes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [words_of(templates[n].encode()) for n in self.names]
        self.known = [frozenset(w) for w in self.words]
        self.phrases = [words_of(PHRASES[n].encode()) if n in PHRASES else [] for n in self.names]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            at, h = winnow(words)
            for p, x in zip(at.tolist(), h.tolist(), strict=True):
                self.places[x].append((t, p))
        self.hashes = np.array(sorted(self.places), np.uint64)

    def find(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(template, share of its words matched, first word, word after the last) of every match, by place."""
        at, h = winnow(words)
        if not len(self.hashes) or not len(h):
            return []
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        own = self.hashes[k] == h
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, x in zip(at[own].tolist(), h[own].tolist(), strict=True):
            for t, q in self.places[x]:
                seeds[t].append((p, q))
        # Place by place, how many words of a template the text has before it: no part matches more than it has.
        held = {t: np.concatenate([[0], np.cumsum(np.fromiter((w in self.known[t] for w in words), np.int64, len(words)))]) for t in seeds}
        out, parts = [], [(0, len(words))]
        while parts:
            low, high = parts.pop()
            found = self._matches(words, seeds, held, low, high)
            out += found
            if found:
                parts += zip([low, *[e for *_, e in found]], [*[s for _, _, s, _ in found], high], strict=True)
        return sorted(out, key=lambda x: x[2])

    def _matches(self, words: list[bytes], seeds: dict, held: dict, low: int, high: int) -> list[tuple[str, float, int, int]]:
        """Matches inside ``words[low:high]`` that do not overlap, by place."""
        found = set()
        for t, all_ in seeds.items():
            size = len(self.words[t])
            least = COVER * size
            own = all_[bisect_left(all_, (low, 0)) : bisect_left(all_, (high - K + 1, 0))]
            if not own or held[t][high] - held[t][low] < least:
                continue
            for chain in chains(own):
                (p, q), (r, v) = chain[0], chain[-1]
                start, end = max(low, p - q - BAND), min(high, r + size - v + BAND)
                if held[t][end] - held[t][start] < least:
                    continue
                if p - q == r - v and p - q >= low and p - q + size <= high and words[p - q : p - q + size] == self.words[t]:
                    n, first, last = size, p - q, p - q + size - 1  # word for word
                else:
                    n, first, last = self._align(t, chain, words, start, end)
                if n >= least and holds(words[first : last + 1], self.phrases[t]):
                    found.add(((last - first + 1 - n) / 2 - n, size, self.names[t], last - first, first, n))
        starts: list[tuple[int, int]] = []
        out: list[tuple[str, float, int, int]] = []
        for _, size, name, long, first, n in sorted(found):
            k = bisect_left(starts, (first, 0))
            if (k == 0 or starts[k - 1][1] < first) and (k == len(starts) or starts[k][0] > first + long):
                insort(starts, (first, first + long))
                out.append((name, n / size, first, first + long + 1))
        return sorted(out, key=lambda x: x[2])

    def _align(self, t: int, chain: list[tuple[int, int]], words: list[bytes], low: int, high: int) -> tuple[int, int, int]:
        """Longest common subsequence of a template and ``words[low:high]`` within the band that follows ``chain``: its words, its
        first and its last; the tightest, then the earliest, if several are as long."""
        template = self.words[t]
        # Per cell of a row: words matched, where the match begins and, negated, ends; a cell is the text before one of its words.
        nothing = (0, -1, 1)
        row, base = [nothing], low
        k, n = 0, len(chain)
        for i, word in enumerate(template):
            while k < n and chain[k][1] <= i:
                k += 1
            before = chain[k - 1][0] - chain[k - 1][1] if k else chain[0][0] - chain[0][1]
            after = chain[k][0] - chain[k][1] if k < n else before
            start, end = max(low, min(before, after) + i - BAND), min(high, max(before, after) + i + 1 + BAND)
            if end < start:
                start = end = min(max(low, start), high)
            new: list[tuple[int, int, int]] = []
            top = len(row) - 1
            for c in range(start, end + 1):  # the text before word c
                d = c - base
                best = row[min(d, top)] if d >= 0 else nothing
                if c > start and new[-1] > best:
                    best = new[-1]
                if c > low and d > 0 and words[c - 1] == word:
                    m, first, _ = row[min(d - 1, top)]
                    best = max(best, (m + 1, first if m else c - 1, 1 - c))
                new.append(best)
            row, base = new, start
        m, first, last = max(row, key=lambda x: (x[0], x[1] + x[2], -x[1]))
        return m, first, -last


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    """Whether the words of ``phrase`` stand together in ``words``."""
    n = len(phrase)
    return not n or any(words[k : k + n] == phrase for k in range(len(words) - n + 1))


def chains(seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Chains of ``seeds``, sorted pairs of a place in the text and in a template: each seed is in one.

    A seed follows the seed within ``GAP`` words, earlier in both, whose chain covers most with it; the chain that covers most is taken
    first, and one that runs into seeds already taken starts after them.
    """
    n = len(seeds)
    score, back = [float(K)] * n, [-1] * n
    first = 0
    for j, (p, q) in enumerate(seeds):
        while seeds[first][0] < p - GAP:
            first += 1
        for i in range(j - 1, first - 1, -1):
            r, v = seeds[i]
            if r < p and v < q:
                s = score[i] + min(K, q - v, p - r) - SHIFT * abs((p - r) - (q - v))
                if s > score[j]:
                    score[j], back[j] = s, i
    taken, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: (-score[j], j)):
        chain = []
        while j >= 0 and not taken[j]:
            taken[j] = True
            chain.append(seeds[j])
            j = back[j]
        if chain:
            out.append(chain[::-1])
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, coverage double, start, end)`` of every match; offsets in code points, end exclusive."""
    templates = TEMPLATES if templates is None else templates
    blocks: list[dict[str, str]] = [{}]
    for name, text in sorted(templates.items()):
        if blocks[-1] and sum(map(len, blocks[-1].values())) + len(text) > BLOCK:
            blocks.append({})
        blocks[-1][name] = text
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("license", "string").add("coverage", "double").add("start", "long").add("end", "long")

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in batches:
                which, rows = [], []
                for k, raw in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                    found = index.find(words_of(raw))
                    if found:
                        at = [m.span() for m in POINTS.finditer(raw.decode())]
                        which += [k] * len(found)
                        rows += [(name, cover, at[s][0], at[e - 1][1]) for name, cover, s, e in found]
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.record_batch([b.column(0).take(pa.array(which, pa.int64())), *cols], names=["id", "license", "coverage", "start", "end"])

        return run

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks:
        found = source.mapInArrow(scan(docs.sparkSession.sparkContext.broadcast(block)), shape)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, coverage, start, end of every license match in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
