"""License scans by conditional compression.

Blocks of text with a licence word in them are compressed twice, alone and with a template as raw dictionary. The
template that saves the largest share names the licence, and a comparison of the words says how the block differs.
A line break, with the marks of a comment around it, is a space: blocks grow over lines and sentences as long as the
words that they hold can still be those of a template. Blocks that have too few words in common with every template for a
hit are not compressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heapify, heappop, heappush

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

_WARRANTY = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should "
             "have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>.")
_GRANT = ("This {0} is free software{4} you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
          "the Free Software Foundation{2} version {3} of the License")


def _gnu(what: str, name: str, version: str, later: bool) -> list[str]:
    """The Free Software Foundation's notice, its first sentence and all of it."""
    tail = ", or (at your option) any later version." if later else "."
    grant = _GRANT.format(what, name, "; either" if later else ";", version, ":") + tail
    line = f"This work is licensed under the GNU {name}, version {version}"
    return [*([line + " or later."] if later else [line + " only."]), grant, f"{grant} {_WARRANTY.format(what, name)}"]


_CONDITIONS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
               "the following conditions are met")
_TWO = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_THIRD = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.")
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
           "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.")


def _cc(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.",
            f"This work is licensed under the Creative Commons {long} 4.0 International License."]


#: Wording of notices, by SPDX name. Licences that are short are here in full.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", _APACHE,
        _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0-or-later": _gnu("program", "General Public License", "3", True),
    "GPL-3.0-only": _gnu("program", "General Public License", "3", False),
    "GPL-2.0-or-later": _gnu("program", "General Public License", "2", True),
    "GPL-2.0-only": _gnu("program", "General Public License", "2", False),
    "LGPL-3.0-or-later": _gnu("library", "Lesser General Public License", "3", True),
    "LGPL-3.0-only": _gnu("library", "Lesser General Public License", "3", False),
    "LGPL-2.1-or-later": _gnu("library", "Lesser General Public License", "2.1", True),
    "LGPL-2.1-only": _gnu("library", "Lesser General Public License", "2.1", False),
    "AGPL-3.0-or-later": _gnu("program", "Affero General Public License", "3", True),
    "AGPL-3.0-only": _gnu("program", "Affero General Public License", "3", False),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [
        _ISC,
        _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "BSD-2-Clause OR BSD-3-Clause": [_CONDITIONS + "."],  # what both begin with
    "BSD-2-Clause": [f"{_CONDITIONS}: {_TWO}", f"{_CONDITIONS}: {_TWO} {_DISCLAIMER}"],
    "BSD-3-Clause": [f"{_CONDITIONS}: {_TWO} {_THIRD}", f"{_CONDITIONS}: {_TWO} {_THIRD} {_DISCLAIMER}"],
}
#: Words that name another licence; notice and template have the same of them, and the same numbers.
TELLING = {"later", "only", "lesser", "affero", "endorse", "noncommercial", "noderivatives", "sharealike", "nc", "nd", "sa"}
ANCHOR = r"(?i)licen[sc]|copyright|permission is hereby|redistribut|public domain|is hereby granted"
UNIT = re.compile(r"[^\n]*?(?:[.!?](?=\s|\Z)|\n|\Z)")  # sentences, and the lines of those that are wrapped
ANCHORED = re.compile(ANCHOR)
MARKS = re.compile(r"[\s#*/;%>!-]*")  # of comments, before a line
WRAP = re.compile(r"[^\S\n]*\n[\s#*/;%>!-]*")
ITEM = re.compile(r"(?:^|(?<![vV]ersion)(?<!\b[vV]\.)(?:\n|(?<=[.:;])[^\S\n]+))[\s#*/;%>!-]*\(?\d[.)](?=\s)")  # of clauses
LOOK_BACK = 8  # lines from a licence word to where its sentence begins
LEAST_SAVED = 0.35  # share of the block's compressed bytes that a template must save
LEAST_WORDS = 0.6  # share of the template's or the block's words that must agree
LEVEL = 9
FOUND = ("doc_id long, start int, end int, license string, saved double, agreement double, "
         "missing array<string>, added array<string>")


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-]\d+)*", ITEM.sub(" ", text).lower())


class Scanner:
    """Compressors for all templates, one dictionary each."""

    def __init__(self, templates: dict[str, list[str]]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.templates = []
        for name, texts in templates.items():
            for text in texts:
                raw = zstandard.ZstdCompressionDict(text.encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, words(text), zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
        self.sizes = [len(own) for _, own, _ in self.templates]
        self.tells = [self.telling(own) for _, own, _ in self.templates]
        self.holders: dict[str, list[tuple[int, int]]] = {}  # (template, count) of each word
        for t, (_, own, _) in enumerate(self.templates):
            for word, n in Counter(own).items():
                self.holders.setdefault(word, []).append((t, n))

    def blocks(self, text: str) -> Iterator[tuple[int, int, int, list[int]]]:
        """(most that its score can be, start, end, templates) of the stretches of lines and sentences that begin at a licence
        word or up to LOOK_BACK lines before it in its sentence, as far as their words can be those of a template."""
        units = [m.span() for m in UNIT.finditer(text) if MARKS.fullmatch(m[0]) is None]
        if not units:
            return
        starts = set()
        for m in ANCHORED.finditer(text):
            i = max(bisect_right(units, (m.start(), len(text))) - 1, 0)
            for j in range(i, max(i - LOOK_BACK, 0) - 1, -1):
                starts.add(j)
                if j and text[units[j - 1][0]:units[j - 1][1]].rstrip().endswith((".", "!", "?")):
                    break
        found = {}
        for i in sorted(starts):
            start = MARKS.match(text, units[i][0], units[i][1]).end()
            seen, common, n = Counter(), [0] * len(self.sizes), 0
            alive = range(len(self.sizes))
            tells: set[str] = set()
            for j in range(i, len(units)):
                end = units[j][1]
                if j not in found:
                    before = text[units[j - 1][0]:units[j][0]] if j else ""
                    found[j] = words(before + text[units[j][0]:end])[len(words(before)):]
                for word in found[j]:
                    have = seen[word]
                    seen[word] += 1
                    for t, most in self.holders.get(word, ()):
                        common[t] += have < most
                n += len(found[j])
                tells |= self.telling(found[j])
                alive = [t for t in alive if (n - common[t]) * LEAST_WORDS <= 2 * (1 - LEAST_WORDS) * self.sizes[t]]
                if not alive:
                    break
                fit = [t for t in alive if 2 * common[t] >= LEAST_WORDS * (self.sizes[t] + n) and self.tells[t] == tells]
                if fit:
                    yield max(3 * common[t] - self.sizes[t] - n for t in fit), start, end, fit

    def best(self, block: str, fit: list[int]) -> tuple[float, str, float, list[str], list[str], int] | None:
        raw = WRAP.sub(" ", block).encode("utf-8")
        alone = len(self.plain.compress(raw))
        ranked = sorted(((1 - len(c.compress(raw)) / alone, name, own) for name, own, c in map(self.templates.__getitem__, fit)),
                        key=lambda x: (-x[0], x[1]))
        found = words(block)
        for saved, name, own in ranked:
            if saved < LEAST_SAVED:
                return None
            matcher = SequenceMatcher(None, own, found, autojunk=False)
            same = sum(m.size for m in matcher.get_matching_blocks())
            agreement = 2 * same / (len(own) + len(found))
            if agreement >= LEAST_WORDS and self.telling(own) == self.telling(found):
                changes = [op for op in matcher.get_opcodes() if op[0] != "equal"]
                return (saved, name, agreement, [w for _, a, b, _, _ in changes for w in own[a:b]],
                        [w for _, _, _, a, b in changes for w in found[a:b]], 3 * same - len(own) - len(found))
        return None

    @staticmethod
    def telling(found: list[str]) -> set[str]:
        """Versions and TELLING words must agree exactly: other words may vary, they name another licence."""
        return {w for w in found if w[0].isdigit() or w in TELLING}

    def scan(self, text: str) -> list[tuple]:
        """Notices that do not overlap. Those are first kept that have most words in common less those that differ; a block is
        compared when no other can have more."""
        heap = [(-most, 0, start, end, fit) for most, start, end, fit in self.blocks(text)]
        heapify(heap)
        chosen = []
        while heap:
            _, compared, start, end, x = heappop(heap)
            if any(end > a and start < b for a, b, _ in chosen):
                continue
            if compared:
                chosen.append((start, end, x))
            elif hit := self.best(text[start:end], x):
                heappush(heap, (-hit[5], 1, start, end, hit[:5]))
        return sorted(chosen, key=lambda c: c[:2])


def notices(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, start, end, license, saved, agreement, missing, added): one row for each licence notice of each row of
    (doc_id, text, ...), in code points, end exclusive.

    ``saved`` is the share of compressed bytes that the template saves, ``missing`` and ``added`` are the words in which
    notice and template differ. NULL and empty texts, and texts without a licence word, have none. Equal savings go to
    the name that comes first. Whole texts are searched; those without a licence word never leave the JVM.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(),
                 pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["doc_id", "start", "end", "license", "saved", "agreement", "missing", "added"]
        for batch in batches:
            rows = [(i, start, end, name, saved, agreement, missing, added)
                    for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for start, end, (saved, name, agreement, missing, added) in scanner.scan(text)]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return whole(docs).where(F.col("text").rlike(ANCHOR)).mapInArrow(run, FOUND)
