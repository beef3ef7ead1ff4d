"""Headers, SPDX ids and full texts of licences, as TF-IDF vectors."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

TEXTS = Path(__file__).parent / "license_texts"

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GNU = """{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public
License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later
version."""
_GNU_REST = """{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.
You should have received a copy of the GNU {1}General Public License along with this {3}. If not, see
<https://www.gnu.org/licenses/>."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:"""
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GNU_TITLES = [("GPL-2.0", "", "2, June 1991"), ("GPL-3.0", "", "3, 29 June 2007"),
               ("LGPL-2.1", "Lesser ", "2.1, February 1999"), ("LGPL-3.0", "Lesser ", "3, 29 June 2007")]
_SPDX = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0",
         "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]


@cache
def notices() -> list[tuple[str, str]]:
    """(license, text) of all headers, ids and full texts."""
    out = [("Apache-2.0", _APACHE), ("MPL-2.0", _MPL), ("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_REST}"),
           ("MIT", f"MIT License Copyright (c) {_MIT} {_MIT_REST}"), ("BSD-3-Clause", _BSD),
           ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_BSD_REST}"),
           ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THREE} {_BSD_REST}"),
           ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
           ("MPL-2.0", "Mozilla Public License Version 2.0")]
    for name, kind, version in _GNU_TITLES:
        what = "library" if kind else "program"
        head = (f"This {what}", kind, version.split(",")[0], what)
        out += [(name, _GNU.format(*head)), (name, f"{_GNU.format(*head)} {_GNU_REST.format(*head)}"),
                (name, f"GNU {kind}General Public License Version {version}")]
    for name in _SPDX:
        more = ["", "-only", "-or-later"] if "GPL" in name else [""]
        out += [(name, f"SPDX-License-Identifier: {name}{m}") for m in more]
    return out + [(p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]


@cache
def vectors(word: str) -> tuple[list[tuple[str, float]], list[tuple[str, str, float]], float]:
    """(word, idf), (license, word, share of the unit vector) and the idf of all other words.

    Document frequencies are those of the notices; ``word`` is the pattern of a word.
    """
    counts = [(name, i, Counter(re.findall(word, text.lower()))) for i, (name, text) in enumerate(notices())]
    df = Counter(w for _, _, c in counts for w in c)
    idf = {w: math.log((len(counts) + 1) / (n + 1)) + 1 for w, n in df.items()}
    rows = []
    for name, i, c in counts:
        weight = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rows += [(f"{name} {i}", w, x / norm) for w, x in weight.items()]
    return sorted(idf.items()), rows, math.log(len(counts) + 1) + 1
