"""Operator 9, licence scans: known sentences become identifiers, and sequences of them are matched against ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

#: Sentences of licence notices and texts: fixed values, in normal form (see normal()).
SENTENCES = {
    "apache-2-short": "licensed under the apache license version 2 0",
    "apache-2-the": 'licensed under the apache license version 2 0 the license',
    "apache-2-use": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3-short": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "apache-2-title": "apache license version 2 0 january 2004",
    "apache-2-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "gpl-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-3-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl-2-preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "lgpl-2-1-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl-2-1-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-3-title": "gnu affero general public license version 3 19 november 2007",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "mpl-2-title": "mozilla public license version 2 0",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "boost-short": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl-title": "do what the fuck you want to public license",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-4-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-4-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-4-work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "cc0-1-waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-nd-4": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-4": "licensed under cc by nc sa 4 0",
    "cc0-1": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
#: Licences that a line "SPDX-License-Identifier: name" may name, fixed values.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Ordered rules: at each place the first that matches wins, and takes its sentences.
RULES = [
    ("Apache-2.0", ("apache-2-title", "apache-2-grant")),
    ("Apache-2.0", ("apache-2-title",)),
    ("Apache-2.0", ("apache-2-the", "apache-2-use", "apache-2-copy", "apache-2-unless", "apache-2-see")),
    ("Apache-2.0", ("apache-2-the", "apache-2-use", "apache-2-copy")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-university")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty", "bsd-liable")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-university")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liable")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("X11-like", ("mit-grant",)),
    ("MIT-0", ("mit-0-grant", "mit-warranty", "mit-liable")),
    ("MIT-0", ("mit-0-grant",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD-like", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3-title", "gpl-verbatim", "gpl-3-preamble")),
    ("GPL-3.0-only", ("gpl-3-title",)),
    ("GPL-3.0-only", ("gpl-3-preamble",)),
    ("GPL-2.0-only", ("gpl-2-title", "gpl-verbatim", "gpl-2-preamble")),
    ("GPL-2.0-only", ("gpl-2-title",)),
    ("LGPL-2.1-or-later", ("lgpl-2-1-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-2-1-free",)),
    ("LGPL-2.1-only", ("lgpl-2-1-title", "gpl-verbatim")),
    ("LGPL-2.1-only", ("lgpl-2-1-title",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free", "gpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-3.0-only", ("lgpl-3-title", "gpl-verbatim")),
    ("LGPL-3.0-only", ("lgpl-3-title",)),
    ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("AGPL-3.0-only", ("agpl-3-title", "gpl-verbatim")),
    ("AGPL-3.0-only", ("agpl-3-title",)),
    ("Zlib", ("zlib-warranty", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl-2",)),
    ("EPL-1.0", ("epl-1",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-short",)),
    ("WTFPL", ("wtfpl-title",)),
    ("Unlicense", ("unlicense", "unlicense-free")),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-work",)),
    ("CC0-1.0", ("cc0-1-waived",)),
    ("MPL-2.0", ("mpl-2-title",)),
    ("MPL-2.0", ("mpl-2", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2",)),
    ("Apache-2.0", ("apache-2-short",)),
    ("Apache-2.0", ("apache-2-the",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0-only", ("gpl-3-work",)),
    ("GPL-3.0-only", ("gpl-3-short",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC0-1.0", ("cc0-1",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
]
RULES += [(name, (f"spdx-{name}",)) for name in SPDX]
#: Licences that forbid commercial use or derivation, or keep all rights.
RESTRICTED = {"CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "Proprietary"}
#: What a licence's own notice of copyright may say too: it counts where no other licence is found.
ALONE = "Proprietary"
#: One of these is in every known sentence; a text without any has none. Each lies within a word, so that spaces and line
#: breaks between words don't matter in texts that aren't in normal form.
TRIGGERS = ("licen", "permission", "permitted", "warrant", "redistribution", "unencumbered", "copyright", "reserved", "mpl", "disclaims", "liable", "misrepresented", "altered", "waived", "advertising", "compile")
_PIECE_END = re.compile(r"[.!?;:](?=\s|$)|\n")
_NOT_WORD = re.compile(r"[^0-9a-z]+")


def normal(sentence: str) -> str:
    """Lower case; runs of anything but a-z and digits become one space."""
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


SENTENCES |= {f"spdx-{name}": f"spdx license identifier {normal(name)}" for name in SPDX}


@cache
def _known() -> tuple[dict[str, str], set[str]]:
    """Known sentences, and the beginnings of them by whole words."""
    assert all(normal(t) == t and " " not in t for t in TRIGGERS) and all(any(t in s for t in TRIGGERS) for s in SENTENCES.values())
    return {s: k for k, s in SENTENCES.items()}, {s[:i] for s in SENTENCES.values() for i in (*(m.start() for m in re.finditer(" ", s)), len(s))}


def _runs(pieces: list[str]) -> Iterator[tuple[int, str]]:
    """(place, identifier) of the known sentences that a piece or a run of consecutive ones is, the longest at each place.
    A run goes on only while it begins a known sentence."""
    known, begun = _known()
    i = 0
    while i < len(pieces):
        run, best, j = pieces[i], None, i
        while run in begun:
            if run in known:
                best = j, known[run]
            j += 1
            while j < len(pieces) and not pieces[j]:
                j += 1
            if j == len(pieces):
                break
            run = f"{run} {pieces[j]}"
        if best:
            yield i, best[1]
            i = best[0]
        i += 1


def sentence_ids(text: str) -> list[tuple[int, str]]:
    """(number of its first piece, identifier) of the known sentences, in order. A piece ends at .!?;: before space or with
    its line; a known sentence is a piece or a run of consecutive ones, wherever the text around it begins and ends."""
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    return list(_runs([normal(p) for p in _PIECE_END.split(low)]))


def matches(ids: list[str]) -> list[str]:
    """Licences in order of their place; a known sentence that no rule takes gives none, and ALONE beside others neither."""
    out, i = [], 0
    while i < len(ids):
        for name, rule in RULES:
            if tuple(ids[i : i + len(rule)]) == rule:
                out.append(name)
                i += len(rule)
                break
        else:
            i += 1
    return [x for x in out if x != ALONE] or out


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_known (known sentences), sentence_ids, licenses (distinct, sorted), n_matches, restricted.

    Null, empty or other texts without a known sentence have empty lists. Repeated rows and null ids each keep their row;
    an empty table gives none; other columns aren't read. A narrow pass over whole texts.
    """

    def make():
        def step(b: pa.RecordBatch):
            rows = []
            for x in b.column("text").to_pylist():
                ids = [k for _, k in sentence_ids(x or "")]
                found = matches(ids)
                rows.append((len(ids), ids, sorted(set(found)), len(found), bool(RESTRICTED & set(found))))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.bool_())
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_known", "sentence_ids", "licenses", "n_matches", "restricted"])

        return step

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(over_batches(make), "doc_id long, n_known long, sentence_ids array<string>, licenses array<string>, n_matches long, restricted boolean")
