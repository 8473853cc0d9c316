"""License detection: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtrail.llm.common import batch_bytes, text_or_empty

# Phrases of the base detection and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License families: label, name as a pattern of words, keyword that the name holds.
FAMILIES = [
    ("agpl", "gnu affero general public licen[sc]e", "affero"), ("lgpl", "gnu (?:lesser|library) general public licen[sc]e", "general"),
    ("gpl", "(?:gnu )?general public licen[sc]e", "general"), ("gfdl", "gnu free documentation licen[sc]e", "documentation"),
    ("apache", "apache (?:software )?licen[sc]e", "apache"), ("mit", "mit licen[sc]e", "mit licen"), ("mit", "expat licen[sc]e", "expat"),
    ("bsd", "bsd licen[sc]e", "bsd"), ("bsd-2", "(?:2|two) clause bsd(?: licen[sc]e)?", "bsd"), ("bsd-2", "bsd 2 clause(?: licen[sc]e)?", "bsd"),
    ("bsd-3", "(?:3|three) clause bsd(?: licen[sc]e)?", "bsd"), ("bsd-3", "bsd 3 clause(?: licen[sc]e)?", "bsd"),
    ("isc", "isc licen[sc]e", "isc"), ("mpl", "mozilla public licen[sc]e", "mozilla"), ("epl", "eclipse public licen[sc]e", "eclipse"),
    ("eupl", "european union public licen[sc]e", "european"), ("cddl", "common development and distribution licen[sc]e", "distribution"),
    ("cpl", "common public licen[sc]e", "common"), ("artistic", "artistic licen[sc]e", "artistic"), ("boost", "boost software licen[sc]e", "boost"),
    ("zlib", "zlib licen[sc]e", "zlib"), ("unlicense", "the unlicense", "unlicense"), ("unlicense", "the unlicence", "unlicence"), ("wtfpl", "do what the fuck you want to public licen[sc]e", "fuck"),
    ("python", "python software foundation licen[sc]e", "python"), ("postgresql", "postgresql licen[sc]e", "postgresql"),
    ("ofl", "sil open font licen[sc]e", "font"), ("ms-pl", "microsoft public licen[sc]e", "microsoft"), ("osl", "open software licen[sc]e", "open"),
    ("odbl", "open database licen[sc]e", "database"), ("pddl", "public domain dedication and licen[sc]e", "dedication"),
    ("cc0", "cc0", "cc0"), ("cc0", "creative commons zero", "commons"), ("cc-by-nc-nd", "cc by nc nd", "cc by"), ("cc-by-nc-sa", "cc by nc sa", "cc by"),
    ("cc-by-nc", "cc by nc", "cc by"), ("cc-by-nd", "cc by nd", "cc by"), ("cc-by-sa", "cc by sa", "cc by"), ("cc-by", "cc by", "cc by"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative|ativ)?e?s?", "commons"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", "commons"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "commons"), ("cc-by-sa", "creative commons attribution share ?alike", "commons"),
    ("cc-by", "creative commons attribution", "commons"), ("public-domain", "public domain", "domain"),
]
# How a name is used, with the weight of such a mention; the longest forms come first.
FORMS = [
    ("licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{}", 1.0), ("released under (?:the )?(?:terms of )?(?:the )?{}", 1.0),
    ("distributed under (?:the )?(?:terms of )?(?:the )?{}", 1.0), ("available under (?:the )?(?:terms of )?(?:the )?{}", 0.9),
    ("subject to (?:the )?(?:terms of )?(?:the )?{}", 0.8), ("spdx licen[sc]e identifier {}", 1.0), ("{}", 0.6),
]
VERSIONS = "(?: (?:version|v)? ?(?P<v>[0-9]+)(?: [0-9]+)*(?: or (?:any )?later(?: version)?)?)?"
# Signatures of license texts and notices: label, clause, keyword that it holds, weight.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "granted", 1.0),
    ("mit", "to deal in the software without restriction including without limitation the rights to use", "deal in", 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial", 0.9),
    ("mit", "to permit persons to whom the software is furnished to do so", "furnished", 0.9),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim", "holders", 0.7),
    ("x11", "except as contained in this notice the names? of .{1,80} shall not be used in advertising", "advertising", 0.9),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose", "permission", 1.0),
    ("isc", "the software is provided as is and the author disclaims all warranties", "disclaims", 0.8),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee", 0.9),
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions", 0.9),
    ("bsd-3", "neither the names? of .{1,80} nor the names of (?:its|their) contributors may be used to endorse", "endorse", 1.0),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising", 1.0),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is", "provided by", 0.8),
    ("bsd", "however caused and on any theory of liability whether in contract strict liability or tort", "theory", 0.6),
    ("bsd-clear", "no express or implied licenses to any party s patent rights are granted by this license", "patent", 0.9),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance", 0.9),
    ("apache-2", "you may obtain a copy of the license at", "obtain", 0.7),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license", "applicable", 0.9),
    ("apache-2", "distributed on an as is basis without warranties or conditions of any kind", "conditions", 0.8),
    ("apache-2", "see the license for the specific language governing permissions and limitations", "governing", 0.8),
    ("apache-2", "grant of patent license subject to the terms and conditions of this license", "patent", 1.0),
    ("apache-2", "www apache org licenses license 2 0", "apache", 1.0),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor", "apache", 1.0),
    ("apache-1", "this product includes software developed by the apache (?:group|software foundation)", "apache", 0.9),
    ("apache-1", "the names apache server and apache group must not be used", "apache", 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute", 0.9),
    ("gpl", "either version (?P<v>[23]) (?:of the license )?or (?:at your option )?any later version", "later version", 0.8),
    ("gpl", "you should have received a copy of the gnu general public license", "general public", 0.9),
    ("gpl", "this program is distributed in the hope that it will be useful", "hope", 0.8),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", "merchantability", 0.6),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim", 0.9),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", "freedom", 1.0),
    ("gpl-2", "activities other than copying distribution and modification are not covered by this license", "activities", 0.9),
    ("gpl-2", "you must cause any work that you distribute or publish that in whole or in part contains", "publish", 0.8),
    ("gpl-3", "to propagate a work means to do anything with it that without permission", "propagate", 1.0),
    ("gpl-3", "a covered work means either the unmodified program or a work based on the program", "covered work", 1.0),
    ("gpl-3", "protecting users legal rights from anti circumvention law", "circumvention", 1.0),
    ("gpl-3", "conveying modified source versions", "conveying", 0.8),
    ("gpl-3", "installation information for a user product means any methods procedures", "installation", 0.9),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "library", 1.0),
    ("lgpl", "a program that contains no derivative of any portion of the library", "library", 0.9),
    ("lgpl", "work that uses the library", "library", 0.7),
    ("lgpl", "you may convey a combined work under terms of your choice", "combined work", 0.9),
    ("agpl", "remote network interaction use with the gnu general public license", "network", 1.0),
    ("agpl", "interacting with it remotely through a computer network", "remotely", 1.0),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms", "document", 0.9),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant", 1.0),
    ("gpl-exception", "as a special exception you may create a larger work", "exception", 0.8),
    ("gpl-exception", "gcc runtime library exception", "runtime", 0.9),
    ("gpl-exception", "classpath exception", "classpath", 0.9),
    ("gpl-exception", "linking this library statically or dynamically with other modules", "statically", 0.9),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", "source code form", 1.0),
    ("mpl-2", "if a copy of the mpl was not distributed with this file", "the mpl", 1.0),
    ("mpl-2", "incompatible with secondary licenses", "secondary", 0.9),
    ("mpl-1", "the contents of this file are subject to the mozilla public license", "mozilla", 1.0),
    ("mpl-1", "software distributed under the license is distributed on an as is basis without warranty of any kind", "as is", 0.7),
    ("npl", "the contents of this file are subject to the netscape public license", "netscape", 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", "accompanying", 1.0),
    ("epl", "www eclipse org legal epl", "eclipse", 1.0),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", "recipient", 0.8),
    ("cpl", "the accompanying program is provided under the terms of this common public license", "common public", 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development", "common development", 1.0),
    ("cddl", "you can obtain a copy of the license at .{0,60}opensolaris", "opensolaris", 0.9),
    ("eupl", "this european union public licence .{0,12}applies to the work", "european", 1.0),
    ("eupl", "licensed under the eupl", "eupl", 1.0),
    ("ms-pl", "if you bring a patent claim against any contributor over patents", "patent claim", 0.8),
    ("ms-rl", "microsoft reciprocal license", "reciprocal", 1.0),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied", "package", 1.0),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim", 0.7),
    ("artistic-2", "you are permitted to use the standard version and create and use modified versions", "standard version", 1.0),
    ("perl", "under the same terms as perl itself", "perl", 1.0),
    ("ruby", "you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", "redistribute", 0.9),
    ("python", "psf is making python available to licensee on an as is basis", "licensee", 1.0),
    ("python", "this license agreement is between the python software foundation", "python", 1.0),
    ("python", "cnri hereby grants licensee", "cnri", 1.0),
    ("php", "this product includes php software freely available from", "php", 1.0),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 1.0),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic", 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty", 0.7),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 1.0),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 1.0),
    ("zlib", "this notice may not be removed or altered from any source distribution", "removed", 0.9),
    ("libpng", "the png reference library is supplied as is", "png", 1.0),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg", 1.0),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", "organization", 1.0),
    ("boost", "www boost org license 1 0", "boost", 1.0),
    ("curl", "except as contained in this notice the name of a copyright holder shall not be used", "holder", 0.8),
    ("icu", "unicode inc license agreement data files and software", "unicode", 1.0),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode", 1.0),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", "documentation", 0.9),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose", "sell", 0.9),
    ("ncsa", "neither the names of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission ncsa", "ncsa", 0.8),
    ("ncsa", "university of illinois ncsa open source license", "ncsa", 1.0),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "agreement", 1.0),
    ("w3c", "this work is being provided by the copyright holders under the following license w3c", "w3c", 0.9),
    ("w3c", "w3c software notice and license", "w3c", 1.0),
    ("vim", "this license applies to the vim editor", "vim", 1.0),
    ("tcl", "the following terms apply to all files associated with the software unless explicitly disclaimed", "disclaimed", 0.9),
    ("freetype", "portions of this software are copyright .{0,40}the freetype project", "freetype", 1.0),
    ("ftl", "freetype project license", "freetype", 1.0),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "accompanied", 0.9),
    ("qpl", "q public license", "q public", 1.0),
    ("ibm-pl", "ibm public license", "ibm", 1.0),
    ("apsl", "apple public source license", "apple", 1.0),
    ("intel", "intel open source license", "intel", 0.9),
    ("nokia", "nokia open source license", "nokia", 0.9),
    ("sun", "sun public license", "sun public", 1.0),
    ("cecill", "cecill free software license agreement", "cecill", 1.0),
    ("cecill", "ce logiciel est regi par la licence cecill", "cecill", 1.0),
    ("lppl", "latex project public license", "latex", 1.0),
    ("beerware", "the beerware license", "beerware", 1.0),
    ("beerware", "the beer ware license", "beer", 1.0),
    ("beerware", "you can buy me a beer in return", "beer", 0.9),
    ("wtfpl", "you just do what the fuck you want to", "fuck", 1.0),
    ("json", "the software shall be used for good not evil", "evil", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile", 1.0),
    ("unlicense", "we make this dedication for the benefit of the public at large", "dedication", 0.9),
    ("cc0", "to the extent possible under law .{1,60} has waived all copyright and related or neighboring rights", "neighboring", 1.0),
    ("cc0", "creativecommons org publicdomain zero", "publicdomain", 1.0),
    ("cc-by", "creativecommons org licenses by (?P<v>[1-4]) 0", "creativecommons", 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa (?P<v>[1-4]) 0", "creativecommons", 1.0),
    ("cc-by-nc", "creativecommons org licenses by nc (?P<v>[1-4]) 0", "creativecommons", 1.0),
    ("cc-by-nd", "creativecommons org licenses by nd (?P<v>[1-4]) 0", "creativecommons", 1.0),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa (?P<v>[1-4]) 0", "creativecommons", 1.0),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd (?P<v>[1-4]) 0", "creativecommons", 1.0),
    ("cc", "the work as defined below is provided under the terms of this creative commons public license", "commons", 1.0),
    ("cc", "by exercising the licensed rights defined below you accept and agree to be bound", "exercising", 1.0),
    ("cc", "you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit", 0.9),
    ("cc-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license", "remix", 0.9),
    ("cc-nc", "you may not use the material for commercial purposes", "commercial", 0.8),
    ("cc-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix", 0.9),
    ("odbl", "this database is made available under the open database license", "database", 1.0),
    ("odc-by", "open data commons attribution license", "data commons", 1.0),
    ("dbcl", "any rights in individual contents of the database are licensed under the database contents license", "contents", 1.0),
    ("ogl-uk", "contains public sector information licensed under the open government licence", "government", 1.0),
    ("cdla", "community data license agreement", "community data", 1.0),
    ("ofl", "this font software is licensed under the sil open font license", "font", 1.0),
    ("ofl", "with reserved font name", "reserved font", 0.9),
    ("bitstream", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license", "fonts", 1.0),
    ("openrail", "use based restrictions as referenced in paragraph 5", "restrictions", 0.9),
    ("openrail", "open rail m license", "rail", 1.0),
    ("llama", "llama (?:2|3|3 1) community license agreement", "llama", 1.0),
    ("gemma", "gemma terms of use", "gemma", 1.0),
    ("sspl", "server side public license", "server side", 1.0),
    ("elastic", "elastic license (?:2 0|agreement)", "elastic", 1.0),
    ("busl", "business source license 1 1", "business source", 1.0),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production", 1.0),
    ("commons-clause", "commons clause license condition", "commons clause", 1.0),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) license", "polyform", 1.0),
    ("confluent", "confluent community license", "confluent", 1.0),
    ("blueoak", "blue oak model license", "blue oak", 1.0),
    ("upl", "universal permissive license", "permissive", 1.0),
    ("mulan", "mulan psl v2", "mulan", 1.0),
    ("ecl", "educational community license", "educational", 1.0),
    ("afl", "academic free license", "academic", 1.0),
    ("rpl", "reciprocal public license", "reciprocal", 1.0),
    ("osl", "licensed under the open software license", "open software", 1.0),
    ("proprietary", "all rights reserved", "reserved", 0.5),
    ("proprietary", "confidential and proprietary", "proprietary", 0.8),
    ("proprietary", "unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document)", "unauthorized", 0.8),
    ("proprietary", "may not be (?:copied|reproduced|disclosed|distributed) without (?:the )?(?:prior |express )?written (?:consent|permission)", "written", 0.8),
    ("proprietary", "this software contains proprietary information of", "proprietary", 0.9),
    ("proprietary", "trade secrets? of", "trade secret", 0.6),
    ("proprietary", "end user license agreement", "end user", 0.8),
    ("proprietary", "you may not reverse engineer decompile or disassemble", "decompile", 0.8),
    ("non-commercial", "for (?:non commercial|noncommercial|academic|research|evaluation) (?:use|purposes) only", "only", 0.7),
    ("us-government", "this is a work of the (?:united states|u s) government", "government", 0.9),
    ("public-domain", "released (?:in)?to the public domain", "public domain", 0.9),
    ("public-domain", "no copyright is claimed", "claimed", 0.7),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 0.4),
    ("copyright", "copyright notice", "copyright", 0.3),
    ("spdx", "spdx licen[sc]e identifier [a-z0-9]+", "spdx", 0.5),
]

#: Labels that say little: their rules come last.
GENERIC = {"copyright", "spdx"}

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def rules() -> list[tuple[int, str, bytes, "re.Pattern[bytes]", float]]:
    """(priority, label, keyword, pattern, weight): clauses of license texts and notices, then names by form, then what says little.

    Patterns run over words joined by single spaces; a smaller priority wins.
    """
    made: list[tuple[str, str, str, float]] = []
    for form, weight in FORMS:
        for label, name, keyword in FAMILIES:
            made.append((label, keyword, form.format(f"(?:{name})") + VERSIONS, weight))
    texts = [(label, keyword, pattern, weight) for label, pattern, keyword, weight in TEXTS]
    made = [t for t in texts if t[0] not in GENERIC] + made + [t for t in texts if t[0] in GENERIC]
    return [(i, label, keyword.encode(), re.compile(b"(?<![^ ])" + p.encode() + b"(?![^ ])"), weight)
            for i, (label, keyword, p, weight) in enumerate(made)]


class _Accepted:
    """Accepted spans: is a span inside one of them?  The largest end by start, as a binary indexed tree of maxima."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.ends = [0] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def covers(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        while i:
            if self.ends[i] >= end:
                return True
            i -= i & -i
        return False


def detect(words: bytes, gate) -> list[tuple[int, int, str, float]]:
    """Detections that survive: by priority, then by place, dropping spans inside an accepted one.

    ``gate`` maps keywords to rules, so only rules whose keyword occurs are tried.  Of n detections
    each is judged in time log n.
    """
    found = []
    for keyword, members in gate.items():
        if keyword in words:
            for priority, label, _, pattern, weight in members:
                for m in pattern.finditer(words):
                    version = m.groupdict().get("v")
                    found.append((priority, m.start(), m.end(), f"{label}-{version.decode()}" if version else label, weight))
    accepted = _Accepted([f[1] for f in found])
    kept: list[tuple[int, int, str, float]] = []
    for _, a, b, label, weight in sorted(found):
        if not accepted.covers(a, b):
            accepted.add(a, b)
            kept.append((a, b, label, weight))
    return sorted(kept)


def scan_licenses(documents: DataFrame) -> DataFrame:
    """License labels per document: base phrases, and the labels of all signature rules.

    Words are runs of ASCII digits, letters in either case and non-ASCII characters.  A null or
    empty text has no words, no labels and score 0.  Rows are judged one by one, so repeated rows
    give repeated results; only ``doc_id`` and ``text`` are read.  Score: 1 minus the product of
    (1 - weight) over the surviving detections, a base label counting 0.6.
    """
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, n_detections long")

    def run(batches):
        table = rules()
        gate: dict[bytes, dict[bytes, list]] = {}  # first word of a keyword -> keyword -> rules
        for r in table:
            gate.setdefault(r[2].split()[0], {}).setdefault(r[2], []).append(r)
        phrases = [(re.compile(b"(?<![^ ])" + p.encode() + b"(?![^ ])"), label) for p, label in BASE.items()]
        for batch in batches:
            data, ends = batch_bytes(batch.column(1))
            data = _LOWER[data]
            word = _WORD[data]
            flat = np.where(word, data, np.uint8(32))
            starts = word.copy()
            starts[1:] &= ~word[:-1]
            rim = ends[:-1][ends[:-1] < len(data)]
            starts[rim] = word[rim]
            total = np.concatenate([[0], np.cumsum(starts)])
            n_words = total[ends[1:]] - total[ends[:-1]]
            view = memoryview(flat) if len(flat) else memoryview(b"")
            out = []
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                text = bytes(view[a:b])
                own = text.split()
                tried = gate.keys() & set(own)
                if not tried:
                    # without any keyword neither a rule nor a base phrase can occur
                    out.append((0, None, None, "", "", 0.0, 0))
                    continue
                words = b" ".join(own)
                places, base = [], set()
                for pattern, label in phrases:
                    for m in pattern.finditer(words):
                        places.append(m.start())
                        base.add(label)
                kept = detect(words, {k: r for first in tried for k, r in gate[first].items()})
                labels = base | {k[2] for k in kept}
                left = 1.0
                for weight in [k[3] for k in kept] or [0.6] * bool(base):
                    left *= 1.0 - weight
                numbers = [words.count(b" ", 0, p) for p in (min(places), max(places))] if places else [None, None]
                out.append((len(places), *numbers, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - left, len(kept)))
            columns = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            made = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words.astype(np.int64)), *made],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                                              "labels", "score", "n_detections"])

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)
