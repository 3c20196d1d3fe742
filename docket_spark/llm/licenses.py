"""Licence recognition by sentence rules, by DataFrame functions only.

A text is cut into sentences, each normalised (lower case, everything but letters and digits a single blank).  A
sentence may be a line, or run over lines up to a blank one, with comment signs before each.  Known
licence sentences map to identifiers; the identifiers of a text, in order, are matched against licence rules, which are
identifier sequences that must follow each other, possibly with other known sentences between.  The tables are small
and fixed, so they travel as literals: no join, no shuffle, and whole texts of any length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Licence sentences, as printed in the licences' own notices, and their identifiers.
SENTENCES = {
    "mit_released": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "mit_title": "The MIT License",
    "mit_title_paren": "MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "asis_software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache2_licensed": "Licensed under the Apache License, Version 2.0",
    "apache2_licensed_the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2_comply": "you may not use this file except in compliance with the License",
    "apache2_obtain": "You may obtain a copy of the License at",
    "apache2_title": "Apache License Version 2.0, January 2004",
    "gpl3_work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3_licensed": "Licensed under the GNU General Public License, version 3",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl_received": "You should have received a copy of the GNU General Public License along with this program",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync4_licensed": "Licensed under CC BY-NC 4.0",
    "ccby4_licensed": "Licensed under CC BY 4.0",
    "ccbysa4_licensed": "Licensed under CC BY-SA 4.0",
    "cc0_licensed": "Licensed under CC0 1.0",
    "ccbync4_work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "ccby4_work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl2_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "mit_liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit_this": "This project is licensed under the MIT License",
    "mit_software": "This software is released under the MIT License",
    "mit_source": "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree",
    "apache2_this": "This project is licensed under the Apache License, Version 2.0",
    "apache2_unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache2_see": "See the License for the specific language governing permissions and limitations under the License",
    "apache2_asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "apache2_notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "apache2_asf_licenses": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")",
    "apache2_terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2_copyright_grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_details": "See the GNU General Public License for more details",
    "gpl2_write": "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "gpl3_title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2_title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl2_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl_everyone": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "lgpl3_title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21_title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl_received": "You should have received a copy of the GNU Lesser General Public License along with this library",
    "lgpl3_licensed": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl3_title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl_received": "You should have received a copy of the GNU Affero General Public License along with this program",
    "agpl3_licensed": "Licensed under the GNU Affero General Public License, version 3",
    "bsd_asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd_liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "bsd_advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "bsd3_licensed": "Licensed under the BSD 3-Clause License",
    "bsd2_licensed": "Licensed under the BSD 2-Clause License",
    "bsd3_title": "BSD 3-Clause License",
    "bsd2_title": "BSD 2-Clause License",
    "isc_title": "ISC License",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_old_grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc_licensed": "Licensed under the ISC License",
    "bsd0_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib_asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_held": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib_origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib_altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib_notice": "This notice may not be removed or altered from any source distribution",
    "epl2_made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl2_are_made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "epl1_made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl2_title": "Eclipse Public License - v 2.0",
    "mpl2_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl2_title": "Mozilla Public License Version 2.0",
    "mpl2_licensed": "Licensed under the Mozilla Public License, version 2.0",
    "bsl_title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "bsl_distributed": "Distributed under the Boost Software License, Version 1.0",
    "ccby4_title": "Creative Commons Attribution 4.0 International Public License",
    "ccbysa4_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ccbysa3_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "ccby3_work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "ccbynd4_work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "ccbyncsa4_work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "ccbyncnd4_work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "cc0_title": "CC0 1.0 Universal",
    "wtfpl_title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "psf_licensed": "Licensed to PSF under a Contributor Agreement",
    "artistic2_title": "The Artistic License 2.0",
    "artistic_perl": "you can redistribute it and/or modify it under the same terms as Perl itself",
}
#: Ordered licence rules: (licence, rule, identifiers that follow each other).  The first rule of a licence that holds names it.
RULES = [
    ("MIT", "full text", ["mit_grant", "mit_notice", "asis_software"]),
    ("MIT", "grant", ["mit_grant"]),
    ("MIT", "notice", ["mit_released"]),
    ("MIT", "notice", ["mit_licensed"]),
    ("MIT", "title", ["mit_title"]),
    ("MIT", "title", ["mit_title_paren"]),
    ("Apache-2.0", "header", ["apache2_licensed_the", "apache2_comply", "apache2_obtain"]),
    ("Apache-2.0", "notice", ["apache2_licensed_the"]),
    ("Apache-2.0", "notice", ["apache2_licensed"]),
    ("Apache-2.0", "title", ["apache2_title"]),
    ("GPL-3.0", "header", ["gpl_free", "gpl_received"]),
    ("GPL-3.0", "grant", ["gpl_free"]),
    ("GPL-3.0", "notice", ["gpl3_work"]),
    ("GPL-3.0", "notice", ["gpl3_licensed"]),
    ("GPL-2.0", "grant", ["gpl2_free"]),
    ("BSD-3-Clause", "full text", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", "full text", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("CC-BY-NC-4.0", "notice", ["ccbync4_licensed"]),
    ("CC-BY-NC-4.0", "notice", ["ccbync4_work"]),
    ("CC-BY-4.0", "notice", ["ccby4_licensed"]),
    ("CC-BY-4.0", "notice", ["ccby4_work"]),
    ("CC-BY-SA-4.0", "notice", ["ccbysa4_licensed"]),
    ("CC0-1.0", "notice", ["cc0_licensed"]),
    ("MPL-2.0", "notice", ["mpl2_subject"]),
    ("Unlicense", "full text", ["unlicense", "unlicense_anyone"]),
    ("Unlicense", "notice", ["unlicense"]),
    ("MIT", "notice", ["mit_this"]),
    ("MIT", "notice", ["mit_software"]),
    ("MIT", "notice", ["mit_source"]),
    ("Apache-2.0", "full text", ["apache2_title", "apache2_terms", "apache2_copyright_grant"]),
    ("Apache-2.0", "header", ["apache2_asf", "apache2_asf_licenses"]),
    ("Apache-2.0", "header", ["apache2_comply", "apache2_obtain"]),
    ("Apache-2.0", "notice", ["apache2_this"]),
    ("GPL-3.0", "title", ["gpl3_title"]),
    ("GPL-2.0", "title", ["gpl2_title"]),
    ("GPL-2.0-only", "grant", ["gpl2_only"]),
    ("LGPL-3.0", "header", ["lgpl3_free", "lgpl_received"]),
    ("LGPL-3.0", "grant", ["lgpl3_free"]),
    ("LGPL-3.0", "notice", ["lgpl3_licensed"]),
    ("LGPL-3.0", "title", ["lgpl3_title"]),
    ("LGPL-2.1", "header", ["lgpl21_free", "lgpl_received"]),
    ("LGPL-2.1", "grant", ["lgpl21_free"]),
    ("LGPL-2.1", "title", ["lgpl21_title"]),
    ("AGPL-3.0", "header", ["agpl3_free", "agpl_received"]),
    ("AGPL-3.0", "grant", ["agpl3_free"]),
    ("AGPL-3.0", "notice", ["agpl3_licensed"]),
    ("AGPL-3.0", "title", ["agpl3_title"]),
    ("BSD-4-Clause", "full text", ["bsd_redistribution", "bsd_advertising"]),
    ("BSD-3-Clause", "notice", ["bsd3_licensed"]),
    ("BSD-3-Clause", "notice", ["bsd_style"]),
    ("BSD-3-Clause", "title", ["bsd3_title"]),
    ("BSD-2-Clause", "notice", ["bsd2_licensed"]),
    ("BSD-2-Clause", "title", ["bsd2_title"]),
    ("ISC", "full text", ["isc_grant", "isc_asis"]),
    ("ISC", "full text", ["isc_old_grant", "isc_asis"]),
    ("ISC", "grant", ["isc_grant"]),
    ("ISC", "grant", ["isc_old_grant"]),
    ("ISC", "notice", ["isc_licensed"]),
    ("ISC", "title", ["isc_title"]),
    ("0BSD", "full text", ["bsd0_grant", "isc_asis"]),
    ("Zlib", "full text", ["zlib_asis", "zlib_held", "zlib_grant", "zlib_notice"]),
    ("Zlib", "grant", ["zlib_grant"]),
    ("EPL-2.0", "notice", ["epl2_made"]),
    ("EPL-2.0", "notice", ["epl2_are_made"]),
    ("EPL-2.0", "title", ["epl2_title"]),
    ("EPL-1.0", "notice", ["epl1_made"]),
    ("MPL-2.0", "notice", ["mpl2_licensed"]),
    ("MPL-2.0", "title", ["mpl2_title"]),
    ("BSL-1.0", "full text", ["bsl_title", "bsl_grant"]),
    ("BSL-1.0", "grant", ["bsl_grant"]),
    ("BSL-1.0", "notice", ["bsl_distributed"]),
    ("CC-BY-4.0", "title", ["ccby4_title"]),
    ("CC-BY-SA-4.0", "notice", ["ccbysa4_work"]),
    ("CC-BY-SA-3.0", "notice", ["ccbysa3_work"]),
    ("CC-BY-3.0", "notice", ["ccby3_work"]),
    ("CC-BY-ND-4.0", "notice", ["ccbynd4_work"]),
    ("CC-BY-NC-SA-4.0", "notice", ["ccbyncsa4_work"]),
    ("CC-BY-NC-ND-4.0", "notice", ["ccbyncnd4_work"]),
    ("CC0-1.0", "title", ["cc0_title"]),
    ("WTFPL", "title", ["wtfpl_title"]),
    ("PSF-2.0", "notice", ["psf_licensed"]),
    ("Artistic-2.0", "title", ["artistic2_title"]),
    ("Artistic-1.0-Perl", "notice", ["artistic_perl"]),
]
#: Ends of sentences: a line break, or one of . ! ? ; : before a blank or the end.  A dot inside "2.0" ends nothing.
SENTENCE_END = r"[.!?;:]+(?:\s+|$)|\n+"
#: What comments begin their lines with and would be a word or a sentence's end; other signs are dropped in any case.
COMMENT_START = r"(?m)^[ \t]*(?:dnl|@?rem|;+)(?:[ \t]+|$)"
#: A text without any of these words holds no known sentence (checked when this module is loaded).
ANCHORS = ("licen", "permission", "redistribution", "redistribute", "warranty", "copyright", "software", "cc0", "terms and conditions", "damages", "notice", "disclaim", "acknowledgement", "misrepresented", "mpl")


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normal(text): name for name, text in SENTENCES.items()}
assert all(any(a in text for a in ANCHORS) for text in KNOWN)


def _parts(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence -> identifier; a known sentence with sentence ends inside is cut as texts are."""
    out = {}
    for name, text in sentences.items():
        pieces = [normal(x) for x in re.split(SENTENCE_END.replace("$", r"\Z"), text)]
        pieces = [x for x in pieces if x]
        for k, x in enumerate(pieces):
            out.setdefault(x, name if k == len(pieces) - 1 else f"{name}#{k}")
    return out


def sentences_in(text: Column, table: dict[str, str]) -> Column:
    """The known sentences of a text in order, normalised; of those that begin at one place the longest."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]+", " ")), COMMENT_START, "")
    # No capitals are left, so Z can stand for the end of a sentence; a line break is one unless a known sentence runs over it.
    ended = F.regexp_replace(plain, r"[.!?;:]+(?:\s+|$)", "Z")
    for pattern, by in ((r"[^a-z0-9Z\n]+", " "), (r" ?([Z\n]) ?", "$1"), (r"\n{2,}", "Z")):
        ended = F.regexp_replace(ended, pattern, by)
    over_lines = lambda s: s.replace(" ", r"[ \n]") if re.search("[a-z]", s) else s
    longest_first = "|".join(over_lines(s) for s in sorted(table, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(F.trim(ended), F.lit(rf"(?<![^Z\n])(?:{longest_first})(?![^Z\n])"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, "\n", " "))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sentences: dict[str, str] = SENTENCES, rules=RULES, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Per input row the ``keep`` columns, sentence_ids (array of identifiers in order) and licences (sorted array of licence:rule).

    Own ``sentences`` need ``anchors`` of which each sentence holds one, in lower case.  Null and empty texts have none.
    A licence is named once, by its first rule that holds.  Repeated rows stay; other columns are dropped; ``keep`` must
    not hold the new names.
    """
    if clash := set(keep) & {"sentence_ids", "licences", "__text"}:
        raise ValueError(f"clashing names: {sorted(clash)}")
    table = _parts(sentences)
    known = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    body = F.coalesce("__text", F.lit(""))
    gate = body.rlike("(?i)" + "|".join(map(re.escape, anchors)))
    found = F.transform(sentences_in(body, table), lambda s: F.try_element_at(known, s))
    ids = F.when(gate, found).otherwise(F.array().cast("array<string>"))
    df = df.select(*keep, df[text].alias("__text")).select(*keep, F.explode(F.array(ids)).alias("sentence_ids"))
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    by_licence: dict[str, Column] = {}
    for licence, rule, sequence in rules:
        holds = line.rlike(r"[|]" + r"[|](?:[^|]*[|])*".join(map(re.escape, sequence)) + r"[|]")
        name = F.lit(f"{licence}:{rule}")
        by_licence[licence] = by_licence[licence].when(holds, name) if licence in by_licence else F.when(holds, name)
    named = F.array_sort(F.array_compact(F.array(*by_licence.values())))
    return df.select(*keep, "sentence_ids", F.when(F.size("sentence_ids") > 0, named).otherwise(F.array().cast("array<string>")).alias("licences"))


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(doc_id, F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def oracle_sql(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """DuckDB SQL for digests(scan(documents)) where no known sentence runs over a line break."""
    table = _parts(sentences)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    keys, names = (", ".join(map(quote, x)) for x in zip(*sorted(table.items())))
    by_licence: dict[str, list[str]] = {}
    for licence, rule, sequence in rules:
        pattern = r"[|]" + r"[|](?:[^|]*[|])*".join(map(re.escape, sequence)) + r"[|]"
        by_licence.setdefault(licence, []).append(f"WHEN regexp_matches(line, {quote(pattern)}) THEN {quote(f'{licence}:{rule}')}")
    cases = ", ".join(f"CASE {' '.join(x)} END" for x in by_licence.values())
    ends = SENTENCE_END.replace("$", r"\z")
    return rf"""
WITH cut AS (
  SELECT doc_id, list_transform(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]+', ' ', 'g')), '{ends}'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS parts
  FROM documents),
ids AS (SELECT doc_id, list_transform(list_filter(parts, lambda s: list_contains([{keys}], s)), lambda s: [{names}][list_position([{keys}], s)]) AS found FROM cut),
lines AS (SELECT doc_id, found, '|' || array_to_string(found, '|') || '|' AS line FROM ids)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_sentences, coalesce(array_to_string(found, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), ','), '') AS licences
FROM lines"""
