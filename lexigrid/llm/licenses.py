"""License scans: known sentences become identifiers, and identifier sequences licences.

DataFrame functions only, and no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import ascii_lower, table

#: Sentences of public licences and notices, normalised.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-notice-3": "this project is licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "licensed under the bsd license",
    "bsd3-notice": "licensed under the bsd 3 clause license",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-url-2": "https www apache org licenses license 2 0",
    "apache-define": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache-licensor": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "apache-terms": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-2": "licensed under the gnu general public license version 3",
    "gpl2-notice": "licensed under the gnu general public license version 2",
    "gpl-grant-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-grant-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-notice": "licensed under the gnu lesser general public license version 3",
    "agpl-notice": "licensed under the gnu affero general public license version 3",
    "gpl-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl2-preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "agpl3-preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl3-preamble": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl-grant-21": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "ccby-notice": "licensed under cc by 4 0",
    "ccby-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa-notice": "licensed under cc by sa 4 0",
    "ccbysa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync-notice": "licensed under cc by nc 4 0",
    "ccbync-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-notice": "licensed under cc0 1 0",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
}


@dataclass(frozen=True)
class LicenseRule:
    """A licence, its class, and sequences of sentences any of which shows it."""

    name: str
    kind: str
    sequences: tuple[tuple[str, ...], ...]


#: In order: the first rule that a text meets is its main licence.
RULES = (
    LicenseRule("AGPL-3.0", "copyleft", (("agpl-notice",), ("gpl-verbatim", "agpl3-preamble"))),
    LicenseRule("GPL-3.0", "copyleft", (("gpl3-notice",), ("gpl3-notice-2",), ("gpl-grant-3", "gpl-warranty"), ("gpl-verbatim", "gpl3-preamble"))),
    LicenseRule("GPL-2.0", "copyleft", (("gpl2-notice",), ("gpl-grant-2", "gpl-warranty"), ("gpl-verbatim", "gpl2-preamble"))),
    LicenseRule("LGPL-3.0", "copyleft", (("lgpl-notice",), ("gpl-verbatim", "lgpl3-preamble"))),
    LicenseRule("LGPL-2.1", "copyleft", (("lgpl-grant-21",),)),
    LicenseRule("MPL-2.0", "copyleft", (("mpl-notice", "mpl-copy"), ("mpl-notice", "mpl-copy-2"))),
    LicenseRule("CC-BY-NC-4.0", "noncommercial", (("ccbync-notice",), ("ccbync-long",))),
    LicenseRule("CC-BY-SA-4.0", "copyleft", (("ccbysa-notice",), ("ccbysa-long",))),
    LicenseRule("CC-BY-4.0", "permissive", (("ccby-notice",), ("ccby-long",))),
    LicenseRule("Apache-2.0", "permissive", (("apache-notice",), ("apache-header",), ("apache-terms", "apache-see"), ("apache-define", "apache-licensor"))),
    LicenseRule("BSD-3-Clause", "permissive", (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ("bsd3-notice",))),
    LicenseRule("BSD-2-Clause", "permissive", (("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-notice",))),
    LicenseRule("MIT", "permissive", (("mit-notice",), ("mit-notice-2",), ("mit-notice-3",), ("mit-grant", "mit-condition", "mit-warranty"))),
    LicenseRule("ISC", "permissive", (("isc-grant", "isc-warranty"),)),
    LicenseRule("CC0-1.0", "permissive", (("cc0-notice",),)),
    LicenseRule("Unlicense", "permissive", (("unlicense-grant",),)),
    LicenseRule("Proprietary", "reserved", (("rights-reserved",),)),
)

#: Every known sentence holds one of these words, so texts without them are not taken apart.
TRIGGER = r"licen[sc]e|permission|warrant|redistribut|copyright|unencumbered|rights|with this program|the mpl was not"
#: What parts sentences: a full stop, question or exclamation mark before white space or the end, a colon at
#: the end of a line, and lines without a letter or digit. Versions such as 2.0 stay whole.
ENDERS = r"[.!?]+(?:[\x20\x09-\x0D]+|$)|:[\x20\x09\r]*\n|\n[^a-z0-9\n]*\n"


def openings(sentences: dict[str, str] = SENTENCES) -> str:
    """A pattern of line ends before the first words of a long known sentence, which so is parted from a title above it."""
    firsts = sorted({tuple(line.split()[:3]) for line in sentences.values() if len(line.split()) >= 12})
    return r"\n[^a-z0-9\n]*(" + "|".join(r"[^a-z0-9\n]+".join(words) for words in firsts) + ")"


def normalise(sentence: Column) -> Column:
    """The letters and digits of a lower-case sentence in words parted by one space."""
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def scan_licenses(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[LicenseRule, ...] = RULES) -> DataFrame:
    """docs with sentence_ids (array), licenses (array of names in the order of rules) and license_kind.

    A text is parted at sentence ends, at empty lines, also ones of comment marks
    alone, and before lines that begin as a known long sentence does; a part that
    is no known sentence is parted at its line ends. So notices count on a line
    of their own, and sentences that were wrapped count as a whole, also below a
    title or copyright line. A licence is found where one of its sequences of
    identifiers occurs without another known sentence between. license_kind is
    the first licence's, else "unknown" with known sentences and "none" without.
    A sequence that lies in a longer one of another rule counts for both. Null
    and empty texts have none; repeated notices stay repeated in sentence_ids.
    Whole texts are read, in one pass, however long; an empty table gives an
    empty one; columns of docs with these names are replaced.
    """
    whole = F.regexp_replace(ascii_lower(F.coalesce(F.col(text), F.lit(""))), openings(sentences), "\n\n$1")
    known = F.create_map(*(F.lit(x) for name, line in sentences.items() for x in (line, name)))
    names = lambda part: F.try_element_at(known, normalise(part))
    of_part = lambda part: F.when(names(part).isNotNull(), F.array(names(part))).otherwise(F.transform(F.split(part, "\n"), names))
    nothing = F.array().cast("array<string>")
    ids = F.when(F.rlike(ascii_lower(F.col(text)), F.lit(TRIGGER)), F.filter(F.flatten(F.transform(F.split(whole, ENDERS), of_part)), lambda x: x.isNotNull())).otherwise(nothing)
    step = docs.withColumn("sentence_ids", ids).withColumn("__line", F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" ")))
    meets = lambda rule: F.greatest(F.lit(False), *(F.contains(F.col("__line"), F.lit(f" {' '.join(s)} ")) for s in rule.sequences))
    step = step.withColumn("licenses", F.array_compact(F.array(*(F.when(meets(r), F.lit(r.name)) for r in rules))))
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.kind)))
    kind = F.when(F.size("licenses") > 0, F.try_element_at(kinds, F.get("licenses", 0))).when(F.size("sentence_ids") > 0, "unknown").otherwise("none")
    return step.withColumn("license_kind", kind).drop("__line")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("sentence_ids").cast("bigint").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "license_kind",
    )


def _oracle() -> str:
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    norm = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(f"('{name}', '{line}')" for name, line in SENTENCES.items())
    seqs = ", ".join(f"({i}, '{r.name}', '{r.kind}', ' {' '.join(s)} ')" for i, r in enumerate(RULES) for s in r.sequences)
    return rf"""
WITH k(name, line) AS (VALUES {known}), q(no, license, kind, seq) AS (VALUES {seqs}),
p AS (SELECT doc_id, part, i FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT doc_id, string_split_regex(regexp_replace({lower("coalesce(text, '')")}, '{openings()}', chr(10) || chr(10) || '\1', 'g'), '{ENDERS}') AS parts FROM documents))),
w AS (SELECT p.*, k.name FROM p LEFT JOIN k ON k.line = {norm("part")}),
l AS (SELECT doc_id, i, unnest(string_split(part, chr(10))) AS line, unnest(range(1, len(string_split(part, chr(10))) + 1)) AS j FROM w WHERE name IS NULL),
f AS (SELECT doc_id, i, 0 AS j, name FROM w WHERE name IS NOT NULL
      UNION ALL SELECT doc_id, i, j, k.name FROM l JOIN k ON k.line = {norm("l.line")}),
s AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY i, j) AS ids, ' ' || string_agg(name, ' ' ORDER BY i, j) || ' ' AS seqs FROM f GROUP BY doc_id),
r AS (SELECT DISTINCT doc_id, no, license, kind FROM s JOIN q ON contains(s.seqs, q.seq)),
g AS (SELECT doc_id, string_agg(license, ',' ORDER BY no) AS licenses, arg_min(kind, no) AS kind FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses,
       CASE WHEN g.kind IS NOT NULL THEN g.kind WHEN n > 0 THEN 'unknown' ELSE 'none' END AS license_kind
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()


def untriggered() -> list[str]:
    """Known sentences that the trigger would miss; there must be none."""
    return [name for name, line in SENTENCES.items() if not re.search(TRIGGER, line)]
