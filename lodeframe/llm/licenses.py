"""Licence scans by sentence rules.

Marks of comments at the start of lines are taken off, and a text is cut into sentences: at
full stops and the like before white space, and at empty lines. Lines of a sentence belong together, so it
does not matter how it is wrapped. What starts at the start of a line is normalised (A-Z
lower-cased, each run of other characters than a-z and 0-9 a space) and has the identifier of the longest
catalogued sentence that it begins with, at a word's end. ``This file is released under the`` and the like stand for
``licensed under the``; where a holder is named within a sentence, any words will do. Tags of the form
``SPDX-License-Identifier: ...`` have one identifier for each licence of their expression; what
follows ``WITH`` is an exception and none. The identifiers of a text, in text order,
are matched against ordered licence rules: a rule is a sequence of identifiers that must
follow each other with no other identifier between them. Rules are tried in order, and
the sentences that a rule takes are not seen by later rules.

Null, empty and other texts without a known sentence give a row with empty arrays and the
verdict ``none``. Every row is judged by itself, so repeated rows repeat; extra columns
are not looked at; an empty table gives no rows. Long texts and sentences are used whole: a line is looked at with
as many lines after it as the longest catalogued sentence has words, and can be no longer.
All on DataFrame functions; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import ascii_lower

# How sentences of public licence texts start, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "Apache2Line",
    "licensed under the apache license version 2 0 the license": "Apache2Grant",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "Apache2Whole",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "you may obtain a copy of the license at": "Apache2Obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "Apache2Basis",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2See",
    "apache license version 2 0": "Apache2Title",
    "released under the mit license": "MITLine",
    "licensed under the mit license": "MITLine",
    "this project is licensed under the mit license": "MITLine",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind": "MITWarranty",
    "this work is licensed under the gnu general public license version 3": "GPL3Line",
    "licensed under the gnu general public license version 3": "GPL3Line",
    "licensed under the gnu general public license version 2": "GPL2Line",
    "licensed under cc by nc 4 0": "CCBYNC4Line",
    "licensed under cc by 4 0": "CCBY4Line",
    "licensed under cc by sa 4 0": "CCBYSA4Line",
    "licensed under cc0 1 0": "CC0Line",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this software is provided by the copyright holders and contributors as is": "BSDWarranty",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "ZlibGrant",
    "licensed under the creative commons attribution 4 0 international license": "CCBY4Line",
    "licensed under the creative commons attribution sharealike 4 0 international license": "CCBYSA4Line",
    "licensed under the creative commons attribution noncommercial 4 0 international license": "CCBYNC4Line",
    "licensed under the apache license 2 0": "Apache2Line",
    "licensed under the bsd 3 clause license": "BSD3Line",
    "licensed under the bsd 2 clause license": "BSD2Line",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ISCGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "ISCGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCNotice",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCNotice",
    "the software is provided as is and the author disclaims all warranties": "ISCWarranty",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2Grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "EPL2Grant",
    "boost software license version 1 0": "BSL1Title",
    "distributed under the boost software license version 1 0": "BSL1Title",
    "all rights reserved": "AllRights",
    "copyright": "Copyright",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
}
# The grants of the GNU licences, by a rule: licence, name, versions.
for _name, _short, _versions in (("general public license", "GPL", ("2", "3")), ("lesser general public license", "LGPL", ("2.1", "3")), ("affero general public license", "AGPL", ("3",))):
    for _thing in ("program", "library", "software", "file"):
        _grant = f"this {_thing} is free software you can redistribute it and or modify it under the terms of the gnu {_name} as published by the free software foundation"
        SENTENCES[_grant] = f"{_short}Grant"
        for _version in _versions:
            _number, _id = _version.replace(".", " "), f"{_short}{_version}"
            SENTENCES[f"{_grant} version {_number}"] = f"{_id}Only"
            SENTENCES[f"{_grant} either version {_number} of the license or at your option any later version"] = f"{_id}OrLater"
# Short names of versions, by a rule.
SENTENCES |= {f"licensed under the {gnu}gpl{sep}{n}": f"GPL{n}Line" for gnu in ("", "gnu ") for sep in (" v", "v", " version ") for n in "23"}
#: Sentences that name a holder, normalised, as a pattern: what stands between is any words. Where the name ends in a full stop, the catalogue has the rest.
NAMED = "^neither the names? of (?:[a-z0-9]+ )+?nor the names? of (?:(?:its|their|any|the) )?contributors may be used to endorse or promote products derived from this software without specific prior written permission "
NAMED_ID = "BSDEndorse"
#: What is said before the licence's name, and what the catalogue says for it.
SUBJECT, SAID = "^this [a-z]+ is (?:licensed|released|distributed|made available) under (?:the terms of )?(?:the|a) ", "licensed under the "
# Identifiers of licences in tags, as the public list of such has them; old ones with what they mean.
TAGS = {t.lower(): t for t in "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()}
TAGS |= {f"{old}{end}": f"{old.upper()}{new}" for old in ("agpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0") for end, new in (("", "-only"), ("+", "-or-later"))}
# Licences and the sequences of identifiers that show them, in the order in which they are tried.
RULES = [
    *[("Apache-2.0", [*head, *tail]) for tail in (["Apache2Basis", "Apache2See"], ["Apache2See"], []) for head in (["Apache2Whole", "Apache2Comply", "Apache2Obtain"], ["Apache2Whole", "Apache2Obtain"])],
    ("Apache-2.0", ["Apache2Grant", "Apache2Comply", "Apache2Obtain", "Apache2Basis", "Apache2See"]),
    ("Apache-2.0", ["Apache2Grant", "Apache2Comply", "Apache2Obtain", "Apache2See"]),
    ("Apache-2.0", ["Apache2Grant", "Apache2Comply", "Apache2Obtain"]),
    ("MIT", ["MITGrant", "MITNotice", "MITWarranty"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDEndorse", "BSDWarranty"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDWarranty"]),
    ("Zlib", ["ZlibWarranty", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant"]),
    ("ISC", ["ISCNotice", "ISCWarranty"]),
    ("ISC", ["ISCNotice"]),
    ("0BSD", ["ISCGrant"]),
    ("MPL-2.0", ["MPL2Grant"]),
    ("EPL-2.0", ["EPL2Grant"]),
    *[(f"{lic}-{v if '.' in v else v + '.0'}-{end}", [f"{lic}{v}{name}"]) for lic, vs in (("GPL", ("3", "2")), ("LGPL", ("3", "2.1")), ("AGPL", ("3",))) for v in vs for end, name in (("or-later", "OrLater"), ("only", "Only"))],
    ("Apache-2.0", ["Apache2Line"]),
    ("Apache-2.0", ["Apache2Grant"]),
    ("Apache-2.0", ["Apache2Whole"]),
    ("Apache-2.0", ["Apache2Title"]),
    ("MIT", ["MITLine"]),
    ("MIT", ["MITGrant"]),
    ("GPL-3.0-only", ["GPL3Line"]),
    ("GPL-2.0-only", ["GPL2Line"]),
    ("CC-BY-NC-4.0", ["CCBYNC4Line"]),
    ("CC-BY-SA-4.0", ["CCBYSA4Line"]),
    ("CC-BY-4.0", ["CCBY4Line"]),
    ("CC0-1.0", ["CC0Line"]),
    ("BSD-3-Clause", ["BSD3Line"]),
    ("BSD-2-Clause", ["BSD2Line"]),
    ("BSL-1.0", ["BSL1Title"]),
    ("Unlicense", ["UnlicenseGrant"]),
    *[(name, [f"SPDX-{name}"]) for name in sorted(set(TAGS.values()))],
    ("LicenseRef-all-rights-reserved", ["Copyright", "AllRights"]),
]
# Words of which every catalogued sentence has one; texts without any need no cutting.
ANCHORS = ("licen", "copyright", "permission", "permitted", "warranty", "software", "reserved", "redistributions", "gpl")

GATE = "(?i)" + "|".join(ANCHORS)
#: Comment marks before a line, and after it.
MARKS, ENDS = "(?m)^[ \\t]*(?:/\\*+|\\*+/|\\*+|//+|#+|--+|;+|<!--+|%+)?[ \\t]*", "(?m)[ \\t]*(?:\\*+/|--+>)[ \\t]*$"
STOP, JUNK = "[.!?]+[ \\t\\n]+|\\n[ \\t]*\\n", "[^a-z0-9]+"
TAG = "spdx-license-identifier:[ \\t]*([a-z0-9.+() \\t-]*)"
#: Words of the longest catalogued sentence; it spans no more lines than that, as empty ones end it.
MOST_LINES = max(s.count(" ") + 1 for s in SENTENCES)
NOTICE = "^copyright (?:c |[0-9]{4})"
FIRST_WORD = "^(?:" + "|".join(sorted({s.split(" ")[0] for s in SENTENCES} | {"neither"})) + ")(?: |$)"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, JUNK, " "))


def tagged(line: Column) -> Column:
    """Identifiers of a line with a tag: one for each licence of its expression."""
    words = F.filter(F.split(F.regexp_extract(line, TAG, 1), "[() \\t]+"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for tag, name in TAGS.items() for x in (tag, f"SPDX-{name}")])
    wanted = F.filter(words, lambda w, i: ~w.isin("and", "or", "with") & ((i == 0) | ~F.coalesce(F.get(words, i - 1) == "with", F.lit(False))))
    return F.transform(wanted, lambda w: F.coalesce(F.element_at(known, w), F.lit("SPDXOther")))


def identifier(words: Column) -> Column:
    """The identifier of the longest catalogued sentence that normalised words begin with, null if none."""
    ended = F.concat(F.regexp_replace(words, SUBJECT, SAID), F.lit(" "))
    out = F.when(ended.startswith("neither "), F.when(ended.rlike(NAMED), NAMED_ID))
    for start in sorted(SENTENCES, key=lambda s: (-len(s), s)):
        out = out.when(ended.startswith(f"{start} "), F.lit(SENTENCES[start]))
    return out


def identifiers(text: Column) -> Column:
    """All identifiers of a text in its order."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_lower(text), "\\r\\n?", "\n"), MARKS, ""), ENDS, ""), STOP, "\u0001")

    def of(sentence: Column) -> Column:
        lines = F.transform(F.split(sentence, "\n"), lambda s: F.struct(s.alias("raw"), normalised(s).alias("words")))
        lines = F.filter(lines, lambda s: s["words"] != "")

        def one(line: Column, i: Column) -> Column:
            rest = F.array_join(F.transform(F.slice(lines, i + 1, MOST_LINES), lambda s: s["words"]), " ")
            found = F.when(line["words"].rlike(FIRST_WORD), identifier(rest))
            # Within a sentence, as where a line of a wrapped notice happens to start so, the word alone is no notice, and what follows a name was seen with it.
            found = F.when((i == 0) | ((found != "Copyright") | line["words"].rlike(NOTICE)) & ~rest.startswith("nor "), found)
            return F.when(line["raw"].contains("spdx-license-identifier:"), tagged(line["raw"])).when(found.isNotNull(), F.array(found)).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(lines, one))

    return F.flatten(F.transform(F.split(plain, "\u0001"), of))


def matched(identifiers: Column) -> Column:
    """Names of the rules that match an array of identifiers, in the order of the rules.

    The identifiers stand between bars in one string, so that a rule is a substring; what a
    rule has taken is replaced by a mark that no later rule can match across.
    """
    state = F.struct(F.concat(F.lit("|"), F.array_join(F.transform(identifiers, lambda i: F.concat(i, F.lit("|"))), "|"), F.lit("|")).alias("s"), F.array().cast("array<string>").alias("got"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in ids)).alias("ids")) for name, ids in RULES])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["s"], rule["ids"])
        return F.when(hit, F.struct(F.replace(acc["s"], rule["ids"], F.lit("#")).alias("s"), F.concat(acc["got"], F.array(rule["name"])).alias("got"))).otherwise(acc)

    return F.array_distinct(F.aggregate(rules, state, step)["got"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, identifiers, licenses, verdict of every row; the last is the first licence, ``unknown`` or ``none``."""
    text, none = F.col("text").cast("string"), F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(GATE), text).alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.when(F.col("text").isNotNull(), identifiers(F.col("text"))), none).alias("identifiers"))
    rows = rows.select("doc_id", "identifiers", F.when(F.size("identifiers") > 0, matched(F.col("identifiers"))).otherwise(none).alias("licenses"))
    verdict = F.when(F.size("licenses") > 0, F.col("licenses")[0]).when(F.size("identifiers") > 0, "unknown").otherwise("none")
    return rows.select("doc_id", F.size("identifiers").cast("long").alias("n_known"), F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"), verdict.alias("verdict"))


def _oracle() -> str:
    """The same in SQL, by rows: one for each line, joined to the catalogue; rules are tried one after the other."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in SENTENCES.items())
    tags = ", ".join(f"({quoted(k)}, {quoted('SPDX-' + v)})" for k, v in TAGS.items())
    steps, last = [], "r0"
    for n, (name, ids) in enumerate(RULES, 1):
        mark = quoted("".join(f"|{i}|" for i in ids))
        steps.append(f"r{n} as (select rid, replace(st, {mark}, '#') as st, case when contains(st, {mark}) then list_append(got, '{name}') else got end as got from {last})")
        last = f"r{n}"
    return f"""
with known(start_, id) as (values {known}),
tags(tag, id) as (values {tags}),
raw as (
  select row_number() over () as rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
plain as (
  select rid, regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '{MARKS}', '', 'g'), '{ENDS}', '', 'g') as t
  from raw where regexp_matches(t, '{"|".join(ANCHORS)}')),
cut as (select rid, unnest(string_split(regexp_replace(t, '{STOP}', chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(t, '{STOP}', chr(1), 'g'), chr(1)), 1) as k from plain),
line0 as (select rid, k, unnest(string_split(s, chr(10))) as raw_, generate_subscripts(string_split(s, chr(10)), 1) as i from cut),
line1 as (select rid, k, raw_, trim(regexp_replace(raw_, '{JUNK}', ' ', 'g')) as w, i from line0),
line as (
  select *, regexp_replace(string_agg(w, ' ') over (partition by rid, k order by i rows between current row and {MOST_LINES - 1} following) || ' ', '{SUBJECT}', '{SAID}') as rest,
    row_number() over (partition by rid, k order by i) as at_
  from line1 where w <> ''),
spdx as (
  select rid, k, i, unnest(words) as w, generate_subscripts(words, 1) as j, words
  from (select rid, k, i, list_filter(regexp_split_to_array(regexp_extract(raw_, '{TAG}', 1), '[() \\t]+'), lambda x: x <> '') as words from line where contains(raw_, 'spdx-license-identifier:'))),
ids as (
  select rid, k, i, 0 as j, arg_max(id, length(start_)) as id from line join known on starts_with(rest, start_ || ' ')
  where not contains(raw_, 'spdx-license-identifier:') group by rid, k, i, at_, w
  having at_ = 1 or (arg_max(id, length(start_)) <> 'Copyright' or regexp_matches(w, '{NOTICE}')) and arg_max(start_, length(start_)) not like 'nor %'
  union all
  select rid, k, i, 0, '{NAMED_ID}' from line where regexp_matches(rest, '{NAMED}') and not contains(raw_, 'spdx-license-identifier:')
  union all
  select rid, k, i, j, coalesce(id, 'SPDXOther') from spdx left join tags on w = tag
  where w not in ('and', 'or', 'with') and (j = 1 or words[j - 1] <> 'with')),
r0 as (select rid, list(id order by k, i, j) as ids, string_agg('|' || id || '|', '' order by k, i, j) as st, []::varchar[] as got from ids group by rid),
{", ".join(steps)},
d as (select rid, r0.ids, list_filter(l.got, lambda x, i: list_position(l.got, x) = i) as got from {last} l join r0 using (rid))
select doc_id, coalesce(len(ids), 0)::bigint as n_known, coalesce(array_to_string(ids, ','), '') as identifiers, coalesce(array_to_string(got, ','), '') as licenses,
  case when len(got) > 0 then got[1] when len(ids) > 0 then 'unknown' else 'none' end as verdict
from raw left join d using (rid)
"""


ORACLE = _oracle()
