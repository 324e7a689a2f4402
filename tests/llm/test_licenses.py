"""Licence notices as they are normally written, wrapped or not."""

import textwrap

import pytest

from lodeframe.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.'
NOTICES = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "MPL-2.0": MPL, "ISC": ISC,
    "GPL-3.0-or-later": GNU.format("program", "General Public License", "3"), "GPL-2.0-or-later": GNU.format("program", "General Public License", "2"),
    "LGPL-2.1-or-later": GNU.format("library", "Lesser General Public License", "2.1"), "AGPL-3.0-or-later": GNU.format("program", "Affero General Public License", "3"),
}


def verdicts(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [(r.verdict, r.licenses) for r in rows]


def wrapped(text, width, mark):
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
    return "\n".join(f"{mark} {line}".rstrip() for line in lines)


@pytest.mark.parametrize("width, mark", [(10_000, ""), (72, ""), (72, " *"), (60, "//"), (40, "#")])
def test_notices(spark, width, mark):
    texts = ["Copyright (c) 2024 Someone\n\n" + wrapped(t, width, mark) for t in NOTICES.values()]
    assert [v for v, _ in verdicts(spark, texts)] == list(NOTICES)


ENDORSE = "3. {} may be used to endorse or promote products derived from this software without specific prior written permission."
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""


@pytest.mark.parametrize("width", [10_000, 72, 40])
def test_named_holders(spark, width):
    names = ["Neither the name of Google Inc. nor the names of its contributors", "Neither the name of the University of Somewhere nor the names of its contributors", "Neither the names of the authors nor the names of their contributors", "Neither the name of X nor the names of contributors"]
    texts = [wrapped(f"{BSD2}\n\n{ENDORSE.format(n)}", width, " *") for n in names] + [wrapped(f"{BSD2}\n\nThe name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", width, "#")]
    assert [found for _, found in verdicts(spark, [*texts, BSD2 + "\n\nNeither the name nor the thing."])] == ["BSD-3-Clause"] * 5 + ["BSD-2-Clause"]


def test_said_otherwise(spark):
    texts = {"This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0", "this file is licensed under the Apache License, Version 2.0": "Apache-2.0", "This program is released under the GNU GPL v3.": "GPL-3.0-only", "Licensed under the GPLv2": "GPL-2.0-only", "This library is made available under the terms of the MIT License": "MIT", ZLIB: "Zlib", "This file is licensed under the Thing": "none"}
    assert [v for v, _ in verdicts(spark, list(texts))] == list(texts.values())


def test_tags(spark):
    tags = {"MIT": "MIT", "MITRE": "", "GPL-3.0-or-later": "GPL-3.0-or-later", "GPL-3.0": "GPL-3.0-only", "gpl-2.0+": "GPL-2.0-or-later", "Apache-2.0 OR MIT": "Apache-2.0,MIT", "(MIT AND BSD-3-Clause)": "BSD-3-Clause,MIT", "GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only"}
    out = verdicts(spark, [f"x\n// SPDX-License-Identifier: {t}\nint a;" for t in tags] + ["/* SPDX-License-Identifier: ISC */"])
    assert [names for _, names in out] == [*tags.values(), "ISC"] and out[1][0] == "unknown"


def test_words_end_and_lines_start(spark):
    texts = ["Released under the MIT Licensed thing", "some line without an end\nReleased under the MIT License\nCopyright X", "we released under the MIT License", "word " * 20_000 + "license", "copyrighted work", "license\n" * 3000]
    assert [v for v, _ in verdicts(spark, texts)] == ["none", "MIT", "none", "none", "none", "none"]


def test_every_sentence_has_an_anchor():
    assert all(any(a in s for a in licenses.ANCHORS) or s.startswith("licensed under cc") for s in licenses.SENTENCES if s != "you may obtain a copy of the license at")
