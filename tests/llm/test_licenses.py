"""The default catalogue: whole licences in any wrapping, behind comment signs, with any holder."""

import re
import textwrap

import pytest

from treeline.llm.licenses import KNOWN, scan

WHOLE = [(name, text) for name, text in KNOWN if len(text) > 300]
COPYRIGHTS = ("# Copyright 2020 X", " * Copyright (c) Some One", "Copyright Some Name", "// (c) 2019 by Me",
              "Copyright José <a@b.c>", "/* Copyright: 2001-2003, A. Name */", "# All rights reserved.")


def _wrapped(text, width, sign=""):
    # A line that is a copyright line in the licence stays one.
    parts = re.split(r"\n[ \t]*\n", text.strip("\n"))
    lines = [x for p in parts for x in (
        p.split("\n") if re.search(r"(?m)^\s*Copyright [(\[]", p) else textwrap.wrap(" ".join(p.split()), width)) + [""]]
    return "\n".join(f"{sign}{x}" for x in lines)


def _licenses(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.license for r in scan(rows).orderBy("doc_id").collect()]


def test_common_licenses_are_known():
    assert {"MIT", "ISC", "0BSD", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause",
            "BSD-3-Clause", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0"} <= {name for name, _ in WHOLE}


@pytest.mark.parametrize("width, sign", [(9999, ""), (64, ""), (47, " * "), (90, "# ")])
def test_whole_texts_in_any_wrapping(spark, width, sign):
    found = _licenses(spark, [_wrapped(text, width, sign) for _, text in WHOLE])
    assert found == [name for name, _ in WHOLE]


def test_copyright_lines_say_nothing(spark):
    mit = next(text for name, text in WHOLE if name == "MIT")
    assert _licenses(spark, [f"{line}\n\n{mit}" for line in COPYRIGHTS]) == ["MIT"] * len(COPYRIGHTS)


def test_sentences_are_no_copyright_lines(spark):
    lines = ["copyright notice of A", "copyrighted work", "(c) You must retain", "copyright holders, 2020"]
    mit = next(text for name, text in WHOLE if name == "MIT")
    assert _licenses(spark, [f"{mit}\n{line}" for line in lines]) == [None] * len(lines)
