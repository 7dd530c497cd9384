"""Licence scans of real, wrapped and embedded licence texts, between many texts of other words."""

from __future__ import annotations

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from stopclock.llm import licences

TEXTS, HEADERS = dict(licences.full_texts()), dict(licences.HEADERS)


def prose(seed: int, lines: int = 6) -> str:
    pick = random.Random(seed)
    words = ["the", "of", "and", "to", "in", "is", "for", "with", "this", "that", *(f"word{i}" for i in range(400))]
    return "\n".join(" ".join(pick.choices(words, k=12)) for _ in range(lines))


def commented(text: str, width: int) -> str:
    return "\n".join("# " + line for line in textwrap.wrap(" ".join(text.split()), width))


CASES = [
    *[("LICENSE", text, name, "text") for name, text in TEXTS.items()],
    ("COPYING", TEXTS["MIT"].replace("MIT License\n\n", "").replace("<year> <copyright holders>", "2021 Ada Example"), "MIT", "text"),
    ("rewrapped.txt", textwrap.fill(" ".join(TEXTS["BSD-3-Clause"].split()), 60), "BSD-3-Clause", "text"),
    ("embedded.md", f"{prose(1, 30)}\n\n{TEXTS['ISC']}\n\n{prose(2, 30)}", "ISC", "text"),
    *[(f"{name}.py", f"{commented(text, 70)}\n\n{prose(3, 60)}", name, "text") for name, text in HEADERS.items()],
    ("wrapped.txt", f"{prose(4)}\nThis work is licensed\nunder the GNU General\nPublic License, version 3.\n{prose(5)}", "GPL-3.0", "header"),
    ("title.txt", f"MIT License\n{prose(6)}", "MIT", "header"),
    ("spdx.c", f"// SPDX-License-Identifier: Apache-2.0\n{prose(7)}", "Apache-2.0", "header"),
    ("granted.txt", f"{prose(8)}\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software\n{prose(9)}", "MIT", "header"),
    ("cc.txt", f"Creative Commons Attribution-ShareAlike\n4.0 International Public License\n{prose(10)}", "CC-BY-SA-4.0", "header"),
    ("reserved.txt", f"All rights reserved.\n{prose(11)}\nSPDX-License-Identifier: MIT\n{prose(12)}", "MIT", "header"),
    ("bare.txt", f"{prose(13)}\nAll rights reserved.\n{prose(14)}", "Proprietary", "header"),
    ("liable.txt", f"{prose(15)}\nThe licence fee is not refundable and the seller is liable for damage to the fence.\n{prose(16)}", None, "none"),
]


def test_every_template_has_a_mark():
    assert all(re.search(licences.MARKS, body) for _, body in [*licences.TEMPLATES, *licences.NOTICES, *licences.HEADERS, *TEXTS.items()])


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"f{i}/{name}", text) for i, (name, text, _, _) in enumerate(CASES)] + [(1000 + i, f"p/{i}.txt", prose(100 + i)) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, file string, text string").repartition(4)
    return {r["doc_id"]: r for r in licences.scan_licences(table, F.col("file")).collect()}


@pytest.mark.parametrize("case", range(len(CASES)), ids=[f"{name}-{licence}" for name, _, licence, _ in CASES])
def test_licence_texts_are_named(found, case):
    _, _, licence, how = CASES[case]
    assert (found[case]["licence"], found[case]["how"]) == (licence, how)


def test_prose_has_no_licence(found):
    assert all(found[1000 + i]["how"] == "none" for i in range(1000))
