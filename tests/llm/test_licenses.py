import random

import pytest
from tests.llm import data

from voxstrata.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(16)
    return licenses.train(data.frame(spark, [(i, data.text(rng, 60), "en", "a", 0) for i in range(60)]))


def scan(spark, model, texts):
    df = data.clashing(data.frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)]))
    return {r.doc_id: r for r in licenses.scan_documents(df, model).collect()}


def sure(row):
    return [f.family for f in row.findings if f.confirmed]


def test_notices_in_prose(spark, model):
    rng = random.Random(17)
    cases = [(family, notice) for family, notices in licenses.NOTICES.items() for notice in notices]
    texts = [f"{data.text(rng, 30)}\n{notice.upper()}.\n{data.text(rng, 90)}" for _, notice in cases]
    got = scan(spark, model, texts)
    right = sum(sure(got[i]) == [family] for i, (family, _) in enumerate(cases))
    assert right >= 0.95 * len(cases)


def test_notice_inside_a_long_paragraph(spark, model):
    rng = random.Random(18)
    got = scan(spark, model, [f"{data.text(rng, 200)} released under the mit license {data.text(rng, 200)}"])
    assert set(sure(got[0])) == {"mit"}


def test_wrapped_notices(spark, model):
    rng = random.Random(21)
    cases = [
        ("apache-2.0", "Licensed under the Apache License,\nVersion 2.0"),
        ("proprietary", "All rights\n  reserved"),
        ("gpl-3.0", "This work is licensed under the GNU General\r\nPublic License, version 3"),
        ("gpl-2.0", "This work is licensed under the GNU General\nPublic License, version 2"),
    ]
    texts = [f"{data.text(rng, 30)}\n\n{notice}.\n \n{data.text(rng, 90)}" for _, notice in cases]
    texts += [f"{data.text(rng, 8)}\n{data.text(rng, 8)}\n{cases[0][1]}\n{data.text(rng, 8)}", "Released under the MIT license.\nLicensed under the ISC license.", "All rights\n\nreserved"]
    got = scan(spark, model, texts)
    assert [set(sure(got[i])) for i in range(4)] == [{family} for family, _ in cases]
    assert set(sure(got[4])) == {"apache-2.0"} and set(sure(got[5])) == {"mit", "isc"} and sure(got[6]) == []


def test_clean_and_scrambled_texts(spark, model):
    rng = random.Random(19)
    texts = [data.text(rng, 200) for _ in range(30)] + ["the license of the version", "version 2.0 public general the under", "mit and apache are names", "all rights are reserved for members by law and custom"]
    got = scan(spark, model, texts)
    assert [sure(r) for r in got.values()] == [[]] * len(texts)


def test_awkward_rows(spark, model):
    rows = data.awkward(random.Random(20))
    got = licenses.scan_documents(data.frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert all(r.n_windows == 0 and not r.findings for r in got if r.doc_id in {x[0] for x in rows if not (x[1] or "").strip()})
    assert licenses.scan_documents(data.empty(spark), model).count() == 0


def test_training_is_repeatable_and_works_without_documents(spark):
    a, b = licenses.train(data.empty(spark)), licenses.train(data.empty(spark))
    assert (a.weights == b.weights).all() and a.temperature == b.temperature
    assert sure(scan(spark, a, ["Licensed under the Apache License, Version 2.0."])[0]) == ["apache-2.0"]


def test_probabilities_are_calibrated_on_fresh_variants(model):
    import numpy as np

    p = model.probabilities(np.array([0]), np.array([0]), 1)
    assert p.shape == (1, len(licenses.FAMILIES)) and np.isclose(p.sum(), 1)
    error, accuracy = licenses.calibration(model)
    assert error <= 0.08 and accuracy >= 0.85, (error, accuracy)


#: Headers as projects write them: holders, wrapping and comment signs aren't in the templates.
HEADERS = {
    "gpl-3.0": """/* frob.c - frobs
 * Copyright (C) 2019 Jane Roe
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */""",
    "gpl-2.0": """# Foo is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.""",
    "lgpl-2.1": """ This library is free software; you can redistribute it and/or
 modify it under the terms of the GNU Lesser General Public
 License as published by the Free Software Foundation; either
 version 2.1 of the License, or (at your option) any later version.

 This library is distributed in the hope that it will be useful,
 but WITHOUT ANY WARRANTY; without even the implied warranty of
 MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "isc": """Copyright (c) 2021, Acme Inc.

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "bsd": """Copyright (c) 2012, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.""",
    "mpl-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "apache-2.0": """Copyright 2018 The Authors. All rights reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "mit": """The MIT License (MIT)

Copyright (c) 2015 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies""",
    "agpl-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
}


def test_headers_of_files(spark, model):
    rng = random.Random(22)
    got = scan(spark, model, [f"{header}\n\n{data.text(rng, 120)}" for header in HEADERS.values()])
    assert {family: set(sure(got[i])) for i, family in enumerate(HEADERS)} == {family: {family} for family in HEADERS}


def test_words_that_two_versions_share_confirm_neither(spark, model):
    got = scan(spark, model, ["distributed under the terms of the GNU General Public License as published by the Free Software Foundation", "licensed under the gnu general public license, version"])
    assert [sure(r) for r in got.values()] == [[], []]


def test_scan_against_window_by_window(spark, model):
    """Brute force: each window of each line by itself, its terms, softmax and bigrams from plain Python sets."""
    import re

    import numpy as np

    rng = random.Random(23)
    texts = [f"{data.text(rng, rng.randrange(1, 90))}\n\n{notice}\n\n{data.text(rng, 10)}" for notice in [*HEADERS.values(), "Released under the MIT License."]]
    texts = [re.sub(r"(?<=\S)[ ]*\n(?=[^\n]*\S)", " ", t) for t in texts]  # one line a paragraph
    got = scan(spark, model, texts)
    index = {int(t): i for i, t in enumerate(model.terms)}
    for i, text in enumerate(texts):
        expected, at = [], 0
        for line in text.split("\n"):
            words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", line.lower())
            starts = range(0, max(1, -(-(len(words) - licenses.WINDOW) // 20) * 20 + 1), 20) if len(words) > licenses.WINDOW else (0,)
            for a in starts if words else ():
                w = licenses._words([" ".join(words[a : a + licenses.WINDOW])])[0]
                terms = {index[int(g)] for grams in licenses._grams(w) for g in grams if int(g) in index}
                if not terms:
                    continue
                z = (model.weights[sorted(terms)].sum(axis=0) + model.bias) / model.temperature
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                if p.argmax() < len(licenses.FAMILIES) - 1 and p.max() >= licenses.MIN_PROBABILITY:
                    expected.append((at + a, len(w), licenses.FAMILIES[p.argmax()], pytest.approx(float(p.max()), abs=1e-4)))
            at += len(words)
        assert [(f.word, f.n_words, f.family, f.probability) for f in got[i].findings] == expected


def test_families_that_are_equally_probable(spark):
    """The query's choice among equal probabilities is the first name."""
    from pyspark.sql import functions as F

    rows = [([("mit", 0.5), ("bsd", 0.5), ("isc", 0.25)],)]
    df = spark.createDataFrame(rows, "sure array<struct<family:string,probability:double>>")
    best = F.element_at(F.array_sort(F.transform("sure", lambda f: F.struct((-f["probability"]).alias("minus"), f["family"].alias("family")))), 1)
    assert df.select(best["family"]).first()[0] == "bsd"


def test_training_ignores_other_columns_and_repeated_texts(spark):
    rng = random.Random(24)
    rows = [(i, data.text(rng, 60), "en", "a", 0) for i in range(20)]
    a = licenses.train(data.frame(spark, rows))
    b = licenses.train(data.clashing(data.frame(spark, rows + rows[:1] * 50)).withColumn("h", data.F.lit(1)))
    assert (a.weights == b.weights).all() and a.temperature == b.temperature
