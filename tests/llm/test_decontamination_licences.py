import random

import numpy as np
import pyarrow as pa
from llm_data import frame, prose

from talkmill.llm import decontamination as D
from talkmill.llm import licences as L


def corpus(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randint(20, 45)).replace(" ", ", ", 1).capitalize() + ".") for k in range(12)]
    items += [(90, None), (91, ""), (None, "an item without an id"), (0, items[0][1])]
    rows = [(k, prose(rng, rng.randint(50, 400)), "s") for k in range(60)]
    planted = {}
    for k in range(0, 40):
        i = k % 12
        words = items[i][1].split()
        if k >= 20:  # edited copies: an eighth of the words replaced, one dropped
            for _ in range(max(1, len(words) // 8)):
                words[rng.randrange(len(words))] = rng.choice(["velvet", "orchard"])
            del words[rng.randrange(len(words))]
        body = rows[k][1].split()
        at = rng.randrange(len(body))
        rows[k] = (k, " ".join(body[:at] + words + body[at:]), "s")
        planted[k] = i
    # one item has leaked into so many documents that its n-grams aren't rare
    rows += [(1000 + k, prose(rng, 30) + " " + items[3][1], "s") for k in range(300)]
    planted |= {1000 + k: 3 for k in range(300)}
    return frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), planted, rows


def test_finds_copies_and_leaves_the_rest(spark):
    docs, items, planted, rows = corpus(spark)
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items).collect()}
    assert set(got) == set(planted.items())
    assert all(r.score == 1.0 for (d, _), r in got.items() if d < 20 or d >= 1000)
    kept = D.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in rows} - set(planted))


def test_finds_edited_copies(spark):
    """Every 4th, 5th or 6th word replaced: as an item's only copy, and beside exact copies that make the broken n-grams the rarer ones."""
    rng = random.Random(12)
    items, rows, want = [], [], set()
    for k in range(18):
        words = [f"{w}{k}" for w in prose(rng, rng.randint(20, 50)).split()]
        items.append((k, " ".join(words)))
        edited = [f"new{k}x{n}" if n % (4 + k % 3) == 1 else w for n, w in enumerate(words)]
        rows.append((k, f"{prose(rng, 40)} {' '.join(edited)} {prose(rng, 40)}", "s"))
        want.add((k, k))
        if k % 2:
            rows.append((100 + k, f"{prose(rng, 30)} {items[k][1]}", "s"))
            want.add((100 + k, k))
    rows.append((200, prose(rng, 200), "s"))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == want
    assert [r.doc_id for r in D.clean_documents(docs, bench).collect()] == [200]


def test_blocks_change_nothing(spark):
    docs, items, _, _ = corpus(spark)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(D.contaminated(docs, items)) == key(D.contaminated(docs, items, block_bytes=600))


def test_a_stray_hit_before_the_copy_costs_nothing():
    # the item's first words stand just before the tail of its copy, whose front is broken
    assert D.passages([(100, 0), (110, 30)], 40, 1000) == [(56, 164)]
    assert D.passages([(10, 0), (200, 0), (206, 150)], 20, 1000) == [(0, 90), (186, 234)]
    item = [f"w{n}" for n in range(40)]
    copy = [f"x{n}" if n % 3 == 2 and n < 30 else w for n, w in enumerate(item)]
    words = ["far"] * 200 + copy[:28] + item[:3] + copy[28:] + ["away"] * 200
    block = D.Block([(7, " ".join(item).encode())])
    number = block.numbers(D.split(pa.array([" ".join(words)]))[1])
    got = D.best_passage(block, 0, number, [(228, 0), (240, 37)], D.THRESHOLD)
    assert got[0] == D.align(block.ids[0], number)[0] / 80


def smith_waterman(item, words):
    """(best score, start of the latest alignment that has it at the first end) cell by cell."""
    h = [[(0, k) for k in range(len(words) + 1)] for _ in range(len(item) + 1)]
    best = (0, 0, 0)
    for i in range(1, len(item) + 1):
        h[i][0] = (0, 0)
        for j in range(1, len(words) + 1):
            s, a = h[i - 1][j - 1]
            c = [(s + (2 if item[i - 1] == words[j - 1] else -1), a), (h[i - 1][j][0] - 1, h[i - 1][j][1]), (h[i][j - 1][0] - 1, h[i][j - 1][1]), (0, j)]
            h[i][j] = max(x for x in c if x[0] > 0) if max(x[0] for x in c) > 0 else (0, j)
            if h[i][j][0] > best[0]:
                best = (h[i][j][0], h[i][j][1], j)
    return best


def test_against_all_pairs_alignment(spark):
    """Every item against every document: nothing is found that alignment doesn't, and at least 0.9 of what alignment has. Every 3rd to 8th word is edited."""
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randint(12, 40))) for k in range(16)] + [(16, "velvet orchard"), (17, "quartz")]
    rows = []
    for k in range(90):
        words = items[k % 16][1].split()
        step, how = 3 + k % 6, k % 3
        copy = []
        for n, w in enumerate(words):
            if n % step == step - 1:
                copy += [] if how == 1 else [f"new{n}"] if how == 0 else [w, f"more{n}"]
            else:
                copy.append(w)
        rows.append((k, f"{prose(rng, rng.randint(0, 60))} {' '.join(copy)} {prose(rng, rng.randint(0, 60))}", "s"))
    rows += [(100, "a Velvet, orchard!", "s"), (101, "quartz", "s"), (102, "orchard velvet", "s")]
    want = {}
    for i, t, _ in rows:
        words = D.words_of(t.encode())
        for k, x in items:
            item = D.words_of(x.encode())
            s, a, z = smith_waterman(item, words)
            if s / (2 * len(item)) >= D.THRESHOLD:
                want[i, k] = (s / (2 * len(item)), a, z - a)
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.n_words) for r in D.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) and len(want) > 80
    same = sum(want[k][0] == v[0] for k, v in got.items())
    assert same >= 0.95 * len(got)
    assert sum(want[k] == v for k, v in got.items()) >= 0.9 * same
    print(len(want), len(got), same)


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert D.align(a, b)[0] == h.max()


def test_odd_rows(spark, docs, rows, empty):
    _, items, _, _ = corpus(spark)
    assert D.contaminated(empty, items).count() == 0 and D.clean_documents(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0 and D.clean_documents(docs, none).count() == len(rows)
    assert D.clean_documents(docs, items).count() == len(rows)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licences(spark):
    texts = {
        1: "Some prose.\nReleased under the MIT License.\nMore prose.",
        2: MIT,
        3: "\n".join(reversed(MIT.split("\n"))),
        4: "Licensed under the Apache License, Version 2.0. All rights reserved.",
        5: "you may license this text",
        6: None,
        7: "",
        8: "LICENSED UNDER CC BY-NC 4.0!",
        9: "This work is licensed under the GNU General Public License, version 3.\r\nreleased under the mit license",
    }
    got = {r.doc_id: r for r in L.scan(frame(spark, [(k, t, None) for k, t in texts.items()])).collect()}
    assert {k: r.licences for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "", 4: "Apache-2.0 Proprietary", 5: "", 6: "", 7: "", 8: "CC-BY-NC-4.0", 9: "MIT GPL-3.0-only"}
    assert got[2].sentence_ids == "mit_grant mit_notice as_is" and got[3].n_known == 3


def test_hints_hold_before_normalising(spark):
    texts = {1: "All rights  reserved.", 2: "Some prose. ALL RIGHTS\treserved!", 3: "all rights\u00a0- Reserved", 4: "all rights were reserved"}
    got = {r.doc_id: r.licences for r in L.scan(frame(spark, [(k, t, None) for k, t in texts.items()])).collect()}
    assert got == {1: "Proprietary", 2: "Proprietary", 3: "Proprietary", 4: ""}


def test_every_known_sentence_is_normal_and_hinted():
    import re

    for ss in L.SENTENCES.values():
        for s in ss:
            assert re.sub(L.NOISE, " ", s.lower()).strip() == s and re.search(L.HINT, s)
    names = {k for _, rule in L.RULES for k in rule}
    assert names <= L.SENTENCES.keys() and len({n for n, _ in L.RULES}) >= 20


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join("\n".join(mark + x for x in textwrap.wrap(p, width)) or mark.rstrip() for p in text.split("\n"))


GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NOTICES = {
    "MIT": None,
    "GPL-3.0-or-later": GNU.format("program", "General Public License", 3),
    "GPL-2.0-or-later": GNU.format("program", "General Public License", 2),
    "LGPL-3.0-or-later": GNU.format("library", "Lesser General Public License", 3),
    "LGPL-2.1-or-later": GNU.format("library", "Lesser General Public License", 2.1),
    "AGPL-3.0-or-later": GNU.format("program", "Affero General Public License", 3),
    "BSD-2-Clause": BSD2,
    "BSD-3-Clause": BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def test_whole_notices_wrapped_and_commented(spark):
    """Every notice at three widths and behind comment marks, among prose."""
    rows, want = [], {}
    for k, (name, text) in enumerate(NOTICES.items()):
        text = text or MIT.replace("\n", "\n\n")
        for v, (width, mark) in enumerate([(10_000, ""), (80, ""), (70, " * "), (76, "# "), (60, "// ")]):
            rows.append((10 * k + v, "Some prose about rivers.\n\n" + wrapped(text, width, mark) + "\n\nMore prose.\n", None))
            want[10 * k + v] = name
    got = {r.doc_id: r.licences for r in L.scan(frame(spark, rows)).collect()}
    assert got == want


def test_sql_tells_rows_of_one_id_apart(spark, tmp_path):
    import duckdb

    rows = [(1, MIT, "s"), (1, "Released under the MIT License.\nx", "s"), (1, None, "s"), (2, wrapped(NOTICES["GPL-3.0-or-later"], 50, "# "), "s"), (3, "a; b: licensed under cc by 4.0", "s"), (None, BSD2, "s")]
    frame(spark, rows).select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    key = lambda rows: sorted((str(r[0]), *r[1:]) for r in rows)
    assert key(duckdb.sql(L.sql()).fetchall()) == key(map(tuple, L.scan(frame(spark, rows)).collect()))


def test_scan_of_odd_rows(docs, rows, empty):
    assert L.scan(docs).count() == len(rows) and L.scan(empty).count() == 0
