"""Each operator against a brute-force version on small tables with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, components, embeddings, licenses, lines, neardup, packing, pii, quality, sstable, suffixes
from skein.llm.common import shared_dir
from skein.llm.tokens import SegmentEncoder, WordEncoder, load, tokenizer_path

LONG = " ".join(f"word{i % 997} and{i % 7}" for i in range(6000))
PASSAGE = " ".join(f"shared{i} passage" for i in range(60))
TEXTS = [None, "", " ", "\n", "Hello, world.", "Hello, world.", LONG, f"x1 {PASSAGE} y1\n{'a repeated line of text'}", f"x2 {PASSAGE} y2 z\n A Repeated LINE of text \t", "a repeated line of text\nother",
         "mail a.b@c.de and a@b.c_d@e.fr, ip 1.2.3.4 999.1.1.1, card 4111 1111 1111 1111, phone +49 (0) 123-4567 é", "#" * 900, "日本語 ß <|endoftext|> it's", "a" * 1200]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(5, "Hello, world.", "y")], "doc_id long, text string, n_words string").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_tokens_agree():
    import pyarrow as pa

    for name, cls in (("word_bpe_49k.json", WordEncoder), ("byte_bpe_50k.json", SegmentEncoder), ("byte_bpe_50k.json", bpe.ForcedEncoder)):
        texts = [*TEXTS, "a  b\tc\xa0d", "<|startoftext|>A <|EndOfText|>", "İ Σας ÀÉ x.. y,z", "a\x01 b,c"]
        true = [e.ids for e in load(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in cls(tokenizer_path(name)).encode_array(pa.array(texts))] == true


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    tok, by_sequence = load(tokenizer_path(packing.VOCABULARY)), defaultdict(list)
    for r in rows:
        ids = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [1]
        own = ids[r.start : r.start + r.length]
        assert r.start == r.piece * 4096 and len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack_documents(empty).count() == 0


def test_pack_lengths():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 4097, 3000), minlength=4097)
    packed = packing.pack_lengths(counts)
    total = np.zeros(4097, int)
    for items, times in packed:
        assert sum(s * n for s, n in items) <= 4096
        for s, n in items:
            total[s] += n * times
    assert (total == counts).all()
    assert sum(t for _, t in packed) <= 1.02 * (counts * np.arange(4097)).sum() / 4096


@pytest.mark.parametrize("capacity", [1000, 1021, 129, 7])
def test_pack_lengths_at_any_capacity(capacity, monkeypatch):
    asked, true = [], packing.solve
    monkeypatch.setattr(packing, "solve", lambda *a: asked.append(1) or true(*a))
    counts = np.bincount(np.random.default_rng(4).integers(1, capacity + 1, 2000), minlength=capacity + 1)
    packed = packing.pack_lengths(counts)
    total = np.zeros(capacity + 1, int)
    for items, times in packed:
        assert sum(s * n for s, n in items) <= capacity
        for s, n in items:
            total[s] += n * times
    assert asked and (total == counts).all()
    assert sum(t for _, t in packed) <= 1.05 * (counts * np.arange(capacity + 1)).sum() / capacity + 1


def test_lines(docs, empty):
    out = {(r.doc_id, r.text): r for r in lines.dedup_lines(docs, shard_keys=1).collect()}
    assert {k[0]: r.n_dropped for k, r in out.items() if r.n_dropped} == {7: 1, 8: 1}
    assert {r.n_lines for k, r in out.items() if k[0] in (0, 1, 2)} == {1} and lines.dedup_lines(empty).count() == 0


def test_lines_of_shared_identifiers(spark, monkeypatch):
    """Against the rule applied line by line; groups of batches, shards and their cache are made small."""
    for name, value in (("PROBE_BYTES", 4000), ("CACHED_SHARDS", 2)):
        monkeypatch.setattr(lines, name, value)
    rng, line = np.random.default_rng(1), "a line long enough to be counted, number"
    rows = [(int(rng.integers(0, 40)), "\n".join(f"{' ' * (k % 3)}{line} {k}{'X' if k % 2 else 'x'}\r" for k in rng.integers(0, 30, rng.integers(0, 9)))) for _ in range(60)]
    rows += [(100, f"{line} a"), (100, f"{line} a"), (101, f"{line} a"), (None, f"{line} a"), (None, f"{line} b"), (102, f"{line} b\n{line} b"), (103, "y" * 300_000 + f"\n{line} b")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for x in t.split("\n"):
            holders[key(x)].add((-1, n) if i is None else (i, 0))
    goes = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)])[0]
    true = Counter((i, "\n".join(x for x in t.split("\n") if not goes(i, x)), t.count("\n") + 1, sum(goes(i, x) for x in t.split("\n")), 5, "k") for i, t in rows)
    docs_ = spark.createDataFrame([(5, i, t, 0, "k") for i, t in rows], "held int, doc_id long, text string, N_Lines int, _carried string").repartition(3)
    out = lines.dedup_lines(docs_, shard_keys=7)
    assert out.columns == ["held", "doc_id", "text", "_carried", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.held, r["_carried"]) for r in out.collect()) == true and sum(k[3] for k in true) > 20
    twice = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert not any(r.n_dropped for r in lines.dedup_lines(twice).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_oracles(spark):
    from skein.llm import queries

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        true = con.execute(sql)
        names = [d[0] for d in true.description]
        assert sorted(true.fetchall()) == sorted(map(tuple, queries.queries()[name](spark, folder).select(*names).collect())), name


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64))
    ph = lines.PerfectHash.build(keys)
    assert sorted(ph.find(keys).tolist()) == list(range(len(keys)))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(90)]
    rows += [(90, rows[0][1]), (91, [2 * x for x in rows[0][1]]), (92, None), (93, [0.0] * 16), (94, [None] + [1.0] * 15), (95, [float("nan")] * 16), (96, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    m = np.array([r[1] for r in rows[:92]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = m @ m.T >= 0.95
    out = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert [out[i].n_links for i in range(92)] == (hit.sum(1) - 1).tolist()
    assert all(out[i].n_links == 0 and out[i].kept for i in range(92, 97))
    assert embeddings.near_vectors(df.where("false")).count() == 0


def linked(vectors):
    """Links of each vector and the smallest vector reachable, by brute force."""
    hit = vectors @ vectors.T >= 0.95
    least, before = np.arange(len(hit)), None
    while before is None or (least != before).any():
        before, least = least, np.array([least[row].min() for row in hit])
    return hit.sum(1) - 1, least


def vectors_of(spark, vectors):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    return sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(rows).collect())


def test_vectors_at_the_border_of_a_dense_group(spark):
    rng = np.random.default_rng(8)
    m = rng.standard_normal(64) / 8 + rng.standard_normal((2500, 64)) * 0.0343 * rng.uniform(0.6, 1.4, 2500)[:, None]
    m /= np.linalg.norm(m, axis=1)[:, None]
    n, least = linked(m)
    assert ((n > 0) & (n < embeddings.LIST)).sum() > 50
    assert vectors_of(spark, m) == [(i, n[i], least[i]) for i in range(len(m))]


def test_isolated_pairs_missed_by_the_start(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ORDERS", 1)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(9)
    m = rng.standard_normal((600, 64))
    m = np.concatenate([m, m[:300] + 0.3 * rng.standard_normal((300, 64))])
    m /= np.linalg.norm(m, axis=1)[:, None]
    n, least = linked(m)
    assert vectors_of(spark, m) == [(i, n[i], least[i]) for i in range(len(m))]


def test_orders_grow():
    assert embeddings.orders_for(500) == embeddings.ORDERS < embeddings.orders_for(100_000) < embeddings.orders_for(1_000_000)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    for one_task in (0, components.ONE_TASK):
        assert sorted(map(tuple, components.components(links, one_task=one_task).collect())) == [(i, 0) for i in range(31)] + [(50, 50), (51, 50)]
        assert components.components(links.where("false"), one_task=one_task).count() == 0


def brute_pii(text):
    luhn = lambda s: sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0
    rules = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15)}
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m.group())]


def test_pii(spark, docs, empty):
    many = spark.createDataFrame([(100, "é a@b.cd 1.2.3.4 " * 700, "")], docs.schema)
    for r in pii.find(docs.unionByName(many)).collect():
        text = "é a@b.cd 1.2.3.4 " * 700 if r.doc_id == 100 else TEXTS[r.doc_id] or ""
        assert [tuple(s) for s in r.base] == brute_pii(text)
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[10].startswith("mail [EMAIL] and [EMAIL]") and masked[0] is None and masked[6] == LONG
    assert pii.find(empty).count() == 0 and pii.mask(empty).count() == 0


def test_pii_terms(spark):
    rows = [(i, f"filler{i} text{i} ask Zebulon at zeb@home.org about{i} thing{i}") for i in range(6)] + [(10 + i, f"other plain{i} words{i}") for i in range(60)]
    found = {r.doc_id: r.terms for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zebulon" in [dict(rows)[i][t.start : t.end] for t in found[i]] for i in range(6))
    assert not any(found[10 + i] for i in range(60))


def test_pii_terms_at_any_distance(spark):
    far = lambda i: " ".join(f"pad{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = {i: f"Zebulon {far(i)} wrote zeb@home.org about {far(i)} and zebulon" for i in range(6)} | {10 + i: f"other plain{i} words{i} wrote about and with" for i in range(60)}
    texts |= {20: "Zebulon alone", 30: "zeb@home.org once more and nothing near"}
    rows = [(i, t) for i, t in texts.items()] + [(3, "ab@cd.ef with Zebulon")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, len(r.base), tuple(t.end - t.start for t in r.terms)) for r in pii.find(docs_).collect() if r.terms)
    assert found == sorted([(i, 1, (7, 7)) for i in range(6)] + [(3, 1, (7,)), (20, 0, (7,))])
    out = Counter((r.doc_id, r.text) for r in pii.mask(docs_).collect())
    gone = lambda i: texts[i].replace("zeb@home.org", "[EMAIL]").replace("Zebulon", "[TERM]").replace("zebulon", "[TERM]")
    assert out == Counter([(i, gone(i) if i < 6 or i in (20, 30) else t) for i, t in texts.items()] + [(3, "[EMAIL] with [TERM]")])
    copies = spark.createDataFrame([(i, "Zebulon zeb@home.org") for i in range(6)] + rows[6:66], docs_.schema)
    assert not any(r.terms for r in pii.find(copies).collect())


def test_pii_terms_of_all_pairs(spark):
    """Against PMI and significance of every entity and word, with names planted beside entities and far from them."""
    import math

    rng = np.random.default_rng(4)
    common, rare = [f"common{chr(97 + i)}" for i in range(20)], ["rare" + "".join(map(chr, 97 + rng.integers(0, 26, 5))) for _ in range(150)]
    names = {f"p{k}@home.org": f"Surname{'abcdefgh'[k]}" for k in range(8)}
    rows = []
    for i in range(300):
        text = [*rng.choice(common, 12), *rng.choice(rare, 3)]
        if i % 3 == 0:
            mail = f"p{i % 8}@home.org"
            text.insert(int(rng.integers(0, len(text))), mail)
            if rng.random() < 0.8:
                text.insert(int(rng.integers(0, len(text))), names[mail])
        elif i % 50 == 1:
            text.append(names[f"p{i % 8}@home.org"])
        rows.append((i // 2 if i < 20 else i, " ".join(text), None, i))
    texts = [(i, t) for i, t, _, _ in rows]
    words = [set(re.findall(r"[^\W\d_][^\W\d_'-]{2,}", re.sub(r"\S+@\S+", " ", t).lower())) for _, t in texts]
    raw = Counter(w for _, t in texts for w in set(re.findall(r"[^\W\d_][^\W\d_'-]{2,}", t.lower())))
    held, hidden, total = defaultdict(list), set(), len(rows)
    for k, (_, t) in enumerate(texts):
        for e in set(re.findall(r"\S+@\S+", t)):
            held[e].append(k)
    for own in held.values():
        for w, c in Counter(w for k in own for w in words[k]).items():
            pmi = math.log2(c * total / (len(own) * max(raw[w], c)))
            if c >= 3 and pmi >= 0.8 * math.log2(total / len(own)) and 2 * c * math.log(2) * pmi >= 10.83:
                hidden.add(w)
    planted = {n.lower() for n in names.values()}
    assert planted <= hidden and len(hidden - planted) <= 1  # recall 1 and precision 8/9 at least on what was planted
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, terms string, _spans int")
    out = Counter((r.doc_id, tuple(sorted((t.start, t.end) for t in r.terms))) for r in pii.find(docs_).collect())
    assert out == Counter((i, tuple((m.start(), m.end()) for m in re.finditer(r"\S+", t) if m[0].lower() in hidden)) for i, t in texts)
    masked = pii.mask(docs_)
    hide = lambda t: " ".join("[EMAIL]" if "@" in w else "[TERM]" if w.lower() in hidden else w for w in t.split())
    assert masked.columns == docs_.columns and sorted(map(tuple, masked.collect()), key=lambda r: r[3]) == [(i, hide(t), None, k) for k, (i, t) in enumerate(texts)]


def test_pii_joins_no_texts(spark):
    """Terms too large to broadcast neither move the texts nor change what is found; more than `at_once` are found by a join."""
    name = lambda k: f"Zébulon{chr(97 + k // 5)}{chr(97 + k % 5)}"
    rows = [(10 * k + i, f"{name(k)} wrote n{k}@home.org pad{chr(97 + k)}{chr(97 + i)} and {name(k).upper()}") for k in range(20) for i in range(6)]
    rows += [(1000 + i, "other words wrote and") for i in range(300)] + [(1, f"{name(3)} {name(17)} alone"), (1, None), (2000, "")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    key, kept = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        made = [pii.find(docs_), pii.mask(docs_)]
        assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in made)
        found, masked = ([tuple(map(str, r)) for r in df.collect()] for df in made)
        for at_once, joins in ((20, False), (19, True), (0, True)):
            ways = [pii.find(docs_, at_once=at_once), pii.mask(docs_, at_once=at_once)]
            assert all(("Join" in df._jdf.queryExecution().optimizedPlan().toString()) == joins for df in ways)
            assert [Counter(tuple(map(str, r)) for r in df.collect()) for df in ways] == [Counter(found), Counter(masked)]
    finally:
        spark.conf.set(key, kept)
    hide = lambda t: t if t is None else re.sub(r"n\d+@home.org", "[EMAIL]", re.sub(r"(?i)zébulon[a-z]{2}", "[TERM]", t))
    assert Counter(masked) == Counter((str(i), str(hide(t))) for i, t in rows)


def test_pii_looked_up(spark):
    words = [f"wört{k}" for k in range(0, 2000, 2)]
    docs_ = spark.createDataFrame([(k, " ".join(f"wört{chr(97 + j)}" for j in range(26)) + f" x{chr(97 + k)}y") for k in range(26)] + [(30, None), (31, "")], "doc_id long, text string")
    for known in (words + [f"wört{chr(97 + j)}" for j in range(0, 26, 3)] + ["xby"], ["xcy"], []):
        told = {r.doc_id: r._said for r in pii.looked_up(docs_, spark.createDataFrame([(w,) for w in known], "word string"), len(known)).collect()}
        assert all(set(told[k]) == {f"wört{chr(97 + j)}" for j in range(26) if f"wört{chr(97 + j)}" in known} | ({f"x{chr(97 + k)}y"} & set(known)) for k in range(26))
        assert not told[30] and not told[31]


def test_licenses(spark, docs):
    text = "Intro.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0. More words"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "no licence to drive"), (4, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scanned(rows).collect()} == {1: "MIT,Apache-2.0", 2: "", 3: "", 4: "CC-BY-NC-4.0"}


NOTICES = {
    "MIT-grant;MIT-notice;AsIs;Liability": ("MIT", """Copyright (c) 2020 A B
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""),
    "BSD-use;BSD-source;BSD-binary;BSD-names;AsIs;Liability": ("BSD-3-Clause", """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must
 *    retain the above copyright notice.
 * 2. Redistributions in binary form must reproduce the above
 *    copyright notice.
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products
 *    derived from this software.
 *
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
 * AND ANY EXPRESS WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
 * OWNER BE LIABLE."""),
    "Apache-2 0-ref;Apache-may;Apache-obtain": ("Apache-2.0", """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in
# compliance with the License. You may obtain a copy of the
# License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""),
    "GPL-2-later": ("GPL-2.0-or-later", """// This program is free software; you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation; either version 2 of the License, or
// (at your option) any later version."""),
    "GPL-3-ref": ("GPL-3.0-only", "This work is licensed under the GNU\nGeneral Public License, version 3."),
    "LGPL-2 1-ref": ("LGPL-2.1-only", "Distributed under the GNU Lesser General\r\nPublic License, version 2.1."),
    "CC-by sa-4 0-ref": ("CC-BY-SA-4.0", "This work is licensed under a Creative\nCommons BY-SA 4.0 License."),
    "MIT-ref": ("MIT", "This library is released under the\nMIT license."),
    "SPDX-mit-ref": ("MIT", "/* SPDX-License-Identifier: MIT */\nint x;"),
    "SPDX-apache 2 0-ref": ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport re"),
    "AsIs;CC-by-4 0-ref": ("CC-BY-4.0", "The software is provided as is\nLicensed under CC BY 4.0"),
}


def test_wrapped_notices(spark):
    rows = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(NOTICES.values())], "doc_id long, text string")
    out = {r.doc_id: (r.sequence, r.licenses) for r in licenses.scanned(rows).collect()}
    assert out == {k: (sequence, name) for k, (sequence, (name, _)) in enumerate(NOTICES.items())}


#: Licence texts as published, and what they are.
FULL = {
    "MIT": """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Copyright (c) 2024, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.""",
    "BSD-4-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright
   notice.
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by Some Body.
4. Neither the name of Some Body nor the names of its contributors may be
   used to endorse or promote products derived from this software.""",
    "Apache-2.0": """Copyright 2024 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.""",
    "GPL-3.0-only": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

Everyone is permitted to copy this text.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain worldwide.""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.""",
    "GPL-2.0-only,MIT": "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT\nint x;",
    "LGPL-2.1-or-later": "<!-- SPDX-License-Identifier: LGPL-2.1-or-later -->\n",
}


def test_published_texts(spark):
    """As they are, after comment signs, on one line a paragraph, and among prose."""
    forms = [lambda t: t, *(lambda t, sign=sign: "\n".join(f"{sign}{x}".rstrip() for x in t.split("\n")) for sign in ("# ", "// ", " * ", "-- ", "    ")),
             lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")), lambda t: f"Some prose that ends here.\n\n{t}\n\nAnd more prose, nothing else."]
    rows = [(10 * k + n, form(t)) for k, t in enumerate(FULL.values()) for n, form in enumerate(forms) if not (k >= len(FULL) - 2 and n)]
    out = {r.doc_id: sorted(r.licenses.split(",")) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = [sorted(n.split(",")) for n in FULL]
    assert {i: x for i, x in out.items() if x != names[i // 10]} == {}
    assert licenses.scanned(spark.createDataFrame([(1, "You have my permission to use the software as is, in no way a licence.")], "doc_id long, text string")).first().licenses == ""


def test_shards(spark, docs, empty):
    shards = sstable.write_shards(docs, shared_dir(spark, "t"), shards=3)
    tok, start = load(tokenizer_path(sstable.VOCABULARY)), 0
    coded = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    for r in sorted(sstable.read_shards(spark, shards).collect(), key=lambda r: r.start):
        ids = coded(TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sstable.lookup(shards, 12)[0].tolist() == coded(TEXTS[12]) and len(sstable.lookup(shards, 5)) == 2 and not sstable.lookup(shards, 99)
    assert sstable.written_and_read(empty).count() == 0


def test_shards_of_null_identifiers(spark, docs, empty):
    texts = [f"without identifier {i}" for i in range(20)] + [None]
    every = docs.unionByName(spark.createDataFrame([(None, t, "") for t in texts], docs.schema))
    shards = sstable.write_shards(every, shared_dir(spark, "t"), shards=3)
    tok, rows = load(tokenizer_path(sstable.VOCABULARY)), sstable.read_shards(spark, shards).collect()
    coded = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    print_ = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert Counter((r.n_tokens, r.ids_crc32) for r in rows if r.doc_id is None) == Counter(print_(coded(t)) for t in texts)
    assert sum(r.n_tokens for r in rows) == sum(len(coded(t)) for t in [*TEXTS, "Hello, world.", *texts]) and len(rows) == every.count()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert sorted(x.tolist() for x in sstable.lookup(shards, None)) == sorted(map(coded, texts)) and not sstable.lookup(shards, 99) and len(sstable.lookup(shards, 0)) == 1
    assert sstable.written_and_read(every.where("doc_id IS NULL")).count() == len(texts)


def test_shards_leave_workers_small(spark):
    """What workers hold more after encoding many distinct parts and writing them."""

    def probe(batches):
        list(batches)
        time.sleep(0.3)  # so that every worker gets some
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(n) for n in re.findall(r"Pss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read())) >> 10])], ["mb"])

    held = lambda: max(r.mb for r in spark.range(0, 16, 1, 16).mapInArrow(probe, "mb long").collect())
    before = held()
    words = F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda k: F.conv(F.hex(F.xxhash64("id", k)), 16, 36))
    many = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    shards = sstable.write_shards(many, shared_dir(spark, "t"), shards=16)
    assert sum(s["documents"] for s in shards) == 400
    assert held() < before + 200


def test_near_duplicates(spark, docs, empty):
    base = [f"term{i}" for i in range(160)]
    edit = lambda k: " ".join(w if i != 12 * k else "changed" for i, w in enumerate(base))
    rows = [(i, edit(i), "") for i in range(12)] + [(20, " ".join(base).upper(), ""), (21, "one two", ""), (22, "One, two!", ""), (None, "one two", ""), (23, " ".join(base[:100]), "")]
    out = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(rows, docs.schema).unionByName(docs.withColumn("doc_id", docs.doc_id + 100))).collect()}
    assert {out[i].class_id for i in (*range(12), 20)} == {0} and out[22].class_id == 21 and out[23].class_id == 23 and out[100].kept and out[101].kept
    assert neardup.classes(empty).count() == 0


def test_unlike_texts_of_one_identifier(spark):
    base = [" ".join(f"t{k}w{i}" for i in range(80)) for k in range(12)]
    near = lambda k: base[k].replace(f"t{k}w40", "changed")
    rows = [(k, base[k]) for k in range(12)] + [(100, near(k)) for k in range(12)] + [(100, "a text of its own that nothing else is like")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r.doc_id, r.class_id) for r in neardup.classes(docs_).collect())
    assert out == Counter([(k, k) for k in range(12)] + [(100, k) for k in range(12)] + [(100, 100)])
    assert Counter(map(tuple, neardup.first_of_each(docs_).collect())) == Counter(rows[:12] + rows[-1:])


def least_linked(ids, linked):
    """The smallest identifier that links reach, for each."""
    least = {i: i for i in ids}
    while True:
        new = {i: min([least[i], *(least[j] for j in linked[i])]) for i in ids}
        if new == least:
            return least
        least = new


@pytest.mark.parametrize("few, block", [(32, 512), (2, 8)])
def test_near_duplicates_of_all_pairs(spark, monkeypatch, few, block):
    """Against every pair's multisets, with groups whose links lie on both sides of the threshold."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "GROUP_BLOCK", block)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):
        base = list(rng.choice(words, 90))
        base += base[:20] * (family % 3)  # repeated shingles
        for k in range(14):
            text = list(base)
            for at in rng.integers(0, len(base), rng.integers(0, 5)):
                text[at] = f"new{family}x{k}x{at}"
            rows.append((10 * len(rows), " ".join(text)))
    rows += [(5000 + i, " ".join(rng.choice(words, 60))) for i in range(20)] + [(9000, rows[3][1].upper()), (9001, None), (9002, "one two"), (9003, "One, two!")]
    bags = {i: Counter(zip(*(re.findall(r"\w+", t.lower())[k:] for k in range(5)), strict=False)) or Counter([tuple(re.findall(r"\w+", t.lower()))]) for i, t in rows if t}
    linked = {i: [j for j in bags if (a & bags[j]).total() >= 0.8 * (a | bags[j]).total()] for i, a in bags.items()} | {9001: []}
    true = least_linked(linked, linked)
    assert len(set(true.values())) > 30 and max(Counter(true.values()).values()) > 5
    out = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in out.collect()} == true
    clash = spark.createDataFrame([(i, t, 1, "d", 3) for i, t in rows], "doc_id long, text string, node int, _digest string, Kept int")
    left = neardup.first_of_each(clash)
    assert left.columns == clash.columns and sorted(map(tuple, left.collect()), key=lambda r: r[0]) == [(i, t, 1, "d", 3) for i, t in rows if true[i] == i]


def test_bag_minhash_estimates():
    rng = np.random.default_rng(5)
    shingle = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.integers(1, 6, 400), rng.integers(1, 6, 400)
    sign = neardup.bag_minhash(np.repeat([0, 1], 400), np.tile(shingle, 2), np.concatenate(w), 2, 2000)
    true = np.minimum(*w).sum() / np.maximum(*w).sum()
    assert abs((sign[0] == sign[1]).mean() - true) < 0.04


def test_group_links():
    rng = np.random.default_rng(6)
    x, y = ([rng.integers(0, 50, n).astype(np.uint64) for n in sizes] for sizes in ((30, 5, 9), (12, 40)))
    true = [[sum((Counter(a.tolist()) & Counter(b.tolist())).values()) for b in y] for a in x]
    assert neardup.block_overlaps(x, y, 8).astype(int).tolist() == true
    hit = rng.random((20, 20)) < 0.06
    joined = neardup.spanning(hit, np.arange(20), np.arange(20) + 100)
    parent = {}
    find = lambda v: v if parent.setdefault(v, v) == v else find(parent[v])
    for a, b in joined:
        parent[find(a)] = find(b)
    assert all(find(i) == find(j + 100) for i, j in zip(*np.nonzero(hit), strict=True)) and all(hit[a, b - 100] for a, b in joined)


def test_round_trip(docs, empty):
    tok = load(tokenizer_path(bpe.VOCABULARY))
    for r in bpe.round_trip_digests(docs).collect():
        ids = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.with_text(bpe.with_ids(docs).drop("text"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, t or "") for i, t in enumerate(TEXTS)} and bpe.with_ids(empty).count() == 0


def features(text):
    """The statistics that rules may test, by plain Python; and the four base ones."""
    import regex

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        covered |= {i, i + 1, i + 2} if c[tuple(w[i : i + 3])] > 1 else set()
    rows = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols, twice = sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(rows) - len(set(rows))
    part = lambda a, b: a / b if b else 0.0
    of = lambda p: part(len(regex.findall(p, t)), chars)
    rates = [part(chars, len(w)), part(symbols, chars), part(twice, len(rows)), part(len(covered), len(w)), of(r"\p{Lu}"), of("[0-9]"), of(r"\p{P}"), part(len(set(w)), len(w)), part(len(w), len(rows)), part(sum(len(x) > 20 for x in w), len(w))]
    return [float(len(w)), *rates], (len(w), chars, symbols, twice, len(covered))


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))
    junk = lambda n: " ".join("".join(map(chr, rng.integers(33, 91, rng.integers(2, 30)))) for _ in range(n))
    rows = [(100 + i, (junk if i % 3 == 0 else prose)(int(rng.integers(45, 90))) + "\nsame $ line\nsame $ line\n same $ line" * (i % 2), "own") for i in range(240)]
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: docs["n_words"] for c in ("mean_word", "kept", "_words")})
    labels = spark.createDataFrame([(100 + i, int(i % 3 > 0)) for i in range(240)] + [(i, i % 2) for i in range(13)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules, texts = quality.learn(quality.labelled(every, labels)), dict(enumerate(TEXTS)) | {i: t for i, t, _ in rows}
    out = quality.judged(every, labels)
    assert rules and out.columns == ["doc_id", "text", "mean_word", "_words", *quality.BASE, "base_failed", "kept"]
    kept = []
    for r in out.collect():
        stats, (n, *base) = features(texts[r.doc_id])
        failed = n < 50 or 100 * base[-1] > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, *base, failed)
        assert r.kept == (not failed and not any(quality.matches(rule, stats) for rule in rules))
        kept += [r.doc_id] * r.kept
    good = [i for i, t, _ in rows if i % 3 != 1 and len(t.split()) >= 60]  # 100 + i with i % 3 == 0 is junk
    assert sum(i in set(kept) for i in good) > 0.9 * len(good) and sum(i in set(kept) for i in range(100, 340, 3)) < 8
    left = quality.accepted(every, labels)
    assert left.columns == every.columns and sorted(r.doc_id for r in left.collect()) == sorted(kept) and left.schema["kept"].dataType.simpleString() == "string"
    assert quality.judged(empty, labels.where("false")).count() == 0


def test_learn():
    rows = [([float(i)] + [0.0] * (len(quality.FEATURES) - 1), i >= 70) for i in range(100)] * 5
    rules = quality.learn(rows)
    assert rules and sum(any(quality.matches(r, x) for r in rules) == bad for x, bad in rows) >= 0.95 * len(rows)
    assert quality.learn([]) == []


@pytest.mark.parametrize("length, choices", [(40, 9), (400, 65)])
def test_suffixes(spark, docs, empty, length, choices):
    more = spark.createDataFrame([(200 + i, f"{i}" * 7 + PASSAGE[i : 700 - 9 * i] + f"{i}{i}" * 5, "") for i in range(8)], docs.schema)
    every = docs.unionByName(more)
    texts = [(r.doc_id, (r.text or "").encode()) for r in every.collect()]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    true = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        true[(i, bytes(np.frombuffer(t, np.uint8)[~gone]), int(gone.sum()))] += 1
    assert Counter((r.doc_id, bytes(r.kept), r.n_removed) for r in suffixes.cut_repeats(every, length=length, choices=choices).collect()) == true
    assert suffixes.cut_repeats(empty).count() == 0
    assert suffixes.cut_repeats(empty, passage=240).count() == 0


def covered(texts, length):
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        yield i, t, gone


def test_suffix_passages(spark, docs):
    rng = np.random.default_rng(5)
    filler = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    spaced = lambda n: " ".join(filler(k) for k in rng.integers(1, 9, n))
    passages = [filler(300), spaced(49), spaced(52), spaced(60), filler(400), spaced(90), spaced(150)]
    rows = [(300 + i, filler(37 * i % 50) + passages[i % 7] + filler(11) + passages[(3 * i) % 7][i % 5 :] + "é" * (i % 3), "") for i in range(21)]
    every = docs.where("doc_id <> 6").unionByName(spark.createDataFrame(rows, docs.schema)).withColumnsRenamed({"n_words": "_row"}).selectExpr("*", "_row AS _runs", "_row AS n_bytes", "1 AS regions", "2 AS Kept")
    texts = [(r.doc_id, (r.text or "").encode()) for r in every.collect()]
    runs = lambda gone: int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())

    def wordy(t, short):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], short.astype(int), [0]]))).reshape(-1, 2).tolist()
        return [e - s for s, e in edge if sum(s <= m.start() and m.end() <= e for m in re.finditer(rb"\S+", t)) > 50]

    true = Counter((i, bytes(np.frombuffer(t, np.uint8)[~gone]), int(gone.sum()), runs(gone), sum(wordy(t, short)), len(wordy(t, short))) for (i, t, gone), (_, _, short) in zip(covered(texts, 400), covered(texts, 240), strict=True))
    assert len({x[5] for x in true}) > 1 and len({x[3] for x in true}) > 1
    out = suffixes.cut_repeats(every, passage=240)
    assert out.columns == ["doc_id", "_row", "_runs", "regions", "kept", "n_bytes", "n_removed", "n_spans", "n_passage_bytes", "n_passages"]
    assert Counter((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans, r.n_passage_bytes, r.n_passages) for r in out.collect()) == true


def test_unsound_keys(spark):
    from skein.llm.common import sound_key

    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 5), (None, 3)], "k long, c long")
    keys = [r[0] for r in df.select(sound_key(df, "k", "c")).collect()]
    assert keys[0] == keys[1] and len(set(keys[1:4])) == 3 and keys[3] == 2 and keys[4] is None


def test_multikey_order():
    rng = np.random.default_rng(7)
    columns = [rng.integers(0, 3, 5000), rng.integers(0, 50, 5000), rng.integers(0, 1000, 5000)]
    assert (np.stack(columns)[:, suffixes.multikey_order(columns, 16)] == np.stack(columns)[:, np.lexsort(columns[::-1])]).all()
