"""Quality rules, language ID, licences, decontamination, URL filters, archives and mixing on small fixtures."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcemill.llm import decontaminate, language, licenses, mixing, quality, urls, warc
from sourcemill.llm import queries as llm
from sourcemill.llm.textbatch import utf8

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_queries_like_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    found = c.execute(llm.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == sorted(df.columns)
    assert rows_of(df.select(order)) == sorted(found.fetchall(), key=str)


# Quality


def longest_repeats(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if i != j:
                k = 0
                while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def brute_quality(text, least=10):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    long = longest_repeats(words)
    covered = {i + k for i, n in enumerate(long) if n >= least for k in range(n)}
    longest = max((n for n in long if n >= least), default=0)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    kept = not failed and len(covered) <= quality.MAX_COVERED * len(words) and longest <= quality.MAX_LONGEST
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(hit), len(covered), longest, failed, kept)


def brute_repeats(words, least):
    """How many substrings of at least least words occur twice or more and in no way longer."""
    found, n = 0, least
    while True:
        at = defaultdict(list)
        for i in range(len(words) - n + 1):
            at[tuple(words[i : i + n])].append(i)
        more = [p for p in at.values() if len(p) > 1]
        if not more:
            return found
        sides = [({words[i - 1] if i else i for i in p}, {words[i + n] if i + n < len(words) else i for i in p}) for p in more]
        found += sum(len(a) > 1 and len(b) > 1 for a, b in sides)
        n += 1


def test_maximal_repeats():
    rng = random.Random(7)
    for least in (1, 2, 4):
        texts = [[rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 60))] for _ in range(30)]
        tokens = np.array([ord(c) for t in texts for c in t], np.uint64)
        first = np.cumsum([0, *map(len, texts)])
        of, length, at, span = quality.maximal_repeats(tokens, first, least)
        assert np.bincount(of, minlength=len(texts)).tolist() == [brute_repeats(t, least) for t in texts]
        for k, t in enumerate(texts):
            want = longest_repeats(t)
            assert max(length[of == k], default=0) == max((n for n in want if n >= least), default=0)
            own = (at >= first[k]) & (at < first[k + 1])
            covered = {i for a, n in zip(at[own] - first[k], span[own]) for i in range(a, a + n)}
            assert covered == {i + j for i, n in enumerate(want) if n >= least for j in range(n)}


def test_quality(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "é# ü\né# ü\n\n", "a\x0bb\x85c d"]
    for _ in range(40):
        words = [rng.choice(["ab", "ç", "x*y", "<z>", "q", "r", "s", "t", "u", "v"]) for _ in range(rng.randrange(5, 160))]
        if rng.random() < 0.5:
            k = rng.randrange(len(words))
            words += words[k : k + rng.randrange(40)] * rng.randrange(1, 3)
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t "]) for w in words))
    texts.append("word " * 3000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("x"))
    found = quality.quality(df)
    assert all(r.n_repeats == brute_repeats(re.findall(r"[^\x20\x09-\x0D]+", t or ""), 10) for r, t in zip(found.orderBy("doc_id").collect(), texts[:-1]))
    got = found.drop("n_repeats")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {i: brute_quality(t) if i < len(texts) - 1 else (3000, 12000, 0, 0, 3000, 3000, 2999, True, False) for i, t in enumerate(texts)}
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {r.doc_id for r in got.collect() if r.kept}
    assert quality.keep_good(df).columns == df.columns
    assert quality.quality(df.limit(0)).count() == 0


# Language


def brute_bits(samples, order, text):
    n = defaultdict(Counter)
    for s in samples:
        b = b"\n" * order + s.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                n[b[i - k : i]][b[i]] += 1
    b, total = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = n.get(b[i - k : i])
            if c is None:
                continue
            all_, kinds = sum(c.values()), len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / (all_ + kinds))
                break
            total -= math.log2(kinds / (all_ + kinds))
        else:
            total += 8
    return total


def test_code_lengths():
    samples = {"a": ["hello world", "help the held"], "b": ["hallo welt é", "holla"]}
    trees = language.Trees(samples, 3)
    texts = ["hello", "hél wor", "zzz", "", "welt help", "日本"]
    data, offsets = utf8(pa.array(texts))
    want = [[brute_bits(samples[lang], 3, t) for lang in "ab"] for t in texts]
    assert np.allclose(trees.bits(data, offsets), want, atol=1e-3)


def test_language_held_out(spark):
    found = llm.op7_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    right = found.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, None), (3, "123 !"), (4, ""), (None, "hallo welt")], "doc_id long, text string").withColumn("lang", F.lit("z"))
    train = spark.createDataFrame([("hello the world", "en"), ("hallo welt", "de"), (None, "en"), ("x", None)], "text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.fit(train)).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "und", None: "de"}
    none = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.fit(train, max_languages=1)


def test_language_copies_count_once(spark):
    names = [f"l{i}" for i in range(8)]
    train = spark.range(16000).select(F.concat(F.lit("text of "), (F.col("id") % 8).cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 8).cast("string")).alias("lang"))
    assert language.fit(train, max_docs=1).languages == names
    texts = [f"words {i} of a text" for i in range(40)]
    copies = [("the one that is copied", "a")] * 90 + [(t, "a") for t in texts] + [("andere", "b")]
    got = language.fit(spark.createDataFrame(copies, "text string, lang string"), max_docs=60)
    want = language.Trees({"a": sorted({t for t, lang in copies if lang == "a"}), "b": ["andere"]})
    data, offsets = utf8(pa.array([*texts, "the one", "zzz"]))
    assert np.allclose(got.bits(data, offsets), want.bits(data, offsets))


# Licences


def test_licenses(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, "Some text. Released under the MIT License.\nMore; all RIGHTS reserved."), (2, f"MIT License\n{grant}.\n{notice}"), (3, "no license here"), (4, None), (5, ""),
        (6, "Licensed under the Apache License, Version 2.0.\r\nLicensed under CC BY-NC 4.0. x"), (6, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("left", F.lit(2))
    got = rows_of(licenses.scan(df).select("doc_id", "sequence", "licenses"))
    assert got == sorted([
        (1, "mit reserved", "All-Rights-Reserved MIT"), (2, "mit mit-grant mit-notice", "MIT"), (6, "apache2 cc-by-nc", "Apache-2.0 CC-BY-NC-4.0"), (6, "cc-by-nc", "CC-BY-NC-4.0"),
    ], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_wrapped(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    bsd = """Copyright (c) 2020, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
    commented = "\r\n".join(f" * {line}".rstrip() for line in mit.splitlines())
    rows = [(1, mit), (2, commented), (3, gpl), (4, bsd), (5, "This file is released under the MIT license"), (6, "We like the MIT\n\nLicense plates. Permit license."), (7, "x" * 2000 + " is under the MIT\n# license " + "y" * 2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "left": F.lit("x")})
    got = rows_of(licenses.scan(frame).select("doc_id", "sequence", "licenses"))
    assert licenses.scan(frame.limit(0)).count() == 0
    assert got == [
        (1, "mit-grant mit-notice as-is", "MIT"), (2, "mit-grant mit-notice as-is", "MIT"), (3, "gpl3 gpl-copy", "GPL-3.0"),
        (4, "reserved bsd-grant", "BSD-3-Clause"), (5, "mit", "MIT"), (7, "mit", "MIT"),
    ]


CONDITIONS = """Copyright (c) 2020, Somebody.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,"""


def test_standard_licences(spark):
    texts = {"BSD-2-Clause": CONDITIONS + WARRANTY, "BSD-3-Clause": CONDITIONS + NAMES + WARRANTY, "ISC": ISC, "MPL-2.0": MPL, "Apache-2.0": APACHE}
    rows = []
    for name, text in texts.items():
        whole = re.sub(r"\s*\n(?!\n)\s*", " ", text)
        rows += [(name, text), (name, whole), (name, "\n".join(f"# {x}".rstrip() for x in text.splitlines())), (name, "A text before it.\n\n" + text + "\n\nAnd one after."), (name, "word " * 50_000 + "\n\n" + text)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(df).collect()} == {i: name for i, (name, _) in enumerate(rows)}


# Decontamination


def brute_leaks(docs, items, window=13, identity=0.8):
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    out = {}
    for d, t in docs:
        w = cut(t)
        for i, it in items:
            x = cut(it)
            size = min(window, len(x))
            for shift in range(-len(x), len(w)):
                pairs = [(p, p + shift) for p in range(len(x)) if 0 <= p + shift < len(w)]
                if size and len(pairs) >= size and pairs:
                    same = [x[p] == w[q] for p, q in pairs]
                    good = [k for k in range(len(same) - size + 1) if sum(same[k : k + size]) >= identity * size - 1e-9]
                    if good and len(x) >= 3:
                        out[d, i] = max(out.get((d, i), 0), sum(same[good[0] : good[-1] + size]))
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(k))) for i, k in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 40])] + [(50, None), (51, ""), (52, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1")]
    docs = []
    for d in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            part = (rng.choice(items)[1] or "").split()
            part = [rng.choice(words) if rng.random() < 0.15 else w for w in part][rng.choice([0, 0, 1, 2]) :]
            k = rng.randrange(len(text) + 1)
            text[k:k] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
        docs.append((d, " ".join(text)))
    docs += [(200, None), (201, ""), (202, items[9][1] + " " + items[9][1]), (203, ("word " * 40_000) + items[14][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    for size in (1 << 24, 300):
        got = decontaminate.contaminated(df, bench, block_bytes=size)
        assert {(r.doc_id, r.item_id): r.n_matched for r in got.collect()} == want
        clean = decontaminate.decontaminate(df, bench, block_bytes=size)
        assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
        assert clean.columns == df.columns
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    unnamed = spark.createDataFrame([(None, items[13][1])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(df, unnamed).collect()} == {d for d, _ in docs} - {d for d, i in want if i == 13}


def test_masks_miss_every_allowed_set_of_substitutions():
    for words in range(3, 60):
        for window, identity in ((13, 0.8), (8, 0.7), (50, 0.8)):
            size, most = decontaminate._rule(words, window, identity)
            masks = decontaminate.masks_for(size, most)
            assert all(len(m) >= 2 for m in masks) or size < 4
            for gone in itertools.combinations(range(size), most):
                assert any(not {p + at for p in m} & set(gone) for m in masks for at in range(size - m[-1]))


def test_decontamination_finds_all_substituted_passages(spark):
    rng = random.Random(8)
    words = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(k))) for k in range(5, 20)]
    docs, want = [], set()
    for k, text in items:
        for _ in range(20):
            part = text.split()
            size = min(13, k)
            for p in rng.sample(range(k), 2 if size >= 10 else 1):
                part[p] = "other"
            want.add((len(docs), k))
            docs.append((len(docs), " ".join([*rng.choices(words, k=30), *part, *rng.choices(words, k=30)])))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert want <= {(r.doc_id, r.item_id) for r in got.collect()}


# URL filters


def test_urls_like_brute_force(spark):
    rng = random.Random(4)
    hosts = ["net", "a.net", "example.net", "b.example.net", "net.org", "org", "x.org", "xorg", "example.com", "EXAMPLE.com", "a\x01b.net"]
    paths = ["", "/", "/en", "/en/x", "/fr/", "/de/y/z", "/en/x?q=://net/en/", "#f"]
    rules = list({(rng.choice(hosts).lower(), rng.choice(["/", "/en/", "/fr/", "/e", "/de/y"])): rng.choice(["allow", "block"]) for _ in range(14)}.items())
    rules = [(*k, v) for k, v in rules]
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)] + [(900, None), (901, "no scheme"), (902, ""), (903, "http://")]

    def verdict(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("key", F.lit(0)).repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for n in (1, 5, 40):
        assert rows_of(urls.judge(df, table, partitions=n)) == sorted([(i, *verdict(u)) for i, u in pages], key=str)
    assert {r.verdict for r in urls.judge(df, table.limit(0)).collect()} == {"allow"}
    assert urls.judge(df.limit(0), table).count() == 0


# Archives


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(5)
    noise = lambda n: "".join(chr(rng.randrange(32, 0x300)) for _ in range(n))
    bodies = [None, "", "x" * 99, "y" * 100, noise(30_000), noise(700), "z" * 250_000]
    rows = [(i, rng.choice([None, f"http://h/{i} a\n"]), rng.choice(bodies)) for i in range(80)] + [(3, "u", "y" * 100), (None, "u", "y" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = "file://" + str(tmp_path / "archive")
    assert warc.write_warc(df, folder).agg(F.sum("records")).first()[0] == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        b, to = (h or "").encode(), first.get(h)
        to = None if to == i else to
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    for split in (1 << 25, 1000, 77):
        found = warc.read_warc(spark, folder, split_bytes=split)
        assert rows_of(warc.page_records(found)) == sorted(want, key=str)
    # A cut file loses its last record, bytes before the first do no harm.
    path = max((str(p) for p in (tmp_path / "archive").glob("part-*")), key=os.path.getsize)
    whole = list(warc.records(path, 0, os.path.getsize(path)))
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(b"\x1f\x8b\x08 noise" + data[:-3])
    assert [r[2]["x-page-id"] for r in warc.records(path, 0, len(data) + 9) if "x-page-id" in r[2]] == [r[2]["x-page-id"] for r in whole[:-1] if "x-page-id" in r[2]]
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    assert warc.write_warc(df.limit(0), folder).count() == 0


# Mixing


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), s) for s, n in (("big", 300), ("mid", 60), ("low", 10), (None, 5)) for i in range(n)]
    rows += [(1, None, "big"), (2, "", "empty"), (3, "a b", "big"), (3, "a b", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("pass", F.lit(0)).withColumn("tokens", F.lit(0))
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    total = sum(size.values())
    shares = [v / total for v in size.values() if v]
    entropy = lambda a: (lambda p: -sum(x * math.log(x) for x in p))([x**a / sum(y**a for y in shares) for x in shares])
    tokens = df.select("source", mixing.n_tokens(F.col("text")).alias("tokens"))
    plan = mixing.source_weights(tokens, target_entropy=0.9).collect()
    a = plan[0].exponent
    assert abs(entropy(a) - 0.9 * math.log(len(shares))) < 1e-6
    assert abs(sum(r.weight for r in plan) - 1) < 1e-9
    capped = mixing.source_weights(tokens, max_repeats=3.0, budget=2 * total).collect()
    assert max(r.quota / r.tokens for r in capped) <= 3.0 + 1e-6 and capped[0].exponent < 1
    used = mixing.mix(df, target_entropy=0.9, block_tokens=200).collect()
    took, times = Counter(), defaultdict(Counter)
    for r in used:
        took[r.source] += r.n_tokens
        times[r.source][r["pass"]] += 1
    longest = max(len((t or "").split()) for _, t, _ in rows)
    for r in plan:
        assert r.quota <= took[r.source] < r.quota + longest
        assert all(times[r.source][k] == sum(1 for x in rows if x[2] == r.source) for k in range(r.passes))
    ranks = [(r.source, r["pass"], r.block_rank, r.doc_rank) for r in used]
    assert len(set(ranks)) == len(ranks)
    assert mixing.mix(df.limit(0), target_entropy=0.9).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df)


def test_mixing_of_very_many_blocks(spark):
    """The order within a pass does not depend on how its blocks are shelved."""
    rows = [(i, "w " * (i % 7 + 1), "a" if i % 3 else "b") for i in range(3000)]
    used = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), target_entropy=0.99, block_tokens=5).collect()
    for source in "ab":
        for turn in {r["pass"] for r in used if r.source == source}:
            ranks = sorted({r.block_rank for r in used if r.source == source and r["pass"] == turn})
            assert len(ranks) > 100 and ranks[0] >= 1


def test_language_sample_is_bounded(spark):
    rows = [("the house and the tree " + str(i), "en") for i in range(40)] + [("das haus und der baum " * 2000 + str(i), "de") for i in range(40)] + [("une maison", "fr")]
    train = spark.createDataFrame(rows, "text string, lang string")
    trees = language.fit(train, max_docs=10, max_bytes=100_000)
    assert trees.languages == ["de", "en", "fr"]
    docs = spark.createDataFrame([(1, "the tree"), (2, "der baum"), (3, "la maison"), (4, "the house " * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, trees).collect()} == {1: "en", 2: "de", 3: "fr", 4: "en"}


def test_very_long_urls_and_pages(spark, tmp_path):
    rows = [(1, "http://h/" + "a" * 3_000_000, "x" * 200), (2, "http://h/" + "".join(random.Random(1).choices("abcdef0123456789", k=2_000_000)), "y" * 3_000_000), (3, "u", "z" * 10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2), "payload": F.lit("x"), "refers": F.lit(3)})
    folder = "file://" + str(tmp_path / "long")
    assert warc.write_warc(df, folder).agg(F.sum("records")).first()[0] == 3
    assert {(r.page_id, r.payload_bytes) for r in warc.page_records(warc.read_warc(spark, folder, split_bytes=5000)).collect()} == {(1, 200), (2, 3_000_000), (3, 10)}
    judged = urls.judge(df, urls.rules_frame(spark))
    assert {(r.page_id, r.host, len(r.path)) for r in judged.collect()} == {(1, "h", 3_000_001), (2, "h", 2_000_001), (3, "", 0)}


def test_many_copies_of_a_page_and_rules_of_a_host(spark, tmp_path):
    df = spark.createDataFrame([(i, None, "same page " * 20) for i in range(500)], "page_id long, url string, html string").repartition(7)
    folder = "file://" + str(tmp_path / "copies")
    assert warc.write_warc(df, folder).agg(F.sum("records")).first()[0] == 500
    found = warc.page_records(warc.read_warc(spark, folder)).collect()
    assert {(r.page_id, r.refers_to) for r in found} == {(0, None)} | {(i, 0) for i in range(1, 500)}
    rules = spark.createDataFrame([("h.org", "/" + "x" * n, "block") for n in range(1, 400)] + [("org", "/", "allow"), ("h.org\U0010ffff", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(n, "http://a.h.org/" + "x" * n + "y") for n in range(0, 400, 7)] + [(999, "http://\U0010ffffz.org/q")], "page_id long, url string")
    got = {r.page_id: r.rule for r in urls.judge(pages, rules, partitions=9).collect()}
    assert got == {n: "h.org/" + "x" * n if n else "org/" for n in range(0, 400, 7)} | {999: "org/"}
