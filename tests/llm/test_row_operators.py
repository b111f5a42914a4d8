"""Operators that judge rows one by one, held against brute force."""

import base64
import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.llm import byte_bpe, common, decontaminate, license_scan, quality_rules, secret_scan, toxicity, url_filter


def pairs(rows):
    return collections.Counter(map(str, rows))


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken(docs, empty, texts, own):
    args = byte_bpe._public()
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs, *args).collect()]
    want = []
    for i, t in texts:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert pairs(got) == pairs(want)
    assert byte_bpe.digests(empty, *args).count() == 0
    assert pairs((r.doc_id, list(r.ids)) for r in byte_bpe.encode(docs, *args).collect()) == pairs((i, own.encode_ordinary(t or "")) for i, t in texts)


def test_bpe_edits(own):
    encoder, r = byte_bpe.encoder_for(*byte_bpe._public()), random.Random(3)
    for _ in range(300):
        e = byte_bpe.Editable(encoder, "".join(r.choice("ab  \n\t.,'sé日0") for _ in range(r.randrange(40))))
        for _ in range(4):
            a = r.randint(0, len(e.text))
            e.replace(a, r.randint(a, len(e.text)), "".join(r.choice("ab  \n.'s0") for _ in range(r.randrange(5))))
            assert e.ids() == own.encode_ordinary(e.text)
        e.append(" and more")
        assert e.ids() == own.encode_ordinary(e.text)
    long = byte_bpe.Editable(encoder, "some words here " * 2000)
    assert long.replace(16000, 16003, "xyz") < 12
    state = byte_bpe.Prefixes(encoder.vocabulary, b" unbeliev")
    state.append(b"ableness")
    assert state.ids() == own.encode_ordinary(" unbelievableness")


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql)


def as_rows(frame, columns):
    return pairs(tuple(r[c] for c in columns) for r in frame.collect())


@pytest.mark.parametrize("module, run, least", [(quality_rules, quality_rules.judge, 1), (secret_scan, None, 2)])
def test_against_sql(spark, docs, empty, module, run, least, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    query = module.op10_quality_rules if module is quality_rules else module.op5_secret_scan
    got = query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(module.SQL)
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert as_rows(got, names) == pairs(want.fetchall())
    assert query(spark, f"{tmp_path}/none").count() == 0


def test_secret_spans(docs, texts):
    """Spans by Python's re, which knows positions."""
    got = {}
    for r in secret_scan.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(sorted((s.start, s.kind_order, s.end) for k in secret_scan.RULES for s in r[k.kind]))
    for i, t in texts:
        want = []
        for k, rule in enumerate(secret_scan.RULES):
            want += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, t or "") if len(m.group(rule.group)) >= rule.least]
        assert sorted(want) in got[i]
    assert any(any(x) for x in got.values())


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_trigram_queries(rule):
    """Every match of a pattern fulfils the query derived from it, and no alternative is there without a reason."""
    query, met = rule.query(), set()
    assert bool(query) == (rule.kind != "hex")

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.from_regex(rule.pattern, fullmatch=True))
    def holds(text):
        folded = secret_scan.folded(text)
        fulfilled = [a for a in query if all(t in folded for t in a)]
        assert fulfilled or not query
        met.update(fulfilled)

    holds()
    assert len(met) >= min(3, len(query))


def test_trigram_query_of_any_pattern():
    query = lambda p: sorted(sorted(x) for x in secret_scan.trigram_query(p))
    assert query("abcd") == [["abc", "bcd"]] and query("AB") == [[]] and query("(abc|xyz)+q*") == [["abc"], ["xyz"]]
    assert query("ab?cd") == [["abc", "bcd"], ["acd"]] and query("abc|d") == [[]] and query("a.c") == [[]]
    assert query("foo[0-9]+bar") == [["bar", "foo"]] and query("[xy]yz") == [["xyz"], ["yyz"]] and query("(?:ab){2}") == [[]]


def test_many_spans_in_one_text(spark):
    """The work grows with the number of matches, not with its square."""
    n = 40_000
    text = "é ".join(f"{k:016x}" for k in range(n)) + " token=" + "Z" * 14
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.start, x.end) for x in got.hex] == [(18 * k, 18 * k + 16) for k in range(n)]
    assert [(x.start, x.end) for x in got.assign] == [(18 * n - 1, 18 * n + 19)]


def test_quality_stage(spark, docs, texts):
    kept = quality_rules.stage(spark, docs, "")
    assert kept.columns == docs.columns
    powers = quality_rules.Powers()
    assert pairs((r.doc_id, r.text) for r in kept.collect()) == pairs((i, t) for i, t in texts if quality_rules.measure((t or "").encode(), powers)[6])


def test_word_hashes():
    r, known = random.Random(5), {}
    for _ in range(500):
        text = "".join(r.choice("aAb c\n\té\x0b") for _ in range(r.randrange(60))).encode()
        words = text.lower().split()
        hashes = common.word_hashes(text).tolist()
        assert len(hashes) == len(words)
        assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    long = b" ".join(r.choice(list(known)) for _ in range(60_000)) + b" " + b"z" * 200_000 + b" a"
    assert common.word_hashes(long).tolist()[:60_000] == [known[w] for w in long.split()[:60_000]]
    assert len(common.word_hashes(long)) == len(long.split())


@pytest.mark.parametrize("block_bytes", [8 << 20, 600])
def test_decontaminate(spark, texts, block_bytes, monkeypatch, tmp_path):
    from tests.llm.conftest import frame, prose

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = [(0, prose(20, 30)), (1, prose(21, 400)), (2, "too short"), (3, None), (4, ""), (None, prose(22, 12)), (6, prose(20, 30)), (7, prose(23, 5)), (8, prose(24, 8)), (9, "Singleword")]
    r = random.Random(1)
    data = list(texts)
    for k in range(90):
        item = items[r.choice([0, 1, 2, 5, 7, 8, 9])][1].split()
        for _ in range(r.randrange(3)):
            item[r.randrange(len(item))] = "changed"
        front = prose(100 + k, r.randrange(300) if k % 4 else 0)
        data.append((1000 + k, front + " " + "\n".join(item).upper() + " " + prose(200 + k, r.randrange(3000))))
    docs = frame(spark, data)

    def shingles(words, size):
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}

    want = []
    for i, t in data:
        for j, x in items:
            doc, item = ((y or "").encode().lower().split() for y in (t, x))
            size = min(5, len(item))
            if size:
                a, b = shingles(doc, size), shingles(item, size)
                if 100 * len(a & b) >= 80 * len(b):
                    want.append((i, j, len(b), len(a & b)))
    assert len(want) > 40 and {j for _, j, *_ in want} >= {0, 1, 2, None, 7, 8, 9}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert pairs((x.doc_id, x.item_id, x.n_item_shingles, x.n_shared) for x in decontaminate.search(docs, bench).collect()) == pairs(want)
    hit = {i for i, *_ in want}
    assert pairs((x.doc_id, x.text) for x in decontaminate.clean(docs, bench).collect()) == pairs((i, t) for i, t in data if i not in hit)
    assert decontaminate.search(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(data)
    assert decontaminate.search(docs.limit(0), bench).count() == 0
    if block_bytes > 1000:
        con = duckdb.connect()
        for name, df in (("documents", docs), ("benchmark", bench)):
            df.write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        got = con.execute(decontaminate.SQL).fetchall()
        assert pairs(x[:4] for x in got) == pairs(want)


def test_toxicity(spark, docs, empty):
    from tests.llm.conftest import frame, prose

    r, data, marks = random.Random(2), [], []
    for k in range(600):
        bad = k % 4 == 0
        words = prose(k, 40).split()
        for _ in range(r.randrange(1, 6) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["nasty,", "Vile", "rotten."]))
        data.append((k, " ".join(words)))
        if k < 400:
            marks += [(k, int(bad))] * (1 + k % 2)
    labels = spark.createDataFrame(marks + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    rows, toxic, shares = toxicity.sample(frame(spark, data), labels)
    assert len(rows) == 400 and toxic.sum() == 100
    model = toxicity.fit(rows, toxicity.graded(toxic, shares))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    got = {x.doc_id: x for x in toxicity.score(frame(spark, data), model).collect()}
    held = [(got[k].toxic, k % 4 == 0) for k in range(400, 600)]
    assert sum(a == b for a, b in held) >= 196
    # Severity by hand from the model: each word's bucket once, sigmoid of weights less threshold, summed over thresholds.
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for k, text in data[::37]:
        words = set(re.findall("[a-z0-9']+", text.lower()))
        score = sum(weights.get(b, 0.0) for b in {xxhash.xxh3_64_intdigest(w.encode()) % toxicity.BUCKETS for w in words})
        assert abs(sum(1 / (1 + math.exp(x - score)) for x in model.thresholds.tolist()) - got[k].expected_severity) < 1e-4
    # What is fitted is the least penalised negative log-likelihood: no small step from it does better.
    grades = toxicity.graded(toxic, shares)

    def loss(weights, thresholds):
        at = {b: w for b, w in zip(model.buckets.tolist(), weights, strict=True)}
        out, seen = 0.0, {}
        for row, grade in zip(rows, grades.tolist(), strict=True):
            seen[row.tobytes(), grade] = row
        for (_, grade), row in seen.items():
            score = sum(at.get(b, 0.0) for b in row.tolist())
            above = [1.0, *[1 / (1 + math.exp(x - score)) for x in thresholds], 0.0]
            out -= math.log(max(above[grade] - above[grade + 1], 1e-12))
        return out / len(seen) + toxicity.RIDGE / 2 * float(weights @ weights)

    best, r2 = loss(model.weights, model.thresholds), np.random.default_rng(0)
    for _ in range(6):
        step = r2.normal(0, 0.05, len(model.weights))
        assert loss(model.weights + step, model.thresholds) > best - 1e-3
        assert loss(model.weights, model.thresholds + r2.normal(0, 0.2, 2).cumsum() * 0.5) > best - 1e-3
    assert all(0 <= x.expected_severity <= 2 and x.grade in (0, 1, 2) for x in got.values())
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.filter("expected_severity is null").count() == 0
    assert toxicity.score(empty, model).count() == 0
    flat = toxicity.fit([], np.zeros(0, np.int64))
    none = toxicity.sample(empty, labels)
    assert none[0] == [] and len(toxicity.graded(*none[1:])) == 0 and {x.expected_severity < 1e-9 for x in toxicity.score(docs, flat).collect()} == {True}


def test_licences(spark, docs, empty):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "code"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0\ncode"),
        (4, "a/b/c/z.py", "no notice, but a version of the work under license"), (5, "a/b/c/COPYING.txt", "nothing"), (6, "top.py", None), (None, None, None),
        (7, "d/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (8, "d/e/f", ""), (8, "d/e/f", ""), (9, "ab/x.py", "code"),
    ]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = pairs((r.file_id, r.licence, r.origin) for r in license_scan.scan(files).collect())
    assert got == pairs([
        (1, "MIT", "header"), (2, "MIT", "inherited"), (3, "Apache-2.0", "header"), (4, "MIT", "inherited"), (5, "MIT", "inherited"), (6, None, None), (None, None, None),
        (7, "GPL-3.0", "header"), (8, "GPL-3.0", "inherited"), (8, "GPL-3.0", "inherited"), (9, None, None),
    ])
    found = license_scan.scan(license_scan.as_files(docs))
    assert found.count() == docs.count() and found.filter("licence = 'Apache-2.0' and origin = 'header'").count() == 1
    assert license_scan.scan(license_scan.as_files(empty)).count() == 0


def brute_scan(rows, templates, least):
    """Licence, cosine and origin of each file by comparing all windows and whole licence files with all templates."""
    weights = license_scan.Weights(templates, least)

    def top(text, is_licence):
        lines = [x for x in text.split("\n") if re.search("[A-Za-z0-9]", x)]
        units = [(" ".join(lines[i : i + n]), False) for n in (1, 2, 3) for i in range(len(lines))] + [(text, True)] * is_licence
        found = []
        for unit, file in units:
            words = re.findall("[a-z0-9]+", unit.lower())
            x = {t: words.count(t) * weights.idf.get(t, weights.unknown) for t in set(words)}
            norm = math.sqrt(sum(v * v for v in x.values()))
            found += [(-round(sum(x.get(t, 0) * w for t, w in v.items()) / norm, 6), name) for (name, v), whole in zip(weights.vectors, weights.whole, strict=True) if norm and (file or not whole)]
        best = min(found, default=(0, None))
        return best if -best[0] >= least else None

    licence = lambda p: bool(re.search(license_scan.LICENCE_NAME, p.rsplit("/", 1)[-1]))
    directory = lambda p: p.rpartition("/")[0].rstrip("/")
    own = [top(t or "", licence(p or "")) for _, p, t in rows]
    held = {}
    for (_, p, _), x in zip(rows, own, strict=True):
        if x and licence(p or ""):
            held[directory(p)] = min(held.get(directory(p), x), x)
    out = []
    for (i, p, _), x in zip(rows, own, strict=True):
        steps, origin = directory(p or "").split("/"), "header"
        if x is None:
            x = next((held[d] for k in range(len(steps), 0, -1) if (d := "/".join(steps[:k])) in held), None)
            origin = "inherited"
        out.append((i, *((x[1], round(-x[0], 4), origin) if x else (None, None, None))))
    return out


def test_licences_by_brute_force(spark, docs, tmp_path):
    """The query itself, and files with pieces of templates, against comparing everything with everything."""
    r = random.Random(4)
    pool = [w for own in license_scan.TEMPLATES.values() for x in own for w in x.split()] + "some other words of any prose and code".split()
    pieces = [x for own in license_scan.TEMPLATES.values() for x in own] + [f"// SPDX-License-Identifier: {k}" for k in license_scan.TEMPLATES]
    rows = []
    for k in range(120):
        lines = [" ".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(4))]
        if k % 2:
            words = r.choice(pieces).split()
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = "changed"
            cut = r.randrange(len(words) + 1)
            lines.insert(r.randrange(len(lines) + 1), " ".join(words[:cut]) + r.choice(["\n", " ", "\n\n * "]) + " ".join(words[cut:]))
        rows.append((k, f"{r.choice('ab')}/{r.choice('xy')}/{r.choice(['LICENSE', 'f.py', 'COPYING', 'g.c'])}", "\n".join(lines)))
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = pairs((x.file_id, x.licence, x.cosine and round(x.cosine, 4), x.origin) for x in license_scan.scan(files).collect())
    want = pairs(brute_scan(rows, license_scan.TEMPLATES, license_scan.LEAST))
    assert sum((want - got).values()) <= 2 and sum("header" in x for x in want) > 20  # cosines may round apart
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tree = [tuple(x) for x in license_scan.as_files(docs).collect()]
    got = pairs((x.doc_id, x.licence, x.origin) for x in license_scan.op9_license_scan(spark, str(tmp_path)).collect())
    assert got == pairs((i, a, o) for i, a, _, o in brute_scan(tree, license_scan.TEMPLATES, license_scan.LEAST))


def all_licences(text, is_licence, weights, least):
    """Every licence with a template that any window or the whole licence file reaches the threshold with, and the best cosine."""
    lines = [x for x in text.split("\n") if re.search("[A-Za-z0-9]", x)]
    found = {}
    for unit in [" ".join(lines[i : i + n]) for n in (1, 2, 3) for i in range(len(lines))] + [text] * is_licence:
        x = collections.Counter(re.findall("[a-z0-9]+", unit.lower()))
        x = {t: n * weights.idf.get(t, weights.unknown) for t, n in x.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        for name, v in weights.vectors if norm else ():
            found[name] = max(found.get(name, 0), sum(x.get(t, 0) * w for t, w in v.items()) / norm)
    return {name: round(c, 4) for name, c in found.items() if round(c, 6) >= least}


def test_every_licence(spark):
    """No licence that reaches the threshold is left out: not the second of a file or directory, nor a short licence's text on a
    few lines of any file, nor a name next to a letter that no term has."""
    mit, isc, bsd = (license_scan.TEMPLATES[k][-1] for k in ("MIT", "ISC", "BSD-3-Clause"))
    one = lambda text: " ".join(text.split())
    cut = lambda text, n: "\n".join(" ".join(text.split()[k : k + len(text.split()) // n + 1]) for k in range(0, len(text.split()), len(text.split()) // n + 1))
    rows = [
        (0, "a/LICENSE", "MIT License\n\ncode\n\nApache License 2.0\n"), (1, "a/b/x.py", "code"), (2, "two/LICENSE", "ISC License"), (3, "two/COPYING", "Apache License 2.0"), (4, "two/y.py", None),
        (5, "m.py", one(mit)), (6, "m3.py", cut(mit, 3) + "\nint x;"), (7, "i.c", one(isc)), (8, "b.c", cut(bsd, 2)), (9, "s.md", "_MIT License_"), (10, "t.md", "\u00e9MIT License\u00e9"),
        (11, "k.c", "SPDX_License_Identifier_Apache_2_0"), (12, "long.txt", "license " + "the " * 60_000), (13, "p.txt", "of the or and in any copyright"), (14, "g.c", "CC0 1.0 Universal\nGNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
        (15, "part.c", " ".join(mit.split()[:120])), (16, "less.c", " ".join(mit.split()[:40])),
    ]
    weights = license_scan.Weights(license_scan.TEMPLATES, license_scan.LEAST)
    want = {i: all_licences(t or "", "LICENSE" in p or "COPYING" in p, weights, license_scan.LEAST) for i, p, t in rows}
    want |= {1: want[0], 4: {**want[2], **want[3]}}
    assert {"MIT", "Apache-2.0"} <= set(want[0]) and {"ISC", "Apache-2.0"} <= set(want[4]) and all(want[k] for k in (5, 6, 7, 8, 9, 10, 11, 15)) and not want[12]
    got = license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()
    assert {r.file_id: {x.licence: round(x.cosine, 4) for x in r.licences} for r in got} == want
    for r in got:
        assert r.licence is None or (r.licence, round(r.cosine, 4)) in {(x.licence, round(x.cosine, 4)) for x in r.licences}
        assert r.licences == sorted(r.licences, key=lambda x: (-x.cosine, x.licence))


def test_real_licences(spark):
    """Titles, identifier lines and texts as they stand in files."""
    mit = "Copyright (c) 2020 Some One\n\n" + license_scan.TEMPLATES["MIT"][-1]
    gnu = lambda title, v: f"                    {title}\n                       {v}\n\n Copyright (C) 2007 Free Software Foundation\n Everyone is permitted to copy\n"
    cases = [
        ("MIT", mit), ("MIT", "MIT License\n\n" + mit), ("MIT", "The MIT License (MIT)"), ("MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
        ("GPL-1.0", gnu("GNU GENERAL PUBLIC LICENSE", "Version 1, February 1989")), ("GPL-2.0", gnu("GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991")), ("GPL-3.0", gnu("GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007")),
        ("LGPL-2.0", gnu("GNU LIBRARY GENERAL PUBLIC LICENSE", "Version 2, June 1991")), ("LGPL-2.1", gnu("GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999")), ("LGPL-3.0", gnu("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007")),
        ("AGPL-3.0", gnu("GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007")), ("GFDL-1.3", gnu("GNU Free Documentation License", "Version 1.3, 3 November 2008")), ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n  text"),
        ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n   TERMS"), ("MPL-2.0", "Mozilla Public License Version 2.0\n======"), ("ISC", license_scan.TEMPLATES["ISC"][-1]),
        ("BSD-2-Clause", "Copyright 2020\n" + license_scan.TEMPLATES["BSD-2-Clause"][-1]), (None, "Just a file about the license of a driver, version 2.\nAll rights reserved."), (None, "SPDX-License-Identifier: Other-9.9"),
    ]
    files = spark.createDataFrame([(k, f"d{k}/LICENSE", t) for k, (_, t) in enumerate(cases)], "file_id long, path string, text string")
    got = {x.file_id: x.licence for x in license_scan.scan(files).collect()}
    assert [got[k] for k in range(len(cases))] == [name for name, _ in cases]


def test_url_filter(spark, tmp_path):
    r = random.Random(6)
    hosts = ["example.org", "a.example.org", "EXAMPLE.com", "b.com", "x.net", "org", "badexample.org"]
    urls = [None, "", "no scheme", "http://", "://", "https://h?x/y", "https://h#y", "http://x.net/en/1/2/3/4?q=://", "a\nb://C.com/fr/9", "http://org", "http://example.org/en/1", "http://u:p@a.com:80/de/"]
    urls += [f"http://{r.choice(hosts)}/{r.choice(['es', 'en', 'fr', 'de', 'EN'])}/{r.randrange(60)}{r.choice(['', '/', '.html', '/a/b', '?p=1'])}" for _ in range(600)]
    rows = [(i, u, "<html>", 1.5) for i, u in enumerate(urls)] + [(None, "http://x.net/en/1", None, None), (3, "http://", None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, template double").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op1_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(url_filter.SQL)
    names = [x[0] for x in want.description]
    assert as_rows(got, names) == pairs(want.fetchall())
    for row in got.collect():
        url = next(u for i, u, *_ in rows if i == row.page_id)
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        if row.page_id is not None:
            assert (row.host, row.path) == (host, path)
            best = max(fit, key=lambda x: len(x.text), default=None)
            assert row.rule == (best and best.text)
            assert best is None or row.verdict == ("block" if best.block else "allow")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert url_filter.op1_url_filter(spark, f"{tmp_path}/none").count() == 0


def test_url_verdicts_by_templates(spark):
    """Labels reach urls without a rule through their template, merged branches, the host and the domain; without labels in
    the domain nothing is rejected."""
    rules = (url_filter.Rule("shop.com", "/ads/x", True), url_filter.Rule("news.com", "/", False), url_filter.Rule("bad.com", "/a/", True), url_filter.Rule("bad.com", "/b/", True), url_filter.Rule("mixed.com", "/good/", False), url_filter.Rule("mixed.com", "/ill/", True))
    urls = [f"http://shop.com/ads/x{k}" for k in range(40)] + [f"http://shop.com/ads/other{k}" for k in range(5)]
    urls += [f"http://news.com/{k}" for k in range(60)] + [f"http://bad.com/{s}/{k}" for s in "ab" for k in range(20)] + [f"http://bad.com/c/{k}" for k in range(5)]
    urls += [f"http://mixed.com/{s}/{k}" for s in ("good", "ill") for k in range(40)] + [f"http://mixed.com/good{k}" for k in range(4)]
    urls += [f"http://new.com/{k}" for k in range(3)] + [f"http://else.net/ads/{k}" for k in range(9)] + [None]
    got = {r.path if r.host != "else.net" else r.host: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    verdict = {u: r.verdict for u, r in got.items()}
    assert got["/ads/x1"].template.startswith("/ads/*") and got["/ads/other1"].rule is None
    assert verdict["/ads/other1"] == "block"  # its template is labelled
    assert verdict["/c/1"] == "block" and got["/c/1"].template.startswith("/c/*")  # no label of its own, but all around it
    assert verdict["/good/1"] == "allow" and verdict["/ill/1"] == "block"
    assert verdict["else.net"] == "allow" and verdict[""] == "allow" and got["/7"].verdict == "allow"


def test_url_branches_do_not_depend_on_size(spark):
    """A section with enough urls stays a branch however many others there are."""
    for others in (3, 40):
        urls = [f"http://h.com/ads/{k}" for k in range(60)] + [f"http://h.com/s{j}/{k}.html" for j in range(others) for k in range(5)] + ["http://h.com/rare/1/2/3/4/5/6", "http://h.com/0123abcd9/x"]
        rows = url_filter.generalised(spark.createDataFrame([("h.com", u[12:]) for u in urls], "host string, path string"))
        got = {r.path: r.template for r in rows.collect()}
        assert got["/ads/3"] == "/ads/*///" and got["/s1/4.html"] == "/s1/*///" and got["/rare/1/2/3/4/5/6"] == "/*/*/*/*/**" and got["/0123abcd9/x"] == "/*/*///"
