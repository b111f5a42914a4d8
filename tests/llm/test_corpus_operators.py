"""Operators that compare rows with each other, held against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import frame, prose
from tidelake.llm import common, components, line_dedup, lm_scoring, near_dedup, quality_rules


def tally(rows):
    return collections.Counter(map(str, rows))


def shingles(text, words):
    found = (text or "").encode().lower().split()
    size = min(words, len(found)) or 1
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1)) if found else frozenset()


def brute_groups(data, words):
    """component_id of each row, by comparing all pairs."""
    sets = [shingles(t, words) for _, t in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(data):
        if i is not None:
            ids[root(k)].append(i)
    return [(i, len(sets[k]), min(ids[root(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(data)]


def variants(seed, n, words, most):
    """Texts that each differ from one base in up to ``most`` words, so that many pairs are near the threshold."""
    r, base = random.Random(seed), prose(seed, words).split()
    for _ in range(n):
        out = list(base)
        for _ in range(r.randrange(most + 1)):
            out[r.randrange(len(out))] = f"v{r.randrange(10**6)}"
        yield " ".join(out)


@pytest.fixture(scope="module")
def crowd(texts):
    data = list(texts)
    for seed, n, words, most in ((50, 60, 60, 5), (51, 60, 600, 45), (52, 50, 130, 9), (53, 40, 12, 2), (54, 30, 430, 30)):
        data += [(1000 * seed + k, t) for k, t in enumerate(variants(seed, n, words, most))]
    data += [(90_000 + k, "a common passage of a few words that many share " * 1 + prose(900 + k, 12)) for k in range(30)]
    return data


@pytest.mark.parametrize("words, block", [(4, 1024), (5, 16)])
def test_near_groups(spark, crowd, words, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = near_dedup.groups(frame(spark, crowd), words)
    want = brute_groups(crowd, words)
    assert len({w[2] for w in want}) < len(want) - 60
    assert tally((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == tally(want)
    assert all(r.kept == (r.doc_id == r.component_id or r.component_id is None) for r in got.collect())


def test_near_links_survive_without_stars(spark, crowd, monkeypatch):
    """With no candidates but the blocks of buckets, the components are the same."""
    monkeypatch.setattr(near_dedup, "FEW", 1)
    monkeypatch.setattr(near_dedup, "_pairs", lambda members: members.select("node", "node").toDF("u", "v").limit(0))
    got = near_dedup.groups(frame(spark, crowd), 4)
    assert tally((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == tally(brute_groups(crowd, 4))


@pytest.mark.parametrize("n, shared", [(5, 5), (9, 8), (27, 24), (90, 80), (270, 240), (900, 800)])
def test_signatures_find_similar_sets(n, shared):
    """Pairs of sets of any size at the threshold share a bucket and pass the signature filter; bins agree as often as sets do."""
    signer, r = near_dedup.Signer(), np.random.default_rng(n)
    agreed, trials = [], 400
    with np.errstate(over="ignore"):
        for _ in range(trials):
            x = r.integers(0, 1 << 63, 2 * n - shared, np.uint64) * np.uint64(2)
            a, b = (signer.values(np.sort(y)) for y in (x[:n], np.r_[x[:shared], x[n:]]))
            assert (signer.keys(a) == signer.keys(b)).any()
            agreed.append((a == b).sum())
    assert min(agreed) >= near_dedup.LEAST_AGREEING
    assert abs(np.mean(agreed) / near_dedup.BINS - shared / (2 * n - shared)) < 0.02


def test_near_empty_and_stage(spark, empty, crowd):
    assert near_dedup.groups(empty).count() == 0
    kept = near_dedup.stage(spark, frame(spark, crowd), "")
    ids = {w[0] for w in brute_groups(crowd, 5) if w[0] == w[2] and w[0] is not None}
    got = [r.doc_id for r in kept.collect()]
    assert {i for i in got if i is not None} == ids and len(got) - got.count(None) == len(ids)
    assert kept.columns == frame(spark, []).columns


def test_components(spark):
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if x != 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=14), st.text("abé", max_size=14), st.integers(0, 4))
def test_distance(a, b, most):
    assert line_dedup.distance(a, b, most) == min(edit(a, b), most + 1)


@settings(max_examples=400, deadline=None)
@given(st.text("ab日", min_size=4, max_size=24), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["", "a", "c"]), st.booleans()), max_size=3))
def test_linked_lines_meet(a, edits):
    b = a
    for at, c, replace in edits:
        b = b[:at] + c + b[at + replace :]
    s, t = sorted([a, b], key=len)
    for k in (1, 2, 3):
        if s != t and len(s) > k and edit(s, t) <= k:
            assert meet(s, t, k)


def meet(s, t, k, parent=None):
    """Whether two lines share a key under which what is left of them shares one, and so on."""
    shared = {x for x, own, _, _ in line_dedup.pieces_of(s, k, parent) if own} & {x for x, _, _, _ in line_dedup.pieces_of(t, k, parent)}
    if not shared or max(len(s), len(t)) <= 2 * k:
        return bool(shared)
    return any(
        edit(*sorted([a, b], key=len)) <= k and (a == b or meet(a, b, k, x)) for x in shared for a in line_dedup.rests_of(s, k, x, parent) for b in line_dedup.rests_of(t, k, x, parent) if len(a) <= len(b)
    )


def spark_hash(data, *before):
    """xxhash64 of a string as Spark has it, after other values (a long, an int, a string)."""
    seed = 42
    for x in (*before, data):
        if x is not None:
            raw = x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True) if not isinstance(x, np.int32) else int(x).to_bytes(4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def key_of_row(i, t):
    data = None if t is None else t.encode()
    return b"".join(spark_hash(data, *before, i).to_bytes(8, "big") for before in ((), (np.int32(1),)))


def linked_lines(spark, data, edits, **kw):
    docs = frame(spark, data)
    name = {signed(spark_hash(x.encode())): x for _, t in data for x in t.split("\n")}
    got = line_dedup.links(docs, common.written(line_dedup._lines(docs)), edits, **kw).collect()
    out = {tuple(sorted((name[x.hi_a], name[x.hi_b]), reverse=True)) for x in got}
    assert len(out) == len(got)
    return out


def test_row_key(spark, texts):
    data = [x for x in texts] + [(7, None), (-1, "")]
    got = frame(spark, data).select("doc_id", "text", common.row_key().alias("k")).collect()
    assert all(bytes(r.k) == key_of_row(r.doc_id, r.text) for r in got)


@pytest.mark.parametrize("batch", [16, 10_000])
def test_links_under_crowded_keys(spark, batch):
    """Many lines with a common heading: the keys of the heading are split until few lines meet."""
    r, edits = random.Random(12), 1
    tails = [f"{r.randrange(10**6):06d}{c}" for c in ("", "é", " and so on") for _ in range(120)]
    tails += [t[:3] + r.choice("0x") + t[3 + r.randrange(2) :] for t in tails[::3]]
    heading = "Posted to the common list, number "
    tails = sorted(set(tails))
    lines = [heading + t for t in tails]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = linked_lines(spark, [(k, "\n".join(lines[k % 3 :: 3])) for k in range(5)], edits, meeting=8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # A common heading doesn't change the distance.
    want = {(heading + x, heading + y) for i, x in enumerate(tails) for y in tails[:i] if abs(len(x) - len(y)) <= edits and edit(x, y) <= edits}
    assert len(want) > 100 and got == want


def test_replaced_word_in_long_line(spark, tmp_path):
    """A word that differs by two edits in a long line, as op6 and the pipeline's stage see it."""
    line = prose(900, 40)
    changed = line[:130] + "zz" + line[132:]
    assert len(line) > 270 and edit(line, changed) == 2
    data = [(1, line), (2, changed), (3, prose(901, 40)), (4, None), (5, " ")]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_near_dropped, x.n_links, x.class_id) for x in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1, 1), 2: (1, 1, 1), 3: (0, 0, 3), 4: (0, 0, 4), 5: (0, 0, 5)}
    # A row that repeats others in all its lines goes; rows that had no text stay as they are.
    assert {x.doc_id: x.text for x in line_dedup.stage(spark, frame(spark, data), "").collect()} == {1: line, 3: data[2][1], 4: None, 5: " "}


def test_very_long_lines(spark):
    """Lines beyond the rolling hash's reach, one of them with letters of several bytes."""
    for base in ("abcdefghij klmnopq " * 1500, "日é😀 x" * 6000):
        line = prose(950, 20) + base
        data = [(1, line), (2, line[:9000] + "Z" + line[9001:] + "!"), (3, "Q" + line[:20000] + "W" + line[20000:])]
        assert linked_lines(spark, data, 2) == {tuple(sorted((line, t), reverse=True)) for t in (data[1][1], data[2][1])}


def test_crowded_keys_with_two_edits(spark, monkeypatch):
    """Keys of a common heading are split for two edits, too."""
    r, refined, calls = random.Random(13), line_dedup._refined, []
    monkeypatch.setattr(line_dedup, "_refined", lambda *a: calls.append(1) or refined(*a))
    tails = [f"{r.randrange(10**7):07d}{c}" for c in ("", "é so on") for _ in range(60)]
    tails = sorted({*tails, *(t[:2] + r.choice("0x") + t[2 + r.randrange(2) : 5] + t[5 + r.randrange(2) :] for t in tails[::2])})
    heading = "Posted to the list, no. "
    lines = [heading + t for t in tails]
    got = linked_lines(spark, [(k, "\n".join(lines[k % 3 :: 3])) for k in range(4)], 2, meeting=12)
    want = {(heading + x, heading + y) for i, x in enumerate(tails) for y in tails[:i] if abs(len(x) - len(y)) <= 2 and edit(x, y) <= 2}
    assert len(calls) > 0 and len(want) > 40 and got == want


def brute_lines(data, edits):
    """For each row: id, lines that count, equal and near ones that go, links, class, digest of what is kept; and the texts kept."""
    counts = lambda line: bool(line.encode().split())
    keys = [key_of_row(i, t) for i, t in data]
    order = sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0] or 0, keys[k]))
    first, holders = {}, collections.defaultdict(list)
    for k in order:
        for number, line in enumerate((data[k][1] or "").split("\n")):
            if counts(line):
                first.setdefault(line, (keys[k], number))
                holders[line].append(k)
    names = list(first)
    long = [x for x in names if len(x.strip(" ")) >= line_dedup.MIN_CHARS]
    late, degree, joined = set(), collections.Counter(), [*holders.values()]
    for x in range(len(long)):
        for y in range(x):
            if abs(len(long[x]) - len(long[y])) <= edits and edit(long[x], long[y]) <= edits:
                late.add(long[x])
                degree[long[x]] += 1
                degree[long[y]] += 1
                joined.append([holders[long[x]][0], holders[long[y]][0]])
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for rows in joined:
        for k in rows:
            parent[root(keys[k])] = root(keys[rows[0]])
    least = {}
    for k in order:
        least.setdefault(root(keys[k]), data[k][0])
    out, kept_texts = [], []
    for k, (i, t) in enumerate(data):
        lines, kept, equal, near, links = (t or "").split("\n"), [], 0, 0, 0
        for number, line in enumerate(lines):
            if counts(line):
                links += degree[line]
                if first[line] != (keys[k], number):
                    equal += 1
                    continue
                if line in late:
                    near += 1
                    continue
            kept.append(line)
        out.append((i, sum(map(counts, lines)), equal, near, links, least[root(keys[k])], hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        text = "\n".join(kept)
        kept_texts.append(t if not equal + near else text if counts(text) else ...)
    return out, kept_texts


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, texts, edits, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP", 7)
    monkeypatch.setattr(line_dedup, "NEIGHBOURS", 4)
    data, r = list(texts), random.Random(7)
    lines = [prose(300 + k, 6) for k in range(12)]
    for k in range(60):
        line = r.choice(lines)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(line))
            line = line[:at] + r.choice(["", "é", "zz"]) + line[at + r.randrange(2) :]
        data.append((500 + k if k % 9 else None, "\n".join([prose(400 + k, 8), line, "short", line if k % 7 == 0 else ""])))
    judged, found = line_dedup.judged_lines(frame(spark, data), edits)
    assert found.count() > 5
    want, kept = brute_lines(data, edits)
    got = line_dedup.deduplicated(frame(spark, data), judged).collect()
    assert tally((x.doc_id, hashlib.sha256((x["__kept"] or "").encode()).hexdigest()) for x in got) == tally((w[0], w[-1]) for w in want)
    if edits == line_dedup.EDITS:
        frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
        got = line_dedup.op6_line_dedup(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_lines", "n_equal_dropped", "n_near_dropped", "n_links", "class_id", "kept_sha256"]
        assert tally(tuple(x) for x in got.collect()) == tally(want)
        staged = line_dedup.stage(spark, frame(spark, data), "")
        assert staged.columns == frame(spark, []).columns
        assert tally((x.doc_id, x.text) for x in staged.collect()) == tally((i, t) for (i, _), t in zip(data, kept, strict=True) if t is not ...)
        frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
        assert line_dedup.op6_line_dedup(spark, f"{tmp_path}/none").count() == 0
        with pytest.raises(ValueError):
            line_dedup.deduplicated(frame(spark, data).withColumn("__kept", F.lit(1)), judged)


def test_lm_scores(spark, texts, monkeypatch, tmp_path):
    monkeypatch.setattr(lm_scoring, "HEAD", 40)
    monkeypatch.setattr(lm_scoring, "CLASSES", 20)
    monkeypatch.setattr(lm_scoring, "BATCH", 64)
    monkeypatch.setattr(lm_scoring, "TAIL", 8)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 2000)
    r, data = random.Random(4), list(texts)
    for k in range(400):  # each word but the first is told by the one before
        word, out = r.randrange(12), []
        for _ in range(30):
            out.append(f"w{word}")
            word = (word * 5 + 1) % 12 if r.random() < 0.95 else r.randrange(12)
        data.append((2000 + k, " ".join(out)))
    found = lm_scoring.learned(frame(spark, data).repartition(5))
    again = lm_scoring.learned(frame(spark, data).repartition(2))
    assert (found.model.flat() == again.model.flat()).all()  # whatever the partitions
    got = lm_scoring.score(frame(spark, data), found).collect()
    c, tokens = collections.Counter(), {}
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in data:
        tokens[i, t] = (t or "").encode().lower().split() + [b""]
        if not out_of(i):
            c.update(tokens[i, t])
    n, v = sum(c.values()), len(c)
    want = [(i, out_of(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for i, t in data for w in [tokens[i, t]]]
    assert tally((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5)) for x in got) == tally(want)
    held = [x for x in got if x.held_out and (x.doc_id or 0) >= 2000]
    assert sum(x.score for x in held) > 0.75 * sum(x.base_score for x in held)
    assert all(x.score < 0 and math.isfinite(x.score) for x in got)
    assert lm_scoring.score(frame(spark, [])).count() == 0

    # The score by hand: a softmax over all classes for each token, then the token's share of its class.
    m, head = found.model, {t: k for k, (t, _) in enumerate(found.head[:20])}
    class_of = lambda t: head[t] if t in head else 20 + spark_hash(t[-2:]) % 8
    mass = collections.Counter()
    for t, k in c.items():
        if t not in head:
            mass[class_of(t)] += k + 1
    by_id = {x.doc_id: x.score for x in got if x.doc_id is not None}
    for i, t in data[::7]:
        if i is None or sum(i == j for j, _ in data) > 1:
            continue
        before, total = [len(m.share)] * 2, 0.0
        for word in tokens[i, t][:400]:
            q = m.context[before[-2]] * m.weights[0] + m.context[before[-1]] * m.weights[1]
            s = (m.target @ q + m.bias).astype(float)
            k = class_of(word)
            total += (s[k] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            total += 0 if word in head else math.log10((c[word] + 1) / (mass[k] + 1))
            before.append(k)
        assert len(tokens[i, t]) > 400 or abs(total - by_id[i]) < 1e-3 * max(1, abs(total))


def test_lm_normalised():
    """Over classes the probabilities of any context sum up to 1."""
    model = lm_scoring.Model(np.arange(1.0, 8.0))
    trainer, r = lm_scoring.Trainer(model, 1), np.random.default_rng(2)
    for _ in range(50):
        trainer.step(*r.integers(0, 7, (3, 64)).astype(np.int32))
    scorer = lm_scoring.Scorer(model)
    for last in range(7):
        total = sum(math.exp(scorer.log_probabilities(np.array([2, last, k], np.int32))[2]) for k in range(7))
        assert abs(total - 1) < 1e-4


def test_hash_as_sparks(spark):
    import xxhash

    words = ["", "a", "abcd", "é日😀", "x" * 7, "y" * 33, "z" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(cast(w as binary)) as h").collect()
    assert [r.h for r in got] == [int(np.array(xxhash.xxh64_intdigest(w.encode(), seed=42), np.uint64).view(np.int64)) for w in words]


def test_pipeline(spark, texts, tmp_path):
    """Each stage by brute force on what its predecessor kept."""
    item = prose(20, 30)
    data = [x for x in texts if x[0] is not None] + [(600, prose(77, 90) + "\n" + item + "\n" + prose(78, 50)), (601, prose(79, 120)), (602, prose(79, 119) + " end")]
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    powers = quality_rules.Powers()
    rows = [(i, t) for i, t in data if quality_rules.measure((t or "").encode(), powers)[6]]
    left = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    done = [(r.doc_id, r.text) for r in line_dedup.stage(spark, left, "").collect()]
    assert tally(done) == tally((i, t) for (i, _), t in zip(rows, brute_lines(rows, line_dedup.EDITS)[1], strict=True) if t is not ...)
    assert all(t.split() for _, t in done)  # no row without text goes on
    kept = {w[0] for w in brute_groups(done, 5) if w[0] == w[2]}
    alone = {i: t for i, t in done if i in kept}
    clean = {i: t for i, t in alone.items() if 100 * len(shingles(item, 5) & shingles(t, 5)) < 80 * len(shingles(item, 5))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean) and 601 in got and 602 not in got
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in clean.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
