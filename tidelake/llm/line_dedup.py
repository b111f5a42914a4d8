"""Line deduplication by a segment-partition edit join (operator 6).

Lines within ``edits`` edit operations of each other are linked. Lengths fall into classes; a class has edits + 1
segments of one size, the first half of them placed from a line's start, the others from its end. If two lines are
linked, some segment i of the shorter is untouched, with i operations before it and edits - i after it at most (Li et
al., "Pass-Join", 2011, multi-match-aware selection): in the longer it is moved by i or edits - i places at most, counted
from the end it is placed from. So each line puts its segments in an index under (class, segment number, text) and looks
up those of its substrings that such a segment could have become, in its own class and in those of the ``edits`` smaller
lengths: about five keys a line for two edits. Segments are hashed by a rolling hash in numpy, all lines of a batch at once.
Lines that meet are first compared by counts of characters, which any edit moves by at most two, then verified by a
banded bit-parallel edit distance.

A line counts if it has a word. An occurrence is dropped if an equal line occurs earlier, however short or frequent it is,
or if its text is linked with a different one that occurs earlier, in the order of id (null last), row, line number.
Only lines of ``MIN_CHARS`` characters or more, blank ends aside, take part in the edit join: two edits turn one short
line into quite another.

Equal lines collapse in part before each shuffle, so a line that a third of all rows holds is one row. Lines that meet
under one index key are paired inside the task that reads the key, in blocks, and only those that pass the character
counts leave it. Where more than ``MEETING`` different lines meet, as below a common heading, no task holds them: what is
left of them without the common segment still lies within ``edits``, so it is split into segments and indexed again,
under the old key and the new segment. So the group falls apart into small ones, level by level, until only
``2 * edits`` characters are left.

Defined results: a null text has no lines and stays null. Rows with equal id and text are alike: each keeps what the
other keeps, and what is kept of them is decided by the first of them. A null id comes after all others. Columns besides
id and text pass through; ``__row_key``, ``__equal``, ``__near``, ``__links`` and ``__kept`` are names of its own and are
refused. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import SMALL_SIDE, byte_texts, dropped, if_small, mixed, row_key, sliced, table, written
from tidelake.llm.components import components

EDITS = 2
MIN_CHARS = 20
#: Lines of a group that are compared with each other at a time.
GROUP = 1024
#: Different lines under one key up to which one task pairs them.
MEETING = 4 * GROUP
#: Groups of up to so many rows are paired all at once, by neighbours in the sorted batch.
NEIGHBOURS = 16
#: Characters of a segment up to which it is hashed by the rolling hash, and of a line that is hashed with others.
ROLLING = 1 << 14
#: Bytes of lines that one numpy step looks at.
CHUNK = 1 << 19
OWN_NAMES = ("__row_key", "__equal", "__near", "__links", "__kept")


@functools.lru_cache(1 << 14)
def _class_of(n: int, edits: int) -> int:
    """The least length of the class of lengths that ``n`` is in; a class is about a fifth of its lengths wide."""
    start = edits + 1
    while start + max(1, start // 4) <= n:
        start += max(1, start // 4)
    return start


@functools.lru_cache(1 << 14)
def _plan(n: int, edits: int) -> np.ndarray:
    """Rows salt, whether it is of the index, start, size of the pieces of a line of n characters.

    Lines that are too short to be split, and those that such a one may be linked with, meet under one key."""
    out = [(1, 1, 0, 0)] if n <= 2 * edits else []
    for start in sorted({_class_of(m, edits) for m in range(max(edits + 1, n - edits), n + 1)}):
        size, own = start // (edits + 1), start == _class_of(n, edits) if n > edits else False
        for i in range(edits + 1):
            back = edits - i
            at, moves = (i * size, i) if i <= back else (n - (back + 1) * size, back)
            out += [(start * 16 + i, own and not d, at + d, size) for d in range(-moves, moves + 1) if 0 <= at + d <= n - size]
    return np.array(out, np.int64).reshape(-1, 4).T


_BASE = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
    return _POWERS[0], _POWERS[1]


def _hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hashes of the slices of ``codes`` (code points)."""
    up, down = _powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(codes)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def index_of(lines: list[bytes], edits: int, parents: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Pieces of lines: ``owner`` (number in ``lines``), ``key``, ``own`` (whether it is of the index), ``at``, ``size``; and
    for each line its ``length`` and ``counts`` of characters (numbers in eight classes, modulo 256, as one long).

    ``parents`` are the keys under which the lines, as rests, are indexed again.
    """
    parts, at = [], 0
    with np.errstate(over="ignore"):
        while at < len(lines):
            to, size = at + 1, len(lines[at])
            while to < len(lines) and size + len(lines[to]) < CHUNK and len(lines[to]) <= ROLLING:
                size += len(lines[to])
                to += 1
            parts.append((at, _index_of(lines[at:to], edits, None if parents is None else parents[at:to])))
            at = to
    if not parts:
        return {k: np.empty(0, np.int64) for k in ("owner", "key", "own", "at", "size", "length", "counts")}
    for first, part in parts:
        part["owner"] += first
    return {k: np.concatenate([p[k] for _, p in parts]) for k in parts[0][1]}


def _index_of(lines: list[bytes], edits: int, parents: np.ndarray | None) -> dict[str, np.ndarray]:
    codes = np.frombuffer(b"\n".join(lines).decode().encode("utf-32-le"), np.uint32)
    ends = np.r_[np.flatnonzero(codes == 10), len(codes)]
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    classes = ((codes * np.uint32(2654435761)) >> np.uint32(29)).astype(np.int64)
    line_of = np.repeat(np.arange(len(lines)), np.diff(np.r_[starts, len(codes) + 1]))[: len(codes)]
    within = codes != 10
    counts = np.bincount(line_of[within] * 8 + classes[within], minlength=8 * len(lines)).astype(np.uint8).view(np.int64)
    kinds, of = np.unique(length, return_inverse=True)
    plans = [_plan(int(n), edits) for n in kinds]
    n_pieces = np.array([p.shape[1] for p in plans])
    first = np.r_[0, np.cumsum(n_pieces)[:-1]]
    each = n_pieces[of]
    owner = np.repeat(np.arange(len(lines)), each)
    salt, own, at, size = np.concatenate(plans, axis=1)[:, np.arange(len(owner)) + np.repeat(first[of] - np.r_[0, np.cumsum(each)[:-1]], each)]
    begin = starts[owner] + at
    if len(lines) == 1 and length[0] > ROLLING:
        found = np.array([_long(codes[b : b + n]) for b, n in zip(begin, size, strict=True)], np.uint64)
    else:
        found = _hashed(codes, begin, begin + size)
    key = found + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    if parents is not None:
        key = mixed(key) + parents.view(np.uint64)[owner] * np.uint64(0x165667B19E3779F9)
    return {"owner": owner, "key": mixed(key).view(np.int64), "own": own, "at": at, "size": size, "length": length, "counts": counts}


def _long(codes: np.ndarray) -> np.uint64:
    """The hash of a piece of a long line: the rolling one up to ROLLING characters, so that it doesn't depend on the line."""
    import xxhash

    if len(codes) <= ROLLING:
        return _hashed(codes, np.array([0]), np.array([len(codes)]))[0]
    return np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes()))


def pieces_of(line: str, edits: int, parent: int | None = None) -> list[tuple[int, bool, int, int]]:
    """(key, whether it is of the index, start, size) for a line: its own segments, and what it looks up."""
    found = index_of([line.encode()], edits, None if parent is None else np.array([parent], np.int64))
    return list(zip(found["key"].tolist(), found["own"].astype(bool).tolist(), found["at"].tolist(), found["size"].tolist(), strict=True))


def rests_of(line: str, edits: int, key: int, parent: int | None = None) -> set[str]:
    """What is left of a line without the piece that ``key`` stands for (at each place where it does)."""
    return {line[:at] + line[at + size :] for found, _, at, size in pieces_of(line, edits, parent) if found == key}


def distance(a: str, b: str, most: int) -> int:
    """Edit distance of ``a`` and ``b``, or most + 1 if it is larger: bit-parallel on the diagonals that can matter.

    Bit W - 1 of the vertical differences stands for the row ``most`` below the diagonal; the window moves down by a row
    with each column (Hyyro, "A Bit-Vector Algorithm for Computing Levenshtein and Damerau Edit Distances", 2003).
    """
    if a == b:
        return 0
    start = 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n or most == 0:
        return min(m, most + 1)
    limit, most = most, min(most, m)
    width = 2 * most + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, now = mask & ~((1 << (width - most - 1)) - 1), 0, most
    last = top >> 1
    for j, c in enumerate(b):
        shift = j + most - (width - 1)
        found = places.get(c, 0)
        x = (found >> shift if shift >= 0 else found << -shift) & mask
        zero = ((((x & plus) + plus) ^ plus) | x | minus) & mask
        across_plus, across_minus = (minus | ~(zero | plus)) & mask, zero & plus
        if j < m - most:  # the window's lowest row is within the pattern
            now += not zero & top
        else:
            now += bool(across_plus & last) - bool(across_minus & last)
            last >>= 1
        plus, minus = (across_minus | ~((zero >> 1) | across_plus)) & mask, (zero >> 1) & across_plus
    return min(now, limit + 1)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_key(line: Column) -> tuple[Column, Column]:
    """128 bits that stand for a line, as two longs; the first is xxh64 with seed 42, which Python can compute, too."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _lines(docs: DataFrame) -> DataFrame:
    """order_id, row_key, number, hi, lo of each line that counts in ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("order_id"), row_key().alias("row_key"), F.posexplode(F.split(text, "\n", -1)).alias("number", "line"))
    hi, lo = line_key(F.col("line"))
    return rows.filter(has_word(F.col("line"))).select("order_id", "row_key", "number", hi.alias("hi"), lo.alias("lo"))


def _indexed(docs: DataFrame, edits: int) -> DataFrame:
    """(key, mark, line, counts) of all lines. mark: twice the line's length, and 1 if the key is of the index; line: its
    number, the first 64 bits of its key."""

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest, seen = xxhash.xxh64_intdigest, set()
        for whole in batches:
            for batch in sliced(whole, 500):
                fresh, numbers = [], []
                for text in byte_texts(batch.column("text")):
                    for line in (text or b"").split(b"\n"):
                        if len(line) < MIN_CHARS:
                            continue
                        number = digest(line, 42)
                        if number in seen:
                            continue
                        seen.add(number)
                        plain = line.strip(b" ")
                        if len(plain) >= 4 * MIN_CHARS or len(plain.decode()) >= MIN_CHARS:
                            fresh.append(line)
                            numbers.append(number)
                if len(seen) >= 300_000:
                    seen.clear()
                found = index_of(fresh, edits)
                of, number = found["owner"], np.array(numbers, np.uint64).view(np.int64)
                columns = [found["key"], found["length"][of] * 2 + found["own"], number[of], found["counts"][of]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "mark", "line", "counts"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(spread, "key long, mark long, line long, counts long")


def _may_link(s: np.ndarray, t: np.ndarray, edits: int) -> np.ndarray:
    """Whether the indexed line of each column of ``s`` (mark, line, counts) may be linked with that of ``t``."""
    more = (t[0] >> 1) - (s[0] >> 1)
    out = ((s[0] & 1) == 1) & (more >= 0) & (more <= edits) & (s[1] != t[1])
    at = np.flatnonzero(out)
    a, b = (np.ascontiguousarray(x[2][at]).view(np.uint8).reshape(-1, 8).astype(np.int16) for x in (s, t))
    moved = np.abs(a - b)
    out[at] = np.minimum(moved, 256 - moved).sum(axis=1) <= 2 * edits
    return out


def _distinct(table: np.ndarray) -> np.ndarray:
    """A table in the order of key, line and mark without repeated columns."""
    if not table.shape[1]:
        return table
    return table[:, np.r_[True, (table[:3, 1:] != table[:3, :-1]).any(axis=0)]]


def _pairs(table: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the groups of equal keys of a table (key, mark, line, counts) in the order of key, line and mark."""
    table = _distinct(table)
    key = table[0]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    wanted = size > 1
    if wanted.any():  # one line alone, or none that is of the index, links nothing
        wanted &= table[2, first] != table[2, first + size - 1]
        wanted &= np.logical_or.reduceat((table[1] & 1).astype(bool), first)
    us, vs = [], []

    def add(s: np.ndarray, t: np.ndarray) -> None:
        linked = _may_link(s, t, edits)
        us.append(np.maximum(s[1], t[1])[linked])
        vs.append(np.minimum(s[1], t[1])[linked])

    few = wanted & (size <= NEIGHBOURS)
    last = np.repeat(np.where(few, first + size, 0), size)  # the end of each row's group, if it is a small one
    for d in range(1, int(size[few].max(initial=1))):
        i = np.flatnonzero(last[: len(last) - d] > np.arange(d, len(last)))
        for a, b in ((i, i + d), (i + d, i)):
            add(table[1:4, a], table[1:4, b])
    for at, n in zip(first[wanted & ~few], size[wanted & ~few], strict=True):
        group = table[1:4, at : at + n]
        mine = group[:, (group[0] & 1) == 1]
        for i in range(0, mine.shape[1], 64):
            part = mine[:, i : i + 64]
            for j in range(0, n, GROUP):
                other = group[:, j : j + GROUP]
                add(np.repeat(part, other.shape[1], axis=1), np.tile(other, part.shape[1]))
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.empty(0, bool)
    return u[new], v[new]


def _met(rows: DataFrame, edits: int, meeting: int) -> DataFrame:
    """(u, v, key, own): pairs of lines that meet under a key and may be linked; of keys with more than ``meeting``
    different lines the lines themselves, as u, with a null v, and whether the key is of the index for them.

    ``rows``: key, mark, line, counts and, from the second level on, left (characters of the rest).
    """
    names = [c for c in ("key", "mark", "line", "counts", "left") if c in rows.columns]
    dealt = rows.select(*names).repartition(F.col("key")).sortWithinPartitions("key", "line", "mark")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, crowded = np.empty((len(names), 0), np.int64), None

        def linked(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.bool_())], names=["u", "v", "key", "own"])

        def members(group: np.ndarray) -> pa.RecordBatch:
            own = (group[1] & 1).astype(bool)
            return pa.RecordBatch.from_arrays([pa.array(group[2]), pa.nulls(len(own), pa.int64()), pa.array(group[0]), pa.array(own)], names=["u", "v", "key", "own"])

        def ended(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What whole groups give."""
            first = np.flatnonzero(np.r_[True, table[0, 1:] != table[0, :-1]])
            size = np.diff(np.r_[first, table.shape[1]])
            inside = np.ones(table.shape[1], bool)
            for at, n in zip(first[size > meeting], size[size > meeting], strict=True):
                if too_many(table[:, at : at + n]):
                    inside[at : at + n] = False
                    yield members(table[:, at : at + n])
            yield linked(*_pairs(table[:, inside], edits))

        def too_many(group: np.ndarray) -> bool:
            if len(names) == 5 and group[4].max() <= 2 * edits:
                return False  # nothing is left to be split: as many lines as there are such short texts
            return len(np.unique(group[2])) > meeting

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in names])
            if crowded is not None:  # the group that the last batches began goes on
                same = int(np.searchsorted(table[0], crowded, "right"))
                if same:
                    yield members(table[:, :same])
                table = table[:, same:]
                if not table.shape[1]:
                    continue
                crowded = None
            table = np.concatenate([held, table], axis=1)
            if not table.shape[1]:
                continue
            cut = int(np.searchsorted(table[0], table[0, -1], "left"))
            if cut:
                yield from ended(table[:, :cut])
            held = table[:, cut:]
            if held.shape[1] > meeting:
                held = _distinct(held)
                if held.shape[1] > meeting and too_many(held):
                    yield members(held)
                    crowded, held = int(held[0, 0]), held[:, :0]
        if held.shape[1]:
            yield from ended(held)

    return dealt.mapInArrow(run, "u long, v long, key long, own boolean")


def _crowded(met: DataFrame) -> DataFrame:
    """(key, line) of the keys whose lines weren't paired; those of which no line is of the index link nothing."""
    rows = met.filter("v is null")
    return rows.join(rows.filter("own").select("key").distinct(), "key", "left_semi").select("key", F.col("u").alias("line")).distinct()


def _refined(rows: DataFrame, edits: int) -> DataFrame:
    """The next level's index: key, mark, line, counts, left, parent, rest. ``rows``: key, mark, line, counts, parent, rest,
    of which a piece of rest goes for key; parent is null at the first level."""
    names = ["key", "mark", "line", "counts", "left", "parent", "rest"]

    def pieces(rests: list[bytes], parents: list) -> dict[str, np.ndarray]:
        return index_of(rests, edits, None if not parents or parents[0] is None else np.array(parents, np.int64))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in sliced(whole, 500):
                keys, parents, texts = (batch.column(c).to_pylist() for c in ("key", "parent", "rest"))
                found = pieces([x.encode() for x in texts], parents)
                at_key = found["key"] == np.array(keys, np.int64)[found["owner"]]
                left = {(k, texts[k][:at] + texts[k][at + size :]) for k, at, size in zip(*(found[c][at_key].tolist() for c in ("owner", "at", "size")), strict=True)}
                left = sorted(left)
                of = np.array([k for k, _ in left], np.int64)
                key = np.array(keys, np.int64)
                found = pieces([x.encode() for _, x in left], [keys[k] for k, _ in left])
                owner = found["owner"]
                row = of[owner] if len(owner) else owner
                mark, line, counts = (batch.column(c).to_numpy()[row] for c in ("mark", "line", "counts"))
                columns = [found["key"], (mark & -2) | found["own"], line, counts, found["length"][owner], key[row]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([left[k][1] for k in owner.tolist()], pa.string())], names=names)

    wanted = rows.select("key", "mark", "line", "counts", "parent", "rest")
    return wanted.mapInArrow(run, "key long, mark long, line long, counts long, left long, parent long, rest string")


def _texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hi, lo, line), each once, of the lines whose first halves ``wanted`` (id, a written table) asks for."""
    asked = lines.join(if_small(wanted), lines.hi == wanted.id, "left_semi")
    places = asked.groupBy("hi", "lo").agg(F.min(F.struct("row_key", "number")).alias("at"))
    # The lines of one text at most are gathered.
    by_row = written(places.groupBy(F.col("at.row_key").alias("of_row")).agg(F.collect_list(F.struct("hi", "lo", "at.number")).alias("asked")))
    side = if_small(by_row, SMALL_SIDE // 2)
    text = F.split(F.col("text").cast("string"), "\n", -1)
    keyed = docs.select(row_key().alias("row_key"), "text").join(side, F.col("row_key") == F.col("of_row"))
    held = keyed.select(F.explode(F.transform(F.array(text), lambda t: F.transform("asked", lambda x: F.struct(x.hi.alias("hi"), x.lo.alias("lo"), F.get(t, x.number).alias("line"))))[0]).alias("x"))
    out = written(held.select("x.*").dropDuplicates(["hi", "lo"]))  # rows may be alike
    dropped(by_row)
    return out


def _candidates(docs: DataFrame, lines: DataFrame, edits: int, meeting: int) -> DataFrame:
    """Pairs (u, v) of line numbers that may be linked, each once; a written table."""
    met = written(_met(_indexed(docs, edits), edits, meeting))
    found = met.filter("v is not null").select("u", "v")
    old = [met]
    if not met.filter("own").isEmpty():
        crowded = written(_crowded(met))
        wanted = written(crowded.select(F.col("line").alias("id")).distinct())
        texts = _texts(docs, lines, wanted)
        old += [crowded, wanted, texts]

        def described(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                facts = index_of([x.encode() for x in batch.column("rest").to_pylist()], edits)
                more = [pa.array(facts["length"] * 2, pa.int64()), pa.array(facts["counts"], pa.int64()), pa.nulls(batch.num_rows, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["key", "line", "rest", "mark", "counts", "parent"])

        rows = crowded.join(texts.select(F.col("hi").alias("line"), F.col("line").alias("rest")), "line").select("key", "line", "rest")
        rows = rows.mapInArrow(described, "key long, line long, rest string, mark long, counts long, parent long")
        while True:  # each level's rests are shorter
            index = written(_refined(rows, edits))
            met = written(_met(index, edits, meeting))
            old += [index, met]
            found = found.unionAll(met.filter("v is not null").select("u", "v"))
            if met.filter("own").isEmpty():
                break
            rows = index.join(_crowded(met), ["key", "line"], "left_semi").dropDuplicates(["key", "line", "rest"])
    out = written(found.distinct())
    dropped(*old)
    return out


def links(docs: DataFrame, lines: DataFrame, edits: int = EDITS, meeting: int = MEETING) -> DataFrame:
    """(hi_a, lo_a, hi_b, lo_b): keys of all pairs of different lines within ``edits`` edit operations, each pair once; a
    written table. ``lines``: of _lines(docs), written."""
    found = _candidates(docs, lines, edits, meeting)
    wanted = written(found.select(F.col("u").alias("id")).unionAll(found.select("v")).distinct())
    texts = _texts(docs, lines, wanted)
    both = found.join(texts.toDF("u", "lo_a", "line_a"), "u").join(texts.toDF("v", "lo_b", "line_b"), "v")

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in sliced(whole, 1000):
                keep = [distance(x, y, edits) <= edits for x, y in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["hi_a", "lo_a", "hi_b", "lo_b"]).filter(pa.array(keep, pa.bool_()))

    out = written(both.select("u", "lo_a", "v", "lo_b", "line_a", "line_b").mapInArrow(verify, "hi_a long, lo_a long, hi_b long, lo_b long"))
    dropped(found, wanted, texts)
    return out


def judged_lines(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Written tables: (order_id, row_key, number, hi, lo, first, n_links, late) of the occurrences of lines that are
    repeated or linked; the links."""
    lines = written(_lines(docs))
    found = links(docs, lines, edits)
    both = found.unionAll(found.select("hi_b", "lo_b", "hi_a", "lo_a"))
    repeated = lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1").select("hi", "lo")
    active = written(repeated.unionAll(found.select("hi_a", "lo_a")).unionAll(found.select("hi_b", "lo_b")).distinct())
    held = written(lines.join(if_small(active), ["hi", "lo"], "left_semi").select(*lines.columns))
    first = written(held.groupBy("hi", "lo").agg(F.min(F.struct("order_id", "row_key", "number")).alias("first")))
    ends = both.join(first.toDF("hi_a", "lo_a", "first_a"), ["hi_a", "lo_a"]).join(first.toDF("hi_b", "lo_b", "first_b"), ["hi_b", "lo_b"])
    near = written(ends.groupBy(F.col("hi_a").alias("hi"), F.col("lo_a").alias("lo")).agg(F.count("*").alias("n_links"), F.max((F.col("first_b") < F.col("first_a")).cast("int")).alias("late")))
    facts = written(first.join(near, ["hi", "lo"], "left").select("hi", "lo", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("late", F.lit(0)).alias("late")))
    out = written(held.join(if_small(facts), ["hi", "lo"]).select(*held.columns, "first", "n_links", "late"))
    dropped(lines, active, held, first, near, facts)
    return out, found


def by_row(judged: DataFrame) -> DataFrame:
    """(row_key, numbers of equal lines, numbers of near lines, number of links) of rows that lose lines (else both are
    null) or have linked ones."""
    place = F.struct("order_id", "row_key", "number")
    hits = judged.withColumn("again", place != F.col("first")).filter("again or n_links > 0")
    read = hits.groupBy("row_key").agg(
        F.collect_set(F.when(F.col("again"), F.col("number"))).alias("equal"),  # lines of one text at most
        F.collect_set(F.when(~F.col("again") & (F.col("late") == 1), F.col("number"))).alias("near"),
        F.sum("n_links").alias("n_links"),
    )
    loses = F.size("equal") + F.size("near") > 0
    return read.select("row_key", F.when(loses, F.col("equal")).alias("equal"), F.when(loses, F.col("near")).alias("near"), "n_links")


def deduplicated(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` with ``__row_key``, ``__equal``, ``__near`` (line numbers that go), ``__links`` and ``__kept`` (what is left of
    the text)."""
    if clash := set(OWN_NAMES) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are names of this operator")
    gone = by_row(judged).toDF("__gone_key", "__equal", "__near", "__links")
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__row_key", row_key())
    joined = keyed.join(gone, keyed["__row_key"] == gone["__gone_key"], "left").drop("__gone_key")
    left = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("__equal", i) & ~F.array_contains("__near", i))
    return joined.withColumn("__kept", F.when(F.col("__equal").isNull(), text).otherwise(F.array_join(left, "\n")))


def classes(docs: DataFrame, judged: DataFrame, found: DataFrame) -> DataFrame:
    """(row_key, class_id) of rows that share lines with others, or have linked ones: the least id among the rows that can
    be reached over equal and linked lines, null if none of them has an id."""
    occurs = judged.select("row_key", "order_id", F.struct("hi", "lo").alias("line"), F.col("first.row_key").alias("first_row"))
    edges = occurs.select(F.col("row_key").alias("u"), F.col("first_row").alias("v")).filter("u <> v")
    rows = judged.select(F.col("hi").alias("hi_a"), F.col("lo").alias("lo_a"), F.col("first.row_key").alias("u")).distinct()
    linked = found.join(rows, ["hi_a", "lo_a"]).join(rows.toDF("hi_b", "lo_b", "v"), ["hi_b", "lo_b"]).select("u", "v").filter("u <> v")
    labels = written(components(edges.unionAll(linked).distinct()))
    named = judged.select("row_key", "order_id").distinct().join(labels, F.col("row_key") == F.col("node")).select("row_key", "component", "order_id")
    least = named.groupBy("component").agg(F.min("order_id").alias("class_id"))
    return named.join(least, "component").groupBy("row_key").agg(F.min(F.nullif("class_id", F.lit((1 << 63) - 1))).alias("class_id"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines that count, equal and near ones that go, links of its lines, class of the document (least
    id that equal and linked lines lead to, its own if there are none), digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, found = judged_lines(docs)
    done = deduplicated(docs, judged)
    copies = docs.groupBy(row_key().alias("copy_key")).agg(F.count("*").alias("copies")).filter("copies > 1")
    of_class = classes(docs, judged, found).withColumnRenamed("row_key", "class_key")
    return (
        done.join(copies, F.col("__row_key") == F.col("copy_key"), "left").join(of_class, F.col("__row_key") == F.col("class_key"), "left")
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.size(F.filter(F.split("text", "\n", -1), has_word)), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("__equal"), F.lit(0)).cast("long").alias("n_equal_dropped"),
            F.coalesce(F.size("__near"), F.lit(0)).cast("long").alias("n_near_dropped"),
            F.floor(F.coalesce("__links", F.lit(0)) / F.coalesce("copies", F.lit(1))).cast("long").alias("n_links"),
            F.when(F.col("class_key").isNull(), F.col("doc_id").cast("long")).otherwise(F.col("class_id")).alias("class_id"),
            F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"),
        )
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones; ``n_chars``, where there is one, follows the text. A row that lost
    lines and has no word left is one of repeated lines only, and goes."""
    judged, _ = judged_lines(docs)
    done = deduplicated(docs, judged).filter(F.col("__equal").isNull() | has_word(F.col("__kept")))
    changed = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__equal").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
