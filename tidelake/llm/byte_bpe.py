"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 2).

For each prefix of a piece (one match of the splitting pattern) the encoder stores the one last token with which the
encoding of that prefix ends. The encoding of a prefix is unique, so a token may end a prefix exactly when it is
compatible with the last token of the prefix before it. Appending bytes leaves every stored entry valid; an edit inside
a text re-splits from the piece before it until the pieces fall into step with the old ones again.

Two tokens are compatible if merging by rank never joins bytes across their border. That is read off by undoing the
merges of both tokens from the last one back: at each step no pair that then stands at the border may have a rank
below those already undone.

Defined results: a null text is an empty one: no tokens, and the digests of nothing. Rows are handled one by one, so
null or repeated ids and ties stay as they are; only ``doc_id`` and ``text`` are read. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm.common import byte_texts, sliced, table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces whose encoding a worker remembers for good, further ones that it remembers until there are as many, and pairs
#: of tokens. Memory only: a piece that isn't remembered is encoded anew.
REMEMBERED, REMEMBERED_LATE, REMEMBERED_PAIRS = 300_000, 100_000, 500_000


class Vocabulary:
    """Ranks of a byte-level vocabulary, given as the bytes of a rank file (base64 token and rank on each line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            halves = self._last_merge(token, rank)
            if halves is not None:  # else merging never yields the token
                self.parts[rank] = halves
                self.ends.add_word(token.decode("latin-1"), rank)
        self.ends.make_automaton()
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.decimal_of = {rank: str(rank) for rank in self.bytes_of}
        self._pairs: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two ranks that the last merge of ``token`` joins; itself for a byte; None if merging never yields it."""
        if len(token) == 1:
            return rank, rank
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(found)
            if best >= rank:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between the two tokens alone."""
        pairs, key = self._pairs, left << 32 | right
        found = pairs.get(key)
        if found is None:
            if len(pairs) >= REMEMBERED_PAIRS:
                pairs.clear()
            found = pairs[key] = self.compatible(left, right)
        return found

    def compatible(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit:
                return False
            a, b = self.parts[left], self.parts[right]
            # The later merge is undone first; of equal ranks, merging from the left undoes the right one first.
            if left > right:
                if len(self.bytes_of[left]) > 1:
                    limit, left = left, a[1]
                    continue
                if len(self.bytes_of[right]) == 1:
                    return True
                limit, right = right + 1, b[0]
            else:
                if len(self.bytes_of[right]) > 1:
                    limit, right = right + 1, b[0]
                    continue
                if len(self.bytes_of[left]) == 1:
                    return True
                limit, left = left, a[1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, "", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes; what is stored for the prefixes so far stays."""
        v, last = self.vocabulary, self.last
        known = len(last)
        self.data += data.decode("latin-1")
        last += [-1] * len(data)
        sizes, fits = v.size_of, v.fits
        # All tokens that end at each byte, the longest first.
        for end, token in v.ends.iter(self.data, max(0, known - v.longest + 1)):
            if end >= known and last[end] < 0:
                before = end - sizes[token]
                if before < 0 or fits(last[before], token):
                    last[end] = token
        if -1 in last[known:]:
            raise ValueError("no token ends at some byte; the vocabulary lacks a byte")

    def truncate(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:]

    def ids(self) -> list[int]:
        out, end, last, sizes = [], len(self.last) - 1, self.last, self.vocabulary.size_of
        while end >= 0:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out


class Encoder:
    """Encodes texts; remembers the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}
        self.late: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece that isn't among the first ones met."""
        found = self.late.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            found = (whole,) if whole is not None else tuple(Prefixes(self.vocabulary, data).ids())
            if len(self.known) < REMEMBERED:
                self.known[piece] = found
            else:
                if len(self.late) >= REMEMBERED_LATE:
                    self.late.clear()
                self.late[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        known, piece = self.known, self.piece
        return [i for p in self.vocabulary.split(text) for i in known.get(p) or piece(p)]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of what they decode to."""
        ids = self.encode(text)
        decimal = self.vocabulary.decimal_of
        return len(ids), hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(self.vocabulary.decode(ids)).hexdigest()


class Editable:
    """A text with its encoding, for appends and edits that leave far pieces alone."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, text
        self.pieces = encoder.vocabulary.split(text)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` in place of text[start:end]; returns how many pieces were split again."""
        at = first = 0
        while first < len(self.pieces) and at + len(self.pieces[first]) < start:
            at += len(self.pieces[first])
            first += 1
        while first and start - at <= 1:  # the pattern looks one character ahead
            first -= 1
            at -= len(self.pieces[first])
        shift = len(new) - (end - start)
        borders, p = {}, at
        for k in range(first, len(self.pieces)):
            if p >= end:
                borders[p + shift] = k
            p += len(self.pieces[k])
        self.text = self.text[:start] + new + self.text[end:]
        fresh: list[str] = []
        for m in self.encoder.vocabulary.pattern.finditer(self.text, at):
            if m.start() >= start + len(new) and m.start() in borders:
                self.pieces[first : borders[m.start()]] = fresh
                return len(fresh)
            fresh.append(m.group())
        self.pieces[first:] = fresh
        return len(fresh)

    def append(self, new: str) -> int:
        return self.replace(len(self.text), len(self.text), new)

    def ids(self) -> list[int]:
        known, piece = self.encoder.known, self.encoder.piece
        return [i for p in self.pieces for i in known.get(p) or piece(p)]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.read(path, pattern))
    return _ENCODERS[path, pattern]


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of tokens and digests for each row of ``docs``; ``path`` must exist on every executor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = encoder_for(path, pattern)
        for whole in batches:
            for batch in sliced(whole, 500):
                rows = [encoder.digest((x or b"").decode()) for x in byte_texts(batch.column("text"))]
                n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` as doc_id and token ids (array<int>)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = encoder_for(path, pattern)
        for whole in batches:
            for batch in sliced(whole, 500):
                ids = [encoder.encode((x or b"").decode()) for x in byte_texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, ids array<int>")


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *_public())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of ``docs``; the last stage, so it need not return the columns of documents."""
    return digests(docs, *_public())
