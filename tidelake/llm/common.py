"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at, so that a worker's memory doesn't follow the batch size.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder; the path goes to Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    A temporary folder takes its place only in a local session, as in tests; on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing that is still to be computed reads them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each up to which a table is sent to all executors: about 20 MB.
SMALL_SIDE = 200_000


def if_small(df: DataFrame, rows: int = SMALL_SIDE) -> DataFrame:
    """A written table, marked for broadcasting if its row count, read from the files' footers, proves it small."""
    return F.broadcast(df) if df.count() <= rows else df


def key_of(*columns: Column) -> Column:
    """128 bits that stand for some values; rows with equal ones are alike."""
    halves = [F.lpad(F.hex(F.xxhash64(*start, *columns)), 16, "0") for start in ((), (F.lit(1),))]
    return F.unhex(F.concat(*halves))


def row_key(id_: str = "doc_id", text: str = "text") -> Column:
    """The key of a row's id (a long) and text."""
    return key_of(F.col(id_).cast("long"), F.col(text).cast("string"))


def byte_texts(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def sliced(batch, rows: int) -> Iterator:
    """An Arrow batch in slices of ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_RANDOM = None
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)
_PIECE = 1 << 16  # bytes hashed at a time


def _tables():
    """Which bytes are white space, a random number for each byte, powers of the base and of its inverse."""
    global _RANDOM
    if _RANDOM is None:
        import numpy as np

        spaces = np.zeros(256, bool)
        spaces[[0x20, *range(0x09, 0x0E)]] = True
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[np.uint64(1), np.full(_PIECE, _P, np.uint64)])
            down = np.cumprod(np.r_[np.uint64(1), np.full(_PIECE, _P_INVERSE, np.uint64)])
        _RANDOM = spaces, np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), up, down
    return _RANDOM


def mixed(x):
    """Well-spread 64-bit values (the finaliser of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes):
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, with A-Z in lower case; the same in every process."""
    import numpy as np

    spaces, random, up, down = _tables()
    text = text.lower()  # of bytes: A-Z only
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > _PIECE:  # cut after white space; only a longer word is hashed from its words' bytes at once
            end = at + _PIECE
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                out.append(_long_word(text, at))
                at = _word_end(text, at)
                continue
            end = cut
        a = np.frombuffer(text, np.uint8, end - at, at)
        word = np.empty(len(a) + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(spaces[a], out=word[1:-1])
        borders = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = borders[::2], borders[1::2]
        if len(starts):
            prefix = np.empty(len(a) + 1, np.uint64)
            prefix[0] = 0
            np.cumsum(random[a] * up[: len(a)], out=prefix[1:])
            out.append(mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end if end > at else at + 1
        while at < len(text) and text[at] in b" \t\n\r\x0b\x0c":
            at += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _word_end(text: bytes, at: int) -> int:
    return min([x for x in (text.find(c, at + 1) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0], default=len(text))


def _long_word(text: bytes, at: int):
    """The hash of a word of more than _PIECE bytes."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(text[at : _word_end(text, at)].strip())], np.uint64)


def shingle_hashes(words, size: int):
    """Hashes of all runs of ``size`` words; with fewer words, none."""
    import numpy as np

    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + n]
    return mixed(out)
