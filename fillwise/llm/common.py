"""What the corpus operators share: scratch tables, bounded key filters, word hashes, links to components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-fillwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker, and of a row group of a scratch table: both wait in memory, for each task.
BATCH_BYTES, ROW_GROUP_BYTES = 4 << 20, 32 << 20
_BATCHES, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def texts_of(df: DataFrame) -> DataFrame:
    """The frame, about to send texts to Python workers: where the session has Spark's default of 64 MB, batches get smaller."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, _DEFAULT) == _DEFAULT:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts its lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    _note(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Scopes of ``settled`` that are open, for each thread: what one thread writes is not another's to delete.
_scopes = threading.local()


def _note(path: str) -> None:
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].append(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, as a table; the scratch tables that it wrote on the way are deleted when that is complete."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    path = scratch_path(spark, name)
    try:
        out = build()
        out.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        for used in _scopes.open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(used)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _note(path)
    return spark.read.schema(out.schema).parquet(path)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front of those that ``columns`` already has (as Spark compares them)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; where all characters are single bytes, lower() does that."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class KeyFilter:
    """A bit map of hashed keys, for dropping rows before a shuffle.

    The map has about 16 bits for each key and at most ``2**MAX_BITS``, so no more than a million rows of two numbers
    reach the driver and are broadcast. Above half as many keys the map would be full: then ``mark`` joins with the
    keys themselves. A row that passes the map may still have no such key (bits collide), so an exact step has to
    follow; no row with a key is dropped.
    """

    MIN_BITS, MAX_BITS = 16, 26

    def __init__(self, keys: DataFrame, column: str, hashed: bool = False, max_bits: int = MAX_BITS):
        """``hashed``: the keys are hashes already and place themselves."""
        keys = keys.select(F.col(column).alias("key")).where("key IS NOT NULL")
        n = keys.count()
        self.n_bits, self.hashed = 1 << max(self.MIN_BITS, min(max_bits, (16 * n).bit_length())), hashed
        self.words = self.keys = None
        if n > self.n_bits // 2:
            self.keys = keys.distinct()
            return
        word, bit = self._place(F.col("key"))
        rows = (
            keys.groupBy(word.alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        )
        self.words = written(rows, "keyfilter")

    def _place(self, key: Column) -> tuple[Column, Column]:
        at = F.pmod(key if self.hashed else F.xxhash64(key), F.lit(self.n_bits))
        return F.floor(at / 63).cast("int"), (at % 63).cast("int")

    def mark(self, df: DataFrame, column: str, flag: str) -> DataFrame:
        """Adds a boolean: False means that the row's key is certainly not among the keys."""
        own_word, own_bits = fresh([*df.columns, flag], "word", "bits")
        if self.words is None:
            keys = self.keys.select(F.col("key").alias(own_word))
            marked = df.join(keys, F.col(column) == F.col(own_word), "left")
            return marked.withColumn(flag, F.col(own_word).isNotNull()).drop(own_word)
        word, bit = self._place(F.col(column))
        hit = F.call_function("shiftrightunsigned", F.col(own_bits), bit).bitwiseAND(F.lit(1).cast("long")) == 1
        words = F.broadcast(self.words.select(F.col("word").alias(own_word), F.col("bits").alias(own_bits)))
        marked = df.join(words, word == F.col(own_word), "left")
        return marked.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(own_word, own_bits)

    def array(self) -> np.ndarray | None:
        """The map as 64-bit words for use in Python workers, bits 0 to 62 of each; None where there are too many keys."""
        if self.words is None:
            return None
        out = np.zeros(self.n_bits // 63 + 1, dtype=np.uint64)
        got = self.words.toPandas()
        out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
        return out


# Hashes of words over whole blocks of text: a word's bytes are the digits of a number modulo 2^64, taken from one
# running sum over the block, and are then mixed. Long words get a hash of their own: there are unlike words of some
# thousand letters with equal numbers, whatever the base.
_BASE, BLOCK, LONG_WORD = 0x9E3779B97F4A7C15, 1 << 18, 512
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[ord(c) for c in SEPARATORS]] = False
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


EXACT_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
FOLDED_CODES = EXACT_CODES.copy()
FOLDED_CODES[65:91] = EXACT_CODES[97:123]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for blocks of the usual size."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    up, down = (np.full(n, x, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    if n <= 2 * BLOCK:
        _powers.update(up=up, down=down)
    return up, down


def _block_hashes(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words of each text) of texts that lie side by side in ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = _IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin, end = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    first[begin], last[end] = word[begin], word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(max(n, BLOCK))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[k] : ends[k]].tobytes()
        hashes[k] = xxhash.xxh3_64_intdigest(word.lower() if codes is FOLDED_CODES else word)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def word_hashes(texts: pa.Array, codes: np.ndarray = EXACT_CODES, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words of some rows, number of words of each of these rows), in the order of the rows.

    FOLDED_CODES lower-case A-Z. About ``block`` bytes are in work at a time; a longer text is cut between words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= block:
            yield _block_hashes(data[a:b], offsets[lo : hi + 1] - a, codes)
        else:
            parts = []
            while a < b:
                cut = min(a + block, b)
                while cut < b and not (gap := np.flatnonzero(~_IS_WORD[data[cut : min(cut + block, b)]])).size:
                    cut = min(cut + block, b)
                cut = cut + int(gap[0]) if cut < b else b
                parts.append(_block_hashes(data[a:cut], np.array([0, cut - a]), codes)[0])
                a = cut
            parts = np.concatenate(parts)
            yield parts, np.array([len(parts)])
        lo = hi


#: Rows from which a group or node is hot, and most hot ones that are broadcast.
HOT_DEGREE, MAX_HOT = 1000, 50_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Left-joins the groups (key, count, ...), one row a key. Rows of very large groups stay where they are: of these groups at most MAX_HOT are broadcast."""
    names = [c for c in groups.columns if c != key]
    big, *own = fresh([*rows.columns, *groups.columns], "big", *(f"big_{c}" for c in names))
    hot = groups.where(F.col(count) > HOT_DEGREE).orderBy(F.desc(count), key).limit(MAX_HOT)
    hot = F.broadcast(hot.select(F.col(key).alias(big), *[F.col(c).alias(o) for c, o in zip(names, own, strict=True)]))
    split = rows.join(hot, F.col(key) == F.col(big), "left")
    large = split.where(F.col(big).isNotNull()).select(*rows.columns, *[F.col(o).alias(c) for c, o in zip(names, own, strict=True)])
    rest = split.where(F.col(big).isNull()).select(rows.columns).join(groups, key, "left")
    return large.unionByName(rest.select(large.columns))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): every linked node with the smallest node that it can reach. Links with a null end count for nothing.

    Alternating large-star and small-star rounds, until every node has either no smaller neighbour or that one alone:
    then these are the roots. A node's smallest neighbour is a partial aggregate. Links of nodes with very many
    neighbours meet it by a broadcast of at most MAX_HOT rows, so that they stay where they are; the others meet it by
    a shuffle. A round reads each of its tables once or twice, and plans nothing for very large nodes where there are
    none: each scan, stage and broadcast costs the driver some MB, however few the links are.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x <> y").select("u", "v").distinct(), "edges"
    )
    for _ in range(max_rounds):
        ends = F.array(F.struct(F.col("u"), F.col("v").alias("w")), F.struct(F.col("v").alias("u"), F.col("u").alias("w")))
        both = edges.select(F.explode(ends).alias("end")).select("end.u", "end.w")
        nodes = written(both.groupBy("u").agg(
            F.least(F.min("w"), F.col("u")).alias("m"), F.count("*").alias("d"), F.count_if(F.col("w") < F.col("u")).alias("smaller")
        ), "nodes")
        state = nodes.agg(F.max("d").alias("most"), F.count_if(F.expr("smaller > 0 AND d > 1")).alias("open")).first()
        if not state["open"]:
            return nodes.select(F.col("u").alias("node"), F.col("m").alias("root"))
        of_smaller = nodes.select(F.col("u").alias("v"), "m", "d")
        met = with_groups(edges, of_smaller, "v", "d") if state["most"] > HOT_DEGREE else edges.join(of_smaller, "v")
        large = met.select("u", F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        new = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(new.distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
