"""Best-fit packing of token pieces into sequences, level by level.

Items (pieces) are dealt at random into groups, and each group is packed by best fit, longest item first. Nearly full
bins are closed. Underfull bins become the items of the next level, which has fewer groups, until one group holds all
that is left or a level stops helping. A group is a bounded number of (id, length) pairs; texts and ids never meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import fresh, texts_of, written

CAPACITY = 2048
#: Items that are packed together, and the room at which a bin counts as full.
GROUP_ITEMS, SLACK = 20_000, 4
_ENCODERS: dict[tuple[str, str | None], object] = {}


def encoder(tokenizer: str, ranks: str | None):
    """text -> ids of the tokenizer file. With ``ranks``, the same vocabulary as tiktoken ranks, which is faster."""
    if (tokenizer, ranks) not in _ENCODERS:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(tokenizer)
        special = [t.content for t in plain.get_added_tokens_decoder().values()]

        def slow(text: str) -> list[int]:
            return plain.encode(text, add_special_tokens=False).ids

        if ranks is None:
            _ENCODERS[tokenizer, ranks] = slow
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            # strings of special tokens are ids of their own: such texts go to the library that knows them
            _ENCODERS[tokenizer, ranks] = lambda t: slow(t) if any(s in t for s in special) else fast.encode_ordinary(t)
    return _ENCODERS[tokenizer, ranks]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full pieces, before them what is left over."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def token_pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut to ``capacity``.

    A null or empty text has the end id alone; repeated rows give their pieces again; very long texts are encoded whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*encode(text), end_id] if isinstance(text, str) else [end_id], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n]
                    row = (doc_id, k, start, n, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            yield out.astype({"doc_id": pdf["doc_id"].dtype}) if len(out) else out

    return texts_of(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def best_fit(ids: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of the bin) of each item; a bin is named by its first item. Items come longest first."""
    bins, offsets = np.empty(len(ids), dtype=np.int64), np.empty(len(ids), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has r ids left
    left: dict[int, int] = {}
    for k in range(len(ids)):
        n = int(lengths[k])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            name = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, name = capacity, int(ids[k])
        bins[k], offsets[k] = name, capacity - room
        left[name] = room - n
        by_room[room - n].append(name)
        rooms |= 1 << (room - n)
    fill = np.fromiter((capacity - left[int(b)] for b in bins), dtype=np.int64, count=len(bins))
    return bins, offsets, fill


def _level(items: DataFrame, groups: int, capacity: int, seed: int) -> DataFrame:
    """(item, bin, shift, fill) from (item, n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "item"], ascending=[False, True])
        bins, shift, fill = best_fit(pdf["item"].to_numpy(), pdf["n"].to_numpy(), capacity)
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "bin": bins, "shift": shift, "fill": fill})

    dealt = items.withColumn("group", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(groups)))
    schema = "item long, bin long, shift long, fill long"
    return written(dealt.groupBy("group").applyInPandas(run, schema), "packed")


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: int = SLACK
) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of at most ``capacity``.

    Every row gets a place of its own, repeated rows too. Rows of length 0 take no room; an empty table stays empty.
    Sequence numbers are names, not ranks. Bins with at most ``slack`` free places count as full: that leaves at most
    slack / capacity of the room unused (0.2 %). Rounds end with one group, or when a round closes or merges less than 2 %
    of what was open: the bins that are left are then nearly all too full to be merged in pairs.
    """
    (own,) = fresh([*pieces.columns, "sequence_id", "offset", "item", "bin", "shift", "fill"], "row")
    pieces = written(pieces.withColumn(own, F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") >= capacity - slack)
    items = pieces.where(F.col("length") < capacity - slack).select(F.col(own).alias("item"), F.col("length").alias("n"))
    n, level = items.count(), 0
    places = None  # (item, bin, shift, fill), item being a piece
    closed: list[DataFrame] = []
    while n:
        groups = -(-n // group_items)
        moves = _level(items, groups, capacity, level)
        if places is None:
            places = moves
        else:
            up = moves.select(F.col("item").alias("bin"), F.col("bin").alias("__to"), F.col("shift").alias("__by"), F.col("fill").alias("__fill"))
            places = written(
                places.drop("fill").join(up, "bin").select(
                    "item", F.col("__to").alias("bin"), (F.col("shift") + F.col("__by")).alias("shift"), F.col("__fill").alias("fill")
                ),
                "places",
            )
        if groups == 1:
            break
        underfull = F.col("fill") < capacity - slack
        items = places.where(underfull).groupBy("bin").agg(F.max("fill").alias("n")).withColumnRenamed("bin", "item")
        left = items.count()
        if left > 0.98 * n:
            break
        closed.append(places.where(~underfull))
        places, n, level = places.where(underfull), left, level + 1
    out = full.withColumns({"sequence_id": F.col(own), "offset": F.lit(0).cast("long")})
    if places is not None:
        for part in closed:
            places = places.unionByName(part)
        spots = places.select(F.col("item").alias(own), F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
        out = out.unionByName(pieces.drop("sequence_id", "offset").join(spots, own).select(*out.columns))
    return out.drop(own)


def packed_sequences(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): token_pieces() packed by pack().

    A null text counts as empty and has the end id alone. Null and repeated ids are documents like others. Very long texts are
    encoded whole and cut into pieces. An empty table gives an empty result. Other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, ranks, capacity=capacity, **columns), capacity)


def public_tokenizer() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), **public_tokenizer())
