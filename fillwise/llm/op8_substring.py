"""Repeated passages removed with FM-indexes over shards of suspicious text.

A window is 13 words in a row. Each window has an anchor, the 4-word gram of it that hashes lowest, so equal windows
have equal anchors. Anchors that two documents share mark suspicious text; runs of windows with one such anchor are
segments, and a segment goes to the shard of its anchor. Each shard builds a compressed FM-index over its distinct
segments: a Burrows-Wheeler transform in a wavelet matrix of packed bits, and text places of some suffixes only. The
segments are streamed back through it by backward search: a window whose interval still holds several suffixes after 13
steps has a matching statistic of 13 words or more, and the smallest document among them decides. Anchors with very many
segments are split: each of their windows is a segment with a shard of its own hash, which finds the same matches. Inside
a shard word sequences themselves are compared; a segment's occurrences are tied to it by 128-bit hashes. Rows whose whole
text a smaller id has (by SHA-256) need no index: all their windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import KeyFilter, texts_of, with_groups, word_hashes, written

WIDTH, GRAM = 13, 4
#: Bytes of segments in one FM-index (about); segments from which an anchor is split into its windows; steps between sampled suffixes.
SHARD_BYTES, HOT_ANCHOR, SAMPLE = 2 << 20, 5_000, 8
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def anchors(words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchor of each window over hashed words; of equal grams in a window the first."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for i in range(GRAM):
        h = h * _P + words[i : n - GRAM + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    span = width - GRAM + 1
    place = np.arange(n - width + 1) + np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1)
    return h[place].view(np.int64), place


def _runs(texts: pa.Array, width: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(anchor, first window, end) of the runs of each text, for some texts at a time."""
    for hashes, counts in word_hashes(texts):
        out = []
        for words in np.split(hashes, np.cumsum(counts)[:-1]):
            keys, place = anchors(words, width)
            begin = np.flatnonzero(_changes(place))
            out.append((keys[begin], begin, np.append(begin[1:], len(place))[: len(begin)]))
        yield out


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])


class FMIndex:
    """Backward search over a text of whole numbers; separators end every match."""

    def __init__(self, text: np.ndarray, separators: np.ndarray):
        """text: symbols from 1, 0 at the separators, of which the last place must be one."""
        n = len(text)
        rank = text.astype(np.int64) + len(separators)
        rank[separators] = np.arange(len(separators))  # each separator is a symbol of its own
        step = 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * np.int64(int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            rank = new
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        # text places of some suffixes: all at which a walk to the left would meet a separator, and each SAMPLE-th
        known = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.known, self.known_counts = self._packed(known)
        self.places = order[known].astype(np.int32)
        bwt = text[order - 1]
        sigma = int(text.max()) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.depth = max(1, (sigma - 1).bit_length())
        for shift in range(self.depth - 1, -1, -1):
            bit = ((bwt >> shift) & 1).astype(bool)
            self.levels.append((*self._packed(bit), n - int(bit.sum())))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        symbols = np.arange(sigma, dtype=np.int64)
        self.first = self._descend(symbols, np.zeros(sigma, dtype=np.int64))

    @staticmethod
    def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits in 64-bit words, and the number of ones before each word."""
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        return packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1].astype(np.int32)

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)

    def left(self, at: np.ndarray) -> np.ndarray:
        """The suffix that begins one symbol earlier, for suffixes that do not follow a separator."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for packed, counts, zeros in self.levels:
            bit = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(packed, counts, at)
            symbol = 2 * symbol + bit
            at = np.where(bit, zeros + ones, at - ones)
        return self.starts[symbol] + at - self.first[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes: walks to the left until one is known."""
        out, rows, todo, steps = np.zeros(len(rows), dtype=np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            known = (self.known[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[todo[known]] = self.places[self._ones(self.known, self.known_counts, rows[known])] + steps
            todo, rows, steps = todo[~known], self.left(rows[~known]), steps + 1
        return out

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, (packed, counts, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = self._ones(packed, counts, at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Times that the symbol stands before a place of the transform."""
        return self._descend(symbol, at) - self.first[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes after one more symbol in front."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        start = self.starts[symbol]
        return start + both[: len(lo)], start + both[len(lo) :]


def lowest_matches(segments: list[list[bytes]], low: np.ndarray, width: int = WIDTH, block: int = 200_000) -> list[np.ndarray]:
    """For each window of each segment the smallest ``low`` among all segments that contain it."""
    number: dict[bytes, int] = {}
    lengths = np.array([len(s) for s in segments])
    text = np.zeros(int(lengths.sum()) + len(segments), dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    for b, s in zip(begins, segments, strict=True):
        text[b : b + len(s)] = [number.setdefault(w, len(number) + 1) for w in s]
    index = FMIndex(text, begins + lengths)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), lengths + 1)
    windows = lengths - width + 1
    own = np.repeat(np.arange(len(segments)), windows)
    start = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[own]
    best = low[own].copy()
    for at in range(0, len(own), block):
        live = np.arange(at, min(at + block, len(own)))
        symbol = text[start[live] + width - 1]
        lo, hi = index.starts[symbol], index.starts[symbol + 1]
        for step in range(width - 2, -1, -1):
            many = hi - lo > 1  # the window itself is in the index: an interval of one suffix is that
            live, lo, hi = live[many], lo[many], hi[many]
            if not len(live):
                break
            lo, hi = index.extend(text[start[live] + step], lo, hi)
        if len(live):
            lo, which = np.unique(lo, return_inverse=True)
            ends = np.zeros(len(lo), dtype=np.int64)
            ends[which] = hi
            sizes = ends - lo
            first = np.cumsum(sizes) - sizes
            rows = np.arange(int(sizes.sum())) + np.repeat(lo - first, sizes)
            best[live] = np.minimum.reduceat(low[owner[index.locate(rows)]], first)[which]
    return np.split(best, np.cumsum(windows)[:-1])


def _shared_anchors(texts: DataFrame, width: int) -> DataFrame:
    """Anchors of windows in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            for some in _runs(batch.column(1), width):
                keys = np.concatenate([keys for keys, _, _ in some])
                docs = np.repeat(ids[at : at + len(some)], [len(keys) for keys, _, _ in some])
                at += len(some)
                order = np.argsort(keys)
                keys, docs = keys[order], docs[order]
                edge = np.flatnonzero(_changes(keys))
                low, high = (f.reduceat(docs, edge) if len(edge) else docs for f in (np.minimum, np.maximum))
                yield pa.record_batch({"anchor": keys[edge], "lo": low, "hi": high})

    rows = texts.select("id", "text").mapInArrow(run, "anchor long, lo long, hi long")
    return rows.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("anchor")


def _marked(texts: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Adds ``begins``, the first windows of the runs with a shared anchor, by a join: where the anchors are too many for a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in _runs(batch.column(2), width):
                n = [len(keys) for keys, _, _ in some]
                rows = np.repeat(np.arange(at, at + len(some)), n)
                at += len(some)
                yield pa.record_batch({
                    "id": batch.column(0).take(pa.array(rows)), "key": batch.column(1).take(pa.array(rows)),
                    "anchor": np.concatenate([keys for keys, _, _ in some]), "begin": np.concatenate([b for _, b, _ in some]),
                })

    runs = texts.mapInArrow(run, "id long, key long, anchor long, begin long").join(anchors, "anchor", "left_semi")
    begins = runs.groupBy("id", "key").agg(F.sort_array(F.collect_set("begin")).alias("begins"))
    return texts.join(begins, ["id", "key"])


def _segments(texts: DataFrame, shared: KeyFilter, width: int) -> DataFrame:
    """Occurrences (seg, seg2, id, key, start) with text null, and each block's distinct segments with text, anchor, lo and hi.

    ``key`` tells rows of one id with different texts apart; in a distinct segment it is the anchor.
    """
    n_bits, words = shared.n_bits, shared.array()
    bits = texts.sparkSession.sparkContext.broadcast(words)
    if words is None:
        texts = _marked(texts, shared.keys.withColumnRenamed("key", "anchor"), width)
    schema = "key long, seg long, seg2 long, id long, start int, text string, lo long, hi long"
    names = [c.split()[0] for c in schema.split(", ")]

    def hit(keys: np.ndarray) -> np.ndarray:
        at = keys % np.int64(n_bits)
        return (bits.value[at // 63] >> (at % 63).astype(np.uint64)) & np.uint64(1) == 1

    def table(*columns) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in _runs(batch.column(2), width):
                found, known = [], {}
                for i, (keys, begin, end) in enumerate(some, at):
                    ok = hit(keys) if bits.value is not None else np.isin(begin, batch.column(3)[i].as_py())
                    if not ok.any():
                        continue
                    doc, key, words = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), words_of(batch.column(2)[i].as_py())
                    for anchor, a, b in zip(keys[ok].tolist(), begin[ok].tolist(), end[ok].tolist(), strict=True):
                        part = b" ".join(words[a : b + width - 1])
                        seg = xxhash.xxh3_128_intdigest(part)
                        seg = (seg >> 65, (seg & ((1 << 64) - 1)) >> 1)
                        found.append((key, *seg, doc, a))
                        was = known.get((anchor, seg))
                        if was is None:
                            known[anchor, seg] = [part.decode("utf-8", "surrogatepass"), doc, doc]
                        elif doc < was[1]:
                            was[1] = doc
                        elif doc > was[2]:
                            was[2] = doc
                at += len(some)
                if found:
                    n = len(found)
                    yield table(*zip(*found, strict=True), [None] * n, np.zeros(n), np.zeros(n))
                    text, low, high = zip(*known.values(), strict=True)
                    n = len(known)
                    yield table([k for k, _ in known], [s[0] for _, s in known], [s[1] for _, s in known], np.zeros(n), np.zeros(n), text, low, high)

    return written(texts.mapInArrow(run, schema), "segments")


def _matches(distinct: DataFrame, width: int) -> DataFrame:
    """(seg, seg2, at, lows): for windows at, at + 1, ... of a segment the smallest document that has them.

    Segments of an anchor stand in one shard. Where an anchor has very many, their windows are dealt one by one, each
    text once with its first and last document, so that no shard grows with the number of segments that share it.
    """
    counts = distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > HOT_ANCHOR)
    hot = written(counts.select(F.col("anchor").alias("__hot")), "hot-anchors")
    rows = distinct.join(hot, F.col("anchor") == F.col("__hot"), "left")
    plain = rows.where("__hot IS NULL").select("seg", "seg2", F.lit(0).alias("at"), "text", "lo", "hi", F.xxhash64("anchor").alias("deal"))
    words = F.split("text", " ")
    places = F.sequence(F.lit(0), F.size(words) - width)
    windows = F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, width), " ").alias("text")))
    single = rows.where("__hot IS NOT NULL").select("seg", "seg2", "lo", "hi", F.explode(windows).alias("places"))
    single = single.select("seg", "seg2", F.col("places.at").alias("at"), F.col("places.text").alias("window"), "lo", "hi")
    shared = single.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = written(shared.withColumn("number", F.monotonically_increasing_id()), "hot-windows")
    alone = shared.select(
        F.col("number").alias("seg"), F.lit(0).cast("long").alias("seg2"), F.lit(-1).alias("at"), F.col("window").alias("text"),
        "lo", "hi", F.xxhash64("window").alias("deal"),
    )
    todo = plain.unionByName(alone)
    shards = max(1, -(-(todo.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf.groupby("text", sort=False)
        number, low, high = same.ngroup().to_numpy(), same["lo"].min().to_numpy(np.int64), same["hi"].max().to_numpy(np.int64)
        first = ~pdf["text"].duplicated()
        lows = lowest_matches([t.encode("utf-8", "surrogatepass").split(b" ") for t in pdf.loc[first, "text"]], low, width)
        sizes = np.array([len(x) for x in lows])
        least = np.minimum.reduceat(np.concatenate(lows), np.cumsum(sizes) - sizes)
        useful = (least < high)[number]  # elsewhere no document stands after a match
        out = pdf.loc[useful, ["seg", "seg2", "at"]].assign(number=number[useful]).drop_duplicates(["seg", "seg2", "at"])
        return out.assign(lows=[lows[k] for k in out["number"]]).drop(columns="number")

    dealt = todo.withColumn("shard", F.pmod("deal", F.lit(shards)))
    found = dealt.groupBy("shard").applyInPandas(run, "seg long, seg2 long, at int, lows array<long>")
    found = written(found, "matches")
    lows = found.where("at < 0").select(F.col("seg").alias("number"), "lows").join(shared.select("number", "window", "n"), "number")
    back = with_groups(single.select("seg", "seg2", "at", "window").distinct(), written(lows.drop("number"), "hot-lows"), "window")
    return found.where("at >= 0").unionByName(back.where("lows IS NOT NULL").select("seg", "seg2", "at", "lows"))


def _row_key(text_col: str) -> Column:
    return F.xxhash64(text_col)


def _copies(texts: DataFrame) -> DataFrame:
    """(id, key) of rows whose whole text a smaller id has: the index holds each text once, under its smallest id."""
    sums = written(texts.select("id", "key", F.sha2("text", 256).alias("sum")), "text-sums")
    first = sums.groupBy("sum").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    return written(with_groups(sums, written(first.where("first <> last"), "text-groups"), "sum").where("id <> first").select("id", "key").distinct(), "copies")


def _without_rows(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """All but the given (id, key); rows whose id is not among them don't move."""
    marked = KeyFilter(rows, "id").mark(texts, "id", "hit")
    return marked.where(~F.col("hit")).drop("hit").unionByName(marked.where("hit").drop("hit").join(rows, ["id", "key"], "left_anti"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, key, firsts): for each document with repeated windows the places of their first words; key is _row_key().

    For whole copies of a document with a smaller id that is [-1]: all their windows repeat.
    """
    texts = texts_of(docs).select(F.col(id_col).cast("long").alias("id"), _row_key(text_col).alias("key"), F.col(text_col).alias("text"))
    texts = texts.where("id IS NOT NULL AND text IS NOT NULL")
    copies = _copies(texts)
    texts = _without_rows(texts, copies)
    shared = KeyFilter(written(_shared_anchors(texts, width), "anchors"), "anchor", hashed=True)
    segments = _segments(texts.select("id", "key", "text"), shared, width)
    distinct = segments.where("text IS NOT NULL").select(F.col("key").alias("anchor"), "seg", "seg2", "text", "lo", "hi")
    matches = _matches(distinct, width)
    hits = segments.where("text IS NULL").select("seg", "seg2", "id", "key", "start").join(matches, ["seg", "seg2"])
    places = F.filter(F.sequence(F.lit(0), F.size("lows") - 1), lambda i: F.get("lows", i) < F.col("id"))
    spans = hits.select("id", "key", F.explode(F.transform(places, lambda i: F.col("start") + F.col("at") + i)).alias("first"))
    spans = spans.groupBy("id", "key").agg(F.sort_array(F.collect_set("first")).alias("firsts"))
    return written(spans.unionByName(copies.withColumn("firsts", F.array(F.lit(-1)))), "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of each row.

    A word goes when a window over it also starts in a document with a smaller id. Null and empty texts have no words.
    Rows with a null id keep all their words and take nothing from others. Rows repeated with one id don't take from
    each other. Texts shorter than a window stay whole; very long ones are hashed in blocks. An empty table gives an empty result. Other columns are ignored.
    """
    spans = repeated_spans(docs, id_col, text_col, width)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = KeyFilter(spans, "id").mark(rows.withColumn("__id", F.col("doc_id").cast("long")), "__id", "hit")
    whole = marked.where(~F.col("hit")).select("doc_id", "text", F.lit(None).cast("array<int>").alias("firsts"))
    spans = spans.withColumnRenamed("key", "__key")
    own = (F.col("__id") == F.col("id")) & (_row_key("text") == F.col("__key"))
    touched = marked.where("hit").join(spans, own, "left").select("doc_id", "text", "firsts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, firsts in zip(pdf["text"], pdf["firsts"], strict=True):
                words = words_of(text)
                n = len(words)
                if firsts is not None and n >= width:
                    firsts = np.asarray(firsts)
                    if firsts[0] < 0:
                        firsts = np.arange(n - width + 1)
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, firsts, 1)
                    np.add.at(edge, firsts + width, -1)
                    words = [w for w, c in zip(words, np.cumsum(edge[:-1]) == 0, strict=True) if c]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else ""))
            got = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            got.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield got if with_text else got.drop(columns="kept_text")

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return whole.mapInPandas(run, schema).unionByName(touched.mapInPandas(run, schema))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
lo AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM lo WHERE first < doc_id),
per AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w.w[i]) END AS k
  FROM w LEFT JOIN per ON w.doc_id = per.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
