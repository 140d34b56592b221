"""Near-duplicate components by a token-group matrix: exact components of all links, without the links themselves.

A document is its set of 5-word shingles; two link when 100 |A & B| >= 75 |A | B|. Identical sets are one document from
the start. Documents that share a min-hash are tried against the one among them with the fewest rare tokens; those that
link with it form its group and keep their difference from it. The token-group matrix holds, for each group, the union
of its members' prefix tokens with sizes and places. Groups meet in it, and the overlap that sizes, places and common
tokens allow bounds them. For a pair that qualifies, each member of the smaller group is a query: it is tried against
the other group's leader, and where that fails the group is opened by the differences from the leader.

Why nothing is lost. Tokens are ordered rare first, the order being the same for all: if A and B link and |B| <= |A|,
the first |A| - ceil(3|A|/4) + 1 tokens of A and the first |B| - ceil(6|B|/7) + 1 tokens of B share one. Inside an
opened group with leader L, let a document lack m tokens of L and have e others, w = 4m + 3e. A and B with x differences
in common link exactly when |L| + 7x >= wA + wB. A query that doesn't link with L has w > |L|, so a partner B shares
more than wB / 7 of its m + e differences, and the first m + e - floor(wB / 7) of them have one that the query has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import FOLDED_CODES, KeyFilter, components, mixed, settled, texts_of, with_groups, word_hashes, written

#: Tokens that are known as frequent: at most so many, each in so many documents among so many tokens. They only affect the order.
MAX_FREQUENT, BATCH_MIN, BATCH_TOKENS = 100_000, 2, 2_000_000
MIN_HASHES = 3
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes of some rows one after the other, their number for each row), in row order.

    With fewer words than ``width`` the whole sequence is one shingle; without words there is none.
    """
    for words, counts in word_hashes(texts, FOLDED_CODES):
        n = len(words)
        rolled = np.full(max(0, n - width + 1), width, dtype=np.uint64)
        for i in range(width):
            rolled = rolled * _P + words[i : i + len(rolled)]
        rolled = mixed(rolled)
        sets, at = [], 0
        for k in counts.tolist():
            if k >= width:
                s = np.sort(rolled[at : at + k - width + 1])
                sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif k:
                h = np.full(1, k, dtype=np.uint64)
                for i in range(at, at + k):
                    h = h * _P + words[i : i + 1]
                sets.append(mixed(h))
            else:
                sets.append(np.zeros(0, np.uint64))
            at += k
        yield np.concatenate(sets), np.array([len(s) for s in sets])


def one_by_one(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each row."""
    for flat, counts in shingle_sets(texts):
        yield from np.split(flat, np.cumsum(counts)[:-1])


def probe_length(n):
    return n - -(-3 * n // 4) + 1


def index_length(n):
    return n - -(-6 * n // 7) + 1


def _frequent(texts: DataFrame) -> np.ndarray:
    """(token, documents) of the most frequent tokens, by token. Only the order of tokens depends on it."""

    def count(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        tokens.sort()
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(np.append(edge, len(tokens)))
        often = times >= BATCH_MIN
        return pa.record_batch({"token": tokens[edge[often]].view(np.int64), "n": times[often]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for flat, _ in shingle_sets(batch.column(0)):
                held.append(flat)
                size += len(flat)
                if size >= BATCH_TOKENS:
                    yield count(held)
                    held, size = [], 0
        yield count(held)

    counts = texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas()
    pairs = np.array([top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.uint64)])
    return pairs[:, np.argsort(pairs[0])]


class _Order:
    """The common order of tokens: unknown ones by hash, then known ones by number of documents and hash."""

    def __init__(self, frequent: np.ndarray):
        self.tokens, self.times = frequent
        self.some = np.zeros(1 << 22, dtype=bool)
        self.some[self.tokens >> np.uint64(42)] = True

    def known(self, flat: np.ndarray) -> np.ndarray:
        """Number of documents of each token, 0 where it is not among the frequent ones."""
        out = np.zeros(len(flat), dtype=np.uint64)
        at = np.flatnonzero(self.some[flat >> np.uint64(42)])
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, flat[at]), len(self.tokens) - 1)
            out[at] = np.where(self.tokens[place] == flat[at], self.times[place], np.uint64(0))
        return out


def _prefix(s: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a set's probe, in order, with the number of documents of each."""
    k, unknown = probe_length(len(s)), s[often == 0]
    if len(unknown) >= k:
        return unknown[:k], np.zeros(k, dtype=np.uint64)
    rest = np.flatnonzero(often)
    rest = rest[np.argsort(often[rest], kind="stable")][: k - len(unknown)]
    return np.concatenate([unknown, s[rest]]), np.concatenate([np.zeros(len(unknown), np.uint64), often[rest]])


def _sets(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, n, rare, sig1, sig2, mh, probe, edge_n, edge, index_edge_n, index_edge) of each row.

    ``probe`` has the rarest tokens in order, as many as a probe needs; the edges are the places in the common order of
    its last token and of the last one that the index holds; ``rare`` tells how many in a thousand tokens are unknown.
    """
    kind = texts.schema["id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def rows(flat: np.ndarray, counts: np.ndarray, order: _Order) -> dict[str, pa.Array]:
        m = len(counts)
        full = np.flatnonzero(counts)
        begin = (np.cumsum(counts) - counts)[full]
        often = order.known(flat)

        def each(ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
            out = np.zeros(m, dtype=np.uint64)
            if len(full):
                out[full] = ufunc.reduceat(values, begin)
            return out.view(np.int64)

        lows = [each(np.minimum, mixed(flat ^ np.uint64(k * 7919 + 1))) for k in range(MIN_HASHES)]
        unknown = np.add.reduceat((often == 0).astype(np.int64), begin) if len(full) else np.zeros(0, np.int64)
        rare = np.zeros(m, dtype=np.int32)
        rare[full] = 1000 * unknown // counts[full]
        probes, edges = [], np.zeros((4, m), dtype=np.int64)
        for k, a in zip(full.tolist(), begin.tolist(), strict=True):
            n = int(counts[k])
            probe, times = _prefix(flat[a : a + n], often[a : a + n])
            probes.append(probe)
            for i, last in ((0, len(probe) - 1), (2, index_length(n) - 1)):
                edges[i, k], edges[i + 1, k] = times[last], probe[last] >> np.uint64(1)
        sizes = np.zeros(m + 1, dtype=np.int32)
        sizes[1:][full] = [len(p) for p in probes]
        values = np.concatenate([np.zeros(0, np.uint64), *probes]).view(np.int64)
        mh_sizes = np.where(counts > 0, MIN_HASHES, 0)
        mh = np.column_stack(lows)[full].ravel()
        return {
            "n": pa.array(counts.astype(np.int32)), "rare": pa.array(rare),
            "sig1": pa.array(each(np.add, flat)), "sig2": pa.array(each(np.bitwise_xor, mixed(flat * _P))),
            "mh": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(mh_sizes)]).astype(np.int32), mh),
            "probe": pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), values),
            "edge_n": pa.array(edges[0]), "edge": pa.array(edges[1]),
            "index_edge_n": pa.array(edges[2]), "index_edge": pa.array(edges[3]),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(shared.value)
        for batch in batches:
            at = 0
            for flat, counts in shingle_sets(batch.column(1)):
                yield pa.record_batch({"id": batch.column(0).slice(at, len(counts)), **rows(flat, counts, order)})
                at += len(counts)

    schema = (
        f"id {kind}, n int, rare int, sig1 long, sig2 long, mh array<long>, probe array<long>, "
        "edge_n long, edge long, index_edge_n long, index_edge long"
    )
    return written(texts.mapInArrow(run, schema), "sets")


def _compared(pairs: DataFrame, texts: DataFrame, wanted: str) -> DataFrame:
    """(a, b, linked, size, w, d, delta) of each pair, by whole sets; ``size`` is that of b.

    d differences of a from b in order: what only a has, then what only b has. ``delta`` has the first ones of those that
    link ('prefix'), all of those that do not where the pair is ``open`` and may matter ('whole'), or is empty ('none').
    """
    pairs = written(
        pairs.where("a <> b").groupBy("a", "b").agg(F.max("open").alias("open")) if wanted == "whole"
        else pairs.where("a <> b").select("a", "b").distinct().withColumn("open", F.lit(False)), "pairs"
    )
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = written(KeyFilter(involved, "id").mark(texts, "id", "hit").where("hit").select("id", "text"), "texts")
    left = some.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = some.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    empty = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, t, is_open in zip(one_by_one(batch.column(3)), one_by_one(batch.column(4)), batch.column(2).to_pylist(), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                e, m = len(s) - both, len(t) - both
                w, linked = 4 * m + 3 * e, both > 0 and 100 * both >= 75 * (e + len(t))
                keep = 0
                if wanted == "prefix" and linked:
                    keep = e + m - w // 7
                elif wanted == "whole" and is_open and not linked and 3 * w <= 7 * len(t):
                    keep = e + m
                delta = empty
                if keep:
                    only = [np.setdiff1d(x, y, assume_unique=True) for x, y in ((s, t), (t, s))]
                    one = np.uint64(1)
                    delta = np.concatenate([only[0] & ~one, only[1] | one])[:keep].view(np.int64)
                out.append((bool(linked), len(t), w, e + m, delta))
            linked, size, w, d, delta = zip(*out, strict=True) if out else ((),) * 5
            offsets = np.cumsum([0, *map(len, delta)]).astype(np.int32)
            yield pa.record_batch({
                "a": batch.column(0), "b": batch.column(1), "linked": pa.array(linked, pa.bool_()), "size": pa.array(size, pa.int32()),
                "w": pa.array(w, pa.int32()), "d": pa.array(d, pa.int32()),
                "delta": pa.ListArray.from_arrays(offsets, np.concatenate([empty, *delta])),
            })

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "open", "text_a", "text_b")
    return written(joined.mapInArrow(run, f"a {kind}, b {kind}, linked boolean, size int, w int, d int, delta array<long>"), "compared")


def _grouped(reps: DataFrame, assigned: DataFrame) -> DataFrame:
    """Adds grp: the leader of a row's group, itself where it has none. Rows without a group don't move."""
    marked = KeyFilter(assigned, "member").mark(reps, "id", "hit")
    alone = marked.where(~F.col("hit")).drop("hit").withColumn("grp", F.col("id"))
    rest = marked.where("hit").drop("hit").join(assigned, F.col("id") == F.col("member"), "left")
    return alone.unionByName(rest.withColumn("grp", F.coalesce("leader", "id")).drop("member", "leader"))


def _may_link() -> Column:
    """Whether some member of p_grp may link with some member of x_grp that is no larger, by what the matrix says.

    The first common token in order is a hit. So the overlap is at most what either has from its first hit on; and at
    most the hits and what is behind the earlier of the two edges. A link needs 3 / 7 of the sum of the sizes.
    """
    past = F.greatest("hi", "ihi")
    behind_probe, behind_index = F.ceil(3 * F.col("hi") / 4) - 1, F.ceil(6 * F.col("ihi") / 7) - 1
    tail = F.when(F.col("single"), F.col("n_place")).otherwise(past), F.when(F.col("single"), F.col("i_place")).otherwise(past)
    first = F.col("edge") <= F.col("index_edge")
    behind = F.when(first, F.least(behind_probe, tail[1])).otherwise(F.least(F.greatest(behind_index, F.when(F.col("single"), 0).otherwise(behind_probe)), tail[0]))
    overlap = F.least("rem", "irem", F.col("hits") + behind)
    return 7 * overlap >= 3 * (F.col("lo") + F.greatest(F.col("ilo"), F.ceil(3 * F.col("lo") / 4)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest id reachable by links.

    Null and empty texts and texts without words have no shingles and link with nothing, not even with each other.
    Rows repeated with one id are one document that has the links of all of them. Rows with a null id are left alone:
    their component is null. Very long texts are hashed in blocks and compared whole. An empty table gives an empty
    result. Other columns are ignored. The result is a table; all tables on the way are deleted.
    """
    return settled(docs.sparkSession, lambda: _near_duplicates(docs, id_col, text_col), "near-duplicates")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = texts_of(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = _sets(texts, _frequent(texts))
    usable = sets.where("n > 0 AND id IS NOT NULL")
    classes = written(usable.groupBy("sig1", "sig2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    signed = lambda df, *rest: df.select(F.struct("sig1", "sig2", "n").alias("signature"), *rest)
    members = with_groups(signed(usable, "id"), signed(classes, "rep", "rows"), "signature", "rows").select("id", "rep").distinct()
    members = written(members, "members")
    marked = KeyFilter(members.where("id <> rep"), "id").mark(usable, "id", "hit")
    own = members.where("id = rep").select("id")
    reps = marked.where(~F.col("hit")).drop("hit").unionByName(marked.where("hit").drop("hit").join(own, "id", "left_semi"))
    # ids with several texts are neither leaders nor in groups
    several = members.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    several = written(several, "several")

    # groups of similar documents around the one with the fewest rare tokens
    keys = reps.select("id", "n", "rare", F.posexplode("mh").alias("k", "mh")).withColumn("slot", F.struct("k", "mh"))
    keys = written(keys.join(several, "id", "left_anti"), "min-hashes")
    leaders = keys.groupBy("slot").agg(F.min(F.struct("rare", "id", "n")).alias("leader"), F.count("*").alias("m"))
    leaders = written(leaders.where("m > 1"), "leaders")
    star = with_groups(keys, leaders, "slot", "m").where("leader IS NOT NULL").where("4 * least(n, leader.n) >= 3 * greatest(n, leader.n)")
    star = star.select(F.col("id").alias("a"), F.col("leader.id").alias("b"))
    tried = _compared(star, texts, "prefix").where("linked")
    rare = keys.where("k = 0").groupBy(F.col("id").alias("b")).agg(F.min("rare").alias("rare"))
    best = tried.join(rare, "b").groupBy("a").agg(F.min(F.struct("rare", "b")).alias("x"))
    assigned = written(best.select(F.col("a").alias("member"), F.col("x.b").alias("leader")), "groups")
    roots = written(components(tried), "roots")

    # the token-group matrix: prefix tokens of each group, with the sizes and places of the documents that have them
    grouped = _grouped(reps, assigned)
    tokens = grouped.select(
        "id", "n", "grp", F.struct("edge_n", "edge").alias("edge"), F.struct("index_edge_n", "index_edge").alias("index_edge"),
        F.posexplode("probe").alias("place", "token"),
    ).withColumn("indexed", F.col("place") < F.col("n") - F.ceil(6 * F.col("n") / 7) + 1)
    contested = tokens.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("indexed").alias("indexed"))
    contested = written(contested.where("lo <> hi AND indexed").select("token"), "contested")
    tokens = KeyFilter(contested, "token", hashed=True).mark(tokens, "token", "hit").where("hit").drop("hit")
    postings = tokens.join(contested, "token", "left_semi")
    of_index = lambda x: F.when(F.col("indexed"), x)
    matrix = written(postings.groupBy("token", "grp").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("place")).alias("rem"),
        F.min(of_index(F.col("n"))).alias("ilo"), F.max(of_index(F.col("n"))).alias("ihi"),
        F.max(of_index(F.col("n") - F.col("place"))).alias("irem"), F.min(F.col("n") - F.col("place") - 1).alias("after"),
        F.max("edge").alias("edge"), F.min(of_index(F.col("index_edge"))).alias("index_edge"),
    ), "matrix")
    p = matrix.select("token", F.col("grp").alias("p_grp"), "lo", "hi", "rem", F.col("after").alias("n_place"), "edge")
    x = matrix.where("ilo IS NOT NULL").select("token", F.col("grp").alias("x_grp"), "ilo", "ihi", "irem", F.col("after").alias("i_place"), "index_edge")
    hits = p.join(x, "token").where("p_grp <> x_grp AND ilo <= hi AND 4 * ihi >= 3 * lo")
    hits = hits.groupBy("p_grp", "x_grp").agg(
        F.count("*").alias("hits"), *(F.min(c).alias(c) for c in ("lo", "ilo", "n_place", "i_place", "index_edge")),
        *(F.max(c).alias(c) for c in ("hi", "ihi", "rem", "irem", "edge")),
    )

    # which groups have several documents, and which of a pair is the query
    sizes = assigned.groupBy(F.col("leader").alias("of")).agg(F.count("*").alias("size"))
    sizes = written(sizes.unionByName(several.select(F.col("id").alias("of"), F.lit(0).cast("long").alias("size"))), "sizes")
    size_of = lambda name, grp: sizes.select(F.col("of").alias(grp), F.col("size").alias(name))
    pairs = hits.join(size_of("p_size", "p_grp"), "p_grp", "left").join(size_of("x_size", "x_grp"), "x_grp", "left")
    pairs = pairs.withColumn("single", F.col("p_size").isNull() & F.col("x_size").isNull()).where(_may_link())
    own_root = lambda grp: F.coalesce(f"{grp}_root", grp)
    for grp in ("p_grp", "x_grp"):
        pairs = pairs.join(roots.select(F.col("node").alias(grp), F.col("root").alias(f"{grp}_root")), grp, "left")
    pairs = pairs.where(own_root("p_grp") != own_root("x_grp"))
    p_size, x_size = F.coalesce("p_size", F.lit(0)), F.coalesce("x_size", F.lit(0))
    smaller = (p_size < x_size) | (p_size == x_size) & (F.col("p_grp") > F.col("x_grp"))
    pairs = written(pairs.select(
        F.when(smaller, F.col("p_grp")).otherwise(F.col("x_grp")).alias("asks"), F.when(smaller, F.col("x_grp")).otherwise(F.col("p_grp")).alias("b"),
        (F.greatest(p_size, x_size) > 0).alias("open"),
    ).distinct(), "qualifying")
    queries = pairs.select(F.col("asks").alias("a"), "b", "open").unionByName(
        pairs.join(assigned, F.col("asks") == F.col("leader")).select(F.col("member").alias("a"), "b", "open")
    )
    asked = _compared(queries, texts, "whole")

    # opened groups: documents that share enough differences from the leader
    q = asked.where("NOT linked AND size(delta) > 0").select(
        F.col("a").alias("q"), F.col("b").alias("leader"), "size", F.col("w").alias("q_w"), F.col("d").alias("q_d"), F.posexplode("delta").alias("q_place", "token")
    )
    inner = tried.join(assigned, (F.col("a") == F.col("member")) & (F.col("b") == F.col("leader"))).select(
        "member", "leader", "w", "d", F.posexplode("delta").alias("place", "token")
    )
    needs = F.ceil((F.col("q_w") + F.col("w") - F.col("size")) / 7)
    met = q.join(inner, ["leader", "token"]).where((F.col("place") <= F.col("d") - needs) & (F.col("q_place") <= F.col("q_d") - needs))
    opened = _compared(met.select(F.col("q").alias("a"), F.col("member").alias("b")), texts, "none")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(members.join(several, "id", "left_semi").select("id", "rep"))
    links = links.union(asked.where("linked").select("a", "b")).union(opened.where("linked").select("a", "b"))
    roots = written(components(links), "roots")

    of_class = members.join(roots, F.col("rep") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = sets.select("id", "n").join(of_class.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
walk(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM walk r JOIN links l ON r.doc_id = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN walk r ON d.doc_id = r.doc_id
GROUP BY d.doc_id, n.n
"""
