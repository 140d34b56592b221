"""Word hashes of long words, and scratch tables of threads side by side."""

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest

from fillwise.llm import common
from fillwise.llm.op2_jaccard import near_duplicates


def twins(k):
    """Two words of 2 ** k letters whose numbers in any base are equal modulo 2 ** 64 for k of 11 or more."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("codes", [common.EXACT_CODES, common.FOLDED_CODES])
@pytest.mark.parametrize("k", [3, 9, 10, 12, 19])
def test_unlike_words_have_unlike_hashes(codes, k):
    a, b = twins(k)
    (h, n), = common.word_hashes(pa.array([f"{a} {b} {a}"]), codes)
    assert n.tolist() == [3] and h[0] == h[2] != h[1]


def test_only_letters_fold():
    a, _ = twins(12)
    hashes = lambda text, codes: next(common.word_hashes(pa.array([text]), codes))[0].tolist()
    assert hashes(a.upper() + "É", common.FOLDED_CODES) == hashes(a + "É", common.FOLDED_CODES) != hashes(a + "é", common.FOLDED_CODES)
    assert hashes(a.upper(), common.EXACT_CODES) != hashes(a, common.EXACT_CODES)


def test_unlike_long_words_do_not_link(spark):
    a, b = twins(12)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper()), (4, f"{b} x")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_threads_do_not_delete_each_others_tables(spark):
    docs = [spark.createDataFrame([(k, f"one two three four five six {k // 2 * (n + 1)}") for k in range(8)], "doc_id long, text string") for n in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda d: sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(d).collect()), docs))
    assert all(rows == [(k, k // 2 * 2) for k in range(8)] for rows in got)
