"""Divergence of sources against a brute-force version, on hard rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fillwise.llm import op13_divergence as div
from tests.llm.test_operators import lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    """Every pair and term of (text, lang, source) rows, term by term."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall(lower(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def share(c, kept=kept):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found, 1)]
    return sorted(out)


def documents(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcABCéßЖ漢", k=rng.randint(1, 4))) for _ in range(80)] + ["a" * 5000, "𝒳y"]
    texts = lambda: rng.choice([" ", "-", "1", "\x7f", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40, 300])))
    rows = [(texts(), rng.choice(["en", "de", None, ""]), rng.choice(["web", "news", "é", None, "Z", "a"])) for _ in range(n)]
    return [*rows, *rows[:9], (None, "en", "silent"), ("", None, None), ("12 34", "xx", "lone"), ("one two", "yy", "p"), (None, "yy", "q")]


@pytest.mark.parametrize(("min_docs", "top", "block"), [(10, 10, 2048), (2, 3, 7), (1, 10, 1)])
def test_divergence_equals_brute_force(spark, min_docs, top, block):
    rows = documents()
    # columns with names of the operator's own change nothing
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(5)
    got = sorted(map(tuple, div.divergence(docs, min_docs=min_docs, top=top, block_terms=block).collect()))
    assert got == brute(rows, min_docs, top)


def test_no_documents_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert div.divergence(docs).count() == 0


@given(st.lists(st.sampled_from(["a", "B", "é", " ", "7", "漢", "_"]), max_size=60), st.integers(1, 20))
def test_texts_are_cut_between_terms(parts, piece):
    text = "".join(parts)
    assert [t.decode() for some in div.terms_of(text.encode(), piece) for t in some] == TERM.findall(lower(text))


@settings(deadline=None)
@given(st.integers(1, 5), st.integers(1, 30), st.integers(0, 2**32))
def test_runs_give_the_same_sums(rows, n, seed):
    rng = np.random.default_rng(seed)
    matrix = rng.integers(0, 4, (rows, n))
    whole = [div.shares(r, int(r.sum()), n) for r in matrix]
    runs = [(at, div.shares(v, int(r.sum()), n)) for r, (at, v) in zip(matrix, div.run_lengths(matrix), strict=True)]
    for i in range(rows):
        for k in range(rows):
            assert div.over_runs(runs[i], runs[k], n) == int(div.distance(whole[i], whole[k]).sum())


def test_shares_of_large_counts_are_exact():
    counts = np.array([0, 5, 10**12, 2**60])
    assert div.shares(counts, 2**61, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (2**61 + 8) for c in counts]
