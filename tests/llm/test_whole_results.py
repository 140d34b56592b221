"""Nothing is lost: licence notices against verbatim search over whole tables, archives of rows that share an id."""

from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fillwise.llm import op3_warc as warc
from fillwise.llm import op10_licenses as lic


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_verbatim_notice_is_reported(sf):
    scanner, found = lic.Scanner(lic.TEMPLATES), 0
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall():
        got, words = Counter(x["license"] for x in scanner.scan(text)), f" {' '.join(lic.words_of(text or ''))} "
        for name, template in scanner.words.items():
            n = words.count(f" {' '.join(template)} ")
            assert got[name] >= n, (doc_id, name)
            found += n
    assert found >= 3


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([k for k, t in lic.TEMPLATES.items() if len(lic.words_of(t)) <= 20]), st.integers(0, 90), st.integers(0, 2**32))
def test_short_notices_are_found_among_words_that_do_not_compress(name, before, seed):
    """High-entropy words around the notice, wherever it starts in a block."""
    import random

    rng = random.Random(seed)
    noise = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüß0123456789", k=rng.randint(3, 14))) for _ in range(n)]
    text = " ".join([*noise(before), lic.TEMPLATES[name], *noise(rng.randint(0, 90))])
    hits = [x for x in lic.Scanner(lic.TEMPLATES).scan(text) if x["license"] == name]
    assert len(hits) == 1 and hits[0]["missing"] == hits[0]["added"] == []


def archived(spark, tmp_path, rows):
    pages = spark.createDataFrame([(i, f"u{k}", h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    return warc.read_archives(archives, with_payload=True).collect()


def test_rows_that_share_an_id_keep_their_own_payloads(spark, tmp_path):
    rows = [(1, "A"), (1, "B"), (2, "A"), (3, "B"), (4, "C"), (4, "D"), (5, "C"), (5, "C"), (None, "C"), (None, "E"), (6, None), (7, "")]
    top: dict = {}
    for i, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = Counter()
    for k, (i, h) in enumerate(rows):
        again = i is not None and i != top[h or ""]
        want[i, f"u{k}", warc.payload_digest((h or "").encode()), "revisit" if again else "response", top[h or ""] if again else None, "" if again else h or ""] += 1
    got = Counter((r["page_id"], r["url"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in archived(spark, tmp_path, rows))
    assert got == want and sum(got.values()) == len(rows)
