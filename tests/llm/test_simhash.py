import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from collatura.llm import components, simhash
from collatura.llm.common import Scratch

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint_is_the_plain_majority(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) == plain_print(text.encode("utf-8", "ignore").decode())


def test_long_text_counts_in_chunks():
    text = " ".join(random.Random(1).choices(["a", "bb", "ccc", "é"], k=70_000))
    assert simhash.fingerprint(text.encode()) == plain_print(text)


@pytest.mark.parametrize("blocks", [1, 2, 4, 8])
def test_all_links_found_by_any_number_of_blocks(spark, monkeypatch, blocks):
    rng = random.Random(blocks)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:40]:
        for far in (1, 2, 3, 4):
            q = p
            for b in rng.sample(range(64), far):
                q ^= 1 << b
            prints.append(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "BLOCKS", ((10**9, blocks),) if blocks < 8 else ())
    scratch = Scratch(spark, "test")
    edges = simhash.links(scratch, spark.createDataFrame([(x,) for x in signed], "fp long"), tile=16)
    got = components.connected_components(scratch, edges)
    got = {r["node"]: r["component"] for r in got.collect()}
    links = [(a, b) for a in signed for b in signed if a < b and (a ^ b).bit_count() <= 3 or (a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)]
    want = plain_components(links, set(signed))
    assert {n: got.get(n, n) for n in want} == want


def test_components_in_rounds_equal_the_plain_ones(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(60)]
    df = spark.createDataFrame(edges + edges[:9], "a long, b long")
    for most in (10, 10**6):
        got = {r["node"]: r["component"] for r in components.connected_components(Scratch(spark, "test"), df, per_task=most).collect()}
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        assert got == plain_components(edges, nodes)


def test_odd_rows(spark):
    rows = [(3, "one two three four", "x", "y"), (1, "One  two\tTHREE four", None, None), (2, None, "x", None), (5, "", "x", None), (9, " \n ", "x", None), (None, "one two three four", "x", None), (None, "alone in the world here", "x", None), (3, "one two three four", "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 1), (1, 1), (2, 2), (5, 2), (9, 2), (None, 1), (None, None), (3, 1)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark):
    from pathlib import Path

    from collatura.llm.queries import op2_simhash

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = plain_components(links, set(prints))
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
