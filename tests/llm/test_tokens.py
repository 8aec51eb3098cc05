import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from collatura.llm import tokens  # noqa: E402

FILE = P.path("byte_bpe_50k.json")
SPEC = open(FILE, encoding="utf-8").read()
WHOLE = Tokenizer.from_file(FILE)
CODER = tokens.Encoder(SPEC)


def same(text):
    assert CODER.encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t'sreé.,x9½٣ñ一 \x1c\x85!-_—́ʰ")), max_size=24))
def test_encoder_equals_the_library_on_hard_characters(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_encoder_equals_the_library(text):
    same(text.encode("utf-8", "ignore").decode())


def test_encoder_on_special_strings():
    for text in ("", " ", "a<|endoftext|> b", "  two", "a  b", "a \n b", "a\n b ", "it's we'll 'tis", "x " * 300):
        same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_block_round_trip(ids, fits):
    ids = np.array(ids, "<u4")
    assert tokens.unpack(tokens.pack(ids, fits)).tolist() == ids.tolist()


def test_file_round_trip_and_random_access(tmp_path):
    rng = random.Random(2)
    docs = [(i if i != 3 else None, np.array([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 5, 9000]))], "<u4")) for i in range(12)]
    with open(tmp_path / "x", "wb") as out:
        w = tokens.Writer(out, block=256)
        for d in docs:
            w.add(*d)
        w.close()
    with open(tmp_path / "x", "rb") as file:
        r = tokens.Reader(file)
        flat = np.concatenate([x for _, x in docs])
        for _ in range(50):
            a, b = sorted((rng.randrange(len(flat) + 1), rng.randrange(len(flat) + 1)))
            assert (r.tokens(a, b) == flat[a:b]).all()
        got = list(r.documents(chunk=500))
        assert [(d, x.tolist()) for d, _, x in got] == [(d, x.tolist()) for d, x in docs]


def test_empty_file(tmp_path):
    with open(tmp_path / "x", "wb") as out:
        tokens.Writer(out).close()
    with open(tmp_path / "x", "rb") as file:
        assert list(tokens.Reader(file).documents()) == []


def test_table(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "lo", "ñu.", "\n", "x9"], k=rng.randrange(400)))) for i in rng.sample(range(900), 60)]
    rows += [(950, None), (951, ""), (952, "same"), (952, "same"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, mix int")
    got = tokens.token_files(df, FILE).orderBy("start").collect()
    at = 0
    for row, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.token_files(df.limit(0), FILE).count() == 0


def test_blank_cuts_are_not_taken_for_pieces():
    from tokenizers import models, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    whole = Tokenizer(models.BPE({x: i for i, x in enumerate([*letters, "ĠĠ", "ĠĊ"])}, [("Ġ", "Ġ"), ("Ġ", "Ċ")]))
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own = tokens.Encoder(whole.to_str())
    for text in ("a \nbar", "a \n bar", "a    b", "a  ", "a \n\n b", "a    b \n c"):
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
