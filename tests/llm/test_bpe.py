import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.bpe import LATIN, Bpe, encoded

BPE = Bpe()
PARTS = ["a", "th", "ing", "'s", "'ll", "'", " ", "  ", "\n", "\t", "1", "23", "!", "--", "é", "漢", "😀", "<|endoftext|>", "<|endo", "ftext|>", "\x1c", " ", " ", "ſ", "́"]


def direct(text):
    return BPE.tokenizer.encode(text, add_special_tokens=False).ids


def test_both_encoders_agree_on_every_latin_character():
    for c in map(chr, range(ord(LATIN))):
        for text in (c, f"a{c}b", f" {c} ", c * 3, f"1{c}'s", f"{c}\n{c}!"):
            assert BPE.plain.encode_ordinary(text) == direct(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=250).map("".join), st.sampled_from([3, 24, 100]))
def test_short_leaves(text, leaf):
    BPE.leaf = leaf
    assert BPE.encode(text) == direct(text)


@pytest.mark.parametrize("seed", range(12))
def test_long_unsplit_texts(seed):
    r = random.Random(seed)
    parts = r.sample([x for x in PARTS if not x.isspace()], r.randint(1, 4)) if seed % 3 else ["a", "b", "e"]
    text = "".join(r.choices(parts, k=3000))
    BPE.leaf = r.choice([40, 200])
    assert BPE.encode(text) == direct(text)


def test_round_trip_of_rows(spark):
    texts = [None, "", " ", "plain text", "<|endoftext|> é 漢 😀", "x" * 40_000, "ab " * 20_000, "�\u0000z"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "i long, text string, ids string")
    out = encoded(df, ("ids", "decoded", "intact")).collect()
    for x in out:
        assert list(x.ids) == direct(texts[x.i] or "") and x.decoded == (texts[x.i] or "") and x.intact
    assert encoded(df.limit(0)).count() == 0
    from hashlib import sha256

    for x in encoded(df, ("n_tokens", "ids_sha256", "decoded_sha256")).collect():
        ids = direct(texts[x.i] or "")
        assert (x.n_tokens, x.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == sha256(BPE.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
