import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.DEFAULT_FOLDER, tokens.DEFAULT_TOKENIZER)), reason="no tokenizer files")
TEXTS = ["", None, "  ", "Hello  world", "<|endoftext|> plain", "naïve 😀👩‍👧 日本語​", "a" * 20_000, "tab\tand\nline", "x­-ray"]


def table(spark):
    return spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], [2])], "id long, text string, ids array<int>")


def test_ids_and_round_trip(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(os.path.join(tokens.DEFAULT_FOLDER, tokens.DEFAULT_TOKENIZER))
    own.encode_special_tokens = True
    encoded = tokens.encode(table(spark), "id", "text")
    rows = [(r.id, r.ids) for r in encoded.collect()]
    assert len(rows) == len(TEXTS) + 1
    for k, ids in rows:
        assert ids == own.encode(TEXTS[k] or "", add_special_tokens=False).ids and 50256 not in ids
    assert {r.id: r.text for r in tokens.decode(encoded, "id").collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    counts = {r.id: r.n_tokens for r in tokens.count(table(spark), "id", "text").collect()}
    assert counts == {k: len(i) for k, i in rows}


def test_spans_cover_the_text(spark):
    for r in tokens.encode(table(spark), "id", "text", spans=True).collect():
        t = TEXTS[r.id] or ""
        assert len(r.starts) == len(r.ids) == len(r.ends)
        if t:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)
            assert all(b >= a and c <= b for a, b, c in zip(r.starts, r.ends, r.starts[1:]))


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [60_000, None, 39])], "id long, ids array<int>")
    rows = {r.id: r.text for r in tokens.decode(df, "id").collect()}
    assert rows[1] is None and rows[2] == "" and rows[3].startswith("��")


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_pieces_join_to_the_text(text):
    bpe = tokens.load(tokens.read_definition())
    ids = bpe.encode([text])[0]
    assert bpe.decode(ids) == text and "".join(bpe.decode_pieces(ids)) == text
    assert sum(len(bpe.to_bytes([k])) for k in ids) == len(text.encode())


def test_empty_table(spark):
    assert tokens.encode(table(spark).limit(0), "id", "text").count() == 0


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 10)
    parts = list(tokens.slices(["abc", None, "defghij", "k", "x" * 30]))
    assert [b for b, _ in parts] == [0, 3] and sum(len(p) for _, p in parts) == 5
