"""SentencePiece encoding against the library itself: ids, spans and decoded texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfseek.llm import queries, sentencepieces
from shelfseek.llm.sentencepieces import NORMALIZER, PIECES, Encoder, fields, message_of


def model_with(**changes) -> bytes:
    """The public model with other rules of normalisation, or with further pieces."""
    with open(queries.piece_model_path(), "rb") as file:
        model = file.read()
    out = [said for field, _, said in fields(model) if field != NORMALIZER]
    spec = message_of(1, b"own")
    if changes.get("rule"):
        rule = sentencepiece.SentencePieceNormalizer(rule_name=changes["rule"]).serialized_normalizer_spec()
        spec += b"".join(said for field, _, said in fields(rule) if field == 2)
    spec += message_of(3, changes.get("dummy", 1)) + message_of(4, changes.get("fewer", 0)) + message_of(5, 1)
    own = [message_of(PIECES, message_of(1, p.encode()) + b"\x15\0\0\0\0" + message_of(3, 4)) for p in changes.get("own", ())]
    first = [said for said in out if said[0] == PIECES << 3 | 2]
    return b"".join(first + own + [said for said in out if said[0] != PIECES << 3 | 2]) + message_of(NORMALIZER, spec)


MODELS = {
    "as it is": {}, "nfkc": {"rule": "nfkc"}, "nmt, fewer spaces": {"rule": "nmt_nfkc", "fewer": 1},
    "case folding, no dummy": {"rule": "nmt_nfkc_cf", "fewer": 1, "dummy": 0}, "fewer spaces": {"fewer": 1},
    "own pieces": {"own": ("<eot>", "é!")}, "own pieces over words": {"own": ("a▁b",), "rule": "nfkc"},
}
TEXTS = [
    "", " ", "  two  spaces  ", "Hello World", "▁mark", "a b a b", "ﬁne ﬂag ①②③ ½ ™", "Å Å Å", "가각힣 한국어 ｶﾞ ガ", "\t\n\r tab",
    "　wide　", "​zero​ width­", "😀 👩‍👩‍👧 𝒳", "x\x00y", "<s> </s> <unk> <0x41>", "é!é! <eot><eot> é!", "¨ ´a", "ÉÈ Straße İ",
    "�", "word " * 50, "a" * 300, "ا ﷺ ﷽",
]


@pytest.fixture(scope="module", params=MODELS, ids=list(MODELS))
def both(request):
    model = model_with(**MODELS[request.param])
    return Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def same(both, texts):
    encoder, library = both
    for text in texts:
        ids, first, last = encoder.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        spans = sentencepieces.spans_of(library.encode(text, return_type="serialized_proto"))[:, 1:].tolist()
        assert [list(pair) for pair in zip(first.tolist(), last.tolist())][1:-1] == spans, text


def test_chosen_texts(both):
    same(both, TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text(both, texts):
    same(both, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab  ▁é!é①ﬁ　​한<eot>\n", max_size=30), max_size=4))
def test_texts_of_odd_signs(both, texts):
    same(both, texts)


def test_which_vocabularies_are_cut_by_word():
    assert Encoder(model_with()).by_word
    assert not Encoder(model_with(own=("a▁b",))).by_word


@pytest.mark.parametrize("stretch", [1, 7, 50])
def test_stretches_do_not_show(monkeypatch, stretch):
    monkeypatch.setattr(sentencepieces, "STRETCH", stretch)
    model = model_with()
    pair = Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    same(pair, [*TEXTS, " ".join(TEXTS), "  ".join(TEXTS)])


def plain_row(library, doc_id, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    digests = (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())
    return (doc_id, len(ids), *(hashlib.sha256(d).hexdigest() for d in digests))


def test_query_equals_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = queries.op13_sentencepiece(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(plain_row(library, r.doc_id, r.text) for r in docs)


def test_odd_rows(documents, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())
    rows = [*odd_rows, *enumerate(TEXTS, 100), (None, None), (3, "again"), (3, "again")]
    found = sentencepieces.encode(documents(rows), queries.piece_model_path()).collect()
    shown = [(r.doc_id, r.n_tokens, *(hashlib.sha256(d).hexdigest() for d in (r.ids, r.decoded.encode()))) for r in found]
    assert sorted(shown, key=repr) == sorted((plain_row(library, row[0], row[1]) for row in rows), key=repr)
    assert sentencepieces.encode(documents(rows).where("false"), queries.piece_model_path()).collect() == []


def test_pieces_cover_their_source(documents):
    texts = {i: text for i, text in enumerate(TEXTS)}
    encoded = sentencepieces.encode(documents(list(texts.items())), queries.piece_model_path())
    rows = sentencepieces.pieces(encoded, queries.piece_model_path()).orderBy("doc_id", "place").collect()
    for i, text in texts.items():
        mine = [r for r in rows if r.doc_id == i]
        assert [r.place for r in mine] == list(range(len(mine))) and (mine[0].piece, mine[-1].piece) == ("<s>", "</s>")
        assert b"".join(text.encode()[r.first : r.last] for r in mine) == text.encode()
