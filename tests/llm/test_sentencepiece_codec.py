import hashlib

import numpy as np
import pytest

from somaframe.llm import sentencepiece_codec as S
from somaframe.llm.queries import model_path


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


TEXTS = ["", " ", "a  b", "\t x", "é́ ﬁ", "日本語 テスト", "😀 a😀", "x\n\n y ", "  lead", "trail  ", "▁▁a", "<s> hi </s> <unk>", "a" * 5000, "Ｆｕｌｌ", "ab " * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_library(library, text):
    codec = S.codec_of(S.load_model(model_path()))
    ids, begins, ends = codec.encode(text)
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert codec.decode(ids).decode() == library.decode(ids.tolist())
    assert (ends >= begins).all() and ends.max() <= len(text.encode())
    assert (np.diff(begins[1:-1]) >= 0).all()


def test_documents(documents, library):
    got = {r.doc_id: r for r in S.digests(documents, S.load_model(model_path())).collect()}
    for r in documents.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, empty, library):
    model = S.load_model(model_path())
    rows = S.encode(odd, model).collect()
    assert sorted(r.ids for r in rows) == sorted(library.encode(r.text or "", add_bos=True, add_eos=True) for r in odd.collect())
    assert S.encode(empty, model).count() == S.digests(empty, model).count() == 0


def raw_fields(data):
    """Top-level fields of a message: number, and its whole bytes, key included."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        begin = at
        key = varint()
        if key & 7 == 0:
            varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            at += size
        yield key >> 3, data[begin:at]


@pytest.fixture(scope="module", params=["nmt_nfkc", "nfkc_cf"])
def mapped(request):
    """The model with a compiled character map: the normaliser of one of the library's own rules in the place of its own."""
    import sentencepiece

    with open(model_path(), "rb") as f:
        model = f.read()
    rule = sentencepiece.SentencePieceNormalizer(rule_name=request.param)
    spec, size = rule.serialized_normalizer_spec(), b""
    n = len(spec)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return b"".join(raw for number, raw in raw_fields(model) if number != 3) + bytes([3 << 3 | 2]) + size + bytes([n]) + spec, rule


MAPPED = [*TEXTS, "Ｆｕｌｌ　ｗｉｄｔｈ ①②③ ㍿", "ﬁne ﬂow é́ Å Å", "ｶﾞｷﾞ バ", "a​b­c﻿", "ǅ Straße ΑΣ İ", "ẛ̣ ½ ⅷ ™ …", "\r\n\x01 \x7f x\u0085y", " 　 lead and trail   ", "각 한글", "ﷺ ﷽", "x" * 300 + "ﬁ" * 300]


def test_longest_entries_of_a_map(mapped):
    """The longest entry counts, not the first; where none begins there is none."""
    codec = S.codec_of(mapped[0])
    assert codec.charmap.units and codec.charmap.first
    text = "ﬁ é ｶﾞ x".encode()
    assert codec.charmap.longest(text, 0) == (3, b"fi")
    e = text.index(b"e")
    assert codec.charmap.longest(text, e) == (3, "é".encode())  # the longer entry, not e alone
    assert codec.charmap.longest("ｶﾞ".encode(), 0) == (6, "ガ".encode())
    assert codec.charmap.longest(b"x", 0) is None and codec.charmap.longest(b"e", 0) is None and codec.charmap.longest("é".encode()[:2], 0) is None


def test_normalisation_and_offsets_with_a_map(mapped):
    import sentencepiece

    proto, _ = mapped
    codec, library = S.codec_of(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for text in MAPPED:
        ids, begins, ends = codec.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert codec.decode(ids).decode() == library.decode(ids.tolist())
        normal, source = codec.normalise(text)
        assert normal == library.normalize(text), repr(text)
        assert len(source) == len(normal.encode()) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())
        # spans in bytes, as the library tells them; pieces of a single byte may share their character's span
        want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        got = list(zip(begins[1:-1].tolist(), ends[1:-1].tolist(), strict=True))
        assert len(got) == len(want)
        assert [w for w, i in zip(want, ids[1:-1].tolist(), strict=True) if codec.pieces[i][2] != S.BYTE] == [g for g, i in zip(got, ids[1:-1].tolist(), strict=True) if codec.pieces[i][2] != S.BYTE], repr(text)


def test_documents_with_a_map(documents, mapped):
    import sentencepiece

    proto, _ = mapped
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    got = {r.doc_id: r for r in S.digests(documents, proto).collect()}
    for r in documents.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
