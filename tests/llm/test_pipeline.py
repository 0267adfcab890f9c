import hashlib

import numpy as np

import corpus_pipeline as C
from somaframe.llm._common import checkpoint
from somaframe.llm.queries import model_path
from tests_llm_brute import check_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    import sentencepiece

    docs, seen = documents, {}
    for name, stage in C.STAGES:
        seen[name] = docs
        docs = checkpoint(stage(spark, docs, SF))
        if name != "encode":
            assert docs.columns == documents.columns
    check_kept([(r.doc_id, r.text) for r in seen["near_dedup"].collect()], {r.doc_id for r in seen["mix_sources"].collect()})
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = sorted((r.doc_id, hashlib.sha256(np.array(library.encode(r.text or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()) for r in seen["encode"].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in docs.collect()) == want
    assert sorted(r.doc_id for r in C.run(spark, SF).collect()) == [d for d, _ in want]


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in C.STAGES:
            docs = checkpoint(stage(spark, docs, SF))
    assert docs.count() == 0
