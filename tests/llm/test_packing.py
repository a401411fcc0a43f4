import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import random_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.packing import curve_key, hilbert_keys, pack_documents
from lodestone.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), WordEncoder(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from("'sdtrevml .,\n\t\x0b\x1c\x85\xa0ΣσİK字é<|>endoftext"))))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == plain(text)


@pytest.mark.parametrize("text", ["it's we'll I'd x'sx ''s", "<|endoftext|> a", "½ ² ³¹ 12a3 º ª µ ÿ Ý ß", "ΑΣ ΑΣ.", "a" * 5000, "...!?  ,;.a.b", "", "\n"])
def test_ids_of_odd_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == plain(text)


@pytest.mark.parametrize("axes,levels", [(2, 4), (3, 3)])
def test_the_curve_visits_every_cell_by_single_steps(axes, levels):
    cells = np.stack(np.meshgrid(*[np.arange(1 << levels)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert_keys(cells, levels)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_equal_texts_have_equal_keys_and_near_ones_near_keys():
    r = np.random.default_rng(1)
    a = r.poisson(5, (200, 256)).astype(float)
    near = a + (r.random(a.shape) < 0.01)
    ka, kn = curve_key(a), curve_key(near)
    assert (curve_key(a) == ka).all()
    assert np.median(np.abs(ka - kn)) < np.median(np.abs(ka - r.permutation(ka))) / 4


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_rebuild_every_document(spark, length):
    rows = [*random_documents(9), (None, "null id"), (5000, None), (5001, "long " * 9000), (5002, "same"), (5002, "same")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'x' as ids", "1 as n", "2 as key")
    got = pack_documents(frame, PATH, length, with_ids=True).collect()
    whole = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for d, t in rows:
        want = np.array([*plain(t), 2], "<u4").tobytes()
        parts = sorted(whole[d, len(want) // 4])
        copies = sum((d, t) == x for x in rows)
        assert b"".join(p for _, p in parts[::copies]) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == len(sequences) - 1
    assert sum(r.length for r in got) == sum(len(plain(t)) + 1 for _, t in rows)


def test_nothing_to_pack(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
