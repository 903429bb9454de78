import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselens.llm import op2_token_files as files
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [files.END]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_on_their_own_give_the_same_ids(tokenizer, rows):
    texts = [r[1] for r in rows] + [r[1] or "" for r in ODD] + [
        "I'll we've don't 'S ''s a'b", "ÀÉÎõü ÿÿ ß ﬀ İstanbul Σας ὈΔΥΣΣΕΎΣ", "é ́ ǻ", "a<|endoftext|>b <|ENDOFTEXT|>",
        " x　y\x85z\x1c", "中文字符 日本語 한국어 १२३", "x" * 5000, "...!!! $$$ (a) [b]{c}", "naïve×÷ª º µm", "ÃÂ¢",
    ]
    encoder = files.Encoder(PATH)
    ids, ends = encoder.encode(pa.array(texts, pa.large_string()))
    assert encoder.plain and len(ends) == len(texts)
    for text, a, b in zip(texts, [0, *ends[:-1]], ends):
        assert ids[a:b].tolist() == whole(tokenizer, text), text[:80]


def check(got, texts, tokenizer):
    start = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), texts):
        ids = whole(tokenizer, t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(texts)


def test_round_trip(documents, rows, tokenizer):
    check(files.round_trip(documents, PATH).collect(), [(r[0], r[1]) for r in rows], tokenizer)


def test_odd_rows(odd, empty, tokenizer):
    got = files.round_trip(odd, PATH).collect()
    want = sorted((r[0] is not None, r[0] or 0, len(whole(tokenizer, r[1])), crc(whole(tokenizer, r[1]))) for r in ODD)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert files.round_trip(empty, PATH).count() == 0


def test_sequences_are_equal_and_mapped(spark, rows, tokenizer, tmp_path):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows[:30]], "doc_id bigint, text string")
    manifest = files.write_token_files(docs, str(tmp_path), PATH, length=64)
    stream = [x for r in rows[:30] for x in whole(tokenizer, r[1])]
    read = []
    for m in manifest.orderBy("start").collect():
        file = files.TokenFile(f"{tmp_path}/{m.file}")
        own = []
        for i in range(len(file)):
            ids = file.ids(i)
            assert len(ids) == 64 and not ids.flags.owndata and ids.dtype == np.uint16
            own += ids[file.mask(i)].tolist()
        assert len(own) == m.n_tokens
        read += own
    assert read == stream


def test_an_encoder_holds_a_bounded_number_of_words():
    """Workers of an executor encode side by side, after stages that left them little memory."""
    own = files.Encoder(PATH)
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in f"{i:06d}") for i in range(250_000)]
    for a in range(0, len(words), 50_000):
        own.encode(pa.array([" ".join(words[a : a + 50_000])], pa.large_string()))
    assert 0 < len(own.bodies) + len(own.bodies.older) <= 200_000
