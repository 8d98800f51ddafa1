import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from massq.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(PATH), P.PATTERN)


def ids(vocabulary, text):
    import numpy as np

    return np.frombuffer(vocabulary.encode([text])[0][0], "<i4").tolist()


def test_hard_texts(vocabulary, reference):
    rng = random.Random(3)
    for text in ["", "a", " \n ", "aaaa" * 3000, "ab" * 777, "".join(rng.choice("abcdeé") for _ in range(5000)), "".join(chr(rng.randrange(32, 0xD000)) for _ in range(3000)), "<|endoftext|> don't", "x" * 64, "y" * 65]:
        assert ids(vocabulary, text) == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(vocabulary, reference, text):
    import numpy as np

    found = ids(vocabulary, text)
    assert found == reference.encode_ordinary(text)
    assert vocabulary.decode(np.array(found, np.int64)).tobytes() == text.encode()


def test_forgetting(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    texts = [f"word{i} other{i} and more{i * 7}" for i in range(100)]
    assert [b for b in vocabulary.encode(texts)[1]] == [len(reference.encode_ordinary(t)) for t in texts]


def test_query(spark, docs, rows, reference, none):
    got = bpe.digests(bpe.encoded(docs.select("doc_id", "text", "n"), bpe.tokenizer(spark))).collect()
    assert len(got) == len(rows)
    for x in got:
        want = reference.encode_ordinary(x.text or "")
        assert x._ids == want and x.n_tokens == len(want)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((x.text or "").encode()).hexdigest()
    assert bpe.encoded(none, bpe.tokenizer(spark)).count() == 0


def test_bad_vocabulary(tmp_path):
    path = tmp_path / "v"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([("a b", 1, 2, "x")], "text string, _both int, _both_both int, _ids string")
    got = bpe.encoded(rows, bpe.tokenizer(spark)).first()
    assert (got["_both"], got["_both_both"]) == (1, 2) and bytes(got["_decoded"]) == b"a b"
