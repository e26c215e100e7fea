import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgrid.llm import bpe
from tests.llm.helpers import TEXTS, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def ids_of(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def samples():
    draw = random.Random(5)
    pools = [(32, 127), (32, 127), (0, 0x250), (0x300, 0x400), (0x2000, 0x2100), (0x3040, 0x30FF), (0x1F600, 0x1F64F)]
    made = ["".join(chr(draw.randrange(*draw.choice(pools))) for _ in range(draw.randrange(1, 50))) for _ in range(400)]
    return made + [t or "" for _, t, _, _ in TEXTS] + ["x" * 3000, "é" * 500, "it's 'S WE'LL ''s", "ΑΣ İ ß ŉ", "<|startoftext|><|endoftext|>"]


def test_equals_the_library(codec):
    library = Tokenizer.from_file(PATH)
    for text in samples():
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(codec, text) == expected, text
        assert codec.decode(np.array(expected, "<u4").tobytes()).decode() == library.decode(expected, skip_special_tokens=False)


def test_pieces_do_not_change_the_ids(codec, monkeypatch):
    text = "The lazy dog, and the fox's den. Déjà vu — " * 40
    whole = ids_of(codec, text)
    monkeypatch.setattr(bpe, "PIECE", 37)
    assert ids_of(codec, text) == whole


def test_cuts_are_where_no_token_spans(codec):
    tokens = [t.decode() for t in codec.tokens if t and not t.startswith(b"<|")]
    inside = {bytes(codec.byte_of[c] for c in t.removesuffix("</w>")) for t in tokens}
    word = "qxzjéß".encode()
    for i in codec.cuts(word):
        assert not any(word[i - 1 : i + 1] in t for t in inside)


def test_spelled_text_comes_back(codec):
    ids = b"".join(codec.encode("Hello, World café"))
    assert codec.text_of(ids) == "hello , world café"


def test_table(spark):
    library = Tokenizer.from_file(PATH)
    found = bpe.encode_documents(documents(spark), PATH).collect()
    assert len(found) == len(TEXTS)
    expected = sorted((str(i), hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t, _, _ in TEXTS)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in found) == expected
    assert all(len(r.ids) == 4 * r.n_tokens for r in found)
    assert bpe.encode_documents(empty(spark), PATH).count() == 0


def test_long_fragments_equal_the_library(codec):
    import time

    library = Tokenizer.from_file(PATH)
    draw = random.Random(8)
    texts = ["".join(draw.choice(pool) for _ in range(n)) for pool, n in (("abcdefghijklmnopqrstuvwxyz", 40_000), ("a", 5_001), ("ab", 3_000), ("the", 2_000), ("aeiou", 777), ("0123456789abcdef/+", 20_000))]
    assert codec.ordered and codec.plain
    for text in texts:
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    took = []
    for size in (1 << 18, 1 << 20):  # four times the letters take about four times as long, on any host
        start = time.process_time()
        found = ids_of(codec, text[:size])
        took.append(time.process_time() - start)
    assert found == library.encode(text, add_special_tokens=False).ids
    assert took[1] < 10 * took[0]
    assert all(len(w) <= bpe.SHORT for w in codec.words)


def test_other_files_are_refused_or_read_by_their_own_rules(tmp_path):
    import json

    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    other = str(tmp_path / "cased.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    cased, library = bpe.Codec(other), Tokenizer.from_file(other)
    assert not cased.plain
    for text in samples()[:60] + ["Mixed CASE Words"]:
        assert ids_of(cased, text) == library.encode(text, add_special_tokens=False).ids
