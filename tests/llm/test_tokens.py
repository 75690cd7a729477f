import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callsight.llm.queries import tokenizer
from callsight.llm.tokens import Encoder

from .cases import TEXTS

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TRICKY = [
    "  two  spaces\n\n\nthree lines \t tab",
    "it's we're I'LL don't 's 'S ''s",
    "1234 56,78 a1b2 ²³½ Ⅷ",
    "naïve ÉCOLE ẞ ΣΣ İstanbul K",
    "á ́x 가",
    "<|endoftext|>a<|startoftext|> <|endoftext|>",
    "　wide em\x85next\x1cfs\x1f",
    "中文字 ไทย \U0001f469‍\U0001f469",
    "a_b __c__ [x]{y}   z ×÷",
    "trailing ",
]


def direct(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("file", FILES)
def test_same_ids_as_the_library(file):
    encoder = Encoder.of(tokenizer(file))
    for text in TRICKY + [t for _, t in TEXTS if t]:
        assert encoder.ids(text) == direct(encoder, text), text[:80]
    assert encoder.ids(None) == encoder.ids("") == b""


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\t'sdlre.,\xa0aB1é"))), max_size=60))
def test_any_text(file, text):
    encoder = Encoder.of(tokenizer(file))
    assert encoder.ids(text) == direct(encoder, text)


@pytest.mark.parametrize("file,change", [("byte_bpe_50k.json", {"add_prefix_space": True}), ("byte_bpe_50k.json", {"use_regex": False}), ("word_bpe_49k.json", {"use_regex": True})])
def test_other_rules_are_left_to_the_library(tmp_path, file, change):
    with open(tokenizer(file), encoding="utf-8") as f:
        spec = json.load(f)
    assert Encoder.of(tokenizer(file)).rule is not None
    rules = spec["pre_tokenizer"]
    (rules if rules["type"] == "ByteLevel" else rules["pretokenizers"][-1]).update(change)
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(spec))
    encoder = Encoder(str(path))
    assert encoder.rule is None
    for text in TRICKY:
        assert encoder.ids(text) == direct(encoder, text)
