"""Ids put together from items equal the library's ids of whole texts."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import _items

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ALPHABET = ["a", "B", "the", " ", "  ", "\n", "\t", ",", ".", "!", "?;", "'s", "'", "1", "23", "é", "é", "J̌", "Σ", "ß", "İ", " ", " ", "中", "ा", "😀", "<|endoftext|>", "<|", "_", "-", "***", "&", "$5", "#", "a\nb", "it's\n's", ".\n.", "\x1f", "\u0085"]
READY = {}


def both(name):
    if name not in READY:
        library = Tokenizer.from_file(_items.default_path(name))
        library.no_truncation()
        library.no_padding()
        READY[name] = _items.library_items(_items.default_path(name), FILES[name]), library
    return READY[name]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), min_size=1, max_size=8))
def test_any_texts(name, texts):
    items, library = both(name)
    ids, ends = items.ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_tables_begin_anew(name, monkeypatch):
    monkeypatch.setattr(_items, "CACHE_BYTES", 100)
    monkeypatch.setattr(_items, "TOGETHER", 2)
    items, library = _items.library_items(_items.default_path(name), FILES[name]), both(name)[1]
    for text in ("one two, three. four five two,", "six two, one", "", "seven: one\n two"):
        ids, ends = items.ids(pa.array([text, text]))
        assert ids[ends[1] :].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_texts_without_spaces_are_not_kept(name):
    items, library = _items.library_items(_items.default_path(name), FILES[name]), both(name)[1]
    for n in range(40):
        texts = [chr(0x4E00 + (n * 50 + k) % 5000) * 300 + f"{n}.{k}" for k in range(50)]
        ids, ends = items.ids(pa.array(texts))
    assert ids[ends[-2] :].tolist() == library.encode(texts[-1], add_special_tokens=False).ids
    assert items.bytes_held() < 100_000
