"""Token ids of Arrow columns of texts, by encoding each distinct item between spaces once.

Both public tokenizers cut texts before they merge, and a space always ends a piece, so an item's
ids don't depend on its neighbours (see ``Items.loose`` for the one exception).  Splitting, finding
distinct items and putting ids together run over whole Arrow columns; Python sees distinct items.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of repeated items and of their ids that a worker keeps; with more it begins anew.
CACHE_BYTES = 32 << 20
#: Longer items (where no spaces are written an item may be a whole text) are encoded each time and never kept.
KEPT_LENGTH = 64
#: Punctuation that is cut off an item's end, and after what: digits, Latin and Cyrillic letters
#: that normalisation and lower-casing leave one letter each.
TAIL = ",.;:!?*&$#%"
LETTERS = r"A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}"
AFTER = f"[{LETTERS}]$"
#: Lines that meet in an item: one line end between two of those letters or printable ASCII.
LINES = f"^(?P<left>[!-~{LETTERS}]+)\n(?P<right>[!-~{LETTERS}]+)$"
#: Items that go to the library in one call.
TOGETHER = 200
#: White space with a space after it: there a byte-level tokenizer's pieces reach over the space.
LOOSE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as binary values (with 64-bit offsets: ids take more bytes than their texts)."""
    offsets = np.concatenate([[0], ends]).astype("i8") * 4
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of binary values and the offsets of each into them."""
    offsets = np.frombuffer(values.buffers()[1], "i8")[values.offset : values.offset + len(values) + 1] // 4
    data = values.buffers()[2]
    return np.frombuffer(data, "<u4")[offsets[0] : offsets[-1]] if data else np.zeros(0, "<u4"), offsets - offsets[0]


class Items:
    """ids(): the ids of each text of a column, as one array and the texts' offsets into it.

    ``encode`` gives the ids of distinct strings, put together, and how many each has; short ones stay
    in tables until those hold too many bytes.  Punctuation after a letter or digit is a piece of its own in
    both tokenizers, so an item is put together from what stands before it and it.  With ``spaced``, an
    item carries the space before it (byte-level vocabularies); texts where white space precedes a
    space go through whole.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaced: bool):
        self.encode, self.spaced = encode, spaced
        self.forget()

    def forget(self) -> None:
        """Empty tables: by the mark that items carry before them, the items and their ids."""
        self.held = {mark: pa.array([], pa.string()) for mark in ("", " ")}
        self.codes = {mark: pa.array([], pa.large_binary()) for mark in ("", " ")}

    def bytes_held(self) -> int:
        return sum(x.nbytes for table in (self.held, self.codes) for x in table.values())

    def fresh(self, items: list[str]) -> pa.Array:
        ids, sizes = self.encode(items)
        return binary(ids, np.cumsum(sizes))

    def spelled(self, some: pa.Array, mark: str) -> pa.Array:
        """Ids of items that may repeat, each with ``mark`` before it."""
        coded = some.dictionary_encode()
        return self.known(coded.dictionary, mark, coded.indices).take(coded.indices)

    def known(self, items: pa.Array, mark: str, uses: pa.Array) -> pa.Array:
        """Ids of distinct items, each with ``mark`` before it; those that ``uses`` names once only are not kept."""
        at = pc.index_in(items, value_set=self.held[mark])
        if not at.null_count:
            return self.codes[mark].take(at)
        lacks = at.is_null()
        found, new = self.codes[mark].take(at.drop_null()), items.filter(lacks)
        codes = self.composed(new, mark)
        lacks = lacks.to_numpy(zero_copy_only=False)
        often = np.bincount(uses.to_numpy(), minlength=len(items))[lacks] > 1
        kept = pc.and_(pc.less_equal(pc.binary_length(new), KEPT_LENGTH), pa.array(often))
        self.held[mark] = pa.concat_arrays([self.held[mark], new.filter(kept)])
        self.codes[mark] = pa.concat_arrays([self.codes[mark], codes.filter(kept)])
        place = np.where(lacks, len(found) + np.cumsum(lacks) - 1, np.cumsum(~lacks) - 1)
        return pa.concat_arrays([found, codes]).take(pa.array(place))

    def composed(self, items: pa.Array, mark: str) -> pa.Array:
        """Codes of new items, put together from parts that are pieces of their own in both tokenizers."""
        lines = pc.match_substring_regex(items, LINES).to_numpy(zero_copy_only=False)
        stem = pc.ascii_rtrim(items, TAIL)
        cut = pc.and_(pc.not_equal(pc.binary_length(stem), pc.binary_length(items)), pc.match_substring_regex(stem, AFTER)).to_numpy(zero_copy_only=False) & ~lines
        whole = [mark + x for x in items.filter(pa.array(~(cut | lines))).to_pylist()]
        parts = [self.fresh(whole)] if whole else []
        spelled = self.spelled
        joined = lambda *codes: pc.binary_join_element_wise(*codes, pa.scalar(b"", pa.large_binary()))
        if cut.any():
            tails = pc.struct_field(pc.extract_regex(items.filter(pa.array(cut)), f"(?P<tail>[{TAIL}]+)$"), "tail")
            parts.append(joined(spelled(stem.filter(pa.array(cut)), mark), spelled(tails, "")))
        if lines.any():
            met = pc.extract_regex(items.filter(pa.array(lines)), LINES)
            left, right = spelled(pc.struct_field(met, "left"), mark), spelled(pc.struct_field(met, "right"), "")
            parts.append(joined(left, self.fresh(["\n"])[0], right))
        place = np.empty(len(items), "i8")
        place[np.concatenate([np.flatnonzero(~(cut | lines)), np.flatnonzero(cut), np.flatnonzero(lines)])] = np.arange(len(items))
        return pa.concat_arrays(parts).take(pa.array(place))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.bytes_held() > CACHE_BYTES:
            self.forget()
        mark, loose = " " if self.spaced else "", np.zeros(len(texts), bool)
        if self.spaced:
            loose = pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(loose), "", texts) if loose.any() else texts, " ")
        starts = split.offsets.to_numpy().astype("i8")
        starts, flat = starts - starts[0], split.flatten()
        coded = flat.dictionary_encode()
        codes, at = [self.known(coded.dictionary, mark, coded.indices)], coded.indices.to_numpy().astype("i8")
        if self.spaced:  # the first item of a text has no space before it
            first = flat.take(pa.array(starts[:-1])).dictionary_encode()
            at[starts[:-1]] = len(codes[0]) + first.indices.to_numpy()
            codes.append(self.known(first.dictionary, "", first.indices))
        if loose.any():
            at[starts[:-1][loose]] = sum(map(len, codes)) + np.arange(np.count_nonzero(loose))
            codes.append(self.fresh(texts.filter(pa.array(loose)).to_pylist()))
        found, ends = numbers(pa.concat_arrays(codes).take(pa.array(at)))
        return found, ends[starts]


def library_items(path: str, spaced: bool) -> Items:
    """Distinct items by the tokenizers library, single-threaded: Spark deals out the work.

    Some hundred items go through one call.  Those that begin with a space and end without white space
    stand one after the other, and a token that opens with a space opens an item; between others
    stands an added token, at which the library cuts a text before anything else.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    added = library.get_added_tokens_decoder()
    between, token = next((i, t) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized))
    vocabulary = library.get_vocab()
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level vocabularies spell a space

    def ids_of(text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, sizes = [], []
        for i in range(0, len(items), TOGETHER):
            some = items[i : i + TOGETHER]
            text = "".join(some)
            plain = not any(t.content in text for t in added.values())
            if plain and spaced and text.count(" ") == len(some) and all(x[0] == " " and not x[-1].isspace() for x in some):
                ids = ids_of(text)
                starts = np.flatnonzero(opens[ids])
                found.append(ids)
                sizes.append(np.diff(np.append(starts, len(ids))))
            elif plain:
                ids = ids_of(token.content.join(some))
                cuts = np.flatnonzero(ids == between)
                found.append(np.delete(ids, cuts))
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:
                each = [ids_of(x) for x in some]
                found += each
                sizes.append(np.array(list(map(len, each)), "i8"))
        return np.concatenate(found), np.concatenate(sizes)

    return Items(encode, spaced)


_LOADED: dict[tuple, Items] = {}


def once(make: Callable[..., Items], *args) -> Items:
    """One for each Python worker."""
    if (make, args) not in _LOADED:
        _LOADED[make, args] = make(*args)
    return _LOADED[make, args]


def slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[slice]:
    """Row ranges of about ``most`` bytes, so that a batch of long texts is worked on in steps."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
    begin = 0
    while begin < len(texts):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield slice(begin, end)
        begin = end


def default_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
