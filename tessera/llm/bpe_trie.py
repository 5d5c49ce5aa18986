"""Byte-pair encoding of whole corpora over a trie of distinct words.

A word's encoding is fixed by the last token of each of its prefixes: if ``t`` ends the encoding of
a prefix, the tokens before it are the encoding of what precedes ``t``.  Distinct words of an Arrow
batch form a trie, a depth-first walk gives each node its last token once, and words that share a
prefix share its encoding.  Nothing is shuffled; memory holds one batch's trie and a bounded cache.

This needs a vocabulary in which each token comes from one merge (checked when it is loaded).
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections import ChainMap
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import id_and_text, named
from tessera.llm._items import Items, once, slices

#: Words that a worker keeps with their ids, and their greatest length; others are encoded in each batch anew.
KNOWN_WORDS, KNOWN_LENGTH = 300_000, 64


class TrieBpe:
    """Encodes words of byte symbols by last-token states; ``suffix`` marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix = vocab, suffix
        self.packed = {t: struct.pack("<I", i) for t, i in vocab.items()}
        self.rank = {left + right: r for r, (left, right) in enumerate(merges)}
        self.parts = {left + right: (left, right) for left, right in merges}
        self.pair_rank = {pair: r for r, pair in enumerate(merges)}
        if len(self.parts) != len(merges):
            raise ValueError("a token comes from two merges: last-token states don't determine the encoding")
        self.longest = max(len(t.removesuffix(suffix) if suffix else t) for t in vocab)
        self.adjacent: dict[tuple[str, str], bool] = {}

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging left+right ends with a boundary between them.

        The symbols beside the boundary are followed back in time.  Two that were there together
        would have been joined if their merge came before either one's next merge (of equal merges
        the one further left comes first).
        """
        key = (left, right)
        if (known := self.adjacent.get(key)) is not None:
            return known
        rank, never = self.rank, len(self.rank)
        a, b, a_ends, b_ends, fine = left, right, never, never, True
        while True:
            joined = self.pair_rank.get((a, b))
            if joined is not None and joined < a_ends and joined <= b_ends:
                fine = False
                break
            a_born, b_born = rank.get(a, -1), rank.get(b, -1)
            if a_born < 0 and b_born < 0:
                break
            if a_born > b_born:
                a, a_ends = self.parts[a][1], a_born
            else:
                b, b_ends = self.parts[b][0], b_born
        if len(self.adjacent) > 2_000_000:
            self.adjacent.clear()
        self.adjacent[key] = fine
        return fine

    def last_token(self, word: str, n: int, last: list[str], end: str) -> str:
        """The last token of the encoding of word's first n symbols, given those of its shorter prefixes (last[i]: of i symbols)."""
        for size in range(min(n, self.longest), 0, -1):
            token = word[n - size : n] + end
            if token in self.ids and (size == n or self.may_follow(last[n - size], token)):
                return token
        raise ValueError(f"no token ends {word[max(0, n - 40) : n]!r}")

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word.

        Sorted words are the trie in depth-first order: a word's node path is that of the word before it
        up to their common prefix, whose states stay, and new nodes from there on.  A node keeps its last
        token only, which says how far back the one before it ends: the path is followed back once a word.
        """
        out, end, ids = {}, self.suffix, self.packed
        last: list[str] = [""]
        before = ""
        for word in sorted(words):
            inner = word[:-1] if end else word  # the last symbol is another one than inside words
            del last[common(before, inner) + 1 :]
            for depth in range(len(last), len(inner) + 1):
                last.append(self.last_token(inner, depth, last, ""))
            before = inner
            token = self.last_token(word, len(word), last, end) if end else last[-1]
            codes, at = [ids[token]] if token else [], len(word) - len(token) + len(end if token else "")
            while at > 0:
                codes.append(ids[last[at]])
                at -= len(last[at])
            out[word] = b"".join(reversed(codes))
        return out


def common(a: str, b: str) -> int:
    """How many symbols two words share from their beginning on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


class WordTokenizer:
    """A word-level BPE file of the tokenizers library: its normaliser, its pattern, TrieBpe for its model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.library = Tokenizer.from_file(path)
        self.bpe = TrieBpe(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        by_id = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.tokens = pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)])
        self.decimals = pa.array([str(i) for i in range(max(by_id) + 1)])
        self.known: dict[str, str] = {}

    def words(self, piece: str) -> list[str]:
        """Byte-symbol words of a piece of text without special tokens."""
        if piece.isascii() and piece.replace("\n", "").isprintable():
            return self.pattern.findall(piece.lower())
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def encode(self, items: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each item."""
        pieces = [[p for p in self.at_special.split(item) if p] if "<|" in item else [item] for item in items]
        words = [[(p,) if p in self.special else self.words(p) for p in ps] for ps in pieces]
        known = self.known
        new = {w for ws in words for found in ws if isinstance(found, list) for w in found if w not in known}
        codes = self.bpe.encode_words(new)
        if len(known) < KNOWN_WORDS:
            long = {w: codes.pop(w) for w in [w for w in codes if len(w) > KNOWN_LENGTH]}
            known.update(codes)
            codes = ChainMap(long, known) if long else known
        else:
            codes = ChainMap(codes, known)
        pack = lambda found: codes[found[0]] if len(found) == 1 and isinstance(found, list) else pack_all(found)
        pack_all = lambda found: struct.pack("<I", self.special[found[0]]) if isinstance(found, tuple) else b"".join([codes[w] for w in found])
        return [pack(ws[0]) if len(ws) == 1 else b"".join(map(pack, ws)) for ws in words]

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id runs.  The file names no decoder: the library then joins tokens by spaces."""
        return joined(self.tokens, ids, offsets)


def joined(names: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), names.take(pa.array(ids))), " ")


def trie_items(path: str) -> Items:
    coder = WordTokenizer(path)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = coder.encode(texts)
        return np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), "i8", len(codes)) // 4

    items = Items(encode, spaced=False)
    items.coder = coder
    return items


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, finish: Callable, schema: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = once(trie_items, path)
        for batch in batches:
            for rows in slices(batch["text"]):
                ids, offsets = items.ids(batch["text"][rows])
                yield finish(batch["doc_id"][rows], items.coder, ids, offsets)

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, schema)


def encode_corpus(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string for each row.

    Null texts are empty; an empty text has no ids and decodes to an empty string.  Rows that repeat are
    encoded alike, an empty table gives an empty result, other columns are not read.
    """

    def finish(doc_ids: pa.Array, coder: WordTokenizer, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype("i4")))
        return pa.record_batch({"doc_id": doc_ids, "ids": runs, "decoded": coder.decoded(ids, offsets)})

    return _coded(docs, tokenizer_path, id_col, text_col, finish, "doc_id long, ids array<int>, decoded string")


def decode_corpus(coded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids are empty."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(trie_items, tokenizer_path).coder
        for batch in batches:
            runs = batch["ids"]
            base = runs.offsets.to_numpy().astype("i8")
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": coder.decoded(runs.flatten().to_numpy(), base - base[0])})

    rows = coded.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(decode, "doc_id long, text string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_corpus, but only counts and digests leave the Python workers."""

    def finish(doc_ids: pa.Array, coder: WordTokenizer, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        sha = lambda texts: pa.array([hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts], pa.string())
        return pa.record_batch({"doc_id": doc_ids, "n_tokens": pa.array(np.diff(offsets)), "ids_sha256": sha(joined(coder.decimals, ids, offsets)), "decoded_sha256": sha(coder.decoded(ids, offsets))})

    return _coded(docs, tokenizer_path, id_col, text_col, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
