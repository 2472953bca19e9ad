"""Exact byte-level BPE ids of a public vocabulary, by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; the same path on every executor.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the public pre-splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTES = 256
#: Words kept with their ids in each Python worker.
CACHE = 200_000


class Encoder:
    """Encodes text to the ids BPE merging would give, without merging.

    Every prefix of a word has exactly one last token: the one that ends there (all such tokens come
    from an automaton over the vocabulary) and that stands next to the last token of the prefix before
    it without any merge taking place over their border. These are stored for each prefix in turn;
    following them back from the end gives the ids. Work per word is linear in its length, times the tokens that end at a place.
    """

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        import ahocorasick
        import regex

        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.left, self.right, self.pairs = {}, {}, {}
        for x, y in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b, ab = vocab[x], vocab[y], vocab[x + y]
            self.left[ab], self.right[ab], self.pairs[a, b] = a, b, ab
        self.tokens = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.tokens.add_word(text.decode("latin-1"), (i, len(text)))
        self.tokens.make_automaton()
        self.words = regex.compile(PATTERN).findall
        self.borders: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def borders_hold(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart. Ids are in the order of merging, so taking the later-made side apart step by step gives every pair that ever met at the border; a pair merges if its turn comes before either side is used up."""
        key, until = (a, b), 1 << 30
        if (known := self.borders.get(key)) is not None:
            return known
        holds = None
        while holds is None:
            if self.pairs.get((a, b), until) < until:
                holds = False
            elif a > b:
                holds = True if a < BYTES else None
                until, a = a, self.right.get(a)
            else:  # of equal merges the left one comes first
                holds = True if b < BYTES else None
                until, b = b + 1, self.left.get(b)
        if len(self.borders) < 4_000_000:
            self.borders[key] = holds
        return holds

    def by_prefixes(self, raw: bytes) -> list[int]:
        """Ids of the bytes of a word: the last token of each prefix, followed back from the end."""
        last, length = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end, (token, n) in self.tokens.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0 and (n == end or (last[end - n] >= 0 and self.borders_hold(last[end - n], token))):
                last[end], length[end] = token, n
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def word(self, text: str) -> list[int]:
        if (ids := self.known.get(text)) is not None:
            return ids
        raw = text.encode("utf-8")
        # merging reaches every entry of the vocabulary (tested for all of them), so an entry is its own id
        ids = [whole] if (whole := self.ids.get(raw)) is not None else self.by_prefixes(raw)
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(text) < 64:
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens: their strings are ordinary text. Null and empty text have no ids."""
        if not text:
            return []
        out: list[int] = []
        word = self.word
        for w in self.words(text):
            out += word(w)
        return out

    def count(self, text: str | None) -> int:
        return sum(len(self.word(w)) for w in self.words(text)) if text else 0


@lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(folder, name)


def _mapped(column: str, of: Callable[[Encoder, str | None], object], kind: pa.DataType, out: str, folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            keep = [i for i, n in enumerate(b.schema.names) if n != column]
            made = pa.array([of(enc, t) for t in b.column(b.schema.names.index(column)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), made], [*(b.schema.names[i] for i in keep), out])

    return run


def encode_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>): every document once, repeated ids as often as they come; null and empty text have the empty list."""
    df = docs.select(id, F.col(text).alias("_text"))
    kind = dict(df.dtypes)[id]
    return df.mapInArrow(_mapped("_text", Encoder.encode, pa.list_(pa.int32()), "ids", folder, name), f"{id} {kind}, ids array<int>")


def count_tokens(docs: DataFrame, columns: list[str], text: str = "text", out: str = "tokens", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """`columns` and the number of tokens of each document (0 for null and empty text)."""
    df = docs.select(*columns, F.col(text).alias("_text"))
    kinds = dict(df.dtypes)
    return df.mapInArrow(_mapped("_text", Encoder.count, pa.int64(), out, folder, name), ", ".join(f"{c} {kinds[c]}" for c in columns) + f", {out} bigint")
