"""BPE encoding and decoding of whole texts by prefix-sharing trie traversal.

For byte-pair merging by rank, the encoding of every prefix of a word ends in exactly one token, and the encoding of a
word is its last token after the encoding of what precedes it. So the distinct words of a slice go into a trie, and a
depth-first walk carries the last token of every prefix: at each node it is the one token that ends there and that may
follow the last token standing where it begins. Shared prefixes are computed once; a word is read off backwards.

Two tokens may follow each other if merging their symbols yields just these two, which is decided once per pair.
The normaliser and pre-tokeniser of the file run on distinct chunks between blanks; chunks and words keep their ids in
bounded memos, so a text costs one lookup per chunk.

Defined cases: null and empty texts have no tokens and decode to an empty text; special tokens of the file are matched
literally in the raw text, as the library does; rows, null ids and repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Collection, Iterator
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import slices, small_batches, text_bytes

MEMO_CHUNKS = 160_000
MEMO_PAIRS = 500_000
SLICE_BYTES = 2 << 20


class TrieEncoder:
    """Encoder for a tokenizers file with a BPE model and an end-of-word suffix."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)]
        if model["type"] != "BPE" or unsupported or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("only a plain BPE model is supported")
        library = Tokenizer.from_str(source)
        self.normalise, self.pre_tokenise = library.normalizer, library.pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: v for k, v in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.names = {v: k for k, v in [*vocab.items(), *special.items()]}
        suffix = model.get("end_of_word_suffix")
        if not suffix:
            raise ValueError("only models with an end-of-word suffix are supported")
        self.inner = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c[0]: i for c, i in vocab.items() if len(c) == 1 + len(suffix) and c.endswith(suffix)}
        symbols = {i: (i,) for i in [*self.inner.values(), *self.last.values()]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            new = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = (rank, new)
            symbols[new] = symbols[vocab[a]] + symbols[vocab[b]]
        self.symbols = symbols
        # tokens by their symbols read backwards: [children, token that ends here]
        self.backwards: list = [{}, None]
        for token, seq in symbols.items():
            node = self.backwards
            for s in reversed(seq):
                node = node[0].setdefault(s, [{}, None])
            node[1] = token
        self.follows: dict[int, dict[int, bool]] = {}          # by the token before, then the token
        self.pairs = 0
        # packed ids and decoded text of chunks between blanks, and of pre-tokenised words that aren't plain (a plain word is
        # a chunk of its own); what was used since the memo last filled up is young, the rest is old and goes when it
        # fills up again
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self._age()

    def _age(self) -> None:
        self.old_words, self.old_chunks = self.words, self.chunks
        self.words, self.chunks = {}, {}

    def _merge(self, ids: list[int]) -> list[int]:
        """Merging by rank, leftmost first; only used on the symbols of two tokens."""
        while len(ids) > 1:
            rank, at = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges),
                           default=(0, -1))
            if at < 0:
                break
            ids[at:at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a (-1: at the start of a word)."""
        self.pairs += 1
        if self.pairs > MEMO_PAIRS:
            self.follows.clear()
            self.pairs = 0
        want = [b] if a < 0 else [a, b]
        return self._merge([s for t in want for s in self.symbols[t]]) == want

    def encode_words(self, words: Collection[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokenised words (in the byte alphabet of the file)."""
        trie: dict = {}                         # inner symbols lead to dicts, last symbols to the word itself
        inner, last, follows, names = self.inner, self.last, self.follows, self.backwards
        for w in words:
            node = trie
            for c in w[:-1]:
                s = inner[c]
                node = node[s] if s in node else node.setdefault(s, {})
            node[last[w[-1]]] = w
        out: dict[str, list[int]] = {}
        longest = max(map(len, words), default=0)
        path = [0] * longest                    # symbols from the root
        tokens = [0] * longest                  # last token of each prefix, and its length
        lengths = [0] * longest
        stack = [(0, s, child) for s, child in trie.items()]
        while stack:
            depth, symbol, node = stack.pop()
            path[depth] = symbol
            at, back = names, depth
            while True:
                at = at[0].get(path[back])
                if at is None:
                    raise ValueError("the vocabulary does not encode this word")
                token = at[1]
                if token is not None:
                    before = tokens[back - 1] if back else -1
                    known = follows.get(before)
                    if known is None:
                        known = follows[before] = {}
                    ok = known.get(token)
                    if ok is None:
                        ok = known[token] = self._may_follow(before, token)
                    if ok:
                        break
                if not back:
                    raise ValueError("the vocabulary does not encode this word")
                back -= 1
            tokens[depth], lengths[depth] = token, depth - back + 1
            if type(node) is dict:
                depth += 1
                for s in node:
                    stack.append((depth, s, node[s]))
                continue
            ids = []
            while depth >= 0:
                ids.append(tokens[depth])
                depth -= lengths[depth]
            ids.reverse()
            out[node] = ids
        return out

    def _pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokenised words of a chunk; special tokens as their ids."""
        if chunk.isascii():                     # letters, or letters and one mark, are what the file's pattern yields
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        out: list[str | int] = []
        for part in self.split_special.split(chunk) if self.special and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = self.normalise.normalize_str(part) if self.normalise else part
                out.extend(w for w, _ in self.pre_tokenise.pre_tokenize_str(plain))
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Adds chunks to the memos; their new words go through one trie."""
        for c in chunks & self.old_chunks.keys():
            self.chunks[c] = self.old_chunks[c]
        pieces = {c: self._pieces(c) for c in chunks - self.chunks.keys()}
        words = {w for p in pieces.values() for w in p if type(w) is str}
        plain = {w for w in words if w.isascii() and w.isalpha() and w.islower()}
        for memo, old, mine in ((self.chunks, self.old_chunks, plain), (self.words, self.old_words, words - plain)):
            new = mine - memo.keys()
            for w in new & old.keys():
                memo[w] = old[w]
            for w, ids in self.encode_words(new - old.keys()).items():
                memo[w] = array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])
        for chunk, parts in pieces.items():
            if chunk in self.chunks:
                continue
            got = [(self.chunks if p in plain else self.words)[p] if type(p) is str else (array("I", [p]).tobytes(), self.names[p])
                   for p in parts]
            self.chunks[chunk] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Per text: ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if len(self.chunks) > MEMO_CHUNKS:
            self._age()
        split = [list(filter(None, (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
                 for t in texts]
        self._learn(set().union(*split) - self.chunks.keys())
        ids, decoded = [], []
        for chunks in split:
            got = [self.chunks[c] for c in chunks]
            ids.append(b"".join([g[0] for g in got]))
            decoded.append(" ".join([g[1] for g in got if g[1]]))
        return ids, decoded

    def decode(self, ids: bytes | None) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _encoder(source: str) -> TrieEncoder:
    """The worker's encoder for this file. Python workers serve many tasks, so it stays with the process (in a module of
    its own, since this code travels by value), with what it has learned about pairs and words."""
    held = sys.modules.setdefault("_newsloom_encoders", ModuleType("_newsloom_encoders")).__dict__
    digest = hashlib.sha256(source.encode()).hexdigest()
    if digest not in held:
        for old in [k for k, v in held.items() if hasattr(v, "encode_words")]:
            del held[old]
        held[digest] = TrieEncoder(source)
    return held[digest]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` per row: ids packed as little-endian unsigned 32-bit integers, and their decoded text.

    ``path`` names the tokenizer file on the driver; its text travels with the tasks.
    """
    small_batches(docs.sparkSession)
    source = Path(path).read_text(encoding="utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(source)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices([len(t or b"") for t in texts], SLICE_BYTES):
                gc.disable()                    # tries and memos are many small objects without cycles
                try:
                    ids, decoded = coder.encode([t.decode() if t else None for t in texts[lo:hi]])
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids binary, decoded string")
