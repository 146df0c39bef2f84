"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled one after another into a deterministic automaton over
token labels. It begins with one loop for each byte. The gadget of merge
(a, b) -> c cuts the arc b from the state that a leads to, and puts an arc c
wherever the arc a was, leading to a copy of the state that b leads to. What it
accepts in the end are exactly the token sequences that the merge rules give.

The state after an arc depends on its label alone, and a gadget only refers to
arcs made before it. So the automaton is kept as the list of its gadgets: a row
for each token with the operands (where its arcs were copied from) and its
number, and a table of cut arcs. `arc` follows copies back until it meets a cut
or two bytes; what it finds is kept in a transition table of bounded size.

Every prefix of a word has one accepted sequence, so encoding needs one pass with
one state for each position. A second table, over bytes, gives the longest label
that ends at a position and from it the shorter ones; the one whose arc leaves
the state of the position where it begins is taken.

Defined cases: a null text counts as empty; an empty text has no ids; the string
of a special token in a text becomes that token; repeated rows are encoded each
for itself; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.textcore import lean, slices
from reelspark.session import ship

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
START = -1
CACHE_ENTRIES, CACHE_CHARS, TABLE_ENTRIES = 300_000, 48, 400_000

#: Fixed value: the white space that the split knows (Unicode's, without the four separators U+001C to U+001F).
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
#: Fixed value: the pattern that splits texts before the merges, with white space spelt out.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEFORE_SPACE = re.compile(f"[{SPACE}] ")
#: A word, marks behind it, and perhaps a line end, a word and marks again: pieces whose split is plain.
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)(?:\n([^\W\d_]+)([!-/:-@\[-`{-~]*))?")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable in Latin-1."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Automaton:
    """The compiled automaton of a list of merges over byte-level tokens."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], special: dict[str, int] | None = None):
        back = {c: b for b, c in byte_letters().items()}
        size = max([*vocab.values(), *(special or {}).values()]) + 1
        self.special = special or {}
        self.labels: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.labels[k] = bytes(back[c] for c in token)
        for token, k in self.special.items():
            self.labels[k] = token.encode()
        self.first: list[int] = [START] * size
        self.second: list[int] = [START] * size
        self.number: list[int] = [-1] * size  # -1: a byte, there from the beginning
        self.cut: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for b, letter in byte_letters().items():
            if letter not in vocab:
                raise ValueError(f"the vocabulary lacks byte {b}")
        made = {vocab[c]: None for c in byte_letters().values()}
        for k, (a, b) in enumerate(merges):
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            if out in made or (left << 32 | right) in self.cut:
                raise ValueError(f"merge {k} makes a token or takes a pair that an earlier merge has")
            if left in made and right in made and self._replay(left, right):  # else no path has the pair, and the token never comes up
                self._gadget(k, left, right, out)
                made[out] = None
        self._suffixes(list(made))
        self.steps = dict(self.go)

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        self.cut[a << 32 | b] = k
        self.first[c], self.second[c], self.number[c] = a, b, k

    def _suffixes(self, made: list[int]) -> None:
        """The table that reads bytes: its states are prefixes of labels, and each knows the longest label that ends there."""
        go, size, own = {}, 1, {}
        for token in made:
            node = 0
            for byte in self.labels[token]:
                node = go.setdefault(node << 8 | byte, size)
                size += node == size
            own[node] = token
        self.go, self.longest, self.shorter = go, [START] * size, [START] * len(self.labels)
        self.fail = fail = [0] * size
        for key in sorted(go, key=self._depths(go, size).__getitem__):  # shorter prefixes first
            above, byte, node = key >> 8, key & 255, go[key]
            if above:
                fail[node] = self._step(fail[above], byte)
            behind = self.longest[fail[node]]
            self.longest[node] = own.get(node, behind)
            if node in own:
                self.shorter[own[node]] = behind

    @staticmethod
    def _depths(go: dict[int, int], size: int) -> dict[int, int]:
        depth, out = [0] * size, {}
        for key, node in go.items():  # a node is made after the one above it
            depth[node] = depth[key >> 8] + 1
            out[key] = depth[node]
        return out

    def _step(self, node: int, byte: int) -> int:
        while (to := self.go.get(node << 8 | byte)) is None and node:
            node = self.fail[node]
        return to or 0

    def arc(self, state: int, label: int) -> bool:
        """Whether the automaton has an arc with this label from the state after token `state`."""
        key = state << 32 | label
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = state == START or self._replay(state, label)
            if len(self.arcs) > TABLE_ENTRIES:
                self.arcs.clear()
        return known

    def _replay(self, state: int, label: int) -> bool:
        number, cut = self.number, self.cut
        before = len(number) * 2  # gadgets with a smaller number have had their effect on the arc
        while True:
            if cut.get(state << 32 | label, before) < before:
                return False
            x, y = number[state], number[label]
            if x < 0 and y < 0:
                return True
            if x == y:  # c after c: as a after b was, before this gadget's cut
                before, state, label = x, self.second[state], self.first[label]
            elif x > y:  # the state was copied from that of b, before this gadget's cut
                before, state = x, self.second[state]
            else:  # the arc was put beside that of a, after this gadget's cut
                before, label = y + 1, self.first[label]

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-split word."""
        at, node, size = [START], 0, 0
        steps, longest, shorter, labels, arcs, arc = self.steps, self.longest, self.shorter, self.labels, self.arcs, self.arc
        for byte in data:
            key = node << 8 | byte
            node = steps.get(key)
            if node is None:
                if len(steps) > TABLE_ENTRIES + len(self.go):
                    steps.clear()
                    steps.update(self.go)
                node = steps[key] = self._step(key >> 8, byte)
            token, size = longest[node], size + 1
            while state := size - len(labels[token]):
                state = at[state]
                known = arcs.get(state << 32 | token)
                if known or known is None and arc(state, token):
                    break
                token = shorter[token]
            at.append(token)
        out = []
        while size:
            out.append(at[size])
            size -= len(labels[at[size]])
        return out[::-1]

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs in order; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Kept(dict):
    """Results by string, for strings of bounded length in one line and up to a bounded number."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= CACHE_CHARS and ("\n" not in key or len(key) == 1):
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


class Encoder:
    """Splits texts as the tokenizer file says and encodes the words with the automaton."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(spec["model"]["vocab"], merges, special)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.path, self._library = path, None
        self.words = _Kept(self._word, CACHE_ENTRIES // 4)
        self.heads = _Kept(self._split, CACHE_ENTRIES // 4)
        self.tails = _Kept(self._tail, CACHE_ENTRIES)

    def _split(self, text: str) -> bytes:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Unicode versions differ in what these are: ask the library that the results have to equal
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            words = [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        else:
            words = SPLIT.findall(text)
        if len(words) == 1:
            return self._word(words[0])
        return b"".join(map(self.words.__getitem__, words))

    def _tail(self, piece: str) -> bytes:
        """The ids of a piece with the space before it."""
        if piece.isalpha():
            return self._word(" " + piece)
        if m := WORD_AND_MARKS.fullmatch(piece):
            word, marks, after, more = m.groups()
            if word.isalpha() and (after is None or after.isalpha()):
                out = self.tails[word] + self.words[marks]
                return out if after is None else out + self.words["\n"] + self.words[after] + (self.words[more] if more else b"")
        return self._split(" " + piece)

    def _word(self, word: str) -> bytes:
        return np.array(self.automaton.word(word.encode()), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        """No match of the split crosses a space behind a character that is no white space."""
        if not text:
            return b""
        if BEFORE_SPACE.search(text):
            return self._split(text)
        head, *tails = text.split(" ")
        return (self.heads[head] if head else b"") + b"".join(map(self.tails.__getitem__, tails))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.uint32(self.automaton.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join(out) + self._plain(text[at:])

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4"))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process; the automaton is compiled once there."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _free(base: str, taken: Iterable[str]) -> str:
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """keep's columns (default: all but the text), `ids` (binary, little-endian unsigned 32-bit) and, on request, `decoded`."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = [_free("ids", keep)] + [_free("decoded", keep)] * decode
    own = _free("text_", keep)
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(own))
    fields = [source.schema[c] for c in keep] + [T.StructField(n, k()) for n, k in zip(names, (T.BinaryType, T.StringType), strict=False)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, own):
                ids = [enc.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
                cols = [*batch.columns[: len(keep)], pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([enc.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return source.mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER, ids: str = "ids") -> DataFrame:
    """The same rows with `decoded` behind their columns; null ids give an empty text."""
    ship(tokens.sparkSession)
    name = _free("decoded", tokens.columns)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [enc.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(name, T.StringType())]))


def digests(ids: Column, decoded: Column) -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256."""
    return [(F.length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256")]
