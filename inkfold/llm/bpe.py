"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is exactly one token that its encoding ends with. All vocabulary tokens that end at a
place come from one automaton pass; among them the wanted one is the token whose predecessor (the last token of the
prefix before it) stays separate from it under the merge rules. Back-pointers from the end of the word give the ids.
The pair test walks down the right edge of one token's merge tree and the left edge of the other's, so it needs no
merging of text. Cost: linear in the text times the longest token.

A worker remembers the ids of stretches between white space, packed as bytes, so that the text of a known stretch is
neither cut into words nor encoded again."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from inkfold.llm.common import keyed_texts, per_worker, table

# Private mark in place of the end-of-word suffix; the byte alphabet stays below U+0200.
WORD_END = "\ue000"
NEVER = 1 << 60
# Entries per worker process of each of the two parts of the memory of stretches, and of the pair memory, which is emptied
# when full; longer stretches are not kept (speed only).
STRETCH_MEMORY = 500_000
LONGEST_KEPT = 64
PAIR_MEMORY = 500_000
# Python takes these for white space, the tokenizer's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Letters and at most one mark behind them are a piece each; all other stretches are cut by the tokenizer's pattern.
PLAIN_WORD = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]?)")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Memory(dict):
    """What ``build`` makes of a key, kept for the keys of late: when ``room`` are held they become the older part, and the
    older part before them is let go."""

    def __init__(self, build: Callable[[str], bytes], room: int = STRETCH_MEMORY):
        self.build, self.room, self.older = build, room, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.build(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordBpe:
    """Encoder and decoder for a tokenizer description with byte-level alphabet and end-of-word suffix."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}

        def inner(token: str) -> str:
            return token[: -len(suffix)] + WORD_END if suffix and token.endswith(suffix) else token

        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = rank
            if both not in self.parts:
                self.parts[both] = (a, b)
                self.rank[both] = rank
        self.automaton = ahocorasick.Automaton()
        for token, number in vocab.items():
            word = inner(token)
            self.automaton.add_word(word, (number, len(word)))
        self.automaton.make_automaton()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.stretches = Memory(self._stretch)
        self.token_bytes = np.full(max(self.text_of, default=-1) + 1, None, dtype=object)
        for number, token in self.text_of.items():
            self.token_bytes[number] = token.encode("utf-8")
        self.pairs: dict[int, bool] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, side by side, encode to just these two tokens."""
        a, b, after_a, after_b = left, right, NEVER, NEVER
        while True:
            meet = self.merged.get((a, b), NEVER)
            if meet < after_a and meet <= after_b:
                return False
            if self.rank[a] > self.rank[b]:
                after_a, a = self.rank[a], self.parts[a][1]
            elif b in self.parts:
                after_b, b = self.rank[b], self.parts[b][0]
            else:
                return True

    def encode_word(self, piece: str) -> list[int]:
        """Token ids of one piece: last token of every prefix, then back from the end."""
        if piece.isascii() and piece.isalnum():
            word = piece + WORD_END
        else:
            word = piece.encode("utf-8").decode("latin-1").translate(self.alphabet) + WORD_END
        tokens, starts = [-1] * len(word), [0] * len(word)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(word):
            if tokens[end] >= 0:
                continue
            start = end - length
            if start >= 0:
                before = tokens[start]
                if before < 0:
                    continue
                pair = before << 20 | token
                apart = pairs.get(pair)
                if apart is None:
                    if len(pairs) >= PAIR_MEMORY:
                        pairs.clear()
                    apart = pairs[pair] = self.stay_apart(before, token)
                if not apart:
                    continue
            tokens[end], starts[end] = token, start
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(tokens[at])
            at = starts[at]
        ids.reverse()
        return ids

    def _stretch(self, stretch: str) -> bytes:
        """Packed ids of a text without white space."""
        plain = PLAIN_WORD.fullmatch(stretch)
        pieces = [p for p in plain.groups() if p] if plain else self.pieces.findall(stretch)
        if len(pieces) == 1 and pieces[0] == stretch:
            ids = self.encode_word(stretch)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.stretches.__getitem__, pieces))

    def _plain(self, text: str) -> bytes:
        # Capital sigma is lowered without regard to its place in the word, as the tokenizer does.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # No piece holds white space or looks beyond its own text.
        parts = self.pieces.findall(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.stretches.__getitem__, parts))

    def packed(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.special_split is None or not any(s in text for s in self.specials):
            return self._plain(text)
        parts = self.special_split.split(text)
        return b"".join(np.uint32(self.specials[p]).astype("<u4").tobytes() if p in self.specials else self._plain(p) for p in parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode_utf8(self, ids: np.ndarray) -> bytes:
        """Token texts with a blank between them, in UTF-8: the description names no decoder."""
        return b" ".join(self.token_bytes[ids].tolist())

    def decode(self, ids: list[int]) -> str:
        return self.decode_utf8(np.asarray(ids, dtype=np.int64)).decode("utf-8")


def encode_texts(df: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): ``n_tokens``, digests of the ids and of the decoded text, ``ids``.

    Null and empty texts give no tokens (the digests of nothing). Texts of any length are encoded whole; repeated rows
    are encoded each. Other columns are ignored. The tokenizer file is read on the driver and broadcast: its size does
    not depend on the data."""
    spark = df.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast({"file": f.read()})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = per_worker(held, "bpe", lambda: WordBpe(held.value["file"]))
        for batch in batches:
            out = []
            for text in batch["text"]:
                packed = bpe.packed(text)
                ids = np.frombuffer(packed, dtype="<i4")
                decoded = bpe.decode_utf8(ids)
                out.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids))
            got = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
            got.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield got

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return keyed_texts(df).mapInPandas(encode, schema)


def decode_ids(df: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id``, ``ids`` -> ``doc_id``, ``decoded``. A null list decodes to the empty text."""
    spark = df.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast({"file": f.read()})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = per_worker(held, "bpe", lambda: WordBpe(held.value["file"]))
        for batch in batches:
            texts = [bpe.decode(ids) if ids is not None else "" for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "decoded": texts})

    return df.select("doc_id", "ids").mapInPandas(decode, "doc_id bigint, decoded string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), default_tokenizer())
