"""Byte-level BPE on a worker: the library's encoder for one vocabulary file, and pre-tokens as it would split them.

Pre-tokens are found by the public split pattern with another engine than the library's. The two know different versions of Unicode: where a text
holds a character that one takes for a letter or number and the other does not, its pre-tokens are not told here, and the library takes the text whole.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
BATCH_CHARS = 1 << 20
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def batches(texts: Iterable[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Lists of texts of about so many characters; a longer text is a list of its own."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


@lru_cache(maxsize=1)
def _splitter() -> tuple[regex.Pattern, re.Pattern, re.Pattern]:
    """The split pattern, and the characters (of the basic plane; all) whose class the two engines see differently."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    one = {bytes([b]): b for b in range(256)}
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=one, special_tokens={}).encode_ordinary(every)
        odd |= set(bytes(theirs).decode()).symmetric_difference(regex.findall(kind, every))
    low = [c for c in odd if c < "\U00010000"]
    known = lambda chars: re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]") if chars else re.compile(r"(?!)")
    return regex.compile(public_tokenizers.PATTERN), known(low), known(odd)


def odd(text: str) -> bool:
    """Whether the two engines may split a text differently."""
    if text.isascii():
        return False
    _, low, every = _splitter()
    return bool(low.search(text) or (_ASTRAL.search(text) and every.search(text)))


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, which they tile; the library's own unless the text is odd()."""
    return _splitter()[0].findall(text)


class ByteBPE:
    """Encoder for one rank file; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int] | None = None):
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values(), default=-1) + 1
        self.token = [b""] * size
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.names = [str(k) for k in range(size)]
        self.opens = np.array([t[:1] == b" " for t in self.token], dtype=bool)
        self.special = special or {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def plain(self, text: str) -> bytes:
        """Ids of one text, special strings being ordinary text."""
        return np.asarray(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def parts(self, text: str) -> list[str]:
        """A text cut at special strings, which stand at the odd places."""
        return self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]

    def encode(self, text: str) -> bytes:
        """Ids of one text; special strings become their ids, as the tokenizers library does by default."""
        parts = self.parts(text)
        if len(parts) == 1:
            return self.plain(text)
        return b"".join(np.asarray([self.special[x]], dtype="<u4").tobytes() if k % 2 else self.plain(x) for k, x in enumerate(parts))

    def lengths(self, pieces: Iterable[str]) -> dict[str, int]:
        """Token counts of pre-tokens. Those that start with their only space are encoded in one call: each one's first token is the only one with a leading space."""
        spaced = [w for w in pieces if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        out = {}
        if spaced:
            ids = np.asarray(self.encoding.encode_ordinary("".join(spaced)), dtype=np.int64)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(spaced):
                raise AssertionError("a pre-token's first token must be the only one that starts with a space")
            out = dict(zip(spaced, np.diff(starts, append=len(ids)).tolist(), strict=True))
        return out | {w: len(self.encoding.encode_ordinary(w)) for w in pieces if w not in out}

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of ids, joined."""
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=4)
def from_ranks(path: str) -> ByteBPE:
    """Encoder for a rank file, once per worker."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def from_json(path: str) -> ByteBPE:
    """Encoder for a byte-level BPE file of the tokenizers library whose ids are its merge ranks.

    Raises ValueError for a file that works otherwise; ``library`` takes those.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, byte = spec["model"], spec.get("pre_tokenizer") or {}, _byte_of()
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens with rules of their own")
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab[a + b] for a, b in pairs]
    if order != list(range(256, 256 + len(order))) or len(vocab) != 256 + len(order):
        raise ValueError(f"{path}: ids are not merge ranks")
    return ByteBPE({bytes(byte[c] for c in t): i for t, i in vocab.items()}, special)


@lru_cache(maxsize=4)
def library(path: str):
    """texts -> ids (lists) by the file's own library, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [model.encode(t) for t in texts]
    if path.endswith(".tiktoken"):
        bpe = from_ranks(path)
        return lambda texts: [bpe.encoding.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def raw_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the file's library, without begin, end or added special tokens."""
    try:
        encoder = from_json(path) if path.endswith(".json") else from_ranks(path) if path.endswith(".tiktoken") else None
    except ValueError:
        encoder = None
    if encoder:
        return [encoder.encode(t) for t in texts]
    return [np.asarray(x, dtype="<u4").tobytes() for x in library(path)(texts)]


def vocabulary(path: str) -> int:
    """One more than the largest id of a file, special tokens included."""
    if path.endswith(".tiktoken"):
        return len(from_ranks(path).token)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
