"""Pre-tokens of a word-level BPE tokenizer file, and the ids of each distinct pre-token.

The files are those of the `tokenizers` library whose pre-tokens are encoded one by one (a word-end suffix
marks the last piece), so ids of a text are the ids of its pre-tokens in order.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Characters on which Python's lower() and `regex` classes are known to agree with the library; other texts
#: are normalised and split by the library itself.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ɏ]*+")
#: Pre-tokens, and white-space chunks, that a memo holds: some 40 MB each.
MEMO = 200_000
#: Stands for the word end in the rank encoder; pre-tokens that hold it go to the library.
END = "\x01"


def _unit_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merged(parts: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    while len(parts) > 1:
        least, at = min((order.get(pair, len(order)), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if least == len(order):
            break
        parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
    return parts


def _rank_encoder(model: dict, suffix: str):
    """An encoder that joins the two pieces whose union has the least id, several times as fast as the library; None
    where it could differ.

    It gives the library's ids if ids of merged pieces ascend in merge order and every piece is reached by merging its
    own units: if neighbours' union is a piece, they are then the very pair that makes it, as otherwise merging that
    piece's units alone would have stopped at the same two neighbours.
    """
    import tiktoken

    vocabulary, bytes_of = model["vocab"], _unit_bytes()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    units = 2 * len(bytes_of)
    if made != list(range(units, units + len(merges))):
        return None
    order, ranks = {m: i for i, m in enumerate(merges)}, {}
    for piece, rank in vocabulary.items():
        if rank >= units + len(merges):
            continue  # special strings
        word = piece.endswith(suffix)
        chars = list(piece.removesuffix(suffix))
        if not chars or not set(chars) <= bytes_of.keys():
            return None
        ranks[bytes(bytes_of[c] for c in chars) + END.encode() * word] = rank
        if word:
            chars[-1] += suffix
        if _merged(chars, order) != [piece]:
            return None
    if len(ranks) != units + len(merges):
        return None
    return tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})


class PreTokenizer:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(first["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.ranks = _rank_encoder(spec["model"], suffix)
        self.memo: dict[str, int] = {}
        self.chunks: dict[str, bytes] = {}

    def _plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """The text's pre-tokens; a special string is one of its own, as the library takes it by default."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._plain(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            out += [part] if part in self.special else self._plain(part)
        return out

    def _word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in order, and where each one's ids end."""
        text = END.join(words) + END
        if self.ranks is not None and words and text.count(END) == len(words) and self.special.keys().isdisjoint(words):
            ids = np.array(self.ranks.encode_ordinary(text), np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, ends
        each = [self._word(w) for w in words]
        return np.array(list(chain.from_iterable(each)), np.int64), np.cumsum([len(x) for x in each], dtype=np.int64)

    def lengths(self, words: list[str]) -> np.ndarray:
        """Number of ids of each pre-token."""
        return np.diff(self.encode(words)[1], prepend=0)

    def count(self, text: str) -> int:
        """Number of the text's ids; only pre-tokens not yet in the bounded memo are encoded."""
        words, memo = self.split(text), self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set(words)
            order = list(new)
            memo.update(zip(order, self.lengths(order).tolist(), strict=True))
        return sum(map(memo.__getitem__, words))

    def id_bytes(self, text: str, dtype: str) -> bytes:
        """The text's ids as an array of dtype. Pre-tokens never span white space, so plain texts go by white-space
        chunks through a bounded memo, and only chunks not yet in it are encoded."""
        if not PLAIN.fullmatch(text) or self.special_pattern is not None and self.special_pattern.search(text):
            return self.encode(self.split(text))[0].astype(dtype).tobytes()
        chunks, memo = text.lower().split(), self.chunks
        new = set(chunks).difference(memo)
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set(chunks)
            order = list(new)
            words = list(map(self.pattern.findall, order))
            ids, ends = self.encode(list(chain.from_iterable(words)))
            raw, width = ids.astype(dtype).tobytes(), np.dtype(dtype).itemsize
            # ids before each chunk: those up to the end of the last word of the chunks before it
            cuts = (np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])] * width).tolist()
            memo.update((c, raw[a:b]) for c, a, b in zip(order, cuts[:-1], cuts[1:], strict=True))
        return b"".join(map(memo.__getitem__, chunks))

    def forget(self) -> None:
        """Empties the memos: workers outlive tasks, and their memory counts for the tasks of other steps."""
        self.memo.clear()
        self.chunks.clear()


@lru_cache(maxsize=2)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
