"""Splitting text into the pieces that byte-level BPE merges inside of, for whole batches at once.

The split is that of `public_tokenizers.PATTERN`.  Which code points are letters, numbers or white space
depends on the Unicode tables of the library that the ids must equal, so a `Kinds` asks that library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
_UNKNOWN = 255


class Kinds:
    """Kind of each code point; `ask` gives those characters of a string that a class pattern matches."""

    def __init__(self, ask: Callable[[str, str], Iterable[str]]):
        self.ask, self.table = ask, np.full(0x110000, _UNKNOWN, np.uint8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (out == _UNKNOWN).any():
            new = np.unique(codes[out == _UNKNOWN])
            self.table[new] = OTHER
            whole = "".join(map(chr, new.tolist()))
            for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
                self.table[[ord(c) for c in self.ask(pattern, whole)]] = kind
            out = self.table[codes]
        return out


def tiktoken_kinds() -> Kinds:
    """Kinds as tiktoken sees them: what an encoding with the class as its pattern does not skip."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def ask(pattern: str, text: str) -> str:
        found = tiktoken.Encoding("kind", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return found.decode(found.encode_ordinary(text))

    return Kinds(ask)


def tokenizers_kinds() -> Kinds:
    """Kinds as the tokenizers library sees them: what a split that removes matches takes away."""
    from tokenizers import Regex, pre_tokenizers

    def ask(pattern: str, text: str) -> set[str]:
        kept = pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text)
        return set(text).difference(*(piece for piece, _ in kept))

    return Kinds(ask)


def pieces(codes: np.ndarray, first: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Starts of the pieces of documents that start at `first`, none of them empty, in `codes`.

    Letters, numbers and other marks form runs that take one space before them; white space before a run
    leaves its last character to itself; an apostrophe that starts a piece takes the English endings with it.
    """
    n = len(codes)
    kind = kinds(codes)
    head = np.zeros(n + 2, bool)
    head[first] = True
    border = head.copy()
    head[1:n] |= kind[1:] != kind[:-1]
    start = head.copy()
    follows = np.flatnonzero(head[1:n] & ~border[1:n] & (kind[:-1] == SPACE)) + 1   # a run after white space
    start[follows - 1] = True
    start[follows[codes[follows - 1] == 32]] = False
    marks = np.flatnonzero(start[:n] & (codes == 39))
    if len(marks):
        wide = np.append(codes, np.zeros(3, codes.dtype))
        alive = np.append(border, np.ones(3, bool))
        a, b = wide[marks + 1], wide[marks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~alive[marks + 1]
        two = (np.isin(a, [ord("r"), ord("v")]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~alive[marks + 1] & ~alive[marks + 2]
        for at, size in ((marks[one], 1), (marks[two], 2)):
            start[at + 1] = False
            after = at + 1 + size
            after = after[after < n]
            start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start[:n])
