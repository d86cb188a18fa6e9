"""Character classes as the tokenizer library has them.

Each library carries its own version of Unicode, so the classes of the splitting rule are read off the library: a run
of letters behind a letter is one piece, and so on for numbers and for the rest; what joins none of them is white
space. Ranges are halved until they are of one class. The table is learned once on the driver and sent to the tasks.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import regex

#: Classes; a blank is the one white space that may stand before a word.
LETTER, NUMBER, BLANK, SPACE, OTHER = range(5)
POINTS, CHUNK = 0x110000, 1 << 14
SURROGATES = (0xD800, 0xE000)
#: A character of each class that can be joined, and what the `regex` module has for the class.
SAMPLES = {OTHER: ("!", r"[^\p{White_Space}\p{L}\p{N}]"), LETTER: ("a", r"\p{L}"), NUMBER: ("1", r"\p{N}")}


def text_of(first: int, end: int) -> str:
    return "".join(map(chr, range(first, end)))


@dataclass(frozen=True)
class Classes:
    """Ranges of equal class (first code point, class), and those code points that the `regex` module classes otherwise."""

    first: tuple[int, ...]
    kind: tuple[int, ...]
    odd: tuple[tuple[int, int], ...]

    def table(self) -> np.ndarray:
        """Class of every code point."""
        return np.repeat(np.array(self.kind, dtype=np.uint8), np.diff([*self.first, POINTS]))

    def odd_characters(self) -> frozenset[str]:
        return frozenset(chr(p) for a, b in self.odd for p in range(a, b))

    def odd_byte(self) -> int:
        """UTF-8 texts whose bytes are all below this have no odd character."""
        return min((chr(a).encode()[0] for a, _ in self.odd), default=256)

    def split_pattern(self) -> re.Pattern:
        """The split of byte-level texts into pieces, over these classes; slower than that of the `regex` module."""
        ends = [*self.first[1:], POINTS]

        def chars(*kinds: int) -> str:
            return spelled((a, b) for a, b, k in zip(self.first, ends, self.kind) if k in kinds)

        letters, numbers, white, other = chars(LETTER), chars(NUMBER), chars(BLANK, SPACE), chars(OTHER)
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[{other}]+|[{white}]+(?![^{white}])|[{white}]+")


def spelled(ranges) -> str:
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in ranges)


@functools.lru_cache(maxsize=4)
def classes_of(path: str) -> Classes:
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    out = np.full(POINTS, OTHER, dtype=np.uint8)
    todo = [(a, min(a + CHUNK, b)) for a0, b in ((0, SURROGATES[0]), (SURROGATES[1], POINTS)) for a in range(a0, b, CHUNK)]
    while todo:
        a, b = todo.pop()
        text = text_of(a, b)
        kind = next((k for k, (sample, _) in SAMPLES.items() if len(pre.pre_tokenize_str(sample + text)) == 1), None)
        if kind is None and b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        else:
            out[a:b] = SPACE if kind is None else kind
    out[32] = BLANK
    first = np.flatnonzero(np.diff(out, prepend=255)).tolist()
    kinds = out[first].tolist()
    odd = []
    for a, b, k in zip(first, [*first[1:], POINTS], kinds):
        same = SAMPLES[k][1] if k in SAMPLES else r"\p{White_Space}"
        for p in regex.finditer(rf"(?:(?!{same})[\s\S])+", "".join(chr(c) for c in range(a, b) if not SURROGATES[0] <= c < SURROGATES[1])):
            shift = SURROGATES[1] - SURROGATES[0] if a < SURROGATES[0] < b and a + p.start() >= SURROGATES[0] else 0
            odd.append((a + p.start() + shift, a + p.end() + shift))
    return Classes(tuple(first), tuple(kinds), tuple(odd))
