"""White-space chunks of a text, and a bounded memo of what a tokenizer makes of each.

A byte-level tokenizer never merges across the pre-token boundaries of its pattern, and each boundary of a chunk
(one optional blank and a run of other characters, or white space) is one of those. So is that between a word of
letters and a mark, so words and the marks after them are chunks of their own, and a word is one whatever follows it.
The ids of a text are those of its chunks, in order, and a chunk that was met before need not be encoded again. The memo is emptied when it
would pass ``most`` chunks, so its memory is bounded whatever the corpus; results don't depend on it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

# Unicode white space as the tokenizers' patterns know it, the one special token, and the letter that
# stands for a blank in a byte-level vocabulary.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SPECIAL = "<|endoftext|>"
BLANK = "\u0120"
MARKS = ".,;:!?%&$*#|"
CHUNK = re.compile(f" ?[A-Za-z]++(?![^{WHITE}{MARKS}])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Texts are handled so many characters at a time, at least one text.
AT_ONCE = 60_000


def chunks(text: str) -> list[str]:
    """The chunks of a text; each special string stands alone."""
    if SPECIAL not in text:
        return CHUNK.findall(text)
    out: list[str] = []
    for k, part in enumerate(text.split(SPECIAL)):
        out += [SPECIAL] * (k > 0) + CHUNK.findall(part)
    return out


def portions(texts: Iterable[str], size: int = AT_ONCE) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class Memo:
    """What ``encode`` gives for each new chunk; chunks longer than ``longest`` are not kept."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = 1_000_000, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.known: dict = {}

    def of(self, texts: Iterable[str]) -> Iterator[list]:
        """For each text, the values of its chunks."""
        for some in portions(texts):
            split = [chunks(t) for t in some]
            new = list(set().union(*split).difference(self.known))
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = list(set().union(*split))
            self.known.update(zip(new, self.encode(new), strict=True))
            get = self.known.__getitem__
            yield from (list(map(get, x)) for x in split)
            for x in new:
                if len(x) > self.longest:
                    del self.known[x]


def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Chunks to ids, as little-endian unsigned 32-bit bytes, by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model = tok.model
    (newline,) = tok.encode("\n", add_special_tokens=False).ids

    def encode(new: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        plain = []
        for x in new:
            word = x[1:] if x[0] == " " else x
            if word.isascii() and word.isalpha():
                # One pre-token of letters, which stand for themselves, and a blank: the library's model alone will do.
                out[x] = array("I", [t.id for t in model.tokenize(x.replace(" ", BLANK))]).tobytes()
            elif x[-1].isspace() or x == SPECIAL:
                out[x] = array("I", tok.encode(x, add_special_tokens=False).ids).tobytes()
            else:
                plain.append(x)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            # One call for many chunks; the line breaks between them are tokens of their own.
            (e,) = tok.encode_batch_fast(["\n".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cuts = 4 * np.flatnonzero(ids == newline)
            raw = ids.tobytes()
            bounds = map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)])
            out.update(zip(some, map(raw.__getitem__, bounds), strict=True))
        return list(map(out.__getitem__, new))

    return encode


@lru_cache(maxsize=2)
def library_memo(path: str) -> Memo:
    """One memo a Python worker, kept from task to task."""
    return Memo(library_encoder(path), most=1_500_000)
