"""Chunked encoding with the tokenizers library, shared by the token-id operators.

A pre-token of the byte-level patterns never reaches from a character that isn't white space into white
space, and an added token has no white space, so a text can be cut there: each chunk (white space, then the rest up to
the next white space) gets the ids it has in the whole text. Words recur, so a worker remembers the ids of the chunks
it has seen.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White_Space of Unicode, as the tokenizers' ``\\s`` has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Between the chunks of a text; a text that holds it is encoded in one piece.
MARK = "\U0010ffff"
#: What keeps a text from being cut at its spaces and line ends: runs of white space, white space at its ends, other white space.
UNEVEN = "[\\x00\\t\\x0b\\x0c\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{10ffff}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"
#: Chunks that a worker remembers in each of two generations, and the longest that it does.
REMEMBERED = 500_000
LONGEST = 100
#: Bytes of text that are encoded at once, but one document at least.
AT_ONCE = 8 << 20


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others moved to U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [moved.get(b, chr(b)) for b in range(256)]


#: A word that is one pre-token with the space before it, and points, which are another.
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]{1,100})([,.;:!?]{0,8})")
TABLE = dict(enumerate(byte_table()))


class Encoder:
    """Ids of whole texts, through the distinct chunks of an Arrow array of them."""

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = tokenizer, remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.points: dict[str, bytes] = {}

    @staticmethod
    def chunk(key: str) -> str:
        """Keys leave out a chunk's space; one with a zero before it is what follows that, one that begins with a line end itself."""
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def ids_of(self, keys: list[str]) -> list[bytes]:
        """The ids of each key's chunk as unsigned 32-bit integers."""
        if len(self.young) > self.remembered:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, keys))
        young, old, model, match, rest = self.young, self.old, self.tokenizer.model.tokenize, WORD.fullmatch, []
        for n in [n for n, v in enumerate(out) if v is None]:
            k = keys[n]
            v = old.get(k)
            if v is None:
                if not (m := match(k)):
                    rest.append(n)
                    continue
                word, points = m.groups()
                v = young.get(word) if points else None
                if v is None:  # with its space one pre-token: straight to the merges
                    v = array("I", [t.id for t in model("Ġ" + (word if word.isascii() else word.encode().decode("latin-1").translate(TABLE)))]).tobytes()
                if points:
                    if points not in self.points:
                        self.points[points] = array("I", self.tokenizer.encode(points, add_special_tokens=False).ids).tobytes()
                    v += self.points[points]
            out[n] = young[k] = v
        encoded = self.tokenizer.encode_batch_fast([self.chunk(keys[n]) for n in rest], add_special_tokens=False)
        for n, e in zip(rest, encoded):
            out[n] = array("I", e.ids).tobytes()
            if len(keys[n]) <= LONGEST:
                young[keys[n]] = out[n]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (null: none), and how many each text has."""
        big = pa.large_string()
        texts = pc.fill_null(texts.cast(big), "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        keyed = pc.binary_join_element_wise(pa.scalar("\0", big), pc.replace_substring(pc.replace_substring(texts, "\n", " \n"), " ", MARK), pa.scalar("", big))
        whole: dict[int, np.ndarray] = {}
        if pc.any(uneven).as_py():
            rows = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
            made = []
            for r in rows.tolist():
                t = texts[r].as_py()
                if MARK in t:
                    whole[r] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                made.append("" if MARK in t else MARK.join("\0" + c for c in CHUNK.findall(t)))
            keyed = pc.replace_with_mask(keyed, uneven, pa.array(made, big))
        lists = pc.split_pattern(keyed, MARK)
        flat = lists.flatten().dictionary_encode()
        ids = self.ids_of(flat.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = flat.indices.to_numpy()
        table = np.frombuffer(b"".join(ids), np.uint32)
        out = gather(table, np.cumsum(size) - size, size, at)
        ends = np.r_[0, np.cumsum(size[at])]
        counts = np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        if whole:
            pieces = [whole.get(r, p) for r, p in enumerate(np.split(out, np.cumsum(counts)[:-1]))]
            out, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        return out, counts


def gather(table: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches table[start[i] : start[i] + size[i]] for each i of ``at``, one after the other."""
    n = size[at]
    ends = np.cumsum(n)
    return table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - ends + n, n)]


class Strings:
    """Byte strings by number, to be joined by many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array(list(map(len, strings)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        return gather(self.table, self.start, self.size, numbers).tobytes()


def slices(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of rows with about ``at_once`` bytes of text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // at_once
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return ((a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def json_tokenizer(path: str):
    """The tokenizer of a JSON file as the library loads it: its added tokens are units wherever a text has their strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def rank_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A byte-level BPE of the tokenizers library that merges by the ranks of a rank file.

    A merge of each cut of a token into two tokens, in the order of the ranks of what they make; a
    pre-token that is itself a token is taken whole, as the ranks' own encoder does.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    table = byte_table()
    name = {t: "".join(table[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        cuts = [(ranks[token[:k]], ranks[token[k:]], k) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        merges += [(name[token[:k]], name[token[k:]]) for _, _, k in sorted(cuts)]
    tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer
