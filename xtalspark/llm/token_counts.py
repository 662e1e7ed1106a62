"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers give the token count of a byte-level BPE:

* The split of a text into pieces is a transducer of 12 states over 12
  character classes; a transition says whether a piece starts at the character
  it reads, or at the one before. Texts of a batch are laid end to end and cut
  into chunks of equal length. Each chunk is run from all states at once, which
  gives a map of states to states; the maps compose, and a parallel prefix scan
  over them gives the state in which each chunk really begins. A text of any
  length is thus as parallel as many short ones.
* The tokens of a piece are counted by a transducer over bytes, whose
  transitions are annotated with the tokens that reading the byte adds (or takes
  away, where it merges what was read). Its states are prefixes of pieces, made
  as they are first needed: the last token of a prefix is the one token that
  ends it and is compatible with the last token of what stands before.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SP, WS, AP, L1, LR, LV, LE, LL, LO, NU, OT, END = range(12)
FRESH, LET, NUM, OTH, SP1, WS1, SPN, WSN, APO, APR, APV, APL = range(12)
CHUNK = 64

# White space as the pieces' pattern has it.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: States of the piece transducer that are kept; beyond it they are made anew.
MAX_STATES = 400_000
#: Bytes of a piece beyond which its states are not remembered.
LONG_PIECE = 1000


def character_classes() -> np.ndarray:
    out = np.full(0x110000, OT, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LO
        elif kind == "N":
            out[c] = NU
    out[WHITE] = WS
    out[0x20] = SP
    out[ord("'")] = AP
    for chars, k in (("stmd", L1), ("r", LR), ("v", LV), ("e", LE), ("l", LL)):
        for c in chars:
            out[ord(c)] = k
    return out


def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by [class, state]. Output: 1, a piece starts at
    this character; 2, one starts at the character before; 3, both."""
    to, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = (L1, LR, LV, LE, LL, LO)

    def begin(k: int) -> int:
        return LET if k in letters else {SP: SP1, WS: WS1, AP: APO, NU: NUM, OT: OTH}[k]

    def run(k: int) -> int:  # what the class continues if no piece must start
        return LET if k in letters else NUM if k == NU else OTH

    for s in range(12):
        for k in range(11):
            if s == FRESH or s == LET and k not in letters or s == NUM and k != NU or s == OTH and k not in (AP, OT):
                to[k, s], out[k, s] = begin(k), 1
            elif s in (LET, NUM, OTH):
                to[k, s] = s
            elif s in (SP1, WS1, SPN, WSN):
                if k in (SP, WS):
                    to[k, s] = SPN if k == SP else WSN
                elif s == SP1:
                    to[k, s] = run(k)
                elif s == SPN:
                    to[k, s], out[k, s] = run(k), 2
                else:
                    to[k, s], out[k, s] = begin(k), 1 + 2 * (s == WSN)
            elif s == APO:
                nxt = {L1: FRESH, LR: APR, LV: APV, LL: APL, AP: OTH, OT: OTH}.get(k)
                to[k, s], out[k, s] = (nxt, 0) if nxt is not None else (begin(k), 1)
            elif k == {APR: LE, APV: LE, APL: LL}[s]:
                to[k, s] = FRESH
            else:  # no contraction: the letter before began a piece
                to[k, s], out[k, s] = (LET, 2) if k in letters else (begin(k), 3)
        to[END, s], out[END, s] = FRESH, 1 + 2 * (s in (APR, APV, APL))
    return to, out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of a row of state maps, in log depth."""
    n = len(maps)
    if n == 1:
        return maps
    inner = prefix_scan(compose(maps[0 : n // 2 * 2 : 2], maps[1::2]))
    out = np.empty_like(maps)
    out[0] = maps[0]
    out[1::2] = inner
    out[2::2] = compose(inner[: (n - 1) // 2], maps[2::2])
    return out


class Splitter:
    def __init__(self) -> None:
        self.classes = character_classes()
        self.to, self.out = split_transducer()

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Where pieces start in code points, END classes marking ends of texts."""
        n = len(codes)
        rows = -(-n // CHUNK)
        k = np.full(rows * CHUNK, END, np.uint8)
        k[:n] = codes
        lanes = np.ascontiguousarray(k.reshape(rows, CHUNK).T).astype(np.intp) * 12
        to, emit = self.to.ravel(), self.out.ravel()
        maps = np.tile(np.arange(12, dtype=np.uint8), (rows, 1))
        for lane in lanes:
            maps = to[lane[:, None] + maps]
        state = np.empty(rows, np.uint8)
        state[0] = FRESH
        state[1:] = prefix_scan(maps)[:-1, FRESH]
        flags = np.empty((CHUNK, rows), np.uint8)
        for i, lane in enumerate(lanes):
            at = lane + state
            flags[i] = emit[at]
            state = to[at]
        flat = flags.T.ravel()
        here = (flat & 1).astype(bool)
        here[:-1] |= (flat[1:] & 2).astype(bool)
        return here[:n]


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file, by rule: bytes
    that print stand for themselves, the others follow from 256 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceTransducer:
    """Counts the tokens of a piece; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {}
        for i, (a, b) in enumerate(pairs):
            self.rank.setdefault((as_bytes(a), as_bytes(b)), i)
        tokens = {as_bytes(s) for s in vocab if all(c in letters for c in s)}
        self.tokens = {t: t for t in tokens if len(t) == 1 or self.merge(t) == [t]}
        self.longest = max(map(len, self.tokens))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.last: list[bytes] = [b""]
        self.adds: list[int] = [0]  # annotation of the one transition into the state
        self.count: list[int] = [0]

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a short string, pair by pair of lowest rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > 4 * MAX_STATES:
                self.fits.clear()
            ok = self.fits[a, b] = self.merge(a + b) == [a, b]
        return ok

    def _long(self, piece: bytes) -> int:
        """tokens_of() a piece of any length: the same transitions, but of its
        states only the last are kept, as many as the longest token is long."""
        size = self.longest + 1
        last, count = [b""] * size, [0] * size
        for end in range(1, len(piece) + 1):
            for n in range(min(self.longest, end), 0, -1):
                token, before = self.tokens.get(piece[end - n : end]), (end - n) % size
                if token is not None and (end == n or self.compatible(last[before], token)):
                    last[end % size], count[end % size] = token, (count[before] if end > n else 0) + 1
                    break
            else:
                raise ValueError(f"no token ends {piece[max(0, end - 50) : end]!r}")
        return count[len(piece) % size]

    def tokens_of(self, piece: bytes) -> int:
        if len(piece) > LONG_PIECE:
            return self._long(piece)
        if len(self.last) > MAX_STATES:
            self.clear()
        path, state, total = [0], 0, 0
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            child = self.next.get(key)
            if child is None:
                child = self._state(piece, i, path)
                self.next[key] = child
            state = child
            path.append(state)
            total += self.adds[state]
        return total

    def _state(self, piece: bytes, i: int, path: list[int]) -> int:
        for n in range(min(self.longest, i + 1), 0, -1):
            token = self.tokens.get(piece[i + 1 - n : i + 1])
            if token is None:
                continue
            before = path[i + 1 - n]
            if before == 0 or self.compatible(self.last[before], token):
                self.last.append(token)
                self.count.append(self.count[before] + 1)
                self.adds.append(self.count[-1] - self.count[path[i]])
                return len(self.last) - 1
        raise ValueError(f"no token ends {piece[: i + 1]!r}")


class Counter:
    """Token counts of batches of texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and spec["normalizer"] is None
        plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) and not model.get("ignore_merges")
        if not plain:
            raise ValueError(f"{path}: only byte-level BPE without normaliser and prefix space is compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter, self.pieces = Splitter(), PieceTransducer(model["vocab"], model["merges"])
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, leftmost first; how many there are."""
        parts, n = [text], 0
        if any(s in text for s in self.special):
            import re

            parts = re.split("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)), text)
            n = len(parts) - 1
        return parts, n

    def count(self, texts: list[str]) -> np.ndarray:
        own, parts, of = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            p, own[i] = self.parts(t)
            parts += p
            of += [i] * len(p)
        joined = "\0".join(parts)  # the stand-in is overwritten by the class END
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = np.append(self.splitter.classes[codes], np.uint8(END))
        classes[ends] = END
        at = np.flatnonzero(self.splitter.starts(classes))
        bounds = at.tolist()
        bounds.append(len(classes))
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        known = self.known
        if len(known) > MAX_STATES:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = self.pieces.tokens_of(p.encode("utf-8", "replace"))
        n = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        n[np.isin(at, ends, assume_unique=True)] = 0  # the ends themselves
        sums = np.append(0, np.cumsum(n))
        cuts = np.searchsorted(at, np.append(0, ends + 1))
        np.add.at(own, of, sums[cuts[1:]] - sums[cuts[:-1]])
        return own


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled counter for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Append n_tokens (long) to every row of df.

    vocabulary is the path of a byte-level BPE in the tokenizers library's JSON
    form, the same on each executor. Null counts as empty, which has 0 tokens.
    A column n_tokens in df is replaced. Rows stay as they are, repeated or not.
    """

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(vocabulary)
        for texts in batches:
            values, out, at = texts.fillna("").tolist(), [], 0
            while at < len(values):  # about 4 million characters at once
                end, chars = at, 0
                while end < len(values) and (end == at or chars + len(values[end]) < 4_000_000):
                    chars += len(values[end])
                    end += 1
                out.append(c.count(values[at:end]))
                at = end
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    return df.withColumn("n_tokens", counted(F.coalesce(F.col(text), F.lit(""))))


if sys.maxunicode != 0x10FFFF:
    raise ImportError("wide strings are needed")
