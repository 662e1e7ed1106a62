"""SentencePiece encoding and decoding with a unigram (Viterbi) search.

The pieces of a model file, with their log scores, go into a double-array trie
over UTF-8 bytes. A text is normalised as the model says (white space to its
marker, one marker in front), cut into units at places no piece crosses, and
each unit takes the segmentation of the largest sum of scores; characters in no
piece fall back to byte pieces. Ties take the longest last piece, as in the public library.
The search runs over many distinct units at once, position by position: array
operations follow the trie for all units that are still in it.

Scores are summed in double precision within a unit. The public library sums
single-precision floats over the whole text, and so may choose differently
where two segmentations of a long text come within its rounding.

A model without unigram scores may be given: a BPE model's scores, which are
its negated ranks, are then read as log scores.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Units whose ids a worker remembers; beyond it, it starts anew.
MAX_UNITS = 400_000
#: Bytes of a unit that is searched along with others; longer ones are searched alone.
TOGETHER = 256
#: Units searched, and characters of text cut into units, at once.
BLOCK_UNITS, BLOCK_CHARS = 8192, 1 << 20


class DoubleArray:
    """Double-array trie: state s goes by byte b to base[s] + b, if check there is s."""

    def __init__(self, words: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in words:
            node = 0
            for b in word:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = v
        size = 2 * len(children) + 1024
        base, check, held = [0] * size, [-1] * size, [-1] * size
        place, low = {0: 0}, 1
        check[0] = 0
        held[0] = value[0]
        for node in self._breadth_first(children):
            kids = sorted(children[node])
            if not kids:
                continue
            while check[low] >= 0:
                low += 1
            at, tries = max(low - kids[0], 0), 0
            while any(check[at + b] >= 0 for b in kids):
                at, tries = at + 1, tries + 1
                if at + 512 > len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    held += [-1] * grow
            if tries > 64 and len(kids) == 1:
                low += 1
            base[place[node]] = at
            for b in kids:
                check[at + b] = place[node]
                held[at + b] = value[children[node][b]]
                place[children[node][b]] = at + b
            if at + 512 > len(check):
                base += [0] * 1024
                check += [-1] * 1024
                held += [-1] * 1024
        end = max(place.values()) + 257
        pad = max(0, end - len(base))
        self.base = array("i", (base + [0] * pad)[:end])
        self.check = array("i", (check + [-1] * pad)[:end])
        self.value = array("i", (held + [-1] * pad)[:end])

    @staticmethod
    def _breadth_first(children: list[dict[int, int]]) -> Iterator[int]:
        queue = [0]
        for node in queue:
            yield node
            queue.extend(children[node][b] for b in sorted(children[node]))

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each word that begins at start, shortest first."""
        base, check, value, s = self.base, self.check, self.value, 0
        last = len(base)
        for i in range(start, len(data)):
            t = base[s] + data[i]
            if t >= last or check[t] != s or t == 0:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class Model:
    """A SentencePiece model, read from the file's protocol-buffer bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path}: only models with the identity normaliser are read")
        self.dummy = norm.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.scores = [p.score for p in spec.pieces]
        if USER in self.kinds:
            raise ValueError(f"{path}: user-defined pieces are not read")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        usable = [(p.encode(), i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL]
        self.trie = DoubleArray(usable)
        self.unknown_score = min(self.scores[i] for _, i in usable) - UNKNOWN_PENALTY
        inner = {c for p, k in zip(self.pieces, self.kinds) if k == NORMAL and len(p) > 1 for c in p}
        crossing = any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds) if k == NORMAL)
        # Units end where a marker follows another character, and around line
        # feeds if these are in no piece of several characters.
        alone = "" if "\n" in inner else "\n"
        self.unit = re.compile(".+" if crossing else f"{alone}{'|' * bool(alone)}{MARK}*[^{MARK}{alone}]+|{MARK}+", re.S)
        self.whole = crossing
        self.known: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.same = np.zeros(0, np.int32), np.zeros(0, bool)
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.score_of = np.array(self.scores, np.float64)
        self.byte_ids = np.array([self.byte_id.get(b, self.unknown) for b in range(256)], np.int32)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]

    def best(self, unit: str) -> list[int]:
        """Ids of the best segmentation of one unit (Viterbi)."""
        data = unit.encode("utf-8", "replace")
        n = len(data)
        score, back = [None] * (n + 1), [(0, 0)] * (n + 1)
        score[0] = 0.0
        scores, prefixes = self.scores, self.trie.prefixes
        at = 0
        while at < n:
            lead = data[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, single = score[at], False
            for end, piece in prefixes(data, at):
                s = here + scores[piece]
                if score[end] is None or s > score[end]:
                    score[end], back[end] = s, (at, piece)
                single |= end == at + step
            if not single:
                s = here + self.unknown_score
                if score[at + step] is None or s > score[at + step]:
                    score[at + step], back[at + step] = s, (at, self.unknown)
            at += step
        out: list[int] = []
        while n:
            at, piece = back[n]
            if piece == self.unknown and self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(data[at:n]))
            else:
                out.append(piece)
            n = at
        out.reverse()
        return out

    def best_of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids by unit): best() of many units at once."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        width, rows = int(n.max()), np.arange(len(units))
        data = np.zeros((len(units), width + 1), np.uint8)
        data[np.arange(width + 1) < n[:, None]] = np.frombuffer(b"".join(units), np.uint8)
        score = np.full((len(units), width + 5), -np.inf)
        back_at, back_piece = np.zeros(score.shape, np.int32), np.zeros(score.shape, np.int32)
        score[:, 0] = 0.0
        step_of = np.where(np.arange(256) < 0x80, 1, np.where(np.arange(256) < 0xE0, 2, np.where(np.arange(256) < 0xF0, 3, 4)))

        def offer(who: np.ndarray, at: int, end, s: np.ndarray, piece) -> None:
            better = s > score[who, end]
            who, end = who[better], end[better] if isinstance(end, np.ndarray) else end
            score[who, end], back_at[who, end] = s[better], at
            back_piece[who, end] = piece[better] if isinstance(piece, np.ndarray) else piece

        for at in range(width):
            who = rows[(n > at) & (score[:, at] > -np.inf)]
            here, step = score[who, at], step_of[data[who, at]]
            single = np.zeros(len(who), bool)
            live, state = np.arange(len(who)), np.zeros(len(who), np.int64)
            for end in range(at + 1, width + 1):
                to = self.base[state] + data[who[live], end - 1].astype(np.int64)
                fits = (to < len(self.base)) & (to > 0)
                fits &= (self.check[np.where(fits, to, 0)] == state) & (n[who[live]] >= end)
                live, state = live[fits], to[fits]
                if not len(live):
                    break
                piece = self.value[state]
                ends = piece >= 0
                i, piece = live[ends], piece[ends]
                offer(who[i], at, end, here[i] + self.score_of[piece], piece)
                single[i] |= step[i] == end - at
            alone = ~single
            offer(who[alone], at, at + step[alone], here[alone] + self.unknown_score, self.unknown)
        found, end = [], n.copy()
        live = rows[n > 0]
        while len(live):
            at = back_at[live, end[live]].astype(np.int64)
            found.append((live, at, end[live], back_piece[live, end[live]]))
            end[live] = at
            live = live[at > 0]
        who, at, end, piece = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.lexsort((at, who))
        who, at, end, piece = who[order], at[order], end[order], piece[order]
        size = np.where((piece == self.unknown) & bool(self.byte_id), end - at, 1)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids = np.repeat(piece, size)
        if self.byte_id:
            by_byte = np.flatnonzero(ids == self.unknown)
            ids[by_byte] = self.byte_ids[data[np.repeat(who, size)[by_byte], np.repeat(at, size)[by_byte] + inner[by_byte]]]
        return ids, np.bincount(who, size, len(units)).astype(np.int64)

    def _learn(self, units: list[str]) -> None:
        """Add distinct new units to the table of known ones."""
        coded = sorted((u.encode("utf-8", "replace"), u) for u in units)
        coded.sort(key=lambda x: len(x[0]))
        flat, lengths = [], []
        short = sum(len(d) <= TOGETHER for d, _ in coded)
        for lo in range(0, short, BLOCK_UNITS):
            ids, size = self.best_of([d for d, _ in coded[lo : min(lo + BLOCK_UNITS, short)]])
            flat.append(ids)
            lengths.append(size)
        for _, u in coded[short:]:
            flat.append(np.array(self.best(u), np.int32))
            lengths.append(np.array([len(flat[-1])]))
        new, size = np.concatenate(flat).astype(np.int32), np.concatenate(lengths)
        ends = np.cumsum(size)
        texts, at = self.bytes_of, 0
        same, listed = [], new.tolist()
        for (_, u), end in zip(coded, ends.tolist()):
            same.append(b"".join([texts[i] for i in listed[at:end]]).decode("utf-8", "replace") == u.replace(MARK, " "))
            at = end
        self.known.update((u, len(self.lengths) + i) for i, (_, u) in enumerate(coded))
        self.starts = np.append(self.starts, len(self.flat) + ends - size)
        self.lengths = np.append(self.lengths, size)
        self.flat = np.append(self.flat, new)
        self.same = np.append(self.same, np.array(same, bool))

    def _parts(self, text: str) -> Iterator[str]:
        """text, marked and in front of a marker if the model says so, cut between
        units into parts of about BLOCK_CHARS."""
        marked = text.replace(" ", MARK)
        if self.dummy:
            marked = MARK + marked
        at = 0
        while len(marked) - at > 2 * BLOCK_CHARS and not self.whole:
            cut = marked.find(MARK, at + BLOCK_CHARS)
            while cut > 0 and marked[cut - 1] == MARK:
                cut = marked.find(MARK, cut + 1)
            if cut < 0:
                break
            yield marked[at:cut]
            at = cut
        yield marked[at:]

    def _look_up(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, number of ids by unit, whether a unit decodes to itself)."""
        if len(self.known) > MAX_UNITS:
            self.known.clear()
            self.starts, self.lengths, self.flat, self.same = self.starts[:0], self.lengths[:0], self.flat[:0], self.same[:0]
        new = set(units).difference(self.known)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        size = self.lengths[at]
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.starts[at] - first, size) + np.arange(size.sum())], size, self.same[at]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, number of ids by text, whether a text's ids decode to it).
        Empty texts have no ids."""
        total, same = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.zeros(0, np.int32)]
        held, units = 0, []
        of: list[tuple[int, int]] = []

        def flush() -> None:
            ids, size, good = self._look_up(units)
            out.append(ids)
            which = np.repeat([o[0] for o in of], [o[1] for o in of])
            np.add.at(total, which, size)
            same[which[~good]] = False
            units.clear()
            of.clear()

        for i, t in enumerate(texts):
            for part in self._parts(t) if t else ():
                found = self.unit.findall(part)
                units += found
                of.append((i, len(found)))
                held += len(part)
                if held >= BLOCK_CHARS:
                    flush()
                    held = 0
        if of:
            flush()
        flat, ends = np.concatenate(out), np.cumsum(total)
        for i, t in enumerate(texts):
            if not same[i] or MARK in t:  # the units do not tell: decode the whole
                same[i] = self.decode(flat[ends[i] - total[i] : ends[i]].tolist()) == t
        return flat, total, same

    def encode(self, text: str) -> list[list[int]]:
        """Ids by unit; an empty text has none."""
        units = [u for part in self._parts(text) for u in self.unit.findall(part)] if text else []
        ids, size, _ = self._look_up(units)
        return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if units else []

    def decode(self, ids) -> str:
        """Text of ids: markers to spaces, bytes joined, one space in front dropped."""
        if len(ids) and min(ids) < 0:
            raise ValueError(f"piece ids are 0 or more, not {min(ids)}")
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[self.dummy and data[:1] == b" " :].decode("utf-8", "replace")


_loaded: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def _columns(df: DataFrame, added: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    own = df.drop(*(f.name for f in added))
    return own, T.StructType([*own.schema.fields, *added])


def encode(df: DataFrame, model_path: str, text: str = "text", check: bool = False) -> DataFrame:
    """Append ids (array of int) to every row of df, and with check also
    round_trip: whether decoding them gives the text back.

    Null and empty texts have no ids and decode to the empty text. A text that
    holds the white-space marker itself decodes to a space there, so its
    round_trip is false. Columns named ids or round_trip in df are replaced.
    """
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] + [T.StructField("round_trip", T.BooleanType())] * check
    own, schema = _columns(df, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                flat, total, same = m.encode_all([t or "" for t in texts.slice(start, 500).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)), pa.int32()), pa.array(flat))
                arrays = [*part.columns, lists] + [pa.array(same)] * check
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *(f.name for f in added)])

    return own.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Append out, the text of the array ids; null ids give the empty text.

    Ids below 0 or of the vocabulary's size or more raise an error.
    """
    own, schema = _columns(df, [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.decode(x or ()) for x in lists], pa.string())], names=[*batch.schema.names, out])

    return own.mapInArrow(run, schema)
