"""SentencePiece encoding, decoding and sampled segmentations.

Encoding. No piece of the vocabulary has the space mark after another
character (checked on loading), so no merge crosses the border before a run of
space marks. A text is cut there into units, and between a word and what no
piece joins to it (a comma, a line's end), so that a word makes one unit
whatever follows it; each distinct unit is encoded once. Joining the units'
pieces gives the library's own encoding.

Sampling. The lattice of a text has an edge for each piece that spells its
part of the text, of weight 1 / (rank + 10) (the model stores merge ranks, not
probabilities), and for each character without a piece a byte-fallback edge.
It falls apart at the unit borders. A segmentation has probability
proportional to the product of its weights. The k most likely segmentations
under independent Gumbel perturbations are a sample without replacement; they
are found by A-star search with the perturbed mass of a subtree as its bound:

* the first follows each unit's exact conditional edge probabilities (backward
  sums over the lattice);
* along a segmentation, everything that departs from it first in unit i is one
  open node: its mass is known, so its bound is a Gumbel truncated at the
  bound of the node that it was split from;
* the open node with the largest bound is the next segmentation's; it is drawn
  inside that unit by edge probabilities without those already taken, runs
  free after it, and splits its node anew.

The bound left at the top is the threshold of the inclusion probability
1 - exp(-exp(log p - threshold)). All draws come from a counter-based
generator keyed by the row's doc_id, the sample and the unit.
"""

from __future__ import annotations

import re
import threading
from collections import defaultdict
from itertools import chain, compress, count, islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, mix, slices, text_buffer

SPACE = "▁"
LONGEST = 16
PREFIX = -2
SLICE = 1 << 20
#: Characters of different units that a task remembers, with their lattices, beyond which those met in few slices are forgotten, and that a worker remembers from task to task.
HELD, RESTING = 4 << 20, 1 << 19
#: Per character; keeps the lattice's backward sums near one.
SCALE = 100.0
#: Of the chance one, in cumulated chances.
PARTS = float(1 << 40)
#: Units that are encoded together.
JOINED = 64
_STEP = [int(v) | 1 for v in mix(np.arange(901, 906, dtype=U64))]
_ALL = (1 << 64) - 1
_BLANK, _MARK = ord(" "), SPACE.encode()
#: What parts a unit that does not begin with a blank from the one before it, where units are encoded together.
_APART = " \n"
#: First bits of a character of one to four bytes.
_LEAD = (0, 0xC0, 0xE0, 0xF0)
#: Characters that a normaliser would change: a composed accent, a ligature, a wide letter.
_PLAIN = "e\u0301 \ufb01\uff21"
_local = threading.local()


def default_model() -> str:
    """The public 32k model installed with the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The model's encoder, its piece bytes and a hash table of its pieces by code points."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.vocab_size()
        self.bytes, normal = [], []
        for k in range(n):
            piece = m.id_to_piece(k)
            if m.is_byte(k):
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.bytes.append(b"" if m.is_control(k) or m.is_unknown(k) else piece.encode())
                if not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)):
                    normal.append((piece, k))
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in normal):
            raise ValueError("a piece crosses a unit border")
        if max(len(p) for p, _ in normal) > LONGEST:
            raise ValueError("a piece is too long for the lattice")
        self.border = self._borders()
        self.n_apart = len(m.encode(_APART[1:]))
        self.byte_ids = {m.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.byte_id = np.array([k for k, _ in sorted(self.byte_ids.items(), key=lambda x: x[1])], np.int32)
        codes, lengths = _codes([p for p, _ in normal])
        keys = np.zeros(len(normal), U64)
        at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        prefixes = []
        for k in range(LONGEST):
            on = lengths > k
            prefixes.append(keys[on])
            keys[on] = _next_hash(keys[on], codes[at[on] + k])
        prefixes = np.setdiff1d(np.concatenate(prefixes[1:]), keys)
        self.slots = np.full((1 << 20) + 64, -1, np.int32)
        self.keys = np.zeros((1 << 20) + 64, U64)
        for key, k in zip(np.concatenate([keys, prefixes]).tolist(), [*(k for _, k in normal), *[PREFIX] * len(prefixes)], strict=True):
            at_ = key >> 44
            while self.slots[at_] != -1:
                at_ += 1
            self.slots[at_], self.keys[at_] = k, key
        self.probes = self._longest_run()
        rank = np.arange(n) - min(k for _, k in normal)
        self.weight = 1.0 / (np.maximum(rank, 0) + 10.0)
        self.unknown = 1.0 / (100.0 * n)
        self.scaled = np.zeros(n)
        for p, k in normal:
            self.scaled[k] = self.weight[k] * SCALE ** len(p)

    def _borders(self) -> np.ndarray:
        """Whether units part between two bytes (first * 256 + second, a blank for the space mark): before a blank, and beside a letter where no piece has both."""
        joined, letter = np.zeros((256, 256), bool), np.zeros(256, bool)
        for piece in self.bytes:
            codes = np.frombuffer(piece.replace(_MARK, b" "), np.uint8)
            joined[codes[:-1], codes[1:]] = True
        letter[0x41:0x5B] = letter[0x61:0x7B] = letter[0x80:] = True
        out = ~joined & (letter[:, None] | letter)
        out[:, 0x80:0xC0] = False  # inside a character
        code = ord(_APART[1])
        if joined[code].any() or joined[:, code].any() or self.model.decode(self.model.encode(_PLAIN)) != _PLAIN:
            out[:] = False
        out[:, _BLANK], out[_BLANK] = True, False
        return out.ravel()

    def _longest_run(self) -> int:
        used = np.flatnonzero(self.slots != -1)
        runs = np.split(used, np.flatnonzero(np.diff(used) > 1) + 1)
        return max(map(len, runs))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece id of each key, PREFIX for one that only longer pieces start with, or -1."""
        at = (keys >> U64(44)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.slots[at], -1)
        left = np.flatnonzero((self.keys[at] != keys) & (self.slots[at] != -1))
        for k in range(1, self.probes + 1):
            if not len(left):
                break
            a = at[left] + k
            hit = self.keys[a] == keys[left]
            out[left[hit]] = self.slots[a[hit]]
            left = left[~hit & (self.slots[a] != -1)]
        return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _next_hash(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h + code.astype(U64) * U64(_STEP[4]) + U64(1)) * U64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> Vocabulary:
    held = _local.__dict__.setdefault("held", {})
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


def units_of(text: str, vocab: Vocabulary | None = None) -> list[str]:
    """The text's units, in plain form; the first has the model's leading space mark."""
    border, out = (vocab or vocabulary(default_model())).border, []
    before = _BLANK
    for c in " " + text.replace(SPACE, " ") if text else "":
        code = c.encode()
        if not out or border[before << 8 | code[0]]:
            out.append("")
        out[-1] += SPACE if c == " " else c
        before = code[-1]
    return out


def units_in(column: pa.Array, vocab: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(unit of each occurrence, first occurrence of each text (texts + 1), the different units) as units_of gives them, in UTF-8 with blanks for space marks."""
    vocab = vocab or vocabulary(default_model())
    raw, offsets = text_buffer(column)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    some = offsets[1:] > offsets[:-1]
    raw = np.insert(raw, offsets[:-1][some], _BLANK)  # the model's leading space mark
    offsets = offsets + np.concatenate([[0], np.cumsum(some)])
    if len(raw) and (marks := np.flatnonzero((raw[:-2] == _MARK[0]) & (raw[1:-1] == _MARK[1]) & (raw[2:] == _MARK[2]))).size:
        raw[marks] = _BLANK
        keep = np.ones(len(raw), bool)
        keep[marks + 1] = keep[marks + 2] = False
        raw, offsets = raw[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    border = np.zeros(len(raw), bool)
    border[1:] = vocab.border.take(raw[:-1].astype(np.uint16) << 8 | raw[1:])
    border[offsets[:-1][some]] = True
    starts = np.flatnonzero(border)
    ends = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return found.indices.to_numpy(), np.searchsorted(starts, offsets), found.dictionary.to_pylist()


class Lattice:
    """The piece lattices of some units, flat.

    Unit u has the slots start[u] to end[u], one for each place between its
    characters; a slot's edges are first[slot] to stop[slot] by length, each
    with its piece (-1 - code: the character's bytes), its chance among the
    slot's and the chances cumulated. Edges of slots equally far from their
    units' ends lie together, which is the order of the backward sums.
    """

    def __init__(self, vocab: Vocabulary, units: list[str] | tuple = ()):
        self.vocab = vocab
        self._room: dict[str, np.ndarray] = {}
        self.start = self.end = np.zeros(0, np.int64)
        self.first = self.stop = np.zeros(0, np.int32)
        self.others = np.zeros(0)
        self.length, self.piece, self.chance, self.cumulated = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.float32)
        if units:
            self.extend(units)

    def extend(self, units: list[str]) -> None:
        """Add units after those there are."""
        vocab = self.vocab
        codes, lengths = _codes(units)
        n_units, n = len(units), len(codes)
        start = np.concatenate([[0], np.cumsum(lengths)])[:-1] + np.arange(n_units)
        size = n + n_units
        at = np.arange(n) + np.repeat(np.arange(n_units), lengths)  # slot of each character
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # characters to the unit's end
        h, on, hits, edges = np.zeros(n, U64), np.arange(n), [], np.zeros(n, np.int64)
        for k in range(LONGEST):
            on = on[left[on] > k]
            h[on] = _next_hash(h[on], codes[on + k])
            found = vocab.find(h[on])
            real = found >= 0
            where, piece = on[real], found[real]
            if k == 0:  # every character has an edge
                lone = np.setdiff1d(np.arange(n), where, assume_unique=True)
                where, piece = np.concatenate([where, lone]), np.concatenate([piece, -1 - codes[lone].astype(np.int32)])
            edges[where] += 1
            hits.append((where, piece))
            on = on[found != -1]
        near = left.astype(np.uint16) if left.max(initial=0) <= 0xFFFF else left
        order = np.argsort(near, kind="stable")
        cuts, slots, counts = np.searchsorted(near[order], np.arange(1, int(left.max(initial=0)) + 2)), at[order], edges[order]
        begin = np.cumsum(counts) - counts  # first edge of each character in this order
        total = int(counts.sum())
        length, pieces, filled = np.zeros(total, np.uint8), np.zeros(total, np.int32), np.zeros(n, np.int64)
        filled[order] = begin
        for k, (where, piece) in enumerate(hits):
            to = filled[where]
            length[to], pieces[to] = k + 1, piece
            filled[where] = to + 1
        first, stop = np.zeros(size, np.int64), np.zeros(size, np.int64)
        first[slots], stop[slots] = begin, begin + counts
        chance, cumulated, others = np.zeros(total), np.zeros(total, np.float32), np.zeros(size)
        weight = np.where(pieces < 0, vocab.unknown * SCALE, vocab.scaled[np.maximum(pieces, 0)])
        target = np.repeat(slots, counts) + length
        edge_cuts = np.append(begin, total)[cuts]
        back, shift, shifted = np.ones(size), np.zeros(size), False
        for i, j, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), edge_cuts[:-1].tolist(), edge_cuts[1:].tolist(), strict=True):
            here, some, bounds, to = slots[i:j], counts[i:j], begin[i:j] - a, target[a:b]
            w = weight[a:b] * back[to]
            if shifted:
                ahead = shift[to]
                top = np.maximum.reduceat(ahead, bounds)
                w *= np.exp(ahead - np.repeat(top, some))
                shift[here] = top
            sums = np.add.reduceat(w, bounds)
            p = w / np.repeat(sums, some)
            chance[a:b] = p
            parts = (p * PARTS).astype(np.int64)  # whole numbers, so that sums do not depend on the other units
            upto = np.cumsum(parts)
            upto -= np.repeat(upto[bounds] - parts[bounds], some)
            cumulated[a:b] = upto
            cumulated[a + bounds + some - 1] = PARTS
            most = np.maximum.reduceat(p, bounds)
            ties = p == np.repeat(most, some)
            others[here] = np.add.reduceat(np.where(ties, 0.0, p), bounds) + (np.add.reduceat(ties, bounds, dtype=np.int64) - 1) * most
            far = (sums > 1e100) | (sums < 1e-100)
            if far.any():
                shifted = True
                shift[here[far]] += np.log(sums[far])
                sums = np.where(far, 1.0, sums)
            back[here] = sums
        cumulated /= PARTS
        base, more = len(self.first), len(self.piece)
        for name, new in (
            ("start", start + base), ("end", start + lengths + base), ("first", more + first), ("stop", more + stop),
            ("others", others), ("length", length), ("piece", pieces), ("chance", chance), ("cumulated", cumulated),
        ):
            self._append(name, new)

    def _append(self, name: str, new: np.ndarray) -> None:
        """Put values behind an array, whose room doubles when it is full."""
        old = getattr(self, name)
        room = self._room.get(name)
        size = len(old) + len(new)
        if room is None or len(room) < size:
            room = np.empty(max(size, 2 * len(old)), old.dtype)
            room[: len(old)] = old
            self._room[name] = room
        room[len(old) : size] = new
        setattr(self, name, room[:size])

    def keep(self, kept: np.ndarray) -> None:
        """Forget all units but those marked, which move up in order."""
        sizes = self.end - self.start + 1
        slots = np.repeat(kept, sizes)
        first, counts = self.first[slots].astype(np.int64), (self.stop - self.first)[slots]
        some = counts > 0
        on = np.zeros(len(self.piece) + 1, np.int8)
        on[first[some]] += 1
        on[first[some] + counts[some]] -= 1
        edges = np.cumsum(on[:-1], dtype=np.int8).astype(bool)
        first = np.where(some, (np.cumsum(edges) - edges)[np.where(some, first, 0)], 0)
        start = np.cumsum(sizes[kept]) - sizes[kept]
        new = {"start": start, "end": start + sizes[kept] - 1, "first": first, "stop": first + counts, "others": self.others[slots]}
        new |= {name: getattr(self, name)[edges] for name in ("length", "piece", "chance", "cumulated")}
        self._room.clear()
        for name, values in new.items():
            setattr(self, name, values.astype(getattr(self, name).dtype, copy=False))

    def edges(self, slot: int) -> tuple[list[int], list[float], int]:
        """Lengths and chances of a slot's edges, and the number of the first."""
        a, b = int(self.first[slot]), int(self.stop[slot])
        return self.length[a:b].tolist(), self.chance[a:b].tolist(), a


class Units:
    """The different units that a worker has met lately: numbers, encodings, lattices and the slices with them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.lat = Lattice(vocab)
        self.ids, self.begin, self.n_ids, self.whole = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.met = np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Forget the units that were met in few slices, so that the others have at most so many characters."""
        sizes, least = self.lat.end - self.lat.start + 1, 2
        while sizes[self.met >= least].sum() > most:
            least *= 2
        kept = self.met >= least
        names = list(compress(self.numbers, kept.tolist()))
        self.numbers = defaultdict(count(len(names)).__next__, zip(names, range(len(names)), strict=True))
        self.lat.keep(kept)
        self.ids, self.n_ids = self.ids[_ragged(self.begin[kept], self.n_ids[kept])], self.n_ids[kept]
        self.begin, self.whole, self.met = np.cumsum(self.n_ids) - self.n_ids, self.whole[kept], self.met[kept] // 2

    def number(self, units: list[bytes]) -> np.ndarray:
        """The number of each unit, which is different from the others; those not known are learnt."""
        if len(self.lat.first) > HELD:
            self.shrink(HELD // 2)
        numbers = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        self.learn()
        self.met[numbers] += 1
        return numbers

    def learn(self) -> None:
        """Encode the units numbered since the last time."""
        units = list(islice(self.numbers, len(self.n_ids), None))
        if not units:
            return
        texts = [u.decode("utf-8", "replace") for u in units]
        flat, n_ids, whole = self._encode_joined(units, texts) or self._encode_each(units, texts)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(n_ids) - n_ids])
        self.ids, self.n_ids, self.whole = np.concatenate([self.ids, flat]), np.concatenate([self.n_ids, n_ids]), np.concatenate([self.whole, whole])
        self.met = np.concatenate([self.met, np.zeros(len(units), np.int64)])
        self.lat.extend([t.replace(" ", SPACE) for t in texts])

    def _encode_joined(self, units: list[bytes], texts: list[str]):
        """(ids, how many of each unit, whether they spell it), of JOINED units at a time; None where some piece does not spell its part."""
        if any(map(bytes.isspace, (u for u in units if u.endswith(b" ")))):  # blanks alone would meet the next unit's
            return None
        apart, spelt = _APART.encode(), self.vocab.bytes
        led = np.fromiter((u[0] != _BLANK for u in units), bool, len(units))
        parts = [t if t[0] == " " else _APART + t for t in texts]
        ids = self.vocab.model.encode(["".join(parts[i : i + JOINED])[1:] for i in range(0, len(parts), JOINED)], num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
        raw = b"".join([u if u[0] == _BLANK else apart + u for u in units])
        blanks = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) == _BLANK)])
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + led * len(apart))
        ends += blanks[ends] * (len(_MARK) - 1)
        reached = np.cumsum(self.vocab.sizes[flat])
        last = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[last] != ends).any() or b"".join(map(spelt.__getitem__, flat.tolist())) != raw.replace(b" ", _MARK):
            return None
        n_ids = np.diff(last + 1, prepend=0)
        if led.any():
            first = (last + 1 - n_ids)[led]
            begin = np.concatenate([[0], ends[:-1]])[led] + len(apart) - 1 + len(_MARK)
            if (reached[first + self.vocab.n_apart - 1] != begin).any():
                return None
            flat = np.delete(flat, (first[:, None] + np.arange(self.vocab.n_apart)).ravel())
            n_ids = n_ids - led * self.vocab.n_apart
        return flat, n_ids, np.ones(len(units), bool)

    def _encode_each(self, units: list[bytes], texts: list[str]):
        ids = self.vocab.model.encode([t[1:] if t[0] == " " else _APART[1:] + t for t in texts], num_threads=1)
        ids = [e if t[0] == " " else e[self.vocab.n_apart :] for e, t in zip(ids, texts, strict=True)]
        for m in [m for m, t in enumerate(texts) if t == " "]:  # the model gives nothing for an empty text
            ids[m] = [self.vocab.model.piece_to_id(SPACE)]
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        whole = [b"".join([self.vocab.bytes[x] for x in e]) == u.replace(b" ", _MARK) for e, u in zip(ids, units, strict=True)]
        return np.fromiter(chain.from_iterable(ids), np.int32, int(n_ids.sum())), n_ids, np.array(whole, bool)


def _known(path: str) -> Units:
    """The units that this worker holds, from task to task."""
    held = _local.__dict__.setdefault("units", {})
    if path not in held:
        held[path] = Units(vocabulary(path))
    return held[path]


def _uniform(row: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) that row and counters decide."""
    h = row
    for c in counters:
        h = mix(h + np.asarray(c).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
    return ((h >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _seeds(row, index, sample: int):
    return mix(row + U64(_STEP[0]) * np.asarray(index).astype(U64) + U64(_STEP[1] * (sample + 1) & (1 << 64) - 1))


def _walk(lat: Lattice, unit: np.ndarray, row: np.ndarray, index: np.ndarray, sample: int):
    """Draw a segmentation for each unit occurrence: (edges of all, how many of each, log probability, log probability of all others).

    The others' probability is summed over the edges not taken, so that it is
    exact however small, and 0 (a log of -inf) only for a unit with no other
    segmentation.
    """
    n = len(unit)
    steps, rest, drawn = np.zeros(n, np.int64), np.zeros(n), []
    # of the occurrences not at their unit's end: number, seed, place, what is left out and what is reached so far
    on, seed, at, r, reach = np.arange(n), _seeds(row, index, sample), lat.start[unit], np.zeros(n), np.ones(n)
    first, edge = lat.first.take(at), lat.stop.take(at) - 1
    while len(on):
        u = _uniform(seed, len(drawn)).astype(np.float32)
        back = np.flatnonzero((edge > first) & (lat.cumulated.take(edge - 1) >= u))  # from the longest edge, which is the likeliest as a rule
        while len(back):
            e = edge[back] - 1
            edge[back] = e
            back = back[(e > first[back]) & (lat.cumulated.take(e - 1) >= u[back])]
        chance = lat.chance.take(edge)
        r += reach * np.where(chance > 0.5, lat.others.take(at), 1.0 - chance)
        reach *= chance
        drawn.append((on, edge))
        at = at + lat.length.take(edge)
        first, edge = lat.first.take(at), lat.stop.take(at) - 1
        left = edge >= first  # no edge starts at the end
        done, left = np.flatnonzero(~left), np.flatnonzero(left)
        if len(done):
            gone = on.take(done)
            steps[gone], rest[gone] = len(drawn), r.take(done)
            on, seed, at, r, reach, first, edge = (x.take(left) for x in (on, seed, at, r, reach, first, edge))
    begin = np.cumsum(steps) - steps
    edges = np.empty(int(steps.sum()), np.int64)
    for step, (on, edge) in enumerate(drawn):
        edges[begin[on] + step] = edge
    logp = np.add.reduceat(np.log(lat.chance[edges]), begin) if n else np.zeros(0)
    with np.errstate(divide="ignore"):
        return edges, steps, logp, np.log(rest)


def _mix_one(x: int) -> int:
    x &= _ALL
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


def _uniform_one(row: int, counter: int) -> float:
    h = _mix_one(row + counter * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019)
    return ((h >> 11) + 0.5) / (1 << 53)


def _seed_one(row: int, index: int, sample: int) -> int:
    return _mix_one(row + _STEP[0] * index + _STEP[1] * (sample + 1))


class Taken:
    """The segmentations of a unit that are drawn already, as a tree of edges from its start."""

    def __init__(self, lat: Lattice, unit: int):
        self.lat, self.at, self.end = lat, [int(lat.start[unit])], int(lat.end[unit])
        self.children: list[dict[int, int]] = [{}]
        self.rest, self.found = [1.0], {}

    def edges(self, node: int) -> tuple[list[int], list[float], int]:
        if node not in self.found:
            self.found[node] = self.lat.edges(self.at[node])
        return self.found[node]

    def free(self, node: int) -> list[float]:
        """Of each edge at a node, the probability of the segmentations over it that are not drawn."""
        lengths, chances, _ = self.edges(node)
        children = self.children[node]
        return [p * self.rest[children[x]] if x in children else p for x, p in zip(lengths, chances, strict=True)]

    def add(self, lengths: list[int]) -> None:
        path = [0]
        for x in lengths:
            node = path[-1]
            if x not in self.children[node]:
                self.children[node][x] = len(self.at)
                self.at.append(self.at[node] + x)
                self.children.append({})
                self.rest.append(1.0)
            path.append(self.children[node][x])
        for node in reversed(path):
            self.rest[node] = sum(self.free(node)) if self.at[node] < self.end else 0.0


def _redraw(taken: Taken, row: int, sample: int) -> tuple[list[int], list[int], float]:
    """A segmentation of the unit that is not taken: (lengths, edges, log probability)."""
    at, node = taken.at[0], 0
    out, edges, logp = [], [], 0.0
    seed = _seed_one(row, 1 << 40, sample)
    while at < taken.end:
        lengths, chances, number = taken.lat.edges(at) if node is None else taken.edges(node)
        free = chances if node is None else taken.free(node)
        u, edge = _uniform_one(seed, len(out)) * sum(free), 0
        for edge, p in enumerate(free):  # noqa: B007
            u -= p
            if u <= 0 and p > 0:
                break
        else:
            edge = max(k for k, p in enumerate(free) if p > 0)
        x = lengths[edge]
        logp += log(chances[edge])
        node = None if node is None else taken.children[node].get(x)
        out.append(x)
        edges.append(number + edge)
        at += x
    return out, edges, logp


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _below(g: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A Gumbel draw g truncated at top."""
    top = np.broadcast_to(top, g.shape)
    low = np.minimum(g, top)
    return low - np.log1p(np.exp(-np.abs(g - top))) if len(g) else g


def _prefix(logp: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of logp over the text's occurrences before each."""
    before = np.cumsum(logp) - logp
    return before - np.repeat(before[np.minimum(first[:-1], max(len(logp) - 1, 0))], sizes) if len(logp) else before


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def sample_slice(lat: Lattice, unit: np.ndarray, first: np.ndarray, row: np.ndarray, k: int):
    """k segmentations of each text: (samples, threshold, lengths_of).

    unit: unit of each occurrence; first: first occurrence of each text (texts
    + 1); row: seed of each text. A sample has, per occurrence, logp and its
    edges, begin to begin + steps of drawn, and per text its perturbed value,
    -inf where the text has no further segmentation. lengths_of(sample,
    occurrence) gives the edges' lengths.
    """
    texts, n, sizes = len(first) - 1, len(unit), np.diff(first)
    owner = np.repeat(np.arange(texts), sizes)
    index = np.arange(n) - np.repeat(first[:-1], sizes)
    seeds, some = row[owner], np.flatnonzero(sizes > 0)
    taken: dict[tuple[int, int], Taken] = {}
    samples, bounds = [], []

    def lengths_of(s: int, j: int) -> list[int]:
        begin = int(samples[s]["begin"][j])
        return lat.length[drawn[begin : begin + int(samples[s]["steps"][j])]].tolist()

    def push(sample, value, from_):
        """Keep a sample and open its nodes at occurrences with index >= from_."""
        r = len(samples)
        samples.append(sample | {"value": value})
        g = _prefix(sample["logp"], first, sizes) + sample["rest"]
        on = np.flatnonzero((index >= from_[owner]) & np.isfinite(g) & np.isfinite(value[owner]))
        bound = np.full(n, -np.inf)
        bound[on] = _below(g[on] + _gumbel(_uniform(seeds[on], 11 + r, index[on])), value[owner[on]])
        bounds.append(bound)

    def top():
        best = np.full((len(bounds), texts), -np.inf)
        for s, b in enumerate(bounds):
            if n:
                best[s, some] = np.maximum.reduceat(b, first[:-1][some])
        return best.argmax(axis=0), best.max(axis=0)

    drawn, steps, logp, rest = _walk(lat, unit, seeds, index, 0)
    value = np.full(texts, -np.inf)
    value[some] = _gumbel(_uniform(row[some], 7))
    push({"begin": np.cumsum(steps) - steps, "steps": steps, "logp": logp, "rest": rest}, value, np.zeros(texts, np.int64))
    for r in range(1, k):
        parent, value = top()
        go = np.flatnonzero(np.isfinite(value))
        new = {name: samples[0][name].copy() for name in ("begin", "steps", "logp", "rest")}
        for s in range(1, len(samples)):
            mine = np.flatnonzero((parent == s)[owner])
            for name in new:
                new[name][mine] = samples[s][name][mine]
        split = np.full(texts, n + 1)
        for t in go.tolist():
            split[t] = int(bounds[parent[t]][first[t] : first[t + 1]].argmax())
        after = np.flatnonzero(index > split[owner])
        walked, new["steps"][after], new["logp"][after], new["rest"][after] = _walk(lat, unit[after], seeds[after], index[after], r)
        new["begin"][after] = len(drawn) + np.cumsum(new["steps"][after]) - new["steps"][after]
        redrawn, end = [], len(drawn) + len(walked)
        for t in go.tolist():
            s, j = int(parent[t]), int(first[t] + split[t])
            if (s, j) not in taken:
                taken[s, j] = Taken(lat, int(unit[j]))
                taken[s, j].add(lengths_of(s, j))
            gone = taken[s, j]
            lengths, edges, new["logp"][j] = _redraw(gone, int(row[t]), r)
            new["begin"][j], new["steps"][j] = end + len(redrawn), len(edges)
            redrawn += edges
            gone.add(lengths)
            if gone.rest[0] > 0:
                g = float(samples[s]["logp"][first[t] : j].sum()) + log(gone.rest[0]) + _gumbel(_uniform(row[t : t + 1], 13 + r, split[t : t + 1]))
                bounds[s][j] = _below(g, value[t : t + 1])[0]
            else:
                bounds[s][j] = -np.inf
        drawn = np.concatenate([drawn, walked, np.array(redrawn, np.int64)])
        push(new, value, split + 1)
    for sample in samples:
        sample["drawn"] = drawn
    return samples, top()[1], lengths_of


def edge_ids(lat: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(ids of the edges in order, how many of each); None: one each. A character without a piece becomes its bytes."""
    ids = lat.piece[edges]
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids, None
    code, sizes = -1 - ids[lone].astype(np.int64), np.ones(len(edges), np.int64)
    cost = sizes[lone] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    at = (np.cumsum(sizes) - sizes)[lone]
    ids = np.repeat(ids, sizes)
    for c, lead in enumerate(_LEAD, 1):
        here = np.flatnonzero(cost == c)
        for k in range(c):
            byte = code[here] >> 6 * (c - 1 - k)
            ids[at[here] + k] = lat.vocab.byte_id[byte | lead if k == 0 else 0x80 | byte & 0x3F]
    return ids, sizes


def _run(path: str, k: int):
    def run(batches):
        units = _known(path)
        try:
            for batch in batches:
                keys, column = batch.column(0), batch.column(1)
                _, offsets = text_buffer(column)
                for i, j in slices(offsets, SLICE):
                    yield _slice(units, keys.slice(i, j - i), column.slice(i, j - i), batch.column(2).slice(i, j - i), k)
        finally:
            if len(units.lat.first) > RESTING:
                units.shrink(RESTING)

    return run


def _lists(values: pa.Array | np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _slice(known: Units, keys, column: pa.Array, seeds, k: int):
    local, first, units = units_in(column, known.vocab)
    unit = known.number(units)[local]
    lat, texts = known.lat, len(first) - 1

    def per_text(values, kind=np.int64):
        c = np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)])
        return c[first[1:]] - c[first[:-1]]

    exact = per_text(~known.whole[unit]) == 0
    row = mix(np.asarray(seeds).astype(np.int64).view(U64))
    samples, threshold, _ = sample_slice(lat, unit, first, row, k)
    there = np.stack([np.isfinite(s["value"]) for s in samples], 1)
    shape = (texts, len(samples))
    n_pieces, logp, drawn = np.zeros(shape, np.int64), np.zeros(shape), []
    for s, sample in enumerate(samples):
        edges = sample["drawn"][: int(sample["steps"].sum())] if s == 0 else sample["drawn"][_ragged(sample["begin"], sample["steps"])]  # the first has them in order
        ids, sizes = edge_ids(lat, edges)
        counts = sample["steps"]
        if sizes is not None:
            counts = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        n_pieces[:, s], logp[:, s] = per_text(counts), per_text(sample["logp"], float)
        drawn.append(ids)
    gap = logp - threshold[:, None]
    with np.errstate(over="ignore"):
        inclusion = np.where(~np.isfinite(gap) | (gap > 30), 1.0, -np.expm1(-np.exp(gap)))
    sizes = np.where(there, n_pieces, 0)
    begin = (np.cumsum(sizes) - sizes.ravel()).reshape(shape)
    flat = np.empty(int(sizes.sum()), np.int32)
    for s, ids in enumerate(drawn):
        flat[_ragged(begin[:, s], sizes[:, s])] = ids[np.repeat(there[:, s], n_pieces[:, s])]
    value = np.stack([s["value"] for s in samples], 1)
    fields = [*(pa.array(x[there]) for x in (n_pieces, logp, value, inclusion)), _lists(pa.array(flat), sizes[there])]
    n_own = per_text(known.n_ids[unit])
    own = _lists(pa.array(known.ids[_ragged(known.begin[unit], known.n_ids[unit])]), n_own)
    sampled = _lists(pa.StructArray.from_arrays(fields, fields=_FIELDS), there.sum(axis=1))
    return pa.RecordBatch.from_arrays([keys, pa.array(n_own), pa.array(exact), own, sampled], ["doc_id", "n_pieces", "exact", "ids", "samples"])


_FIELDS = [pa.field("n_pieces", pa.int64()), pa.field("log_p", pa.float64()), pa.field("perturbed", pa.float64()), pa.field("inclusion", pa.float64()), pa.field("ids", pa.list_(pa.int32()))]
_SQL = "n_pieces: long, log_p: double, perturbed: double, inclusion: double, ids: array<int>"


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of a segmentation: the inverse of encoding."""
    vocab = vocabulary(path or default_model())
    return b"".join(vocab.bytes[k] for k in ids).decode("utf-8", "replace").replace(SPACE, " ")[1:]


def sample_segmentations(docs: DataFrame, k: int = 2, path: str | None = None, with_ids: bool = False, text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, digest, exact[, ids], samples) for every row of docs.

    n_pieces and digest (and ids) are of the model's own encoding, digests are
    of ids; exact says
    that decoding gives the text back (a text that itself holds the space mark
    U+2581 reads as spaces). samples: up to k distinct segmentations in order
    of their perturbed values: n_pieces, digest, log_p, perturbed, inclusion
    [, ids]; fewer only where the text has fewer segmentations. Null and empty texts have no pieces, no samples, and are exact.
    Draws depend on doc_id alone (a null one counts as -1), so repeated rows
    give equal results. Other columns are ignored.
    """
    path = path or default_model()
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text"), F.coalesce(F.xxhash64("doc_id") if kind == "string" else F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("seed"))
    found = rows.mapInArrow(_run(path, k), f"doc_id {kind}, n_pieces long, exact boolean, ids array<int>, samples array<struct<{_SQL}>>")
    names = ["n_pieces", "digest", "log_p", "perturbed", "inclusion", *(["ids"] if with_ids else [])]
    samples = F.transform("samples", lambda s: F.struct(*(F.xxhash64(s["ids"]).alias(x) if x == "digest" else s[x].alias(x) for x in names)))
    return found.select("doc_id", "n_pieces", F.xxhash64("ids").alias("digest"), "exact", *(["ids"] if with_ids else []), samples.alias("samples"))
