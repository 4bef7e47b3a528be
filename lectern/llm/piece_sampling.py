"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text's pieces are drawn from the lattice of all its segmentations: forward filtering sums the weights of all ways to
each position, backward sampling draws piece by piece from the end. The random numbers are hashes of the row's key, the
place in the text and the step, so that a row is segmented alike on every run, in whatever task it lies.

A piece never reaches over a space or a line break, so the lattice of a text is a chain of small lattices, one a word;
those of frequent words are kept in a table a worker, and all words of a batch take their next backward step together.
Spaces are written as U+2581, as the vocabulary has them. A character that no piece begins with as itself (U+2581 in the
text among them) becomes its bytes, so that decoding gives back every text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, own_columns, text_of
from lectern.llm.shingles import _powers, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: A piece of rank r weighs (r + SHIFT) ** -POWER: Zipf's law for the ranks that a BPE vocabulary has.
POWER, SHIFT = 1.2, 10
UNIT = re.compile(" ?[^ \n]+|[ \n]")
#: A worker forgets its words' lattices beyond so many states.
MOST_STATES = 1_000_000
CHUNK = 1 << 18
#: Rows that are encoded and handed on together.
PART = 256
#: Words of at most so many characters are taken up side by side.
SHORT = 64
SCALE = 2.0
MARK_CHAR = "▁"


def _sums(raw: bytes) -> np.ndarray:
    """Prefix sums of the bytes' polynomial."""
    total = np.zeros(len(raw) + 1, np.uint64)
    power, _ = _powers(max(16, int(len(raw)).bit_length()))
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return total


def _range_hashes(total: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    _, inverse = _powers(max(16, int(len(total) - 1).bit_length()))
    return mixed((total[start + size] - total[start]) * inverse[start] + size.astype(np.uint64))


class Pieces:
    """A vocabulary: ids and log weights of the pieces' bytes, and the bytes of every id."""

    def __init__(self, pieces: list[tuple[int, bytes]], byte_ids: list[int]):
        self.byte_ids = byte_ids
        self.ids, self.weights = {}, {}
        self.bytes: dict[int, bytes] = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        for rank, (i, piece) in enumerate(pieces):
            self.bytes[i] = piece.replace(MARK, b" ")
            self.ids[piece], self.weights[piece] = i, -POWER * math.log(rank + SHIFT)
        self.longest = max(map(len, self.ids), default=1)
        self._index()

    def _index(self) -> None:
        """Hashes of all beginnings of pieces, ascending, with the piece that each is (or -1) and whether longer ones follow."""
        begun: dict[bytes, list[int]] = {}
        for piece, i in self.ids.items():
            for n in range(1, len(piece)):
                begun.setdefault(piece[:n], [-1, 0])[1] = 1
            begun.setdefault(piece, [-1, 0])[0] = i
        raw = b"".join(begun)
        size = np.fromiter(map(len, begun), np.int64, len(begun))
        stop = np.cumsum(size)
        hashes = _range_hashes(_sums(raw), stop - size, size)
        order = np.argsort(hashes)
        kind = np.array(list(begun.values()), np.int64).reshape(-1, 2)[order]
        self.hashes, self.found, self.longer = hashes[order], kind[:, 0], kind[:, 1] > 0
        self.log_weight = np.zeros(max(self.bytes) + 1)
        for piece, i in self.ids.items():
            self.log_weight[i] = self.weights[piece]
        lengths = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)]
        self.size = np.array(lengths, np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(lengths))), np.uint8)
        self.offset = np.cumsum(self.size) - self.size


@lru_cache(maxsize=4)
def load_pieces(model: str = MODEL) -> Pieces:
    """Read a SentencePiece model's vocabulary. Pieces with U+2581 after their first character are not used."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    byte_ids, found = [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or "▁" in piece[1:] or "\n" in piece):
            found.append((i, piece.encode()))
    return Pieces(found, byte_ids)


class Lattices:
    """Sampling tables of the words seen. A state is an end position in a word; its edges are the pieces that end there."""

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.last: dict[str, int] = {}  # word -> its final state
        self.states = 0
        self.edges = 0
        self.slot = np.searchsorted(vocabulary.hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.head = np.empty(1 << 16, np.int32)  # first edge of a state
        self.cum = np.empty(1 << 16)  # cumulative probability among a state's edges; its last one's is 1
        self.back = np.empty(1 << 16, np.int32)  # state before the piece, -1 at a word's begin
        self.piece = np.empty(1 << 16, np.int32)

    def _append(self, cum: np.ndarray, back: np.ndarray, piece: np.ndarray, heads: np.ndarray) -> None:
        """Edges of the newest states; heads: where in them each state's begin."""
        need = self.edges + len(cum)
        while need > len(self.cum):
            self.cum, self.back, self.piece = (np.concatenate([x, np.empty_like(x)]) for x in (self.cum, self.back, self.piece))
        at = slice(self.edges, need)
        self.cum[at], self.back[at], self.piece[at] = cum, back, piece
        while self.states > len(self.head):
            self.head = np.concatenate([self.head, np.empty_like(self.head)])
        self.head[self.states - len(heads) : self.states] = self.edges + heads
        self.edges = need

    def _looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash among the vocabulary's, -1 where there is none."""
        known = self.v.hashes
        row = np.minimum(self.slot[(hashes >> np.uint64(44)).astype(np.int64)], len(known) - 1)
        below = np.flatnonzero(known[row] < hashes)
        while len(below):
            row[below] += 1
            below = below[row[below] < len(known)]
            below = below[known[row[below]] < hashes[below]]
        row[row == len(known)] = len(known) - 1
        return np.where(known[row] == hashes, row, -1)

    def add(self, words: list[str]) -> None:
        """Take up new words: short ones that pieces can spell all at once, the others one by one."""
        rest, first = [], 0
        while first < len(words):
            some, size = [], 0
            while first < len(words) and size < CHUNK // 2:
                some.append(words[first])
                size += 4 * len(words[first]) if len(words[first]) <= SHORT else 0
                first += 1
            rest += self._many([w for w in some if len(w) <= SHORT and MARK_CHAR not in w])
            rest += [w for w in some if len(w) > SHORT or MARK_CHAR in w]
        cum: list[float] = []
        back: list[int] = []
        piece: list[int] = []
        heads: list[int] = []
        for word in rest:
            self._one(word, cum, back, piece, heads)
        if rest:
            self._append(np.array(cum, float), np.array(back, np.int32), np.array(piece, np.int32), np.array(heads, np.int32))

    def _many(self, words: list[str]) -> list[str]:
        """Lattices of many words side by side; returns the words that have a character which no piece spells alone."""
        if not words:
            return []
        v = self.v
        raws = [MARK + w[1:].encode("utf-8", "surrogatepass") if w[0] == " " else w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        begin = np.cumsum(size + 1) - size - 1  # one byte between words keeps an end apart from the next begin
        raw = b"\0".join(raws) + b"\0"
        at = np.frombuffer(raw, np.uint8)
        word = np.repeat(np.arange(len(raws)), size + 1)
        end = (begin + size)[word]
        place = np.arange(len(raw))
        opens = (at & 0xC0 != 0x80) & (place < end)
        total = _sums(raw)
        live, starts, stops, ids = place[opens], [], [], []
        for n in range(1, v.longest + 1):
            h = _range_hashes(total, live, np.full(len(live), n))
            k = self._looked_up(h)
            hit = k >= 0
            whole = hit & (v.found[k] >= 0)
            starts.append(live[whole])
            stops.append(live[whole] + n)
            ids.append(v.found[k[whole]])
            live = live[hit & v.longer[k] & (live + n < end[live])]
            if not len(live):
                break
        s, e, p = np.concatenate(starts), np.concatenate(stops), np.concatenate(ids)
        # every character must be a piece of its own, else its bytes come in
        bounds = np.append(place[opens], len(raw))
        nxt = np.minimum(bounds[np.searchsorted(bounds, s, side="right")], end[s])
        alone = np.zeros(len(raw), bool)
        alone[s[e == nxt]] = True
        bad = np.zeros(len(raws), bool)
        bad[word[opens & ~alone]] = True
        good = ~bad[word[s]]
        s, e, p = s[good], e[good], p[good]
        off = e - begin[word[s]]
        order = np.lexsort((s, e, off))
        s, e, p, off = s[order], e[order], p[order], off[order]
        # weights are scaled by the byte, so that the sums of a short word stay in range
        w = np.exp(v.log_weight[p] + SCALE * (e - s))
        alpha = np.zeros(len(raw) + 1)
        alpha[begin] = 1.0
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.empty(0, np.int64)
        state_of = np.full(len(raw) + 1, -1, np.int64)
        state_of[e[first]] = self.states + np.arange(len(first))
        cum = np.empty(len(e))
        steps = np.searchsorted(off, np.arange(1, int(off[-1]) + 2)) if len(off) else []
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            if a == b:
                continue
            c = alpha[s[a:b]] * w[a:b]
            heads = first[np.searchsorted(first, a) : np.searchsorted(first, b)] - a
            # sums run edge by edge, in one order whatever words lie beside
            size_of = np.diff(np.append(heads, b - a))
            for k in range(1, int(size_of.max())):
                at_k = heads[size_of > k] + k
                c[at_k] += c[at_k - 1]
            sums = c[heads + size_of - 1]
            alpha[e[a:b][heads]] = sums
            cum[a:b] = c / np.repeat(sums, size_of)
        if len(e):
            back = state_of[s]
            back[s == begin[word[s]]] = -1
            self.states += len(first)
            self._append(cum, back, p, first)
        ends = state_of[begin + size]
        self.last.update((x, y) for x, y, z in zip(words, ends.tolist(), bad.tolist(), strict=True) if not z)
        return [x for x, z in zip(words, bad.tolist(), strict=True) if z]

    def _one(self, word: str, cum: list[float], back: list[int], piece: list[int], heads: list[int]) -> None:
        v = self.v
        raw, literal = (MARK + word[1:].encode("utf-8", "surrogatepass"), 3) if word[0] == " " else (word.encode("utf-8", "surrogatepass"), 0)
        n = len(raw)
        begins = [i for i in range(n) if raw[i] & 0xC0 != 0x80] + [n]
        alpha: dict[int, float] = {0: 0.0}
        state: dict[int, int] = {0: -1}
        ways: dict[int, list[tuple[float, int, int]]] = {}
        for b, i in enumerate(begins[:-1]):
            here, known = alpha[i], False
            single = begins[b + 1]
            for j in begins[b + 1 :]:
                if j - i > v.longest:
                    break
                p = raw[i:j]
                # a U+2581 that the text itself has is no space
                if (i >= literal and MARK in p) or p not in v.ids:
                    continue
                known |= j == single
                ways.setdefault(j, []).append((here + v.weights[p], i, v.ids[p]))
            if not known:
                ways.setdefault(single, []).append((here - POWER * math.log(SHIFT) * 8, i, -1))
            # all ways to the next begin are known now
            top = max(w for w, _, _ in ways[single])
            alpha[single] = top + math.log(sum(math.exp(w - top) for w, _, _ in ways[single]))
            spelled = [w for w in ways[single] if w[2] == -1]
            inner = -1
            if spelled:
                inner = state[i]
                for x in raw[i : single - 1]:
                    heads.append(len(cum))
                    cum.append(1.0)
                    back.append(inner)
                    piece.append(v.byte_ids[x])
                    inner, self.states = self.states, self.states + 1
            reached, edges = 0.0, ways.pop(single)
            heads.append(len(cum))
            for k, (w, start, p) in enumerate(edges):
                reached = 1.0 if k == len(edges) - 1 else reached + math.exp(w - alpha[single])
                cum.append(min(reached, 1.0))
                back.append(inner if p == -1 else state[start])
                piece.append(v.byte_ids[raw[single - 1]] if p == -1 else p)
            state[single], self.states = self.states, self.states + 1
        self.last[word] = state[n]

    def sample(self, words: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of pieces of each word, ids of all pieces in order)."""
        new = set(words).difference(self.last)
        if new:
            if self.states > MOST_STATES:
                self.__init__(self.v)
                new = set(words)
            self.add(list(new))
        state = np.array(list(map(self.last.__getitem__, words)), np.int32)
        live, steps = np.arange(len(words)), []
        while len(live):
            draw = mixed(seeds[live] + np.uint64((len(steps) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            target = (draw >> np.uint64(11)) * 2.0**-53
            edge = self.head[state]
            above = np.flatnonzero(self.cum[edge] <= target)
            while len(above):
                edge[above] += 1
                above = above[self.cum[edge[above]] <= target[above]]
            steps.append((live, self.piece[edge]))
            state = self.back[edge]
            on = state >= 0
            live, state = live[on], state[on]
        counts = np.zeros(len(words), np.int64)
        for at, _ in steps:
            counts[at] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (at, ids) in enumerate(steps):
            out[ends[at] - 1 - step] = ids
        return counts, out


_LATTICES: dict[int, Lattices] = {}


def _lattices(vocabulary: Pieces) -> Lattices:
    """This worker's tables; a task that brings another vocabulary starts anew."""
    key = hash(tuple(vocabulary.ids.values()))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattices(vocabulary)
    return _LATTICES[key]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of the batches, PART at a time, so that few texts and their pieces are held at once."""
    for pdf in batches:
        for at in range(0, len(pdf), PART):
            yield pdf.iloc[at : at + PART].reset_index(drop=True)


def encode_texts(texts: list[str], keys: np.ndarray, lattices: Lattices) -> list[np.ndarray]:
    """The sampled piece ids of each text. keys: 64-bit row keys."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        stop, size, words, counts = first, 0, [], []
        while stop < len(texts) and (stop == first or size + len(texts[stop]) < 2 * CHUNK):
            found = UNIT.findall(texts[stop])
            words += found
            counts.append(len(found))
            size += len(texts[stop])
            stop += 1
        each = np.array(counts, np.int64)
        begins = np.cumsum(each) - each
        place = (np.arange(len(words)) - np.repeat(begins, each)).astype(np.uint64)
        seeds = mixed(np.repeat(mixed(keys[first:stop].astype(np.uint64)), each) + place)
        pieces, ids = lattices.sample(words, seeds)
        ends = np.concatenate([[0], np.cumsum(pieces)])
        for b, c in zip(begins.tolist(), counts, strict=True):
            out.append(ids[ends[b] : ends[b + c]])
        first = stop
    return out


def decode_ids(ids: np.ndarray, vocabulary: Pieces) -> str:
    """The text that the pieces spell."""
    size = vocabulary.size[ids]
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return ""
    at = np.repeat(vocabulary.offset[ids] - (ends - size), size) + np.arange(ends[-1])
    return vocabulary.flat[at].tobytes().decode("utf-8", "surrogatepass")


def _mapped(rows: DataFrame, body: Callable, columns: list[str], out: str, kind: str) -> DataFrame:
    """rows.mapInPandas(body) with a column `out` after `columns`; in Spark's plan these go by number, whatever their names."""
    names, plain = rows.columns, rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in body(x.set_axis(names, axis=1) for x in batches):
            yield pdf[[*columns, out]].set_axis([f"c{i}" for i in range(len(columns) + 1)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    told = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(columns)], f"c{len(columns)} {kind}"])
    return plain.mapInPandas(named, told).toDF(*columns, out)


def sample_pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str = MODEL, seed: int = 0, out: str = "pieces", keep_text: bool = True) -> DataFrame:
    """`docs` with a column `out` of sampled piece ids (array of int), with or without their text.

    The row's key is the hash of its id and the seed: repeated rows, and rows of null id and one text, get one
    segmentation. A null text counts as empty; an empty text has no pieces. An existing column `out` is replaced. A very
    long text is sampled whole; Spark hands texts to the task in batches of 64 MB (spark.sql.execution.arrow.maxBytesPerBatch)
    or of one text.
    """
    vocabulary, key, text = docs.sparkSession.sparkContext.broadcast(load_pieces(model)), free_name(docs, "_key"), free_name(docs, "_text")
    kept = docs.drop(out) if keep_text else docs.drop(out, text_col)
    keyed = docs.withColumns({key: F.xxhash64(F.lit(seed), F.col(id_col)), text: text_of(text_col)}).select(*own_columns(kept), key, text)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = _lattices(vocabulary.value)
        for pdf in _parts(batches):
            ids = encode_texts(pdf[text].tolist(), pdf[key].to_numpy(), lattices)
            yield pdf.drop(columns=[key, text]).assign(**{out: ids})

    return _mapped(keyed, encode, kept.columns, out, "array<int>")


def decode_pieces(encoded: DataFrame, pieces_col: str = "pieces", out: str = "text", model: str = MODEL) -> DataFrame:
    """`encoded` with a column `out` of the texts that the pieces spell. Null pieces give null."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_pieces(model))
    kept = encoded.drop(out) if out != pieces_col else encoded

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            yield pdf.assign(**{out: [None if x is None else decode_ids(np.asarray(x), vocabulary.value) for x in pdf[pieces_col]]})

    return _mapped(kept, decode, [c for c in kept.columns if c != out], out, "string")


def pieces_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str = MODEL, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of the ids as 4-byte little-endian integers), decoded_sha256, lossless.

    One pass: a text is encoded, its ids are decoded again and compared in the same task. A null text counts as empty and
    has no pieces; repeated rows give repeated results; an empty table gives no rows.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"), text_of(text_col).alias("text"))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = _lattices(vocabulary.value)
        for pdf in _parts(batches):
            texts = pdf["text"].tolist()
            rows = []
            for text, ids in zip(texts, encode_texts(texts, pdf["key"].to_numpy(), lattices), strict=True):
                back = decode_ids(ids, vocabulary.value)
                rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            found = pd.DataFrame(rows, columns=["n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])
            found.insert(0, "doc_id", pdf["doc_id"].values)
            yield found

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed.mapInPandas(report, f"doc_id {kind}, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
