"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut where no piece can reach over (before a run of spaces, around a line end),
so its lattice is a chain of small lattices, one for each distinct unit of a chunk. The
forward pass sums the weights of all segmentations up to each position; backward sampling
then draws a whole segmentation of every occurrence, with numbers that depend on the row's
key, the unit's place in the text and the step alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequoria.llm import textgrid as g

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The character that stands for a space in pieces, and a stand-in for itself in a text.
SPACE, LITERAL_SPACE = 0x2581, 0x110000
_UNIT = re.compile(" *[^ \n▁]+| +|[\n▁]")
#: A piece inside a unit; texts can only be cut between units if all pieces are.
_INSIDE = re.compile("▁*[^▁\n]*|\n")
CHUNK_BYTES = 1 << 20
#: Log weight of a byte where a character is no piece.
BYTE_PENALTY = -14.0


@dataclass(frozen=True)
class Pieces:
    """The vocabulary: ``text`` by id ("" for control pieces), log weights, and the ids of the 256 bytes."""

    text: list[str]
    weight: list[float]
    byte_ids: list[int]


def load_pieces(path: str = DEFAULT_MODEL, prior: str = "zipf") -> Pieces:
    """Read a model on the driver.

    ``prior`` "score" takes the scores as log probabilities (unigram models); "zipf" takes
    the rank of a merge as the rank of a Zipf law, as BPE scores are only minus the rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    score = [0.0 if special[i] else model.get_score(i) for i in range(n)]
    weight = score if prior == "score" else [-float(np.log(2.7 - s)) for s in score]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(not model.is_byte(i) for i in byte_ids):
        raise ValueError(f"{path} has no byte pieces, so it cannot encode every text")
    text = ["" if special[i] else model.id_to_piece(i) for i in range(n)]
    over = [t for t in text if not _INSIDE.fullmatch(t)]
    if over:
        raise ValueError(f"{path} has pieces that reach over the places where texts are cut, such as {over[0]!r}")
    return Pieces(text, weight, byte_ids)


class Trie:
    """Pieces by their characters; transitions lie in one open-addressed table."""

    def __init__(self, pieces: Pieces):
        nodes: dict[tuple[int, int], int] = {}
        terminal = [-1]
        for i, text in enumerate(pieces.text):
            node = 0
            for c in map(ord, text):
                node = nodes.setdefault((node, c), len(terminal))
                if node == len(terminal):
                    terminal.append(-1)
            if text:
                terminal[node] = i
        self.terminal = np.array(terminal, dtype=np.int64)
        keys = np.array([(a << 21 | c) + 1 for a, c in nodes], dtype=np.uint64)
        values = np.array(list(nodes.values()), dtype=np.int64)
        self.mask = np.uint64((1 << max(4, int(4 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.zeros(int(self.mask) + 1, dtype=np.uint64), np.full(int(self.mask) + 1, -1, dtype=np.int64)
        at, left = g.mix(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several at one place the last stays
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        #: The nodes of single characters, by character.
        self.root = np.full(LITERAL_SPACE + 1, -1, dtype=np.int32)
        for (a, c), node in nodes.items():
            if a == 0:
                self.root[c] = node

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node, -1 for none."""
        key = ((node.astype(np.uint64) << np.uint64(21)) | char.astype(np.uint64)) + np.uint64(1)
        at = g.mix(key) & self.mask
        there = self.keys[at]
        hit = there == key
        out = np.where(hit, self.values[at], -1)
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            there = self.keys[at[left]]
            hit = there == key[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out


class Sampler:
    def __init__(self, pieces: Pieces):
        self.pieces, self.trie, self.weight = pieces, Trie(pieces), np.array(pieces.weight)
        self.byte_ids = np.array(pieces.byte_ids, dtype=np.int32)
        self.decoded = [t.replace("▁", " ").encode() for t in pieces.text]
        for b, i in enumerate(pieces.byte_ids):
            self.decoded[i] = bytes([b])

    def lattice(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Edges (from state, to state, piece or -1 minus the character, depth) of units chars[begin:end]; unit u has states from begin[u] + u."""
        n = len(chars)
        unit = np.repeat(np.arange(len(begin)), end - begin)
        stop, node = end[unit], self.trie.root[chars]
        act = np.flatnonzero(node >= 0)
        node, single, found, k = node[act], np.zeros(n, dtype=bool), [], 0
        while len(act):
            piece = self.trie.terminal[node]
            whole = np.flatnonzero(piece >= 0)
            first = act[whole]
            found.append((first, first + k + 1, piece[whole]))
            if k == 0:
                single[first] = True
            k += 1
            inside = np.flatnonzero(act + k < stop[act])
            act = act[inside]
            node = self.trie.step(node[inside], chars[act + k])
            there = np.flatnonzero(node >= 0)
            act, node = act[there], node[there]
        rest = np.flatnonzero(~single)
        found.append((rest, rest + 1, -1 - chars[rest]))
        first, last, piece = (np.concatenate(x) for x in zip(*found))
        u = unit[first]
        return first + u, last + u, piece, last - begin[u]

    def filtered(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Edges by their end state with the running sum of their probabilities given that state, and the first edge of every state."""
        source, target, piece, depth = self.lattice(chars, begin, end)
        # an edge has its target and length for itself, so the order is the same in any chunk; long pieces, mostly the likely ones, come first
        # (edges of one length are in order, so the sort merges few runs; depths are mostly small, so their sort counts)
        order = np.argsort(target << 5 | (31 - (target - source)), kind="stable")
        exact_source, exact_piece = source, piece = source[order], piece[order]
        target, depth = target[order], depth[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=len(chars) + len(begin)))])
        weight = self.weight[np.maximum(piece, 0)]
        raw = np.flatnonzero(piece < 0)
        weight[raw] = BYTE_PENALTY * _utf8_length(-1 - piece[raw])
        by_depth = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
        source, target, depth, weight = source[by_depth], target[by_depth], depth[by_depth], weight[by_depth]
        new = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        size = np.diff(np.concatenate([new, [len(target)]]))
        # one step for each depth over all units; a state's edges lie together
        cuts = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]]))
        state_cut = np.searchsorted(new, np.concatenate([cuts, [len(target)]]))
        alpha, share = np.zeros(len(chars) + len(begin)), np.empty(len(target))
        for i, a in enumerate(cuts):
            lo, hi = state_cut[i], state_cut[i + 1]
            b = new[hi] if hi < len(new) else len(target)
            v, segments, lengths = alpha[source[a:b]] + weight[a:b], new[lo:hi] - a, size[lo:hi]
            top = np.maximum.reduceat(v, segments)
            v = np.exp(v - np.repeat(top, lengths))
            total = np.add.reduceat(v, segments)
            alpha[target[new[lo:hi]]] = top + np.log(total)
            share[a:b] = v / np.repeat(total, lengths)
        exact_share = np.empty_like(share)
        exact_share[by_depth] = share
        return exact_source, exact_piece, np.cumsum(exact_share), first

    def sample(self, units: list[str], of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a segmentation of each occurrence ``of`` of a distinct unit: (ids one after another, ids of each occurrence)."""
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        chars = np.where(chars == SPACE, LITERAL_SPACE, np.where(chars == 0x20, SPACE, chars))
        end = np.cumsum(lengths)
        begin = end - lengths
        source, piece, running, first = self.filtered(chars, begin, end)
        out_size, raw = np.ones(len(piece), dtype=np.int64), np.flatnonzero(piece < 0)
        out_size[raw] = _utf8_length(-1 - piece[raw])
        start = (begin + np.arange(len(units)))[of]
        state, act, step, drawn, count = (end + np.arange(len(units)))[of], np.arange(len(of)), 0, [], np.zeros(len(of), dtype=np.int64)
        while len(act):
            lo, hi = first[state[act]], first[state[act] + 1]
            draw = (g.mix(keys[act] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64), 7) >> np.uint64(11)) * 2.0**-53
            base = np.where(lo > 0, running[lo - 1], 0.0)
            draw += base
            edge = lo.copy()
            later = np.flatnonzero((hi - lo > 1) & (running[lo] <= draw))
            while len(later):
                edge[later] += 1
                later = later[(edge[later] < hi[later] - 1) & (running[edge[later]] <= draw[later])]
            drawn.append((act, edge))
            count[act] += out_size[edge]
            state[act] = source[edge]
            act, step = act[state[act] > start[act]], step + 1
        place = np.cumsum(count)
        out = np.empty(int(count.sum()), dtype=np.int32)
        for act, edge in drawn:
            place[act] -= out_size[edge]
            p, at = piece[edge], place[act]
            out[at] = p
            for a, c in zip(at[p < 0].tolist(), (-1 - p[p < 0]).tolist()):
                raw = chr(SPACE if c == LITERAL_SPACE else c).encode()
                out[a : a + len(raw)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        return out, count

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each text); ``keys`` has a 64-bit number for each text."""
        found = [_UNIT.findall(f" {t}") if t else [] for t in texts]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        distinct = pa.array([u for x in found for u in x], pa.large_string()).dictionary_encode()
        del found
        first = np.cumsum(sizes) - sizes
        places = (np.arange(sizes.sum()) - np.repeat(first, sizes)).astype(np.uint64)
        occurrences = g.mix(np.repeat(g.mix(keys.astype(np.uint64), 5), sizes) + places * np.uint64(0xD6E8FEB86659FD93), 6)
        ids, count = self.sample(distinct.dictionary.to_pylist(), distinct.indices.to_numpy(), occurrences)
        return ids, g.sums(count, np.concatenate([first, [sizes.sum()]]))

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids from ``encode``; bytes that form no UTF-8 become U+FFFD."""
        return b"".join(map(self.decoded.__getitem__, ids))[1:].decode("utf-8", "replace")


def _utf8_length(char: np.ndarray) -> np.ndarray:
    char = np.where(char == LITERAL_SPACE, SPACE, char)
    return 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)


_samplers: dict[str, Sampler] = {}


def _sampler(name: str, pieces) -> Sampler:
    if name not in _samplers:
        _samplers.clear()
        _samplers[name] = Sampler(pieces.value)
    return _samplers[name]


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL, seed: int = 0, prior: str = "zipf", check: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces, lossless) of every row of ``docs`` (doc_id, text).

    ``model`` is a file that the driver reads; its vocabulary, of fixed size, is broadcast.
    A row's draws depend on ``seed`` and doc_id alone, so equal rows get equal ids in any
    partitioning; ``lossless`` tells that decoding gave the text back (true for null and
    empty texts, which have no ids). Null doc_ids are one key. Repeated rows stay, other
    columns are left out. One narrow stage, no shuffle.
    """
    pieces, name = docs.sparkSession.sparkContext.broadcast(load_pieces(model, prior)), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in g.chunks(batch, limit=CHUNK_BYTES):
                sampler = _sampler(name, pieces)
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                ids, count = sampler.encode(texts, part.column("row_key").to_numpy().view(np.uint64))
                offsets = np.concatenate([[0], np.cumsum(count)])
                same = [not check or sampler.decode(ids[a:b].tolist()) == t for a, b, t in zip(offsets, offsets[1:], texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(count, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "lossless"])

    return docs.select("doc_id", "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("row_key")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    pieces, name = encoded.sparkSession.sparkContext.broadcast(load_pieces(model)), uuid.uuid4().hex
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [_sampler(name, pieces).decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
