"""Byte-pair encoding and decoding with an index of where each pair occurs.

The different words of a chunk stand one after another as linked symbols. An index maps
each pair that can be merged to all its places; the active ranks are taken in ascending
order, a pair's places are merged from left to right, and the places of the pairs that
appear are entered. Cuts between words, normal forms and the vocabulary are those of a
tokenizer file.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sequoria.llm import textgrid as g

DEFAULT_MODEL = "/opt/tokenizers/word_bpe_49k.json"
CHUNK_BYTES = 1 << 24
#: Different pieces of text whose ids a task remembers.
REMEMBERED = 3 << 18
#: Pieces of these characters only are their own normal form but for case, and are cut by the same rule written for them;
#: all others are cut by the library, whose tables of characters decide.
_PLAIN = re.compile("[!-~À-ÿ]*")
_PLAIN_WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: White space that cuts a text into pieces; all of it is dropped between words.
_CUT = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


class Merges:
    """Ranks and results of pairs: the pair (a, b) is the number a << 32 | b; NONE is the rank of a pair that is not merged."""

    NONE = 1 << 60

    def __init__(self, rules: dict[int, tuple[int, int]]):
        self.rule = rules
        self.pairs = np.array(sorted(rules), np.int64)
        self.ranks = np.array([rules[p][0] for p in self.pairs.tolist()], np.int64)
        self.of_rank = {rank: (p >> 32, p & 0xFFFFFFFF, new) for p, (rank, new) in rules.items()}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), self.NONE)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], self.NONE)


class PairIndex:
    """Symbols of many words in one row, and for each mergeable pair the places where it begins, by the pair's rank."""

    #: Places from which on a pair's merges are made on arrays at once.
    MANY = 48

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, merges: Merges):
        """``symbols`` of all words one after another, and the number of each word's."""
        self.merges, self.symbol, n = merges, symbols.astype(np.int64), len(symbols)
        self.word = np.repeat(np.arange(len(sizes)), sizes)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)[sizes > 0]
        self.after[ends - 1] = -1
        self.before[ends - sizes[sizes > 0]] = -1
        self.places: dict[int, list] = {}
        self.active: list[int] = []
        at = np.flatnonzero(self.after >= 0)
        self.enter(at, merges.ranks_of(self.symbol[at], self.symbol[at + 1]))

    def enter(self, at: np.ndarray, ranks: np.ndarray) -> None:
        """Notes the pairs that begin at ``at``."""
        found = np.flatnonzero(ranks < Merges.NONE)
        if not len(found):
            return
        order = found[np.argsort(ranks[found], kind="stable")]
        at, ranks = at[order], ranks[order]
        first = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for rank, begin, end in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            self._listed(rank).append(at[begin:end])

    def _listed(self, rank: int) -> list:
        if rank not in self.places:
            self.places[rank] = []
            heapq.heappush(self.active, rank)
        return self.places[rank]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, symbol) of every symbol that is left, in order."""
        while self.active:
            rank = heapq.heappop(self.active)
            held = self.places.pop(rank)
            # arrays of places, or single ones
            at = np.unique(np.concatenate([x if isinstance(x, np.ndarray) else np.array([x]) for x in held])) if len(held) > 1 or not isinstance(held[0], int) else np.array(held)
            a, b, new = self.merges.of_rank[rank]
            if len(at) < self.MANY or a == b or not self._at_once(rank, at, a, b, new):
                self._one_by_one(rank, at.tolist(), a, b, new)
        left = np.flatnonzero(self.symbol >= 0)
        return self.word[left], self.symbol[left]

    def _at_once(self, rank: int, at: np.ndarray, a: int, b: int, new: int) -> bool:
        """Merges all places of a pair; does nothing and returns False if that makes a pair of lower rank, which would come first in its word."""
        then = self.after[at]
        at = at[(self.symbol[at] == a) & (then >= 0) & (self.symbol[then] == b)]
        then = self.after[at]
        following, preceding = self.after[then], self.before[at]
        # a neighbour that is merged as well is new too
        right, left = np.where(following >= 0, self.symbol[following], -1), np.where(preceding >= 0, self.symbol[preceding], -1)
        follows = np.flatnonzero((following[:-1] == at[1:]) & (following[:-1] >= 0))
        right[follows], left[follows + 1] = new, -1
        news = np.full(len(at), new)
        after_ranks = np.where(right >= 0, self.merges.ranks_of(news, right), Merges.NONE)
        before_ranks = np.where(left >= 0, self.merges.ranks_of(left, news), Merges.NONE)
        # between two merges of one word the pair (new, right as it was) exists for a moment
        moment = self.merges.ranks_of(news[follows], np.full(len(follows), a))
        if min(after_ranks.min(initial=Merges.NONE), before_ranks.min(initial=Merges.NONE), moment.min(initial=Merges.NONE)) < rank:
            return False
        self.symbol[at], self.symbol[then], self.after[at] = new, -1, following
        self.before[following[following >= 0]] = at[following >= 0]
        self.enter(np.concatenate([at, self.before[at]]), np.concatenate([after_ranks, before_ranks]))
        return True

    def _one_by_one(self, rank: int, places: list[int], a: int, b: int, new: int) -> None:
        symbol, after, before, word, rule = self.symbol, self.after, self.before, self.word, self.merges.rule
        waiting = -1
        for at in places:
            if word[at] == waiting:  # a merge in this word has made a pair that comes first
                self._listed(rank).append(at)
                continue
            then = int(after[at])
            if symbol[at] != a or then < 0 or symbol[then] != b:
                continue
            following, preceding = int(after[then]), int(before[at])
            symbol[at], symbol[then], after[at] = new, -1, following
            if following >= 0:
                before[following] = at
                found = rule.get(new << 32 | int(symbol[following]))
                if found:
                    self._listed(found[0]).append(at)
                    waiting = int(word[at]) if found[0] < rank else waiting
            if preceding >= 0:
                found = rule.get(int(symbol[preceding]) << 32 | new)
                if found:
                    self._listed(found[0]).append(preceding)
                    waiting = int(word[at]) if found[0] < rank else waiting


class WordBpe:
    """Encoder and decoder of a tokenizer file without unknown tokens, prefixes, dropout or a decoder of its own."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        model = json.loads(spec)
        added, model = model["added_tokens"], model["model"]
        vocab: dict[str, int] = model["vocab"]
        shown = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
        shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown.values())}
        self.byte_of = shown
        symbol = lambda suffix: np.array([vocab[c + suffix] for c in sorted(shown, key=shown.__getitem__)], np.int64)
        self.symbols, self.last_symbols = symbol(""), symbol(model["end_of_word_suffix"] or "")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges({vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))})
        token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self.tokens = pa.array([token.get(i) for i in range(max(token, default=-1) + 1)], pa.large_string())
        self.decimals = pa.array(list(map(str, range(len(self.tokens)))), pa.large_string())
        self.added = {t["content"]: t["id"] for t in added}
        self.added_at = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.known: dict[str, np.ndarray] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, pieces: list[str]) -> list[list[bytes | int]]:
        """For each piece of text its words, and the ids of added tokens in it."""
        out: list[list[bytes | int]] = []
        for piece in pieces:
            if _PLAIN.fullmatch(piece) and not (self.added and "<" in piece and self.added_at.search(piece)):
                out.append([w.encode() for w in _PLAIN_WORD.findall(piece.lower())])
                continue
            found: list[bytes | int] = []
            for part in self.added_at.split(piece) if self.added else (piece,):
                if part in self.added:
                    found.append(self.added[part])
                elif part:
                    words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                    found += [bytes(map(self.byte_of.__getitem__, w)) for w, _ in words]
            out.append(found)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Enters the ids of pieces that are not known yet, with one index of the pairs of all their new words."""
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            self.words.clear()
            fresh = pieces
        cuts = self.cuts(fresh)
        new = list(dict.fromkeys(w for c in cuts for w in c if isinstance(w, bytes) and w not in self.words))
        sizes = np.array([len(w) for w in new], np.int64)
        raw = np.frombuffer(b"".join(new), np.uint8)
        symbols = self.symbols[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last_symbols[raw[ends]]
        word, ids = PairIndex(symbols, sizes, self.merges).merged()
        first, ids = np.searchsorted(word, np.arange(len(new) + 1)).tolist(), ids.tolist()
        self.words.update((w, tuple(ids[a:b])) for w, a, b in zip(new, first, first[1:]))
        for piece, words in zip(fresh, cuts):
            self.known[piece] = np.array([i for w in words for i in (self.words[w] if isinstance(w, bytes) else (w,))], np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each text) of a column of texts; null counts as empty."""
        data, offsets = g.texts_of(texts)
        plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes().translate(_CUT)))
        parts = pc.split_pattern(plain, " ")
        rows = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        distinct = parts.flatten().dictionary_encode()
        pieces = distinct.dictionary.to_pylist()
        self.learn(pieces)
        ids = [self.known[p] for p in pieces]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        code = distinct.indices.to_numpy()
        first, size = (np.cumsum(sizes) - sizes)[code], sizes[code]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return flat[np.repeat(first, size) + place], np.bincount(rows, size, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts: tokens joined by spaces, of the ids between ``offsets``; ids that are no token's are left out."""
        return _joined(self.tokens, ids, offsets)

    def numbers(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The ids between ``offsets`` in decimals, joined by spaces."""
        return _joined(self.decimals, ids, offsets)


def _joined(names: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    known = (ids >= 0) & (ids < len(names))
    wanted = pa.array(np.where(known, ids, 0), pa.int64(), mask=~known)
    kept = names.take(wanted)
    if kept.null_count:
        full = kept.is_valid()
        kept, offsets = kept.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), kept), pa.scalar(" ", pa.large_string()))


_models: dict[str, WordBpe] = {}


def _model(name: str, spec) -> WordBpe:
    if name not in _models:
        _models.clear()
        _models[name] = WordBpe(spec.value)
    return _models[name]


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text), whole texts, without special tokens around them.

    ``model`` is a tokenizer file that the driver reads; of fixed size, it is broadcast.
    Null and empty texts have no ids. Repeated rows stay, null doc_ids stay, other columns
    are left out; an empty table gives an empty one. One narrow stage, no shuffle.
    """
    with open(model, encoding="utf-8") as file:
        spec, name = docs.sparkSession.sparkContext.broadcast(file.read()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in g.chunks(batch, limit=CHUNK_BYTES):
                ids, count = _model(name, spec).encode(part.column("text"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    with open(model, encoding="utf-8") as file:
        spec, name = encoded.sparkSession.sparkContext.broadcast(file.read()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                lists = part.column("ids")
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _model(name, spec).decode(ids, offsets).cast(pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_report(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``, encoded and decoded in one narrow stage.

    Edge cases as in ``encode_documents``.
    """
    with open(model, encoding="utf-8") as file:
        spec, name = docs.sparkSession.sparkContext.broadcast(file.read()), uuid.uuid4().hex
    digests = lambda texts: pa.array([sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in g.chunks(batch, limit=CHUNK_BYTES):
                own = _model(name, spec)
                ids, count = own.encode(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), digests(own.numbers(ids, offsets)), digests(own.decode(ids, offsets))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
