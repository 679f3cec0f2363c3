"""BPE encoding and decoding by a pair occurrence index.

Texts are cut into words; the distinct words that a partition has not met yet are laid out as one
flat row of symbols. An index maps each mergeable pair to all its positions in that row. The active
ranks are applied in ascending order, each to its whole list at once, and a merge enters the two pairs it
makes into the lists of their own ranks. Every token of these vocabularies is made by a merge that
ranks before the merges that use it, so a list that was applied never grows again; ``PairIndex``
checks this when it loads a vocabulary.

Defined results: a null or empty text has no tokens, and decodes to the empty text. Rows are
independent, so repeated rows give repeated results; columns other than the id and the text are not read.
A text of any length is encoded whole. The vocabulary is a fixed file of about two MB that is read on the
driver and broadcast. Ties between pairs are settled by rank, then from left to right. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of chunks and words, with their ids and tokens, kept between batches. Half of it is for new ones; when that is full it becomes the old half, and what the
#: old half had and was not met since goes, which costs time but changes nothing. A longer chunk or word (in characters) is never kept.
CACHE_BYTES, CACHE_LENGTH = 64 << 20, 100
#: Bytes that an entry takes beside its characters, about.
_ENTRY = 300
#: Code points for which Python's lower(), NFC and the character classes below were compared with the
#: library's over the whole range. A text with any other goes through the library's own normaliser and splitter.
_COMMON = re.compile(r"[^\x00-\x1b\x20-ȳΑ-Ρα-ωА-я‐-‧‰-⁞€]")


class PairIndex:
    """The merges of a vocabulary and the words encoded so far."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.numbers = {i: str(i) for i in self.tokens}
        self.parts: list[tuple[int, int, int]] = []
        made: set[int] = set()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        later = {vocab[a + b] for a, b in pairs}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if (left in later and left not in made) or (right in later and right not in made):
                raise ValueError(f"merge {rank} uses a token that a later merge makes")
            made.add(whole)
            self.parts.append((left, right, whole))
        keys = np.array([a << 20 | b for a, b, _ in self.parts], np.int64)
        self.ranks = np.append(np.argsort(keys), -1)
        self.keys = np.append(np.sort(keys), np.iinfo(np.int64).max)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + end] for c in alphabet], np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = common_pattern(pattern).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.blob = blob
        self.library = None
        self.known: dict[str, tuple[str, str]] = {}
        self.seen: dict[str, tuple[str, str] | None] = {}
        self.old_known: dict[str, tuple[str, str]] = {}
        self.old_seen: dict[str, tuple[str, str] | None] = {}
        self.held = 0

    def library_words(self, text: str) -> list[str]:
        """The words of a text, by the library's own normaliser and splitter."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.blob)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def chunks(self, text: str) -> list[str]:
        """What white space separates; no word spans it, so a chunk's tokens do not depend on what is around it.

        Special tokens stand for themselves. A text with uncommon code points is one chunk.
        """
        if _COMMON.search(text):
            return [text]
        if self.cut is None or "<|" not in text:
            return text.split()
        return [x for part in self.cut(text) for x in ([part] if part in self.special else part.split())]

    def words_of(self, chunk: str) -> list[str]:
        if chunk in self.special:
            return [chunk]
        if _COMMON.search(chunk):
            parts = self.cut(chunk) if self.cut else [chunk]
            return [w for p in parts for w in ([p] if p in self.special else self.library_words(p))]
        return self.words(chunk.replace("Σ", "σ").lower())

    def learn(self, words: set[str]) -> None:
        """Encode new words together and keep, for each, its ids and its tokens as text."""
        order = []
        for w in words:
            if w in self.special:
                self.known[w] = (str(self.special[w]), w)
            else:
                order.append(w)
        raw = [w.encode("utf-8", "surrogatepass") for w in order]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[flat]
        symbol[ends - 1] = self.last[flat[ends - 1]]
        self._merge(symbol, ends)
        alive = symbol >= 0
        counts = np.add.reduceat(alive, ends - lengths, dtype=np.int64).tolist() if order else []
        ids = symbol[alive].tolist()
        numbers = list(map(self.numbers.__getitem__, ids))
        tokens = list(map(self.tokens.__getitem__, ids))
        at = 0
        for w, n in zip(order, counts):
            to = at + n
            self.known[w] = (" ".join(numbers[at:to]), " ".join(tokens[at:to]))
            at = to

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def _merge(self, symbol: np.ndarray, ends: np.ndarray) -> None:
        """Apply all merges in place; a symbol that a merge took in becomes -1."""
        size = len(symbol)
        after = np.arange(1, size + 1)
        after[ends - 1] = -1
        before = np.arange(-1, size - 1)
        before[0:1] = -1
        before[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray, rank: np.ndarray) -> list[int]:
            """Put positions into the lists of their ranks; the ranks that had no list."""
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            fresh = []
            bounds = [0, *cuts.tolist(), len(rank)]
            for r, i, j in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    fresh.append(r)
            return fresh

        at = np.flatnonzero(after >= 0)
        rank = self._rank(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        active = enter(at, rank) if len(at) else []
        heapq.heapify(active)
        while active:
            now = heapq.heappop(active)
            left, right, whole = self.parts[now]
            lists = index.pop(now)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            n = after[at]
            at = at[(n >= 0) & (symbol[at] == left) & (symbol[n] == right)]
            if left == right and len(at) > 1:
                at = _alternate(at, after)
            if not len(at):
                continue
            n = after[at]
            beyond = after[n]
            symbol[at] = whole
            symbol[n] = -1
            after[n] = -1
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            right_at = at[has]
            right_rank = self._rank(symbol[right_at], symbol[beyond[has]])
            left_at = before[at]
            left_at = left_at[left_at >= 0]
            left_rank = self._rank(symbol[left_at], symbol[after[left_at]])
            new_at = np.concatenate((right_at, left_at))
            new_rank = np.concatenate((right_rank, left_rank))
            hit = new_rank >= 0
            if hit.any():
                for r in enter(new_at[hit], new_rank[hit]):
                    heapq.heappush(active, r)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its decimal ids joined by a space, and its tokens joined by a space."""
        cut = [self.chunks(t) for t in texts]
        fresh: set[str] = set()
        for chunks in cut:
            fresh.update(chunks)
        if self.held > CACHE_BYTES // 2:
            self.old_seen, self.old_known, self.seen, self.known, self.held = self.seen, self.known, {}, {}, 0
        missing = self._promote(fresh.difference(self.seen), self.seen, self.old_seen)
        words_missing: set[str] = set()
        if missing:
            parts = {c: self.words_of(c) for c in missing}
            words_missing = self._promote({w for words in parts.values() for w in words}.difference(self.known), self.known, self.old_known)
            self.learn(words_missing)
            known = self.known
            for c, words in parts.items():
                if len(words) == 1:
                    self.seen[c] = known[words[0]]
                elif words:
                    got = [known[w] for w in words]
                    self.seen[c] = (" ".join([g[0] for g in got]), " ".join([g[1] for g in got]))
                else:
                    self.seen[c] = None
        seen = self.seen.__getitem__
        for chunks in cut:
            got = [g for g in map(seen, chunks) if g]
            yield " ".join([g[0] for g in got]), " ".join([g[1] for g in got])
        self._trim(self.seen, missing)
        self._trim(self.known, words_missing)

    def _promote(self, wanted: set[str], cache: dict[str, tuple[str, str] | None], old: dict[str, tuple[str, str] | None]) -> set[str]:
        """Bring what the old half has into the new one; the rest of what is wanted."""
        there = wanted & old.keys()
        for c in there:
            cache[c] = old.pop(c)
        self._trim(cache, there)
        return wanted - there

    def _trim(self, cache: dict[str, tuple[str, str] | None], new: set[str]) -> None:
        """Count what new entries hold, and let go of the long ones."""
        for c in new:
            if len(c) > CACHE_LENGTH:
                del cache[c]
            else:
                got = cache[c]
                self.held += _ENTRY + len(c) + (len(got[0]) + len(got[1]) if got else 0)

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own the vocabulary's tokens are joined by a space; unknown ids have none."""
        return " ".join([t for i in ids if (t := self.tokens.get(i)) is not None])


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of a run of places where each follows the one before, as in 'aaaa', the first, third and so on."""
    follows = np.append(False, after[at[:-1]] == at[1:])
    starts = np.flatnonzero(~follows)
    offset = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[offset % 2 == 0]


def common_pattern(pattern: str) -> re.Pattern:
    """The vocabulary's pattern with its letter and number classes spelled out for the common code points."""
    common = sorted({x for c in range(0x2100) if not _COMMON.match(chr(c)) for x in chr(c) + chr(c).lower()})
    for kind in "LN":
        members = "".join(re.escape(c) for c in common if unicodedata.category(c).startswith(kind))
        pattern = pattern.replace(rf"\p{{{kind}}}", members)
    return re.compile(pattern)


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself where printable, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


_LOADED: dict[int, PairIndex] = {}


def loaded(blob: str) -> PairIndex:
    """One index per worker process and vocabulary."""
    key = hash(blob)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PairIndex(blob)
    return _LOADED[key]


#: Characters encoded at a time; a longer text is a batch of its own.
BATCH_CHARS = 2_000_000


def _runs(texts: Iterable[str]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    ``vocabulary`` is the path of a tokenizer file on the driver. One narrow pass, no shuffle.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = loaded(blob.value)
        for batch in batches:
            at = 0
            for texts in _runs(t.as_py() or "" for t in batch.column(1)):
                n, ids_hash, text_hash, ids = [], [], [], []
                for a, b in index.encode(texts):
                    n.append(a.count(" ") + 1 if a else 0)
                    ids_hash.append(hashlib.sha256(a.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(b.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.array(a.split(), np.int32))
                columns = [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.field("element", pa.int32(), False))))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text, the decoding of its ids with special tokens kept. Null ids decode to the empty text."""
    spark = encoded.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = loaded(blob.value)
        for batch in batches:
            texts = [index.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
