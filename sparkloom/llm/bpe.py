"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The most frequent words of the whole corpus, counted by Spark, are encoded once and compiled into a minimal acyclic automaton
whose arcs carry numbers that add up to the word's rank; the rank points to its ids. Suffixes are shared. The file goes to the
executors with SparkContext.addFile and is memory-mapped there. Words that it lacks are merged exactly by the vocabulary's
rules. A run's new words are looked up together, a letter of each at a time, and those that the lexicon lacks merged together, a merge
of each at a time. The vocabulary file is read on the executors from `path`, a parameter.

Cases: a null text is the empty text and gets no ids; special tokens that stand in a text get their id; a very long word is
merged with a heap; ties for a lexicon place go to the smaller word; rows that repeat a doc_id are encoded each; empty table,
empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._base import documents, stored, text_of
from sparkloom.llm._hashes import chunks

LEXICON_WORDS = 50_000
MIN_COUNT = 3
#: Keys of one generation; two are held, of words and of pieces.
CACHED = 100_000
#: A space before anything but white space begins a new token of the pattern, whatever stands around it: texts are cut there.
CUT = re.compile(r" (?=\S)")
#: Where a space isn't followed by such, plain splitting at spaces would cut elsewhere.
UNEVEN = re.compile(r" (?!\S)")
RUN_CHARS = 1 << 20
#: No rank.
NONE = np.iinfo(np.int32).max
#: Longer words, in bytes, are merged by themselves.
TOGETHER = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others,
    in order, for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairTable:
    """Numbers of distinct keys, found for many keys at once: open addressing, the next slot where a slot is another key's."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.values[at], NONE)
        left = np.flatnonzero((have != keys) & (have >= 0))
        while len(left):
            at_left = at[left] = (at[left] + 1) & self.mask
            have = self.keys[at_left]
            hit = have == keys[left]
            out[left[hit]] = self.values[at_left[hit]]
            left = left[~hit & (have >= 0)]
        return out


class Vocabulary:
    """Merges, ids and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in letters]
        self.table: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the id that a rank's merge gives
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        size, pairs = len(self.made) + len(vocab), list(self.ranks)
        self.width = max(size, max(self.table) + 1)
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        self.pairs = PairTable(keys, np.array(list(self.ranks.values()), np.int32))
        self.byte_array, self.made_array = np.array(self.byte_ids, np.int64), np.array([*self.made, 0], np.int64)
        both = np.arange(65536)
        self.byte_ranks = self.ranks_of(self.byte_array[both >> 8], self.byte_array[both & 255])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table.update({i: t.encode() for t, i in self.special.items()})
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NONE for those that aren't merged."""
        return self.pairs.find(a * self.width + b)

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge of each word: all words' letters lie in one array, and in each round every word has its best pair merged."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        own, ids = np.repeat(np.arange(len(words)), size), self.byte_array[data]
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(own[1:] == own[:-1])
        rank[inner] = self.byte_ranks[(data[inner] << 8) | data[inner + 1]]
        done = []
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(own))))
            over = best == NONE
            if over.any():
                done.append((own[over], ids[over]))
                own, ids, rank, best = (x[~over] for x in (own, ids, rank, best))
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == best)
            at = hit[np.concatenate(([True], own[hit][1:] != own[hit][:-1]))]  # the leftmost of each word
            ids[at] = self.made_array[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            own, ids, rank = own[keep], ids[keep], rank[keep]
            at -= np.arange(len(at))
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(own))]
                same = own[left] == own[left + 1]
                left = left[same]
                rank[left] = self.ranks_of(ids[left], ids[left + 1])
            # a word's last letter has no pair
            rank[at[(at + 1 >= len(own)) | (own[np.minimum(at + 1, len(own) - 1)] != own[at])]] = NONE
        owner, flat = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat = flat[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [tuple(flat[lo:hi]) for lo, hi in zip([0, *ends], ends)]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Lowest rank first, then leftmost; only the pairs beside a merge are looked up again."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > TOGETHER:
            return self._merge_long(ids)
        rank, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k] = made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a linked list and a heap."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap = [(f, k, ids[k], ids[k + 1]) for k in range(n - 1) if (f := ranks.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            f, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = self.made[f], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (f := ranks.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (f, left, ids[left], ids[right]))
        return tuple(i for i in ids if i >= 0)

    def pieces(self, text: str):
        """(special id or None, text) of the parts between special tokens."""
        if self.cut is None or not self.cut.search(text):
            yield None, text
            return
        for part in self.cut.split(text):
            if part in self.special:
                yield self.special[part], part
            elif part:
                yield None, part


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The automaton's file. Words are added in order; what can no longer change is replaced by an equal state, if there is one."""
    words = sorted(entries)
    final: list[bool] = [False]
    arcs: list[dict[int, int]] = [{}]
    known: dict = {}
    stack: list[tuple[int, int, int]] = []  # parent, label, child, of the last word's path

    def settle(depth: int) -> None:
        while len(stack) > depth:
            parent, label, child = stack.pop()
            key = (final[child], tuple(arcs[child].items()))
            arcs[parent][label] = known.setdefault(key, child)

    last = b""
    for w in words:
        common = next((k for k, (x, y) in enumerate(zip(w, last)) if x != y), min(len(w), len(last)))
        settle(common)
        node = stack[-1][2] if stack else 0
        for b in w[common:]:
            arcs.append({})
            final.append(False)
            arcs[node][b] = child = len(arcs) - 1
            stack.append((node, b, child))
            node = child
        final[node] = True
        last = w
    settle(0)
    # number of words below each state, children first; then states in the order of discovery
    below: dict[int, int] = {}
    todo = [(0, False)]
    while todo:
        node, done = todo.pop()
        if done:
            below[node] = final[node] + sum(below[c] for c in arcs[node].values())
        elif node not in below:
            todo.append((node, True))
            todo += [(c, False) for c in arcs[node].values() if c not in below]
    place, order = {0: 0}, [0]
    for node in order:
        for c in arcs[node].values():
            if c not in place:
                place[c] = len(order)
                order.append(c)
    first, labels, goes, adds = [0], bytearray(), [], []
    for node in order:
        rank = int(final[node])
        for label, c in sorted(arcs[node].items()):
            labels.append(label)
            goes.append(place[c])
            adds.append(rank)
            rank += below[c]
        first.append(len(goes))
    ids = [entries[w] for w in words]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype("<u4")
    parts = [
        np.array(first, "<u4").tobytes(), np.array(goes, "<u4").tobytes(), np.array(adds, "<u4").tobytes(), starts.tobytes(),
        np.array([i for x in ids for i in x], "<u4").tobytes(), bytes(bytearray(final[n] for n in order)), bytes(labels),
    ]
    return struct.pack("<7Q", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A memory-mapped automaton; get(word) gives its ids or None."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, at = memoryview(self.map), 56
        sizes = struct.unpack("<7Q", self.map[:56])
        parts = []
        for size in sizes:
            parts.append(view[at : at + size])
            at += size
        self.first, self.goes, self.adds, self.starts, self.ids = (p.cast("I") for p in parts[:5])
        self.final = parts[5]
        self.labels_at = at - sizes[6]
        count = np.diff(np.frombuffer(self.first, np.uint32).astype(np.int64))
        self.arcs = np.append(np.repeat(np.arange(len(count)), count) * 256 + np.frombuffer(parts[6], np.uint8), np.iinfo(np.int64).max)

    def get(self, word: bytes):
        node = rank = 0
        first, goes, adds, find, base = self.first, self.goes, self.adds, self.map.find, self.labels_at
        for k in range(len(word)):
            lo, hi = first[node], first[node + 1]
            at = find(word[k : k + 1], base + lo, base + hi) - base
            if at < 0:
                return None
            rank += adds[at]
            node = goes[at]
        if not self.final[node]:
            return None
        return tuple(self.ids[self.starts[rank] : self.starts[rank + 1]])


    def get_all(self, words: list[bytes]) -> list:
        """get of each word: all go an arc on together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        goes, adds = np.append(np.frombuffer(self.goes, np.uint32), 0), np.append(np.frombuffer(self.adds, np.uint32), 0)
        node, rank, live = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        ends = []
        for k in range(int(size.max(initial=0)) + 1):
            over = size[live] == k
            ends.append(live[over])
            live = live[~over]
            if not len(live):
                break
            key = node[live] * 256 + data[start[live] + k]
            at = np.searchsorted(self.arcs, key)
            known = self.arcs[at] == key
            live, at = live[known], at[known]
            rank[live] += adds[at]
            node[live] = goes[at]
        out: list = [None] * len(words)
        whole = np.concatenate(ends)
        whole = whole[np.frombuffer(self.final, np.uint8)[node[whole]] > 0]
        starts, ids = self.starts, self.ids
        for w, r in zip(whole.tolist(), rank[whole].tolist()):
            out[w] = tuple(ids[starts[r] : starts[r + 1]])
        return out


class Kept(dict):
    """What make(key) gave, for the keys used last: of two generations of CACHED keys the older one is dropped."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.older.pop(key, None)
        if ids is None:
            ids = self.make(key)
        if len(key) <= 64:
            self.put(key, ids)
        return ids

    def put(self, key: str, ids: tuple[int, ...]) -> None:
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[key] = ids

    def has(self, key: str) -> bool:
        return key in self or key in self.older


class Encoder:
    """Texts to ids and back. Words are found in the lexicon or merged; words and pieces of text after a space are kept."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.kept_words, self.kept_pieces = Kept(self._word), Kept(lambda piece: self.words(" " + piece))
        self.word, self.piece = self.kept_words.__getitem__, self.kept_pieces.__getitem__
        ids = range(max(vocabulary.table) + 1)
        self.strings = pa.array([vocabulary.table.get(i, b"") for i in ids], pa.binary())

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        found = self.lexicon.get(raw) if self.lexicon else None
        return self.vocabulary.merge(raw) if found is None else found

    def learn(self, words) -> None:
        """Keeps the ids of words that aren't kept yet."""
        new = [w for w in dict.fromkeys(words) if not self.kept_words.has(w) and len(w) <= TOGETHER]
        raw = [w.encode("utf-8") for w in new]
        found = self.lexicon.get_all(raw) if self.lexicon else [None] * len(raw)
        rest = [k for k, ids in enumerate(found) if ids is None and len(raw[k]) <= TOGETHER]
        for k, ids in zip(rest, self.vocabulary.merge_all([raw[k] for k in rest])):
            found[k] = ids
        for w, ids in zip(new, found):
            if ids is not None:
                self.kept_words.put(w, ids)

    def words(self, part: str) -> tuple[int, ...]:
        return tuple(itertools.chain.from_iterable(map(self.word, self.vocabulary.words.findall(part))))

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for special, part in self.vocabulary.pieces(text):
            if special is not None:
                parts.append(np.array([special], np.int32))
                continue
            first, *rest = CUT.split(part)
            parts.append(np.fromiter(itertools.chain(self.words(first), itertools.chain.from_iterable(map(self.piece, rest))), np.int32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.int32)])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where texts begin and end. Each distinct piece of the run is looked up once, and Arrow
        puts the pieces' ids in place; texts with special tokens or uneven spaces are encoded by themselves."""
        special = self.vocabulary.cut
        even = [not (UNEVEN.search(t) or (special is not None and special.search(t))) for t in texts]
        split = pc.split_pattern(pa.array([t if e else "" for t, e in zip(texts, even)], pa.string()), " ")
        begins = split.offsets.to_numpy()[:-1]
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a text's first piece has no space before it
        codes[begins] = len(pieces) + np.arange(len(texts))
        # letters alone are one word of the pattern, kept as such; of other new pieces the pattern is asked once
        word, piece, known, pattern = self.word, self.piece, self.kept_pieces.has, self.vocabulary.words.findall
        spaced, alone = [" " + p for p in pieces], list(map(str.isalpha, pieces))
        fresh = {p: pattern(w) for p, w, one in zip(pieces, spaced, alone) if not (one or known(p))}
        self.learn(itertools.chain(itertools.compress(spaced, alone), itertools.chain.from_iterable(fresh.values())))
        for p, words in fresh.items():
            if len(p) <= 64:
                self.kept_pieces.put(p, tuple(itertools.chain.from_iterable(map(word, words))))
        table = [word(w) if one else piece(p) for p, w, one in zip(pieces, spaced, alone)]
        firsts = [self.words(t.split(" ", 1)[0]) if e else self.encode(t) for t, e in zip(texts, even)]
        table += firsts
        sizes = np.fromiter(map(len, table), np.int32, len(table))
        ids = np.fromiter(itertools.chain.from_iterable(table), np.int32, int(sizes.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))
        flat = lists.take(pa.array(codes)).flatten().to_numpy()
        upto = np.concatenate(([0], np.cumsum(sizes[codes], dtype=np.int64)))
        return flat, upto[np.concatenate((begins, [len(codes)]))].astype(np.int32)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids that lie one after another; ends: where lists begin and end. Bytes that aren't UTF-8 are replaced."""
        found = self.strings.take(pa.array(ids))
        offsets = np.frombuffer(found.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        texts = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets[ends]), found.buffers()[2]])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.string())


_LOADED: dict = {}


def _encoder(path: str, lexicon: str | None) -> Encoder:
    key = (path, lexicon)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Vocabulary(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _LOADED[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of letters only stands after white space in the whole corpus."""

    def count(batches):
        seen: Counter = Counter()

        def flush():
            # what stands only once here is carried too: the sums are over all documents
            words = [w for w in seen if w.isalpha() and len(w) <= 32]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(text.as_py().split())
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    found = docs.select(text_of().alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, min_count: int = MIN_COUNT) -> str:
    """Compile the corpus's `words` most frequent words, with the space before them; the file's name under SparkFiles. At most `words` rows reach the driver."""
    counts = stored(word_counts(docs).filter(F.col("n") >= min_count))
    # the least count whose words still fit, from a table of counts; equal counts are in or out together
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).withColumn("above", F.sum("m").over(Window.orderBy(F.desc("n"))))
    least = by_count.filter(F.col("above") <= words).agg(F.min("n").alias("n")).first()["n"]
    top = counts.filter(F.col("n") >= least).collect() if least is not None else []
    vocabulary = Vocabulary(path)
    spaced = [w.encode() for r in top for w in vocabulary.words.findall(f" {r['word']}")]
    name = f"lexicon-{uuid.uuid4().hex}"
    file = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(file, "wb") as f:
        f.write(compile_lexicon({w: vocabulary.merge(w) for w in spaced}))
    docs.sparkSession.sparkContext.addFile(file)
    return name


def encode(docs: DataFrame, path: str | None = None, lexicon: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int>; with decoded also the text that the ids decode to. One pass over the texts."""
    path = path or default_path()
    lexicon = lexicon or build_lexicon(docs, path)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded

    def run(batches):
        encoder = _encoder(path, lexicon)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                part = whole.slice(begin, 1024)
                for at, texts in chunks(part.column(1).to_pylist(), RUN_CHARS):
                    flat, ends = encoder.encode_all(texts)
                    columns = [part.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                    if decoded:
                        columns.append(encoder.decode(flat, ends))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids."""
    path = path or default_path()
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        encoder = _encoder(path, None)
        for batch in batches:
            lists = [np.array(x.as_py() or [], np.int32) for x in batch.column(1)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            texts = encoder.decode(np.concatenate(lists) if lists else np.zeros(0, np.int32), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def query(spark, sf_dir):
    rows = encode(documents(spark, sf_dir), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
