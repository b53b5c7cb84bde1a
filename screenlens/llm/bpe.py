"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's frequent words are compiled, with their token ids, into a transducer whose equal
suffixes share states: each arc carries a number, and the sum of the numbers on a word's path is the
word's place in the table of id lists. The transducer is one flat block of arrays; workers get it
by broadcast (its size is bounded by `lexicon_words`), put it in an unlinked file and map that
into memory. Batches of words walk it together in numpy. Words it lacks are merged exactly, so
the lexicon has no influence on results. The tokenizer file is only read, never trained.

Defined results: a null text counts as empty and has no token; texts are encoded whole; the special
tokens' strings become their ids; a word of any length is merged exactly; words of equal numbers go to the lexicon in their order; an empty table gives an empty one; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import heapq
import json
import mmap
import re
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, release, tidy, tune

LEXICON_WORDS = 120_000
#: Distinct words whose ids a worker remembers, and that a task counts before it gives what it has.
REMEMBERED, COUNTED = 120_000, 250_000
#: Characters of the longest word that the lexicon takes or a worker remembers; longer ones are merged each time.
LONGEST = 64
SCHEMA = "ids binary, decoded string"
NAME = "word_bpe_49k.json"


def tokenizer_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(first: str) -> str:
    """A character class of the code points under 256 whose category starts with `first`."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == first)


_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
LATIN_PIECE = re.compile(rf"{_CLITICS}|[{_latin('L')}]+|[{_latin('N')}]|[^\t-\r\x20\x85\xa0{_latin('L')}{_latin('N')}]+")
#: Over a text's class letters: those of clitics stand for themselves.
CLASS_PIECE = re.compile(f"{_CLITICS}|[Lstrevmld]+|N|[O']+")


class Classes(dict):
    """Code point to class letter; asks the tokenizer file's own splitter once for each code point."""

    def __init__(self, split):
        super().__init__({ord(c): c for c in "strevmld'"})
        self.split = split

    def __missing__(self, code: int) -> str:
        c = chr(code)
        alone = len(self.split(c + c))
        self[code] = out = " " if not alone else "N" if alone == 2 else "L" if len(self.split("a" + c)) == 1 else "O"
        return out


class Splitter:
    """Normalises and splits texts into words as a tokenizer file says.

    Latin-1 text goes by one expression. For other text the library normalises, and tells the class
    of each new code point, so that Unicode versions can't differ.
    """

    def __init__(self, path: str):
        self.path, self.normal = path, None

    def load(self) -> None:
        """The library's tokenizer takes much memory, and most workers never meet text that needs it."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        self.normal, self.classes = t.normalizer.normalize_str, Classes(t.pre_tokenizer.pre_tokenize_str)

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.normal is None:
                self.load()
            text = self.normal(text)
            return [text[m.start() : m.end()] for m in CLASS_PIECE.finditer(text.translate(self.classes))]
        return LATIN_PIECE.findall(text.lower())


class Merges:
    """Vocabulary and ranked merges of a tokenizer file; merges one word exactly."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        odd = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255)]
        shown = {c: chr(256 + odd.index(c)) if c in odd else chr(c) for c in range(256)}
        self.inner = [vocab[shown[c]] for c in range(256)]
        self.last = [vocab[shown[c] + end] for c in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with options are not supported")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t

    def word(self, word: bytes) -> list[int]:
        ids = [self.inner[c] for c in word[:-1]] + [self.last[word[-1]]]
        get = self.merge.get
        if len(ids) > 50:
            return self.long_word(ids)
        while len(ids) > 1:
            best, at = None, 0
            for k in range(len(ids) - 1):
                m = get((ids[k], ids[k + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids


    def long_word(self, ids: list[int]) -> list[int]:
        """The same merges in n log n steps: pairs wait in a heap by rank and place; a pair that changed meanwhile is passed over."""
        get, n = self.merge.get, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple] = []

        def wait(a: int) -> None:
            b = after[a]
            m = get((ids[a], ids[b])) if b >= 0 else None
            if m is not None:
                heapq.heappush(heap, (m[0], a, ids[a], ids[b], m[1]))

        for a in range(n - 1):
            wait(a)
        while heap:
            _, a, x, y, new = heapq.heappop(heap)
            b = after[a]
            if ids[a] != x or b < 0 or ids[b] != y:
                continue
            ids[a], ids[b] = new, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            if before[a] >= 0:
                wait(before[a])
            wait(a)
        return [i for i in ids if i >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of the words, as one block."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    final: list[bool] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs_of)
            arcs_of.append(key[1])
            final.append(key[0])
        return state

    # A path holds the not yet settled states of the last word: [final, [(byte, state)], byte into it].
    path: list[list] = [[False, [], -1]]
    previous = b""
    ordered = sorted(words)
    for w in ordered:
        common = 0
        for x, y in zip(w, previous):  # noqa: B905
            if x != y:
                break
            common += 1
        while len(path) > common + 1:
            done = path.pop()
            path[-1][1].append((done[2], settle(done)))
        for c in w[common:]:
            path.append([False, [], c])
        path[-1][0] = True
        previous = w
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((done[2], settle(done)))
    root = settle(path[0])
    count = np.zeros(len(arcs_of), dtype=np.int64)
    key, target, add = [], [], []
    for s, arcs in enumerate(arcs_of):
        n = int(final[s])
        for c, t in arcs:
            key.append(s << 8 | c)
            target.append(t)
            add.append(n)
            n += int(count[t])
        count[s] = n
    lists = [words[w] for w in ordered]
    ptr = np.cumsum([0, *map(len, lists)])
    head = np.array([len(key), len(final), len(ordered), int(ptr[-1]), root], dtype=np.int64)
    parts = [head, np.array(key, np.int64), ptr.astype(np.int64), np.array(target, np.int32), np.array(add, np.int32), np.array([i for x in lists for i in x], np.int32), np.array(final, np.uint8)]
    return b"".join(x.tobytes() for x in parts)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(block), access=mmap.ACCESS_READ)
        arcs, states, words, ids, self.root = np.frombuffer(self.map, np.int64, 5).tolist()
        at = 40

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(self.map, kind, n, at)
            at += out.nbytes
            return out

        self.key, self.ptr = take(np.int64, arcs), take(np.int64, words + 1)
        self.target, self.add, self.ids = take(np.int32, arcs), take(np.int32, arcs), take(np.int32, ids)
        self.final = take(np.uint8, states)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, -1 if it is not in the lexicon; all words walk together."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        state = np.full(len(words), self.root, dtype=np.int64)
        place = np.zeros(len(words), dtype=np.int64)
        live = np.arange(len(words)) if len(self.key) else np.zeros(0, np.int64)
        if not len(self.key):
            state[:] = -1
        for step in range(int(size.max(initial=0))):
            live = live[size[live] > step]
            if not len(live):
                break
            k = state[live] << 8 | flat[start[live] + step]
            i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[i] == k
            state[live[~hit]] = -1
            live, i = live[hit], i[hit]
            state[live] = self.target[i]
            place[live] += self.add[i]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] > 0
        return np.where(ok, place, -1)

    def word_ids(self, place: int) -> np.ndarray:
        return self.ids[self.ptr[place] : self.ptr[place + 1]]


class Codec:
    def __init__(self, path: str, block: bytes):
        self.merges, self.lexicon, self.known = Merges(path), Lexicon(block), {}
        self.pieces = Splitter(path).pieces
        self.tokens = np.array(self.merges.token, dtype=object)

    def learn(self, new: list[str]) -> None:
        """Remember the ids of new words: from the lexicon, or merged."""
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, raw, p in zip(new, coded, self.lexicon.places(coded).tolist(), strict=True):
            ids = self.lexicon.word_ids(p) if p >= 0 else np.array(self.merges.word(raw), dtype=np.int32)
            self.known[w] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        runs: list[list] = []
        for t in texts:
            parts = self.merges.split.split(t) if t and self.merges.split and "<" in t else [t or ""]
            runs.append([(p, None) if p in self.merges.special else (p, self.pieces(p)) for p in parts if p])
        need = set().union(*(x for run in runs for _, x in run if x is not None))
        if len(self.known) + len(need) > REMEMBERED:
            self.known = {}
        self.learn([w for w in need if w not in self.known])
        get = self.known.__getitem__
        long = [w for w in need if len(w) > LONGEST]
        special = lambda p: int(self.merges.special[p]).to_bytes(4, "little")
        out = [b"".join(special(p) if x is None else b"".join(map(get, x)) for p, x in run) for run in runs]
        for w in long:
            del self.known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces: the tokenizer has no decoder of its own."""
        return " ".join(self.tokens[np.frombuffer(ids, dtype="<u4")])


@functools.lru_cache(1)
def _codec(path: str, key: int, block: Broadcast) -> Codec:
    return Codec(path, block.value)


CACHES.append(_codec.cache_clear)


def groups(texts: list[str | None], limit: int = 500_000):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def codec_udf(path: str, block: Broadcast, key: int):
    """Arrow UDF: text to struct<ids, decoded>; decoded comes from the ids."""

    @F.arrow_udf(SCHEMA)
    def code(text: pa.Array) -> pa.Array:
        codec = _codec(path, key, block)
        ids = [x for part in groups(text.to_pylist()) for x in codec.encode(part)]
        out = pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], ["ids", "decoded"])
        del ids
        release()
        return out

    return code.asNondeterministic()


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): parts of the numbers of all words of docs (text) of up to LONGEST characters; a task gives what it counted whenever it holds COUNTED words."""

    def count(batches):
        c: collections.Counter = collections.Counter()
        pieces = Splitter(path).pieces

        def out():
            found = [x for x in c.items() if len(x[0]) <= LONGEST]
            for k in range(0, len(found), 20_000):
                part = found[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])
            c.clear()

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    c.update(pieces(t))
                if len(c) > COUNTED:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(tidy(count), "word string, n long")


def lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """Compile the corpus's most frequent words, `words` at most."""
    counted = word_counts(docs, path).groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(words).select("word")
    merges = Merges(path)
    return compile_lexicon({w: merges.word(w) for w in (r.word.encode("utf-8", "surrogatepass") for r in top.toLocalIterator())})


def udf_for(spark: SparkSession, docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS):
    """The UDF with a lexicon of the rows of docs (text)."""
    tune(spark)
    path = path or tokenizer_path()
    block = lexicon(docs, path, words)
    return codec_udf(path, spark.sparkContext.broadcast(block), hash(block))


def code(spark: SparkSession, docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded of every row of docs (doc_id, text)."""
    udf = udf_for(spark, docs, path, words)
    return docs.select("doc_id", udf("text").alias("r")).select("doc_id", "r.*")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of `code`."""
    return result.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
