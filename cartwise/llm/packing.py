"""Order-preserving packing of tokenized documents into fixed-length sequences.

Every input partition is packed on its own, in the order of its rows, so no row is shuffled. Inside
a partition, window cuts are chosen by dynamic programming over document ends, sentence ends and,
within very long sentences, every ``STEP`` tokens. The cost of a plan is its padding plus a penalty
per cut that is not at a document's end. A window of at most ``length`` tokens costs its padding; a
window that is exactly a power of two long needs none. The best predecessor of a cut is the minimum
of ``cost + position`` over a sliding window, kept in a monotone queue.

The stream is planned in chunks of about ``CHUNK`` tokens; the last window of a chunk is planned
again with the next chunk. What remains at a partition's end is cut into powers of two, which need
no padding.

Null texts count as empty: such a document is its end token alone. Repeated rows are packed as often
as they occur. Extra columns are dropped. Null ids are carried along.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import itemgetter
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END_ID = 1
#: Tokens between two allowed cuts inside a sentence that is longer than this.
STEP = 128
#: Of sentence ends within this many tokens the last may be a cut.
APART = 24
#: Powers of two below this are used for a partition's end only: shorter windows help nobody.
LEAST_POWER = 512
#: Cost, in padded tokens, of a cut at a sentence end and inside a sentence.
SENTENCE_PENALTY, INSIDE_PENALTY = 4, 24
CHUNK = 400_000
SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _letters(core: str) -> bool:
    """Whether ``core`` is letters alone, also composed and in lower case as the tokenizer sees it."""
    return core.isalpha() and (core.isascii() or normalize("NFC", normalize("NFC", core).lower()).isalpha())


class Chunks(dict):
    """Ids of the parts between white space, as bytes, remembered per worker.

    The tokenizer drops white space and looks at each part alone, so a text's ids are those of its
    parts in a row. Unknown parts are encoded together, each followed by a marker of its own.
    """

    LIMIT = 700_000
    MARK = "\ue000"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._alone(self.MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def _alone(self, part: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u4")

    def learn_letters(self, parts: list[str]) -> None:
        """Parts of letters alone: each is one word, and ends with the first id that ends a word."""
        for a in range(0, len(parts), 1024):
            some = parts[a : a + 1024]
            ids = self._alone(" ".join(some))
            ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
            if len(ends) == len(some):
                raw, start = ids.tobytes(), 0
                for part, end in zip(some, ends, strict=True):
                    self[part] = raw[4 * start : 4 * end]
                    start = end
            else:  # a letter whose lower case is more than letters
                self.learn(some)

    def learn(self, parts: list[str]) -> None:
        for a in range(0, len(parts), 512):
            some = parts[a : a + 512]
            mark = f" {self.MARK} "
            ids = self._alone(mark.join(some) + mark)
            m = len(self.mark)
            at = np.flatnonzero(ids[: len(ids) - m + 1] == self.mark[0])
            for k in range(1, m):
                at = at[ids[at + k] == self.mark[k]]
            if len(at) == len(some) and not any(self.MARK in p for p in some):
                start = 0
                for part, end in zip(some, at.tolist(), strict=True):
                    self[part] = ids[start:end].tobytes()
                    start = end + m
            else:
                for part in some:
                    self[part] = self._alone(part).tobytes()

    def add(self, parts: set[str]) -> bool:
        """Know all ``parts``; true if others were forgotten for it.

        A run of letters with stops behind it is taken as two, unless a letter ends in a mark once it is
        normalised: the tokenizer keeps a mark and the stop behind it together.
        """
        emptied = len(self) > self.LIMIT
        if emptied:
            self.clear()
        cores: list[tuple[str, str, str]] = []
        letters: set[str] = set()
        other: set[str] = set()
        for part in parts:
            core = part.rstrip(".,!?")
            if _letters(core):
                tail = part[len(core) :]
                if core.isascii():
                    core = core.lower()
                if core not in self:
                    letters.add(core)
                if tail and tail not in self:
                    other.add(tail)
                if core != part:
                    cores.append((part, core, tail))
            else:
                other.add(part)
        self.learn_letters(list(letters))
        self.learn(list(other))
        for part, core, tail in cores:
            self[part] = self[core] + self[tail] if tail else self[core]
        return emptied


@lru_cache(maxsize=1)
def _chunks(path: str) -> Chunks:
    return Chunks(path)


_NOT_SPACE = "\x1c\x1d\x1e\x1f"  # str.split() would cut here, the tokenizer does not
_TO_BLANK = str.maketrans("\t\n\x0b\x0c\r", "     ")
_SLICE, _LAST = 2_000_000, itemgetter(-1)


def _parts(text: str) -> Iterator[list[str]]:
    """Runs between white space, for long texts a slice at a time."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > _SLICE:
            cut = text.find(" ", start + _SLICE)
            end = cut if cut >= 0 else end
        piece = text[start:end]
        if any(c in piece for c in _NOT_SPACE):
            yield [p for p in piece.translate(_TO_BLANK).split(" ") if p]
        else:
            yield piece.split()
        start = end


def tokens_of(text: str | None, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text with the end token, and the positions where a sentence ends."""
    known = _chunks(path)
    ids, ends, base = [], [], 0
    for parts in _parts(text or ""):
        if not parts:
            continue
        new = set(filterfalse(known.__contains__, parts))
        if new and known.add(new):
            known.add(set(parts) - new)
        raw = list(map(known.__getitem__, parts))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)).cumsum() // 4
        last = np.frombuffer("".join(map(_LAST, parts)).encode("utf-32-le", "surrogatepass"), "<u4")
        ends.append(base + sizes[(last == ord(".")) | (last == ord("!")) | (last == ord("?"))])
        ids.append(b"".join(raw))
        base += int(sizes[-1])
    ids.append(np.array([end_id], "<u4").tobytes())
    at = np.concatenate(ends) if ends else np.empty(0, np.int64)
    return np.frombuffer(b"".join(ids), "<u4"), at


def cut_places(n: int, sentence_ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places inside a document of ``n`` tokens where it may be cut, with their penalties."""
    if n <= APART:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = sentence_ends[(sentence_ends > 0) & (sentence_ends < n - 1)]  # they ascend
    marks = np.concatenate([[0], inner, [n]])
    inside = []
    for k in np.flatnonzero(marks[1:] - marks[:-1] > step):
        inside.append(np.arange(marks[k] + step, marks[k + 1], step))
    places = marks[1:-1]
    places = places[np.diff(places // APART, append=-1) != 0]  # the last of those close together
    costs = np.full(len(places), SENTENCE_PENALTY, np.int64)
    if inside:
        extra = np.concatenate(inside)
        costs = np.concatenate([costs, np.full(len(extra), INSIDE_PENALTY, np.int64)])
        places = np.concatenate([places, extra])
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    return places, costs


def choose_cuts(places: list[int], costs: list[int], length: int = LENGTH) -> list[int]:
    """Cuts of the cheapest plan over ``places`` (ascending, the last is the end); 0 is the start.

    Neighbouring places are at most ``length`` apart.
    """
    powers = [1 << k for k in range(length.bit_length()) if LEAST_POWER <= 1 << k < length]
    best, back = [0], [-1]
    index = {0: 0}
    at = [0, *places]
    queue = deque([0])  # indices with ascending best + position
    key = [0]
    for i in range(1, len(at)):
        here = at[i]
        low = here - length
        while at[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        cost = key[j] + length - here
        for p in powers:
            k = index.get(here - p)
            if k is not None and best[k] < cost:
                cost, j = best[k], k
        cost += costs[i - 1]
        best.append(cost)
        back.append(j)
        index[here] = i
        mine = cost + here
        key.append(mine)
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(i)
    cuts, i = [], len(at) - 1
    while i > 0:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1]


def split_tail(n: int, length: int) -> list[int]:
    """Window sizes that hold exactly ``n`` tokens: whole windows, then powers of two."""
    out = [length] * (n // length)
    n %= length
    while n:
        p = 1 << (n.bit_length() - 1)
        out.append(p)
        n -= p
    return out


class _Packer:
    """Plans one partition's stream; pieces come out as soon as their window is fixed."""

    def __init__(self, length: int, first_id: int):
        self.length, self.sequence = length, first_id
        self.docs: deque = deque()  # [doc_id, ids, tokens already given out]
        self.places: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        places, costs = cut_places(len(ids), sentence_ends)
        self.places.append(np.append(places, len(ids)) + self.size)
        self.costs.append(np.append(costs, 0))
        self.docs.append([doc_id, ids, 0])
        self.size += len(ids)

    def plan(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        places, costs = np.concatenate(self.places), np.concatenate(self.costs)
        cuts = choose_cuts(places.tolist(), costs.tolist(), self.length)
        if last:
            done = cuts[-2] if len(cuts) > 1 else 0
            sizes = np.diff([0, *cuts[:-1]]).tolist() + split_tail(self.size - done, self.length)
        else:
            # The two last windows lean on a made-up end; they are planned again.
            cuts = cuts[:-2]
            sizes = np.diff([0, *cuts]).tolist()
        used = sum(sizes)
        out = [piece for size in sizes for piece in self._window(size)]
        keep = places > used
        self.places, self.costs = [places[keep] - used], [costs[keep]]
        self.size -= used
        return out

    def _window(self, size: int) -> Iterator[tuple]:
        offset = 0
        while offset < size:
            doc = self.docs[0]
            doc_id, ids, start = doc
            n = min(size - offset, len(ids) - start)
            crc = zlib.crc32(ids[start : start + n].tobytes())
            yield doc_id, start, n, crc, len(ids), self.sequence, offset
            offset += n
            doc[2] += n
            if doc[2] == len(ids):
                self.docs.popleft()
        self.sequence += 1


def pack(
    docs: DataFrame, tokenizer_file: str | None = None, length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """One row per piece of a document of ``docs`` (doc_id, text).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A sequence id is the
    partition's number in the high bits and a running number in the low 32, so ids ascend in the
    order of the rows and a task that runs again gives the same ones.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = tokenizer_file

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def shown(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [id_type] + [pa.int64()] * 6
            return pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        id_type = pa.int64()
        for batch in it:
            if packer is None:
                packer = _Packer(length, TaskContext.get().partitionId() << 32)
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, *tokens_of(text.as_py(), path, end_id))
                if packer.size >= CHUNK:
                    rows = packer.plan(last=False)
                    if rows:
                        yield shown(rows, id_type)
        if packer is not None:
            rows = packer.plan(last=True)
            if rows:
                yield shown(rows, id_type)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {SCHEMA}"
    )
