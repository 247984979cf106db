"""Cost-balanced packing of tokenized documents into sequences."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessmine.llm.common import steps, utf8

#: Tokens that one task gathers before it packs them: bounds its memory, and padding to under 1 in 256.
BLOCK_TOKENS = 1 << 20
#: Words whose ids a worker remembers: beyond, the more frequent half stays.
WORDS_KEPT = 400_000
#: Bytes of text whose words are told apart in one step; a longer text is a step of its own.
TEXT_BYTES = 1 << 23
#: How the tokenizer cuts a word before it merges (fixed by its file).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A comma or stop that doesn't follow a letter or digit may be part of a longer piece.
JOINED = r"(^|[^\pL\pN])[,.]"


def words(texts: pa.Array) -> pa.ListArray:
    """Words of each text whose ids in a row are the text's, cut at ASCII white space.

    Commas and stops that can safely be so are cut off, and A-Z is lower-cased, for fewer distinct words.
    """
    # a copy that begins at its buffer's begin: ascii_lower goes wrong on slices
    data, bounds = utf8(texts)
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(data[bounds[0] : bounds[-1]]))
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    apart = texts
    for mark, cut in ((", ", " , "), (". ", " . "), (".\n", " . ")):
        apart = pc.replace_substring(apart, mark, cut)
    return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, JOINED), texts, apart))


def _byte_letters() -> dict[int, str]:
    """The letter by which the tokenizer writes each byte: itself if it is visible, else the next one after 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds:
    """Ids of whole texts, by way of each distinct word's ids.

    The tokenizer drops white space and never merges across it, so a text's ids are its
    words' ids in a row. A word of lower-case letters is one piece, which goes straight to
    the merges. Other new words are encoded many at a time, joined by blanks; as each piece
    of a word ends with one word-end token, the joined ids can be told apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.letters = regex.compile(PIECES), _byte_letters()
        # the empty word, which comes of white space at an end, has no ids
        self.index: dict[str, int] = {"": 0}
        self.flat, self.start, self.uses = np.zeros(0, np.uint32), np.zeros(2, np.int64), np.ones(1, np.int64)

    def forget(self) -> None:
        """Keep the half that was used most."""
        names, sizes = list(self.index), np.diff(self.start)
        stay = np.sort(np.concatenate([[0], 1 + np.argsort(-self.uses[1:], kind="stable")[: WORDS_KEPT // 2]]))
        self.flat = self.flat[np.repeat(np.isin(np.arange(len(sizes)), stay), sizes)]
        self.start = np.concatenate([[0], np.cumsum(sizes[stay])])
        self.uses = self.uses[stay] // 2
        self.index = {names[k]: n for n, k in enumerate(stay.tolist())}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _count(self, word: str) -> int:
        """Pieces in a word, or 0 if only the tokenizer can tell."""
        if word.isalpha():
            return 1 if "İ" not in word else 0
        if word[-1] in ".,;:!?" and word[:-1].isalpha() and "İ" not in word:
            return 2
        if word.isascii():
            if not word.isprintable() or any(s in word for s in self.special):
                return 0
            return len(self.pieces.findall(word.lower()))
        if "İ" in word or not regex.fullmatch(r"[\p{L}\p{N}\p{P}\p{S}]+", word):
            return 0
        return len(self.pieces.findall(word)) if unicodedata.is_normalized("NFC", word) else 0

    def _plain(self, word: str) -> list[int] | None:
        """The ids of a word of lower-case letters, not all of them ASCII; nothing for another word."""
        if not (word.isalpha() and word.islower() and unicodedata.is_normalized("NFC", word)):
            return None
        return [x.id for x in self.merges.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def _joined(self, new: list[str]) -> list[np.ndarray]:
        """The ids of each word, many being encoded as one text where their pieces can be counted."""
        out: list[np.ndarray] = []
        groups = [new[k : k + 512] for k in range(0, len(new), 512)]
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            counts = [self._count(w) for w in group]
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(counts) - 1
            if all(counts) and len(ends) == last[-1] + 1 and ends[-1] == len(ids):
                out += np.split(ids, ends[last][:-1])
            else:
                out += self._encoded(group)
        return out

    def learn(self, new: list[str]) -> None:
        """The ids of new words, in their order."""
        tokenize = self.merges.tokenize
        own = [([x.id for x in tokenize(w)] if w.islower() and w.isalpha() else None) if w.isascii() else self._plain(w) for w in new]
        rest = [k for k, x in enumerate(own) if x is None]
        for k, ids in zip(rest, self._joined([new[k] for k in rest]), strict=True):
            own[k] = ids.tolist()
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in own])])
        self.flat = np.concatenate([self.flat, np.array([i for x in own for i in x], np.uint32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.index) > WORDS_KEPT:
            self.forget()
        docs = words(texts)
        coded = docs.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [x for x in names if x not in self.index]:
            self.learn(new)
        place = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        rows = place[np.asarray(coded.indices)]
        self.uses += np.bincount(rows, minlength=len(self.uses))
        ids = pa.ListArray.from_arrays(pa.array(self.start, pa.int32()), pa.array(self.flat)).take(pa.array(rows))
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(docs)))])
        cuts = np.asarray(ids.offsets)[ends] - ids.offset
        flat = np.asarray(ids.flatten())
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker process."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def cost(length: np.ndarray | int, linear: float = 1.0, quadratic: float = 1 / 4096) -> np.ndarray | float:
    """What attention over a piece costs, in units of a token's linear part."""
    return length * (linear + quadratic * length)


def assign(lengths: np.ndarray, capacity: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths.

    There are as many sequences as the tokens need; what is beyond full ones goes to
    sequences of powers of two, so that nothing is padded. Pieces of a full sequence are
    cut off first. The others, longest first, go to the cheapest sequence with room
    enough; one that fits nowhere is cut to fill the emptiest, and its rest goes on.
    """
    total = int(lengths.sum())
    full, rest = divmod(total, capacity)
    sizes = [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    out: list[tuple[int, int, int, int, int]] = []
    used, begin, left = 0, [0] * len(lengths), lengths.astype(np.int64).tolist()
    for d in np.argsort(-lengths, kind="stable").tolist():
        while left[d] >= capacity:
            out.append((d, begin[d], capacity, used, 0))
            begin[d], left[d], used = begin[d] + capacity, left[d] - capacity, used + 1
    room = np.array(sizes[used:], np.int64)
    filled, spent = np.zeros(len(room), np.int64), np.zeros(len(room))
    for d in sorted((d for d in range(len(left)) if left[d]), key=lambda d: (-left[d], d)):
        while left[d]:
            fits = np.where(room >= left[d], spent, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(room.argmax())
            n = min(left[d], int(room[s]))
            out.append((d, begin[d], n, used + s, int(filled[s])))
            begin[d], left[d] = begin[d] + n, left[d] - n
            room[s] -= n
            filled[s] += n
            spent[s] += cost(n)
    return out


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most ``capacity`` tokens.

    A null text is empty: its one token is ``end_id``. Each partition packs its own
    documents, block by block, so nothing is shuffled and a task holds one block (and one
    document) at most. Sequence ids carry the partition's number; repeated rows and null
    doc_ids are packed like any other row, each for itself: pieces of rows that share a
    doc_id can't be told apart by it, only by sequence_id and offset. Other columns, whatever
    their names, are not read; an empty table gives no row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, context = word_ids(tokenizer), TaskContext.get()
        base = context.partitionId() << 36
        names: list = []
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, waiting
            lengths = np.array([len(x) for x in held], np.int64)
            rows = sorted(assign(lengths, capacity), key=lambda r: (r[3], r[4]))
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            crcs = [zlib.crc32(held[a][b : b + n].astype("<u4", copy=False).tobytes()) for a, b, n, _, _ in rows]
            tokens = np.bincount(sequence, weights=length).astype(np.int64)[sequence]
            cols = [pa.array([names[a] for a in d.tolist()], id_type), *map(pa.array, (start, length, np.array(crcs, np.int64), lengths[d], base + sequence, offset, tokens))]
            if with_ids:
                cols.append(pa.array([held[a][b : b + n].astype(np.int64) for a, b, n, _, _ in rows], pa.list_(pa.int64())))
            base += int(sequence.max()) + 1
            names.clear()
            held.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", *(x.split()[0] for x in PIECE.split(", ")), *["ids"] * with_ids])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in steps(utf8(texts)[1], TEXT_BYTES):
                for name, own in zip(ids[i:j], ids_of(texts.slice(i, j - i)), strict=True):
                    names.append(name)
                    held.append(np.append(own, np.uint32(end_id)))
                    waiting += len(own) + 1
                    if waiting >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECE}" + ", ids array<bigint>" * with_ids)
