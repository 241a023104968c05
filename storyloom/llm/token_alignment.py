"""Cross-tokenizer alignment: groups and links of a byte-level BPE's tokens (A) and a SentencePiece model's pieces (B) over the same bytes.

Words are aligned, not documents. A word starts at blanks before a sign, or at a line break between two signs, if the sign before it is no white
space. There neither tokenizer joins anything: A's pattern starts a new piece, and B has no piece with a blank or a line break after another
sign (``Models`` checks that). So both encode a text as they encode its words one by one, both end a token there, and groups, links and counts of a document are
those of its words in turn. A distinct word is encoded once for as long as the worker remembers it. Texts for which that gives other bytes are encoded whole once more.

Link counts of the corpus come back by chunks of documents: a chunk asks once for each of its pairs of ids, so a pair that every document
has is a row a chunk, and no document's links are shuffled one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table

FOLDER = "/opt/tokenizers"
#: Characters of text that make a chunk, that are encoded at once, and of words that a worker remembers.
CHUNK_CHARS, BLOCK_CHARS, REMEMBERED = 2_000_000, 2_000, 2_000_000
#: Blocks that are aligned in one go; the word that opens each, as B puts a blank before it.
BLOCKS, OPENER = 64, " a"

_ODD = re.compile(r"\s(?:\s|\Z)")
_WORDS = re.compile(r"(?<=\S)(?= +\S|\n\S)")
_PARTS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, first long, n_words long, words binary, sizes binary, links binary, pairs array<long>, times array<long>"
_KINDS = [*[pa.int64()] * 6, pa.string(), *[pa.int64()] * 2, *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]


def byte_signs() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 signs for themselves, the others counted up from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Models:
    """Both tokenizers, the bytes of their tokens and the names of their ids as they stand in a digest."""

    def __init__(self, byte_bpe: str, piece_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        signs, spec = byte_signs(), json.loads(byte_bpe)
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        by_id = {i: t for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [added.get(i) or bytes(signs[c] for c in by_id[i]) for i in range(max([*by_id, *added]) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece holds a blank or a line break after another sign, so words can't be encoded one by one")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.a_names = np.array([[f"{s}{i}" for i in range(len(self.a_bytes))] for s in ",;\n"], object)
        self.b_names = np.array([[f"{s}{i}" for i in range(len(self.b_bytes))] for s in ",|"], object)

    def encode(self, blocks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids and (start, end) characters of A and of B, for texts that start with the blank which B adds itself."""
        b = self.b.encode([x[1:] for x in blocks], return_type="offset_mapping", num_threads=1)
        for x, y in zip(self.a.encode_batch(blocks, add_special_tokens=False), b, strict=True):
            yield np.array(x.ids, np.int64), np.array(x.offsets, np.int64).reshape(-1, 2), np.array(y["ids"], np.int64), np.array(y["offsets"], np.int64).reshape(-1, 2)


@lru_cache(maxsize=1)
def models(byte_bpe: str, piece_model: bytes) -> Models:
    return Models(byte_bpe, piece_model)


def byte_places(text: str) -> np.ndarray:
    """Where each character starts in UTF-8, and the text's end."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))]).astype(np.int64)


def token_ends(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens. ``coarse``: (start, end) bytes of the characters that each is said to cover; they hold for tokens that are as
    long as their decoded bytes and start where the one before ends. Tokens that share a character (its bytes are several
    tokens, of which each, or only the last, is said to cover it) are laid out by decoded bytes from the last sure end on."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    starts, ends = coarse[:, 0], coarse[:, 1]
    before = np.concatenate([[0], ends[:-1]])
    sure = (ends - starts == sizes) & (starts == before)
    at = np.arange(len(sizes))
    last = np.maximum.accumulate(np.where(sure, at, -1))
    laid = np.cumsum(sizes)
    base, gone = np.append(ends, 0)[last], np.append(laid, 0)[last]
    return base + laid - gone


class Aligned:
    """Digests and links of the words that this worker has aligned, by slot. A word is known by its text, without the blank if it starts with just one;
    one that a model can't give back has no tokens."""

    def __init__(self, made: Models) -> None:
        self.models = made
        self.slot: dict[str, int] = {}
        self.digest: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.links = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)
        self.chars = 0

    def forget(self) -> None:
        """Keep only words that were seen again."""
        keep = np.flatnonzero(self.seen > 1)
        known, self.links = list(self.slot), self.links_of(keep)
        self.slot = {known[old]: new for new, old in enumerate(keep.tolist())}
        self.digest = [self.digest[i] for i in keep.tolist()]
        self.counts, self.seen = self.counts[keep], np.zeros(len(keep), np.int64)
        self.chars = sum(map(len, self.slot))

    def links_of(self, slots: np.ndarray) -> np.ndarray:
        """Links of the slots, one after the other."""
        n, ends = self.counts[slots, 3], np.cumsum(self.counts[:, 3])
        return self.links[np.repeat(ends[slots] - np.cumsum(n), n) + np.arange(n.sum())] if len(slots) else self.links[:0]

    def _keep(self, words: list[str], digests: list[str], counts: np.ndarray, links: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.digest), len(self.digest) + len(words)), strict=True))
        self.digest += digests
        self.counts, self.links = np.concatenate([self.counts, counts]), np.concatenate([self.links, links])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.chars += sum(map(len, words))

    def learn(self, words: list[str]) -> None:
        """Align words that aren't known. Those that end with a sign are encoded together in blocks, as they would be in a text."""
        blocks, held, n = [], [], 0
        for word in words:
            if word[-1].isspace():
                blocks.append([word])
                continue
            held.append(word)
            n += len(word)
            if n >= BLOCK_CHARS:
                blocks.append(held)
                held, n = [], 0
        self._blocks([*blocks, held] if held else blocks, OPENER)

    def learn_whole(self, word: str) -> None:
        """Align a text that isn't a row of words."""
        self._blocks([[word]], "")

    def _blocks(self, blocks: list[list[str]], opener: str) -> None:
        alone, made = [], [([], [], np.zeros((0, 4), np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(blocks), BLOCKS):
            some = blocks[k : k + BLOCKS]
            joined = [opener + "".join([w if w[0].isspace() else f" {w}" for w in block]) for block in some]
            fit = []
            for block, text, found in zip(some, joined, self.models.encode(joined), strict=True):
                said = text.encode()
                if b"".join([self.models.a_bytes[i] for i in found[0].tolist()]) == said == b"".join([self.models.b_bytes[i] for i in found[2].tolist()]):
                    fit.append((block, text, *found))
                elif len(block) > 1:
                    alone += [[w] for w in block]
                else:
                    made.append((block, [""], np.zeros((1, 4), np.int64), np.zeros(0, np.int64)))
            if fit:
                made.append(self._align(fit, opener))
        words, digests, counts, links = zip(*made, strict=True)
        self._keep([w for x in words for w in x], [d for x in digests for d in x], np.concatenate(counts), np.concatenate(links))
        if alone:
            self._blocks(alone, opener)

    def _align(self, fit: list[tuple], opener: str) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """Words of encoded blocks, laid end to end, with digests, counts and links."""
        m, first = self.models, np.cumsum([0, *(len(x[1]) for x in fit)])
        place = byte_places("".join(x[1] for x in fit))
        a, b = (np.concatenate([x[k] for x in fit]) for k in (2, 4))
        a_chars = np.concatenate([x[3] + at for x, at in zip(fit, first.tolist(), strict=False)])
        b_chars = np.concatenate([np.maximum(x[5] + 1, 0) + at for x, at in zip(fit, first.tolist(), strict=False)])  # B's texts are without their first blanks,
        b_chars[np.cumsum([0, *(len(x[4]) for x in fit[:-1])]), 0] = first[:-1]  # which their first pieces cover
        a_sizes = m.a_sizes[a]
        a_ends, b_ends = token_ends(place[a_chars], a_sizes), token_ends(place[b_chars], m.b_sizes[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        words = [w for block, *_ in fit for w in ([opener, *block] if opener else block)]
        stops = place[np.cumsum([len(w) + (not w[0].isspace()) for w in words])]
        from_b = np.searchsorted(b_ends, a_ends - a_sizes, side="right")
        n_links = np.searchsorted(b_ends, a_ends) - from_b + 1
        total = np.cumsum(n_links)
        other = np.repeat(from_b - total + n_links, n_links) + np.arange(total[-1])
        pairs = (np.repeat(a, n_links) << np.int64(32)) | b[other]
        a_upto, b_upto, cuts_upto = (np.searchsorted(x, stops, side="right") for x in (a_ends, b_ends, cuts))
        counts = np.diff(np.stack([a_upto, b_upto, cuts_upto, total[a_upto - 1]], axis=1), axis=0, prepend=0)
        opens = np.ones(len(a), np.int64)
        opens[1:] = of_a[1:] != of_a[:-1]
        opens[np.concatenate([[0], a_upto[:-1]])] = 2
        follows = np.ones(len(b), np.int64)
        follows[1:] = of_b[1:] != of_b[:-1]
        names = np.empty(len(a) + len(b), object)
        names[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = m.a_names[opens, a]
        names[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = m.b_names[follows, b]
        digests = "".join(names.tolist()).split("\n")[1:]
        if opener:
            at = np.cumsum([0, *(len(x[0]) + 1 for x in fit[:-1])])
            mine = np.ones(len(words), bool)
            mine[at] = False
            pairs, counts = pairs[np.repeat(mine, counts[:, 3])], counts[mine]
            words, digests = ([x[i] for i in np.flatnonzero(mine).tolist()] for x in (words, digests))
        return words, digests, counts, pairs

    @staticmethod
    def word(segment: str) -> str:
        return segment[1:] if segment[0] == " " and not segment[1].isspace() else segment

    def words(self, text: str) -> list[str]:
        """The text's words in order."""
        whole = f" {text}"
        if _ODD.search(whole):
            return [self.word(w) for w in _WORDS.split(whole)]
        return text.replace("\n", " \n").split(" ")


@lru_cache(maxsize=1)
def aligned(byte_bpe: str, piece_model: bytes) -> Aligned:
    return Aligned(models(byte_bpe, piece_model))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2**32 - 1, by place of byte, as the higher places are nearly all zero."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def chunk_rows(known: Aligned, chunk: int, ids: list[int | None], texts: list[str | None], remembered: int = REMEMBERED) -> pa.RecordBatch:
    """A row for each document, with the place and number of its words; then one row with the words of all documents as numbers of the chunk's distinct words, those words'
    links as numbers of the chunk's distinct pairs, and the pairs with their counts."""
    if known.chars > remembered:
        known.forget()
    split = [known.words(t) if t else [] for t in texts]
    known.learn(list(set().union(*split).difference(known.slot)))
    find = known.slot.__getitem__
    places = [np.array(list(map(find, words)), np.int64) for words in split]
    bad = known.counts[:, 0] == 0
    if bad.any():
        for i, (text, place) in enumerate(zip(texts, places, strict=True)):
            if bad[place].any():
                whole = known.word(f" {text}")
                if whole not in known.slot:
                    known.learn_whole(whole)
                places[i] = np.array([x for x in [known.slot[whole]] if known.counts[x, 0]], np.int64)
    every = np.concatenate([np.zeros(0, np.int64), *places])
    times = np.bincount(every, minlength=len(known.digest))
    slots = np.flatnonzero(times)
    known.seen += times
    number = np.zeros(len(times), np.int64)
    number[slots] = np.arange(len(slots))
    local, times, counts = number[every], times[slots], known.counts[slots]
    pairs, links = np.unique(known.links_of(slots), return_inverse=True)
    n_pairs = np.zeros(len(pairs), np.int64)
    np.add.at(n_pairs, links, np.repeat(times, counts[:, 3]))
    n_words = np.array([len(p) for p in places], np.int64)
    upto = np.cumsum(n_words)
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[local], axis=0)])
    per = sums[upto] - sums[upto - n_words]
    hashes = [hashlib.sha256(";".join([known.digest[s] for s in p.tolist()]).encode()).hexdigest() if len(p) else "" for p in places]
    none = [None] * len(ids)
    of_docs = [ids, *per.T.tolist(), hashes, (upto - n_words).tolist(), n_words.tolist()]
    of_chunk = [packed(local), packed(counts[:, 3]), packed(links), pairs, n_pairs]
    columns = [[chunk] * (len(ids) + 1), *([*c, None] for c in of_docs), *([*none, c] for c in of_chunk)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def answered(parts: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a chunk with the sums over their links; ``answers``: the corpus-wide count of each of the chunk's pairs, and whether its B id has none higher."""
    order = np.argsort(answers.column("pair").to_numpy())
    count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order]
    of_chunk = pa.compute.is_valid(parts.column("sizes"))
    head, docs = parts.filter(of_chunk), parts.filter(pa.compute.invert(of_chunk))
    sizes, links, words = (unpacked(head.column(c)[0].as_py()) for c in ("sizes", "links", "words"))
    ends = np.cumsum(sizes)
    first, n_words = (docs.column(c).to_numpy() for c in ("first", "n_words"))
    made = []
    for of_pair in (best.astype(np.int64), count):
        of_link = np.concatenate([[0], np.cumsum(of_pair[links])])
        of_words = np.concatenate([[0], np.cumsum((of_link[ends] - of_link[ends - sizes])[words])])
        made.append(pa.array(of_words[first + n_words] - of_words[first], pa.int64()))
    return pa.table([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *made, docs.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, folder: str = FOLDER, chunk_chars: int = CHUNK_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Tokens of A come from a blank and the text, those of B from the text. Offsets of both are coarse cuts, refined by decoded bytes (``token_ends``).
    Groups end where tokens of A and B both end; links join tokens whose bytes overlap. A pair of ids counts its links in all documents.

    Null and empty texts, and those that a model can't give back byte by byte: no tokens, zeros, an empty hash. Repeated rows: each counts and comes out.
    Null doc_id: kept. Other columns are left out. Empty table: empty result. A very long text is a chunk of its own.
    The files of both tokenizers are read on the driver, in ``folder``, and go to the tasks with the code (2 MB).
    """
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as f:
        byte_bpe = f.read()
    with open(f"{folder}/piece_bpe_32k.model", "rb") as f:
        piece_model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, k = aligned(byte_bpe, piece_model), TaskContext.get().partitionId() << 32, 0
        ids, texts, n = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                n += len(text or "")
                if n >= chunk_chars:
                    yield chunk_rows(known, task + k, ids, texts, remembered)
                    ids, texts, n, k = [], [], 0, k + 1
        if ids:
            yield chunk_rows(known, task + k, ids, texts, remembered)

    parts = table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PARTS))
    asked = parts.where("sizes is not null").select("chunk", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))  # at most as many rows as A has ids
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_b))
    answers = asked.select("chunk", "pair").join(counts, "pair").select(F.col("chunk").alias("of_chunk"), "pair", "count", "best")
    rows = parts.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "n_words", "words", "sizes", "links")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(answered, out)
