"""Word lexicons of books from labels and character statistics."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.enums import CUT_CHARS, LEXICON_STOP_WORDS
from storyloom.functions.text import BLANKS, SENTENCE_MARKS, TOKEN_MARKS, sentence_clean, trimmed
from storyloom.sources.checkpoints import table

MIN_PMI, MIN_COUNT, LONGEST, MIN_FREQUENCY = 2.0, 3, 7, 3
SLICE_ROWS, SLICE_CHARS = 20_000, 2_000_000
#: Characters of sentences that are packed in a row, and of texts that are looked at at once.
PACK_CHARS, CHUNK_CHARS = 8_000, 500_000


def label_words(shots: DataFrame) -> DataFrame:
    """L1: (project, word)."""
    word = trimmed(F.coalesce("label", F.lit("")))
    return shots.select("project", word.alias("word")).where(F.length("word").between(2, 8) & ~F.col("word").isin(LEXICON_STOP_WORDS)).distinct()


def cleaned(sentences: DataFrame) -> DataFrame:
    """(project, clean), a row a sentence."""
    return sentences.select("project", sentence_clean(F.col("text")).alias("clean"))


def _flags(chars: str) -> np.ndarray:
    """For each code point, whether it is one of ``chars``."""
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table


_MARKS = _flags(SENTENCE_MARKS + BLANKS)
_BREAK = ord("\n")  # no cleaned sentence holds it; stands between sentences


def packed(sentences: DataFrame, size: int = PACK_CHARS) -> DataFrame:
    """(project, clean): cleaned sentences, as many of a book in a row as make about ``size`` characters, with line feeds between them. What takes
    cleaned sentences takes these, and handles few rows; a sentence is never divided."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, texts in _by_book(batch):
                codes = _codes_of([t.replace("\n", "") for t in texts])
                codes = codes[~_MARKS[codes] | (codes == _BREAK)]
                ends, start, rows = np.append(np.flatnonzero(codes == _BREAK), len(codes)), 0, []
                while start < len(codes):
                    end = int(ends[min(np.searchsorted(ends, start + size), len(ends) - 1)])
                    rows.append(codes[start:end].tobytes().decode("utf-32-le", "surrogatepass"))
                    start = end + 1
                yield pa.RecordBatch.from_arrays([pa.array([book] * len(rows), pa.string()), pa.array(rows, pa.string())], names=["project", "clean"])

    return sentences.select("project", "text").mapInArrow(laid, "project string, clean string")


def _by_book(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[str]]]:
    """The texts of each book, about ``CHUNK_CHARS`` at a time; a text that is null is empty."""
    books = batch.column(0).dictionary_encode("encode")
    of, texts = books.indices.to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    for rows in np.split(order, starts[1:]) if len(order) else []:
        for piece in _pieces([t or "" for t in texts[rows].tolist()], CHUNK_CHARS):
            yield books.dictionary[int(of[rows[0]])].as_py(), piece


def _codes_of(texts: list[str]) -> np.ndarray:
    """The code points of the texts, with a line feed between them."""
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, how often each occurs, number of each code point's character among them)."""
    n = np.bincount(codes)
    chars = np.flatnonzero(n)
    number = np.zeros(len(n), np.int64)
    number[chars] = np.arange(len(chars))
    return chars, n[chars], number[codes]


def unigrams(clean: DataFrame) -> DataFrame:
    """L2: (project, gram, n)."""
    return gram_counts(clean, (1,))


def bigrams(clean: DataFrame) -> DataFrame:
    """L2: (project, gram, n) of neighbouring characters within a sentence."""
    return gram_counts(clean, (2,))


def of_size(grams: DataFrame, size: int) -> DataFrame:
    return grams.where(F.length("gram") == size)


def gram_counts(clean: DataFrame, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(project, gram, n) of runs of one or two characters, both in one walk. Each batch of sentences is counted as an array of code points, so that what is
    shuffled is one row for each book and gram of a batch, not one for each character."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, texts in _by_book(batch):
                codes = _codes_of(texts)
                if not len(codes):
                    continue
                chars, single, number = _dense(codes)
                grams, n = [], []
                if 1 in sizes:
                    inside = chars != _BREAK
                    grams += map(chr, chars[inside].tolist())
                    n.append(single[inside])
                if 2 in sizes:
                    pairs = number[:-1] * len(chars) + number[1:]
                    if len(chars) ** 2 <= max(len(codes), 1 << 16):
                        counts = np.bincount(pairs)
                        found = np.flatnonzero(counts)
                        counts = counts[found]
                    else:
                        found, counts = np.unique(pairs, return_counts=True)
                    a, b = chars[found // len(chars)], chars[found % len(chars)]
                    inside = (a != _BREAK) & (b != _BREAK)
                    grams += [chr(x) + chr(y) for x, y in zip(a[inside].tolist(), b[inside].tolist(), strict=True)]
                    n.append(counts[inside])
                yield pa.RecordBatch.from_arrays([pa.array([book] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(np.concatenate(n), pa.int64())], names=["project", "gram", "n"])

    rows = clean.select("project", "clean").mapInArrow(counted, "project string, gram string, n long")
    return rows.groupBy("project", "gram").agg(F.sum("n").alias("n"))


def pmi_table(clean: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """L3: (project, gram, n, pmi) of the bigrams that occur often enough; the others have no bond."""
    grams = table(gram_counts(clean))
    return pmi_of_counts(of_size(grams, 1), of_size(grams, 2), min_count)


def pmi_of_counts(one: DataFrame, two: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """L3 from the counts of single characters and of pairs."""
    totals = one.groupBy("project").agg(F.sum("n").alias("total"))
    a, b = (one.select("project", F.col("gram").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    rows = two.where(F.col("n") >= min_count).withColumn("a", F.substring("gram", 1, 1)).withColumn("b", F.substring("gram", 2, 1)).join(a, ["project", "a"]).join(b, ["project", "b"]).join(totals, "project")
    together, single = F.col("n") / F.col("total"), (F.col("n_a") / F.col("total")) * (F.col("n_b") / F.col("total"))
    return rows.select("project", "gram", "n", F.log2(together / single).alias("pmi"))


_CUTS = _flags(CUT_CHARS + "\n")
_GAP = "\ud800"  # no text holds it; stands between texts


def _codes(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts one after the other with a gap after each, and their code points."""
    whole = _GAP.join([*texts, ""])
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


_TOKEN_BLANKS = _flags(TOKEN_MARKS + BLANKS)


def _spaced(texts: list[str]) -> list[str]:
    """T10, as ``token_clean``: marks and blanks become spaces."""
    whole = _GAP.join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_TOKEN_BLANKS[codes], np.uint32(0x20), codes).tobytes().decode("utf-32-le", "surrogatepass").split(_GAP)


#: Most entries of a book's square of bonds; a book with more characters looks its pairs up in the sorted array.
SQUARE = 1 << 24


class Bonds:
    """Which neighbours of a book are bonded. ``bonded``: sorted pairs, the first character's code times 2**32 plus the second's."""

    def __init__(self, bonded: np.ndarray) -> None:
        self.bonded = bonded.astype(np.uint64)
        first, second = (x.astype(np.int64) for x in (self.bonded >> np.uint64(32), self.bonded & np.uint64(0xFFFFFFFF)))
        chars = np.unique(np.concatenate([first, second]))
        self.side = len(chars) + 1  # a character without bonds is number 0
        self.square = None
        if self.side**2 <= SQUARE:
            self.number = np.zeros(0x110000, np.int32)
            self.number[chars] = np.arange(1, self.side)
            self.square = np.zeros(self.side**2, bool)
            self.square[self.number[first].astype(np.int64) * self.side + self.number[second]] = True

    def between(self, codes: np.ndarray) -> np.ndarray:
        """Whether each code point is bonded to the one after it."""
        if self.square is not None:
            number = self.number[codes]
            return self.square[number[:-1] * self.side + number[1:]]
        pairs = (codes[:-1].astype(np.uint64) << np.uint64(32)) | codes[1:]
        return self.bonded[np.minimum(np.searchsorted(self.bonded, pairs), len(self.bonded) - 1)] == pairs


def _same(numbers: np.ndarray, most: int, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a start, how often) of each different run of ``size`` numbers from 0 to ``most`` among those that begin at ``starts``."""
    bits, key, used = max(1, int(most).bit_length()), np.zeros(len(starts), np.int64), 0
    for k in range(size):
        if used + bits > 62:
            known, key = np.unique(key, return_inverse=True)
            used = len(known).bit_length()
        key, used = (key << bits) | numbers[starts + k], used + bits
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return starts[at], n


def _pieces(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``most`` characters."""
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def cut_at_bonds(texts: list[str], bonded: np.ndarray, longest: int = LONGEST) -> Counter[str]:
    """L4: how often each word occurs: maximal runs of bonded neighbours, in pieces of ``longest``; characters that always cut give no word.

    ``bonded``: as in ``Bonds``.
    """
    bonds, found = Bonds(bonded), Counter()
    for piece in _pieces(texts, CHUNK_CHARS):
        whole, codes = "\n".join(piece), _codes_of(piece)
        if not len(codes):
            continue
        cuts = _CUTS[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = cuts[1:] | cuts[:-1] | ~bonds.between(codes)
        first = np.flatnonzero(begins)
        runs = np.diff(first, append=len(codes))
        parts = -(-runs // longest)
        starts = np.repeat(first, parts) + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.diff(starts, append=len(codes))
        keep = ~cuts[starts]
        starts, size = starts[keep], size[keep]
        chars, _, number = _dense(codes)
        for length in np.unique(size).tolist():
            begin, n = _same(number, len(chars), starts[size == length], length)
            for i, times in zip(begin.tolist(), n.tolist(), strict=True):
                found[whole[i : i + length]] += times
    return found


def slices(rows: DataFrame, beside: DataFrame, size: int, weight: Column | None = None) -> DataFrame:
    """(project, slices): into how many groups a book's rows are dealt, each of about ``size`` rows (or sum of ``weight``), and of no fewer than ``beside`` (project, entries)
    says are the entries of what each group gets besides. So what is repeated for each group never grows beyond the rows themselves."""
    n = rows.groupBy("project").agg(F.sum(F.lit(1) if weight is None else weight).alias("n")).join(beside, "project", "left")
    return n.select("project", F.ceil(F.col("n") / F.greatest(F.lit(size), F.coalesce("entries", F.lit(0)))).cast("int").alias("slices"))


def bonds_of_books(pmi: DataFrame, min_pmi: float = MIN_PMI) -> DataFrame:
    """(project, bonds, entries): the bonded pairs of a book as one sorted array, each pair the first character's code times 2**32 plus the second's."""
    code = F.shiftleft(F.ascii(F.substring("gram", 1, 1)).cast("long"), 32) + F.ascii(F.substring("gram", 2, 1))
    rows = pmi.where(F.col("pmi") >= min_pmi).groupBy("project").agg(F.array_sort(F.collect_list(code)).alias("bonds"))
    return rows.withColumn("entries", F.size("bonds"))


def dealt(rows: DataFrame, beside: DataFrame, key: str, size: int, entries: DataFrame | None = None, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a slot for groups (project, slot), and ``beside`` once for each of them, as (b_project, b_slot, ...). ``entries``: (project, entries)
    of ``beside``, if it doesn't say so itself; ``weight``: as in ``slices``."""
    dealt_to = table(slices(rows, beside.select("project", "entries") if entries is None else entries, size, weight))
    slot = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("b_slot")
    others = [c for c in beside.columns if c not in ("project", "entries")]
    return rows.join(dealt_to, "project").withColumn("slot", F.pmod(F.xxhash64(key), "slices").cast("int")).drop("slices"), beside.join(dealt_to, "project").select(F.col("project").alias("b_project"), slot, *others)


def pmi_words(clean: DataFrame, pmi: DataFrame, min_pmi: float = MIN_PMI, size: int = SLICE_CHARS) -> DataFrame:
    """L4: (project, word, n): statistical words and how often they occur.

    Sentences of a book are dealt over groups of about ``size`` characters; each gets the book's bonded pairs as one value. Counts are added up afterwards.
    """
    bonds = table(bonds_of_books(pmi, min_pmi))
    beside = bonds.select("project", (F.col("entries").cast("long") * 8).alias("entries"))  # a bond takes as much room as eight characters
    rows, bonds = dealt(clean.where("clean <> ''").select("project", "clean"), bonds, "clean", size, beside, F.length("clean"))

    def words_of(sentences: pa.Table, bonds: pa.Table) -> pa.Table:
        if not sentences.num_rows:
            return pa.table({"project": pa.array([], pa.string()), "word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        bonded = bonds.column("bonds").combine_chunks().flatten().to_numpy()
        found = cut_at_bonds(sentences.column("clean").to_pylist(), bonded)
        return pa.table({"project": pa.array([sentences.column("project")[0].as_py()] * len(found), pa.string()), "word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    found = rows.groupBy("project", "slot").cogroup(bonds.groupBy("b_project", "b_slot")).applyInArrow(words_of, "project string, word string, n long")
    return found.groupBy("project", "word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, least: int = MIN_FREQUENCY) -> DataFrame:
    """L5."""
    return words.where(F.length("word").between(2, 4) & ~F.col("word").isin(LEXICON_STOP_WORDS) & (F.col("n") >= least))


def lexicon(shots: DataFrame, sentences: DataFrame) -> DataFrame:
    """(project, word, from_label, freq): label words, and frequent statistical words."""
    clean = table(packed(sentences))
    return lexicon_of(shots, clean, pmi_table(clean))


def lexicon_of(shots: DataFrame, clean: DataFrame, pmi: DataFrame) -> DataFrame:
    """L6 from bonds that are there already."""
    frequent = frequent_words(pmi_words(clean, pmi))
    both = label_words(shots).select("project", "word", F.lit(True).alias("from_label"), F.lit(0).cast("long").alias("freq")).unionByName(frequent.select("project", "word", F.lit(False).alias("from_label"), F.col("n").alias("freq")))
    return both.groupBy("project", "word").agg(F.bool_or("from_label").alias("from_label"), F.max("freq").alias("freq"))


def lexicon_stats(words: DataFrame) -> DataFrame:
    """(project, entities, label_words, frequent_words)."""
    return words.groupBy("project").agg(F.count(F.lit(1)).alias("entities"), F.count_if("from_label").alias("label_words"), F.count_if(F.col("freq") > 0).alias("frequent_words"))


def manifest(shot_files: DataFrame, sentence_files: DataFrame) -> DataFrame:
    """(project, chapter, shot_mtime, sent_mtime)."""
    s = sentence_files.select("project", "chapter", F.col("mtime").cast("string").alias("sent_mtime"))
    return shot_files.select("project", "chapter", F.col("mtime").cast("string").alias("shot_mtime")).join(s, ["project", "chapter"], "left").na.fill("missing", ["sent_mtime"])


def needs_rebuild(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(project, rebuild): a book whose manifest isn't the recorded one; a book that is gone needs none."""
    a = now.select("project", "chapter", F.struct("shot_mtime", "sent_mtime").alias("a"))
    b = recorded.select("project", "chapter", F.struct("shot_mtime", "sent_mtime").alias("b"))
    per = a.join(b, ["project", "chapter"], "full_outer").groupBy("project").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("rebuild"), F.count("a").alias("n"))
    return per.where("n > 0").select("project", "rebuild")


class Words:
    """A book's words as a tree, level by level: a level's sorted keys are the place of the node before times 2**21 plus a character's code. A word costs some nine
    bytes for each character that it doesn't share, and all places of a text go down the tree at once."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels = levels
        self.base = np.cumsum([0, *(len(keys) for keys, _ in levels)])

    def __len__(self) -> int:
        return int(self.base[-1])

    def found(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, numbers of the words) for each length of words, the short ones first."""
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for depth, (keys, ends) in enumerate(self.levels):
            if len(at) and at[-1] + depth >= len(codes):
                inside = at + depth < len(codes)
                at, node = at[inside], node[inside]
            if not len(at):
                return
            key = (node << np.uint64(21)) | codes[at + depth]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[place] == key
            at, place = at[there], place[there]
            node, hit = place.astype(np.uint64), ends[place]
            yield depth + 1, at[hit], self.base[depth] + place[hit]


def automaton_of(words: Iterable[str]) -> Words:
    """Finds all of the words in one walk over a text's code points."""
    known = [w for w in words if w]
    size = np.fromiter(map(len, known), np.int64, len(known))
    starts = np.cumsum(size) - size
    codes = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32)
    alive, node, levels = np.arange(len(known)), np.zeros(len(known), np.uint64), []
    while len(alive):
        depth = len(levels)
        keys, place = np.unique((node << np.uint64(21)) | codes[starts[alive] + depth], return_inverse=True)
        ends = np.zeros(len(keys), bool)
        ends[place[size[alive] == depth + 1]] = True
        levels.append((keys, ends))
        longer = size[alive] > depth + 1
        alive, node = alive[longer], place[longer].astype(np.uint64)
    return Words(levels)


def automata(words: DataFrame) -> DataFrame:
    """(project, automaton, entries): the tree of each book's words (project, word), built once."""

    def built(rows: pa.Table) -> pa.Table:
        made = automaton_of(rows.column("word").to_pylist())
        entries = sum(int(ends.sum()) for _, ends in made.levels)
        return pa.table({"project": rows.column("project")[:1], "automaton": pa.array([pickle.dumps(made.levels)], pa.binary()), "entries": pa.array([entries], pa.int32())})

    return words.where("word <> ''").select("project", "word").groupBy("project").applyInArrow(built, "project string, automaton binary, entries int")


#: (whole, of, start, size, word): the texts one after the other, and of each find the number of its text, its start, its length and its word's number.
Finds = tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _owners(texts: list[str], start: np.ndarray) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.searchsorted(ends, start, side="right")


def all_finds(made: Words, texts: list[str]) -> Finds:
    """Every word anywhere in the texts."""
    whole, codes = _codes(texts)
    parts = [(start, np.full(len(start), n), word) for n, start, word in made.found(codes)]
    start, size, word = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
    return whole, _owners(texts, start), start, size, word


def longest_finds(made: Words, texts: list[str]) -> Finds:
    """The longest word at each place, in order; what begins none is passed over."""
    whole, codes = _codes(texts)
    longest, which = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for n, start, word in made.found(codes):
        longest[start], which[start] = n, word
    spots = np.flatnonzero(longest)
    after = np.searchsorted(spots, spots + longest[spots]).tolist()
    taken, k = [], 0
    while k < len(after):
        taken.append(k)
        k = after[k]
    start = spots[np.array(taken, np.int64)]
    return whole, _owners(texts, start), start, longest[start], which[start]


def longest_words(made: Words, texts: list[str]) -> list[tuple[int, str]]:
    """(number of the text, word) in order."""
    whole, of, start, size, _ = longest_finds(made, texts)
    return [(text, whole[i : i + n]) for text, i, n in zip(of.tolist(), start.tolist(), size.tolist(), strict=True)]


def _counted(book: str, rows: pa.Table, made: Words, finds: Callable[[Words, list[str]], Finds]) -> pa.RecordBatch:
    """(project, key, token, n) of texts (key, text, about)."""
    keys = rows.column("key").combine_chunks().dictionary_encode()
    whole, of, start, size, word = finds(made, [t or "" for t in rows.column("text").to_pylist()])
    of = keys.indices.to_numpy()[of].astype(np.int64)
    _, first, n = np.unique(of * max(1, len(made)) + word, return_index=True, return_counts=True)
    tokens = [whole[i:j] for i, j in zip(start[first].tolist(), (start[first] + size[first]).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([book] * len(n), pa.string()), keys.dictionary.take(pa.array(of[first])), pa.array(tokens, pa.string()), pa.array(n, pa.int64())], names=["project", "key", "token", "n"])


def _gathered(book: str, rows: pa.Table, made: Words, spaced: bool) -> pa.RecordBatch:
    """A row for each key of texts (key, text, about), see ``tokenized``."""
    keys = rows.column("key").combine_chunks().dictionary_encode()
    number, texts = keys.indices.to_numpy().astype(np.int64), [t or "" for t in rows.column("text").to_pylist()]
    size = np.arange(len(keys.dictionary) + 1)
    whole, of, start, chars, word = longest_finds(made, _spaced(texts) if spaced else texts)
    entries = max(1, len(made))
    code, first, n = np.unique(number[of] * entries + word, return_index=True, return_counts=True)
    of, word = code // entries, code % entries
    _, at, which = np.unique(word, return_index=True, return_inverse=True)
    plain = np.array([len(set(whole[i:j])) < 2 for i, j in zip(start[first[at]].tolist(), (start[first[at]] + chars[first[at]]).tolist(), strict=True)], bool)[which]
    odd = set(of[plain].tolist())  # only for these keys it matters which characters a text has
    letters = ["".join(sorted(set(t))) if k in odd else "" for k, t in zip(number.tolist(), texts, strict=True)]
    tokens, rows_of = pa.array(np.searchsorted(of, size).astype(np.int32)), pa.array(np.searchsorted(number, size).astype(np.int32))
    lists = [(tokens, pa.array(np.where(plain, -1 - word, word).astype(np.int32))), (tokens, pa.array(n.astype(np.int32))), (rows_of, pa.array(np.fromiter(map(len, texts), np.int32, len(texts)))), (rows_of, pa.array(letters, pa.string())), (rows_of, rows.column("about").combine_chunks())]
    return pa.RecordBatch.from_arrays([pa.array([book] * len(keys.dictionary), pa.string()), keys.dictionary, *(pa.ListArray.from_arrays(*x) for x in lists)], names=["project", "key", "tokens", "n", "lengths", "letters", "about"])


def walked(texts: DataFrame, trees: DataFrame, made_of: Callable[[str, pa.Table, Words], pa.RecordBatch], schema: str, size: int = SLICE_ROWS) -> DataFrame:
    """What ``made_of`` gives for the texts (project, key, text, about) and the tree of their book's words; all texts of a key come together. ``trees``: see ``automata``.

    A book's texts are dealt by key over groups, so that a large book isn't one task. In a group the tree comes first and the texts stream past it in order of their
    keys, so a task holds one tree and one piece of the texts, however many rows the group has.
    """
    kind = texts.schema["about"].dataType
    rows, made = dealt(texts.select("project", "key", "text", "about"), trees, "key", size)

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, left = None, None, None

        def pieces(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """The counts of ``rows``; the rows of the last key wait for those that follow."""
            nonlocal left
            keys = rows.column("key").to_pylist()
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + ([len(keys)] if last and keys else [])
            chars, begin = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(rows.column("text")), 0).to_numpy())]), 0
            for k, end in enumerate(ends):
                if k + 1 == len(ends) or chars[ends[k + 1]] - chars[begin] > CHUNK_CHARS:
                    yield made_of(group[0], rows.slice(begin, end - begin), tree)
                    begin = end
            left = rows.slice(begin)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            starts = rows.column("automaton").is_valid().to_pylist()
            names = list(zip(rows.column("project").to_pylist(), rows.column("slot").to_pylist(), strict=True))
            begin = 0
            while begin < len(names):
                if names[begin] != group or starts[begin]:
                    if left is not None:
                        yield from pieces(left, True)
                    group, left = names[begin], None
                    tree = Words(pickle.loads(rows.column("automaton")[begin].as_py()) if starts[begin] else [])
                    begin += starts[begin]
                end = begin
                while end < len(names) and names[end] == group and not starts[end]:
                    end += 1
                mine = rows.slice(begin, end - begin).select(["key", "text", "about"])
                yield from pieces(mine if left is None else pa.concat_tables([left, mine]), False)
                begin = end
        if left is not None:
            yield from pieces(left, True)

    none = F.lit(None)
    first = made.select(F.col("b_project").alias("project"), F.col("b_slot").alias("slot"), none.cast("string").alias("key"), none.cast("string").alias("text"), none.cast(kind).alias("about"), "automaton")
    both = first.unionByName(rows.select("project", "slot", "key", "text", "about", none.cast("binary").alias("automaton")))
    met = both.repartition("project", "slot").sortWithinPartitions("project", "slot", F.col("automaton").isNull(), "key")
    return met.mapInArrow(tokens_of, schema)


def _counts(texts: DataFrame, words: DataFrame, finds: Callable[[Words, list[str]], Finds], size: int) -> DataFrame:
    return walked(texts.select("project", "key", "text", F.lit(None).cast("boolean").alias("about")), table(automata(words)), lambda *of: _counted(*of, finds), "project string, key string, token string, n long", size)


def postings(texts: DataFrame, words: DataFrame, size: int = SLICE_ROWS) -> DataFrame:
    """(project, key, token, n) of texts (project, key, text): each text is tokenized once, with its own book's lexicon."""
    return _counts(texts, words, longest_finds, size)


def contained(texts: DataFrame, words: DataFrame, size: int = SLICE_ROWS) -> DataFrame:
    """(project, key, token, n): all words of the book that stand anywhere in the text, and how often."""
    return _counts(texts, words, all_finds, size)


def tokenized(texts: DataFrame, trees: DataFrame, spaced: bool, size: int = SLICE_ROWS) -> DataFrame:
    """(project, key, tokens, n, lengths, letters, about): a row for each key of texts (project, key, text, about), also if it has no tokens.

    A token is its word's number in the book's tree; for a word that repeats one character it is -1 minus that. ``lengths``, ``letters`` and ``about`` have an entry for each text of the
    key; letters are the different characters of the text if the key has such a word. ``spaced``: texts are cleaned for the tokenizer first.
    """
    texts = texts if "about" in texts.columns else texts.withColumn("about", F.lit(None).cast("boolean"))
    about = texts.schema["about"].dataType.simpleString()
    schema = f"project string, key string, tokens array<int>, n array<int>, lengths array<int>, letters array<string>, about array<{about}>"
    return walked(texts, trees, lambda *of: _gathered(*of, spaced), schema, size)
