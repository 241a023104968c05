"""Recall of reference shots over three channels: labels, word overlap, vectors; merged into reference blocks."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import fixed, fnv1a, padded, query_clean, trimmed, without_blanks
from storyloom.operators import lexicon
from storyloom.operators.rollup import ordered_text
from storyloom.sources.checkpoints import table

SHOT = ["project", "chapter", "shot_id"]
QUOTA = {"label": 2, "token": 2, "vec": 2}
#: Of vector recall: queries of a block, vectors of a run, and scores that are held at once.
QUERY_BLOCK, RUN, SCORES = 4096, 10_000, 2_000_000


def shot_key() -> Column:
    return F.concat_ws("|", *SHOT)


def shot_texts(shots: DataFrame, sentences: DataFrame, trim: bool = True) -> DataFrame:
    """R2: (project, chapter, pos, shot_id, text), the shot's sentences in order; what is missing is empty. Not trimmed (R2b): empty shots go."""
    ids = shots.select("project", "chapter", "pos", "shot_id", F.posexplode_outer("sentence_ids").alias("k", "sid"))
    found = ids.join(sentences.select("project", "chapter", "sid", "text"), ["project", "chapter", "sid"], "left")
    out = ordered_text(found, ["project", "chapter", "pos", "shot_id"], ["k"], F.coalesce("text", F.lit("")), "", "text")
    return out.withColumn("text", trimmed(F.col("text"))) if trim else out.where("text <> ''")


def signatures(requests: DataFrame) -> DataFrame:
    """The distinct (type, funcs) of requests: all that the label channel depends on."""
    return requests.select("type", F.array_sort(F.coalesce("funcs", F.array().cast("array<string>"))).alias("funcs")).distinct()


def _matched(classes: DataFrame, sigs: DataFrame) -> DataFrame:
    """(type, funcs, c_type, c_funcs, matched, exact): signatures with the classes of shots that share a function or the type; equi-joins only."""
    c = classes.select(F.col("type").alias("c_type"), F.col("funcs").alias("c_funcs")).distinct()
    by_func = sigs.withColumn("f", F.explode("funcs")).join(c.withColumn("f", F.explode(F.array_distinct("c_funcs"))), "f").groupBy("type", "funcs", "c_type", "c_funcs").agg(F.count(F.lit(1)).alias("matched"))
    by_type = sigs.join(c, F.col("type") == F.col("c_type")).select("type", "funcs", "c_type", "c_funcs", F.lit(0).cast("long").alias("matched"))
    rows = by_func.unionByName(by_type).groupBy("type", "funcs", "c_type", "c_funcs").agg(F.max("matched").alias("matched"))
    exact = (F.size("funcs") > 0) & (F.col("matched") == F.size("funcs")) & (F.col("type").isNull() | F.coalesce(F.col("type") == F.col("c_type"), F.lit(False)))
    return rows.withColumn("exact", exact)


def label_recall(shots: DataFrame, requests: DataFrame, k: int = QUOTA["label"]) -> DataFrame:
    """(type, funcs, rank, score, project, chapter, shot_id) for each signature of the requests.

    Shots only matter by their class (type, functions). The picked shot of the pool of exact classes is found by counts: first its book, then its chapter, then its place
    in the chapter. The rest is filled from the classes by score, and of a class only its first k + 1 shots in scan order can be needed. So no signature meets all shots.
    """
    s = shots.select("project", "chapter", "pos", "shot_id", F.col("type").alias("c_type"), F.col("funcs").alias("c_funcs"))
    sigs = signatures(requests)
    by_chapter = s.groupBy("project", "chapter", "c_type", "c_funcs").agg(F.count(F.lit(1)).alias("n"))
    by_book = by_chapter.groupBy("project", "c_type", "c_funcs").agg(F.sum("n").alias("n"))
    matched = _matched(by_book.select(F.col("c_type").alias("type"), F.col("c_funcs").alias("funcs")), sigs)
    exact = matched.where("exact").select("type", "funcs", "c_type", "c_funcs")
    sig = ["type", "funcs"]
    same_class = F.expr("c.c_type <=> e.c_type and c.c_funcs = e.c_funcs")

    def cell(rows: DataFrame, by: list[str]) -> DataFrame:
        """The cell in which the index falls, and the index inside it."""
        w = Window.partitionBy(*sig).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(w), F.lit(0))
        return rows.withColumn("before", before).where((F.col("idx") >= F.col("before")) & (F.col("idx") < F.col("before") + F.col("n"))).withColumn("idx", F.col("idx") - F.col("before")).drop("before", "n")

    books = by_book.alias("c").join(exact.alias("e"), same_class).groupBy("e.type", "e.funcs", "project").agg(F.sum("n").alias("n"))
    size = F.sum("n").over(Window.partitionBy(*sig))
    seed = F.concat(F.coalesce("type", F.lit("")), F.lit("|"), F.array_join("funcs", ","), F.lit("|"), size.cast("string"))
    books = books.withColumn("seed", seed).withColumn("size", size).withColumn("idx", fnv1a(F.col("seed")) % F.col("size")).drop("seed", "size")
    book = cell(books, ["project"])
    in_book = book.alias("b").join(exact.alias("e"), F.expr("b.type <=> e.type and b.funcs = e.funcs")).select("b.*", "e.c_type", "e.c_funcs")
    chapters = in_book.alias("e").join(by_chapter.alias("c"), F.expr("e.project = c.project and c.c_type <=> e.c_type and c.c_funcs = e.c_funcs")).groupBy("e.type", "e.funcs", "e.project", "e.idx", "c.chapter").agg(F.sum("n").alias("n"))
    chapter = cell(chapters, ["chapter"])
    in_chapter = chapter.alias("b").join(exact.alias("e"), F.expr("b.type <=> e.type and b.funcs = e.funcs")).select("b.*", "e.c_type", "e.c_funcs")
    rows = in_chapter.alias("e").join(s.alias("c"), F.expr("e.project = c.project and e.chapter = c.chapter and c.c_type <=> e.c_type and c.c_funcs = e.c_funcs")).select("e.type", "e.funcs", "e.idx", "c.project", "c.chapter", "c.pos", "c.shot_id")
    place = F.row_number().over(Window.partitionBy(*sig).orderBy("pos")) - 1
    picked = rows.withColumn("place", place).where("place = idx").select(*sig, "project", "chapter", "pos", "shot_id")

    first = F.row_number().over(Window.partitionBy("c_type", "c_funcs").orderBy("project", "chapter", "pos"))
    tops = s.withColumn("first", first).where(F.col("first") <= k + 1).drop("first")
    score = F.col("matched") * 2 + F.when(F.coalesce(F.col("type") == F.col("c_type"), F.lit(False)), 0.5).otherwise(0.0)
    scored = matched.withColumn("score", score).where("score > 0")
    candidates = scored.alias("e").join(tops.alias("c"), same_class).select("e.type", "e.funcs", "score", "project", "chapter", "pos", "shot_id")
    mark = picked.select(*sig, "project", "chapter", "pos").withColumn("is_picked", F.lit(True))
    both = candidates.alias("a").join(mark.alias("m"), F.expr("a.type <=> m.type and a.funcs = m.funcs and a.project = m.project and a.chapter = m.chapter and a.pos = m.pos"), "left").where("is_picked is null").select("a.*", F.lit(1).alias("tier"))
    every = both.unionByName(picked.withColumn("score", F.lit(2.0)).withColumn("tier", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*sig).orderBy("tier", F.col("score").desc(), "project", "chapter", "pos"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(*sig, "rank", "score", *SHOT)


def label_hits(shots: DataFrame, requests: DataFrame, k: int = QUOTA["label"]) -> DataFrame:
    """(query_id, channel, rank, score, project, chapter, shot_id) of the label channel."""
    found = label_recall(shots, requests, k)
    asked = requests.select("query_id", "type", F.array_sort("funcs").alias("funcs"))
    rows = asked.alias("q").join(found.alias("f"), F.expr("q.type <=> f.type and q.funcs = f.funcs"))
    return rows.select("query_id", F.lit("label").alias("channel"), "rank", "score", *SHOT)


def held_labels(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, project, label), once each: a label (project, label) holds the query (query_id, project, q) or the query holds the label, both of two characters or more.

    A book's labels are one tree that its queries go down, and its queries one that its labels go down; what is found meets by equality. Only words that are no longer
    than the longest text of the other side can be held, so only those are in a tree. The work grows with the texts and what is found in them.
    """
    q = queries.where(F.length("q") >= 2).select("project", "q", F.col("query_id").cast("string").alias("query_id")).distinct()
    asked, named = q.select("project", F.col("q").alias("word")).distinct(), table(labels.where(F.length("label") >= 2).select("project", F.col("label").alias("word")).distinct())

    def within(words: DataFrame, texts: DataFrame) -> DataFrame:
        most = texts.groupBy("project").agg(F.max(F.length("word")).alias("most"))
        return words.join(most, "project").where(F.length("word") <= F.col("most")).select("project", "word")

    asked = table(asked)
    inside = lexicon.contained(q.select("project", F.col("query_id").alias("key"), F.col("q").alias("text")), within(named, asked)).select("project", F.col("key").alias("query_id"), F.col("token").alias("label"))
    around = lexicon.contained(named.select("project", F.col("word").alias("key"), F.col("word").alias("text")), within(asked, named)).select("project", F.col("token").alias("q"), F.col("key").alias("label"))
    around = around.join(q, ["project", "q"]).select("project", "query_id", "label")
    return inside.unionByName(around).distinct().select("query_id", "project", "label")


#: Keys of a label that one task joins with the label's queries.
LABEL_KEYS = 20_000


def containment(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, project, key) where a label of the key holds the query or the query holds the label.

    The pairs of a query and a key grow with the square of the input, so they are only made by the last join, and are neither shuffled nor written: a query meets each different label once, and
    a label's keys are dealt over groups. Only keys with several labels can be found twice, and only what is found of them is made distinct.
    """
    labels = held = table(labels.where(F.length("label") >= 2).select("project", "label", "key").distinct())
    held = held.join(held.groupBy("project", "key").agg((F.count(F.lit(1)) > 1).alias("several")), ["project", "key"])
    groups = labels.groupBy("project", "label").agg(F.ceil(F.count(F.lit(1)) / LABEL_KEYS).cast("int").alias("groups"))
    held = table(held.join(groups, ["project", "label"]).withColumn("slot", F.pmod(F.xxhash64("key"), "groups").cast("int")).drop("groups"))
    pairs = table(held_labels(queries, labels))
    pairs = table(pairs.join(groups, ["project", "label"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups"))
    kind = dict(queries.dtypes)["query_id"]
    once, more = (pairs.join(held.where(c), ["project", "label", "slot"]).select(F.col("query_id").cast(kind).alias("query_id"), "project", "key") for c in ("not several", "several"))
    return once.unionByName(more.distinct())


#: Words of shots in a group, on average: as many as the book's queries have, but no fewer than the first number and no more than the second.
GROUP_WORDS, MOST_WORDS = 400_000, 1_000_000


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Words:
    """Which of ``size`` places hold each of the group's tokens, as often as they hold it: rows sorted by token; of tokens that one place in eight or more hold, a count for each place."""

    def __init__(self, code: np.ndarray, place: np.ndarray, n: np.ndarray, tokens: int, size: int) -> None:
        order = np.argsort(code, kind="stable")
        self.size, self.place = size, np.repeat(place[order], n[order])
        self.first = np.concatenate(([0], np.cumsum(n[order], dtype=np.int64)))[np.searchsorted(code[order], np.arange(tokens + 1))]
        self.row = np.full(tokens, -1)
        many = np.flatnonzero(np.bincount(code, minlength=tokens) * 8 >= max(size, 8))
        self.row[many] = np.arange(len(many))
        self.counts = [np.bincount(self.place[self.first[k] : self.first[k + 1]], minlength=size).astype(np.int32) for k in many.tolist()]

    def sums(self, tokens: np.ndarray) -> np.ndarray:
        """For each place how often it holds one of the tokens."""
        row = self.row[tokens]
        few = tokens[row < 0]
        n = np.bincount(self.place[_spread(self.first[few], self.first[few + 1] - self.first[few])], minlength=self.size)
        for k in row[row >= 0].tolist():
            n += self.counts[k]
        return n


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and the row of each."""
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


class _Shots:
    """A group of a book's shots in scan order, of rows (kind, key, tokens, n, length, word, chapter, pos, shot_id).

    Kinds: t: a shot with the tokens of its text, its length, and its letters as word; l: the tokens of its label, and the label as word (several with line feeds between them).
    Tokens are as in ``lexicon.tokenized``. Shots of the same label are a class, whose tokens are looked at once.
    """

    def __init__(self, rows: pa.Table) -> None:
        text, label = (rows.filter(pc.equal(rows.column("kind"), kind)) for kind in "tl")
        self.about = text.take(pc.sort_indices(text, sort_keys=[(c, "ascending") for c in ("chapter", "pos", "key")])).combine_chunks()
        self.keys, self.size = self.about.column("key").combine_chunks(), len(text)
        self.length = self.about.column("length").to_numpy()
        shot = pc.index_in(label.column("key"), value_set=self.keys)
        label, shot = label.filter(shot.is_valid()), shot.drop_null().to_numpy().astype(np.int64)
        classes = label.column("word").combine_chunks().dictionary_encode()
        of, count = classes.indices.to_numpy().astype(np.int64), len(classes.dictionary)
        order = np.argsort(of, kind="stable")
        self.shot, self.first = shot[order], np.searchsorted(of[order], np.arange(count + 1))
        self.held: dict[str, list[int]] = {}
        for k, names in enumerate(classes.dictionary.to_pylist()):
            for name in names.split("\n"):
                self.held.setdefault(name, []).append(k)
        parts = []
        for table in (self.about, label.take(pa.array(order[self.first[:-1]]))):
            token, row = _flat(table.column("tokens"))
            parts.append((token, row, _flat(table.column("n"))[0], len(table)))
        every = np.concatenate([token for token, *_ in parts])
        plain = every < 0
        self.vocabulary, code = np.unique(np.where(plain, -1 - every, every), return_inverse=True)
        self.plain = np.zeros(len(self.vocabulary), bool)  # words that repeat one character
        self.plain[code[plain]] = True
        cut = len(parts[0][0])
        self.in_text, self.in_label = (_Words(c, row, n, len(self.vocabulary), size) for c, (_, row, n, size) in zip((code[:cut], code[cut:]), parts, strict=True))
        self.messages: _Messages | None = None

    def overlaps(self, queries: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(query_id, which, n) for each query that overlaps with shots of the group: the numbers of those shots in order, and by how much."""
        asked = zip(*(queries.column(c).to_pylist() for c in ("key", "length", "word", "labels")), queries.column("tokens"), strict=True)
        for query_id, length, letters, labels, words in asked:
            words = words.values.to_numpy()
            words = np.where(words < 0, -1 - words, words)
            at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
            tokens = at[self.vocabulary[at] == words] if len(self.vocabulary) else at[:0]
            n = self.in_text.sums(tokens)
            n[self.length < length] = 0
            odd = tokens[self.plain[tokens]]
            if len(odd):  # who shares a word of two different characters shares two characters; the others are looked at
                alone, own = np.flatnonzero((n > 0) & (n == self.in_text.sums(odd))), set(letters)
                n[[k for k, held in zip(alone.tolist(), self.about.column("word").take(pa.array(alone)).to_pylist(), strict=True) if len(own & set(held)) < 2]] = 0
            label = self.in_label.sums(tokens)
            named = [k for name in labels for k in self.held.get(name, ())]
            label[named] = np.maximum(label[named], 1)
            some = np.flatnonzero(label)
            sizes = self.first[some + 1] - self.first[some]
            n[self.shot[_spread(self.first[some], sizes)]] += np.repeat(label[some], sizes)
            which = np.flatnonzero(n)
            if len(which):
                yield query_id, which, n[which]

    def draws(self, start: str, which: np.ndarray, k: int) -> list[tuple[str, int]]:
        """The ``k`` smallest (MD5 of ``start`` and the shot's key, place in ``which``)."""
        if self.messages is None:
            self.messages = _Messages([key.encode() for key in self.keys.to_pylist()])
        return self.messages.least(start.encode(), which, k)


_MD5_ADDED = [np.array([int(abs(math.sin(i + 1)) * 2**32)], np.uint32) for i in range(64)]
_MD5_TURNS = [(np.array([x], np.uint32), np.array([32 - x], np.uint32)) for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in turn * 4]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages whose MD5 is worked out at once.
MD5_AT_ONCE = 1 << 15


def md5_fronts(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first four bytes, as numbers that sort like the hexadecimal text, of the MD5 of ``n`` messages of one block: 16 words, each an array or the same for all. The last three of the 64 steps don't change them."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    t = np.empty(n, np.uint32)
    xor, both, either, add = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add
    for i in range(61):
        if i < 16:
            at = i
            xor(both(xor(c, d, t), b, t), d, t)
        elif i < 32:
            at = (5 * i + 1) % 16
            xor(both(xor(b, c, t), d, t), c, t)
        elif i < 48:
            at = (3 * i + 5) % 16
            xor(xor(b, c, t), d, t)
        else:
            at = 7 * i % 16
            xor(either(np.invert(d, t), b, t), c, t)
        add(a, t, a)
        word, more = words[at], _MD5_ADDED[i]
        if isinstance(word, np.ndarray):
            add(a, word, a)
        elif word:
            more = more + np.array([word], np.uint32)
        add(a, more, a)
        left, right = _MD5_TURNS[i]
        np.left_shift(a, left, t)
        add(either(np.right_shift(a, right, a), t, a), b, a)
        a, b, c, d = d, a, b, c
    return (b + np.array([_MD5_START[0]], np.uint32)).byteswap()


class _Messages:
    """MD5 of messages that begin alike and end with one of ``ends``. All ends are laid out as words once for each of the four places in a word where they can begin."""

    def __init__(self, ends: list[bytes]) -> None:
        self.ends, self.size = ends, np.fromiter(map(len, ends), np.uint32, len(ends))
        self.most = int(self.size.max(initial=0))
        self.laid: dict[int, np.ndarray] = {}

    def words(self, shift: int) -> np.ndarray:
        """The words of each end behind ``shift`` bytes, with the mark that ends a message."""
        if shift not in self.laid:
            width = (shift + self.most + 4) // 4 * 4
            laid = np.frombuffer(b"".join((bytes(shift) + end + b"\x80").ljust(width, b"\0") for end in self.ends), "<u4")
            self.laid[shift] = np.ascontiguousarray(laid.reshape(-1, width // 4).T.astype(np.uint32))
        return self.laid[shift]

    def least(self, start: bytes, which: np.ndarray, k: int) -> list[tuple[str, int]]:
        """The ``k`` smallest (hexadecimal MD5 of ``start`` and the end, place in ``which``)."""
        places = np.arange(len(which))
        if len(which) > k and len(start) + self.most <= 55:  # else more than one block
            whole, shift = len(start) // 4, len(start) % 4
            ends, fronts = self.words(shift), []
            given = np.frombuffer(start[: whole * 4], "<u4").tolist()
            begun = np.array([int.from_bytes(start[whole * 4 :], "little")], np.uint32)
            for i in range(0, len(which), MD5_AT_ONCE):
                part = which[i : i + MD5_AT_ONCE]
                words = [*given, *(row[part] for row in ends)]
                words[whole] |= begun
                words += [0] * (14 - len(words)) + [(self.size[part] + np.uint32(len(start))) << np.uint32(3), 0]
                fronts.append(md5_fronts(words[:16], len(part)))
            front = np.concatenate(fronts)
            places = np.flatnonzero(front <= np.partition(front, k - 1)[k - 1])
        base, found = hashlib.md5(start), []
        for j in places.tolist():
            draw = base.copy()
            draw.update(self.ends[int(which[j])])
            found.append((draw.hexdigest(), j))
        return heapq.nsmallest(k, found)


#: What is to be said of a group's shots and a piece of its queries (book, shots, queries).
Pairs = Callable[[str, _Shots, pa.Table], Iterator[pa.RecordBatch]]


def _every_overlap(book: str, shots: _Shots, queries: pa.Table) -> Iterator[pa.RecordBatch]:
    for query_id, which, n in shots.overlaps(queries):
        same = [pa.repeat(pa.scalar(x, pa.string()), len(which)) for x in (query_id, book)]
        yield pa.RecordBatch.from_arrays([*same, shots.keys.take(pa.array(which)), pa.array(n)], names=["query_id", "project", "key", "n"])


def _met(pairs: Pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows in order of (project, slot), of each group the shots before the queries: the shots are gathered, the queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, shots = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            of = list(zip(rows.column("project").to_pylist(), rows.column("slot").to_pylist(), rows.column("asks").to_pylist(), strict=True))
            begin = 0
            while begin < len(of):
                end = begin + 1
                while end < len(of) and of[end] == of[begin]:
                    end += 1
                if of[begin][:2] != group:
                    group, parts, shots = of[begin][:2], [], None
                piece = rows.slice(begin, end - begin)
                if not of[begin][2]:
                    parts.append(piece.drop_columns(["project", "slot", "asks", "labels"]))
                elif parts or shots:
                    if shots is None:
                        shots, parts = _Shots(pa.concat_tables(parts)), []
                    yield from pairs(group[0], shots, piece)
                begin = end

    return run


def _group(queries: DataFrame, shots: DataFrame, texts: DataFrame, words: DataFrame, pairs: Pairs, schema: str) -> DataFrame:
    """``pairs`` over groups of a book's shots with the book's queries. Shots and queries are tokenized once each, and are a row each with their words' numbers; what of a query and a label is held meets once
    for each different label, not for each shot. A group of shots has no fewer words than the book's queries, as far as a task can hold them, so what is repeated of the queries is little; a task
    holds one group's shots and one piece of the queries. No pair of a query and a shot is shuffled or written."""
    trees = table(lexicon.automata(words))
    q = table(queries.select(F.col("query_id").cast("string").alias("query_id"), "project", query_clean(F.col("text")).alias("q")).where(F.length("q") >= 2).distinct())
    labels = table(shots.select("project", shot_key().alias("key"), without_blanks(F.coalesce("label", F.lit(""))).alias("text")).where(F.length("text") >= 2))
    known = texts.select("project", shot_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.struct("chapter", F.col("pos").cast("int").alias("pos"), "shot_id").alias("about"))

    about = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("chapter", "int"), ("pos", "int"), ("shot_id", "string"))}
    in_text = lexicon.tokenized(known, trees, True).select("project", "key", F.lit("t").alias("kind"), "tokens", "n", F.col("lengths")[0].alias("length"), F.col("letters")[0].alias("word"), *(F.col("about")[0][c].cast(kind).alias(c) for c, kind in (("chapter", "int"), ("pos", "int"), ("shot_id", "string"))))
    in_label = lexicon.tokenized(labels.withColumn("about", F.col("text")), trees, True)
    in_label = in_label.select("project", "key", F.lit("l").alias("kind"), "tokens", "n", F.lit(None).cast("int").alias("length"), F.array_join(F.array_sort(F.array_distinct("about")), "\n").alias("word"), *about.values())
    rows = table(in_text.unionByName(in_label))

    asked = lexicon.tokenized(q.select("project", F.col("query_id").alias("key"), F.col("q").alias("text")), trees, False)
    asked = asked.select("project", F.col("key").alias("query_id"), "tokens", F.explode(F.arrays_zip("lengths", "letters")).alias("one")).select("project", "query_id", "tokens", F.col("one.lengths").alias("length"), F.col("one.letters").alias("word"))
    held = held_labels(q, labels.select("project", F.col("text").alias("label"))).groupBy("project", "query_id").agg(F.collect_list("label").alias("labels"))
    none = F.array().cast("array<string>")
    asked = table(asked.join(held, ["project", "query_id"], "left").withColumn("labels", F.coalesce("labels", none)))

    weight = F.size("tokens") + 1
    size = asked.groupBy("project").agg(F.least(F.sum(weight + F.size("labels")), F.lit(MOST_WORDS)).alias("entries"))
    groups = table(lexicon.slices(rows, size, GROUP_WORDS, weight))
    most = groups.agg(F.sum("slices")).first()[0] or 1
    slot = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slot")
    asked = asked.join(groups, "project").select("project", slot, F.lit(True).alias("asks"), F.lit("q").alias("kind"), F.col("query_id").alias("key"), "tokens", F.lit(None).cast("array<int>").alias("n"), "length", "word", *about.values(), "labels")
    rows = rows.join(groups, "project").select("project", F.pmod(F.xxhash64("key"), "slices").cast("int").alias("slot"), F.lit(False).alias("asks"), "kind", "key", "tokens", "n", "length", "word", "chapter", "pos", "shot_id", F.lit(None).cast("array<string>").alias("labels"))
    # the work is in the pairs, not in the bytes, so the number of partitions goes by the groups
    return rows.unionByName(asked).repartition(4 * most, "project", "slot").sortWithinPartitions("project", "slot", "asks").mapInArrow(_met(pairs), schema)


def token_counts(queries: DataFrame, shots: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, project, key, n): overlap of each query (query_id, project, text) with the shots of its book.

    The parts: words of the label in the query, at least one if label and query hold each other; words of the text, if it is as long as the query and they share two characters.
    """
    return _group(queries, shots, texts, words, _every_overlap, "query_id string, project string, key string, n long")


def token_hits(queries: DataFrame, shots: DataFrame, texts: DataFrame, words: DataFrame, k: int = QUOTA["token"], seed: str = "pick") -> DataFrame:
    """Hits of the token channel: the highest count (first in scan order), then others in an order that a seed decides.

    Each group of shots gives of a query only its best shot and the ``k`` smallest draws, so what meets for a query is a few rows a group, whatever it overlaps with.
    """

    def best(book: str, group: _Shots, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, rows, draws, counts = [], [], [], []
        for query_id, which, n in group.overlaps(queries):
            start, top = f"{seed}|{query_id}|", int(np.argmax(n))
            found = {j: draw for draw, j in group.draws(start, which, k)}
            if top not in found:
                found[top] = hashlib.md5((start + group.keys[int(which[top])].as_py()).encode()).hexdigest()
            ids += [query_id] * len(found)
            rows += which[list(found)].tolist()
            draws += found.values()
            counts += n[list(found)].tolist()
        about = [group.about.column(c).combine_chunks().take(pa.array(rows, pa.int64())) for c in ("chapter", "pos", "shot_id")]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([book] * len(ids), pa.string()), *about, pa.array(draws, pa.string()), pa.array(counts, pa.int64())], names=["query_id", "project", "chapter", "pos", "shot_id", "draw", "n"])

    rows = _group(queries, shots, texts, words, best, "query_id string, project string, chapter int, pos int, shot_id string, draw string, n long")
    by = Window.partitionBy("query_id")
    top = F.row_number().over(by.orderBy(F.col("n").desc(), "project", "chapter", "pos"))
    rank = F.row_number().over(by.orderBy(F.col("top").desc(), "draw"))
    rows = rows.withColumn("top", top == 1).withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select("query_id", F.lit("token").alias("channel"), "rank", F.lit(None).cast("double").alias("score"), *SHOT, "n")


def _unit(embeddings: pa.ChunkedArray) -> np.ndarray:
    m = embeddings.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embeddings), -1)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return m


def best_of_rows(m: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``m``, rows of ``v``, score) of the ``k`` highest products of each row of ``m`` in order, equal ones by row of ``v``. A matrix product rounds a pair by where it
    stands, so it only chooses which pairs are summed up one by one: equal vectors have equal scores, whatever they are multiplied with."""
    low = -(m @ v.T)
    if k < len(v):
        row, column = np.nonzero(~(low > np.partition(low, k - 1, axis=1)[:, k - 1 : k] + 1e-9))
    else:
        row, column = (x.ravel() for x in np.indices(low.shape))
    some = max(1, SCORES // max(1, v.shape[1]))
    score = np.concatenate([np.zeros(0), *((m[row[i : i + some]] * v[column[i : i + some]]).sum(axis=1) for i in range(0, len(row), some))])
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first], score[first]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = QUOTA["vec"], block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, channel, rank, score, project, chapter, shot_id): the most similar shots by exact cosine; a zero vector scores 0.

    Queries (query_id, embedding) are dealt over blocks of about ``block``, vectors over runs of about ``RUN``, and each run meets each block in a group of its own, which keeps the
    best k a query. A group multiplies a few queries at a time by its run, so it holds a run, a block and ``SCORES`` scores, however many there are. Nothing goes
    through the driver but the two counts.
    """
    blocks, runs = (max(1, math.ceil(df.count() / size)) for df, size in ((queries, block), (vectors, RUN)))
    kind = dict(queries.dtypes)["query_id"]

    def best(run: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if run.num_rows and asked.num_rows:
            run = run.take(pc.sort_indices(run, sort_keys=[(c, "ascending") for c in SHOT], null_placement="at_start"))
            v, m = _unit(run.column("embedding")), _unit(asked.column("embedding"))
            some = max(1, SCORES // len(v))
            for i in range(0, len(m), some):
                row, column, score = best_of_rows(m[i : i + some], v, k)
                found.append((row + i, column, score))
        row, column, score = (np.concatenate([np.zeros(0, t), *(f[j] for f in found)]) for j, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"query_id": asked.column("query_id").take(row), **{c: run.column(c).take(column) for c in SHOT}, "score": score})

    in_run, in_block = (F.pmod(F.xxhash64(*of), F.lit(n)).cast("int") for of, n in ((SHOT, runs), (["query_id"], blocks)))
    asked = queries.select("query_id", "embedding", in_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    laid = vectors.select(*SHOT, "embedding", in_run.alias("of_run"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("of_block"))
    rows = laid.groupBy("of_run", "of_block").cogroup(asked.groupBy("run", "block")).applyInArrow(best, f"query_id {kind}, project string, chapter int, shot_id string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *SHOT))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.lit("vec").alias("channel"), "rank", "score", *SHOT)


def merged(*channels: DataFrame) -> DataFrame:
    """Hits of the channels in their order; a shot found twice by a query stays where it came first."""
    rows = None
    for i, hits in enumerate(channels):
        part = hits.select(F.col("query_id").cast("string").alias("query_id"), "channel", "rank", F.col("score").cast("double").alias("score"), *SHOT, F.lit(i).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    first = F.row_number().over(Window.partitionBy("query_id", *SHOT).orderBy("at", "rank"))
    rows = rows.withColumn("first", first).where("first = 1").drop("first")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "rank"))
    return rows.withColumn("place", place).drop("at")


def described(hits: DataFrame, shots: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with type, functions, label and text, scores to three decimals; hits without text go."""
    s = shots.select(*SHOT, "type", "funcs", "label")
    rows = hits.join(s, SHOT).join(texts.select(*SHOT, "text"), SHOT).where("text <> ''")
    return rows.withColumn("score", fixed(F.col("score"), F.lit(3)))


def context_blocks(refs: DataFrame) -> DataFrame:
    """(query_id, block): the numbered references of a query."""
    head = F.concat(F.lit("[RAG-"), "place", F.lit("] ("), "type", F.lit("|"), F.array_join("funcs", ","), F.lit(") "), "project", F.lit("·第"), padded(F.col("chapter")), F.lit("章:镜"), "shot_id", F.lit("「"), "label", F.lit("」\n"), "text")
    return ordered_text(refs, ["query_id"], ["place"], head, "\n\n", "block")


def known_books(requests: DataFrame, shots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests for books that there are, and the others (a warning each). R13: no book named means all."""
    books = shots.select("project").distinct()
    named = F.col("project").isNotNull() & (F.col("project") != "")
    return requests.where(~named).unionByName(requests.where(named).join(books, "project", "left_semi").select(*requests.columns)), requests.where(named).join(books, "project", "left_anti")


def embedding_inputs(texts: DataFrame, most: int = 500) -> DataFrame:
    """Trimmed texts cut to ``most`` characters, blank ones left out, each different one once with its keys apart."""
    return texts.select(*SHOT, F.substring(trimmed(F.col("text")), 1, most).alias("input")).where("input <> ''")


def embedded(inputs: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 32) -> DataFrame:
    """(input, embedding) of the distinct inputs; ``embed`` gets batches of ``size`` and keeps their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), size):
                part = list(rows["input"].iloc[i : i + size])
                yield pd.DataFrame({"input": part, "embedding": embed(part)})

    return inputs.select("input").distinct().mapInPandas(run, "input string, embedding array<float>")


def vector_plan(manifest: DataFrame, index: DataFrame, model: str, dim: int, reset: bool = False) -> DataFrame:
    """(project, chapter, rebuild): chapters without a vector record or with a changed one; all of a book after a reset or a change of model or size."""
    books = index.groupBy("project").agg(F.bool_or((F.col("model") != model) | (F.col("dim") != dim)).alias("changed"))
    rows = manifest.join(index.select("project", "chapter", "source_mtime"), ["project", "chapter"], "left").join(books, "project", "left")
    rebuild = F.lit(reset) | F.coalesce("changed", F.lit(False)) | ~F.col("source_mtime").eqNullSafe(F.col("shot_mtime"))
    return rows.select("project", "chapter", rebuild.alias("rebuild"))


def vector_stats(index: DataFrame) -> DataFrame:
    """(project, shots, chapters)."""
    return index.groupBy("project").agg(F.sum("shot_count").alias("shots"), F.count(F.lit(1)).alias("chapters"))
