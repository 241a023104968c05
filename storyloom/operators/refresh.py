"""Refresh of derived tables after some chapters changed: only books and chapters that the manifests tell apart are counted, built or embedded again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators import lexicon, recall
from storyloom.sources.checkpoints import table

CHAPTER = ["project", "chapter"]


@dataclass
class Derived:
    """What is stored of books: counts of characters and of pairs (project, gram, n), and lexicons (project, word, from_label, freq)."""

    unigrams: DataFrame
    bigrams: DataFrame
    words: DataFrame


def built(shots: DataFrame, sentences: DataFrame) -> Derived:
    """All of it, from all sentences."""
    clean = table(lexicon.packed(sentences))
    grams = table(lexicon.gram_counts(clean))
    one, two = lexicon.of_size(grams, 1), lexicon.of_size(grams, 2)
    return Derived(one, two, lexicon.lexicon_of(shots, clean, lexicon.pmi_of_counts(one, two)))


def changed_chapters(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(project, chapter, is_old, is_new) of the chapters whose manifest rows (L7) differ: those that were there, and those that are there now."""
    a, b = (m.select(*CHAPTER, F.struct("shot_mtime", "sent_mtime").alias(name)) for m, name in ((now, "now"), (recorded, "then")))
    rows = a.join(b, CHAPTER, "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
    return rows.select(*CHAPTER, F.col("then").isNotNull().alias("is_old"), F.col("now").isNotNull().alias("is_new"))


def merged_counts(stored: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(project, gram, n): the stored counts without those of the removed chapters and with those of the added ones. Grams that are gone have no row."""
    signed = stored.select("project", "gram", "n").unionByName(removed.select("project", "gram", (-F.col("n")).alias("n"))).unionByName(added.select("project", "gram", "n"))
    return signed.groupBy("project", "gram").agg(F.sum("n").alias("n")).where("n <> 0")


def refreshed(stored: Derived, shots: DataFrame, sentences: DataFrame, was: DataFrame, changed: DataFrame) -> Derived:
    """``stored`` brought up to the present ``shots`` and ``sentences``; ``was``: the sentences (project, chapter, text) of changed chapters as they were counted.

    Counts move by those of the changed chapters alone. A pair's bond depends on the counts of its whole book, so the lexicons of books with a changed chapter are made anew, from
    the merged counts; all other lexicons stay as they are. The result is that of ``built``. Books without sentences have no counts and those without shots no labels.
    """
    changed = table(changed)
    gone = lexicon.packed(was.join(changed.where("is_old"), CHAPTER, "left_semi"))
    new = lexicon.packed(sentences.join(changed.where("is_new"), CHAPTER, "left_semi"))
    grams = table(merged_counts(stored.unigrams.unionByName(stored.bigrams), lexicon.gram_counts(gone), lexicon.gram_counts(new)))
    one, two = lexicon.of_size(grams, 1), lexicon.of_size(grams, 2)
    books = table(changed.select("project").distinct())
    of_books = [x.join(books, "project", "left_semi") for x in (shots, one, two)]
    clean = table(lexicon.packed(sentences.join(books, "project", "left_semi")))
    rebuilt = lexicon.lexicon_of(of_books[0], clean, lexicon.pmi_of_counts(*of_books[1:]))
    return Derived(one, two, stored.words.join(books, "project", "left_anti").select(*rebuilt.columns).unionByName(rebuilt))


def refreshed_vectors(stored: DataFrame, plan: DataFrame, inputs: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors (project, chapter, shot_id, embedding) after a plan (project, chapter, rebuild): those of its other chapters stay, the shots of chapters to rebuild are
    embedded, each different input once. Chapters that the plan doesn't list are gone."""
    kept = stored.join(plan.where("not rebuild"), CHAPTER, "left_semi").select(*recall.SHOT, "embedding")
    todo = inputs.join(plan.where("rebuild"), CHAPTER, "left_semi")
    made = todo.join(recall.embedded(todo, embed), "input").select(*recall.SHOT, "embedding")
    return kept.unionByName(made)
