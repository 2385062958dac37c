"""Spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words that differ by one inserted, deleted or replaced code point, one
(the longer, or either) is cut into two disjoint chunks of half its length.
The edit touches one of them at most, so the other is a positional gram of the
second word, shifted by one place at most.  The first chunk can only stand at
place 0 and the second only at the shift that the lengths give (0, or -1 if
the second word is shorter), so of the second word's grams only these are
sent.  Both sides meet in an equi-join on (length, chunk, text), and an edit
distance of exactly 1 is verified.

Where many words share a chunk, the rest of them is cut in the same way: what
follows (or precedes) an equal chunk is again one edit apart.  Such a key is
refined until it is small, or until the rest is one letter, and then the
alphabet bounds it.  No key emits all pairs of an unbounded group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize
from .common import small_batches, text_or_empty

RUN = re.compile("[a-zÀ-ÿ]+")  # A-Z are lower-cased before
SHORTEST = 5
RAREST = 3
#: A form is at least so many times as frequent as its variant.
TIMES = 2
#: Keys with more chunk words times gram words than this are refined.
PAIRS = 250_000
#: Distinct words a task counts before it hands its counts on.
HELD = 200_000


# --- words -----------------------------------------------------------------

def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                change: Callable[[int | None, str], str] | None = None, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words of all texts.  ``change(id, run)`` may replace a
    run; equal runs of one row change alike."""
    import pyarrow as pa

    def work(batches):
        total: Counter = Counter()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: only A-Z change
                for run, n in Counter(RUN.findall(lower)).items():
                    word = run if change is None else change(doc, run)
                    if len(word) >= shortest:
                        total[word] += n
            if len(total) > HELD:
                yield handed()
                total.clear()
        if total:
            yield handed()

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


# --- pairs one edit apart --------------------------------------------------

def _cut(rows: DataFrame) -> DataFrame:
    """Each row under its first and its second chunk, with the rest of the word.
    ``size`` is the length of the chunk word's rest, for both sides."""
    half = F.floor(F.col("size") / 2).cast("int")
    tail = F.col("size") - half
    first = F.struct(F.concat("key", F.lit("<"), F.substr("rest", F.lit(1), half)).alias("key"),
                     F.substr("rest", half + 1, F.char_length("rest")).alias("rest"), tail.alias("size"))
    second = F.struct(F.concat("key", F.lit(">"), F.substr("rest", F.char_length("rest") - tail + 1, tail)).alias("key"),
                      F.substr("rest", F.lit(1), F.char_length("rest") - tail).alias("rest"), half.alias("size"))
    return rows.select("word", "is_chunk", F.explode(F.array(first, second)).alias("c")).select("word", "is_chunk", "c.*")


def _verified(rows: DataFrame) -> DataFrame:
    chunk = rows.filter("is_chunk").select("key", F.col("word").alias("a"))
    gram = rows.filter("not is_chunk").select("key", F.col("word").alias("b"))
    longer = F.char_length("a") > F.char_length("b")
    return chunk.join(gram, "key").filter((longer | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, b): each pair of distinct ``words.word`` one edit apart, once.  Words
    need two code points or more."""
    size = F.char_length("word")
    # A word is the chunk side of words of its length and of one less.
    sides = F.array(F.struct(F.lit(True).alias("is_chunk"), size.alias("size")), F.struct(F.lit(False).alias("is_chunk"), size.alias("size")),
                    F.struct(F.lit(False).alias("is_chunk"), (size + 1).alias("size")))
    rows = words.select("word", F.explode(sides).alias("s")).select(
        "word", "s.is_chunk", F.col("s.size").cast("string").alias("key"), F.col("word").alias("rest"), "s.size")
    found = None
    while True:
        rows = materialize(_cut(rows), "chunks")
        many = rows.groupBy("key").agg(F.count_if("is_chunk").alias("chunks"), F.count_if(~F.col("is_chunk")).alias("grams"), F.max("size").alias("size"))
        hot = materialize(many.filter((F.col("chunks") * F.col("grams") > pairs) & (F.col("size") > 1)).select("key"), "hot_chunks")
        none_hot = hot.isEmpty()
        some = _verified(rows if none_hot else rows.join(broadcast_if_small(hot), "key", "left_anti"))
        found = some if found is None else found.unionByName(some)
        if none_hot:
            return found.distinct()
        rows = rows.join(broadcast_if_small(hot), "key", "left_semi")


# --- forms -----------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of the chain of forms.
    Pointers double their reach a round; a chain is no longer than the
    doublings of a count, so six rounds end any."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(up.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "pointers")
        if moved.filter("went").isEmpty():
            return moved.drop("went")
        up = moved.drop("went")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             change: Callable[[int | None, str], str] | None = None, pairs: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of at least ``SHORTEST``
    code points and ``RAREST`` occurrences.  ``n_near`` counts the words one
    edit apart; the form is the most frequent of them (ties: the smallest in
    code-point order) if it is at least twice as frequent, else null; the root
    follows the forms to the last, and is the word itself without a form.

    Null and empty texts have no words; a row without an id counts like any
    other (``change`` gets None).  Repeated rows count as often as they stand.
    An empty table, or one without such words, gives no rows; other columns
    are ignored.
    """
    words = materialize(word_counts(docs, id_col, text_col, change), "words")
    pair = materialize(near_pairs(words, pairs), "near_pairs")
    both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("word"))).alias("top"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("top.word").alias("top"), (-F.col("top.minus")).alias("top_n"))
    is_form = F.col("top_n") >= TIMES * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                  F.when(is_form, F.col("top")).alias("form"), F.when(is_form, F.col("top_n")).alias("form_n"))
    out = materialize(out, "forms")
    last = roots(out.filter("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
