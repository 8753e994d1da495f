"""Evaluation texts leaking into a corpus.

Method: a prefix-filtered set join. Items and documents become sets of shingles of eight consecutive words of normalised
text. Each place of a shingle covers eight words of the item, so half of an item's n words can only be covered by at least
``need = ceil(n / 16 / m)`` of its shingles, m being the most places that one of them has in the item.

* A first pass over all documents counts in how many each word of the items occurs; a shingle is the rarer, the smaller
  the product of its words' shares.
* A document that leaks the item must hold one of its ``size - need + 1`` rarest shingles (the prefix). Only prefix
  shingles are joined with the documents' windows, and the places where they meet are kept.
* Length: a document of fewer than ``need`` windows can't leak the item. Position: the words that the met places cover, with
  those that all places outside the prefix could cover, must be half of the item's.
* The pairs left are verified by exact containment of the item's eight-word windows in the document's words, and the
  covered words are counted.

Documents are normalised once, into a written table. A window's hash is rolled from the hashes of its words (each turned
by its place), so no window is ever built as text before verification; hashes that clash only cost a verification.

Normalisation ignores letter case, accents, punctuation, Unicode form, kinds of blanks and hyphens, line breaks, line
markers and inline markup of any length. A hyphen inside a word, also at a line end, joins its parts.

Odd input: null and empty texts and items of fewer than eight words match nothing; documents repeated under another id
are reported each; very long documents are handled as arrays of words, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.text import nfkd
from granaria.session import Workspace

SPAN = 8
SHARE = 0.5


def plain_words(text: Column) -> Column:
    """The normalised words, joined by single blanks. Every pattern stops at a character that begins the next match, so
    the time is proportional to the text."""
    t = F.lower(nfkd(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, r"[\p{M}\p{Cf}]+", "")
    t = F.translate(t, "đłøı", "dloi")
    t = F.regexp_replace(t, r"</?[a-z][^<>]*+>|\]\([^()\s]*+\)|&(?:[a-z][a-z0-9]*+|#\d++|#x[0-9a-f]++);", "")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N}])[\p{Pd}−](?:[ \t]*+\r?\n[ \t]*+(?:[>*|#+\p{Pd}]++[ \t]*+)?)?(?=[\p{L}\p{N}])|(?<=\p{L})['’ʼ](?=\p{L})", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def _once(rows: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``rows`` with an array computed once for each row, wherever later expressions use it."""
    return rows.select(*keep, F.explode(F.array(value)).alias(name))


def word_hashes(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, h): hashes of the words of ``body``; texts of fewer than SPAN words fall away."""
    words = _once(rows, "w", F.split("body", " "), *keep).where(F.size("w") >= SPAN)
    return _once(words, "h", F.transform("w", lambda x: F.xxhash64(x)), *keep)


def windows(hashed: DataFrame, *keep: str) -> DataFrame:
    """(keep, place, shingle): the rolled hash of every window of SPAN words and the place of its first word, from 0."""
    rows = hashed
    for step in (1, 2, 4):  # the words of a window of 2 * step are those of two of ``step``
        turned = lambda b: F.shiftleft(b, step).bitwiseOR(F.shiftrightunsigned(b, 64 - step))  # noqa: E731, B023
        rows = _once(rows, "h", F.zip_with("h", F.slice("h", 1 + step, F.size("h")), lambda a, b: a.bitwiseXOR(turned(b))), *keep)  # noqa: B023
    return rows.select(*keep, F.posexplode("h").alias("place", "shingle")).where("shingle is not null")


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered_words, item_words) of every document that leaks an item."""
    ws = Workspace(documents.sparkSession, "leakage")
    item = items.select("item_id", plain_words(F.col("text")).alias("body"))
    item = ws.save(item.withColumn("words", F.size(F.split("body", " "))).where(f"words >= {SPAN}"), "items")
    hashed = ws.save(word_hashes(item, "item_id", "words"), "item_hashes")
    bodies = ws.save(documents.select("doc_id", plain_words(F.col("text")).alias("body")).where("body != ''"), "bodies")

    # rarity: documents that hold each word of the items
    vocabulary = ws.save(hashed.select(F.explode("h").alias("word")).distinct(), "vocabulary")
    held = word_hashes(bodies, "doc_id").select("doc_id", F.explode(F.array_distinct("h")).alias("word"))
    rarity = ws.save(held.join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("docs")), "rarity")

    # tokens of the items: shingles with their places, ordered by the sum of their words' logarithms
    placed = windows(hashed, "item_id", "words")
    each = hashed.select("item_id", F.posexplode("h").alias("at", "word")).join(rarity, "word", "left").select("item_id", "at", F.log1p(F.coalesce("docs", F.lit(0)).cast("double")).alias("log"))
    weighed = placed.select("item_id", "words", "place", "shingle", F.explode(F.sequence(F.col("place"), F.col("place") + (SPAN - 1))).alias("at")).join(each, ["item_id", "at"])
    weighed = weighed.groupBy("item_id", "words", "place", "shingle").agg(F.round(F.sum("log"), 6).alias("commonness"))
    tokens = weighed.groupBy("item_id", "words", "shingle").agg(F.min("commonness").alias("commonness"), F.array_sort(F.collect_list("place")).alias("places"))
    need = F.ceil(F.ceil(F.col("words") * SHARE) / (F.max(F.size("places")) * SPAN)).cast("int")
    ordered = tokens.groupBy("item_id", "words").agg(need.alias("need"), F.array_sort(F.collect_list(F.struct("commonness", "shingle", "places"))).alias("t"))
    cut = F.size("t") - F.col("need") + 1
    rest = F.flatten(F.transform(F.slice("t", cut + 1, F.size("t")), lambda x: x["places"]))
    prefix = ordered.select("item_id", "words", "need", rest.alias("rest"), F.explode(F.slice("t", F.lit(1), cut)).alias("x"))
    prefix = ws.save(prefix.select("item_id", "words", "need", "rest", "x.shingle", "x.places"), "prefix")

    # the join on prefix tokens alone; shingles first, so that a shingle of many items meets each window once
    wanted = prefix.select("shingle").distinct()
    met = windows(word_hashes(bodies, "doc_id").withColumn("windows", F.size("h") - (SPAN - 1)), "doc_id", "windows").join(wanted, "shingle").select("doc_id", "windows", "shingle").distinct()
    met = ws.save(met, "met").join(prefix, "shingle").where("windows >= need")
    reach = F.array_distinct(F.flatten(F.transform(F.concat(F.flatten(F.collect_list("places")), F.first("rest")), lambda i: F.sequence(i, i + (SPAN - 1)))))
    bounded = met.groupBy("doc_id", "item_id", "words").agg(F.size(reach).alias("reach")).where(F.col("reach") >= F.col("words") * SHARE)
    pairs = ws.save(bounded.select("doc_id", "item_id"), "pairs")

    candidates = bodies.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.concat(F.lit(" "), "body", F.lit(" ")).alias("text"))
    both = pairs.join(candidates, "doc_id").join(item.select("item_id", "words", F.split("body", " ").alias("w")), "item_id")
    window = lambda i: F.concat(F.lit(" "), F.array_join(F.slice(F.col("w"), i, SPAN), " "), F.lit(" "))
    starts = F.filter(F.sequence(F.lit(1), F.col("words") - (SPAN - 1)), lambda i: F.contains(F.col("text"), window(i)))
    both = both.select("doc_id", "item_id", "words", F.explode(F.array(starts)).alias("starts"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (SPAN - 1))))))
    return both.select("doc_id", "item_id", covered.alias("covered_words"), F.col("words").alias("item_words")).where(F.col("covered_words") >= F.col("item_words") * SHARE).distinct()
