"""Spelling variant grouping: a rare-first prefix filter over positional bigrams.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import ascii_lower, durable, table

#: Letters of a word, and the fewest code points and occurrences of one.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as the words that follow it.
RATIO = 10
#: One edit spoils two bigrams, so of the three rarest one is left, in both words.
RAREST = 3


def letter_runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of letters of at least ``least`` code points, A to Z lower-cased; null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def count_words(words: DataFrame, word: str = "word", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough; nulls are none."""
    return words.where(F.length(word) >= least_length).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """words with ``rare``: its three rarest bigrams' places (from 0), by the order of all words' bigrams.

    Bigrams are ordered by how often they occur in all words, then by
    themselves, then by place. They are no more than the square of the letters
    in use, 8,100 for LETTERS, so their counts are broadcast; where the letters
    are so many that it is beyond 100,000, they are joined by shuffle.
    """
    letters = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))
    grams = words.select("word", F.posexplode(letters).alias("at", "gram"))
    counts = durable(grams.groupBy("gram").agg(F.count("*").alias("all")))
    small = counts.count() <= 100_000
    ranked = grams.join(F.broadcast(counts) if small else counts, "gram")
    rare = F.slice(F.array_sort(F.collect_list(F.struct("all", "gram", "at"))), 1, RAREST)
    return words.join(ranked.groupBy("word").agg(F.transform(rare, lambda g: g["at"]).alias("rare")), "word")


def _keys(word: Column, at: Column) -> Column:
    """What a word shares with every word one edit away that keeps the bigram at ``at``, an array of hashes.

    The edit is wholly behind the bigram or wholly before it, and there in the
    first or the second half; all else is shared. With kind 0, both words are
    of one length; with 1, this is the shorter, and with 2 the longer, whose
    place is then one more if the edit is before it. Halves are cut by the
    shorter word's length.
    """
    size = F.length(word)

    def behind(short: Column, more: int) -> list[Column]:
        half = (short - at - 2) / 2
        cut = at + 2 + half.cast("int")
        # the edit in the second half, then in the first; what is behind it counts from the end
        return [F.substr(word, F.lit(1), cut), F.concat(F.substr(word, F.lit(1), at + 2), F.lit("\t"), F.substr(word, cut + 1 + more, size))]

    def before(place: Column, more: int) -> list[Column]:
        cut = (place / 2).cast("int")
        return [F.concat(F.substr(word, F.lit(1), cut), F.lit("\t"), F.substr(word, at + 1, size)), F.substr(word, cut + 1 + more, size)]

    def tag(found: list[Column], side: str, short: Column, place: Column, kind: int, room: Column) -> list[Column]:
        keys = [F.xxhash64(F.lit(f"{side}{i}{'=' if kind == 0 else '+'}"), short, place, k) for i, k in enumerate(found)]
        return [F.struct(F.when(room, k).alias("key"), F.lit(kind).alias("kind")) for k in keys]

    out = []
    for kind, short in ((0, size), (1, size), (2, size - 1)):
        more = 1 if kind == 2 else 0
        out += tag(behind(short, more), "b", short, at, kind, F.lit(True) if kind == 1 else at + 2 < size)
        out += tag(before(at - more, more), "a", short, at - more, kind, F.lit(True) if kind == 1 else at > 0)
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words that differ by just one inserted, deleted or replaced code point, once.

    words: distinct words of at least four letters and their counts, (word, n).
    Words meet on one of their three rarest bigrams, at one place or the next,
    together with half of what an edit must leave on its side of the bigram;
    without that, common beginnings would meet in the square of their number.
    Words that meet are verified inside the join, so only near pairs leave it.
    """
    at = F.explode("rare").alias("at")
    keyed = rarest_bigrams(words).select("word", "n", at).select("word", "n", F.explode(_keys(F.col("word"), F.col("at"))).alias("k"))
    keyed = keyed.where("k.key is not null").select("word", "n", F.col("k.key").alias("key"), F.col("k.kind").alias("kind"))
    a, b = keyed.alias("a"), keyed.alias("b")
    fits = ((F.col("a.kind") == 0) & (F.col("b.kind") == 0) & (F.col("a.word") < F.col("b.word"))) | ((F.col("a.kind") == 1) & (F.col("b.kind") == 2))
    near = (F.col("a.key") == F.col("b.key")) & fits & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    return a.join(b, near).select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb")).distinct()


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for each row of words.

    words: distinct words and their counts, (word, n); words of fewer than
    four letters have too few bigrams to meet and are near none. form: the near
    word of largest n, of equals the first in code-point order, if it occurs at
    least ``ratio`` times as often; else null. root: the last of the forms of
    forms, the word itself without one. n_near: near words. An empty table
    gives an empty one.

    The counts of forms grow by ``ratio`` from form to form, which bounds their
    chain by the largest count, so a fixed few joins follow all of them. A word
    has at most some hundreds of near words for each of its letters, so no
    group is large.
    """
    words = durable(words.select("word", "n"))
    pairs = durable(near_pairs(words.where(F.length("word") > RAREST)))
    each = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    has_form = -F.col("best.m") >= ratio * F.col("n")
    found = durable(
        words.join(best, "word", "left").select(
            "word", "n", F.when(has_form, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has_form, -F.col("best.m")).alias("form_n")
        )
    )
    most = words.agg(F.max("n")).first()[0] or 1
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log(most, ratio)))))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = durable(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def misspelt(key: Column, run: Column, one_in: int = 31) -> Column:
    """The run, for one in ``one_in`` of the pairs of key and run without one of its code points, by their crc32; a null key counts as empty."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))).otherwise(run)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(letter_runs(F.col("text"))).alias("run"))
    words = count_words(docs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")))
    return group_variants(words)


#: crc32 by its table of 256; words meet on what is left of them without one code point.
ORACLE = r"""
WITH RECURSIVE b AS (
    SELECT cast(i AS bigint) AS i, cast(i AS bigint) AS c, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM b WHERE k < 8
), crc AS MATERIALIZED (
    SELECT list(c ORDER BY i) AS lookup FROM b WHERE k = 8
), d AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), p AS MATERIALIZED (
    SELECT doc_id, run, count(*) AS times, coalesce(cast(doc_id AS varchar), '') || ':' || run AS s FROM d GROUP BY ALL
), h AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_prepend(cast(4294967295 AS bigint), flatten(list_transform(string_split(s, ''), lambda y: CASE WHEN unicode(y) < 128 THEN [cast(unicode(y) AS bigint)] ELSE [cast(192 + unicode(y) // 64 AS bigint), cast(128 + unicode(y) % 64 AS bigint)] END))),
        lambda a, y: xor(a // 256, lookup[xor(a % 256, y) + 1])
    )) AS h FROM p, crc
), w AS MATERIALIZED (
    SELECT word, cast(sum(times) AS bigint) AS n FROM (
        SELECT times, CASE WHEN h % 31 = 0 THEN left(run, cast(h % length(run) AS bigint)) || substr(run, cast(h % length(run) AS bigint) + 2) ELSE run END AS word FROM h
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), x AS MATERIALIZED (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), y AS MATERIALIZED (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM x
), near AS MATERIALIZED (
    SELECT a.word, b.word AS near, b.n AS m FROM y a JOIN y b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT y.word, w.word, w.n FROM y JOIN w ON y.rest = w.word
    UNION SELECT w.word, y.word, y.n FROM y JOIN w ON y.rest = w.word
), g AS (
    SELECT word, count(*) AS n_near, min(struct_pack(m := -m, near := near)) AS best FROM near GROUP BY word
), f AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * w.n THEN best.near END AS form, CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n FROM w LEFT JOIN g USING (word)
), r AS (
    SELECT word, word AS root, form AS next, 0 AS depth FROM f
    UNION ALL
    SELECT r.word, f.word, f.form, depth + 1 FROM r JOIN f ON r.next = f.word
)
SELECT f.word, f.n, f.form, arg_max(r.root, r.depth) AS root, f.n_near, f.form_n FROM f JOIN r USING (word) GROUP BY ALL
"""
