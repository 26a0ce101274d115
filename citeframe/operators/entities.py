"""Records a question names.

Matching runs between distinct lower-cased questions and distinct names, through hash keys only. Substrings are found
by an index of character grams: each pattern is posted under its rarest gram and met by the texts that have it.
Words in common are found from a name's rarer words on, so that a word in many names forms no candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SP, only_words, split_words
from ..session import cut, part_of, store
from .joins import lookup_join

# Characters of a gram
GRAM = 3


def name_key(c: Column) -> Column:
    return only_words(c)


def distinct_names(records: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """(name_key, words, own), cut for reuse: ``own`` are the words that are not stop words,
    repeats kept."""
    return cut(
        records.select(name_key(F.col("name")).alias("name_key")).distinct()
        .withColumn("words", split_words(F.col("name_key")))
        .withColumn("own", F.filter("words", lambda w: ~w.isin(*stops)))
    )


def name_bigrams(names: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """(name_key, a, b) for neighbouring words that are not both stop words."""
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    kept = F.filter(pairs, lambda p: ~(p["a"].isin(*stops) & p["b"].isin(*stops)))
    return names.select("name_key", F.explode(F.array_distinct(kept)).alias("p")).select("name_key", "p.a", "p.b")


def numbered(unique: DataFrame) -> DataFrame:
    """(uq, n), cut, which fixes the numbers: relations of words and grams carry a number instead of the question."""
    return unique if "n" in unique.columns else cut(unique.select("uq", F.monotonically_increasing_id().alias("n")))


def _named(found: DataFrame, questions: DataFrame) -> DataFrame:
    """(uq, name_key) for (n, name_key)."""
    return lookup_join(found, questions, ["n"], ["name_key"]).select("uq", "name_key")


def grams(c: Column, size: int | Column) -> Column:
    """All substrings of ``size`` characters, each once."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(c) - size + 1)
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, size)))).otherwise(
        F.array().cast("array<string>")
    )


def substring_pairs(texts: DataFrame, patterns: DataFrame, kind: Sequence[str] = ()) -> DataFrame:
    """(t, p) where the text contains the pattern; ``texts`` (t) and ``patterns`` (p) are distinct, no pattern is empty.
    Columns named by ``kind`` say which texts a pattern is looked for in.

    A pattern is posted once, under that of its grams that the fewest patterns have; a text has a row for each of its
    grams under which some pattern is posted.
    """
    short = F.least(F.length("p"), F.lit(GRAM))
    own = patterns.select(*kind, "p", F.explode(grams(F.col("p"), short)).alias("gram"))
    rarity = own.groupBy(*kind, "gram").agg(F.count("*").alias("patterns"))
    rarest = own.join(rarity, [*kind, "gram"]).groupBy(*kind, "p").agg(F.min(F.struct("patterns", "gram")).alias("r"))
    posted = cut(rarest.select(*kind, "p", "r.gram"))
    # grams of the sizes that patterns are posted under
    least = posted.agg(F.coalesce(F.min(F.length("gram")), F.lit(GRAM)).alias("n")).scalar()
    none = F.array().cast("array<string>")
    had = F.concat(*[F.when(least <= n, grams(F.col("t"), n)).otherwise(none) for n in range(1, GRAM + 1)])
    met = lookup_join(texts.select(*kind, "t", F.explode(had).alias("gram")), posted, [*kind, "gram"], ["t"], where=F.contains("t", "p"))
    return met.select(*kind, "t", "p")


PAIR, ODD = "pair", "odd"


def _patterns(names: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """(kind, p, name_key): what a question must contain to name a name: two neighbouring words of it; or, of names whose full
    occurrence does not imply such a pair (a single word, stop words only, irregular spacing), the longest word, or all
    of it if it has no word."""
    bigrams = name_bigrams(names, stops)
    pairs = bigrams.select(F.lit(PAIR).alias("kind"), F.concat_ws(" ", "a", "b").alias("p"), "name_key")
    usable = names.join(bigrams.select("name_key").distinct(), "name_key", "left_semi")
    regular = usable.where(F.col("name_key") == F.array_join("words", " ")).select("name_key")
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    odd = names.where("name_key is not null").join(regular, "name_key", "left_anti").select(
        F.lit(ODD).alias("kind"), F.coalesce(longest["w"], F.col("name_key")).alias("p"), "name_key"
    )
    return cut(pairs.unionByName(odd))


def _contained(unique: DataFrame, patterns: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(n, kind, name_key) where a pattern of one of the ``kinds`` occurs in the question.

    A pair holds one space, so it occurs iff it occurs in some two space-separated neighbours; a word or run of blanks
    occurs iff it occurs in one of the question's. These are looked at once however many questions have them.
    """
    clean = only_words(F.col("uq"))
    tokens = F.split(clean, " ")
    size = F.greatest(F.size(tokens) - 1, F.lit(0))
    both = F.zip_with(
        F.slice(tokens, F.lit(1), size), F.slice(tokens, F.lit(2), size),
        lambda x, y: F.when((x != "") & (y != ""), F.concat_ws(" ", x, y)),
    )
    pieces = {
        PAIR: F.array_distinct(F.array_compact(both)),
        ODD: F.array_union(split_words(clean), F.regexp_extract_all(clean, F.lit(f"({SP}+)"))),
    }
    parts = [unique.select("n", F.lit(k).alias("kind"), F.explode(pieces[k]).alias("t")) for k in kinds]
    texts = store(reduce(DataFrame.unionByName, parts), "pieces")
    wanted = patterns.where(F.col("kind").isin(*kinds) & (F.col("p") != ""))
    found = cut(substring_pairs(texts.select("kind", "t").distinct(), wanted.select("kind", "p").distinct(), ["kind"]))
    said = lookup_join(texts, found, ["kind", "t"], ["n"]).select("n", "kind", "p").distinct()
    return lookup_join(said, part_of(wanted, patterns), ["kind", "p"], ["n"]).select("n", "kind", "name_key").distinct()


def _odd_full(near: DataFrame, unique: DataFrame, patterns: DataFrame) -> DataFrame:
    """(n, name_key) of the ``near`` odd names that the question contains whole."""
    clean = only_words(F.col("uq"))
    named = lookup_join(near, unique, ["n"], ["name_key"]).where(clean.contains(F.col("name_key"))).select("n", "name_key")
    # an empty name is in every question
    empty = patterns.where("name_key = ''").agg((F.count("*") > 0).alias("any")).scalar()
    every = unique.where(F.col("uq").isNotNull() & empty).select("n", F.lit("").alias("name_key"))
    return named.unionByName(every)


def match_bigrams(unique: DataFrame, names: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """(uq, name_key) where two neighbouring words "a b" of the name occur in the cleaned question."""
    unique = numbered(unique)
    return _named(_contained(unique, _patterns(names, stops), [PAIR]).select("n", "name_key"), unique)


def name_word_pairs(names: DataFrame) -> DataFrame:
    """(name_key, w1, w2): pairs of a name's own words, the rarer one first."""
    once = names.select("name_key", F.explode(F.array_distinct("own")).alias("word"))
    rarity = once.groupBy("word").agg(F.count("*").alias("in_names"))
    ordered = once.join(rarity, "word").groupBy("name_key").agg(
        F.array_sort(F.collect_list(F.struct("in_names", "word")))["word"].alias("s")
    )
    pairs = F.flatten(
        F.transform(
            "s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("w1"), y.alias("w2")))
        )
    )
    return ordered.select("name_key", F.explode(pairs).alias("p")).select("name_key", "p.*")


def spoken_pairs(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n, w1, w2): the pairs that a question has both words of. ``asked`` (n, word), stored; ``pairs`` (w1, w2), cut.

    A question's word leads to the pairs it is the rarer word of, and these ask for the other one: as many rows as
    the question has words and these have partners, not a row for each two words of the question.
    """
    led = lookup_join(asked.withColumnRenamed("word", "w1"), pairs, ["w1"], ["n"])
    other = F.col("n_") == F.col("n")
    said = asked.select(F.col("n").alias("n_"), F.col("word").alias("w2_"))
    return led.join(said, other & (F.col("w2_") == F.col("w2")), "left_semi")


def _two_words(unique: DataFrame, names: DataFrame) -> DataFrame:
    """(n, name_key) where two of the name's own words occur in the question as words. A word the name repeats
    counts twice and matches alone."""
    name_pairs = cut(name_word_pairs(names))
    said = unique.select("n", F.explode(F.array_distinct(split_words(only_words(F.col("uq"))))).alias("word"))
    asked = store(said, "asked")
    once = names.select("name_key", "own", F.explode(F.array_distinct("own")).alias("word"))
    repeats = once.where(F.size(F.filter("own", lambda o: o == F.col("word"))) > 1).select("name_key", "word")
    spoken = spoken_pairs(asked, part_of(name_pairs.select("w1", "w2").distinct(), name_pairs))
    by_pair = lookup_join(spoken, name_pairs, ["w1", "w2"], ["n"]).select("n", "name_key")
    by_repeat = lookup_join(asked, part_of(repeats, names), ["word"], ["n"]).select("n", "name_key")
    return by_pair.unionByName(by_repeat)


def match_two_words(unique: DataFrame, names: DataFrame) -> DataFrame:
    """(uq, name_key) where two of the name's own words occur in the question as words."""
    unique = numbered(unique)
    return _named(_two_words(unique, names).distinct(), unique)


def match_full(unique: DataFrame, names: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """(uq, name_key) where the whole cleaned name occurs in the cleaned question."""
    unique, patterns = numbered(unique), _patterns(names, stops)
    near = _contained(unique, patterns, [PAIR, ODD]).select("n", "name_key").distinct()
    return _named(_odd_full(near, unique, patterns).distinct(), unique)


def match_names(unique: DataFrame, records: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """(uq, name_key) for every name a question names by any rule."""
    names, unique = distinct_names(records, stops), numbered(unique)
    patterns = _patterns(names, stops)
    met = store(_contained(unique, patterns, [PAIR, ODD]), "met")
    full = _odd_full(met.where(F.col("kind") == ODD), unique, patterns)
    found = met.where(F.col("kind") == PAIR).select("n", "name_key").unionByName(full).unionByName(_two_words(unique, names))
    return _named(found.distinct(), unique)
