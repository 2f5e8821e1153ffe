"""Lexicons: artificial tokens for concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.text import alphabet, base_pos, draw, uniform

from .numbering import numbered

#: Code point ranges of the writing systems for artificial tokens.
PRESETS = {"cjk": [(0x4E00, 0x9FFF)], "hiragana": [(0x3041, 0x3096)], "yi": [(0xA000, 0xA48C)], "cyrillic": [(0x0430, 0x044F)]}


def entries(nodes: DataFrame) -> DataFrame:
    """(key, pos, source, id, synset_id, primary_lemma, lemmas): key is the synset's id, or the node's where it has none."""
    key = F.coalesce(F.when(F.col("synset_id") != "", F.col("synset_id")), F.col("id"))
    return nodes.select(key.alias("key"), F.array(F.coalesce("pos", F.lit("N"))).alias("pos"), F.lit("synsets").alias("source"), "id", "synset_id", "primary_lemma", "lemmas")


def grammar_entries(terminals: DataFrame) -> DataFrame:
    """(key, pos, source) of grammar terminals (symbol, terminal): the set of base parts of speech of each."""
    return terminals.groupBy(F.col("terminal").alias("key")).agg(F.array_sort(F.collect_set(base_pos(F.col("symbol")))).alias("pos")).withColumn("source", F.lit("grammar"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both inventories, sorted by key; a key in both is an error."""
    clash = a.select("key").intersect(b.select("key")).limit(1).collect()
    if clash:
        raise ValueError(f"key in both inventories: {clash[0].key}")
    return a.unionByName(b, allowMissingColumns=True).orderBy("key")


def merged_by_lemma(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, pos): keys of either, with the union of their parts of speech."""
    return a.select("key", "pos").unionByName(b.select("key", "pos")).select("key", F.explode("pos").alias("p")).groupBy("key").agg(F.array_sort(F.collect_set("p")).alias("pos"))


def length(seed: Column | str | int, key: Column, mean: float, sd: float, least: int, most: int) -> Column:
    """A rounded normal length by Box and Muller, held between the bounds."""
    if sd <= 0 or least < 1 or most < least:
        raise ValueError("sd above 0, least at 1 or above and most at least as large are needed")
    u, v = uniform(seed, "u", key), uniform(seed, "v", key)
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.lit(mean) + F.lit(sd) * z).cast("int")))


def artificial_tokens(keys: DataFrame, preset: str, seed: int, mean: float = 3.0, sd: float = 1.0, least: int = 2, most: int = 6) -> DataFrame:
    """keys (key) with `artificial`: a text of drawn characters, unlike that of any other key.

    The first characters are drawn; of keys with the same draw all but the first get the place of their key in that group as further
    characters, between which and the drawn ones no other length can stand.
    """
    chars = alphabet(PRESETS[preset])
    n = len(chars)
    at = F.split(F.lit("".join(chars)), "")
    letter = lambda k: F.element_at(at, (F.floor(F.conv(F.substring(draw(seed, k.cast("string"), F.col("key")), 1, 8), 16, 10).cast("long") % n) + 1).cast("int"))
    own = keys.withColumn("size", length(seed, F.col("key"), mean, sd, least, most))
    own = own.withColumn("drawn", F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), letter), ""))
    place = F.row_number().over(Window.partitionBy("drawn").orderBy(draw(seed, "tie", F.col("key")), "key")) - 1
    own = own.withColumn("place", place)
    # numbered ones are longer than any drawn one: the drawn part is padded to `most` first
    pad = F.repeat(F.lit(chars[0]), F.lit(most) - F.length("drawn"))
    number = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.element_at(at, (F.floor(F.col("place") / F.pow(F.lit(float(n)), k)) % n + 1).cast("int")))
    # the drawn length is told by one character, so padding cannot make two drawn parts equal
    told = F.element_at(at, F.length("drawn"))
    return own.withColumn("artificial", F.when(F.col("place") == 0, F.col("drawn")).otherwise(F.concat("drawn", pad, told, F.array_join(number, "")))).drop("size", "drawn", "place")


def augmented(lexicon: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, pos, source): the lexicon and the nodes it lacks; adjectives begin with a_."""
    lacking = nodes.select(F.col("node").alias("key")).join(lexicon.select("key"), "key", "left_anti").distinct()
    new = lacking.select("key", F.array(F.when(F.col("key").startswith("a_"), "ADJ").otherwise("N")).alias("pos"), F.lit("edge_endpoint_augmented").alias("source"))
    return lexicon.select("key", "pos", "source").unionByName(new)


def inverse(lexicon: DataFrame) -> DataFrame:
    """(artificial, key) of entries that come from synsets."""
    return lexicon.where("source = 'synsets'").select("artificial", "key")


def union_tokens(a: DataFrame, b: DataFrame) -> DataFrame:
    """(token, place): the tokens of a, then those only in b, by ordinal (token, ordinal)."""
    both = a.select("token", F.lit(0).alias("side"), "ordinal").unionByName(b.select("token", F.lit(1).alias("side"), "ordinal"))
    first = both.groupBy("token").agg(F.min(F.struct("side", "ordinal")).alias("at"))
    return numbered(first, "at", "token").select("token", (F.col("place") + 1).cast("int").alias("place"))


def nouns(nodes: DataFrame) -> DataFrame:
    """The nodes (pos) that are nouns."""
    return nodes.where(F.lower("pos") == "n")
