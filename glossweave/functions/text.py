"""Scalar, string and array functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_MARKS = r"[.,]"
SPACES = r"(?U)\s+"


def words(text: Column) -> Column:
    """Tokens between runs of Unicode white space; none of a blank text."""
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def normalize_lemma(raw: Column) -> Column:
    """URL-decoded, underscores as spaces, lower case, trimmed. A plus sign stays; a malformed escape leaves the text as it is."""
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.trim(F.lower(F.translate(decoded, "_", " ")))


def clean_lemma(raw: Column, most: int = 3) -> Column:
    """The lemma if it has one to three lower-case alphabetic words, else null."""
    parts = words(normalize_lemma(raw))
    good = (F.size(parts) > 0) & (F.size(parts) <= most) & F.forall(parts, lambda t: t.rlike(r"^\p{L}+$"))
    return F.when(good, F.array_join(parts, " "))


def acceptable_lemmas(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(raw, lambda r: clean_lemma(r)), lambda t: t.isNotNull()))


def node_lemma(uri: Column) -> Column:
    """The lemma of an English node `/c/en/lemma/...`, else null."""
    parts = F.split(uri, "/")
    return F.when((F.get(parts, F.lit(1)) == "c") & (F.get(parts, F.lit(2)) == "en"), normalize_lemma(F.get(parts, F.lit(3))))


def weight_of(metadata: Column) -> Column:
    """The weight of a JSON object; 1.0 where it is absent, malformed or no number."""
    return F.coalesce(F.get_json_object(metadata, "$.weight").try_cast("double"), F.lit(1.0))


def mentions(metadata: Column, what: str) -> Column:
    return F.coalesce(F.lower(metadata).contains(what), F.lit(False))


def node_id(prefix: str, slug: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), F.replace(slug, F.lit(" "), F.lit("_")), index.cast("string"))


def split_edges(token: Column) -> Column:
    """A token's leading marks one by one, its core, and its trailing marks in their order."""
    lead = F.regexp_extract(token, rf"^({EDGE_MARKS}*)", 1)
    rest = F.substr(token, F.length(lead) + 1)
    core = F.regexp_replace(rest, rf"{EDGE_MARKS}+$", "")
    tail = F.substr(rest, F.length(core) + 1)
    ones = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return F.concat(ones(lead), F.when(core != "", F.array(core)).otherwise(F.array().cast("array<string>")), ones(tail))


def tokens_with_marks(text: Column) -> Column:
    """split_edges of every word: a mark stands alone but between other characters of a word, whose core ends at its last other character."""
    marks = EDGE_MARKS[1:-1]
    return F.regexp_extract_all(text, F.lit(rf"(?U){EDGE_MARKS}|[^\s{marks}](?:\S*[^\s{marks}])?"), F.lit(0))


def core_of(token: Column, marks: str = ",.;:!?") -> Column:
    """The token without marks at its ends."""
    own = "".join("\\" + m for m in marks)
    return F.regexp_replace(token, f"^[{own}]+|[{own}]+$", "")


def strip_symbols(text: Column, marks: str = ".,;!?") -> Column:
    return F.array_join(F.filter(F.transform(words(text), lambda t: core_of(t, marks)), lambda t: t != ""), " ")


def mask_first(tokens: Column, target: Column, mask: str = "[MASK]") -> Column:
    """The tokens as a text with the first target masked; null where the target is absent."""
    at = F.array_position(tokens, target)
    return F.when(at > 0, F.array_join(F.transform(tokens, lambda t, k: F.when(k == at - 1, F.lit(mask)).otherwise(t)), " "))


def masked_sentences(sentences: Column, target: Column, mask: str = "[MASK]") -> Column:
    return F.array_distinct(F.filter(F.transform(sentences, lambda s: mask_first(words(s), target, mask)), lambda s: s.isNotNull()))


def word_order(s1: Column, s2: Column) -> Column:
    """Its name by the two switches: subject last, object before verb."""
    return F.when(s1 == 0, F.when(s2 == 0, "SVO").otherwise("SOV")).otherwise(F.when(s2 == 0, "VOS").otherwise("OVS"))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), " ,", ",")


def arrange(s1: Column, s2: Column, subject: Column, kind: Column, verb: Column, aux: Column, adjective: Column, place: Column, target: Column) -> Column:
    """A sentence in the word order of the switches. kind: TRANS (verb), COP (aux, place) or COP_ADJ (aux, adjective, place)."""
    head = F.when(kind == "TRANS", F.array(verb)).when(kind == "COP", F.array(aux, place)).otherwise(F.array(aux, adjective, place))
    phrase = F.when((kind == "TRANS") & (s2 == 1), F.concat(F.array(target), head)).otherwise(F.concat(head, F.array(target)))
    whole = F.when(s1 == 0, F.concat(F.array(subject), phrase)).otherwise(F.concat(phrase, F.array(subject)))
    return collapse(F.array_join(F.filter(whole, lambda t: t.isNotNull()), " "))


def with_adjective(noun: Column, adjective: Column, s3: Column) -> Column:
    return F.when(adjective.isNull(), noun).when(s3 == 0, F.concat_ws(" ", adjective, noun)).otherwise(F.concat_ws(" ", noun, adjective))


def base_pos(symbol: Column) -> Column:
    out = symbol
    for p in ("V", "PP", "CONJ", "AUX", "ADJP"):  # the last is asked first
        out = F.when(symbol.startswith(p), F.lit(p)).otherwise(out)
    return out


def alphabet(ranges: list[tuple[int, int]]) -> list[str]:
    """The characters of code point ranges, ends included."""
    return [chr(c) for a, b in ranges for c in range(a, b + 1)]


def comma_list(values: Column) -> Column:
    """Items of repeatable options with commas: split, trimmed, blanks dropped."""
    return F.filter(F.transform(F.flatten(F.transform(values, lambda v: F.split(v, ","))), lambda v: F.trim(v)), lambda v: v != "")


def overlap_percent(condition: Column) -> Column:
    return F.regexp_extract(condition, r"(\d+)$", 1).try_cast("int")


def density_percent(condition: Column) -> Column:
    return F.when(condition.startswith("low_40"), 40).when(condition.startswith("mid_60"), 60).when(condition.startswith("high_80"), 80).otherwise(100)


def strategy(condition: Column) -> Column:
    return F.when(condition.endswith("_relation"), "relation-first").when(condition.endswith("_coverage"), "coverage-first").otherwise("full")


def mean_pm_sd(mean: Column, sd: Column, digits: int = 4) -> Column:
    number = lambda c: F.when(c.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", c))
    return F.when(mean.isNull(), "N/A").otherwise(F.concat(number(mean), F.lit(" +/- "), number(sd)))


def half_even(value: Column) -> Column:
    return F.bround(value).cast("long")


def percent(value: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * value, total), F.lit(0.0))


def steps_per_epoch(rows: Column, batch: Column) -> Column:
    return F.ceil(rows / batch).cast("long")


def truncate(tokens: Column, most: int = 64, specials: int = 2) -> Column:
    """The tokens that fit beside the special ones."""
    return F.slice(tokens, 1, most - specials)


def related_quota(target_edges: Column, ratio: Column, most: Column) -> Column:
    return F.least(most, (target_edges * ratio).cast("int"))


def draw(*parts: Column | str | int) -> Column:
    """A hash that stands for a random number: hex text, ordered as the number is."""
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 52 bits of the draw."""
    return F.conv(F.substring(draw(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)
