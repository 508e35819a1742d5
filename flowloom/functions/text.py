"""Text, entropy, key and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.net import bound


def array_entropy(values: Column) -> Column:
    """Shannon entropy (bits) of an array's elements; 0 for an empty or null array.

    In the sorted array the r-th copy of an element adds ``r·log2 r - (r-1)·log2(r-1)`` to
    ``Σ c·log2 c``; its rank r is its distance from the first copy. Entropy is
    ``log2 n - (Σ c·log2 c) / n``.
    """
    def weight(r: Column) -> Column:
        return F.when(r > 1, r * F.log2(r) - F.when(r > 2, (r - 1) * F.log2(r - 1)).otherwise(0.0)).otherwise(0.0)

    def entropy(ordered: Column) -> Column:
        ranks = F.transform(ordered, lambda v, i: (i + 2 - F.array_position(ordered, v)).cast("double"))
        total = F.aggregate(F.filter(ranks, lambda r: r > 1), F.lit(0.0), lambda acc, r: acc + weight(r))
        n = F.size(ordered).cast("double")
        return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - total / n)).otherwise(F.lit(0.0))

    # bound: an array named inside a lambda is built and sorted again for each of its elements
    return bound(F.sort_array(values), entropy)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def shannon_entropy(text: Column) -> Column:
    return array_entropy(characters(F.coalesce(text, F.lit(""))))


def bigrams(text: Column) -> Column:
    def cut(value: Column) -> Column:
        size = F.length(value)
        return F.when(
            size >= 2, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr(value, i, F.lit(2)))
        ).otherwise(F.array().cast("array<string>"))

    return bound(text, cut)


def bigram_entropy(text: Column) -> Column:
    return array_entropy(bigrams(F.coalesce(text, F.lit(""))))


def consonant_vowel_ratio(text: Column) -> Column:
    """Letters that are not vowels over vowels, denominator at least 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    vowels = F.length(F.regexp_replace(low, "[^aeiou]", ""))
    consonants = F.length(F.regexp_replace(low, r"[^\p{L}]|[aeiou]", ""))
    return consonants / F.greatest(vowels, F.lit(1))


def apex_domain(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def first_label(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def label_count(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def strip_port(host: Column) -> Column:
    return F.substring_index(host, ":", 1)


def looks_like_domain(value: Column) -> Column:
    from flowloom.functions.net import is_ip

    def named(v: Column) -> Column:
        # an address holds a colon or ends in a digit; only such text is parsed
        address = (v.contains(":") | F.right(v, F.lit(1)).between("0", "9")) & is_ip(v)
        return (v != "") & v.contains(".") & ~v.contains(" ") & (F.length(v) <= 253) & ~address

    return F.coalesce(bound(F.lower(F.trim(value)), named), F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return hit


def matches_domain(host: Column, pattern: Column | str) -> Column:
    """Exact name, or ``*.suffix`` which also covers the bare suffix."""
    if isinstance(pattern, str):
        if pattern.startswith("*."):
            return host.endswith(pattern[1:]) | (host == pattern[2:])
        return host == pattern
    return F.when(
        pattern.startswith("*."),
        F.endswith(host, F.substr(pattern, F.lit(2))) | (host == F.substr(pattern, F.lit(3))),
    ).otherwise(host == pattern)


def value_key(value: Column) -> Column:
    """Short stable key of a value: the first 16 hex digits of its SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    """The same text for (a, b) and (b, a)."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.concat_ws("|", F.least(x, y), F.greatest(x, y))


def connection_key(src: Column, dst: Column, sport: Column, dport: Column, proto: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (src, dst, sport, dport, proto)]
    ports = [F.when(p == "0", "").otherwise(p) for p in parts[2:4]]
    return F.concat_ws("|", parts[0], parts[1], *ports, parts[4])


def truncated_json(value: Column, budget: int) -> Column:
    return F.substring(F.to_json(value), 1, budget)


def first_json_object(text: Column) -> Column:
    """The outermost ``{…}`` block in free text, null when it does not parse."""
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(block, "$").isNotNull(), block)
