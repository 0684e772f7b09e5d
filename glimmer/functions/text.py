"""Column functions on text: normal forms, keys and token sets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
# Words without weight in names, and what describes an organisation rather than names it.
STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "are", "was", "into", "its"]
LEGAL_WORDS = ["inc", "ltd", "llc", "corp", "corporation", "gmbh", "co", "company", "labs", "lab", "ai", "group", "technologies", "technology", "holding", "plc"]
RULE_SETTERS = ["iso", "iec", "ieee", "ietf", "nist", "etsi", "itu", "w3c", "owasp", "enisa", "fda", "esma"]
TASK_WORDS = ["find", "show", "search", "list", "early", "weak", "signals", "signal", "trends", "trend", "technologies", "technology", "news"]

# Marks that tell families of technologies apart, by pattern of the lower-case text.
TECH_FAMILIES = {
    "фотон": r"фотон|photonic|оптическ|optical",
    "аналог": r"аналогов|analog|смешанно-сигнальн|mixed-signal",
    "цифров": r"цифров|digital",
    "нейроморф": r"нейроморф|neuromorphic|спайков|spiking",
    "в_памяти": r"в памяти|in-?memory|compute-in-memory|кросс-барн|crossbar",
    "в_пикселе": r"в пиксел|in-?pixel|processing-in-pixel|внутри сенсора|in-?sensor",
    "квант": r"квантов|quantum",
    "npu": r"\bnpu\b|нейропроцессор|ускорител[ья] нейронн",
    "доверенная_среда": r"\btee\b|доверенн[ойая] сред|корн[ейи] доверия|root of trust|\bsgx\b|\bpuf\b",
    "федеративное": r"федеративн|federated",
    "lora_адаптеры": r"\blora\b|адаптер",
    "lorawan": r"lorawan|\blpwan\b",
    "слм": r"\bslm\b|мал[ыхые] языков|small language",
    "спекулятивный": r"спекулятивн|speculative",
    "событийный": r"событийн|event-based|event-driven|dvs\b",
}
# Two texts of which one has the first mark and the other the second are never one thing.
TECH_FORBIDDEN = [
    (r"\banalog\b|аналогов", r"\bdigital\b|цифров"),
    (r"in-?pixel|внутри пиксел|processing-in-pixel", r"\bnpu\b|ускорител|accelerator"),
    (r"cortex-?m|микроконтроллер", r"\bsgx\b|intel|серверн"),
    (r"speculative decod|спекулятивн", r"flashattention|attention"),
    (r"\blora\b|мульти-?lora", r"lorawan|\blpwan\b"),
    (r"обучен|дообучен|fine-?tun|training", r"инференс|inference|вывод"),
]


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def normal_text(text: Column) -> Column:
    """NFC, one kind of line break, single blanks within lines, no runs of empty lines."""
    out = F.regexp_replace(_nfc(text), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def tokens(text: Column, longer_than: int = 2, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct words longer than so many characters, without stop words."""
    return F.array_except(F.filter(words(text), lambda w: F.length(w) > longer_than), F.array(*[F.lit(s) for s in stop]))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column, floor: int = 2) -> Column:
    """Overlap coefficient if so many tokens are shared, else Jaccard."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared >= floor, shared / F.least(F.size(a), F.size(b))).otherwise(jaccard(a, b))


def organisation_key(name: Column, drop: list[str] = LEGAL_WORDS) -> Column:
    return F.array_join(F.filter(words(name), lambda w: ~w.isin(drop)), " ")


def name_key(name: Column) -> Column:
    """Words in lower case, single blanks."""
    return F.array_join(words(name), " ")


def sorted_key(name: Column) -> Column:
    """As name_key with the words in order."""
    return F.array_join(F.array_sort(words(name)), " ")


def quote_key(quote: Column) -> Column:
    return F.trim(F.regexp_replace(quote, r"\s+", " "))


def is_acronym(term: Column) -> Column:
    capitals = F.length(F.regexp_replace(term, "[^A-Z]", ""))
    return F.length(term).between(2, 6) & (2 * capitals > F.length(term))


def sets_rules(name: Column, names: list[str] = RULE_SETTERS) -> Column:
    return F.arrays_overlap(words(name), F.array(*[F.lit(n) for n in names]))


def without_task_words(query: Column, drop: list[str] = TASK_WORDS) -> Column:
    """Task words and then a leading preposition go; a query with under 3 characters left stays as it is."""
    kept = F.array_join(F.filter(F.split(F.trim(query), r"\s+"), lambda w: ~F.lower(w).isin(drop)), " ")
    kept = F.regexp_replace(kept, r"^(?:in|on|for|of|about) ", "")
    return F.when(F.length(kept) < 3, query).otherwise(kept)


def fingerprint(*parts: Column) -> Column:
    """Digest of the parts in order; null and empty differ."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(F.concat(F.lit("s"), p.cast("string")), F.lit("n")), F.lit("|")) for p in parts]), 256)


def longest_latin(name: Column, most: int = 6) -> Column:
    """Longest run of up to so many Latin words, over 4 characters; the first of equals."""
    runs = F.filter(F.regexp_extract_all(name, F.lit(rf"[A-Za-z][A-Za-z0-9-]*(?: [A-Za-z][A-Za-z0-9-]*){{0,{most - 1}}}"), 0), lambda r: F.length(r) > 4)
    size = F.array_max(F.transform(runs, F.length))
    return F.get(F.filter(runs, lambda r: F.length(r) == size), F.lit(0))


def probe_term(term: Column, most: int = 6) -> Column:
    return F.array_join(F.slice(F.split(quote_key(term), " "), 1, most), " ")


def json_body(text: Column) -> Column:
    """The outermost braces of an answer, inside or outside a code fence."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def from_inverted(index: Column) -> Column:
    """Text from a map of word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def markers(text: Column, families: dict[str, str]) -> Column:
    """Names of the families whose pattern the text holds, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in sorted(families.items())]))


def stems(text: Column, length: int = 6) -> Column:
    return F.array_distinct(F.transform(words(text), lambda w: F.substring(w, 1, length)))


def forbidden(a: Column, b: Column, pairs: list[tuple[str, str]] = TECH_FORBIDDEN) -> Column:
    """Number of the first pair of marks that keeps the two texts apart, in either order; null if none does."""
    x, y = F.lower(a), F.lower(b)
    return F.coalesce(*[F.when((x.rlike(p) & y.rlike(q)) | (y.rlike(p) & x.rlike(q)), F.lit(i)) for i, (p, q) in enumerate(pairs)])
