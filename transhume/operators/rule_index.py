"""Scans by thousands of rules: an index of rule literals by q-gram, regexes only for the rules left.

One test a rule is a pass over the text for each rule.  Here every literal of a rule (its hints, of which one
occurs in each match) is filed under one of its q-grams, the one that fewest literals share.  A text is read
once, in chunks of bounded size: its q-grams are cut to those of the index, which give the numbers of the rules
that may match, and only these are tested, literal first.  All of it stays inside the row, in native
expressions; nothing is exploded or shuffled.  Rules without literals, or with one shorter than a q-gram, are
tested on every text.

Rules for one whole word (``\\bword\\b``) need no test of their own: one regex, a trie of all these words, finds
those of a text in a single pass.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Container, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume import values
from transhume.functions.text import java_regex
from transhume.values import Rule

Q = 4  # characters of a q-gram
CHUNK = 1 << 16  # characters whose q-grams are held at once
SLOTS = 1 << 10  # of the index; a slot holds the q-grams of one remainder of their checksum
ENTRY = "gram: string, rules: array<int>"
WHOLE_WORD = re.compile(r"\\b([A-Za-z0-9_]{1,64})\\b")


def grams(text: str) -> list[str]:
    return [text[i : i + Q] for i in range(len(text) - Q + 1)]


class RuleIndex:
    """Literals of rules by q-gram; as many entries as there are literals, kept in the plan."""

    def __init__(self, literals: Sequence[Sequence[str]], without: Container[int] = ()):
        """``literals`` holds, for each rule, texts of which at least one occurs in every match; the rules
        numbered in ``without`` are left out."""
        filed = {i: texts for i, texts in enumerate(literals) if i not in without}
        usable = {i: texts for i, texts in filed.items() if texts and min(map(len, texts)) >= Q}
        self.always = [i for i in filed if i not in usable]
        shared = Counter(g for text in {t for ts in usable.values() for t in ts} for g in set(grams(text)))
        self.filed: dict[str, set[int]] = {}
        for i, texts in usable.items():
            for text in texts:
                key = min(grams(text), key=lambda g: (shared[g], g))
                self.filed.setdefault(key, set()).add(i)

    def candidates(self, text: Column) -> Column:
        """Numbers of the rules that may match, in order; only those tested always for null."""
        if not self.filed:
            return _constant(self.always, "array<int>")
        keys = _constant(sorted(self.filed), "array<string>")
        def known(at: Column) -> Column:
            part = F.substring(text, at, F.lit(CHUNK + Q - 1))
            return F.array_intersect(F.regexp_extract_all(part, F.lit(f"(?s)(?=(.{{{Q}}}))"), F.lit(1)), keys)

        starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(CHUNK))
        found = F.array_distinct(F.flatten(F.transform(starts, known)))
        some = rules_of(found, self.filed)
        return F.array_sort(F.array_distinct(F.concat(some, _constant(self.always, "array<int>"))))


def slots(filed: Mapping[str, Iterable[int]]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(SLOTS)]
    for gram, rules in sorted(filed.items()):
        place = zlib.crc32(gram.encode("utf-8")) % SLOTS
        out[place].append({"gram": gram, "rules": sorted(rules)})
    return out


def rules_of(found: Column, filed: Mapping[str, Iterable[int]]) -> Column:
    """Numbers of the rules filed under the texts found; none for null."""
    table = _constant(slots(filed), f"array<array<struct<{ENTRY}>>>")

    def of_one(gram: Column) -> Column:
        slot = F.get(table, (F.crc32(F.encode(gram, "utf-8")) % SLOTS).cast("int"))
        return F.flatten(F.transform(F.filter(slot, lambda e: e["gram"] == gram), lambda e: e["rules"]))

    return F.coalesce(F.flatten(F.transform(found, of_one)), F.array().cast("array<int>"))


def whole_words(literals: Sequence[Sequence[str]], patterns: Sequence[str]) -> dict[str, set[int]]:
    """Rules that match one whole word and no more, by this word."""
    out: dict[str, set[int]] = {}
    for i, (texts, pattern) in enumerate(zip(literals, patterns)):
        word = WHOLE_WORD.fullmatch(pattern)
        # a rule whose literals are no part of its word would need both
        if word and (not texts or any(text in word[1] for text in texts)):
            out.setdefault(word[1], set()).add(i)
    return out


def trie_regex(words: Iterable[str]) -> str:
    """A regex for any of the words, each letter tried once however many words share it."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def regex(node: dict) -> str:
        letters: dict[str, str] = {}
        for letter in sorted(node):
            if letter:
                rest = regex(node[letter])
                letters[rest] = letters.get(rest, "") + letter
        parts = [(f"[{own}]" if len(own) > 1 else own) + rest for rest, own in letters.items()]
        if "" in node:
            return f"(?:{'|'.join(parts)})?" if parts else ""
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    firsts = "".join(sorted(root))
    return rf"(?=[{firsts}])\b({regex(root)})\b"


def word_rules(text: Column, filed: Mapping[str, Iterable[int]]) -> Column:
    """Numbers of the rules whose word occurs as a whole one."""
    found = F.regexp_extract_all(text, F.lit(java_regex(trie_regex(filed))), F.lit(1))
    return rules_of(F.array_distinct(found), filed)


def _constant(items: Sequence, kind: str) -> Column:
    """A list as one literal, which Spark folds; an expression for each item would take long to plan."""
    return F.from_json(F.lit(json.dumps(items)), kind)


def _texts(texts: Sequence[str | None]) -> Column:
    return _constant(list(texts), "array<string>")


def hits(df: DataFrame, literals: Sequence[Sequence[str]], text_col: str, out: str, patterns: Sequence[str] = ()) -> DataFrame:
    """Numbers of the rules of which a literal occurs and, where given, the pattern."""
    text = F.col(f"`{text_col}`")
    every = _constant([list(texts) for texts in literals], "array<array<string>>")

    def real(number: Column) -> Column:
        own = F.get(every, number)
        test = (F.size(own) == 0) | F.exists(own, lambda literal: F.contains(text, literal))
        if patterns:
            test = test & F.rlike(text, F.get(_texts([java_regex(p) for p in patterns]), number))
        return F.coalesce(test, F.lit(False))

    words = whole_words(literals, patterns)
    apart = {i for rules in words.values() for i in rules}
    found = [word_rules(text, words)] if words else []
    if len(apart) < len(literals):
        found.append(F.filter(RuleIndex(literals, apart).candidates(text), real))
    return df.withColumn(out, F.array_sort(F.concat(*found)))


def scan_rules(
    df: DataFrame,
    rules: Sequence[Rule] = values.RULES,
    text_col: str = "content",
    detected: str = "detected_patterns",
    issues: str | None = None,
    suggestions: str | None = None,
) -> DataFrame:
    """What ``scan.pattern_scan`` and ``scan.rule_messages`` give, for any number of rules.

    A null text has no patterns, and without rules there are none.
    """
    if not rules:
        rows = df.withColumn(detected, F.array().cast("array<string>"))
        number = F.array().cast("array<int>")
    else:
        rows = hits(df, [r.hints for r in rules], text_col, detected, [r.pattern for r in rules])
        number = F.col(detected)

    def named(texts: Sequence[str | None]) -> Column:
        if not rules:
            return F.array().cast("array<string>")
        return F.filter(F.transform(number, lambda i: F.get(_texts(texts), i)), lambda x: x.isNotNull())

    out = {}
    if issues:
        out[issues] = named([r.issue or None for r in rules])
    if suggestions:
        out[suggestions] = named([r.suggestion or None for r in rules])
    return rows.withColumns({**out, detected: named([r.name for r in rules])})


def scan_literals(
    df: DataFrame,
    literals: Sequence[str] = values.LITERALS,
    text_col: str = "content",
    out: str = "literals",
) -> DataFrame:
    """What ``scan.literal_scan`` gives, for any number of literals."""
    if not literals:
        return df.withColumn(out, F.array().cast("array<string>"))
    rows = hits(df, [[text] for text in literals], text_col, out)
    return rows.withColumn(out, F.transform(out, lambda i: F.get(_texts(literals), i)))
