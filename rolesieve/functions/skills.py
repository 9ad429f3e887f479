"""Whole-word skill mentions, all skills of a list in one pass over the text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column, functions as F

from .text import regex_literal


def _literal_strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def _edge(char: str, ahead: bool) -> str:
    r"""What \b means next to ``char``, spelled out: faster than the Unicode form of \b."""
    sign = "!" if _is_word(char) else "="
    return rf"(?{'' if ahead else '<'}{sign}[\p{{L}}\p{{N}}_])"


@dataclass(frozen=True)
class SkillFinder:
    """Finds which of ``skills`` a text mentions as whole words, ignoring case.

    One regex scan collects every mention: it looks ahead at each word boundary without consuming,
    so overlapping mentions are all seen, and takes the longest skill there.  A shorter skill that
    always comes with a longer one ("spark" with "spark sql") is added from a table made here.
    """

    skills: tuple[str, ...]

    @property
    def lowered(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(s.lower() for s in self.skills))

    @property
    def pattern(self) -> str:
        # Longest first within one first letter; the letter is matched once for all of them.
        ordered = sorted(self.lowered, key=lambda s: (s[0], -len(s), s))
        branches = []
        for first, group in groupby(ordered, key=lambda s: s[0]):
            rest = "|".join(f"{regex_literal(s[1:])}{_edge(s[-1], ahead=True)}" for s in group)
            branches.append(f"{_edge(first, ahead=False)}{regex_literal(first)}(?:{rest})")
        if all(_is_word(s[0]) for s in ordered):
            branches = [b.removeprefix(_edge("a", ahead=False)) for b in branches]
            return rf"{_edge('a', ahead=False)}(?=({'|'.join(branches)}))"
        return rf"(?=({'|'.join(branches)}))"

    @property
    def contained(self) -> dict[str, list[str]]:
        """Longer skill -> the shorter ones it starts with, up to a word boundary."""
        out = {}
        for long in self.lowered:
            inner = [s for s in self.lowered if s != long and re.match(rf"{re.escape(s)}\b", long)]
            if inner:
                out[long] = inner
        return out

    def found(self, text: Column) -> Column:
        """array<string>: the distinct skills mentioned, lower case, in no particular order."""
        if not self.skills:
            return F.array().cast("array<string>")
        # Two letters fold to ASCII ones when case is ignored but not when lowered.
        low = F.lower(text)
        low = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, "ſı", "si"))
        hits = F.array_distinct(F.regexp_extract_all(low, F.lit(self.pattern), F.lit(1)))
        return self._with_contained(hits)

    def _with_contained(self, hits: Column) -> Column:
        extra = [
            F.when(F.array_contains(hits, long), _literal_strings(inner)).otherwise(F.array().cast("array<string>"))
            for long, inner in self.contained.items()
        ]
        return F.array_distinct(F.concat(hits, *extra)) if extra else hits

    def found_across(self, left: Column, right: Column) -> Column:
        """Skills that begin in ``left`` and end in ``right`` when the two are joined by one blank."""
        hits = []
        for skill in (s for s in self.lowered if " " in s):
            joints = [
                # The plain comparison spares most texts the search.
                F.lower(left).endswith(skill[:i]) & F.lower(left).rlike(rf"(?U)\b{regex_literal(skill[:i])}\z")
                & F.lower(F.left(right, F.lit(len(skill) + 1))).rlike(rf"(?U)\A{regex_literal(skill[i + 1:])}\b")
                for i, char in enumerate(skill)
                if char == " "
            ]
            hits.append(F.when(reduce(or_, joints), F.lit(skill)))
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def in_list_order(found: Column, skills: tuple[str, ...]) -> Column:
    """The listed skills among those found, in list order and spelling."""
    lowered = [s.lower() for s in skills]
    hits = F.array_intersect(_literal_strings(lowered), found)
    changed = [s for s in skills if s != s.lower()]
    if not changed:
        return hits
    spelling = F.create_map(*[F.lit(x) for s in skills for x in (s.lower(), s)])
    return F.transform(hits, lambda h: F.element_at(spelling, h))


def mentions(text: Column, skill: str) -> Column:
    """True where the text mentions one skill as a whole word."""
    return F.coalesce(text.rlike(rf"(?iU)\b{regex_literal(skill)}\b"), F.lit(False))


def matched_skills(text: Column, skills: tuple[str, ...]) -> Column:
    return in_list_order(SkillFinder(tuple(skills)).found(text), tuple(skills))
