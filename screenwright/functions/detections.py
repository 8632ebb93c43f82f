"""Builders for arrays of detections.

A detection is ``struct<detector, risk_type, score, description, matched_value>``. A detector yields an array of
them; the order inside the array is part of the result because ties and redaction depend on it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.catalogue import FINDINGS
from screenwright.functions.text import Words, contains_any, let, listed_part, literals, occurs_among, parsed, part_of

DETECTION_TYPE = "struct<detector:string,risk_type:string,score:int,description:string,matched_value:string>"
DETECTIONS_TYPE = f"array<{DETECTION_TYPE}>"


@dataclass(frozen=True)
class Tier:
    """Keywords that lead to the same finding; ``strip`` is removed from a keyword before it is looked for."""

    finding: str
    words: tuple[str, ...]
    strip: str = " "


def finding(detector: str, key: str, matched: Column | None = None, detail: Column | None = None) -> Column:
    """A detection from the catalogue; ``detail`` is appended to its description."""
    risk_type, score, description, message = FINDINGS[detector, key]
    values = (f"'detector', {text_literal(detector)}, 'risk_type', {text_literal(risk_type)}, 'score', {score}, "
              f"'description', {text_literal(description)}, 'matched_value', {text_literal(message or '')}")
    fixed = F.expr(f"named_struct({values})")
    if detail is not None:
        fixed = fixed.withField("description", F.concat(F.lit(description), detail))
    return fixed if message is not None else fixed.withField("matched_value", matched)


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def no_detections() -> Column:
    return F.array().cast(DETECTIONS_TYPE)


def first_of(*cases: tuple[Column, Column]) -> Column:
    """The detection of the first true condition, as an array of at most one."""
    condition, found = cases[0]
    chain = F.when(condition, F.array(found))
    for condition, found in cases[1:]:
        chain = chain.when(condition, F.array(found))
    return chain.otherwise(no_detections())


def with_values(candidates: Iterable[Column]) -> Column:
    """Keep the candidate detections whose matched value is not empty."""
    return F.filter(F.array(*candidates), lambda d: d["matched_value"] != "")


def needle(word: str, strip: str, mode: str) -> str:
    """What is looked for in normalised text for a listed keyword.

    ``compact`` deletes the characters in ``strip`` from the keyword although normalised text keeps single spaces, so
    a keyword of several words is found only where they are written together. ``spaced`` normalises the keyword the
    same way as the text.
    """
    if mode == "spaced":
        return " ".join("".join(c for c in word.lower() if c not in ".-_*/|\\+=[]{}()").split())
    if mode != "compact":
        raise ValueError(f"unknown match mode {mode!r}")
    return "".join(c for c in word if c not in strip).lower()


def any_needle(text: Column, words: Iterable[str], strip: str, mode: str, among: Column | Words | None = None) -> Column:
    return contains_any(text, [needle(w, strip, mode) for w in words], among)


def first_keyword(text: Column, words: Iterable[str], among: Column | Words | None = None) -> Column:
    """The first word of the list, in list order, that occurs in the text; null if none does."""
    if among is not None:
        listed = parsed([{"word": w} | listed_part(part_of(w), among) for w in words], "word:string,part:string,tier:int")
        return F.get(F.filter(listed, lambda e: occurs_among(among, e) & F.contains(text, e["word"])), F.lit(0))["word"]
    return let(text, lambda t: F.get(F.filter(literals(words), lambda w: F.contains(t, w)), F.lit(0)))


def tiered_keywords(
    detector: str, tiers: Iterable[Tier], text: Column, mode: str, as_written: Column | None = None,
    among: Column | Words | None = None,
) -> Column:
    """First keyword in list order, tiers in order, as an array of at most one detection.

    ``as_written`` is a second text in which the keyword is looked for unchanged; ``among`` are the ``long_words`` of ``text``.
    """
    def part(word: str, strip: str) -> str:
        # Written either way, this part of the keyword is in the normalised text; mostly that settles it.
        return part_of(needle(word, strip, mode) if as_written is None else word)

    entries = [
        {
            "needle": needle(word, tier.strip, mode),
            **listed_part(part(word, tier.strip), among),
            "word": word,
            "found": {
                "detector": detector, "risk_type": risk_type, "score": score, "description": description + word,
                "matched_value": word,
            },
        }
        for tier in tiers
        for risk_type, score, description, _ in [FINDINGS[detector, tier.finding]]
        for word in tier.words
    ]
    listed = parsed(entries, f"needle:string,part:string,tier:int,word:string,found:{DETECTION_TYPE}")

    def occurs(entry: Column) -> Column:
        hit = F.contains(text, entry["needle"])
        if as_written is not None:
            hit = hit | F.contains(as_written, entry["word"])
        return (F.contains(text, entry["part"]) if among is None else occurs_among(among, entry)) & hit

    return F.transform(F.slice(F.filter(listed, occurs), 1, 1), lambda e: e["found"])
