"""Text preparation and matching as built-in column expressions.

Four choices here decide how fast a scan over long prompts is:

* A word list is tested with ``contains`` per word inside one higher-order function over a literal array. On 250 MB of
  prose that is about five times faster than one alternation regex, and the expression tree stays small.
* A keyword, or its longest part without a space, lies inside one word of the normalised text. A frame that holds the
  distinct words of some lengths (``long_words``) has keywords looked for among the words that are long enough for them,
  which are few; the text itself is scanned only where such a part occurs.
* Most of these parts have a rare letter with two more behind it. One pattern finds the ends of words that start with such
  a piece (``word_ends``), and keywords are then looked for among those ends, which are fewer still (``Words``).
* A pattern that cannot match without some literal text is evaluated only where that text occurs (``gate``).
* A value that is needed more than once is bound once with ``let`` instead of being repeated in every branch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank (Unicode white space without the no-break spaces) and the
# separators that normalising deletes.
BLANK_CLASS = r"[\t-\r\x{1c}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
SEPARATORS = r"[.\-_*/|\\+=\[\]{}()]+"
# Words of at least so many bytes are kept apart for keywords that long (see ``long_words``).
WORD_BYTES = (3, 5, 7, 9, 12)
# Letters that fewer words of European languages have than the commonest ones, the rarest first; see ``piece_of``.
RARE_LETTERS = "qxzjkvbywpgfmuchdls"
TRIMMED = "".join(chr(c) for c in range(0x21))


def regex(pattern: str) -> str:
    r"""Spell a catalogue pattern for Spark.

    ``\b`` is ASCII-only on newer Java versions and Unicode-aware on older ones; ``(?U:\b)`` is Unicode-aware on all.
    """
    return pattern.replace(r"\b", r"(?U:\b)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(column: Column) -> Column:
    """Mark an expensive column, so that a filter on it is not pushed below the projection that computes it.

    The optimiser pushes a filter through a projection by repeating the expression in the filter, which here would
    screen every prompt twice. It does not do so for expressions that depend on the partition; the condition is always
    true.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def java_trim(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends, not only spaces."""
    return F.btrim(text, F.lit(TRIMMED))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    other = BLANK_CLASS.replace("[", "[^", 1)
    # Mostly the start settles it, and a pattern decodes all it is given.
    return text.isNull() | (~F.substring(text, 1, 16).rlike(other) & ~text.rlike(other))


def normalise(text: Column) -> Column:
    """Lower-case, delete separators, collapse white space, trim. Null becomes the empty string."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, "")
    # Single spaces need no rewriting.
    collapsed = F.regexp_replace(spaced, "[\\t-\\r][\\t-\\r ]*| [\\t-\\r ]+", " ")
    return java_trim(collapsed)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which a character outside the basic plane counts as two."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)).cast("int")


def literals(values: Iterable[str]) -> Column:
    """Array of fixed strings. The optimiser folds it to one literal."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def long_words(norm: Column) -> Column:
    """Normalised text, and its distinct words of at least as many bytes as each of ``WORD_BYTES`` says."""
    def shown(words: Column) -> Column:
        return F.array_join(words, " ")

    def steps(words: Column, sizes: tuple[int, ...], *before: Column) -> Column:
        if not sizes:
            return F.array(norm, *before)
        kept = F.filter(words, lambda w: F.octet_length(w) >= sizes[0])
        return let(kept, lambda k: steps(k, sizes[1:], *before, shown(k)))

    return steps(F.array_distinct(F.split(norm, " ")), WORD_BYTES)


def part_of(word: str) -> str:
    """The longest part of a keyword that stays as it is when a text that holds the keyword is normalised."""
    return max(re.split(r"[\s.\-_*/|\\+=\[\]{}()]+", word.lower()), key=len)


def tier_of(part: str) -> int:
    """The position in ``long_words`` of the words long enough to hold ``part``."""
    return sum(len(part.encode()) >= size for size in WORD_BYTES)


@dataclass(frozen=True)
class Words:
    """``long_words`` with ``word_ends`` behind them, and the pieces that expressions count on there."""

    column: Column
    pieces: set[str] = field(default_factory=set)


def piece_of(part: str) -> str:
    """The end of a keyword's part from its rarest letter on; empty if it has no rare letter with enough behind it.

    Four letters are enough, or three where a part has no such end.
    """
    if len(part) < 3 or not part.isascii():
        return ""
    for least in (4, 3):
        starts = [i for i in range(max(len(part) - least, 0) + 1) if part[i] in RARE_LETTERS]
        if starts:
            return part[min(starts, key=lambda i: RARE_LETTERS.index(part[i])):]
    return ""


def listed_part(part: str, among: Column | Words | None) -> dict:
    """What is looked for in place of a keyword's part, and the position in ``among`` of the words to look in."""
    piece = piece_of(part) if isinstance(among, Words) else ""
    if not piece:
        return {"part": part, "tier": tier_of(part)}
    among.pieces.add(piece)
    return {"part": piece, "tier": len(WORD_BYTES) + 1}


def word_ends(words: Column, pieces: Iterable[str]) -> Column:
    """The distinct ends of words from the first piece on that occurs in a word; ``words`` are ``long_words``.

    A match is the leftmost one and takes the rest of its word, so whatever piece a word holds lies in its end.
    """
    tree: dict = {}
    for piece in pieces:
        node = tree
        for letter in piece:
            node = node.setdefault(letter, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        if "" in node:  # what is longer is found with it
            return ""
        branches = [re.escape(letter) + spelled(below) for letter, below in sorted(node.items())]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    if not tree:
        return F.lit("")
    # Alternatives are tried one by one, so they are dealt into groups that one look at the next letter rules out.
    firsts = sorted(tree)
    groups = [firsts[i:i + 4] for i in range(0, len(firsts), 4)]
    dealt = "|".join(f"(?=[{''.join(g)}]){spelled({letter: tree[letter] for letter in g})}" for g in groups)
    pattern = f"(?=[{''.join(firsts)}])(?:{dealt})[^ ]*"
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.get(words, F.lit(1)), F.lit(pattern), F.lit(0))), " ")


def occurs_among(among: Column | Words, entry: Column) -> Column:
    """Whether what is looked for of a listed keyword (``listed_part``) lies in the words it can lie in."""
    return F.contains(F.get(among.column if isinstance(among, Words) else among, entry["tier"]), entry["part"])


def contains_any(text: Column, words: Iterable[str], among: Column | Words | None = None) -> Column:
    """Plain substring test against a list; stops at the first word found.

    A word that contains another one of the list cannot change the answer and is not looked for. ``among`` are the
    ``long_words`` of the text that ``text`` is a form of (as written, lowered or normalised).
    """
    words = list(dict.fromkeys(words))
    needed = [w for w in words if not any(other != w and other in w for other in words)]
    if among is None:
        # Bound, as the optimiser would work out a text that is used once again for each word.
        return let(text, lambda t: F.exists(literals(needed), lambda w: F.contains(t, w)))
    listed = [{"word": w} | listed_part(part_of(w), among) for w in needed]
    return F.exists(parsed(listed, "word:string,part:string,tier:int"),
                    lambda e: occurs_among(among, e) & F.contains(text, e["word"]))


def parsed(rows: list[dict], fields: str) -> Column:
    """Fixed records as an array. The optimiser folds it to one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(regex(pattern))


def first_match(
    text: Column, pattern: str, gate: Iterable[str] = (), gate_text: Column | None = None, group: int = 0,
    among: Column | Words | None = None,
) -> Column:
    """First match of ``pattern``, or the empty string.

    ``gate`` lists literals of which at least one has to be in the text for the pattern to match at all; ``among`` as in
    ``contains_any``.
    """
    found = F.regexp_extract(text, regex(pattern), group)
    gates = list(gate)
    if not gates:
        return found
    source = text if gate_text is None else gate_text
    if among is not None and all(part_of(g) for g in gates):
        return F.when(contains_any(source, gates, among), found).otherwise(F.lit(""))
    present = F.contains(source, F.lit(gates[0]))
    for literal in gates[1:]:
        present = present | F.contains(source, F.lit(literal))
    return F.when(present, found).otherwise(F.lit(""))


def whole_words(text: Column, words: Iterable[str], pattern: str, among: Column | Words | None = None) -> Column:
    """Pattern of words with word boundaries, run only where one of the words occurs at all."""
    return contains_any(text, words, among) & matches(text, pattern)
