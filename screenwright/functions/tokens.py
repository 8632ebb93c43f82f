"""Token and cost estimates."""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright import catalogue as C
from screenwright.functions.text import contains_any, is_blank, let, utf16_length

MOST_TOKENS = 4000
# What all phrases that ask for a number of words end in.
COUNT_ENDING = commonprefix([phrase[::-1] for phrase, _ in C.WORD_COUNT_TOKENS])[::-1]


def count_tokens(text: Column) -> Column:
    return F.when(is_blank(text), 0).otherwise(F.ceil(utf16_length(text) / F.lit(4.0)).cast("int"))


def response_tokens(text: Column) -> Column:
    """Expected length of the answer. The rules apply in order, each to the result of the one before."""

    def estimate(v: Column) -> Column:
        lower, size = v["lower"], v["size"]
        base = F.greatest(F.lit(300), size * 3)
        long_form = let(base, lambda e: F.when(
            contains_any(lower, C.LONG_FORM), F.greatest(F.lit(1200), e * 2)).otherwise(e))
        code = let(long_form, lambda e: F.when(
            contains_any(lower, C.CODE_FORM), F.greatest(F.lit(600), e + 400)).otherwise(e))
        # The forms only add, so they are not looked for where the base is at the limit, nor where a short form is: that
        # gives less than any base.
        added = F.when(size * 3 >= MOST_TOKENS, MOST_TOKENS).otherwise(code)
        short = F.when(
            contains_any(lower, C.SHORT_FORM), F.greatest(F.lit(150), F.floor(size / F.lit(2)).cast("int"))).otherwise(added)
        counted = F.lit(None).cast("int")
        for phrase, tokens in C.WORD_COUNT_TOKENS:
            counted = F.when(F.contains(lower, F.lit(phrase)), tokens).otherwise(counted)
        counted = F.when(F.contains(lower, F.lit(COUNT_ENDING)), counted)
        return F.least(F.lit(MOST_TOKENS), F.greatest(F.lit(100), F.coalesce(counted, short)))

    values = F.struct(F.lower(text).alias("lower"), count_tokens(text).alias("size"))
    return F.when(is_blank(text), 100).otherwise(let(values, estimate))


def cost(tool: Column, input_tokens: Column, output_tokens: Column) -> Column:
    name = F.lower(F.coalesce(tool, F.lit("")))

    def price(column: int) -> Column:
        chain = None
        for names, *rates in C.PRICES:
            hit = F.lit(False)
            for part in names:
                hit = hit | F.contains(name, F.lit(part))
            rate = F.lit(rates[column] / 1_000_000.0)
            chain = F.when(hit, rate) if chain is None else chain.when(hit, rate)
        return chain.otherwise(F.lit(C.DEFAULT_PRICE[column] / 1_000_000.0))

    return input_tokens * price(0) + output_tokens * price(1)


def exact_sum(amount: Column) -> Column:
    """Sum of money independent of row order: amounts are whole multiples of a hundred-millionth dollar."""
    return F.coalesce(F.sum(F.round(amount, 8).cast("decimal(28,8)")), F.lit(0)).cast("double")
