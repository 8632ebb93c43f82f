"""Secret scan: fixed shapes, plus strings that a battery of randomness tests cannot tell from random.

Candidates are runs of 20 or more letters, digits and ``+/_-`` with both a letter and a digit. The encoding (hex, base32,
base64) is inferred from the characters. Three tests of "its characters are drawn uniformly" run on each: chi-squared
over the alphabet, the number of runs above and below the middle of the alphabet, and the lag-1 serial correlation;
the smallest of the three p-values counts three times. The less surprising a string is as a random one, the lower the
bin of that value.

What is reported is controlled, not what is dismissed: the null hypothesis is that a string is a path, a name or another
text-like string. Its distribution comes from the corpus, by encoding and length class (a quarter of a doubling): each
candidate gives a decoy that keeps its digits, signs and the capitals that start a hump, and whose letters are drawn by
the frequency of letters in all texts; classes with few candidates give several decoys each, up to ``LEAST_DECOYS``. The
decoys run through the same tests. The p-value of a candidate is the share of decoys of its class that look as random as it
does, and a Benjamini-Hochberg step-up at ``RATE`` within the class decides, so about that share of the reports is
expected to be false; ``_found.false_share`` says how many. Short strings give less evidence, so in them only few keys are told from names,
and capital hex strings, whose decoys keep most of the characters, hardly ever. All counts are of fixed size: letters, classes
and bins. All of it is DataFrame expressions; texts are read once, and what was found in them is written.

Null texts count as empty. Very long strings are tested whole. Rows that repeat are scanned each, and count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.functions.text import settled

from .common import keep
from .spans import free_of, in_order, joined, quoted, sha256, spans

# The shapes of the contract, letters of the key words in either case.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
#: A candidate starts where a run of its characters starts; it has to hold a digit and a letter (tested after).
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
RATE = 0.05
LEAST_DECOYS = 400
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters that decoys are drawn from are a string of about this length, each letter by its share.
_DRAWN = 2000
#: Bins of -log10 p: eight a decade, twenty decades.
BINS_A_DECADE, MOST_BIN = 8, 160


def _upper_tail(z: str) -> str:
    """P(Z > z) of the normal distribution by Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    tail = (f"(0.3989422804014327D * exp(-{z} * {z} / 2) * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * "
            f"(1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))")
    return f"IF({z} < 0, 1 - {tail}, {tail})"


def _tested_sql(array: str) -> str:
    """Candidates with encoding, length class and bin of their p-value, in nested steps so that each is worked out once."""
    hex_, base32, base64 = (f"'{a}'" for a in ALPHABETS.values())
    # Step 1: the string in the letters of its alphabet.
    named = f"""transform({array}, x -> named_struct('start', x.start, 'end', x.end, 'kind', 'random', 'code', CASE WHEN x.value RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex'
                     WHEN x.value RLIKE '^[A-Z2-7]+$' THEN 'base32' ELSE 'base64' END,
        'word', CASE WHEN x.value RLIKE '^[0-9A-F]+$' THEN lower(x.value)
                     WHEN x.value RLIKE '^[A-Z2-7]+$' THEN x.value ELSE translate(x.value, '-_', '+/') END))"""
    alphabet = f"CASE x.code WHEN 'hex' THEN {hex_} WHEN 'base32' THEN {base32} ELSE {base64} END"
    # Step 2: numbers of the characters, and which lie in the upper half of the alphabet.
    coded = f"""transform({named}, x -> named_struct('c', x, 'n', length(x.word),
        'k', CASE x.code WHEN 'hex' THEN 16 WHEN 'base32' THEN 32 ELSE 64 END,
        'v', transform(split(x.word, ''), y -> CAST(instr({alphabet}, y) - 1 AS DOUBLE)),
        'h', CASE x.code WHEN 'hex' THEN translate(x.word, {hex_}, '{"0" * 8 + "1" * 8}')
             WHEN 'base32' THEN translate(x.word, {base32}, '{"0" * 16 + "1" * 16}')
             ELSE translate(x.word, {base64}, '{"0" * 32 + "1" * 32}') END,
        'squares', aggregate(transform(array_distinct(split(x.word, '')),
                                       y -> length(x.word) - length(replace(x.word, y, ''))),
                             0D, (s, y) -> s + CAST(y AS DOUBLE) * y)))"""
    # Step 3: the statistics. Serial: mean product of neighbours' deviations over the alphabet's variance.
    stats = f"""transform({coded}, x -> named_struct('c', x.c, 'n', x.n, 'k', x.k,
        'chi', x.squares * x.k / x.n - x.n,
        'ones', CAST(length(replace(x.h, '0', '')) AS DOUBLE),
        'runs', CAST(1 + x.n - 1 - (length(x.h) - length(regexp_replace(x.h, '(?<=0)0|(?<=1)1', ''))) AS DOUBLE),
        'serial', aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1),
                                     (a, b) -> (a - (x.k - 1) / 2D) * (b - (x.k - 1) / 2D)), 0D, (s, y) -> s + y)))"""
    # Step 4: standard scores. Chi-squared by the cube root of Wilson and Hilferty; runs given the counts.
    scores = f"""transform({stats}, x -> named_struct('c', x.c, 'n', x.n,
        'chi', (pow(greatest(x.chi, 0D) / (x.k - 1), 1 / 3D) - (1 - 2 / (9D * (x.k - 1)))) / sqrt(2 / (9D * (x.k - 1))),
        'runs', IF(x.ones = 0 OR x.ones = x.n, sqrt(CAST(x.n AS DOUBLE)),
            abs(x.runs - (1 + 2 * x.ones * (x.n - x.ones) / x.n)) / sqrt(greatest(1e-9D,
                2 * x.ones * (x.n - x.ones) * (2 * x.ones * (x.n - x.ones) - x.n) / (CAST(x.n AS DOUBLE) * x.n * (x.n - 1))))),
        'serial', abs(x.serial) / (sqrt(CAST(x.n - 1 AS DOUBLE)) * (CAST(x.k AS DOUBLE) * x.k - 1) / 12D)))"""
    p = f"least({_upper_tail('x.chi')}, 2 * {_upper_tail('x.runs')}, 2 * {_upper_tail('x.serial')})"
    return f"""transform({scores}, x -> named_struct('start', x.c.start, 'end', x.c.end, 'kind', x.c.kind,
        'stratum', concat(x.c.code, ':', CAST(floor(4 * log2(x.n)) AS INT)),
        'bin', CAST(least({MOST_BIN}, greatest(0, floor(-log10(greatest(least(1D, 3 * {p}), 1e-30D)) * {BINS_A_DECADE})))
                    AS INT)))"""


def _tested(array: str) -> Column:
    return F.expr(_tested_sql(array))


def scan(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``_row`` with the columns of ``carry``, base spans ``_assign``, ``_access`` and ``_hex``, the candidates outside of
    them (``_runs``) and the counts of letters, written to the shared folder."""
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    # Settled: an array that the optimiser put into the lambda of the next step would be searched for again every time.
    out = out.withColumns({"_assign": settled(spans("_text", ASSIGN, "assign", 2)), "_access": settled(spans("_text", ACCESS, "access")),
                           "_hex": settled(spans("_text", HEX, "hex")), "_runs": settled(spans("_text", RANDOM, "random")),
                           "_lower": settled(F.lower("_text"))})
    out = out.withColumn("_assign", settled(F.expr("filter(_assign, x -> length(x.part) >= 12)")))
    out = out.withColumns({
        "_base": settled(F.concat("_assign", "_access", "_hex")),
        "_letters": F.expr("transform(array(" + ", ".join(f"'{c}'" for c in _LETTERS) + "), "
                           "c -> CAST(length(_lower) - length(replace(_lower, c, '')) AS BIGINT))"),
        "_runs": settled(F.expr("filter(_runs, x -> x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Za-z]')"))})
    slim = {f"_{k}": F.expr(f"transform(_{k}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))") for k in KINDS[:3]}
    return keep(out.withColumn("_runs", free_of("_runs", "_base")).withColumns(slim).drop("_base", "_text", "_lower"), "secrets")


def decoys(array: str, letters: dict[str, str], copies: str) -> str:
    """SQL of the decoys of candidates: ``letters`` has the string that letters are drawn from by encoding, ``copies`` is
    the number of decoys of a candidate ``x``."""
    drawn = "CASE code " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in letters.items()) + " END"
    size = "CASE code " + " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in letters.items()) + " END"
    code = _code("x.value")
    letter = f"substring({drawn}, 1 + CAST(pmod(xxhash64(x.value, k, i), {size}) AS INT), 1)"
    return f"""flatten(transform({array}, x -> flatten(transform(array({code}), code -> transform(sequence(1, {copies}), k ->
        named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'part', x.part, 'value', array_join(transform(split(x.value, ''),
            (c, i) -> CASE WHEN NOT c RLIKE '[A-Za-z]' THEN c
                           WHEN code = 'base32' OR code = 'HEX' OR (c RLIKE '[A-Z]' AND substring(x.value, i + 2, 1) RLIKE '[a-z]')
                           THEN upper({letter}) ELSE {letter} END), '')))))))"""


def _code(value: str) -> str:
    return (f"CASE WHEN {value} RLIKE '^[0-9a-f]+$' THEN 'hex' WHEN {value} RLIKE '^[0-9A-F]+$' THEN 'HEX' "
            f"WHEN {value} RLIKE '^[A-Z2-7]+$' THEN 'base32' ELSE 'base64' END")


def _drawn(counts: list[int]) -> dict[str, str]:
    """The strings that letters are drawn from, by encoding; every letter occurs."""
    def of(some: str) -> str:
        n = [counts[_LETTERS.index(c)] for c in some]
        return "".join(c * (1 + round(_DRAWN * k / max(1, sum(n)))) for c, k in zip(some, n, strict=True))

    return {"hex": of("abcdef"), "HEX": of("abcdef"), "base32": of(_LETTERS), "base64": of(_LETTERS)}


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[str, tuple[int, float]]:
    """For each encoding and length class: the largest bin that is reported, and the expected share of false reports.

    Sums by class and bin; classes grow with the logarithm of the longest string, so few rows come back.
    """
    totals = scanned.agg(*(F.sum(F.col("_letters")[i]).alias(c) for i, c in enumerate(_LETTERS))).first()
    letters = _drawn([n or 0 for n in totals])
    # The class of a candidate depends on its encoding and length alone, so that decoys can be told off beforehand.
    class_ = f"concat({_code('x.value')}, ':', CAST(floor(4 * log2(length(x.value))) AS INT))"
    sizes = scanned.where("size(_runs) > 0").select(F.explode("_runs").alias("x")).groupBy(F.expr(class_).alias("class")).agg(
        F.count(F.lit(1)).alias("n")).collect()
    several = " ".join(f"WHEN {quoted(r['class'])} THEN {-(-LEAST_DECOYS // r['n'])}" for r in sorted(sizes) if r["n"] < LEAST_DECOYS)
    copies = f"CASE {class_} {several} ELSE 1 END" if several else "1"
    some = scanned.where("size(_runs) > 0").select("_runs", F.expr(decoys("_runs", letters, copies)).alias("_decoys"))
    both = some.select(F.explode(F.concat(
        F.transform(_tested("_runs"), lambda x: F.struct(x["stratum"].alias("stratum"), x["bin"].alias("bin"), F.lit(True).alias("own"))),
        F.transform(_tested("_decoys"), lambda x: F.struct(x["stratum"].alias("stratum"), x["bin"].alias("bin"), F.lit(False).alias("own"))),
    )).alias("c"))
    counted = both.groupBy("c.stratum", "c.bin").agg(F.count_if("c.own").alias("n"), F.count_if(~F.col("c.own")).alias("null")).collect()
    out = {}
    for stratum in sorted({r["stratum"] for r in counted}):
        bins = sorted((r["bin"], r["n"], r["null"]) for r in counted if r["stratum"] == stratum)
        m, all_null, own, null = sum(x[1] for x in bins), sum(x[2] for x in bins), 0, 0
        for b, n, d in bins:
            own, null = own + n, null + d
            p = (null + 1) / (all_null + 1)
            if own and p <= rate * own / m:
                out[stratum] = (b, p * m / own)
    return out


def _found(docs: DataFrame, text: str, carry: list[str], rate: float) -> DataFrame:
    scanned = scan(docs, text, carry)
    limits = thresholds(scanned, rate)

    def of_stratum(i: int, other: str) -> str:
        cases = " ".join(f"WHEN {quoted(s)} THEN {v[i]}" for s, v in sorted(limits.items()))
        return f"coalesce(CASE x.stratum {cases} END, {other})" if cases else other

    out = scanned.withColumn("_random", settled(F.expr("filter(" + _tested_sql("_runs") + f", x -> x.bin <= {of_stratum(0, '-1')})")))
    return out.withColumns({
        "_false": F.expr(f"array_max(transform(_random, x -> CAST({of_stratum(1, '0')} AS DOUBLE)))"),
        "_random": F.expr("transform(_random, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))")}).drop("_runs", "_letters")


def with_secrets(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """Adds the struct ``_found`` with the spans of each kind (assign, access, hex, random) and ``false_share``, the share
    of random ones expected to be false in the least certain class met (null without any). An input column of that name
    gives way."""
    return _found(docs, text, docs.columns, rate).select(
        *(F.col("_row").getField(c).alias(c) for c in docs.columns if c != "_found"),
        F.struct(*(F.col(f"_{k}").alias(k) for k in KINDS), F.col("_false").alias("false_share")).alias("_found"))


def digest(docs: DataFrame) -> DataFrame:
    found = _found(docs, "text", ["doc_id"], RATE)
    found = found.withColumns({"_base": settled(in_order(["_assign", "_access", "_hex"], KINDS)),
                               "_all": settled(in_order(["_assign", "_access", "_hex", "_random"], KINDS))})
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        sha256(joined("_base")).alias("base_sha256"), joined("_all").alias("spans"),
        F.size("_random").cast("long").alias("n_random"), F.col("_false").alias("false_share"))
