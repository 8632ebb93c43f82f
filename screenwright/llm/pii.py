"""Personal data: fixed shapes, plus numbers that weak labelers and a trained classifier take for personal.

Candidates are grouped digit strings of 7 to 19 digits outside the fixed shapes (local phone numbers, identity numbers).
Four labelers vote on each (+1, -1 or no vote): the shape of its groups, a gazetteer of the words before it, the
characters around it, and what else stands nearby. Votes are counted by pattern (at most 81), expectation-maximisation
on those counts estimates each labeler's reliability without any label, and the posteriors, as soft labels, train the
final classifier: naive Bayes over features of the span (digits, groups, separators, the words before). A candidate is
personal where the classifier gives ``LEAST`` or more. The counts that are gathered have a fixed size; everything else
is DataFrame expressions on each row, so no row moves. Positions are running sums, and candidates meet the fixed spans
around them in one sorted pass, so the work of a text grows with its length, also where it is full of matches.

Null texts count as empty. Input columns travel in a struct, so their names may be anything. Very long texts are scanned whole; the patterns are possessive, so they stay linear and do
not recurse. An empty table trains nothing and gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.functions.text import settled

from .common import keep
from .spans import blocks, cut, in_order, joined, neighbours, none, quoted, replaced, sha256, spans

KINDS = ["email", "ip", "card", "phone", "number"]
# The shapes of the contract. A look-behind or \G lets a search start only where the longest match would;
# possessive groups match the same strings as greedy ones, as nothing that follows could take their characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

NUMBER = r"(?<![A-Za-z0-9_@.+#/=-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![A-Za-z0-9_@#=])"
#: Characters looked at before a candidate.
BEFORE = 24
LEAST = 0.9
ROUNDS = 30
# Words before a number that speak for and against a person, in English, German, French and Spanish.
FOR = ["tel", "telephone", "phone", "call", "mobile", "cell", "fax", "ssn", "passport", "telefon", "handy", "anrufen",
       "ausweis", "téléphone", "portable", "appeler", "passeport", "teléfono", "móvil", "llamar", "pasaporte"]
AGAINST = ["version", "license", "lizenz", "licence", "licencia", "isbn", "page", "seite", "página", "usd", "eur",
           "total", "order", "commit", "line", "row", "no", "nr", "id", "in", "since", "year"]
VOTES = ["shape", "gazetteer", "edges", "nearby"]


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn; digits that double are told by their distance from the end."""
    return (f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> IF(i % 2 = 0, CAST(d AS INT), "
            f"CAST(d AS INT) * 2 - IF(d >= '5', 9, 0))), 0, (s, d) -> s + d) % 10 = 0")


def base_spans(packed: DataFrame) -> DataFrame:
    """Adds ``_email``, ``_ip``, ``_card``, ``_phone`` and ``_number`` to a frame that has the text as ``_text``.

    Each step is settled: an array that the optimiser put into the lambda of the next step would be searched for again for
    every match.
    """
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    t = "_text"
    out = packed.withColumns({f"_{k}": settled(c) for k, c in {
        "email": F.when(F.contains(F.col(t), F.lit("@")), spans(t, EMAIL, "email")).otherwise(none()),
        "ip": spans(t, IP, "ip"), "card": spans(t, CARD, "card"),
        "phone": F.when(F.contains(F.col(t), F.lit("+")), spans(t, PHONE, "phone")).otherwise(none()),
        "number": spans(t, NUMBER, "number")}.items()})
    return out.withColumns({f"_{k}": settled(F.expr(c)) for k, c in {
        "ip": f"filter(_ip, x -> x.value RLIKE {quoted(IP_PARTS)})",
        "card": f"filter(_card, x -> length({digits}) BETWEEN 12 AND 19 AND {_luhn(digits)})",
        "phone": f"filter(_phone, x -> length({digits}) BETWEEN 9 AND 15)"}.items()})


def candidates(found: DataFrame) -> DataFrame:
    """Adds ``_votes``: candidates with one vote a labeler and the features of the classifier."""
    out = found.withColumn("_fixed", settled(F.concat("_email", "_ip", "_card", "_phone")))
    out = out.withColumns({
        "_number": settled(F.expr(f"filter({neighbours('_number', '_fixed')}, n -> n.before <= n.x.start AND n.after >= n.x.end)")),
        "_blocks": settled(F.expr(f"CASE WHEN size(_number) > 0 THEN {blocks('_text')} END"))})
    near = cut("_blocks", f"greatest(0, n.x.start - {BEFORE})", "n.x.start")
    out = out.withColumn("_number", settled(F.expr(f"""transform(transform(_number, n -> named_struct('n', n, 'near', {near})),
        m -> named_struct('start', m.n.x.start, 'end', m.n.x.end, 'value', m.n.x.value,
            'word', lower(regexp_extract(m.near, '([\\\\p{{L}}]+)[^\\\\p{{L}}]*$', 1)), 'tail', right(m.near, 2),
            'next', {cut("_blocks", "m.n.x.end", "m.n.x.end + 1")},
            'digits', length(regexp_replace(m.n.x.value, '[^0-9]', '')), 'groups', regexp_count(m.n.x.value, '[0-9]+'),
            'near', m.n.before + 60 > m.n.x.start OR m.n.after < m.n.x.end + 60))""")))
    words = lambda xs: "(" + ", ".join(f"'{w}'" for w in xs) + ")"
    shapes = r"^(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|0[0-9]{2,4}[ ./-][0-9]{5,8}|[0-9]{2}([ .][0-9]{2}){4})$"
    return out.withColumn("_votes", settled(F.expr(f"""coalesce(transform(_number, x -> named_struct('start', x.start, 'end', x.end,
        'shape', CASE WHEN x.value RLIKE {quoted(shapes)} THEN 1 WHEN x.groups = 1 OR x.groups > 6 THEN -1 ELSE 0 END,
        'gazetteer', CASE WHEN x.word IN {words(FOR)} THEN 1 WHEN x.word IN {words(AGAINST)} THEN -1 ELSE 0 END,
        'edges', CASE WHEN x.tail RLIKE ': ?$' THEN 1 WHEN x.tail RLIKE '[$€£"=%*]' OR x.next RLIKE '[%$€£"*]' THEN -1 ELSE 0 END,
        'nearby', CASE WHEN x.near THEN 1 WHEN x.digits > 15 THEN -1 ELSE 0 END,
        'features', array(concat('digits:', CAST(x.digits AS STRING)), concat('groups:', CAST(least(x.groups, 7) AS STRING)),
            concat('first:', IF(startswith(x.value, '('), 'bracket', IF(startswith(x.value, '0'), 'zero', 'digit'))),
            concat('mark:', CASE WHEN contains(x.value, '-') THEN 'hyphen' WHEN contains(x.value, '.') THEN 'dot'
                                 WHEN contains(x.value, ' ') THEN 'space' ELSE 'none' END),
            concat('word:', CASE WHEN x.word IN {words(FOR)} THEN 'for' WHEN x.word IN {words(AGAINST)} THEN 'against'
                                 ELSE 'other' END)))), array())"""))).drop("_number", "_fixed", "_blocks")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over counted vote patterns: the prior, and for each labeler and vote the chances of
    that vote on personal and other candidates. Starts from the majority, as a labeler is better than chance."""
    total = sum(n for _, n in patterns)
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(p))) for p, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(ROUNDS):
        yes = sum(q * n for q, (_, n) in zip(post, patterns, strict=True))
        prior = (yes + 1) / (total + 2)
        tables = []
        for k in range(len(VOTES)):
            table = {}
            for vote in (-1, 0, 1):
                a = sum(q * n for q, (p, n) in zip(post, patterns, strict=True) if p[k] == vote)
                b = sum((1 - q) * n for q, (p, n) in zip(post, patterns, strict=True) if p[k] == vote)
                table[vote] = ((a + 1) / (yes + 3), (b + 1) / (total - yes + 3))
            tables.append(table)
        post = [posterior(prior, tables, p) for p, _ in patterns]
    return prior, tables


def posterior(prior: float, tables: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def train(voted: DataFrame) -> tuple[float, dict[str, float]]:
    """The final classifier: its bias and a weight a feature. What comes to the driver has a fixed size."""
    one = voted.select(F.explode("_votes").alias("x"))
    # Votes and features are counted together in one pass: 81 patterns by a few thousand feature combinations at most.
    counts = one.groupBy(*(F.col(f"x.{v}").alias(v) for v in VOTES), F.col("x.features").alias("features")).agg(
        F.count(F.lit(1)).alias("n")).collect()
    patterns: dict[tuple[int, ...], int] = {}
    for r in counts:
        votes = tuple(r[v] for v in VOTES)
        patterns[votes] = patterns.get(votes, 0) + r["n"]
    if not patterns:
        return -1e9, {}
    prior, tables = reliabilities(sorted(patterns.items()))
    yes = no = 0.0
    by: dict[str, list[float]] = {}
    for r in sorted(counts, key=lambda r: (tuple(r[v] for v in VOTES), r["features"])):
        q = posterior(prior, tables, tuple(r[v] for v in VOTES))
        yes, no = yes + q * r["n"], no + (1 - q) * r["n"]
        for f in r["features"]:
            own = by.setdefault(f, [0.0, 0.0])
            own[0] += q * r["n"]
            own[1] += (1 - q) * r["n"]
    weights = {f: round(math.log((a + 1) / (yes + 20) / ((b + 1) / (no + 20))), 6) for f, (a, b) in sorted(by.items())}
    return round(math.log((yes + 1) / (no + 1)), 6), weights


def _found(docs: DataFrame, text: str, carry: list[str], least: float) -> DataFrame:
    """``_row`` with the columns of ``carry``, and the spans of each kind. What a text holds is found once and written;
    training and classification read that."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"),
                         F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    slim = {f"_{k}": F.expr(f"transform(_{k}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))") for k in KINDS[:4]}
    voted = keep(candidates(base_spans(packed)).withColumns(slim).drop("_text"), "personal-data")
    bias, weights = train(voted)
    cases = " ".join(f"WHEN {quoted(f)} THEN {w}D" for f, w in weights.items())
    weight = f"CASE f {cases} ELSE 0D END" if cases else "0D"
    limit = math.log(least / (1 - least)) - bias
    return voted.withColumn("_number", F.expr(
        f"transform(filter(_votes, x -> aggregate(transform(x.features, f -> {weight}), 0D, (s, w) -> s + w) >= {limit!r}D), "
        f"x -> named_struct('start', x.start, 'end', x.end, 'kind', 'number'))")).drop("_votes")


def with_pii(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """Adds the struct ``_found`` with the spans of each kind: email, ip, card, phone, number. An input column of that
    name gives way."""
    return _found(docs, text, docs.columns, least).select(
        *(F.col("_row").getField(c).alias(c) for c in docs.columns if c != "_found"),
        F.struct(*(F.col(f"_{k}").alias(k) for k in KINDS)).alias("_found"))


def redact(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with every span in its text replaced by its kind in brackets; nulls stay null."""
    found = _found(docs, text, docs.columns, least)
    found = found.withColumn("_all", settled(in_order([f"_{k}" for k in KINDS], KINDS)))
    found = found.withColumn("_text", F.col("_row").getField(text))
    return found.select(*((replaced("_text", "_all") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    found = _found(docs, "text", ["doc_id"], LEAST)
    found = found.withColumns({"_base": settled(in_order([f"_{k}" for k in KINDS[:4]], KINDS)),
                               "_all": settled(in_order([f"_{k}" for k in KINDS], KINDS))})
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]),
        sha256(joined("_base")).alias("base_sha256"), joined("_all").alias("spans"),
        F.size("_number").cast("long").alias("n_number"))
