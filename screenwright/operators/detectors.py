"""The screening detectors.

A detector has a direct layer (patterns and listed keywords) and an intent layer (word lists that together show what
the writer is doing). The direct layer becomes one array column per detector; the intent layer is evaluated only for
the rows that need it. All of it is one narrow projection: no shuffle, no Python per row.

``DETECTORS`` is the extension point. An entry is a name, the two layers as functions of a ``Text``, and whether the
intent layer also runs where the direct layer found something.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright import catalogue as C
from screenwright.functions.detections import (
    Tier,
    any_needle,
    finding,
    first_keyword,
    first_of,
    no_detections,
    tiered_keywords,
    with_values,
)
from screenwright.functions.reuse import built_once
from screenwright.functions.text import (
    Words,
    contains_any,
    first_match,
    is_blank,
    java_trim,
    let,
    literals,
    long_words,
    matches,
    normalise,
    regex,
    whole_words,
    word_ends,
)

TEXT_COLUMNS = ("_lower", "_norm", "_words", "_longest", "_inquiry", "_personal_inquiry")


@dataclass(frozen=True)
class Text:
    """The columns a detector looks at."""

    prompt: Column
    lower: Column
    norm: Column
    inquiry: Column
    personal_inquiry: Column
    words: Words
    longest: Column
    mode: str = "compact"


@dataclass(frozen=True)
class Detector:
    name: str
    direct: Callable[[Text], Column]
    intent: Callable[[Text, Column], Column]
    both_layers: bool = False


def injection_direct(t: Text) -> Column:
    # Every injection pattern needs one of these literals; testing them first spares most rows eight regex scans.
    attempt = contains_any(t.lower, (
        "mode", "instruction", "rules", "history", "guideline", "constraint", "filters", "safety", "you are now a",
        "system ", "restrictions",
    ), t.words)
    hit = F.lit(False)
    for pattern in C.INJECTION_PATTERNS:
        hit = hit | matches(t.prompt, pattern)
    return first_of((attempt & hit, finding("injection", "pattern", t.prompt)))


def injection_intent(t: Text, _direct: Column) -> Column:
    signals = F.struct(
        contains_any(t.norm, C.PERSONA, t.words).alias("persona"),
        contains_any(t.norm, C.GUARDRAIL_BYPASS, t.words).alias("bypass"),
        contains_any(t.norm, C.INSTRUCTION_OVERRIDE, t.words).alias("override"),
    )
    return F.when(t.inquiry, F.array(finding("injection", "inquiry"))).otherwise(let(signals, lambda s: first_of(
        (s["persona"] & s["bypass"], finding("injection", "persona_bypass", t.prompt)),
        (s["override"], finding("injection", "override", t.prompt)),
        (s["bypass"], finding("injection", "bypass", t.prompt)),
        (s["persona"], finding("injection", "persona", t.prompt)),
    )))


def secret_direct(t: Text) -> Column:
    gates = ("ghp_", "sk-", "PRIVATE KEY-----")
    return with_values(
        finding("secret", "pattern", first_match(t.prompt, pattern, (gate,), among=t.words))
        for pattern, gate in zip(C.SECRET_PATTERNS, gates, strict=True)
    )


def secret_intent(t: Text, _direct: Column) -> Column:
    signals = F.struct(
        contains_any(t.norm, C.SECRET_SHARING, t.words).alias("sharing"),
        contains_any(t.norm, C.SECRET_OWNERSHIP, t.words).alias("owned"),
    )
    return F.when(t.inquiry, F.array(finding("secret", "inquiry"))).when(
        contains_any(t.norm, C.SECRET_SENSITIVE, t.words),
        let(signals, lambda s: first_of(
            (s["sharing"] & s["owned"], finding("secret", "full")),
            (s["sharing"], finding("secret", "partial")),
            (F.lit(True), finding("secret", "mention")),
        )),
    ).otherwise(no_detections())


def personal_direct(t: Text) -> Column:
    def candidates(digits: Column) -> Column:
        def numeric(has_digits: Column, pattern: str) -> Column:
            return F.when(has_digits, first_match(t.prompt, pattern)).otherwise(F.lit(""))

        # A card number may have a separator after every digit; the others contain four digits in a row.
        return with_values([
            finding("personal", "EMAIL", first_match(t.prompt, C.EMAIL_PATTERN, ("@",))),
            finding("personal", "PHONE", numeric(digits["four"], C.PHONE_PATTERN)),
            finding("personal", "AADHAAR", numeric(digits["four"], C.AADHAAR_PATTERN)),
            finding("personal", "PAN", numeric(digits["four"], C.PAN_PATTERN)),
            finding("personal", "SSN", numeric(digits["four"], C.SSN_PATTERN)),
            finding("personal", "CREDIT_CARD", numeric(digits["any"], C.CREDIT_CARD_PATTERN)),
        ])

    some = matches(t.prompt, "[0-9]")
    return let(let(some, lambda d: F.struct(
        d.alias("any"), (d & matches(t.prompt, "[0-9]{4}")).alias("four"))), candidates)


def personal_intent(t: Text, direct: Column) -> Column:
    signals = F.struct(
        matches(t.norm, C.POSSESSION_PATTERN).alias("possession"),
        matches(t.norm, C.DISCLOSING_PATTERN).alias("sharing"),
    )
    return F.when(
        t.personal_inquiry & (F.size(direct) == 0), F.array(finding("personal", "inquiry")),
    ).when(
        contains_any(t.norm, C.PERSONAL_SENSITIVE, t.words),
        let(signals, lambda s: first_of(
            (s["possession"] & s["sharing"], finding("personal", "full")),
            (s["possession"] | s["sharing"], finding("personal", "partial")),
            (F.lit(True), finding("personal", "mention")),
        )),
    ).otherwise(no_detections())


def health_direct(t: Text) -> Column:
    record_words = ("mrn", "medical record", "patient id", "patient#", "record number")
    return with_values([
        finding("health", "MRN", first_match(t.prompt, C.MRN_PATTERN, record_words, t.lower, among=t.words)),
        finding("health", "ICD10",
                F.when(matches(t.prompt, "[0-9]{2}"), first_match(t.prompt, C.ICD10_PATTERN)).otherwise(F.lit(""))),
        finding("health", "NPI", first_match(t.prompt, C.NPI_PATTERN, ("npi",), t.lower, among=t.words)),
        finding("health", "DOB", first_match(t.prompt, C.DOB_PATTERN, ("dob", "date of birth", "born on"), t.lower, among=t.words)),
    ])


def health_intent(t: Text, _direct: Column) -> Column:
    signals = F.struct(
        contains_any(t.norm, C.HEALTH_PERSONAL, t.words).alias("personal"),
        contains_any(t.norm, C.HEALTH_DISCLOSURE, t.words).alias("disclosure"),
    )
    return F.when(
        contains_any(t.norm, C.HEALTH_TOPIC, t.words),
        let(signals, lambda s: first_of(
            (s["personal"] & s["disclosure"], finding("health", "full")),
            (s["personal"], finding("health", "partial")),
            (F.lit(True), finding("health", "mention")),
        )),
    ).otherwise(no_detections())


def code_direct(t: Text) -> Column:
    def snippet(pattern: str, gate: tuple[str, ...]) -> Column:
        return F.substring(first_match(t.prompt, pattern, gate, among=t.words), 1, 60)

    def seen(pattern: str, gate: str) -> Column:
        return contains_any(t.lower, (gate,), t.words) & matches(t.prompt, pattern)

    sql = (seen(C.SQL_SELECT_PATTERN, "select") | seen(C.SQL_INSERT_PATTERN, "insert")
           | seen(C.SQL_UPDATE_PATTERN, "update") | seen(C.SQL_DELETE_PATTERN, "delete"))
    script = contains_any(t.prompt, ("function", "const", "let", "var"), t.words) & (
        matches(t.prompt, C.JS_FUNCTION_PATTERN) | matches(t.prompt, C.JS_ARROW_PATTERN))

    def python(function: Column) -> Column:
        # The snippet is always that of the function, so a class alone is reported with an empty one.
        return F.when((function != "") | seen(C.PYTHON_CLASS_PATTERN, "class"),
                      F.array(finding("code", "python", function))).otherwise(no_detections())

    return F.concat(
        with_values([
            finding("code", "java_class", snippet(C.JAVA_CLASS_PATTERN, ("public", "private", "protected"))),
            finding("code", "annotation", snippet(C.JAVA_ANNOTATION_PATTERN, ("@",))),
        ]),
        first_of((sql, finding("code", "sql"))),
        let(snippet(C.PYTHON_DEF_PATTERN, ("def",)), python),
        with_values([finding("code", "python_import", snippet(C.PYTHON_IMPORT_PATTERN, ("import",)))]),
        first_of((script, finding("code", "script"))),
    )


def code_intent(t: Text, _direct: Column) -> Column:
    signals = F.struct(
        contains_any(t.norm, C.CODE_PROPRIETARY, t.words).alias("proprietary"),
        (contains_any(t.norm, C.CODE_SHARING, t.words) & contains_any(t.norm, C.CODE_REFERENCE, t.words)).alias("shared"),
    )
    return F.when(t.inquiry, F.array(finding("code", "inquiry"))).otherwise(let(signals, lambda s: first_of(
        (s["shared"] & s["proprietary"], finding("code", "full")),
        (s["shared"], finding("code", "partial")),
        (s["proprietary"], finding("code", "mention")),
    )))


def keyword_direct(t: Text) -> Column:
    tiers = (Tier("block", C.KEYWORD_BLOCK), Tier("alert", C.KEYWORD_ALERT))
    return tiered_keywords("keyword", tiers, t.norm, t.mode, as_written=t.lower, among=t.words)


def keyword_intent(t: Text, _direct: Column) -> Column:
    signals = F.struct(
        any_needle(t.norm, C.KEYWORD_HOW_TO, " ", t.mode, t.words).alias("how_to"),
        any_needle(t.norm, C.KEYWORD_ACTION, " ", t.mode, t.words).alias("action"),
        first_keyword(t.lower, C.KEYWORD_EXFILTRATION, t.words).alias("taken"),
    )
    return F.when(t.inquiry, F.array(finding("keyword", "inquiry"))).otherwise(let(signals, lambda s: first_of(
        (s["how_to"] & s["action"], finding("keyword", "how_to", t.prompt)),
        (s["taken"].isNotNull(), finding("keyword", "exfiltration", s["taken"], s["taken"])),
        (s["action"], finding("keyword", "action", t.prompt)),
    )))


def ranked_intent(name: str, *tiers: Tier) -> Callable[[Text, Column], Column]:
    """Intent layer of the detectors that look for the first keyword of ranked lists."""

    def intent(t: Text, _direct: Column) -> Column:
        return F.when(t.inquiry, F.array(finding(name, "inquiry"))).otherwise(
            tiered_keywords(name, tiers, t.norm, t.mode, among=t.words))

    return intent


def crypto_direct(t: Text) -> Column:
    def wallet(value: Column) -> Column:
        kind = (
            F.when(value.startswith("0x"), "Ethereum")
            .when(value.startswith("1") | value.startswith("3") | value.startswith("bc1"), "Bitcoin")
            .when(value.startswith("L") | value.startswith("M"), "Litecoin")
            .otherwise("Unknown Crypto")
        )
        return finding("crypto", "wallet_address", value, F.concat(kind, F.lit(")")))

    # Each pattern with the literal and the bytes without a space that a match has at least.
    gates, least = ((), ("0x",), ()), (14, 42, 27)
    return with_values(
        [finding("crypto", "key", long_match(t, p, 51)) for p in C.CRYPTO_KEY_PATTERNS]
        + [let(long_match(t, p, n, g), wallet) for p, g, n in zip(C.WALLET_PATTERNS, gates, least, strict=True)]
    )


def long_match(t: Text, pattern: str, least: int, gate: tuple[str, ...] = (), gate_text: Column | None = None) -> Column:
    """First match of a pattern that needs ``least`` bytes without a space."""
    return F.when(t.longest >= least, first_match(t.prompt, pattern, gate, gate_text, among=t.words)).otherwise(F.lit(""))


def network_direct(t: Text) -> Column:
    def every(pattern: str) -> Column:
        return F.regexp_extract_all(t.prompt, F.lit(regex(pattern)), F.lit(0))

    def public(ip: Column) -> Column:
        return ~F.exists(literals(C.LOCAL_IPV4_PREFIXES), lambda prefix: F.startswith(ip, prefix))

    v4 = F.transform(F.filter(every(C.IPV4_PATTERN), public), lambda ip: finding("network", "ipv4", ip))
    v6 = F.transform(every(C.IPV6_PATTERN), lambda ip: finding("network", "ipv6", ip))
    return F.concat(
        F.when(t.prompt.rlike(r"[0-9]\.[0-9]"), v4).otherwise(no_detections()),
        F.when(t.prompt.rlike("[0-9a-fA-F]:[0-9a-fA-F]"), v6).otherwise(no_detections()),
    )


def jwt_claims(payload: Column) -> Column:
    """Describe a web token by the issuer, subject and mail address in its middle part."""
    length = F.length(payload)
    padding = F.repeat(F.lit("="), F.pmod(F.lit(4) - length, F.lit(4)))
    decoded = F.try_to_binary(F.concat(F.translate(payload, "-_", "+/"), padding), F.lit("base64")).cast("string")

    def claim(body: Column, key: str, label: str) -> Column:
        value = java_trim(F.regexp_extract(body, f'"{key}"\\s*:\\s*"?([^",}}]+)"?', 1))
        return let(value, lambda v: F.when(v != "", F.concat(F.lit(f" {label}: "), v)).otherwise(F.lit("")))

    def describe(body: Column) -> Column:
        return F.when(body.isNull(), F.lit(C.JWT_UNREADABLE)).otherwise(F.concat(
            F.lit(C.JWT_DESCRIPTION),
            claim(body, "iss", "Issuer"), claim(body, "sub", "Subject"), claim(body, "email", "Email"),
        ))

    # Four characters stand for three bytes; one left-over character stands for nothing and is not valid.
    return let(F.when(length % 4 != 1, decoded), describe)


def jwt_direct(t: Text) -> Column:
    def token(value: Column) -> Column:
        payload = F.get(F.split(value, r"\."), F.lit(1))
        return F.when(value != "", F.array(finding("jwt", "token_value", value, jwt_claims(payload)))).otherwise(
            no_detections())

    return let(first_match(t.prompt, C.JWT_PATTERN, ("eyJ",), among=t.words), token)


def database_direct(t: Text) -> Column:
    uri_gates = (("jdbc:",), ("mongodb",), ("redis://",), ("postgres", "mysql", "mariadb"))
    url_gates = (("jdbc:",), ("database_url",))
    return with_values(
        [finding("database", "uri", first_match(t.prompt, p, g, t.lower, among=t.words))
         for p, g in zip(C.DB_CREDENTIAL_URI_PATTERNS, uri_gates, strict=True)]
        + [finding("database", "url", first_match(t.prompt, p, g, t.lower, among=t.words))
           for p, g in zip(C.DB_URL_PATTERNS, url_gates, strict=True)]
    )


def cloud_direct(t: Text) -> Column:
    secret_gates = (("akia",), (), ("sig=",), ('"private_key"',), ("signature=",))
    storage_gates = (("amazonaws.com",), ("blob.core.windows.net",), ("storage.googleapis.com",))
    least = (20, 40, 0, 0, 0)
    return with_values(
        [finding("cloud", "secret", long_match(t, p, n, g, t.lower))
         for p, g, n in zip(C.CLOUD_SECRET_PATTERNS, secret_gates, least, strict=True)]
        + [finding("cloud", "storage", first_match(t.prompt, p, g, t.lower, among=t.words))
           for p, g in zip(C.CLOUD_STORAGE_PATTERNS, storage_gates, strict=True)]
    )


DETECTORS: dict[str, Detector] = {d.name: d for d in (
    Detector("injection", injection_direct, injection_intent),
    Detector("secret", secret_direct, secret_intent),
    Detector("personal", personal_direct, personal_intent, both_layers=True),
    Detector("health", health_direct, health_intent, both_layers=True),
    Detector("keyword", keyword_direct, keyword_intent),
    Detector("code", code_direct, code_intent),
    Detector("crypto", crypto_direct, ranked_intent(
        "crypto", Tier("secret", C.CRYPTO_SECRET), Tier("wallet", C.CRYPTO_WALLET),
        Tier("transaction", C.CRYPTO_TRANSACTION))),
    Detector("network", network_direct, ranked_intent(
        "network", Tier("identity", C.NETWORK_IDENTITY), Tier("infra", C.NETWORK_INFRA),
        Tier("context", C.NETWORK_CONTEXT))),
    Detector("jwt", jwt_direct, ranked_intent(
        "jwt", Tier("token", C.AUTH_TOKEN, " -"), Tier("context", C.AUTH_CONTEXT, " -"),
        Tier("discussion", C.AUTH_DISCUSSION, " -"))),
    Detector("database", database_direct, ranked_intent(
        "database", Tier("credential", C.DB_CREDENTIAL, "_"), Tier("architecture", C.DB_ARCHITECTURE),
        Tier("operation", C.DB_OPERATION))),
    Detector("cloud", cloud_direct, ranked_intent(
        "cloud", Tier("credential", C.CLOUD_CREDENTIAL, "_"), Tier("infra", C.CLOUD_INFRA))),
)}
CORE = ("injection", "secret", "personal", "health", "keyword")
EXTRA = ("code", "crypto", "network", "jwt", "database", "cloud")


@built_once
def org_pieces() -> set[str]:
    """The pieces that the intent layer of organisations looks for, in either match mode."""
    among = Words(F.col("_words"))
    for mode in ("compact", "spaced"):
        for listed in (C.ORG_CIRCUMVENTION, C.ORG_DATA, C.ORG_SHARING):
            any_needle(F.col("_norm"), listed, " ", mode, among)
    return among.pieces


def add_text_columns(df: DataFrame, prompt: str = "prompt", pieces: Iterable[str] = ()) -> DataFrame:
    """Add the lowered and normalised text, its long words with the ends of words from a piece on, the length of the longest
    run without a space and the two inquiry tests, each computed once.

    ``pieces`` are those of detectors; those of the inquiry tests and of organisations are looked for in any case.
    An inquiry has a question mark, or one of the asking phrases as whole words. The general list is the personal one
    and one more phrase, so its own pattern runs only where that phrase occurs.
    """
    df = df.withColumns({
        "_lower": F.lower(F.coalesce(F.col(prompt), F.lit(""))),
        "_norm": normalise(F.col(prompt)),
        "_longest": F.coalesce(F.array_max(F.transform(F.split(prompt, " "), F.octet_length)), F.lit(0)),
    })
    norm, words = F.col("_norm"), Words(F.col("_words"))
    asked = F.contains(F.col("_lower"), F.lit("?"))
    personal = asked | whole_words(norm, C.INQUIRY_PHRASES, C.PERSONAL_INQUIRY_PATTERN, words)
    general = F.col("_personal_inquiry") | whole_words(norm, (C.INQUIRY_EXTRA_PHRASE,), C.INQUIRY_PATTERN, words)
    wanted = words.pieces | org_pieces() | set(pieces)
    df = df.withColumn("_words", let(long_words(norm), lambda w: F.array_append(w, word_ends(w, wanted))))
    return df.withColumn("_personal_inquiry", personal).withColumn("_inquiry", general)


def run_detectors(df: DataFrame, names: tuple[str, ...], prompt: str = "prompt", mode: str = "compact") -> DataFrame:
    """Add ``_found_<name>`` for each named detector and the text columns."""
    layers = {n: layer_columns(n, prompt, mode) for n in names}
    df = add_text_columns(df, prompt, {piece for *_, pieces in layers.values() for piece in pieces})
    df = df.withColumns({f"_direct_{n}": direct for n, (direct, *_) in layers.items()})
    return df.withColumns({f"_found_{n}": found for n, (_, found, _) in layers.items()}).drop(
        *[f"_direct_{n}" for n in names])


@built_once
def layer_columns(name: str, prompt: str, mode: str) -> tuple[Column, Column, set[str]]:
    """The direct layer of a detector, both layers together, which read the former from ``_direct_<name>``, and the pieces
    that they look for among the ends of words."""
    d = DETECTORS[name]
    words = Words(F.col("_words"))
    t = Text(F.col(prompt), F.col("_lower"), F.col("_norm"), F.col("_inquiry"), F.col("_personal_inquiry"), words, F.col("_longest"), mode)
    blank = is_blank(F.col(prompt))
    direct = F.col(f"_direct_{name}")
    intent = d.intent(t, direct)
    both = F.concat(direct, intent) if d.both_layers else F.when(F.size(direct) > 0, direct).otherwise(intent)
    return (F.when(blank, no_detections()).otherwise(d.direct(t)), F.when(blank, no_detections()).otherwise(both), words.pieces)


def detect(df: DataFrame, name: str, prompt: str = "prompt", mode: str = "compact") -> DataFrame:
    """Run one detector on its own: the input columns plus ``detections``."""
    scored = run_detectors(df, (name,), prompt, mode)
    return scored.withColumnRenamed(f"_found_{name}", "detections").drop(*TEXT_COLUMNS)
