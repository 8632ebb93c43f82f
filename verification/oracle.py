r"""The screening rules in SQL, for comparison with the Spark results.

Written from the rules, not from the Spark expressions: detectors are CASE chains over lists, organisation policies
are joins with position windows instead of folded arrays, redaction is a list reduction.

``\b`` in this SQL dialect knows ASCII only. Texts are therefore folded first: letters and digits outside ASCII become
``_``, which is a word character, and everything else outside ASCII becomes ``!``, which is not.
"""

from __future__ import annotations

from screenwright import catalogue as C
from verification.bindings import base_sql, quote

BLANK = r"[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"


def blank(text: str) -> str:
    return f"({text} IS NULL OR NOT regexp_matches({text}, '{BLANK.replace('[', '[^', 1)}'))"


def trim(text: str) -> str:
    return rf"regexp_replace({text}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def fold(text: str) -> str:
    return (rf"regexp_replace(regexp_replace({text}, '[^\x00-\x7F\p{{L}}\p{{Nd}}]', '!', 'g'), "
            rf"'[^\x00-\x7F]', '_', 'g')")


def words(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def has(text: str, values) -> str:
    return f"len(list_filter({words(values)}, lambda w: contains({text}, w))) > 0"


def has_compact(text: str, values) -> str:
    return f"len(list_filter({words(values)}, lambda w: contains({text}, replace(w, ' ', '')))) > 0"


def source(pattern: str) -> str:
    return "folded" if r"\b" in pattern else "prompt"


def is_match(pattern: str, text: str | None = None) -> str:
    return f"regexp_matches({text or source(pattern)}, {quote(pattern)})"


def value(pattern: str) -> str:
    return f"regexp_extract({source(pattern)}, {quote(pattern)})"


def struct(risk_type: str, score: str, description: str, matched: str) -> str:
    return f"{{'t': {risk_type}, 's': CAST({score} AS INT), 'd': {description}, 'm': {matched}}}"


def report(detector: str, key: str, matched: str | None = None, detail: str | None = None) -> str:
    risk_type, score, description, message = C.FINDINGS[detector, key]
    text = quote(description) + (f" || {detail}" if detail else "")
    return struct(quote(risk_type), str(score), text, quote(message) if message is not None else matched)


NONE = "CAST([] AS STRUCT(t VARCHAR, s INT, d VARCHAR, m VARCHAR)[])"


def one(item: str) -> str:
    return f"[{item}]"


def cases(*branches: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in branches) + f" ELSE {NONE} END"


def valued(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda d: d.m <> '')"


def ranked(detector: str, tiers) -> str:
    """First keyword over tiers, as a coalesce of first list elements."""
    branches = [("inquiry", one(report(detector, "inquiry")))]
    for key, values, strip in tiers:
        needle = "w"
        for c in strip:
            needle = f"replace({needle}, '{c}', '')"
        first = f"list_filter({words(values)}, lambda w: contains(norm, {needle}))[1]"
        branches.append((f"{first} IS NOT NULL", one(report(detector, key, first, first))))
    return cases(*branches)


def detectors() -> dict[str, tuple[str, str, bool]]:
    """Name -> (direct layer, intent layer, whether both run)."""
    d: dict[str, tuple[str, str, bool]] = {}
    attempt = " OR ".join(is_match(p) for p in C.INJECTION_PATTERNS)
    persona, bypass, override = has("norm", C.PERSONA), has("norm", C.GUARDRAIL_BYPASS), has("norm", C.INSTRUCTION_OVERRIDE)
    d["injection"] = (
        cases((f"({attempt})", one(report("injection", "pattern", "prompt")))),
        cases(("inquiry", one(report("injection", "inquiry"))),
              (f"{persona} AND {bypass}", one(report("injection", "persona_bypass", "prompt"))),
              (override, one(report("injection", "override", "prompt"))),
              (bypass, one(report("injection", "bypass", "prompt"))),
              (persona, one(report("injection", "persona", "prompt")))), False)
    sensitive, sharing, owned = (has("norm", v) for v in (C.SECRET_SENSITIVE, C.SECRET_SHARING, C.SECRET_OWNERSHIP))
    d["secret"] = (
        valued([report("secret", "pattern", value(p)) for p in C.SECRET_PATTERNS]),
        cases(("inquiry", one(report("secret", "inquiry"))),
              (f"{sensitive} AND {sharing} AND {owned}", one(report("secret", "full"))),
              (f"{sensitive} AND {sharing}", one(report("secret", "partial"))),
              (sensitive, one(report("secret", "mention")))), False)
    personal = (("EMAIL", C.EMAIL_PATTERN), ("PHONE", C.PHONE_PATTERN), ("AADHAAR", C.AADHAAR_PATTERN),
                ("PAN", C.PAN_PATTERN), ("SSN", C.SSN_PATTERN), ("CREDIT_CARD", C.CREDIT_CARD_PATTERN))
    poss, share = is_match(C.POSSESSION_PATTERN, "folded_norm"), is_match(C.DISCLOSING_PATTERN, "folded_norm")
    sens = has("norm", C.PERSONAL_SENSITIVE)
    d["personal"] = (
        valued([report("personal", key, value(p)) for key, p in personal]),
        cases(("personal_inquiry AND len(direct_personal) = 0", one(report("personal", "inquiry"))),
              (f"{poss} AND {sens} AND {share}", one(report("personal", "full"))),
              (f"({poss} AND {sens}) OR ({sens} AND {share})", one(report("personal", "partial"))),
              (sens, one(report("personal", "mention")))), True)
    health = (("MRN", C.MRN_PATTERN), ("ICD10", C.ICD10_PATTERN), ("NPI", C.NPI_PATTERN), ("DOB", C.DOB_PATTERN))
    own, topic, disclosed = (has("norm", v) for v in (C.HEALTH_PERSONAL, C.HEALTH_TOPIC, C.HEALTH_DISCLOSURE))
    d["health"] = (
        valued([report("health", key, value(p)) for key, p in health]),
        cases((f"{own} AND {topic} AND {disclosed}", one(report("health", "full"))),
              (f"{own} AND {topic}", one(report("health", "partial"))),
              (topic, one(report("health", "mention")))), True)
    listed = []
    for key, values in (("block", C.KEYWORD_BLOCK), ("alert", C.KEYWORD_ALERT)):
        first = (f"list_filter({words(values)}, "
                 "lambda w: contains(lowered, w) OR contains(norm, replace(w, ' ', '')))[1]")
        listed.append((f"{first} IS NOT NULL", one(report("keyword", key, first, first))))
    taken = f"list_filter({words(C.KEYWORD_EXFILTRATION)}, lambda w: contains(lowered, w))[1]"
    action = has_compact("norm", C.KEYWORD_ACTION)
    d["keyword"] = (
        cases(*listed),
        cases(("inquiry", one(report("keyword", "inquiry"))),
              (f"{has_compact('norm', C.KEYWORD_HOW_TO)} AND {action}", one(report("keyword", "how_to", "prompt"))),
              (f"{taken} IS NOT NULL", one(report("keyword", "exfiltration", taken, taken))),
              (action, one(report("keyword", "action", "prompt")))), False)
    snippet = {key: f"substr({value(p)}, 1, 60)" for key, p in (
        ("java_class", C.JAVA_CLASS_PATTERN), ("annotation", C.JAVA_ANNOTATION_PATTERN),
        ("python", C.PYTHON_DEF_PATTERN), ("python_import", C.PYTHON_IMPORT_PATTERN))}
    sql = " OR ".join(is_match(p) for p in (
        C.SQL_SELECT_PATTERN, C.SQL_INSERT_PATTERN, C.SQL_UPDATE_PATTERN, C.SQL_DELETE_PATTERN))
    seen = {
        "java_class": is_match(C.JAVA_CLASS_PATTERN), "annotation": is_match(C.JAVA_ANNOTATION_PATTERN), "sql": sql,
        "python": f"{is_match(C.PYTHON_DEF_PATTERN)} OR {is_match(C.PYTHON_CLASS_PATTERN)}",
        "python_import": is_match(C.PYTHON_IMPORT_PATTERN),
        "script": f"{is_match(C.JS_FUNCTION_PATTERN)} OR {is_match(C.JS_ARROW_PATTERN)}",
    }
    code = " || ".join(cases((f"({hit})", one(report("code", key, snippet.get(key))))) for key, hit in seen.items())
    reference, handed, ours = (has("norm", v) for v in (C.CODE_REFERENCE, C.CODE_SHARING, C.CODE_PROPRIETARY))
    d["code"] = (
        code,
        cases(("inquiry", one(report("code", "inquiry"))),
              (f"{reference} AND {handed} AND {ours}", one(report("code", "full"))),
              (f"{reference} AND {handed}", one(report("code", "partial"))),
              (ours, one(report("code", "mention")))), False)

    def wallet(p: str) -> str:
        v = value(p)
        kind = (f"CASE WHEN starts_with({v}, '0x') THEN 'Ethereum' WHEN starts_with({v}, '1') OR starts_with({v}, '3') "
                f"OR starts_with({v}, 'bc1') THEN 'Bitcoin' WHEN starts_with({v}, 'L') OR starts_with({v}, 'M') "
                "THEN 'Litecoin' ELSE 'Unknown Crypto' END || ')'")
        return report("crypto", "wallet_address", v, kind)

    d["crypto"] = (
        valued([report("crypto", "key", value(p)) for p in C.CRYPTO_KEY_PATTERNS] + [wallet(p) for p in C.WALLET_PATTERNS]),
        ranked("crypto", (("secret", C.CRYPTO_SECRET, " "), ("wallet", C.CRYPTO_WALLET, " "),
                          ("transaction", C.CRYPTO_TRANSACTION, " "))), False)
    public = "NOT (" + " OR ".join(f"starts_with(ip, '{p}')" for p in C.LOCAL_IPV4_PREFIXES) + ")"
    d["network"] = (
        f"list_transform(list_filter(regexp_extract_all(folded, {quote(C.IPV4_PATTERN)}), lambda ip: {public}), "
        f"lambda ip: {report('network', 'ipv4', 'ip')}) || "
        f"list_transform(regexp_extract_all(folded, {quote(C.IPV6_PATTERN)}), "
        f"lambda ip: {report('network', 'ipv6', 'ip')})",
        ranked("network", (("identity", C.NETWORK_IDENTITY, " "), ("infra", C.NETWORK_INFRA, " "),
                           ("context", C.NETWORK_CONTEXT, " "))), False)
    d["jwt"] = (
        cases((f"{value(C.JWT_PATTERN)} <> ''",
               one(report("jwt", "token_value", value(C.JWT_PATTERN), claims(f"split_part({value(C.JWT_PATTERN)}, '.', 2)"))))),
        ranked("jwt", (("token", C.AUTH_TOKEN, " -"), ("context", C.AUTH_CONTEXT, " -"),
                       ("discussion", C.AUTH_DISCUSSION, " -"))), False)
    d["database"] = (
        valued([report("database", "uri", value(p)) for p in C.DB_CREDENTIAL_URI_PATTERNS]
               + [report("database", "url", value(p)) for p in C.DB_URL_PATTERNS]),
        ranked("database", (("credential", C.DB_CREDENTIAL, "_"), ("architecture", C.DB_ARCHITECTURE, " "),
                            ("operation", C.DB_OPERATION, " "))), False)
    d["cloud"] = (
        valued([report("cloud", "secret", value(p)) for p in C.CLOUD_SECRET_PATTERNS]
               + [report("cloud", "storage", value(p)) for p in C.CLOUD_STORAGE_PATTERNS]),
        ranked("cloud", (("credential", C.CLOUD_CREDENTIAL, "_"), ("infra", C.CLOUD_INFRA, " "))), False)
    return d


def claims(payload: str) -> str:
    padded = f"rpad(translate({payload}, '-_', '+/'), CAST(4 * ceil(length({payload}) / 4.0) AS INT), '=')"
    body = f"TRY(decode(from_base64({padded})))"

    def claim(key: str, label: str) -> str:
        v = trim(f"""regexp_extract({body}, '"{key}"\\s*:\\s*"?([^",}}]+)"?', 1)""")
        return f"CASE WHEN {v} <> '' THEN ' {label}: ' || {v} ELSE '' END"

    return (f"CASE WHEN length({payload}) % 4 = 1 OR {body} IS NULL THEN {quote(C.JWT_UNREADABLE)} ELSE "
            f"{quote(C.JWT_DESCRIPTION)} || {claim('iss', 'Issuer')} || {claim('sub', 'Subject')} || "
            f"{claim('email', 'Email')} END")


SUB = (f"CASE WHEN sub_user IS NULL OR {trim('sub_user')} = '' OR sub_user = 'anonymous-sub' THEN 'unknown' "
       "ELSE sub_user END")


def canonical(sub: str) -> str:
    return (
        f"CASE WHEN user_id = '101' OR lower(user_id) IN ('telecomm', 'telecomm-user') OR lower({sub}) = 'telecomm-user' "
        f"THEN 'Telecomm' WHEN user_id = '102' OR lower(user_id) IN ('software', 'software-user') "
        f"OR lower({sub}) = 'software-user' THEN 'Software' WHEN user_id IS NULL OR {trim('user_id')} = '' "
        "OR user_id = 'anonymous-user' THEN 'anonymous-user' ELSE user_id END")


NORM = trim(r"regexp_replace(regexp_replace(lower(coalesce(prompt, '')), '[.\-_*/|\\+=\[\]{}()]', '', 'g'), '[\t-\r ]+', ' ', 'g')")


def texts(origin: str) -> str:
    """Text columns beside every column of ``origin``."""
    return f"""
SELECT *, contains(lowered, '?') OR {is_match(C.INQUIRY_PATTERN, 'folded_norm')} AS inquiry,
  contains(lowered, '?') OR {is_match(C.PERSONAL_INQUIRY_PATTERN, 'folded_norm')} AS personal_inquiry
FROM (SELECT *, {fold('norm')} AS folded_norm, {fold('prompt')} AS folded
      FROM (SELECT *, lower(coalesce(prompt, '')) AS lowered, {NORM} AS norm, {blank('prompt')} AS blank FROM {origin}))"""


def found(names, origin: str = "texts") -> str:
    rules = detectors()
    direct = ", ".join(f"CASE WHEN blank THEN {NONE} ELSE {rules[n][0]} END AS direct_{n}" for n in names)
    both = []
    for n in names:
        _, intent, all_layers = rules[n]
        layered = f"direct_{n} || ({intent})" if all_layers else (
            f"CASE WHEN len(direct_{n}) > 0 THEN direct_{n} ELSE {intent} END")
        both.append(f"CASE WHEN blank THEN {NONE} ELSE {layered} END AS found_{n}")
    return f"SELECT *, {', '.join(both)} FROM (SELECT *, {direct} FROM {origin})"


ORG_HITS = f"""
keywords AS (
  SELECT id, user_id AS org_key, lower(sub_user) AS policy_sub, coalesce(allow_col, false) AS allow,
    coalesce(block_col, false) AS block, coalesce(critical_col, false) AS critical, coalesce(redacted_col, false) AS redact,
    unnest(list_filter(list_transform(string_split(keyword_list, ','), lambda w: {trim('w')}), lambda w: w <> '')) AS word,
    generate_subscripts(
      list_filter(list_transform(string_split(keyword_list, ','), lambda w: {trim('w')}), lambda w: w <> ''), 1) AS pos
  FROM policies),
hits AS (
  SELECT t.request_id, k.*, row_number() OVER (PARTITION BY t.request_id, k.id ORDER BY k.pos) AS nth
  FROM texts t JOIN keywords k ON t.org_key = k.org_key AND (k.policy_sub = '*' OR k.policy_sub = lower(t.sub_user))
  WHERE NOT t.blank AND (k.word = '*' OR contains(t.lowered, lower(k.word))
    OR contains(t.norm, replace(replace(replace(lower(k.word), ' ', ''), '-', ''), '_', '')))),
firsts AS (
  SELECT *, min(CASE WHEN allow THEN id END) OVER (PARTITION BY request_id) AS stop FROM hits WHERE nth = 1),
org_direct AS (
  SELECT request_id, bool_or(stop IS NOT NULL) AS stopped,
    coalesce(list(d ORDER BY id) FILTER (WHERE (stop IS NULL OR id < stop) AND d.t IS NOT NULL), {NONE}) AS org_hits
  FROM (SELECT *, CASE
      WHEN block THEN {report('org', 'block', 'word', "org_key || ']: \"' || word || '\"'")}
      WHEN critical THEN {report('org', 'critical', 'word', "org_key || ']: \"' || word || '\"'")}
      WHEN redact THEN {report('org', 'redact', 'word', "org_key || ']: \"' || word || '\"'")} END AS d FROM firsts)
  GROUP BY request_id)"""

ORG_INTENT = cases(
    ("inquiry", one(report("org", "inquiry"))),
    (has_compact("norm", C.ORG_CIRCUMVENTION), one(report("org", "circumvention", "prompt"))),
    (f"{has_compact('norm', C.ORG_DATA)} AND {has_compact('norm', C.ORG_SHARING)}",
     one(report("org", "sharing", "prompt"))),
    (has_compact("norm", C.ORG_DATA), one(report("org", "data", "prompt"))))


def org_found(origin: str) -> str:
    return f"""
SELECT *, CASE WHEN blank OR org_key IS NULL OR sub_user IS NULL THEN {NONE}
  WHEN NOT coalesce(stopped, false) AND len(coalesce(org_hits, {NONE})) > 0 THEN org_hits
  ELSE coalesce(org_hits, {NONE}) || ({ORG_INTENT}) END AS found_org
FROM {origin} LEFT JOIN org_direct USING (request_id)"""


def band(pick: int, below: str) -> str:
    return "CASE " + " ".join(f"WHEN risk_score >= {b[0]} THEN '{b[pick]}'" for b in C.BANDS) + f" ELSE '{below}' END"


def reason() -> str:
    branches = []
    for action, (by_type, default, ending) in C.REASONS.items():
        start = " ".join(f"WHEN '{t}' THEN {quote(x)}" for t, x in by_type.items())
        branches.append(f"WHEN '{action}' THEN CASE highest_risk_type {start} ELSE {quote(default)} END || {quote(ending)} "
                        "|| CAST(risk_score AS VARCHAR) || ').'")
    return f"CASE action {' '.join(branches)} ELSE {quote(C.ALLOW_REASON)} END"


def placeholder(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{t}' THEN '{p}'" for t, p in C.PLACEHOLDERS.items()) + (
        f" ELSE '{C.DEFAULT_PLACEHOLDER}' END")


REDACTED = f"""CASE WHEN len(list_filter(detections, lambda d: d.m = '*')) > 0
  THEN {placeholder("list_filter(detections, lambda d: d.m = '*')[1].t")}
  ELSE list_reduce([{{'t': '', 's': CAST(0 AS INT), 'd': '', 'm': prompt}}]
    || list_filter(detections, lambda d: NOT {blank('d.m')}),
    lambda a, d: {{'t': a.t, 's': a.s, 'd': a.d, 'm': replace(a.m, d.m, {placeholder('d.t')})}}).m END"""

ORDER = ("injection", "secret", "personal", "health", "keyword", "org", "code", "crypto", "network", "jwt", "database",
         "cloud")


def utf16(text: str) -> str:
    return rf"(length({text}) + len(regexp_extract_all({text}, '[\x{{10000}}-\x{{10FFFF}}]')))"


def tokens(text: str) -> str:
    return f"CASE WHEN {blank(text)} THEN 0 ELSE CAST(ceil({utf16(text)} / 4.0) AS INT) END"


def answer(text: str) -> str:
    low, size = f"lower({text})", f"({tokens(text)})"
    base = f"greatest(300, {size} * 3)"
    long_form = f"CASE WHEN {has(low, C.LONG_FORM)} THEN greatest(1200, {base} * 2) ELSE {base} END"
    code = f"CASE WHEN {has(low, C.CODE_FORM)} THEN greatest(600, ({long_form}) + 400) ELSE {long_form} END"
    short = f"CASE WHEN {has(low, C.SHORT_FORM)} THEN least({code}, greatest(150, {size} // 2)) ELSE {code} END"
    counted = "CASE " + " ".join(
        f"WHEN contains({low}, '{p}') THEN {n}" for p, n in reversed(C.WORD_COUNT_TOKENS)) + f" ELSE {short} END"
    return f"CAST(CASE WHEN {blank(text)} THEN 100 ELSE least(4000, greatest(100, {counted})) END AS INT)"


def cost(tool: str, tokens_in: str, tokens_out: str) -> str:
    def rate(i: int) -> str:
        whens = " ".join("WHEN " + " OR ".join(f"contains(lower({tool}), '{n}')" for n in names)
                         + f" THEN CAST('{rates[i] / 1_000_000.0!r}' AS DOUBLE)" for names, *rates in C.PRICES)
        return f"CASE {whens} ELSE CAST('{C.DEFAULT_PRICE[i] / 1_000_000.0!r}' AS DOUBLE) END"

    return f"(CAST({tokens_in} AS DOUBLE) * {rate(0)} + CAST({tokens_out} AS DOUBLE) * {rate(1)})"


def screening(profile: str = "core") -> str:
    """Expressions up to ``scored``."""
    names = [n for n in ORDER if n != "org"][: 5 if profile == "core" else None]
    ordered = [n for n in ORDER if n in names or n == "org"]
    return f"""
{base_sql()},
prepared AS (SELECT * REPLACE ({canonical(SUB)} AS user_id, {SUB} AS sub_user) FROM requests),
keyed AS (
  SELECT p.*, CASE WHEN {blank('p.user_id')} THEN p.user_id ELSE coalesce(CAST(u.org_id AS VARCHAR), p.user_id) END AS org_key
  FROM prepared p LEFT JOIN users u ON p.user_id = u.user_id),
texts AS ({texts('keyed')}),
{ORG_HITS},
found_all AS ({found(names)}),
found_org_too AS ({org_found('found_all')}),
combined AS (SELECT *, {' || '.join(f'found_{n}' for n in ordered)} AS detections FROM found_org_too),
totals AS (
  SELECT *, least(coalesce(list_max(list_transform(detections, lambda d: d.s)), 0), 100) AS risk_score FROM combined),
typed AS (
  SELECT *, coalesce(list_filter(detections, lambda d: d.s = list_max(list_transform(detections, lambda e: e.s)))[1].t, 'NONE')
    AS highest_risk_type, {band(1, 'NONE')} AS risk_level, {band(2, 'ALLOW')} AS action FROM totals),
scored AS (
  SELECT *, {reason()} AS action_reason, CASE WHEN action = 'REDACT' THEN {REDACTED} ELSE prompt END AS redacted_prompt
  FROM typed)"""


def auditing(profile: str = "core") -> str:
    """Expressions up to ``audit``."""
    tool = "coalesce(tool, 'Unknown')"
    used_tokens = "CASE action WHEN 'BLOCK' THEN 0 WHEN 'REDACT' THEN in_red + out_red ELSE in_all + out_all END"
    return f"""
{screening(profile)},
sized AS (
  SELECT *, {tokens('prompt')} AS in_all, {answer('prompt')} AS out_all, {tokens('redacted_prompt')} AS in_red,
    {answer('redacted_prompt')} AS out_red
  FROM scored WHERE NOT (coalesce(testing, false) AND lower({tool}) = 'dashboardtest')),
priced AS (
  SELECT *, {cost(tool, 'in_all', 'out_all')} AS cost_all, {cost(tool, 'in_red', 'out_red')} AS cost_red FROM sized),
audit AS (
  SELECT sha256(request_id) AS id,
    CASE WHEN {blank('user_id')} THEN 'anonymous-user' ELSE {trim('user_id')} END AS user_id, {tool} AS tool,
    coalesce(browser_name, 'Unknown') AS browser_name, prompt AS original_prompt, redacted_prompt, highest_risk_type,
    risk_score, risk_level, action, action_reason, CAST(NULL AS BIGINT) AS processing_time_ms,
    CAST({used_tokens} AS INT) AS tokens_used,
    CAST(CASE action WHEN 'BLOCK' THEN in_all + out_all
      WHEN 'REDACT' THEN greatest(0, in_all + out_all - in_red - out_red) ELSE 0 END AS INT) AS tokens_saved,
    CASE action WHEN 'BLOCK' THEN 0.0 WHEN 'REDACT' THEN cost_red ELSE cost_all END AS cost_used,
    CASE action WHEN 'BLOCK' THEN cost_all WHEN 'REDACT' THEN greatest(CAST(0 AS DOUBLE), cost_all - cost_red)
      ELSE CAST(0 AS DOUBLE) END AS cost_saved,
    ts AS created_at
  FROM priced)"""


SHOWN = "list_aggregate(list_transform({0}, lambda d: d.t || '|' || CAST(d.s AS VARCHAR) || '|' || d.d || '|' || d.m), 'string_agg', ' ;; ')"


def shown(column: str) -> str:
    """Detections as one text; the empty string for none."""
    return f"coalesce({SHOWN.format(column)}, '')"
