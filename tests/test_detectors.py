"""Golden prompts per detector, and rules the golden prompts do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from screenwright import catalogue as C
from screenwright.functions.detections import first_keyword, needle
from screenwright.functions.text import Words, contains_any, listed_part, long_words, normalise, part_of, piece_of, tier_of, word_ends
from screenwright.functions.tokens import response_tokens
from screenwright.operators.detectors import DETECTORS, add_text_columns, detect, run_detectors
from screenwright.operators.org_policy import detect_org_keywords
from screenwright.operators.scoring import decide, total_score
from screenwright.schemas import POLICIES
from verification.golden import GOLDEN_PROMPTS

SECTIONS = {"SEC": "secret", "PII": "personal", "PHI": "health", "SRC": "code", "CRY": "crypto", "NET": "network",
            "JWT": "jwt", "DB": "database", "CLD": "cloud", "KWD": "keyword", "JLB": "injection"}


def run(spark, name, prompts, **options):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "n int, prompt string").coalesce(1)
    rows = detect(df, name, **options).orderBy("n").collect()
    return [[(d.score, d.matched_value) for d in r.detections] for r in rows]


@pytest.mark.parametrize("section", SECTIONS)
def test_golden_scores(spark, section):
    cases = [(i, score, p) for i, _documented, score, p in GOLDEN_PROMPTS if i.startswith(section + "-")]
    df = spark.createDataFrame(cases, "case_id string, score int, prompt string").coalesce(1)
    scored = detect(df, SECTIONS[section]).withColumn("got", total_score(F.col("detections")))
    assert scored.filter("got <> score").select("case_id", "score", "got").collect() == []
    assert scored.count() == len(cases)


def test_golden_scores_of_organisations_without_policies(spark):
    cases = [(i, score, p, "9", "u") for i, _documented, score, p in GOLDEN_PROMPTS if i.startswith("ORG-")]
    df = spark.createDataFrame(cases, "case_id string, score int, prompt string, org_key string, sub_user string").coalesce(1)
    scored = detect_org_keywords(add_text_columns(df), spark.createDataFrame([], POLICIES)).withColumn(
        "got", total_score(F.col("_found_org")))
    assert scored.filter("got <> score").select("case_id", "score", "got").collect() == []
    assert scored.count() == len(cases) == 16


def test_golden_actions_follow_the_documented_letter_where_scores_agree(spark):
    letters = {"B": "BLOCK", "R": "REDACT", "A": "ALERT", "S": "ALLOW"}
    moved = {"CRY-R1", "KWD-R1", "KWD-R2", "KWD-R3", "KWD-R4", "KWD-A1", "KWD-A3"}
    cases = [(i, letters[i.split("-")[1][0]], score) for i, documented, score, _ in GOLDEN_PROMPTS
             if documented == score and i not in moved]
    df = spark.createDataFrame(cases, "case_id string, action string, score int").coalesce(1)
    assert df.filter(decide(F.col("score")) != F.col("action")).collect() == []


def test_blank_prompts_find_nothing(spark):
    for name in DETECTORS:
        assert run(spark, name, [None, "", " \t\n", " "]) == [[], [], [], []]


def test_personal_reports_first_match_of_each_kind_and_both_layers(spark):
    found = run(spark, "personal", [
        "my mail is a.b@example.com or c.d@example.org",
        "is my email a.b@example.com safe?",
        "smile \U0001f600 my card is 4111 1111 1111 1111 été",
        "card 1234-5678-9012-3456",
    ])
    assert found[0] == [(60, "a.b@example.com")]
    assert (20, C.FINDINGS["personal", "inquiry"][3]) not in found[1]
    # A boundary before a letter outside ASCII lets the match take the separator in front of it.
    assert (75, "4111 1111 1111 1111 ") in found[2]
    assert (75, "1234-5678-9012-3456") in found[3]


def test_network_reports_every_public_address(spark):
    found = run(spark, "network", [
        "8.8.8.8 10.0.0.1 192.168.1.9 172.16.4.4 172.17.4.4 9.9.9.9 127.0.0.1 0.1.2.3 fe80:1:2:3:4:5:6:7",
        "10.0.0.1 ipaddress"])
    assert found[0] == [(70, "8.8.8.8"), (70, "172.17.4.4"), (70, "9.9.9.9"), (65, "fe80:1:2:3:4:5:6:7")]
    assert found[1] == [(70, "ip address")]


def test_keywords_report_the_first_in_list_order(spark):
    assert run(spark, "keyword", ["nda, confidential and drop table", "the nda is confidential", "disabled"]) == [
        [(100, "drop table")], [(55, "confidential")], [(60, "disabled")]]


def test_spaced_mode_finds_keywords_of_several_words(spark):
    prompt = ["my seed phrase"]
    assert run(spark, "crypto", prompt) == [[]]
    assert run(spark, "crypto", prompt, mode="spaced") == [[(90, "seed phrase")]]
    with pytest.raises(ValueError):
        run(spark, "crypto", prompt, mode="other")


def test_python_class_alone_has_an_empty_snippet(spark):
    assert run(spark, "code", ["class Job:\n  pass", "x\ndef f(a):\n  1"]) == [[(50, "")], [(50, "def f(")]]
    assert run(spark, "code", ["public class " + "A" * 80])[0][0] == (70, ("public class " + "A" * 80)[:60])


def test_long_prompts_are_scanned_to_the_end(spark):
    filler = "lorem ipsum " * 20_000
    found = run(spark, "personal", [filler + "123-45-6789"])
    assert found == [[(75, "123-45-6789")]]


def test_keywords_are_found_among_long_words_as_in_the_text(spark):
    """Keywords of any length, of several words, across separators, at both ends and in words of any script."""
    rnd = random.Random(5)
    words = ("i", "my", "otp", "ssn", "api key", "apikey", "system ", "rm -rf", "password", "source code", "here is", "authentication",
             "db_password", "eyJ", "0x", "@", "what's wrong with", "new task:", "internationalisation")
    fill = ["über", "xx", "naïvepassworden", "pass", "word", "a.p.i", "key", "\t", "\n", "--", "пароль", "Authentication", "re-authentications", ""]
    texts = [rnd.choice(["", " ", "-", "."]).join(rnd.choice([*fill, *words]) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string").coalesce(1)
    df = df.select("prompt", F.lower("prompt").alias("lower"), normalise(F.col("prompt")).alias("norm"))
    df = df.withColumn("among", long_words(F.col("norm")))
    asked = [(form, listed) for form in ("prompt", "lower", "norm") for listed in (words[:4], words[4:9], words[9:14], words[14:], ("my",), ("rm -rf",))]
    found = [c for form, listed in asked for c in (contains_any(F.col(form), listed, F.col("among")), first_keyword(F.col(form), listed, F.col("among")))]
    for row in df.select("prompt", "lower", "norm", *found).collect():
        for k, (form, listed) in enumerate(asked):
            held = [w for w in listed if w in row[form]]
            assert (row[3 + 2 * k], row[4 + 2 * k]) == (bool(held), held[0] if held else None), (form, listed, row[form])
    assert (part_of("rm -rf"), part_of("db_password"), tier_of("i"), tier_of("password")) == ("rm", "password", 0, 3)
    among = df.where("norm LIKE '%authentication%'").select("among").first()[0]
    assert all(len(w.encode()) >= 12 for w in among[5].split(" ") if w) and "authentication" in among[5]


def test_keywords_are_found_among_the_ends_of_words(spark):
    """One pattern keeps the end of a word from the first piece on; a keyword is found there wherever it lies in a word."""
    rnd = random.Random(7)
    words = ("key", "api key", "password", "secret key", "bypass", "sk-", "my", "token", "kubernetes", "keyboard", "what's wrong with",
             "passphrase", "ssn", "über key", "otp", "iam")
    fill = ["xx", "über", "mon", "pass", "phrase", "word", "s.e.c.r.e.t", "\t", "\n", "Key", "пароль", "\u00a0", "a|b", ""]
    texts = [rnd.choice(["", " ", "-", "'"]).join(rnd.choice([*fill, *words]) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string").coalesce(1)
    df = df.select(F.lower("prompt").alias("lower"), normalise(F.col("prompt")).alias("norm"))
    asked = [(form, listed) for form in ("lower", "norm") for listed in (words[:4], words[4:9], words[9:], ("my",), ("bypass", "pass"))]
    among = Words(F.col("among"))
    found = [c for form, listed in asked for c in (contains_any(F.col(form), listed, among), first_keyword(F.col(form), listed, among))]
    assert among.pieces >= {"key", "kubernetes", "keyboard", "bypass", "word"} and not any(p[0] in "aeinort" for p in among.pieces)
    kept = df.withColumn("among", F.array_append(long_words(F.col("norm")), word_ends(long_words(F.col("norm")), among.pieces)))
    for row in kept.select("lower", "norm", "among", *found).collect():
        ends = set()
        for word in row.norm.split(" "):
            starts = [word.find(p) for p in among.pieces if p in word]
            ends |= {word[min(starts):]} if starts else set()
        assert set(filter(None, row.among[-1].split(" "))) == ends, row.norm
        for k, (form, listed) in enumerate(asked):
            held = [w for w in listed if w in row[form]]
            assert (row[3 + 2 * k], row[4 + 2 * k]) == (bool(held), held[0] if held else None), (form, listed, row[form])


def test_screening_looks_for_most_keywords_among_the_ends_of_words(spark):
    """The work on a text must not grow with the number of keywords: few are looked for among its words one by one."""
    df = spark.createDataFrame([("1", "a prompt")], "request_id string, prompt string")
    plan = run_detectors(df, tuple(DETECTORS))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan
    listed = [listed_part(part_of(needle(w, " ", "compact")), Words(F.col("_words"))) for name in dir(C)
              if name.startswith(("KEYWORD_", "HEALTH_", "PERSONAL_S", "DB_ARCH", "CLOUD_INFRA", "NETWORK_I", "GUARDRAIL", "ORG_")) and "PATTERN" not in name
              for w in getattr(C, name)]
    assert len(listed) > 200 and sum(entry["tier"] <= 5 for entry in listed) < len(listed) / 5


def test_parts_of_common_letters_have_pieces_too():
    """Every one of these was looked for in all words of a text."""
    pieces = [piece_of(part) for part in ("ethics", "history", "identity", "token", "login", "ssn", "share", "table", "my", "otp", "über")]
    assert pieces == ["hics", "history", "dentity", "ken", "login", "ssn", "hare", "ble", "", "", ""]


def test_white_space_collapses_in_one_pass(spark):
    texts = [" a\tb", "a \n b", "a\x0b\x0c\rb  c d", "a -  - b", "\u00a0 \u00a0", "a b", "\t", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalise(F.col("t")).alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 2
    assert [r.n for r in df.orderBy("i").collect()] == ["a b", "a b", "a b c d", "a b", "\u00a0 \u00a0", "a b", "", "", ""]


def test_expected_answers_up_to_the_limit(spark):
    def plain(text):
        size, low = -(-len(text) // 4), text.lower()
        n = max(300, size * 3)
        n = max(1200, n * 2) if any(w in low for w in C.LONG_FORM) else n
        n = max(600, n + 400) if any(w in low for w in C.CODE_FORM) else n
        n = min(n, max(150, size // 2)) if any(w in low for w in C.SHORT_FORM) else n
        for phrase, tokens in C.WORD_COUNT_TOKENS:
            n = tokens if phrase in low else n
        return min(4000, max(100, n))

    texts = [f"{head} {'z' * n}" for n in (5, 300, 1600, 3900, 5270, 5330, 5340, 5400, 20_000, 40_000)
             for head in ("x", "Essay", "code", "fix", "essay code", "essay fix", "code fix", "100 words", "2000 words fix essay", "00 words", "500 words 1000 words")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", response_tokens(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [plain(t) for t in texts]
    # A text at the limit is not searched for what would only add.
    chosen = df._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 4000" in chosen


def test_a_text_is_prepared_once_however_many_words_are_looked_for(spark):
    """The optimiser must not put the preparation of a text used once into the search of each word."""
    texts = spark.createDataFrame([("My Pass-Word",), (None,)], "prompt string").select(normalise(F.col("prompt")).alias("norm"))
    listed = ("nothing", "password", "my")
    found = texts.select(contains_any(F.col("norm"), listed).alias("any"), "norm").select(
        "any", first_keyword(F.col("norm"), listed).alias("first"))
    for one in (texts.select(contains_any(F.col("norm"), listed)), texts.select(first_keyword(F.col("norm"), listed))):
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert not any("regexp_replace" in part for part in plan.split("Contains(")[1:] if "lambda" not in part.split(",")[0])
    assert [tuple(r) for r in found.collect()] == [(True, "password"), (False, None)]
